"""Scalar functions over text, names and times, as Column expressions.

Patterns say ``(?U)`` where letters beyond ASCII count as word characters. Null in, null out, unless
a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a passage's subject.
STOP_WORDS = ("для", "или", "при", "над", "под", "это", "что", "как", "где", "the", "and", "with", "from", "this", "that")

#: Endings a query word may lose, in the order they are tried.
SUBJECT_ENDINGS = ("ами", "ями", "ов", "ев", "ей", "ам", "ям", "ах", "ях", "ой", "ы", "и", "а", "я", "у", "ю", "е", "о")

#: Endings of the lexical stemmer, in the order they are tried.
LEXICAL_ENDINGS = tuple("иями ям ыми ейший ейшая ейшее ейшие ейших ого его ому ему ими ых их ою ею ая яя ое ее ые ие ым им ом ем ах ях ов ев ей ам ит ет ут ют ат ят ти а е и й о у ы ь я ю ию".split())

#: Spellings of one unit of quantity.
UNIT_ALIASES = {
    "м": "м", "мп": "м", "пм": "м", "погм": "м", "метр": "м",
    "м2": "м2", "квм": "м2", "м²": "м2", "м3": "м3", "кубм": "м3", "м³": "м3",
    "шт": "шт", "штук": "шт", "штука": "шт",
    "компл": "компл", "комплект": "компл", "кт": "компл", "кмпл": "компл",
    "кг": "кг", "т": "т", "тн": "т", "л": "л",
}


def instant(c: Column) -> Column:
    """An ISO-8601 text in any of its notations as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.trim(c))


def content_key(c: Column) -> Column:
    """What identifies a content: the first 16 hex digits of its sha256, lower case; null if empty."""
    k = F.lower(F.substring(F.trim(c), 1, 16))
    return F.when(F.length(k) > 0, k)


def last_part(c: Column) -> Column:
    """The last part of a path of either kind of slash."""
    return F.regexp_extract(c, r"([^\\/]*)$", 1)


def suffix(c: Column) -> Column:
    """The extension, lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(last_part(c), r"\.([A-Za-z][A-Za-z0-9]{0,4})$", 1))


def stem(c: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(last_part(c), r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")


def folded(c: Column) -> Column:
    """Small letters, ё as е, white space as single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"(?U)\s+", " "))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of digits and Latin or Russian letters of at least two characters, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9a-zа-яё]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def _cut(word: Column, endings: tuple[str, ...], least: int) -> Column:
    out = F.lit(None).cast("string")
    for e in reversed(endings):
        out = F.when(word.endswith(e) & (F.length(word) - len(e) >= least), F.substring(word, F.lit(1), F.length(word) - len(e))).otherwise(out)
    return F.coalesce(out, word)


def subject_stem(word: Column) -> Column:
    """A query word without its ending, if it is of letters and hyphens and five characters remain."""
    w = F.lower(F.trim(word))
    return F.when(w.rlike(r"^[\p{L}-]+$"), _cut(w, SUBJECT_ENDINGS, 5)).otherwise(w)


def lexical_stem(word: Column) -> Column:
    """A Russian word of at least four letters without its ending, if at least four remain."""
    return F.when(word.rlike("^[а-яё]{4,}$"), _cut(word, LEXICAL_ENDINGS, 4)).otherwise(word)


def lexical_words(c: Column) -> Column:
    """The words behind the terms a text is indexed by: runs of letters and digits with inner points and
    hyphens, of at least three characters, without stop words."""
    raw = F.regexp_extract_all(F.translate(F.lower(c), "ё", "е"), F.lit(r"[0-9a-zа-я]+(?:[.-][0-9a-zа-я]+)*"), F.lit(0))
    return F.filter(raw, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def lexical_terms(c: Column) -> Column:
    """The terms a text is indexed by: its lexical words, Russian ones by their stem."""
    return F.transform(lexical_words(c), lambda t: F.when(t.rlike("[0-9]"), t).otherwise(lexical_stem(t)))


def term_id(term: Column) -> Column:
    """The 31-bit checksum that numbers a term in a sparse vector."""
    return F.crc32(term).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def number(c: Column) -> Column:
    """The first number of a Russian-written text: blanks part thousands; of point and comma the last is
    the decimal one, a single kind repeated parts thousands. Null where there is none; NaN is null."""
    s = F.translate(c, chr(0xA0) + chr(0x202F) + chr(0x2009), "   ")
    t = F.replace(F.regexp_extract(s, r"-?[0-9][0-9 .,]*[0-9]|-?[0-9]", 0), F.lit(" "), F.lit(""))
    point, comma = F.instr(t, ".") > 0, F.instr(t, ",") > 0
    last_comma = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    plain = (
        F.when(point & comma & last_comma, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(point & comma, F.replace(t, F.lit(","), F.lit("")))
        .when(comma, F.replace(t, F.lit(","), F.lit(".")))
        .when(F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) > 1, F.replace(t, F.lit("."), F.lit("")))
        .otherwise(t)
    )
    return F.when(F.length(t) > 0, plain.try_cast("double"))


def unit(c: Column) -> Column:
    """One spelling for each unit of quantity; null is the empty unit."""
    key = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е"), r"(?U)[\s.-]", "")
    table = F.create_map(*(F.lit(x) for kv in UNIT_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), key)


def formatted(x: Column) -> Column:
    """A total for reading: blanks part thousands, two decimals unless it is whole."""
    whole = F.translate(F.format_number(x, 0), ",", " ")
    return F.when(x == F.floor(x), whole).otherwise(F.translate(F.format_number(x, 2), ",", " "))


def contains_whole(text: Column, token: str) -> Column:
    """Whether a text holds an identifier as a whole: no word character touches it, nor one behind a joint (. / -)."""
    q = "\\Q" + token + "\\E"
    return text.rlike(rf"(?iu)(?U)(?<!\w)(?<!\w[.\-/]){q}(?!\w)(?![.\-/]\w)")


def identifiers(c: Column) -> Column:
    """The identifiers of a text, in order, each once: dotted or hyphenated of three parts, short marks, letters glued to digits. Bare numbers are quantities."""
    raw = F.regexp_extract_all(c, F.lit(r"""[^\s,;()\[\]«»"']+"""), F.lit(0))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^[.,;:]+|[.,;:]+$", ""))
    shaped = lambda t: (
        t.rlike(r"(?U)^\w+(?:[.\-/]\w+){2,}$") | t.rlike(r"^(?=.*[A-Za-zА-Яа-яЁё])(?=.*[0-9])[A-Za-zА-Яа-яЁё0-9_.\-/]{5,}$") | t.rlike(r"(?U)^[A-Za-zА-Яа-яЁё]{1,4}[0-9]{1,3}-\w{1,6}$")
    )
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & t.rlike("[0-9]") & ~t.rlike(r"^[0-9]+(?:[.,][0-9]+)?$") & shaped(t)))


def norm_designations(c: Column) -> Column:
    """Names of norms: a marker with its number, in capitals and with one blank between."""
    t = F.regexp_replace(F.translate(c, "ёЁ", "еЕ"), r"(?U)\s+", " ")
    found = F.regexp_extract_all(F.upper(t), F.lit(r"(?<![А-ЯA-Z0-9])((?:ГОСТ Р|ГОСТ|СНИП|САНПИН|ВСН|СП|СТО|РД|РТН|НТД|ВИТ) ?№? ?[0-9]+(?:[.\-][0-9]+)*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r" ?№? ?([0-9].*)$", " $1")))


# the four identities of a document; they differ on purpose

_COPY = r"[\s_]*\(\d+\)$"


def retrieval_identity(path: Column) -> Column:
    """Copies collapse; a two-digit tail is an issue only behind a dotted number."""
    s = F.regexp_replace(F.lower(stem(path)), "(?U)" + _COPY, "")
    return F.when(s.rlike(r"\d\.\d"), F.regexp_replace(s, r"(?<=[\d)])-\d{2}$", "")).otherwise(s)


def table_identity(path: Column) -> Column:
    """Copies collapse; a two-digit tail is always an issue."""
    return F.regexp_replace(F.regexp_replace(F.lower(stem(path)), "(?U)" + _COPY, ""), r"-\d{2}$", "")


def family_identity(path: Column) -> Column:
    """Copies, parts and issues collapse, however many of them stand at the end."""
    s = F.regexp_replace(F.lower(stem(path)), r"(?U)(?:\s*\(\d+\)|_part\d+)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?:-\d{2}|\.\d{2})+$", ""), r"(?U)\s+", " "))


def pair_identity(path: Column) -> Column:
    """Only the copy mark collapses."""
    return F.regexp_replace(F.lower(stem(path)), "(?U)" + _COPY, "")


def document_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 8)
