"""Which files a table question is about, and what of their rows is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import subject_stem
from tesserae.operators.tables import EXACT_HEADERS, header_field, header_text, one_file_per_document

#: Extensions of files that may hold tables; files a question reads at most.
TABLE_EXTENSIONS, MOST_FILES = ("pdf", "xlsx", "csv", "docx"), 20


def mentioning(parents: DataFrame, keywords: list[str]) -> DataFrame:
    """(source_path) of files with a parent that holds any of the keywords' stems, each once. Without keywords none."""
    any_of = F.lit(False)
    for k in keywords:
        any_of = any_of | F.contains(F.lower("parent_text"), subject_stem(F.lit(k)))
    return parents.filter(any_of & F.col("source_path").isNotNull()).select("source_path").distinct()


def resolve_files(files: DataFrame, parents: DataFrame, keywords: list[str], source_like: str | None = None, dataset: str | None = None, most: int = MOST_FILES) -> DataFrame:
    """(source_path, document, mentions, position): files that may hold tables, one for each document.

    Those that mention a keyword come first, then by path. A part of the path or a dataset narrows all.
    Without a part of the path, files that don't mention a keyword count only if none does.
    """
    f = files.filter(F.lower("source_path").rlike(rf"\.(?:{'|'.join(TABLE_EXTENSIONS)})$"))
    if source_like:
        f = f.filter(F.contains(F.lower("source_path"), F.lit(source_like.lower())))
    if dataset:
        f = f.filter(F.col("dataset") == dataset)
    hit = mentioning(parents, keywords).withColumn("mentions", F.lit(True))
    f = f.join(hit, "source_path", "left").withColumn("mentions", F.coalesce("mentions", F.lit(False)))
    if not source_like:
        any_ = f.agg(F.max("mentions").alias("_any"))
        f = f.join(F.broadcast(any_), F.col("mentions") | ~F.coalesce("_any", F.lit(False)), "left_semi")
    one = one_file_per_document(f)
    # a question's files are few: the list is cut where it is built
    first = one.select("source_path", "document", "mentions").orderBy(F.desc("mentions"), "source_path").limit(most)
    from pyspark.sql import Window

    return first.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mentions"), "source_path")))


def _filled(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.length(F.trim(F.coalesce(v, F.lit("")))) > 0)


def full_row(typed: list[str]) -> Column:
    """A row as one map: its typed fields, and raw columns that don't hide one; empty cells fall away."""
    fields = F.map_from_arrays(F.array(*map(F.lit, typed)), F.array(*(F.col(c).cast("string") for c in typed)))
    raw = F.map_filter(F.coalesce("raw_row", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*typed) | F.element_at(fields, k).isNull())
    return F.map_concat(_filled(fields), F.map_filter(_filled(raw), lambda k, v: ~F.array_contains(F.map_keys(_filled(fields)), k)))


def row_preview(source: Column, fields: tuple[str, ...] = ("pos", "name", "unit", "qty", "amount", "price")) -> Column:
    """The few fields of a row that are shown, with the name of its file."""
    m = F.map_from_arrays(F.array(*map(F.lit, (*fields, "source"))), F.array(*(F.col(c).cast("string") for c in fields), F.regexp_extract(source, r"([^\\/]*)$", 1)))
    return _filled(m)


def _names_mark(header: Column) -> Column:
    h = header_text(header)
    return h.isin(*EXACT_HEADERS) | (header_field(header) == "mark")


def repaired_mark(mark: Column, raw: Column) -> Column:
    """A row's mark, or null if the raw columns it came from are no mark columns. A value no raw column holds stays."""
    held = F.filter(F.map_entries(raw), lambda x: F.trim(x["value"]) == F.trim(mark))
    wrong = (F.size(held) > 0) & ~F.exists(held, lambda x: _names_mark(x["key"]))
    return F.when(~F.coalesce(wrong, F.lit(False)), mark)


def row_mark(mark: Column, name: Column, raw: Column) -> Column:
    """What a row is called by: its first filled mark column, else its mark, else its name; empty if it has none."""
    own = F.filter(F.map_entries(raw), lambda x: (F.length(F.trim(F.coalesce(x["value"], F.lit("")))) > 0) & _names_mark(x["key"]))
    return F.trim(F.coalesce(F.get(own, F.lit(0))["value"], F.when(F.length(F.trim(mark)) > 0, mark), name, F.lit("")))


_ABSOLUTE = r"(?<![\w/\\])(?:[A-Za-z]:[\\/]|\\\\|/(?:home|Users|root|mnt|opt|var|tmp|srv)/)[^\s,;\"\'<>|]*"


def redacted(text: Column) -> Column:
    """A text for others to read: absolute paths of this machine fall away."""
    return F.regexp_replace(text, _ABSOLUTE, "[redacted-path]")


def safe_error(error: Column) -> Column:
    """An error for others to read: that there is one, not what it says. An empty one stays empty."""
    return F.when(F.length(F.trim(error)) > 0, F.lit("internal_error")).otherwise(error)


def decimal_points(text: Column) -> Column:
    """Commas between digits as points."""
    return F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", ".")


def row_json(raw: Column) -> Column:
    return F.to_json(raw)


def json_row(text: Column) -> Column:
    """The map of a row's JSON; null where it is none."""
    return F.from_json(text, "map<string,string>")
