"""Problem 4: noise in texts of scanned pages, found and repaired.

Misread words. All words of the corpus are counted. Frequent words of one script are the dictionary;
any other word's correction candidates come from a join on character q-grams inverted over the
dictionary. The q-grams are positional: a dictionary word is cut into ``MISREAD`` + 1 even pieces, of
which at least one stands unharmed in a word with up to ``MISREAD`` misread letters, at its place or
shifted by as many characters as the word is longer or shorter. Gradient-boosted trees rank all
candidates by how well known look-alikes explain the difference, by overlap and by frequency. The
trees are fitted on dictionary words misread on purpose, and on pairs of dictionary words as the
negatives. Words of one or two letters have too little to go by and are never corrected.

Lines. Two classifiers of the same kind look at neighbouring lines: one says whether a hyphen at a
line's end breaks a word, the other whether a line is furniture (page number, running header). They
are fitted on sample texts set into pages on purpose, about ``SAMPLE`` of them; all else, counts
and candidates, covers the whole corpus. A line with a number may be furniture, and one without if it
recurs in its text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.boost import Boosted
from tesserae.llm.frequent import most_frequent, sample_texts
from tesserae.llm.spans import LETTER, NUMBER, char_values, chunks, classes, code_points, span_hashes
from tesserae.session import checkpoint

#: Most texts the line classifiers are fitted on, and most words the ranking is fitted on.
SAMPLE, SAMPLE_WORDS = 1000, 1500
#: A dictionary word occurs at least so often, and so many times as often as a misreading of it.
LEAST, RATIO = 10, 12
#: Misread letters of a word up to which every dictionary word is a candidate, and how much longer or shorter that may make it.
MISREAD, LONGER, SHORTER = 3, 3, 1
#: Most words whose hashes workers hold to pass over ordinary words quickly; it never changes a result.
LEXICON = 200_000
ACCEPT = 0.5

HYPHENS = "-¬" + chr(0x2010) + chr(0xAD)
_MARKS = "†>}{|"
#: What a character looks like to a bad reader (true, read).
LOOKS = tuple(
    (a, b)
    for a, bs in {
        "о": "0 o", "а": "a", "е": "e", "р": "p c", "с": "c", "х": "x", "у": "y", "к": "k", "м": "лл m", "н": "и п h", "т": "† t т", "и": "u н",
        "п": "н л", "л": "п", "д": "л", "в": "8", "з": "3 э", "э": "з", "ч": "4", "б": "6", "ы": "bl ьi ьl", "ь": "ъ b", "ж": ">к }к", "ю": "lo io 10", "ш": "щ", "щ": "ш", "ц": "п", "г": "r", "я": "r",
        "o": "0 о", "a": "а", "e": "c е", "p": "р", "c": "с e", "x": "х", "y": "у", "t": "f †", "n": "ri ii", "s": "5", "l": "1 i", "i": "1 l", "d": "cl", "g": "9 q", "h": "b li", "m": "rn", "w": "vv", "b": "6", "u": "ii v", "ü": "ii u", "ö": "o", "ä": "a", "ß": "b 8", "z": "2", "q": "9", "f": "t",
    }.items()
    for b in bs.split(" ")
)
#: Two letters that may be read as the one they look like (true, read).
MERGED = tuple((b, a) for a, b in LOOKS if len(b) == 2 and re.fullmatch("[a-z]{2}|[а-яё]{2}", b))
_LOOK_SET = frozenset(LOOKS + MERGED)
_BREAK = re.compile(rf"([^\W\d_])[{HYPHENS}][ \t]*(?:\r\n|\r|\n)\s*([^\W\d_])")
_CODE = re.compile(r"[^\W_]{1,5}(?:[-.][^\W_]{1,8}){2,}|[^\W\d_]{2,4}-\d+[^\W\d_]\d+")
_LINE = re.compile(r"\r\n|\r|\n")
_DROP = {0xFEFF: None, 0x200B: None}
#: Combining marks and marks without width; only texts that hold one are composed anew.
_MARKED = re.compile(f"[{chr(0x300)}-{chr(0x36F)}{chr(0xFEFF)}{chr(0x200B)}]")
_OPEN = re.compile(rf"[{HYPHENS}][ \t]*(?:[\r\n]|$)")
_PIECE = re.compile(rf"\w+[{HYPHENS}][ \t]*(?=[\r\n]|$)")


def tidy(text: str) -> str:
    """One composition of letters, no byte order marks."""
    if _MARKED.search(text):
        text = unicodedata.normalize("NFC", text.translate(_DROP))
    return text


# words


def tokens(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: runs of letters, digits and marks that letters are misread as.

    Words broken over lines are joined; item codes are left out, and so are words without a letter,
    words mostly of digits and the pieces at a line's end that stay apart. Gives the joined text,
    start, end, hash and text number of each word.
    """
    plain = []
    for t in texts:
        t = tidy(t) if t else ""
        if _OPEN.search(t):
            t = _BREAK.sub(r"\1\2", t)
            if _OPEN.search(t):
                t = _PIECE.sub(" ", t)
        plain.append(t.replace(chr(0xAD), "").lower())
    codes, starts = code_points(plain)
    kind = classes(codes)
    letter = kind == LETTER
    inside = letter | (kind == NUMBER)
    for m in _MARKS[:3]:
        inside |= codes == ord(m)
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.concatenate([[0], np.cumsum(letter)])
    letters = sums[end] - sums[start]
    keep = (letters * 2 > end - start) & (end - start >= 2) & ~_in_codes(codes, kind, first, start)
    start, end = start[keep], end[keep]
    return "".join(plain), start, end, span_hashes(char_values(codes), start, end), np.searchsorted(starts, start, "right") - 1


def _in_codes(codes: np.ndarray, kind: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which words are part of an item code: a run with digits whose parts are joined by points, hyphens or slashes."""
    if not len(codes):
        return np.zeros(len(start), bool)
    solid = (kind == LETTER) | (kind == NUMBER)
    joint = (codes == 45) | (codes == 46) | (codes == 47)
    inner = joint.copy()
    inner[0] = inner[-1] = False
    inner[1:-1] &= solid[:-2] & solid[2:] & ~first[1:-2] & ~first[2:-1]
    part = solid | inner
    begin = part.copy()
    begin[1:] &= ~part[:-1] | first[1:-1]
    chunk = np.cumsum(begin) - 1
    n = int(chunk[-1]) + 1
    if not n:
        return np.zeros(len(start), bool)
    joints = np.bincount(chunk[inner], minlength=n)
    digits = np.bincount(chunk[(kind == NUMBER) & part], minlength=n)
    code = ((joints >= 2) & (digits >= 1)) | ((joints >= 1) & (digits >= 2))
    return code[np.maximum(chunk[start], 0)]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for part in chunks(b.column(0)):
                joined, start, end, key, _ = tokens(part.to_pylist())
                code, unique = pd.factorize(key)
                place = np.zeros(len(unique), np.int64)
                place[code[::-1]] = np.arange(len(code))[::-1]
                for p, n in zip(place.tolist(), np.bincount(code, minlength=len(unique)).tolist()):
                    seen[joined[start[p] : end[p]]] += n
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


_CYR, _LAT = re.compile("[а-яё]"), re.compile(r"[a-zäöüß]")


def one_script(word: str) -> bool:
    return word.isalpha() and not (_CYR.search(word) and _LAT.search(word))


def difference(read: str, true: str) -> tuple[str, str]:
    """What is left of both without their common beginning and end."""
    i = 0
    while i < min(len(read), len(true)) and read[i] == true[i]:
        i += 1
    j = 0
    while j < min(len(read), len(true)) - i and read[-1 - j] == true[-1 - j]:
        j += 1
    return read[i : len(read) - j], true[i : len(true) - j]


def explained(read: str, true: str) -> tuple[int, int]:
    """(look-alikes, other edits) of the cheapest way from the true word to the read one; one look-alike costs a fifth of an edit."""
    a, b = difference(read, true)
    if (b, a) in _LOOK_SET:
        return 1, 0
    if not a and not b:
        return 0, 0
    wide = _band(max(len(a), len(b)))
    best = {(0, 0): (0, 0)}
    cost = lambda c: c[0] + 5 * c[1]
    for i in range(len(b) + 1):
        for j in range(len(a) + 1):
            now = best.get((i, j))
            if now is None:
                continue
            steps = []
            if j < len(a) and (b[i : i + 2], a[j]) in _LOOK_SET:
                steps.append((i + 2, j + 1, (now[0] + 1, now[1])))
            if i < len(b) and j < len(a) and a[j] == b[i]:
                steps.append((i + 1, j + 1, now))
            if i < len(b):
                steps += [(i + 1, j + k, (now[0] + 1, now[1])) for k in (1, 2) if j + k <= len(a) and (b[i], a[j : j + k]) in _LOOK_SET]
                steps.append((i + 1, j, (now[0], now[1] + 1)))
                if j < len(a):
                    steps.append((i + 1, j + 1, (now[0], now[1] + 1)))
            if j < len(a):
                steps.append((i, j + 1, (now[0], now[1] + 1)))
            for x, y, c in steps:
                if abs(x - y) <= wide and ((x, y) not in best or cost(c) < cost(best[x, y])):
                    best[x, y] = c
    return best.get((len(b), len(a)), (0, max(len(a), len(b))))


def _band(size: int) -> int:
    """How far the places of two words may drift apart; long words are aligned near the diagonal only."""
    return size if size <= 14 else 8


_SEEN = sorted({c for pair in LOOKS for x in pair for c in x})
_PLACE = np.zeros(0x3000, np.uint8)
_PLACE[[ord(c) for c in _SEEN]] = np.arange(1, len(_SEEN) + 1)
_ONE = np.zeros((len(_SEEN) + 1,) * 2, bool)
_TWO = np.zeros((len(_SEEN) + 1,) * 3, bool)
_PAIR = np.zeros((len(_SEEN) + 1,) * 3, bool)
for _a, _b in LOOKS:
    (_ONE if len(_b) == 1 else _TWO)[tuple(_PLACE[[ord(c) for c in _a + _b]])] = True
for _a, _b in MERGED:
    _PAIR[tuple(_PLACE[[ord(c) for c in _a + _b]])] = True


def explained_all(reads: list[str], trues: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``explained`` of many pairs at once: the same steps in the same order, each for all pairs."""
    rest = [difference(r, t) for r, t in zip(reads, trues)]
    la, lb = (np.array([len(x[i]) for x in rest], np.int64) for i in (0, 1))
    size = np.maximum(la, lb)
    looks, edits = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
    tops = [0, 3, 6, 9, 14]
    while len(size) and tops[-1] < size.max():
        tops.append(2 * tops[-1])
    for low, high in zip(tops, tops[1:]):
        rows = np.flatnonzero((size > low) & (size <= high))
        if not len(rows):
            continue
        # padded to one length, a column of codes for each place
        a, b = (np.array([rest[r][i] for r in rows], f"U{high}").view(np.uint32).reshape(-1, high).T for i in (0, 1))
        pa_, pb = (np.where(x < len(_PLACE), _PLACE[np.minimum(x, len(_PLACE) - 1)], 0) for x in (a, b))
        # the cost in the upper half, the edits in the lower; a later way must cost less to be taken
        kind = np.int16 if high <= 14 else np.int64
        shift = 6 if high <= 14 else 24
        better = lambda now, new: np.where(new >> shift < now >> shift, new, now)
        look, edit, never = kind(1 << shift), kind((5 << shift) + 1), np.full(len(rows), (1 << 14) if high <= 14 else (1 << 56), kind)
        wide = np.where(size[rows] <= 14, high, 8)
        history: list[list[np.ndarray]] = []
        for i in range(high + 1):
            row: list[np.ndarray] = []
            for j in range(high + 1):
                v = never if i or j else np.zeros(len(rows), kind)
                if abs(i - j) <= 9 or high <= 14:
                    last = history[-1] if i else row
                    if i > 1 and j:
                        v = better(v, np.where(_PAIR[pb[i - 2], pb[i - 1], pa_[j - 1]], history[-2][j - 1] + look, never))
                    if i:
                        if j > 1:
                            v = better(v, np.where(_TWO[pb[i - 1], pa_[j - 2], pa_[j - 1]], last[j - 2] + look, never))
                        if j:
                            cost = np.where(b[i - 1] == a[j - 1], 0, np.where(_ONE[pb[i - 1], pa_[j - 1]], look, edit)).astype(kind)
                            v = better(v, last[j - 1] + cost)
                        v = better(v, last[j] + edit)
                    if j:
                        v = better(v, row[j - 1] + edit)
                    # beyond the band there is no way on
                    v = np.where(abs(i - j) <= wide, v, never)
                row.append(v)
            history = [*history[-1:], row]
            at = np.flatnonzero(lb[rows] == i)
            if len(at):
                v = np.stack(row)[la[rows[at]], at].astype(np.int64)
                lost = v >= int(never[0])
                e = v & ((1 << shift) - 1)
                edits[rows[at]] = np.where(lost, size[rows[at]], e)
                looks[rows[at]] = np.where(lost, 0, (v >> shift) - 5 * e)
    return looks, edits


def pair_features(read: str, n: float, true: str, m: float, shared: float) -> list[float]:
    looks, edits = explained(read, true)
    return [looks, edits, len(true), shared / max(1, len(true) + 1), float(np.log1p(m)), float(np.log(m / n)), float(one_script(read)), (looks + 2 * edits) / len(true)]


def features_all(reads: list[str], n: np.ndarray, trues: list[str], m: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """``pair_features`` of many pairs, a row each."""
    looks, edits = explained_all(reads, trues)
    size = np.array([len(t) for t in trues], np.int64)
    pure = {w: one_script(w) for w in set(reads)}
    return np.stack([looks, edits, size, shared / np.maximum(1, size + 1), np.log1p(m), np.log(m / n), np.array([pure[w] for w in reads], bool), (looks + 2 * edits) / size], 1).astype(float)


def bigrams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


def fit_ranking(words: list[tuple[str, int]], seed: int = 1) -> Boosted:
    """On dictionary words misread on purpose, and on dictionary words that are near others but right."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    posts: dict[str, list[int]] = {}
    for i, (w, _) in enumerate(words):
        for g in bigrams(w):
            posts.setdefault(g, []).append(i)

    def near(word: str, but: int) -> list[tuple[int, int]]:
        c = Counter(i for g in bigrams(word) for i in posts.get(g, ()) if i != but and abs(len(words[i][0]) - len(word)) <= 1)
        return c.most_common(3)

    def seldom(n: float) -> float:
        """How often a misreading of a word of that count may occur: any part of it from 1 / RATIO down to once."""
        return max(1.0, n / float(np.exp(rng.uniform(np.log(RATIO), np.log(max(RATIO + 1, n))))))

    looks: dict[str, list[str]] = {}
    for a, b in LOOKS:
        looks.setdefault(a, []).append(b)
    for i, (w, n) in enumerate(words):
        merged = [(t, r) for t, r in MERGED if t in w]
        for _ in range(2):
            spots = [p for p, c in enumerate(w) if c in looks]
            if spots or merged:
                read = list(w)
                if merged and (not spots or rng.random() < 0.3):
                    t, r = merged[int(rng.integers(0, len(merged)))]
                    read = list(w.replace(t, r, 1))
                else:
                    for p in rng.choice(spots, min(len(spots), 1 + int(rng.random() < 0.25)), replace=False):
                        read[p] = str(rng.choice(looks[w[p]]))
                read = "".join(read)
                rare = seldom(n)
                x.append(pair_features(read, rare, w, n, len(bigrams(read) & bigrams(w))))
                y.append(1)
                for j, shared in near(read, i):
                    x.append(pair_features(read, rare, words[j][0], words[j][1], shared))
                    y.append(0)
        for j, shared in near(w, i):
            m = words[j][1]
            looks_only = explained(w, words[j][0])
            if looks_only[1]:
                x.append(pair_features(w, seldom(m), words[j][0], m, shared))
                y.append(0)
    return Boosted().fit(np.array(x), np.array(y, float)) if x else Boosted(rounds=0).fit(np.zeros((1, 8)), np.zeros(1))


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, correction, p): each misread word of the vocabulary with the dictionary word it stands for."""
    pure = F.col("word").rlike(r"^[а-яё]{3,}$") | F.col("word").rlike(r"^[a-zäöüß]{3,}$")
    dictionary = vocab.filter(pure & (F.col("n") >= LEAST))
    sample = [(r["word"], r["n"]) for r in most_frequent(dictionary, "n", SAMPLE_WORDS)]
    model = fit_ranking(sample)
    pieces = MISREAD + 1
    part = lambda size, i: (F.floor(size * i / pieces), F.floor(size * (i + 1) / pieces))

    def cut(word: Column, size: Column, i: Column, shift: Column) -> Column:
        begin, end = part(size, i)
        begin, end = begin + shift, end + shift
        whole = (end > begin) & (begin >= 0) & (end <= F.length(word))
        return F.when(whole, F.substring(word, (begin + 1).cast("int"), (end - begin).cast("int")))

    size = F.length("word")
    each = F.explode(F.array(*map(F.lit, range(pieces)))).alias("i")
    d = dictionary.select(F.col("word").alias("true"), F.col("n").alias("m"), size.alias("len"), each)
    d = d.select("true", "m", "len", "i", cut(F.col("true"), F.col("len"), F.col("i"), F.lit(0)).alias("g")).filter("g is not null")
    # how much longer the word is than the true one, and how far a piece may have moved
    ways = [(i, more, shift) for i in range(pieces) for more in range(-SHORTER, LONGER + 1) for shift in range(min(0, more), max(0, more) + 1)]
    way = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(more).alias("more"), F.lit(shift).alias("shift")) for i, more, shift in ways))).alias("w")
    # a word too frequent for any dictionary word to be RATIO times as frequent is no misreading
    most = dictionary.agg(F.max("n")).first()[0] or 0
    s = vocab.filter((F.length("word") >= 2) & (F.col("n") * RATIO <= most)).select("word", "n", way).withColumn("len", F.length("word") - F.col("w.more"))
    s = s.select("word", "n", "len", "w.i", cut(F.col("word"), F.col("len"), F.col("w.i"), F.col("w.shift")).alias("g")).filter("g is not null and len >= 3")
    hits = s.join(d, ["len", "i", "g"]).filter((F.col("m") >= RATIO * F.col("n")) & (F.col("word") != F.col("true")))
    pairs = hits.groupBy("word", "true").agg(F.first("n").alias("n"), F.first("m").alias("m"))
    gram = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(2))))
    shared = pairs.withColumn("shared", F.size(F.array_intersect(gram(F.col("word")), gram(F.col("true")))))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads, trues = b.column("word").to_pylist(), b.column("true").to_pylist()
            n, m, k = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "m", "shared"))
            p = model.predict(features_all(reads, n, trues, m, k)) if reads else np.zeros(0)
            likely = pa.array(p >= ACCEPT)
            yield pa.record_batch([b.column("word"), b.column("true"), pa.array(p)], ["word", "correction", "p"]).filter(likely)

    # every candidate is scored: neither its place among the others nor the grams it shares leave one out
    scored = shared.select("word", "n", "true", "m", "shared").mapInArrow(rank, "word string, correction string, p double")
    scored = checkpoint(scored)
    # what is a misreading itself corrects nothing
    sound = scored.join(scored.select(F.col("word").alias("correction")).distinct(), "correction", "left_anti")
    best = sound.groupBy("word").agg(F.max(F.struct("p", "correction")).alias("b"))
    return best.select("word", F.col("b.correction").alias("correction"), F.col("b.p").alias("p"))


# lines

_PAGE = re.compile(r"^\W*(?:(?:стр|страница|лист|с|л|page|pg|p|seite|s|blatt)\b\.?\s*)?(?P<n>\d{1,4})\s*(?:(?:из|of|von|/)\s*\d{1,4})?\W*$", re.I)
_BARE = re.compile(r"^\d{1,4}$")
_DIGIT, _DIGITS, _BLANKS, _SIGNS = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r" {2,}"), re.compile(r"[\W\d]")
_ENDING = re.compile(r"\d{1,4}[.;:,!?]+")
_LIST = re.compile(r"^\d{1,3}[.)]")
_TAIL = re.compile(r"^(?P<title>.*\S)(?: {2,}|\t+| *\| *)(?P<n>\d{1,4})$|^(?P<m>\d{1,4})(?: {2,}|\t+)(?P<rest>\S.*)$")
_NUM = re.compile(r"\d[\d./-]*\d|\d")
FURNITURE = 21


class Page:
    """The lines of a text and what can be said about each that may be furniture."""

    def __init__(self, text: str) -> None:
        self.raw = _LINE.split(text)
        self.lines = [x.strip() for x in self.raw]
        self.full = [i for i, x in enumerate(self.lines) if x]
        sizes = sorted(len(self.lines[i]) for i in self.full)
        self.width = sizes[int(0.8 * (len(sizes) - 1))] if sizes else 0
        self.short = sum(x < 30 for x in sizes) / max(1, len(sizes))
        self.times = Counter(x.lower() for x in self.lines) if len(self.full) > 1 else Counter()

    def candidates(self) -> list[int]:
        """Places in full of the lines that hold a number or recur, and don't end a sentence."""
        out = []
        for k, i in enumerate(self.full):
            x = self.lines[i]
            if (_DIGIT.search(x) or (self.times[x.lower()] > 1 and any(map(str.isalpha, x)))) and (x[-1] not in ".;:,!?" or (_PAGE.match(x) and not _ENDING.fullmatch(x))) and x.count("|") < 2 and not _CODE.fullmatch(x):
                out.append(k)
        return out

    @staticmethod
    def number(x: str) -> int | None:
        m = _PAGE.match(x)
        if m:
            return int(m["n"])
        m = _TAIL.match(x)
        return int(m["n"] or m["m"]) if m else None

    @staticmethod
    def shape(x: str) -> str:
        return _DIGITS.sub("9", _BLANKS.sub("  ", x.lower()) if "  " in x else x.lower())

    @staticmethod
    def code(x: str) -> str | None:
        """The longest number of a line that may be a title's, without a page number behind."""
        m = _TAIL.match(x)
        title = (m["title"] or m["rest"]) if m else x
        found = _NUM.findall(title)
        return max(found, key=len) if found and len(_SIGNS.sub("", title)) >= 3 else None

    def features(self, places: list[int]) -> np.ndarray:
        x = np.zeros((len(places), FURNITURE))
        if not places:
            return x
        text = {k: self.lines[self.full[k]] for k in places}
        number = {k: self.number(t) for k, t in text.items()}
        page_like = {k: bool(_PAGE.match(t)) for k, t in text.items()}
        bare = {k: page_like[k] and bool(_BARE.match(t)) for k, t in text.items()}
        listed = {k: page_like[k] and bool(_LIST.match(t)) for k, t in text.items()}
        code_of = {k: self.code(t) for k, t in text.items()}
        shape = {k: self.shape(t) for k, t in text.items()}
        times = Counter(shape.values())
        kinds: dict[str, list[tuple[int, int]]] = {}
        for k in places:
            if number[k] is not None:
                key = "n" if bare[k] else shape[k] if page_like[k] else "tail"
                kinds.setdefault(key, []).append((k, number[k]))
        follows = set()
        for group in kinds.values():
            for (k, a), (j, b) in zip(group, group[1:]):
                if b - a == 1:
                    follows.update((k, j))
        codes = Counter(c for c in code_of.values() if c)
        clear = {k for k in places if number[k] is not None and ((page_like[k] and not bare[k] and not listed[k]) or k in follows)}
        for row, k in enumerate(places):
            t, i = text[k], self.full[k]
            before = self.lines[self.full[k - 1]] if k else ""
            after = self.lines[self.full[k + 1]] if k + 1 < len(self.full) else ""
            code = code_of[k]
            near = [j for j in (k - 1, k + 1) if j in clear]
            b2 = self.lines[self.full[k - 2]] if near and k - 1 in clear and k > 1 else before
            a2 = self.lines[self.full[k + 2]] if k + 1 in clear and k + 2 < len(self.full) else after
            page = page_like[k]
            x[row] = (
                page and not bare[k] and not listed[k], bare[k], k in follows, number[k] is not None and not page,
                codes[code] if code else 0, len(near), bool(b2) and b2[-1] not in ".!?:;", bool(a2) and (a2[0].islower()),
                bool(b2) and b2[-1] in HYPHENS, i > 0 and not self.lines[i - 1], i + 1 < len(self.lines) and not self.lines[i + 1],
                code is not None and len(code) >= 5, len(t) / max(1, self.width), len(before) / max(1, self.width), t[0].isupper(),
                sum(map(str.isupper, t)) / max(1, sum(map(str.isalpha, t))), len(before) < 25 and any(map(str.isdigit, before)), k == 0 or k + 1 == len(self.full), min(5, times[shape[k]]), min(200, max(60, len(t))), self.short,
            )
        return x

    def kinds(self, k: int) -> list[str]:
        """Which furniture a line is, given that it is."""
        t = self.lines[self.full[k]]
        if _PAGE.match(t):
            return ["page_number"]
        return ["running_header", "page_number"] if _TAIL.match(t) and self.number(t) is not None else ["running_header"]


JOIN = 7
#: What tells one break of a line from another: the pieces, the mark, and whether the second begins small and both are without digits.
BREAK = "mark boolean, left string, right string, small boolean, plain boolean"


def break_key(left: str, right: str) -> tuple | None:
    """A line's end (with its hyphen) and the beginning of the next line of text, as in ``BREAK``; None if there are no pieces."""
    a = re.search(r"(\w+)(.)$", left)
    b = re.match(r"\w+", right)
    if not a or not b:
        return None
    a1, b1 = a[1].lower(), b[0].lower()
    return a[2] == "-", a1, b1, b[0][0].islower(), not any(map(str.isdigit, a1 + b1))


def join_features(key: tuple, known) -> list[float]:
    mark, a, b, small, plain = key
    return [float(mark), float(known(a + b)), float(known(a)), float(known(b)), float(small), float(plain), len(a) + len(b)]


def breaks(page: Page, gone: set[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring lines of text of which the first ends in a hyphen behind a letter; furniture between them is passed over."""
    kept = [k for k in range(len(page.full)) if k not in gone]
    for k, j in zip(kept, kept[1:]):
        x, y = page.lines[page.full[k]], page.lines[page.full[j]]
        if len(x) > 1 and x[-1] in HYPHENS and x[-2].isalpha() and y[0].isalpha():
            yield k, j


class LineModels:
    def __init__(self, furniture: Boosted, join: Boosted) -> None:
        self.furniture, self.join = furniture, join

    def judge_all(self, texts: list[str]) -> list[tuple[Page, dict[int, list[str]], list[tuple[int, int, tuple]]]]:
        """For each text its page, its furniture lines with their kinds, and the hyphens at line ends with
        what the join classifier needs. The trees run once over the lines of all texts."""
        pages = [Page(t) for t in texts]
        places = [p.candidates() if len(p.full) > 1 else [] for p in pages]
        x = [p.features(k) for p, k in zip(pages, places)]
        is_ = self.furniture.predict(np.concatenate(x)) >= 0.5 if any(map(len, x)) else np.zeros(0, bool)
        at, out = 0, []
        for t, p, k in zip(texts, pages, places):
            gone = {i: p.kinds(i) for i, yes in zip(k, is_[at : at + len(k)]) if yes}
            at += len(k)
            pairs = breaks(p, set(gone)) if _OPEN.search(t) else ()
            keys = ((i, j, break_key(p.lines[p.full[i]], p.lines[p.full[j]])) for i, j in pairs)
            out.append((p, gone, [x for x in keys if x[2]]))
        return out


def set_in_pages(text: str, titles: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A text wrapped to lines with page marks between them; the marks' lines."""
    words, width = text.split(), int(rng.integers(40, 80))
    lines, now = [], ""
    for w in words:
        if len(now) + len(w) + 1 > width:
            room = width - len(now) - 2
            if w.isalpha() and 2 < room < len(w) - 2 and rng.random() < 0.5:
                lines.append(f"{now} {w[:room]}-")
                now = w[room:]
                continue
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    lines.append(now)
    title, n = str(rng.choice(titles)), int(rng.integers(1, 300))
    form = int(rng.integers(0, 7))
    page = [lambda n: f"- {n} -", lambda n: f"[{n}]", lambda n: f"Стр. {n} из {n + 30}", lambda n: f"Лист {n}", lambda n: f"p. {n}", lambda n: f"Page {n} of {n + 30}", str][form]
    style, every, out, marks = int(rng.integers(0, 4)), int(rng.integers(4, 14)), [], set()
    for i, x in enumerate(lines):
        out.append(x)
        if i % every == every - 1 and i + 1 < len(lines):
            head = title.upper() if rng.random() < 0.15 else title
            block = [[page(n)], [head], [head, page(n)], [f"{head}   {n}"]][style]
            if style == 2 and rng.random() < 0.5:
                block.reverse()
            marks.update(block)
            out += ([""] if rng.random() < 0.3 else []) + block + ([""] if rng.random() < 0.3 else [])
            n += 1
    return "\n".join(out), marks


def fit_lines(texts: list[str], words: list[str], seed: int = 2) -> LineModels:
    """On sample texts set into pages, and on the lines of texts without any mark of a scan as they are."""
    rng = np.random.default_rng(seed)
    names = [w for w in words if len(w) > 4] or ["общие", "указания"]
    marks = [w for w in words if 2 <= len(w) <= 5] or ["том", "лист"]

    def title() -> str:
        """Words of the corpus, some with a mark in capitals and a number before them, as sheets and norms are named."""
        said = [w.capitalize() if rng.random() < 0.7 else w for w in map(str, rng.choice(names, int(rng.integers(1, 4))))]
        if rng.random() < 0.2:
            return " ".join([said[0].capitalize(), *said[1:]])
        mark = str(rng.choice(marks))
        mark = mark.upper() if rng.random() < 0.7 else mark.capitalize()
        tail = f".{rng.integers(1, 60)}" if rng.random() < 0.7 else ""
        return f"{mark} {rng.integers(100, 999)}{rng.choice(['.', '/'])}{rng.integers(10, 99)}{tail} {' '.join(said)}"

    titles = [title() for _ in range(200)]
    fx, fy, jx, jy = [], [], [], []
    known = set(words)

    def learn(left: str, right: str, is_: float) -> None:
        if key := break_key(left, right):
            jx.append(join_features(key, known.__contains__))
            jy.append(is_)

    for t in texts:
        t = tidy(t)
        page = Page(t)
        places = page.candidates()
        plain = not _BREAK.search(t)
        if plain and places:
            f = page.features(places)
            # a text of a real scan without hyphens would be a wrong negative
            keep = (f[:, 0] == 0) & (f[:, 2] == 0) & (f[:, 4] < 2)
            fx.append(f[keep])
            fy.append(np.zeros(int(keep.sum())))
        if plain and len(t) > 300 and "|" not in t:
            made, lines = set_in_pages(t, titles, rng)
            page = Page(made)
            places = page.candidates()
            if places:
                f = page.features(places)
                fx.append(f)
                fy.append(np.array([float(page.lines[page.full[k]] in lines) for k in places]))
    for w in words[:SAMPLE_WORDS]:
        if len(w) > 5 and w.isalpha():
            cut = int(rng.integers(2, len(w) - 2))
            mark = HYPHENS[int(rng.integers(0, 4))]
            learn(w[:cut] + mark, w[cut:], 1.0)
            blur = w[:cut] + "†" + w[cut + 1 :]
            learn(blur[:cut] + mark, blur[cut + 1 :], 1.0)
            other = str(rng.choice(names))
            learn(w + "-", other, 0.0)
            learn(w + "-", other.capitalize(), 0.0)
    furniture = Boosted().fit(np.concatenate(fx), np.concatenate(fy)) if fx else Boosted(rounds=0).fit(np.zeros((1, FURNITURE)), np.zeros(1))
    join = Boosted(rounds=30).fit(np.array(jx), np.array(jy)) if jx else Boosted(rounds=0).fit(np.zeros((1, JOIN)), np.zeros(1))
    return LineModels(furniture, join)


class Scans:
    """Noise of scanned pages in a table (src, row_key, text).

    Null, empty and blank texts have no noise and stay as they are. Identical rows count once.
    Whole texts are read; a text that is one long line has no line noise. Numbers that are values,
    list numbers and item codes are left alone.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        vocab = checkpoint(vocabulary(docs))
        self.wrong = checkpoint(corrections(vocab))
        good = vocab.join(self.wrong, "word", "left_anti").filter(F.col("word").rlike(r"^[а-яё]+$") | F.col("word").rlike(r"^[a-zäöüß]+$"))
        self.known = good.filter(F.col("n") >= LEAST).select("word")
        top = most_frequent(good.filter(F.col("n") > 1), "n", LEXICON)
        ordinary = [r["word"] for r in top]
        frequent = [r["word"] for r in top if r["n"] >= LEAST]
        texts = sample_texts(docs, "text", SAMPLE, F.length("t") > 100)
        self.models = fit_lines(texts, frequent)
        codes, starts = code_points(ordinary)
        skip = np.unique(span_hashes(char_values(codes), starts[:-1], starts[1:])) if ordinary else np.zeros(0, np.uint64)
        self.ordinary = docs.sparkSession.sparkContext.broadcast(skip)

    @cached_property
    def seen(self) -> DataFrame:
        """(src, row_key, h, kinds, gone, breaks, odd): of each text (h is its hash) that may be noisy its kinds of furniture
        and their places, its hyphens at line ends and its words off the lexicon."""
        models, ordinary = self.models, self.ordinary

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            skip = ordinary.value
            for b in batches:
                kinds, lost, cuts, odd = [], [], [], []
                for part in chunks(b.column(2)):
                    texts = part.to_pylist()
                    joined, start, end, key, of = tokens(texts)
                    at = np.minimum(np.searchsorted(skip, key), max(0, len(skip) - 1))
                    strange = np.flatnonzero(skip[at] != key) if len(skip) else np.arange(len(key))
                    words: list[set[str]] = [set() for _ in texts]
                    for p in strange.tolist():
                        words[of[p]].add(joined[start[p] : end[p]])
                    odd += [sorted(w) for w in words]
                    lined = [i for i, t in enumerate(texts) if t and _LINE.search(t)]
                    found: list[set[str]] = [set() for _ in texts]
                    open_: list[set[tuple]] = [set() for _ in texts]
                    places: list[list[int]] = [[] for _ in texts]
                    for i, (_, gone, joins) in zip(lined, models.judge_all([tidy(texts[i]) for i in lined])):
                        found[i].update(x for k in gone.values() for x in k)
                        places[i] = sorted(gone)
                        open_[i].update(key for *_, key in joins)
                    kinds += map(sorted, found)
                    lost += places
                    cuts += [[dict(zip(_BREAK_NAMES, k)) for k in sorted(x)] for x in open_]
                yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(kinds, pa.list_(pa.string())), pa.array(lost, pa.list_(pa.int32())), pa.array(cuts, _BREAKS), pa.array(odd, pa.list_(pa.string()))], ["src", "row_key", "h", "kinds", "gone", "breaks", "odd"])

        rows = self._texts().mapInArrow(look, f"src string, row_key string, h bigint, kinds array<string>, gone array<int>, breaks array<struct<{BREAK.replace(' ', ': ').replace(',:', ',')}>>, odd array<string>")
        return checkpoint(rows.filter("size(kinds) > 0 or size(breaks) > 0 or size(odd) > 0"))

    def _texts(self) -> DataFrame:
        return self.docs.select("src", "row_key", "text", F.xxhash64("text").alias("h"))

    @cached_property
    def joined(self) -> DataFrame:
        """The different breaks (as in ``BREAK``) that part a word: what is known of their pieces is joined, not carried along."""
        pairs = self.seen.select(F.explode("breaks").alias("b")).select("b.*").distinct()
        for name, word in (("k0", F.concat("left", "right")), ("k1", F.col("left")), ("k2", F.col("right"))):
            known = self.known.select(F.col("word").alias("_w"), F.lit(True).alias(name))
            pairs = pairs.join(known, word == F.col("_w"), "left").drop("_w")
        model = self.models.join

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(r, (r["left"] + r["right"], r["left"], r["right"]), (r["k0"], r["k1"], r["k2"])) for r in b.to_pylist()]
                x = [join_features(tuple(r[n] for n in _BREAK_NAMES), dict(zip(words, is_)).get) for r, words, is_ in rows]
                yes = model.predict(np.array(x, float)) >= 0.5 if x else np.zeros(0, bool)
                yield b.select(_BREAK_NAMES).filter(pa.array(yes, pa.bool_()))

        flat = pairs.select(*_BREAK_NAMES, *(F.coalesce(k, F.lit(False)).alias(k) for k in ("k0", "k1", "k2")))
        return checkpoint(flat.mapInArrow(decide, BREAK))

    def found(self) -> DataFrame:
        """(src, row_key, noise): a row for each kind of noise in a text."""
        lines = self.seen.select("src", "row_key", F.explode("kinds").alias("noise"))
        broken = self.seen.select("src", "row_key", F.explode("breaks").alias("b")).select("src", "row_key", "b.*").join(self.joined, list(_BREAK_NAMES), "left_semi")
        misread = self.seen.select("src", "row_key", F.explode("odd").alias("word")).join(self.wrong.select("word"), "word", "left_semi")
        return lines.union(broken.select("src", "row_key", F.lit("broken_word"))).union(misread.select("src", "row_key", F.lit("wrong_character"))).distinct()

    def repaired(self) -> DataFrame:
        """(src, row_key, text) of the texts with noise, as continuous paragraphs.

        Furniture lines go, broken words are joined, misread words replaced with their case kept,
        lines of a paragraph joined by blanks; blank lines and ends of sentences before short lines
        keep paragraphs apart.
        """
        # what is to be done to a text travels with it; it is at most its own distinct words, lines and breaks
        key = ["src", "row_key", "h"]
        seen = self.seen.dropDuplicates(key)
        fix = seen.select(*key, F.explode("odd").alias("word")).join(self.wrong, "word").groupBy(*key).agg(F.collect_list(F.struct("word", "correction")).alias("fix"))
        joins = seen.select(*key, F.explode("breaks").alias("b")).select(*key, "b.*").join(self.joined, list(_BREAK_NAMES), "left_semi").groupBy(*key).agg(F.collect_list(F.struct(*_BREAK_NAMES)).alias("joins"))
        lines = seen.filter("size(gone) > 0").select(*key, "gone")
        todo = fix.join(joins, key, "full_outer").join(lines, key, "full_outer")
        # only the texts with noise are told apart from their copies
        rows = self._texts().join(todo, key).dropDuplicates(key)

        def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for t, fix, joins, gone in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                    out.append(mended(t, {x["word"]: x["correction"] for x in fix or ()}, set(gone or ()), {tuple(x[n] for n in _BREAK_NAMES) for x in joins or ()}))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], ["src", "row_key", "text"])

        return rows.select("src", "row_key", "text", "fix", "joins", "gone").mapInArrow(mend, "src string, row_key string, text string")


_BREAK_NAMES = tuple(x.split(" ")[0] for x in BREAK.split(", "))
_BREAKS = pa.list_(pa.struct([(n, pa.string() if n in ("left", "right") else pa.bool_()) for n in _BREAK_NAMES]))


def mended(text: str, fix: dict[str, str], gone: set[int], joins: set[tuple]) -> str:
    """A text without the lines in gone (places among its full lines), with the breaks in joins closed and the words in fix replaced."""
    page = Page(tidy(text))
    joined = {k: break_key(page.lines[page.full[k]], page.lines[page.full[j]]) in joins for k, j in breaks(page, gone)}
    out: list[str] = []
    glue = ""
    place = {i: k for k, i in enumerate(page.full)}
    blank = False
    for i, x in enumerate(page.lines):
        k = place.get(i)
        if k is None:
            blank = blank or bool(out)
            continue
        if k in gone:
            continue
        if not out:
            out.append(x)
        elif glue == "join":
            out[-1] = out[-1][:-1] + x
        elif glue == "keep":
            out[-1] += x
        elif blank and out[-1][-1:] in ".!?:":
            out.append(x)
        else:
            out[-1] += " " + x
        glue = "" if k not in joined else "join" if joined[k] else "keep"
        blank = False
    done = "\n\n".join(out).replace(chr(0xAD), "")

    if not fix:
        return done
    # the same words as are looked for: item codes and the like stay as they are
    low, start, end, _, _ = tokens([done])
    if len(low) != len(done):
        return done
    parts, at = [], 0
    for i, j in zip(start.tolist(), end.tolist()):
        if w := fix.get(low[i:j]):
            read = done[i:j]
            parts += [done[at:i], w.upper() if read.isupper() and len(w) > 1 else w.capitalize() if read[0].isupper() else w]
            at = j
    return "".join(parts) + done[at:]
