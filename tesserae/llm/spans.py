"""Texts as arrays of code points: character classes, spans and span hashes for many texts at once."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, BLANK, UNKNOWN = 0, 1, 2, 3, 4
_UNSEEN = 255
#: White_Space of Unicode.
_BLANKS = frozenset(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_class_of = np.full(0x110000, _UNSEEN, np.uint8)
_value_of: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

CHUNK_CHARS = 1_000_000


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; the table is filled for those that occur. UNKNOWN are those our tables don't name yet."""
    got = _class_of[codes]
    if (got == _UNSEEN).any():
        for c in np.unique(codes[got == _UNSEEN]).tolist():
            char = chr(c)
            kind = unicodedata.category(char)[0]
            _class_of[c] = BLANK if char in _BLANKS else LETTER if kind == "L" else NUMBER if kind == "N" else UNKNOWN if unicodedata.category(char) == "Cn" else OTHER
        got = _class_of[codes]
    return got


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and where each text begins (with the end as last entry)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return flat, starts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        p, q = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        p[0] = q[0] = 1
        _power, _inverse = np.cumprod(p), np.cumprod(q)
    return _power[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambler (the finalizer of a well-known public generator, splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, the same wherever the span stands."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def char_values(codes: np.ndarray) -> np.ndarray:
    global _value_of
    if _value_of is None:
        _value_of = mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return _value_of[codes]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of letters and digits of the lower-cased texts.

    Gives each word's hash, text number, first and last position in its lower-cased text, and the
    bounds of every text's words. Null is as an empty text.
    """
    lower = [(t or "").lower() for t in texts]
    codes, starts = code_points(lower)
    kind = classes(codes)
    inside = (kind == LETTER) | (kind == NUMBER)
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text_of = np.searchsorted(starts, start, "right") - 1
    bounds = np.searchsorted(start, starts)
    return span_hashes(char_values(codes), start, end), text_of, start - starts[text_of], end - starts[text_of], bounds


def run_hashes(word: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every k consecutive words inside one text, and the number of the text."""
    n = len(word)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per = np.maximum(np.diff(bounds) - (k - 1), 0)
    text_of = np.repeat(np.arange(len(per)), per)
    at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x100000001B3) + word[at + i])
    return h, text_of


@functools.cache
def _engines() -> tuple:
    """The tokenizer library's own idea of letters, numbers and white space."""
    import tiktoken

    plain = {bytes([i]): i for i in range(256)}
    return tuple((kind, tiktoken.Encoding(f"kind{kind}", pat_str=p, mergeable_ranks=plain, special_tokens={})) for kind, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")))


_newer: dict[int, int] = {}


def token_classes(codes: np.ndarray) -> np.ndarray:
    """As classes; characters our tables don't name yet are asked of the tokenizer library."""
    kind = classes(codes)
    new = kind == UNKNOWN
    if new.any():
        kind = kind.copy()
        for c in np.unique(codes[new]).tolist():
            if c not in _newer:
                _newer[c] = next((k for k, e in _engines() if e.encode_ordinary(chr(c))), OTHER)
            kind[codes == c] = _newer[c]
    return kind


#: The endings the pattern splits off behind an apostrophe that begins a word.
_CONTRACTED = (("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l"))


def pretokens(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words a byte-level tokenizer splits texts into before its merges.

    Runs of letters, of numbers or of other characters, each with one blank U+0020 before it; the
    white space left over is split off the last blank before a word. An apostrophe that begins a run
    of other characters and has s, t, m, d, re, ve or ll behind it is a word with these letters.
    Gives the joined text, each word's start, end and hash, and the bounds of every text.
    """
    plain = [t or "" for t in texts]
    codes, starts = code_points(plain)
    kind = token_classes(codes)
    n = len(codes)
    first = np.zeros(n + 3, bool)
    first[starts] = True
    first[n:] = True
    begin = np.zeros(n, bool)
    if n:
        before = np.empty(n, np.uint8)
        before[0], before[1:] = _UNSEEN, kind[:-1]
        before[first[:n]] = _UNSEEN
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = _UNSEEN, kind[1:]
        after[first[1 : n + 1]] = _UNSEEN
        spaced = np.zeros(n, bool)
        spaced[1:] = codes[:-1] == 32
        spaced &= ~first[:n]
        blank = kind == BLANK
        begin = np.where(blank, (before != BLANK) | ((after != BLANK) & (after != _UNSEEN)), (before != kind) & ~spaced)
        quotes = np.flatnonzero(begin & (codes == 39))
        if len(quotes):
            far = np.concatenate([codes, np.zeros(3, codes.dtype)])
            for ending in _CONTRACTED:
                size = len(ending)
                hit = quotes[np.all([(far[quotes + i + 1] == ord(c)) & ~first[quotes + i + 1] for i, c in enumerate(ending)], axis=0)]
                begin[hit + 1] = False
                past = hit[~first[hit + size + 1]] + size + 1
                begin[past[kind[past] == LETTER]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n) if len(start) else start
    return "".join(plain), start, end, span_hashes(char_values(codes), start, end), np.searchsorted(start, starts)


def chunks(column: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[pa.Array]:
    """Slices of a string column of bounded total length; one longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + chars)))
        yield column.slice(start, end - start)
        start = end
