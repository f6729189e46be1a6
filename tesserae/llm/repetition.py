"""Problem 10: how much of a document repeats itself.

A text's words are the runs of letters and digits of its lower case; a 5-run is five consecutive
words, repeated if an equal one stands earlier in the same text. Lines (sentences inside them, and
pieces of long ones) are labelled content or boilerplate by Viterbi decoding of a linear-chain
conditional random field over features of each piece. The words in content pieces give the content
share, which decides whether a document is retained; where an exact share of repeated 5-runs is
asked for, the labels choose the candidates that are held against it.

The field is fitted on the driver on texts without any repetition into which copies of their own
phrases, sentences and blocks were planted, some of them with edits. A piece is boilerplate by what
was planted there, not by any of its features. The sample is bounded by ``SAMPLE``; everything else
sees all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.frequent import sample_texts
from tesserae.llm.spans import chunks, classes, code_points, mix, run_hashes, words

RUN = 5
#: About how many texts the field is fitted on; never more than twice as many.
SAMPLE = 300
LEAST_RUNS, LEAST_SHARE = 20, 0.3
#: Words of a piece of a long line; share of planted words from which a piece of a made text is boilerplate;
#: content share from which a document is retained.
PIECE, PLANTED, RETAIN = 12, 0.25, 0.7
_EDGES = np.array([0.0, 0.1, 0.25, 0.5, 0.75])


class Lines:
    """Lines of many texts with what the labels rest on."""

    def __init__(self, texts: list[str | None]) -> None:
        n = len(texts)
        word, text_of, first, _, bounds = words(texts)
        run, run_text = run_hashes(word, bounds, RUN)
        again = pd.Series(mix(run + mix(run_text.astype(np.uint64)))).duplicated().to_numpy() if len(run) else np.zeros(0, bool)
        self.runs = np.bincount(run_text, minlength=n)
        self.repeated = np.bincount(run_text, weights=again, minlength=n).astype(np.int64)

        lower = [(t or "").lower() for t in texts]
        codes, starts = code_points(lower)
        stop = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 59)
        cut = (codes == 10) | (codes == 13)
        if len(codes) > 1:
            cut[:-1] |= stop[:-1] & (classes(codes[1:]) == 3)
        line_of = np.concatenate([[0], np.cumsum(cut)])[starts[text_of] + first] if len(word) else np.zeros(0, np.int64)
        line, _ = pd.factorize(line_of * (n + 1) + text_of)
        if len(line):
            # long lines in even pieces
            size = np.bincount(line)
            inside = np.arange(len(line)) - (np.cumsum(size) - size)[line]
            pieces = -(-size // PIECE)
            line = (np.cumsum(pieces) - pieces)[line] + inside * pieces[line] // size[line]
        m = int(line[-1]) + 1 if len(line) else 0
        self.line, self.first = line, starts[text_of] + first
        self.words = np.bincount(line, minlength=m)
        self.text = np.zeros(m, np.int64)
        self.text[line] = text_of
        self.texts = n
        per = np.maximum(np.diff(bounds) - (RUN - 1), 0)
        at = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
        covered = np.zeros(len(word) + 1, np.int64)
        np.add.at(covered, at[again], 1)
        np.add.at(covered, np.minimum(at[again] + RUN, len(word)), -1)
        part = lambda x: np.bincount(line, weights=x, minlength=m) / np.maximum(self.words, 1) if m else np.zeros(0)
        begins = np.zeros(len(word))
        begins[at[again]] = 1
        seen = pd.Series(mix(word + mix(text_of.astype(np.uint64)))).duplicated().to_numpy().astype(float) if len(word) else np.zeros(0)
        if m:
            start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            place = (np.arange(len(line)) - start[line]).astype(np.uint64)
            whole = mix(np.add.reduceat(mix(word ^ mix(place)), start) + mix(self.text.astype(np.uint64)))
            self.equal = pd.Series(whole).duplicated().to_numpy()
        else:
            self.equal = np.zeros(0, bool)
        #: Shares of a piece's words: that begin a repeated run, that lie in one, that occur earlier in the text.
        self.shares = [part(begins), part((np.cumsum(covered)[:-1] > 0).astype(float)), part(seen)]

    def features(self) -> np.ndarray:
        wide = len(_EDGES) + 1
        x = np.zeros((len(self.words), wide * len(self.shares) + 3))
        rows = np.arange(len(x))
        for i, share in enumerate(self.shares):
            x[rows, i * wide + np.searchsorted(_EDGES, share)] = 1
        x[:, -3] = self.equal
        x[:, -2] = np.minimum(self.words, 40) / 40
        x[:, -1] = 1
        return x

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of each line; lines are in reading order."""
        start = np.searchsorted(self.text, np.arange(self.texts))
        return self.text, np.arange(len(self.text)) - start[self.text]


class Field:
    """Two labels (0 content, 1 boilerplate), weights of features for label 1, and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, sets: list[tuple[Lines, np.ndarray]], rounds: int = 60, rate: float = 0.8) -> Field:
        """Gradient ascent on the likelihood of the labels (forward and backward sums)."""
        xs = [(s.features(), s.grid(), y) for s, y in sets]
        field = cls(np.zeros(xs[0][0].shape[1]), np.zeros((2, 2)))
        total = sum(len(y) for *_, y in xs)
        for _ in range(rounds):
            gw, gm = -1e-3 * field.weights, -1e-3 * field.moves
            for x, (text, place), y in xs:
                node, edge, seen = field._expected(x @ field.weights, text, place, y)
                gw = gw + x.T @ (y - node) / total
                gm = gm + (seen - edge) / total
            field.weights, field.moves = field.weights + 10 * rate * gw, field.moves + rate * gm
        return field

    def _expected(self, score: np.ndarray, text: np.ndarray, place: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, longest = int(text.max()) + 1, int(place.max()) + 1
        e = np.zeros((longest, n, 2))
        live = np.zeros((longest, n), bool)
        e[place, text, 1], live[place, text] = score, True
        a, b = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        a[0] = e[0]
        for t in range(1, longest):
            a[t] = np.where(live[t][:, None], np.logaddexp(a[t - 1][:, :1] + self.moves[0], a[t - 1][:, 1:] + self.moves[1]) + e[t], a[t - 1])
        z = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
        edge = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            nxt = e[t + 1] + b[t + 1]
            b[t] = np.where(live[t + 1][:, None], np.logaddexp(nxt[:, :1] + self.moves[:, 0], nxt[:, 1:] + self.moves[:, 1]), 0)
            p = np.exp(a[t][:, :, None] + self.moves[None] + nxt[:, None, :] - z[:, None, None])
            edge += p[live[t + 1]].sum(0)
        node = np.exp(a + b - z[None, :, None])[place, text, 1]
        seen = np.zeros((2, 2))
        follow = np.flatnonzero(place[1:] > 0)
        np.add.at(seen, (y[follow].astype(int), y[follow + 1].astype(int)), 1)
        return node, edge, seen

    def decode(self, lines: Lines) -> np.ndarray:
        """The best labels of each text's lines together (Viterbi)."""
        if not len(lines.words):
            return np.zeros(0, np.int8)
        score = lines.features() @ self.weights
        text, place = lines.grid()
        label = np.zeros(len(score), np.int8)
        # texts of like length are decoded together, so one long text costs only itself
        size = np.bincount(text, minlength=lines.texts)[text]
        tier = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for k in np.unique(tier):
            rows = np.flatnonzero(tier == k)
            _, who = np.unique(text[rows], return_inverse=True)
            n, longest = int(who.max()) + 1, int(place[rows].max()) + 1
            e = np.zeros((longest, n, 2))
            live = np.zeros((longest, n), bool)
            e[place[rows], who, 1], live[place[rows], who] = score[rows], True
            best, back = e[0], np.zeros((longest, n, 2), np.int8)
            for t in range(1, longest):
                via = best[:, :, None] + self.moves[None]
                back[t] = np.where(live[t][:, None], via.argmax(1), [[0, 1]])
                best = np.where(live[t][:, None], via.max(1) + e[t], best)
            state, out = best.argmax(1).astype(np.int8), np.zeros((longest, n), np.int8)
            for t in range(longest - 1, -1, -1):
                out[t] = state
                state = back[t][np.arange(n), state]
            label[rows] = out[place[rows], who]
        return label


def planted(texts: list[str], seed: int = 7) -> list[tuple[str, np.ndarray]]:
    """Texts with copies of their own phrases, sentences or blocks, and which characters were planted.

    Each text also comes as it is. A copy may be alone, in a row, within a line, or have a word changed.
    """
    rng = np.random.default_rng(seed)
    out = []
    for t in texts:
        lines = [x for x in t.replace(". ", ".\n").split("\n") if x.strip()]
        if not 2 <= len(lines) <= 60:
            continue
        out.append((t, np.zeros(len(t), bool)))
        pieces = [(x + "\n", False) for x in lines]
        for _ in range(int(rng.integers(1, 6))):
            own = [i for i, (_, copy) in enumerate(pieces) if not copy]
            block = int(rng.choice(own))
            source = [x for x, copy in pieces[block : block + int(rng.integers(1, 4))] if not copy]
            words = source[0].split(" ")
            form = rng.random()
            if form < 0.35 and len(words) >= 6:
                size = int(rng.integers(5, max(6, min(12, len(words)))))
                begin = int(rng.integers(0, len(words) - size + 1))
                source = [" ".join(words[begin : begin + size]).strip() + " "]
            elif form < 0.5 and len(words) > 8:
                words = list(words)
                words[int(rng.integers(0, len(words)))] = "иное"
                source = [" ".join(words)]
            at = int(rng.integers(block + 1, len(pieces) + 1))
            pieces[at:at] = [(x, True) for x in source] * int(rng.integers(1, 5))
        made = "".join(x for x, _ in pieces)
        out.append((made, np.repeat([copy for _, copy in pieces], [len(x) for x, _ in pieces])))
    return out


def labelled(made: list[tuple[str, np.ndarray]]) -> tuple[Lines, np.ndarray]:
    """The pieces of made texts, and which of them are boilerplate by the share of planted words."""
    lines = Lines([t for t, _ in made])
    mask = np.concatenate([m for _, m in made]) if made else np.zeros(0, bool)
    share = np.bincount(lines.line, weights=mask[lines.first], minlength=len(lines.words)) / np.maximum(lines.words, 1)
    return lines, (share >= PLANTED).astype(float)


def fit_field(texts: list[str], seed: int = 7) -> Field:
    """Fit on texts into which copies were planted; texts that repeat themselves already are left out."""
    plain = [t for t in texts if len(t.lower()) == len(t)]
    found = Lines(plain)
    plain = [t for t, r in zip(plain, found.repeated) if not r]
    # one more, so that a corpus without usable texts still has a field
    plain.append("\n".join(f"строка номер {i} содержит слова {i * 7} {i * 11} {i * 13}" for i in range(1, 9)))
    return Field.fit([labelled(planted(plain, seed))])


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_runs, repeated_runs, repeated_share, n_words, content_share) for every row.

    Null, empty and blank texts, and texts of fewer than five words, have no run, a repeated share
    of 0 and a content share of 1. Whole texts are read; other columns are ignored.
    """
    field = fit_field(sample_texts(docs, text, SAMPLE, F.length("t") > 200))
    names = [key, "n_runs", "repeated_runs", "repeated_share", "n_words", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            for part in chunks(b.column(1)):
                lines = Lines(part.to_pylist())
                label = field.decode(lines)
                total = np.bincount(lines.text, weights=lines.words, minlength=lines.texts)
                content = np.bincount(lines.text, weights=lines.words * (label == 0), minlength=lines.texts)
                share = lines.repeated / np.maximum(lines.runs, 1)
                kept = np.where(total > 0, content / np.maximum(total, 1), 1.0)
                yield pa.record_batch([b.column(0).slice(start, len(part)), pa.array(lines.runs, pa.int64()), pa.array(lines.repeated, pa.int64()), pa.array(share), pa.array(total.astype(np.int64)), pa.array(kept)], names)
                start += len(part)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_runs bigint, repeated_runs bigint, repeated_share double, n_words bigint, content_share double"
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def repeating(docs: DataFrame, key: str = "doc_id", text: str = "text", least_runs: int = LEAST_RUNS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The keys of self-repeating texts: the labels choose candidates, the exact share of repeated runs is held against them."""
    r = repetition(docs, key, text)
    return r.filter((F.col("content_share") < 1) & (F.col("n_runs") >= least_runs) & (F.col("repeated_runs") >= least_share * F.col("n_runs"))).select(key).distinct()


def retained(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = RETAIN) -> DataFrame:
    """(key, content_share, retained): whether a document has enough content, by its labels alone. Texts without words have nothing to lose and stay."""
    return repetition(docs, key, text).select(key, "content_share", (F.col("content_share") >= least).alias("retained"))
