"""Problem 7: the most similar vectors of every vector, by an adaptive dimension scan.

Unit vectors are cut into cells around centroids of two levels (fitted on a bounded sample, every
vector is indexed); a query visits the cells nearest to it. In a cell the vectors are rotated by one
random orthogonal matrix and scanned in column blocks: after d of D columns the distance so far,
scaled by D / d, estimates the whole one, and a candidate is abandoned as soon as that estimate
exceeds the query's bound times 1 + EPSILON / sqrt(d), the hypothesis test of the scan. The bound is
the distance of the least similarity asked for, or of the query's k-th best candidate so far. What
survives all blocks is measured exactly. A cell above its size is split: its vectors into shards,
the queries that visit it into blocks, and every block meets every shard in a group of its own.

Vectors that are equal are one class, which carries its k + 1 least ids: no further member can be
among another's k closest. All members of a class ask with its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import checkpoint

#: Vectors a cell should hold, queries a block, and the bound of the sample the centroids are fitted on.
CELL, ASKS = 6000, 48_000
SAMPLE = 100_000
#: Cells a query of near pairs visits; for the k closest of any cosine the number comes from the recall measured
#: on the sample, which is to be RECALL at least with that many sample vectors asking.
PAIR_PROBES = 3
RECALL, ASKED = 0.97, 500
#: Most tasks the groups are spread over.
_TASKS = 4000
#: Of the hypothesis test; a larger one abandons later.
EPSILON = 2.1
BLOCK = 16


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _pack(x: np.ndarray) -> pa.Array:
    """Raw vectors as bytes: half precision where that loses nothing, else single; the length tells which."""
    half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    size = np.where(exact, 2, 4) * x.shape[1]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(int(ends[-1]), np.uint8)
    for rows, v in ((exact, half), (~exact, np.ascontiguousarray(x, np.float32))):
        if rows.any():
            raw = np.ascontiguousarray(v[rows]).view(np.uint8)
            data[ends[:-1][rows][:, None] + np.arange(raw.shape[1])] = raw
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _unpack(packed: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    v = np.empty((len(packed), dim))
    if len(packed):
        _, ends, data = packed.buffers()
        ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        data, half = np.frombuffer(data, np.uint8), np.diff(ends) == 2 * dim
        for rows, kind in ((half, np.float16), (~half, np.float32)):
            if rows.any():
                v[rows] = data[ends[:-1][rows][:, None] + np.arange(np.dtype(kind).itemsize * dim)].view(kind)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        start = np.searchsorted(near[order], np.arange(k))
        size = np.diff(np.append(start, len(x)))
        sums = np.zeros_like(c)
        filled = size > 0
        sums[filled] = np.add.reduceat(x[order], start[filled])
        sums[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


class Quantizer:
    """Centroids of two levels: coarse ones, and in each coarse cell fine ones in number by its share of the sample.

    A vector is held against all coarse centroids and the fine ones of its nearest few coarse cells
    only, so its cost grows with the root of the number of cells.
    """

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.coarse = centroids(x, max(1, min(len(x), int(np.ceil(np.sqrt(cells))))))
        of = (x.astype(np.float32) @ self.coarse.T).argmax(1)
        fine = []
        for c in range(len(self.coarse)):
            rows = x[of == c]
            fine.append(centroids(rows, min(len(rows), max(1, round(cells * len(rows) / len(x))))) if len(rows) else self.coarse[c : c + 1])
        self.start = np.concatenate([[0], np.cumsum([len(f) for f in fine])])
        self.fine = np.concatenate(fine).astype(np.float32)
        self.widest = int(np.diff(self.start).max())

    def __len__(self) -> int:
        return len(self.fine)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each vector, the nearest first; -1 where there are fewer."""
        x = x.astype(np.float32)
        wide = min(len(self.coarse), max(4, 2 * int(np.ceil(np.sqrt(probes)))))
        out = np.full((len(x), probes), -1, np.int64)
        rows = max(64, 8_000_000 // (wide * self.widest))
        for lo in range(0, len(x), rows):
            part = x[lo : lo + rows]
            top = np.argpartition(-(part @ self.coarse.T), wide - 1, axis=1)[:, :wide]
            score = np.full((len(part), wide, self.widest), -np.inf, np.float32)
            for c in np.unique(top):
                i, j = np.nonzero(top == c)
                score[i, j, : self.start[c + 1] - self.start[c]] = part[i] @ self.fine[self.start[c] : self.start[c + 1]].T
            score = score.reshape(len(part), -1)
            cell = (self.start[top][:, :, None] + np.arange(self.widest)).reshape(len(part), -1)
            few = min(probes, score.shape[1])
            best = np.argpartition(-score, few - 1, axis=1)[:, :few]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
            got = np.take_along_axis(cell, best, 1)
            out[lo : lo + len(part), :few] = np.where(np.isfinite(np.take_along_axis(score, best, 1)), got, -1)
        return out


def _rows(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", a[i], b[j])


class Scan:
    """The base vectors of a cell in rotated column blocks."""

    def __init__(self, base: np.ndarray, turn: np.ndarray) -> None:
        self.exact = base
        self.turned = base.astype(np.float32) @ turn
        self.turn, self.dim = turn, base.shape[1]
        self.step = min(BLOCK, self.dim)
        head = self.turned[:, : self.step]
        # one product gives the squared distance over the first block: -2 q.b + |q|^2 + |b|^2
        self.head = np.concatenate([-2 * head, (head**2).sum(1, keepdims=True), np.ones((len(head), 1), np.float32)], 1).T.copy()

    def _limit(self, bound: np.ndarray | float, d: int) -> np.ndarray | float:
        """Of the squared distance over d columns, for a bound of the whole squared distance."""
        return bound * (d / self.dim) * (1 + EPSILON / np.sqrt(d)) ** 2 + 1e-6

    def _survivors(self, head: np.ndarray, turned: np.ndarray, bound: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        part = head @ self.head[:, lo:hi]
        i, j = np.nonzero(part <= self._limit(bound, self.step)[:, None])
        so_far, j = part[i, j], j + lo
        for d in range(self.step, self.dim, BLOCK):
            to = min(d + BLOCK, self.dim)
            if to == self.dim:
                break
            diff = turned[i, d:to] - self.turned[j, d:to]
            so_far = so_far + (diff * diff).sum(1)
            keep = so_far <= self._limit(bound, to)[i]
            i, j, so_far = i[keep], j[keep], so_far[keep]
        return i, j

    def search(self, queries: np.ndarray, k: int | None = None, least: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, base, cosine) arrays: all of at least that cosine, or the k best of each query."""
        rows = max(64, 8_000_000 // max(1, len(self.exact)))
        for at in range(0, len(queries), rows):
            q = queries[at : at + rows]
            turned = q.astype(np.float32) @ self.turn
            h = turned[:, : self.step]
            head = np.concatenate([h, np.ones((len(h), 1), np.float32), (h**2).sum(1, keepdims=True)], 1)
            if k is None:
                bound = np.full(len(q), 2 - 2 * least, np.float32)
                i, j = self._survivors(head, turned, bound, 0, len(self.exact))
                cos = _rows(q, self.exact, i, j)
                keep = cos >= least
                yield i[keep] + at, j[keep], cos[keep]
                continue
            first = min(len(self.exact), max(4 * k, 256))
            cos = q @ self.exact[:first].T
            top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
            c = cos[i, j]
            for lo in range(first, len(self.exact), 2048):
                worst = np.full(len(q), -1.0)
                full = np.bincount(i, minlength=len(q)) >= k
                np.minimum.at(worst2 := np.full(len(q), 2.0), i, c)
                worst[full] = worst2[full]
                bound = (2 - 2 * np.maximum(worst, -1 if least is None else least)).astype(np.float32)
                ni, nj = self._survivors(head, turned, bound, lo, min(lo + 2048, len(self.exact)))
                i, j, c = np.concatenate([i, ni]), np.concatenate([j, nj]), np.concatenate([c, _rows(q, self.exact, ni, nj)])
                order = np.lexsort((-c, i))
                i, j, c = i[order], j[order], c[order]
                place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i]
                keep = place < k
                i, j, c = i[keep], j[keep], c[keep]
            if least is not None:
                keep = c >= least
                i, j, c = i[keep], j[keep], c[keep]
            yield i + at, j, c


class VectorIndex:
    """Cells over the distinct vectors of a table.

    Null vectors, vectors of another length, with a null, infinite or NaN entry, or of length zero
    are in no index. Identical rows are one; an id with two vectors is in both their classes. Extra
    columns are ignored. Empty tables give empty results.
    """

    def __init__(self, table: DataFrame, key: str, vector: str, dim: int, k: int = 10, cell: int = CELL) -> None:
        self.dim, self.k, self.key, self.cell = dim, k, key, cell
        src = table.filter(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                ok = np.isfinite(x).all(1) & (np.linalg.norm(x, axis=1) > 0)
                yield pa.record_batch([b.column(0).filter(pa.array(ok)), _pack(x[ok])], ["id", "v"])

        self.packed = src.mapInArrow(pack, "id string, v binary")
        first = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
        same = self.packed.withColumn("_n", first).filter(F.col("_n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        self.classes = checkpoint(same)
        self.count = self.classes.count()
        cells = max(1, -(-self.count // cell))
        bound = min(SAMPLE, max(20_000, 64 * cells))
        # by the hash against a threshold, so that no task sends more than its share
        share = min(1.0, bound / max(1, self.count))
        rows = self.classes.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").collect()
        self.sample = _unpack(pa.array(sorted(bytes(r[0]) for r in rows), pa.binary()), dim) if rows else np.eye(1, dim)
        self.quantizer = Quantizer(self.sample, min(cells, len(self.sample)))
        # a cell far above its size is split into shards that each of its queries visits
        self.shards = np.maximum(1, np.ceil(self._share(1) * self.count / (3 * cell))).astype(int)

    def _share(self, probes: int) -> np.ndarray:
        """The share of all vectors that visit each cell, as the sample has it."""
        near = self.quantizer.nearest(self.sample, probes)
        return np.bincount(near[near >= 0], minlength=len(self.quantizer)) / len(self.sample)

    def _visits(self, rows: DataFrame, probes: int, blocks: np.ndarray, base: bool, asks: bool) -> DataFrame:
        """(slot, base, asks, v, ids): a row in each group it is part of. base rows are searched: they are
        in every block of their shard; rows that ask are in one block of every shard of the cells they visit."""
        quantizer, shards, dim = self.quantizer, self.shards, self.dim
        start = np.concatenate([[0], np.cumsum(shards * blocks)])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                near = quantizer.nearest(_unpack(b.column(0), dim), probes if asks else 1)
                home = near[:, 0]
                h = b.column(2).to_numpy(zero_copy_only=False)
                own, block = h % shards[home], (h >> 20) % blocks[home]
                row, slot, kind, ask = [], [], [], []

                def add(r: np.ndarray, cell: np.ndarray, shard: np.ndarray | int, blk: np.ndarray | int, is_base: bool, does: np.ndarray | bool) -> None:
                    row.append(r)
                    slot.append(start[cell] + shard * blocks[cell] + blk)
                    kind.append(np.full(len(r), is_base))
                    ask.append(np.broadcast_to(does, len(r)))

                if base:
                    for k in range(int(blocks[home].max())):
                        r = np.flatnonzero(k < blocks[home])
                        # at home the base row itself asks
                        add(r, home[r], own[r], k, True, asks & (block[r] == k))
                for p in range(near.shape[1] if asks else 0):
                    c = near[:, p]
                    live = c >= 0
                    for s in range(int(shards[c[live]].max()) if live.any() else 0):
                        r = np.flatnonzero(live & (s < shards[c]) & ~((c == home) & (s == own) & base))
                        add(r, c[r], s, (h[r] >> 20) % blocks[c[r]], False, True)
                row = pa.array(np.concatenate(row))
                yield pa.record_batch([pa.array(np.concatenate(slot), pa.int64()), pa.array(np.concatenate(kind)), pa.array(np.concatenate(ask)), b.column(0).take(row), b.column(1).take(row)], ["slot", "base", "asks", "v", "ids"])

        number = F.xxhash64("v").bitwiseAND(F.lit((1 << 62) - 1))
        return rows.select("v", "ids", number.alias("h")).mapInArrow(send, "slot bigint, base boolean, asks boolean, v binary, ids array<string>")

    def probes_for(self, recall: float = RECALL) -> int:
        """The fewest cells to visit for a share of the closest vectors, measured on the sample.

        The sample is sparser than the table, so fewer neighbours of a sample vector stand for the k
        closest; at least one.
        """
        x = self.sample.astype(np.float32)
        k = min(len(x) - 1, max(1, -(-self.k * len(x) // max(1, self.count))))
        if k < 1:
            return 1
        ask = np.random.default_rng(9).choice(len(x), min(ASKED, len(x)), replace=False)
        near = np.concatenate([np.argpartition(-(x[ask[i : i + 64]] @ x.T), k, axis=1)[:, : k + 1] for i in range(0, len(ask), 64)])
        home = self.quantizer.nearest(x, 1)[:, 0]
        cells = self.quantizer.nearest(x[ask], len(self.quantizer))
        place = np.full((len(ask), len(self.quantizer)), len(self.quantizer))
        i, j = np.nonzero(cells >= 0)
        place[i, cells[i, j]] = j
        need = np.take_along_axis(place, home[near], 1)[near != ask[:, None]]
        return int(min(len(self.quantizer), np.quantile(need, recall, method="higher") + 1))

    def _blocks(self, probes: int) -> np.ndarray:
        return np.maximum(1, np.ceil(self._share(probes) * self.count / ASKS)).astype(int)

    def _searched(self, visits: DataFrame, blocks: np.ndarray, k: int | None, least: float | None) -> DataFrame:
        turn, dim = rotation(self.dim), self.dim

        def scan(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            base = np.flatnonzero(t.column("base").to_numpy())
            asks = np.flatnonzero(t.column("asks").to_numpy())
            parts = []
            if len(base) and len(asks):
                x = _unpack(t.column("v"), dim)
                parts = list(Scan(x[base], turn).search(x[asks], k, least))
            i, j, c = (np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, int if n < 2 else float) for n in range(3))
            i, j = asks[i], base[j]
            other = i != j
            ids = t.column("ids")
            return pa.table([ids.take(pa.array(i[other])), ids.take(pa.array(j[other])), pa.array(c[other])], ["a", "b", "cosine"])

        # a number of tasks of our own: few groups each, however many there are
        tasks = int(min(_TASKS, (self.shards * blocks).sum()))
        return visits.repartition(tasks, "slot").groupBy("slot").applyInArrow(scan, "a array<string>, b array<string>, cosine double")

    def near_pairs(self, least: float, probes: int = PAIR_PROBES) -> DataFrame:
        """(a, b, cosine): classes, as their least ids in order, of at least that cosine; both directions."""
        blocks = self._blocks(probes)
        found = self._searched(self._visits(self.classes, probes, blocks, True, True), blocks, None, least)
        # one scan gives both directions; a union would search twice
        way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col("cosine"))
        both = found.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")
        return both.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).filter(F.col("a") != F.col("b"))

    def _closest(self, pairs: DataFrame, k: int, members: DataFrame | None = None) -> DataFrame:
        """(id, other, cosine): of every id of the classes a, or of members (a, id), the k closest ids, ties by id."""
        order = Window.partitionBy("a").orderBy(F.desc("cosine"), F.get("b", 0))
        few = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
        near = few.groupBy("a").agg(F.flatten(F.collect_list(F.transform("b", lambda x: F.struct((-F.col("cosine")).alias("d"), x.alias("id"))))).alias("n"))
        own = F.transform("a", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("id")))
        every = near.select("a", F.slice(F.array_sort(F.concat("n", own)), 1, k + 1).alias("n"))
        each = every.select(F.explode("a").alias("id"), "n") if members is None else members.join(every, "a")
        each = each.select("id", F.explode(F.slice(F.filter("n", lambda x: x["id"] != F.col("id")), 1, k)).alias("x"))
        return each.select("id", F.col("x.id").alias("other"), (-F.col("x.d")).alias("cosine"))

    def mutual(self, least: float, probes: int = PAIR_PROBES) -> DataFrame:
        """(id_a, id_b), a < b: ids of at least that cosine, each among the other's k closest.

        Whether an id is among the k closest depends only on closer ones, so the search can be
        bounded by the least cosine.
        """
        alone = self.classes.filter(F.size("ids") > 1).select(F.col("ids").alias("a"), F.array().cast("array<string>").alias("b"), F.lit(1.0).alias("cosine"))
        c = self._closest(self.near_pairs(least, probes).unionByName(alone), self.k)
        pair = c.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), (F.col("id") < F.col("other")).alias("up"))
        return pair.groupBy("id_a", "id_b").agg(F.max("up").alias("u"), F.min("up").alias("d")).filter("u and not d").select("id_a", "id_b")

    def closest(self, asked: Callable[[Column], Column] = lambda id: hundredth(id), probes: int | None = None) -> DataFrame:
        """(id, other, cosine, position) of every id for which asked holds, copies of a vector included.

        probes: how many cells a query visits, by default as many as the recall on the sample needs.
        """
        probes = probes or self.probes_for()
        asking = self.packed.filter(F.coalesce(asked(F.col("id")), F.lit(False))).distinct()
        members = checkpoint(asking.join(self.classes, "v").select("v", F.col("ids").alias("a"), "id"))
        wanted = self.classes.join(members.select("v"), "v", "left_semi")
        blocks = self._blocks(1)
        visits = self._visits(self.classes, 1, blocks, True, False).unionByName(self._visits(wanted, probes, blocks, False, True))
        found = self._searched(visits, blocks, self.k + 1, None).filter(F.col("a") != F.col("b"))
        found = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
        # a class alone in its cells still has its own members
        alone = members.filter(F.size("a") > 1).select("a", F.array().cast("array<string>").alias("b"), F.lit(1.0).alias("cosine")).distinct()
        c = self._closest(found.unionByName(alone), self.k, members.select("a", "id"))
        order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
        # an id with two vectors asks with both
        c = c.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
        return c.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= self.k)


def hundredth(id: Column) -> Column:
    """The query set of whole tables: ids (texts, so their checksums) divisible by 100."""
    return (F.crc32(id) % 100) == 0
