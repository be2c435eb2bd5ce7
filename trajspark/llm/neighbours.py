"""Approximate nearest neighbours with a hash-prefix forest.

A tree is a sorted array of hash strings. The characters of a string are the axes that a randomly rotated vector lies
nearest to, the nearest first, each with its sign (cross-polytope hashing about the mean of a bounded sample). A query
descends in every tree to its longest-prefix match; then all trees ascend together, one character at a time, down to
prefixes of two characters. From there a whole step up would meet half of a shard, so the last step is taken one sibling
at a time: all trees go on together to the subtree of two characters whose axes the query lies nearest to next. The
ascent stops as soon as `share` of a shard (at least `least`) has been met; everything met, and nothing else, is compared
exactly. If the `STEPS` nearest subtrees hold too few, the ascent ends at the root: the whole shard.

Every valid vector is indexed: shards of about `shard` vectors, dealt by hash of vec_id, are built once and written, each
with the sorted arrays of all trees. Queries come in blocks of at most `block`, which are broadcast and look up their own
prefixes in each shard; the index is not shuffled again, and of every task only the k best of a query go on. Equal
vectors of a shard are one entry of a tree with their smallest ids, so copies cost nothing.

Cases: vectors null, zero or with null or non-finite components take no part; vectors of another length than the query's
are no candidates; ties go to the smaller vec_id; fewer candidates than k give fewer rows; equal rows count once and
never answer each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

LENGTH = 8  # characters of a string, one byte each
AXES = 12  # a query's nearest axes, whose pairs are the subtrees of two characters
STEPS = 64
LOOKED_UP = 12  # steps looked up together; most queries need no more
AT_ONCE = 256  # queries looked up together


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>), dim of the rows that take part, equal rows once."""
    e = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.where(finite & F.exists("embedding", lambda x: x != 0)).distinct().withColumn("dim", F.size("embedding"))


class Forest:
    """Centre and rotation of every tree, for one vector length of at most 128 rotated axes."""

    def __init__(self, sample: np.ndarray, trees: int = 192, seed: int = 9):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.centre = sample.mean(0)
        self.rotations = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :128] for _ in range(trees)]).astype(np.float32)

    def nearest_axes(self, x: np.ndarray, most: int):
        """For each tree: the characters of the `most` axes nearest to each vector, nearest first, and their distances along them."""
        x, rows = (x - self.centre).astype(np.float32), np.arange(len(x))[:, None]
        for turn in self.rotations:
            y = x @ turn
            size = np.abs(y)
            axes = np.argsort(-size, axis=1)[:, :most]
            yield axes * 2 + (y[rows, axes] > 0), size[rows, axes]

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings of the vectors as numbers whose first character is the highest byte: one row a tree."""
        out = np.zeros((len(self.rotations), len(x)), np.uint64)
        for t, (characters, _) in enumerate(self.nearest_axes(x, LENGTH)):
            for at in range(characters.shape[1]):
                out[t] |= characters[:, at].astype(np.uint64) << np.uint64(8 * (LENGTH - 1 - at))
        return out

    def subtrees(self, x: np.ndarray) -> np.ndarray:
        """Prefixes of two characters in each vector's order of ascent, its own first: trees x vectors x steps."""
        out = []
        for characters, size in self.nearest_axes(x, AXES):
            i, j = (m.ravel() for m in np.indices((characters.shape[1],) * 2))
            i, j = i[i != j], j[i != j]
            # the first axis weighs a little more: an entry lies nearest to it
            order = np.argsort(-(1.15 * size[:, i] + size[:, j]), axis=1, kind="stable")[:, :STEPS]
            out.append((characters[:, i] << 8 | characters[:, j])[np.arange(len(x))[:, None], order])
        return np.stack(out)


class Shard:
    """Entries (distinct vectors, each with its smallest ids) and, for every tree, their strings in order."""

    NAMES = ("ids", "begin", "points", "strings", "order")
    KINDS = (np.int64, np.int64, np.float64, np.uint64, np.int32)

    def __init__(self, ids: np.ndarray, begin: np.ndarray, points: np.ndarray, strings: np.ndarray, order: np.ndarray):
        self.ids, self.begin, self.points, self.strings, self.order = ids, begin, points, strings, order

    @classmethod
    def build(cls, forest: Forest, ids: np.ndarray, x: np.ndarray, most: int) -> Shard:
        """`most` ids are kept for each distinct vector: k nearest and the query itself."""
        at = np.lexsort((ids, *x.T[::-1]))
        new = np.append(True, (x[at][1:] != x[at][:-1]).any(1))
        first = np.flatnonzero(new)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        keep = rank < most
        begin = np.append(np.flatnonzero(new[keep]), keep.sum())
        points = np.ascontiguousarray(x[at[first]])
        strings = forest.strings(points)
        order = np.argsort(strings, axis=1, kind="stable")
        return cls(ids[at[keep]], begin, points, np.take_along_axis(strings, order, 1), order)

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n), k).tobytes() for n, k in zip(self.NAMES, self.KINDS)]

    @classmethod
    def unpack(cls, dim: int, data: list[bytes]) -> Shard:
        ids, begin, points, strings, order = (np.frombuffer(d, k) for d, k in zip(data, cls.KINDS))
        n = len(points) // dim
        return cls(ids, begin, points.reshape(n, dim), strings.reshape(-1, n), order.reshape(-1, n))

    def ranges(self, low_string: np.ndarray, high_string: np.ndarray):
        """Start and size, in every tree, of the entries between two strings (trees x ...)."""
        low = np.stack([np.searchsorted(a, s, "left") for a, s in zip(self.strings, low_string)])
        return low, np.stack([np.searchsorted(a, s, "right") for a, s in zip(self.strings, high_string)]) - low

    def mark(self, seen: np.ndarray, low: np.ndarray, size: np.ndarray) -> int:
        """Marks the entries of ranges (trees x steps); the number of all entries marked."""
        m = size.ravel().astype(np.int64)
        start = (low + np.arange(len(low))[:, None] * len(self.points)).ravel()
        base = np.repeat(start - np.append(0, np.cumsum(m)[:-1]), m)
        seen[self.order.ravel()[base + np.arange(len(base))]] = True
        return int(np.count_nonzero(seen))

    def ascend(self, low: np.ndarray, size: np.ndarray, seen: np.ndarray, enough: int) -> bool:
        """Takes steps (trees x steps) in turn until `enough` entries are met; False where these steps do not suffice."""
        total = int(np.count_nonzero(seen)) + np.cumsum(size.sum(0))
        # entries met in several trees count once, so no step before this one can suffice
        first = min(int(np.searchsorted(total, enough)) + 1, low.shape[1])
        count = self.mark(seen, low[:, :first], size[:, :first])
        while count < enough and first < low.shape[1]:
            count = self.mark(seen, low[:, first : first + 1], size[:, first : first + 1])
            first += 1
        return count >= enough

    def met(self, forest: Forest, q: np.ndarray, enough: int):
        """For each query, the entries met when the ascent stops."""
        n = len(self.points)
        if n <= enough:
            yield from (np.arange(n) for _ in q)
            return
        last = np.uint64((1 << 8 * (LENGTH - 2)) - 1)
        for start in range(0, len(q), AT_ONCE):
            part = q[start : start + AT_ONCE]
            steps = forest.subtrees(part).astype(np.uint64) << np.uint64(8 * (LENGTH - 2))
            seen, done = np.zeros((len(part), n), bool), np.zeros(len(part), bool)
            for at in range(0, max(1, steps.shape[2]), LOOKED_UP):
                left = np.flatnonzero(~done)
                some = steps[:, left, at : at + LOOKED_UP]
                low, size = self.ranges(some, some | last)
                if at == 0:
                    # longer prefixes lie in the first subtree: they can only suffice where that one is large enough
                    deep = np.flatnonzero(size[:, :, :1].sum((0, 2)) >= enough)
                    if len(deep):
                        own = forest.strings(part[deep])
                        rest = [np.uint64((1 << 8 * (LENGTH - length)) - 1) for length in range(LENGTH, 2, -1)]
                        levels = [self.ranges(own & ~r, own | r) for r in rest]
                        for j, i in enumerate(deep):
                            done[i] = self.ascend(np.stack([a[:, j] for a, _ in levels], 1), np.stack([m[:, j] for _, m in levels], 1), seen[i], enough)
                for j, i in enumerate(left):
                    if not done[i]:
                        done[i] = self.ascend(low[:, j], size[:, j], seen[i], enough)
                if done.all():
                    break
            yield from (np.flatnonzero(m) if d else np.arange(n) for m, d in zip(seen, done))

    def search(self, forest: Forest, q_ids: np.ndarray, q: np.ndarray, k: int, enough: int):
        """(query, vec_id, distance) of the k nearest entries met, for each query."""
        for q_id, v, candidates in zip(q_ids, q, self.met(forest, q, enough)):
            d = np.sqrt(((self.points[candidates] - v) ** 2).sum(1))
            if len(d) > k + 1:  # the query itself may be among them
                near = d <= np.partition(d, k)[k]
                candidates, d = candidates[near], d[near]
            found = [(x, i) for c, x in zip(candidates, d.tolist()) for i in self.ids[self.begin[c] : self.begin[c + 1]].tolist() if i != q_id]
            yield from ((int(q_id), i, x) for x, i in sorted(set(found))[:k])


_INDEX = "dim int, shard int, ids binary, begin binary, points binary, strings binary, order binary"


def build_index(rows: DataFrame, forests: dict[int, Forest], counts: dict[int, int], k: int, shard: int) -> DataFrame:
    """One row for each shard, written once; rows: valid vectors of the lengths in counts."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)
    shards = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // shard))])
    dealt = rows.select("vec_id", "embedding", "dim", F.pmod(F.xxhash64("vec_id"), shards[F.col("dim")]).cast("int").alias("shard"))

    def build(t: pa.Table) -> pa.Table:
        dim, part = t["dim"][0].as_py(), t["shard"][0].as_py()
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        data = Shard.build(shared.value[dim], np.asarray(t["vec_id"]), x, k + 1).pack()
        return pa.table([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], ["dim", "shard", *Shard.NAMES])

    return stash(dealt.groupBy("dim", "shard").applyInArrow(build, _INDEX))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, trees: int = 192, share: float = 0.08, least: int = 300, shard: int = 8192, block: int = 20_000, sample: int = 4000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows for each query (frames of vec_id, embedding)."""
    spark = rows.sparkSession
    asked = stash(valid_vectors(queries))
    wanted = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = valid_vectors(rows).where(F.col("dim").isin(list(wanted)))
    counts = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], out)
    forests = {}
    for dim in counts:
        picked = base.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "embedding").collect()
        forests[dim] = Forest(np.array([r["embedding"] for r in sorted(picked, key=lambda r: (r["vec_id"], r["embedding"]))], float), trees)
    if counts:
        index = build_index(base, forests, counts, k, shard)
    for dim in counts:
        pieces = -(-wanted[dim] // block)
        for piece in range(pieces):
            # about `block` queries at a time
            part = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece)).select("vec_id", "embedding").collect()
            if not part:
                continue
            q = np.array([r["embedding"] for r in part], float)
            shared = spark.sparkContext.broadcast((forests[dim], np.array([r["vec_id"] for r in part], np.int64), q))

            def look(batches, dim=dim, shared=shared):
                for batch in batches:
                    for row in range(batch.num_rows):
                        s = Shard.unpack(dim, [batch.column(c)[row].as_py() for c in range(len(Shard.NAMES))])
                        hits = list(s.search(*shared.value, k, max(least, k + 1, int(share * len(s.points)))))
                        columns = list(zip(*hits)) or [(), (), ()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

            found = found.unionByName(index.where(F.col("dim") == dim).select(*Shard.NAMES).mapInArrow(look, out))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found rows for every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
