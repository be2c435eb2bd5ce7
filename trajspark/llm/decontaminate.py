"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of every benchmark text (a shorter text, if it has words, is one
window). Words are numbered, and patterns of one length m share arrays: `shift` holds, by the hash of a block of B words,
how far the search may jump when that block ends at the current position (blocks of no pattern jump m-B+1 words, a word
of no pattern is jumped over whole), `begin` holds, by the hash of the block that ends a pattern (shift 0), where its
bucket of patterns starts, inside a bucket patterns are ordered by a hash of all their words, and a direct comparison of
the words confirms an occurrence. Documents are only mapped, never shuffled; the pattern tables are broadcast in blocks
of about `max_windows` windows (about 100 bytes a window and the words), with one pass over the documents for each block;
a longer benchmark text is cut into overlapping pieces first, so no text must fit into a block. Several passes need the
documents numbered and written once.

Cases: a null or empty text has no words and is clean; benchmark rows with null text or no words give no window; equal
windows of several items count for each; repeated rows give one result each; empty tables give no rows or no hits;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stash, table

#: Lower-cases A-Z, keeps 0-9, a-z and everything beyond ASCII, turns the rest into spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FACTOR, _WHOLE = 1_000_003, (1 << 40) - 1
_SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, starts array<long>, ends array<long>, row long"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _hashes(rows: np.ndarray, mask: int) -> np.ndarray:
    h = np.zeros(len(rows), np.int64)
    for column in rows.T:
        h = (h * _FACTOR + column + 1) & mask
    return h


class Patterns:
    """All distinct patterns of one length: rows of word numbers in the order of their buckets, and the items of each."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray):
        self.length = m = rows.shape[1]
        self.block = block = min(3, m)
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        self.mask = (1 << min(24, max(10, (4 * len(rows)).bit_length()))) - 1
        bucket, whole = _hashes(rows[:, m - block :], self.mask), _hashes(rows, _WHOLE)
        order = np.lexsort((whole, bucket))
        self.rows, self.whole = rows[order].astype(np.int32), whole[order]
        self.begin = np.searchsorted(bucket[order], np.arange(self.mask + 2)).astype(np.int32)
        shift = np.full(self.mask + 1, m - block + 1, np.uint32)
        for end in range(block, m + 1):
            np.minimum.at(shift, _hashes(rows[:, end - block : end], self.mask), m - end)
        self.shift = array("I", shift.tobytes())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[which.ravel()], owners], 1), axis=0)
        self.owners = pairs[:, 1].astype(np.int32)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)).astype(np.int32)

    def find(self, numbers: list[int], bucket: int):
        """Item numbers of the pattern that equals these words, or None."""
        h = 0
        for c in numbers:
            h = (h * _FACTOR + c + 1) & _WHOLE
        low, high = int(self.begin[bucket]), int(self.begin[bucket + 1])
        at = low + int(np.searchsorted(self.whole[low:high], h))
        while at < high and self.whole[at] == h:
            if self.rows[at].tolist() == numbers:
                return self.owners[self.first[at] : self.first[at + 1]]
            at += 1
        return None


def build_tables(items: list[tuple], width: int = 10) -> tuple:
    """(number of each word, items, Patterns of each length); items are (item_id, text bytes)."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({str(item) for item, _ in items})
    at = {n: i for i, n in enumerate(names)}
    windows: dict[int, list] = {}
    for item, text in items:
        numbers = np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words(text)], np.int32)
        if len(numbers):
            rows = np.lib.stride_tricks.sliding_window_view(numbers, min(width, len(numbers)))
            windows.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), at[str(item)], np.int64)))
    return vocabulary, names, [Patterns(np.concatenate([r for r, _ in g]), np.concatenate([o for _, o in g])) for _, g in sorted(windows.items())]


def search(w: list[bytes], tables: tuple) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges (end exclusive) inside any occurrence, and the items whose windows occur."""
    vocabulary, names, lengths = tables
    n, found, items, get = len(w), [], set(), vocabulary.get
    for p in lengths:
        m, block, mask, shift = p.length, p.block, p.mask, p.shift
        i = m
        while i <= n:
            h = 0
            for j in range(i - block, i):
                c = get(w[j])
                if c is None:
                    break
                h = (h * _FACTOR + c + 1) & mask
            if c is None:
                i = j + m + 1
                continue
            s = shift[h]
            if s:
                i += s
                continue
            numbers = [get(x) for x in w[i - m : i]]
            owners = None if None in numbers else p.find(numbers, h)
            if owners is not None:
                found.append((i - m, i))
                items.update(names[o] for o in owners.tolist())
            i += 1
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged], items


def _blocks(benchmark: DataFrame, width: int, max_windows: int):
    """The benchmark in blocks of about max_windows windows; their number follows from one count."""
    most = max(1, max_windows // 8)

    def cut(cols):
        out = [[], [], []]
        for text, item in zip(*cols):
            w = words(text)
            n = max(1, len(w) - width + 1) if w else 0
            for start in range(0, n, most):
                for c, v in zip(out, (item, b" ".join(w[start : start + most + width - 1]), min(most, n - start))):
                    c.append(v)
        return out

    texts = benchmark.select(F.col("text").cast("binary").alias("text"), F.col("item_id").cast("string").alias("item_id"))
    pieces = stash(map_batches(texts, cut, "item_id string, text binary, n long"))
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // max_windows))
    for k in range(blocks):
        part = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield blocks, [(r["item_id"], bytes(r["text"])) for r in part.distinct().collect()]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), starts, ends (word ranges hit) for every row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    passes = []
    for pieces, items in _blocks(benchmark, width, max_windows):
        if not passes:
            source = source.select("doc_id", "text", F.lit(0).cast("long").alias("row"))
            if pieces > 1:  # numbered and written once, so that every pass sees the same number for a row
                source = stash(source.withColumn("row", F.monotonically_increasing_id()))
        shared = spark.sparkContext.broadcast(build_tables(items, width))

        def scan(cols, shared=shared):
            out = [[] for _ in range(7)]
            for doc, text, row in zip(*cols):
                w = words(text)
                ranges, ids = search(w, shared.value)
                for c, v in zip(out, (doc, len(w), sum(b - a for a, b in ranges), sorted(ids), [a for a, _ in ranges], [b for _, b in ranges], row)):
                    c.append(v)
            return out

        passes.append(map_batches(source, scan, _SCHEMA))
    if len(passes) == 1:
        return passes[0].drop("row")
    return _merge(passes)


def _merge(passes: list[DataFrame]) -> DataFrame:
    """Join the passes of several pattern blocks by the number of the row; a group has one row from each pass."""
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)
    ranges = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    grouped = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(ranges).alias("r"), ids.alias("item_ids"))
    last = lambda acc: F.element_at(acc, -1)
    kind = "array<struct<starts:bigint,ends:bigint>>"
    merged = F.aggregate(
        "r",
        F.array().cast(kind),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["starts"] <= F.coalesce(last(acc)["ends"], F.lit(-1))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["starts"].alias("starts"), F.greatest(last(acc)["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(x))).cast(kind),
    )
    full = grouped.withColumn("r", F.when(F.size("r") == 0, F.array().cast(kind)).otherwise(merged))
    hit = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    return full.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", F.col("r.starts").alias("starts"), F.col("r.ends").alias("ends"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """The rows of docs that share no window with the benchmark; all columns stay.

    One pattern block filters in place. Several blocks read the rows, numbered and written once, in tasks of their own (no
    worker holds two blocks' tables), and only the numbers of hit rows meet the documents again.
    """
    spark = docs.sparkSession
    row = "_row"
    while row in docs.columns:
        row += "_"
    hits = None
    for blocks, items in _blocks(benchmark, width, max_windows):
        shared = spark.sparkContext.broadcast(build_tables(items, width))
        if blocks == 1:

            def clean(texts, shared=shared):
                import pyarrow as pa

                return pa.array([not search(words(t), shared.value)[0] for t in texts.to_pylist()], pa.bool_())

            return docs.where(F.arrow_udf(clean, "boolean").asNondeterministic()(F.col("text").cast("binary")))
        if hits is None:
            docs = stash(docs.withColumn(row, F.monotonically_increasing_id()))

        def hit(cols, shared=shared):
            return [[r for text, r in zip(*cols) if search(words(text), shared.value)[0]]]

        found = map_batches(docs.select(F.col("text").cast("binary").alias("text"), row), hit, f"{row} long")
        hits = found if hits is None else hits.unionByName(found)
    return docs.join(stash(hits.distinct()).hint("merge"), row, "left_anti").drop(row)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-window overlap of every document with the benchmark."""
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The windows that occur are at most 10 words long; whole tables are too slow as a SQL word-by-word join beyond small inputs.
def brute_force(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """For tests: (doc_id, n_words, n_hit, n_items, sha, contaminated) by comparing every window with every position."""
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc, text in docs:
        w, hit, ids = low(text), set(), set()
        for item, t in items:
            p = low(t)
            for i in range(max(1, len(p) - width + 1) if p else 0):
                win = p[i : i + width]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
