"""Prefix trie of conversations with a splitter skeleton.

A conversation is a key: 40 hex characters a turn, a 128-bit hash of role and text and the text's UTF-8 bytes, so a node of the
trie is a key's prefix and its members are neighbours in key order. Equal conversations are one row with a count before
anything is dealt. Splitters cut the sorted keys into shards; a node whose members lie in several shards has a splitter among them
and is therefore a prefix of that splitter. The trie of the splitters' paths, the skeleton, is broadcast. Each shard walks its sorted
keys with a stack and finishes every other node by itself; of skeleton nodes it gives partial aggregates, which Spark reduces,
and the skeleton, at most `skeleton_bytes` of paths, is summed up from its leaves.

Splitters come from the keys of smallest hash, eight for each shard; they decide about balance only. Paths of splitters are cut
so that all of them together stay below `skeleton_bytes`.

The SHA-256 of a node's member ids is a running hash over its ids in order: ids of repeated conversations are dealt by ranges of
ids, each range gives a conversation one text chunk, and chunks are hashed in order as a stream, so hot groups are never a list.

Cases: null turns come first, equal turns are ordered by the hash of role and text; null role or text is empty; rows without
conv_id are left out; an empty table has no nodes, not even a root; repeated rows are turns of their own; other columns are
ignored. What a task must hold is one conversation's key (40 bytes a turn), the nodes that wait for their parent, at most those of its
shard, and the skeleton.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

W = 40  # characters of a turn in a key
NO_ENDS = hashlib.sha256(b"").hexdigest()
_COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_hash string"
_OUT = f"{_COLUMNS}, skeleton long, above long"


def turn_key(role: Column, text: Column) -> Column:
    """40 hex characters that stand for a turn: 32 of its hash, 8 for the bytes of its text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32), F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))


def keys(conversations: DataFrame) -> DataFrame:
    """conv_id, key: each conversation's turns in order."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull(), "turn", turn_key(F.col("role"), F.col("text")).alias("k")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["k"]), "").alias("key"))


def rebuilt(sequences: DataFrame, width: int = 5, most: int = 9) -> DataFrame:
    """conv_id, key: the first h turns of conversation c - c % width, then c's own after its first h; h: crc32(c) % most."""
    own = stash(sequences)
    heads = own.select(F.col("conv_id").alias("base"), F.substring("key", 1, W * (most - 1)).alias("head"))
    joined = own.hint("merge").join(heads.hint("merge"), F.col("conv_id") - F.col("conv_id") % width == F.col("base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int") * W
    return joined.select("conv_id", F.concat(F.substr(F.coalesce("head", F.lit("")), F.lit(1), h), F.substr("key", h + 1, F.octet_length("key"))).alias("key"))


def _ends(sequences: DataFrame, several: DataFrame, range_rows: int) -> DataFrame:
    """key_sha, ends: the SHA-256 of the ids of each repeated conversation."""
    again = sequences.select(F.sha2("key", 256).alias("key_sha"), "conv_id").hint("merge").join(several.hint("merge"), "key_sha", "left_semi")
    again = stash(again)
    ranges = max(1, -(-again.count() // range_rows))
    dealt = stash(again.repartitionByRange(ranges, "conv_id").withColumn("span", F.spark_partition_id()))
    chunks = dealt.groupBy("key_sha", "span").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("key_sha", "span", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key_sha", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key_sha", "ends"])

    return chunks.repartition(F.col("key_sha")).sortWithinPartitions("key_sha", "span").select("key_sha", "text").mapInArrow(run, "key_sha string, ends string")


def _splitters(distinct: DataFrame, shards: int, skeleton_bytes: int) -> list[str]:
    """At most shards - 1 keys, cut to whole turns, that part the sorted keys about evenly."""
    depth = max(1, skeleton_bytes // (W * shards * 8))
    rows = distinct.orderBy(F.xxhash64("key"), "key").limit(8 * shards).select(F.substring("key", 1, W * depth).alias("key")).collect()
    sample = sorted(r["key"] for r in rows)
    return sorted({sample[i] for i in range(8, len(sample), 8)} - {""})


class _Node:
    __slots__ = ("end", "low", "n", "children", "leaves", "saved", "ends", "waiting", "skeleton")

    def __init__(self, end: int, skeleton: int | None):
        self.end, self.skeleton = end, skeleton
        self.low, self.n, self.children, self.leaves, self.saved, self.ends, self.waiting = None, 0, 0, 0, 0, NO_ENDS, []

    def add(self, low: int, n: int) -> None:
        self.low, self.n = low if self.low is None else min(low, self.low), self.n + n


def walk(rows, number: dict[str, int]):
    """Rows of _OUT for one shard's (key, low, n, ends) in key order. number: the skeleton's nodes."""
    path, stack = "", [_Node(0, number[""])]

    def close():
        node = stack.pop()
        above = stack[-1] if stack else None
        if node.skeleton is not None:
            yield node.low, node.end // W, None, node.n, node.children, node.leaves, node.saved, node.ends, path[node.end - W : node.end], node.skeleton, None
        else:
            node.saved += (node.n - 1) * int(path[node.end - 8 : node.end], 16)
            node.leaves = node.leaves or 1
            for c in node.waiting:
                yield (*c[:2], node.low, *c[3:])
            row = node.low, node.end // W, None, node.n, node.children, node.leaves, node.saved, node.ends, path[node.end - W : node.end], None, above.skeleton
            if above.skeleton is None:
                above.waiting.append(row)
            else:
                yield row
            above.children += 1
        if above:
            above.add(node.low, node.n)
            above.leaves += node.leaves
            above.saved += node.saved

    for key, low, n, ends in rows:
        same, most = 0, min(len(key), len(path))
        while same < most and key[same : same + W] == path[same : same + W]:
            same += W
        while stack[-1].end > same:
            yield from close()
        path = key
        for end in range(same + W, len(key) + 1, W):
            inside = stack[-1].skeleton is not None
            stack.append(_Node(end, number.get(key[:end]) if inside else None))
        stack[-1].ends = ends
        stack[-1].add(low, n)
    while stack:
        yield from close()


def _skeleton(parts: DataFrame, paths: list[str], number: dict[str, int]) -> list[tuple]:
    """Whole aggregates of the skeleton's nodes, children before parents. parts: one reduced row for each node."""
    got = {r["skeleton"]: r for r in parts.collect()}
    more: dict[int, list[int]] = {}  # children, leaves and saved words that skeleton nodes below add
    low = {i: r["conv_id"] for i, r in got.items()}
    out = []
    for i in range(len(paths) - 1, -1, -1):
        p, r = paths[i], got[i]
        extra = more.get(i, [0, 0, 0])
        children = r["n_children"] + extra[0]
        own = (r["n_convs"] - 1) * int(p[-8:], 16) if p else 0
        leaf = 0 if children else 1
        above = number[p[:-W]] if p else None
        if p:
            up = more.setdefault(above, [0, 0, 0])
            up[0] += 1
            up[1] += extra[1] + leaf
            up[2] += extra[2] + own
        out.append((r["conv_id"], len(p) // W, low[above] if p else None, r["n_convs"], children, r["n_leaves"] + extra[1] + leaf, r["saved_tokens"] + extra[2] + own, r["ends_sha256"], p[-W:], i))
    return out


def prefix_trie(sequences: DataFrame, shards: int | None = None, skeleton_bytes: int = 32 << 20, range_rows: int = 50_000) -> DataFrame:
    """Every node of the trie of sequences (conv_id, key): conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, turn_hash (the last turn's key, to be joined with turn_key).

    shards: as many as shuffle partitions where None, at most 4096; range_rows: ids in a chunk of a repeated conversation."""
    spark = sequences.sparkSession
    shards = min(4096, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    sequences = stash(sequences)
    distinct = stash(sequences.groupBy("key").agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("key_sha", F.sha2("key", 256)))
    if distinct.isEmpty():
        return spark.createDataFrame([], _COLUMNS)
    splitters = _splitters(distinct, shards, skeleton_bytes)
    paths = sorted({s[:end] for s in splitters for end in range(W, len(s) + 1, W)} | {""})
    number = {p: i for i, p in enumerate(paths)}
    shared = spark.sparkContext.broadcast((splitters, number))

    several = stash(distinct.where("n > 1").select("key_sha"))
    ends = stash(_ends(sequences, several, range_rows))
    distinct = distinct.hint("merge").join(ends.hint("merge"), "key_sha", "left").select("key", "low", "n", F.coalesce("ends", F.sha2(F.col("low").cast("string"), 256)).alias("ends"))

    def deal(batches):
        for b in batches:
            shard = [bisect_right(shared.value[0], k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], [*b.schema.names, "shard"])

    def grow(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        kinds, out = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")], []
        names = [c.split()[0] for c in _OUT.split(", ")]
        for _, shard in itertools.groupby(rows, key=lambda r: r[4]):
            for r in walk((r[:4] for r in shard), shared.value[1]):
                out.append(r)
                if len(out) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    dealt = distinct.mapInArrow(deal, "key string, low long, n long, ends string, shard int")
    nodes = stash(dealt.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "key").mapInArrow(grow, _OUT))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    # a sequence ends in one shard only; elsewhere the node has the hash of no ids
    ended = F.coalesce(F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256")
    parts = nodes.where("skeleton is not null").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums, ended)
    top = spark.createDataFrame(_skeleton(parts, paths, number), f"{_COLUMNS}, skeleton long")
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    rest = nodes.where("skeleton is null")
    lows = F.broadcast(top.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("low")))  # one row for each node of the skeleton
    under = rest.where("above is not null").join(lows, "above").withColumn("parent_conv_id", F.col("low"))
    return rest.where("above is null").select(names).unionByName(under.select(names)).unionByName(top.select(names))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn (null for the root)."""
    turns = conversations.select(turn_key(F.col("role"), F.col("text")).alias("turn_hash"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one row for each distinct turn, written before the join: a first turn may be very common
    turns = stash(turns.groupBy("turn_hash").agg(F.first("role").alias("role"), F.first("text").alias("text")))
    return nodes.hint("merge").join(turns.hint("merge"), "turn_hash", "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    nodes = prefix_trie(rebuilt(keys(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = """
WITH turns AS (
  SELECT conv_id, turn, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS m,
    sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS tie FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, tie) AS ms FROM turns GROUP BY 1),
crc AS (
  SELECT conv_id, ms, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295), 4294967295) % 9 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.ms[1 : c.h], []), c.ms[c.h + 1 :]) AS ms FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, ms, unnest(range(0, len(ms) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT d, ms[1 : d] AS p, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ms) = d), '') AS ends FROM prefixes GROUP BY 1, 2),
sized AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * octet_length(encode(p[d].t)) END AS saved,
    (SELECT count(*) FROM nodes c WHERE c.d = x.d + 1 AND c.p[1 : x.d] = x.p) AS children FROM nodes x),
below AS (
  SELECT x.d, x.p, sum(y.saved) AS saved, count(*) FILTER (WHERE y.children = 0) AS leaves FROM sized x JOIN sized y ON y.d >= x.d AND y.p[1 : x.d] = x.p GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.children AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM sized x JOIN below b ON b.d = x.d AND b.p = x.p LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.p[1 : x.d - 1]
"""


def brute_force(rows) -> list[tuple]:
    """The nodes by definition, for tests. rows: (conv_id, turn, role, text), no ties."""
    own: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes: dict[tuple, list] = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members, ends = nodes.setdefault(whole[:d], ([], []))
            members.append(c)
            if d == len(whole):
                ends.append(c)
    out = []
    for p, (members, ends) in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in nodes)
        saved = sum((len(nodes[q][0]) - 1) * len(q[-1][1].encode()) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]][0]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, sha))
    return out
