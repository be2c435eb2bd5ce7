"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

Every word position of a piece starts a suffix of at most `deepest` words. The suffixes are dealt by their word prefix into
groups, as many as keep a group near half of a memory budget; a group's suffixes are sorted, which lays out its subtree, equal
suffixes are leaves, and the count of every phrase (an inner node) is the total of the leaves below it. Groups know nothing of
each other. A prefix has two words, and one word more for as long as its group's load would be above the budget (a frequent
prefix), up to the whole suffix, of which each block has one counted row.

Two passes read the texts, in blocks of whole or cut texts with numpy and Arrow:

1. words of each block with their counts, and how many suffixes fall into each group at each length of prefix, both summed
   by Spark: f of single words, n and the loads. Which groups are above the budget is one bit a group, broadcast.
2. suffixes; equal ones of a block are one row with a count. A block's suffixes of one group travel packed: its words once
   and a matrix of their numbers.

Counts, cuts, scores and the ranking are DataFrame joins and windows; scores are whole decimals (exact while 1000*a*n is
below 1e38). The first `top` phrases of a language are found per hash slot first, so no task sorts a language.

Cases: null text has no words, null lang is `und`; empty texts and pieces have no phrases; repeated rows count each; texts
longer than a block are cut between words, the next words being read along as context; equal scores go by a, then phrase;
an empty table gives no rows; other columns are ignored. Languages without candidates have no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_GAP = re.compile(rb"[ \t.,;:!?\x0A-\x0D]")
_PACKED = "grp long, lang string, n long, size long, words binary, ids binary, counts binary"


def cut_up(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of data, each token's number among them, whether it begins a piece, and its byte offset."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = piece[1:] != piece[:-1]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    body = raw[inside]
    coded = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), fresh, start


def blocks(batches, size: int, deepest: int):
    """(lang, bytes, own): texts of a language joined by line ends, lower-cased. Tokens from byte `own` on are context only."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, data = lang.as_py(), (text.as_py() or b"").translate(LOWER)
            if len(data) > size:
                yield from ((lang, *part) for part in segments(data, size, deepest))
                continue
            held.setdefault(lang, []).append(data)
            total += len(data) + 1
            if total > size:
                yield from _join(held)
                held, total = {}, 0
    yield from _join(held)


def _join(held):
    for lang, parts in held.items():
        data = b"\n".join(parts)
        yield lang, data, len(data)


def segments(data: bytes, size: int, deepest: int):
    """Cuts of about size bytes at gaps between words; each reads on for the words of its last suffixes."""
    at, ahead = 0, re.compile(rb"(?:[ \t]*[^ \t.,;:!?\x0A-\x0D]+){0,%d}" % (deepest - 1))
    while at < len(data):
        gap = _GAP.search(data, at + size)
        stop = gap.start() if gap else len(data)
        yield data[at : ahead.match(data, stop).end()], stop - at
        at = stop


def _loads(hashes: np.ndarray, rows: np.ndarray, depth: int, groups: int) -> np.ndarray:
    """The group of each row by its first `depth` words."""
    known = np.concatenate([np.zeros(1, np.uint64), hashes])
    mix = np.full(len(rows), 0x9E3779B97F4A7C15 * (depth + 1) & (1 << 64) - 1, np.uint64)
    for c in range(depth):
        mix = (mix ^ known[rows[:, c]]) * np.uint64(0xFF51AFD7ED558CCD)
        mix ^= mix >> np.uint64(32)
    return (mix % np.uint64(groups)).astype(np.int64)


def _counted(docs: DataFrame, size: int, deepest: int, groups: int) -> DataFrame:
    """lang, word, grp, f, several rows each: how often a word stands in a block, and (word null) a group's suffixes there."""

    def run(batches):
        for lang, data, end in blocks(batches, size, deepest):
            words, ids, fresh, start = cut_up(data)
            if not len(words):
                continue
            own = int(np.searchsorted(start, end))
            n = np.bincount(ids[:own], minlength=len(words))
            seen = np.flatnonzero(n)
            rows, hashes = _suffixes(ids, fresh, own, deepest), _hashes(lang, words)
            load = np.concatenate([np.bincount(_loads(hashes, rows, d, groups), minlength=groups) for d in range(2, deepest + 1)])
            full = np.flatnonzero(load)
            yield from pa.table({"lang": pa.repeat(pa.scalar(lang), len(seen)), "word": words.take(pa.array(seen)), "grp": pa.nulls(len(seen), pa.int64()), "f": pa.array(n[seen])}).to_batches(65536)
            yield from pa.table({"lang": pa.nulls(len(full), pa.string()), "word": pa.nulls(len(full), pa.string()), "grp": pa.array(full + 2 * groups), "f": pa.array(load[full])}).to_batches(65536)

    return docs.mapInArrow(run, "lang string, word string, grp long, f long")


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    """A hash of (lang, word) that is the same in every block."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _suffixes(ids: np.ndarray, fresh: np.ndarray, own: int, deepest: int) -> np.ndarray:
    """A row of word numbers (from 1; 0: none) for each own token that begins a suffix of two words or more."""
    n = len(ids)
    out = np.zeros((n, deepest), np.int32)
    live, goes_on = np.ones(n, bool), ~fresh
    out[:, 0] = ids + 1
    for d in range(1, min(deepest, n)):
        live = live[: n - d] & goes_on[d:]
        out[: n - d, d] = np.where(live, ids[d:] + 1, 0)
    out = out[:own]
    return out[out[:, 1] > 0]


def _order(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which equal prefixes stand together: columns packed into as few 62-bit keys as hold them."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    per = max(1, 62 // bits)
    keys = []
    for a in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for c in range(a, min(a + per, rows.shape[1])):
            key = key << bits | rows[:, c]
        keys.append(key)
    return np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")


def leaves(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and the totals of their counts."""
    if not len(rows):
        return rows, counts
    order = _order(rows)
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(counts[order], first)


def _deal(lang: str, words: pa.Array, hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, groups: int, over: np.ndarray):
    """Packed chunks of sorted leaves, one for each group that they fall into. over: by length of prefix and group, whether
    its load is above the budget; group numbers begin at depth * groups."""
    grp = np.full(len(rows), -1)
    for depth in range(2, rows.shape[1] + 1):
        open_ = np.flatnonzero(grp < 0)
        g = _loads(hashes, rows[open_], depth, groups)
        fits = ~over[depth - 2, g] if depth < rows.shape[1] else np.ones(len(g), bool)
        grp[open_[fits]] = g[fits] + depth * groups
    order = np.argsort(grp, kind="stable")
    grp, rows, counts = grp[order], rows[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1], [True]])) if len(grp) else []
    codec = pa.Codec("zstd", compression_level=1)
    for a, b in zip(edges[:-1], edges[1:]):
        used, local = np.unique(rows[a:b], return_inverse=True)
        local = local.reshape(b - a, -1)
        if used[0] == 0:
            used = used[1:]
        else:
            local = local + 1
        kind = np.uint16 if len(used) < 65535 else np.int32
        chosen = words.take(pa.array(used - 1)).cast(pa.binary())
        order = pc.sort_indices(chosen).to_numpy()  # sorted words pack well
        place = np.zeros(len(used) + 1, np.int32)
        place[order + 1] = np.arange(1, len(used) + 1)
        local = place[local]
        text = b"\n".join(chosen.take(pa.array(order)).to_pylist())
        yield int(grp[a]), lang, int(b - a), len(text), codec.compress(text, asbytes=True), codec.compress(local.astype(kind).tobytes("F"), asbytes=True), codec.compress(counts[a:b].astype(np.int64).tobytes(), asbytes=True)


def _open(chunk: dict, deepest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words, rows, counts of a packed chunk."""
    codec, n = pa.Codec("zstd"), chunk["n"]
    words = pc.split_pattern(pa.array([codec.decompress(chunk["words"], chunk["size"], asbytes=True).decode()]), "\n").values
    kind = np.uint16 if len(words) < 65535 else np.int32
    ids = np.frombuffer(codec.decompress(chunk["ids"], n * deepest * np.dtype(kind).itemsize), kind).reshape(deepest, n).T
    return words, ids.astype(np.int32), np.frombuffer(codec.decompress(chunk["counts"], n * 8), np.int64)


def _as_batches(rows, rows_each: int = 256):
    names = [c.split()[0] for c in _PACKED.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4]) + len(r[5]) + len(r[6])
        if len(held) == rows_each or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _subtrees(parts: DataFrame, groups: int, deepest: int, least: int) -> DataFrame:
    """lang, phrase, words, f of the nodes of each group's subtree, from its sorted leaves. Nodes of at least the words of the
    group's prefixes are whole in it and are kept from `least` on; shorter ones are parts of a total."""

    def build(t: pa.Table) -> pa.Table:
        out, depth = [], t["grp"][0].as_py() // groups
        for lang in pc.unique(t["lang"]).to_pylist():
            chunks = [_open(c, deepest) for c in t.filter(pc.equal(t["lang"], lang)).to_pylist()]
            coded = pa.concat_arrays([c[0] for c in chunks]).dictionary_encode()
            number = np.concatenate([[0], coded.indices.to_numpy(zero_copy_only=False) + 1]).astype(np.int32)
            at, rows = 0, []
            for words, ids, _ in chunks:
                rows.append(np.where(ids > 0, number[ids + at], 0).astype(np.int32))
                at += len(words)
            rows, counts = leaves(np.concatenate(rows), np.concatenate([c[2] for c in chunks]))
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for d in range(1, deepest + 1):
                new[1:] |= rows[1:, d - 1] != rows[:-1, d - 1]
                if d < 2:
                    continue
                first = np.flatnonzero(new)
                f = np.add.reduceat(counts, first)
                keep = (rows[first, d - 1] > 0) & ((f >= least) | (d < depth))
                first, f = first[keep], f[keep]
                texts = [coded.dictionary.take(pa.array(rows[first, c] - 1)) for c in range(d)]
                out.append(pa.table({"lang": pa.repeat(pa.scalar(lang), len(f)), "phrase": pc.binary_join_element_wise(*texts, " "), "words": pa.repeat(pa.scalar(d, pa.int32()), len(f)), "f": pa.array(f)}))
        return pa.concat_tables(out)

    return parts.groupBy("grp").applyInArrow(build, "lang string, phrase string, words int, f long")


def phrase_counts(docs: DataFrame, least: int = 100, deepest: int = 5, budget: int = 2_000_000, block: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `deepest` words that occur at least `least` times, and (lang, n).

    budget: suffixes that one task may hold, about 60 bytes each; block: bytes of text that a task cuts up at a time."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, size // (3 * budget))  # half a budget each at 6 bytes a word
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    single = stash(_counted(texts, block, deepest, groups).groupBy("lang", "word", "grp").agg(F.sum("f").alias("f")).where((F.col("f") > budget) | F.col("grp").isNull()))
    sums = stash(single.where("word is not null").groupBy("lang").agg(F.sum("f").alias("n")))
    over = np.zeros((deepest - 1, groups), bool)
    for r in single.where("grp is not null").select("grp").toLocalIterator():  # at most one in `budget` suffixes
        over[divmod(r["grp"] - 2 * groups, groups)] = True
    shared = spark.sparkContext.broadcast(over)

    def suffixes(batches):
        def rows():
            for lang, data, end in blocks(batches, block, deepest):
                words, ids, fresh, start = cut_up(data)
                if len(words):
                    found = _suffixes(ids, fresh, int(np.searchsorted(start, end)), deepest)
                    found, counts = leaves(found, np.ones(len(found), np.int64))
                    yield from _deal(lang, words, _hashes(lang, words), found, counts, groups, shared.value)

        yield from _as_batches(rows())

    nodes = _subtrees(texts.mapInArrow(suffixes, _PACKED), groups, deepest, least)
    if over.any():  # nodes above the prefixes of a group are in parts
        nodes = nodes.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    often = single.where((F.col("f") >= least) & F.col("word").isNotNull())
    ones = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    return stash(ones.unionByName(nodes)), sums


def collocations(docs: DataFrame, least: int = 100, deepest: int = 5, top: int = 2000, percent: int = 100, slots: int = 256, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language.

    A phrase's score is that of its worst cut into two; a phrase inside a longer candidate that has `percent` of its
    occurrences is dropped (one word more on either side decides: any longer one lies between, by counts)."""
    counts, sums = phrase_counts(docs, least, deepest, **how)
    word = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    found = counts.where("words > 1")
    cuts = found.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stash(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail")))
    of = lambda name, count: counts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias(name), F.col("f").alias(count))
    left, right = of("of_head", "l"), of("of_tail", "r")
    scored = cuts.hint("merge").join(left.hint("merge"), (cuts["lang"] == left["of_lang"]) & (cuts["head"] == left["of_head"])).drop("of_lang", "of_head")
    scored = scored.hint("merge").join(right.hint("merge"), (scored["lang"] == right["of_lang"]) & (scored["tail"] == right["of_tail"])).drop("of_lang", "of_tail")
    n = sums.withColumnRenamed("lang", "of_lang")
    scored = scored.join(F.broadcast(n), scored["lang"] == n["of_lang"])  # one row for each language of the corpus
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = scored.select("lang", "phrase", "a", "k", "l", "r", "n", score.alias("score")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    longer = found.where("words > 2").select("lang", F.col("f"), F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = stash(longer.groupBy("lang", "phrase").agg(F.max("f").alias("within")))
    kept = best.hint("merge").join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("within") < F.lit(percent) * F.col("a"), F.lit(True)))
    rank = F.expr("row_number() over (partition by lang, slot order by score desc, a desc, phrase)")
    kept = kept.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(slots))).withColumn("rank", rank).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, ws[i : i + d - 1] AS ws, d FROM starts, (VALUES (1), (2), (3), (4), (5)) AS k(d) WHERE i + d - 1 <= len(ws)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, d, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY 1, 2, 4),
sums AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM f WHERE d = 1 GROUP BY 1),
cand AS (SELECT * FROM f WHERE d > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, ws, d, f AS a, unnest(range(1, d)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.d, c.a, c.k, x.f AS l, y.f AS r, s.n, (1000 * c.a * s.n) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 :], ' ') JOIN sums s ON s.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.d > b.d AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def brute_force(rows, least: int = 100, deepest: int = 5, top: int = 2000, percent: int = 100) -> list[tuple]:
    """The same by definition, for tests. rows: (lang, text)."""
    f: dict[str, Counter] = {}
    for lang, text in rows:
        data = (text or "").encode().translate(LOWER)
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for d in range(1, deepest + 1):
                f.setdefault(lang or "und", Counter()).update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rest = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(p, q) for q, b in good.items()):
                continue
            score, _, left, right = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rest.append((-score, -a, b" ".join(p), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rest)[:top])]
    return out
