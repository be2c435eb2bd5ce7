"""Near-duplicate texts: components of all pairs whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

A fingerprint of 64 bits cannot cover this threshold (at 0.8 about 10 bits differ, and in the tail 19 or more), so pairs
are found by prefix filtering, which loses none: put the shingles of all sets into one order; a set of n shingles that
shares at least 0.8 n of them with another has one of them among its first n - ceil(0.8 n) + 1, and so has the other.
Any order will do. Here it is that of the hashes, with the shingles that a bounded sample shows often put last; the
sample changes only how many rows meet, never the result.

Equal sets are one class from the start. Classes whose fingerprints op4's anchor points link (simhash.near_links: 64 bits over 3-word
shingles, 2 bits) or who share a fingerprint are candidates first. Beside these, in a first round, each class is compared with two classes at each shingle of its
prefix, the one with the largest share of shingles that others have too and the one with the largest number: this joins a
large group of near copies by stars, in rows linear in the group. A second round compares the rest: at each shingle, pairs
of classes that are in different components so far. What lies behind the prefix that ends first adds at most
ceil(0.8 n) - 1 to an overlap, so a pair is a candidate only if its lengths and the number of shingles that both prefixes
have allow 0.8. That number is at most how many of a class's own prefix stand in the round at all: classes with too few of
these do not meet, which leaves the outer members of a large group out. Candidates are confirmed by their whole sets.

Cases: words are lower-cased in A-Z and split at white space, a text of fewer words is one shingle; null texts and texts
without words are equal to each other; rows are known by doc_id and text, so that a null or repeated doc_id takes part
like any other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import map_batches, stash
from .components import connected_components


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 values (signed) of a text's shingles."""
    from xxhash import xxh64_intdigest as h

    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    found = {h(b" ".join(t), 42) for t in zip(*(w[i:] for i in range(size)))} if len(w) >= size else {h(b" ".join(w), 42)}
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def prefix(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of s in the order of hashes with those in late (sorted) put last."""
    n = len(s)
    if n and len(late):
        last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
        s = np.concatenate([s[~last], s[last]])
    return s[: n - (4 * n + 4) // 5 + 1]


#: Buckets of text hashes by which texts are left out before they are shuffled.
_BUCKETS = 1 << 18


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))


def _often(source: DataFrame, rows: int = 20_000, least: int = 20, most: int = 100_000) -> np.ndarray:
    """Shingles in at least `least` of about `rows` texts, the `most` commonest of them."""
    k = max(1, source.count() // rows)
    sample = source.where(F.pmod("h", F.lit(k)) == 0).select("text")

    def run(cols):
        values, n = np.unique(np.concatenate([shingles(t) for t in cols[0]]), return_counts=True)
        return [values.tolist(), n.tolist()]

    seen = map_batches(sample, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array(sorted(r["token"] for r in seen.orderBy(F.desc("n"), "token").limit(most).collect()), np.int64)


def _long_enough(a: str | Column, b: str | Column) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _confirmed(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """a, b: the pairs of classes with similarity 0.8 or more; only their texts are cut into shingles again."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    keys = stash(classes.hint("merge").join(wanted.hint("merge"), "cls", "left_semi").select("cls", F.col("key.doc_id").alias("k_doc"), F.col("key.h").alias("k_h")))
    # a table of fixed size keeps most other texts out of the shuffle; the join decides
    buckets = np.zeros(_BUCKETS, bool)
    buckets[[r["k"] for r in keys.select(F.pmod("k_h", F.lit(_BUCKETS)).cast("int").alias("k")).distinct().collect()]] = True
    shared = source.sparkSession.sparkContext.broadcast(buckets)

    def maybe(h):
        import pyarrow as pa

        return pa.array(shared.value[h.to_numpy(zero_copy_only=False) % _BUCKETS])

    source = source.where(F.arrow_udf(maybe, "boolean")(F.col("h")))
    texts = source.hint("merge").join(keys.hint("merge"), source["doc_id"].eqNullSafe(keys["k_doc"]) & (source["h"] == keys["k_h"])).select("cls", "text")
    cut = map_batches(texts.select("text", "cls"), lambda c: [c[1], [shingles(t) for t in c[0]]], "cls long, s array<long>")
    sets = stash(cut.groupBy("cls").agg(F.first("s").alias("s")))
    first = pairs.hint("merge").join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = first.hint("merge").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("n"))
    return stash(both.where(F.col("common") * 5 >= (F.col("n") - F.col("common")) * 4).select("a", "b"))


def _with_known(rows: DataFrame) -> DataFrame:
    """rows (token, cls, n, ...) with known: how many shingles of its prefix a class has in rows."""
    own = stash(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("known")).select(F.col("cls").alias("k_cls"), "known"))
    return stash(rows.hint("merge").join(own.hint("merge"), rows["cls"] == own["k_cls"]).drop("k_cls"))


def _allows(common: Column, na: Column, nb: Column) -> Column:
    """Whether sets of sizes na and nb whose prefixes have at most `common` shingles in common can be similar.

    Behind the prefix that ends first in the order, at most ceil(0.8 n) - 1 more are in common.
    """
    return (common + F.ceil(F.greatest(na, nb) * 4 / F.lit(5)) - 1) * 9 >= (na + nb) * 4


def _can_meet(a: str, b: str) -> Column:
    """Whether classes of columns n and known under the prefixes a and b can be similar."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return _long_enough(na, nb) & _allows(F.least(f"{a}known", f"{b}known"), na, nb)


def _candidates(met: DataFrame) -> DataFrame:
    """a, b from rows of (a, na, b, nb), one for each shingle that both prefixes have."""
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return counted.where(_allows(F.col("c"), F.col("na"), F.col("nb"))).select("a", "b")


def _pair(a: str, na: str, b: str, nb: str) -> list[Column]:
    first = F.col(a) < F.col(b)
    return [F.least(a, b).alias("a"), F.when(first, F.col(na)).otherwise(F.col(nb)).alias("na"), F.greatest(a, b).alias("b"), F.when(first, F.col(nb)).otherwise(F.col(na)).alias("nb")]


def _pairs_of_anchors(classes: DataFrame) -> DataFrame:
    """a, b from classes (cls, n, fp): those whose fingerprints are equal or linked by anchor points, by the first class of each fingerprint."""
    first = stash(classes.groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("first")))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first.cls").alias(f"{c}_cls"), F.col("first.n").alias(f"{c}_n")).hint("merge")
    near = simhash.near_links(first.select("fp")).hint("merge").join(end("a"), "a").join(end("b"), "b")
    same = classes.select("cls", "n", F.col("fp").alias("a")).hint("merge").join(end("a"), "a").where("cls <> a_cls")
    met = near.select(*_pair("a_cls", "a_n", "b_cls", "b_n")).unionByName(same.select(*_pair("cls", "n", "a_cls", "a_n")))
    return met.where(_long_enough("na", "nb")).select("a", "b")


def _pairs_of_stars(shared: DataFrame) -> DataFrame:
    end = F.struct("cls", "n", "known")
    core = F.max(F.struct((F.col("known") / F.col("n")).alias("share"), "cls", "n", "known")).alias("core")
    ends = stash(shared.groupBy("token").agg(core, F.max(end).alias("high")))
    each = shared.hint("merge").join(ends.hint("merge"), "token")
    other = {"core": F.lit(True), "high": F.col("core.cls") != F.col("high.cls")}
    met = [each.where(_can_meet("", f"{e}.") & (F.col("cls") != F.col(f"{e}.cls")) & once).select(*_pair("cls", "n", f"{e}.cls", f"{e}.n")) for e, once in other.items()]
    return _candidates(met[0].unionByName(met[1]))


def _pairs_between(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes of different components at a shingle; the largest component there is not compared with itself."""
    known = shared.drop("known").hint("merge").join(roots.hint("merge"), shared["cls"] == roots["node"], "left")
    known = stash(known.select("token", "cls", "n", F.coalesce("root", "cls").alias("root")))
    sizes = known.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = stash(sizes.groupBy("token").agg(F.max(F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.col("top.root").alias("big")))
    rows = _with_known(known.hint("merge").join(mixed.hint("merge"), "token"))
    few = stash(rows.where("root <> big").select("token", *[F.col(c).alias(f"o_{c}") for c in ("cls", "n", "root", "known")]))
    once = (F.col("root") == F.col("big")) | (F.col("o_cls") < F.col("cls"))
    met = rows.hint("merge").join(few.hint("merge"), "token").where((F.col("root") != F.col("o_root")) & once & _can_meet("", "o_"))
    return _candidates(met.select(*_pair("cls", "n", "o_cls", "o_n")))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, h (XXH64 of the text), lowest (doc_id and h of the row that its component keeps) for every row of docs.

    The smallest doc_id is kept, then the smallest h; a row without doc_id only if its component has none with one.
    """
    source = _keyed(docs)
    late = source.sparkSession.sparkContext.broadcast(_often(source))

    def run(cols):
        from xxhash import xxh64_intdigest

        out = [[] for _ in range(6)]
        for text, doc, h in zip(*cols):
            s = shingles(text)
            cls = xxh64_intdigest(s.tobytes(), 7)
            for c, v in zip(out, (doc, h, cls - (1 << 64) if cls >> 63 else cls, len(s), prefix(s, late.value), simhash.fingerprint_of(text))):
                c.append(v)
        return out

    rows = stash(map_batches(source.select("text", "doc_id", "h"), run, "doc_id long, h long, cls long, n long, prefix array<long>, fp long"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = stash(rows.groupBy("cls").agg(F.min(key).alias("key"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("fp").alias("fp")))
    at = classes.select("cls", "n", F.explode("prefix").alias("token"))
    many = stash(at.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token"))
    shared = _with_known(stash(at.hint("merge").join(many.hint("merge"), "token", "left_semi").select("token", "cls", "n")))
    near = _pairs_of_anchors(classes.select("cls", "n", "fp"))
    links = _confirmed(stash(near.unionByName(_pairs_of_stars(shared)).distinct()), classes, source)
    roots = connected_components(links)
    more = stash(_pairs_between(shared, roots))
    if not more.isEmpty():
        more = _confirmed(more, classes, source)
        roots = connected_components(links.unionByName(more))
    member = stash(classes.select("cls", "key").hint("merge").join(roots.hint("merge"), classes["cls"] == roots["node"], "left").select("cls", "key", F.coalesce("root", "cls").alias("root")))
    lowest = stash(member.groupBy("root").agg(F.min("key").alias("lowest")))
    labelled = stash(member.hint("merge").join(lowest.hint("merge"), "root").select("cls", F.struct("lowest.doc_id", "lowest.h").alias("lowest")))
    return rows.select("doc_id", "h", "cls").hint("merge").join(labelled.hint("merge"), "cls").select("doc_id", "h", "lowest")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id stays, once."""
    lowest = components(docs).select(F.col("lowest.doc_id").alias("k_doc"), F.col("lowest.h").alias("k_h")).distinct()
    lowest = stash(lowest)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h"))
    kept = rows.hint("merge").join(lowest.hint("merge"), rows["doc"].eqNullSafe(lowest["k_doc"]) & (rows["h"] == lowest["k_h"]))
    # rows of one doc_id and text may differ in other columns
    one = kept.groupBy("k_doc", "k_h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")


def brute_force(docs: list[tuple]) -> list[int]:
    """For tests: for each (doc_id, text) the least place of its component, by comparing all pairs."""
    sets = [set(shingles(t.encode() if t is not None else None).tolist()) for _, t in docs]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for k in range(i):
            if group[i] != group[k] and len(sets[i] & sets[k]) * 5 >= len(sets[i] | sets[k]) * 4:
                low, high = sorted((group[i], group[k]))
                group = [low if g == high else g for g in group]
    return group
