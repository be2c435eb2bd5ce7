"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes over 3-word shingles. Two fingerprints that differ in at most 2 bits differ in at most
1 bit of the lower or of the upper 32 bits, so each half is covered by itself with threshold 1. The anchors of a half
are the code words of the perfect [31,26] Hamming code on its lower 31 bits, each with the 32nd bit as it is: covering
radius 1, 2^27 anchors. Every distinct fingerprint is put at its nearest anchor ("home") and copied to every anchor
within covering radius plus threshold, 17 in each half, and fingerprints are compared inside an anchor: home rows with
the copies that arrive there. Any pair within the threshold meets at the home of either.

An anchor where more than `crowd` comparisons would meet is not expanded. All fingerprints that touch such an anchor
are linked by their one-bit neighbourhood instead: two fingerprints are within 2 bits exactly if their radius-1 balls
share a point, so linking every fingerprint to the smallest one at each of its 65 points gives the same components with
a number of rows linear in the group. Exact copies are one fingerprint from the start.

Cases: null or empty texts have fingerprint zero; repeated rows give one result each; a null doc_id takes part in
linking without becoming a component_id (null if no other is reachable); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stash, table
from .components import connected_components

_FULL = 1 << 16


def fingerprint_of(text: bytes | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of a text's shingles: a bit is 1 if set in over half of the XXH64 (seed 42) values."""
    from xxhash import xxh64_intdigest as h

    w = text.lower().split() if text else []
    if not w:
        return 0
    if len(w) < size:
        hashes = [h(b" ".join(w), 42)]
    elif size == 3:
        hashes = [h(b"%b %b %b" % t, 42) for t in zip(w, w[1:], w[2:])]
    else:
        hashes = [h(b" ".join(w[i : i + size]), 42) for i in range(len(w) - size + 1)]
    ones, all_ = np.zeros(64, np.int64), np.array(hashes, np.uint64)
    for i in range(0, len(all_), _FULL):
        ones += np.unpackbits(all_[i : i + _FULL].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(all_), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (signed long) for every row of docs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(source, lambda c: [c[0], [fingerprint_of(t, size) for t in c[1]]], "doc_id long, fp long")


#: Parity masks of the Hamming code: bit j of mask k is set if position j+1 has bit k.
_MASKS = [sum(1 << j for j in range(31) if (j + 1) >> k & 1) for k in range(5)]


def _syndrome(half: Column) -> Column:
    s = F.lit(0)
    for k, mask in enumerate(_MASKS):
        s = s.bitwiseOR(F.shiftleft((F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2).cast("int"), k))
    return s


def _unit(position: Column) -> Column:
    """The word with only that position set; position 0 is the empty word."""
    return F.when(position == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))


def _halves(fps: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.inline(F.array(F.struct(F.lit(0).alias("half"), low.alias("word")), F.struct(F.lit(1).alias("half"), high.alias("word")))))
    return halves.withColumn("s", _syndrome(F.col("word")))


def anchored(fps: DataFrame) -> DataFrame:
    """half, anchor, fp, home: each fp at its home anchor and at all anchors within radius 1 + threshold 1, in both halves."""
    halves = _halves(fps)
    # flipping position j leads to the code word that also flips j xor s; each pair {j, j xor s} counts once
    j = halves.select("half", "word", "fp", "s", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("j"))
    other = F.col("j").bitwiseXOR(F.col("s"))
    j = j.where((F.col("j") == 32) | (F.col("j") < other) | ((F.col("s") == 0) & (F.col("j") == 0)))
    corrected = F.col("word").bitwiseXOR(_unit(F.col("s")))
    anchor = F.when(F.col("j") == 32, corrected.bitwiseXOR(F.lit(1 << 31).cast("long"))).otherwise(F.col("word").bitwiseXOR(_unit(F.col("j"))).bitwiseXOR(_unit(other)))
    home = (F.col("j") == 0)
    return j.select("half", anchor.alias("anchor"), "fp", home.alias("home"))


def near_links(fps: DataFrame, max_bits: int = 2, crowd: int = 4096) -> DataFrame:
    """a, b: links between distinct fingerprints whose components are those of all pairs within 2 bits."""
    if max_bits != 2:
        raise ValueError("the anchors are built for a threshold of 2 bits")
    # most copies stand at anchors that are no one's home: they are left out before anything is written
    homes = stash(_halves(fps).select("half", F.col("word").bitwiseXOR(_unit(F.col("s"))).alias("anchor")).distinct())
    at = stash(anchored(fps).hint("merge").join(homes.hint("merge"), ["half", "anchor"], "left_semi"))
    load = at.groupBy("half", "anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("copies")).where("homes > 0 and copies > 1")
    load = stash(load)
    calm = load.where(F.col("homes") * F.col("copies") <= crowd).select("half", "anchor")
    rush = load.where(F.col("homes") * F.col("copies") > crowd).select("half", "anchor")
    here = at.hint("merge").join(calm.hint("merge"), ["half", "anchor"], "left_semi")
    homes = here.where("home").select("half", "anchor", F.col("fp").alias("a"))
    copies = here.select("half", "anchor", F.col("fp").alias("b"))
    pairs = homes.hint("merge").join(copies.hint("merge"), ["half", "anchor"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()
    crowded = at.hint("merge").join(rush.hint("merge"), ["half", "anchor"], "left_semi").select("fp").distinct()
    return pairs.unionByName(_ball_links(crowded))


def _ball_links(fps: DataFrame) -> DataFrame:
    """Link each fingerprint to the smallest one that shares a point of its radius-1 ball."""
    bit = F.col("i")
    flip = F.when(bit == 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    points = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("fp", F.col("fp").bitwiseXOR(flip).alias("point"))
    first = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "a")
    return points.hint("merge").join(first.hint("merge"), "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, crowd: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most 2 bits) for every row of docs."""
    prints = stash(fingerprints(docs, size))
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = near_links(classes.select("fp"), crowd=crowd)
    roots = connected_components(links)
    # the smallest doc_id of a component: over its fingerprints' own smallest
    member = classes.hint("merge").join(roots.hint("merge"), classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    member = stash(member)
    lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    labelled = member.hint("merge").join(lowest.hint("merge"), "root").select("fp", "component_id")
    return prints.hint("merge").join(labelled.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """For tests: (doc_id, fingerprint, component_id) by comparing all pairs."""
    fps = [(d, fingerprint_of(t.encode() if t is not None else None) & (2**64 - 1)) for d, t in docs]
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for k in range(i):
            if (fps[i][1] ^ fps[k][1]).bit_count() <= 2 and group[i] != group[k]:
                old, new = group[i], group[k]
                group = [new if g == old else g for g in group]
    low: dict[int, int] = {}
    for g, (d, _) in zip(group, fps):
        low[g] = min(d, low.get(g, d))
    return [(d, f"{fp:016x}", low[g]) for g, (d, fp) in zip(group, fps)]
