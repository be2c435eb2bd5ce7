"""Utility, cost, sequence and validities of trajectories, an Arrow batch at a time.

reward.py writes each rule as an expression over nested arrays. Inside of lambdas Spark interprets these node by node, which took most of the
time of every query that needs all scores. Here the calls of a batch are flat numpy arrays; only the words of texts are taken call by call. Pairs
of calls are compared in slices of about a million, so that a very long trajectory is bounded in memory too.

Cases: null tool_calls give null scores; a null output reads "None"; a null or short box has no coordinates, and a comparison with a
missing coordinate is false; a NaN is above every number, as in Spark; a null question asks for nothing.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reward as R

COUNTERS = ["cost_dup_spatial", "cost_dup_ocr", "cost_oscillation", "cost_consecutive_same", "cost_call_budget"]
_TYPES = {"utility": pa.float64(), "cost": pa.float64(), **dict.fromkeys(COUNTERS, pa.int64()), "sequence": pa.float64(), "validities": pa.list_(pa.int32())}
_SCHEMA = f"struct<utility:double,cost:double,{','.join(c + ':bigint' for c in COUNTERS)},sequence:double,validities:array<int>>"
_PAIRS = 1 << 20


# --- texts --------------------------------------------------------------------------------------------------------

_PLAIN_WORD = re.compile(r"\w+", re.ASCII)


@lru_cache(1)
def _any_word() -> re.Pattern:
    """Word characters of any script as Java's (?U)\\w has them: Python's own leaves out marks and takes in fractions."""
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc"}
    circled = [(0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189), (0x200C, 0x200D)]
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        is_word = c <= sys.maxunicode and (unicodedata.category(chr(c)) in kinds or any(a <= c <= b for a, b in circled))
        if is_word and begin is None:
            begin = c
        elif not is_word and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return re.compile(f"[{''.join(out)}]+")


def words(low: str) -> frozenset[str]:
    """Distinct words of a text in lower case."""
    return frozenset((_PLAIN_WORD if low.isascii() else _any_word()).findall(low))


_KINDS = [(re.compile(kind), value) for kind, _, value in R.KINDS]
_EXISTENCE, _CUES = re.compile(R.EXISTENCE), re.compile(R.NUMBER_CUES)
# white space as Java's \s has it; trim takes off spaces only
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


@lru_cache(1 << 12)
def _asked(question: str | None):
    """Long words, known words, which kinds it is of, existence, number."""
    if question is None:
        return frozenset(), None, (False,) * len(_KINDS), False, False
    low = question.lower()
    long = frozenset(w for w in words(low) if len(w) >= 3)
    return long, frozenset(_SPACE.split(low.strip(" "))), tuple(bool(k.search(low)) for k, _ in _KINDS), bool(_EXISTENCE.search(low)), bool(_CUES.search(low))


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _evidence(low: list[str], lows: pa.Array, length: np.ndarray, found: list[frozenset], asked: list, text: np.ndarray, question: np.ndarray) -> np.ndarray:
    """Relevance, number hint and novelty of pairs of an output and a question, given by their places."""
    useful = ((length > 0) & ~pc.is_in(lows, value_set=pa.array(["none", "null"], lows.type)).to_numpy(zero_copy_only=False))[text]
    fact = lambda f, shape: np.array([f(a) for a in asked], bool).reshape(len(asked), *shape)[question]
    kinds, existence, number = fact(lambda a: a[2], (len(_KINDS),)), fact(lambda a: a[3], ()), fact(lambda a: a[4], ())
    long, shared, fresh = (np.zeros(len(text), bool) for _ in range(3))
    for k, (t, q) in enumerate(zip(text.tolist(), question.tolist())):
        if w := found[t]:
            wanted, known = asked[q][:2]
            if wanted:
                long[k], shared[k] = max(map(len, w)) > 2, not wanted.isdisjoint(w)
            if len(w) > 2 and known is not None:
                fresh[k] = len([x for x in w if len(x) > 3 and x not in known]) > 2
    relevance = np.where(existence & (length > 20)[text], 0.5, 0.0)
    for k, (_, given, value) in reversed(list(enumerate(R.KINDS))):
        relevance = np.where(kinds[:, k] & _has(lows, given)[text], value, relevance)
    relevance = np.where(long, np.where(shared, 0.6, relevance), 0.0)
    hint = np.where(number & _has(lows, "[0-9]")[text], 0.15, 0.0)
    return np.where(useful, relevance * 0.4 + hint + np.where(fresh, 0.15, 0.0), 0.0)


def _numbered(values: pa.Array) -> tuple[np.ndarray, list]:
    """The place of every value among the distinct ones, null like any other, and these."""
    coded = pc.dictionary_encode(values, null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


# --- boxes: x1, y1, x2, y2 and whether all four are there ----------------------------------------------------------


def _above(x, y):
    """x > y with NaN above every number."""
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def _boxes(box: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = pc.fill_null(pc.list_value_length(box), 0).to_numpy(zero_copy_only=False)
    flat, begin = box.values, box.offsets.to_numpy()[:-1]
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    value = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(float)
    out, ok = np.zeros((4, len(box))), n >= 4
    for k in range(4):
        at = begin[ok] + k
        out[k, ok] = value[at]
    whole = ok.copy()
    whole[ok] = np.logical_and.reduce([there[begin[ok] + k] for k in range(4)]) if ok.any() else []
    return out, whole


def _area(b: np.ndarray) -> np.ndarray:
    return (b[2] - b[0]) * (b[3] - b[1])


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    side = lambda i: np.maximum(0.0, np.fmin(a[i + 2], b[i + 2]) - np.maximum(a[i], b[i]))
    both = side(0) * side(1)
    union = _area(a) + _area(b) - both
    return np.where((both != 0) & _above(union, 0.0), both / np.where(union == 0, 1.0, union), 0.0)


def _earlier(row: np.ndarray):
    """(later, earlier): all pairs of places in `row` (sorted) with equal values, in slices of bounded size."""
    first = np.searchsorted(row, row)
    many = np.arange(len(row)) - first
    sofar = np.cumsum(many)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(sofar, (sofar[a - 1] if a else 0) + _PAIRS, "right")))
        later = np.repeat(np.arange(a, b), many[a:b])
        within = np.arange(len(later)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])
        yield later, first[later] + within
        a = b


# --- sequence and format ------------------------------------------------------------------------------------------


@lru_cache(1 << 14)
def _sequence(names: tuple) -> float:
    n, kinds, total = len(names), len(set(names)), 0.0
    if n < 2:
        return 0.0
    for pattern, weight in R.PREFERRED + R.ANTI:
        total += sum(names[i : i + len(pattern)] == tuple(pattern) for i in range(n - len(pattern) + 1)) * weight
    total += 0.2 if kinds >= 3 else 0.1 if kinds == 2 else -0.3
    return max(-1.0, min(1.0, total))


@lru_cache(1 << 12)
def _validity(raw: str | None) -> int:
    """As reward.validity without raw text; 4 where the box decides."""
    if not raw:
        return 0
    low = raw.lower()
    tool = R.ALIASES.get(low, low if low in R.KNOWN_TOOLS else None)
    return 1 if tool is None else 4 if tool in R.SPATIAL else 3


# --- a batch ------------------------------------------------------------------------------------------------------


def score(tool_calls: pa.ListArray, question: pa.Array, gt_box: pa.Array, config: R.RewardConfig) -> pa.StructArray:
    rows, none = len(tool_calls), tool_calls.is_null().to_numpy(zero_copy_only=False)
    flat = tool_calls.flatten()  # without what stands under nulls
    n = pc.fill_null(pc.list_value_length(tool_calls), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    row = np.repeat(np.arange(rows), n)
    i = np.arange(len(row)) - np.repeat(ends - n, n)
    name, raw = (pc.dictionary_encode(pc.struct_field(flat, f), null_encoding="encode") for f in ("tool_name", "raw_name"))
    # texts repeat: what depends on a text, or on a text and a question, is found once for each in a batch
    text, texts = _numbered(pc.struct_field(flat, "output"))
    bbox = pc.struct_field(flat, "bbox")
    box, whole = _boxes(bbox)
    area = _area(box)

    code, codes = name.indices.to_numpy(), {x: k for k, x in enumerate(name.dictionary.to_pylist())}
    is_tool = lambda *tools: np.isin(code, [codes[t] for t in tools if t in codes])
    spatial_name, zoom, ocr = is_tool(*R.SPATIAL), is_tool("zoom"), is_tool("ocr")
    spatial = spatial_name & bbox.is_valid().to_numpy(zero_copy_only=False)
    boxed = spatial & whole

    # pairs of boxes
    dup_spatial, again = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    at = np.flatnonzero(boxed)
    for later, earlier in _earlier(row[at]):
        later, earlier = at[later], at[earlier]
        v = _iou(box[:, later], box[:, earlier])
        np.add.at(dup_spatial, later[_above(v, config.iou_threshold)], 1)
        same = _above(v, 0.9)
        again[later[same]] = again[earlier[same]] = True

    # texts
    output = ["None" if t is None else t for t in texts]
    low = [t.lower() for t in output]
    lows = pa.array(low, pa.large_string())
    found = list(map(words, low))
    asking, questions = _numbered(question)
    pairs, pair = np.unique(text.astype(np.int64) * max(len(questions), 1) + asking[row], return_inverse=True)
    length = np.fromiter(map(len, output), np.int64, len(output))
    evidence = _evidence(low, lows, length, found, list(map(_asked, questions)), *divmod(pairs, len(questions)))[pair] if len(row) else np.zeros(0)
    read = ocr & np.fromiter(map(bool, texts), bool, len(texts))[text]
    gain = (np.where(_has(lows, "[0-9]"), 0.15, 0.0) + np.where(_has(lows, R.UNITS), 0.15, 0.0))[text]
    dup_ocr, seen = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    at = np.flatnonzero(ocr)
    for later, earlier in _earlier(row[at]):
        later, earlier = at[later], at[earlier]
        for k, p, t, u in zip(later.tolist(), earlier.tolist(), text[later].tolist(), text[earlier].tolist()):
            x, y = found[t], found[u]
            if x and y and read[k] and len(x & y) / max(len(x), len(y)) > config.text_threshold:
                seen[k] = True
                dup_ocr[k] += read[p]
    gain = np.where(read, gain - np.where(seen, 0.2, 0.0), 0.0)

    # neighbours
    def behind(x, by, fill):
        out = np.full(len(x), fill)
        if len(x) > by:
            out[by:] = np.where(i[by:] >= by, x[:-by], fill)
        return out

    last = i == np.repeat(n, n) - 1
    ahead = np.zeros(len(row), bool)
    ahead[:-1] = zoom[1:] & ~last[:-1]
    middle = behind(zoom, 1, False) & spatial_name & ahead
    third = behind(middle, 1, False)
    consecutive = (i > 0) & (code == behind(code, 1, -1))
    budget = i >= config.call_budget
    part = lambda on, weight: np.where(on, weight, 0.0)
    cost = np.maximum.reduce([part((dup_spatial > 0) | (dup_ocr > 0), 0.6), part(middle | third, 0.4), part(consecutive, 0.3), part(budget, 0.2)])

    # utility
    gt, gt_whole = _boxes(gt_box)
    # as gt_bonus has it, a box without a tool name is not taken for one that is not spatial
    unnamed = (code == codes.get(None, -1)) & whole
    v = np.where((boxed | unnamed) & gt_whole[row], _iou(box, gt[:, row]), 0.0)
    bonus = np.where(_above(v, config.iou_threshold), 0.3, np.where(_above(v, 0.2), 0.1, 0.0))
    lazy = np.where(boxed & _above(area, config.lazy_ratio), np.where(again, -0.5, -0.3), 0.0)
    end = np.full(rows, -1)
    np.maximum.at(end, row[spatial], np.flatnonzero(spatial))
    end = end[row]
    ended = (end > np.arange(len(row))) & whole[end] if len(row) else np.zeros(0, bool)
    end_area = area[end] if len(row) else area
    refined = np.where(ended & _above(end_area, 0.0) & boxed & _above(end_area * 0.5, area), 0.15, 0.0)
    utility = np.maximum(-0.5, np.minimum(1.0, evidence + bonus + lazy + gain + refined))

    # bincount adds in the order of the calls
    total = lambda x: np.bincount(row, x, rows) if len(row) else np.zeros(rows)
    count = lambda x: total(x).astype(np.int64)
    begins = (ends - n).tolist()
    names = list(map(list(codes).__getitem__, code.tolist()))
    sequence = [_sequence(tuple(names[b:e])) for b, e in zip(begins, ends.tolist())]
    sides = whole & (pc.fill_null(pc.list_value_length(bbox), 0).to_numpy(zero_copy_only=False) == 4) & _above(box[2], box[0]) & _above(box[3], box[1])
    valid = np.array([*map(_validity, raw.dictionary.to_pylist()), 0], np.int32)[raw.indices.to_numpy()]
    valid = np.where(valid == 4, np.where(sides, 3, 2), valid).astype(np.int32)
    values = [total(utility), total(cost), count(dup_spatial), count(dup_ocr), count(middle), count(consecutive), count(budget), sequence]
    columns = [pa.array(v, t, mask=none) for v, t in zip(map(np.asarray, values), _TYPES.values())]
    offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(none, False) if none.any() else None)
    return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(valid))], list(_TYPES))


def scored(config: R.RewardConfig) -> Column:
    """struct of utility, cost, its counters, sequence and validities from tool_calls, question and gt_box."""

    def run(tool_calls: pa.Array, question: pa.Array, gt_box: pa.Array) -> pa.Array:
        return score(tool_calls, question, gt_box, config)

    return F.arrow_udf(run, _SCHEMA)(F.col("tool_calls"), F.col("question"), F.col("gt_box").cast("array<double>"))


def with_scores(df: DataFrame, config: R.RewardConfig) -> DataFrame:
    out = df.withColumn("_scores", scored(config))
    return out.withColumns({f: F.col(f"_scores.{f}") for f in _TYPES}).drop("_scores")
