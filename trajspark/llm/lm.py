"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model that holds every pair of words of every training text: p(b | a) = (n(ab) + K p(b)) / (n(a) + K)
with the add-half unigram p(b) (hierarchical Dirichlet smoothing, which sums to one). As an automaton: each word of the
training texts is a state; a pair is an arc from the state of its first word with weight p(b | a); every state has a
failure arc to the empty history with weight K / (n(a) + K), where each word has an arc of weight p(b). One traversal from
left to right carries the state and adds up logarithms.

The whole automaton grows with the corpus, so no worker holds it. Texts fall into blocks of about `block_bytes`; a block
needs the states and arcs of its own words and pairs only, which are known from its texts. Every block counts them in its
training texts and sends them, each distinct word or pair once, as sorted lists to ranges of the key space; a range adds
the blocks up, and what a block could not know (the count in other blocks) goes back to it. There the block's part of the
automaton is put together and its texts are traversed. Nothing is cut: each count is that of the whole training corpus. A
block has each key at most once, and there are as many ranges as blocks, so frequent words make no hot task. Words and
pairs are keyed by 64-bit hashes.

Cases: null and empty texts are one end token; with no training text N and V are 0 and every token has probability 1;
a null doc_id counts as empty text in the crc; repeated rows give one result each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import crc_mod, slices, table

END = b"\n"  # no word holds white space
#: Weight of the unigram in a history's distribution, in tokens.
PRIOR = 200.0
_U = np.uint64
#: Keys are hashes of 63 bits; their lowest bit is free to mark what stands in a training text.
_EVEN = ~_U(1)


def tokens(text: bytes | None) -> list[bytes]:
    w = text.lower().split() if text else []
    w.append(END)
    return w


def word_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts in a row, and the place where each text begins (one more: the end)."""
    keys, begins = [], [0]
    for t in texts:
        w = tokens(t)
        keys.append(np.fromiter(map(xxh3_64_intdigest, w), _U, len(w)))
        begins.append(begins[-1] + len(w))
    return (np.concatenate(keys) & _EVEN if keys else np.zeros(0, _U)), np.array(begins)


def pair_keys(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Key of the pair that ends at each token; 0 for the first token of a text."""
    w, out = words, np.zeros(len(words), _U)
    a = w[:-1] * _U(0x9E3779B97F4A7C15)
    h = (a ^ (a >> _U(29))) * _U(0xBF58476D1CE4E5B9) + w[1:]
    h *= _U(0x94D049BB133111EB)
    out[1:] = (h ^ (h >> _U(31))) & _EVEN
    out[begins[:-1]] = 0
    return out


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the key space that each key falls into."""
    return ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def corpus_size(docs: DataFrame, ranges: int, flush: int = 4_000_000) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of all rows of docs; tasks count before they shuffle sorted lists to key ranges."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        part, lists, counts = _lists(_ranges(keys, ranges), keys, n)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(lists, pa.binary()), pa.array(counts, pa.binary())], names=["part", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, 512, 4 << 20):
                held.append(word_keys(part.column(0).to_pylist())[0])
                size += len(held[-1])
                if size >= flush:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def add_up(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([np.cumsum(_unpack(k), dtype=_U) for k in t["keys"].to_pylist()]))
        return pa.table([pa.array([sum(int(_unpack(c).sum()) for c in t["counts"].to_pylist())]), pa.array([len(keys)])], ["n", "v"])

    lists = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part long, keys binary, counts binary")
    parts = lists.groupBy("part").applyInArrow(add_up, "n long, v long")
    return tuple(parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


class Automaton:
    """The states and arcs that a block of texts can meet: `count` is the whole corpus's count of a word or pair. A word with
    a count is a state."""

    def __init__(self, count: np.ndarray, total: int, kinds: int, prior: float = PRIOR):
        self.count, self.prior = count, prior
        self.denominator = total + 0.5 * (kinds + 1) if total else 0.5

    def traverse(self, word: np.ndarray, pair: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token in order (the places in count of its word and of the pair that it ends): log10 weight of the path
        that reads it, log10 weight of the empty history's arc, and its count. The state after a token is the token's own if
        the model has one, else the empty history, so all states are known at once and the block is read in one step."""
        n = self.count[word]
        root = (n + 0.5) / self.denominator
        history = np.zeros(len(n), np.int64)
        history[1:] = n[:-1]
        arc = self.count[pair]
        history[begins[:-1]] = arc[begins[:-1]] = 0  # a text starts at the empty history
        # an arc where there is one; the failure arc and the empty history's arc otherwise: n(ab) is 0 there
        path = (arc + self.prior * root) / (history + self.prior)
        return np.log10(path), np.log10(root), n


def _blocked(docs: DataFrame, training: Column, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, doc_id, text, train; number of blocks): rows dealt by their place, so that equal rows are dealt as well."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    return rows.select(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text", "train"), blocks


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers as eight runs of bytes, lowest first, so that the shuffle's compression leaves small ones short."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U).ravel()


def _lists(group: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """One row for each run of equal values in group: the value, the run's ascending keys as differences, and its counts."""
    at = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(at[1:], len(group))
    first = [_pack(np.diff(keys[i:j], prepend=_U(0))) for i, j in zip(at, ends)]
    return group[at].tolist(), first, [_pack(n[i:j]) for i, j in zip(at, ends)]


def _marked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words and then of the pairs of a block's tokens, their lowest bit set in training texts; begins). A
    text's first token has the key of its word in place of a pair, without a mark."""
    words, begins = word_keys(t["text"].to_pylist())
    pairs, train = pair_keys(words, begins), np.repeat(np.asarray(t["train"].to_pylist(), _U), np.diff(begins))
    both = np.concatenate([words | train, pairs | train])
    both[len(words) + begins[:-1]] = words[begins[:-1]]
    return both, begins


def _own_counts(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, their counts in training texts, where each begins) of sorted marked keys."""
    keys = marked & _EVEN
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(marked & _U(1), at).astype(np.int64), at


def score(docs: DataFrame, training: Column, prior: float = PRIOR, block_bytes: int = 12 << 20) -> tuple[DataFrame, int]:
    """(doc_id, train, n_tokens, n_known, base_score, score for every row of docs; N). The rows where `training` holds
    are learned from."""
    blocks, ranges = _blocked(docs, training, block_bytes)
    total, kinds = corpus_size(docs.where(training), ranges)

    def ask(t: pa.Table) -> pa.Table:
        marked, _ = _marked(t)
        marked.sort()
        keys, n, _ = _own_counts(marked)
        part, lists, counts = _lists(_ranges(keys, ranges), keys, n)
        return pa.table([pa.array(part, pa.int64()), pa.array([t["block"][0].as_py()] * len(part), pa.int32()), pa.array(lists, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "keys", "counts"])

    def add_up(t: pa.Table) -> pa.Table:
        lists, counts = [np.cumsum(_unpack(k), dtype=_U) for k in t["keys"].to_pylist()], [_unpack(c).view(np.int64) for c in t["counts"].to_pylist()]
        keys, n = np.concatenate(lists), np.concatenate(counts)
        block = np.repeat(np.asarray(t["block"], np.int64), [len(x) for x in lists])
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ _U(1)))
        whole = np.empty(len(keys), np.int64)
        whole[order] = np.repeat(np.add.reduceat(n[order], begins), np.diff(np.append(begins, len(keys))))
        others = whole - n
        keep = others > 0  # lists stay in the order of blocks and keys
        back, lists, counts = _lists(block[keep], keys[keep], others[keep])
        return pa.table([pa.array(back, pa.int32()), pa.array(lists, pa.binary()), pa.array(counts, pa.binary())], ["block", "keys", "others"])

    asked = blocks.groupBy("block").applyInArrow(ask, "part long, block int, keys binary, counts binary")
    replies = asked.groupBy("part").applyInArrow(add_up, "block int, keys binary, others binary")

    def read(texts: pa.Table, more: pa.Table) -> pa.Table:
        names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        kinds_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not texts.num_rows:
            return pa.table([pa.array([], k) for k in kinds_], names)
        marked, begins = _marked(texts)
        order = np.argsort(marked)
        keys, n, at = _own_counts(marked[order])
        place = np.empty(len(order), np.int32)
        place[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(order))))
        del marked, order, at
        for k, c in zip(more["keys"].to_pylist(), more["others"].to_pylist()):
            n[np.searchsorted(keys, np.cumsum(_unpack(k), dtype=_U))] += _unpack(c).view(np.int64)
        word, pair = place[: len(place) // 2], place[len(place) // 2 :]
        path, root, known = Automaton(n, total, kinds, prior).traverse(word, pair, begins)
        sums = lambda x: np.add.reduceat(x, begins[:-1])
        out = [texts["doc_id"], texts["train"], np.diff(begins), sums((known > 0).astype(np.int64)), sums(root) if total else np.zeros(texts.num_rows), sums(path) if total else np.zeros(texts.num_rows)]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(out, kinds_)], names)

    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(read, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored, total


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the model of the training rows, and under their add-half unigrams."""
    scored, total = score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def brute_force(rows: list[tuple], train: list[bool], prior: float = PRIOR) -> list[tuple]:
    """For tests: (doc_id, n_tokens, n_known, base_score, score) with plain counters and the automaton walked arc by arc."""
    import re
    from collections import Counter
    from math import log10

    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    words, arcs = Counter(), Counter()
    for (_, t), use in zip(rows, train):
        if use:
            words.update(low(t))
            arcs.update(zip(low(t), low(t)[1:]))
    total = sum(words.values())
    out = []
    for doc, t in rows:
        state, base, path, known = None, 0.0, 0.0, 0
        for w in low(t):
            p = (words[w] + 0.5) / (total + 0.5 * (len(words) + 1)) if total else 1.0
            base += log10(p)
            known += words[w] > 0
            if state is None:
                path += log10(p)
            elif (state, w) in arcs:
                path += log10((arcs[state, w] + prior * p) / (words[state] + prior))
            else:
                path += log10(prior / (words[state] + prior)) + log10(p)
            state = w if w in words else None
        out.append((doc, len(low(t)), known, base, path))
    return out
