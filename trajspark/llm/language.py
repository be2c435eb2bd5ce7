"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises all its substrings. A text is cross-parsed against
every language: the longest match from the current place is one phrase, then the next phrase starts. A phrase is a place
in the sample, which takes log2 of the sample's length in bits: phrases times these bits estimate the cross entropy (as
all languages parse the same text, its length is left out), so that a small sample, whose matches are shorter, does not
lose by its size. The language that needs fewest bits wins. Every letter of Unicode that the
sample shows is a symbol of its own, lower-cased; letters that no sample has share one symbol, everything else another.

The arcs of all automata lie in one open hash table (arrays of numpy), so memory goes with the sample and not with the
alphabet. Texts are parsed in step, a lane for each `block` characters. A lane begins with a new phrase; where the lane
before it ends inside a phrase, it is parsed again from that state up to the place where both parses are in the same
state, which repeats until all lanes fit together: the phrases are those of an unbroken parse, however long the text.

Learning takes a bounded sample of labelled rows, with whole texts: for each language the first `rows` by hash of doc_id,
of those the ones that together stay within `chars` characters (less with many languages: `total` over all). Where no text
is as short as that, the language's shortest is taken.

Cases: null texts and texts without a letter are `und` with score 0; ties go to the language first by code point; with
nothing to learn from all texts are `und`; repeated rows give one result each; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, table

_LETTER = re.compile(r"[^\W\d_]")
_PHRASE = np.int32(1 << 30)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the automaton of all substrings; state 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link


@functools.cache
def _folded() -> np.ndarray:
    """For each code point the code point of its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        if _LETTER.match(chr(cp)):
            out[cp] = ord(chr(cp).lower()[0])
    return out


class Arcs:
    """Hash table from (state, symbol), as one number, to the next state."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.to[slot[first]] = keys[first], to[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Next state for each key, -1 where there is no arc."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.to[slot[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return out


class Parser:
    """Automata of all languages; symbol 0 stands for every character that is no letter. A step that begins a phrase has
    _PHRASE added to the state it leads to."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folded = _folded()
        lower = {x: folded[_code_points(samples[x])] for x in self.languages}
        letters = np.unique(np.concatenate([*lower.values(), np.zeros(1, np.int32)]))[1:]
        self.n_symbols = len(letters) + 2  # the last one: letters that no language has shown
        self.symbol_of = np.where(folded == 0, 0, self.n_symbols - 1).astype(np.int32)
        known = np.flatnonzero(np.isin(folded, letters) & (folded > 0))
        self.symbol_of[known] = np.searchsorted(letters, folded[known]) + 1
        keys, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        self.roots, begin = [], 0
        # first steps of a phrase; a symbol unknown to the language is a phrase by itself and leads back to the root
        self.first = np.zeros((len(self.languages), self.n_symbols), np.int32)
        for k, x in enumerate(self.languages):
            nxt, _ = suffix_automaton(self.symbol_of[_code_points(samples[x])].tolist())
            self.roots.append(begin)
            self.first[k] = _PHRASE + begin
            for c, q in nxt[0].items():
                self.first[k, c] = _PHRASE + begin + q
            # the root has no arcs in the table: the first step from it begins a phrase
            arcs = [(state, c, q) for state, out in enumerate(nxt[1:], 1) for c, q in out.items()]
            if arcs:
                a = np.array(arcs, np.int64)
                keys.append((a[:, 0] + begin) * self.n_symbols + a[:, 1])
                to.append((a[:, 2] + begin).astype(np.int32))
            begin += len(nxt)
        self.bits = np.log2([len(samples[x]) + 1.0 for x in self.languages])
        self.arcs = Arcs(np.concatenate(keys), np.concatenate(to))
        self.roots = np.array(self.roots, np.int32)

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol_of[_code_points(text)]

    def _step(self, state: np.ndarray, symbol: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The next states; language is the number of each state's language times n_symbols."""
        to = self.arcs.find((state * np.int64(self.n_symbols) + symbol).ravel()).reshape(state.shape)
        return np.where(to >= 0, to, self.first.ravel()[language + symbol])

    def phrases(self, texts: list[str], block: int = 1024, room: int = 12_000_000) -> np.ndarray:
        """Phrases of each text against each language, one row for each text; `room` bounds the states held at once."""
        out, lanes = np.zeros((len(texts), len(self.languages)), np.int64), []
        for i, text in enumerate(texts):
            s = self.symbols(text)
            lanes += [(i, s[at : at + block]) for at in range(0, len(s), block)]
        most = max(1, room // (block * max(1, len(self.languages))))
        end = None
        for at in range(0, len(lanes), most):
            part = lanes[at : at + most]
            owner = np.array([i for i, _ in part])
            entry = end if at and lanes[at - 1][0] == owner[0] else self.roots
            count, end = self._parse([s for _, s in part], np.append(False, owner[1:] == owner[:-1]), entry)
            np.add.at(out, owner, count.T)
        return out

    def _parse(self, lanes: list[np.ndarray], follows: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (language, lane) and the states at the end of the last lane. Lane 0 is entered in the states `entry`;
        where follows[i], lane i goes on where lane i-1 ends; other lanes are entered at the roots."""
        n_lang, n = len(self.languages), len(lanes)
        lengths = np.array([len(s) for s in lanes])
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((lengths.max(), n), np.int32)
        for i, s in enumerate(lanes):
            grid[: len(s), i] = s
        states = np.zeros((len(grid), n_lang, n), np.int32)  # after each step, with its mark
        used = np.repeat(self.roots[:, None], n, 1)
        used[:, 0] = entry
        state, language = used[:, order].copy(), np.arange(n_lang)[:, None] * self.n_symbols
        in_order, falling = np.ascontiguousarray(grid[:, order]), -lengths[order]
        for t in range(len(grid)):
            live = int(np.searchsorted(falling, -t, side="left"))  # lanes longer than t
            to = self._step(state[:, :live], in_order[t, :live], language)
            states[t][:, order[:live]] = to
            state[:, :live] = to & (_PHRASE - 1)
        last = lambda: states[lengths - 1, :, np.arange(n)].T & (_PHRASE - 1)
        while True:
            due = used.copy()
            due[:, 1:] = np.where(follows[1:], last()[:, :-1], used[:, 1:])
            which, lane = np.nonzero(due != used)
            if not len(lane):
                break
            used, now, t = due, due[which, lane], 0
            while len(lane):
                to = self._step(now, grid[t, lane], which * self.n_symbols)
                before, states[t, which, lane] = states[t, which, lane], to
                t += 1
                on = ((to ^ before) & (_PHRASE - 1) != 0) & (lengths[lane] > t)
                which, lane, now = which[on], lane[on], to[on] & (_PHRASE - 1)
        return (states >= _PHRASE).sum(0), last()[:, -1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) for each text; score is the share by which the winner's bits are below the runner-up's."""
        use = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        found: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        for i, row in zip(use, self.phrases([texts[i] for i in use]) * self.bits if use else ()):
            best = int(np.argmin(row))
            second = float(np.min(np.delete(row, best))) if len(row) > 1 else 2 * float(row[best])
            found[i] = (self.languages[best], float(min(1.0, max(0.0, 1 - row[best] / second))))
        return found


def learn(docs: DataFrame, rows: int = 48, chars: int = 40_000, total: int = 1_000_000) -> Parser:
    """Parser from a bounded sample of the labelled rows of docs (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null").select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.length("text").alias("n")).where("n > 0")
    order = F.struct(F.xxhash64("doc_id").alias("o"), "doc_id", "h")
    shortest = known.groupBy("lang").agg(F.min(F.struct("n", order.alias("key"))).alias("s")).collect()
    share = min(chars, total // max(1, len(shortest)))
    w = Window.partitionBy("lang").orderBy(order)
    first = known.where(F.col("n") <= share).withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).collect()
    chosen = {(r["lang"], r["s"]["key"]["doc_id"], r["s"]["key"]["h"]): 0 for r in shortest if r["s"]["n"] > share}
    used: dict[str, tuple[int, set]] = {}
    for r in sorted(first, key=lambda r: r["r"]):
        size, seen = used.setdefault(r["lang"], (0, set()))
        if r["h"] not in seen and size + r["n"] <= share:
            chosen[r["lang"], r["doc_id"], r["h"]] = r["r"]
            used[r["lang"]] = (size + r["n"], seen | {r["h"]})
    picked = docs.sparkSession.createDataFrame([(*k, r) for k, r in chosen.items()], "p_lang string, p_doc long, p_h long, r int")
    # at most `rows` rows for each language
    on = (F.col("lang") == F.col("p_lang")) & F.col("doc_id").cast("long").eqNullSafe(F.col("p_doc")) & (F.xxhash64("text") == F.col("p_h"))
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), on).groupBy("p_lang", "r").agg(F.min("text").alias("text")).collect()
    by: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: r["r"]):
        by.setdefault(r["p_lang"], []).append(r["text"])
    return Parser({lang: "\n".join(t) for lang, t in by.items()})


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; the tables are broadcast, their size bounded by learn()'s sample."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(cols):
        found = shared.value.predict(cols[1])
        return [cols[0], [x for x, _ in found], [s for _, s in found]]

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, lang_pred string, score double", max_rows=2048, max_bytes=4 << 20)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    parser = learn(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, parser).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
