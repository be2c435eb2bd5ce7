"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and white space, after 。！？, and at line ends); a sentence of more than 16 words
is cut further after the words of least hash in every window of 8 (winnowing), so that equal passages are cut alike wherever
they stand and no piece is longer than 8 words. Characters of scripts without spaces count as words. From every sentence a
span runs on until it has at least 3 sentences and 20 words. Spans are hashed (lower case, single spaces)
and joined globally by hash: the occurrence with the smallest (doc_id, place) is the first; sentences covered by any
other occurrence are removed.

Cases: null and empty texts have no spans and stay as they are; a text too short for one span stays; equal rows (same
doc_id and text) count as one document and are cut alike; a null doc_id sorts first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stash, table

#: Only where a match ends counts. It begins with a set of characters, for which the regex engine searches fast.
_BREAK = re.compile(r"[.!?\n。！？](?:(?<=[.!?])\s+|(?<=\n)\n*|(?<=[。！？])[。！？]*\s*)")
#: Scripts without spaces: Thai, kana, Han, Hangul syllables.
_WIDE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
_WORD = re.compile(rf"[{_WIDE}]\s*|[^\s{_WIDE}]+\s*")
_PLAIN = re.compile(r"\S+\s*")
_ANY_WIDE = re.compile(f"[{_WIDE}]")


def sentences(text: str, long: int = 16) -> list[str]:
    """Pieces that put together are the text."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out += _pieces(text[at : m.end()], long)
        at = m.end()
    if at < len(text):
        out += _pieces(text[at:], long)
    return out


def count_words(s: str) -> int:
    return len(_WORD.findall(s)) if not s.isascii() and _ANY_WIDE.search(s) else len(s.split())


def _word_hash(word: str) -> int:
    return crc32(word.strip().lower().encode("utf-8", "surrogatepass"))


#: Most short words recur, above all single characters; only those are kept, so that the table stays small.
_short_hash = lru_cache(1 << 15)(_word_hash)


def _pieces(sentence: str, long: int, window: int = 8) -> list[str]:
    if len(sentence) <= long:
        return [sentence]
    if sentence.isascii() or not _ANY_WIDE.search(sentence):
        low = sentence.lower().split()
        if len(low) <= long:
            return [sentence]
        words, h = _PLAIN.findall(sentence), [crc32(w.encode("utf-8", "surrogatepass")) for w in low]
    else:
        words = _WORD.findall(sentence)
        if len(words) <= long:
            return [sentence]
        h = [_short_hash(w) if len(w) < 16 else _word_hash(w) for w in words]
    # the white space before the first word stands in no word
    words[0] = sentence[: len(sentence) - sum(map(len, words))] + words[0]
    out, at = [], 0
    for end in _cuts(h, window):
        out.append("".join(words[at:end]))
        at = end
    return out + ["".join(words[at:])] if at < len(words) else out


def _cuts(h: list[int], window: int) -> list[int]:
    """The places after the last least hash of every window."""
    out, k = [], window - 1
    while k < len(h):
        seen = h[k - window + 1 : k + 1]
        low = min(seen)
        last = k - seen[::-1].index(low)
        out.append(last + 1)
        # up to the word with which that hash is out of the window, only a smaller one counts
        while (more := h[k + 1 : last + window]) and min(more) < low:
            k += 1 + next(i for i, x in enumerate(more) if x < low)
            low, last = h[k], k
            out.append(last + 1)
        k = last + window
    return out


def spans(text: str, size: int = 3, least: int = 20) -> list[tuple[int, int, int]]:
    """(hash, first sentence, end sentence) of the span that starts at each sentence, if the text is long enough for it."""
    return _spans(text, sentences(text), size, least)


def _spans(text: str, parts: list[str], size: int = 3, least: int = 20) -> list[tuple[int, int, int]]:
    from xxhash import xxh64_intdigest

    wide = not text.isascii() and _ANY_WIDE.search(text)
    split = [s.lower().encode("utf-8", "surrogatepass").split() for s in parts]
    words = list(map(count_words, parts)) if wide else list(map(len, split))
    joined, out, end, total, n = list(map(b" ".join, split)), [], 0, 0, len(parts)
    for i in range(n):
        while end < n and (total < least or end - i < size):
            total += words[end]
            end += 1
        if end - i < size or total < least:
            break
        h = xxh64_intdigest(b"\n".join(joined[i:end]), 1)
        out.append((h - (1 << 64) if h >> 63 else h, i, end))
        total -= words[i]
    return out


def span_table(docs: DataFrame) -> DataFrame:
    """h, doc_id, body, i, j: every span of every row of docs (doc_id, text), and a row without h for each row of docs, whose j is
    the number of its sentences."""

    def run(cols):
        out = [[] for _ in range(5)]
        for doc, body, text in zip(*cols):
            parts = sentences(text or "")
            h, i, j = zip((None, None, len(parts)), *_spans(text or "", parts))
            for c, v in zip(out, (h, [doc] * len(h), [body] * len(h), i, j)):
                c += v
        return out

    return map_batches(docs.select("doc_id", "body", "text"), run, "h long, doc_id long, body int, i int, j int")


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text (without repeated spans), n_sentences, n_removed, n_chars_removed for every row of docs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.hash("text", F.xxhash64("text")).alias("body"))
    every = stash(span_table(source))
    found = every.where("h is not null")
    # counts first: only the hash is shuffled, and a hash that stands once goes no further. Each small side is written and
    # read again, so that Spark can split the tasks of a passage that very many documents share.
    often = stash(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    shared = stash(found.hint("merge").join(often.hint("merge"), "h", "left_semi"))
    where = F.struct("doc_id", "body", "i")
    first = stash(shared.groupBy("h").agg(F.min(where).alias("first")))
    later = shared.hint("merge").join(first.hint("merge"), "h").where(~where.eqNullSafe(F.col("first")))
    counts = every.where("h is null").select("doc_id", "body", "i", "j")
    either = later.select("doc_id", "body", "i", "j").unionByName(counts).groupBy("doc_id", "body")
    cut = either.agg(F.collect_set(F.when(F.col("i").isNotNull(), F.struct("i", "j"))).alias("cut"), F.max(F.when(F.col("i").isNull(), F.col("j"))).alias("n")).withColumnsRenamed({"doc_id": "cut_doc", "body": "cut_body"})
    joined = source.hint("merge").join(cut.hint("merge"), source["doc_id"].eqNullSafe(cut["cut_doc"]) & (source["body"] == cut["cut_body"]), "left")

    def run(cols):
        out = [[] for _ in range(5)]
        for doc, text, ranges, n in zip(*cols):
            # a text is split again only where something is cut out of it
            kept, gone = text, 0
            if ranges:
                parts = sentences(text or "")
                keep = [True] * n
                for r in ranges:
                    keep[r["i"] : r["j"]] = [False] * (r["j"] - r["i"])
                kept, gone = "".join(p for p, k in zip(parts, keep) if k), keep.count(False)
            for c, v in zip(out, (doc, kept, n, gone, len(text or "") - len(kept or ""))):
                c.append(v)
        return out

    return map_batches(joined.select("doc_id", "text", "cut", "n"), run, "doc_id long, text string, n_sentences long, n_removed long, n_chars_removed long")


def op1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentence spans that an earlier one has."""
    return dedup_spans(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], size: int = 3, least: int = 20) -> list[tuple]:
    """For tests: (doc_id, text, n_removed) with every span kept as words in a dictionary; rows have different doc_ids."""
    first, later = {}, []
    for doc, text in sorted(rows):
        parts = sentences(text or "")
        for i in range(len(parts)):
            ends = [j for j in range(i + size, len(parts) + 1) if sum(map(count_words, parts[i:j])) >= least]
            if ends:
                key = tuple(tuple(p.lower().split()) for p in parts[i : ends[0]])
                if first.setdefault(key, (doc, i)) != (doc, i):
                    later.append((doc, i, ends[0]))
    out = []
    for doc, text in rows:
        parts = sentences(text or "")
        gone = {k for d, i, j in later if d == doc for k in range(i, j)}
        out.append((doc, text if not gone else "".join(p for k, p in enumerate(parts) if k not in gone), len(gone)))
    return out
