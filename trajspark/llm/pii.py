"""Personal data: base patterns, plus a linear-chain conditional random field over word shapes.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns that pass a value check.
The field adds what the patterns miss (phones without "+", addresses without a dot): its tokens are runs of letters or
of digits and single other characters, its features the shapes of a token and of two neighbours on either side (case
and length class of letters, length of digits, the character itself, white space before it), its labels begin/inside of
each kind. It is trained on a small labelled table by gradient ascent on the log-likelihood and decoded by Viterbi over
many sequences at once in numpy. A sequence is a stretch of a line around digits and "@" whose gaps are under 12 tokens;
elsewhere no span could pass the value checks, which hold for added spans too. Added spans that overlap others go.

Cases: null texts count as empty and have no spans; spans count code points, end exclusive; masking keeps null texts
null; repeated rows give one result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ["email", "ip", "card", "phone"]
_MARK = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never ends inside a run of digits, so none starts there: the look-behind saves the tries
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _fits(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from each "@" outwards so that long runs stay linear."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1) if start == at else end
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind in order."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- the field ---------------------------------------------------------------------------------------------------

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_N_SHAPES, _REACH = 2 * 168, (-2, -1, 0, 1, 2)


def shape(token: str, spaced: bool) -> int:
    """Number of a token's shape: letters by case and length class, digits by length, other characters as they are."""
    c = token[0]
    if c.isalpha():
        case = 0 if token.islower() else 2 if token.isupper() and len(token) > 1 else 1 if c.isupper() and token[1:].islower() or len(token) == 1 else 3
        s = case * 4 + (0 if len(token) == 1 else 1 if len(token) == 2 else 2 if len(token) <= 4 else 3)
    elif "0" <= c <= "9":
        s = 16 + min(len(token), 20)
    else:
        s = 38 + (ord(c) if ord(c) < 128 else 128)
    return s * 2 + spaced


def tokenise(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, shape) of the tokens of a stretch of text."""
    return [(m.start(), m.end(), shape(m[0], m.start() == start or text[m.start() - 1].isspace())) for m in _TOKEN.finditer(text, start, end)]


def features(shapes: np.ndarray) -> np.ndarray:
    """Rows of weight-table places for each token: the shapes at the reach around it; place 0 of each part is "none"."""
    padded = np.concatenate(([-1, -1], shapes, [-1, -1])) + 1
    n = len(shapes)
    return np.stack([padded[2 + r : 2 + r + n] + k * (_N_SHAPES + 1) for k, r in enumerate(_REACH)], axis=1)


class Field:
    """Weights of the states (place x label) and of the transitions (label x label)."""

    def __init__(self, state: np.ndarray, move: np.ndarray):
        self.state, self.move = state, move

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequence of each sequence of shapes, by Viterbi over all of them step by step."""
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        if not order:
            return out
        scores = [self.state[features(sequences[k])].sum(1) for k in order]
        lengths = np.array([len(s) for s in scores])
        n, labels = len(order), self.move.shape[0]
        delta, back = np.zeros((n, labels)), []
        for k, s in enumerate(scores):
            delta[k] = s[0]
        for t in range(1, int(lengths[0])):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            reach = delta[:live, :, None] + self.move
            came = reach.argmax(1)
            back.append(came.astype(np.int8))
            delta[:live] = np.take_along_axis(reach, came[:, None], 1)[:, 0] + np.stack([s[t] for s in scores[:live]])
        for lane, k in enumerate(order):
            path = [int(delta[lane].argmax())]
            for t in range(int(lengths[lane]) - 2, -1, -1):
                path.append(int(back[t][lane, path[-1]]))
            out[k] = np.array(path[::-1])
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, rate: float = 0.15, ridge: float = 0.01) -> Field:
    """Maximum-likelihood weights (ridge penalty, Adam steps) from texts with labelled spans; forward-backward over all
    texts at once, padded to the longest."""
    shapes, golds = [], []
    for text, spans in rows:
        toks = tokenise(text, 0, len(text))
        gold = [0] * len(toks)
        for kind, a, b in spans:
            inside = [i for i, (s, e, _) in enumerate(toks) if s >= a and e <= b]
            for i in inside:
                gold[i] = 2 + 2 * KINDS.index(kind)
            if inside:
                gold[inside[0]] -= 1
        shapes.append(np.array([s for _, _, s in toks]))
        golds.append(np.array(gold))
    n, longest, labels = len(rows), max(map(len, shapes)), len(LABELS)
    place, gold, mask = np.zeros((n, longest, len(_REACH)), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for k, (s, g) in enumerate(zip(shapes, golds)):
        place[k, : len(s)], gold[k, : len(s)], mask[k, : len(s)] = features(s), g, 1
    allowed = np.zeros((labels, labels))
    for j in range(2, labels, 2):  # inside follows begin or inside of its kind only
        allowed[:, j] = -1e4
        allowed[[j - 1, j], j] = 0
    state, move = np.zeros((len(_REACH) * (_N_SHAPES + 1), labels)), np.zeros((labels, labels))
    moments = [np.zeros_like(state), np.zeros_like(state), np.zeros_like(move), np.zeros_like(move)]
    rows_at = np.arange(n)
    for step in range(1, rounds + 1):
        e = state[place].sum(2)
        t_move = move + allowed
        alpha, beta = np.zeros((n, longest, labels)), np.zeros((n, longest, labels))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            a = _log_sum(alpha[:, t - 1, :, None] + t_move, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, a, alpha[:, t - 1])
        z = _log_sum(alpha[:, -1], 1)
        expect = np.zeros_like(move)
        for t in range(longest - 2, -1, -1):
            both = t_move + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            on = mask[:, t + 1, None] > 0
            beta[:, t] = np.where(on, _log_sum(both, 2), 0)
            expect += (np.exp(alpha[:, t, :, None] + both - z[:, None, None]) * mask[:, t + 1, None, None]).sum(0)
        share = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        g_state = np.zeros_like(state)
        delta = -share
        delta[rows_at[:, None], np.arange(longest), gold] += mask
        np.add.at(g_state, place, delta[:, :, None, :])
        g_move = -expect
        np.add.at(g_move, (gold[:, :-1], gold[:, 1:]), mask[:, 1:])
        for w, g, m, v in ((state, g_state / n - ridge / n * state, moments[0], moments[1]), (move, g_move / n - ridge / n * move, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(state, move + allowed)


def labelled_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: sentences around values of each kind and around numbers that are none."""
    # fixed values: the sentences and the labelled values
    frames = ["call {} now", "Reach us at {}.", "the number is {}, thanks", "({})", "from {} and then on", "Kontakt: {} bitte", "{}", "es {} de la", "seen {}; nothing else", "A. {} was there"]
    values = {
        "phone": ["555-123-4567", "(712) 555-9396", "212-555-0147", "712.555.9396", "+1 (477) 555-4197", "+49 30 1234567", "+33 1 23 45 67 89", "(030) 555-12345", "+1-202-555-0199", "415 555 2671"],
        "email": ["ann.lee@mail9.example.com", "bob@example.org", "if.22@mail.example.net", "x_y@host", "root@localhost", "j.doe+tag@a.example.com", "info@example.com", "K99@example.co", "mary-ann@mx1"],
        "ip": ["41.74.196.26", "10.0.0.1", "192.168.1.254", "64.64.98.125", "8.8.8.8"],
        "card": ["4436387346764662", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"],
        "": ["1999", "12.5", "3.14 and 2.71", "page 12 of 400", "2024-01-31", "10:45", "v1.2.3", "$1,200.50", "A4", "12345", "50%", "1 2 3", "no. 17", "8-10", "1914-1918", "@home", "123456789012345678901234", "chapter 3.2", "x = 10", "ISO 9001", "24/7", "100 000", "0.001", "2001:db8", "hello there", "The End"],
    }
    rows = []
    for kind, texts in values.items():
        for i, value in enumerate(texts):
            for j, frame in enumerate(frames):
                if (i + j) % 2 == 0 or j == 6:
                    at = frame.index("{}")
                    rows.append((frame.format(value), [(kind, at, at + len(value))] if kind else []))
    return rows


def _stretches(text: str, gap: int = 12, around: int = 6) -> list[list[tuple[int, int, int]]]:
    """Token sequences around the marks of each line."""
    out, at = [], 0
    while (m := _MARK.search(text, at)) is not None:
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        end = len(text) if end < 0 else end
        toks = tokenise(text, start, end)
        marks = [i for i, (s, _, _) in enumerate(toks) if text[s] == "@" or "0" <= text[s] <= "9"]
        first = None
        for i, k in enumerate(marks):
            first = k if first is None else first
            if i + 1 == len(marks) or marks[i + 1] - k > gap:
                out.append(toks[max(0, first - around) : k + around + 1])
                first = None
        at = end
    return out


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base, sequences, owner = [], [], []
    for i, text in enumerate(texts):
        base.append(base_spans(text) if text and _MARK.search(text) else [])
        if text:
            for s in _stretches(text):
                sequences.append(s)
                owner.append(i)
    added: list[list] = [[] for _ in texts]
    paths = field.decode([np.array([x[2] for x in s]) for s in sequences])
    for i, s, path in zip(owner, sequences, paths):
        k = 0
        while k < len(path):
            if path[k] % 2 == 1:
                end = k + 1
                while end < len(path) and path[end] == path[k] + 1:
                    end += 1
                kind, a, b = KINDS[(path[k] - 1) // 2], s[k][0], s[end - 1][1]
                if _added_fits(kind, texts[i][a:b]):
                    added[i].append((kind, a, b))
                k = end
            else:
                k += 1
    out = []
    for b, more in zip(base, added):
        starts, ends, extra = [x for _, x, _ in b], list(accumulate((y for _, _, y in b), max)), []
        for kind, x, y in sorted(more, key=lambda s: (s[1], s[2])):
            before = bisect_left(starts, y)  # base spans that begin before this one ends
            if not before or ends[before - 1] <= x:
                extra.append((kind, x, y))
        out.append((b, sorted(b + extra, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def _added_fits(kind: str, s: str) -> bool:
    if kind == "email":
        return "@" in s[1:-1]
    if kind == "ip":
        return s.count(".") == 3 and all(p.isdigit() and p.isascii() for p in s.split(".")) and _fits("ip", s)
    return _fits(kind, s)


def _text(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(cols):
        found = all_spans(cols[1], shared.value)
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return [cols[0], [rows(b) for b, _ in found], [rows(s) for _, s in found]]

    span = "array<struct<kind:string,start:long,end:long>>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, f"doc_id long, base {span}, spans {span}")


def mask_column(spark: SparkSession, field: Field, text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    shared = spark.sparkContext.broadcast(field)

    def masked(texts):
        rows = texts.to_pylist()
        out = []
        for text, (_, spans) in zip(rows, all_spans(rows, shared.value)):
            if not spans:
                out.append(text)
                continue
            parts, end = [], 0
            for kind, a, b in spans:
                if a >= end:
                    parts += [text[end:a], f"[{kind.upper()}]"]
                end = max(end, b)
            out.append("".join([*parts, text[end:]]))
        return pa.array(out, pa.string())

    return F.arrow_udf(masked, "string")(text)


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked; all columns stay, n_chars (if there) follows the new text."""
    out = docs.withColumn("text", mask_column(docs.sparkSession, train(labelled_table()), F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def digest(spans: list) -> str:
    return hashlib.sha256(_text(spans).encode()).hexdigest()


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents"), train(labelled_table()))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
