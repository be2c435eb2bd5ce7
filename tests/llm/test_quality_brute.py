"""The quality classifier against plain loops: n-grams by definition, FTRL one coordinate at a time, and the query's scores."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from trajspark.llm import quality

M = (1 << 64) - 1
POWER = []
p = 1
for _ in range(4096):
    p = p * 0x9E3779B97F4A7C15 & M
    POWER.append(p)


def run_hash(data):
    return sum((b + 1) * POWER[i & 4095] for i, b in enumerate(data)) & M


def mix(h, seed):
    h = (h ^ seed) * 0xFF51AFD7ED558CCD & M
    return h ^ h >> 32


def kind(b):
    return 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b


def shape(word):
    kinds = [kind(b) for b in word]
    return bytes(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def places(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text or b"")
    w = [run_hash(x) for x in words]
    s = [61 if i and words[i] == words[i - 1] else run_hash(shape(words[i])) for i in range(len(words))]
    pair = lambda h, i: (mix(h[i], 7) * 3 + h[i + 1]) & M
    out = [mix(h, 1) for h in w] + [mix(h, 3) for h in s]
    for i in range(len(words) - 1):
        out += [mix(pair(w, i), 2), mix(pair(s, i), 4)]
    for i in range(len(words) - 2):
        out.append(mix((mix(pair(s, i), 9) * 5 + s[i + 2]) & M, 5))
    return sorted(h >> (64 - quality.BITS) for h in out)


def shares(text):
    found = places(text)
    return {k: float(np.float32(quality.SCALE * found.count(k) / max(1, len(found)))) for k in set(found)}


def ftrl(rows, alpha=0.3, beta=1.0, l1=0.02, l2=0.05, epochs=4):
    bias, z, n = 1 << quality.BITS, {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = {**rows[k][0], bias: 1.0}, rows[k][1]
            w = {i: weight(i) for i in x}
            m = max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (1 / (1 + math.exp(-m)) - y) * v
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z}


def margin(text, weights):
    found = places(text)
    return weights.get(1 << quality.BITS, 0.0) + quality.SCALE * sum(weights.get(i, 0.0) for i in found) / max(1, len(found))


TEXTS = [b"the sea the sea", b"", None, b"A1b22 c", b"  x\t\ny  y y", "Über 12:30 \U0001f600".encode(), b"w" * 5000 + b" Z", b"one"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_ngrams_by_definition(text):
    assert sorted(quality.ngrams([text])[0].astype(int).tolist()) == places(text)


def test_query_scores_equal_the_loop(spark, tmp_path):
    rng = random.Random(7)
    good, bad = ["sea", "Ship", "sand", "of"], ["buy", "NOW", "99", "sea", "!!"]
    docs, labels = [], []
    for d in range(120):
        y = rng.random() < 0.5
        docs.append((d, " ".join(rng.choice(good if y != (rng.random() < 0.1) else bad) for _ in range(rng.choice([1, 5, 40]))), "en", "a"))
        if d % 4:
            labels.append((d, int(y), 0))
    docs += [(200, None, "en", "a"), (201, "", "en", "a")]
    labels += [(3, 0, 0), (3, 1, 0), (999, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = {d: (None if t is None else t.encode()) for d, t, *_ in docs}
    y = {}
    for d, q, _ in labels:
        if d in text and zlib.crc32(str(d).encode()) % 5:
            y[d] = min(q, y.get(d, 1))
    weights = ftrl([(shares(text[d]), y[d]) for d in sorted(y)])
    got = {r.doc_id: r for r in quality.op7_quality(spark, str(tmp_path)).collect()}
    assert set(got) == set(text)
    for d, t in text.items():
        want = 1 / (1 + math.exp(-margin(t, weights)))
        assert got[d].score == pytest.approx(want, abs=1e-6) and got[d].predicted == int(got[d].score >= 0.3)
