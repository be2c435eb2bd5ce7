"""The ten opN_ queries end to end on a written folder: contract columns against their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trajspark.llm import decontaminate, lm, pii, registry, simhash, spans

BASE = {"doc_id", "text", "lang", "source", "n_chars"}


def crc(d, n):
    return zlib.crc32(b"" if d is None else str(d).encode()) % n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(51)
    d = str(tmp_path_factory.mktemp("sf"))
    words = {"en": ["the", "sea", "and", "ship", "of", "sand"], "de": ["der", "und", "schiff", "meer", "ist", "auf"]}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + (". " if rng.random() < 0.1 else "") for _ in range(n))
    docs = [(i, line(k := rng.choice(["en", "de"]), rng.choice([3, 40, 120])), k, rng.choice(["a", "b", "c", None])) for i in range(90)]
    docs += [(200 + i, docs[5][1], docs[5][2], "a") for i in range(4)]
    docs += [(300, "mail ann@host.example.com or 10.0.0.1 or 4111 1111 1111 1111 or +49 30 1234567", "en", "a"), (301, None, None, None), (302, "", "en", "b"), (303, "!!! 123", None, "b")]
    items = [(1, docs[7][1]), (2, "sea and"), (3, None)]
    vectors = np.random.default_rng(5).standard_normal((400, 8))
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(docs[i][2] == "en"), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, f"https://www.example.net/{rng.choice(['en', 'de'])}/{i}", "<html>") for i in range(90)] + [(90, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d, docs, items, vectors.astype(np.float32).astype(float)


def run(spark, folder, name, columns):
    out = registry.queries()[name](spark, folder[0])
    assert out.columns[: len(columns.split())] == columns.split()
    return out.collect()


def test_op1_and_op2(spark, folder):
    _, docs, *_ = folder
    got = {r.doc_id: (r.text, r.n_removed) for r in run(spark, folder, "op1_spans", "doc_id text")}
    assert got == {d: (t, n) for d, t, n in spans.brute_force([r[:2] for r in docs])}
    rows = {r.doc_id: r for r in run(spark, folder, "op2_pii", "doc_id n_email n_ip n_card n_phone base_sha256 spans")}
    for d, t, *_ in docs:
        want = pii.base_spans(t or "")
        assert rows[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert Counter({k: rows[d][f"n_{k}"] for k in pii.KINDS}) == Counter(k for k, _, _ in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(rows[d].spans.split(","))
    assert (rows[300].n_email, rows[300].n_ip, rows[300].n_card, rows[300].n_phone) == (1, 1, 1, 1)


def test_op3_and_op4(spark, folder):
    _, docs, items, _ = folder
    got = run(spark, folder, "op3_decontaminate", "doc_id n_words n_hit n_items items_sha256 contaminated")
    assert sorted(map(tuple, got)) == sorted(decontaminate.brute_force([r[:2] for r in docs], items))
    got = run(spark, folder, "op4_simhash", "doc_id fingerprint component_id")
    assert sorted(map(tuple, got)) == sorted(simhash.brute_force([r[:2] for r in docs]))


def test_op5_op6_and_op7(spark, folder):
    _, docs, *_ = folder
    lang = {r.doc_id: r for r in run(spark, folder, "op5_language", "doc_id held_out lang_pred score")}
    assert all(lang[d].held_out == (crc(d, 4) == 2) and 0 <= lang[d].score <= 1 for d, *_ in docs)
    assert all(lang[d].lang_pred == k for d, _, k, _ in docs[:90]) and {lang[d].lang_pred for d in (301, 302, 303)} == {"und"}
    train = [crc(r[0], 5) != 1 for r in docs]
    want = {d: x for d, *x in lm.brute_force([r[:2] for r in docs], train)}
    total = sum(len(lm.tokens((t or "").encode())) for (_, t, *_), use in zip(docs, train) if use)
    for r in run(spark, folder, "op6_lm_score", "doc_id held_out n_tokens n_known train_tokens base_score score"):
        assert (r.held_out, r.train_tokens) == (crc(r.doc_id, 5) == 1, total)
        assert [r.n_tokens, r.n_known, r.base_score, r.score] == pytest.approx(want[r.doc_id], abs=1e-6)
    scores = {r.doc_id: r for r in run(spark, folder, "op7_quality", "doc_id held_out score predicted")}
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in scores.values())
    assert len(scores) == len(docs) and all((scores[d].score > 0.5) == (k == "en") for d, _, k, _ in docs[:90])


def test_op8(spark, folder):
    _, docs, *_ = folder
    rows = run(spark, folder, "op8_mixing", "doc_id size source_size target taken")
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in docs}
    total = Counter()
    for d, _, _, s in docs:
        total[s] += size[d]
    source = {d: s for d, _, _, s in docs}
    weight = dict(zip(["a", "b", "c", None], (5, 2, 1, 5)))
    left, target = 1.5 * sum(total.values()), {}
    while len(target) < 4:
        open_ = [s for s in weight if s not in target]
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * total[s]]
        if not over:
            target |= part
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
    for r in rows:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
    for s in weight:
        assert abs(sum(r.taken for r in rows if source[r.doc_id] == s) - target[s]) <= 2 * max(size.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, folder, "op8_mixing", "doc_id")))


def test_op9_and_op10(spark, folder):
    *_, vectors = folder
    found = {}
    for r in run(spark, folder, "op9_neighbours", "query_id rank vec_id score"):
        assert r.score == pytest.approx(math.dist(vectors[r.query_id], vectors[r.vec_id]), abs=1e-12)
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(found) == {0, 100, 200, 300} and all(sorted(f) == list(range(1, 11)) for f in found.values())
    exact = {q: set(sorted(range(400), key=lambda i: (i == q, math.dist(vectors[q], vectors[i])))[:10]) for q in found}
    assert np.mean([len(exact[q] & set(found[q].values())) / 10 for q in found]) >= 0.9
    rows = run(spark, folder, "op10_urls", "page_id host path rule verdict")
    assert all((r.rule, r.verdict) == (("example.net/en/", "allow") if r.path.startswith("/en/") else ("net/", "block")) for r in rows if r.page_id < 90)
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id == 90] == [("", "", None, "allow")]
