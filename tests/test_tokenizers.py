"""The tokeniser slot against merging by definition, and the queries that use it."""

import re

import pytest
import regex

from trajspark import registry
from trajspark.functions import tokenizers as K

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TEXTS = ["hello world", "It's 12345 déjà-vu  \n\n  end ", "", None, "ü" * 70, "<|endoftext|> is text", "日本語 and \U0001f600", "a" * 300]


def by_definition(text, ranks):
    return [t for piece in regex.findall(K.PIECES, text) for t in K.merged(piece.encode(), ranks)]


def test_ids_equal_merging_by_definition_and_go_back(spark):
    ranks = K.read_ranks(PATH)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "i int, text string, ids2 string")
    got = {r.i: r.ids for r in K.with_subwords(df, {"text": "ids"}, PATH).collect()}
    back = {rank: token for token, rank in ranks.items()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (None if t is None else by_definition(t, ranks))
        assert t is None or b"".join(back[x] for x in got[i]).decode() == t


def test_words_have_the_same_interface(spark):
    df = spark.createDataFrame([(" a  b ",), ("",), (None,)], "text string")
    assert [r.ids for r in K.with_words(df, {"text": "ids"}).collect()] == [["a", "b"], [], None]


def test_queries(spark):
    sf, ranks, q = "/root/testdata/sf0.001", K.read_ranks(PATH), registry.queries()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = {d: t for d, t in texts.items() if len(t) < 3000}
    lengths = {r.doc_id: (r.tokens, r.kept) for r in q["subword_lengths"](spark, sf).collect()}
    assert set(lengths) == set(texts) and all(lengths[d][0] == len(by_definition(t, ranks)) for d, t in short.items())
    assert all(kept == (n <= 12_000) for n, kept in lengths.values())
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, by_definition(r.text, ranks)))
    for r in q["subword_loss_mask"](spark, sf).collect():
        assert r.ids == [x for _, ids in turns[r.conv_id] for x in ids]
        assert r["mask"] == [int(role == "assistant") for role, ids in turns[r.conv_id] for _ in ids]
    encode = K.encoder(PATH).decode
    for r in q["subword_pairs"](spark, sf).collect():
        assert re.match("(en|de|fr|es) ", encode(r.chosen)) and encode(r.chosen).split(" ")[0] == encode(r.rejected).split(" ")[0]


def test_missing_vocabulary(spark):
    with pytest.raises(Exception):
        K.with_subwords(spark.createDataFrame([("a",)], "text string"), {"text": "ids"}, "/none/x.tiktoken").collect()


def test_slices_bound_the_text_of_a_batch():
    import pyarrow as pa

    from trajspark.functions.tokenizers import _slices

    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "a": ["x" * 40, None, "x" * 500, "", "é" * 30, "y"], "b": ["z" * 70, "z", None, "", "z" * 30, "w"]})
    parts = list(_slices(batch, ["a", "b"], 100))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1], [2], [3, 4, 5]]
    assert list(_slices(batch.slice(0, 0), ["a"], 100)) == []
