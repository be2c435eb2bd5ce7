"""The trie against its definition, with splitters in every place."""

import random

import pytest

from trajspark.llm import trie


def conversations():
    rng = random.Random(9)
    text = lambda: rng.choice(["hi", "é", "", None, "yes", "a longer text"])
    rows = []
    for c in range(60):
        rows += [(c, t, rng.choice(["user", "assistant", None]), text()) for t in range(rng.choice([0, 1, 2, 3, 7, 12]))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(10)]  # a hot group
    rows += [(200, t, "user", str(t % 3)) for t in range(300)] + [(300, None, "user", "no turn"), (300, 5, "user", "x"), (None, 1, "user", "lost"), (-7, 0, "user", "a"), (301, 0, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "conv_id long, turn long, role string, text string, key string, low int, path string")


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("how", [{"shards": 1}, {"shards": 4}, {"shards": 40, "range_rows": 7}, {"shards": 40, "skeleton_bytes": 40 * 40 * 8 * 2}], ids=str)
def test_equals_brute_force(spark, how):
    rows = conversations()
    got = trie.prefix_trie(trie.rebuilt(trie.keys(frame(spark, rows))), **how).drop("turn_hash")
    assert ordered(got.collect()) == ordered(trie.brute_force(rows))


def test_texts_and_empty(spark):
    rows = [(0, 0, "user", "a"), (0, 1, None, None), (1, 0, "user", "a"), (1, 0, "user", "a")]
    nodes = trie.prefix_trie(trie.keys(frame(spark, rows)))
    got = {(r.conv_id, r.depth): (r.role, r.text, r.n_convs) for r in trie.with_texts(nodes, frame(spark, rows)).collect()}
    assert got == {(0, 0): (None, None, 2), (0, 1): ("user", "a", 2), (0, 2): ("", "", 1), (1, 2): ("user", "a", 1)}
    assert trie.prefix_trie(trie.rebuilt(trie.keys(frame(spark, [])))).count() == 0


def test_turns_that_read_alike_differ(spark):
    rows = [(0, 0, "ab", "c"), (1, 0, "a", "bc"), (2, 0, "", "abc")]
    assert trie.prefix_trie(trie.keys(frame(spark, rows))).where("depth = 1").count() == 3
