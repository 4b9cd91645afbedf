"""The window network against plain versions of its tree, score and gradient."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import lm_scoring as L


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    net = L.Network([int(n) for n in rng.integers(1, 500, 90)])
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    return net


def plain_log_probability(net, x, at, unit):
    h = np.tanh(net.bias + sum(s * net.near[x[at + shift]] for s, shift in zip(net.scale, L.NEAR)))
    return sum(-np.log1p(np.exp(-net.branch[d, unit] * (net.out[net.node[d, unit]] @ h + net.prior[net.node[d, unit]]))) for d in range(net.depth[unit]))


def test_probabilities_sum_to_one_and_equal_a_plain_walk(net):
    rng = np.random.default_rng(2)
    x = np.r_[[90, 90], rng.integers(0, 90, 40), [90, 90], rng.integers(0, 90, 1), [90, 90]].astype(np.int32)
    got = net.log_probability(x)
    for at in range(2, len(x) - 2):
        if x[at] == 90:
            assert got[at - 2] == 0
            continue
        assert got[at - 2] == pytest.approx(plain_log_probability(net, x, at, x[at]), abs=1e-3)
    assert sum(np.exp(plain_log_probability(net, x, 5, u)) for u in range(90)) == pytest.approx(1, abs=1e-4)


def test_gradient_against_finite_differences(net):
    rng = np.random.default_rng(3)
    x = np.r_[[90, 90], rng.integers(0, 90, 30), [90, 90]].astype(np.int32)
    place = np.array([0, 3, 4, 11, 29])
    loss = lambda: -np.mean([plain_log_probability(net, x, p + 2, x[p + 2]) for p in place])
    for name, (rows, g) in net.gradients(x, place).items():
        weights, dense = getattr(net, name), np.zeros_like(getattr(net, name), dtype=float)
        dense[rows] = g
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            if rng.random() < 0.7 and not isinstance(rows, slice):
                at = (int(rng.choice(rows)), *at[1:])
            was, step = weights[at], 1e-2
            weights[at] = was + step
            up = loss()
            weights[at] = was - step
            down = loss()
            weights[at] = was
            assert dense[at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_units_say_what_the_text_was():
    words, pieces = {"the": 0, "cat": 1}, {"sat": 2, "sat\n": 3, "ur\n": 4}
    name = {0: "the ", 1: "cat ", 2: "sat", 3: "sat ", 4: "ur "}
    for word in ("the", "cat", "satsatur", "sat", "xsatur", "日本語", "saturn", "🙂"):
        codes = L.unit_codes(words, pieces, 5, word)
        raw = b"".join(name[c].encode() if c < 5 else bytes([(c - 5) % 256]) + b" " * (c >= 261) for c in codes)
        assert raw.decode() == word + " "


def test_huffman_is_optimal_in_mean_depth():
    nodes, depth, _, branch = L.huffman([1, 1, 2, 4, 8])
    assert nodes == 4 and sorted(depth) == [1, 2, 3, 4, 4] and sum(2.0**-d for d in depth) == 1 and set(np.unique(branch)) <= {-1.0, 0.0, 1.0}


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    again = docs.unionByName(docs.limit(5))
    found = [sorted(tuple(r) for r in L.lm_scores(again.repartition(n)).collect()) for n in (2, 11)]
    assert len(found[0]) == again.count()
    assert found[0] == found[1]
    assert all(a[2] == pytest.approx(b[2], rel=1e-5) for a, b in zip(found[0], found[0][1:]) if a[0] == b[0])


def test_every_unit_is_counted_and_long_texts_are_whole(spark):
    rows = [(1, "abc def " * 60_000), (2, "zqxj" * 40_000), (3, None), (4, "!?"), (5, "abc")]
    got = {r["doc_id"]: r for r in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_tokens"] == 120_000 and got[3]["log_likelihood"] == 0 and got[3]["mean_log_likelihood"] is None
    assert all(np.isfinite(got[d]["log_likelihood"]) and got[d]["log_likelihood"] < 0 for d in (1, 2, 4, 5))


def test_parts_as_a_column(spark):
    words = ["a", "abc", "abcd", "abcdefg", "日本語テキスト", "🙂🙂🙂🙂"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    assert [r[0] for r in table.select(L._parts(F.col("word"))).collect()] == [L.parts_of(w) for w in words]


def test_equal_texts_are_scored_once_and_all_have_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "BATCH", 64)
    rows = [(i, ["the cat sat on the mat", "a dog ran over the hill and far away", "", None, "?!"][i % 5] if i % 3 else f"text {i} of its own") for i in range(300)]
    ids = {}
    batch = L.pa.RecordBatch.from_arrays([L.pa.array([7, 8, 9, 10]), L.pa.array([b"ab", b"ab", b"", b"cd"], L.pa.binary()), L.pa.array([0] * 4)], ["doc_id", "codes", "key"])
    assert [b.num_rows for b in L.distinct(iter([batch, batch.slice(3)]), ids)] == [3, 0] and ids == {0: [7, 8], 1: [9], 2: [10, 10]}
    got = {r["doc_id"]: r for r in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sorted(got) == list(range(300))
    for k in ("the cat sat on the mat", "a dog ran over the hill and far away", "?!"):
        assert len({got[i]["log_likelihood"] for i, t in rows if t == k}) == 1
