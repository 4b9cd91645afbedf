"""Co-occurrence, PPMI and walks against plain versions on a small graph; clean controls on a corpus."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import toxicity as T

CLEAN = [
    "More trains travel this morning.",
    "The doctor closed the door and took the path to the station where a train was waiting for all of us.",
    "We had a short discussion about the garden and the weather in spring, then we went home.",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["zzz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(40)] + [(40, ""), (41, "wa")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


NODES, SEEDS, WINDOW = [f"w{chr(97 + i)}" for i in range(12)], 4, 3


def plain_graph(rows):
    pair, uni, slots, words = Counter(), Counter(), Counter(), 0
    for _, t in rows:
        w = T.words_of(t)
        words += len(w)
        uni.update(w)
        for i, a in enumerate(w):
            for j in range(max(0, i - WINDOW), min(len(w), i + WINDOW + 1)):
                if j != i and a in NODES[:SEEDS]:
                    slots[a] += 1
                    if w[j] != a:
                        pair[a, w[j]] += 1
    weight = defaultdict(float)
    for (a, x), n in pair.items():
        if x in NODES:
            weight[a, x] = max(0, math.log(n * words / (slots[a] * uni[x]))) * n / (n + T.DAMP)
    return weight


def test_edges_are_the_plain_ppmi(texts):
    rows, frame = texts
    weight = plain_graph(rows)
    got = {r["word"]: dict(zip(r["seeds"], r["ppmi"])) for r in T.edges(frame, NODES[:SEEDS], NODES, WINDOW).collect()}
    for x in NODES:
        want = {i: weight[a, x] for i, a in enumerate(NODES[:SEEDS]) if weight[a, x] > 0}
        assert got[x] == pytest.approx(want, abs=1e-5)


def test_walk_is_the_plain_power_iteration(texts):
    rows, frame = texts
    weight = plain_graph(rows)
    w = np.zeros((len(NODES), len(NODES)))
    for i, a in enumerate(NODES[:SEEDS]):
        for j, x in enumerate(NODES):
            w[i, j] = weight[a, x]
            if j >= SEEDS:
                w[j, i] = weight[a, x]
    out = w.sum(axis=1, keepdims=True)
    move = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    ends = []
    for start in ([3, 1, 0, 0], [0, 0, 1, 1]):
        s = np.zeros(len(NODES))
        s[:SEEDS] = np.array(start) / sum(start)
        p = s
        for _ in range(300):
            p = T.RESTART * s + (1 - T.RESTART) * p @ move
        ends.append(p)
    little = np.mean([(1 - T.RESTART) * (e[:SEEDS, None] * move[:SEEDS]).sum() for e in ends]) / len(NODES)
    want = (ends[0] - ends[1]) / (ends[0] + ends[1] + little)
    vectors = T.edges(frame, NODES[:SEEDS], NODES, WINDOW)
    got = {r["word"]: r["polarity"] for r in T.walk_polarity(vectors, np.array([3.0, 1, 0, 0]), np.array([0.0, 0, 1, 1])).collect()}
    assert [got[x] for x in NODES] == pytest.approx(list(want), abs=1e-4)


def made_corpus(rng, n=1500):
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w, toxic = rng.choices(plain, k=60), i % 5 == 0
        for _ in range(6 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "grotty", "hidden", "vexo" + rng.choice("abcdefghij") + "a"]))
        t = " ".join(w)
        if i % 3 == 0:  # labelled rows never hold this word, so only the walk can tell it
            t = t.replace("hidden", "grotty")
            labels.append((i, int(toxic)))
        rows.append((i, t))
    return rows, labels


def test_words_without_labels_get_polarity_and_clean_english_does_not(spark):
    rows, labels = made_corpus(random.Random(8))
    lexicon = T.induce(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert min(lexicon.polarity[w] for w in ("vilest", "grotty", "hidden")) >= T.CUT
    values = lexicon.values()
    assert all(lexicon.score(values.of(t)) < 0.5 for t in CLEAN + ["", rows[1][1]])
    assert lexicon.score(values.of("so vilest and hidden")) > 0.5
    assert "vexo" in lexicon.stems and lexicon.of_word("vexozzz") >= T.CUT and lexicon.of_word("vex") == 0


def test_clean_english_under_the_corpus_lexicon(spark):
    d = "/root/testdata/sf0.01"
    lexicon = T.induce(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    values = lexicon.values()
    assert all(lexicon.score(values.of(t)) < 0.5 for t in CLEAN)
    table = spark.createDataFrame([(1, t) for t in CLEAN] + [(2, None), (3, "word " * 100_000)], "doc_id long, text string")
    assert [r[0] for r in table.select(T.score_column(lexicon, "text")).collect()] == pytest.approx([lexicon.score(values.of(t or "")) for t in [*CLEAN, None, "word " * 100_000]])


def test_blocks_of_nodes_give_the_same_lexicon(spark, monkeypatch):
    rows, labels = made_corpus(random.Random(8), 600)
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = T.induce(*frames)
    monkeypatch.setattr(T, "NODES_AT_ONCE", 150)
    many = T.induce(*frames)
    assert one.polarity == pytest.approx(many.polarity) and one.stems == pytest.approx(many.stems)
