"""The graph of all frequent words against a plain version: words that no seed stands near are joined too."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import toxicity as T
from graphloom.llm import word_graph as G

WINDOW = 3


@pytest.mark.parametrize("small", [False, True])
def test_walk_is_the_plain_power_iteration_over_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in {"SCAN": 100, "BYTES": 40, "SLICE": 7}.items():
            monkeypatch.setattr(G, name, value)
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(14)]
    rows = [(i, " ".join(rng.choices(words[i % 3 * 4 : i % 3 * 4 + 6], k=rng.randint(0, 40)))) for i in range(60)] + [(60, ""), (61, "wa zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = Counter(w for _, t in rows for w in set(t.split()) if w != "zzz")
    pair, slots = Counter(), Counter()
    for _, t in rows:
        w = t.split()
        for i, a in enumerate(w):
            for j in range(max(0, i - WINDOW), min(len(w), i + WINDOW + 1)):
                slots[a] += j != i
                pair[a, w[j]] += j != i and a != w[j]
    weight = defaultdict(float)
    for (a, b), n in pair.items():
        if n and "zzz" not in (a, b):
            weight[a, b] = max(0, math.log(n * sum(slots.values()) / (slots[a] * slots[b]))) * n / (n + T.DAMP)
    strong, mild = {"wa": 3.0, "wb": 1.0}, ["wm", "wn"]
    nodes = sorted(df)
    w = np.array([[weight[a, b] for b in nodes] for a in nodes])
    move = w / w.sum(axis=1, keepdims=True)
    ends = []
    for start in (strong, dict.fromkeys(mild, 1.0)):
        s = np.array([start.get(a, 0.0) for a in nodes]) / sum(start.values())
        p = s
        for _ in range(300):
            p = T.RESTART * s + (1 - T.RESTART) * p @ move
        ends.append(p)
    want = (ends[0] - ends[1]) / (ends[0] + ends[1] + (1 - T.RESTART) / len(nodes))
    frequent = spark.createDataFrame(list(df.items()), "word string, df long")
    got = {r["word"]: r["polarity"] for r in T.graph_polarity(docs, frequent, strong, mild, WINDOW).collect()}
    assert weight["we", "wf"] > 0 and [got[a] for a in nodes] == pytest.approx(list(want), abs=1e-3)
