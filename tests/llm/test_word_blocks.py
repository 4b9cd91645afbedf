"""Blocks of the graph that sort their pairs, and those with a table, against plain counts."""

import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import toxicity as T
from graphloom.llm import word_graph as G

WINDOW = 2


@pytest.mark.parametrize("limits", [{}, {"PLACE": 0}, {"PLACE": 0, "SCAN": 1, "OCCURRENCES": 30, "SLICE": 5, "EDGES_AT_ONCE": 4}, {"PLACE": 0.5, "BYTES": 300, "SCAN": 1, "SLICE": 5, "FAR": 20}])
def test_edges_are_the_pairs_more_frequent_than_chance(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(G, name, value)
    rng = random.Random(7)
    words = ["w" + chr(97 + i) for i in range(26)]
    rows = [(" ".join(rng.choices(words, [26 / (i + 1) for i in range(26)], k=rng.randint(0, 30))),) for _ in range(50)]
    docs = spark.createDataFrame(rows, "text string").repartition(2)
    pair, slots = Counter(), Counter()
    for (t,) in rows:
        w = t.split()
        for i, a in enumerate(w):
            for j in range(max(0, i - WINDOW), min(len(w), i + WINDOW + 1)):
                slots[a] += j != i
                if a != w[j]:
                    pair[a, w[j]] += 1
    with G.kept_codes(spark) as path:
        codes, occurrences, places = G.coded(docs, lambda: T.Codes(words), 26, WINDOW, path)
        cuts = G.blocks(occurrences, WINDOW, 100)
        assert [x[0] for x in cuts] == [0, *(x[1] for x in cuts[:-1])] and cuts[-1][1] == 26
        assert any(x[2] is None for x in cuts) == bool(limits)
        got = {}
        for r in G.graph(codes, occurrences, places, WINDOW, 100).collect():
            lengths, steps, n = (G.unpacked(G.pa.scalar(bytes(r[c]), G.pa.binary()), k) for c, k in (("lengths", r["high"] - r["low"]), ("steps", r["n"]), ("counts", r["n"])))
            row = np.repeat(np.arange(r["low"], r["high"]), lengths)
            col = np.cumsum(steps, dtype=np.int64) + G.cells(r["low"]) - G.cells(row)
            got |= {(words[a], words[b]): v for a, b, v in zip(row, col, n.tolist())}
    total = sum(slots.values())
    assert got == {(words[a], words[b]): n for a in range(26) for b in range(a) if (n := pair[words[a], words[b]]) * total > slots[words[a]] * slots[words[b]]}
