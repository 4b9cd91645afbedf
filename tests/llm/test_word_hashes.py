"""Words as numbers against the plain pattern; workers keep no memory of the texts they have read."""

import itertools
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from graphloom.llm import toxicity as T
from graphloom.llm import word_hashes as H
from graphloom.llm.common import shared_dir

ODD = ["", "a", "A b_c1d", "İΑΣ ΑΣ ΑΣ.", "x\ny\r\nz w", "naïve—CAFÉ ½ Ⅷ ²x", "日本語 texte\U00010400\U0001f600b", "don't\x00stop", "éa", "ZZZ" * 300 + " end"]


@pytest.mark.parametrize("small", [False, True])
def test_words_are_those_of_the_pattern_in_any_cut(monkeypatch, small):
    if small:
        monkeypatch.setattr(H, "LONG", 5)
        monkeypatch.setattr(H, "AT_ONCE", 9)
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choices("abÉΣİ _1.\n日", k=rng.randint(0, 60))) for _ in range(200))]
    found = H.Hashes().of(texts)
    words = [w for t in texts for w in T.words_of(t)]
    assert found.counts.tolist() == [len(T.words_of(t)) for t in texts]
    assert found.words(np.arange(len(words))) == words
    number = dict(zip(words, found.hashes.tolist()))
    assert [number[w] for w in words] == found.hashes.tolist() and len(set(number.values())) == len(number)
    assert H.Hashes().of_words(list(number)).tolist() == list(number.values())
    table = H.Table(np.zeros(0, np.uint64), np.zeros(0, np.int32), -1)
    assert set(table.of(found.hashes).tolist()) == {-1} and H.Hashes().of([]).counts.tolist() == []


def test_values_are_those_of_each_word():
    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 11))) for _ in range(3000)]
    lexicon = T.Lexicon({w: rng.uniform(-1, 1) for w in words[::3]}, {"abca": 0.7, "bcabc": 0.9, "aaaaaaaa": 0.6, "bcabcaa": -0.2})
    assert lexicon.values().of(" ".join(words)).tolist() == [np.float32(lexicon.of_word(w)) for w in words]


def test_tallies_count_documents_and_not_occurrences(spark, monkeypatch):
    monkeypatch.setattr(T, "_FLUSH", 3)
    rows = [("Aa aa b", 1), ("b c", 0), ("aa d e f", None), ("", 0)]
    got = {r["word"]: (r["df"], r["toxic"], r["clean"]) for r in T.tallies(spark.createDataFrame(rows, "text string, toxic int").repartition(2)).collect()}
    assert got == {"": (4, 1, 2), "aa": (2, 1, 0), "b": (2, 1, 1), "c": (1, 0, 1), "d": (1, 0, 0), "e": (1, 0, 0), "f": (1, 0, 0)}


def test_a_worker_keeps_no_memory_of_texts():
    values, letters = T.Lexicon({"vex": 1.0}).values(), itertools.product("abcdefghijklmnopqrst", repeat=4)
    texts = [" ".join("".join(x) + "," for x in itertools.islice(letters, 1600)) for _ in range(100)]
    values.of(texts[0] + "vex")
    tracemalloc.start()
    try:
        for t in texts:
            values.of(t)
        assert tracemalloc.get_traced_memory()[0] < 1e6  # a memory of 160,000 different pieces took 17 MB
    finally:
        tracemalloc.stop()


def test_codes_leave_the_shared_folder(spark):
    rows = [(k, f"wa wb wc {'wd' if k % 2 else 'we'}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = spark.createDataFrame([(w, 20) for w in ("wa", "wb", "wc", "wd", "we")], "word string, df long")
    assert T.graph_polarity(docs, frequent, {"wd": 1.0}, ["we"], 3).count() == 5
    assert not list(Path(shared_dir(spark).split(":", 1)[-1]).glob("codes-*"))
