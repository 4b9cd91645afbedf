import numpy as np
import pyarrow as pa

from graphloom.llm import lm_scoring

TEXTS = ["A word, the word. THE (word)", "東京は雨、明日も。 ภาษาไทย x9", "", "  \t", "a" * 100 + "," + "b" * 70 + ".", "snake_case don't -- e-mail", "İstanbul ΣΑΣ, ὈΔΥΣΣΕΎΣ"]


def test_tokens():
    assert lm_scoring.tokens_of(TEXTS[0]) == ["a", "word", ",", "the", "word", ".", "the", "(", "word", ")"]
    assert lm_scoring.tokens_of(TEXTS[1])[:6] == ["東", "京", "は", "雨", "、", "明"] and lm_scoring.tokens_of(TEXTS[1])[-1] == "x9"
    assert lm_scoring.tokens_of(TEXTS[5]) == ["snake_case", "don", "'", "t", "--", "e", "-", "mail"]


def test_counts_and_sequences_are_of_tokens(spark):
    tokens = [lm_scoring.tokens_of(t) for t in TEXTS]
    flat = [x for t in tokens for x in t]
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    counts = {r["word"]: r["n"] for r in lm_scoring.word_counts(frame).collect()}
    assert counts == {x: flat.count(x) for x in flat}
    words = {w: i for i, w in enumerate(sorted(set(flat))[::2])}
    known = (words, {}, len(words))
    codes = lm_scoring.Codes(*known)
    units = [[c for x in t for c in lm_scoring.unit_codes(*known, x)] for t in tokens]
    for _ in range(2):
        assert [np.frombuffer(b"".join(codes[p] for p in t.lower().split()), "<u2").tolist() for t in TEXTS] == units
    rows = [(i, np.array(u, "<u2").tobytes(), i // 4) for i, u in enumerate(units)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows])], ["i", "c", "k"])
    found = list(lm_scoring.stretches([batch, batch], 9999, 30))
    assert [r for _, rs, _ in found for r in rs] == 2 * [(i, len(u)) for i, u in enumerate(units)]
    assert [c for x, _, _ in found for c in x if c != 9999] == [c for _ in range(2) for u in units for c in u]
    assert all({i // 4 for i, _ in rs} == {k} for _, rs, k in found) and all((x[:2] == 9999).all() and (x[-2:] == 9999).all() for x, _, _ in found)


def test_punctuation_is_scored(spark):
    out = lm_scoring.lm_scores(spark.createDataFrame([(1, "one, two."), (2, "雨が降る"), (3, "!?")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {1: 4, 2: 4, 3: 1}
