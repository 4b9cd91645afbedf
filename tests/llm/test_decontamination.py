from itertools import combinations

from graphloom.llm import decontamination

from .test_operators import plain_contaminated


def missed(n, changed, masks):
    """Sets of changed places among ``n`` that leave no mask a place on unchanged words only."""
    care = [{s + k for k, c in enumerate(m) if c == "1"} for m in masks for s in range(n - len(m) + 1)]
    return [p for p in combinations(range(n), changed) if not any(c.isdisjoint(p) for c in care)]


def results(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: (r["contaminated"], r["overlap"]) for r in decontamination.decontamination(docs, bench).collect()}


def substituted(n, changed):
    """Texts that hold an item of ``n`` words with each set of ``changed`` places changed."""
    item = [f"w{n}x{k}" for k in range(n)]
    return " ".join(item), [" ".join(["pre", "fix", *("zzz" if k in p else x for k, x in enumerate(item)), "end"]) for p in combinations(range(n), changed)]


def test_masks_cover_long_stretches():
    for n, most in ((15, 3), (14, 2), (13, 2), (12, 2), (11, 2), (10, 2)):
        for changed in range(most + 1):
            assert not missed(n, changed, decontamination.MASKS)


def test_long_stretches_with_substitutions(spark):
    item, texts = substituted(15, 3)
    got = results(spark, list(enumerate(texts)), [(1, item)])
    assert len(got) == 455 and all(hit and abs(share - 0.8) < 1e-9 for hit, share in got.values())
    # only the stretch from the tenth word on has enough equal words
    long = [f"v{k}" for k in range(40)]
    stretch = " ".join(["a"] * 9 + ["zz" if k in (3, 7, 11) else x for k, x in enumerate(long[9:24])] + ["b"] * 20)
    over = " ".join(["a"] * 9 + ["zz" if k in (3, 7, 11, 14) else x for k, x in enumerate(long[9:24])] + ["b"] * 20)
    rows, items = [(1, stretch), (2, over), (3, " ".join(long[25:])), (4, "")], [(1, " ".join(long))]
    got = results(spark, rows, items)
    assert [(d, got[d][0]) for d, _ in rows] == plain_contaminated(rows, items) == [(1, True), (2, False), (3, True), (4, False)]


def test_masks_cover_short_items():
    assert missed(5, 1, decontamination.MASKS) == [(1,), (3,)]
    for n in range(5, 15):
        masks = decontamination.MASKS + (decontamination.SHORT_MASKS if n == 5 else ())
        for changed in range(n // 5 + 1):
            assert not missed(n, changed, masks)


def test_short_items_with_substitutions(spark):
    items, rows = [], []
    for n in range(5, 15):
        for changed in range(n // 5 + 2):  # one more than may be
            item, texts = substituted(n, changed)
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
        items.append((n, item))
    got = results(spark, rows, items)
    want = plain_contaminated(rows, items)
    assert [(d, got[d][0]) for d, _ in rows] == want and len({hit for _, hit in want}) == 2
    # without items of five words the short masks are not needed
    assert results(spark, rows, items[1:]) == {d: x if not rows[d][1].count("w5x") else (False, 0.0) for d, x in got.items()}
