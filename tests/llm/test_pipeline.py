"""The pipeline's stages one by one against plain Python, and as a whole."""

import corpus_pipeline as cp
from graphloom.llm import toxicity
from tests.llm.test_operators import SMALL, low, ordered, pairs, plain_components, plain_contaminated


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = pairs(kept)
        path = str(tmp_path / str(k))
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        after = pairs(kept)
        assert len(set(after)) == len(after) and set(after) <= set(before)
        if name == "toxicity":
            lexicon = toxicity.induce(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            values = lexicon.values()
            want = [r for r in before if lexicon.score(values.of(r[1] or "")) < 0.5]
        elif name == "exact_dedup":
            want = [(i, t) for i, t in before if i == max(j for j, u in before if low(u) == low(t))]
        elif name == "simhash_near_dedup":
            component = {i: c for i, _, c in plain_components(before)}
            want = [(i, t) for i, t in before if component[i] == i]
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            hit = dict(plain_contaminated(before, items))
            want = [(i, t) for i, t in before if not hit[i]]
        assert ordered(after) == ordered(want), name
    packed = cp.STAGES[-1][1](spark, kept, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in pairs(kept)}


def test_run(spark):
    assert cp.run(spark, SMALL).count() > 50
