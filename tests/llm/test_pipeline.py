import corpus_pipeline
from cairn.llm import minhash, toxicity
from tests.llm.helpers import awkward, held_words, near_duplicates


def test_stages_take_effect_one_after_another(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "decontamination", "mixing", "sharding"]
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, data)
        assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), docs.schema)
        kept.append([r["doc_id"] for r in now.collect()])
    model = toxicity.train(docs, labels)
    clean = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert set(kept[0]) == clean
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = near_duplicates([(k, text[k]) for k in kept[0]])
    assert set(kept[1]) == {k for k, (_, low) in groups.items() if k == low}
    items = [held_words(r["text"]) for r in bench.collect()]
    held = {k for k in kept[1] if any(b" " + b" ".join(w) + b" " in b" " + b" ".join(held_words(text[k])) + b" " for w in items)}
    assert not held & set(kept[2]) and len(kept[2]) >= len(kept[1]) - len(held) - 2
    assert set(kept[3]) <= set(kept[2])
    run = corpus_pipeline.run(spark, data).collect()
    assert sorted(r["doc_id"] for r in run) == sorted(kept[3])
    assert {r["shard"] for r in run} <= set(range(corpus_pipeline.SHARDS))


def test_stages_survive_awkward_rows(spark, data):
    now = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        out.count()
        now = out if out.columns == now.columns else now
        assert stage(spark, now.limit(0), data).count() == 0
    assert minhash is not None
