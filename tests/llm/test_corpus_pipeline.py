"""Each stage of the pipeline keeps the columns of documents and takes its decisions."""
import corpus_pipeline as p
import brute
from barloom.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before), name
        if name == "quality rules":
            assert not any(brute.quality(t)[-1] for t in after.values()) and after.items() <= before.items()
        if name == "line dedup":
            assert set(after) == set(before) and sum(map(len, after.values())) <= sum(map(len, before.values()))
        if name.startswith("n-gram"):
            ends = brute.components(list(before.items()), 5, 80)
            assert after == {k: t for k, t in before.items() if ends[k][1] == k}
        if name.startswith("benchmark"):
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert not any(i in t for i in items for t in after.values())
            assert all(any(i[:30] in before[k] for i in items) for k in set(before) - set(after))
        before = after
    packed = p.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
