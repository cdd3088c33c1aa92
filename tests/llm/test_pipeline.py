import corpus_pipeline as pipeline
from karst.llm import minhash, mixing, quality, suffixes
from karst.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_table(spark):
    docs = documents(spark, SF)
    kept = {"quality": quality.keep, "near_dedup": minhash.keep_one, "substring_dedup": suffixes.cut, "mix": mixing.mix}
    assert [n for n, _ in pipeline.STAGES] == [*kept, "pack"]
    rows = docs
    for name, op in kept.items():
        assert rows.columns == docs.columns
        rows = op(rows)
    rows = rows.cache()
    rows.count()
    packed = pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert packed.filter("piece = 0").count() == rows.count()


def test_nulls_and_clashing_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.collect()
        pipeline.STAGES[-1][1](spark, docs, SF).collect()
