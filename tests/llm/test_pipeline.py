import zlib

import corpus_pipeline
from loomtext.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_return_documents_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids
        if name != "line_dedup":
            assert now < ids, f"{name} dropped nothing"
        else:
            assert now == ids
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)
    assert key(again) == key(packed) and zlib.crc32(b"") == 0


def test_stages_take_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_ten_queries():
    assert [int(q.split("_")[0][2:]) for q in registry.QUERIES] == list(range(1, 11))
