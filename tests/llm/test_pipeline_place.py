"""The mix decides the order of the pipeline's result."""

import corpus_pipeline
from trackloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_place_in_result(spark, tmp_path):
    rows = [(i, f"word{i} " * (5 + i % 7), "en", "abc"[i % 3], 0) for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = corpus_pipeline.mix(spark, docs, "")
    placed.write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    want = mixing.mix_sources(docs).collect()
    order = lambda found: [r["doc_id"] for r in sorted(found, key=lambda r: (r["slot"], r["at_byte"], r["doc_id"]))]
    assert order(out) == order(want) and len(out) == 90
