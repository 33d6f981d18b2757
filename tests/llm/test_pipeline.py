from __future__ import annotations

import corpus_pipeline


def test_stages_on_odd_rows(spark, docs, empty, tmp_path):
    """Stages keep the columns of documents; each reads what the one before wrote."""
    for table in (docs, empty):
        at = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, "")
            path = str(tmp_path / f"{name}-{k}-{table is docs}")
            out.write.parquet(path)
            at = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert at.columns == docs.columns
        assert {"doc_id", "sequence_id", "offset", "length"} <= set(at.columns)
        assert (at.count() == 0) == (table is empty)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {}
    for r in out:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert out and max(total.values()) <= 2048
