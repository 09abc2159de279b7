"""The pipeline, stage by stage against plain versions of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from paperloom.llm import quality, near_dedup, secret_scan, sentencepiece_codec
from paperloom.llm.registry import tokenizer_path
from tests.llm.conftest import DOCS, lorem
from tests.llm.test_near_dedup import plain_least


def test_pipeline(spark, tmp_path):
    rows = [(i, lorem(i, 80 + i % 60), "en", f"s{i % 4}", 1) for i in range(250)]
    rows += [(500 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "s0", 1) for i in range(40)]
    rows += [(600, "password = hunter2hunter2 " + lorem(7007, 90), "en", "s1", 1), (601, None, None, None, None), (602, "short", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixture", "tokens"]
    now, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((before.collect(), now.collect()))
    verdict = {r["doc_id"]: r["kept"] for r in quality.query(docs).collect()}
    assert sorted(r["doc_id"] for r in kept[0][1]) == sorted(i for i, v in verdict.items() if v) and len(kept[0][1]) > 250
    given = sorted(kept[1][0], key=lambda r: r["doc_id"])
    least, _ = plain_least([r["text"] for r in given])
    assert sorted(r["doc_id"] for r in kept[1][1]) == [given[k]["doc_id"] for k in least] and len(kept[1][1]) < len(given)
    assert len(kept[2][0]) == len(kept[2][1])
    for r in kept[2][1]:
        assert r["n_chars"] == len(r["text"]) and not secret_scan.base_spans(r["text"])
    assert any("[SECRET]" in r["text"] for r in kept[2][1])
    times = Counter(r["doc_id"] for r in kept[3][1])
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in kept[3][0]}
    library = sentencepiece_codec.codec(tokenizer_path("piece_bpe_32k.model")).library
    assert len(kept[4][1]) == len(kept[4][0])
    texts = {r["doc_id"]: r["text"] for r in kept[4][0]}
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in kept[4][1])
    whole = Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert whole == Counter((r["doc_id"], r["ids_sha256"]) for r in kept[4][1])
    assert near_dedup.near_dedup(now.limit(0).selectExpr("doc_id", "cast(null as string) as text")).count() == 0


def test_pipeline_of_nothing_and_of_odd_columns(spark, tmp_path, odd_docs, clashing):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd_docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    clashing.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, None, 7}
