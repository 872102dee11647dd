"""The pipeline, stage by stage, against brute force on each stage's own input."""

import hashlib

import pytest
from test_operators import SF, brute_components, tiktoken_own  # noqa: F401

from tidegrid.llm import quality, toxicity
from tidegrid.llm.compression import scored

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path, tiktoken_own):  # noqa: F811
    from tidegrid.llm import decontamination

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name in ("toxicity", "quality"):
            module = {"toxicity": toxicity, "quality": quality}[name]
            model = getattr(module, f"{name}_model")(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r["doc_id"] for r in scored(docs, model).where(f"predicted = {int(name == 'quality')}").collect()}
        elif name == "near_duplicates":
            want = {i for i, (_, c) in brute_components(before, 5, 80).items() if i == c}
        elif name == "decontamination":
            want = set(before) - {r["doc_id"] for r in decontamination.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            want = set(before)
            for r in after.collect():
                assert r["token_ids"] == tiktoken_own.encode_ordinary(before[r["doc_id"]])
                assert r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest()
        assert ids == want, name
        if name != "byte_bpe":
            assert after.columns == docs.columns
        kept.append(len(ids))
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_tables(spark, tmp_path, empty):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names; then empty tables."""
    from pyspark.sql import functions as F

    text = "some words of a text that stand here and there and go on " * 3
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, "word " * 60_000, "en", "s", 7), (None, text + "x y z", None, "s", 1), (6, text + " end", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit("x"), "predicted": F.lit(9), "node": F.lit("x"), "token_ids": F.lit("x"), "kept": F.lit(False)})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "no document has these words in a row"), (2, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"]
    out = got.collect()
    if empty:
        assert out == []
    said = {i: t or "" for i, t, *_ in rows}
    for r in out:
        assert len(r["token_ids"]) == r["n_tokens"] and r["decoded_sha256"] == hashlib.sha256(said[r["doc_id"]].encode()).hexdigest()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids))
