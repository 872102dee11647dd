"""Quality by compression: dictionaries of good and of bad labelled text; the normalised difference of compressed sizes becomes a calibrated score.

Edge cases: as for toxicity. Null and empty texts get the score of an all-zero measure; without labels of both kinds every score is the share of
label 1 (0.5 if there are none); a null doc_id is scored, held_out is null; repeated rows give one result row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .compression import Method, Model, fit, scored

METHOD = Method(window=160, level=3, dict_bytes=32_768, contrast=False)


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 0


def quality_model(docs: DataFrame, labels: DataFrame, method: Method = METHOD) -> Model:
    return fit(docs, labels, "quality", held_out, method)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
