"""Toxicity by compression distance: dictionaries of toxic and of ordinary text, windows of some 24 bytes, calibrated thresholds.

Toxic texts are mostly ordinary ones, so a dictionary of whole toxic texts tells little. The toxic dictionary is trained on the words that a
significance test finds far more often in toxic texts, and laid over the ordinary dictionary: an ordinary window then compresses alike with both, and a
window with such words shorter with the toxic one. The selection of words is a departure from plain compression distance; the README has the figures.

Edge cases: null and empty texts have no windows and get the score of an all-zero measure; without labels of both kinds every score is the share of
label 1 (0.5 if there are none); labels of null ids and labels other than 0 and 1 are ignored; a null doc_id is scored, held_out is null; repeated
rows give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .compression import Method, Model, fit, scored

METHOD = Method(window=24, level=12, dict_bytes=65_536, contrast=True)


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 4 == 2


def toxicity_model(docs: DataFrame, labels: DataFrame, method: Method = METHOD) -> Model:
    return fit(docs, labels, "toxic", held_out, method)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
