"""The transcript tables in the form the operators of this folder take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkstream.functions.keys import norm_id, whole_number
from chalkstream.session import read


def utterances(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """session_id and utterance_id in normal form, and the columns asked for as they stand.

    A row whose utterance_id is not a whole number keeps a null id. Repeats are kept.
    """
    rows = read(spark, sf_dir, "test_transcripts")
    return rows.select(norm_id("session_id").alias("session_id"), whole_number("utterance_id").alias("utterance_id"), *columns)


def responses(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = read(spark, sf_dir, "test_features")
    return rows.select(norm_id("response_id").alias("response_id"), *columns)
