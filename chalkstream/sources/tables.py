"""Readers and writers of the tables: typed CSV, transcript folders and archives, optional side tables, text sinks."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSES = "response_id string, session_id string, learning_objective_id string, learning_objective string"
TRANSCRIPT = "session_id string, utterance_id string, role string, content string, timestamp string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses as text, by an explicit schema."""
    return spark.read.schema(RESPONSES).csv(path, header=True, multiLine=True, escape='"')


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """response_id and is_correct: numbers in text, through a float; what is none is null."""
    t = spark.read.schema("response_id string, is_correct string").csv(path, header=True)
    return t.withColumn("is_correct", F.col("is_correct").try_cast("double").cast("int"))


def parse_transcripts(raw: DataFrame) -> DataFrame:
    """utterance_id as a number where it is one, null otherwise; order is by it, nulls last, never physical."""
    return raw.withColumn("utterance_id", F.col("utterance_id").try_cast("double"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts from a folder of CSV files, one for each session, or from an archive of them.

    The session is the file's stem. Files of an archive are split over tasks by archive; a path that is neither raises.
    """
    if path.endswith(".zip"):
        if not list(Path(path.removeprefix("file:")).parent.glob(Path(path).name)):
            raise FileNotFoundError(path)

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for content in b.content:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if name.endswith(".csv"):
                                rows = pd.read_csv(io.BytesIO(z.read(name)), dtype=str, keep_default_na=False, na_values=[""])
                                rows["session_id"] = Path(name).stem
                                yield rows.reindex(columns=["session_id", "utterance_id", "role", "content", "timestamp"]).astype(object).where(lambda x: x.notna(), None)

        return parse_transcripts(spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, TRANSCRIPT))
    if not Path(path.removeprefix("file:")).is_dir() and "://" not in path:
        raise FileNotFoundError(path)
    raw = spark.read.schema(TRANSCRIPT).csv(path, header=True, multiLine=True, escape='"')
    return parse_transcripts(raw.withColumn("session_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)))


def transcripts_of(transcripts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted sessions only, one scan for all; a wanted session without rows is no error."""
    return transcripts.join(wanted.select("session_id").distinct(), "session_id", "left_semi")


def resolve(folder: str, prefix: str, suffix: str) -> str:
    """The one file of a folder whose name begins and ends so; none or several raise."""
    found = sorted(p.name for p in Path(folder).iterdir() if fnmatch.fnmatch(p.name, f"{prefix}*{suffix}"))
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files {prefix}*{suffix} in {folder}")
    return str(Path(folder) / found[0])


def largest(folder: str, pattern: str) -> str:
    """The largest file of a pattern, of ties the first by name: the full template beside a smoke one."""
    found = sorted(Path(folder).glob(pattern), key=lambda p: (-p.stat().st_size, p.name))
    if not found:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return str(found[0])


def optional(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A side table, or an empty one of the schema where there is no file."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if form == "csv" else reader.json(path, multiLine=True) if form == "json" else reader.parquet(path)


def with_vectors(rows: DataFrame, key: str, vectors: DataFrame, size: int) -> DataFrame:
    """rows with emb: the vector of their key, zeros for a key without one."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return rows.join(vectors.select(F.col("id").alias(key), "emb"), key, "left").withColumn("emb", F.coalesce("emb", zeros))


def write_scores(template: DataFrame, scores: DataFrame, path: str) -> None:
    """One CSV of the template's rows: clipped probabilities, 0.5 for rows without a score."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce("probability", F.lit(0.5))))
    out = template.select("response_id").join(scores.select("response_id", "probability"), "response_id", "left").select("response_id", p.alias("probability"))
    out.orderBy("response_id").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_flat(template: DataFrame, value: float, path: str) -> None:
    template.select("response_id", F.lit(value).alias("probability")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
