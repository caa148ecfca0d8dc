"""Places where a model of your own is called: batched scorers, generation with parsing, guards, prompts, selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stub_score(key: F.Column) -> F.Column:
    """A deterministic stand-in for a scorer: 0.35 + 0.55 of the first 32 bits of an MD5, in [0.35, 0.9]."""
    return 0.35 + 0.55 * F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967295.0


def scored(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 8) -> DataFrame:
    """key, p: a model applied in batches of texts of like length; load runs once in each worker.

    Within a partition texts go to the model from the longest down, so that a batch pads little.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            b = b.assign(_n=b[text].fillna("").str.len()).sort_values("_n", ascending=False, kind="stable")
            texts = b[text].fillna("").tolist()
            p = [x for i in range(0, len(texts), batch) for x in model(texts[i : i + batch])]
            yield pd.DataFrame({key: b[key].to_numpy(), "p": p})

    return rows.select(key, text).mapInPandas(run, f"{key} string, p double")


def generated(rows: DataFrame, key: str, prompt: str, load: Callable[[], Callable[[list[str]], list[str]]], schema: str, batch: int = 1000) -> DataFrame:
    """key, answer (struct of schema, null where the text is no such JSON), raw: constrained generation in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "raw": model(part[prompt].fillna("").tolist())})

    return rows.select(key, prompt).mapInPandas(run, f"{key} string, raw string").select(key, F.when(F.expr("try_parse_json(raw) is not null"), F.from_json("raw", schema)).alias("answer"), "raw")


def guard_failures(answers: DataFrame, most: float = 0.2) -> DataFrame:
    """The answers, or an error if more than the share most of them could not be parsed."""
    r = answers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer").isNull()).alias("bad")).first()
    if r.n and r.bad > most * r.n:
        raise RuntimeError(f"{r.bad} of {r.n} answers could not be parsed")
    return answers


def rubric_columns(answers: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Booleans of a rubric answer as 0 or 1, 0 where it is missing."""
    return answers.select("session_id", *[F.coalesce(F.col(f"answer.{k}").cast("int"), F.lit(0)).alias(f"rubric_{k}") for k in keys])


def arc_columns(answers: DataFrame) -> DataFrame:
    """Confusions and resolutions of an arc answer; misconception columns are null where none is present."""
    a = lambda c: F.col(f"answer.{c}")
    held = a("misconception_present")
    return answers.select(
        "session_id", a("confusion_count").alias("arc_confusion_count"), F.when(a("confusion_count") > 0, a("resolution_count") / a("confusion_count")).otherwise(0.0).alias("arc_resolution_rate"), (a("final_state") == "resolved").cast("int").alias("arc_final_resolved"),
        (a("resolution_agent") == "student").cast("int").alias("arc_student_led"), held.cast("int").alias("misconception_present"), F.when(held, a("misconception_resolved").cast("int")).alias("misconception_resolved"),
    )


def prompts(turns: DataFrame, system: str, budget: int = 6500, chars_per_token: int = 4) -> DataFrame:
    """session_id, prompt: utterance lines of a session behind an instruction, as many last turns as the budget holds."""
    line = F.concat(F.lit("utterance_id="), F.col("i").cast("string"), F.lit(": "), F.col("content"))
    w = W.partitionBy("session_id").orderBy(F.desc("i"))
    room = budget * chars_per_token - len(system) - 200
    kept = turns.withColumn("line", line).withColumn("used", F.sum(F.length("line") + 1).over(w)).where(F.col("used") <= room)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("session_id").agg(F.concat(F.lit(system + "\n\n"), body).alias("prompt"))


def similar_turns(turns: DataFrame, k_most: int = 20, k_least: int = 3) -> DataFrame:
    """The turns most like the session's query vector: between k_least and k_most of them, in order of place.

    turns: session_id, i, n, emb and query (arrays of numbers of one length). Ties go to the earlier turn.
    """

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.asarray(x, float), np.asarray(y, float)
            d = np.linalg.norm(x) * np.linalg.norm(y)
            out.append(float(x @ y / d) if d else 0.0)
        return pd.Series(out)

    w = W.partitionBy("session_id").orderBy(F.desc("sim"), "i")
    ranked = turns.withColumn("sim", F.round(cosine("emb", "query"), 9)).withColumn("rk", F.row_number().over(w))
    return ranked.where(F.col("rk") <= F.greatest(F.lit(k_least), F.least(F.lit(k_most), F.col("n")))).drop("rk")
