"""Mixing sources to target shares of tokens, with capped repeats."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkstream.llm.components import hashed_share

#: Tokenizer file: a public vocabulary as ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split into words before byte pairs are merged, as published with such vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(documents: DataFrame, text: str, tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """documents with the number of tokens of the whole text; null texts have 0. The file must be on every executor."""

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield b.map(lambda x: len(encoding.encode_ordinary(x)) if x else 0)

    return documents.withColumn(out, F.coalesce(tokens(F.col(text)), F.lit(0)))


#: Words that place a text; the first topic that has one is taken. Fixed values.
TOPICS = {
    "geometry": "angle|triangle|perimeter|radius|diameter|polygon|vertex|vector|parallel|shape",
    "statistics": "median|probability|frequency|sample|chart|outcome|histogram",
    "algebra": "equation|bracket|variable|coefficient|sequence|gradient|intercept",
    "fractions": "fraction|decimal|percentage|ratio|denominator|numerator",
}


def topic(text: Column) -> Column:
    out = F.lit("other")
    for name, words in reversed(TOPICS.items()):
        out = F.when(F.lower(text).rlike(rf"\b(?:{words})"), name).otherwise(out)
    return out


def language(lang: Column) -> Column:
    """The primary tag in lower case: 'en-GB' and 'EN' are 'en'; null and blank are 'und'."""
    x = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]+)", 1))
    return F.when(F.coalesce(x, F.lit("")) == "", "und").otherwise(x)


def rake(cells: pd.DataFrame, margins: dict[str, dict[str, float]], most: dict[str, float], total: float, rounds: int = 200, within: float = 1e-6) -> pd.Series:
    """Repeats for each cell so that tokens * repeats meets the margins' shares of total, by proportional fitting.

    cells: a row for each combination of the margins' columns, with tokens. most: the largest repeats by the first
    margin's value, in which every step is clipped; that margin is fitted last, so that where margins disagree or the
    caps bind, it is the one that is met as far as can be.
    """
    first, *others = margins
    caps = cells[first].map(most).fillna(0.0).to_numpy(float)
    size = cells.tokens.to_numpy(float)
    r = (caps > 0).astype(float).clip(0, caps)
    for _ in range(rounds):
        before = r.copy()
        for name in (*others, first):
            goal = cells[name].map(margins[name]).fillna(0.0).to_numpy(float) * total
            have = pd.Series(r * size).groupby(cells[name].to_numpy()).transform("sum").to_numpy()
            r = (r * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)).clip(0, caps)
        # what clipping took is spread over the cells of the first margin that still have room
        for _ in range(20):
            goal = cells[first].map(margins[first]).fillna(0.0).to_numpy(float) * total
            have = pd.Series(r * size).groupby(cells[first].to_numpy()).transform("sum").to_numpy()
            room = pd.Series((caps - r) * size).groupby(cells[first].to_numpy()).transform("sum").to_numpy()
            lack = (goal - have).clip(0)
            if (lack <= within * total).all() or not (room > 0).any():
                break
            r = (r + np.divide(lack, room, out=np.zeros_like(lack), where=room > 0).clip(0, 1) * (caps - r)).clip(0, caps)
        if abs(r - before).max() < within:
            break
    return pd.Series(r, index=cells.index)


def mix(documents: DataFrame, doc: str, targets: dict[str, tuple[float, int]], total: float | None = None, most_cells: int = 100_000) -> DataFrame:
    """documents with repeats, how often each is used, 0 for those left out.

    documents: doc (unique), source, lang, topic, tokens. targets: source -> (share of tokens, most repeats). Weights are
    raked over cells of source, language and topic to the target shares and to the tokens' own shares of languages and
    topics. Unless given, total is the largest, up to the tokens of all targeted sources, at which every source that has
    any tokens can reach its share within its repeats. A document gets the whole part of its cell's
    weight, and one more if the hash of its id falls under the rest, so its expected tokens are the calibrated ones.

    Documents of no targeted source, or without tokens, get 0. A source too small for its share gets the most repeats.
    Only the cells, at most most_cells, come to the driver, summed before. An empty table stays empty.
    """
    known = documents.where(F.col("source").isin(*targets) & (F.col("tokens") > 0))
    cells = known.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(most_cells + 1).toPandas()
    if len(cells) > most_cells:
        raise ValueError(f"more than {most_cells} cells of source, language and topic")
    if cells.empty:
        return documents.withColumn("repeats", F.lit(0))
    scale = sum(s for s, _ in targets.values())
    whole = float(cells.tokens.sum())
    margins = {"source": {k: s / scale for k, (s, _) in targets.items()}} | {c: (cells.groupby(c).tokens.sum() / whole).to_dict() for c in ("lang", "topic")}
    held = cells.groupby("source").tokens.sum()
    reach = [held[k] * m / (s / scale) for k, (s, m) in targets.items() if s > 0 and k in held.index]
    cells["__weight"] = rake(cells, margins, {k: float(m) for k, (_, m) in targets.items()}, total or min([whole, *reach]))
    spark = documents.sparkSession
    weights = spark.createDataFrame(cells[["source", "lang", "topic", "__weight"]].sort_values(["source", "lang", "topic"]))
    w = F.coalesce("__weight", F.lit(0.0))
    drawn = documents.join(F.broadcast(weights), ["source", "lang", "topic"], "left")
    extra = (hashed_share(F.col(doc).cast("string")) < w - F.floor(w)).cast("int")
    return drawn.withColumn("repeats", F.when(F.col("tokens") > 0, (F.floor(w) + extra).cast("int")).otherwise(0)).drop("__weight")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, available, used (tokens), short: a row for each target; short if it is 2 % of its share below."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    whole = used.agg(F.sum("used").alias("whole"))
    out = targets.join(used, "source", "left").crossJoin(F.broadcast(whole))
    share = F.coalesce(F.col("used") / F.nullif("whole", F.lit(0)), F.lit(0.0))
    return out.select("source", "target_share", share.alias("actual_share"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("used", F.lit(0)).alias("used"), (share < 0.98 * F.col("target_share")).alias("short"))
