"""Models over features and texts, out-of-fold scores, and linear heads as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkstream.operators.scoring import metrics


def text_pipeline(text: str = "lo_text", category: str = "lo_id", numbers: tuple[str, ...] = (), trees: bool = False, terms: int = 5000) -> Pipeline:
    """Words and pairs of words (up to terms of each), a one-hot category (unknown ones kept apart), and numbers as they are."""
    stages = [
        SQLTransformer(statement=f"select *, coalesce({text}, '') as _text, coalesce({category}, 'UNK') as _cat from __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_w", vocabSize=terms, binary=True),
        CountVectorizer(inputCol="_pairs", outputCol="_p", vocabSize=terms, binary=True),
        StringIndexer(inputCol="_cat", outputCol="_i", handleInvalid="keep"),
        OneHotEncoder(inputCol="_i", outputCol="_c", handleInvalid="keep"),
        VectorAssembler(inputCols=["_w", "_p", "_c", *numbers], outputCol="features", handleInvalid="keep"),
        GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, maxDepth=4, seed=1) if trees else LogisticRegression(featuresCol="features", labelCol="y", regParam=0.05),
    ]
    return Pipeline(stages=stages)


def out_of_fold(rows: DataFrame, pipeline: Pipeline, folds: int) -> DataFrame:
    """rows with p from the model that has not seen their fold (0 to folds - 1): one fit a fold, scores unioned."""
    parts = [pipeline.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)).withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p") for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def seed_summary(rows: DataFrame, pipeline: Pipeline, folds: int, seeds: int) -> DataFrame:
    """Log loss and AUC of out-of-fold scores for several assignments of groups to folds: a row for each seed."""
    spark = rows.sparkSession
    out = []
    for s in range(seeds):
        split = rows.withColumn("fold", F.pmod(F.xxhash64("lo_id", F.lit(s)), F.lit(folds)).cast("int"))
        m = metrics(out_of_fold(split, pipeline, folds)).first()
        out.append((s, m.n, m.log_loss, m.auc))
    return spark.createDataFrame(out, "seed int, n long, log_loss double, auc double")


def learned_difficulty(groups: DataFrame, prior: float, penalty: float = 100.0) -> DataFrame:
    """id, diff, resid: outcome regressed on vectors with a ridge penalty, weighted by counts; clipped to [0.02, 0.98].

    groups: id, emb, rate, n. Under 10 groups everything takes the prior.
    """
    from pyspark.ml.functions import array_to_vector

    rows = groups.where("emb is not null and n > 0").withColumn("features", array_to_vector(F.col("emb").cast("array<double>")))
    seen = rows.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w")).first()
    if seen.k < 10:
        return groups.select("id", F.lit(prior).alias("diff"), F.lit(0.0).alias("resid"))
    model = LinearRegression(featuresCol="features", labelCol="rate", weightCol="n", regParam=penalty / float(seen.w), elasticNetParam=0.0, standardization=False, solver="normal").fit(rows)
    d = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("prediction")))
    return model.transform(rows).select("id", F.round(d, 6).alias("diff"), F.round(F.col("rate") - d, 6).alias("resid"))


def linear_heads(texts: DataFrame, key: str, text: str, coefficients: DataFrame, intercepts: DataFrame) -> DataFrame:
    """key, code, p: independent logistic heads over words, as a join of words with (code, term, w) and (code, b).

    A text without any known term takes the intercepts alone. Terms are counted once a text.
    """
    terms = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("term"))
    sums = terms.join(coefficients, "term").groupBy(key, "code").agg(F.sum("w").alias("z"))
    grid = texts.select(key).distinct().crossJoin(F.broadcast(intercepts))  # codes are a fixed, small table
    z = F.coalesce("z", F.lit(0.0)) + F.col("b")
    return grid.join(sums, [key, "code"], "left").select(key, "code", (1 / (1 + F.exp(-z))).alias("p"))
