"""Group statistics and difficulty estimates: shrunken rates, nearest neighbours, shared parts, folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkstream.functions.dialect import Dialect
from chalkstream.functions.scan import numbered
from chalkstream.operators.profiles import r6

#: Queries that are held against all rows at once.
QUERY_BLOCK = 4096


def nearest(rows: DataFrame, queries: DataFrame, k: int = 15, exclude_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """query, id, y, cosine: for each query its k nearest rows by cosine, of ties the smaller ids.

    rows and queries: id, emb (array of numbers), and y in rows. Queries are taken in blocks of bounded size, each held
    against all rows in one pass in which every batch keeps only its own k best, so what is shuffled is k rows for a
    query and batch. Rows or queries without a vector, or of length 0, meet nothing.
    """
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("cosine", T.DoubleType())])
    q = queries.where("emb is not null").select("id", F.col("emb").cast("array<double>").alias("emb"))
    n = q.count()
    out: DataFrame | None = None
    for b in range(max(1, -(-n // block))):
        part = (q.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // block))) == b) if n > block else q).toPandas()
        ids = part.id.to_numpy(np.int64)
        m = np.array(part.emb.tolist(), float) if len(part) else np.zeros((0, 1))
        norm = np.linalg.norm(m, axis=1) if len(part) else np.zeros(0)
        held = rows.sparkSession.sparkContext.broadcast((ids[norm > 0], (m[norm > 0].T / norm[norm > 0]).T))

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qi, qm = held.value
            for x in batches:
                if not len(x) or not len(qi):
                    continue
                v = np.array(x.emb.tolist(), float)
                length = np.linalg.norm(v, axis=1)
                ok = length > 0
                v, own, y = (v[ok].T / length[ok]).T, x.id.to_numpy(np.int64)[ok], x.y.to_numpy(float)[ok]
                if not len(own):
                    continue
                s = np.round(qm @ v.T, 12)
                if exclude_self:
                    s[qi[:, None] == own[None, :]] = -2.0
                order = np.argsort(own, kind="stable")
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                r = np.repeat(np.arange(len(qi)), best.shape[1])
                c = best.ravel()
                keep = s[r, c] > -1.5
                yield pd.DataFrame({"query": qi[r[keep]], "id": own[c[keep]], "y": y[c[keep]], "cosine": s[r[keep], c[keep]]})

        found = rows.where("emb is not null").select("id", F.col("emb").cast("array<double>").alias("emb"), F.col("y").cast("double").alias("y")).mapInPandas(search, schema)
        out = found if out is None else out.unionAll(found)
    w = W.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return out.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def neighbour_difficulty(near: DataFrame, prior: float, pseudo: float = 30.0) -> DataFrame:
    """query, diff, sim, support: the neighbours' shrunken outcome weighted by max(cosine, 0) cubed; the prior without any weight."""
    w = F.pow(F.greatest("cosine", F.lit(0.0)), F.lit(3.0))
    shrunk = (F.col("y") + pseudo * prior) / (1 + pseudo)
    s = near.groupBy("query").agg(F.sum(w).alias("w"), F.sum(w * shrunk).alias("wy"), F.max("cosine").alias("sim"))
    has = F.col("w") > 0
    return s.select("query", F.round(F.when(has, F.col("wy") / F.col("w")).otherwise(prior), 6).alias("diff"), F.round(F.when(has, F.col("sim")).otherwise(0.0), 6).alias("sim"), F.round(F.when(has, F.log1p("w")).otherwise(0.0), 6).alias("support"))


def knn_duck(pseudo: float = 30.0, k: int = 15) -> str:
    return f"""with v as (select vec_id as id, cast(embedding as double[]) as emb, cast(label >= 5 as int) as y from embeddings), p as (select avg(y) as prior from v),
s as (select q.id as query, v.id, v.y, round(list_cosine_similarity(q.emb, v.emb), 12) as c, row_number() over (partition by q.id order by round(list_cosine_similarity(q.emb, v.emb), 12) desc, v.id) as rk from v q, v where q.id % 50 = 0 and q.id <> v.id),
a as (select query, sum(greatest(c, 0) ** 3) as w, sum(greatest(c, 0) ** 3 * (y + {pseudo} * prior) / (1 + {pseudo})) as wy, max(c) as sim, max(prior) as prior from s, p where rk <= {k} group by query)
select query, round(case when w > 0 then wy / w else prior end, 6) as diff, round(case when w > 0 then sim else 0 end, 6) as sim, round(case when w > 0 then ln(1 + w) else 0 end, 6) as support from a"""


def shared_parts_sql(e: Dialect, outcomes: str) -> str:
    """Difficulty of an entity from the parts it shares with others: each part's shrunken rate without the entity's own rows.

    outcomes: lo, kc, y. A part that no other entity has is skipped; an entity whose parts all are takes the prior.
    """
    one = "1.0D" if e.spark else "1.0"
    return f"""with p as (select avg(y * {one}) as prior from {outcomes}), own as (select lo, kc, sum(y) as sy, count(*) as n from {outcomes} group by lo, kc),
tot as (select kc, sum(sy) as sy, sum(n) as n from own group by kc),
r as (select own.lo, own.kc, tot.n - own.n as n, (tot.sy - own.sy + 20 * prior) / (tot.n - own.n + 20) as rate from own join tot on own.kc = tot.kc cross join p)
select lo, {r6('coalesce(avg(case when n > 0 then rate end), (select prior from p))')} as kcdiff_mean, {r6('coalesce(min(case when n > 0 then rate end), (select prior from p))')} as kcdiff_min, {r6('coalesce(max(case when n > 0 then rate end), (select prior from p))')} as kcdiff_max, count(*) as kcdiff_n, {r6('ln(1 + coalesce(sum(case when n > 0 then n end), 0))')} as kcdiff_support, {r6(f'count_if(n > 0) * {one} / count(*)')} as kcdiff_seen_share from r group by lo"""


def contrast_sql(e: Dialect, record: str, diff: str, resp: str) -> str:
    """Logit of a session's accuracy less logit of the objective's difficulty, clipped by 1e-4; null without a record."""
    logit = lambda x: f"ln(greatest(0.0001, least(0.9999, {x})) / (1 - greatest(0.0001, least(0.9999, {x}))))"
    return f"select r.response_id, {r6(logit('rec_accuracy') + ' - ' + logit('lo_mean_correct'))} as irt_margin, {r6(logit('rec_recency_acc') + ' - ' + logit('lo_mean_correct'))} as irt_margin_recent from {resp} r left join {record} k on r.session_id = k.session_id join {diff} d on r.response_id = d.response_id"


def greedy_plan(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[int]]]:
    """For each size, largest first: the folds of its first groups, and the cycle that the rest follow.

    Every group goes to the lightest fold, of ties the first. Once the loads lie less than a size apart, equal groups
    visit the folds in a fixed order, so a size costs a few steps however many groups it has.
    """
    load = [0] * folds
    out = []
    for size, count in sorted(sizes, reverse=True):
        first: list[int] = []
        while count and max(load) - min(load) >= size:
            k = min(range(folds), key=lambda j: (load[j], j))
            load[k] += size
            first.append(k)
            count -= 1
        cycle: list[int] = []
        if count:
            trial = load[:]
            for _ in range(folds):
                k = min(range(folds), key=lambda j: (trial[j], j))
                trial[k] += size
                cycle.append(k)
            for j, k in enumerate(cycle):
                load[k] += size * (count // folds + (j < count % folds))
        out.append((size, first, cycle))
    return out


def greedy_folds(groups: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """key, n, fold: groups by falling size, of ties by key, each to the lightest fold so far.

    groups has a row for each record. Only the different sizes, at most the root of twice the number of records, come to
    the driver; groups of a size are numbered by blocks of their key's hash order.
    """
    sized = groups.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    plan = greedy_plan([(r.n, r.c) for r in sized.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()], folds)
    if not plan:
        return sized.withColumn("fold", F.lit(0))
    h = F.md5(F.col(key).cast("string"))
    ranked = numbered(sized.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 2)), "n", "__b", ["__h"], index="rk", total="__t")
    table = groups.sparkSession.createDataFrame([(s, f, c) for s, f, c in plan], "n long, first array<int>, cycle array<int>")
    joined = ranked.join(F.broadcast(table) if len(plan) <= 100_000 else table, "n")
    lead = F.size("first")
    fold = F.when(F.col("rk") < lead, F.get("first", F.col("rk").cast("int"))).otherwise(F.get("cycle", ((F.col("rk") - lead) % folds).cast("int")))
    return joined.select(key, "n", fold.alias("fold"))


def clean_rows_sql(e: Dialect, resp: str) -> str:
    """Whether all responses of a session fall in one fold, folds by the objective's hash; and each fold's base."""
    f = f"cast(floor({e.share_of('lo_id')} * 5) as int)"
    return f"select session_id, count(*) as n, min({f}) as lowest, max({f}) as highest, cast(min({f}) = max({f}) as int) as clean from {resp} group by session_id"


def fold_rates_sql(e: Dialect, resp: str, labels: str) -> str:
    f = f"cast(least(4, floor({e.share_of('lo_id')} * 5)) as int)"
    return f"select {f} as fold, count(*) as n, {r6('avg(y)')} as base_rate, {r6('sum(y + 0.0)')} as positives from {resp} r join {labels} l on r.response_id = l.response_id group by 1"


def flat_difficulty(near: DataFrame) -> DataFrame:
    """query, p: the plain neighbour classifier, outcomes weighted by max(cosine, 1e-6), itself included, clipped by 1e-6."""
    w = F.greatest("cosine", F.lit(1e-6))
    p = F.sum(w * F.col("y")) / F.sum(w)
    return near.groupBy("query").agg(F.round(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p)), 6).alias("p"))


def flat_duck(k: int = 15) -> str:
    return f"""with v as (select vec_id as id, cast(embedding as double[]) as emb, cast(label >= 5 as int) as y from embeddings),
s as (select q.id as query, v.y, round(list_cosine_similarity(q.emb, v.emb), 12) as c, row_number() over (partition by q.id order by round(list_cosine_similarity(q.emb, v.emb), 12) desc, v.id) as rk from v q, v where q.id % 50 = 0)
select query, round(greatest(1e-6, least(1 - 1e-6, sum(greatest(c, 1e-6) * y) / sum(greatest(c, 1e-6)))), 6) as p from s where rk <= {k} group by query"""
