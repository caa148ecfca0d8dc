"""Scores and their treatment: stubs, calibration, blending, shrinking, recentring, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkstream.functions.dialect import Dialect
from chalkstream.functions.scan import running_sum
from chalkstream.operators.profiles import r6

# Calibration of the two halves, and the weight of the second.
PLATT_TREES, PLATT_TEXT, BLEND = (0.9410532717942149, -0.011745382464934489), (0.6876178756942771, 0.45650491437726304), 0.43


def logit(x: str) -> str:
    return f"ln(greatest(1e-6, least(1 - 1e-6, {x})) / (1 - greatest(1e-6, least(1 - 1e-6, {x}))))"


def platt(x: str, ab: tuple[float, float]) -> str:
    return f"1 / (1 + exp(-({ab[0]} * {logit(x)} + ({ab[1]}))))"


def stub_sql(e: Dialect, resp: str) -> str:
    """response_id, p_text, p_trees: deterministic stand-ins for two scorers, 0.35 + 0.55 of a share of an MD5; seeds averaged."""
    s = lambda k: f"(0.35 + 0.55 * {e.share_of(f'''concat('{k}|', response_id)''')})"
    return f"select response_id, {s('text')} as p_text, ({' + '.join(s(f'seed{i}') for i in range(5))}) / 5 as p_trees from {resp}"


def blended_sql(e: Dialect, scores: str) -> str:
    """Calibrated halves, their blend (0.5 where either is missing), and the blend shrunk towards the middle in logits."""
    a, b = platt("p_text", PLATT_TEXT), platt("p_trees", PLATT_TREES)
    mix = f"case when p_text is null or p_trees is null then 0.5 else (1 - {BLEND}) * {a} + {BLEND} * {b} end"
    return f"select response_id, {r6(a)} as p_text, {r6(b)} as p_trees, {r6(mix)} as p, {r6(f'1 / (1 + exp(-0.8 * {logit(mix)}))')} as p_shrunk from {scores}"


def output_sql(e: Dialect, wanted: str, blended: str) -> str:
    """Every wanted response once, its score clipped by 1e-6, 0.5 where there is none."""
    return f"select t.response_id, {r6('greatest(1e-6, least(1 - 1e-6, coalesce(s.p, 0.5)))')} as probability from {wanted} t left join {blended} s on t.response_id = s.response_id"


#: Left edges of the ten bins of the calibration error, as computers count tenths.
EDGES = [i * 0.1 for i in range(10)]


def metrics(pred: DataFrame) -> DataFrame:
    """n, base_rate, mean_pred, log_loss, brier, ece, auc of rows (p, y), nulls left out; auc is null for one class.

    AUC is from ranks with ties averaged: rows are summed by p first, and running counts go by blocks of p.
    """
    d = pred.where("p is not null and y is not null").select(F.col("p").cast("double").alias("p"), F.col("y").cast("int").alias("y"))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    b = sum((F.when(F.col("p") >= x, 1).otherwise(0) for x in EDGES[1:]), F.lit(0))
    bins = d.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    ece = bins.agg((F.sum(F.col("c") * F.abs(F.col("mp") - F.col("my"))) / F.sum("c")).alias("ece"))
    flat = d.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"), F.avg("p").alias("mean_pred"), F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"))
    by_p = d.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("pos")).withColumn("one", F.lit(1)).withColumn("blk", F.floor(F.col("p") * 4096))
    ranked = running_sum(by_p, "one", "blk", ["p"], "c", "upto")
    auc = ranked.agg(F.sum(F.col("pos") * (F.col("upto") - (F.col("c") - 1) / 2)).alias("r"), F.sum("pos").alias("np"), F.sum("c").alias("nn"))
    auc = auc.select(F.when((F.col("np") > 0) & (F.col("np") < F.col("nn")), (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * (F.col("nn") - F.col("np")))).alias("auc"))
    out = flat.crossJoin(ece).crossJoin(auc)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("base_rate", "mean_pred", "log_loss", "brier", "ece", "auc")])


def metrics_duck(pred: str) -> str:
    bins = " + ".join(f"case when p >= {x!r} then 1 else 0 end" for x in EDGES[1:])
    return f"""with d as (select p, y from ({pred}) x where p is not null and y is not null), q as (select *, greatest(1e-6, least(1 - 1e-6, p)) as q from d),
b as (select {bins} as b, count(*) as c, avg(p) as mp, avg(y) as my from d group by 1), r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from d)
select count(*) as n, round(avg(y), 6) as base_rate, round(avg(p), 6) as mean_pred, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss, round(avg((p - y) ** 2), 6) as brier, (select round(sum(c * abs(mp - my)) / sum(c), 6) from b) as ece,
 (select round(case when sum(y) > 0 and sum(y) < count(*) then (sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) end, 6) from r) as auc from q"""


def fit_platt(pred: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """a and b of sigmoid(a * logit(p) + b) by Newton's method; each round is one aggregate over the rows (p, y)."""
    d = pred.where("p is not null and y is not null").select(F.expr(logit("p")).alias("z"), F.col("y").cast("double").alias("y"))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        s = 1 / (1 + F.exp(-(a * F.col("z") + b)))
        g, w = F.col("y") - s, s * (1 - s)
        r = d.agg(*[F.sum(x).alias(k) for k, x in {"ga": g * F.col("z"), "gb": g, "aa": w * F.col("z") * F.col("z"), "ab": w * F.col("z"), "bb": w}.items()]).first()
        if r.ga is None or abs(det := (r.aa + 1e-6) * (r.bb + 1e-6) - r.ab**2) < 1e-12:
            break
        da, db = ((r.bb + 1e-6) * r.ga - r.ab * r.gb) / det, ((r.aa + 1e-6) * r.gb - r.ab * r.ga) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def recentre(pred: DataFrame, target: float, tolerance: float = 1e-9) -> float:
    """The shift of logits that brings the mean of p to target, by bisection in [-15, 15]; one aggregate a step."""
    d = pred.where("p is not null").select(F.expr(logit("p")).alias("z"))
    lo, hi = -15.0, 15.0
    while hi - lo > tolerance:
        steps = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
        means = d.agg(*[F.avg(1 / (1 + F.exp(-(F.col("z") + s)))).alias(f"m{i}") for i, s in enumerate(steps)]).first()
        if means[0] is None:
            return 0.0
        below = [s for s, m in zip(steps, means) if m < target]
        lo, hi = (below[-1] if below else lo), (next((s for s, m in zip(steps, means) if m >= target), hi))
    return (lo + hi) / 2
