"""Connected components by alternating large-star and small-star, and splits that never part a component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkstream.session import cut, uncut


def large_star(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the least of its neighbourhood.

    edges: (u, v) distinct, u > v. The least neighbour is found by a pre-aggregated minimum and joined back, so a hot
    node's neighbours are never gathered; adaptive execution splits its partition of the join.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # the larger neighbours of a node u are the v of edges (v, u)
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of these. edges as above."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = least.select("u", F.col("m").alias("v"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(moved).where("u > v").distinct()


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v) that isn't its component's least node, which is root.

    Every round is written to the shared checkpoint folder and read again. It ends when no round changes the edges; the number of
    rounds grows as the logarithm of the longest path squared at worst, in practice four to eight.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null").distinct()
    now = cut(now)
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(*mark).first()
    for _ in range(most_rounds):
        last, now = now, cut(small_star(large_star(now)))
        uncut(last)
        after = now.agg(*mark).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def linked_records(rows: DataFrame, record: str, entities: list[Column]) -> DataFrame:
    """(record, component, group_id, n_records): records sharing any entity, also through others.

    entities are columns whose equal non-null values link records; values of different columns never meet. component
    is the hash-free name of the component's least entity, null for a record without any entity, which is a group of
    its own. group_id is the least record, as text, of the component and n_records their number.

    Null records are left out; a record in several rows counts once and links all their entities. An empty table gives
    no rows. Ties do not arise, since the least of distinct names is unique. Other columns of rows are ignored.

    The graph is over entities, not records: a record of two entities is an edge, and an edge that many records share
    is one, so a hot entity with a third of all rows costs one node. Records join their component last.
    """
    named = [F.when(e.isNotNull(), F.concat(F.lit(f"{i}|"), e.cast("string"))) for i, e in enumerate(entities)]
    seen = rows.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.array_compact(F.array(*named)).alias("e")).distinct()
    # all entities of a row are joined to its first; a record in several rows is a node itself, so that they meet
    several = seen.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record")
    again = seen.join(several, "record", "left_semi").select(F.explode("e").alias("u"), F.concat(F.lit("~|"), "record").alias("v"))
    within = seen.where(F.size("e") > 1).select(F.col("e")[0].alias("v"), F.explode(F.slice("e", 2, len(entities))).alias("u")).select("u", "v")
    root = stars(within.union(again).distinct())
    first = seen.select("record", F.get("e", F.lit(0)).alias("node")).groupBy("record").agg(F.min("node").alias("node"))
    placed = first.join(root, "node", "left").select("record", F.coalesce("root", "node").alias("component"))
    groups = placed.where("component is not null").groupBy("component").agg(F.min("record").alias("group_id"), F.count(F.lit(1)).alias("n_records"))
    out = placed.join(groups, "component", "left")
    return out.select("record", "component", F.coalesce("group_id", "record").alias("group_id"), F.coalesce("n_records", F.lit(1)).alias("n_records")).withColumnRenamed("record", record)


def hashed_share(key: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the key."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]], heavy: float = 0.01) -> DataFrame:
    """groups with a column split: all records of a group_id in one, the shares of targets met as well as can be.

    A group that holds at least the share heavy of all records is placed first: at most 1 / heavy such groups exist,
    and in falling order of size, then by name, each goes to the split with the most room left. All other groups go
    by the hash of group_id to ranges proportional to the room that is left, so a new group never moves an old one
    unless a heavy group does. Shares must be positive and are scaled to sum to 1. An empty table stays empty.
    """
    if not targets or any(not s > 0 for _, s in targets):
        raise ValueError("targets need a name and a positive share each")
    if not 0 < heavy <= 1:
        raise ValueError("heavy must be above 0 and at most 1")
    total = sum(s for _, s in targets)
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    room = {name: s / total * n for name, s in targets}
    placed: dict[str, str] = {}
    for row in sizes.where(F.col("n") >= max(1.0, heavy * n)).orderBy(F.desc("n"), "group_id").limit(int(1 / heavy) + 1).collect() if n else []:
        to = max(room, key=lambda k: room[k])
        placed[row.group_id] = to
        room[to] -= row.n
    left = {k: max(0.0, v) for k, v in room.items()}
    whole = sum(left.values()) or 1.0
    at, h, split = 0.0, hashed_share(F.col("group_id")), None
    for name, v in left.items():
        at += v / whole
        if v:
            split = F.when(h < at, name) if split is None else split.when(h < at, name)
    last = [k for k, v in left.items() if v] or [targets[0][0]]
    rest = F.lit(last[-1]) if split is None else split.otherwise(last[-1])
    fixed = reduce(lambda c, kv: c.when(F.col("group_id") == kv[0], kv[1]), list(placed.items())[1:], F.when(F.col("group_id") == next(iter(placed)), placed[next(iter(placed))])).otherwise(rest) if placed else rest
    return groups.withColumn("split", fixed)
