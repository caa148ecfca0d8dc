import random

from pyspark.sql import functions as F

from chalkstream.llm.components import assign_splits, linked_records, stars
from chalkstream.llm.conversations import clean_role, conversations, reply_links, session_verdicts

ROWS = "session_id string, utterance_id long, role string, content string, ts string"


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_stars_find_components(spark):
    r = random.Random(3)
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [(f"m{r.randrange(60):02}", f"m{r.randrange(60):02}") for _ in range(40)] + [("hub", f"h{i}") for i in range(50)]
    got = {x.node: x.root for x in stars(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items() if k != v}


def test_linked_records_and_splits(spark):
    r = random.Random(5)
    rows = [(f"r{i:03}", f"s{r.randrange(90)}" if i % 9 else None, f"o{r.randrange(60)}" if i % 4 else None) for i in range(150)] + [("r000", "s1", None), ("r001", "s1", "o2"), (None, "s1", "o1"), ("lone", None, None)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "id string, s string, o string").withColumn("group_id", F.lit("clash"))
    got = {x.id: x for x in linked_records(df, "id", [F.col("s"), F.col("o")]).collect()}
    links = [(i, i) for i, _, _ in rows if i] + [(i, p + v) for i, s, o in rows if i for p, v in (("~s", s), ("~o", o)) if v]
    root = union_find(links)
    want = {}
    for i in {i for i, _, _ in rows if i}:
        want.setdefault(root[i], []).append(i)
    assert {k: x.group_id for k, x in got.items()} == {i: min(g) for g in want.values() for i in g}
    assert got["lone"].n_records == 1
    split = assign_splits(linked_records(df, "id", [F.col("s"), F.col("o")]), [("train", 0.8), ("test", 0.2)])
    assert split.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert linked_records(df.limit(0), "id", [F.col("s"), F.col("o")]).count() == 0


def test_session_verdicts(spark):
    rows = (
        [("ok", i, "tutor" if i % 2 else " PUPIL ", f"line {i}", f"00:00:{i:02}") for i in range(1, 9)] * 2
        + [("gap", 1, "tutor", "a", None), ("gap", 3, "stu", "b", None)]
        + [("torn", 1, "tutor", "a", "x"), ("torn", 1, "tutor", None, "x"), ("torn", 2, "student", "b", "x")]
        + [("alone", 1, "tutor", "a", None), ("alone", 2, "student", " \t\xa0", None)]
        + [("blank", 1, "tutor", "", None), ("blank", 2, None, "words", None)]
        + [("loose", None, "student", "a", None), ("loose", 5, "T", "b", None), (None, 1, "tutor", "x", None)]
        + [("hot", i, "tutor" if i < 9000 else "student", "word", None) for i in range(10000)]
    )
    df, named = spark.createDataFrame(rows, ROWS), spark.createDataFrame([("ok",), ("gone",), (None,)], "session_id string")
    got = {r.session_id: r.reason for r in session_verdicts(reply_links(df), named).collect()}
    assert got == {"ok": None, "gap": "broken", "torn": "broken", "alone": "no_reply", "blank": "empty", "loose": None, "gone": "missing", "hot": None}
    built = conversations(df, named).collect()
    assert {r.session_id for r in built} == {"ok", "loose", "hot"}
    ok = sorted((r.place, r.content) for r in built if r.session_id == "ok")
    assert ok == [(i, f"line {i}") for i in range(1, 9)]
    # carried over blocks of 4,096: the first student message answers the last tutor message before it
    assert next(r.reply_to for r in built if r.session_id == "hot" and r.place == 9000) == 8999
    assert session_verdicts(reply_links(df.limit(0)), named.limit(0)).count() == 0


def test_roles(spark):
    df = spark.createDataFrame([(x,) for x in ("Tutor ", "tutr", "S", "learner", "BG", "parent", "", None)], "role string")
    assert [r[0] for r in df.select(clean_role(F.col("role"))).collect()] == ["tutor", "tutor", "student", "student", "background", "other", None, None]
