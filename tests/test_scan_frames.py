import random

import pytest
from pyspark.sql import functions as F

from chalkstream.functions.keys import is_blank, linkable_id, norm_id, whole_number
from chalkstream.functions.scan import numbered, running_max, running_sum, with_halo
from chalkstream.functions.text import overlap, seconds, words
from chalkstream.operators import frames, sequences
from chalkstream.functions.dialect import run
from chalkstream.session import cut, uncut


def test_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("s1", " S1\t", "\xa0s1\n", "unk ", "", None, "a b")], "x string")
    assert [r[0] for r in df.select(norm_id("x")).collect()] == ["S1", "S1", "S1", "UNK", "", None, "A B"]
    assert [r[0] for r in df.select(linkable_id("x")).collect()] == ["S1", "S1", "S1", None, None, None, "A B"]


def test_whole_numbers(spark):
    cases = {"7": 7, " 007 ": 7, "7.0": 7, "-3": -3, "7.5": None, "x": None, "": None, "1e3": None, "NaN": None, "9" * 30: None, "5d": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert [r[0] for r in df.select(whole_number("x")).collect()] == list(cases.values())


def test_blank_seconds_words(spark):
    df = spark.createDataFrame([("",), (" \t \xa0",), (None,), ("x ",)], "x string")
    assert [r[0] for r in df.select(is_blank("x")).collect()] == [True, True, True, False]
    t = spark.createDataFrame([("00:01:02",), ("1:2",), ("00:01:02:03",), ("aa:bb:cc",), (None,)], "x string")
    assert [r[0] for r in t.select(seconds(F.col("x"))).collect()] == [62, None, None, None, None]
    w = spark.createDataFrame([("The Über cat", "the cat")], "a string, b string")
    assert w.select(words(F.col("a"), 4), overlap(words(F.col("a")), words(F.col("b")))).first()[:] == (["über"], 2 / 3)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_scans_equal_plain_loops(spark, n):
    r = random.Random(n)
    rows = [(g, i, r.choice([None, r.randrange(100)])) for g in "ab" for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, v long").withColumn("b", F.floor(F.col("k") / 700))
    out = running_sum(running_max(numbered(df, "g", "b", ["k"]), "g", "b", ["k"], "v", "m"), "g", "b", ["k"], "v", "s").collect()
    assert len(out) == len(rows)
    for g in "ab":
        best, total = None, None
        for x in sorted((x for x in out if x.g == g), key=lambda x: x.k):
            if x.v is not None:
                best, total = (x.v if best is None else max(best, x.v)), (total or 0) + x.v
            assert (x.i, x.n, x.m) == (x.k, n, best) and (x.s or 0) == (total or 0)


def test_halo_makes_bounded_frames_exact(spark):
    df = spark.createDataFrame([("s", i) for i in range(9000)], "session_id string, i long")
    h = with_halo(df)
    assert h.where("own").count() == 9000
    near = h.selectExpr("*", "lag(i, 60) over (partition by session_id, blk order by i) as a", "lead(i, 60) over (partition by session_id, blk order by i) as z").where("own")
    assert near.where("(i >= 60 and a <> i - 60) or (i >= 60 and a is null) or (i < 8940 and (z is null or z <> i + 60))").count() == 0


def test_cut_keeps_rows(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    uncut(df)


def _utt(spark, rows):
    df = spark.createDataFrame([("s", i, r, c, None, None, i, len(rows)) for i, (r, c) in enumerate(rows)], "session_id string, utterance_id long, role string, content string, secs double, secs_loose double, i long, n long")
    return with_halo(df)


def test_turns(spark):
    said = frames.talk(_utt(spark, [("tutor", "a"), ("tutor", "b"), ("background", "z"), ("student", " "), ("student", "c"), ("student", "d"), ("tutor", "e")]))
    got = frames.turns(said).where("own").collect()
    assert [(t.turn, t.teacher, t.student, t.i, t.n) for t in got] == [(1, "a b", "c d", 0, 1)]
    first = frames.turns(frames.talk(_utt(spark, [("student", "x"), ("tutor", "y"), ("student", "z")]))).where("own").orderBy("turn").collect()
    assert [(t.turn, t.teacher, t.student) for t in first] == [(0, "", "x"), (1, "y", "z")]
    assert frames.turns(frames.talk(_utt(spark, [("tutor", "only")]))).count() == 0


def impasse_by_hand(rows, expiry=10):
    """The state machine itself, row by row."""
    until, out = -1, []
    for i, (role, event) in enumerate(rows):
        out.append(i <= until)
        if role == "student" and event == "c":
            until = max(until, i + expiry)
        elif role == "student" and event == "r":
            until = i - 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_impasse_equals_the_state_machine(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["student", "tutor"]), r.choice(["c", "r", "", "", "", ""])) for _ in range(300)]
    text = {"c": "i'm lost", "r": "got it", "": "so it is blue"}
    got = run(sequences.impasse_sql, talk=frames.talk(_utt(spark, [(a, text[b]) for a, b in rows]))).first()
    states = impasse_by_hand(rows)
    tutor = [s for (a, _), s in zip(rows, states) if a == "tutor"]
    assert abs(got.ctg_imp_share - sum(tutor) / len(tutor)) < 1e-6 and abs(got.ctg_imp_utt_share - sum(states) / 300) < 1e-6
    assert abs(got.ctg_episodes_per_utt - sum(a == "student" and b == "c" and not s for (a, b), s in zip(rows, states)) / 300) < 1e-6


def test_row_order_does_not_matter(spark):
    rows = [("s", str(i), r, f"why is {i} so?", f"00:00:{i:02}") for i, r in enumerate(["tutor", "student"] * 10)]
    random.Random(1).shuffle(rows)
    a = spark.createDataFrame(rows, "session_id string, utterance_id string, role string, content string, ts string")
    assert a.count() == 20
