"""Rows whose answer lies far away, in other blocks too, against plain loops over a session."""

import bisect
import re

import pytest
from pyspark.sql import functions as F

from chalkstream.functions import lexicons as L
from chalkstream.functions.dialect import run
from chalkstream.functions.scan import with_halo
from chalkstream.operators import objectives, profiles
from chalkstream.operators import sequences as seq


def framed(spark, said):
    """Frame of utterances from (role, content) of one session."""
    rows = spark.createDataFrame([("s", i, r, c, None, len(said)) for i, (r, c) in enumerate(said)], "session_id string, i long, role string, content string, secs_loose double, n long")
    return with_halo(rows.withColumn("secs", F.col("secs_loose")).repartition(4))


@pytest.fixture(scope="module")
def long_talk():
    """Runs of one speaker of 1 to 9,000 rows, so that whole blocks hold one role."""
    said, k = [], 0
    for role, n in [("background", 3), ("student", 70), ("tutor", 1), ("student", 4000), ("background", 100), ("student", 1), ("tutor", 90), ("student", 9000), ("tutor", 200), ("student", 2), ("", 4200), ("tutor", 1), ("student", 80)]:
        for _ in range(n):
            said.append((role, f"{role} {k}"))
            k += 1
    return said


def test_neighbours_however_far(spark, long_talk):
    last, want = {"tutor": "", "student": ""}, []
    for role, content in long_talk:
        want.append([last[{"student": "tutor", "tutor": "student"}[role]] if role in last else "", ""])
        if role in last:
            last[role] = content
    after = ""
    for k in range(len(long_talk) - 1, -1, -1):
        want[k][1] = after
        if long_talk[k][0] == "tutor":
            after = long_talk[k][1]
    got = run(seq.neighbours_own_sql, near=run(seq.neighbours_sql, utt=framed(spark, long_talk))).orderBy("i").collect()
    assert [[r.other_before, r.tutor_after] for r in got] == want


@pytest.mark.parametrize("gap", [70, 4300, 9000])
def test_interactions_however_far(spark, gap):
    # every attempt is confirmed, and the question answered at length, beyond a run of other rows
    said = [("tutor", "what do you think?"), *[("background", "noise")] * gap, ("student", "i think that it must be 12"), *[("", "")] * gap, ("tutor", "exactly"), *[("background", "noise")] * gap]
    got = run(seq.interactions_sql, utt=framed(spark, said)).first()
    assert (got.answer_confirmed_rate, got.funnel_rate) == (1.0, 1.0)
    said[gap + 1] = ("student", "ok")
    assert run(seq.interactions_sql, utt=framed(spark, said)).first().funnel_rate == 0.0


def test_pauses_however_far(spark):
    n = 9000
    utt = framed(spark, [("student", "yes"), ("tutor", "no"), *[("background", "")] * n, ("student", "so")])
    at = F.when(F.col("i") == 0, 10.0).when(F.col("i") == 1, 30.0).when(F.col("i") == n + 2, 100.0)
    got = profiles.session_profile(utt.withColumn("secs_loose", at)).first()
    assert (got.avg_pause_secs, got.n_long_pauses, got.avg_student_pause_secs) == (45.0, 1, 90.0)


def test_keywords_within_twenty_words(spark):
    """Words are counted over the joined transcript: in rows before and after, over blocks, and not far off in one row."""
    filler = lambda n: " ".join(["blah"] * n)
    said = [("tutor", "we saw fractions"), *[("student", "")] * 4094, ("tutor", filler(19)), ("tutor", "Last week"), ("student", f"{filler(18)} decimals ratios"), ("tutor", f"{filler(90)} angles {filler(25)} the previous session {filler(18)} symmetry percentages")]
    said.append(("tutor", f"{filler(25)} blast time then last time"))
    words = re.findall(r"\w+", "\n".join(c for _, c in said).lower())
    starts = [m.start() for m in re.finditer(r"\w+", "\n".join(c for _, c in said))]
    places = [bisect.bisect_left(starts, m.start()) for m in re.finditer(L.PATTERNS["prior_session"], "\n".join(c for _, c in said).lower())]
    keys = ["fractions", "decimals", "ratios", "angles", "symmetry", "percentages", "saw", "nothing", ""]
    want = {k: int(any(k in words[max(0, p - 20) : p + 21] for p in places)) for k in keys}
    assert sum(want.values()) == 3
    resp = spark.createDataFrame([(k or "none", "s", "x", k) for k in keys] + [("other", "t", "x", "decimals")], "response_id string, session_id string, lo_id string, lo_text string")
    got = {r.response_id: r.histpos_prior_lo for r in run(objectives.history_sql, utt=objectives.with_offsets(framed(spark, said)), resp=resp).collect()}
    assert got == {k or "none": v for k, v in want.items()} | {"other": None}  # whose session has no transcript
