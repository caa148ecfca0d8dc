import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkstream.functions import lexicons as L
from chalkstream.functions.dialect import DUCK, SPARK
from chalkstream.operators import difficulty, scoring, texts
from chalkstream.plans import registry
from chalkstream.sources import tables

SEEN = {
    "praise": ("That's right, well done", "that is fine"), "feedback_incorrect": ("not quite there", "quite so"), "backchannel": ("  Okay. ", "okay let me explain"), "prompt_explanation": ("why?", "the why of it"), "prompt_next_step": ("and then?", "then we go"),
    "prompt_self_correction": ("are you sure?", "surely"), "prompt_representation": ("draw a picture", "a drawing"), "hint": ("remember that", "clue: look"), "example": ("for example", "like a cat"), "procedural": ("first you add", "step one: do"), "conceptual": ("that's why", "mathematically, we"),
    "prior_knowledge": ("remember this", "remembering"), "gives_answer": ("the answer is 5", "which gives 12"), "bare_answer": ("x = 2", "6 apples"), "tag_question": ("so bright?", "so bright"), "student_explains": ("because it is", "becoming"), "confusion": ("i'm lost", "i am confused"), "resolution": ("got it", "get it done"),
    "self_explanation": ("that means", "meaning"), "hedge": ("maybe", "may be"), "elicit": ("how so", "however"), "tell": ("you just add", "justice"), "confirm": ("exactly", "exacting"), "corrective": ("try again", "trying"), "maths": ("5", "blue"), "deep_question": ("why", "whyever"), "shallow_question": ("is it red", "isit"), "states_answer": ("it equals", "equal"),
    "check_understanding": ("makes sense", "sensible"), "verdict_positive": ("spot on", "spotty"), "verdict_negative": ("nope", "noped"), "first_session": ("first lesson", "lesson one"), "prior_session": ("last week", "lastly"), "unclear": ("so [unclear]", "unclear"), "tutor_placeholder": ("[TUTOR_NAME]", "tutor name"),
}


def test_every_lexicon_on_a_hit_and_a_near_miss(spark):
    assert SEEN.keys() == L.PATTERNS.keys()
    rows = spark.createDataFrame([(k, i, t) for k, pair in SEEN.items() for i, t in enumerate(pair)], "name string, kind int, text string")
    for name in SEEN:
        hits = rows.where(F.col("name") == name).where(F.expr(SPARK.has("text", name))).collect()
        assert [r.kind for r in hits] == [0], name


def test_dialects_quote():
    assert DUCK.text("it's") == "'it''s'" and SPARK.text(r"\d") == r'r"\d"'


def test_stems_match_at_word_starts_only():
    p = re.compile(L.stems("ratio;y=mx;tens to"))
    assert p.search("a ratio of") and p.search("y=mx+c") and not p.search("operations") and p.search("tens to ones")


def test_greedy_plan_equals_the_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = [int(s) for s in rng.integers(1, 9, rng.integers(1, 60))]
        k = int(rng.integers(2, 6))
        load = [0] * k
        want = []
        for s in sorted(sizes, reverse=True):
            j = min(range(k), key=lambda q: (load[q], q))
            load[j] += s
            want.append((s, j))
        plan = {s: (a, c) for s, a, c in difficulty.greedy_plan([(s, sizes.count(s)) for s in set(sizes)], k)}
        got = []
        for s in sorted(set(sizes), reverse=True):
            a, c = plan[s]
            got += [(s, a[i] if i < len(a) else c[(i - len(a)) % k]) for i in range(sizes.count(s))]
        assert got == want


def test_greedy_folds_are_balanced(spark):
    rows = spark.createDataFrame([(f"g{i}",) for i in range(200) for _ in range(1 + i % 7)], "g string")
    got = difficulty.greedy_folds(rows, "g", 4).groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 4 and max(r.n for r in got) - min(r.n for r in got) <= 7
    assert difficulty.greedy_folds(rows.limit(0), "g").count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(120, 8))
    m[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v], float(i % 2)) for i, v in enumerate(m)] + [(999, None, 1.0)], "id long, emb array<double>, y double")
    got = {}
    for r in difficulty.nearest(rows, rows.where("id % 10 = 0"), k=5, block=4).collect():
        got.setdefault(r.query, []).append((r.rk, r.id))
    n = np.linalg.norm(m, axis=1)
    for q in range(0, 120, 10):
        cos = np.array([m[q] @ m[i] / (n[q] * n[i]) if n[i] and i != q else -9 for i in range(120)])
        assert [i for _, i in sorted(got[q])] == list(np.argsort(-np.round(cos, 12), kind="stable")[:5])


def test_metrics_of_ties_edges_and_one_class(spark):
    p = [0.0, 0.1, 0.3, 0.3, 0.6, 0.7, 1.0]
    y = [0, 0, 1, 0, 1, 1, 1]
    got = scoring.metrics(spark.createDataFrame(list(zip(p, y)), "p double, y int")).first()
    pairs = [(a, b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    assert abs(got.auc - sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)) < 1e-6
    assert scoring.metrics(spark.createDataFrame([(0.4, 1)], "p double, y int")).first().auc is None


def test_platt_and_recentring(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * z + 0.4)))).astype(int)
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(z, y)], "p double, y int")
    a, b = scoring.fit_platt(df)
    assert abs(a - 0.7) < 0.12 and abs(b - 0.4) < 0.12
    s = scoring.recentre(df, 0.6)
    assert abs(np.mean(1 / (1 + np.exp(-(z + s)))) - 0.6) < 1e-4


def test_matching_blocks_ratio(spark):
    got = {r.v: (r.entry, r.ratio) for r in texts.best_ratio(spark.createDataFrame([("add fractions",), ("ad fractions",), ("zebra",), (None,)], "v string"), "v", ["add fractions", "add decimals"]).collect()}
    assert got == {"add fractions": ("add fractions", 1.0), "ad fractions": ("add fractions", 0.96), "zebra": (None, None)}


@pytest.mark.parametrize(
    "text,want",
    [
        ('[{"utterance_id": 3, "code": "A"}, {"label": "B"}]', [(3, "A"), (8, "B")]), ('{"codes": ["A", "B", "C"]}', [(7, "A"), (8, "B"), (-1, "C")]), ('{"utterance_id": "x", "code": "A"}', [(7, "A")]),
        ('{"5": "A", "note": "B"}', [(5, "A")]), ('{"a": {"code": "A"}}', [(7, "A")]), ("not json", []), ("5", []), (None, []),
    ],
)
def test_answers_in_any_shape(text, want):
    assert texts.parsed_codes(text, [7, 8]) == want


def test_annotator_codes_and_sentences(spark):
    df = spark.createDataFrame([('["A"]', [4]), (None, None)], "t string, ids array<long>")
    assert [[(c.utterance_id, c.code) for c in r.codes] for r in texts.annotator_codes(df, "t", "ids").collect()] == [[(4, "A")], []]
    s = spark.createDataFrame([(["Yes", "Yes", "", "Why?", "ok"],), ([],)], "x array<string>")
    assert [r[0] for r in s.select(texts.joined_sentences(F.col("x"))).collect()] == ["Yes. Why? ok.", ""]


def test_packing(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([3, 4, 9, 1, 2, 50, 1])], "g string, i long, n long")
    assert [r.batch for r in texts.packed(rows, "g", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3, 4]
    assert sorted(r.i for r in texts.dropped_longest(rows, "g", "i", "n", 12).collect()) == [0, 1, 3, 4, 6]


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    body = "session_id,utterance_id,role,content,timestamp\nx,1,tutor,\"a, b\",00:00:01\nx,u,student,c,\n"
    (tmp_path / "t" / "s1.csv").write_text(body)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("in/s1.csv", body)
    for path in (tmp_path / "t", tmp_path / "t.zip"):
        got = tables.read_transcripts(spark, str(path)).orderBy("content").collect()
        assert [(r.session_id, r.utterance_id, r.content, r.timestamp) for r in got] == [("s1", 1.0, "a, b", "00:00:01"), ("s1", None, "c", None)]
    with pytest.raises(FileNotFoundError):
        tables.read_transcripts(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        tables.resolve(str(tmp_path), "q", ".csv")
    assert tables.resolve(str(tmp_path / "t"), "s", ".csv").endswith("s1.csv") and tables.largest(str(tmp_path / "t"), "*.csv").endswith("s1.csv")
    assert tables.optional(spark, str(tmp_path / "no.parquet"), "a int").count() == 0
    (tmp_path / "l.csv").write_text("response_id,is_correct\nr1,1.0\nr2,x\n")
    assert [r.is_correct for r in tables.read_labels(spark, str(tmp_path / "l.csv")).orderBy("response_id").collect()] == [1, None]
    ids = spark.createDataFrame([("r1",), ("r2",)], "response_id string")
    tables.write_scores(ids, spark.createDataFrame([("r1", 2.0)], "response_id string, probability double"), str(tmp_path / "out"))
    assert [(r.response_id, float(r.probability)) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("r1", 0.999999), ("r2", 0.5)]


def test_registry_names():
    names = registry.queries()
    assert set(registry.oracle_sql()) <= set(names) and len(names) > 40 and not any(re.match(r"(op|p)\d+_", n) for n in names)
