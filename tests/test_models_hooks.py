import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkstream.operators import hooks, integrity, models
from chalkstream.streaming import events


def test_out_of_fold_text_model(spark):
    rows = spark.createDataFrame([(f"r{i}", "add fractions" if i % 2 else "draw a chart", f"o{i % 5}", i % 2, i % 3) for i in range(90)], "response_id string, lo_text string, lo_id string, y int, fold int")
    got = models.out_of_fold(rows, models.text_pipeline(), 3)
    assert got.count() == 90 and got.where("(p > 0.5) <> (y = 1)").count() == 0
    assert models.seed_summary(rows, models.text_pipeline(), 3, 1).first().auc > 0.9


def test_learned_difficulty_and_heads(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, [float(x) for x in v], float(0.5 + 0.1 * v[0]), 20) for i, v in enumerate(m)], "id long, emb array<double>, rate double, n int")
    got = models.learned_difficulty(rows, 0.5, 1.0)
    assert got.agg(F.max(F.abs("resid"))).first()[0] < 0.05
    assert {r.diff for r in models.learned_difficulty(rows.limit(5), 0.4).collect()} == {0.4}
    texts = spark.createDataFrame([("a", "why why not"), ("b", "")], "k string, t string")
    p = {(r.k, r.code): round(r.p, 4) for r in models.linear_heads(texts, "k", "t", spark.createDataFrame([("A", "why", 2.0)], "code string, term string, w double"), spark.createDataFrame([("A", -1.0), ("B", 0.0)], "code string, b double")).collect()}
    assert p == {("a", "A"): 0.7311, ("b", "A"): 0.2689, ("a", "B"): 0.5, ("b", "B"): 0.5}


def test_hooks(spark):
    rows = spark.createDataFrame([(f"k{i}", "x" * i) for i in range(20)] + [("none", None)], "k string, t string")
    got = {r.k: r.p for r in hooks.scored(rows, "k", "t", lambda: lambda texts: [float(len(x)) for x in texts]).collect()}
    assert got == {f"k{i}": float(i) for i in range(20)} | {"none": 0.0}
    answers = hooks.generated(rows, "k", "t", lambda: lambda texts: ['{"ok": true}' if len(t) > 3 else "no" for t in texts], "ok boolean")
    assert answers.where("answer.ok").count() == 16
    with pytest.raises(RuntimeError):
        hooks.guard_failures(answers.where("length(raw) < 5"), 0.2)
    s = spark.createDataFrame([("x",)], "k string").select(hooks.stub_score(F.col("k"))).first()[0]
    assert abs(s - (0.35 + 0.55 * int(hashlib.md5(b"x").hexdigest()[:8], 16) / 0xFFFFFFFF)) < 1e-12


def test_records_prompts_and_selection(spark):
    arc = spark.createDataFrame([("s", (2, 1, "resolved", "student", False, True)), ("t", None)], "session_id string, answer struct<confusion_count:int,resolution_count:int,final_state:string,resolution_agent:string,misconception_present:boolean,misconception_resolved:boolean>")
    r = {x.session_id: x for x in hooks.arc_columns(arc).collect()}
    assert (r["s"].arc_resolution_rate, r["s"].arc_student_led, r["s"].misconception_resolved) == (0.5, 1, None) and r["t"].arc_confusion_count is None
    rub = spark.createDataFrame([("s", (True, None))], "session_id string, answer struct<a:boolean,b:boolean>")
    assert hooks.rubric_columns(rub, ("a", "b")).first()[1:] == (1, 0)
    turns = spark.createDataFrame([("s", i, "w" * 50) for i in range(100)], "session_id string, i int, content string")
    p = hooks.prompts(turns, "sys", budget=300).first().prompt
    assert p.startswith("sys\n\nutterance_id=") and p.endswith("utterance_id=99: " + "w" * 50) and len(p) < 1100
    vec = spark.createDataFrame([("s", i, 6, [1.0, float(i)], [1.0, 0.0]) for i in range(6)], "session_id string, i int, n int, emb array<double>, query array<double>")
    assert sorted(x.i for x in hooks.similar_turns(vec, k_most=3).collect()) == [0, 1, 2]


def test_integrity(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "m").write_text(f"{hashlib.sha256(b'x').hexdigest()}  a\n")
    assert integrity.verify_manifest(str(tmp_path / "m"), str(tmp_path)) == []
    (tmp_path / "a").write_text("y")
    with pytest.raises(RuntimeError):
        integrity.verify_manifest(str(tmp_path / "m"), str(tmp_path))
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    assert integrity.frozen_hash(a, "k", "v") == integrity.frozen_hash(a.orderBy(F.desc("k")), "k", "v") != integrity.frozen_hash(a.limit(1), "k", "v")
    with pytest.raises(ValueError):
        integrity.require_columns(a, ["k", "z"], "block")
    with pytest.raises(PermissionError):
        integrity.Provenance("c", "cc-by-nc").check()
    with pytest.raises(ValueError):
        integrity.Provenance("c", "?").check()
    text = integrity.column_catalogue({"block": a})
    assert "| k | block | other |" in text and integrity.column_catalogue({"block": a}, text) == text
    with pytest.raises(ValueError):
        integrity.column_catalogue({"block": a}, "old")
    with integrity.step("nothing"):
        pass
    moved = integrity.shuffled(spark.range(300).withColumnRenamed("id", "k"), "k", 3).collect()
    assert sorted(r.k for r in moved) == sorted(r.other for r in moved) == list(range(300)) and any(r.k != r.other for r in moved)


def test_streams(spark, tmp_path):
    rows = [(i, f"2031-01-01 00:{i % 60:02}:00", i % 2, "error" if i % 7 == 0 else "purchase" if i % 11 == 0 else "view", 1.0, None) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    for name, out, mode in (("visits", events.visits(stream), "append"), ("rates", events.window_rates(stream), "append"), ("impasses", events.impasses(stream), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.user_id: r for r in spark.table("impasses").collect()}
    for u in (0, 1):
        own = df.where(F.col("user_id") == u).orderBy("ts", "event_id").toPandas().event_type
        until, at, ep = -1, 0, 0
        for n, k in enumerate(own):
            now = n <= until
            at += now
            if k == "error":
                ep += not now
                until = max(until, n + 10)
            elif k == "purchase":
                until = n - 1
        assert (got[u].n, got[u].at_impasse, got[u].episodes) == (60, at, ep)
