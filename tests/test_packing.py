"""Batch packing in blocks against the plain loop, and turn sizes against the turns themselves."""

import random

from pyspark.sql import functions as F

from chalkstream.operators import frames, texts
from chalkstream.plans import registry


def by_hand(sizes, budget):
    out, batch, used = [], 0, 0
    for size in sizes:
        if used == 0 or used + size <= budget:
            used += size
        else:
            batch, used = batch + 1, size
        out.append(batch)
    return out


def test_blocks_of_any_length_equal_the_plain_loop():
    rng = random.Random(7)
    for _ in range(3000):
        budget = rng.choice([0, 1, 5, 10])
        sizes = [rng.choice([0, 0, 1, 2, 3, 7, 10, 11, 40][: rng.randint(2, 9)]) for _ in range(rng.randint(1, 40))]
        ends = sorted({*rng.sample(range(1, len(sizes) + 1), rng.randint(1, min(6, len(sizes)))), len(sizes)})
        blocks = [sizes[a:b] for a, b in zip([0, *ends], ends)]
        entries = texts.block_entries([texts.block_exits(x, budget) for x in blocks], budget)
        got = [b for x, (batch, used) in zip(blocks, entries) for b in texts.block_batches(x, batch, used, budget)]
        assert got == by_hand(sizes, budget), (sizes, ends, budget)


def test_long_groups_are_packed_in_blocks_from_rows_computed_once(spark):
    rng, seen = random.Random(3), spark.sparkContext.accumulator(0)
    groups = {"long": [rng.choice([0, 1, 3, 8, 30, 90]) for _ in range(13_000)], "ones": [1] * 9000, "blank": [0] * 5000 + [99, 1], "short": [60, 60]}
    rows = [(g, i, n, f"{g}{i}") for g, sizes in groups.items() for i, n in enumerate(sizes)]

    @F.udf("long")
    def counted(n):
        seen.add(1)
        return n

    df = spark.createDataFrame([*rows, (None, 0, 1, "x"), ("short", None, 1, "y")], "g string, i long, n long, t string").repartition(3)
    got = texts.packed(df.withColumn("n", counted("n")), "g", "i", "n", 50).collect()
    assert seen.value <= len(rows) + 2
    assert sorted((r.g, r.i, r.n, r.t, r.batch) for r in got) == sorted((*row, b) for g, sizes in groups.items() for row, b in zip([r for r in rows if r[0] == g], by_hand(sizes, 50)))


def test_turn_sizes_are_those_of_the_turns(spark, tmp_path):
    rng, rows, at = random.Random(5), [], 0
    for session, runs in (("room", 700), ("a", 9), ("b", 1), ("c", 30)):
        at = 0
        for _ in range(runs):
            role = rng.choice(["tutor", " Student ", "student", "background", "TUTOR", None])
            for _ in range(rng.choice([1, 2, 3, 40]) if rng.random() < 0.98 else 4500):
                at += rng.choice([0, 1, 1, 1, 2])
                key = rng.choice([f"{at}", f" {at}.0", f"{at}", None if rng.random() < 0.2 else f"{at}", "x" if rng.random() < 0.2 else f"{at}"])
                row = (rng.choice([session, f"\t{session} ", session.upper()]), key, role, rng.choice(["", "  ", None, "a", " bc\n", "d e  f", "é" * 9]), rng.choice(["00:00:01", None, "00:01:00"]))
                rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [("students first", "1", "student", "x", None), ("tutor only", "1", "tutor", "x", None), (None, "1", "student", "x", None)]
    df = spark.createDataFrame(rows, "session_id string, utterance_id string, role string, content string, ts string")
    df.withColumn("ingested_at", F.current_timestamp()).repartition(3).write.parquet(f"{tmp_path}/test_transcripts.parquet")
    turns = frames.turns(frames.talk(frames.utterances(spark, str(tmp_path)))).where("own")
    want = sorted((r.session_id, r.i, r.size) for r in turns.selectExpr("session_id", "i", "length(teacher) + length(student) as size").collect())
    assert sorted((r.session_id, r.i, r.size) for r in frames.turn_sizes(spark, str(tmp_path)).collect()) == want

    sizes = {}
    for session, _, size in want:
        sizes.setdefault(session, []).append(size)
    got = registry.queries()["batch_packing"](spark, str(tmp_path)).collect()
    assert {r.session_id: (r.last_batch, r.n_turns) for r in got} == {s: (by_hand(x, 2000)[-1], len(x)) for s, x in sizes.items()}
