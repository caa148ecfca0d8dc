from itertools import groupby

from chalkstream.llm.turns import speaker_turns


def test_turns_over_blocks(spark):
    """A turn goes on over the end of a block, over whole blocks, and over blocks without words."""
    said = [(i, "tutor" if i < 4000 or i == 9000 else "student") for i in range(1, 13500) if not 21000 < i * 2 < 25000]
    said += [(i, "tutor" if i % 3 else "student") for i in range(13500, 17000)] + [(30000, "student"), (30001, None), (30002, "student")]
    rows = [("s", i, r, f"w{i}", None) for i, r in said] + [("t", 4095, "tutor", "a", None), ("t", 4096, "student", "b", None), ("t", 8192, "student", "c", None)]
    got = speaker_turns(spark.createDataFrame(rows, "session_id string, utterance_id long, role string, content string, ts string")).collect()
    want = []
    for r, group in groupby([x for x in said if x[1]], key=lambda x: x[1]):
        ids = [i for i, _ in group]
        want.append((r, " ".join(f"w{i}" for i in ids), ids[0], ids[-1], len(ids)))
    assert [(r.role, r.text, r.first_id, r.last_id, r.n_segments) for r in sorted(got, key=lambda r: r.turn) if r.session_id == "s"] == want
    assert [(r.turn, r.role, r.text) for r in sorted(got, key=lambda r: r.turn) if r.session_id == "t"] == [(1, "tutor", "a"), (2, "student", "b c")]
