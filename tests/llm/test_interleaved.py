"""Channels planted in one session, with known parents."""

import random

import pytest

from chalkstream.llm.conversations import conversations, reply_links, session_verdicts

ROWS = "session_id string, utterance_id long, role string, content string, ts string"
TOPICS = ["fractions denominators numerators equivalent simplify", "triangles angles parallel degrees vertices", "median probability histogram outcomes frequency"]


def planted(seed, n=240, at=1):
    """Messages of up to three channels, each message answering the one before it in its channel: rows and parents."""
    r = random.Random(seed)
    rows, parents, last, now = [], {}, {}, 0
    for i in range(n):
        k = r.randrange(3)
        now += r.randrange(2, 9)
        prev = last.get(k)
        role = r.choice(["tutor", "student"]) if prev is None else "student" if prev[1] == "tutor" else "tutor"
        echo = r.sample(prev[2], 2) if prev else []
        own = r.sample(TOPICS[k].split(), 2)
        text = f"so the {' and '.join(dict.fromkeys(echo + own))} here" + ("?" if role == "tutor" else "")
        rows.append(("s", at + i, role, text, f"{now // 3600:02}:{now // 60 % 60:02}:{now % 60:02}"))
        if prev:
            parents[at + i] = prev[0]
        last[k] = (at + i, role, list(dict.fromkeys(echo + own)))
    return rows, parents


def test_interleaved_channels(spark):
    """At least 0.9 of the messages are linked to the message they answer, over the ends of blocks as well."""
    for at in (1, 4096 - 100):
        rows, parents = planted(4, at=at)
        got = {x.pos: x.parent_pos for x in reply_links(spark.createDataFrame(rows, ROWS)).collect()}
        assert sum(got[k] == v for k, v in parents.items()) / len(parents) >= 0.9


@pytest.mark.parametrize("n", [60])
def test_trees_follow_links(spark, n):
    rows, _ = planted(2, n, at=4096 - n // 2)
    df = spark.createDataFrame(rows * 2, ROWS)
    parent = {x.pos: x.parent_pos for x in reply_links(df).collect()}

    def root(p):
        return p if parent[p] is None else root(parent[p])

    got = {x.place: x for x in conversations(df, df.select("session_id")).collect()}
    assert {p: x.conversation for p, x in got.items()} == {p: root(p) for p in parent}
    assert {p: x.content for p, x in got.items()} == {u: c for _, u, _, c, _ in rows}


def test_verdicts_come_from_links(spark):
    """A session whose links never cross is dropped only if one speaks alone; crossing links keep it."""
    df = spark.createDataFrame([("a", 1, "tutor", "hello", None), ("a", 2, "tutor", "anyone", None), ("b", 1, "tutor", "fractions", None), ("b", 2, "student", "fractions", None)], ROWS)
    links = reply_links(df)
    assert {x.session_id: x.reason for x in session_verdicts(links, df.select("session_id").limit(0)).collect()} == {"a": "no_reply", "b": None}
    assert {x.session_id: x.n_replies for x in session_verdicts(links, df.select("session_id").limit(0)).collect()} == {"a": 0, "b": 1}
