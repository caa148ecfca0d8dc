import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chalkstream.llm.leakage import leaked_items, myers, pieces, word_list
from chalkstream.llm.mixing import count_tokens, mix, rake, shares
from chalkstream.llm.quality import FEATURES, fitted_rules, text_kinds, text_statistics
from chalkstream.llm.rules import predict
from chalkstream.llm.samples import labelled
from chalkstream.llm.turns import cleaned, noise, speaker_turns

NOISE = {
    "[00:01:02] so it is 5": "stamp", "half of 28 00:00:32": "stamp", "{t=14s} yes": "stamp", "00:12:17,044 --> 00:12:17,999 no": "stamp", "01:13 - yes": "stamp", "@06:31 go": "stamp", "[04m33s] yes": "stamp",
    "Tutor: go on": "label", "TUTOR >> go": "label", "yes\n**Speaker 2**: right": "label", "S> it is 5": "label", "(learner) x": "label",
    "um so": "filler", "so u-um yes": "filler", "Mm, yes": "filler", "it is ERM 5": "filler", "hmm... ok": "filler",
    "[laughs] ok": "sound", "yes ((door slams))": "sound", "*typing* no": "sound", "♪ music ♪": "sound", "go [bell rings then": "sound",
    "so\u00a0um\u00a0yes": "filler", "[00:01:02]\u00a0yes": "stamp",
}
CLEAN = ["the film lasts 01:25:30 so how many", "the ratio is 6:7:39 in the end", "the train leaves at 09:34 and gets in at 11:31", "it is 5 mm long", "T = 2 and s = 20", "[unclear] yes", "Answer: 5", "if x < 5 and y > 3", "work out 8 * 2 * 2", "a bell rings in the corridor", "yeah okay oh", "emil.um@example.com", "", "the number 5"]


def test_noise(spark):
    rows = [("s", i, t) for i, t in enumerate([*NOISE, *CLEAN])] * 2 + [("s", None, "um"), (None, 1, "um"), ("s", 99, None)]
    got = {}
    for r in noise(spark.createDataFrame(rows, "session_id string, utterance_id long, content string")).collect():
        got.setdefault(r.utterance_id, []).append(r.kind)
    texts = [*NOISE, *CLEAN]
    assert {texts[k]: v for k, v in got.items()} == {t: [k] for t, k in NOISE.items()}


def test_turns(spark):
    rows = [("s", 2, "student", "um it is 5", "00:00:09"), ("s", 1, "tutor", "[00:00:01] Tutor: what is it\nStudent: hm five?", "00:00:01"), ("s", 3, "stu", "[laughs]", "00:00:10"), ("s", None, "tutor", "good", "00:00:12"), ("s", 4, "student", "yes", "00:00:05"), ("s", 5, "tutor", "bye", "00:00:20"), ("s", 5, "tutor", "bye", "00:00:20"), ("s", 6, None, "x", None), (None, 1, "tutor", "x", None)]
    df = spark.createDataFrame(rows, "session_id string, utterance_id long, role string, content string, ts string")
    got = [(r.role, r.text) for r in speaker_turns(df).orderBy("turn").collect()]
    assert got == [("tutor", "what is it"), ("student", "five? it is 5 yes"), ("tutor", "good bye")]
    assert speaker_turns(df.limit(0)).count() == 0
    long = spark.createDataFrame([("s", 1, "um word " * 50_000)], "session_id string, utterance_id long, content string")
    assert cleaned(long).select(F.length("__d")).first()[0] < 400_000


def plain_distance(a, b):
    best = None
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    best = min(row)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.lists(st.sampled_from("abc"), max_size=60))
def test_myers_is_edit_distance(a, b):
    assert myers(a, b) == plain_distance(a, b)


@given(st.integers(0, 200), st.integers(1, 30))
def test_every_run_holds_a_piece(n, run):
    cuts = pieces(["w"] * n, run)
    assert [a for a, _ in cuts] == [0] * bool(n) + [b for _, b in cuts[:-1]] and (not n or cuts[-1][1] == n)
    for start in range(max(0, n - run + 1)):
        assert any(start <= a and b <= start + run for a, b in cuts)


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(40)] + ["naïve", "x9"]
    items = [(i, " ".join(rng.choice(vocab, 14 + i % 30))) for i in range(20)] + [(20, None), (21, "?!"), (22, "Short one")]
    docs = []
    for d in range(80):
        w = list(rng.choice(vocab, 60))
        if d % 2:
            src = items[d % 20][1].split()
            k = int(rng.integers(5, len(src)))
            a = int(rng.integers(0, len(src) - k + 1))
            w[30:30] = src[a : a + k]
        docs.append((d, (", " if d % 3 else "\n> ").join(x.upper() if d % 5 == 0 else x for x in w)))
    docs += [(80, None), (81, ""), (82, "short  ONE")]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string").withColumn("distance", F.lit(1)), "doc_id", "text", spark.createDataFrame(items, "item_id long, item_text string"), "item_id", "item_text")
    found = {(r.doc_id, r.item_id) for r in got.where("longest_run >= 12").collect()}
    want = set()
    for i, t in items:
        w = word_list(t or "")
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, x in docs:
            v = word_list(x or "")
            if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)):
                want.add((d, i))
    assert found == want and want
    assert (82, 22) in {(r.doc_id, r.item_id) for r in got.where("distance = 0").collect()}


def test_raking_and_mixing(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None, "en" if i % 4 else "fr", "t", "word " * (5 + i % 7) if i % 13 else None) for i in range(3000)], "doc_id long, source string, lang string, topic string, text string").withColumn("weight", F.lit("clash")).withColumn("repeats", F.lit(9))
    counted = count_tokens(docs, "text")
    assert counted.where("text is null and tokens > 0").count() == 0 and counted.where("text is not null and tokens = 0").count() == 0
    targets = {"a": (0.6, 3), "b": (0.3, 2), "c": (0.1, 1), "none": (0.2, 1)}
    mixed = mix(counted, "doc_id", targets)
    assert mixed.where("source is null and repeats > 0").count() == 0
    got = {r.source: r for r in shares(mixed, spark.createDataFrame([(k, s / 1.2) for k, (s, _) in targets.items()], "source string, target_share double")).collect()}
    assert got["none"].short and got["none"].used == 0
    assert abs(got["a"].actual_share - 0.6) < 0.03 and abs(got["c"].actual_share - 0.1) < 0.02
    assert mixed.where("(source = 'a' and repeats > 3) or (source = 'c' and repeats > 1)").count() == 0
    assert mix(counted.limit(0), "doc_id", targets).count() == 0


def test_rake_meets_margins():
    import pandas as pd

    cells = pd.DataFrame([(s, t, 100.0 * (i + 1)) for i, (s, t) in enumerate((s, t) for s in "ab" for t in "xy")], columns=["source", "topic", "tokens"])
    r = rake(cells, {"source": {"a": 0.5, "b": 0.5}, "topic": {"x": 0.3, "y": 0.7}}, {"a": 9, "b": 9}, 1000)
    got = r * cells.tokens
    assert np.allclose(got.groupby(cells.source).sum(), [500, 500], atol=1e-3) and np.allclose(got.groupby(cells.topic).sum(), [300, 700], atol=1)


def test_kinds_held_out(spark):
    rows = text_statistics(spark.createDataFrame(labelled(800, 77), "text string, want string")).toPandas()
    got = np.where(rows.n_words == 0, "junk", predict(fitted_rules(spark), {f: rows[f].to_numpy(float) for f in FEATURES}, "prose"))
    assert (got == rows.want).mean() > 0.95


def test_kinds_of_odd_texts(spark):
    texts = [None, "", " \n\t", "word", "a, b, c", "x" * 100_000, "The answer is five because we add two and three to it.", "a'" * 100_000, "a," * 100_000, "one " * 100_000, "<b>" * 50_000, "1. x\n" * 50_000, " " * 100_000]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, n_words int")
    got = {r.id: r for r in text_kinds(rows).collect()}
    assert len(got) == len(texts) and [got[i].kind for i in (0, 1, 2, 6)] == ["junk", "junk", "junk", "prose"]
    assert got[6].n_words == 12 and got[0].mean_word_length == 0 and got[6].punct_line_share == 1.0
    assert text_kinds(rows.limit(0)).count() == 0
    assert re.match("int|bigint", dict(text_kinds(rows).dtypes)["n_words"])


@pytest.mark.parametrize("text,share", [("The cat, it sat.", 2 / 13), ("", 0.0), ("...", 1.0)])
def test_symbol_ratio(spark, text, share):
    assert abs(text_statistics(spark.createDataFrame([(text,)], "text string")).first().symbol_ratio - share) < 1e-9


@pytest.mark.parametrize("text", ["um " * 60_000, "[" * 100_000, "00:00:01 " * 30_000, "Tutor: " * 30_000, "Tutor: x\n" * 30_000, "(laughs" * 30_000, ":" * 100_000, "s]" * 60_000])
def test_noise_in_very_long_texts(spark, text):
    df = spark.createDataFrame([("s", 1, "tutor", text, "00:00:01")], "session_id string, utterance_id long, role string, content string, ts string")
    assert noise(df).count() <= 4 and speaker_turns(df).count() <= 30_000
