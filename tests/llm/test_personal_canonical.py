from pyspark.sql import functions as F

from chalkstream.llm.boost import Boosted
from chalkstream.llm.canonical import agreement, alike, content, map_to_entries, normal
from chalkstream.llm.personal import KINDS, VOCABULARY, _ordinary, candidates, fitted, gate, personal_spans, redacted, spans_of
from chalkstream.llm.utterance_samples import labelled

FOUND = {
    "my email is tobias.kerrby+maths@year8.example.org": {"email"}, "write to orla dash ruskbeck2 at quickbox dot example if it breaks": {"email"}, "login: s.zannbeck[at]ormond-trust[dot]invalid": {"email"},
    "call my mum on 07700 900 133": {"phone"}, "text me, oh double seven double oh nine double oh six one oh": {"phone"}, "(548) 555-0144 is the house phone": {"phone"}, "I counted 39 07700 900 370": {"phone"}, "1-426-555-0108 is the house phone": {"phone"},
    "my national insurance number is QQ 12 34 56 C": {"id_number"}, "passport no nine eight nine five nine eight seven eight four": {"id_number"}, "SSN 000-52-4328": {"id_number"}, "the nurse wrote 999 700 3663 as my NHS no": {"id_number"},
    "I live at 55 Dravby Parade": {"address"}, "come round to forty two Vinery Parade after school": {"address"}, "our address is flat 14, 72 saint ruskton street": {"address"},
    "my name is Priya Orlaro": {"name"}, "my teacher is Mr Voskescu": {"name"}, "it's down as O'Eldington, Esme on the list": {"name"}, "tobias ranjfen is my little brother": {"name"}, "my\u00a0name\u00a0is\u00a0Priya\u00a0Orlaro": {"name"},
    "is 999 533 4414 divisible by 15": set(), "the pattern goes 9136 5294 1808 and so on": set(), "my name is Zara": set(), "Hello Luca, how was your day?": set(), "how far is it from Otterholt Street to Gorse Close": set(),
    "there are 16 houses on the lane": set(), "quickbox dot example is the website for it": set(), "the pens are 36 @ 40p each": set(), "[EMAIL] and [PHONE]": set(), "Mr and Mrs is how it starts": set(), "": set(),
}


def test_spans_and_placeholders(spark):
    rows = [(i, t) for i, t in enumerate(FOUND)] * 2 + [(99, None), (100, "word " * 60_000 + "my name is Priya Orlaro")] + [(101 + i, x) for i, x in enumerate(("1 " * 50_000, "a.b@" * 50_000, "one " * 50_000, "at dot " * 30_000, "12 Hazel " * 20_000, "mr " * 50_000, "Hugo " * 20_000, ", " * 60_000))]
    got = personal_spans(spark.createDataFrame(rows, "id int, content string").withColumn("spans", F.lit(1)), "content").withColumn("out", redacted(F.col("content"), F.col("spans"))).collect()
    assert len(got) == len(rows)
    texts = list(FOUND)
    for r in got:
        kinds = {s.kind for s in r.spans}
        if r.id < 99:
            assert kinds == FOUND[texts[r.id]], r
    by = {r.id: r.out for r in got}
    assert by[0] == "my email is [EMAIL]" and by[99] is None and by[100].endswith("my name is [NAME]")
    assert personal_spans(spark.createDataFrame([], "content string"), "content").count() == 0


def test_held_out_accuracy():
    words = _ordinary(VOCABULARY)
    test = labelled(600, 1234)
    got = spans_of([t for t, _ in test], fitted(), words)
    for kind in KINDS:
        want = [any(k == kind for k, _, _ in s) for _, s in test]
        have = [any(k == kind for _, _, k, _ in g) for g in got]
        hit = sum(a and b for a, b in zip(want, have))
        assert hit / sum(want) > 0.95 and hit / sum(have) > 0.95


def test_gate_keeps_all_that_is_accepted(spark):
    texts = [t for t, _ in labelled(1500, 4321)]
    inside = {r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").where(gate(F.col("t"))).collect()}
    for t, spans in zip(texts, spans_of(texts, fitted(), _ordinary(VOCABULARY))):
        assert not spans or t in inside, t


def test_overlaps_are_resolved():
    assert all(b <= c for (_, b, _, _), (c, _, _, _) in zip(*[iter(spans_of(["mail a.b@c.example or call 07700 900 123, Mr Tarnby, 12 Hazel Lane"], fitted(), _ordinary(VOCABULARY))[0])] * 2))
    assert candidates("", frozenset()) == []


def test_boosting_learns_a_rule():
    import numpy as np

    x = np.random.default_rng(0).random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    m = Boosted().fit(x[:600], y[:600]).calibrate(x[600:700], y[600:700])
    assert ((m.score(x[700:]) >= m.threshold) == y[700:]).mean() > 0.93


ENTRIES = [(1, "Add fractions with the same denominator"), (2, "Add fractions with different denominators"), (3, "Convert fractions to decimals"), (4, "Convert decimals to fractions"), (5, "Multiply a 2-digit number by a 1-digit number"), (6, "Multiply a 2-digit number by a 2-digit number"), (7, "Find the volume of a cuboid"), (8, "Draw a bar chart"), (9, "Round decimals to two decimal places")]
MEANT = {
    "add fracs w/ the same denom.": 1, "ADDING FRACTIONS WITH DIFFERNT DENOMINATORS (recap)": 2, "fractions to decimals - convert": 3, "change decimals to fractions homework": 4, "Y5 - times a 2digit no. by a 1-digit number": 5,
    "multiply a two-digit nubmer by a 2-digit number!": 6, "work out the volume of a cubiod": 7, "Draw a bar cahrt": 8, "WALT: round decimals to two d.p.": 9, "Round decimals to three decimal places": None, "Find the volume of a pyramid": None, "see notes": None, "multiply a 3-digit number by a 1-digit number": None,
}


def test_values_are_mapped(spark):
    rows = [(t, i) for i, t in enumerate(MEANT)] * 3 + [(None, 1), ("", 2), (" \t", 3), ("x" * 5000, 4)]
    got = {r.v: r.ref_id for r in map_to_entries(spark.createDataFrame(rows, "v string, score int"), "v", spark.createDataFrame(ENTRIES, "ref_id long, objective string"), "ref_id", "objective").collect()}
    assert got == {**MEANT, "x" * 5000: None}
    none = map_to_entries(spark.createDataFrame(rows[:3], "v string, score int"), "v", spark.createDataFrame([], "ref_id long, objective string"), "ref_id", "objective").collect()
    assert {r.ref_id for r in none} == {None}
    assert map_to_entries(spark.createDataFrame([], "v string"), "v", spark.createDataFrame(ENTRIES, "ref_id long, objective string"), "ref_id", "objective").count() == 0


def test_words_alike():
    assert alike("nubmer", "number") > 0.8 and alike("two", "ten") == 0 and alike("digits2", "digits3") == 0
    assert content(normal("Learning to: Add  Fractions (pt 3)...")) == ("add", "fraction")
    assert agreement(("add", "cubic"), ("add", "cuboid"), {"cubic", "cuboid"}) == 0


def test_a_value_is_mapped_alike_whatever_else_there_is(spark):
    entries = spark.createDataFrame(ENTRIES, "ref_id long, objective string")
    mapped = lambda texts: {r.v: (r.ref_id, round(r.cosine or 0, 9)) for r in map_to_entries(spark.createDataFrame([(t,) for t in texts], "v string"), "v", entries, "ref_id", "objective").collect()}
    whole, other = mapped(MEANT), [f"add cubic numbers {i}" for i in range(300)]
    half = list(MEANT)[::2]
    assert {t: whole[t] for t in half} == {t: v for t, v in mapped(half + other).items() if t in half}


def test_acceptance_is_by_cosine_and_margin(spark):
    """No entry is accepted under the threshold, or within the margin of another that its words fit as well."""
    entries = spark.createDataFrame([*ENTRIES, (10, "Draw a bar chart"), (11, "Draw the bar charts")], "ref_id long, objective string")
    rows = map_to_entries(spark.createDataFrame([(t,) for t in MEANT], "v string"), "v", entries, "ref_id", "objective").collect()
    assert all(r.ref_id is None or r.cosine >= 0.4 and r.cosine - r.runner_up >= 0.005 for r in rows)
    assert next(r.ref_id for r in rows if r.v == "Draw a bar cahrt") is None
