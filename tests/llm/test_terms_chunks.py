import math
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chalkstream.llm.chunks import boundary_pattern, split_long
from chalkstream.llm.distinctive import distinctive_terms, recurring_terms


def brute(rows):
    """record -> term -> (tf, units) from different rows."""
    tf, units = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    for record, unit, text in set(rows):
        if record is None or text is None:
            continue
        for t in re.findall("[a-z]{4,}", text.lower()):
            tf[record][t] += 1
            if unit is not None:
                units[record][t].add(unit)
    return tf, units


def test_terms_against_brute_force(spark):
    words = ["apple", "pear", "tree", "a", "Maths", "don't", "über", "x1y2", "four4five"]
    rows = [(f"r{i % 7}" if i % 31 else None, (i * 37) % 5000 if i % 11 else None, " ".join(words[(i * k) % 9] for k in range(1, 2 + i % 6)) if i % 17 else None) for i in range(600)]
    rows += rows[:50]
    got = {(r.record, r.term): r for r in distinctive_terms(spark.createDataFrame(rows, "record string, unit long, text string"), "record", "unit", "text").collect()}
    tf, units = brute(rows)
    assert got.keys() == {(r, t) for r in tf for t in tf[r]}
    n, df = len(tf), Counter(t for r in tf for t in tf[r])
    for (r, t), x in got.items():
        assert (x.tf, x.n_units, x.df, x.n_records, x.record_terms) == (tf[r][t], len(units[r][t]), df[t], n, sum(tf[r].values()))
        assert math.isclose(x.score, tf[r][t] / sum(tf[r].values()) * (math.log((1 + n) / (1 + df[t])) + 1))


def test_terms_of_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "record string, unit long, text string, tf int, df int, score double")
    assert distinctive_terms(empty, "record", "unit", "text").count() == 0
    clash = spark.createDataFrame([("r", 1, "same word word", 9, 9, 9.0)], "record string, unit long, text string, tf int, df int, score double")
    assert {(r.term, r.tf) for r in distinctive_terms(clash, "record", "unit", "text").collect()} == {("same", 1), ("word", 2)}
    rows = [("a", u, "wonder") for u in range(4)] + [("b", 1, "wonder"), ("c", None, "thing")]
    found = recurring_terms(distinctive_terms(spark.createDataFrame(rows, "record string, unit long, text string"), "record", "unit", "text")).collect()
    assert [(r.record, r.term) for r in found] == [("a", "wonder")]


def test_long_texts_are_cut_and_come_back(spark):
    texts = ["", " ", "short", "word " * 400, "x" * 3000, "é😀" * 700, "One. Two? Three!\n\n" * 200, "a" * 499 + "b", "a" * 501, "no,breaks;here " * 300 + "\n", None, "\n" * 1200]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "id int, content string").withColumn("piece", F.lit("clash"))
    got = defaultdict(set)
    for r in split_long(rows, "content").collect():
        got[r.id].add((r.piece_no, r.n_pieces, r.start, r.piece))
    assert set(got) == {i for i, t in enumerate(texts) if t is not None}
    for i, found in got.items():
        built = ""
        for k, n, start, piece in sorted(found):
            assert len(piece) <= 500 and n == len(found) and texts[i][start : start + len(piece)] == piece
            if k > 1:
                assert 25 <= len(built) - start <= 50
            built = built[:start] + piece
        assert built == texts[i]
        assert (len(found) > 1) == (len(texts[i]) > 500)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" .,\nab", min_size=1, max_size=400), st.integers(2, 40))
def test_boundary_pattern_tiles(text, most):
    pattern = boundary_pattern(most)
    # Python has no lookbehind of varying width, so boundaries are tried without it: the last alternative alone must tile
    plain = re.compile("(?s)(" + rf".{{1,{most}}}" + ")")
    assert "".join(plain.findall(text)) == text and pattern.count("|") >= 5
