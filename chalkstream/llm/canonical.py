"""Mapping freely typed values to the entries of a canonical list."""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections.abc import Container, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkstream.functions.keys import is_blank
from chalkstream.session import cut

#: Public vocabulary whose whole words are words of the language; the path must exist on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: What is written around an objective and says nothing of the skill.
FRAMES = (
    r"^(?:revision|recap|l\.? ?o\.?|walt|wilf|objective|learning objective|lesson objective|aim|topic|focus|target)\b[ .:)-]*",
    r"^(?:to be able to|be able to|to learn (?:how )?to|learning (?:how )?to|learn (?:how )?to|i can|we can|i am learning to|we are learning to|to understand how to|understand how to|how to|know how to|can)\b[ :-]*",
    r"^(?:y|yr|year) ?\d{1,2}\b[ :-]*",
    r"\(?\b(?:pt|part|lesson|session|week|ex|exercise)\.? ?\d{1,3}\b\)?",
    r"\(?\b(?:homework|recap|revision|revisited|again|hw|practice questions|starter|consolidation|continued|cont)\b\)?$",
)
#: Phrases of one meaning; the right side is what is compared.
SAME = (
    (r"\s*%\s*", " percentage "),
    (r"\bconstruct(?:ing)?\b", " draw "),
    (r"\bw/o\b|\bwith no\b|\bwithout any\b|\bw/out\b", " without "),
    (r"\bw/", " with "),
    (r"\bwork(?:ing|s)? ?out(?:ing)?\b|\bcalculat(?:e|ing)\b|\bdetermin(?:e|ing)\b|\bfinding\b", " find "),
    (r"\btake(?:s)? away\b|\btaking away\b|\bminus\b", " subtract "),
    (r"\btimes(?:ing)?\b", " multiply "),
    (r"(?<!percentage )\bchang(?:e|ing)\b", " convert "),
    (r"\b(\d)[ -]?digit\b", r" digits\1 "),
    (r"\b(?:one|single)[ -]digit\b", " digits1 "),
    (r"\btwo[ -]digit\b", " digits2 "),
    (r"\bthree[ -]digit\b", " digits3 "),
    (r"\bfour[ -]digit\b", " digits4 "),
    (r"\bfive[ -]digit\b", " digits5 "),
    (r"\b(\d) ?d\.? ?p\b\.?", r" \1 decimal places "),
    (r"\bd\.? ?p\b\.?", " decimal places "),
    (r"\b(\d) ?s\.? ?f\b\.?", r" \1 significant figures "),
    (r"\bs\.? ?f\b\.?", " significant figures "),
    (r"\bno\.?s\b", " numbers "),
    (r"\bno\b\.?|\bnum\b\.?", " number "),
    (r"\bintegers\b", " whole numbers "),
    (r"\binteger\b", " whole number "),
    (r"\bfracs?\b\.?s?", " fraction "),
    (r"\bdenoms?\b\.?s?", " denominator "),
    (r"\beqn?s?\b\.?", " equations "),
    (r"\bquad\b\.?", " quadratic "),
    (r"\btri\b\.?", " triangle "),
    (r"\brect\b\.?", " rectangle "),
    (r"\bperim\b\.?", " perimeter "),
    (r"\bstd\b\.?", " standard "),
    (r"\bamt\b\.?", " amount "),
    (r"\bprob\b\.?", " probability "),
    (r"\bform\.(?=\s|$)", " formula "),
    (r"\bmult\b\.?", " multiply "),
    (r"\bdiv\b\.?", " divide "),
    (r"\bsub\b\.?", " subtract "),
    (r"\bh\.? ?c\.? ?f\b\.?", " highest common factor "),
    (r"\bl\.? ?c\.? ?m\b\.?", " lowest common multiple "),
    (r"\bbodmas\b|\bbidmas\b", " order of operations "),
    (r"\b(?:1|one)[ -]?step\b", " one step "),
    (r"\b(?:2|two)[ -]?step\b", " two step "),
    (r"\bstraight[ -]?line\b", " straight line "),
    (r"&", " and "),
)
SMALL = frozenset("a an the of by with to in into on and for from as using use their its it that it's some i put".split())
#: Words of the frames, known even with a slip of the pen.
FRAME_WORDS = ("again", "homework", "recap", "revision", "lesson", "objective", "learn", "learning", "part", "understand", "today", "using")
NUMBERS = frozenset("one two three thre four five fiv six seven eight nine nin ten hundred thousand million zero single singl double doubl triple tripl".split())  # with their stems


def normal(text: str) -> str:
    """Lower case, one script form, no frames, no punctuation, phrases of one meaning alike."""
    x = unicodedata.normalize("NFKC", text).lower().replace("_", " ").replace("’", "'").replace("…", " ")
    x = re.sub(r"\.{2,}", " ", x)
    x = re.sub(r"[\"“”*!?#\t\n\r]|^\W+", " ", x)
    x = " ".join(x.split())
    for _ in range(3):
        for frame in FRAMES:
            x = re.sub(frame, " ", x).strip(" .:;,-")
    x = f" {x} "
    for pattern, to in SAME:
        x = re.sub(pattern, to, x)
    x = re.sub(r"[^\w\s-]|_", " ", x)
    return " ".join(x.replace("-", " ").split())


def stem(word: str) -> str:
    """Endings that change no meaning here: -ing, plural, a final e."""
    if len(word) > 5 and word.endswith("ing"):
        word = word[:-3]
        if word[-1] == word[-2] and word[-1] not in "sldfz":
            word = word[:-1]
    elif len(word) > 3 and word.endswith("ies"):
        word = word[:-3] + "y"
    elif len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if len(word) > 4 and word.endswith("ize"):
        word = word[:-2] + "se"
    return word[:-1] if len(word) > 3 and word.endswith("e") else word


def content(text: str) -> tuple[str, ...]:
    """The stems that carry meaning. Two-word verbs whose halves stand apart, and slips in verbs of one meaning, too."""
    out = [stem(w) for w in text.split() if w not in SMALL]
    for pair, verb in ((("work", "out"), "find"), (("tak", "away"), "subtract")):
        if all(w in out for w in pair):
            out = [w for w in out if w not in pair] + [verb]
    return tuple("find" if len(w) > 5 and alike(w, "calculat") >= 0.7 else w for w in out)


@lru_cache(1 << 17)
def alike(a: str, b: str) -> float:
    """1 - restricted Damerau-Levenshtein distance / longer length; numbers and very short words must be equal."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 3 or any(c.isdigit() for c in a + b):
        return 0.0
    if any(w in NUMBERS for w in (a, b)) and (min(len(a), len(b)) < 4 or a in NUMBERS and b in NUMBERS):
        return 0.0
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return 1 - last[-1] / max(len(a), len(b))


def agreement(typed: tuple[str, ...], entry: tuple[str, ...], known: Container[str] = (), listed: Container[str] = (), least: float = 0.5) -> float:
    """How far the words of both can be paired, 0 to 1 by length, whatever their order.

    It is 0 if a word of the entry has no partner. A typed word that is in listed, the words of all entries, pairs with
    nothing but itself and what is four fifths alike or what it begins, and one that is in known, the words of the
    language, is a word of its own and no slip of the pen, unless it is its partner cut short or three quarters alike.
    Unpaired typed words count in full, but for words of FRAME_WORDS.
    """
    cut_short = lambda t, e: len(t) >= 4 and e.startswith(t)
    pairs = sorted(((max(alike(t, e), 0.8 * cut_short(t, e)), i, j) for i, t in enumerate(typed) for j, e in enumerate(entry)), key=lambda p: (-p[0], abs(p[1] - p[2]), p[1]))
    used, done, got = {}, set(), 0.0
    for s, i, j in pairs:
        if s < least or i in used or j in done:
            continue
        t, e = typed[i], entry[j]
        if s < 1 and (t in listed and s < 0.8 and not (len(t) > 6 and cut_short(t, e)) or not cut_short(t, e) and s < 0.7 and t in known):
            continue
        used[i] = j
        done.add(j)
        got += s * max(len(t), len(e))
    if len(done) < len(entry):
        return 0.0
    spare = [t for i, t in enumerate(typed) if i not in used and not any(alike(t, w) >= 0.6 for w in FRAME_WORDS)]
    whole = sum(max(len(typed[i]), len(entry[j])) for i, j in used.items()) + sum(map(len, spare))
    return got / whole if whole else 0.0


@lru_cache(2)
def language(path: str) -> frozenset[str]:
    """Stems of the whole words of a public vocabulary: entries of letters that begin with a space."""
    out = set()
    with open(path, "rb") as f:
        for line in f:
            b = base64.b64decode(line.split()[0])
            if b[:1] == b" " and b[1:].isalpha() and b.islower():
                out.add(stem(b[1:].decode("ascii", "ignore")))
    return frozenset(out)


def grams(words: tuple[str, ...]) -> list[str]:
    """Character trigrams of words with their ends, and those over the space between neighbours, which tell their order."""
    out = {w[i : i + 3] for w in (f"^{c}$" for c in words) for i in range(len(w) - 2)}
    return sorted(out | {g for a, b in zip(words, words[1:]) for g in (f"{a[-2:]} {b[:1]}", f"{a[-1:]} {b[:2]}")})


def map_to_entries(
    values: DataFrame, value: str, entries: DataFrame, key: str, entry: str, threshold: float = 0.4, margin: float = 0.005, near: float = 0.7, agree: float = 0.74, vocabulary: str = VOCABULARY
) -> DataFrame:
    """value, key, cosine, runner_up: each different value that isn't blank once, with the entry it means.

    Values are deduplicated and normalised once. Candidates come from an inverted index of character trigrams, weighted
    by inverse document frequency among the entries. Of a value's grams only the weightiest are looked up, until what is
    left of its norm is below the threshold: an entry that shares none of these cannot reach it. Candidates are scored by
    weighted cosine. As an exact check, those of at least near times the best cosine have their words paired with the
    entry's; a candidate whose words agree by less than agree is none. Of the others the one of the highest cosine is
    accepted if it reaches the threshold and is ahead of the next by the margin.

    key is null where nothing is accepted, so unmatched values are reported; cosine is then that of the best candidate
    left, null without any. Ties go to none (margin). Null and blank values are left out; an empty list of entries
    matches nothing. Other columns are ignored. What a value is mapped to depends on no other value.
    """
    v = values.where(~is_blank(F.col(value))).select(F.col(value).cast("string").alias("raw")).distinct()
    e = entries.where(~is_blank(F.col(entry))).select(F.col(key).alias("key"), F.col(entry).alias("raw"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [content(normal(x)) for x in b.raw]
            yield b.assign(text=[" ".join(w) for w in words], words=[list(w) for w in words], grams=[grams(w) for w in words])

    schema = "text string, words array<string>, grams array<string>"
    both = cut(v.mapInPandas(parts, f"raw string, {schema}"))
    listed = cut(e.mapInPandas(parts, T.StructType([e.schema["key"], T.StructField("raw", T.StringType()), *T._parse_datatype_string(schema).fields])).drop("raw"))
    n = listed.count()
    idf = listed.select(F.explode("grams").alias("g")).groupBy("g").agg(F.log(1 + n / F.count(F.lit(1))).alias("w"))
    weighed = listed.select("key", F.explode("grams").alias("g")).join(idf, "g").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("of"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n_e"))
    weighed = weighed.join(listed.select("key", F.col("words").alias("entry")), "key")

    texts = both.groupBy("text").agg(F.first("words").alias("words"), F.first("grams").alias("grams"))
    rare = F.lit(math.log(1 + max(n, 1)))
    mine = texts.select("text", F.explode("grams").alias("g")).join(idf, "g", "left").withColumn("w", F.coalesce("w", rare))
    mine = mine.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("w", "g")), asc=False).alias("gw")).withColumn("n_v", F.sqrt(F.aggregate("gw", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    # the grams before whose end the squared norm of the rest is not yet below threshold squared
    rest = F.aggregate("gw", F.struct((F.col("n_v") * F.col("n_v")).alias("left"), F.lit(0).alias("k")), lambda a, x: F.when(a["left"] < threshold * threshold * F.col("n_v") * F.col("n_v"), a).otherwise(F.struct((a["left"] - x["w"] * x["w"]).alias("left"), (a["k"] + 1).alias("k"))))
    sought = mine.select("text", F.explode(F.slice("gw", 1, F.greatest(F.lit(1), rest["k"]))).alias("x")).select("text", F.col("x.g").alias("g"))
    pairs = sought.join(listed.select("key", F.explode("grams").alias("g")), "g").select("text", "key").distinct().join(mine, "text").join(weighed, "key")
    dot = F.aggregate("gw", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at("of", x["g"]), F.lit(0.0)))
    scored = pairs.select("text", "key", "entry", F.explode_outer(F.array(dot / (F.col("n_v") * F.col("n_e")))).alias("cosine")).where(F.col("cosine") >= threshold * near)
    best = scored.groupBy("text").agg(F.max("cosine").alias("top"))

    # typed words that are words of entries
    own = texts.select("text", F.explode("words").alias("word")).distinct().join(listed.select(F.explode("words").alias("word")).distinct(), "word").groupBy("text").agg(F.collect_set("word").alias("listed"))
    asked = scored.join(best, "text").where(F.col("cosine") >= near * F.col("top")).join(own, "text").join(texts.select("text", "words"), "text")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = language(vocabulary)
        for b in batches:
            score = [agreement(tuple(t), tuple(x), known, frozenset(o)) for t, x, o in zip(b.words, b.entry, b.listed)]
            yield b[["text", "key", "cosine"]][[s >= agree for s in score]]

    left = asked.select("text", "key", "cosine", "entry", "listed", "words").mapInPandas(judge, T.StructType([T.StructField("text", T.StringType()), e.schema["key"], T.StructField("cosine", T.DoubleType())]))
    two = left.groupBy("text").agg(F.max_by(F.struct("key", "cosine"), F.struct("cosine", "key")).alias("b"), F.max("cosine").alias("top"), F.sort_array(F.collect_list("cosine"), asc=False).alias("c"))
    second = F.coalesce(F.get("c", F.lit(1)), F.lit(0.0))
    ok = (F.col("top") >= threshold) & (F.col("top") - second >= margin)
    done = two.select("text", F.when(ok, F.col("b.key")).alias(key), F.col("top").alias("cosine"), second.alias("runner_up"))
    return both.select("raw", "text").join(done, "text", "left").select(F.col("raw").alias(value), key, "cosine", "runner_up")
