"""Per-document text quality statistics, and the kind of text they point to."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkstream.functions.keys import WHITE_CLASS
from chalkstream.llm.rules import Rule, decide, irep
from chalkstream.llm.samples import labelled

#: The commonest function words of some languages. Fixed values.
COMMON = (
    "the of and to in a is it that was for on are as with be at by this have from or had not but what all were we when your can there an which their if will each about how up out them then she he you they so has its who i me my our us his her these some would like into than only could been do does did no more most "
    "le la les de des du et en un une que qui dans pour est sur pas avec il elle nous vous ce cette sont au aux ne se par on a été plus "
    "der die das und ist nicht ein eine einen mit von zu den dem auf für wir ich sie es im am hat haben war sich als auch wird noch dass man "
    "el los las y del se por con una su para al lo es como más pero sus ha hay "
    "și în nu pe cu este sunt din la care mai sau au fost ca să despre pentru "
    "il di che è non per gli della con sono ha i "
    "het een van op te dat niet zijn met voor aan er ook maar om"
)
#: What is left of web pages: navigation words. Fixed values.
NAVIGATION = ("home", "login", "menu", "cookie", "cookies", "privacy", "terms", "search", "share", "print", "help", "next", "previous", "subscribe", "contact", "loading", "sitemap", "newsletter", "register", "basket", "checkout", "faq", "settings", "dashboard", "logout", "careers")
#: The same of several words, by a word that each has.
NAVIGATION_PHRASES = {"log": "log (?:in|out)", "sign": "sign (?:up|in)", "top": "back to top", "accept": "accept all", "read": "read more", "skip": "skip to content", "reserved": "all rights reserved", "click": "click here"}
# repeated groups are bounded, since Java's patterns recurse into them; runs are possessive, as they never give back
_WORD = r"[\p{L}\p{N}]++(?:['’][\p{L}]++){0,4}+"
_MARK = r"^[ \t]*(?:[-*•–—»☐☑✓◦▪·‣][ \t]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[).][ \t]|\d{1,2} marks?\b)"
#: A line of up to seven words without an end.
_SHORT = rf"^[^\p{{L}}\p{{N}}]*+(?:{_WORD}[^\p{{L}}\p{{N}}]++){{0,6}}+(?:{_WORD})?+[^\p{{L}}\p{{N}}]*+$"
_CONSONANT = "[bcdfghjklmnpqrstvwxz]"
_DEBRIS = r"\x{fffd}ÃÂ¤¶§±þ€\x{7f}"
FEATURES = ("common_share", "symbol_ratio", "mean_word_length", "punct_line_share", "mark_share", "cell_share", "short_share", "nav_share", "distinct_share", "odd_share", "long_share", "tag_share", "comma_rate", "broken_share", "n_words")


def _cells(x: Column) -> Column:
    """Whether a line is one of cells: between bars, by tabs, by runs of spaces, or by commas without a space."""
    return (
        (x.contains("|") & x.rlike(r"\|.*\|"))
        | x.rlike(r"^[ \t]*[|+].*[|+][ \t]*$")
        | (x.contains("\t") & x.rlike(r"[^\t]\t|\t[^\t]"))
        | (x.contains("   ") & x.rlike(r"\S {3,}\S"))
        | x.rlike(r"^(?:[^,;\s]{0,40}+[,;](?=[^\s]|$)){2}")
    )


def _share(lines: Column, total: Column, of: Callable[[Column], Column]) -> Column:
    own = F.aggregate(F.filter(lines, of), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(total > 0, own / total).otherwise(0.0)


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with FEATURES as columns: numbers that tell prose from lists, tables and junk.

    n_words (runs of letters and digits), mean_word_length, symbol_ratio (neither letter, digit nor space, of all but
    space), punct_line_share (lines that end in punctuation, of those not blank), common_share (function words of some
    languages, of all words); then shares of the characters of all lines that are not blank: lines that begin with
    a list's mark (if there are two), lines of cells, short lines without an end; of words: navigation words, different words, words no
    language has, words with a capital or a stop inside; of characters: unbroken runs over 30, markup and encoding debris; and separators by word.

    Null and blank texts have 0 everywhere, and a text without words a mean_word_length of 0. Columns of documents with
    a feature's name are replaced. All runs in one stage in the JVM, over whole texts.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [c for c in documents.columns if c not in FEATURES]
    base = documents.select(*[F.col(f"`{c}`") for c in own], t.alias("__t"), F.lower(t).alias("__l"))
    base = base.withColumns(
        {
            "__solid": F.length(F.replace("__t", F.lit(" "), F.lit(""))) - F.regexp_count("__t", F.lit(f"[^ -~](?<=[{WHITE_CLASS}])")),
            "__lines": F.filter(F.split("__t", r"\r\n|[\r\n]"), lambda x: x.rlike(r"[^\s ]")),
        }
    )
    # the words alone, each between single spaces: patterns that begin with a space are tried at words only
    found = F.regexp_extract_all("__l", F.lit(f"({_WORD})"), F.lit(1))
    base = base.withColumn("__words", found).withColumn("__w", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    base = base.withColumn("__alnum", F.length(F.replace(F.replace(F.array_join("__words", ""), F.lit("'"), F.lit("")), F.lit("’"), F.lit("")))).withColumn("__own", F.array_distinct("__words"))
    base = base.withColumn("n_words", F.size("__words")).withColumn("__chars", F.aggregate("__lines", F.lit(0), lambda a, x: a + F.length(x)))
    n, solid, lines, chars = F.col("n_words"), F.col("__solid"), F.col("__lines"), F.col("__chars")
    counted = lambda text, pattern, of, most=1.0: F.when(of > 0, F.least(F.regexp_count(text, F.lit(pattern)) / of, F.lit(most))).otherwise(0.0)
    gathered = lambda text, pattern: F.length(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ""))
    # patterns begin with what is rare and look behind only after it; each gate is true wherever its pattern can match
    stats = {
        "mean_word_length": F.when(n > 0, F.col("__alnum") / n).otherwise(0.0),
        "symbol_ratio": F.when(solid > 0, (solid - F.col("__alnum")) / solid).otherwise(0.0),
        "punct_line_share": F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: F.right(F.regexp_replace(F.right(x, F.lit(40)), r"[\s\xa0]+$", ""), F.lit(8)).rlike(r"[.!?…:;]['\"”’)\]]*$"))) / F.size(lines)).otherwise(0.0),
        "common_share": F.when(n > 0, F.size(F.filter("__words", lambda x: x.isin(*sorted(set(COMMON.split()))))) / n).otherwise(0.0),
        "mark_share": F.when(F.size(F.filter(lines, lambda x: x.rlike(_MARK))) > 1, _share(lines, chars, lambda x: x.rlike(_MARK))).otherwise(0.0),
        "cell_share": _share(lines, chars, _cells),
        "short_share": _share(lines, chars, lambda x: ~x.rlike("[.!?]") & x.rlike(_SHORT)),
        "nav_share": F.when(n > 0, F.least((F.size(F.filter("__words", lambda x: x.isin(*NAVIGATION))) + F.when(F.arrays_overlap("__own", F.array(*map(F.lit, NAVIGATION_PHRASES))), F.regexp_count("__w", F.lit(rf" (?:{'|'.join(NAVIGATION_PHRASES.values())})(?= )"))).otherwise(0)) / n, F.lit(1.0))).otherwise(0.0),
        "distinct_share": F.when(n > 0, F.size("__own") / n).otherwise(0.0),
        "odd_share": counted(F.concat(F.lit(" "), F.array_join("__own", " "), F.lit(" ")), rf"{_CONSONANT}{{2}}(?:{_CONSONANT}{{3,}}+|[jqvxz]|(?<= ..){_CONSONANT}{{1,2}}+(?= ))| \p{{L}}*+\p{{N}}++\p{{L}}[\p{{L}}\p{{N}}]{{2,}}+", F.size("__own")),
        "long_share": F.when(solid > 0, gathered(F.concat(F.lit(" "), "__t"), r"\s(\S{30,}+)") / solid).otherwise(0.0),
        "tag_share": F.when((solid > 0) & F.col("__t").rlike(rf"[<{{{_DEBRIS}]"), gathered("__t", rf"([<{{{_DEBRIS}](?:(?<=<)[^<>\n]{{1,200}}>|(?<=\{{)[^{{}}\n]{{1,200}}\}}|(?<=[{_DEBRIS}])))") / solid).otherwise(0.0),
        "broken_share": counted("__t", r"\p{Lu}(?<=\p{Ll}.)|[.,:;!?](?<=\p{L}.)\p{Ll}", n),
        "comma_rate": counted("__t", r"[,;/·|»]", n, 2.0),
    }
    done = base.withColumns(stats).select(*[F.col(f"`{c}`") for c in own], "n_words", *[c for c in FEATURES if c != "n_words"])
    # through an array, so that a filter on what follows is not pushed down to compute every feature again
    return done.select(F.explode_outer(F.array(F.struct(*[F.col(f"`{c}`") for c in done.columns]))).alias("__row")).select("__row.*")


_FITTED: dict[tuple[int, int], list[Rule]] = {}


def fitted_rules(spark: SparkSession, samples: int = 5000, seed: int = 11) -> list[Rule]:
    """The ordered rules for junk, table and list, learned from samples invented, labelled documents (a bounded set)."""
    if (samples, seed) not in _FITTED:
        rows = text_statistics(spark.createDataFrame(labelled(samples, seed), "text string, kind string").repartition(4)).select("kind", *FEATURES).orderBy("kind", *FEATURES).toPandas()
        _FITTED[samples, seed] = irep({f: rows[f].to_numpy(float) for f in FEATURES}, rows.kind.to_numpy(), ["junk", "table", "list"])
    return _FITTED[samples, seed]


def text_kinds(documents: DataFrame, text: str = "text", samples: int = 5000) -> DataFrame:
    """text_statistics with kind: prose, list, table or junk. Blank and null texts are junk."""
    stats = text_statistics(documents, text)
    blank = F.col("n_words") == 0
    return stats.withColumn("kind", F.when(blank, "junk").otherwise(decide(fitted_rules(documents.sparkSession, samples), "prose")))
