"""Text operators: lexicon counts, tokens, truncation, matching of near-equal texts, packing, tolerant parsing."""

from __future__ import annotations

import bisect
import difflib
import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkstream.functions import lexicons as L
from chalkstream.functions.dialect import Dialect
from chalkstream.functions.scan import BLOCK
from chalkstream.operators.profiles import r6
from chalkstream.session import cut


def lexicon_counts_sql(e: Dialect, utt: str) -> str:
    """Utterances of each role that each lexicon matches, with how often placeholders and calls by name occur."""
    flags = ", ".join(f"count_if({e.has('content', name)}) as {name}" for name in L.PATTERNS)
    names = e.size(e.keep(e.found("content", L.NAME_CALL, 1), ("not array_contains(" if e.spark else "not list_contains(") + e.strings(L.NOT_NAMES) + ", lower(v))"))
    return f"select role, count(*) as n, {flags}, cast(sum({names}) as bigint) as name_calls, cast(sum({e.count('content', '[?]')}) as bigint) as question_marks, count_if({e.matches('content', '[?]' + chr(92) + 's*$')}) as questions from {utt} where own group by role"


def token_profile_sql(e: Dialect, utt: str) -> str:
    """Sizes of the token sets of a session: words, talk words, letters only, content words, acknowledgements."""
    ack = e.strings(L.ACKNOWLEDGEMENTS)
    return f"""with a as (select session_id, {e.words('content')} as w, {e.talk_words('content')} as t, {e.found('lower(content)', "[a-z']+")} as l from {utt} where own)
select session_id, cast(sum({e.size('w')}) as bigint) as n_words, cast(sum({e.size('t')}) as bigint) as n_talk, cast(sum({e.size('l')}) as bigint) as n_letters, cast(sum({e.size(e.without('t', e.strings([*L.TALK_STOPS, *L.FILLERS])))}) as bigint) as n_content,
 count_if({e.size('t')} between 1 and 3 and {e.size(e.without('t', ack))} = 0) as n_ack from a group by session_id"""


def normalised_sql(e: Dialect, resp: str) -> str:
    """Objective texts in lower case, with single spaces and without trailing stops, and how many responses share each."""
    x = f"trim({e.replace('lower(lo_text)', '[' + chr(92) + 'p{Z}' + chr(92) + 's]+', ' ')})"
    return f"select {e.replace(x, '[.]+$', '')} as text, count(*) as n, count(distinct lo_id) as n_lo from {resp} where lo_text <> '' group by 1"


def columns_sql(e: Dialect, profile: str) -> str:
    """Selection, guarded division, filling and clipping of a profile's columns."""
    return f"select session_id, n_utterances, {r6('case when tutor_questions > 0 then tutor_praise * 1.0 / tutor_questions else 0 end')} as praise_per_question, {r6('greatest(0.0, least(10.0, student_tutor_word_ratio))')} as word_ratio_capped, cast(tutor_questions > student_questions as int) as tutor_asks_more, coalesce(nullif(n_unclear, 0), -1) as n_unclear_or_missing from {profile}"


def truncated_sql(e: Dialect, resp: str) -> str:
    """Head-keep truncation of an objective's words to 6: the first 2 and the last 4."""
    t = e.words("lo_text")
    cut = f"concat(slice({t}, 1, 2), slice({t}, -4, 4))" if e.spark else f"list_concat(({t})[1:2], ({t})[-4:])"
    joined = f"array_join(case when size({t}) > 6 then {cut} else {t} end, ' ')" if e.spark else f"array_to_string(case when len({t}) > 6 then {cut} else {t} end, ' ')"
    return f"select response_id, {joined} as kept from {resp} where lo_text <> ''"


def best_ratio(values: DataFrame, value: str, entries: list[str], cutoff: float = 0.87) -> DataFrame:
    """value, entry, ratio: for each different value its best entry by matching-blocks ratio of at least cutoff, else nulls.

    entries is a short list, held by every task. The ratio is 2 M / T of the longest matching blocks, found one after the
    other, which edit distances do not give; it runs in batches of different values, with two cheap bounds before it.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b.value:
                m, best, entry = difflib.SequenceMatcher(), cutoff, None
                m.set_seq2(v)
                for x in entries:
                    m.set_seq1(x)
                    if m.real_quick_ratio() >= best and m.quick_ratio() >= best and (r := m.ratio()) >= best and (entry is None or r > best):
                        best, entry = r, x
                out.append((v, entry, round(best, 6) if entry is not None else None))
            yield pd.DataFrame(out, columns=["value", "entry", "ratio"])

    return values.where(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct().mapInPandas(match, "value string, entry string, ratio double").withColumnRenamed("value", value)


def block_exits(sizes: list[int], budget: int) -> tuple[int, list[int], list[int], list[int]]:
    """The sum of a block's sizes, and for each row at which its first batch may start, in order: the sum up to and with
    that row, how many batches start from there, and what the last of them holds at the end of the block.

    These are the rows that a batch begun before, of a size of 1 to budget, may not reach, and row 0.
    """
    n, sums = len(sizes), [0, *accumulate(sizes)]
    many, held, after, end = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1), n
    for k in range(n - 1, -1, -1):
        if sizes[k]:
            while end > k + 1 and sums[end] - sums[k] > budget:
                end -= 1
            after[k] = end
        else:  # what holds nothing so far takes the next row of any size
            after[k] = after[k + 1]
        many[k], held[k] = (1, sums[n] - sums[k]) if after[k] == n else (many[after[k]] + 1, held[after[k]])
    at = [k for k in range(n) if k == 0 or sizes[k] and sums[k] < budget]
    return sums[n], [sums[k + 1] for k in at], [many[k] for k in at], [held[k] for k in at]


def block_entries(blocks: Iterable[tuple[int, Sequence[int], Sequence[int], Sequence[int]]], budget: int) -> Iterator[tuple[int, int]]:
    """For each block of a group, given by block_exits in order: the batch that is open where it begins, and what it holds."""
    batch = used = 0
    for total, upto, many, held in blocks:
        yield batch, used
        if used == 0:  # as if it started with row 0
            batch, used = batch + many[0] - 1, held[0]
        elif (k := bisect.bisect_right(upto, budget - used)) == len(upto):
            used += total
        else:
            batch, used = batch + many[k], held[k]


def block_batches(sizes: list[int], batch: int, used: int, budget: int) -> list[int]:
    """The batch of each row of a block, entered with a batch that holds used."""
    out = []
    for size in sizes:
        if used == 0 or used + size <= budget:
            used += size
        else:
            batch, used = batch + 1, size
        out.append(batch)
    return out


def packed(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """rows with batch: in order, a group's rows are packed until the next would exceed the budget; an oversized row is alone.

    The running sum starts anew with each batch, which no window says. So rows are folded by blocks of 4,096 places of
    order, a whole number: each block says how it is left for every row at which its first batch may start, a
    fold over one entry a block follows these, and then each block is packed from the state it is entered with. Rows
    without group or order are left out; sizes are not negative, and null counts as 0.
    """
    rest = [c for c in rows.columns if c not in (group, order)]

    @F.pandas_udf("total bigint, upto array<bigint>, many array<int>, held array<bigint>")
    def exits(sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([block_exits(x.tolist(), budget) for x in sizes], columns=["total", "upto", "many", "held"])

    @F.pandas_udf("array<struct<batch:int,used:bigint>>")
    def entries(total: pd.Series, upto: pd.Series, many: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([[{"batch": b, "used": u} for b, u in block_entries(zip(*x), budget)] for x in zip(total, upto, many, held)], dtype=object)

    @F.pandas_udf("array<int>")
    def batches(sizes: pd.Series, batch: pd.Series, used: pd.Series) -> pd.Series:
        return pd.Series([block_batches(x.tolist(), b, u, budget) for x, b, u in zip(sizes, batch, used)], dtype=object)

    row = F.struct(F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("s"), F.struct(*rest).alias("r"))
    of = rows.where(F.col(group).isNotNull() & F.col(order).isNotNull()).groupBy(group, F.floor(F.col(order) / BLOCK).alias("__blk"))
    blocks = of.agg(F.array_sort(F.collect_list(row)).alias("__xs"))
    blocks = cut(blocks.withColumn("__at", exits(F.col("__xs.s"))))
    ways = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__blk", "__at"))).alias("__bs")).where(F.size("__bs") > 1)
    ways = ways.withColumn("__e", entries(*[F.col(f"__bs.__at.{c}") for c in ("total", "upto", "many", "held")]))
    ways = ways.select(group, F.explode(F.arrays_zip(F.col("__bs.__blk").alias("b"), F.col("__e").alias("e"))).alias("x")).select(group, F.col("x.b").alias("__blk"), F.col("x.e").alias("__in"))
    entered = blocks.drop("__at").join(ways, [group, "__blk"], "left")
    entered = entered.withColumn("__b", batches(F.col("__xs.s"), F.coalesce("__in.batch", F.lit(0)), F.coalesce("__in.used", F.lit(0).cast("long"))))
    each = entered.select(group, F.explode(F.arrays_zip(F.col("__xs").alias("x"), F.col("__b").alias("b"))).alias("p"))
    return each.select(group, F.col("p.x.o").alias(order), *[F.col("p.x.r")[c].alias(c) for c in rest], F.col("p.b").alias("batch"))


def dropped_longest(rows: DataFrame, group: str, key: str, size: str, budget: int) -> DataFrame:
    """rows whose sizes stay within the budget when the longest (of ties the later key) goes first, time after time."""
    total = F.sum(size).over(W.partitionBy(group))
    gone = F.coalesce(F.sum(size).over(W.partitionBy(group).orderBy(F.desc(size), F.desc(key)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__left", total - gone).where(F.col("__left") <= budget).drop("__left")


def parsed_codes(text: str | None, expected: list[int]) -> list[tuple[int, str]]:
    """(utterance_id, code) of an annotator's answer in any shape it comes in; invalid text gives none.

    Takes a list, an object that holds a list, one record, a map from id to code or record, and bare codes, which get the
    expected ids by position; -1 where there is no id.
    """
    try:
        got = json.loads(text or "")
    except ValueError:
        return []
    if isinstance(got, dict):
        lists = [v for v in got.values() if isinstance(v, list)]
        if lists:
            got = lists[0]
        elif {"utterance_id", "code"} & got.keys():
            got = [got]
        else:
            got = [v if isinstance(v, dict) else {"utterance_id": k, "code": v} for k, v in got.items() if isinstance(v, dict) and "code" in v or isinstance(v, str) and k.lstrip("-").isdigit()]
    if not isinstance(got, list):
        return []
    out = []
    for i, x in enumerate(got):
        spare = expected[i] if i < len(expected) else -1
        if isinstance(x, str):
            out.append((spare, x))
        elif isinstance(x, dict):
            uid = x.get("utterance_id")
            try:
                uid = spare if uid is None else int(uid)
            except (TypeError, ValueError):
                uid = spare
            out.append((uid, str(x.get("code") or x.get("label") or "")))
    return out


def annotator_codes(answers: DataFrame, text: str, expected: str) -> DataFrame:
    """answers with codes: array of struct(utterance_id, code) by parsed_codes, in Arrow batches."""

    @F.pandas_udf("array<struct<utterance_id:bigint,code:string>>")
    def parse(t: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([[{"utterance_id": u, "code": c} for u, c in parsed_codes(x, list(i) if i is not None else [])] for x, i in zip(t, ids)], dtype=object)

    return answers.withColumn("codes", parse(F.col(text), F.col(expected)))


def joined_sentences(texts: F.Column) -> F.Column:
    """An array of texts as one: equal neighbours once, a full stop after those that end without one, single spaces."""
    return F.aggregate(
        texts, F.struct(F.lit("").alias("out"), F.lit("").alias("last")),
        lambda a, x: F.when((x == a["last"]) | (x == ""), a).otherwise(F.struct(F.concat(a["out"], F.when(a["out"] == "", "").otherwise(" "), x, F.when(x.rlike(r"[.!?]$"), "").otherwise(".")).alias("out"), x.alias("last"))),
    )["out"]
