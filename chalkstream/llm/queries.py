"""The named queries of this folder: each of them runs one operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkstream.functions.keys import is_blank, linkable_id, norm_id
from chalkstream.llm.canonical import map_to_entries
from chalkstream.llm.chunks import split_long
from chalkstream.llm.components import assign_splits, linked_records
from chalkstream.llm.conversations import conversations, reply_links, session_verdicts
from chalkstream.llm.distinctive import distinctive_terms, recurring_terms
from chalkstream.llm.turns import noise, speaker_turns
from chalkstream.llm.leakage import leaked, leaked_items
from chalkstream.llm.mixing import count_tokens, language, mix, shares, topic
from chalkstream.llm.personal import personal_spans, redacted
from chalkstream.llm.quality import text_kinds
from chalkstream.llm.transcripts import responses, utterances
from chalkstream.session import cut, read

Query = Callable[[SparkSession, str], DataFrame]


# 1: personal information inside free text


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir, "content").where("session_id is not null and utterance_id is not null")
    return personal_spans(rows, "content").select("session_id", "utterance_id", F.explode("spans.kind").alias("kind")).distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utterances that name something personal, with placeholders for it."""
    rows = utterances(spark, sf_dir, "content").where("session_id is not null and utterance_id is not null")
    marked = personal_spans(rows, "content").where(F.size("spans") > 0)
    return marked.select("session_id", "utterance_id", redacted(F.col("content"), F.col("spans")).alias("content"), F.size("spans").alias("n_spans")).distinct()


# 2: how distinctive a term is per record


def session_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An utterance id's text counts once, whatever role or time its repeats have."""
    return distinctive_terms(utterances(spark, sf_dir, "content"), "session_id", "utterance_id", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring_terms(session_terms(spark, sf_dir)).select("session_id", "term")


def p2_session_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_terms(spark, sf_dir).select("session_id", "term", "tf", "n_units", "df", F.round("score", 9).alias("score"))


def p2_objective_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every objective id against all others; its rows are the responses' different texts."""
    rows = responses(spark, sf_dir, linkable_id("learning_objective_id").alias("learning_objective_id"), "learning_objective").withColumn("unit", F.lit(None).cast("bigint"))
    out = distinctive_terms(rows, "learning_objective_id", "unit", "learning_objective", same=("response_id",))
    return out.select("learning_objective_id", "term", "tf", "df", F.round("score", 9).alias("score"))


# 3: mapping freely typed values


def _objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response with an objective once; of several texts the one that came last."""
    rows = responses(spark, sf_dir, "learning_objective", "ingested_at").where(~is_blank(F.col("learning_objective")) & F.col("response_id").isNotNull())
    return rows.groupBy("response_id").agg(F.max_by("learning_objective", F.struct("ingested_at", "learning_objective")).alias("learning_objective"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objectives(spark, sf_dir)
    mapped = map_to_entries(rows, "learning_objective", read(spark, sf_dir, "objective_reference"), "ref_id", "objective")
    return rows.join(mapped, "learning_objective").select("response_id", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"))


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different text with its entry and scores; those without an entry are the report of what matches nothing."""
    return map_to_entries(read(spark, sf_dir, "test_features"), "learning_objective", read(spark, sf_dir, "objective_reference"), "ref_id", "objective")


# 4: splitting oversized items


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An utterance is oversized if the operator makes a second piece of it."""
    return split_long(utterances(spark, sf_dir, "content").where("utterance_id is not null"), "content").where("piece_no = 2").select("session_id", "utterance_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact repeats of an utterance are cut once."""
    return split_long(utterances(spark, sf_dir, "content").where("utterance_id is not null"), "content").where("n_pieces > 1").select("session_id", "utterance_id", "piece_no", "n_pieces", "start", "piece").distinct()


# 5: splits that keep related records together


def response_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir, norm_id("session_id").alias("session_id"), linkable_id("learning_objective_id").alias("learning_objective_id"))
    return linked_records(rows, "response_id", [F.col("session_id"), F.col("learning_objective_id")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response_groups(spark, sf_dir).where("n_records > 1").select("response_id", "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r.split_name, r.target_share) for r in read(spark, sf_dir, "split_targets").orderBy("split_name").collect()]
    return assign_splits(response_groups(spark, sf_dir), targets).select("response_id", "group_id", "split")


# 6: rebuilding conversations


def _sessions_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir, norm_id("session_id").alias("session_id")).select("session_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = reply_links(utterances(spark, sf_dir, "content", "role", "ts"))
    return session_verdicts(links, _sessions_named(spark, sf_dir)).where("reason is not null").select("session_id", "reason")


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(utterances(spark, sf_dir, "content", "role", "ts"), _sessions_named(spark, sf_dir))


# 7: clean speaker turns


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(utterances(spark, sf_dir, "content"))


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(utterances(spark, sf_dir, "content", "role", "ts"))


# 8: evaluation texts in training text


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact check, 12 consecutive words, follows the operator."""
    return p8_leaks(spark, sf_dir).where("longest_run >= 12").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak an item, by few edits from it or by a run of it: distance and longest run of each."""
    found = leaked_items(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "item_text")
    return leaked(found)


# 9: mixing sources to target weights


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", language(F.col("lang")).alias("lang"), topic(F.col("text")).alias("topic"), "text")
    targets = {r.source: (r.target_share, r.max_repeats) for r in read(spark, sf_dir, "mix_targets").collect()}
    return mix(cut(count_tokens(docs, "text").drop("text")), "doc_id", targets)


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_mixed(spark, sf_dir), read(spark, sf_dir, "mix_targets").select("source", "target_share"))


# 10: text quality


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_kinds(read(spark, sf_dir, "documents").select("doc_id", "text")).where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = text_kinds(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return stats.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punct_line_share", "common_share")], "kind")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit() and callable(f)}


# DuckDB's view of the same results. WS is white space of any kind, as chr() codes.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
_SID = f"upper(trim(session_id, {_WS}))"
_UID = f"try_cast(regexp_extract(trim(utterance_id, {_WS}), '^([+-]?[0-9]+)([.]0*)?$', 1) as bigint)"
_U = f"u as (select {_SID} as session_id, {_UID} as utterance_id, role, content, ts from test_transcripts)"
_TERMS = f"""with {_U}, d as (select distinct session_id, utterance_id, content from u where session_id is not null and content is not null),
 t as (select session_id, utterance_id, unnest(regexp_extract_all(lower(content), '[a-z]{{4,}}')) as term from d),
 c as (select session_id, term, count(*) as tf, count(distinct utterance_id) as n_units from t group by all),
 f as (select term, count(*) as df from c group by term), l as (select session_id, sum(tf) as len from c group by all), n as (select count(*) as n from l)"""


def oracle_sql() -> dict[str, str]:
    role = "regexp_replace(lower(coalesce(role, '')), '[^a-z]', '', 'g')"
    return {
        "p2_found": f"{_TERMS} select session_id, term from c join f using (term) where n_units >= 4 and df between 2 and 6",
        "p2_session_terms": f"{_TERMS} select session_id, term, tf, n_units, df, round(tf / len * (ln((1 + n) / (1 + df)) + 1), 9) as score from c join f using (term) join l using (session_id), n",
        "p2_objective_terms": f"""with d as (select distinct upper(trim(response_id, {_WS})) as response_id, upper(trim(learning_objective_id, {_WS})) as learning_objective_id, learning_objective from test_features where learning_objective is not null),
 t as (select learning_objective_id, unnest(regexp_extract_all(lower(learning_objective), '[a-z]{{4,}}')) as term from d where learning_objective_id not in ('', 'UNK')),
 c as (select learning_objective_id, term, count(*) as tf from t group by all), f as (select term, count(*) as df from c group by term), l as (select learning_objective_id, sum(tf) as len from c group by all), n as (select count(*) as n from l)
 select learning_objective_id, term, tf, df, round(tf / len * (ln((1 + n) / (1 + df)) + 1), 9) as score from c join f using (term) join l using (learning_objective_id), n""",
        "p4_found": f"with {_U} select distinct session_id, utterance_id from u where utterance_id is not null and length(content) > 500",
        "p5_found": f"""with recursive r as (select distinct upper(trim(response_id, {_WS})) as response_id, {_SID} as s, upper(trim(learning_objective_id, {_WS})) as o from test_features),
 e as (select response_id, 's' || s as x from r where s is not null union select response_id, 'o' || o from r where o not in ('', 'UNK')),
 so as (select distinct a.x, b.x as y from e a join e b using (response_id)),
 reach as (select distinct x, x as y from e union select reach.x, so.y from reach join so on reach.y = so.x),
 least as (select reach.x, min(response_id) as group_id from reach join e on e.x = reach.y group by 1), g as (select response_id, min(group_id) as group_id from e join least using (x) group by 1)
 select response_id, group_id from g where group_id in (select group_id from g group by 1 having count(*) > 1)""",
        # every run of 12 words of an item against every run of 12 words of a document
        "p8_found": r"""with i as (select item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') as w from eval_items), d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
 ig as (select distinct item_id, array_to_string(list_slice(w, k, k + 11), ' ') as run from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12) a),
 dg as (select distinct doc_id, array_to_string(list_slice(w, k, k + 11), ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12) b)
 select distinct doc_id, item_id from ig join dg using (run)""",
        "p6_found": f"""with {_U}, a as (select *, case when trim(coalesce(content, ''), {_WS}) = '' then null when {role} in ('tutor', 'tutr', 'tut', 't', 'teacher') then 't' when {role} in ('student', 'stu', 's', 'pupil', 'learner') then 's' end as who from u),
 c as (select session_id, utterance_id, count(distinct coalesce('+' || content, '-')) as k from u where utterance_id is not null group by all),
 b as (select session_id, max(k) as k, count(*) as n, max(utterance_id) - min(utterance_id) + 1 as span from c group by all),
 w as (select session_id, count(distinct who) as w from a group by all),
 s as (select session_id from u union select {_SID} from test_features)
 select session_id, case when w.w is null then 'missing' when w.w = 0 then 'empty' when w.w = 1 then 'no_reply' else 'broken' end as reason from s left join w using (session_id) left join b using (session_id)
 where session_id is not null and (w.w is null or w.w < 2 or b.n <> b.span or b.k > 1)""",
    }
