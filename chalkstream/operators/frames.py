"""The base frames of all session operators: cleaned utterances in order, and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkstream.functions.keys import norm_id, whole_number
from chalkstream.functions.scan import numbered, running_sum, with_halo
from chalkstream.session import cut, read


def elapsed(ts: str, e: str = "col", strict: bool = True) -> str:
    """SQL, the same in both engines: 'HH:MM:SS' as seconds; strict takes three parts, else the first three of more."""
    colons = f"(length({ts}) - length(replace({ts}, ':', '')))"
    part = lambda i: f"try_cast(trim(split_part({ts}, ':', {i})) as int)"
    return f"case when {colons} {'= 2' if strict else '>= 2'} then cast({part(1)} * 3600 + {part(2)} * 60 + {part(3)} as double) end"


#: The block of rows whose utterance_id is no whole number; it comes after all others.
NO_ID = 1 << 52


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a transcript in their normal form, each row as often as it was delivered."""
    t = read(spark, sf_dir, "test_transcripts")
    return t.select(
        norm_id("session_id").alias("session_id"), whole_number("utterance_id").alias("utterance_id"), F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("ts", F.lit("")).alias("ts"),
    ).where("session_id is not null")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, utterance_id, role, content, secs, secs_loose, i, n, and blk, own for windows.

    Rows alike in all but ingested_at are one. role is trimmed and in lower case, '' for null; content is '' for null.
    i is the 0-based place by utterance_id (those that are no whole number last), then role, content, ts.
    """
    rows = _delivered(spark, sf_dir)
    rows = rows.withColumn("block", F.coalesce(F.shiftright("utterance_id", 12), F.lit(NO_ID))).repartition("session_id", "block").dropDuplicates()
    placed = numbered(rows, "session_id", "block", [F.asc_nulls_last("utterance_id"), "role", "content", "ts"])
    timed = placed.withColumn("secs", F.expr(elapsed("ts"))).withColumn("secs_loose", F.expr(elapsed("ts", strict=False)))
    return with_halo(timed.select("session_id", "utterance_id", "role", "content", "secs", "secs_loose", "i", "n"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
UTT = f"""select *, 0 as blk, true as own, {elapsed('ts')} as secs, {elapsed('ts', strict=False)} as secs_loose,
 row_number() over (partition by session_id order by utterance_id nulls last, role, content, ts) - 1 as i, count(*) over (partition by session_id) as n
 from (select distinct upper(trim(session_id, {_WS})) as session_id, try_cast(regexp_extract(trim(utterance_id, {_WS}), '^([+-]?[0-9]+)([.]0*)?$', 1) as bigint) as utterance_id,
  lower(trim(coalesce(role, ''))) as role, coalesce(content, '') as content, coalesce(ts, '') as ts from test_transcripts where session_id is not null) d"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """response_id, session_id, lo_id ('UNK' for none), lo_text ('' for none): each response once, the last delivery."""
    f = read(spark, sf_dir, "test_features")
    last = f.groupBy(norm_id("response_id").alias("response_id")).agg(F.max(F.struct("ingested_at", "session_id", F.coalesce("learning_objective_id", F.lit("")).alias("o"), F.coalesce("learning_objective", F.lit("")).alias("t"))).alias("r"))
    lo = norm_id("r.o")
    return last.where("response_id is not null").select("response_id", norm_id("r.session_id").alias("session_id"), F.when(lo == "", "UNK").otherwise(lo).alias("lo_id"), F.col("r.t").alias("lo_text"))


RESP = f"""select response_id, upper(trim(session_id, {_WS})) as session_id, case when upper(trim(o, {_WS})) = '' then 'UNK' else upper(trim(o, {_WS})) end as lo_id, t as lo_text
 from (select upper(trim(response_id, {_WS})) as response_id, session_id, coalesce(learning_objective_id, '') as o, coalesce(learning_objective, '') as t,
  row_number() over (partition by upper(trim(response_id, {_WS})) order by ingested_at desc, session_id desc, coalesce(learning_objective_id, '') desc, coalesce(learning_objective, '') desc) as k from test_features where response_id is not null) x where k = 1"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """response_id, y (0 or 1): labels given as text in either form, each response once."""
    t = read(spark, sf_dir, "response_labels")
    return t.groupBy(norm_id("response_id").alias("response_id")).agg(F.max(F.col("is_correct").try_cast("double")).cast("int").alias("y")).where("response_id is not null and y is not null")


LABELS = f"select * from (select upper(trim(response_id, {_WS})) as response_id, cast(max(try_cast(is_correct as double)) as int) as y from response_labels where response_id is not null group by 1) l where y is not null"


def _bare(content: str) -> F.Column:
    return F.regexp_replace(content, r"^\s+|\s+$", "")


def talk(utt: DataFrame) -> DataFrame:
    """session_id, i, n, role (teacher or student), content, low, secs and blk, own: what tutor and student say.

    Of utterances, those of the two roles with content, trimmed, and numbered anew from 0.
    """
    said = utt.where("own and role in ('tutor', 'student')").withColumn("content", _bare("content")).where("content <> ''")
    said = said.select("session_id", F.when(F.col("role") == "tutor", "teacher").otherwise("student").alias("role"), "content", F.lower("content").alias("low"), "secs", F.col("i").alias("at"), F.floor(F.col("i") / 4096).alias("block"))
    return with_halo(numbered(said, "session_id", "block", ["at"]).drop("at", "block"))


TALK = r"""select session_id, case when role = 'tutor' then 'teacher' else 'student' end as role, said as content, lower(said) as low, secs, row_number() over (partition by session_id order by i) - 1 as i, count(*) over (partition by session_id) as n, 0 as blk, true as own
 from (select *, regexp_replace(content, '^\s+|\s+$', '', 'g') as said from utt where role in ('tutor', 'student')) x where said <> ''"""


def turns(said: DataFrame) -> DataFrame:
    """session_id, turn, teacher, student, last_student, i, n and blk, own: a turn is a teacher block, then a student block.

    A new turn begins where the teacher speaks after the student; the first is 0 if the student opens, else 1. Texts of
    a block are joined by a space. A last turn without student text is dropped; i and n number the rest. last_student is
    the place of the turn's last student utterance in talk, null for no turn that is left.
    """
    w = W.partitionBy("session_id", "blk").orderBy("i")
    flagged = said.withColumn("flag", F.when((F.col("role") == "teacher") & (F.lag("role").over(w) == "student"), 1).otherwise(F.when((F.col("i") == 0) & (F.col("role") == "teacher"), 1).otherwise(0)))
    counted = running_sum(flagged.where("own"), "session_id", "blk", ["i"], "flag", "turn")
    block = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("i", "content")))), lambda x: x["content"]), " ")
    built = counted.groupBy("session_id", "turn").agg(block("teacher").alias("teacher"), block("student").alias("student"), F.max(F.when(F.col("role") == "student", F.col("i"))).alias("last_student"))
    kept = built.where("student <> ''").withColumn("block", F.floor(F.col("turn") / 4096))
    return with_halo(numbered(kept, "session_id", "block", ["turn"]).drop("block"))


TURNS = """select session_id, turn, teacher, student, last_student, row_number() over (partition by session_id order by turn) - 1 as i, count(*) over (partition by session_id) as n, 0 as blk, true as own
 from (select session_id, turn, coalesce(string_agg(case when role = 'teacher' then content end, ' ' order by i), '') as teacher, coalesce(string_agg(case when role = 'student' then content end, ' ' order by i), '') as student, max(case when role = 'student' then i end) as last_student
  from (select *, sum(flag) over (partition by session_id order by i) as turn from (select *, case when role = 'teacher' and (lag(role) over (partition by session_id order by i) = 'student' or i = 0) then 1 else 0 end as flag from talk) a) b group by 1, 2) c where student <> ''"""


def turn_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, i, size: the length of teacher and student of each turn of turns(), without their texts.

    Where turns begin depends on the order of roles alone, and rows alike in utterance_id and role are of one turn. So
    texts are only moved to drop rows delivered twice. A block's rows are cut into pieces, teacher then student; only
    a block's first piece may go on with a turn, which a window over one row a block tells.
    """
    rows = _delivered(spark, sf_dir).where("role in ('tutor', 'student')")
    # rows without id are ordered by role first, so that what they hold may lie in any block of its role
    spread = F.lit(NO_ID) + F.when(F.col("role") == "tutor", 64).otherwise(0) + F.pmod(F.hash("content", "ts"), F.lit(64))
    rows = rows.withColumn("block", F.coalesce(F.shiftright("utterance_id", 12), spread)).repartition("session_id", "block").dropDuplicates()
    sized = rows.select("session_id", "block", "utterance_id", "role", F.length(_bare("content")).alias("size"))
    said = sized.groupBy("session_id", "block", "utterance_id", "role").agg(F.sum("size").alias("size"), F.count(F.expr("nullif(size, 0)")).alias("n")).where("n > 0")
    w = W.partitionBy("session_id", "block").orderBy(F.asc_nulls_last("utterance_id"), "role")
    flagged = said.withColumn("flag", F.when((F.col("role") == "tutor") & (F.lag("role").over(w) == "student"), 1).otherwise(0))
    of = lambda role, what: F.coalesce(F.sum(F.when(F.col("role") == role, F.col(what))), F.lit(0))
    pieces = flagged.withColumn("piece", F.sum("flag").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("session_id", "block", "piece")
    pieces = cut(pieces.agg(F.sum("size").alias("size"), of("tutor", "n").alias("teacher"), of("student", "n").alias("student")))

    ends = pieces.groupBy("session_id", "block").agg(F.max("piece").alias("more"), F.min_by("teacher", "piece").alias("first"), F.max_by("student", "piece").alias("last"))
    past = W.partitionBy("session_id").orderBy("block")
    begins = F.when(F.lag("last").over(past).isNull() | (F.col("first") > 0) & (F.lag("last").over(past) > 0), 1).otherwise(0)
    before = F.sum(F.col("begins") + F.col("more")).over(past.rowsBetween(W.unboundedPreceding, 0)) - F.col("more") - 1
    ends = ends.withColumn("begins", begins).select("session_id", "block", before.alias("before"))
    placed = pieces.join(ends, ["session_id", "block"]).withColumn("i", F.col("before") + F.col("piece"))
    built = placed.groupBy("session_id", "i").agg(F.sum("size").alias("size"), F.sum("teacher").alias("teacher"), F.sum("student").alias("student")).where("student > 0")
    # texts of a role are joined by a space
    return built.select("session_id", "i", (F.col("size") + F.greatest(F.col("teacher") - 1, F.lit(0)) + F.col("student") - 1).alias("size"))
