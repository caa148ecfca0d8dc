"""Ordered operators within a session: verdicts, impasses, repair arcs, records, interactions, look-back and look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkstream.functions import lexicons as L
from chalkstream.functions.dialect import Dialect, run
from chalkstream.functions.scan import BLOCK, numbered
from chalkstream.operators.profiles import r6

#: Utterances after which an impasse ends by itself; rows a repair looks ahead for its kind, and for another error.
EXPIRY, KIND_AHEAD, ERROR_AHEAD = 10, 5, 6
#: Characters of a reply in which its verdict stands, and widths of the texts that heads see.
VERDICT_HEAD, TEACHER_TAIL, STUDENT_HEAD, REPLY_HEAD = 90, 220, 220, 160


def turns_sql(e: Dialect, turns: str) -> str:
    """Turn merge (a row for each turn), with the text an annotator sees: [A] the answer, [R] the reply that follows."""
    nxt = f"coalesce(lead(teacher) over ({e.w}), '')"
    return f"""select session_id, turn, teacher, student, n as n_turns, annotator_text from (select *, concat(right(teacher, {TEACHER_TAIL}), ' [A] ', substr(student, 1, {STUDENT_HEAD}), ' [R] ', substr({nxt}, 1, {REPLY_HEAD})) as annotator_text from {turns}) x where own"""


def verdict(e: Dialect, text: str) -> str:
    """1, 0 or null: what a reply's opening says of the answer before it; a negative opening wins."""
    head = f"substr({text}, 1, {VERDICT_HEAD})"
    return f"case when {e.has(head, 'verdict_negative')} or {e.has(head, 'feedback_incorrect')} then 0 when {e.has(head, 'verdict_positive')} and not {e.has(text, 'backchannel')} then 1 end"


def turn_verdicts_sql(e: Dialect, turns: str) -> str:
    """The verdict on each turn, read from the teacher block of the next, and the utterance it falls on."""
    return f"select session_id, turn, last_student, {verdict(e, 'reply')} as verdict from (select *, lead(teacher) over ({e.w}) as reply from {turns}) x where own"


def impasse_sql(e: Dialect, talk: str) -> str:
    """The contingency block: how moves depend on whether the student is at an impasse when they are made.

    An impasse holds at a row if the last student event before it, at most EXPIRY rows back, is confusion; a student
    row of both kinds is confusion.
    """
    event = f"case when role = 'student' and {e.has('low', 'confusion')} then 1 when role = 'student' and {e.has('low', 'resolution')} then 0 end"
    one = "1.0D" if e.spark else "1.0"
    rate = lambda a, b: f"{a} * {one} / greatest(1, {b})"
    late = "floor(0.8 * n)"
    return f"""with a as (select *, {event} as ev, {e.has('low', 'tell')} as tl, {e.has('low', 'elicit')} as el from {talk}),
b as (select *, coalesce({e.last('ev', f'({e.w} rows between {EXPIRY} preceding and 1 preceding)')}, 0) = 1 as imp, role = 'teacher' as tut from a),
c as (select session_id, max(n) as n, count_if(tut and imp) as ti, count_if(tut and not imp) as tf, count_if(tut and imp and tl) as tli, count_if(tut and not imp and tl) as tlf, count_if(tut and imp and el) as eli, count_if(tut and not imp and el) as elf,
 count_if(imp) as iu, count_if(imp and i >= 0.8 * n) as li, count_if(not tut and not imp and coalesce(ev = 1, false)) as ep from b where own group by session_id)
select session_id, {r6(rate('tli', 'ti'))} as ctg_tell_imp, {r6(rate('tlf', 'tf'))} as ctg_tell_flu, {r6(rate('eli', 'ti'))} as ctg_elicit_imp, {r6(rate('elf', 'tf'))} as ctg_elicit_flu, {r6(rate('tli', 'ti') + ' - ' + rate('tlf', 'tf'))} as ctg_tell_contrast,
 {r6(rate('eli', 'ti') + ' - ' + rate('elf', 'tf'))} as ctg_elicit_contrast, {r6(rate('ti', 'ti + tf'))} as ctg_imp_share, {r6(rate('iu', 'n'))} as ctg_imp_utt_share, {r6(rate('li', 'n - ' + late))} as ctg_late_imp_share, {r6(rate('ep', 'n'))} as ctg_episodes_per_utt from c"""


def repair_kind(e: Dialect, low: str) -> str:
    """answer before prompt before explain; null for none of them."""
    any_of = lambda names: " or ".join(e.has(low, n) for n in names)
    return f"case when {any_of(('gives_answer', 'bare_answer'))} then 'answer' when {any_of(('prompt_self_correction', 'prompt_explanation', 'elicit'))} then 'prompt' when {any_of(('procedural', 'conceptual', 'tell'))} then 'explain' end"


def repairs_sql(e: Dialect, talk: str, verdicts: str) -> str:
    """The repair block. An arc starts where the tutor corrects; its kind is that of the correction itself, else of the
    first tutor row of the KIND_AHEAD after it. It recovers if the next verdict, however far, is positive, and errs again
    if another correction follows within ERROR_AHEAD rows. Without arcs shares are null and has_arc is 0.

    The next verdict is sought among arcs and verdicts by place: within a block, then at the first of the blocks after.
    """
    one = "1.0D" if e.spark else "1.0"
    ahead = "order by i, is_verdict desc rows between 1 following and unbounded following"
    seen = f"seen as (select *, {e.first('case when is_verdict = 1 then v end', f'(partition by session_id {ahead})')} as next_v from both_rows)"
    if e.spark:  # within blocks, and from the first verdict of the blocks after
        seen = f"""cut as (select *, floor(i / {BLOCK}) as blk from both_rows), heads as (select session_id, blk, min_by(v, i) filter (where is_verdict = 1) as first_v from cut group by session_id, blk),
far as (select session_id, blk, {e.first('first_v', '(partition by session_id order by blk rows between 1 following and unbounded following)')} as far_v from heads),
near as (select *, {e.first('case when is_verdict = 1 then v end', f'(partition by session_id, blk {ahead})')} as near_v from cut),
seen as (select near.*, coalesce(near_v, far_v) as next_v from near join far on near.session_id = far.session_id and near.blk = far.blk)"""
    return f"""with a as (select t.*, role = 'teacher' and ({e.has('low', 'corrective')} or {e.has('low', 'feedback_incorrect')}) as cor, case when role = 'teacher' then coalesce({repair_kind(e, 'low')}, '-') end as kind from {talk} t),
b as (select *, nullif(kind, '-') as own_kind, nullif({e.first('kind', f'({e.w} rows between 1 following and {KIND_AHEAD} following)')}, '-') as next_kind, coalesce(max(cast(cor as int)) over ({e.w} rows between 1 following and {ERROR_AHEAD} following), 0) as again from a),
arcs as (select session_id, i, coalesce(own_kind, next_kind) as kind, again, 0 as is_verdict, cast(null as int) as v from b where own and cor),
both_rows as (select session_id, i, kind, again, is_verdict, v from arcs union all select session_id, last_student, null, null, 1, verdict from {verdicts} where verdict is not null),
{seen},
s as (select session_id, count(*) as n_arcs, count_if(coalesce(kind = 'prompt', false)) as p, count_if(coalesce(kind = 'explain', false)) as x, count_if(coalesce(kind = 'answer', false)) as a, sum(coalesce(next_v, 0)) as rec, sum(again) as err from seen where is_verdict = 0 group by session_id),
t as (select session_id, count_if(role = 'teacher') as n_tutor from {talk} where own group by session_id)
select t.session_id, {r6(f'p * {one} / greatest(1, p + x + a)')} as rep_prompt_share, {r6(f'x * {one} / greatest(1, p + x + a)')} as rep_explain_share, {r6(f'a * {one} / greatest(1, p + x + a)')} as rep_answer_share, {r6(f'rec * {one} / n_arcs')} as rep_recovery_rate, {r6(f'err * {one} / n_arcs')} as rep_re_error_rate,
 {r6(f'coalesce(n_arcs, 0) * {one} / greatest(1, n_tutor)')} as rep_arcs_per_tutor_turn, cast(n_arcs is not null as int) as rep_has_arc from t left join s on t.session_id = s.session_id"""


def record_sql(e: Dialect, graded: str) -> str:
    """The record block over graded answers (session_id, k from 0, m of them, turn, n_turns, p): means, last few, recency, runs, halves, trend."""
    one = "1.0D" if e.spark else "1.0"
    island = "k - alike" if e.spark else "row_number() over (partition by session_id order by k) - row_number() over (partition by session_id, p >= 0.5 order by k)"
    return f"""with a as (select *, p >= 0.5 as ok, {island} as island, exp(-(m - 1 - k) / {'5.0D' if e.spark else '5.0'}) as w, turn * {one} / greatest(n_turns, 1) as rel from {graded}),
runs as (select session_id, coalesce(max(case when ok then c end), 0) as rc, coalesce(max(case when not ok then c end), 0) as ri from (select session_id, ok, island, count(*) as c from a group by session_id, ok, island) x group by session_id),
s as (select session_id, max(m) as m, max(n_turns) as nt, avg(p) as acc, max(case when k = m - 1 then p end) as l1, avg(case when k >= m - 3 then p end) as l3, avg(case when k >= m - 5 then p end) as l5, sum(w * p) / sum(w) as rec, avg(case when k >= floor(m / {'2.0D' if e.spark else '2.0'}) then p end) - avg(case when k < floor(m / {'2.0D' if e.spark else '2.0'}) then p end) as half,
 case when max(m) > 2 then regr_slope(p, k * {one}) else 0.0 end as trend, coalesce(max(case when not ok then k end) * {one} / max(m), 1.0) as pli, avg(case when rel <= 0.3 then p end) as early, avg(case when rel >= 0.7 then p end) as late from a group by session_id)
select s.session_id, {r6('acc')} as rec_accuracy, {r6('l1')} as rec_last_1, {r6('l3')} as rec_last_3, {r6('l5')} as rec_last_5, {r6('rec')} as rec_recency_acc, {r6(f'rc * {one} / m')} as rec_run_correct_share, {r6(f'ri * {one} / m')} as rec_run_incorrect_share, {r6('half')} as rec_half_delta, {r6('trend')} as rec_trend,
 {r6('pli')} as rec_pos_last_incorrect, {r6('early')} as rec_early_acc, {r6('late')} as rec_late_acc, {r6(f'm * {one} / greatest(nt, 1)')} as rec_answered_share, {r6(f'ln(1 + m)')} as rec_log_answered from s join runs on s.session_id = runs.session_id"""


def graded_sql(e: Dialect, turns: str) -> str:
    """Answers that count, with a probability of being right: from the stub of a head, a share of the turn's MD5.

    A turn is an answer if its second share is at least a half, as with a head that tells answers from other talk.
    """
    p, a = (e.share_of(f"concat('{x}|', session_id, '|', cast(turn as string))") if e.spark else e.share_of(f"concat('{x}|', session_id, '|', cast(turn as varchar))") for x in ("cor", "ans"))
    placed = "" if e.spark else "row_number() over (partition by session_id order by turn) - 1 as k, count(*) over (partition by session_id) as m, "
    return f"select session_id, {placed}turn, n as n_turns, {p} as p from {turns} where own and {a} >= 0.5"


def graded(turns: DataFrame) -> DataFrame:
    """graded_sql with k and m, and alike, the place among the session's answers that are as right or wrong; block by block."""
    rows = run(graded_sql, turns=turns).withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("part", F.concat_ws("|", "session_id", (F.col("p") >= 0.5).cast("string")))
    return numbered(numbered(rows, "session_id", "block", ["turn"], "k", "m"), "part", "block", ["turn"], "alike", "n_alike").drop("part", "block", "n_alike")


def interactions_sql(e: Dialect, utt: str) -> str:
    """The interaction block: repairs completed, checks affirmed, answers attempted and confirmed, questions answered at length.

    The next tutor row, and whether a long answer comes before it, are sought however far: within the block, and rows that
    find none there count by what the blocks after begin with.
    """
    ack = e.strings(L.ACKNOWLEDGEMENTS)
    one = "1.0D" if e.spark else "1.0"
    rows = f"""with a as (select *, lower(content) as low, role = 'student' as stu, role = 'tutor' as tut, {e.talk_words('content')} as tk from {utt}),
f as (select *, {e.size('tk')} as wc, {e.matches('low', '[?]' + chr(92) + 's*$')} as q, {e.has('low', 'corrective')} as cr, {e.has('low', 'confirm')} as cf, {e.has('low', 'check_understanding')} as cfu, {e.has('low', 'elicit')} as el, {e.has('low', 'maths')} as mt,
 {e.has('low', 'resolution')} or ({e.size('tk')} between 1 and 3 and {e.size(e.without('tk', ack))} = 0) as yes, {e.has('low', 'hedge')} or {e.has('low', 'confusion')} as unsure from a),"""
    ahead, future = f"({e.w} desc rows between unbounded preceding and 1 preceding)", "(partition by session_id order by blk desc rows between unbounded preceding and 1 preceding)"
    attempt, ask, check = "stu and wc > 5 and (mt or not q)", "tut and (q or el)", "tut and cfu and role_after = 'student'"
    long_or_tutor = "case when tut then 0 when stu and wc > 5 then 1 end"
    whole = lambda n, left, found: f"sum({n} + case when {found} then {left} else 0 end)"
    return f"""{rows}
g as (select *, lag(role) over b as role_after, lag(yes) over b as yes_after, lag(unsure) over b as unsure_after, {e.last('case when tut then cf end', ahead)} as next_cf, {e.last(long_or_tutor, ahead)} as long_answer, coalesce(bool_or(tut and cf) over {ahead}, false) as cf_later from f window b as ({e.w} desc)),
blocks as (select session_id, blk, min_by(cf, i) filter (where tut) as first_cf, min_by({long_or_tutor}, i) filter (where tut or stu and wc > 5) as first_long, bool_or(tut and cf) as any_cf, count_if(tut and cr) as n_cr, count_if(tut and cr and cf_later) as done, count_if(tut and cr and not cf_later) as done_left,
 count_if({check} and yes_after) as yes, count_if({check} and (yes_after or unsure_after)) as checks, count_if(stu) as n_stu, count_if({attempt}) as attempts, count_if({attempt} and coalesce(next_cf, false)) as confirmed, count_if({attempt} and next_cf is null) as confirmed_left,
 count_if({ask}) as asks, count_if({ask} and coalesce(long_answer = 1, false)) as answered, count_if({ask} and long_answer is null) as answered_left from g where own group by session_id, blk),
beyond as (select *, {e.last('first_cf', future)} as far_cf, {e.last('first_long', future)} as far_long, bool_or(any_cf) over {future} as far_any from blocks)
select session_id, {r6(f"{whole('done', 'done_left', 'far_any')} * {one} / nullif(sum(n_cr), 0)")} as repair_complete_rate, {r6(f'sum(yes) * {one} / nullif(sum(checks), 0)')} as cfu_affirm_rate, {r6(f'case when sum(attempts) > 0 then sum(attempts) * {one} / sum(n_stu) end')} as answer_attempt_rate,
 {r6(f"{whole('confirmed', 'confirmed_left', 'far_cf')} * {one} / nullif(sum(attempts), 0)")} as answer_confirmed_rate, {r6(f"{whole('answered', 'answered_left', 'far_long = 1')} * {one} / nullif(sum(asks), 0)")} as funnel_rate from beyond group by session_id"""


def neighbours_sql(e: Dialect, utt: str) -> str:
    """As-of look-ups: the latest text of the other role before a row, the first tutor row after it, and adjacent roles.

    Strictly before and after, however far; missing is ''. They are sought within a row's block, then at what the blocks
    before end with and those after begin with, carried by windows over one row a block.
    """
    tutor, student = (f"case when role = '{role}' then content end" for role in ("tutor", "student"))
    back, ahead = f"({e.w} rows between unbounded preceding and 1 preceding)", f"({e.w} desc rows between unbounded preceding and 1 preceding)"
    past, future = (f"(partition by session_id order by blk{d} rows between unbounded preceding and 1 preceding)" for d in ("", " desc"))
    far = f"""with ends as (select session_id, blk, max_by(content, i) filter (where role = 'tutor') as tutor_last, max_by(content, i) filter (where role = 'student') as student_last, min_by(content, i) filter (where role = 'tutor') as tutor_first from {utt} where own group by session_id, blk),
carried as (select session_id, blk, {e.last('tutor_last', past)} as tutor_far, {e.last('student_last', past)} as student_far, {e.last('tutor_first', future)} as next_far from ends)
"""
    before = {"tutor": f"coalesce({e.last(tutor, back)}, tutor_far)", "student": f"coalesce({e.last(student, back)}, student_far)"}
    return f"""{far}select session_id, i, role, coalesce(case role when 'student' then {before['tutor']} when 'tutor' then {before['student']} end, '') as other_before, coalesce({e.last(tutor, ahead)}, next_far, '') as tutor_after,
 lag(role) over ({e.w}) as role_before, lead(role) over ({e.w}) as role_after, coalesce(max(cast({e.has('content', 'confusion')} as int)) over ({e.w} rows between 2 preceding and 2 following), 0) as near_confusion, own from {utt} left join carried using (session_id, blk)"""


def neighbours_own_sql(e: Dialect, near: str) -> str:
    return f"select session_id, i, role, other_before, tutor_after, role_before, role_after, near_confusion from {near} where own"


def with_role_places(utt: DataFrame) -> DataFrame:
    """The own rows of utt with k, the place among the session's rows of that role, and m, their number; block by block."""
    own = utt.where("own").withColumn("part", F.concat_ws("|", "session_id", "role")).withColumn("block", F.floor(F.col("i") / BLOCK))
    return numbered(own, "part", "block", ["i"], "k", "m")


def positions_sql(e: Dialect, utt: str) -> str:
    """utt in Spark: with_role_places. Place within the role as a fraction, late from two thirds on; thirds by 0.33 and 0.67; the first 40; the last 3 of a role."""
    one = "1.0D" if e.spark else "1.0"
    placed = "k, m" if e.spark else "row_number() over (partition by session_id, role order by i) - 1 as k, count(*) over (partition by session_id, role) as m"
    return f"""with a as (select session_id, i, n, role, {placed} from {utt} where own)
select session_id, role, count(*) as m, {r6(f'avg(k * {one} / greatest(m - 1, 1))')} as mean_place, count_if(k * {one} / greatest(m - 1, 1) >= {one} * 2 / 3) as n_late, count_if(i * {one} / n < 0.33) as n_early_third, count_if(i * {one} / n >= 0.67) as n_last_third, count_if(i < 40) as n_head,
 min(i) as first_at, max(i) as last_at, max(case when k >= m - 3 then i end) - min(case when k >= m - 3 then i end) as last3_span from a group by session_id, role"""


def transcript_sql(e: Dialect, utt: str, resp: str) -> str:
    """The transcript of student and tutor as 'role: content' lines, behind the objective, for each response."""
    text = e.joined("concat(role, ': ', content)", "i", "\\n") if e.spark else "string_agg(concat(role, ': ', content), chr(10) order by i)"
    if e.spark:
        text = "listagg(concat(role, ': ', content), '\\n') within group (order by i)"
    nl = "'\\n'" if e.spark else "chr(10)"
    return f"""with t as (select session_id, {text} as transcript from {utt} where own and role in ('student', 'tutor') group by session_id)
select r.response_id, length(transcript) as n_chars, md5(concat('OBJECTIVE: ', r.lo_text, {nl}, coalesce(transcript, ''))) as prompt_md5, substr(concat('OBJECTIVE: ', r.lo_text, {nl}, coalesce(transcript, '')), 1, 120) as prompt_head from {resp} r left join t on r.session_id = t.session_id"""


def rendering_sql(e: Dialect, turns: str) -> str:
    """The last 24 turns of a session as a rendered dialogue, renumbered from 1."""
    text = "concat('Teacher Turn ', k, ': ', teacher, ' Student Turn ', k, ': ', student)"
    return f"select session_id, max(k) as n_turns, md5({e.joined(text, 'k')}) as text_md5, {'cast(max(length(teacher) + length(student)) as bigint)'} as longest from (select session_id, teacher, student, i - greatest(n - 24, 0) + 1 as k from {turns} where own and i >= n - 24) x group by session_id"
