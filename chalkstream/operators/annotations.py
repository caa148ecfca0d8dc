"""Compilers of hard annotations: shares of codes, temporal profile, fallbacks, student states, rubric and arc records."""

from __future__ import annotations

from chalkstream.functions.codes import MOVES, STATES
from chalkstream.functions.dialect import Dialect
from chalkstream.operators.profiles import r6


def _one(e: Dialect) -> str:
    return "1.0D" if e.spark else "1.0"


def annotations_sql(e: Dialect, raw: str) -> str:
    """session_id, utterance_id, role, code, pos: annotations with a code; moves are the tutor's, states the student's."""
    return f"select upper(trim(session_id)) as session_id, utterance_id, case annotation_type when 'move' then 'tutor' else 'student' end as role, code, coalesce(position_frac, 0.5) as pos from {raw} where code is not null and session_id is not null"


def tutor_codes_sql(e: Dialect, ann: str) -> str:
    """Shares of the tutor's codes among substantive ones, quotients, entropy in bits, prompting by thirds, fallbacks.

    A fallback is a prompt directly followed, among substantive codes, by the answer. The administrative share is of all.
    """
    one = _one(e)
    shares = ", ".join(f"{r6(f'''coalesce(count_if(code = '{c}') * {one} / nullif({'count(*)' if c == 'ADMINISTRATIVE' else 'count_if(sub)'}, 0), 0)''')} as {c.lower()}" for c in MOVES)
    pr, ga = "code like 'PROMPTING%'", "code = 'GIVING_ANSWER'"
    he = lambda cond: f"coalesce(count_if({pr} and sub and {cond}) * {one} / nullif(count_if(sub and {cond}), 0), 0)"
    thirds = {"early": "pos < 0.33", "mid": "pos >= 0.33 and pos < 0.67", "late": "pos >= 0.67"}
    return f"""with a as (select *, code <> 'ADMINISTRATIVE' as sub from {ann} where role = 'tutor'),
f as (select session_id, count_if({pr} and nxt = 'GIVING_ANSWER') as fb from (select *, lead(code) over (partition by session_id order by utterance_id, code) as nxt from a where sub) x group by session_id),
en as (select session_id, -sum(c * {one} / t * ln(c * {one} / t)) / ln(2) as h from (select session_id, code, count(*) as c, sum(count(*)) over (partition by session_id) as t from a where sub group by session_id, code) x group by session_id),
s as (select session_id, count(*) as n_codes, {shares}, {r6(f'coalesce(count_if({pr}) * {one} / nullif(count_if(sub), 0), 0)')} as high_engagement_ratio, {r6(f"count_if({pr}) * {one} / (count_if(code like 'EXPLAINING%' or {ga}) + 1)")} as elicit_vs_tell, {r6(f"count_if(code in ('GIVING_HINT', 'GIVING_EXAMPLE')) * {one} / (count_if({ga}) + 1)")} as scaffold_vs_tell,
 {r6(f"coalesce(count_if(code = 'FEEDBACK_CORRECT') * {one} / nullif(count_if(code in ('FEEDBACK_CORRECT', 'FEEDBACK_INCORRECT')), 0), 0)")} as feedback_positive_rate, {', '.join(f'{r6(he(c))} as he_{k}' for k, c in thirds.items())}, {r6(he(thirds['late']) + ' - ' + he(thirds['early']))} as scaffold_slope, count_if({pr}) as n_prompts,
 {r6(f"count_if({ga} and sub and pos >= 0.67) * {one} / greatest(count_if(sub and pos >= 0.67), 1)")} as giving_answer_late from a group by session_id)
select s.*, coalesce(fb, 0) as fallback_count, {r6(f'coalesce(fb, 0) * {one} / greatest(n_prompts, 1)')} as fallback_rate, {r6('coalesce(h, 0)')} as move_entropy from s left join f on s.session_id = f.session_id left join en on s.session_id = en.session_id"""


def student_codes_sql(e: Dialect, ann: str) -> str:
    """Shares of the student's states, and corrections by self for each confusion."""
    one = _one(e)
    shares = ", ".join(f"{r6(f'''count_if(code = '{c}') * {one} / count(*)''')} as stu_{c.lower()}" for c in [*STATES, "ANSWER_ONLY", "REASONING_SHOWN", "INSIGHT_DELIGHT"])
    return f"select session_id, count(*) as n_states, {shares}, {r6(f'''coalesce(count_if(code = 'SELF_CORRECTING') * {one} / nullif(count_if(code = 'CONFUSION_EXPRESSED'), 0), 0)''')} as stu_confusion_resolve from {ann} where role = 'student' group by session_id"


def compiled_sql(e: Dialect, tutor: str, student: str) -> str:
    """Sessions of either compiler, absent parts 0."""
    return f"""select coalesce(t.session_id, s.session_id) as session_id, coalesce(n_codes, 0) as n_codes, coalesce(n_states, 0) as n_states, coalesce(high_engagement_ratio, 0) as high_engagement_ratio, coalesce(move_entropy, 0) as move_entropy, coalesce(fallback_count, 0) as fallback_count, coalesce(stu_confusion_expressed, 0) as stu_confusion_expressed, coalesce(stu_reasoning_shown, 0) as stu_reasoning_shown
from {tutor} t full outer join {student} s on t.session_id = s.session_id"""


def code_windows_sql(e: Dialect, ann: str, utt: str) -> str:
    """Utterances within the span of a session's annotations: their number, and how many carry a code (semi join)."""
    return f"""with b as (select session_id, min(utterance_id) as a, max(utterance_id) as z from {ann} group by session_id)
select u.session_id, count(*) as n_span, count(distinct case when c.utterance_id is not null then u.utterance_id end) as n_coded from {utt} u join b on u.session_id = b.session_id and u.utterance_id between b.a and b.z
left join (select distinct session_id, utterance_id from {ann}) c on u.session_id = c.session_id and u.utterance_id = c.utterance_id where u.own group by u.session_id"""


def objective_codes_sql(e: Dialect, raw: str) -> str:
    """Annotations by session and objective: how many, the share of prompts, and recency."""
    return f"select upper(trim(session_id)) as session_id, upper(trim(lo_id)) as lo_id, count(*) as n, {r6(f'''count_if(code like 'PROMPTING%') * {_one(e)} / count(*)''')} as prompt_share, {r6('max(position_frac)')} as recency from {raw} where lo_id is not null and code is not null group by 1, 2"
