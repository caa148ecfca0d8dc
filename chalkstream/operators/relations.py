"""Joins and set operators between the tables, in the forms session analytics needs."""

from __future__ import annotations

from chalkstream.functions.dialect import Dialect
from chalkstream.operators.profiles import r6


def labelled_sql(e: Dialect, resp: str, labels: str) -> str:
    """Responses with their label: an inner join on the response."""
    return f"select r.response_id, r.session_id, r.lo_id, l.y from {resp} r join {labels} l on r.response_id = l.response_id"


def spine_sql(e: Dialect, resp: str, profile: str, task: str, difficulty: str) -> str:
    """A wide row for each response: session, task and objective blocks, all left joined on their keys, 0 where there is none."""
    return f"""select r.response_id, coalesce(p.n_utterances, 0) as n_utterances, coalesce(p.student_words, 0) as student_words, coalesce(p.student_ttr, 0) as student_ttr, t.session_n_responses, d.lo_mean_correct, d.lo_difficulty_rank, cast(p.session_id is null as int) as no_transcript
from {resp} r left join {profile} p on r.session_id = p.session_id left join {task} t on r.session_id = t.session_id left join {difficulty} d on r.response_id = d.response_id"""


def fallback_sql(e: Dialect, resp: str, utt: str) -> str:
    """Responses whose session has no transcript (anti join), which take the base rate."""
    return f"select r.response_id, r.session_id from {resp} r where not exists (select 1 from {utt} u where u.session_id = r.session_id and u.own)"


def covered_sql(e: Dialect, resp: str, utt: str) -> str:
    """Sessions asked for that have a transcript (semi join), once each."""
    return f"select distinct r.session_id from {resp} r where exists (select 1 from {utt} u where u.session_id = r.session_id and u.own)"


def annotated_sql(e: Dialect, utt: str, ann: str) -> str:
    """Sessions' utterances with the codes on them: a join on session and utterance after a cast of keys."""
    return f"select u.session_id, u.role, a.code, count(*) as n, {r6('avg(a.pos)')} as mean_pos from {utt} u join {ann} a on u.session_id = a.session_id and u.utterance_id = a.utterance_id where u.own group by u.session_id, u.role, a.code"


def extremes_sql(e: Dialect, utt: str) -> str:
    """The longest utterance of a session (of ties the first), and where the first question and the last praise stand."""
    return f"""select session_id, max(length(content)) as longest, min(case when length(content) = mx then i end) as longest_at, min(case when content like '%?%' then i end) as first_question, max(case when {e.has('content', 'praise')} then i end) as last_praise
from (select *, max(length(content)) over (partition by session_id, blk) as mb, mx from {utt} join (select session_id as sid, max(length(content)) as mx from {utt} where own group by session_id) m on session_id = m.sid) x where own group by session_id"""


def distinct_sql(e: Dialect, resp: str) -> str:
    """Different sessions in the order of their first response, and the first response of each session and objective."""
    return f"select session_id, lo_id, min(response_id) as first_response, count(*) as n from {resp} group by session_id, lo_id"


def union_sql(e: Dialect, utt: str, resp: str) -> str:
    """Keys of both tables: union, intersection and difference by session."""
    return f"""with a as (select distinct session_id from {utt}), b as (select distinct session_id from {resp})
select 'both' as part, count(*) as n from (select * from a intersect select * from b) x union all select 'only_transcripts', count(*) from (select * from a except select * from b) y union all select 'only_responses', count(*) from (select * from b except select * from a) z union all select 'either', count(*) from (select * from a union select * from b) w"""


def answer_log_sql(e: Dialect, events: str) -> str:
    """Events of a user as an ordered log: place, gap to the one before, the last error before each event."""
    lag = "lag(ts) over (partition by user_id order by ts, event_id)"
    gap = f"(unix_micros(cast(ts as timestamp)) - unix_micros(cast({lag} as timestamp))) / 1000000.0D" if e.spark else f"(epoch_us(ts) - epoch_us({lag})) / 1000000.0"
    return f"""with a as (select user_id, event_id, event_type, value, {gap} as gap, max(case when event_type = 'error' then event_id end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_error from {events})
select user_id, count(*) as n, {r6('avg(gap)')} as mean_gap, count_if(coalesce(gap > 3600, false)) as n_long, count(last_error) as after_error, {r6('avg(case when last_error is not null then value end)')} as value_after_error from a group by user_id"""
