"""Session profiles: counts, rates, pauses and moves of a session, from one pass over its utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chalkstream.functions import lexicons as L
from chalkstream.functions.dialect import Dialect, run

#: Column -> lexicon of tutor utterances that are counted.
TUTOR_MOVES = {
    "tutor_feedback_incorrect": "feedback_incorrect", "tutor_backchannels": "backchannel", "tutor_prompts_explanation": "prompt_explanation", "tutor_prompts_next_step": "prompt_next_step", "tutor_prompts_self_correction": "prompt_self_correction",
    "tutor_prompts_alt_repr": "prompt_representation", "tutor_tag_questions": "tag_question", "tutor_gives_hint": "hint", "tutor_gives_example": "example", "tutor_explains_procedural": "procedural", "tutor_explains_conceptual": "conceptual",
    "tutor_gives_answer": "gives_answer", "tutor_prior_knowledge_check": "prior_knowledge",
}


def r6(x: str) -> str:
    """Rounded so that engines agree, without a negative zero."""
    return f"round(cast({x} as double), 6) + 0.0"


def session_profile_sql(e: Dialect, utt: str) -> str:
    """The structured block: 57 columns and the tutor-normalised rates, a row for each session.

    Counts are of own rows; pauses are between neighbours with a valid time, in order, and may be negative; late rows are
    from place max(1, floor(0.8 n)); var is of a sample; rates whose denominator is 0 are 0.
    """
    moves = "\n".join(f", {e.has('content', lex)}{' or ' + e.has('content', 'bare_answer') if lex == 'gives_answer' else ''} as m_{col}" for col, lex in TUTOR_MOVES.items())
    stops = e.strings(L.OBJECTIVE_STOPS)
    names = f"{e.size(e.keep(e.found('content', L.NAME_CALL, 1), ('not array_contains(' if e.spark else 'not list_contains(') + e.strings(L.NOT_NAMES) + ', lower(v))'))}"
    counts = ", ".join(f"count_if(tut and m_{c}) as {c}" for c in TUTOR_MOVES)
    rate = lambda a, b: f"case when {b} > 0 then {a} * {'1.0D' if e.spark else '1.0'} / {b} else 0.0 end"
    ttr = f"select session_id, count(distinct t) as types, count(*) as tokens from (select session_id, {e.explode(e.words('content'))} as t from {utt} where own and role = 'student') x group by session_id"
    own_secs = "case when stu then secs_loose end"
    if e.spark:  # what earlier blocks end with, by a window over one row a block
        past = "(partition by session_id order by blk rows between unbounded preceding and 1 preceding)"
        far = f"""ends as (select session_id, blk, max_by(secs_loose, i) filter (where secs_loose is not null) as last_secs, max_by(secs_loose, i) filter (where role = 'student' and secs_loose is not null) as last_own from {utt} where own group by session_id, blk),
carried as (select session_id, blk, {e.last('last_secs', past)} as far_secs, {e.last('last_own', past)} as far_own from ends),
"""
        before, own_before, timed = f"coalesce({e.last('secs_loose', 'a')}, far_secs)", f"coalesce({e.last(own_secs, 'a')}, far_own)", "f left join carried using (session_id, blk)"
    else:
        far, before, own_before, timed = "", e.last("secs_loose", "a"), e.last(own_secs, "a"), "f"
    return f"""
with f as (select *, role = 'student' as stu, role = 'tutor' as tut, {e.size(e.found('content', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+'))} as w, {e.count('content', '[?]')} as q, {e.count('lower(content)', L.PATTERNS['unclear'])} as unclear,
  {e.count('lower(content)', L.PATTERNS['tutor_placeholder'])} as ph, {e.without(e.words('content'), stops)} as toks, i >= greatest(1, floor(0.8 * n)) as late from {utt}),
{far}g as (select *, secs_loose - {before} as pause, case when stu then secs_loose - {own_before} end as own_pause, lag(toks) over b as before, lag(role) over b as role_before from {timed}
  window a as ({e.w} rows between unbounded preceding and 1 preceding), b as ({e.w})),
h as (select *{moves}, {e.has('content', 'praise')} as praise, {e.has('content', 'student_explains')} as explains, {names} as calls, {e.matches('content', chr(94) + chr(92) + 's*' + L.PATTERNS['unclear'] + chr(92) + 's*$')} as only_unclear,
  role_before = 'student' and {e.size('before')} >= 3 and {e.size(e.both('before', 'toks'))} > 0.6 * {e.size('before')} as restates from g where own),
ttr as ({ttr}),
s as (select session_id, count(*) as n_utterances, count_if(stu) as n_student, count_if(tut) as n_tutor, count_if(role = 'background') as n_background, coalesce(sum(case when stu then w end), 0) as student_words, coalesce(sum(case when tut then w end), 0) as tutor_words,
  sum(length(content)) as total_chars, sum(q) as n_question_marks, sum(unclear) as n_unclear, case when count(secs_loose) >= 2 then max_by(secs_loose, case when secs_loose is not null then i end) - min_by(secs_loose, case when secs_loose is not null then i end) else 0 end as session_duration_secs,
  coalesce(avg(pause), 0) as avg_pause_secs, count_if(coalesce(pause > 30, false)) as n_long_pauses, coalesce(avg(own_pause), 0) as avg_student_pause_secs, coalesce(avg(case when stu then w end), 0) as student_words_per_turn, coalesce(var_samp(case when stu then w end), 0) as student_words_var,
  coalesce(max(case when stu then w end), 0) as student_max_turn_words, count_if(stu and w <= 3) as student_short_turns, coalesce(sum(case when stu then q end), 0) as student_questions, coalesce(sum(case when tut then q end), 0) as tutor_questions, count_if(tut and praise) as tutor_praise,
  coalesce(avg(case when tut then w end), 0) as tutor_words_per_turn, count_if(stu and only_unclear) as student_unclear_only, coalesce(sum(case when stu then unclear end), 0) as student_unclear, sum(ph) as tutor_ph_count,
  coalesce(sum(case when stu then ph end), 0) as student_ph, coalesce(sum(case when tut then ph end), 0) as tutor_ph, coalesce(sum(case when tut then calls end), 0) as tutor_name_calls, coalesce(sum(case when late and stu then w end), 0) as late_student_words,
  coalesce(sum(case when late and stu then q end), 0) as late_student_questions, coalesce(sum(case when late and tut then q end), 0) as late_tutor_questions, count_if(late and stu) as late_student, count_if(late and stu and w <= 3) as late_short,
  {counts}, count_if(tut and coalesce(restates, false)) as tutor_restating, count_if(stu and explains) as student_explains from h group by session_id)
select s.session_id, n_utterances, n_student, n_tutor, n_background, cast(student_words as bigint) as student_words, cast(tutor_words as bigint) as tutor_words, {r6('student_words / (tutor_words + 1.0)')} as student_tutor_word_ratio, cast(total_chars as bigint) as total_chars,
 cast(n_question_marks as bigint) as n_question_marks, cast(n_unclear as bigint) as n_unclear, {r6('session_duration_secs')} as session_duration_secs, {r6('avg_pause_secs')} as avg_pause_secs, n_long_pauses, {r6('avg_student_pause_secs')} as avg_student_pause_secs,
 {r6('student_words_per_turn')} as student_words_per_turn, {r6('student_words_var')} as student_words_var, cast(student_max_turn_words as bigint) as student_max_turn_words, student_short_turns, {r6(rate('student_short_turns', 'n_student'))} as student_short_turn_ratio,
 {r6('coalesce(types * 1.0 / tokens, 0)')} as student_ttr, cast(student_questions as bigint) as student_questions, cast(tutor_questions as bigint) as tutor_questions, tutor_praise, {r6('tutor_words_per_turn')} as tutor_words_per_turn, student_unclear_only,
 {r6(rate('student_unclear', 'n_student'))} as unclear_per_student_turn, cast(n_background > 0 as int) as is_tsl, cast(tutor_ph_count > 0 as int) as has_tutor_ph, cast(tutor_ph_count as bigint) as tutor_ph_count, cast(student_ph > 0 as int) as student_says_tutor_name,
 cast(tutor_ph > 0 as int) as tutor_says_tutor_name, cast(tutor_name_calls as bigint) as tutor_name_calls, {r6(rate('tutor_name_calls', 'n_tutor'))} as tutor_name_calls_per_turn, cast(tutor_name_calls > 0 as int) as has_name_call, cast(late_student_words as bigint) as late_student_words,
 cast(late_student_questions as bigint) as late_student_questions, cast(late_tutor_questions as bigint) as late_tutor_questions, {r6(rate('late_short', 'late_student'))} as late_student_short_ratio, {', '.join(TUTOR_MOVES)}, tutor_restating, student_explains,
 {r6('(tutor_prompts_explanation + tutor_prompts_next_step + tutor_prompts_self_correction + tutor_prompts_alt_repr) / (tutor_gives_answer + tutor_explains_procedural + 1.0)')} as elicit_vs_tell_ratio, {r6('(tutor_gives_hint + tutor_gives_example) / (tutor_gives_answer + 1.0)')} as scaffold_vs_tell_ratio,
 {r6('tutor_praise / (tutor_praise + tutor_feedback_incorrect + 1e-9)')} as feedback_positive_ratio, {r6('tutor_prompts_self_correction / (tutor_feedback_incorrect + 1.0)')} as error_response_quality
from s left join ttr on s.session_id = ttr.session_id"""


#: Counts that become rates by tutor utterances; student_explains goes by student utterances.
RATES = (*TUTOR_MOVES, "tutor_restating", "student_explains")


def session_rates_sql(e: Dialect, profile: str) -> str:
    """Rates of the counted moves, and the student's share of utterances; a row for each session of a profile."""
    rates = ", ".join(f"{r6(f'case when {d} > 0 then {c} * 1.0 / {d} else 0.0 end')} as {c}_rate" for c in RATES for d in ["n_student" if c == "student_explains" else "n_tutor"])
    return f"select session_id, {rates}, {r6('case when n_utterances > 0 then n_student * 1.0 / n_utterances else 0.0 end')} as student_turn_share from {profile}"


def dialogue_profile_sql(e: Dialect, utt: str) -> str:
    """The dialogue block: 31 columns, a row for each session.

    Segments are thirds of the places (a float bound); toks are different content words, wc all words of a row; rates
    are shares of a role's rows, 0 without any; -1 says that confusion never came up.
    """
    stops, ack = e.strings([*L.TALK_STOPS, *L.FILLERS]), e.strings(L.ACKNOWLEDGEMENTS)
    has = lambda name: e.has("low", name)
    flags = {"conf": "confusion", "res": "resolution", "selfx": "self_explanation", "hedge": "hedge", "el": "elicit", "tl": "tell", "cf": "confirm", "cr": "corrective", "mt": "maths", "deep": "deep_question", "shallow": "shallow_question"}
    share = lambda cond, of: f"coalesce(avg(case when {of} then cast({cond} as int) end), 0)"
    ttr = f"select session_id, count(distinct t) as types from (select session_id, {e.explode('toks')} as t from f where own and stu) x group by session_id"
    return f"""
with a as (select *, lower(content) as low, role = 'student' as stu, role = 'tutor' as tut, case when i < n / {'3.0D' if e.spark else '3.0'} then 0 when i < 2 * n / {'3.0D' if e.spark else '3.0'} then 1 else 2 end as seg, {e.talk_words('content')} as tk from {utt}),
f as (select *, {e.without('tk', stops)} as toks, {e.size('tk')} as wc, {e.matches('low', '[?]' + chr(92) + 's*$')} as q, {', '.join(f'{has(v)} as {k}' for k, v in flags.items())} from a),
g as (select *, lag(role) over b as role_before, lag(toks) over b as toks_before, lead(role) over b as role_after, lead(secs) over b as secs_after from f window b as ({e.w})),
p as (select session_id, i, row_number() over (partition by session_id order by i) - 1 as k, count(*) over (partition by session_id) as m from (select session_id, i from f where own and stu) x),
gaps as (select session_id, stddev_pop(d) as sd, avg(d) as mean from (select session_id, secs - lag(secs) over (partition by session_id order by secs) as d from f where own and secs is not null) x group by session_id),
h as (select g.*, p.k, p.m, p.k >= p.m - 3 as last3, case when tut and role_before = 'student' then {e.overlap('toks', 'toks_before')} end as jac,
  case when tut and q and role_after = 'student' and secs_after - secs >= 0 then secs_after - secs end as wait, stu and wc between 1 and 3 and {e.size(e.without('tk', ack))} = 0 as ack from g left join p on g.session_id = p.session_id and g.i = p.i where own),
ttr as ({ttr}),
s as (select session_id, count_if(stu) as ns, sum(case when stu then {e.size('toks')} else 0 end) as content, {share('wc > 5', 'stu')} as substantive_turn_rate, {share('ack', 'stu')} as ack_only_rate, coalesce(max(case when stu then wc end), 0) as longest_stu_utt_words,
  coalesce(sum(case when stu and seg = 2 then wc end) * {'1.0D' if e.spark else '1.0'} / nullif(sum(case when stu then wc end), 0), 0) as stu_words_final_third_share, case when count_if(stu) < 3 then 0.0 else regr_slope(wc, case when stu then k * {'1.0D' if e.spark else '1.0'} / nullif(m - 1, 0) end) end as stu_words_trend,
  {share('conf', 'stu')} as confusion_rate, {share('res', 'stu')} as resolution_rate, coalesce(max(cast(last3 and res as int)), 0) as ends_resolved, coalesce(max(cast(last3 and conf as int)), 0) as ends_confused, coalesce(max(case when stu and conf then i end) * {'1.0D' if e.spark else '1.0'} / max(n), -1.0) as last_confusion_pos,
  coalesce(cast(max(case when stu and res then i end) > max(case when stu and conf then i end) as int), 0) as recovered, {share('q', 'stu and seg = 2')} as final_third_stu_q_rate, {share('q', 'stu and seg = 2')} - {share('q', 'stu and seg = 0')} as stu_q_rate_delta,
  {share('el', 'tut')} as tutor_elicit_rate, {share('tl', 'tut')} as tutor_tell_rate, count_if(tut and el) * {'1.0D' if e.spark else '1.0'} / (count_if(tut and tl) + 1) as elicit_to_tell, {share('q', 'tut')} as tutor_q_rate, coalesce(avg(jac), 0) as uptake, coalesce(avg(cast(jac > 0.3 as int)), 0) as revoicing_rate,
  {share('cf', 'tut')} as confirm_rate, {share('cr', 'tut')} as corrective_rate, coalesce(avg(wait), 0) as wait_time_s, {share('selfx', 'stu')} as self_explanation_rate, {share('mt', 'stu')} as math_doing_rate, {share('hedge', 'stu')} as hedge_rate, {share('deep', 'stu and q')} as help_deep_rate, {share('shallow', 'stu and q')} as help_shallow_rate,
  coalesce(count_if(seg = 2) / nullif((max(case when seg = 2 then secs end) - min(case when seg = 2 then secs end)) / 60.0, 0), 0) - coalesce(count_if(seg = 0) / nullif((max(case when seg = 0 then secs end) - min(case when seg = 0 then secs end)) / 60.0, 0), 0) as pace_delta from h group by session_id)
select s.session_id, cast(content as bigint) as stu_content_words, {r6("coalesce(types * 1.0 / nullif(content, 0), 0)")} as stu_ttr, cast(longest_stu_utt_words as bigint) as longest_stu_utt_words, ends_resolved, ends_confused, recovered, {r6("coalesce(sd / (mean + 1e-6), 0)")} as gap_cv,
 {', '.join(f'{r6(c)} as {c}' for c in ('substantive_turn_rate', 'ack_only_rate', 'stu_words_final_third_share', 'stu_words_trend', 'confusion_rate', 'resolution_rate', 'last_confusion_pos', 'final_third_stu_q_rate', 'stu_q_rate_delta', 'tutor_elicit_rate', 'tutor_tell_rate', 'elicit_to_tell', 'tutor_q_rate', 'uptake', 'revoicing_rate', 'confirm_rate', 'corrective_rate', 'wait_time_s', 'self_explanation_rate', 'math_doing_rate', 'hedge_rate', 'help_deep_rate', 'help_shallow_rate', 'pace_delta'))}
from s left join ttr on s.session_id = ttr.session_id left join gaps on s.session_id = gaps.session_id"""


def session_profile(utt: DataFrame) -> DataFrame:
    return run(session_profile_sql, utt=utt)


def session_rates(profile: DataFrame) -> DataFrame:
    return run(session_rates_sql, profile=profile)


def dialogue_profile(utt: DataFrame) -> DataFrame:
    return run(dialogue_profile_sql, utt=utt)
