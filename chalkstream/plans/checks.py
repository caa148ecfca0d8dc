"""SQL for DuckDB written from the definitions, not from the operators: by joins on places and plain grids, without blocks."""

from __future__ import annotations

from chalkstream.functions import lexicons as L
from chalkstream.functions.codes import ASK, CODES, ENGAGE, RESIDUAL, STRUGGLE, TELL
from chalkstream.operators.frames import RESP, TALK, TURNS, UTT


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words: tuple[str, ...] | list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _says(col: str, name: str) -> str:
    return f"regexp_matches({col}, {_q(L.PATTERNS[name])}, 'i')"


# the nearest row of a role before and after, by joins on the closest place
NEIGHBOURS = f"""with utt as ({UTT}), u as (select *, case role when 'student' then 'tutor' when 'tutor' then 'student' end as wanted from utt),
 b as (select u.session_id, u.i, p.content as x from u asof join utt p on u.session_id = p.session_id and u.wanted = p.role and u.i > p.i),
 a as (select u.session_id, u.i, p.content as x from u asof join (select * from utt where role = 'tutor') p on u.session_id = p.session_id and u.i < p.i),
 c as (select distinct session_id, i + unnest([-2, -1, 0, 1, 2]) as i from utt where {_says('content', 'confusion')})
 select u.session_id, u.i, u.role, coalesce(b.x, '') as other_before, coalesce(a.x, '') as tutor_after, l.role as role_before, r.role as role_after, cast(c.i is not null as int) as near_confusion
 from u left join b on u.session_id = b.session_id and u.i = b.i left join a on u.session_id = a.session_id and u.i = a.i left join utt l on u.session_id = l.session_id and l.i = u.i - 1 left join utt r on u.session_id = r.session_id and r.i = u.i + 1
 left join c on u.session_id = c.session_id and u.i = c.i"""

_share = lambda a, b: f"round(cast({a} as double) / nullif({b}, 0), 6) + 0.0"

INTERACTIONS = rf"""with utt as ({UTT}), f as (select session_id, i, role, len(regexp_extract_all(lower(content), '[a-z0-9'']+')) as wc, regexp_matches(content, '[?]\s*$') as q, {_says('content', 'corrective')} as cr, {_says('content', 'confirm')} as cf, {_says('content', 'check_understanding')} as cfu, {_says('content', 'elicit')} as el, {_says('content', 'maths')} as mt,
  {_says('content', 'resolution')} as res, {_says('content', 'hedge')} or {_says('content', 'confusion')} as unsure, len(list_filter(regexp_extract_all(lower(content), '[a-z0-9'']+'), lambda v: v not in {_in(L.ACKNOWLEDGEMENTS)})) as content_words from utt),
 t as (select session_id, i, cf from f where role = 'tutor'), s as (select session_id, i from f where role = 'student' and wc > 5),
 last_cf as (select session_id, max(i) as i from f where role = 'tutor' and cf group by 1),
 repair as (select f.session_id, count(*) as n, count_if(coalesce(l.i > f.i, false)) as k from f left join last_cf l on f.session_id = l.session_id where role = 'tutor' and cr group by 1),
 checked as (select f.session_id, g.res or (g.wc between 1 and 3 and g.content_words = 0) as yes, g.unsure from f join f g on f.session_id = g.session_id and g.i = f.i + 1 where f.role = 'tutor' and f.cfu and g.role = 'student'),
 cfu as (select session_id, count_if(yes) as k, count_if(yes or unsure) as n from checked group by 1),
 tried as (select * from f where role = 'student' and wc > 5 and (mt or not q)),
 confirmed as (select a.session_id, count(*) as k from tried a asof join t on a.session_id = t.session_id and a.i < t.i where t.cf group by 1),
 asked as (select * from f where role = 'tutor' and (q or el)),
 answer as (select a.session_id, a.i, s.i as at from asked a asof join s on a.session_id = s.session_id and a.i < s.i), after as (select a.session_id, a.i, t.i as at from asked a asof join t on a.session_id = t.session_id and a.i < t.i),
 funnel as (select answer.session_id, count_if(answer.at < coalesce(after.at, answer.at + 1)) as k from answer left join after on answer.session_id = after.session_id and answer.i = after.i group by 1),
 n as (select session_id, count_if(role = 'student') as students from f group by 1), nt as (select session_id, count(*) as n from tried group by 1), na as (select session_id, count(*) as n from asked group by 1)
 select n.session_id, {_share('repair.k', 'repair.n')} as repair_complete_rate, {_share('cfu.k', 'cfu.n')} as cfu_affirm_rate, {_share('nt.n', 'students')} as answer_attempt_rate, {_share('case when nt.n > 0 then coalesce(confirmed.k, 0) end', 'nt.n')} as answer_confirmed_rate, {_share('case when na.n > 0 then coalesce(funnel.k, 0) end', 'na.n')} as funnel_rate
 from n left join repair on n.session_id = repair.session_id left join cfu on n.session_id = cfu.session_id left join nt on n.session_id = nt.session_id left join na on n.session_id = na.session_id left join confirmed on n.session_id = confirmed.session_id left join funnel on n.session_id = funnel.session_id"""

_P = _q(L.PATTERNS["prior_session"])
_KEYS = rf"list_filter(list_distinct(regexp_extract_all(lower(lo_text), '[\p{{L}}\p{{N}}_]+')), lambda v: length(v) > 2 and v not in {_in(L.OBJECTIVE_STOPS)})"

# every word of a session is numbered, and so is where each back-reference begins; 41 places around it are spelled out
HISTORY = rf"""with utt as ({UTT}), resp as ({RESP}), low as (select session_id, i, lower(content) as x, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') as w from utt),
 placed as (select *, coalesce(sum(len(w)) over (partition by session_id order by i rows between unbounded preceding and 1 preceding), 0) as before from low),
 words as (select session_id, before + unnest(range(len(w))) as place, unnest(w) as word from placed),
 found as (select session_id, before, regexp_extract_all(x, {_P}) as m, string_split_regex(x, {_P}) as rest from placed where regexp_matches(x, {_P})),
 starts as (select session_id, before, unnest(list_transform(range(1, len(m) + 1), lambda k: concat(array_to_string(list_slice(rest, 1, k), ''), array_to_string(list_slice(m, 1, k - 1), '')))) as head from found),
 places as (select session_id, before + len(regexp_extract_all(head, '[\p{{L}}\p{{N}}_]+')) as place from starts),
 around as (select distinct session_id, place + unnest(range(-20, 21)) as place from places), near as (select distinct words.session_id, word from words join around on words.session_id = around.session_id and words.place = around.place),
 keys as (select response_id, session_id, unnest({_KEYS}) as word from resp), hit as (select distinct response_id from keys join near on keys.session_id = near.session_id and keys.word = near.word),
 s as (select session_id, max(cast(i < 40 and regexp_matches(content, {_q(L.PATTERNS['first_session'])}, 'i') as int)) as is_first, max(cast(i < 40 and regexp_matches(content, {_P}, 'i') as int)) as prior_head from utt group by 1), c as (select session_id, count(*) as k from starts group by 1)
 select r.response_id, is_first as histpos_is_first, prior_head as histpos_prior_head, case when s.session_id is not null then round(ln(1 + coalesce(k, 0)), 6) + 0.0 end as histpos_n_prior, case when s.session_id is not null then cast(hit.response_id is not null as int) end as histpos_prior_lo
 from resp r left join s on r.session_id = s.session_id left join c on r.session_id = c.session_id left join hit on r.response_id = hit.response_id"""

_mass = lambda codes, as_: f"sum(case when code in {_in(codes)} then p else 0 end) as {as_}"
_CODES = "select * from (values " + ", ".join(f"({_q(c)}, {_q(r)}, cast({p} as double))" for c, r, _, p, _ in CODES) + ") as c(code, role, prior)"
_gap = lambda k: f"round(case when count_if(d > 2) > 0 then avg(case when d <= 2 then {k} end) - avg(case when d > 2 then {k} end) end, 6) + 0.0 as gap_{k}"

# every turn of a session for every objective of it, with its distance from each hit
TURN_WINDOWS = rf"""with utt as ({UTT}), talk as ({TALK}), turns as ({TURNS}), resp as ({RESP}),
 p as (select session_id, i, n, code, least(1.0, 6 * prior * u * u) as p from (select t.session_id, t.i, t.n, c.code, c.prior, cast(('0x' || substr(md5(concat(t.session_id, '|', t.turn, '|', c.code)), 1, 8)) as ubigint) / 4294967295.0 as u from turns t join ({_CODES}) c on c.role = 'student' or t.teacher <> '') x),
 m as (select session_id, i, max(n) as n, {_mass(ASK, 'ask')}, {_mass(TELL, 'tell')}, {_mass(ENGAGE, 'reason')}, {_mass(STRUGGLE, 'struggle')}, greatest(0.0, least(1.0, 1.0 - sum(case when code in {_in(RESIDUAL['tutor'])} then p else 0 end))) as instr from p group by 1, 2),
 lo as (select distinct session_id, lo_text, {_KEYS} as k from resp),
 said as (select session_id, i, regexp_extract_all(lower(concat(teacher, ' ', student)), '[a-z'']+') as w from turns),
 hit as (select lo.session_id, lo_text, i from lo join said on lo.session_id = said.session_id where list_has_any(k, w)),
 g as (select h.session_id, h.lo_text, m.i, any_value(m.n) as n, any_value(ask) as ask, any_value(tell) as tell, any_value(reason) as reason, any_value(struggle) as struggle, any_value(instr) as instr, min(abs(m.i - h.i)) as d from hit h join m on h.session_id = m.session_id group by 1, 2, 3),
 b as (select *, row_number() over (partition by session_id, lo_text, d <= 2 order by i desc) as back, count_if(d <= 2) over (partition by session_id, lo_text) as c from g),
 o as (select session_id, lo_text, max(n) as n_turns, round(count_if(d <= 2) / count(*), 6) as cover, round(avg(case when d <= 2 then i end) / greatest(1, max(n) - 1), 6) + 0.0 as place, {_gap('ask')}, {_gap('tell')}, {_gap('reason')}, {_gap('struggle')}, {_gap('instr')},
  round(avg(case when d <= 2 and back <= greatest(1, c // 4) then reason end), 6) + 0.0 as end_reason, round(avg(case when d <= 2 and back <= greatest(1, c // 4) then struggle end), 6) + 0.0 as end_struggle, round(case when max(n) >= 6 then avg(exp(-d)) end, 6) as soft_cover from b group by 1, 2)
 select r.response_id, n_turns, cover, place, gap_ask, gap_tell, gap_reason, gap_struggle, gap_instr, end_reason, end_struggle, soft_cover from resp r left join o on r.session_id = o.session_id and r.lo_text = o.lo_text"""
