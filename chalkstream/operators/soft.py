"""Aggregates of soft code probabilities: rates, shrinkage, windows, boundaries, direction, spread, transitions.

Their frame is long: session_id, role, turn (0-based among n turns of the session), n, code, axis, prior, kappa, p.
"""

from __future__ import annotations

from chalkstream.functions.codes import ASK, CODES, KAPPA, LEAST_MASS, RATIO_CAP, RESIDUAL, WINDOWS
from chalkstream.functions.dialect import Dialect
from chalkstream.operators.profiles import r6


def _one(e: Dialect) -> str:
    return "1.0D" if e.spark else "1.0"


def _list(codes: tuple[str, ...]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def codes_sql(e: Dialect) -> str:
    """The code table: code, role, axis, prior, kappa."""
    return "select code, role, axis, cast(prior as double) as prior, cast(kappa as double) as kappa from (values " + ", ".join(f"('{c}', '{r}', '{a}', {p}, {k})" for c, r, a, p, k in CODES) + ") as c(code, role, axis, prior, kappa)"


def probabilities_sql(e: Dialect, turns: str) -> str:
    """The stub of a head for each turn and code: the square of a share of the MD5 of both, scaled so that its mean is twice the code's prior."""
    key = "concat(session_id, '|', cast(turn as string), '|', code)" if e.spark else "concat(session_id, '|', cast(turn as varchar), '|', code)"
    return f"select session_id, role, i as turn, n, code, axis, prior, kappa, least(1.0, 6 * prior * u * u) as p from (select *, {e.share_of(key)} as u from (select session_id, turn, i, n, teacher from {turns} where own) t cross join ({codes_sql(e)}) c where c.role = 'student' or t.teacher <> '') x"


def rates_sql(e: Dialect, probs: str) -> str:
    """Plain, shrunken and empirically shrunken rates of a code, and its mean over the last turns of the role."""
    wins = ", ".join(f"{r6(f'avg(case when k >= m - {w} then p end)')} as last_{w}" for w in WINDOWS)
    # only a first turn may lack a tutor, so the last turns of a role are the last of the session
    placed = "turn as k, n as m" if e.spark else "row_number() over (partition by session_id, code order by turn) - 1 as k, count(*) over (partition by session_id, code) as m"
    return f"""with a as (select *, {placed} from {probs})
select session_id, code, {r6('avg(p)')} as rate, {r6(f'(sum(p) + {KAPPA} * max(prior)) / (count(*) + {KAPPA})')} as shrunk, {r6('(sum(p) + max(kappa) * max(prior)) / (count(*) + max(kappa))')} as shrunk_eb, {r6('(sum(p) + 35 * max(prior)) / (count(*) + 35)')} as shrunk_35, {wins} from a group by session_id, code"""


def weighted_sql(e: Dialect, probs: str) -> str:
    """Rates weighted by instructional mass, and over the instructional span; residual codes keep the plain rate.

    The mass of a turn is 1 less its residual codes, within [0, 1]; a session without any falls back to plain rates. The
    span runs from the first to the last turn with a mass over a half, or over all turns if fewer than two have it.
    """
    resid = _list((*RESIDUAL["tutor"], *RESIDUAL["student"]))
    return f"""with w as (select session_id, role, turn, greatest(0.0, least(1.0, 1.0 - sum(case when code in ({resid}) then p else 0 end))) as w from {probs} group by session_id, role, turn),
sp as (select session_id, role, case when count_if(w > 0.5) >= 2 then min(case when w > 0.5 then turn end) else min(turn) end as lo, case when count_if(w > 0.5) >= 2 then max(case when w > 0.5 then turn end) else max(turn) end as hi from w group by session_id, role)
select p.session_id, p.code, {r6(f'case when max(p.code) in ({resid}) or sum(w) <= {LEAST_MASS} then avg(p) else sum(p * w) / sum(w) end')} as weighted, {r6('avg(case when p.turn between lo and hi then p end)')} as trimmed
from {probs} p join w on p.session_id = w.session_id and p.role = w.role and p.turn = w.turn join sp on p.session_id = sp.session_id and p.role = sp.role group by p.session_id, p.code"""


def boundaries_sql(e: Dialect, probs: str) -> str:
    """Warm-up, closing, span and share of teaching, the first question (1 if none), and the student's teaching share."""
    one = _one(e)
    return f"""with w as (select session_id, role, turn, max(n) as n, greatest(0.0, least(1.0, 1.0 - sum(case when code in ({_list((*RESIDUAL['tutor'], *RESIDUAL['student']))}) then p else 0 end))) as w, sum(case when code in ({_list(ASK)}) then p else 0 end) as ask, sum(p) as mass from {probs} group by session_id, role, turn),
s as (select session_id, max(n) as n, count_if(role = 'tutor' and w > 0.5) as hits, min(case when role = 'tutor' and w > 0.5 then turn end) as lo, max(case when role = 'tutor' and w > 0.5 then turn end) as hi, avg(case when role = 'tutor' then w end) as sh, min(case when role = 'tutor' and ask > 0.5 then turn end) as fa, avg(case when role = 'tutor' then mass end) as cm, avg(case when role = 'student' then w end) as ss from w group by session_id),
b as (select *, case when hits < 2 then 0 else lo end as l2, case when hits < 2 then n - 1 else hi end as h2 from s)
select session_id, {r6(f'l2 * {one} / n')} as warmup_frac, {r6(f'(n - 1 - h2) * {one} / n')} as closing_frac, {r6(f'(h2 - l2 + 1) * {one} / n')} as instr_span_frac, {r6('sh')} as instr_share, {r6(f'coalesce(fa * {one} / n, 1.0)')} as turns_to_ask, {r6('cm')} as code_mass, {r6('ss')} as stu_instr_share from b"""


def directions_sql(e: Dialect, probs: str) -> str:
    """By axis: rate, last third less first third (null under 3 turns), spread and centroid in time (null under 2 turns or without mass)."""
    one = _one(e)
    if e.spark:  # entropy as ln(total) less the mean of ln(mass), so that one pass of sums does
        return f"""with a as (select session_id, axis, turn, max(n) as n, sum(p) as m from {probs} group by session_id, axis, turn),
t as (select session_id, axis, max(n) as n, avg(m) as rate, sum(m) as tot, sum(case when m > 0 then m * ln(m) else 0.0D end) as ml, sum(m * turn) as mt, avg(case when turn >= n - floor(n / 3.0D) then m end) - avg(case when turn < floor(n / 3.0D) then m end) as slope from a group by session_id, axis)
select session_id, axis, {r6('rate')} as rate, {r6('case when n >= 3 then slope end')} as slope, {r6(f'case when n >= 2 and tot > {LEAST_MASS} then (ln(tot) - ml / tot) / nullif(ln(n), 0) end')} as spread, {r6(f'case when n >= 2 and tot > {LEAST_MASS} then mt / tot / nullif(n - 1, 0) end')} as centroid from t"""
    return f"""with a as (select session_id, axis, turn, max(n) as n, sum(p) as m from {probs} group by session_id, axis, turn),
t as (select *, sum(m) over (partition by session_id, axis) as tot, floor(n / {'3.0D' if e.spark else '3.0'}) as c from a)
select session_id, axis, {r6('avg(m)')} as rate, {r6('case when max(n) >= 3 then avg(case when turn >= n - c then m end) - avg(case when turn < c then m end) end')} as slope, {r6(f'case when max(n) >= 2 and max(tot) > {LEAST_MASS} then -sum(case when m > 0 then m / tot * ln(m / tot) else 0.0 end) / nullif(ln(max(n)), 0) end')} as spread,
 {r6(f'case when max(n) >= 2 and max(tot) > {LEAST_MASS} then sum(m / tot * turn * {one} / nullif(n - 1, 0)) end')} as centroid from t group by session_id, axis"""


def transitions_sql(e: Dialect, probs: str) -> str:
    """How an axis follows another: tutor to student within a turn, student to tutor in the next; capped, null without mass."""
    cap = lambda num, den: f"case when max(n) >= 2 and sum({den}) > {LEAST_MASS} then least(sum({num}) / (sum({den}) + {LEAST_MASS}), {RATIO_CAP}) end"
    pairs = {"elicit_reason": ("elicit", "reason"), "elicit_struggle": ("elicit", "struggle"), "elicit_bare": ("elicit", "bare"), "fbneg_reason": ("fbneg", "reason")}
    after = {"struggle_tell": ("struggle", "tell"), "struggle_scaffold": ("struggle", "scaffold"), "reason_fbpos": ("reason", "fbpos")}
    axes = sorted({a for p in (*pairs.values(), *after.values()) for a in p})
    wide = ", ".join(f"sum(case when axis = '{a}' then p else 0 end) as {a}" for a in axes)
    leads = ", ".join(f"lead({a}) over (partition by session_id order by turn) as next_{a}" for a in sorted({b for _, b in after.values()}))
    cols = [f"{r6(cap(f'{a} * {b}', a))} as {k}" for k, (a, b) in pairs.items()]
    cols += [f"{r6(cap(f'case when next_{b} is not null then {a} * next_{b} end', f'case when next_{b} is not null then {a} end'))} as {k}" for k, (a, b) in after.items()]
    after_rows = f"select *, {leads} from w"
    if e.spark:  # the turn after, from the same block or the first place of the next
        ends = ", ".join(f"next_{a}" for a in sorted({b for _, b in after.values()}))
        moved = ", ".join(f"0.0D as {a}" for a in axes)
        nexts = ", ".join(f"{a} as next_{a}" for a in sorted({b for _, b in after.values()}))
        blank = ", ".join(f"cast(null as double) as next_{a}" for a in sorted({b for _, b in after.values()}))
        after_rows = f"select session_id, turn, max(n) as n, {', '.join(f'max({a}) as {a}' for a in axes)}, {', '.join(f'max({x}) as {x}' for x in ends.split(', '))} from (select session_id, turn, n, {', '.join(axes)}, {blank} from w union all select session_id, turn - 1 as turn, n, {moved}, {nexts} from w where turn > 0) x group by session_id, turn"
    return f"with w as (select session_id, turn, max(n) as n, {wide} from {probs} group by session_id, turn), l as ({after_rows}) select session_id, {', '.join(cols)} from l group by session_id"


def ratios_sql(e: Dialect, probs: str) -> str:
    """Shares and capped quotients of axes, how sure the heads are, and the tutor's share of code mass."""
    return f"""with s as (select session_id, avg(case when axis = 'elicit' then p end) as el, avg(case when axis = 'tell' then p end) as te, avg(case when code in ('FEEDBACK_CORRECT') then p end) as fc, avg(case when code in ('FEEDBACK_INCORRECT') then p end) as fi, avg(case when axis = 'reason' then p end) as re, avg(case when axis = 'struggle' then p end) as st, sum(case when role = 'tutor' then p else 0 end) / nullif(sum(p), 0) as ts from {probs} group by session_id),
q as (select session_id, avg(top) as top1 from (select session_id, role, turn, max(p) as top from {probs} group by session_id, role, turn) x group by session_id)
select s.session_id, {r6(f'el / (el + te + {LEAST_MASS})')} as elicit_share, {r6(f'least(el / (te + {LEAST_MASS}), {RATIO_CAP})')} as elicit_to_tell, {r6(f'fc / (fc + fi + {LEAST_MASS})')} as feedback_positive_ratio, {r6(f're / (re + st + {LEAST_MASS})')} as reason_share, {r6('ts')} as tutor_mass_share, {r6('top1')} as mean_top from s join q on s.session_id = q.session_id"""


def interview_sql(e: Dialect, probs: str) -> str:
    """Rates by turn and late (from two thirds on), weighted by how far the student answers; contrast, delight and its place."""
    one = _one(e)
    return f"""with w as (select session_id, turn, max(n) as n, sum(case when code = 'ANSWER_ONLY' then p else 0 end) as ao, sum(case when code = 'REASONING_SHOWN' then p else 0 end) as rs, sum(case when code = 'INSIGHT_DELIGHT' then p else 0 end) as dl, sum(case when code = 'CONFUSION_EXPRESSED' then p else 0 end) as he, sum(case when code = 'SELF_CORRECTING' then p else 0 end) as ass from {probs} where role = 'student' group by session_id, turn),
a as (select *, greatest(0.0, least(1.0, ao + rs)) as an, turn * {one} / greatest(n - 1, 1) as pos from w),
s as (select session_id, avg(ao) as ao, avg(rs) as rs, avg(an) as an, sum(he * an) / nullif(sum(an), 0) as he, sum(ass * an) / nullif(sum(an), 0) as ass, avg(case when pos >= {one} * 2 / 3 then rs end) as rl, sum(dl) as sd, sum(dl * pos) / nullif(sum(dl), 0) as dp from a group by session_id)
select session_id, {r6('ao')} as answer_only_rate, {r6('rs')} as reasoning_rate, {r6('rl')} as reasoning_late, {r6('an')} as answering_rate, {r6('rs / nullif(ao + rs, 0)')} as reasoning_share, {r6('he')} as hedged_rate, {r6('ass')} as assertive_rate, {r6('(ass - he) / nullif(ass + he, 0)')} as confidence_contrast, {r6('dp')} as delight_pos_mean, {r6('least(sd, 1.0)')} as delight_any from s"""
