"""Operators on learning objectives: coverage in the transcript, local windows, curriculum match, rules, difficulty."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkstream.functions import lexicons as L
from chalkstream.functions.codes import ASK, ENGAGE, RESIDUAL, STRUGGLE, TELL
from chalkstream.functions.dialect import SPARK, Dialect
from chalkstream.functions.scan import running_sum
from chalkstream.operators.profiles import r6


def _one(e: Dialect) -> str:
    return "1.0D" if e.spark else "1.0"


def _keywords(e: Dialect, text: str) -> str:
    """Different words of more than two characters that carry a topic."""
    return e.keep(e.without(e.words(text), e.strings(L.OBJECTIVE_STOPS)), "length(v) > 2")


def coverage_sql(e: Dialect, utt: str, resp: str) -> str:
    """Share of an objective's content words said in the session, by the student, and in the last third; 0 without any."""
    stops = e.strings([*L.TALK_STOPS, *L.FILLERS])
    return f"""with lo as (select response_id, session_id, {e.explode(e.without(e.talk_words('lo_text'), stops))} as t from {resp}),
said as (select session_id, t, max(stu) as stu, max(tail) as tail from (select session_id, cast(role = 'student' as int) as stu, cast(i >= 2 * n / {'3.0D' if e.spark else '3.0'} as int) as tail, {e.explode(e.distinct(e.talk_words('content')))} as t from {utt} where own) x group by session_id, t),
s as (select lo.response_id, count(*) as k, count(said.t) as a, coalesce(sum(stu), 0) as b, coalesce(sum(tail), 0) as c from lo left join said on lo.session_id = said.session_id and lo.t = said.t group by lo.response_id)
select r.response_id, {r6(f'coalesce(a * {_one(e)} / k, 0)')} as lo_cov_session, {r6(f'coalesce(b * {_one(e)} / k, 0)')} as lo_cov_student, {r6(f'coalesce(c * {_one(e)} / k, 0)')} as lo_cov_end from {resp} r left join s on r.response_id = s.response_id"""


def mentions_sql(e: Dialect, utt: str, resp: str) -> str:
    """Keyword overlap by speaker, the first mention as a fraction of the session (1 for none), and the share of rows that mention."""
    one = _one(e)
    return f"""with lo as (select response_id, session_id, {e.explode(_keywords(e, 'lo_text'))} as t from {resp}),
said as (select session_id, i, n, role, {e.explode(e.distinct(e.words('content')))} as t from {utt} where own),
hit as (select lo.response_id, lo.t, said.i, said.n, said.role from lo join said on lo.session_id = said.session_id and lo.t = said.t),
k as (select response_id, count(*) as k from lo group by response_id),
s as (select response_id, count(distinct t) as a, count(distinct case when role = 'student' then t end) as b, count(distinct case when role = 'tutor' then t end) as c, min(i) as f, max(n) as n, count(distinct i) as m from hit group by response_id)
select r.response_id, {r6(f'coalesce(a * {one} / k, 0)')} as lo_keyword_overlap, {r6(f'coalesce(b * {one} / k, 0)')} as lo_keyword_in_student, {r6(f'coalesce(c * {one} / k, 0)')} as lo_keyword_in_tutor, round(coalesce((b * {one} / k) / (c * {one} / k + 1e-9), 0), 3) + 0.0 as lo_student_tutor_coverage_ratio,
 {r6(f'case when k is null or t.n is null then 0.0 else coalesce(f * {one} / s.n, 1.0) end')} as lo_first_mention_frac, {r6(f'coalesce(m * {one} / s.n, 0)')} as lo_mention_density
from {resp} r left join k on r.response_id = k.response_id left join s on r.response_id = s.response_id left join (select session_id, max(n) as n from {utt} where own group by session_id) t on r.session_id = t.session_id"""


def idf_sql(e: Dialect, resp: str) -> str:
    """Inverse document frequency of the content words of different objectives: ln((1 + N) / (1 + df)) + 1."""
    stops = e.strings([*L.TALK_STOPS, *L.FILLERS])
    return f"""with d as (select distinct lower(lo_text) as x from {resp} where lo_text <> ''), c as (select count(*) as nd from d)
select t, ln((1 + nd) / (1 + count(*) * {_one(e)})) + 1 as idf from (select {e.explode(e.without(e.talk_words('x'), stops))} as t from d) w cross join c group by t, nd"""


def local_window_sql(e: Dialect, utt: str, resp: str, idf: str) -> str:
    """The objective's own window: the 8 most relevant rows, each with its neighbours, and rates within it.

    Relevance is the idf mass of the objective's words in a row, of the mass of all its words; ties go to later rows.
    loc_recency is the place of the last relevant row, -1 without one.
    """
    stops, one = e.strings([*L.TALK_STOPS, *L.FILLERS]), _one(e)
    has = lambda name: e.has("lower(content)", name)
    flags = {"cf": "confirm", "cr": "corrective", "el": "elicit", "ga": "states_answer", "sx": "self_explanation", "cn": "confusion", "rs": "resolution"}
    rate = lambda c, who: f"coalesce(avg(case when role = '{who}' then cast({c} as int) end), 0)"
    return f"""with lo as (select x.response_id, x.session_id, x.t, i.idf from (select response_id, session_id, {e.explode(e.without(e.talk_words('lo_text'), stops))} as t from {resp}) x join {idf} i on x.t = i.t),
mass as (select response_id, sum(idf) as mass from lo group by response_id),
said as (select session_id, i, role, {e.explode(e.distinct(e.talk_words('content')))} as t from {utt} where own),
hit as (select lo.response_id, lo.session_id, said.i, said.role, sum(idf) as m from lo join said on lo.session_id = said.session_id and lo.t = said.t group by lo.response_id, lo.session_id, said.i, said.role),
cov as (select lo.response_id, sum(lo.idf) as m from lo join (select distinct session_id, t from said) d on lo.session_id = d.session_id and lo.t = d.t group by lo.response_id),
rel as (select *, row_number() over (partition by response_id order by round(m, 9) desc, i desc) as rk, max(i) over (partition by response_id) as last_i, max(case when role = 'student' then i end) over (partition by response_id) as last_student from hit),
win as (select distinct response_id, session_id, i, last_i, last_student from (select response_id, session_id, last_i, last_student, {e.explode('array(i - 1, i, i + 1)' if e.spark else '[i - 1, i, i + 1]')} as i from rel where rk <= 8) x),
rows as (select session_id, i, n, role, {e.size(e.talk_words('content'))} as wc, {', '.join(f'{has(v)} as {k}' for k, v in flags.items())} from {utt} where own),
s as (select w.response_id, count(*) as c, max(r.n) as n, max(last_i) as last_i, {rate('cf', 'tutor')} as a1, {rate('cr', 'tutor')} as a2, {rate('sx', 'student')} as a3, {rate('wc > 5', 'student')} as a4, {rate('cn', 'student')} as a5, coalesce(max(case when r.i = last_student then cast(rs as int) end), 0) as a6, {rate('el', 'tutor')} as a7, {rate('ga', 'tutor')} as a8,
 count_if(role = 'tutor' and el) * {one} / (count_if(role = 'tutor' and ga) + 1) as a9 from win w join rows r on w.session_id = r.session_id and w.i = r.i group by w.response_id)
select r.response_id, {r6('coalesce(cov.m / mass.mass, 0)')} as lo_cov_idf, {r6('coalesce(a1, 0)')} as loc_tutor_confirm_rate, {r6('coalesce(a2, 0)')} as loc_tutor_corrective_rate, {r6('coalesce(a3, 0)')} as loc_self_expl_rate, {r6('coalesce(a4, 0)')} as loc_substantive_rate, {r6('coalesce(a5, 0)')} as loc_confusion_rate, coalesce(a6, 0) as loc_ends_resolved,
 {r6(f'coalesce(last_i * {one} / n, -1)')} as loc_recency, {r6(f'coalesce(c * {one} / n, 0)')} as loc_window_share, {r6('coalesce(a7, 0)')} as loc_elicit_rate, {r6('coalesce(a8, 0)')} as loc_gives_answer_rate, {r6('coalesce(a9, 0)')} as loc_elicit_vs_tell
from {resp} r left join mass on r.response_id = mass.response_id left join cov on r.response_id = cov.response_id left join s on r.response_id = s.response_id"""


def local_deltas_sql(e: Dialect, local: str, resp: str, dialogue: str) -> str:
    """The seven differences of local rates and the session's; missing counts as 0."""
    pairs = {"delta_confirm": ("loc_tutor_confirm_rate", "confirm_rate"), "delta_corrective": ("loc_tutor_corrective_rate", "corrective_rate"), "delta_self_expl": ("loc_self_expl_rate", "self_explanation_rate"), "delta_substantive": ("loc_substantive_rate", "substantive_turn_rate"), "delta_confusion": ("loc_confusion_rate", "confusion_rate"), "delta_elicit": ("loc_elicit_rate", "tutor_elicit_rate"), "delta_elicit_vs_tell": ("loc_elicit_vs_tell", "elicit_to_tell")}
    return f"select l.response_id, {', '.join(f'{r6(f'coalesce(l.{a}, 0) - coalesce(d.{b}, 0)')} as {k}' for k, (a, b) in pairs.items())} from {local} l join {resp} r on l.response_id = r.response_id left join {dialogue} d on r.session_id = d.session_id"


#: Turns on either side of a hit that belong to the hard window, and the fewest turns of a session for soft coverage.
PAD, LEAST_TURNS = 2, 6
#: What is compared inside and outside the window, and at its end.
_GAPS, _ENDS = ("ask", "tell", "reason", "struggle", "instr"), ("reason", "struggle")


def turn_masses(probs: DataFrame) -> DataFrame:
    """session_id, i, n and the masses of a turn: ask, tell, reason, struggle, and instr, 1 less residual tutor codes within [0, 1]."""
    mass = lambda codes: F.sum(F.when(F.col("code").isin(*codes), F.col("p")).otherwise(0.0))
    sums = [mass(c).alias(k) for k, c in {"ask": ASK, "tell": TELL, "reason": ENGAGE, "struggle": STRUGGLE}.items()]
    instr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mass(RESIDUAL["tutor"]))).alias("instr")
    return probs.groupBy("session_id", F.col("turn").alias("i")).agg(F.max("n").alias("n"), *sums, instr)


def turn_windows(turns: DataFrame, masses: DataFrame, resp: DataFrame) -> DataFrame:
    """Hard and soft coverage of an objective on the turn axis, a row for each response.

    A turn hits if it says a keyword (talk in runs of letters and apostrophes, so digits never hit). The hard window is
    every hit and PAD turns around it: its share and mean place, the gap of each mass between inside and outside (null
    if it is all of the session), and the mean reason and struggle of its last quarter, one turn at least. All are null
    without a hit. Soft coverage is the mean of exp(-turns to the nearest hit), null under LEAST_TURNS turns.

    Each different text of a session is worked out once. Only turns of the window are joined, what is outside is the
    session's sum less theirs, and soft coverage is summed in closed form over the gaps between hits, so that no window
    or join holds all turns for each objective.
    """
    keys = resp.select("session_id", "lo_text").distinct().select("session_id", "lo_text", F.explode(F.expr(_keywords(SPARK, "lo_text"))).alias("t"))
    own = turns.where("own").select("session_id", "i", "n", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "teacher", "student")), F.lit("([a-z']+)"), F.lit(1)))).alias("t"))
    hits = keys.join(own, ["session_id", "t"]).select("session_id", "lo_text", "i", "n").distinct()
    around = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("i") - PAD), F.least(F.col("n") - 1, F.col("i") + PAD))
    window = hits.select("session_id", "lo_text", F.explode(around).alias("i")).distinct()
    whole = masses.groupBy("session_id").agg(F.max("n").alias("n"), *[F.sum(k).alias(f"all_{k}") for k in _GAPS])
    by = W.partitionBy("session_id", "lo_text")
    placed = window.withColumn("back", F.row_number().over(by.orderBy(F.desc("i")))).withColumn("m", F.count("*").over(by)).join(masses.drop("n"), ["session_id", "i"])
    tail = F.col("back") <= F.greatest(F.lit(1), F.floor(F.col("m") / 4))
    inside = placed.groupBy("session_id", "lo_text").agg(F.count("*").alias("m"), F.avg("i").alias("mean_i"), *[F.sum(k).alias(k) for k in _GAPS], *[F.avg(F.when(tail, F.col(k))).alias(f"end_{k}") for k in _ENDS]).join(whole, "session_id")
    # exp(-1) + ... + exp(-m), and the same towards the nearer end of a gap of g turns
    e1 = math.exp(-1)
    run_ = lambda m: e1 * (1 - F.exp(-1.0 * m)) / (1 - e1)
    gap = lambda g: 2 * run_(F.floor(g / 2)) + F.when(g % 2 == 1, F.exp(-(g + 1) / 2.0)).otherwise(0.0)
    nxt = hits.withColumn("next", F.lead("i").over(by.orderBy("i"))).withColumn("first", F.row_number().over(by.orderBy("i")) == 1)
    part = 1.0 + F.when(F.col("next").isNull(), run_(F.col("n") - 1 - F.col("i"))).otherwise(gap(F.col("next") - F.col("i") - 1)) + F.when(F.col("first"), run_(F.col("i"))).otherwise(0.0)
    soft = nxt.groupBy("session_id", "lo_text").agg(F.sum(part).alias("near"))
    r6_ = lambda x: F.round(x, 6) + 0.0
    n, m = F.col("n"), F.col("m")
    done = inside.join(soft, ["session_id", "lo_text"]).select(
        "session_id", "lo_text", n.alias("n_turns"), r6_(m / n).alias("cover"), r6_(F.col("mean_i") / F.greatest(F.lit(1), n - 1)).alias("place"),
        *[r6_(F.when(m < n, F.col(k) / m - (F.col(f"all_{k}") - F.col(k)) / (n - m))).alias(f"gap_{k}") for k in _GAPS], *[r6_(F.col(f"end_{k}")).alias(f"end_{k}") for k in _ENDS],
        r6_(F.when(n >= LEAST_TURNS, F.col("near") / n)).alias("soft_cover"),
    )
    return resp.select("response_id", "session_id", "lo_text").join(done, ["session_id", "lo_text"], "left").drop("session_id", "lo_text")


#: Words on either side of a back-reference among which keywords are sought.
NEAR_WORDS = 20


def with_offsets(utt: DataFrame) -> DataFrame:
    """The own rows of utt with n_words, and words_before, the number of words of the session before the row."""
    own = utt.where("own").withColumn("n_words", F.expr(SPARK.size(SPARK.words("content"))))
    return running_sum(own, "session_id", "blk", ["i"], "n_words", "words_before").withColumn("words_before", F.col("words_before") - F.col("n_words"))


def history_sql(e: Dialect, utt: str, resp: str) -> str:
    """Place in a programme: a first session, back-references among the first 40 rows, how many in all, near a keyword.

    Near is within NEAR_WORDS words of the joined transcript on either side, utt has with_offsets(). Rows meet
    back-references by spans of 64 words, and only words near one are joined with keywords. All are null for a response
    whose session has no transcript.
    """
    one = _one(e)
    prior = e.text(L.PATTERNS["prior_session"])
    spans = lambda a, b: f"explode(sequence(floor(({a}) / 64), floor(({b}) / 64)))"
    near = f"""hits as (select session_id, words_before, low, regexp_extract_all(low, {prior}, 0) as found, split(low, {prior}, -1) as rest from (select session_id, words_before, lower(content) as low from {utt} where own) x where low rlike {prior}),
starts as (select session_id, words_before, low, explode(transform(sequence(1, size(found)), k -> length(array_join(slice(rest, 1, k), '')) + length(array_join(slice(found, 1, k - 1), '')))) as at from hits),
places as (select distinct session_id, words_before + {e.size(e.words('left(low, at)'))} as place from starts),
wide as (select session_id, place, {spans(f'place - {NEAR_WORDS}', f'place + {NEAR_WORDS}')} as span from places),
spread as (select session_id, words_before as b, content, {spans('words_before', 'words_before + n_words - 1')} as span from {utt} where own and n_words > 0),
close_by as (select distinct session_id, explode(slice(tk, cast(greatest(place - {NEAR_WORDS} - b, 0) as int) + 1, cast(greatest(place + {NEAR_WORDS} - b + 1 - greatest(place - {NEAR_WORDS} - b, 0), 0) as int))) as t from (select w.session_id, w.place, s.b, {e.words('s.content')} as tk from spread s join wide w on s.session_id = w.session_id and s.span = w.span)),
near as (select distinct k.response_id from (select response_id, session_id, explode({_keywords(e, 'lo_text')}) as t from {resp}) k join close_by c on k.session_id = c.session_id and k.t = c.t)"""
    return f"""with f as (select session_id, i, {e.has('content', 'first_session')} as first_, {e.has('content', 'prior_session')} as prior_, {e.count('lower(content)', L.PATTERNS['prior_session'])} as np, {e.words('content')} as tk from {utt} where own),
s as (select session_id, max(case when i < 40 then cast(first_ as int) end) as is_first, max(case when i < 40 then cast(prior_ as int) end) as prior_head, sum(np) as n_prior from f group by session_id),
{near}
select r.response_id, case when s.session_id is not null then coalesce(is_first, 0) end as histpos_is_first, case when s.session_id is not null then coalesce(prior_head, 0) end as histpos_prior_head, {r6(f'ln(1 + n_prior * {one})')} as histpos_n_prior, case when s.session_id is not null then cast(near.response_id is not null as int) end as histpos_prior_lo from {resp} r left join s on r.session_id = s.session_id left join near on r.response_id = near.response_id"""


def surface_sql(e: Dialect, resp: str) -> str:
    """Surface features of an objective's text, its operations, its strand and its level, for each different text."""
    one = _one(e)
    ops = ", ".join(f"cast({e.matches('low', p)} as int) as op_{k}" for k, p in L.OPERATIONS.items())
    strand = "case " + " ".join(f"when {e.matches('low', L.stems(words))} then {code}" for _, code, words in L.STRANDS) + " else 5 end"
    level = "case " + " ".join(f"when {e.matches('low', L.stems(words))} then {code}" for code, words in L.LEVELS) + " else 3 end"
    words = e.found("lo_text", "[A-Za-z]+")
    titled = e.size(e.keep(words, e.matches("v", "^[A-Z]", any_case=False)))
    return f"""with d as (select distinct lo_text, lower(lo_text) as low from {resp})
select md5(lo_text) as lo_md5, length(lo_text) as n_chars, {e.size(e.found('lo_text', '[^' + chr(92) + 's]+'))} as n_words, {e.count('low', '[0-9]+[.]?[0-9]*')} as n_numbers, {e.count('low', chr(92) + 'band' + chr(92) + 'b')} as n_and, {e.count('lo_text', ',')} as n_commas, {r6(f'coalesce({titled} * {one} / nullif({e.size(words)}, 0), 0)')} as frac_titlecase,
 cast(coalesce({titled} * {one} / nullif({e.size(words)}, 0), 0) >= 0.5 as int) as is_titlecase, cast({e.matches('lo_text', '^[A-Z]', any_case=False)} as int) as starts_capital, cast({e.matches('lo_text', '[.]' + chr(92) + 's*$')} as int) as ends_period, {r6(f"{e.count('lo_text', '[A-Z]')} * {one} / greatest(1, {e.count('lo_text', '[A-Za-z]')})")} as frac_upper_chars, {ops}, {strand} as lo_topic_strand, {level} as lo_bloom_level from d"""


#: Letters with marks and the plain letters they stand for, by Unicode's decomposition.
_MARKED = {chr(c): base for c in range(0xC0, 0x250) if len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)}


def _plain_letters(e: Dialect, text: str) -> str:
    return f"translate({text}, '{''.join(_MARKED)}', '{''.join(_MARKED.values())}')" if e.spark else f"strip_accents({text})"


def curriculum_sql(e: Dialect, resp: str, statements: str) -> str:
    """The best cosine of an objective with curriculum statements, and the similarity-weighted year of the five best.

    Terms are words without accents and pairs of neighbours; weights (1 + ln tf)(ln((1 + N) / (1 + df)) + 1), of length one, over the
    statements only; other terms of an objective have no weight. The key stage follows from the year, rounded half to
    even. An inverted index joins them term by term, so no objective meets a statement it shares nothing with.
    """
    one = _one(e)
    tok = lambda c: e.keep(e.words(_plain_letters(e, c)), "length(v) >= 2")
    grams = (
        "concat(tk, case when size(tk) > 1 then transform(sequence(0, size(tk) - 2), k -> concat(tk[k], ' ', tk[k + 1])) else cast(array() as array<string>) end)" if e.spark
        else "list_concat(tk, list_transform(range(0, greatest(len(tk) - 1, 0)), lambda k: concat(tk[k + 1], ' ', tk[k + 2])))"
    )
    return f"""with st as (select statement as s, year_group as y, row_number() over (order by statement, year_group) as sid from {statements} where statement is not null),
sg as (select sid, g, 1 + ln(count(*) * {one}) as tf from (select sid, {e.explode(grams)} as g from (select sid, {tok('s')} as tk from st) a) b group by sid, g),
df as (select g, ln((1 + (select count(*) from st)) / (1 + count(*) * {one})) + 1 as idf from sg group by g),
sw as (select sg.sid, sg.g, tf * idf as w from sg join df on sg.g = df.g), sn as (select sid, sqrt(sum(w * w)) as nn from sw group by sid),
lo as (select distinct lower(lo_text) as x from {resp} where lo_text <> ''),
lg as (select x, g, 1 + ln(count(*) * {one}) as tf from (select x, {e.explode(grams)} as g from (select x, {tok('x')} as tk from lo) a) b group by x, g),
lw as (select lg.x, lg.g, tf * idf as w from lg join df on lg.g = df.g), ln_ as (select x, sqrt(sum(w * w)) as nn from lw group by x),
sim as (select lw.x, sw.sid, sum(lw.w * sw.w) / (max(ln_.nn) * max(sn.nn)) as c from lw join sw on lw.g = sw.g join ln_ on lw.x = ln_.x join sn on sw.sid = sn.sid group by lw.x, sw.sid),
top as (select sim.x, c, y, row_number() over (partition by sim.x order by round(c, 9) desc, sim.sid) as rk from sim join st on sim.sid = st.sid),
agg as (select x, max(c) as best, sum(case when y is not null then c * y end) / nullif(sum(case when y is not null then c end), 0) as yr from top where rk <= 5 group by x)
select md5(lo.x) as lo_md5, {r6('coalesce(best, 0)')} as lo_nc_sim, {r6('coalesce(yr, 0)')} as lo_year_group, cast(case when yr is null then 0 when {e.half_even('yr')} <= 2 then 1 when {e.half_even('yr')} <= 6 then 2 when {e.half_even('yr')} <= 9 then 3 else 4 end as int) as lo_ks_level from lo left join agg on lo.x = agg.x"""


def session_task_sql(e: Dialect, resp: str) -> str:
    """How many responses and different objectives a session has."""
    return f"select session_id, count(*) as session_n_responses, count(distinct lo_id) as session_n_distinct_los, {r6(f'count(distinct lo_id) * {_one(e)} / count(*)')} as session_lo_diversity, cast(count(distinct lo_id) = 1 as int) as session_lo_same from {resp} group by session_id"


def difficulty_sql(e: Dialect, resp: str, labels: str) -> str:
    """Mean outcome and count of an objective, its percentile rank with ties averaged, and its place within the session.

    Objectives without labels take the mean of all labels, a count of 0 and rank 0.5. Ranks are over objectives, one row each.
    """
    one = _one(e)
    return f"""with s as (select r.lo_id, avg(y * {one}) as m, count(*) as c from {resp} r join {labels} l on r.response_id = l.response_id group by r.lo_id),
k as (select m, count(*) as ties, sum(count(*)) over (order by m) as upto, sum(count(*)) over () as nn from s group by m),
rk as (select s.lo_id, s.m, s.c, (k.upto - (k.ties - 1) / {'2.0D' if e.spark else '2.0'}) / k.nn as pr from s join k on s.m = k.m),
j as (select r.response_id, r.session_id, coalesce(m, (select avg(y * {one}) from {labels})) as m, coalesce(c, 0) as c, coalesce(pr, 0.5) as pr from {resp} r left join rk on r.lo_id = rk.lo_id),
b as (select session_id, avg(m) as sm, min(m) as lowest from j group by session_id)
select j.response_id, {r6('m')} as lo_mean_correct, c as lo_n_sessions, {r6('pr')} as lo_difficulty_rank, {r6('m - sm')} as lo_difficulty_vs_session_mean, cast(m = lowest as int) as lo_is_hardest_in_session from j join b on j.session_id = b.session_id"""


def assembled_sql(e: Dialect, surface: str, matched: str) -> str:
    """Curriculum columns of an objective in three tiers: the match with statements, else rules, else unknown (0)."""
    return f"select s.lo_md5, coalesce(m.lo_year_group, 0) as lo_year_group, coalesce(m.lo_ks_level, 0) as lo_ks_level, s.lo_topic_strand, s.lo_bloom_level, coalesce(m.lo_nc_sim, 0) as lo_nc_sim, case when m.lo_nc_sim > 0 then 'match' when s.lo_topic_strand < 5 then 'rule' else 'none' end as tier from {surface} s left join {matched} m on s.lo_md5 = m.lo_md5"


def publisher_sql(e: Dialect, corpus: str) -> str:
    """A publisher's corpus by normalised text: occurrences, high confidence, most co-located objectives, median year.

    corpus: lo_text, confidence, co_located_los (a ;-list), year_group, source_site.
    """
    text = f"{e.replace('lower(trim(lo_text))', '[.]+$', '')}"
    parts = f"{e.size(e.keep('split(co_located_los, ' + chr(39) + ';' + chr(39) + ')', 'length(v) > 0'))}" if e.spark else "cast(len(list_filter(string_split(co_located_los, ';'), lambda v: length(v) > 0)) as bigint)"
    year = "percentile(year_group, 0.5)" if e.spark else "median(year_group)"
    return f"select {text} as text, count(*) as n_occurrences, max(cast(confidence = 'high' as int)) as high_confidence, coalesce(max({parts}), 0) as n_co_located, {r6(f'coalesce({year}, 0)')} as year_group, max(cast(source_site = 'programmes_secondary' as int)) as is_secondary from {corpus} where lo_text is not null group by 1"
