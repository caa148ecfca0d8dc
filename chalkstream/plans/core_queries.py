"""The named queries of the core operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkstream.functions.dialect import DUCK, duck, run
from chalkstream.operators import annotations as ann
from chalkstream.operators import difficulty as diff
from chalkstream.operators import frames, hooks, integrity, models, profiles, scoring
from chalkstream.operators import objectives as lo
from chalkstream.operators import sequences as seq
from chalkstream.operators import relations as rel
from chalkstream.operators import soft, texts
from chalkstream.plans import checks
from chalkstream.plans.registry import query
from chalkstream.session import cut, read


@query("session_profile", duck(profiles.session_profile_sql, utt=frames.UTT))
def session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.session_profile(frames.utterances(spark, sf_dir))


@query("session_rates", duck(profiles.session_rates_sql, utt=frames.UTT, profile=profiles.session_profile_sql(DUCK, "utt")))
def session_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.session_rates(session_profile(spark, sf_dir))


@query("dialogue_profile", duck(profiles.dialogue_profile_sql, utt=frames.UTT))
def dialogue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.dialogue_profile(frames.utterances(spark, sf_dir))


# sequences within a session

U, T, R = {"utt": frames.UTT}, {"utt": frames.UTT, "talk": frames.TALK}, {"utt": frames.UTT, "talk": frames.TALK, "turns": frames.TURNS}


def _utt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.utterances(spark, sf_dir)


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.talk(_utt(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.turns(_talk(spark, sf_dir))


@query("turn_merge", duck(seq.turns_sql, **R))
def turn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.turns_sql, turns=_turns(spark, sf_dir))


@query("turn_verdicts", duck(seq.turn_verdicts_sql, **R))
def turn_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.turn_verdicts_sql, turns=_turns(spark, sf_dir))


@query("impasse_contingency", duck(seq.impasse_sql, **T))
def impasse_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.impasse_sql, talk=_talk(spark, sf_dir))


@query("repair_arcs", duck(seq.repairs_sql, **R, verdicts=seq.turn_verdicts_sql(DUCK, "turns")))
def repair_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _talk(spark, sf_dir)
    return run(seq.repairs_sql, talk=said, verdicts=run(seq.turn_verdicts_sql, turns=frames.turns(said)))


@query("record_block", duck(seq.record_sql, **R, graded=seq.graded_sql(DUCK, "turns")))
def record_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.record_sql, graded=seq.graded(_turns(spark, sf_dir)))


@query("interaction_block", checks.INTERACTIONS)
def interaction_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.interactions_sql, utt=_utt(spark, sf_dir))


@query("asof_neighbours", checks.NEIGHBOURS)
def asof_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.neighbours_own_sql, near=run(seq.neighbours_sql, utt=_utt(spark, sf_dir)))


@query("role_positions", duck(seq.positions_sql, **U))
def role_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.positions_sql, utt=seq.with_role_places(_utt(spark, sf_dir)))


@query("objective_prompt", duck(seq.transcript_sql, **U, resp=frames.RESP))
def objective_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.transcript_sql, utt=_utt(spark, sf_dir), resp=frames.responses(spark, sf_dir))


@query("dialogue_rendering", duck(seq.rendering_sql, **R))
def dialogue_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(seq.rendering_sql, turns=_turns(spark, sf_dir))


# objectives

UR, TR = {"utt": frames.UTT, "resp": frames.RESP}, {**R, "resp": frames.RESP}


def _resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.responses(spark, sf_dir)


@query("objective_coverage", duck(lo.coverage_sql, **UR))
def objective_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.coverage_sql, utt=_utt(spark, sf_dir), resp=_resp(spark, sf_dir))


@query("objective_mentions", duck(lo.mentions_sql, **UR))
def objective_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.mentions_sql, utt=_utt(spark, sf_dir), resp=_resp(spark, sf_dir))


@query("objective_local_window", duck(lo.local_window_sql, **UR, idf=lo.idf_sql(DUCK, "resp")))
def objective_local_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = _resp(spark, sf_dir)
    return run(lo.local_window_sql, utt=_utt(spark, sf_dir), resp=resp, idf=run(lo.idf_sql, resp=resp))


@query("objective_local_deltas", duck(lo.local_deltas_sql, **UR, idf=lo.idf_sql(DUCK, "resp"), local=lo.local_window_sql(DUCK, "utt", "resp", "idf"), dialogue=profiles.dialogue_profile_sql(DUCK, "utt")))
def objective_local_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.local_deltas_sql, local=objective_local_window(spark, sf_dir), resp=_resp(spark, sf_dir), dialogue=dialogue_profile(spark, sf_dir))


@query("objective_turn_windows", checks.TURN_WINDOWS)
def objective_turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return lo.turn_windows(turns, lo.turn_masses(run(soft.probabilities_sql, turns=turns)), _resp(spark, sf_dir))


@query("programme_history", checks.HISTORY)
def programme_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.history_sql, utt=lo.with_offsets(_utt(spark, sf_dir)), resp=_resp(spark, sf_dir))


@query("objective_surface", duck(lo.surface_sql, resp=frames.RESP))
def objective_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.surface_sql, resp=_resp(spark, sf_dir))


@query("curriculum_match", duck(lo.curriculum_sql, resp=frames.RESP, statements="select * from nc_curriculum"))
def curriculum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.curriculum_sql, resp=_resp(spark, sf_dir), statements=read(spark, sf_dir, "nc_curriculum"))


@query("session_task", duck(lo.session_task_sql, resp=frames.RESP))
def session_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.session_task_sql, resp=_resp(spark, sf_dir))


@query("objective_difficulty", duck(lo.difficulty_sql, resp=frames.RESP, labels=frames.LABELS))
def objective_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(lo.difficulty_sql, resp=_resp(spark, sf_dir), labels=frames.labels(spark, sf_dir))


# soft codes

RP = {**R, "probs": soft.probabilities_sql(DUCK, "turns")}


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.probabilities_sql, turns=_turns(spark, sf_dir))


@query("soft_rates", duck(soft.rates_sql, **RP))
def soft_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.rates_sql, probs=_probs(spark, sf_dir))


@query("soft_weighted_rates", duck(soft.weighted_sql, **RP))
def soft_weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.weighted_sql, probs=_probs(spark, sf_dir))


@query("soft_boundaries", duck(soft.boundaries_sql, **RP))
def soft_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.boundaries_sql, probs=_probs(spark, sf_dir))


@query("soft_directions", duck(soft.directions_sql, **RP))
def soft_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.directions_sql, probs=_probs(spark, sf_dir))


@query("soft_transitions", duck(soft.transitions_sql, **RP))
def soft_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.transitions_sql, probs=_probs(spark, sf_dir))


@query("soft_ratios", duck(soft.ratios_sql, **RP))
def soft_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.ratios_sql, probs=_probs(spark, sf_dir))


@query("soft_interview", duck(soft.interview_sql, **RP))
def soft_interview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(soft.interview_sql, probs=_probs(spark, sf_dir))


# annotations

A = {"utt": frames.UTT, "ann": ann.annotations_sql(DUCK, "code_annotations")}


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ann.annotations_sql, raw=read(spark, sf_dir, "code_annotations"))


@query("annotation_tutor_codes", duck(ann.tutor_codes_sql, **A))
def annotation_tutor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ann.tutor_codes_sql, ann=_ann(spark, sf_dir))


@query("annotation_student_codes", duck(ann.student_codes_sql, **A))
def annotation_student_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ann.student_codes_sql, ann=_ann(spark, sf_dir))


@query("annotation_sessions", duck(ann.compiled_sql, **A, tutor=ann.tutor_codes_sql(DUCK, "ann"), student=ann.student_codes_sql(DUCK, "ann")))
def annotation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ann.compiled_sql, tutor=annotation_tutor_codes(spark, sf_dir), student=annotation_student_codes(spark, sf_dir))


@query("annotation_spans", duck(ann.code_windows_sql, **A))
def annotation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ann.code_windows_sql, ann=_ann(spark, sf_dir), utt=_utt(spark, sf_dir))


@query("annotation_objectives", duck(ann.objective_codes_sql, raw="select * from code_annotations"))
def annotation_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ann.objective_codes_sql, raw=read(spark, sf_dir, "code_annotations"))


# difficulty and folds


@query("knn_difficulty", diff.knn_duck())
def knn_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), (F.col("label") >= 5).cast("int").alias("y"))
    prior = v.agg(F.avg("y")).first()[0] or 0.0
    return diff.neighbour_difficulty(diff.nearest(v, v.where("id % 50 = 0")), prior)


_PARTS = "select l_partkey as lo, l_suppkey as kc, cast(l_returnflag = 'R' as int) as y from {}"


@query("shared_part_difficulty", duck(diff.shared_parts_sql, outcomes=_PARTS.format("lineitem")))
def shared_part_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_partkey as lo", "l_suppkey as kc", "cast(l_returnflag = 'R' as int) as y")
    return run(diff.shared_parts_sql, outcomes=lines)


@query("ability_contrast", duck(diff.contrast_sql, **TR, labels=frames.LABELS, graded=seq.graded_sql(DUCK, "turns"), record=seq.record_sql(DUCK, "graded"), diff=lo.difficulty_sql(DUCK, "resp", "labels")))
def ability_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(diff.contrast_sql, record=record_block(spark, sf_dir), diff=objective_difficulty(spark, sf_dir), resp=_resp(spark, sf_dir))


@query("greedy_folds")
def greedy_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.greedy_folds(read(spark, sf_dir, "orders"), "o_custkey")


@query("clean_sessions", duck(diff.clean_rows_sql, resp=frames.RESP))
def clean_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(diff.clean_rows_sql, resp=_resp(spark, sf_dir))


@query("fold_rates", duck(diff.fold_rates_sql, resp=frames.RESP, labels=frames.LABELS))
def fold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(diff.fold_rates_sql, resp=_resp(spark, sf_dir), labels=frames.labels(spark, sf_dir))


# scores

S = {"resp": frames.RESP, "scores": scoring.stub_sql(DUCK, "resp")}


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(scoring.stub_sql, resp=_resp(spark, sf_dir))


@query("blended_scores", duck(scoring.blended_sql, **S))
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(scoring.blended_sql, scores=_scores(spark, sf_dir))


@query("output_contract", duck(scoring.output_sql, **S, labels=frames.LABELS, blended=scoring.blended_sql(DUCK, "scores"), wanted="select response_id from labels"))
def output_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(scoring.output_sql, wanted=frames.labels(spark, sf_dir).select("response_id"), blended=blended_scores(spark, sf_dir))


_PRED = f"with resp as ({frames.RESP}), scores as ({scoring.stub_sql(DUCK, 'resp')}), blended as ({scoring.blended_sql(DUCK, 'scores')}), labels as ({frames.LABELS}) select p, y from blended join labels on blended.response_id = labels.response_id"


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blended_scores(spark, sf_dir).join(frames.labels(spark, sf_dir), "response_id").select("p", "y")


@query("score_metrics", scoring.metrics_duck(_PRED))
def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.metrics(_pred(spark, sf_dir))


@query("calibration_fit")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt's a and b fitted on all scores, and the shift that makes the mean of scores the base rate."""
    pred = _pred(spark, sf_dir)
    a, b = scoring.fit_platt(pred)
    shift = scoring.recentre(pred, pred.agg(F.avg("y")).first()[0] or 0.5)
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(shift, 6))], "a double, b double, shift double")


# texts


@query("lexicon_counts", duck(texts.lexicon_counts_sql, **U))
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(texts.lexicon_counts_sql, utt=_utt(spark, sf_dir))


@query("token_profile", duck(texts.token_profile_sql, **U))
def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(texts.token_profile_sql, utt=_utt(spark, sf_dir))


@query("normalised_objectives", duck(texts.normalised_sql, resp=frames.RESP))
def normalised_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(texts.normalised_sql, resp=_resp(spark, sf_dir))


@query("derived_columns", duck(texts.columns_sql, **U, profile=profiles.session_profile_sql(DUCK, "utt")))
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(texts.columns_sql, profile=session_profile(spark, sf_dir))


@query("head_keep_truncation", duck(texts.truncated_sql, resp=frames.RESP))
def head_keep_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(texts.truncated_sql, resp=_resp(spark, sf_dir))


@query("publisher_match")
def publisher_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective texts against curriculum statements by matching-blocks ratio."""
    entries = [r.statement for r in read(spark, sf_dir, "nc_curriculum").where("statement is not null").select(F.lower(F.regexp_replace("statement", "^Pupils should be taught to ", "")).alias("statement")).distinct().orderBy("statement").collect()]
    return texts.best_ratio(_resp(spark, sf_dir).select(F.lower("lo_text").alias("lo_text")), "lo_text", entries)


@query("batch_packing")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed into batches of at most 2,000 characters, and how many each session needs."""
    return texts.packed(frames.turn_sizes(spark, sf_dir), "session_id", "i", "size", 2000).groupBy("session_id").agg(F.max("batch").alias("last_batch"), F.count(F.lit(1)).alias("n_turns"))


_BUDGET = """select session_id, count(*) as n_kept, cast(sum(size) as bigint) as kept_size from (select *, sum(size) over (partition by session_id) - coalesce(sum(size) over (partition by session_id order by size desc, i desc rows between unbounded preceding and 1 preceding), 0) as rest
 from (select session_id, i, length(teacher) + length(student) as size from turns) a) b where rest <= 4000 group by session_id"""


@query("budget_truncation", f"with utt as ({frames.UTT}), talk as ({frames.TALK}), turns as ({frames.TURNS}) {_BUDGET}")
def budget_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that stay when the longest go until 4,000 characters are left."""
    sized = _turns(spark, sf_dir).where("own").selectExpr("session_id", "i", "length(teacher) + length(student) as size")
    return texts.dropped_longest(sized, "session_id", "i", "size", 4000).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("size").alias("kept_size"))


# joins and sets


@query("labelled_responses", duck(rel.labelled_sql, resp=frames.RESP, labels=frames.LABELS))
def labelled_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.labelled_sql, resp=_resp(spark, sf_dir), labels=frames.labels(spark, sf_dir))


@query("response_spine", duck(rel.spine_sql, **UR, labels=frames.LABELS, profile=profiles.session_profile_sql(DUCK, "utt"), task=lo.session_task_sql(DUCK, "resp"), difficulty=lo.difficulty_sql(DUCK, "resp", "labels")))
def response_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.spine_sql, resp=_resp(spark, sf_dir), profile=session_profile(spark, sf_dir), task=session_task(spark, sf_dir), difficulty=objective_difficulty(spark, sf_dir))


@query("fallback_responses", duck(rel.fallback_sql, **UR))
def fallback_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.fallback_sql, resp=_resp(spark, sf_dir), utt=_utt(spark, sf_dir))


@query("covered_sessions", duck(rel.covered_sql, **UR))
def covered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.covered_sql, resp=_resp(spark, sf_dir), utt=_utt(spark, sf_dir))


@query("annotated_utterances", duck(rel.annotated_sql, **A))
def annotated_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.annotated_sql, utt=_utt(spark, sf_dir), ann=_ann(spark, sf_dir))


@query("session_extremes", duck(rel.extremes_sql, **U))
def session_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.extremes_sql, utt=_utt(spark, sf_dir))


@query("first_responses", duck(rel.distinct_sql, resp=frames.RESP))
def first_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.distinct_sql, resp=_resp(spark, sf_dir))


@query("session_sets", duck(rel.union_sql, **UR))
def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.union_sql, utt=_utt(spark, sf_dir), resp=_resp(spark, sf_dir))


@query("event_log", duck(rel.answer_log_sql, events="select * from events"))
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(rel.answer_log_sql, events=read(spark, sf_dir, "events"))


# models and hooks


@query("text_model_scores")
def text_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of objective text and id for every labelled response, three folds by the objective's hash."""
    rows = run(rel.labelled_sql, resp=_resp(spark, sf_dir), labels=frames.labels(spark, sf_dir)).join(_resp(spark, sf_dir).select("response_id", "lo_text"), "response_id")
    rows = cut(rows.withColumn("fold", F.pmod(F.xxhash64("lo_id"), F.lit(3)).cast("int")))
    return models.out_of_fold(rows, models.text_pipeline(), 3).select("response_id", "fold", "p")


@query("learned_difficulty")
def learned_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), (F.col("label") >= 5).cast("double").alias("rate"), F.lit(1).alias("n"))
    return models.learned_difficulty(v, 0.5)


_KINDS = ("explain", "answer", "prompt")


_HEADS = f"""with utt as ({frames.UTT}), talk as ({frames.TALK}), coef(code, term, w) as (values ('explain', 'because', 2.0), ('explain', 'reason', 1.5), ('answer', 'answer', 2.5), ('answer', 'equals', 1.0), ('prompt', 'why', 2.0), ('prompt', 'how', 1.5), ('prompt', 'what', 0.5)),
 t as (select session_id, i, unnest(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'))) as term from talk), z as (select session_id, i, code, sum(w) as z from t join coef using (term) group by all), k(code) as (values ('explain'), ('answer'), ('prompt'))
 select session_id, code, round(avg(1 / (1 + exp(-(coalesce(z, 0) - 2.0)))), 6) as rate, count(*) as n from (select session_id, i, code from talk, k) g left join z using (session_id, i, code) group by 1, 2"""


@query("linear_head_probabilities", _HEADS)
def linear_head_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic heads over the words of every utterance of talk, with a small coefficient table, summed by session and code."""
    coef = spark.createDataFrame([("explain", "because", 2.0), ("explain", "reason", 1.5), ("answer", "answer", 2.5), ("answer", "equals", 1.0), ("prompt", "why", 2.0), ("prompt", "how", 1.5), ("prompt", "what", 0.5)], "code string, term string, w double")
    said = _talk(spark, sf_dir).where("own").select("session_id", F.concat_ws("|", "session_id", "i").alias("row"), "content")
    p = models.linear_heads(said, "row", "content", coef, spark.createDataFrame([(k, -2.0) for k in _KINDS], "code string, b double"))
    return p.groupBy(F.substring_index("row", "|", 1).alias("session_id"), "code").agg(F.round(F.avg("p"), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("prompt_texts")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotator's prompt of each session, within its budget."""
    said = _talk(spark, sf_dir).where("own").select("session_id", "i", "content")
    return hooks.prompts(said, "Classify these utterances:").select("session_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query("annotator_answers", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as uid, upper(event_type) as code from events")
def annotator_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of event properties read in whatever shape, beside the same field by JSON path."""
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"utterance_id": '), F.get_json_object("props", "$.k"), F.lit(', "code": "'), F.upper("event_type"), F.lit('"}')).alias("t"), F.array("event_id").alias("ids"))
    return texts.annotator_codes(e, "t", "ids").select("event_id", F.col("codes")[0]["utterance_id"].alias("uid"), F.col("codes")[0]["code"].alias("code"))


@query("scored_texts", f"select response_id, round(length(lo_text) / (length(lo_text) + 40.0), 6) as p from ({frames.RESP}) r")
def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer called in batches of like length over objective texts; here the length itself, squashed."""
    texts_ = _resp(spark, sf_dir).select("response_id", "lo_text")
    return hooks.scored(texts_, "response_id", "lo_text", lambda: lambda b: [len(x) / (len(x) + 40.0) for x in b]).select("response_id", F.round("p", 6).alias("p"))


_SHUFFLE = f"""with d as (select distinct lo_id from ({frames.RESP}) r), a as (select lo_id, row_number() over (order by md5('0|' || lo_id)) as k from d), b as (select lo_id as other, row_number() over (order by md5('18|' || lo_id)) as k from d) select lo_id, other from a join b using (k)"""


@query("control_shuffle", _SHUFFLE)
def control_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bijection of objectives onto themselves, for controls that must not help."""
    return integrity.shuffled(_resp(spark, sf_dir), "lo_id", 17)


@query("fold_fingerprint")
def fold_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all fold assignments, the same in any order."""
    return spark.createDataFrame([(integrity.frozen_hash(diff.greedy_folds(read(spark, sf_dir, "orders"), "o_custkey"), "o_custkey", "fold"),)], "sha256 string")


@query("knn_difficulty_flat", diff.flat_duck())
def knn_difficulty_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), (F.col("label") >= 5).cast("int").alias("y"))
    return diff.flat_difficulty(diff.nearest(v, v.where("id % 50 = 0"), exclude_self=False))


@query("curriculum_assembly", duck(lo.assembled_sql, resp=f"select response_id, session_id, lo_id, lower(lo_text) as lo_text from ({frames.RESP}) r0", statements="select * from nc_curriculum", surface=lo.surface_sql(DUCK, "resp"), matched=lo.curriculum_sql(DUCK, "resp", "statements")))
def curriculum_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    resp = _resp(spark, sf_dir).withColumn("lo_text", F.lower("lo_text"))
    return run(lo.assembled_sql, surface=run(lo.surface_sql, resp=resp), matched=run(lo.curriculum_sql, resp=resp, statements=read(spark, sf_dir, "nc_curriculum")))


_CORPUS = "select concat(p_name, ' ', p_size) as lo_text, case when p_size % 2 = 0 then 'high' else 'low' end as confidence, repeat(concat(p_brand, ';'), p_size % 4) as co_located_los, cast(p_size % 13 as double) as year_group, case when p_partkey % 3 = 0 then 'programmes_secondary' else 'programmes_primary' end as source_site from {}"


@query("publisher_corpus", duck(lo.publisher_sql, corpus=_CORPUS.format("part")))
def publisher_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table in the role of a publisher's corpus."""
    read(spark, sf_dir, "part").createOrReplaceTempView("part_as_corpus")
    return run(lo.publisher_sql, corpus=spark.sql(_CORPUS.format("part_as_corpus")))
