"""Scores of experiments beyond the plain means: strict options, spread of samples, scaled and held-out options, one report row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import brier_map_strict, clamp, r6
from hindcast.operators import scoring as S
from hindcast.plans import reports, scoring
from hindcast.plans.reports import ACTION_T, C, IS_FIT, SUMMARY, fitting
from hindcast.plans.scoring import AM, PD, W, action_means, scored


def strict_brier(spark: SparkSession, d: str) -> DataFrame:
    """Brier scores over the predicted options only; answers in which the truth is absent are counted and have no score."""
    value = brier_map_strict(F.col("probs"), F.col("correct_answer"), fail=False)
    per = scored(spark, d).filter("format = 'action'").select("experiment", value.alias("brier"))
    return per.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("brier").isNull()).alias("n_absent"), r6(F.avg("brier")).alias("brier"))


STRICT = W + """SELECT experiment, count(*) AS n, count(*) FILTER (NOT list_contains(map_keys(probs), correct_answer)) AS n_absent,
      round(avg(CASE WHEN list_contains(map_keys(probs), correct_answer) THEN brier END), 6) AS brier FROM sm WHERE format = 'action' GROUP BY 1"""


def sample_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation of a question's binary forecasts; the deviation of a single one is 0."""
    b = scored(spark, d).filter("format = 'binary'").groupBy("experiment", "question_id")
    return b.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean"), r6(F.coalesce(F.stddev_samp("p"), F.lit(0.0))).alias("deviation"))


SPREAD = W + """SELECT experiment, question_id, count(*) AS n, round(avg(p), 6) AS mean, round(coalesce(stddev_samp(p), 0), 6) AS deviation
    FROM sm WHERE format = 'binary' GROUP BY 1, 2"""


def delta_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median difference of Brier scores of each two experiments; of an even number the mean of the middle two."""
    return S.medians(S.paired(S.per_question(scored(spark, d))))


MEDIANS = W + f", {PD} SELECT a, b, count(*) AS n, round(quantile_cont(delta, 0.5), 6) AS median FROM pr GROUP BY 1, 2"


def scaled(options: DataFrame, temperatures: DataFrame) -> DataFrame:
    """``options`` (experiment, question_id, option, v, ...) with ``scaled``: the softmax of the logs over the temperature.

    Experiments without a temperature keep 1.
    """
    at = options.join(temperatures, "experiment", "left").withColumn("t", F.coalesce("t", F.lit(1.0)))
    powered = at.withColumn("power", F.pow(clamp(F.round("v", 9)), 1 / F.col("t")))
    return powered.withColumn("scaled", F.col("power") / F.sum("power").over(Window.partitionBy("experiment", "question_id"))).drop("power")


def action_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Mean option probabilities sharpened or flattened by each experiment's fitted temperature."""
    t = reports.action_temperature(spark, d).select("experiment", "t")
    return scaled(action_means(spark, d), t).select("experiment", "question_id", "option", r6("scaled").alias("probability"))


SCALED = W + f""", {AM}, t AS ({ACTION_T}), p AS (SELECT experiment, question_id, option, power({C('round(pr, 9)')}, 1 / t) AS x FROM am JOIN t USING (experiment))
    SELECT experiment, question_id, option, round(x / sum(x) OVER (PARTITION BY experiment, question_id), 6) AS probability FROM p"""


def holdout_action(spark: SparkSession, d: str) -> DataFrame:
    """Temperature of options fitted on the fitting part, and the Brier score of the other questions before and after it."""
    means = action_means(spark, d).withColumn("fit", fitting("question_id"))
    t = reports.fit_action_temperature(means.filter("fit")).select("experiment", "t")
    hit = F.col("option") == F.col("correct_answer")
    error = lambda p: F.sum(F.pow(p - hit.cast("double"), F.lit(2.0))) + F.when(F.bool_or(hit), 0.0).otherwise(1.0)
    per = scaled(means, t).groupBy("experiment", "t", "question_id", "fit").agg(error(F.col("v")).alias("x"), error(F.col("scaled")).alias("z"))
    rest = lambda c: r6(F.avg(F.when(~F.col("fit"), F.col(c))))
    return per.groupBy("experiment", r6("t").alias("t")).agg(F.count_if("fit").alias("n_fit"), F.count_if(~F.col("fit")).alias("n_eval"), rest("x").alias("brier"), rest("z").alias("brier_scaled"))


FIT_T = ACTION_T.replace(" FROM am)", f" FROM am WHERE {IS_FIT})")
HOLDOUT_ACTION = W + f""", {AM}, ft AS ({FIT_T}), x AS (SELECT am.*, coalesce(t, 1) AS t, {IS_FIT} AS fit, power({C('round(pr, 9)')}, 1 / coalesce(t, 1)) AS w FROM am LEFT JOIN ft USING (experiment)),
    y AS (SELECT *, w / sum(w) OVER (PARTITION BY experiment, question_id) AS s, CASE WHEN option = correct_answer THEN 1 ELSE 0 END AS hit FROM x),
    qs AS (SELECT experiment, t, question_id, fit, sum(power(pr - hit, 2)) + 1 - max(hit) AS x, sum(power(s - hit, 2)) + 1 - max(hit) AS z FROM y GROUP BY 1, 2, 3, 4)
    SELECT experiment, round(t, 6) AS t, count(*) FILTER (fit) AS n_fit, count(*) FILTER (NOT fit) AS n_eval, round(avg(x) FILTER (NOT fit), 6) AS brier, round(avg(z) FILTER (NOT fit), 6) AS brier_scaled FROM qs GROUP BY 1, 2"""


def experiment_report(spark: SparkSession, d: str) -> DataFrame:
    """One row an experiment with all of its scores: summary, noise, first and second options, calibration, temperatures (of
    binary and action questions and the mean of those there are) and baselines; what an experiment lacks is null."""
    out = reports.score_summary(spark, d)
    parts = [
        scoring.sample_noise(spark, d).select("experiment", "mean_noise"), scoring.topk_accuracy(spark, d), scoring.calibration(spark, d),
        scoring.temperature_fit(spark, d).select("experiment", F.col("t").alias("t_binary")), reports.action_temperature(spark, d).select("experiment", F.col("t").alias("t_action")),
        scoring.baselines(spark, d),
    ]
    for part in parts:
        out = out.join(part, "experiment", "left")
    known = F.filter(F.array("t_binary", "t_action"), lambda t: t.isNotNull())
    return out.withColumn("t", r6(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, t: s + t) / F.size(known))))


def report_sql() -> str:
    q = {name: sql for name, (_, sql) in scoring.QUERIES.items()}
    parts = (f"(SELECT experiment, mean_noise FROM ({q['sample_noise']}))", f"({q['topk_accuracy']})", f"({q['calibration']})", f"(SELECT experiment, t AS t_binary FROM ({q['temperature_fit']}))",
             f"(SELECT experiment, t AS t_action FROM ({ACTION_T}))", f"({q['baselines']})")
    return "SELECT *, round(CASE WHEN t_binary IS NULL THEN t_action WHEN t_action IS NULL THEN t_binary ELSE (t_binary + t_action) / 2 END, 6) AS t FROM (" + SUMMARY + ") " + " ".join(f"LEFT JOIN {p} USING (experiment)" for p in parts)


QUERIES = {
    "strict_brier": (strict_brier, STRICT),
    "sample_spread": (sample_spread, SPREAD),
    "delta_medians": (delta_medians, MEDIANS),
    "action_scaled": (action_scaled, SCALED),
    "holdout_action": (holdout_action, HOLDOUT_ACTION),
    "experiment_report": (experiment_report, report_sql()),
}
