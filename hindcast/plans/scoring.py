"""Forecast evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import r6
from hindcast.operators import scoring as S
from hindcast.runtime import table

SM = """q AS (SELECT DISTINCT question_id, correct_answer FROM questions WHERE correct_answer IS NOT NULL),
    pp AS (SELECT p.prediction_id, p.experiment, p.question_id, p.sample_idx, p."binary".probability AS p, p."action".probabilities AS probs FROM predictions p WHERE error IS NULL
           QUALIFY row_number() OVER (PARTITION BY prediction_id) = 1),
    j AS (SELECT pp.*, correct_answer, CASE correct_answer WHEN 'YES' THEN 1.0::DOUBLE WHEN 'NO' THEN 0.0::DOUBLE END AS y FROM pp JOIN q USING (question_id)),
    sm AS (SELECT prediction_id, experiment, question_id, sample_idx, p, y, probs, correct_answer, CASE WHEN y IS NOT NULL THEN 'binary' ELSE 'action' END AS format,
      CASE WHEN y = 1 THEN p WHEN y = 0 THEN 1 - p ELSE coalesce(probs[correct_answer], 0) END AS p_correct,
      CASE WHEN y IS NOT NULL THEN (p - y) * (p - y) ELSE coalesce(list_sum(list_transform(map_entries(probs), lambda e: power(coalesce(e.value, 0) - CASE WHEN e.key = correct_answer THEN 1 ELSE 0 END, 2))), 0)
        + CASE WHEN list_contains(map_keys(probs), correct_answer) THEN 0 ELSE 1 END END AS brier
      FROM j WHERE (y IS NOT NULL AND p IS NOT NULL) OR (y IS NULL AND probs IS NOT NULL)),
    pq AS (SELECT experiment, question_id, format, avg(brier) AS brier, avg(p_correct) AS p_correct, avg(-ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p_correct)))) AS log_loss, count(*) AS n_samples, stddev_pop(brier) AS noise FROM sm GROUP BY 1, 2, 3),
    bq AS (SELECT experiment, question_id, round(avg(p), 9) AS p, max(y) AS y FROM sm WHERE format = 'binary' GROUP BY 1, 2)"""
W = f"WITH {SM} "


def scored(spark: SparkSession, d: str) -> DataFrame:
    return S.samples(table(spark, d, "predictions"), table(spark, d, "questions"))


def binary_means(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).filter("format = 'binary'").groupBy("experiment", "question_id").agg(F.round(F.avg("p"), 9).alias("p"), F.max("y").alias("y"))


def per_question_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.per_question(scored(spark, d)).select("experiment", "question_id", "format", F.round("brier", 10).alias("brier"), F.round("p_correct", 10).alias("p_correct"), F.round("log_loss", 10).alias("log_loss"), "n_samples")


def mean_of_brier(spark: SparkSession, d: str) -> DataFrame:
    return S.per_question(scored(spark, d)).groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("brier")).alias("brier"), r6(F.avg("p_correct")).alias("p_correct"))


def brier_of_mean(spark: SparkSession, d: str) -> DataFrame:
    return binary_means(spark, d).groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0)))).alias("brier"))


def log_loss(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("experiment", "format").agg(r6(F.avg("log_loss")).alias("log_loss"))


def action_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean probability of each option over samples, renormalised (equal shares if all are 0)."""
    long = scored(spark, d).filter("format = 'action'").select("experiment", "question_id", "correct_answer", "prediction_id", F.explode("probs").alias("option", "v"))
    mean = long.groupBy("experiment", "question_id", "correct_answer", "option").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("v"))
    total = mean.groupBy("experiment", "question_id").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("k"))
    return mean.join(total, ["experiment", "question_id"]).withColumn("v", F.when(F.col("total") > 0, F.col("v") / F.col("total")).otherwise(1 / F.col("k")))


AM = """lo AS (SELECT experiment, question_id, correct_answer, unnest(map_entries(probs)) AS e FROM sm WHERE format = 'action'),
    me AS (SELECT experiment, question_id, correct_answer, e.key AS option, avg(coalesce(e.value, 0)) AS v FROM lo GROUP BY 1, 2, 3, 4),
    am AS (SELECT *, CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1.0 / count(*) OVER w END AS pr FROM me WINDOW w AS (PARTITION BY experiment, question_id))"""


def action_mean_dist(spark: SparkSession, d: str) -> DataFrame:
    return action_means(spark, d).select("experiment", "question_id", "option", r6("v").alias("probability"))


def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of questions whose truth is the first or among the first two options (ties by letter)."""
    listed = action_means(spark, d).groupBy("experiment", "question_id", "correct_answer").agg(F.array_sort(F.collect_list(F.struct((-F.round("v", 9)).alias("neg"), "option"))).alias("o"))
    rank = F.array_position(F.transform("o", lambda x: x["option"]), F.col("correct_answer"))
    return listed.groupBy("experiment").agg(r6(F.avg((rank == 1).cast("int"))).alias("top1"), r6(F.avg(rank.isin(1, 2).cast("int"))).alias("top2"))


def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    b = S.reliability(binary_means(spark, d))
    every = b.select("experiment").distinct().select("experiment", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    return every.join(b, ["experiment", "bin"], "left").select("experiment", "bin", F.coalesce("n", F.lit(0)).alias("n"), r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return S.calibration(binary_means(spark, d))


def temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    return S.fit_temperature(binary_means(spark, d))


def temperature_apply(spark: SparkSession, d: str) -> DataFrame:
    """Binary means sharpened or flattened by each experiment's fitted temperature."""
    b = binary_means(spark, d)
    return b.join(S.fit_temperature(b).select("experiment", "t"), "experiment").select("experiment", "question_id", r6(S.temperature_scaled(F.col("p"), F.col("t"))).alias("p"))


GRID = """g AS (SELECT experiment, i, 0.5::DOUBLE + i * (3.5::DOUBLE / 70) AS t, p, y FROM bq, generate_series(0, 70) s(i)),
    sc AS (SELECT *, 1 / (1 + exp(-(ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)))) / t))) AS r FROM g),
    ls AS (SELECT experiment, i, t, round(avg(-CASE WHEN y = 1 THEN ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, r))) ELSE ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, r))) END), 9) AS nll FROM sc GROUP BY 1, 2, 3),
    ft AS (SELECT experiment, t, nll FROM ls QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY nll, i) = 1)"""


def baselines(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a coin, of equal shares and of the base rate, on the questions of each experiment."""
    asked = scored(spark, d).select("experiment", "question_id", "format", "y").distinct()
    q = table(spark, d, "questions").select("question_id", F.size("options").alias("k"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base_rate_estimate"))).alias("base")).distinct()
    even = F.pow(1 - 1 / F.col("k"), F.lit(2.0)) + (F.col("k") - 1) / F.pow("k", F.lit(2.0))
    b = F.col("format") == "binary"
    return asked.join(q, "question_id").groupBy("experiment").agg(
        r6(F.avg(F.when(b, 0.25))).alias("coin"), r6(F.avg(F.when(~b & (F.col("k") > 0), even))).alias("uniform"), r6(F.avg(F.when(b, F.pow(F.col("base") - F.col("y"), F.lit(2.0))))).alias("base_rate")
    )


def slice_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Questions and mean Brier by experiment and, one at a time, format, difficulty and domain."""
    meta = table(spark, d, "questions").select("question_id", F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("domain", F.lit("unknown")).alias("domain")).distinct()
    per = S.per_question(scored(spark, d)).join(meta, "question_id", "left")
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(k).alias("value")) for k in ("format", "difficulty", "domain")))).alias("s")
    return per.select("experiment", "brier", cut).groupBy("experiment", "s.slice", "s.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("brier"), 10).alias("brier"))


SLICES = W + """, m AS (SELECT DISTINCT question_id, coalesce(difficulty, 'unknown') AS difficulty, coalesce(domain, 'unknown') AS domain FROM questions), x AS (SELECT pq.*, difficulty, domain FROM pq LEFT JOIN m USING (question_id))
    SELECT experiment, 'format' AS slice, format AS value, count(*) AS n, round(avg(brier), 10) AS brier FROM x GROUP BY 1, 3 UNION ALL
    SELECT experiment, 'difficulty', difficulty, count(*), round(avg(brier), 10) FROM x GROUP BY 1, 3 UNION ALL
    SELECT experiment, 'domain', domain, count(*), round(avg(brier), 10) FROM x GROUP BY 1, 3"""


def common_set_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean Brier over all own questions and over those that every experiment has scored."""
    per = S.per_question(scored(spark, d))
    n = per.select("experiment").distinct().agg(F.count(F.lit(1)).alias("n_exp"))
    common = per.groupBy("question_id").agg(F.count_distinct("experiment").alias("k")).crossJoin(F.broadcast(n)).filter("k = n_exp").select("question_id", F.lit(True).alias("common"))
    marked = per.join(common, "question_id", "left")
    return marked.groupBy("experiment").agg(F.count(F.lit(1)).alias("n_own"), r6(F.avg("brier")).alias("own"), F.count_if("common").alias("n_common"), r6(F.avg(F.when(F.col("common"), F.col("brier")))).alias("common"))


def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_summary(S.paired(S.per_question(scored(spark, d))))


PD = """pr AS (SELECT x.experiment AS a, z.experiment AS b, x.question_id, round(round(x.brier, 9) - round(z.brier, 9), 9) AS delta FROM pq x JOIN pq z USING (question_id) WHERE x.experiment < z.experiment),
    su AS (SELECT a, b, count(*) AS n, round(avg(delta), 6) AS mean_delta, count(*) FILTER (delta < 0) AS wins, count(*) FILTER (delta > 0) AS losses, count(*) FILTER (delta = 0) AS ties FROM pr GROUP BY 1, 2)"""


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    return S.sign_test(paired_deltas(spark, d))


def wilcoxon_wz(spark: SparkSession, d: str) -> DataFrame:
    return S.wilcoxon(S.paired(S.per_question(scored(spark, d))))


WILCOXON = W + f""", {PD}, nz AS (SELECT *, abs(delta) AS size FROM pr WHERE delta <> 0),
    rk AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY size) + (count(*) OVER (PARTITION BY a, b, size) - 1) / 2.0::DOUBLE AS mid FROM nz),
    ti AS (SELECT a, b, sum(t * t * t - t) AS tied FROM (SELECT a, b, size, count(*)::DOUBLE AS t FROM nz GROUP BY 1, 2, 3) GROUP BY 1, 2),
    s AS (SELECT a, b, count(*) AS n, coalesce(sum(mid) FILTER (delta > 0), 0) AS plus, coalesce(sum(mid) FILTER (delta < 0), 0) AS minus FROM rk GROUP BY 1, 2)
    SELECT a, b, n, round(least(plus, minus), 6) AS w, round((least(plus, minus) - n * (n + 1) / 4.0::DOUBLE - sign(least(plus, minus) - n * (n + 1) / 4.0::DOUBLE) * 0.5)
      / sqrt(greatest(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tied / 48, 1e-12::DOUBLE)), 6) AS z FROM s JOIN ti USING (a, b)"""


def sample_noise(spark: SparkSession, d: str) -> DataFrame:
    per = S.per_question(scored(spark, d)).filter("n_samples >= 2")
    return per.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("noise")).alias("mean_noise"), r6(F.max("noise")).alias("max_noise"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "predictions").select("prediction_id", "experiment", "error", "tokens_in", "tokens_out").distinct()
    return once.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_error"), F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out")
    )


def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Error rows by whether a retry may help."""
    once = table(spark, d, "predictions").filter("error is not null").select("prediction_id", "model_id", F.lower("error").alias("e")).distinct()
    return once.groupBy("model_id", F.col("e").rlike("timeout|timed out|http 5[0-9][0-9]|429|rate limit|unavailable|connection").alias("transient")).agg(F.count(F.lit(1)).alias("n"))


def for_each_experiment(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """``rows`` repeated for each experiment that occurs, by one array of their names."""
    names = predictions.agg(F.collect_set("experiment").alias("experiments"))
    return rows.join(F.broadcast(names)).withColumn("experiment", F.explode("experiments")).drop("experiments")


def resume_antijoin(spark: SparkSession, d: str, n_samples: int = 5) -> DataFrame:
    """Work that is left: question x sample of each experiment, minus what has any row (error rows count as done)."""
    p = table(spark, d, "predictions").select("experiment", "question_id", "sample_idx").distinct()
    asked = for_each_experiment(table(spark, d, "questions").filter("correct_answer is not null").select("question_id").distinct(), p)
    work = asked.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    return work.join(p, ["experiment", "question_id", "sample_idx"], "left_anti")


def missing_questions(spark: SparkSession, d: str) -> DataFrame:
    """Resolved questions without a scored sample in an experiment."""
    own = scored(spark, d).select("experiment", "question_id").distinct()
    every = for_each_experiment(table(spark, d, "questions").filter("correct_answer is not null").select("question_id").distinct(), table(spark, d, "predictions"))
    return every.join(own, ["experiment", "question_id"], "left_anti").groupBy("experiment").agg(F.count(F.lit(1)).alias("n_missing"), F.min("question_id").alias("first"))


def probability_check(spark: SparkSession, d: str) -> DataFrame:
    """Action answers whose probabilities don't sum to one within 0.02."""
    once = table(spark, d, "predictions").select("prediction_id", F.map_values("action.probabilities").alias("v")).filter("v is not null").distinct()
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return once.select("prediction_id", r6(total).alias("total")).filter("total < 0.98 or total > 1.02")


QUERIES = {
    "per_question_scores": (per_question_scores, W + "SELECT experiment, question_id, format, round(brier, 10) AS brier, round(p_correct, 10) AS p_correct, round(log_loss, 10) AS log_loss, n_samples FROM pq"),
    "mean_of_brier": (mean_of_brier, W + "SELECT experiment, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(p_correct), 6) AS p_correct FROM pq GROUP BY 1"),
    "brier_of_mean": (brier_of_mean, W + "SELECT experiment, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM bq GROUP BY 1"),
    "log_loss": (log_loss, W + "SELECT experiment, format, round(avg(-ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p_correct)))), 6) AS log_loss FROM sm GROUP BY 1, 2"),
    "action_mean_dist": (action_mean_dist, W + f", {AM} SELECT experiment, question_id, option, round(pr, 6) AS probability FROM am"),
    "topk_accuracy": (topk_accuracy, W + f""", {AM}, k AS (SELECT *, row_number() OVER (PARTITION BY experiment, question_id ORDER BY round(pr, 9) DESC, option) AS r FROM am),
        h AS (SELECT experiment, question_id, coalesce(max(r) FILTER (option = correct_answer), 99) AS r FROM k GROUP BY 1, 2)
        SELECT experiment, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 2 THEN 1.0 ELSE 0 END), 6) AS top2 FROM h GROUP BY 1"""),
    "reliability_bins": (reliability_bins, W + """, b AS (SELECT experiment, least(CAST(trunc(p * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM bq GROUP BY 1, 2),
        e AS (SELECT DISTINCT experiment, s.i::INT AS bin FROM b, generate_series(0, 9) s(i)) SELECT experiment, bin, coalesce(n, 0) AS n, confidence, accuracy FROM e LEFT JOIN b USING (experiment, bin)"""),
    "calibration": (calibration, W + """, b AS (SELECT experiment, least(CAST(trunc(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM bq GROUP BY 1, 2), t AS (SELECT experiment, count(*) AS total, avg(y) AS base FROM bq GROUP BY 1)
        SELECT experiment, round(sum(n / total * abs(c - a)), 6) AS ece, round(sum(n / total * (c - a) * (c - a)), 6) AS reliability, round(sum(n / total * (a - base) * (a - base)), 6) AS resolution, round(max(base) * (1 - max(base)), 6) AS uncertainty
        FROM b JOIN t USING (experiment) GROUP BY 1"""),
    "temperature_fit": (temperature_fit, W + f", {GRID} SELECT experiment, round(t, 6) AS t, round(nll, 6) AS nll FROM ft"),
    "temperature_apply": (temperature_apply, W + f", {GRID} SELECT experiment, question_id, round(1 / (1 + exp(-(ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)) / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p)))) / t))), 6) AS p FROM bq JOIN ft USING (experiment)"),
    "baselines": (baselines, W + """, a AS (SELECT DISTINCT experiment, question_id, format, y FROM sm), m AS (SELECT DISTINCT question_id, len(options) AS k, greatest(0, least(1, base_rate_estimate)) AS base FROM questions)
        SELECT experiment, round(avg(CASE WHEN format = 'binary' THEN 0.25 END), 6) AS coin, round(avg(CASE WHEN format = 'action' AND k > 0 THEN power(1 - 1.0::DOUBLE / k, 2) + (k - 1) / power(k, 2) END), 6) AS uniform,
          round(avg(CASE WHEN format = 'binary' THEN power(base - y, 2) END), 6) AS base_rate FROM a JOIN m USING (question_id) GROUP BY 1"""),
    "slice_breakdown": (slice_breakdown, SLICES),
    "common_set_means": (common_set_means, W + """, c AS (SELECT question_id FROM pq GROUP BY 1 HAVING count(DISTINCT experiment) = (SELECT count(DISTINCT experiment) FROM pq))
        SELECT experiment, count(*) AS n_own, round(avg(brier), 6) AS own, count(*) FILTER (question_id IN (FROM c)) AS n_common, round(avg(brier) FILTER (question_id IN (FROM c)), 6) AS common FROM pq GROUP BY 1"""),
    "paired_deltas": (paired_deltas, W + f", {PD} SELECT * FROM su"),
    "sign_test": (sign_test, W + f""", {PD} SELECT a, b, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(generate_series(greatest(wins, losses), wins + losses),
        lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) END, 6) AS p_value FROM su"""),
    "wilcoxon_wz": (wilcoxon_wz, WILCOXON),
    "sample_noise": (sample_noise, W + "SELECT experiment, count(*) AS n, round(avg(noise), 6) AS mean_noise, round(max(noise), 6) AS max_noise FROM pq WHERE n_samples >= 2 GROUP BY 1"),
    "token_counts": (token_counts, """WITH p AS (SELECT DISTINCT prediction_id, experiment, error, tokens_in, tokens_out FROM predictions)
        SELECT experiment, count(*) AS n, count(error) AS n_error, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out FROM p GROUP BY 1"""),
    "error_kinds": (error_kinds, """WITH p AS (SELECT DISTINCT prediction_id, model_id, lower(error) AS e FROM predictions WHERE error IS NOT NULL)
        SELECT model_id, regexp_matches(e, 'timeout|timed out|http 5[0-9][0-9]|429|rate limit|unavailable|connection') AS transient, count(*) AS n FROM p GROUP BY 1, 2"""),
    "resume_antijoin": (resume_antijoin, """WITH e AS (SELECT DISTINCT experiment FROM predictions), q AS (SELECT DISTINCT question_id FROM questions WHERE correct_answer IS NOT NULL)
        SELECT experiment, question_id, i::INT AS sample_idx FROM e, q, generate_series(0, 4) s(i) EXCEPT SELECT experiment, question_id, sample_idx FROM predictions"""),
    "missing_questions": (missing_questions, W + """, e AS (SELECT DISTINCT experiment FROM predictions), m AS (SELECT experiment, q.question_id FROM e, (SELECT DISTINCT question_id FROM q) q EXCEPT SELECT experiment, question_id FROM sm)
        SELECT experiment, count(*) AS n_missing, min(question_id) AS first FROM m GROUP BY 1"""),
    "probability_check": (probability_check, """WITH p AS (SELECT DISTINCT p.prediction_id, p."action".probabilities AS m FROM predictions p), t AS (SELECT prediction_id, round(coalesce(list_sum(map_values(m)), 0), 6) AS total FROM p WHERE m IS NOT NULL)
        SELECT prediction_id, total FROM t WHERE total < 0.98 OR total > 1.02"""),
}
