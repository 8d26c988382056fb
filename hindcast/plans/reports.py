"""Summaries of experiments, held-out calibration, contrasts and briefing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import clamp, r6
from hindcast.operators import scoring as S
from hindcast.operators.retrieval import first_of, largest, visible
from hindcast.plans.retrieval import EV, events
from hindcast.plans.scoring import AM, GRID, PD, WILCOXON, W, action_means, binary_means, scored
from hindcast.runtime import Scratch, table
from hindcast.sources.files import markdown

C = lambda x: f"greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {x}))"
#: A question is in the fitting part if its hash begins below this: three tenths of all.
FIT_BELOW = "4ccd"


def mean_scores(spark: SparkSession, d: str) -> DataFrame:
    """``experiment, question_id, format, brier, p_correct`` of the mean forecast of each question."""
    b = binary_means(spark, d).select(
        "experiment", "question_id", F.lit("binary").alias("format"), F.pow(F.col("p") - F.col("y"), F.lit(2.0)).alias("brier"), F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")).alias("p_correct")
    )
    hit = F.col("option") == F.col("correct_answer")
    a = action_means(spark, d).groupBy("experiment", "question_id").agg(
        F.lit("action").alias("format"),
        (F.sum(F.pow(F.col("v") - hit.cast("double"), F.lit(2.0))) + F.when(F.bool_or(hit), 0.0).otherwise(1.0)).alias("brier"),
        F.coalesce(F.max(F.when(hit, F.col("v"))), F.lit(0.0)).alias("p_correct"),
    )
    return b.unionByName(a)


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row an experiment: questions by format, Brier scores and log loss of the mean forecasts."""
    only = lambda c, f: r6(F.avg(F.when(F.col("format") == f, F.col(c))))
    return mean_scores(spark, d).groupBy("experiment").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("format") == "binary").alias("n_binary"), F.count_if(F.col("format") == "action").alias("n_action"), r6(F.avg("brier")).alias("brier"),
        only("brier", "binary").alias("brier_binary"), only("brier", "action").alias("brier_action"), r6(F.avg(-F.log(clamp(F.col("p_correct"))))).alias("log_loss"), r6(F.avg("p_correct")).alias("p_correct"),
    )


SUMMARY = W + f""", {AM}, al AS (SELECT experiment, 'binary' AS format, (p - y) * (p - y) AS brier, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pc FROM bq UNION ALL
      SELECT experiment, 'action', sum(power(pr - CASE WHEN option = correct_answer THEN 1 ELSE 0 END, 2)) + CASE WHEN bool_or(option = correct_answer) THEN 0 ELSE 1 END, coalesce(max(CASE WHEN option = correct_answer THEN pr END), 0)
      FROM am GROUP BY experiment, question_id)
    SELECT experiment, count(*) AS n_scored, count(*) FILTER (format = 'binary') AS n_binary, count(*) FILTER (format = 'action') AS n_action, round(avg(brier), 6) AS brier, round(avg(brier) FILTER (format = 'binary'), 6) AS brier_binary,
      round(avg(brier) FILTER (format = 'action'), 6) AS brier_action, round(avg(-ln({C('pc')})), 6) AS log_loss, round(avg(pc), 6) AS p_correct FROM al GROUP BY 1"""


def fitting(question: str) -> Column:
    """Whether a question belongs to the fitting part: by its hash, so for every experiment and every run alike."""
    return F.substring(F.sha2(question, 256), 1, 4) < FIT_BELOW


def holdout_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Temperature fitted on the fitting part, and the Brier score of the other questions before and after it.

    An experiment without fitting questions keeps temperature 1.
    """
    b = binary_means(spark, d).withColumn("fit", fitting("question_id"))
    t = S.fit_temperature(b.filter("fit")).select("experiment", "t")
    both = b.join(t, "experiment", "left").withColumn("t", F.coalesce("t", F.lit(1.0)))
    error = lambda p: r6(F.avg(F.when(~F.col("fit"), F.pow(p - F.col("y"), F.lit(2.0)))))
    return both.groupBy("experiment", "t").agg(F.count_if("fit").alias("n_fit"), F.count_if(~F.col("fit")).alias("n_eval"), error(F.col("p")).alias("brier"), error(S.temperature_scaled(F.col("p"), F.col("t"))).alias("brier_scaled"))


IS_FIT = f"substr(sha256(question_id), 1, 4) < '{FIT_BELOW}'"
HOLDOUT = W + f""", fq AS (SELECT * FROM bq WHERE {IS_FIT}), {GRID.replace("FROM bq", "FROM fq")},
    x AS (SELECT bq.*, round(coalesce(t, 1), 6) AS t, {IS_FIT} AS fit FROM bq LEFT JOIN ft USING (experiment)),
    z AS (SELECT *, 1 / (1 + exp(-ln({C('p')} / (1 - {C('p')})) / t)) AS r FROM x)
    SELECT experiment, t, count(*) FILTER (fit) AS n_fit, count(*) FILTER (NOT fit) AS n_eval, round(avg((p - y) * (p - y)) FILTER (NOT fit), 6) AS brier, round(avg((r - y) * (r - y)) FILTER (NOT fit), 6) AS brier_scaled FROM z GROUP BY 1, 2"""


def action_temperature(spark: SparkSession, d: str, steps: int = 71) -> DataFrame:
    """``experiment, t, nll``: the grid temperature of the softmax over options with the least mean loss, ties to the smallest.

    The array of a question's options is bounded by the options asked; the grid multiplies rows by a constant and its losses
    are partial sums.
    """
    return fit_action_temperature(action_means(spark, d), steps)


def fit_action_temperature(means: DataFrame, steps: int = 71) -> DataFrame:
    """The same from the ``means`` (experiment, question_id, option, correct_answer, v) of options."""
    hit = (F.col("option") == F.col("correct_answer")).alias("hit")
    options = means.groupBy("experiment", "question_id").agg(F.collect_list(F.struct(clamp(F.round("v", 9)).alias("v"), hit)).alias("o"))
    at = options.select("experiment", "o", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i")).withColumn("t", 0.5 + F.col("i") * (3.5 / (steps - 1)))
    power = lambda x: F.pow(x["v"], 1 / F.col("t"))
    total = F.aggregate("o", F.lit(0.0), lambda s, x: s + power(x))
    on_truth = F.aggregate("o", F.lit(0.0), lambda s, x: s + F.when(x["hit"], power(x)).otherwise(0.0))
    loss = at.groupBy("experiment", "i", "t").agg(F.round(F.avg(-F.log(clamp(on_truth / total))), 9).alias("nll"))
    return loss.groupBy("experiment").agg(F.min(F.struct("nll", "i", "t")).alias("b")).select("experiment", r6("b.t").alias("t"), r6("b.nll").alias("nll"))


ACTION_T = W + f""", {AM}, ac AS (SELECT experiment, question_id, option = correct_answer AS hit, {C('round(pr, 9)')} AS c FROM am),
    g AS (SELECT experiment, question_id, i, 0.5::DOUBLE + i * (3.5::DOUBLE / 70) AS t, hit, c FROM ac, generate_series(0, 70) s(i)),
    qr AS (SELECT experiment, question_id, i, t, sum(CASE WHEN hit THEN power(c, 1 / t) ELSE 0 END) / sum(power(c, 1 / t)) AS r FROM g GROUP BY 1, 2, 3, 4),
    l AS (SELECT experiment, i, t, round(avg(-ln({C('r')})), 9) AS nll FROM qr GROUP BY 1, 2, 3)
    SELECT experiment, round(t, 6) AS t, round(nll, 6) AS nll FROM l QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY nll, i) = 1"""


def contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Each two experiments on the questions both scored: mean and upper median difference, signed ranks and their p-value.

    The differences are written once, since means, medians and ranks each read them.
    """
    deltas = Scratch(spark).keep(S.paired(S.per_question(scored(spark, d))))
    mean = deltas.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta")).alias("mean_delta"))
    ranks = S.wilcoxon(deltas).select("a", "b", "w", "z", F.round(S.normal_two_sided(F.col("z")), 5).alias("p_value"))
    return mean.join(S.upper_median(deltas), ["a", "b"]).join(ranks, ["a", "b"], "left")


CONTRASTS = WILCOXON.replace("SELECT a, b, n, round(least(plus, minus), 6) AS w", ", wz AS (SELECT a, b, round(least(plus, minus), 6) AS w", 1) + """),
    md AS (SELECT a, b, delta AS median FROM (SELECT a, b, delta, row_number() OVER (PARTITION BY a, b ORDER BY delta) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM pr) WHERE i = n // 2),
    tt AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM wz)
    SELECT a, b, n, mean_delta, median, w, z, round(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x), 5) AS p_value
    FROM su JOIN md USING (a, b) LEFT JOIN tt USING (a, b)"""


def truth_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What a question's resolution says is true (format and answer), and how many answers contradict it."""
    status, answer = F.col("resolution_status"), F.col("correct_answer")
    kind = F.when(status.isin("resolved_yes", "resolved_no"), "binary").when(status == "resolved_option", "action").otherwise("open")
    wanted = F.when(status == "resolved_yes", answer == "YES").when(status == "resolved_no", answer == "NO").when(status == "resolved_option", answer.rlike("^[A-Z]$"))
    q = table(spark, d, "questions").select("question_id", "resolution_status", "correct_answer").distinct()
    return q.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(answer.isNull()).alias("n_unanswered"), F.count_if(~wanted).alias("n_contradicted"))


TRUTH = """WITH q AS (SELECT DISTINCT question_id, resolution_status AS s, correct_answer AS c FROM questions)
    SELECT CASE WHEN s IN ('resolved_yes', 'resolved_no') THEN 'binary' WHEN s = 'resolved_option' THEN 'action' ELSE 'open' END AS kind, count(*) AS n, count(*) FILTER (c IS NULL) AS n_unanswered,
      count(*) FILTER ((s = 'resolved_yes' AND c <> 'YES') OR (s = 'resolved_no' AND c <> 'NO') OR (s = 'resolved_option' AND NOT regexp_full_match(c, '[A-Z]'))) AS n_contradicted FROM q GROUP BY 1"""


def option_shares(spark: SparkSession, d: str) -> DataFrame:
    """Action answers on the letters of the options asked: letters without a probability, letters never asked, and the share
    of the first-ranked letter after renormalising (ties to the first letter; null if all are 0)."""
    p = table(spark, d, "predictions").filter("action.probabilities is not null").select("prediction_id", "question_id", F.map_entries("action.probabilities").alias("e")).dropDuplicates(["prediction_id"])
    k = table(spark, d, "questions").filter("size(options) > 0").select("question_id", F.size("options").alias("k")).distinct()
    letters = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.char(F.lit(65) + i))
    got = p.join(k, "question_id").withColumn("m", F.map_from_entries("e")).withColumn("letters", letters)
    shares = F.transform("letters", lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0)))
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    with_total = got.withColumn("shares", shares).withColumn("total", total)
    missing = F.size(F.filter("letters", lambda x: F.try_element_at(F.col("m"), x).isNull()))
    return with_total.select(
        "prediction_id", missing.alias("n_missing"), F.size(F.array_except(F.map_keys("m"), "letters")).alias("n_foreign"),
        F.when(F.col("total") > 0, F.get("letters", (F.array_position("shares", F.array_max("shares")) - 1).cast("int"))).alias("top"), r6(F.when(F.col("total") > 0, F.array_max("shares") / F.col("total"))).alias("share"),
    )


OPTION_SHARES = """WITH k AS (SELECT DISTINCT question_id, len(options) AS k FROM questions WHERE len(options) > 0), p AS (SELECT prediction_id, question_id, "action".probabilities AS m FROM predictions WHERE "action".probabilities IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prediction_id) = 1),
    l AS (SELECT prediction_id, m, list_transform(range(0, k), lambda i: chr(65 + CAST(i AS INT))) AS letters FROM p JOIN k USING (question_id)),
    s AS (SELECT *, list_transform(letters, lambda x: coalesce(m[x], 0)) AS shares FROM l)
    SELECT prediction_id, len(list_filter(letters, lambda x: m[x] IS NULL)) AS n_missing, len(list_filter(map_keys(m), lambda x: NOT list_contains(letters, x))) AS n_foreign,
      CASE WHEN list_sum(shares) > 0 THEN letters[list_position(shares, list_max(shares))] END AS top, CASE WHEN list_sum(shares) > 0 THEN round(list_max(shares) / list_sum(shares), 6) END AS share FROM s"""


def briefing_documents(spark: SparkSession, d: str) -> DataFrame:
    """The briefing of each request: its window, then a line for each returned record that it may see, in order of rank.

    A request's lines are at most its top_k, which is cut by a window before they are gathered.
    """
    asked = table(spark, d, "retrieval_requests").select("request_id", "simulation_date", "model_training_cutoff", "top_k").distinct()
    hits = table(spark, d, "retrieval_hits").groupBy("request_id", "record_id").agg(F.min("hit_rank").alias("hit_rank"))
    seen = visible(events(spark, d)).select("record_id", "event_date", "headline")
    shown = hits.join(asked, "request_id").join(seen, "record_id").filter("event_date <= simulation_date")
    ok = first_of(shown, "request_id", ["hit_rank", "record_id"], largest(asked, "top_k"), "top_k", "place")
    line = F.concat("place", F.lit(". ["), F.date_format("event_date", "yyyy-MM-dd"), F.lit("] "), F.trim(F.coalesce("headline", F.lit(""))))
    lines = ok.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("Records from "), F.coalesce(F.date_format("model_training_cutoff", "yyyy-MM-dd"), F.lit("?")), F.lit(" to "), F.date_format("simulation_date", "yyyy-MM-dd"), F.lit(": "), F.coalesce("n", F.lit(0)))
    return asked.join(lines, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("n"), F.concat_ws("\n", head, F.lit("-" * 60), "lines").alias("briefing"))


BRIEFING = f"""WITH {EV}, rq AS (SELECT DISTINCT request_id, simulation_date, model_training_cutoff, top_k FROM retrieval_requests), h AS (SELECT request_id, record_id, min(hit_rank) AS hit_rank FROM retrieval_hits GROUP BY 1, 2),
    k AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY hit_rank, record_id) AS place, top_k, event_date, headline FROM h JOIN rq USING (request_id) JOIN ev USING (record_id) WHERE date_confidence <> 'uncertain' AND event_date <= simulation_date),
    l AS (SELECT request_id, count(*) AS n, string_agg(place || '. [' || strftime(event_date, '%Y-%m-%d') || '] ' || trim(coalesce(headline, '')), chr(10) ORDER BY place) AS lines FROM k WHERE place <= top_k GROUP BY 1)
    SELECT request_id, coalesce(n, 0) AS n, concat_ws(chr(10), 'Records from ' || coalesce(strftime(model_training_cutoff, '%Y-%m-%d'), '?') || ' to ' || strftime(simulation_date, '%Y-%m-%d') || ': ' || coalesce(n, 0), repeat('-', 60), lines) AS briefing
    FROM rq LEFT JOIN l USING (request_id)"""


def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """The summary of experiments as the rows of a Markdown table."""
    return markdown(score_summary(spark, d).select("experiment", "n_scored", "brier", "brier_binary", "brier_action", "log_loss"), ["experiment"])


LINES = f"""WITH su AS ({SUMMARY}) SELECT row_number() OVER (ORDER BY experiment) AS line_no, '| ' || concat_ws(' | ', experiment, n_scored, coalesce(printf('%.4f', brier), '-'), coalesce(printf('%.4f', brier_binary), '-'),
    coalesce(printf('%.4f', brier_action), '-'), coalesce(printf('%.4f', log_loss), '-')) || ' |' AS line FROM su"""

QUERIES = {
    "summary_lines": (summary_lines, LINES),
    "score_summary": (score_summary, SUMMARY),
    "holdout_temperature": (holdout_temperature, HOLDOUT),
    "action_temperature": (action_temperature, ACTION_T),
    "contrasts": (contrasts, CONTRASTS),
    "truth_kinds": (truth_kinds, TRUTH),
    "option_shares": (option_shares, OPTION_SHARES),
    "briefing_documents": (briefing_documents, BRIEFING),
}
