"""Proper scores of probabilistic forecasts, calibration and paired statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import brier_map, clamp, r6


def samples(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each scored sample: ``experiment, question_id, format, p_correct, brier, log_loss`` and its parts.

    Error rows, samples without an answer and questions without a resolution are left out; a repeated prediction_id counts
    once.  Binary: the squared error; action: the sum over options and the truth.
    """
    truth = questions.filter("correct_answer is not null").select("question_id", "correct_answer").distinct()
    once = predictions.filter("error is null").dropDuplicates(["prediction_id"])
    joined = once.join(truth, "question_id")
    y = F.when(F.col("correct_answer") == "YES", 1.0).when(F.col("correct_answer") == "NO", 0.0)
    p = F.col("binary.probability")
    probs = F.col("action.probabilities")
    is_binary = y.isNotNull() & p.isNotNull()
    is_action = y.isNull() & probs.isNotNull()
    p_correct = F.when(is_binary, F.when(y == 1, p).otherwise(1 - p)).when(is_action, F.coalesce(F.try_element_at(probs, "correct_answer"), F.lit(0.0)))
    return (
        joined.filter(is_binary | is_action)
        .select(
            "prediction_id", "experiment", "question_id", "sample_idx", F.when(is_binary, "binary").otherwise("action").alias("format"), p.alias("p"), y.alias("y"), probs.alias("probs"), "correct_answer",
            p_correct.alias("p_correct"),
            F.when(is_binary, F.pow(p - y, F.lit(2.0))).otherwise(brier_map(probs, F.col("correct_answer"))).alias("brier"),
        )
        .withColumn("log_loss", -F.log(clamp(F.col("p_correct"))))
    )


def per_question(scored: DataFrame) -> DataFrame:
    """Means over the samples of a question; each sample is scored first."""
    return scored.groupBy("experiment", "question_id", "format").agg(
        F.avg("brier").alias("brier"), F.avg("p_correct").alias("p_correct"), F.avg("log_loss").alias("log_loss"), F.count(F.lit(1)).alias("n_samples"), F.stddev_pop("brier").alias("noise")
    )


def bin_of(p: Column, bins: int) -> Column:
    return F.least((p * bins).cast("int"), F.lit(bins - 1))


def reliability(binary: DataFrame, bins: int = 10) -> DataFrame:
    """``experiment, bin, n, confidence, accuracy`` of mean probabilities of binary questions."""
    return binary.groupBy("experiment", bin_of(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def calibration(binary: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Murphy's parts, from the bins of ``reliability`` alone."""
    binned = reliability(binary, bins)
    total = binned.groupBy("experiment").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("base"))
    part = lambda c: r6(F.sum(F.col("n") / F.col("total") * c))
    return (
        binned.join(total, "experiment")
        .groupBy("experiment")
        .agg(
            part(F.abs(F.col("confidence") - F.col("accuracy"))).alias("ece"),
            part(F.pow(F.col("confidence") - F.col("accuracy"), F.lit(2.0))).alias("reliability"),
            part(F.pow(F.col("accuracy") - F.col("base"), F.lit(2.0))).alias("resolution"),
            r6(F.first("base") * (1 - F.first("base"))).alias("uncertainty"),
        )
    )


def temperature_scaled(p: Column, t: Column) -> Column:
    q = clamp(p)
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) / t)))


def fit_temperature(binary: DataFrame, steps: int = 71, low: float = 0.5, high: float = 4.0) -> DataFrame:
    """``experiment, t, nll``: the grid temperature with the least mean loss, ties to the smallest.

    All grid losses are sums of one pass over the questions: the grid is fixed, so rows grow by a constant.
    """
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i")
    at = binary.select("experiment", "p", "y", grid).withColumn("t", F.lit(low) + F.col("i") * ((high - low) / (steps - 1)))
    q = clamp(temperature_scaled(F.col("p"), F.col("t")))
    loss = at.groupBy("experiment", "i", "t").agg(F.round(F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))), 9).alias("nll"))
    best = loss.groupBy("experiment").agg(F.min(F.struct("nll", "i", "t")).alias("b"))
    return best.select("experiment", r6("b.t").alias("t"), r6("b.nll").alias("nll"))


def paired(per: DataFrame) -> DataFrame:
    """``a, b, question_id, delta`` for every two experiments that both scored a question."""
    left = per.select("question_id", F.col("experiment").alias("a"), F.round("brier", 9).alias("x"))
    right = per.select("question_id", F.col("experiment").alias("b"), F.round("brier", 9).alias("z"))
    return left.join(right, "question_id").filter("a < b").select("a", "b", "question_id", F.round(F.col("x") - F.col("z"), 9).alias("delta"))


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, 1/2) and k >= n / 2, in n steps: the first term by logarithms, each next one from the last."""
    whole = F.sequence(F.lit(1), F.greatest(n - k, F.lit(1)))
    log_first = F.aggregate(whole, -n * F.log(F.lit(2.0)), lambda s, j: s + F.when(j <= n - k, F.log((k + j) / j)).otherwise(0.0))
    first = F.exp(log_first)
    start = F.struct(first.alias("sum"), first.alias("term"))
    step = lambda s, i: F.struct((s["sum"] + s["term"] * (n - i) / (i + 1)).alias("sum"), (s["term"] * (n - i) / (i + 1)).alias("term"))
    return F.when(k > n, F.lit(0.0)).otherwise(F.aggregate(F.sequence(k, F.greatest(k, n)), start, step, lambda s: s["sum"]))


def paired_summary(deltas: DataFrame) -> DataFrame:
    """Mean, wins, losses, ties and the exact sign test of each pair of experiments."""
    w, l = F.count_if(F.col("delta") < 0), F.count_if(F.col("delta") > 0)
    return deltas.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta")).alias("mean_delta"), w.alias("wins"), l.alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"))


def sign_test(summary: DataFrame) -> DataFrame:
    n, top = (F.col("wins") + F.col("losses")).cast("int"), F.greatest("wins", "losses").cast("int")
    return summary.select("a", "b", "wins", "losses", r6(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, top)))).alias("p_value"))


def with_before(counted: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """``counted`` (one row a group and value) with ``before``: the sum of ``weight`` over the group's smaller values.

    In two steps, so that no group is ordered by one task: sums over steps of 1/2048, of which differences of scores (-2..2) have
    at most 8,193, then the order within a step.
    """
    stepped = counted.withColumn("step", F.floor(F.col(value) * 2048))
    earlier = lambda *keys: Window.partitionBy(*by, *keys).rowsBetween(Window.unboundedPreceding, -1)
    steps = stepped.groupBy(*by, "step").agg(F.sum(weight).alias("m"))
    base = steps.select(*by, "step", F.coalesce(F.sum("m").over(earlier().orderBy("step")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum(weight).over(earlier("step").orderBy(value)), F.lit(0))
    return stepped.join(base, [*by, "step"]).withColumn("before", F.col("base") + inner).drop("step", "base")


def medians(deltas: DataFrame) -> DataFrame:
    """``a, b, n, median``: the middle one of the sorted differences, of an even number the mean of the middle two."""
    counted = deltas.groupBy("a", "b", "delta").agg(F.count(F.lit(1)).alias("t"))
    ends = counted.groupBy("a", "b").agg(F.sum("t").alias("n"))
    placed = with_before(counted, ["a", "b"], "delta", "t").join(ends, ["a", "b"])
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    inside = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("t"))
    middle = placed.groupBy("a", "b", "n").agg(F.max(F.when(inside(low), F.col("delta"))).alias("x"), F.max(F.when(inside(high), F.col("delta"))).alias("z"))
    return middle.select("a", "b", "n", r6((F.col("x") + F.col("z")) / 2).alias("median"))


def upper_median(deltas: DataFrame) -> DataFrame:
    """``a, b, median``: the value at position n // 2 (from 0) of the sorted differences."""
    counted = deltas.groupBy("a", "b", "delta").agg(F.count(F.lit(1)).alias("t"))
    middle = counted.groupBy("a", "b").agg(F.floor(F.sum("t") / 2).alias("at"))
    placed = with_before(counted, ["a", "b"], "delta", "t").join(middle, ["a", "b"])
    return placed.filter("before <= at and at < before + t").select("a", "b", F.col("delta").alias("median"))


def normal_two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)), by the rational form 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def wilcoxon(deltas: DataFrame) -> DataFrame:
    """``a, b, n, w, z``: signed-rank statistic with midranks, tie-adjusted variance and continuity correction."""
    nonzero = deltas.filter("delta <> 0").withColumn("size", F.abs("delta"))
    ties = nonzero.groupBy("a", "b", "size").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("delta") > 0).alias("up"))
    ranked = with_before(ties, ["a", "b"], "size", "t").withColumn("mid", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.groupBy("a", "b").agg(F.sum("t").alias("n"), F.sum(F.col("mid") * F.col("up")).alias("plus"), F.sum(F.col("mid") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("tied"))
    n, least = F.col("n"), F.least("plus", "minus")
    mean, var = n * (n + 1) / 4, F.greatest(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48, F.lit(1e-12))
    gap = least - mean
    return sums.select("a", "b", "n", r6(least).alias("w"), r6((gap - F.signum(gap) * 0.5) / F.sqrt(var)).alias("z"))


def bootstrap_intervals(rows: DataFrame, by: list[str], unit: str, value: str, draws: int = 10_000, groups: int = 64) -> DataFrame:
    """``by``, ``mean, low, high``: mean of ``value`` and its 95 % interval by a Poisson bootstrap with ``draws`` resamples.

    ``rows`` has one row a group and ``unit``.  A unit's weights in all resamples are Poisson(1) numbers from a generator keyed by
    the unit, so they are the same in every group, run and partitioning.  A task keeps two sums a resample for each of its
    groups, at most ``groups`` at once; rows with a null value take no part.
    """
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = list(zip(*sums)) or [()] * len(by)
            lists = lambda i: pa.array([list(v[i]) for v in sums.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*(pa.array(n, f.type) for n, f in zip(names, fields)), lists(0), lists(1)], names=[*by, "w", "wx"])

        fields: list[pa.Field] = []
        for batch in batches:
            fields = [batch.schema.field(i) for i in range(len(by))]
            columns = [c.to_pylist() for c in batch.columns]
            for *group, seed, x in zip(*columns):
                weights = np.random.Generator(np.random.Philox(key=seed & (2**64 - 1))).poisson(1.0, draws)
                at = sums.setdefault(tuple(group), np.zeros((2, draws)))
                at[0] += weights
                at[1] += weights * x
                if len(sums) >= groups:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    clean = rows.filter(F.col(value).isNotNull())
    partial = clean.select(*by, F.xxhash64(F.col(unit).cast("string")).alias("seed"), F.col(value).cast("double").alias("x")).mapInArrow(run, f"{keys}, w array<double>, wx array<double>")
    each = partial.select(*by, F.posexplode(F.arrays_zip("w", "wx")).alias("draw", "s")).groupBy(*by, "draw").agg((F.sum("s.wx") / F.nullif(F.sum("s.w"), F.lit(0.0))).alias("m"))
    ends = each.groupBy(*by).agg(r6(F.percentile("m", 0.025)).alias("low"), r6(F.percentile("m", 0.975)).alias("high"))
    return clean.groupBy(*by).agg(r6(F.avg(value)).alias("mean")).join(ends, by)
