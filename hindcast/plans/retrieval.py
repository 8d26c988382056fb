"""Retrieval, coverage and date validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import host, netloc, normal_topics, r6
from hindcast.operators.retrieval import one_of_each, top_k, visible, window_counts
from hindcast.runtime import table

EV = "ev AS (SELECT * FROM event_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingestion_date) = 1)"
#: Search queries are every twentieth request, against all records.
RQ = """rq AS (SELECT DISTINCT request_id, simulation_date AS simulation, model_training_cutoff AS cutoff, top_k, topic_filter AS topics FROM retrieval_requests),
    v AS (SELECT h.request_id, min_by(e.embedding, h.hit_rank) AS vector FROM (SELECT DISTINCT request_id, record_id, hit_rank FROM retrieval_hits) h
          JOIN ev e USING (record_id) GROUP BY 1)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return one_of_each(table(spark, d, "event_records"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "retrieval_requests")
        .select("request_id", F.col("simulation_date").alias("simulation"), F.col("model_training_cutoff").alias("cutoff"), "top_k", F.col("topic_filter").alias("topics"))
        .distinct()
    )


def with_vectors(spark: SparkSession, d: str, every: int = 20) -> DataFrame:
    """Requests whose id is divisible by ``every``, with the embedding of its best hit as the query vector."""
    hits = table(spark, d, "retrieval_hits").filter(F.col("request_id") % every == 0).select("request_id", "record_id", "hit_rank").distinct()
    vectors = hits.join(events(spark, d).select("record_id", "embedding"), "record_id").groupBy("request_id").agg(F.min_by("embedding", "hit_rank").alias("vector"))
    return requests(spark, d).join(vectors, "request_id")


def temporal_topk(spark: SparkSession, d: str, every: int = 20) -> DataFrame:
    return top_k(events(spark, d), with_vectors(spark, d, every).withColumn("topics", F.array().cast("array<string>")))


def topic_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return top_k(events(spark, d), with_vectors(spark, d))


def topk_sql(topics: str) -> str:
    return f"""
    WITH {EV}, {RQ},
    n AS (SELECT rq.request_id, ev.record_id, rq.top_k, ev.confidence, list_cosine_distance(CAST(v.vector AS DOUBLE[]), CAST(ev.embedding AS DOUBLE[])) AS dist
          FROM rq JOIN v USING (request_id) JOIN ev ON ev.event_date BETWEEN rq.cutoff AND rq.simulation
          WHERE rq.request_id % 20 = 0 AND ev.date_confidence <> 'uncertain' AND {topics}),
    k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(dist * (2 - confidence), 9), record_id) AS rank FROM n WHERE dist <= 0.8)
    SELECT request_id, record_id, rank, round(dist, 6) AS distance FROM k WHERE rank <= top_k"""


def window_count(spark: SparkSession, d: str) -> DataFrame:
    return window_counts(events(spark, d), requests(spark, d))


WINDOW_COUNT = f"""
    WITH {EV}, {RQ}
    SELECT rq.request_id, count(*) FILTER (date_confidence <> 'uncertain') AS n_in_window, count(*) FILTER (date_confidence = 'uncertain') AS n_quarantined
    FROM rq LEFT JOIN ev ON ev.event_date BETWEEN rq.cutoff AND rq.simulation GROUP BY 1"""


def model_cutoff_windows(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    """Records between a model's cutoff and each request's simulation date, by the request's model.

    A model without a cutoff has no window: its requests are counted, its records are null.  ``strict``: it is an error.
    """
    models = table(spark, d, "model_windows").select(F.lower(F.trim("model_id")).alias("model"), "training_cutoff")
    asked = table(spark, d, "retrieval_requests").select("request_id", "simulation_date", F.lower(F.trim("model_id")).alias("model")).distinct()
    cutoff = F.col("training_cutoff")
    if strict:
        cutoff = F.coalesce(cutoff, F.raise_error(F.concat(F.lit("no cutoff of model "), F.coalesce("model", F.lit("null")))).cast("date"))
    spans = asked.join(models, "model", "left").select("request_id", "model", cutoff.alias("cutoff"), F.col("simulation_date").alias("simulation"))
    counted = spans.join(window_counts(events(spark, d), spans), "request_id").withColumn("n_in_window", F.when(F.col("cutoff").isNotNull(), F.col("n_in_window")))
    return counted.groupBy("model").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n_in_window").alias("n_records"))


MODEL_CUTOFF_WINDOWS = f"""
    WITH {EV}, a AS (SELECT DISTINCT request_id, simulation_date, lower(trim(model_id)) AS model FROM retrieval_requests),
    s AS (SELECT a.*, training_cutoff FROM a LEFT JOIN model_windows m ON lower(trim(m.model_id)) = a.model)
    SELECT model, count(DISTINCT request_id) AS n_requests, CASE WHEN max(training_cutoff) IS NOT NULL THEN count(record_id) END AS n_records
    FROM s LEFT JOIN ev ON ev.date_confidence <> 'uncertain' AND ev.event_date BETWEEN training_cutoff AND simulation_date GROUP BY 1"""


def hits_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Returned records that a request must not see: unknown ones, ones dated later, quarantined ones."""
    hits = table(spark, d, "retrieval_hits").select("request_id", "record_id").distinct()
    joined = hits.join(requests(spark, d).select("request_id", "simulation"), "request_id").join(events(spark, d).select("record_id", "event_date", "date_confidence"), "record_id", "left")
    state = F.when(F.col("event_date").isNull(), "unknown").when(F.col("event_date") > F.col("simulation"), "later").when(F.col("date_confidence") == "uncertain", "quarantined").otherwise("visible")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("n_requests"))


HITS_LEAKAGE = f"""
    WITH {EV}, {RQ}, h AS (SELECT DISTINCT request_id, record_id FROM retrieval_hits)
    SELECT CASE WHEN event_date IS NULL THEN 'unknown' WHEN event_date > simulation THEN 'later' WHEN date_confidence = 'uncertain' THEN 'quarantined' ELSE 'visible' END AS state,
      count(*) AS n, count(DISTINCT h.request_id) AS n_requests FROM h JOIN rq USING (request_id) LEFT JOIN ev USING (record_id) GROUP BY 1"""


def briefing_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line of each visible record in a briefing."""
    line = F.concat(
        F.lit("["), F.date_format("event_date", "yyyy-MM-dd"), F.lit("] "), F.trim("headline"),
        F.when(F.length("summary") > 0, F.concat(F.lit(" - "), "summary")).otherwise(""),
        F.when(F.size("topics") > 0, F.concat(F.lit(" (topics: "), F.array_join("topics", ", "), F.lit(")"))).otherwise(""),
    )
    return visible(events(spark, d)).select("record_id", line.alias("line"))


BRIEFING_LINES = f"""
    WITH {EV} SELECT record_id, '[' || strftime(event_date, '%Y-%m-%d') || '] ' || trim(headline) || CASE WHEN length(summary) > 0 THEN ' - ' || summary ELSE '' END
      || CASE WHEN len(topics) > 0 THEN ' (topics: ' || array_to_string(topics, ', ') || ')' ELSE '' END AS line FROM ev WHERE date_confidence <> 'uncertain'"""


def events_per_month(spark: SparkSession, d: str) -> DataFrame:
    return visible(events(spark, d)).groupBy(F.date_format("event_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


MONTHS = "mo AS (SELECT strftime(event_date, '%Y-%m') AS month, count(*) AS n FROM ev WHERE date_confidence <> 'uncertain' GROUP BY 1)"


def calendar(monthly: DataFrame) -> DataFrame:
    """Every month between the first and the last."""
    ends = monthly.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return ends.select(F.explode(F.sequence(F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01"))), F.expr("interval 1 month"))).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


CALENDAR = "cal AS (SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(min(strptime(month || '-01', '%Y-%m-%d')), max(strptime(month || '-01', '%Y-%m-%d')), interval 1 month)) AS m FROM mo))"


def monthly_gaps(spark: SparkSession, d: str, sparse: int = 15) -> DataFrame:
    """Months of the calendar without records (CRITICAL) or with fewer than ``sparse`` (SPARSE)."""
    monthly = events_per_month(spark, d)
    n = F.coalesce("n", F.lit(0))
    return calendar(monthly).join(monthly, "month", "left").select("month", n.alias("n"), F.when(n == 0, "CRITICAL").when(n < sparse, "SPARSE").otherwise("OK").alias("state"))


MONTHLY_GAPS = f"""WITH {EV}, {MONTHS}, {CALENDAR} SELECT month, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'CRITICAL' WHEN n < 15 THEN 'SPARSE' ELSE 'OK' END AS state FROM cal LEFT JOIN mo USING (month)"""


def recency_bias(spark: SparkSession, d: str) -> DataFrame:
    """Months with at least three times the mean of all months (needs three months)."""
    per = events_per_month(spark, d)
    total = per.agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("months"))
    return per.crossJoin(F.broadcast(total)).select("month", "n", r6(F.col("n") / F.col("mean")).alias("ratio"), ((F.col("months") >= 3) & (F.col("n") >= 3 * F.col("mean"))).alias("biased"))


RECENCY_BIAS = f"""WITH {EV}, {MONTHS} SELECT month, n, round(n / (SELECT avg(n) FROM mo), 6) AS ratio, (SELECT count(*) FROM mo) >= 3 AND n >= 3 * (SELECT avg(n) FROM mo) AS biased FROM mo"""


def topic_months(spark: SparkSession, d: str) -> DataFrame:
    """Normalised topics of each month and their records."""
    return (
        visible(events(spark, d)).select(F.date_format("event_date", "yyyy-MM").alias("month"), F.explode(normal_topics("topics")).alias("topic")).groupBy("month", "topic").agg(F.count(F.lit(1)).alias("n"))
    )


NORMAL = "list_sort(list_distinct(list_filter(list_transform(topics, lambda t: replace(replace(lower(trim(t)), ' ', '_'), '-', '_')), lambda t: t <> '')))"
TOPIC_MONTHS = f"WITH {EV}, t AS (SELECT strftime(event_date, '%Y-%m') AS month, unnest({NORMAL}) AS topic FROM ev WHERE date_confidence <> 'uncertain') SELECT month, topic, count(*) AS n FROM t GROUP BY 1, 2"


def missing_topics(spark: SparkSession, d: str, core: int = 12) -> DataFrame:
    """Of the ``core`` most frequent topics those that a month lacks; only months with at least one of them count."""
    per = topic_months(spark, d)
    top = per.groupBy("topic").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "topic").limit(core).select("topic")
    present = per.join(F.broadcast(top), "topic").select("month", "topic")
    wanted = present.select("month").distinct().crossJoin(F.broadcast(top))
    return wanted.join(present, ["month", "topic"], "left_anti").groupBy("month").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("missing"))


MISSING_TOPICS = f"""WITH {EV}, t AS (SELECT strftime(event_date, '%Y-%m') AS month, unnest({NORMAL}) AS topic FROM ev WHERE date_confidence <> 'uncertain'),
    top AS (SELECT topic FROM t GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 12), pr AS (SELECT DISTINCT month, topic FROM t JOIN top USING (topic)),
    w AS (SELECT DISTINCT pr.month, top.topic FROM pr CROSS JOIN top)
    SELECT month, string_agg(topic, ',' ORDER BY topic) AS missing FROM w ANTI JOIN pr USING (month, topic) GROUP BY 1"""


def quarantine_rate(spark: SparkSession, d: str) -> DataFrame:
    q = F.count_if(F.col("date_confidence") == "uncertain")
    return events(spark, d).agg(F.count(F.lit(1)).alias("n"), q.alias("n_quarantined"), r6(q / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("rate"))


QUARANTINE_RATE = f"WITH {EV} SELECT count(*) AS n, count(*) FILTER (date_confidence = 'uncertain') AS n_quarantined, round(count(*) FILTER (date_confidence = 'uncertain') / greatest(count(*), 1), 6) AS rate FROM ev"


def layer_one() -> F.Column:
    """First failed check of a record's own date, or null."""
    early = F.exists("sources", lambda s: F.coalesce(F.date_add(s["pub_date"], 1) < F.col("event_date"), F.lit(False)))
    return F.when(F.col("event_date") > F.to_date("ingestion_date"), "future").when(F.col("event_date_precision") == "unknown", "precision").when(early, "source_before_event")


def layer_two() -> F.Column:
    """Date confidence after counting sources."""
    n, c = F.size("sources"), F.col("date_confidence")
    return (
        F.when(n <= 0, "uncertain")
        .when((n == 1) & (c != "uncertain"), "single_source")
        .when((n >= 3) & (c == "high"), "verified")
        .when((n >= 2) & (c == "medium"), "high")
        .when((n >= 2) & (c == "uncertain"), "quarantine")
        .otherwise(c)
    )


def validate_dates(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("record_id", layer_one().alias("failed"), layer_two().alias("confidence_after"), (layer_one().isNull() & (layer_two() != "quarantine")).alias("valid"))


L1 = "CASE WHEN event_date > CAST(ingestion_date AS DATE) THEN 'future' WHEN event_date_precision = 'unknown' THEN 'precision' WHEN len(list_filter(sources, lambda s: s.pub_date + 1 < event_date)) > 0 THEN 'source_before_event' END"
L2 = """CASE WHEN coalesce(len(sources), 0) = 0 THEN 'uncertain' WHEN len(sources) = 1 AND date_confidence <> 'uncertain' THEN 'single_source' WHEN len(sources) >= 3 AND date_confidence = 'high' THEN 'verified'
    WHEN len(sources) >= 2 AND date_confidence = 'medium' THEN 'high' WHEN len(sources) >= 2 AND date_confidence = 'uncertain' THEN 'quarantine' ELSE date_confidence END"""
VALIDATE_DATES = f"WITH {EV} SELECT record_id, {L1} AS failed, {L2} AS confidence_after, {L1} IS NULL AND {L2} <> 'quarantine' AS valid FROM ev"


def isolated_dates(spark: SparkSession, d: str) -> DataFrame:
    """Days with at most one record beside a day with ten or more, by an equi-join of daily counts."""
    days = events(spark, d).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    beside = days.select(F.explode(F.array(F.date_add("event_date", 1), F.date_sub("event_date", 1))).alias("event_date"), F.col("n").alias("m")).groupBy("event_date").agg(F.max("m").alias("busiest"))
    return days.join(beside, "event_date").filter("n <= 1 and busiest >= 10").select("event_date", "n", "busiest")


ISOLATED_DATES = f"""WITH {EV}, dd AS (SELECT event_date, count(*) AS n FROM ev GROUP BY 1)
    SELECT a.event_date, a.n, max(b.n) AS busiest FROM dd a JOIN dd b ON b.event_date IN (a.event_date - 1, a.event_date + 1) WHERE a.n <= 1 GROUP BY 1, 2 HAVING max(b.n) >= 10"""


def source_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Records whose first dated source came more than 30 days after the event."""
    first = F.array_min(F.transform("sources", lambda s: s["pub_date"]))
    return events(spark, d).select("record_id", F.datediff(first, "event_date").alias("days")).filter("days > 30")


SOURCE_GAPS = f"WITH {EV} SELECT record_id, date_diff('day', event_date, list_min(list_transform(sources, lambda s: s.pub_date))) AS days FROM ev WHERE date_diff('day', event_date, list_min(list_transform(sources, lambda s: s.pub_date))) > 30"


def source_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Sources by host, with how many records name it and on how many days."""
    s = events(spark, d).select("record_id", "event_date", F.explode("sources").alias("s")).select("record_id", "event_date", netloc("s.url").alias("netloc"), host("s.url").alias("host"))
    return s.groupBy("netloc", "host").agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct("event_date").alias("n_days"))


SOURCE_HOSTS = f"""WITH {EV}, s AS (SELECT record_id, event_date, regexp_extract(unnest(sources).url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc FROM ev)
    SELECT netloc, ltrim(lower(netloc), 'w.') AS host, count(DISTINCT record_id) AS n_records, count(DISTINCT event_date) AS n_days FROM s GROUP BY 1, 2"""


def topic_normalize(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("record_id", F.array_join(normal_topics("topics"), ",").alias("topics"))


TOPIC_NORMALIZE = f"WITH {EV} SELECT record_id, array_to_string({NORMAL}, ',') AS topics FROM ev"


def best_headline(spark: SparkSession, d: str) -> DataFrame:
    """Of each lead actor's month the headline with the best length, ties to the first record."""
    score = F.least(F.size(F.split(F.trim("headline"), " +")) / 15.0, F.lit(1.0)) - 0.2 * F.size(F.regexp_extract_all(F.lower("headline"), F.lit("(unmoved|uncertainty|talks)"), F.lit(1)))
    lead = events(spark, d).select(F.get("actors", F.lit(0)).alias("actor_id"), F.date_format("event_date", "yyyy-MM").alias("month"), "record_id", "headline", r6(score).alias("score")).filter("actor_id is not null and headline is not null")
    best = lead.groupBy("actor_id", "month").agg(F.min(F.struct((-F.col("score")).alias("neg"), "record_id", "headline")).alias("b"))
    return best.select("actor_id", "month", "b.record_id", "b.headline", (-F.col("b.neg")).alias("score"))


BEST_HEADLINE = f"""WITH {EV}, l AS (SELECT actors[1] AS actor_id, strftime(event_date, '%Y-%m') AS month, record_id, headline,
      round(least(len(regexp_split_to_array(trim(headline), ' +')) / 15.0, 1.0) - 0.2 * len(regexp_extract_all(lower(headline), '(unmoved|uncertainty|talks)')), 6) AS score FROM ev WHERE headline IS NOT NULL AND actors[1] IS NOT NULL)
    SELECT actor_id, month, record_id, headline, score FROM l QUALIFY row_number() OVER (PARTITION BY actor_id, month ORDER BY score DESC, record_id) = 1"""


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Records first delivered in the last month of ingestion, that an index of the earlier ones lacks."""
    raw = table(spark, d, "event_records").select("record_id", "ingestion_date")
    last = raw.agg(F.add_months(F.to_date(F.max("ingestion_date")), -1).alias("edge"))
    marked = raw.crossJoin(F.broadcast(last))
    old = marked.filter("ingestion_date < edge").select("record_id").distinct()
    return marked.filter("ingestion_date >= edge").join(old, "record_id", "left_anti").groupBy("record_id").agg(F.min("ingestion_date").alias("first_seen"))


INSERT_IF_ABSENT = """WITH e AS (SELECT CAST(CAST(max(ingestion_date) AS DATE) - INTERVAL 1 MONTH AS DATE) AS edge FROM event_records)
    SELECT record_id, min(ingestion_date) AS first_seen FROM event_records, e WHERE ingestion_date >= edge AND record_id NOT IN (SELECT record_id FROM event_records, e WHERE ingestion_date < edge) GROUP BY 1"""


def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    """Confidence by the number of different hosts, moved by how official the sources are, within 0..1.

    The term for dates that agree is left out, as no dates for each source's extraction are given; quality is that of the
    claimed type, not of the URL.  Scores of records with several hosts therefore differ from the reference's.
    """
    quality = F.aggregate("sources", F.lit(0.0), lambda s, x: s + F.when(x["type"].isin("government", "primary"), 1.0).when(x["type"] == "news", 0.8).otherwise(0.5)) / F.greatest(F.size("sources"), F.lit(1))
    n = F.size(F.array_distinct(F.transform("sources", lambda s: F.regexp_extract(s["url"], "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))))
    base = F.when(n <= 1, 0.4).when(n == 2, 0.6).otherwise(0.8) + (quality - 0.5) * 0.2
    return events(spark, d).filter("sources is not null").select("record_id", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))).alias("score"))


CONFIDENCE_SCORE = f"""WITH {EV}, x AS (SELECT record_id, len(list_distinct(list_transform(sources, lambda s: regexp_extract(s.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)))) AS n,
      coalesce(list_sum(list_transform(sources, lambda s: CASE WHEN s.type IN ('government', 'primary') THEN 1.0::DOUBLE WHEN s.type = 'news' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END)), 0) / greatest(len(sources), 1) AS q FROM ev WHERE sources IS NOT NULL)
    SELECT record_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN n <= 1 THEN 0.4::DOUBLE WHEN n = 2 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END + (q - 0.5) * 0.2)), 6) AS score FROM x"""


QUERIES = {
    "temporal_topk": (temporal_topk, topk_sql("true")),
    "topic_overlap_topk": (topic_overlap_topk, topk_sql("(coalesce(len(rq.topics), 0) = 0 OR list_has_any(rq.topics, ev.topics))")),
    "window_count": (window_count, WINDOW_COUNT),
    "model_cutoff_windows": (model_cutoff_windows, MODEL_CUTOFF_WINDOWS),
    "hits_leakage": (hits_leakage, HITS_LEAKAGE),
    "briefing_lines": (briefing_lines, BRIEFING_LINES),
    "events_per_month": (events_per_month, f"WITH {EV}, {MONTHS} SELECT * FROM mo"),
    "monthly_gaps": (monthly_gaps, MONTHLY_GAPS),
    "recency_bias": (recency_bias, RECENCY_BIAS),
    "topic_months": (topic_months, TOPIC_MONTHS),
    "missing_topics": (missing_topics, MISSING_TOPICS),
    "quarantine_rate": (quarantine_rate, QUARANTINE_RATE),
    "validate_dates": (validate_dates, VALIDATE_DATES),
    "isolated_dates": (isolated_dates, ISOLATED_DATES),
    "source_gaps": (source_gaps, SOURCE_GAPS),
    "source_hosts": (source_hosts, SOURCE_HOSTS),
    "topic_normalize": (topic_normalize, TOPIC_NORMALIZE),
    "best_headline": (best_headline, BEST_HEADLINE),
    "insert_if_absent": (insert_if_absent, INSERT_IF_ABSENT),
    "confidence_score": (confidence_score, CONFIDENCE_SCORE),
}
