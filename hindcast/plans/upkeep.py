"""Seeds, sources, stages and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import any_date, host, iso_date, r6, words
from hindcast.operators.leaders import leader_clusters
from hindcast.operators.overlap import overlap_pairs
from hindcast.operators.retrieval import one_of_each
from hindcast.plans.ordered import WORDS, fold_sql
from hindcast.runtime import Scratch, table

Q = "qq AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY question_id) = 1)"
EV = "ev AS (SELECT * FROM event_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingestion_date) = 1)"


def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each host by the kinds that its sources claim: the mean of fixed weights, and a tier."""
    s = one_of_each(table(spark, d, "event_records")).select(F.explode("sources").alias("s")).select(host("s.url").alias("host"), F.lower(F.trim("s.type")).alias("type"))
    weight = F.when(F.col("type").isin("government", "primary"), 1.0).when(F.col("type") == "news", 0.8).when(F.col("type") == "social_media", 0.2).otherwise(0.5)
    q = s.groupBy("host").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(weight)).alias("quality"))
    return q.withColumn("tier", F.when(F.col("quality") >= 0.8, 1).when(F.col("quality") >= 0.6, 2).otherwise(3))


SOURCE_QUALITY = f"""WITH {EV}, u AS (SELECT unnest(sources) AS s FROM ev), h AS (SELECT ltrim(lower(regexp_extract(s.url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'w.') AS host, lower(trim(s.type)) AS type FROM u),
    q AS (SELECT host, count(*) AS n, round(avg(CASE WHEN type IN ('government', 'primary') THEN 1.0::DOUBLE WHEN type = 'news' THEN 0.8 WHEN type = 'social_media' THEN 0.2 ELSE 0.5 END), 6) AS quality FROM h GROUP BY 1)
    SELECT *, CASE WHEN quality >= 0.8 THEN 1 WHEN quality >= 0.6 THEN 2 ELSE 3 END AS tier FROM q"""


def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each lead actor's day, once a URL: the first record's name for it, and how many records name it."""
    e = one_of_each(table(spark, d, "event_records")).select(F.get("actors", F.lit(0)).alias("actor_id"), "event_date", "record_id", F.explode("sources").alias("s"))
    named = e.filter("actor_id is not null and s.url is not null")
    return named.groupBy("actor_id", "event_date", F.col("s.url").alias("url")).agg(F.min(F.struct("record_id", F.col("s.name").alias("name"))).alias("first"), F.count_distinct("record_id").alias("n")).select("actor_id", "event_date", "url", "first.name", "n")


MERGED_SOURCES = f"""WITH {EV}, u AS (SELECT actors[1] AS actor_id, event_date, record_id, unnest(sources) AS s FROM ev), g AS (SELECT actor_id, event_date, s.url AS url, count(DISTINCT record_id) AS n, min({{'r': record_id, 'n': s.name}}).n AS name
    FROM u WHERE actor_id IS NOT NULL AND s.url IS NOT NULL GROUP BY 1, 2, 3) SELECT actor_id, event_date, url, name, n FROM g"""


def stage_reached(spark: SparkSession, d: str) -> DataFrame:
    """The last stage that each question has passed, and how many questions stand there by domain."""
    stage = (
        F.when(F.col("correct_answer").isNotNull(), "resolved").when(F.col("difficulty").isNotNull() & F.col("time_horizon").isNotNull(), "rated").when(F.col("verification_verdict").isNotNull(), "verified").when(F.col("resolution_criteria").isNotNull(), "refined").otherwise("drafted")
    )
    return table(spark, d, "questions").dropDuplicates(["question_id"]).groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain"), stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


STAGES = f"""WITH {Q} SELECT coalesce(domain, 'unknown') AS domain, CASE WHEN correct_answer IS NOT NULL THEN 'resolved' WHEN difficulty IS NOT NULL AND time_horizon IS NOT NULL THEN 'rated' WHEN verification_verdict IS NOT NULL THEN 'verified'
    WHEN resolution_criteria IS NOT NULL THEN 'refined' ELSE 'drafted' END AS stage, count(*) AS n FROM qq GROUP BY 1, 2"""


def retention(spark: SparkSession, d: str, keep: int = 3) -> DataFrame:
    """Predictions beyond the ``keep`` newest of their question and experiment, which a clean-up may remove.

    Ages are counted by day first and then within a day, so that a hot question isn't ordered by one task.
    """
    once = table(spark, d, "predictions").select("question_id", "experiment", "sample_idx", "prediction_id", "created_at").distinct()
    group, day = ["question_id", "experiment"], F.coalesce(F.datediff("created_at", F.lit("1970-01-01")), F.lit(-(2**31) + 1))
    dated = once.na.fill("", group).withColumn("day", day)
    later = Window.partitionBy(*group).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    counts = dated.groupBy(*group, "day").agg(F.count(F.lit(1)).alias("m")).select(*group, "day", F.coalesce(F.sum("m").over(later), F.lit(0)).alias("later"))
    w = Window.partitionBy(*group, "day").orderBy(F.col("created_at").desc_nulls_last(), F.desc("prediction_id"))
    aged = dated.withColumn("place", F.row_number().over(w)).join(counts, [*group, "day"])
    return aged.withColumn("age", F.col("later") + F.col("place")).filter(F.col("age") > keep).select("prediction_id", "age")


RETENTION = """WITH p AS (SELECT DISTINCT question_id, experiment, sample_idx, prediction_id, created_at FROM predictions)
    SELECT prediction_id, row_number() OVER (PARTITION BY question_id, experiment ORDER BY created_at DESC NULLS LAST, prediction_id DESC) AS age FROM p QUALIFY age > 3"""


def briefing_cache(spark: SparkSession, d: str) -> DataFrame:
    """Briefings by hash: in how many experiments and for how many questions one was used, and how often none was at hand."""
    once = table(spark, d, "predictions").select("prediction_id", "briefing_hash", "experiment", "question_id").distinct()
    return once.groupBy("briefing_hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("experiment").alias("n_experiments"), F.count_distinct("question_id").alias("n_questions"))


BRIEFINGS = "WITH p AS (SELECT DISTINCT prediction_id, briefing_hash, experiment, question_id FROM predictions) SELECT briefing_hash, count(*) AS n, count(DISTINCT experiment) AS n_experiments, count(DISTINCT question_id) AS n_questions FROM p GROUP BY 1"


def latency_profile(spark: SparkSession, d: str) -> DataFrame:
    """Latency and tokens by model, each call once, errors apart; medians from counts of each latency, not from all calls."""
    once = table(spark, d, "predictions").select("prediction_id", "model_id", "latency_ms", "tokens_out", F.col("error").isNotNull().alias("failed")).distinct()
    counted = once.filter("latency_ms is not null").groupBy("model_id", "failed", "latency_ms").agg(F.count(F.lit(1)).alias("t"))
    median = counted.groupBy("model_id", "failed").agg(r6(F.percentile("latency_ms", F.lit(0.5), F.col("t"))).alias("median_ms"))
    rest = once.groupBy("model_id", "failed").agg(F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("max_ms"), r6(F.avg("tokens_out")).alias("mean_out"))
    same = rest["model_id"].eqNullSafe(median["model_id"]) & (rest["failed"] == median["failed"])
    return rest.join(median, same, "left").select(rest["model_id"], rest["failed"], "n", "median_ms", "max_ms", "mean_out")


LATENCY = """WITH p AS (SELECT DISTINCT prediction_id, model_id, latency_ms, tokens_out, error IS NOT NULL AS failed FROM predictions)
    SELECT model_id, failed, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS median_ms, max(latency_ms) AS max_ms, round(avg(tokens_out), 6) AS mean_out FROM p GROUP BY 1, 2"""


def seed_merge(spark: SparkSession, d: str, days: int = 3, alike: float = 0.5) -> DataFrame:
    """``question_id, seed_id``: questions of a domain folded into the first one like it that is itself a seed.

    In order of date and id; two are alike if their dates are at most ``days`` apart and their titles share at least ``alike``
    of the words of the longer one.  Partners are looked for in the blocks of days beside a question's own; questions without
    a proper date or a title are seeds of their own.
    """
    day = iso_date("simulation_date")
    q = table(spark, d, "questions").dropDuplicates(["question_id"]).select("question_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.array_distinct(words("title")).alias("words"), day.alias("day"))
    node = F.concat_ws(" ", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("9999-99-99")), "question_id")
    block = F.floor(F.datediff("day", F.lit("1970-01-01")) / (days + 1))
    near = F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: F.concat_ws(" ", "domain", (block + i).cast("string")))
    items = q.select(node.alias("key"), "words", F.concat_ws(" ", "domain", block.cast("string")).alias("here"), near.alias("near"), "day").dropna()
    date_of = lambda c: F.to_date(F.substring(c, 1, 10))
    edges = overlap_pairs(items.drop("day"), alike).filter(F.abs(F.datediff(date_of("a"), date_of("b"))) <= days).select("a", "b")
    led = leader_clusters(q.select(node.alias("key")), edges, "key", "a", "b")
    return led.select(F.substring("key", 12, 1000).alias("question_id"), F.substring("leader", 12, 1000).alias("seed_id"))


SEEDS = f"""{Q}, s AS (SELECT question_id, coalesce(domain, 'unknown') AS domain, {WORDS('title')} AS w, CAST(try_strptime(simulation_date, '%Y-%m-%d') AS DATE) AS d FROM qq),
    nodes AS (SELECT coalesce(strftime(d, '%Y-%m-%d'), '9999-99-99') || ' ' || question_id AS id, * FROM s),
    edges AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id < y.id AND x.domain = y.domain AND abs(x.d - y.d) <= 3 AND len(x.w) > 0 AND len(list_intersect(x.w, y.w)) >= 0.5 * greatest(len(x.w), len(y.w)) - 1e-6)"""
SEED_SQL = fold_sql(SEEDS, "question_id", "seed_id", cut=12)


def merged_seeds(questions: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seeds`` (question_id, seed_id) with the texts of ``questions`` merged: of title and background the longest, the first of
    equally long ones by id; options once each whatever their case, as the first question has them, in that order; whether any
    question bears a flag."""
    q = questions.dropDuplicates(["question_id"]).select("question_id", "title", "background", "options", "flags").join(seeds.select("question_id", "seed_id"), "question_id")
    longest = lambda c: F.min_by(c, F.struct(-F.coalesce(F.length(c), F.lit(-1)), "question_id")).alias(c)
    texts = q.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), longest("title"), longest("background"), F.bool_or(F.coalesce(F.size("flags") > 0, F.lit(False))).alias("flagged"))
    told = q.select("seed_id", "question_id", F.posexplode("options").alias("pos", "option")).filter("option is not null")
    once = told.groupBy("seed_id", F.lower("option").alias("as")).agg(F.min(F.struct("question_id", "pos", "option")).alias("o"))
    options = once.groupBy("seed_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["option"]), "|").alias("options"))
    return texts.join(options, "seed_id", "left").na.fill("", ["options"])


def seed_texts(spark: SparkSession, d: str) -> DataFrame:
    """The seeds of ``seed_merge`` with their merged texts."""
    return merged_seeds(table(spark, d, "questions"), Scratch(spark).keep(seed_merge(spark, d)))


SEED_TEXTS = f"""WITH g AS ({SEED_SQL}), x AS (SELECT g.seed_id, q.* EXCLUDE (seed_id) FROM (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY question_id) = 1) q JOIN g USING (question_id)),
    t AS (SELECT seed_id, count(*) AS n, min({{'n': -coalesce(length(title), -1), 'q': question_id, 't': title}}).t AS title, min({{'n': -coalesce(length(background), -1), 'q': question_id, 't': background}}).t AS background,
      bool_or(coalesce(len(flags) > 0, false)) AS flagged FROM x GROUP BY 1),
    o AS (SELECT seed_id, min({{'q': question_id, 'p': pos, 'o': o}}) AS told FROM (SELECT seed_id, question_id, unnest(options) AS o, generate_subscripts(options, 1) AS pos FROM x) WHERE o IS NOT NULL GROUP BY 1, lower(o)),
    l AS (SELECT seed_id, string_agg(told.o, '|' ORDER BY told) AS options FROM o GROUP BY 1)
    SELECT seed_id, n, title, background, flagged, coalesce(options, '') AS options FROM t LEFT JOIN l USING (seed_id)"""


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Simulation dates in whatever form they were typed, and how they lie to the resolution date."""
    q = table(spark, d, "questions").dropDuplicates(["question_id"])
    return q.select("question_id", any_date("simulation_date").alias("day"), F.datediff(any_date("resolution_date"), any_date("simulation_date")).alias("days_open"))


DATE_OF = lambda c: f"CAST(try_strptime(trim({c}), ['%Y-%m-%d', '%d %B %Y', '%d/%m/%Y', '%Y/%m/%d']) AS DATE)"
PARSED = f"WITH {Q} SELECT question_id, {DATE_OF('simulation_date')} AS day, date_diff('day', {DATE_OF('simulation_date')}, {DATE_OF('resolution_date')}) AS days_open FROM qq"


QUERIES = {
    "parsed_dates": (parsed_dates, PARSED),
    "source_quality": (source_quality, SOURCE_QUALITY),
    "merged_sources": (merged_sources, MERGED_SOURCES),
    "stage_reached": (stage_reached, STAGES),
    "retention": (retention, RETENTION),
    "briefing_cache": (briefing_cache, BRIEFINGS),
    "latency_profile": (latency_profile, LATENCY),
    "seed_merge": (seed_merge, SEED_SQL),
    "seed_texts": (seed_texts, SEED_TEXTS),
}
