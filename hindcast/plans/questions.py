"""Question pipeline and entity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import iso_date, r6, words
from hindcast.operators.overlap import overlap_pairs
from hindcast.operators.retrieval import one_of_each
from hindcast.runtime import table

Q = "qq AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY question_id) = 1)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").dropDuplicates(["question_id"])


DAYS = "date_diff('day', try_cast(CASE WHEN regexp_full_match(simulation_date, '\\d{4}-\\d{2}-\\d{2}') THEN simulation_date END AS DATE), try_cast(CASE WHEN regexp_full_match(resolution_date, '\\d{4}-\\d{2}-\\d{2}') THEN resolution_date END AS DATE))"


def time_horizon(spark: SparkSession, d: str) -> DataFrame:
    """short up to 30 days, medium up to 180 or where a date is missing or none, else long."""
    days = F.datediff(iso_date("resolution_date"), iso_date("simulation_date"))
    return questions(spark, d).select("question_id", F.when(days.isNull(), "medium").when(days <= 30, "short").when(days <= 180, "medium").otherwise("long").alias("horizon"))


def difficulty_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty from the distance of the base rate to one half, the number of options and the background's length."""
    far = F.abs(F.coalesce("base_rate_estimate", F.lit(0.5)) - 0.5)
    long = F.length(F.coalesce("background", F.lit("")))
    binary = F.when(far >= 0.35, "easy").when(far >= 0.15, "medium").otherwise("hard")
    action = F.when((F.size("options") <= 3) & (long < 400), "easy").when((F.size("options") <= 4) & (long < 800), "medium").otherwise("hard")
    return questions(spark, d).select("question_id", F.when(F.col("question_type") == "binary", binary).otherwise(action).alias("difficulty"))


DIFFICULTY = f"""WITH {Q} SELECT question_id, CASE WHEN question_type = 'binary' THEN CASE WHEN abs(coalesce(base_rate_estimate, 0.5) - 0.5) >= 0.35 THEN 'easy' WHEN abs(coalesce(base_rate_estimate, 0.5) - 0.5) >= 0.15 THEN 'medium' ELSE 'hard' END
    ELSE CASE WHEN len(options) <= 3 AND length(coalesce(background, '')) < 400 THEN 'easy' WHEN len(options) <= 4 AND length(coalesce(background, '')) < 800 THEN 'medium' ELSE 'hard' END END AS difficulty FROM qq"""


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """First reason for which a question is dropped, with the number of questions; kept ones have none."""
    flagged = F.exists("flags", lambda f: F.lower(f).startswith("already_resolved"))
    reason = (
        F.when(F.coalesce(flagged, F.lit(False)), "already_resolved")
        .when(F.coalesce(F.trim("question_text"), F.lit("")) == "", "blank")
        .when(F.coalesce(F.trim("resolution_date"), F.lit("")) == "", "no_date")
        .when((F.coalesce(F.trim("resolution_criteria"), F.lit("")) == "") & (F.coalesce(F.trim("resolution_source"), F.lit("")) == ""), "no_criteria")
        .otherwise("kept")
    )
    return questions(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUALITY = f"""WITH {Q} SELECT CASE WHEN len(list_filter(flags, lambda f: starts_with(lower(f), 'already_resolved'))) > 0 THEN 'already_resolved' WHEN coalesce(trim(question_text), '') = '' THEN 'blank'
    WHEN coalesce(trim(resolution_date), '') = '' THEN 'no_date' WHEN coalesce(trim(resolution_criteria), '') = '' AND coalesce(trim(resolution_source), '') = '' THEN 'no_criteria' ELSE 'kept' END AS reason, count(*) AS n FROM qq GROUP BY 1"""


def distribution_balance(spark: SparkSession, d: str) -> DataFrame:
    """Shares by domain, type and difficulty, and whether one is off an equal share by more than a tenth."""
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.coalesce(k, F.lit("unknown")).alias("value")) for k in ("domain", "question_type", "difficulty")))).alias("s")
    n = questions(spark, d).select(cut).groupBy("s.slice", "s.value").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("slice").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    share = F.col("n") / F.col("total")
    return n.join(total, "slice").select("slice", "value", "n", r6(share).alias("share"), (F.abs(share - 1 / F.col("k")) > 0.10).alias("off"))


BALANCE = f"""WITH {Q}, x AS (SELECT 'domain' AS slice, coalesce(domain, 'unknown') AS value FROM qq UNION ALL SELECT 'question_type', coalesce(question_type, 'unknown') FROM qq UNION ALL SELECT 'difficulty', coalesce(difficulty, 'unknown') FROM qq),
    n AS (SELECT slice, value, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT slice, value, n, round(n / sum(n) OVER w, 6) AS share, abs(n / sum(n) OVER w - 1 / count(*) OVER w) > 0.10 AS off FROM n WINDOW w AS (PARTITION BY slice)"""


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts, revisions and resolutions of each domain; unknown states count as ambiguous."""
    state = F.when(F.col("resolution_status").isin("resolved_yes", "resolved_no", "resolved_option", "pending", "annulled"), F.col("resolution_status")).otherwise("ambiguous")
    return questions(spark, d).groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(
        F.count_if(F.col("verification_verdict") == "rejected").alias("n_rejected"), F.count_if(F.col("revision_count") > 0).alias("n_revised"), F.count_if(state == "ambiguous").alias("n_ambiguous"), F.count_if(state.startswith("resolved")).alias("n_resolved")
    )


VERDICTS = f"""WITH {Q} SELECT coalesce(domain, 'unknown') AS domain, count(*) FILTER (verification_verdict = 'rejected') AS n_rejected, count(*) FILTER (revision_count > 0) AS n_revised,
    count(*) FILTER (resolution_status IS NULL OR resolution_status NOT IN ('resolved_yes', 'resolved_no', 'resolved_option', 'pending', 'annulled')) AS n_ambiguous,
    count(*) FILTER (resolution_status IN ('resolved_yes', 'resolved_no', 'resolved_option')) AS n_resolved FROM qq GROUP BY 1"""


def option_block(spark: SparkSession, d: str) -> DataFrame:
    """Options as lettered lines, with "Take no action" added where none says so."""
    none = F.lit("Take no action")
    options = F.when(F.exists("options", lambda o: F.lower(o).contains("no action")), F.col("options")).otherwise(F.concat("options", F.array(none)))
    lines = F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), o))
    return questions(spark, d).filter("size(options) > 0").select("question_id", F.array_join(lines, "\n").alias("block"))


OPTIONS = f"""WITH {Q}, o AS (SELECT question_id, CASE WHEN len(list_filter(options, lambda o: contains(lower(o), 'no action'))) > 0 THEN options ELSE list_append(options, 'Take no action') END AS o FROM qq WHERE len(options) > 0)
    SELECT question_id, array_to_string(list_transform(o, lambda x, i: chr(64 + CAST(i AS INT)) || '. ' || x), chr(10)) AS block FROM o"""


def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Short hash of title and question, and how many questions share it."""
    h = F.substring(F.sha2(F.concat_ws("\n\n", "title", "question_text"), 256), 1, 16)
    return questions(spark, d).groupBy(h.alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def seed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content-based seed id of each question."""
    h = F.substring(F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit(":"), F.coalesce("simulation_date", F.lit(""))), 256), 1, 8)
    return questions(spark, d).select("question_id", F.concat(F.lit("SEED-"), F.upper(F.coalesce("domain", F.lit("unknown"))), F.lit("-"), h).alias("seed"))


def judged_pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Questions that no judged pair of score 3 or more drops: b goes where a is to be kept, else a."""
    pairs = table(spark, d, "similarity_scores").filter("score >= 3 and question_a_id <> question_b_id")
    gone = pairs.select(F.when(F.col("keep") == F.col("question_a_id"), F.col("question_b_id")).otherwise(F.col("question_a_id")).alias("question_id")).distinct()
    return questions(spark, d).join(gone, "question_id", "left_anti").select("question_id", "domain")


def judged_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often pairs that were judged more than once got one score, by the number of judgements."""
    s = table(spark, d, "similarity_scores").filter("score is not null and question_a_id <> question_b_id")
    pair = s.groupBy(F.least("question_a_id", "question_b_id").alias("a"), F.greatest("question_a_id", "question_b_id").alias("b")).agg(F.count(F.lit(1)).alias("n_judged"), F.count_distinct("score").alias("k"))
    return pair.filter("n_judged > 1").groupBy("n_judged").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("k") == 1).alias("n_agreed"))


def search_date_filter(spark: SparkSession, d: str, keep: int = 5) -> DataFrame:
    """The first hits of each request that are dated, not later than the simulation, at most ``keep``."""
    hits = table(spark, d, "retrieval_hits").select("request_id", "record_id", "hit_rank").distinct()
    dated = one_of_each(table(spark, d, "event_records")).select("record_id", "event_date")
    sim = table(spark, d, "retrieval_requests").select("request_id", "simulation_date").distinct()
    ok = hits.join(dated, "record_id").join(sim, "request_id").filter("event_date <= simulation_date")
    w = Window.partitionBy("request_id").orderBy("hit_rank", "record_id")
    return ok.withColumn("kept", F.row_number().over(w)).filter(F.col("kept") <= keep).select("request_id", "record_id", "kept")


SEARCH = """WITH h AS (SELECT DISTINCT request_id, record_id, hit_rank FROM retrieval_hits), e AS (SELECT DISTINCT record_id, event_date FROM event_records), r AS (SELECT DISTINCT request_id, simulation_date FROM retrieval_requests),
    k AS (SELECT request_id, record_id, row_number() OVER (PARTITION BY request_id ORDER BY hit_rank, record_id) AS kept FROM h JOIN e USING (record_id) JOIN r USING (request_id) WHERE event_date <= simulation_date) SELECT * FROM k WHERE kept <= 5"""


def paraphrase_merge(spark: SparkSession, d: str, cap: int = 50) -> DataFrame:
    """Hits of requests with the same simulation date and model merged: of n requests each gives its first ``cap // n`` hits (one
    at least), the first occurrence of a record wins, at most ``cap`` are kept."""
    group = ["simulation_date", "model_id"]
    asked = table(spark, d, "retrieval_requests").select("request_id", *group).distinct()
    shares = asked.groupBy(*group).agg(F.greatest(F.lit(1), F.floor(F.lit(cap) / F.count(F.lit(1)))).alias("share"))
    hits = table(spark, d, "retrieval_hits").groupBy("request_id", "record_id").agg(F.min("hit_rank").alias("hit_rank"))
    own = Window.partitionBy("request_id").orderBy("hit_rank", "record_id")
    ranked = hits.withColumn("own", F.row_number().over(own)).filter(F.col("own") <= cap).join(asked, "request_id").join(shares, group).filter("own <= share")
    first = ranked.groupBy(*group, "record_id").agg(F.min(F.struct("request_id", "hit_rank")).alias("at"))
    w = Window.partitionBy(*group).orderBy("at.request_id", "at.hit_rank", "record_id")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select(*group, "record_id", "place")


PARAPHRASE = """WITH a AS (SELECT DISTINCT request_id, simulation_date, model_id FROM retrieval_requests), n AS (SELECT simulation_date, model_id, greatest(1, 50 // count(*)) AS share FROM a GROUP BY 1, 2),
    h AS (SELECT request_id, record_id, min(hit_rank) AS hit_rank FROM retrieval_hits GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hit_rank, record_id) AS own FROM h),
    f AS (SELECT simulation_date, model_id, record_id, request_id, hit_rank FROM o JOIN a USING (request_id) JOIN n USING (simulation_date, model_id) WHERE own <= share
          QUALIFY row_number() OVER (PARTITION BY simulation_date, model_id, record_id ORDER BY request_id, hit_rank) = 1),
    p AS (SELECT simulation_date, model_id, record_id, row_number() OVER (PARTITION BY simulation_date, model_id ORDER BY request_id, hit_rank, record_id) AS place FROM f) SELECT * FROM p WHERE place <= 50"""


def label_rerank(spark: SparkSession, d: str, keep: int = 12) -> DataFrame:
    """Hits in order of a label's priority, then of rank; the label follows the distance, far ones are irrelevant."""
    label = F.when(F.col("distance") <= 0.2, 0).when(F.col("distance") <= 0.4, 1).when(F.col("distance").isNull() | (F.col("distance") <= 0.6), 2)
    hits = table(spark, d, "retrieval_hits").select("request_id", "record_id", "hit_rank", label.alias("priority")).distinct().filter("priority is not null")
    w = Window.partitionBy("request_id").orderBy("priority", "hit_rank", "record_id")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).select("request_id", "record_id", "priority", "place")


RERANK = """WITH h AS (SELECT DISTINCT request_id, record_id, hit_rank, CASE WHEN distance <= 0.2 THEN 0 WHEN distance <= 0.4 THEN 1 WHEN distance IS NULL OR distance <= 0.6 THEN 2 END AS priority FROM retrieval_hits),
    p AS (SELECT request_id, record_id, priority, row_number() OVER (PARTITION BY request_id ORDER BY priority, hit_rank, record_id) AS place FROM h WHERE priority IS NOT NULL) SELECT * FROM p WHERE place <= 12"""


def title_edges(spark: SparkSession, d: str, least: float = 0.6) -> DataFrame:
    """Pairs of different titles that share at least ``least`` of the words of the longer one."""
    titles = questions(spark, d).filter("length(trim(title)) > 0").select(F.array_sort(F.array_distinct(words("title"))).alias("words")).distinct()
    items = titles.select(F.array_join("words", " ").alias("key"), "words", F.lit(0).alias("here"), F.array(F.lit(0)).alias("near"))
    return overlap_pairs(items, least).select(F.col("a").alias("words_a"), F.col("b").alias("words_b"), r6("share").alias("share"))


TITLE_EDGES = f"""WITH {Q}, t AS (SELECT DISTINCT list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+'), lambda w: w <> ''))) AS w FROM qq WHERE length(trim(title)) > 0),
    u AS (SELECT w, array_to_string(w, ' ') AS s, len(w) AS n FROM t), p AS (SELECT x.s AS words_a, z.s AS words_b, len(list_intersect(x.w, z.w)) / greatest(x.n, z.n) AS share FROM u x JOIN u z ON x.s < z.s AND least(x.n, z.n) >= 0.59 * greatest(x.n, z.n))
    SELECT words_a, words_b, round(share, 6) AS share FROM p WHERE share >= 0.6 - 1e-9"""


def date_vote(spark: SparkSession, d: str) -> DataFrame:
    """Of each lead actor's month the day named by most records, ties to the first record."""
    e = one_of_each(table(spark, d, "event_records")).filter("event_date_precision = 'day'").select(F.get("actors", F.lit(0)).alias("actor_id"), F.date_format("event_date", "yyyy-MM").alias("month"), "event_date", "record_id").filter("actor_id is not null")
    votes = e.groupBy("actor_id", "month", "event_date").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    best = votes.groupBy("actor_id", "month").agg(F.min(F.struct((-F.col("n")).alias("neg"), "first", "event_date")).alias("b"))
    return best.select("actor_id", "month", "b.event_date", (-F.col("b.neg")).alias("n"))


VOTE = """WITH ev AS (SELECT * FROM event_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingestion_date) = 1), e AS (SELECT actors[1] AS actor_id, strftime(event_date, '%Y-%m') AS month, event_date, count(*) AS n, min(record_id) AS f FROM ev WHERE event_date_precision = 'day' AND actors[1] IS NOT NULL GROUP BY 1, 2, 3)
    SELECT actor_id, month, event_date, n FROM e QUALIFY row_number() OVER (PARTITION BY actor_id, month ORDER BY n DESC, f) = 1"""


def actor_months(spark: SparkSession, d: str) -> DataFrame:
    """Records of each lead actor by month, with the role of the actor."""
    e = one_of_each(table(spark, d, "event_records")).select(F.get("actors", F.lit(0)).alias("actor_id"), F.date_format("event_date", "yyyy-MM").alias("month"))
    n = e.filter("actor_id is not null").groupBy("actor_id", "month").agg(F.count(F.lit(1)).alias("n"))
    return n.join(table(spark, d, "actors").select("actor_id", "kind", "role"), "actor_id").select("actor_id", "kind", "role", "month", "n")


ACTOR_MONTHS = """WITH ev AS (SELECT * FROM event_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingestion_date) = 1), n AS (SELECT actors[1] AS actor_id, strftime(event_date, '%Y-%m') AS month, count(*) AS n FROM ev WHERE actors[1] IS NOT NULL GROUP BY 1, 2)
    SELECT actor_id, kind, role, month, n FROM n JOIN actors USING (actor_id)"""


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and cut form of each summary: whole up to 500 signs, else cut with a mark."""
    s = F.col("summary")
    return one_of_each(table(spark, d, "event_records")).filter("summary is not null").select("record_id", F.size(words("summary")).alias("n_words"), F.when(F.length(s) <= 500, s).otherwise(F.concat(F.substring(s, 1, 500), F.lit("…"))).alias("snippet"))


COUNTS = """WITH ev AS (SELECT * FROM event_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingestion_date) = 1)
    SELECT record_id, len(list_filter(regexp_split_to_array(lower(summary), '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+'), lambda w: w <> '')) AS n_words, CASE WHEN length(summary) <= 500 THEN summary ELSE substr(summary, 1, 500) || '…' END AS snippet FROM ev WHERE summary IS NOT NULL"""


QUERIES = {
    "time_horizon": (time_horizon, f"WITH {Q} SELECT question_id, CASE WHEN {DAYS} IS NULL THEN 'medium' WHEN {DAYS} <= 30 THEN 'short' WHEN {DAYS} <= 180 THEN 'medium' ELSE 'long' END AS horizon FROM qq"),
    "difficulty_heuristic": (difficulty_heuristic, DIFFICULTY),
    "quality_gate": (quality_gate, QUALITY),
    "distribution_balance": (distribution_balance, BALANCE),
    "verdict_counts": (verdict_counts, VERDICTS),
    "option_block": (option_block, OPTIONS),
    "prompt_hashes": (prompt_hashes, f"WITH {Q} SELECT substr(sha256(concat_ws(chr(10) || chr(10), title, question_text)), 1, 16) AS hash, count(*) AS n FROM qq GROUP BY 1"),
    "seed_ids": (seed_ids, f"WITH {Q} SELECT question_id, 'SEED-' || upper(coalesce(domain, 'unknown')) || '-' || substr(sha256(coalesce(title, '') || ':' || coalesce(simulation_date, '')), 1, 8) AS seed FROM qq"),
    "judged_pair_dedup": (judged_pair_dedup, f"""WITH {Q}, g AS (SELECT CASE WHEN keep = question_a_id THEN question_b_id ELSE question_a_id END AS question_id FROM similarity_scores WHERE score >= 3 AND question_a_id <> question_b_id)
        SELECT question_id, domain FROM qq ANTI JOIN g USING (question_id)"""),
    "judged_agreement": (judged_agreement, """WITH p AS (SELECT least(question_a_id, question_b_id) AS a, greatest(question_a_id, question_b_id) AS b, count(*) AS n_judged, count(DISTINCT score) AS k FROM similarity_scores WHERE score IS NOT NULL AND question_a_id <> question_b_id GROUP BY 1, 2)
        SELECT n_judged, count(*) AS n_pairs, count(*) FILTER (k = 1) AS n_agreed FROM p WHERE n_judged > 1 GROUP BY 1"""),
    "search_date_filter": (search_date_filter, SEARCH),
    "paraphrase_merge": (paraphrase_merge, PARAPHRASE),
    "label_rerank": (label_rerank, RERANK),
    "title_edges": (title_edges, TITLE_EDGES),
    "date_vote": (date_vote, VOTE),
    "actor_months": (actor_months, ACTOR_MONTHS),
    "word_counts": (word_counts, COUNTS),
}
