"""Evidence for questions: reuse of briefings, context of a search, prompts, merged and newly delivered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import netloc, normal_topics, words
from hindcast.operators.leaders import key_leaders
from hindcast.operators.overlap import overlap_pairs
from hindcast.operators.retrieval import one_of_each
from hindcast.plans.ordered import EVENTS_SQL, event_clusters
from hindcast.plans.retrieval import EV, NORMAL, events
from hindcast.plans.questions import Q, questions
from hindcast.runtime import Scratch, table
from hindcast.sources.files import append_keyed, read_or_none, write_keyed


def briefing_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Answers by where their briefing comes from: their own, one of the question that another answer had, or none.

    The cache has one briefing a question, of the first experiment with one; it is written as a table of its own and read again.
    """
    p = table(spark, d, "predictions").select("prediction_id", "experiment", "question_id", "briefing_hash").distinct()
    path = Scratch(spark).base + "/briefings"
    append_keyed(p.filter("briefing_hash is not null").groupBy("question_id").agg(F.min_by("briefing_hash", F.struct("experiment", "prediction_id")).alias("cached")), path, ["question_id"])
    looked = p.join(read_or_none(spark, path, "question_id string, cached string"), "question_id", "left")
    how = F.when(F.col("briefing_hash").isNotNull(), "own").when(F.col("cached").isNotNull(), "cached").otherwise("none")
    used = looked.select("experiment", how.alias("how"), F.coalesce("briefing_hash", "cached").alias("hash"))
    return used.groupBy("experiment", "how").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("n_briefings"))


REUSE = """WITH p AS (SELECT DISTINCT prediction_id, experiment, question_id, briefing_hash FROM predictions),
    c AS (SELECT question_id, briefing_hash AS cached FROM p WHERE briefing_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY experiment, prediction_id, briefing_hash) = 1)
    SELECT experiment, CASE WHEN briefing_hash IS NOT NULL THEN 'own' WHEN cached IS NOT NULL THEN 'cached' ELSE 'none' END AS how, count(*) AS n, count(DISTINCT coalesce(briefing_hash, cached)) AS n_briefings
    FROM p LEFT JOIN c USING (question_id) GROUP BY 1, 2"""


def search_context(spark: SparkSession, d: str, keep: int = 5, bounded: bool = True) -> DataFrame:
    """What a search may show for each request: its first ``keep`` hits that are dated and not later than the simulation.

    Hits without a date and later ones are dropped and counted, up to the hit that fills the context; what comes after isn't
    looked at.  Not ``bounded``: the first ``keep`` hits, whatever their dates.  A request without a hit has no row.
    """
    hits = table(spark, d, "retrieval_hits").groupBy("request_id", "record_id").agg(F.min("hit_rank").alias("hit_rank"))
    sim = table(spark, d, "retrieval_requests").select("request_id", "simulation_date").distinct()
    dated = hits.join(sim, "request_id").join(events(spark, d).select("record_id", "event_date", "headline"), "record_id", "left")
    state = F.when(F.lit(not bounded), "kept").when(F.col("event_date").isNull(), "undated").when(F.col("event_date") > F.col("simulation_date"), "later").otherwise("kept")
    before = Window.partitionBy("request_id").orderBy("hit_rank", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = dated.withColumn("state", state).withColumn("place", F.coalesce(F.count_if(F.col("state") == "kept").over(before), F.lit(0))).filter(F.col("place") < keep)
    line = F.concat("record_id", F.lit(" ("), F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit("undated")), F.lit("): "), F.trim(F.coalesce("headline", F.lit(""))))
    lines = F.array_sort(F.collect_list(F.when(F.col("state") == "kept", F.struct("place", line.alias("line")))))
    return seen.groupBy("request_id").agg(
        F.count_if(F.col("state") == "kept").alias("n_kept"), F.count_if(F.col("state") == "undated").alias("n_undated"), F.count_if(F.col("state") == "later").alias("n_later"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"),
    )


CONTEXT = f"""WITH {EV}, h AS (SELECT request_id, record_id, min(hit_rank) AS hit_rank FROM retrieval_hits GROUP BY 1, 2), r AS (SELECT DISTINCT request_id, simulation_date FROM retrieval_requests),
    s AS (SELECT h.*, event_date, headline, CASE WHEN event_date IS NULL THEN 'undated' WHEN event_date > simulation_date THEN 'later' ELSE 'kept' END AS state FROM h JOIN r USING (request_id) LEFT JOIN ev USING (record_id)),
    p AS (SELECT *, coalesce(count(*) FILTER (state = 'kept') OVER (PARTITION BY request_id ORDER BY hit_rank, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s)
    SELECT request_id, count(*) FILTER (state = 'kept') AS n_kept, count(*) FILTER (state = 'undated') AS n_undated, count(*) FILTER (state = 'later') AS n_later,
      coalesce(string_agg(record_id || ' (' || strftime(event_date, '%Y-%m-%d') || '): ' || trim(coalesce(headline, '')), chr(10) ORDER BY place) FILTER (state = 'kept'), '') AS context FROM p WHERE place < 5 GROUP BY 1"""

LABELS = ("direct", "close", "background", "irrelevant")


def label_groups(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each request by label, in the fixed order of ``LABELS``: how many, and the first record by rank.

    The tables hold no label; it follows the distance here, as in ``label_rerank``.
    """
    distance = F.col("distance")
    order = F.when(distance <= 0.2, 0).when(distance <= 0.4, 1).when(distance.isNull() | (distance <= 0.6), 2).otherwise(3)
    hits = table(spark, d, "retrieval_hits").select("request_id", "record_id", "hit_rank", order.alias("place")).distinct()
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("place") + 1)
    grouped = hits.groupBy("request_id", "place").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hit_rank", "record_id")).alias("first"))
    return grouped.select("request_id", "place", label.alias("label"), "n", F.col("first.record_id").alias("first"))


LABEL_SQL = """WITH h AS (SELECT DISTINCT request_id, record_id, hit_rank, CASE WHEN distance <= 0.2 THEN 0 WHEN distance <= 0.4 THEN 1 WHEN distance IS NULL OR distance <= 0.6 THEN 2 ELSE 3 END AS place FROM retrieval_hits)
    SELECT request_id, place, ['direct', 'close', 'background', 'irrelevant'][place + 1] AS label, count(*) AS n, min({'k': hit_rank, 'r': record_id}).r AS first FROM h GROUP BY 1, 2"""


def filled(template: str, **fields: Column) -> Column:
    """``template`` with each ``{name}`` replaced by its column; nulls are empty."""
    text: Column = F.lit(template)
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


SYSTEM = "Today is {date}. Use nothing that became known later."
USER = "{title}\n\n{question}\n\nBackground: {background}"


def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each question, with the day of its simulation before it, by its short hash and length."""
    prompt = F.concat_ws("\n\n", filled(SYSTEM, date=F.col("simulation_date")), filled(USER, title=F.col("title"), question=F.col("question_text"), background=F.col("background")))
    q = table(spark, d, "questions").groupBy("question_id").agg(*(F.min(c).alias(c) for c in ("simulation_date", "title", "question_text", "background")))
    return q.select("question_id", F.substring(F.sha2(prompt, 256), 1, 16).alias("prompt_hash"), F.length(prompt).alias("n_chars"))


PROMPTS = """WITH q AS (SELECT question_id, min(simulation_date) AS d, min(title) AS t, min(question_text) AS q, min(background) AS b FROM questions GROUP BY 1),
    p AS (SELECT question_id, 'Today is ' || coalesce(d, '') || '. Use nothing that became known later.' || repeat(chr(10), 2) || coalesce(t, '') || repeat(chr(10), 2) || coalesce(q, '') || repeat(chr(10), 2) || 'Background: ' || coalesce(b, '') AS p FROM q)
    SELECT question_id, substr(sha256(p), 1, 16) AS prompt_hash, length(p) AS n_chars FROM p"""


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text that a record's vector is made of: headline and summary."""
    return events(spark, d).select("record_id", F.concat(F.coalesce("headline", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit(""))).alias("text"))


def earliest_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Records that every model may have been trained on: those dated up to the earliest cutoff of all models."""
    first = table(spark, d, "model_windows").agg(F.min("training_cutoff").alias("cutoff"))
    old = events(spark, d).select("event_date").join(F.broadcast(first)).groupBy("cutoff")
    return old.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_date") <= F.col("cutoff")).alias("n_before"))


def value_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Values of domain, type and difficulty in order of how many questions have them, ties by value."""
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.coalesce(k, F.lit("unknown")).alias("value")) for k in ("domain", "question_type", "difficulty")))).alias("s")
    n = questions(spark, d).select(cut).groupBy("s.slice", "s.value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("n"), "value")))


RANKS = f"""WITH {Q}, x AS (SELECT unnest([{{'s': 'domain', 'v': coalesce(domain, 'unknown')}}, {{'s': 'question_type', 'v': coalesce(question_type, 'unknown')}}, {{'s': 'difficulty', 'v': coalesce(difficulty, 'unknown')}}]) AS e FROM qq),
    n AS (SELECT e.s AS slice, e.v AS value, count(*) AS n FROM x GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY slice ORDER BY n DESC, value) AS place FROM n"""


def canonical_actors(spark: SparkSession, d: str) -> DataFrame:
    """Actors of each record in order, plain names replaced by the one actor who bears or is known by them, whatever the case.

    A name of several actors, or of none, stays as written, trimmed.  A record without actors has no row.
    """
    actors = table(spark, d, "actors")
    names = actors.select("actor_id", F.explode(F.concat(F.array("name"), F.coalesce("known_as", F.array()))).alias("name"))
    of_name = names.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("actor_id").alias("known"), F.count_distinct("actor_id").alias("n")).filter("n = 1").drop("n")
    written = events(spark, d).select("record_id", F.posexplode("actors").alias("pos", "name")).withColumn("key", F.lower(F.trim("name")))
    read = written.join(of_name, "key", "left").select("record_id", F.struct("pos", F.coalesce("known", F.trim("name")).alias("name")).alias("a"))
    return read.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["name"]), "|").alias("actors"))


CANONICAL = f"""WITH {EV}, k AS (SELECT lower(trim(name)) AS key, actor_id FROM actors UNION SELECT lower(trim(x)) AS key, actor_id FROM (SELECT unnest(known_as) AS x, actor_id FROM actors)),
    n AS (SELECT key, min(actor_id) AS known FROM k GROUP BY 1 HAVING count(DISTINCT actor_id) = 1),
    a AS (SELECT record_id, unnest(actors) AS name, generate_subscripts(actors, 1) AS pos FROM ev)
    SELECT record_id, coalesce(string_agg(coalesce(known, trim(name)), '|' ORDER BY pos), '') AS actors FROM a LEFT JOIN n ON n.key = lower(trim(a.name)) GROUP BY 1"""


def domain_export(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines, a folder a domain, and read again: how many each folder holds, of how many seeds."""
    path = Scratch(spark).base + "/seeds"
    q = table(spark, d, "questions").groupBy("question_id").agg(F.min("seed_id").alias("seed_id"), F.min(F.coalesce("domain", F.lit("unknown"))).alias("in_domain"))
    write_keyed(q, path, "in_domain")
    back = spark.read.schema("question_id string, seed_id string, in_domain string").json(path)
    return back.groupBy(F.col("in_domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed_id").alias("n_seeds"))


EXPORT = """WITH q AS (SELECT question_id, min(seed_id) AS seed_id, min(coalesce(domain, 'unknown')) AS domain FROM questions GROUP BY 1)
    SELECT domain, count(*) AS n, count(DISTINCT seed_id) AS n_seeds FROM q GROUP BY 1"""


def merged(e: DataFrame, by: list[str]) -> DataFrame:
    """Records that agree in ``by`` merged: facts stripped, once each and sorted, topics in normal form, quotes once each
    whatever their case, the speaker as the first record has them."""
    facts = e.select(*by, F.explode("key_facts").alias("fact")).select(*by, F.trim("fact").alias("fact")).filter("fact <> ''").distinct()
    topics = e.select(*by, F.explode(normal_topics("topics")).alias("topic")).distinct()
    quotes = e.select(*by, "record_id", F.posexplode("direct_quotes").alias("pos", "q")).select(*by, "record_id", "pos", F.lower(F.trim("q.quote")).alias("said"), F.col("q.speaker").alias("speaker")).filter("said <> ''")
    first = quotes.groupBy(*by, "said").agg(F.min_by("speaker", F.struct("record_id", "pos")).alias("speaker"))
    joined = lambda df, c, name: df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(c)), "|").alias(name))
    out = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    for part in (joined(facts, "fact", "facts"), joined(topics, "topic", "topics"), first.groupBy(*by).agg(F.count(F.lit(1)).alias("n_quotes"), F.count("speaker").alias("n_spoken"))):
        out = out.join(part, by, "left")
    return out.select(*by, "n", "first", F.coalesce("facts", F.lit("")).alias("facts"), F.coalesce("topics", F.lit("")).alias("topics"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_spoken", F.lit(0)).alias("n_spoken"))


def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of each lead actor's day merged."""
    return merged(events(spark, d).withColumn("actor_id", F.get("actors", F.lit(0))).filter("actor_id is not null"), ["actor_id", "event_date"])


def voted_dates(e: DataFrame, by: list[str]) -> DataFrame:
    """``by``, event_date, date_confidence: the day that most records with a day name, ties to the first record by id.

    High if two or more records name it and none another, medium with more than half of the votes, else uncertain.  A group
    without a vote has no row.
    """
    votes = e.filter("event_date_precision = 'day' and event_date is not null").groupBy(*by, "event_date").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    best = votes.groupBy(*by).agg(F.min_by(F.struct("event_date", "n"), F.struct(-F.col("n"), "first")).alias("b"), F.sum("n").alias("all"))
    sure = F.when((F.col("b.n") == F.col("all")) & (F.col("all") >= 2), "high").when(F.col("b.n") * 2 > F.col("all"), "medium").otherwise("uncertain")
    return best.select(*by, "b.event_date", sure.alias("date_confidence"))


def named_sources(e: DataFrame, by: list[str]) -> DataFrame:
    """``by``, urls, hosts: sources once a URL, the first record's first, with their hosts as names."""
    s = e.select(*by, "record_id", F.posexplode("sources").alias("pos", "s")).select(*by, "record_id", "pos", F.col("s.url").alias("url")).filter("url <> ''")
    once = s.groupBy(*by, "url").agg(F.min(F.struct("record_id", "pos")).alias("at"))
    listed = once.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("u")).select(*by, F.col("u.url").alias("urls"))
    return listed.select(*by, F.array_join("urls", "|").alias("urls"), F.array_join(F.transform("urls", netloc), "|").alias("hosts"))


def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Records of each event of ``event_clusters`` merged, with the voted date and all sources."""
    scratch = Scratch(spark)
    e = scratch.keep(events(spark, d).join(event_clusters(spark, d), "record_id"))
    by = ["leader"]
    return merged(e, by).join(voted_dates(e, by), by, "left").join(named_sources(e, by), by, "left")


def merged_sql(by: str) -> str:
    """SQL of ``merged`` over a table e: the part behind WITH that ends in a table m."""
    return f"""b AS (SELECT {by}, count(*) AS n, min(record_id) AS first FROM e GROUP BY ALL),
    f AS (SELECT {by}, string_agg(fact, '|' ORDER BY fact) AS facts FROM (SELECT DISTINCT {by}, trim(x) AS fact FROM (SELECT {by}, unnest(key_facts) AS x FROM e)) WHERE fact <> '' GROUP BY {by}),
    t AS (SELECT {by}, string_agg(topic, '|' ORDER BY topic) AS topics FROM (SELECT DISTINCT {by}, unnest({NORMAL}) AS topic FROM e) GROUP BY ALL),
    u AS (SELECT {by}, record_id, unnest(direct_quotes) AS q, generate_subscripts(direct_quotes, 1) AS pos FROM e),
    s AS (SELECT {by}, lower(trim(q.quote)) AS said, q.speaker AS speaker FROM u WHERE lower(trim(q.quote)) <> '' QUALIFY row_number() OVER (PARTITION BY {by}, lower(trim(q.quote)) ORDER BY record_id, pos) = 1),
    k AS (SELECT {by}, count(*) AS n_quotes, count(speaker) AS n_spoken FROM s GROUP BY ALL),
    m AS (SELECT {by}, n, first, coalesce(facts, '') AS facts, coalesce(topics, '') AS topics, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_spoken, 0) AS n_spoken
    FROM b LEFT JOIN f USING ({by}) LEFT JOIN t USING ({by}) LEFT JOIN k USING ({by}))"""

MERGED = f"WITH {EV}, e AS (SELECT *, actors[1] AS actor_id FROM ev WHERE actors[1] IS NOT NULL), {merged_sql('actor_id, event_date')} SELECT * FROM m"
CLUSTERS = f"""WITH {EV}, c AS ({EVENTS_SQL}), e AS (SELECT * FROM ev JOIN c USING (record_id)), {merged_sql('leader')},
    v AS (SELECT leader, event_date, count(*) AS n, min(record_id) AS first FROM e WHERE event_date_precision = 'day' AND event_date IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT leader, event_date, CASE WHEN n = total AND total >= 2 THEN 'high' WHEN n * 2 > total THEN 'medium' ELSE 'uncertain' END AS date_confidence
      FROM (SELECT *, sum(n) OVER (PARTITION BY leader) AS total FROM v) QUALIFY row_number() OVER (PARTITION BY leader ORDER BY n DESC, first) = 1),
    z AS (SELECT leader, src.url AS url, min({{'r': record_id, 'p': pos}}) AS place FROM (SELECT leader, record_id, unnest(sources) AS src, generate_subscripts(sources, 1) AS pos FROM e) WHERE src.url <> '' GROUP BY 1, 2),
    y AS (SELECT leader, string_agg(url, '|' ORDER BY place) AS urls, string_agg(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '|' ORDER BY place) AS hosts FROM z GROUP BY 1)
    SELECT * FROM m LEFT JOIN w USING (leader) LEFT JOIN y USING (leader)"""


def unseen(candidates: DataFrame, existing: DataFrame, alike: float = 0.8) -> DataFrame:
    """``id`` of the candidates that are new beside ``existing`` and beside each other.

    Both tables have ``id, title, urls``.  A candidate is dropped if ``existing`` has one of its URLs, or a title that shares
    ``alike`` of the words of the longer one; of the rest, in order of id, one is dropped if it matches one kept before in a URL
    or a title.  Empty titles and null URLs match nothing; no pair of a URL's records is built.
    """
    scratch = Scratch(candidates.sparkSession)
    url = lambda df: df.select("id", F.explode("urls").alias("url")).filter("url <> ''").distinct()
    known = url(existing).select("url").distinct()
    fresh = candidates.join(url(candidates).join(known, "url", "left_semi").select("id").distinct(), "id", "left_anti")
    bag = lambda df, old: df.select("id", F.array_sort(F.array_distinct(words("title"))).alias("words"), F.lit(old).alias("old")).filter("size(words) > 0")
    titled = scratch.keep(bag(fresh, 0).unionByName(bag(existing, 1)))
    texts = scratch.keep(titled.groupBy("words").agg(F.max("old").alias("old")).withColumn("key", F.array_join("words", " ")))
    near = F.when(F.col("old") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array().cast("array<int>"))  # no pairs of two old texts
    edges = scratch.keep(overlap_pairs(texts.select("key", "words", F.col("old").alias("here"), near.alias("near")), alike).select("a", "b"))
    old = texts.filter("old = 1").select("key")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near_old = both.join(old.withColumnRenamed("key", "b"), "b", "left_semi").select(F.col("a").alias("key")).unionByName(old).distinct()
    keyed = titled.filter("old = 0").select("id", F.array_join("words", " ").alias("key"))
    left = scratch.keep(fresh.select("id", "urls").join(keyed.join(near_old, "key", "left_semi").select("id"), "id", "left_anti"))
    alive = keyed.join(left.select("id"), "id", "left_semi")
    pairs = edges.join(alive.select(F.col("key").alias("a")).distinct(), "a", "left_semi").join(alive.select(F.col("key").alias("b")).distinct(), "b", "left_semi")
    links = (
        url(left).select("id", F.concat(F.lit("url "), "url").alias("k"))
        .unionByName(alive.select("id", F.concat(F.lit("text "), "key").alias("k")))
        .unionByName(pairs.select(F.explode(F.array("a", "b")).alias("key"), F.concat_ws("\n", "a", "b").alias("k")).join(alive, "key").select("id", F.concat(F.lit("pair "), "k").alias("k")))
        .unionByName(left.select("id", F.lit(None).cast("string").alias("k")))
    )
    return key_leaders(links, "id", "k").filter("id = leader").select("id")


def new_records(spark: SparkSession, d: str) -> DataFrame:
    """Records first delivered in the last month of ingestion that are new beside all earlier ones."""
    e = one_of_each(table(spark, d, "event_records")).select(F.col("record_id").alias("id"), F.col("headline").alias("title"), F.transform("sources", lambda s: s["url"]).alias("urls"), "ingestion_date")
    edge = e.agg(F.add_months(F.to_date(F.max("ingestion_date")), -1).alias("edge"))
    marked = Scratch(spark).keep(e.join(F.broadcast(edge)))
    return unseen(marked.filter("ingestion_date >= edge"), marked.filter("ingestion_date < edge"))


QUERIES = {
    "briefing_reuse": (briefing_reuse, REUSE),
    "search_context": (search_context, CONTEXT),
    "label_groups": (label_groups, LABEL_SQL),
    "rendered_prompts": (rendered_prompts, PROMPTS),
    "embedding_texts": (embedding_texts, f"WITH {EV} SELECT record_id, coalesce(headline, '') || '. ' || coalesce(summary, '') AS text FROM ev"),
    "earliest_cutoff": (earliest_cutoff, f"WITH {EV}, c AS (SELECT min(training_cutoff) AS cutoff FROM model_windows) SELECT cutoff, count(*) AS n, count(*) FILTER (event_date <= cutoff) AS n_before FROM ev, c GROUP BY 1"),
    "value_ranks": (value_ranks, RANKS),
    "domain_export": (domain_export, EXPORT),
    "canonical_actors": (canonical_actors, CANONICAL),
    "merged_records": (merged_records, MERGED),
    "merged_clusters": (merged_clusters, CLUSTERS),
    "new_records": (new_records, None),
}
