"""Order-dependent folds, answer objects, resampling; the folds' SQL scans all rows one by one against all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.objects import object_of
from hindcast.functions.scalars import r6, words
from hindcast.operators import scoring as S
from hindcast.operators.leaders import key_leaders, leader_clusters
from hindcast.operators.overlap import overlap_leaders
from hindcast.operators.retrieval import one_of_each
from hindcast.runtime import Scratch, table


WORDS = lambda c: f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+'), lambda w: w <> '')))"


def fold_sql(tables: str, node: str = "id", leader: str = "leader", cut: int = 1) -> str:
    """SQL of the fold over nodes(id) and edges(a, b) with a < b, which ``tables`` define: a node goes to the least earlier leader it
    matches, else leads.  Names begin at sign ``cut`` of the ids."""
    return f"""WITH RECURSIVE {tables}, n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL)),
    e AS MATERIALIZED (SELECT y.i, list(DISTINCT x.i) AS earlier FROM edges JOIN n x ON x.id = a JOIN n y ON y.id = b GROUP BY 1), o AS MATERIALIZED (SELECT i, coalesce(earlier, []) AS earlier FROM n LEFT JOIN e USING (i)),
    f AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, 0::BIGINT AS led UNION ALL
      SELECT o.i, CASE WHEN list_has_any(kept, earlier) THEN kept ELSE list_append(kept, o.i) END, coalesce(list_min(list_intersect(kept, earlier)), o.i) FROM f JOIN o ON o.i = f.i + 1)
    SELECT substr(x.id, {cut}) AS {node}, substr(y.id, {cut}) AS {leader} FROM f JOIN n x ON x.i = f.i JOIN n y ON y.i = f.led"""


JUDGED = fold_sql(
    """nodes AS (SELECT question_id AS id FROM questions), edges AS (SELECT least(question_a_id, question_b_id) AS a, greatest(question_a_id, question_b_id) AS b
    FROM similarity_scores WHERE score >= 3 AND question_a_id <> question_b_id)""", "question_id",
)


def like_sql(table_name: str, column: str) -> str:
    return fold_sql(
        f"""t AS (SELECT DISTINCT {WORDS(column)} AS w FROM {table_name}), nodes AS (SELECT array_to_string(w, ' ') AS id, w FROM t WHERE len(w) > 0),
    edges AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id < y.id AND len(list_intersect(x.w, y.w)) >= 0.8 * greatest(len(x.w), len(y.w)) - 1e-6)""", "key",
    )


EVENTS = f"""ev AS (SELECT * FROM event_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingestion_date) = 1), r AS (SELECT record_id AS id, event_date AS d, {WORDS('headline')} AS w, list_filter(topics, lambda t: t IS NOT NULL) AS topics FROM ev),
    nodes AS (SELECT id FROM r), p AS (SELECT x.id AS a, y.id AS b, abs(x.d - y.d) AS apart, len(list_intersect(x.w, y.w)) AS common, greatest(len(x.w), len(y.w)) AS most, list_has_any(x.topics, y.topics) AS shared FROM r x JOIN r y ON x.id < y.id),
    edges AS (SELECT a, b FROM p WHERE common > 0.75 * most OR apart <= 2 AND common > 0.5 * most OR apart = 0 AND shared)"""
EVENTS_SQL = fold_sql(EVENTS, "record_id")


def judged_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Questions in order of id, each kept unless an earlier kept one was judged 3 or 4 with it."""
    pairs = table(spark, d, "similarity_scores").filter("score >= 3")
    return leader_clusters(table(spark, d, "questions"), pairs, "question_id", "question_a_id", "question_b_id")


def text_leaders(texts: DataFrame, column: str, alike: float = 0.8) -> DataFrame:
    """Different texts (as sorted words) in order, each kept unless a kept one shares ``alike`` of the words of the longer."""
    scratch = Scratch(texts.sparkSession)
    keys = texts.select(F.array_join(F.array_sort(F.array_distinct(words(column))), " ").alias("key")).filter("key <> ''").distinct()
    named = scratch.keep(keys.orderBy("key").withColumn("id", F.monotonically_increasing_id()))
    led = overlap_leaders(named.select("id", F.split("key", " ").alias("words")), alike)
    members = led.join(named.select(F.col("id").alias("leader"), F.col("key").alias("first")), "leader").select("id", "first")
    return named.join(members, "id", "left").select("key", F.coalesce("first", "key").alias("leader"))


def title_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Titles of questions, each kept unless it is like a kept one."""
    return text_leaders(table(spark, d, "questions"), "title")


def query_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Queries of requests, each kept unless it is like a kept one, so that a search is made once."""
    return text_leaders(table(spark, d, "retrieval_requests"), "query")


def coded_texts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``text, w``: the words of each of ``texts`` (text, words) as numbers, the rarest first."""
    long = texts.select("text", F.explode("words").alias("word"))
    codes = scratch.keep(long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.monotonically_increasing_id()))
    return scratch.keep(long.join(codes, "word").groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("w")))


#: Of words in one order, texts that share more than half have one of their first words in common, and such as share more than
#: three quarters, which are at least 4 if the texts differ, three of their first words.
ONE_OF = "slice(w, 1, size(w) - floor(size(w) / 2))"
THREE_OF = """flatten(transform(sequence(1, m - 2), i -> flatten(transform(sequence(i + 1, m - 1), j -> transform(sequence(j + 1, m), k -> xxhash64(w[i - 1], w[j - 1], w[k - 1]))))))"""


def event_keys(events: DataFrame, days: int = 2) -> DataFrame:
    """``record_id, key``: records describe the same event if and only if they share a key; the key is null beside others.

    Same event: at most ``days`` apart with more than half of the words of the longer headline shared, or the same day and a
    shared topic, or more than three quarters of the words shared, whatever the dates.  Headlines of the same words are one
    text, and one text of one day is one item.  All records of two items that match match each other, so a pair of items is a
    key as well, and no pair of records is built.  Candidates carry their words and are verified where they meet.
    """
    scratch = Scratch(events.sparkSession)
    read = scratch.keep(events.select("record_id", F.unix_date("event_date").alias("day"), "topics", F.array_sort(F.array_distinct(words("headline"))).alias("words")))
    texts = scratch.keep(read.select("words").filter("size(words) > 0").distinct().withColumn("text", F.monotonically_increasing_id()))
    e = scratch.keep(read.join(texts, "words", "left").drop("words"))
    coded = coded_texts(texts, scratch)
    share = lambda least: (F.least(F.size("a.w"), F.size("b.w")) > least * F.greatest(F.size("a.w"), F.size("b.w"))) & (F.size(F.array_intersect("a.w", "b.w")) > least * F.greatest(F.size("a.w"), F.size("b.w")))

    met = coded.filter("size(w) > 3").withColumn("m", F.expr("int(size(w) - floor(size(w) * 0.75) + 2)")).select("text", "w", F.explode(F.expr(THREE_OF)).alias("at"))
    anywhere = met.alias("a").join(met.alias("b"), F.expr("a.at = b.at and a.text < b.text")).filter(share(0.75)).select(F.col("a.text").alias("a"), F.col("b.text").alias("b")).distinct()

    block = F.floor(F.col("day") / max(days, 1))
    heads = e.select("day", "text").dropna().distinct().join(coded, "text").select("day", "text", "w", F.explode(F.expr(ONE_OF)).alias("at"))
    left, right = heads.withColumn("block", block), heads.withColumn("block", F.explode(F.array(block - 1, block)))
    near = left.alias("a").join(right.alias("b"), F.expr(f"a.at = b.at and a.block = b.block and a.text <> b.text and abs(a.day - b.day) <= {int(days)}")).filter(share(0.5))
    ends = [F.struct(F.col(f"{x}.day").alias("day"), F.col(f"{x}.text").alias("text")) for x in "ab"]
    close = near.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()

    by_text = e.select("record_id", F.concat(F.lit("text "), "text").alias("key"))
    by_topic = e.filter("day is not null").select("record_id", "day", F.explode("topics").alias("topic")).dropna().select("record_id", F.concat_ws(" ", F.lit("topic"), "day", "topic").alias("key"))
    by_words = anywhere.select(F.explode(F.array("a", "b")).alias("text"), F.concat_ws(" ", "a", "b").alias("key")).join(e, "text").select("record_id", "key")
    by_days = close.select(F.explode(F.array("a", "b")).alias("end"), F.concat_ws(" ", "a.day", "a.text", "b.day", "b.text").alias("key")).select("end.*", "key").join(e, ["day", "text"]).select("record_id", "key")
    return by_text.unionByName(by_topic).unionByName(by_words).unionByName(by_days)


def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Records in order of id, clustered by leaders that describe the same event."""
    return key_leaders(event_keys(one_of_each(table(spark, d, "event_records"))), "record_id", "key")


def answer_objects(spark: SparkSession, d: str) -> DataFrame:
    """How each raw call's object is found, by model, and the mean probability in it."""
    calls = table(spark, d, "raw_calls").dropDuplicates(["call_id"]).select("model_id", object_of("text").alias("o"))
    return calls.groupBy("model_id", "o.how").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o.probability")).alias("probability"))


def bootstrap_ci(spark: SparkSession, d: str, draws: int = 10_000) -> DataFrame:
    """Mean Brier score of each experiment and its 95 % interval by a Poisson bootstrap over questions."""
    per = S.per_question(S.samples(table(spark, d, "predictions"), table(spark, d, "questions"))).select("experiment", "question_id", "brier")
    return S.bootstrap_intervals(per, ["experiment"], "question_id", "brier", draws)


def significance(spark: SparkSession, d: str, draws: int = 10_000) -> DataFrame:
    """Each two experiments on the questions both scored: mean difference of Brier scores with its 95 % interval, median, wins,
    losses, ties and the exact sign test."""
    deltas = Scratch(spark).keep(S.paired(S.per_question(S.samples(table(spark, d, "predictions"), table(spark, d, "questions")))))
    intervals = S.bootstrap_intervals(deltas, ["a", "b"], "question_id", "delta", draws)
    signs = S.sign_test(S.paired_summary(deltas))
    return intervals.join(S.medians(deltas), ["a", "b"]).join(signs, ["a", "b"])


QUERIES = {f.__name__: (f, None) for f in (answer_objects, bootstrap_ci, significance)} | {
    "judged_leaders": (judged_leaders, JUDGED),
    "title_leaders": (title_leaders, like_sql("questions", "title")),
    "query_leaders": (query_leaders, like_sql("retrieval_requests", "query")),
    "event_clusters": (event_clusters, EVENTS_SQL),
}
