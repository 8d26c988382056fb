"""Queries over whole tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import bpe, components, lookalike, names, neardup, packing, truncation
from hindcast.runtime import table


def near_duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "event_records").filter("length(summary) > 0").select(F.lit("event").alias("kind"), F.col("record_id").alias("id"), F.concat_ws(" ", "headline", "summary").alias("text"))
    questions = table(spark, d, "questions").select(F.lit("question").alias("kind"), F.col("question_id").alias("id"), F.col("question_text").alias("text"))
    return events.unionByName(questions)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(near_duplicate_texts(spark, d), "kind", "id", "text")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record in a group: the group's least id and the number of links of the record's text."""
    return neardup.near_duplicate_groups(near_duplicate_texts(spark, d), "kind", "id", "text")


def model_texts(spark: SparkSession, d: str) -> DataFrame:
    reasonings = table(spark, d, "predictions").select(F.lit("reasoning").alias("field"), F.col("prediction_id").alias("row_id"), F.col("model_id").alias("source"), F.col("binary.reasoning").alias("text"))
    calls = table(spark, d, "raw_calls").select(F.lit("text").alias("field"), F.col("call_id").alias("row_id"), F.col("model_id").alias("source"), "text")
    return reasonings.unionByName(calls)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(model_texts(spark, d)).filter("cut").select("field", "row_id").distinct()


def p3_share(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_share(truncation.truncated(model_texts(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_speakers(table(spark, d, "event_records"), table(spark, d, "actors"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of each spelling of a speaker, also of speakers who are not in ``actors``."""
    return names.speaker_groups(table(spark, d, "event_records"), table(spark, d, "actors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "similarity_scores").filter("score >= 3").select("question_a_id", "question_b_id")
    return components.connected_components(pairs, "question_a_id", "question_b_id", "question_id", "group_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_windows(bpe.text_sizes(table(spark, d, "documents")), table(spark, d, "model_windows"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "documents"))


def p8_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document that looks like another text: the group's least document and the number of such texts."""
    return lookalike.look_alike_groups(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_share, p4_found, p4_groups, p5_found, p6_ids, p7_windows, p8_found, p8_groups, p8_forms)}


#: Texts of problem 1 as lists of word hashes, each with the number of its occurrence, so that lists are sets; ``u`` has each
#: list once (r), ``m`` the ids that hold it, ``l`` the links between lists.
NEAR = """t AS (SELECT DISTINCT 'event' AS kind, record_id AS id, concat_ws(' ', headline, summary) AS x FROM event_records WHERE length(summary) > 0
      UNION ALL SELECT DISTINCT 'question', question_id, question_text FROM questions WHERE question_text IS NOT NULL),
    w AS (SELECT kind, id, x, unnest(regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+')) AS w FROM t),
    n AS (SELECT kind, id, x, hash(w, row_number() OVER (PARTITION BY kind, id, x, w)) AS e FROM w),
    g AS (SELECT kind, id, x, list_sort(list(e)) AS es FROM n GROUP BY ALL),
    u AS MATERIALIZED (SELECT kind, es, len(es) AS k, row_number() OVER () AS r FROM (SELECT DISTINCT kind, es FROM g)),
    m AS (SELECT DISTINCT g.id, u.r FROM g JOIN u ON g.kind = u.kind AND g.es = u.es),
    c AS (SELECT a.r AS ra, b.r AS rb, a.k AS ka, b.k AS kb, len(list_intersect(a.es, b.es)) AS i FROM u a JOIN u b ON a.kind = b.kind AND a.r < b.r AND least(a.k, b.k) >= 0.65 * greatest(a.k, b.k)),
    l AS (SELECT ra, rb FROM c WHERE i / (ka + kb - i) >= 0.65),
    p AS (SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM (SELECT ra, rb FROM l UNION ALL SELECT r, r FROM u) z JOIN m x ON x.r = z.ra JOIN m y ON y.r = z.rb WHERE x.id <> y.id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {NEAR} SELECT id_a, id_b FROM p",
        "p1_groups": f"""WITH RECURSIVE {NEAR}, s AS (SELECT id_a AS a, id_b AS b FROM p UNION SELECT id_b, id_a FROM p), h(id, g) AS (SELECT a, a FROM s UNION SELECT s.b, h.g FROM h JOIN s ON s.a = h.id),
            d AS (SELECT r, count(*) AS n FROM (SELECT ra AS r FROM l UNION ALL SELECT rb FROM l) GROUP BY 1), k AS (SELECT m.id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_links FROM m LEFT JOIN d USING (r) GROUP BY 1)
            SELECT id, min(g) AS group_id, any_value(n_links) AS n_links FROM h JOIN k USING (id) GROUP BY 1""",
        "p5_found": """
            WITH RECURSIVE e AS (SELECT question_a_id a, question_b_id b FROM similarity_scores WHERE score >= 3 AND question_a_id <> question_b_id),
            s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            r(n, g) AS (SELECT a, a FROM s UNION SELECT s.b, r.g FROM r JOIN s ON s.a = r.n)
            SELECT n AS question_id, min(g) AS group_id FROM r GROUP BY n""",
    }
