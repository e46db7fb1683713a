"""Streams with state, on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.plans.register import query
from gleanery.sources.tables import table
from gleanery.streaming import work


@query("""WITH r AS (SELECT conv_id AS session, turn // 4 AS query, CASE role WHEN 'user' THEN 'lexical' WHEN 'assistant' THEN 'hybrid' ELSE role END AS kind, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS k, (turn * 37) % 11 AS t, text AS payload FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY query DESC, k DESC, t, payload) AS n FROM r WHERE k > 0) SELECT session, query, kind, payload FROM w WHERE n = 1""")
def progressive_results(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation shows in the end, its user's turns as lexical and its assistant's as hybrid results, four turns a query."""
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "lexical").when(F.col("role") == "assistant", "hybrid").otherwise(F.col("role"))
    at = F.timestamp_seconds(F.col("turn") * 37 % 11)
    return work.current_results(c.select(F.col("conv_id").alias("session"), F.floor(F.col("turn") / 4).alias("query"), kind.alias("kind"), at.alias("at"), F.col("text").alias("payload")))


KINDS = "CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'attempt' END"


def _kinds() -> F.Column:
    e = F.col("event_type")
    return F.when(e == "error", "timeout").when(e == "signup", "failed").when(e == "purchase", "done").otherwise("attempt")


@query(f"""WITH e AS (SELECT event_id AS id, user_id AS item, ts AS t, {KINDS} AS kind, 'm' || (event_id % 2) AS model FROM events),
s AS (SELECT *, last_value(CASE WHEN kind IN ('failed', 'done') THEN kind || model END IGNORE NULLS) OVER w AS stamp, last_value(CASE WHEN kind <> 'attempt' THEN kind END IGNORE NULLS) OVER w AS latest, last_value(CASE WHEN kind <> 'attempt' THEN t END IGNORE NULLS) OVER w AS since FROM e
  WINDOW w AS (PARTITION BY item ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT id, item, CASE WHEN stamp = 'failedm1' THEN 'failed' WHEN latest = 'timeout' AND t - since < INTERVAL 10 MINUTE THEN 'timeout' END AS reason FROM s WHERE kind = 'attempt')
SELECT id, item, reason IS NULL AS admitted, reason FROM r""")
def retry_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views as attempts on a user's item, errors as time-outs, sign-ups as failures under one of two models, purchases as successes."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("item"), F.col("ts").alias("at"), _kinds().alias("kind"), F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"))
    return work.admitted(e, "m1").select("id", "item", "admitted", "reason")


@query(None)
def background_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A user's sign-ups as sessions that work off what other events left, with 4 items and 60 seconds each."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.col("ts").alias("at"), F.when(F.col("event_type") == "signup", "start").otherwise("item").alias("kind"), F.col("value").alias("seconds"))
    return work.sessions(e, 4, 60)
