"""Replies, grounding and descriptions of frames, on conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import replies
from gleanery.operators import describe
from gleanery.plans.register import query
from gleanery.sources.tables import table

ENDS = r"""'^[\s"''`*\[\]]+|[\s"''`*\[\]]+$', '', 'g'"""


@query(rf"""WITH c AS (SELECT *, (conv_id + turn) % 4 AS k, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS lines FROM conversations),
v AS (SELECT *, list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(lines, lambda x: replace(x, ' ', ', ')), ' '), '[,;\n]+'), lambda x: regexp_replace(x, {ENDS})), lambda x: x <> '')[1:16] AS words FROM c)
SELECT conv_id, turn, CASE k WHEN 0 THEN regexp_replace(array_to_string(lines, ' '), {ENDS}) WHEN 1 THEN trim(text, E' \t\r\n') WHEN 2 THEN 'seen by ' || role ELSE left(trim(regexp_replace(text, '\s+', ' ', 'g')), 240) END AS caption,
CASE k WHEN 0 THEN array_to_string(words, '|') WHEN 1 THEN 'a|' || role WHEN 2 THEN regexp_extract(text, '^[A-Za-z]+') ELSE '' END AS tags FROM v""")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Turns as replies in four states: labelled lines, JSON, JSON cut off in a list, and bare text."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    whole = F.to_json(F.struct(F.col("text").alias("caption"), F.array(F.lit("a"), "role").alias("tags")))
    cut = F.concat(F.lit('Here it is: {"caption": "seen by '), "role", F.lit('", "tags": ["'), F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit('", "z'))
    lines = F.concat(F.lit("CAPTION: "), "text", F.lit("\nTAGS: "), F.replace("text", F.lit(" "), F.lit(", ")))
    found = table(spark, d, "conversations").withColumn("r", replies.parsed(F.when(k == 0, lines).when(k == 1, whole).when(k == 2, cut).otherwise(F.col("text"))))
    return found.select("conv_id", "turn", "r.caption", F.array_join("r.tags", "|").alias("tags"))


SHOWN = "SELECT user_id AS id, event_type || ' ' || (event_id % 5) AS label, ['format', 'emotion', 'other', 'action'][1 + event_id % 4] AS category, event_id AS position, 'k' || (event_id % 9) AS term FROM events"


@query(f"""WITH e AS ({SHOWN}), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY position) AS r FROM e) WHERE r = 1),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY position) AS n, CASE category WHEN 'format' THEN 1 WHEN 'action' THEN 4 WHEN 'emotion' THEN 7 ELSE 11 END AS facet FROM one) WHERE n <= 2),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY facet, position) AS m FROM few) WHERE m <= 8),
s AS (SELECT id, string_agg(seg, '; ' ORDER BY m) AS s FROM (SELECT id, min(m) AS m, category || ': ' || string_agg(label, ', ' ORDER BY m) AS seg FROM kept GROUP BY id, category) GROUP BY id),
t AS (SELECT id, string_agg(term, ', ' ORDER BY position) AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS n FROM (SELECT id, term, min(position) AS position FROM e GROUP BY id, term)) WHERE n <= 6 GROUP BY id)
SELECT s.id, CASE s.id % 3 WHEN 0 THEN '{describe.Wording.nothing}' WHEN 1 THEN '{describe.Wording.unsure[0]}' || s || ' (related: ' || t || ')' || '{describe.Wording.unsure[1]}' ELSE '{describe.Wording.sure[0]}' || s || ' (related: ' || t || ')' || '{describe.Wording.sure[1]}' END AS grounding FROM s JOIN t USING (id)""")
def grounding_text(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as labels of four facets, with quotas; a third of the users is not recognised."""
    i = F.col("event_id")
    facets = F.array(*[F.lit(f) for f in ("format", "emotion", "other", "action")])
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.concat_ws(" ", "event_type", i % 5).alias("label"), F.get(facets, (i % 4).cast("int")).alias("category"), i.alias("position"), F.concat(F.lit("k"), (i % 9).cast("string")).alias("term"))
    tier = F.when(F.col("id") % 3 == 0, "unknown").when(F.col("id") % 3 == 1, "weak").otherwise("recognized")
    return describe.grounding(e.select("id").distinct().withColumn("tier", tier), e, e.select("id", "term", "position"))


@query(r"""WITH f AS (SELECT conv_id AS id, turn AS ordinal, trim(text) AS caption, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, string_split(text, ' ') AS subjects, role FROM conversations), n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
c1 AS (SELECT id, caption, o, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM (SELECT id, arg_min(caption, ordinal) AS caption, min(ordinal) AS o FROM f WHERE caption <> '' GROUP BY id, lower(caption))), c AS (SELECT id, left(string_agg(caption, ' / ' ORDER BY o), 240) AS caption FROM c1 WHERE r <= 2 GROUP BY id),
w AS (SELECT id, ordinal, unnest(subjects) AS v, generate_subscripts(subjects, 1) AS p FROM f), w1 AS (SELECT id, arg_min(trim(v), ordinal * 1000000 + p) AS v, min(ordinal * 1000000 + p) AS p FROM w WHERE trim(v) <> '' GROUP BY id, lower(trim(v))),
s AS (SELECT id, string_agg(v, '|' ORDER BY p) AS subjects FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM w1) WHERE r <= 16 GROUP BY id),
t1 AS (SELECT id, arg_min(t, ordinal) AS t, min(ordinal) AS o FROM f WHERE t <> '' GROUP BY id, lower(t)), t AS (SELECT id, string_agg(t, chr(10) ORDER BY o) AS text FROM t1 a WHERE NOT EXISTS (SELECT 1 FROM t1 b WHERE b.id = a.id AND lower(b.t) <> lower(a.t) AND contains(lower(b.t), lower(a.t))) GROUP BY id),
g AS (SELECT id, string_agg(role, '|' ORDER BY o) AS tags FROM (SELECT id, role, min(ordinal) AS o FROM f GROUP BY id, role) GROUP BY id)
SELECT n.id, caption, subjects, text, tags FROM n LEFT JOIN c USING (id) LEFT JOIN s USING (id) LEFT JOIN t USING (id) LEFT JOIN g USING (id) WHERE n > 1""")
def merged_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of more than one turn as items, turns as frames."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ordinal"), F.col("text").alias("caption"), F.split("text", " ").alias("subjects"), "text", F.array("role").alias("tags"))
    several = c.groupBy("id").count().filter("count > 1").select("id")
    found = describe.merged(c.join(several, "id", "left_semi"))
    return found.select("id", "caption", F.array_join("subjects", "|").alias("subjects"), "text", F.array_join("tags", "|").alias("tags"))
