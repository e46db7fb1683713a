"""Search and similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text, vectors
from gleanery.operators import postings, ranking, search, similar
from gleanery.plans import bindings as B
from gleanery.plans.register import query
from gleanery.sources import tables
from gleanery.sources.tables import table

PAIR = 0.35
H, HT = B.HIT.format(hay="search_text"), B.HIT.format(hay="tag_hay")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _literal(values: list[float]):
    return F.array(*[F.lit(float(x)) for x in values])


@query(f"SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], {B.Q}), 6) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {B.Q}) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_items(_vectors(spark, d), B.query_vector(spark, d), limit=10).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], {B.Q}), 6) AS score FROM embeddings WHERE vec_id <> (SELECT min(vec_id) FROM embeddings) ORDER BY list_dot_product(embedding::DOUBLE[], {B.Q}) DESC, vec_id LIMIT 12")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return similar.similar_items(v, B.query_vector(spark, d), exclude=v.agg(F.min("id")).first()[0]).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT a.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], {B.Q}) AS image, list_dot_product(b.embedding::DOUBLE[], {B.Q}) AS caption FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1)
SELECT id, round(image + CASE WHEN caption IS NULL THEN 0 ELSE 0.9 * greatest(0, caption - 0.55) END, 6) AS score FROM s""")
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with its predecessor as caption."""
    v = _vectors(spark, d)
    both = v.join(v.select((F.col("id") + 1).alias("id"), F.col("embedding").alias("caption")), "id", "left")
    return both.select("id", F.round(vectors.hybrid_score(_literal(B.query_vector(spark, d)), "embedding", "caption"), 6).alias("score"))


@query(f"""WITH t AS (SELECT {B.TERMS} AS terms), d AS (SELECT doc_id, lower(text) AS search_text FROM documents)
SELECT doc_id, round({B.LEXICAL.format(h=H)}, 6) AS score FROM d, t""")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(*[F.lit(w) for w in B.words(spark, d)])
    return table(spark, d, "documents").select("doc_id", F.round(search.term_score(F.lower("text"), terms), 6).alias("score"))


@query("""WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: len(w) > 2) AS terms FROM benchmark),
w AS (SELECT item_id, unnest(list_distinct(terms)) AS w FROM q), tokens AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents)
SELECT item_id, doc_id, count(*) AS shared FROM w JOIN tokens USING (w) GROUP BY ALL HAVING count(*) >= 12""")
def benchmark_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share at least twelve query words with a benchmark item, by an equi-join on words."""
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(text.search_terms("text"))).alias("w"))
    tokens = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w"))
    return tokens.join(F.broadcast(q), "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).filter("shared >= 12")


@query(f"WITH {B.ITEMS}, t AS (SELECT ['en', 'src1'] AS terms) SELECT id, round({B.TAG.format(h=HT)}, 6) AS score FROM items, t")
def tag_term_score(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.functions import tags as T

    terms = F.array(F.lit("en"), F.lit("src1"))
    return B.items(spark, d).select("id", F.round(search.tag_score(T.tag_haystack("tags"), terms), 6).alias("score"))


SEARCH = f"""WITH {B.ITEMS}, t AS (SELECT {B.TERMS} AS terms),
s AS (SELECT id, modified_at, list_dot_product(embedding, {B.Q}) + {B.LEXICAL.format(h=H)} + {B.TAG.format(h=HT)} AS score FROM items, t WHERE {{scope}}),
r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, modified_at DESC, id DESC) AS rank FROM s)
SELECT id, round(score, 6) AS hybrid_score, round(1.0 / (60 + rank), 9) AS rrf_score, rank FROM r WHERE rank <= 40"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("hybrid_score", 6).alias("hybrid_score"), F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


@query(SEARCH.format(scope="true"))
def search_full(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(B.items(spark, d), B.query_vector(spark, d), " ".join(B.words(spark, d))))


@query(SEARCH.format(scope="kind = 'fr'"))
def search_scope(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(B.items(spark, d), B.query_vector(spark, d), " ".join(B.words(spark, d)), kind="fr"))


@query(SEARCH.format(scope="true"))
def search_scope_relax(spark: SparkSession, d: str) -> DataFrame:
    """A kind that no item has is given up."""
    return _rounded(search.search(B.items(spark, d), B.query_vector(spark, d), " ".join(B.words(spark, d)), kind="nothing"))


@query(f"""WITH {B.ITEMS}, dense AS (SELECT id, row_number() OVER (ORDER BY list_dot_product(embedding, {B.Q}) DESC, id) AS rank FROM items),
lex AS (SELECT id, row_number() OVER (ORDER BY modified_at DESC, id) AS rank FROM items WHERE contains(search_text, 'the'))
SELECT id, round(sum(w / (60 + rank)), 9) AS rrf_score FROM (SELECT id, rank, 1.0 AS w FROM dense UNION ALL SELECT id, rank, 2.0 FROM lex) GROUP BY id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of the whole library fused: by vector, and of the items with a word by size."""
    rows = B.items(spark, d).select("id", "modified_at", vectors.dot("embedding", _literal(B.query_vector(spark, d))).alias("s"), F.contains("search_text", F.lit("the")).alias("hit"))
    dense = ranking.ranked(rows.select("id", "s"), [], [F.desc("s"), F.asc("id")]).select("id", F.lit(0).alias("list"), "rank", F.lit(1.0).alias("weight"))
    lex = ranking.ranked(rows.filter("hit").select("id", "modified_at"), [], [F.desc("modified_at"), F.asc("id")]).select("id", F.lit(1).alias("list"), "rank", F.lit(2.0).alias("weight"))
    return search.fuse(dense.unionByName(lex)).select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {PAIR}""")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar.similarity_pairs(_vectors(spark, d), PAIR).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {PAIR}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach(n, r) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n),
c AS (SELECT n AS id, min(r) AS cluster FROM reach GROUP BY n), m AS (SELECT cluster, id, label FROM c JOIN embeddings ON id = vec_id)
SELECT cluster, count(*) AS size, count(DISTINCT label) AS distinct_texts, count(DISTINCT label) >= 2 AS is_template FROM m GROUP BY cluster HAVING count(*) >= 2""")
def template_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("id", "embedding", F.col("label").cast("string").alias("text"), F.array(F.lit("meme")).alias("tags"))
    return similar.clusters(rows, PAIR).select("cluster", "size", "distinct_texts", "is_template")


@query(f"""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 3),
p AS (SELECT i.vec_id AS id, s.vec_id AS source, list_dot_product(i.embedding::DOUBLE[], s.e) AS score FROM embeddings i JOIN s ON i.vec_id <> s.vec_id WHERE i.label <> 0),
b AS (SELECT id, source, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, source) AS r FROM p WHERE score >= 0.2)
SELECT id, source, 'primary' AS space, round(score, 6) AS score, round(score - 0.2, 6) AS margin FROM b WHERE r = 1 ORDER BY score DESC, id LIMIT 40""")
def propagate_labels(spark: SparkSession, d: str) -> DataFrame:
    """Three labelled items, the rest as candidates; items of label 0 have a durable label already."""
    rows = _vectors(spark, d).select("id", "embedding", F.lit(None).cast("array<float>").alias("visual_embedding"), F.lit("").alias("visual_model"), (F.col("label") == 0).alias("durable"))
    found = similar.propagate(rows.orderBy("id").limit(3), rows, "m", primary=0.2)
    return found.withColumn("score", F.round("score", 6)).withColumn("margin", F.round("margin", 6))


@query("""WITH d AS (SELECT doc_id, lower(trim(text, E' \\t\\n\\r\\f\\x0B')) AS t FROM documents WHERE text <> ''), c AS (SELECT a.doc_id AS id, b.doc_id AS twin FROM d a JOIN d b USING (t) WHERE a.doc_id <> b.doc_id)
SELECT id, max(twin) AS twin FROM c GROUP BY id""")
def twin_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Equal normalised texts; every document has the same unit vector, so the text decides."""
    rows = table(spark, d, "documents").filter("text <> ''").select(F.col("doc_id").alias("id"), F.col("text").alias("ocr_text"), F.array(F.lit(1.0)).alias("embedding"))
    return similar.twins(rows, rows).select("id", "twin")


@query("SELECT min(doc_id) AS first, count(*) AS copies, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b"))
    parts = rows.groupBy("_a", "_b", "source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return parts.groupBy("_a", "_b").agg(F.min("first").alias("first"), F.sum("n").alias("copies"), F.count("*").alias("sources")).filter("copies > 1").select("first", "copies", "sources")


@query(f"""WITH c AS (SELECT label, i AS pos, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), m AS (SELECT label, list(x ORDER BY pos) AS v FROM c GROUP BY label)
SELECT label, round(list_dot_product(v, {B.Q}), 6) AS score FROM m WHERE list_dot_product(v, {B.Q}) >= -1""")
def semantic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label centroids ranked against the query vector."""
    centres = vectors.mean_vector(_vectors(spark, d), "embedding", ("label",)).withColumnRenamed("mean", "vector")
    found = search.semantic_labels(centres, B.query_vector(spark, d), least=-1.0, top=100)
    return found.select("label", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT label, i AS pos, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label)
SELECT label, pos - 1 AS pos, round(x / n.n, 6) AS x FROM c JOIN n USING (label)""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = vectors.mean_pool(_vectors(spark, d), "embedding", ("label",))
    return pooled.select("label", F.posexplode("mean").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


#: BM25 of rows (id, len, and tf of each term t) as SQL, over tables b (id, len), f (id, t, tf) and s (n, mean).
BM25 = """df AS (SELECT t, count(*) AS df FROM f WHERE tf > 0 GROUP BY t), g AS (SELECT id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25
  FROM f JOIN df USING (t) JOIN b USING (id), s WHERE tf > 0 GROUP BY id)"""


@query(f"""WITH {B.ITEMS}, q AS (SELECT {B.TERMS} AS terms), w AS (SELECT id, regexp_extract_all(search_text, '[\\p{{L}}\\p{{N}}]+') AS w FROM items), b AS (SELECT id, len(w) AS len FROM w), s AS (SELECT count(*) AS n, avg(len) AS mean FROM b),
t AS (SELECT DISTINCT unnest(terms) AS t FROM q), f AS (SELECT id, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, t), {BM25},
l AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS lr FROM g), h AS (SELECT id, modified_at, list_dot_product(embedding, {B.Q}) + {B.TAG.format(h=HT)} AS hybrid FROM items, q t),
d AS (SELECT *, row_number() OVER (ORDER BY hybrid DESC, modified_at DESC, id DESC) AS dr FROM h), r AS (SELECT d.*, 1.0::DOUBLE / (60 + dr) + coalesce(2.0::DOUBLE / (60 + lr), 0) AS rrf FROM d LEFT JOIN l USING (id)),
o AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, hybrid DESC, modified_at DESC, id DESC) AS rank FROM r) SELECT id, round(hybrid, 6) AS hybrid_score, round(rrf, 6) AS rrf_score, rank FROM o WHERE rank <= 40""")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """The designed lexical channel: BM25 fused with the vector ranking."""
    return _rounded(search.search(B.items(spark, d), B.query_vector(spark, d), " ".join(B.words(spark, d)), lexical="bm25"))


def _fielded(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of six fields: text, source, first and second turn of the conversation of the same number, language, quality."""
    turn = lambda n, name: table(spark, d, "conversations").filter(F.col("turn") == n).groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("text").alias(name))
    marks = table(spark, d, "labels").select("doc_id", F.concat_ws(" ", F.lit("quality"), F.col("quality")).alias("extra"))
    joined = table(spark, d, "documents").join(turn(0, "caption"), "doc_id", "left").join(turn(1, "transcript"), "doc_id", "left").join(marks, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("id"), F.col("text").alias("ocr"), F.col("source").alias("name"), "caption", "transcript", F.col("lang").alias("tags"), "extra")


FIELDS = ("ocr", "name", "caption", "transcript", "tags", "extra")


@query(f"""WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')[1:4] || ['quality', '0', 'src3']) AS terms FROM benchmark ORDER BY item_id LIMIT 1),
c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL), r AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 10 = 3 THEN '' ELSE d.text END AS f1, source AS f2, a.text AS f3, b.text AS f4, lang AS f5, 'quality ' || quality AS f6 FROM documents d LEFT JOIN c a ON a.conv_id = d.doc_id AND a.turn = 0 LEFT JOIN c b ON b.conv_id = d.doc_id AND b.turn = 1 LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 50 <> 7),
u AS (SELECT id, unnest([f1, f2, f3, f4, f5, f6]) AS x, unnest({list(search.BM25_FIELDS)}) AS weight FROM r), w AS (SELECT id, weight, regexp_extract_all(lower(coalesce(x, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM u), b AS (SELECT id, sum(len(w)) AS len FROM w GROUP BY id), s AS (SELECT count(*) AS n, avg(len) AS mean FROM b),
t AS (SELECT unnest(terms) AS t FROM q), f AS (SELECT id, t, sum(weight * len(list_filter(w, lambda x: x = t)))::DOUBLE AS tf FROM w, t GROUP BY id, t), {BM25}
SELECT id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM g ORDER BY bm25 DESC, id LIMIT 40""")
def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    """Six weighted fields in an index, of which a tenth of the rows is changed and a fiftieth deleted; the best 40 for the first benchmark item's first words and a few marks."""
    items = _fielded(spark, d)
    index = postings.build(items, tables.shared_path(spark, "postings"), FIELDS)
    changed = items.filter("id % 10 = 3").withColumn("ocr", F.lit(""))
    postings.update(index, changed.filter("id % 50 <> 7"), items.filter("id % 50 = 7").select("id"))
    text = table(spark, d, "benchmark").orderBy("item_id").select(F.slice(postings.tokens(F.col("text")), 1, 4).alias("w")).first()
    found = postings.top(index, [*(text.w if text else []), "quality", "0", "src3"], 40)
    return found.select("id", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))
