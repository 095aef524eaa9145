"""Queries over chunks and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text
from siltstone.operators import chunks, ingestion, rag, vector_index, vectors
from siltstone.plans import pipelines
from siltstone.plans.catalog import query, table
from siltstone.sources.snapshots import Snapshots
from siltstone.staging import shared_root


@query()
def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return chunks.chunk(d).select("doc_id", "chunk_index", "total_chunks", "page_content")


def pathed(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    return d.select(
        "doc_id",
        "text",
        F.concat(F.lit("file:///data/"), F.col("source"), F.lit("/parsed/doc.v1-"), i, F.lit(".md")).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://a.example/"), i)).alias("source_url"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://b.example/"), i)).alias("url"),
    )


@query("""WITH d AS (SELECT doc_id, 'file:///data/' || source || '/parsed/doc.v1-' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'https://a.example/' || doc_id END AS s, CASE WHEN doc_id % 2 = 0 THEN 'https://b.example/' || doc_id END AS u FROM documents)
SELECT doc_id, 'doc.v1-' || doc_id AS source_id, path AS source_path, 'doc.v1-' || doc_id || '.md' AS file_name, coalesce(s, u) AS source_url, coalesce(s, u) AS url, coalesce(s, u) AS citation_url FROM d""")
def chunk_metadata(spark, sf_dir):
    return pathed(spark, sf_dir).select("doc_id", chunks.metadata(F.col("path"), F.col("source_url"), F.col("url")).alias("m")).select("doc_id", "m.*")


@query("SELECT doc_id, sha256('/data/' || source || '/parsed/doc.v1-' || doc_id || '.md') || ':' || n AS chunk_id FROM documents, range(3) AS t(n)")
def chunk_ids(spark, sf_dir):
    d = pathed(spark, sf_dir).select("doc_id", "path", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    return d.select("doc_id", chunks.chunk_id(F.col("path"), F.col("n")).alias("chunk_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN text WHEN doc_id % 4 = 2 THEN lang ELSE 'Empty document: ' || doc_id END AS content FROM documents""")
def text_fallback(spark, sf_dir):
    m = F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    c = text.content_text(
        F.col("doc_id").cast("string"),
        F.when(m == 0, F.col("text")).when(m == 1, ""),
        F.when(m == 3, ""),
        F.when((m == 1) & (F.col("doc_id") % 3 == 0), F.col("text")),
        F.when(m == 2, F.col("lang")).when(m == 3, "never"),
        none,
    )
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("content"))


def collection(spark, sf_dir) -> DataFrame:
    """Two waves of chunks over the embeddings: the second changes every third vector's document and adds new ones."""
    e = table(spark, sf_dir, "embeddings")
    first = e.filter("vec_id % 5 <> 4").select(F.concat(F.lit("c:"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("v1 "), F.col("vec_id").cast("string")).alias("page_content"), F.lit(1).alias("version"))
    second = e.filter("vec_id % 3 = 0 or vec_id % 5 = 4").select(F.concat(F.lit("c:"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("v2 "), F.col("vec_id").cast("string")).alias("page_content"), F.lit(2).alias("version"))
    return vectors.upsert(first, second).select(
        "*",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://a.example/"), F.col("id").cast("string"))).alias("source_url"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://b.example/"), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "").alias("url"),
        F.lit(None).cast("string").alias("citation_url"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("Title "), F.col("id").cast("string"))).alias("title"),
    )


_COLLECTION_SQL = """
col AS (SELECT 'c:' || vec_id AS chunk_id, vec_id AS id, embedding, CASE WHEN vec_id % 3 = 0 OR vec_id % 5 = 4 THEN 'v2 ' ELSE 'v1 ' END || vec_id AS page_content, CASE WHEN vec_id % 3 = 0 OR vec_id % 5 = 4 THEN 2 ELSE 1 END AS version,
 CASE WHEN vec_id % 2 = 0 THEN 'https://a.example/' || vec_id END AS source_url, CASE WHEN vec_id % 3 = 0 THEN 'https://b.example/' || vec_id WHEN vec_id % 3 = 1 THEN '' END AS url, CASE WHEN vec_id % 4 <> 0 THEN 'Title ' || vec_id END AS title FROM embeddings)
"""


@query(f"WITH {_COLLECTION_SQL} SELECT chunk_id, page_content, version FROM col")
def vector_upsert(spark, sf_dir):
    return collection(spark, sf_dir).select("chunk_id", "page_content", "version")


@query(f"WITH {_COLLECTION_SQL} SELECT chunk_id, page_content, coalesce(source_url, url) AS citation_url FROM col WHERE chunk_id = 'c:12'")
def vector_get(spark, sf_dir):
    return vectors.get(collection(spark, sf_dir), "c:12").select("chunk_id", "page_content", "citation_url")


def _knn_sql(distance: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id AS id, round({distance}, 6) AS distance FROM q, embeddings)
SELECT query_id, id, distance, CAST(row_number() OVER w AS INTEGER) AS rank FROM p WINDOW w AS (PARTITION BY query_id ORDER BY distance, id) QUALIFY row_number() OVER w <= 5"""


def nearest(spark, sf_dir, metric: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.top_k(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), 5, metric)


@query(_knn_sql("list_distance(a, CAST(embedding AS DOUBLE[]))"))
def knn_l2(spark, sf_dir):
    return nearest(spark, sf_dir, "l2")


@query(_knn_sql("1 - list_cosine_similarity(a, CAST(embedding AS DOUBLE[]))"))
def knn_cosine(spark, sf_dir):
    return nearest(spark, sf_dir, "cosine")


def indexed(spark, sf_dir, metric: str) -> DataFrame:
    """The same through the index, which leaves cells out."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, metric, "vec_id")
    return vector_index.search(index, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))[0]


@query(_knn_sql("list_distance(a, CAST(embedding AS DOUBLE[]))"))
def knn_index_l2(spark, sf_dir):
    return indexed(spark, sf_dir, "l2")


@query(_knn_sql("1 - list_cosine_similarity(a, CAST(embedding AS DOUBLE[]))"))
def knn_index_cosine(spark, sf_dir):
    return indexed(spark, sf_dir, "cosine")


_HITS_SQL = f"""WITH {_COLLECTION_SQL}, hits AS (SELECT r.query_id, r.rank, col.* FROM ({_knn_sql('list_distance(a, CAST(embedding AS DOUBLE[]))')}) r JOIN col ON col.id = r.id)"""


def hits(spark, sf_dir) -> DataFrame:
    return nearest(spark, sf_dir, "l2").join(collection(spark, sf_dir).drop("embedding"), "id")


@query(_HITS_SQL + """SELECT query_id, string_agg(CASE WHEN coalesce(source_url, url, '') <> '' THEN 'Source: ' || coalesce(source_url, url) || chr(10) || page_content ELSE page_content END, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id""")
def context(spark, sf_dir):
    return rag.contexts(hits(spark, sf_dir)).select("query_id", "context")


@query(_HITS_SQL + """SELECT query_id, string_agg('### ' || coalesce(title, 'Document ' || rank) || chr(10) || '**Source**: ' || coalesce(source_url, url, 'Unknown source') || chr(10) || chr(10) || page_content || chr(10) || chr(10), chr(10) ORDER BY rank) AS display FROM hits GROUP BY query_id""")
def display(spark, sf_dir):
    return rag.contexts(hits(spark, sf_dir)).select("query_id", "display")


@query(_HITS_SQL + """SELECT query_id, CAST(rank AS INTEGER) AS rank, coalesce(nullif(source_url, ''), nullif(url, ''), 'Unknown source') AS source, coalesce(title, 'Untitled source') AS title, substr(page_content, 1, 280) AS snippet FROM hits""")
def citation(spark, sf_dir):
    c = text.citation(F.col("citation_url"), F.col("source_url"), F.col("url"), F.col("title"), F.col("page_content"))
    return hits(spark, sf_dir).select("query_id", "rank", c.alias("c")).select("query_id", "rank", "c.source", "c.title", "c.snippet")


@query("""WITH q AS (SELECT vec_id AS query_id, label AS ql, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query_id, ql, vec_id AS id, label, round(1 - list_cosine_similarity(a, CAST(embedding AS DOUBLE[])), 6) AS distance FROM q, embeddings WHERE vec_id <> query_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM p) SELECT count(DISTINCT query_id) AS questions, count(DISTINCT CASE WHEN label = ql THEN query_id END) AS hit FROM t WHERE r <= 4""")
def retrieval_eval(spark, sf_dir):
    """Questions with at least one relevant vector (same label) among the first four others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    n = nearest(spark, sf_dir, "cosine").filter("query_id <> id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("r <= 4")
    j = n.join(e, "id").join(e.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return j.agg(F.countDistinct("query_id").alias("questions"), F.countDistinct(F.when(F.col("label") == F.col("ql"), F.col("query_id"))).alias("hit"))


@query()
def answer_events(spark, sf_dir):
    """Benchmark texts as questions against chunks of the documents: routed, retrieved, prompted and answered as ordered events."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    c = chunks.chunk(d).select((F.shiftleft("doc_id", 26) + F.col("chunk_index")).alias("id"), "page_content", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("citation_url"), F.lit(None).cast("string").alias("title"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("message"), F.lit("auto").alias("preferred"))
    return rag.events(rag.answer(q, vectors.embed(c), base_prompt="Answer from the reference data."))


@query(
    """WITH d AS (SELECT doc_id, 'file:///data/' || source || '/' || doc_id || '.md' AS path, text, doc_id % 5 <> 4 AS first, doc_id % 7 <> 0 AS later, doc_id % 3 = 0 AS edited FROM documents)
SELECT path, CASE WHEN first AND NOT later THEN 'dropped' WHEN NOT first THEN 'added' WHEN edited THEN 'changed' ELSE 'unchanged' END AS change,
 later AS held, CASE WHEN later THEN sha256(CASE WHEN edited OR NOT first THEN 'second ' || text ELSE text END) ELSE sha256(text) END AS content_hash, NOT later AS deleted FROM d WHERE first OR later"""
)
def ingest_delta(spark, sf_dir):
    """Two runs over documents as files: what the second finds added, changed, dropped and unchanged, and what collection and ledger hold then."""
    root = f"{shared_root(spark).rstrip('/')}/siltstone-ingest-{uuid.uuid4().hex}"
    held, ledger = (Snapshots(spark, f"{root}/{name}", T.StructType.fromDDL(ddl)) for name, ddl in (("chunks", ingestion.CHUNKS), ("ledger", ingestion.LEDGER)))
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("file:///data/"), "source", F.lit("/"), i.cast("string"), F.lit(".md")).alias("path"))
    small = vectors.hashing_embedder(8)

    def run(files, day):
        return pipelines.ingest_changes(files, held, ledger, F.lit(f"2026-08-{day} 00:00:00").cast("timestamp"), embedder=small, model="hashing-8")

    run(d.filter(i % 5 != 4).select("path", F.col("text").alias("raw")), "01")
    edited = (i % 3 == 0) | (i % 5 == 4)
    second = run(d.filter(i % 7 != 0).select("path", F.when(edited, F.concat(F.lit("second "), "text")).otherwise(F.col("text")).alias("raw")), "02")
    kept = held.read().select(F.col("source_path").alias("path")).distinct().withColumn("held", F.lit(True))
    rows = ledger.read().select("path", "content_hash", F.col("deleted_at").isNotNull().alias("deleted"))
    return second.select("path", "change").join(kept, "path", "left").join(rows, "path", "left").select("path", "change", F.coalesce("held", F.lit(False)).alias("held"), "content_hash", "deleted")
