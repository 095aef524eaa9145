"""Which files have to be chunked and embedded again, and what their chunks are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import chunks
from siltstone.sources import markdown

SPLITTER = "1"  # raised whenever the splitter cuts differently
LEDGER = "path string, content_hash string, version string, chunks int, ingested_at timestamp, deleted_at timestamp"
CHUNKS = "chunk_id string, page_content string, source_id string, source_path string, file_name string, source_url string, url string, citation_url string, title string, head map<string,string>, chunk_index int, total_chunks int, embedding array<float>"


def version_of(size: int, overlap: int, model: str) -> str:
    """What a file's chunks depend on besides its content."""
    return f"{SPLITTER}:{size}:{overlap}:{model}"


def changes(files: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """``path, content_hash, change`` of every file and ledger row: added, changed, unchanged, or dropped.

    ``files``: path, content_hash.  A file that comes again after it was dropped is added; one whose chunks were made by
    another version is changed; ledger rows of files dropped before aren't mentioned again.
    """
    old = ledger.filter("deleted_at is null").select("path", F.col("content_hash").alias("old_hash"), F.col("version").alias("old_version"))
    j = files.select("path", "content_hash").join(old, "path", "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("old_version").eqNullSafe(F.lit(version))
    change = F.when(F.col("content_hash").isNull(), "dropped").when(F.col("old_hash").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return j.select("path", F.coalesce("content_hash", "old_hash").alias("content_hash"), change.alias("change"))


def head_fields(metadata: Column, m: Column) -> Column:
    """All fields of a file's head, with those that ``chunks.metadata`` adds; an own field goes before the head's."""
    names = ("source_id", "source_path", "file_name", "source_url", "url", "citation_url")
    added = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[m[n] for n in names])), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.map_contains_key(added, k)), added)


def chunked(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of files (path, metadata, content, url): the columns of ``CHUNKS`` without the vector."""
    m = chunks.metadata(F.col("path"), F.col("metadata")["source_url"], F.col("url"))
    rows = files.select("path", "content", F.col("metadata")["title"].alias("title"), "metadata", m.alias("m"))
    rows = chunks.chunk(rows.select("path", "content", "title", "m", head_fields(F.col("metadata"), F.col("m")).alias("head")), size=size, overlap=overlap)
    return rows.select(chunks.chunk_id(F.col("path"), F.col("chunk_index")).alias("chunk_id"), "page_content", "m.*", "title", "head", "chunk_index", "total_chunks")


def parsed(files: DataFrame) -> DataFrame:
    """Files (path, raw) with metadata, content and url; those without content are left out."""
    return markdown.with_url(files.select("path", markdown.parse(F.col("raw")).alias("p")).select("path", "p.*")).filter("content <> ''")


def recorded(ledger: DataFrame, plan: DataFrame, counts: DataFrame, version: str, now: Column) -> DataFrame:
    """The ledger after a run: files that were taken in get their new row, dropped ones a mark, others stay as they are."""
    touched = plan.filter("change <> 'unchanged'")
    gone = F.col("change") == "dropped"
    held = ledger.join(touched.filter("change <> 'dropped'").select("path"), "path", "left_anti").join(touched.filter(gone).select("path", F.lit(True).alias("gone")), "path", "left")
    kept = held.select("path", "content_hash", "version", F.when(F.col("gone"), 0).otherwise(F.col("chunks")).cast("int").alias("chunks"), "ingested_at", F.when(F.col("gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")).alias("deleted_at"))
    fresh = touched.filter(~gone).join(counts, "path", "left").select("path", "content_hash", F.lit(version).alias("version"), F.coalesce("chunks", F.lit(0)).cast("int").alias("chunks"), now.alias("ingested_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return kept.unionByName(fresh)
