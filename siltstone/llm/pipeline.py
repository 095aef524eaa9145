"""Training-corpus pipeline over ``documents``: five stages, each one operator of this subpackage.

Each stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents`` for the rows it keeps; the last
returns packed pieces.  Quality models and tokenizers aren't SQL, so there is no oracle; ``tests/llm`` holds the stages
against brute force.

Decisions are made on ids, digests and statistics; a stage then takes out the rows that go by an anti-join, which moves
no text while the keys of these rows are few enough to be sent to all executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import ids_repeat, staged, table
from siltstone.llm.decontaminate import contamination
from siltstone.llm.exact_dedup import exact_duplicates
from siltstone.llm.near_copies import copies_to_drop, few, row_key
from siltstone.llm.packing import pack
from siltstone.llm.quality import fit_quality, measure, score_column

ORACLE_SQL = None


def _each_once(docs: DataFrame) -> DataFrame:
    """Of rows with the same id and text one."""
    return docs.dropDuplicates(["doc_id", "text"]) if ids_repeat(docs) else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least one half; repeated rows are judged alike, null texts as empty ones.

    Statistics are worked out once, written beside the rows, and read for both the fit and the scores.
    """
    measured = staged(measure(docs, keep=docs.columns, name="__x"), "measured")
    model = fit_quality(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__x").alias("x")), table(spark, sf_dir, "labels"))
    return measured.filter(score_column(model)("__x") >= 0.5).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest id; null ids go first, and of repeated rows one stays."""
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    gone = exact_duplicates(docs, keep="max").filter("not kept and not (doc_id <=> keep_id)").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    gone = few(staged(gone, "copies"))
    return _each_once(docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text == gone["__sha"]), "left_anti"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs with a Jaccard similarity of five-word shingles of at least 0.8 connect, the row with the smallest id.

    Links come from op9's operator, SimHash fingerprints of all rows in vantage-point trees, and are held against the
    shingles; an exact join finds those between fingerprints that lie further apart.
    Rows are told apart by id and text; null and empty texts are alike; a null id counts as the largest; of repeated
    rows one stays.
    """
    gone = few(copies_to_drop(docs).select(F.col("key").alias("__key"), F.col("doc_id").alias("__id")))
    return _each_once(docs.join(gone, (row_key() == gone["__key"]) & docs["doc_id"].cast("long").eqNullSafe(gone["__id"]), "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs; the others go whole.

    Null and empty texts stay; repeated rows are judged alike and all stay or go; with an empty benchmark all rows stay.
    """
    hit = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    hit = few(staged(hit, "hit"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (key == hit["__key"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids; null and empty texts have the end id alone, repeated rows are one document."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again.  Null texts are empty ones, of which one stays; repeated rows are one document; an empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
