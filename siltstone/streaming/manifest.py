"""Discovery and manifest merge as a stream: each micro-batch becomes one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import discovery, manifest
from siltstone.sources.snapshots import Snapshots
from siltstone.staging import staged

READERS = 3600  # seconds that a version stays after the next one


def discovered(raw: DataFrame, allowed_domains=(), exclude=()) -> DataFrame:
    """Discovery rows (site_name, source_url, source, lastmod, seen_at) with key, scope and ordinal; stateless, so it streams."""
    scored = discovery.with_scope(raw.withColumn("canonical_url", urls.canonicalize(F.col("source_url"))), "source_url", allowed_domains, exclude)
    return scored.withColumn("ordinal", F.unix_micros("seen_at"))


def merge_stream(raw: DataFrame, snapshots: Snapshots, checkpoint: str, allowed_domains=(), exclude=(), **trigger):
    """Start the query; a batch that is run again after a crash merges to the same manifest, as the merge is idempotent.

    With ``BucketedSnapshots`` a batch reads and writes only the buckets that its URLs are in.  Old versions stay for an
    hour, for those who read them.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        fresh = staged(manifest.collapse(batch), "batch")
        snapshots.update(lambda held: manifest.upsert(held, fresh), touching=fresh)
        snapshots.expire(older_than_seconds=READERS)

    return discovered(raw, allowed_domains, exclude).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fetch_rates(attempts: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Attempts by time window and status, from ``ts, status``; rows later than the watermark are left out."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))
