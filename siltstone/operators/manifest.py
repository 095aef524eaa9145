"""The URL manifest: one row for each site and canonical URL, merged in sets instead of row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("site_name", "canonical_url")
SCHEMA = T.StructType(
    [
        T.StructField("site_name", T.StringType(), False),
        T.StructField("canonical_url", T.StringType(), False),
        T.StructField("source_url", T.StringType()),
        T.StructField("discovery_source", T.ArrayType(T.StringType())),
        T.StructField("sitemap_lastmod", T.TimestampType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("scope_status", T.StringType()),
        T.StructField("scope_reason", T.StringType()),
        T.StructField("fetch_status", T.StringType()),
        T.StructField("last_attempt_at", T.TimestampType()),
        T.StructField("retry_after", T.TimestampType()),
        T.StructField("last_rendered_at", T.TimestampType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("extractor_version", T.StringType()),
        T.StructField("content_length", T.IntegerType()),
        T.StructField("validation_status", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("last_ingested_at", T.TimestampType()),
        T.StructField("cache_status", T.StringType()),
    ]
)
# What discovery doesn't touch.
RENDERED = [f.name for f in SCHEMA.fields[9:]]


def conform(df: DataFrame, *more: str) -> DataFrame:
    """All manifest columns in order, and ``more``; those an older snapshot lacks get their defaults."""
    defaults = {"retry_count": F.lit(0), "discovery_source": F.array().cast("array<string>")}
    return df.select(*[(F.col(f.name) if f.name in df.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in SCHEMA.fields], *more)


def _union(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def collapse(discovered: DataFrame) -> DataFrame:
    """One row for each key of ``discovered`` (site_name, canonical_url, source_url, source, lastmod, scope_status, scope_reason, seen_at, ordinal).

    The last occurrence gives the source URL and the scope, the last one with a lastmod gives that; sources are a set.
    """
    last = F.max_by(F.struct("source_url", "scope_status", "scope_reason"), "ordinal")
    return (
        discovered.groupBy(*KEY)
        .agg(
            last.alias("l"),
            F.array_sort(F.collect_set("source")).alias("discovery_source"),
            F.max_by("lastmod", F.when(F.col("lastmod").isNotNull(), F.col("ordinal"))).alias("sitemap_lastmod"),
            F.min("seen_at").alias("first_seen_at"),
            F.max("seen_at").alias("last_seen_at"),
        )
        .select(*KEY, F.col("l.source_url").alias("source_url"), "discovery_source", "sitemap_lastmod", "first_seen_at", "last_seen_at", F.col("l.scope_status").alias("scope_status"), F.col("l.scope_reason").alias("scope_reason"))
    )


def upsert(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge collapsed discoveries: render state stays, scope and source URL come from the new row, times widen."""
    m, n = conform(manifest).alias("m"), conform(incoming).alias("n")
    is_new, is_old = F.col("n.canonical_url").isNotNull(), F.col("m.canonical_url").isNotNull()

    def pick(name: str) -> Column:
        old, new = F.col(f"m.{name}"), F.col(f"n.{name}")
        if name in KEY or name == "sitemap_lastmod":
            return F.coalesce(new, old)
        if name in ("source_url", "scope_status", "scope_reason"):
            return F.when(is_new, new).otherwise(old)
        if name == "discovery_source":
            return _union(old, new)
        if name == "first_seen_at":
            return F.when(is_old, old).otherwise(new)
        if name == "last_seen_at":
            return F.greatest(old, new)
        return F.when(is_old, old).otherwise(new)

    return m.join(n, [F.col(f"m.{k}") == F.col(f"n.{k}") for k in KEY], "full_outer").select(*[pick(f.name).alias(f.name) for f in SCHEMA.fields])


def save(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Records replace those with their key, word for word."""
    fresh = conform(records)
    return conform(manifest).join(fresh.select(*KEY), list(KEY), "left_anti").unionByName(fresh)


def rekey(manifest: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves``: whole records under their new key, with ``old_url``.  The old row goes; a row that already had the new key is merged in.

    Several moves to one target merge in the order of their old URLs, the last giving what isn't merged.
    """
    fresh = conform(moves, "old_url")
    rest = [f.name for f in SCHEMA.fields if f.name not in KEY]
    one = fresh.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "old_url").alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("discovery_source")))).alias("s"), F.min("first_seen_at").alias("f"), F.max("last_seen_at").alias("l"))
    target = conform(manifest).select(*KEY, F.col("discovery_source").alias("os"), F.col("first_seen_at").alias("of"), F.col("last_seen_at").alias("ol"))
    merged = one.join(target, list(KEY), "left").select(
        *KEY,
        *[
            (_union(F.col("s"), F.col("os")) if c == "discovery_source" else F.least("f", "of") if c == "first_seen_at" else F.greatest("l", "ol") if c == "last_seen_at" else F.col(f"r.{c}")).alias(c)
            for c in rest
        ],
    )
    gone = moves.select("site_name", F.col("old_url").alias("canonical_url")).unionByName(merged.select(*KEY)).distinct()
    return conform(manifest).join(gone, list(KEY), "left_anti").unionByName(conform(merged))


def get(manifest: DataFrame, site: str, canonical: str) -> DataFrame:
    return manifest.filter((F.col("site_name") == site) & (F.col("canonical_url") == canonical))


def select_rows(manifest: DataFrame, site: str, scope_status: str | None = None, fetch_status: str | None = None) -> DataFrame:
    out = manifest.filter(F.col("site_name") == site)
    if scope_status is not None:
        out = out.filter(F.col("scope_status") == scope_status)
    if fetch_status is not None:
        out = out.filter(F.col("fetch_status") == fetch_status)
    return out


def page(manifest: DataFrame, site: str, after: str | None, limit: int) -> DataFrame:
    """The next eligible rows of a site after a URL, in binary order."""
    out = select_rows(manifest, site, "eligible")
    if after is not None:
        out = out.filter(F.col("canonical_url") > after)
    return out.orderBy("canonical_url").limit(limit)


def coverage(manifest: DataFrame, target: float = 95.0) -> DataFrame:
    """Eligible and current rows of each site, their share in percent (100 where nothing is eligible), and whether it is below the target."""
    eligible = F.count_if(F.col("scope_status") == "eligible")
    current = F.count_if((F.col("scope_status") == "eligible") & (F.col("fetch_status") == "success"))
    out = manifest.groupBy("site_name").agg(eligible.alias("eligible"), current.alias("current"))
    share = F.when(F.col("eligible") == 0, 100.0).otherwise(F.col("current") * 100.0 / F.col("eligible"))
    return out.withColumn("coverage", share).withColumn("below_target", F.col("coverage") < target)
