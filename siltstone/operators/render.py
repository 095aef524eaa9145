"""Due selection and the fold of render results into the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import schedule, text, urls
from siltstone.operators import discovery, manifest
from siltstone.operators import sites as site_settings
from siltstone.staging import staged


def with_decision(records: DataFrame, now: Column, trust_lastmod: Column, audit_days: Column, force: bool = False, retry_when_due: bool = False) -> DataFrame:
    """Adds ``decision`` (mode, reason), null where a record isn't due."""
    names = ("retry_after", "retry_count", "last_rendered_at", "sitemap_lastmod", "extractor_version", "last_attempt_at")
    return records.withColumn("decision", schedule.decide_render({n: F.col(n) for n in names}, now, trust_lastmod, audit_days, F.lit(force), retry_when_due))


def select_due(decided: DataFrame, max_urls: int) -> DataFrame:
    """The first ``max_urls`` due records of each site in URL order, with ``considered``: how many records a paging reader looks at until then.

    The cut is found from the due rows alone; records past it are not counted as considered.
    """
    eligible = decided.filter(F.col("scope_status") == "eligible")
    order = Window.partitionBy("site_name").orderBy("canonical_url")
    due = eligible.filter(F.col("decision").isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_urls)
    cut = due.groupBy("site_name").agg(F.max(F.when(F.col("rank") == max_urls, F.col("canonical_url"))).alias("last"))
    counts = eligible.select("site_name", "canonical_url").join(cut, "site_name").filter(F.col("last").isNull() | (F.col("canonical_url") <= F.col("last"))).groupBy("site_name").agg(F.count("*").alias("considered"))
    return due.join(counts, "site_name")


def outcomes(due: DataFrame, results: DataFrame, now: Column, allowed_domains=(), exclude=(), minimum_length: int = 100, sites: DataFrame | None = None) -> DataFrame:
    """Join due records with their results and name each one's outcome.

    ``results``: canonical_url, success, exception, status_code, cache_status, fit_markdown, raw_markdown, meta_url,
    url, title, and the same with ``fallback_`` for the second attempt.  Adds ``outcome`` (failure, confirmed,
    unconfirmed, saved or rekeyed), the counters' flags, and the chosen ``markdown``, ``final_url``, ``new_canonical``.
    With ``sites`` (see ``config.Registry.table``) the scope and the least length are those of each record's site;
    results may then have a site_name too.
    """
    least = F.lit(minimum_length)
    if sites is not None:
        own = sites.select("site_name", F.col("allowed_domains").alias("__d"), F.col("exclude_regexes").alias("__p"), F.col("minimum_content_length").alias("__m"))
        due, least = due.join(own, "site_name"), F.col("d.__m")
    d, r = due.alias("d"), results.alias("r")
    on = F.col("d.canonical_url") == F.col("r.canonical_url")
    j = d.join(r, on & (F.col("d.site_name") == F.col("r.site_name")) if sites is not None and "site_name" in results.columns else on, "left")
    first = text.markdown_choice(F.col("r.fit_markdown"), F.col("r.raw_markdown"))
    second = text.markdown_choice(F.col("r.fallback_fit_markdown"), F.col("r.fallback_raw_markdown"))
    raised = F.col("r.canonical_url").isNull() | F.coalesce("r.exception", F.lit(False))
    failed = ~raised & ~F.coalesce("r.success", F.lit(False))
    fetched = ~raised & ~failed
    status = F.coalesce("r.cache_status", F.lit("miss"))
    confirmed, unconfirmed = fetched & (status == "hit_validated"), fetched & (status == "hit_fallback")
    fresh = fetched & ~status.isin("hit_validated", "hit_fallback")
    long_enough = F.length(text.strip(first)) >= least
    recovered = fresh & ~long_enough & F.coalesce("r.fallback_success", F.lit(False)) & (F.length(text.strip(second)) >= least)
    candidate = (fresh & long_enough) | recovered
    markdown = F.when(recovered, second).when(candidate, first)

    def chosen(name: str) -> Column:
        return F.when(recovered, F.col(f"r.fallback_{name}")).otherwise(F.col(f"r.{name}"))

    final = F.coalesce(F.nullif(chosen("meta_url"), F.lit("")), chosen("url"), F.col("d.source_url"))
    j = j.select("d.*", *[x.alias(n) for n, x in (("raised", raised), ("failed_fetch", failed), ("confirmed", confirmed), ("unconfirmed", unconfirmed), ("low_quality", fresh & ~long_enough), ("candidate", candidate), ("markdown", markdown), ("final_url", final), ("new_title", F.coalesce(F.nullif(chosen("title"), F.lit("")), F.lit("Untitled document"))), ("status_code", F.col("r.status_code")), ("result_cache_status", F.col("r.cache_status")))])
    j = j.withColumn("new_canonical", urls.canonicalize(F.col("final_url")))
    moved = F.col("candidate") & (F.col("new_canonical") != F.col("canonical_url"))
    reason = discovery.scope_reason(F.col("final_url"), allowed_domains, exclude) if sites is None else site_settings.scope_reason(F.col("final_url"), F.col("__d"), F.col("__p"))
    outside = moved & reason.isNotNull()
    outcome = F.when(F.col("confirmed"), "confirmed").when(F.col("unconfirmed"), "unconfirmed").when(outside, "failure").when(moved, "rekeyed").when(F.col("candidate"), "saved").otherwise("failure")
    j = j.withColumn("outcome", outcome).withColumn("retry", F.when(F.col("outcome").isin("failure", "unconfirmed"), schedule.next_retry(F.col("retry_count"), now)))
    return (
        j.withColumn("c_rendered", ~F.col("raised"))
        .withColumn("c_failed", (F.col("outcome") == "failure") & ~F.col("raised"))
        .withColumn("c_low_quality", F.col("low_quality"))
        .withColumn("c_saved", F.col("outcome").isin("saved", "rekeyed"))
        .withColumn("c_retried", F.coalesce("retry.counted", F.lit(False)))
        .drop("__d", "__p", "__m")
    )


def fold(outcome_rows: DataFrame, now: Column, bump_version_on_confirm: bool = False) -> DataFrame:
    """Outcome rows as whole manifest records, with ``old_url`` where the key changed."""
    o = F.col("outcome")
    good = o.isin("saved", "rekeyed")
    retrying = o.isin("failure", "unconfirmed")
    new = {
        "canonical_url": F.when(good, F.col("new_canonical")).otherwise(F.col("canonical_url")),
        "source_url": F.when(good, F.col("final_url")).otherwise(F.col("source_url")),
        "fetch_status": F.when(o == "failure", "failed").when(o == "unconfirmed", F.col("fetch_status")).otherwise("success"),
        "last_attempt_at": now,
        "retry_count": F.when(retrying, F.col("retry.retry_count")).otherwise(0),
        "retry_after": F.when(retrying, F.col("retry.retry_after")),
        "last_rendered_at": F.when(good, now).otherwise(F.col("last_rendered_at")),
        "content_hash": F.when(good, F.sha2("markdown", 256)).otherwise(F.col("content_hash")),
        "content_length": F.when(good, F.length("markdown")).otherwise(F.col("content_length")),
        "title": F.when(good, F.col("new_title")).otherwise(F.col("title")),
        "extractor_version": F.when(good | ((o == "confirmed") & F.lit(bump_version_on_confirm)), schedule.EXTRACTOR_VERSION).otherwise(F.col("extractor_version")),
        "validation_status": F.when(good, "rendered").when(o == "confirmed", "confirmed").when(o == "unconfirmed", "unconfirmed").otherwise(F.col("validation_status")),
    }
    fields = [(new.get(f.name, F.col(f.name))).cast(f.dataType).alias(f.name) for f in manifest.SCHEMA.fields]
    return outcome_rows.select(*fields, F.when(o == "rekeyed", F.col("canonical_url")).alias("old_url"))


def apply(current: DataFrame, outcome_rows: DataFrame, now: Column) -> DataFrame:
    """The manifest after a run: records replaced, redirected ones moved and merged."""
    folded = staged(fold(outcome_rows, now), "folded")
    kept = manifest.save(current, folded.filter("old_url is null").drop("old_url"))
    return manifest.rekey(kept, folded.filter("old_url is not null"))


def counters(outcome_rows: DataFrame, by=()) -> DataFrame:
    names = ("rendered", "saved", "low_quality", "failed", "retried")
    return outcome_rows.groupBy(*by).agg(*[F.count_if(F.col(f"c_{n}")).alias(n) for n in names])


def skipped(decided: DataFrame, max_urls: int) -> DataFrame:
    """``site_name, skipped``: eligible records that weren't due, of those a run looks at until it has ``max_urls`` due ones."""
    due = select_due(decided, max_urls).groupBy("site_name").agg(F.count("*").alias("taken"), F.max("considered").alias("considered"))
    sites = decided.filter(F.col("scope_status") == "eligible").groupBy("site_name").agg(F.count("*").alias("n"))
    return sites.join(due, "site_name", "left").select("site_name", F.coalesce(F.col("considered") - F.col("taken"), F.col("n")).alias("skipped"))


def histograms(outcome_rows: DataFrame) -> DataFrame:
    """``kind, value, n``: HTTP statuses and cache states of first attempts."""
    http = outcome_rows.filter("status_code is not null").select(F.lit("http").alias("kind"), F.col("status_code").cast("string").alias("value"))
    cache = outcome_rows.filter("result_cache_status <> ''").select(F.lit("cache").alias("kind"), F.col("result_cache_status").alias("value"))
    return http.unionByName(cache).groupBy("kind", "value").agg(F.count("*").alias("n"))
