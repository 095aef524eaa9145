"""Queries over the render cycle: due records, outcomes, counters, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import schedule, text, urls
from siltstone.operators import extract, manifest, render
from siltstone.plans.catalog import query, table
from siltstone.sources import markdown

NOW = "2024-02-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# A manifest from events: one record for each user, its state from arithmetic on the last event.
_STATE_SQL = """
st AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(ts) AS last_ts, count(*) FILTER (event_type = 'error') AS errors, max(event_id) AS e FROM events GROUP BY user_id),
mf AS (SELECT 'site' || (user_id % 5) AS site_name, 'https://example.org/' || user_id AS canonical_url, user_id,
 CASE WHEN user_id % 7 = 0 THEN NULL ELSE last_ts END AS last_rendered_at, CASE WHEN user_id % 3 = 0 THEN NULL ELSE last_ts + INTERVAL 1 HOUR END AS last_attempt_at,
 CAST(errors % 8 AS INTEGER) AS retry_count, CASE WHEN kind = 'error' THEN TIMESTAMP '2024-02-15' + to_hours(CAST(user_id % 5 - 2 AS INTEGER)) ELSE NULL END AS retry_after,
 CASE WHEN user_id % 4 = 0 THEN last_ts + INTERVAL 2 DAY ELSE NULL END AS sitemap_lastmod, CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '2' END AS extractor_version,
 CASE WHEN user_id % 11 = 0 THEN 'excluded' ELSE 'eligible' END AS scope_status, CASE WHEN user_id % 2 = 0 THEN 'success' ELSE 'failed' END AS fetch_status FROM st),
dec AS (SELECT *, CASE WHEN retry_after > TIMESTAMP '2024-02-15' THEN NULL WHEN retry_count > 5 AND last_rendered_at IS NULL THEN NULL
 WHEN last_rendered_at IS NULL THEN 'initial_backfill' WHEN site_name <> 'site1' AND sitemap_lastmod > last_rendered_at THEN 'lastmod_changed'
 WHEN extractor_version IS DISTINCT FROM '2' THEN 'extractor_version_stale' WHEN TIMESTAMP '2024-02-15' >= coalesce(last_attempt_at, last_rendered_at) + INTERVAL 15 DAY THEN 'scheduled_audit' END AS reason FROM mf)
"""


def state(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u = F.col("user_id")
    st = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"), F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("errors"))

    def plus(seconds):
        return F.timestamp_micros(F.unix_micros("last_ts") + F.lit(seconds * 1_000_000))

    return st.select(
        F.concat(F.lit("site"), (u % 5).cast("string")).alias("site_name"),
        F.concat(F.lit("https://example.org/"), u.cast("string")).alias("canonical_url"),
        F.concat(F.lit("https://example.org/"), u.cast("string")).alias("source_url"),
        "user_id",
        F.when(u % 7 != 0, F.col("last_ts")).alias("last_rendered_at"),
        F.when(u % 3 != 0, plus(3600)).alias("last_attempt_at"),
        (F.col("errors") % 8).cast("int").alias("retry_count"),
        F.when(F.col("kind") == "error", F.timestamp_seconds(F.unix_timestamp(now()) + (u % 5 - 2) * 3600)).alias("retry_after"),
        F.when(u % 4 == 0, plus(2 * 86400)).alias("sitemap_lastmod"),
        F.when(u % 6 == 0, F.lit(None)).when(u % 6 == 1, "1").otherwise("2").alias("extractor_version"),
        F.when(u % 11 == 0, "excluded").otherwise("eligible").alias("scope_status"),
        F.when(u % 2 == 0, "success").otherwise("failed").alias("fetch_status"),
    )


def decided(spark, sf_dir) -> DataFrame:
    return render.with_decision(state(spark, sf_dir), now(), F.col("site_name") != "site1", F.lit(15))


@query(f"WITH {_STATE_SQL} SELECT user_id, reason, CASE WHEN reason IN ('initial_backfill', 'lastmod_changed') THEN 'write_only' WHEN reason IS NOT NULL THEN 'enabled' END AS mode FROM dec")
def decide_render(spark, sf_dir):
    return decided(spark, sf_dir).select("user_id", "decision.reason", "decision.mode")


@query(
    f"WITH {_STATE_SQL}"
    + """, due AS (SELECT *, row_number() OVER (PARTITION BY site_name ORDER BY canonical_url) AS rank FROM dec WHERE reason IS NOT NULL AND scope_status = 'eligible'),
 cut AS (SELECT site_name, max(canonical_url) FILTER (rank = 4) AS last FROM due WHERE rank <= 4 GROUP BY site_name),
 n AS (SELECT dec.site_name, count(*) AS considered FROM dec JOIN cut USING (site_name) WHERE scope_status = 'eligible' AND (last IS NULL OR canonical_url <= last) GROUP BY 1)
 SELECT due.site_name, canonical_url, CAST(rank AS INTEGER) AS rank, considered FROM due JOIN n USING (site_name) WHERE rank <= 4"""
)
def select_due(spark, sf_dir):
    return render.select_due(decided(spark, sf_dir), 4).select("site_name", "canonical_url", "rank", "considered")


@query("""WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY user_id)
SELECT user_id, CAST(n % 8 + 1 AS INTEGER) AS retry_count, n % 8 + 1 <= 5 AS counted, CASE WHEN n % 8 + 1 <= 5 THEN CAST(epoch(TIMESTAMP '2024-02-15') AS BIGINT) + CAST(least(3600 * 2 ** (n % 8 + 1), 86400) AS BIGINT) END AS retry_at FROM e""")
def retry_backoff(spark, sf_dir):
    n = schedule.next_retry(F.col("retry_count"), now())
    return state(spark, sf_dir).withColumn("r", n).select("user_id", "r.retry_count", "r.counted", F.unix_timestamp("r.retry_after").alias("retry_at"))


# Render results, by arithmetic on the user; every branch of the outcome table occurs.
_RESULT_SQL = (
    f"WITH {_STATE_SQL}"
    + """, res AS (SELECT *, user_id % 13 AS k FROM dec WHERE reason IS NOT NULL AND scope_status = 'eligible'),
 o AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'failure' WHEN k = 2 THEN 'confirmed' WHEN k = 3 THEN 'unconfirmed' WHEN k = 4 THEN 'failure' WHEN k = 5 THEN 'saved' WHEN k = 6 THEN 'failure' WHEN k = 7 THEN 'rekeyed' WHEN k = 8 THEN 'failure' ELSE 'saved' END AS outcome FROM res)
"""
)


def results(spark, sf_dir) -> DataFrame:
    """0 raised; 1 failed; 2 and 3 validated or fallen back on; 4 too short twice; 5 short, then long; 6 moved out of scope; 7 moved; 8 no result; others plain."""
    k = F.col("user_id") % 13
    long, short = F.repeat(F.lit("Useful content "), 20), F.lit(" thin ")
    here = F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string"))
    base = state(spark, sf_dir).select("user_id", "canonical_url").filter(k != 8)
    return base.select(
        "canonical_url",
        (k > 1).alias("success"),
        (k == 0).alias("exception"),
        F.when(k == 0, F.lit(None)).when(k == 1, 503).otherwise(200).alias("status_code"),
        F.when(k == 2, "hit_validated").when(k == 3, "hit_fallback").when(k == 9, "").when(k > 3, "miss").alias("cache_status"),
        F.when(k.isin(4, 5), short).when(k == 10, "  \n").otherwise(long).alias("fit_markdown"),
        F.when(k == 10, long).otherwise("").alias("raw_markdown"),
        F.when(k == 6, "https://elsewhere.example/x").when(k == 7, "https://EXAMPLE.org/moved?utm_source=a").when(k == 11, "").alias("meta_url"),
        here.alias("url"),
        F.when(k == 12, "").otherwise("Title").alias("title"),
        (k == 5).alias("fallback_success"),
        F.when(k == 5, long).otherwise(short).alias("fallback_fit_markdown"),
        F.lit("").alias("fallback_raw_markdown"),
        F.lit("").alias("fallback_meta_url"),
        here.alias("fallback_url"),
        F.lit("Again").alias("fallback_title"),
    )


def rendered(spark, sf_dir) -> DataFrame:
    due = manifest.conform(decided(spark, sf_dir).filter("decision is not null and scope_status = 'eligible'"), "user_id")
    return render.outcomes(due, results(spark, sf_dir), now(), ["example.org"])


@query(_RESULT_SQL + "SELECT user_id, outcome FROM o")
def render_outcome(spark, sf_dir):
    return rendered(spark, sf_dir).select("user_id", "outcome")


@query(
    _RESULT_SQL
    + """SELECT site_name, count(*) FILTER (k NOT IN (0, 8)) AS rendered, count(*) FILTER (outcome IN ('saved', 'rekeyed')) AS saved, count(*) FILTER (k IN (4, 5)) AS low_quality,
 count(*) FILTER (outcome = 'failure' AND k NOT IN (0, 8)) AS failed, count(*) FILTER (outcome IN ('failure', 'unconfirmed') AND retry_count + 1 <= 5) AS retried FROM o GROUP BY site_name"""
)
def render_counters(spark, sf_dir):
    return render.counters(rendered(spark, sf_dir), ["site_name"])


@query(
    _RESULT_SQL
    + """SELECT 'http' AS kind, CASE WHEN k = 1 THEN '503' ELSE '200' END AS value, count(*) AS n FROM o WHERE k NOT IN (0, 8) GROUP BY 2
 UNION ALL SELECT 'cache', CASE k WHEN 2 THEN 'hit_validated' WHEN 3 THEN 'hit_fallback' ELSE 'miss' END, count(*) FROM o WHERE k NOT IN (0, 1, 8, 9) GROUP BY 2"""
)
def status_histogram(spark, sf_dir):
    return render.histograms(rendered(spark, sf_dir))


@query(
    _RESULT_SQL
    + """, n AS (SELECT mf.user_id, CASE WHEN o.outcome IN ('failure') THEN 'failed' WHEN o.outcome IN ('saved', 'rekeyed', 'confirmed') THEN 'success' ELSE mf.fetch_status END AS fetch_status, mf.scope_status, mf.site_name, o.outcome FROM mf LEFT JOIN o USING (user_id)),
 a AS (SELECT site_name, scope_status, fetch_status FROM n WHERE outcome IS DISTINCT FROM 'rekeyed' UNION ALL SELECT DISTINCT site_name, scope_status, 'success' FROM n WHERE outcome = 'rekeyed'),
 c AS (SELECT site_name, count(*) FILTER (scope_status = 'eligible') AS eligible, count(*) FILTER (scope_status = 'eligible' AND fetch_status = 'success') AS current FROM a GROUP BY site_name)
 SELECT *, CASE WHEN eligible = 0 THEN 100.0 ELSE CAST(current AS DOUBLE) * 100 / eligible END AS coverage, CASE WHEN eligible = 0 THEN 100.0 ELSE CAST(current AS DOUBLE) * 100 / eligible END < 95 AS below_target FROM c"""
)
def coverage(spark, sf_dir):
    """Coverage after the run's records are folded into the manifest, redirects merged."""
    after = render.apply(state(spark, sf_dir), rendered(spark, sf_dir), now())
    return manifest.coverage(after)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN CASE WHEN lang = 'en' THEN text ELSE '' END ELSE 'raw' END AS m, sha256(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN CASE WHEN lang = 'en' THEN text ELSE '' END ELSE 'raw' END) AS content_hash,
 length(trim(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN CASE WHEN lang = 'en' THEN text ELSE '' END ELSE 'raw' END, ' ' || chr(10) || chr(9) || chr(13))) >= 100 AS passes FROM documents"""
)
def markdown_quality_gate(spark, sf_dir):
    fit = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, " \n\t")
    raw = F.when(F.col("doc_id") % 3 == 1, F.when(F.col("lang") == "en", F.col("text"))).otherwise("raw")
    m = text.markdown_choice(fit, raw)
    return table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", "m", F.sha2("m", 256).alias("content_hash"), (F.length(text.strip(F.col("m"))) >= 100).alias("passes"))


@query()
def html_to_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("e", extract.extracted(F.col("html")))
    return pages.select("page_id", F.col("e.title").alias("title"), F.col("e.markdown").alias("markdown"), F.length("e.markdown").alias("n_chars"))


def artifacts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    fields = {"title": F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "content_hash": F.sha2("text", 256), "language": F.when(F.col("doc_id") % 5 != 0, F.col("lang"))}
    with_source = F.when(F.col("doc_id") % 2 == 0, markdown.render(fields | {"source_url": url}, F.col("text"))).otherwise(markdown.render(fields | {"source_file": F.concat(F.lit("crawled/"), F.col("source"), F.lit("/a.html"))}, F.col("text")))
    return d.select("doc_id", "source", F.concat(F.lit("content/"), F.col("source"), F.lit("/parsed/"), urls.artifact_filename(url)).alias("path"), with_source.alias("raw"), "text")


@query(
    """SELECT doc_id, 'Document ' || doc_id AS title, CASE WHEN doc_id % 5 <> 0 THEN lang END AS language, CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || source || '/' || doc_id ELSE source || '/a.html' END AS url, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM documents"""
)
def frontmatter_parse(spark, sf_dir):
    p = artifacts(spark, sf_dir).select("doc_id", markdown.parse_flat(F.col("raw")).alias("p")).select("doc_id", "p.*")
    return markdown.with_url(p).select("doc_id", F.col("metadata")["title"].alias("title"), F.col("metadata")["language"].alias("language"), "url", "content")


@query("SELECT doc_id, sha256(text) AS content_hash, true AS same FROM documents")
def frontmatter_roundtrip(spark, sf_dir):
    p = artifacts(spark, sf_dir).select("doc_id", "text", markdown.parse(F.col("raw")).alias("p"))
    return p.select("doc_id", F.col("p.metadata")["content_hash"].alias("content_hash"), (F.col("p.content") == text.strip(F.col("text"))).alias("same"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Residence permit: how to apply' WHEN 1 THEN '#1 "quoted" \\ title' WHEN 2 THEN 'yes' WHEN 3 THEN '2026-01-01' WHEN 4 THEN 'it''s {a: [b]} | > & * !' ELSE '' END || CASE WHEN doc_id % 6 = 5 THEN '' ELSE chr(10) || left(text, 40) END AS title FROM documents""")
def frontmatter_quoting(spark, sf_dir):
    """Titles with signs that YAML reads as something else, written and read back by both parsers."""
    i = F.col("doc_id") % 6
    title = F.when(i == 0, "Residence permit: how to apply").when(i == 1, '#1 "quoted" \\ title').when(i == 2, "yes").when(i == 3, "2026-01-01").when(i == 4, "it's {a: [b]} | > & * !").otherwise("")
    title = F.concat(title, F.when(i == 5, "").otherwise(F.concat(F.lit("\n"), F.substring("text", 1, 40))))
    raw = markdown.render({"title": title, "language": F.lit(None).cast("string")}, F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    both = d.select("doc_id", markdown.parse(F.col("raw"))["metadata"]["title"].alias("title"), markdown.parse_flat(F.col("raw"))["metadata"]["title"].alias("flat"))
    return both.select("doc_id", F.when(F.col("title") == F.col("flat"), F.col("title")).alias("title"))


@query("SELECT source AS site, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY source")
def site_filter(spark, sf_dir):
    a = artifacts(spark, sf_dir).withColumn("site", markdown.site_of(F.col("path"), "content"))
    return a.filter("site = 'src1'").groupBy("site").agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT user_id, event_id, ts, event_id % 3 = 0 AS lastmod_changed, CAST(value AS BIGINT) % 4 = 0 AS hash_changed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
 a AS (SELECT user_id, count(*) AS sampled, count(*) FILTER (lastmod_changed) AS changes, count(*) FILTER (lastmod_changed AND hash_changed) AS both_changed, count(*) FILTER (hash_changed) AS hashes FROM o WHERE r > 1 GROUP BY user_id)
 SELECT user_id, sampled, changes, sampled >= 50 AND changes >= 10 AND both_changed >= 0.9 * changes AND both_changed >= 0.9 * hashes AS trusted FROM a"""
)
def lastmod_trust(spark, sf_dir):
    """Whether a source's lastmod may be trusted: at least 50 observations, 10 changes, and 90 percent agreement with content changes both ways."""
    e = table(spark, sf_dir, "events")
    o = e.select("user_id", (F.col("event_id") % 3 == 0).alias("m"), (F.col("value").cast("long") % 4 == 0).alias("h"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("r")).filter("r > 1")
    a = o.groupBy("user_id").agg(F.count("*").alias("sampled"), F.count_if("m").alias("changes"), F.count_if(F.col("m") & F.col("h")).alias("b"), F.count_if("h").alias("hashes"))
    return a.select("user_id", "sampled", "changes", ((F.col("sampled") >= 50) & (F.col("changes") >= 10) & (F.col("b") >= 0.9 * F.col("changes")) & (F.col("b") >= 0.9 * F.col("hashes"))).alias("trusted"))


@query("""WITH runs AS (SELECT DISTINCT user_id || '/' || event_type AS record, CAST(date_part('day', ts) AS BIGINT) // 2 AS run FROM events), last AS (SELECT max(run) AS r FROM runs)
SELECT DISTINCT record FROM runs WHERE record NOT IN (SELECT record FROM runs, last WHERE run > last.r - 2)""")
def inactive_candidates(spark, sf_dir):
    """Records (a user's events of one type) that the last two discovery runs did not see."""
    runs = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("record"), F.floor(F.dayofmonth("ts") / 2).alias("run")).distinct()
    last = runs.agg(F.max("run").alias("r"))
    recent = runs.join(F.broadcast(last), F.col("run") > F.col("r") - 2).select("record")
    return runs.select("record").distinct().join(recent, "record", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id >= (SELECT count(*) FROM documents) * 0.9")
def reingest_delta(spark, sf_dir):
    """Documents to ingest again: new ones, and those whose hash or version differs from what was ingested."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    n = d.count()
    held = d.filter(F.col("doc_id") < n * 0.9).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("hash")).alias("held"), F.when(F.col("doc_id") % 5 == 0, "1").otherwise("2").alias("version"))
    return d.join(held, "doc_id", "left").filter(~F.col("hash").eqNullSafe(F.col("held")) | ~F.col("version").eqNullSafe(F.lit("2"))).select("doc_id")
