"""Whole runs: discovery of a site's URLs, planning and applying renders, ingestion of Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Registry, Site
from siltstone.functions import schedule, urls
from siltstone.operators import discovery, extract, frontier, ingestion, manifest, render, robots, scans, trust, vectors
from siltstone.operators import presence as page_presence
from siltstone.operators import sites as site_settings
from siltstone.sources import markdown
from siltstone.sources.snapshots import Snapshots
from siltstone.staging import staged

METRICS = "run_id string, site_name string, phase string, state string, version int, finished_at timestamp, metric string, n long"
RUNS = "site_name string, completed_at timestamp, complete boolean, config_fingerprint string"


@dataclass(frozen=True)
class Discovered:
    """``urls``: loc, lastmod (of the last occurrence), n (occurrences) and at (the last one's place); ``complete``: whether all sitemaps were read."""

    urls: DataFrame
    complete: bool
    child_sitemaps: int


def walk_site_sitemaps(responses: DataFrame, sites: DataFrame, max_children: int = discovery.CHILD_SITEMAPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Follow the sitemap indexes of many sites in one walk: ``(urls, runs, places)``.

    ``sites``: site_name, allowed_domains (lower case) and sitemaps (where each site begins); ``responses``: url, status,
    body, error.  Sitemaps are read in the order of a queue: the given ones, then children in the order in which their
    indexes were read and in which they stand there; the last occurrence of a URL gives its lastmod.  Only sitemaps on
    the allowed domains (else on the given sitemaps' hosts) are followed, and at most ``max_children`` beyond the given
    ones.  A site's run isn't complete if it has no sitemap, one isn't allowed, one can't be read, or the cap cuts some
    off.

    ``urls``: site_name, loc, lastmod, n and at; ``runs``: site_name, complete, child_sitemaps; ``places``: site_name,
    node, depth, place of what was read.
    """
    sites = staged(sites.select("site_name", "allowed_domains", F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps")), "seeds")
    given, hosts = site_settings.sitemap_seeds(sites, "sitemaps"), staged(site_settings.sitemap_hosts(sites, "sitemaps"), "hosts")
    fetched = responses.filter(~F.coalesce("error", F.lit(False)) & (F.col("status") < 400))
    parsed = staged(discovery.parse_sitemaps(fetched.select("url", "body")).select("url", "kind", "entries", "children"), "sitemaps")
    links = parsed.select(F.col("url").alias("src"), F.posexplode("children").alias("pos", "dst"))

    def inside(rows: DataFrame) -> DataFrame:
        return rows.join(hosts, "site_name").withColumn("__inside", site_settings.may_fetch(F.col("node"), F.col("hosts"))).drop("hosts")

    own = staged(inside(given), "given")
    budget = own.filter("__inside").groupBy("site_name").agg(F.count("*").alias("n")).select("site_name", (F.col("n") + max_children).alias("budget"), F.lit(None).cast("int").alias("max_depth"))
    places, cut = frontier.walk_sites(links, own.filter("__inside").drop("__inside"), budget, lambda rows: inside(rows).filter("__inside").drop("__inside"))
    read = staged(places.join(parsed.withColumnRenamed("url", "node"), "node", "left"), "read")
    followed = read.select("site_name", F.explode("children").alias("node"))
    foreign = inside(own.select("site_name", "node").unionByName(followed)).filter("not __inside").select("site_name").distinct()
    good = F.col("kind").isin("urlset", "index")
    counts = read.groupBy("site_name").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if((F.col("depth") > 0) & good).alias("children"))
    stopped = foreign.unionByName(cut).distinct().withColumn("stopped", F.lit(True))
    runs = sites.select("site_name").join(counts, "site_name", "left").join(stopped, "site_name", "left")
    runs = runs.select("site_name", (F.col("stopped").isNull() & F.coalesce(F.col("n") == F.col("good"), F.lit(False))).alias("complete"), F.coalesce("children", F.lit(0)).alias("child_sitemaps"))
    rows = read.select("site_name", "depth", "place", F.posexplode("entries").alias("pos", "e")).select("site_name", F.col("e.loc").alias("loc"), F.col("e.lastmod").alias("lastmod"), F.struct("depth", "place", "pos").alias("at"))
    found = rows.groupBy("site_name", "loc").agg(F.max_by(F.struct("lastmod"), "at").alias("l"), F.count("*").alias("n"), F.max("at").alias("at")).select("site_name", "loc", "l.lastmod", "n", "at")
    return found, staged(runs, "runs"), places


def walk_sitemaps(responses: DataFrame, site: Site, max_children: int = discovery.CHILD_SITEMAPS, sitemap_urls: tuple[str, ...] | None = None) -> Discovered:
    """``walk_site_sitemaps`` for one site."""
    given = list(site.sitemap_urls if sitemap_urls is None else sitemap_urls)
    one = Registry([site]).table(responses.sparkSession).withColumn("sitemaps", F.array(*map(F.lit, given)).cast("array<string>"))
    found, runs, _ = walk_site_sitemaps(responses, one, max_children)
    run = runs.first()
    return Discovered(found.drop("site_name"), run.complete, run.child_sitemaps)


def discover_sites(spark: SparkSession, registry: Registry, snapshots: Snapshots, runs: Snapshots, responses: DataFrame | None, now: Column, links: DataFrame | None = None, pages: DataFrame | None = None, presence: Snapshots | None = None, metrics: Snapshots | None = None, run_id: str | None = None) -> DataFrame:
    """One discovery run over all sites; returns their counts as ``site_name, metric, n`` (see ``discovery.summary``), with ``complete``, ``cached``, and the delays that their requests keep.

    Settings are a table, so there is one walk over sitemaps, one over links and one merge, however many sites there
    are.  The ledger says incomplete before anything is read and what came of it at the end, so a run that dies doesn't
    count.  A site whose robots rules can't be reached ends there.  A fresh complete run of the same settings is used
    again within the site's time limit.  Where a site names no sitemaps, those of its robots rules are read.  Each
    occurrence of a URL counts; the last one gives its lastmod.  A gap crawl takes links, and what fetching pages gave.

    Without ``responses`` robots rules aren't looked at, and sites with sitemaps come out incomplete.  With ``presence``
    (schema ``presence.PRESENCE``) the run is remembered for each page, and counts have an ``inactive_candidate`` too.  With ``metrics`` (schema ``METRICS``) and
    a ``run_id`` the counts of the sites that weren't taken from the cache are written there.
    """
    for site in registry.sites.values():
        site.require_discovery()
    sites = staged(registry.table(spark), "sites")
    maps = F.col("discovery_source") == "sitemap"
    limits = sites.filter(maps & (F.col("cache_ttl_hours") > 0)).select("site_name", "fingerprint", F.col("cache_ttl_hours").alias("ttl_hours"))
    cached = staged(discovery.cached_runs(runs.read(), limits, now).filter("cached").select("site_name"), "cached")
    todo = sites.join(cached, "site_name", "left_anti")
    ledger = todo.filter(maps).select("site_name", now.alias("completed_at"), F.lit(False).alias("complete"), F.col("fingerprint").alias("config_fingerprint"))
    runs.update(lambda held: record_runs(held, ledger))

    if responses is None:
        responses = spark.createDataFrame([], "url string, status int, body string, error boolean")
        asked = todo.select("site_name", F.lit("ok").alias("robots_state"), F.lit(None).cast("double").alias("crawl_delay"), F.array().cast("array<string>").alias("robots_sitemaps"))
    else:
        asked = robots.for_sites(todo, responses)
    delay = schedule.effective_delay(F.col("min_delay"), F.col("max_delay"), F.when(F.col("respect_crawl_delay"), F.col("crawl_delay")))
    todo = staged(todo.join(asked, "site_name").withColumn("delay", delay).withColumn("sitemaps", F.when(F.size("sitemap_urls") > 0, F.col("sitemap_urls")).otherwise(F.col("robots_sitemaps"))), "todo")
    active = todo.filter(F.col("robots_state").isin("ok", "no_rules"))

    found, walked, _ = walk_site_sitemaps(responses, active.filter(maps))
    rows = found.withColumn("source", F.lit("sitemap"))
    done = walked.select("site_name", "complete")
    if links is not None:
        crawled = active.filter(~maps)
        reached = staged(discovery.gap_crawl(links, crawled, pages), "gap")
        failed = reached.groupBy("site_name").agg(F.bool_and("success").alias("fetched"))
        done = done.unionByName(crawled.join(failed, "site_name", "left").select("site_name", F.coalesce("fetched", F.lit(False)).alias("complete")))
        at = F.struct("depth", "place", F.lit(0).alias("pos")).alias("at")
        rows = rows.unionByName(reached.filter("success").select("site_name", F.col("node").alias("loc"), F.lit(None).cast("timestamp").alias("lastmod"), F.lit(1).cast("long").alias("n"), at, F.lit("deep_crawl").alias("source")))
    done = staged(done, "done")
    scored = site_settings.with_scope(rows, sites, "loc")
    scored = staged(scored.select("site_name", urls.canonicalize(F.col("loc")).alias("canonical_url"), F.col("loc").alias("source_url"), "source", "lastmod", "scope_status", "scope_reason", now.alias("seen_at"), F.col("at").alias("ordinal"), "n"), "discovered")
    fresh = staged(manifest.collapse(scored), "collapsed")
    snapshots.update(lambda held: manifest.upsert(held, fresh), touching=fresh)
    ended = ledger.drop("complete").join(done, "site_name", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    runs.update(lambda held: record_runs(held, ended))

    again = discovery.summary(snapshots.read().join(cached, "site_name", "left_semi"), ["site_name"])
    counts = discovery.summary(scored, ["site_name"], weight="n").unionByName(again)
    none = sites.select("site_name", F.explode(F.array(F.lit("discovered"), F.lit("eligible"))).alias("metric"), F.lit(0).cast("long").alias("n"))
    if presence is not None:
        ran = staged(todo.select("site_name").join(done, "site_name", "left").withColumn("complete", F.coalesce("complete", F.lit(False))), "ran")
        presence.update(lambda held: page_presence.updated(held, scored, ran, now))
        idle = page_presence.states(presence.read(), sites).filter("state = 'inactive_candidate'")
        counts = counts.unionByName(idle.groupBy("site_name", F.col("state").alias("metric")).agg(F.count("*").alias("n")))
    counts = counts.unionByName(none).groupBy("site_name", "metric").agg(F.sum("n").alias("n"))
    state = sites.select("site_name", "min_delay", "max_delay").join(todo.select("site_name", F.col("delay.min_delay").alias("low"), F.col("delay.max_delay").alias("high")), "site_name", "left").join(done, "site_name", "left").join(cached.withColumn("cached", F.lit(True)), "site_name", "left")
    state = state.select("site_name", F.coalesce("complete", "cached", F.lit(False)).alias("complete"), F.coalesce("cached", F.lit(False)).alias("cached"), F.coalesce("low", "min_delay").alias("min_delay"), F.coalesce("high", "max_delay").alias("max_delay"))
    summary = staged(counts.join(state, "site_name"), "summary")
    if metrics is not None and run_id is not None:
        ran = summary.filter("not cached").select("site_name", F.when(F.col("complete"), "complete").otherwise("incomplete").alias("state"), "metric", "n")
        record_counts(metrics, run_id, "discovery", ran, snapshots.versions()[-1], now)
    return summary


def discover(spark: SparkSession, site: Site, snapshots: Snapshots, runs: Snapshots, responses: DataFrame | None, now: Column, links: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``discover_sites`` for one site, without its name."""
    return discover_sites(spark, Registry([site]), snapshots, runs, responses, now, links, pages).drop("site_name")


def record_runs(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with one row for each site, new ones replacing the old."""
    fresh = rows.select(*runs.columns)
    return runs.join(fresh.select("site_name"), "site_name", "left_anti").unionByName(fresh)


def _table(spark: SparkSession, sites: Site | Registry | DataFrame) -> DataFrame:
    if isinstance(sites, Site):
        sites = Registry([sites])
    return sites.table(spark) if isinstance(sites, Registry) else sites


def plan_render(held: DataFrame, sites: Site | Registry | DataFrame, now: Column, max_urls: int = 5000, force: bool = False, measured: DataFrame | None = None) -> DataFrame:
    """Records of the sites that are due by each site's own settings, in URL order: of each site the first ``max_urls``, with their ``rank``.

    With ``measured`` (rows of ``trust.RESULTS``) a site's lastmod counts only where its last measurement bears it out.
    """
    own = _table(held.sparkSession, sites).select("site_name", "trust_lastmod", "audit_days")
    own = own if measured is None else trust.earned(own, measured)
    eligible = held.filter("scope_status = 'eligible'").join(own, "site_name")
    decided = render.with_decision(eligible, now, F.col("trust_lastmod"), F.col("audit_days"), force).drop("trust_lastmod", "audit_days")
    return scans.numbered(decided.filter("decision is not null"), ["site_name"], ["canonical_url"], "rank", "due").filter(F.col("rank") <= max_urls)


def apply_render(snapshots: Snapshots, due: DataFrame, results: DataFrame, sites: Site | Registry | DataFrame, now: Column, root: str | None = None, metrics: Snapshots | None = None, run_id: str | None = None) -> DataFrame:
    """Fold results into the next snapshot; returns the outcome rows with their Markdown.

    Scope and least length are those of each record's site.  With ``root`` (a folder that all executors share) each
    saved page is written to ``root/site/parsed``, under a name made from its canonical URL; a page that moved leaves no
    file under its old name.  With ``metrics`` (schema ``METRICS``) and a ``run_id`` the run's counters are written there.
    """
    rows = staged(render.outcomes(due, results, now, sites=_table(due.sparkSession, sites)), "outcomes")
    moved = rows.filter("outcome = 'rekeyed'").select("site_name", F.col("new_canonical").alias("canonical_url"))
    snapshots.update(lambda held: render.apply(held, rows, now), touching=rows.select("site_name", "canonical_url").unionByName(moved))
    if root is not None:
        markdown.export(documents(rows, now), root)
    if metrics is not None and run_id is not None:
        totals = render.counters(rows, ["site_name"])
        names = [c for c in totals.columns if c != "site_name"]
        counts = totals.select("site_name", F.lit("complete").alias("state"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in names])).alias("c"))
        record_counts(metrics, run_id, "render", counts.select("site_name", "state", "c.*"), snapshots.versions()[-1], now)
    return rows


def observe(snapshots: Snapshots, log: Snapshots, now: Column) -> int:
    """Add what the last manifest says of each rendered page to the log (schema ``trust.OBSERVATIONS``); a page observed at the same time before isn't added again."""
    rows = staged(trust.observe(snapshots.read(), now), "observed")
    key = ["site_name", "canonical_url", "observed_at"]
    return log.update(lambda held: held.unionByName(rows.join(held.select(*key), key, "left_anti")))


def measure_trust(log: Snapshots, results: Snapshots, sites: Site | Registry | DataFrame, starts_at: Column, ends_at: Column, now: Column) -> DataFrame:
    """Measure all sites over one window, record that, and give the rows (schema ``trust.RESULTS``)."""
    own = _table(log.spark, sites).select("site_name", starts_at.alias("starts_at"), ends_at.alias("ends_at"), F.col("cache_ttl_hours").alias("ttl_hours"), "audit_days")
    rows = staged(trust.measure(log.read(), own, now), "trust")
    results.update(lambda held: held.unionByName(rows))
    return rows


def documents(rows: DataFrame, now: Column) -> DataFrame:
    """``site_name, file_name, rendered, old_names`` of the pages that outcome rows save; ``old_names`` where some moved there."""
    good = rows.filter(F.col("outcome").isin("saved", "rekeyed"))
    head = {
        "title": F.col("new_title"),
        "source_url": F.col("final_url"),
        "canonical_url": F.col("new_canonical"),
        "content_hash": F.sha2("markdown", 256),
        "language": F.col("language"),
        "extractor_version": F.lit(schedule.EXTRACTOR_VERSION),
        "crawl_timestamp": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX"),
    }
    old = F.when(F.col("outcome") == "rekeyed", urls.artifact_filename(F.col("canonical_url")))
    # Of several pages that moved to one address the last by old address is written, as in the manifest.
    named = good.select("site_name", "canonical_url", urls.artifact_filename(F.col("new_canonical")).alias("file_name"), markdown.render(head, F.col("markdown")).alias("rendered"), old.alias("old_name"))
    return named.groupBy("site_name", "file_name").agg(F.max_by("rendered", "canonical_url").alias("rendered"), F.collect_set("old_name").alias("old_names"))


def rendered_pages(pages: DataFrame, site: Site | None = None) -> DataFrame:
    """Render results from raw pages (url, html), by the site's settings: the first attempt cleaned, the second one not."""
    profiles = [extract.Profile(cleanup=c) if site is None else extract.Profile.of(site, c) for c in (True, False)]
    first, second = (extract.extracted(F.col("html"), p) for p in profiles)
    p = pages.select("url", first.alias("a"), second.alias("b"))
    ok = {"success": F.lit(True), "exception": F.lit(False), "status_code": F.lit(200), "cache_status": F.lit("miss"), "raw_markdown": F.lit(""), "meta_url": F.lit(None).cast("string")}
    return p.select(urls.canonicalize(F.col("url")).alias("canonical_url"), "url", F.col("a.markdown").alias("fit_markdown"), F.col("a.title").alias("title"), *[c.alias(n) for n, c in ok.items()], F.lit(True).alias("fallback_success"), F.col("b.markdown").alias("fallback_fit_markdown"), F.lit("").alias("fallback_raw_markdown"), F.lit(None).cast("string").alias("fallback_meta_url"), F.col("url").alias("fallback_url"), F.col("b.title").alias("fallback_title"))


def ingest(spark: SparkSession, root: str, collection: Snapshots | None = None, site: str | None = None, embedder=None, size: int = 1000, overlap: int = 200, delete_stale: bool = False) -> DataFrame:
    """Chunks of all Markdown files below ``root`` with ids, metadata and vectors, merged into ``collection`` if one is given; see ``markdown.rejected`` for files without content.

    ``head`` holds every field of a file's head; the columns beside it are those that retrieval reads.
    """
    out = staged(vectors.embed(ingestion.chunked(markdown.read(spark, root, site), size, overlap), embedder=embedder), "chunks")
    if collection is not None:
        collection.update(lambda held: vectors.upsert(held, out, delete_stale="source_path" if delete_stale else None))
    return out


def ingest_changes(files: DataFrame, collection: Snapshots, ledger: Snapshots, now: Column, within: Column | None = None, embedder=None, model: str = "hashing-384", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Take in what has changed since the last run: ``path, change, chunks`` for every file.

    ``files``: path, raw.  The ledger holds each file's hash and the version of splitter and model that its chunks come
    from; it is joined before anything is parsed, so an unchanged file costs its hash and nothing else.  Chunks of
    changed and vanished files leave ``collection`` (schema ``ingestion.CHUNKS``) in the version in which new ones
    come; vanished files keep a ledger row with the time.  ``within`` says for a ledger row whether this run's files
    speak for it, where they are part of a tree.  A file without content has a ledger row and no chunks.

    The ledger is written last: a run that dies is run again as a whole, and gives the same.
    """
    version = ingestion.version_of(size, overlap, model)
    hashed = files.select("path", F.sha2("raw", 256).alias("content_hash"))
    held = ledger.read()
    plan = staged(ingestion.changes(hashed, held if within is None else held.filter(within), version), "changes")
    fresh = plan.filter(F.col("change").isin("added", "changed"))
    rows = ingestion.chunked(ingestion.parsed(files.join(fresh.select("path"), "path", "left_semi")), size, overlap)
    rows = staged(vectors.embed(rows, embedder=embedder), "chunks")
    old = plan.filter("change <> 'unchanged'").select(F.col("path").alias("source_path"))
    collection.update(lambda had: had.join(old, "source_path", "left_anti").unionByName(rows.select(*had.columns)))
    counts = staged(rows.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("chunks")), "counts")
    ledger.update(lambda had: ingestion.recorded(had, plan, counts, version, now))
    return plan.join(ledger.read().select("path", "chunks"), "path", "left").select("path", "change", "chunks")


def ingest_tree(spark: SparkSession, root: str, collection: Snapshots, ledger: Snapshots, now: Column, site: str | None = None, **options) -> DataFrame:
    """``ingest_changes`` of the Markdown files below ``root``, or of one site's folder, whose absence then says nothing about other sites."""
    within = None if site is None else F.coalesce(markdown.site_of(F.col("path"), root) == site, F.lit(False))
    return ingest_changes(markdown.raw_files(spark, root, site), collection, ledger, now, within, **options)


def record_metrics(metrics: Snapshots, snapshots: Snapshots, run_id: str, site: Site, phase: str, state: str, now: Column, counts: DataFrame | None = None) -> int:
    """Write a run's counts under its ``run_id``, tied to the manifest version they come from, and give that version.

    ``phase``: discovery or render; ``state``: complete, incomplete or failed.  The site's totals (discovered, eligible,
    excluded by reason, current) are counted in that version alone; ``counts`` (metric, n) adds what only the run knows.
    A run that is recorded again replaces its rows; those of other runs and sites stay.
    """
    if phase not in ("discovery", "render") or state not in ("complete", "incomplete", "failed"):
        raise ValueError(f"phase {phase}, state {state}")
    version = (snapshots.versions() or [0])[-1]
    mine = snapshots.read(version or None).filter(F.col("site_name") == site.name)
    current = mine.filter("scope_status = 'eligible' and fetch_status = 'success'").agg(F.lit("current").alias("metric"), F.count("*").alias("n"))
    held = discovery.summary(mine).unionByName(current)
    extra = counts.select("metric", F.col("n").cast("long").alias("n")) if counts is not None else None
    if extra is not None:
        held = held.join(extra.select("metric"), "metric", "left_anti").unionByName(extra)
    head = {"run_id": F.lit(run_id), "site_name": F.lit(site.name), "phase": F.lit(phase), "state": F.lit(state), "version": F.lit(version), "finished_at": now}
    rows = held.select(*[c.alias(k) for k, c in head.items()], "metric", "n")
    metrics.update(lambda old: old.filter(~((F.col("run_id") == run_id) & (F.col("site_name") == site.name))).unionByName(rows))
    return version


def record_counts(metrics: Snapshots, run_id: str, phase: str, counts: DataFrame, version: int, now: Column) -> None:
    """Write counts of a run over many sites (site_name, state, metric, n), tied to the manifest version that they come with; rows of the same run, site and metric are replaced."""
    rows = staged(counts.select(F.lit(run_id).alias("run_id"), "site_name", F.lit(phase).alias("phase"), "state", F.lit(version).alias("version"), now.alias("finished_at"), "metric", F.col("n").cast("long").alias("n")), "metrics")
    key = ["run_id", "site_name", "metric"]
    metrics.update(lambda old: old.join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(rows))


def run_coverage(metrics: DataFrame, site: Site) -> DataFrame:
    """``run_id, eligible, current, coverage_percent, short`` of the site's runs; incomplete discoveries don't count, and no eligible page is full coverage of none: 0."""
    mine = metrics.filter((F.col("site_name") == site.name) & ~((F.col("phase") == "discovery") & (F.col("state") != "complete")))
    by = mine.groupBy("run_id").agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in ("eligible", "current")])
    share = F.when(F.col("eligible") > 0, 100.0 * F.col("current") / F.col("eligible")).otherwise(0.0)
    return by.withColumn("coverage_percent", share).withColumn("short", F.col("coverage_percent") < site.coverage_target)


def health(installed: DataFrame, wanted: str) -> DataFrame:
    """One row: ``model_available``."""
    return installed.sparkSession.range(1).select(model_available(installed, wanted).alias("model_available"))


def model_available(installed: DataFrame, wanted: str) -> Column:
    """Whether the very name and tag is among the installed models."""
    return F.lit(installed.filter(F.col("name") == wanted).limit(1).count() > 0)


def report(summary: DataFrame) -> Column:
    """One line for each count of a run."""
    return F.format_string("%s: %d", F.col("metric"), F.col("n"))


def valid_requests(requests: DataFrame, known_guides: list[str]) -> DataFrame:
    """Adds ``rejected``: why a chat request (message, agent_id, history) isn't taken, or null."""
    bad_role = F.exists(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), lambda h: ~F.coalesce(h["role"], F.lit("")).isin("user", "assistant"))
    return requests.withColumn("rejected", F.when(F.length(F.coalesce("message", F.lit(""))) < 1, "empty_message").when(~F.coalesce("agent_id", F.lit("auto")).isin("auto", *known_guides), "unknown_guide").when(bad_role, "bad_role"))
