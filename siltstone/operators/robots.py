"""Robots rules as rows: lines with their places, stanzas by running counts, and the first rule that applies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import schedule, text, urls

_LINE = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RULES = ("allow", "disallow", "crawl-delay", "request-rate")


def classify_response(status: Column, error: Column) -> Column:
    """What a fetch of robots rules says: ok, no_rules, suspended or unreachable."""
    return F.when(F.coalesce(error, F.lit(False)) | status.isNull(), "unreachable").when(status == 404, "no_rules").when(status.isin(*schedule.SUSPENDING_STATUSES), "suspended").when(status >= 400, "unreachable").otherwise("ok")


def parse(bodies: DataFrame, key: Sequence[str], body_col: str = "body") -> DataFrame:
    """``key, stanzas, sitemap_urls`` of each body; ``key`` must tell the rows apart, and a null body has no rules.

    A stanza is ``(place, agents, is_default, rules (place, allow, path), delay)``.  A line without anything ends one;
    so does an agent after a rule.  Rules before any agent, and agents without any rule, count for nothing.  Rules keep
    their order; the last whole number of seconds is the delay.  What a file holds is the most that a group here does.
    """
    lines = bodies.select(*key, F.posexplode(F.split(F.coalesce(F.col(body_col).cast("string"), F.lit("")), _LINE, -1)).alias("pos", "raw"))
    clean = text.strip(F.regexp_replace("raw", "(?s)#.*$", ""))
    lines = lines.select(*key, "pos", (F.col("raw") == "").alias("blank"), clean.alias("line")).withColumn("name", F.when(F.contains("line", F.lit(":")), F.lower(text.strip(F.substring_index("line", ":", 1)))))
    lines = lines.withColumn("value", urls.unquote(text.strip(F.regexp_replace("line", "(?s)^[^:]*:", "")))).withColumn("kind", F.when(F.col("name") == "user-agent", "agent").when(F.col("name").isin(*RULES), "rule")).drop("line")
    file = Window.partitionBy(*key).orderBy("pos")
    lines = lines.withColumn("block", F.count_if("blank").over(file))
    block = Window.partitionBy(*key, "block").orderBy("pos")
    before = F.last("kind", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("kind") == "agent") & ~before.eqNullSafe(F.lit("agent"))
    lines = lines.withColumn("begins", F.coalesce(begins, F.lit(False))).withColumn("stanza", F.count_if("begins").over(block))

    def listed(when: Column, what: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(when, what)))

    is_rule = F.col("name").isin("allow", "disallow")
    # A path that is empty forbids nothing.
    rule = F.struct("pos", ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"), urls.quote(urls.recomposed(F.col("value"))).alias("path"))
    stanzas = lines.groupBy(*key, "block", "stanza").agg(
        F.min("pos").alias("place"),
        listed(F.col("kind") == "agent", F.struct("pos", F.col("value").alias("agent"))).alias("agents"),
        listed(is_rule, rule).alias("rules"),
        F.max_by(F.col("value").cast("double"), F.when((F.col("name") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("pos"))).alias("delay"),
        F.bool_or(F.col("kind") == "rule").alias("ruled"),
        listed(F.col("name") == "sitemap", F.struct("pos", F.col("value").alias("url"))).alias("maps"),
    )
    stanza = F.struct("place", F.transform("agents", lambda a: a["agent"]).alias("agents"), F.exists("agents", lambda a: a["agent"] == "*").alias("is_default"), "rules", "delay")
    out = stanzas.groupBy(*key).agg(listed((F.col("stanza") > 0) & F.col("ruled"), stanza).alias("stanzas"), F.flatten(F.collect_list("maps")).alias("maps"))
    return out.select(*key, "stanzas", F.transform(F.array_sort("maps"), lambda m: m["url"]).alias("sitemap_urls"))


def stanza_for(stanzas: Column, agent: Column) -> Column:
    """The stanza that speaks to an agent: the first that names part of it, else the first for all."""
    token = F.lower(F.substring_index(agent, "/", 1))
    own = F.filter(stanzas, lambda s: ~s["is_default"] & F.exists(s["agents"], lambda a: F.contains(token, F.lower(a))))
    return F.coalesce(F.get(own, F.lit(0)), F.get(F.filter(stanzas, lambda s: s["is_default"]), F.lit(0)))


def crawl_delay(stanzas: Column, agent: Column) -> Column:
    """Seconds that the agent's stanza asks for; where it asks for none, or for zero, what the stanza for all does."""
    return F.coalesce(F.nullif(stanza_for(stanzas, agent)["delay"], F.lit(0.0)), stanza_for(stanzas, F.lit("*"))["delay"])


def allows(stanzas: Column, agent: Column, url: Column) -> Column:
    """Whether an agent may fetch a URL: the first rule whose path it begins with decides, and without one it may."""
    target = urls.robots_target(url)
    hit = F.filter(stanza_for(stanzas, agent)["rules"], lambda r: (r["path"] == "*") | target.startswith(r["path"]))
    return F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))


def for_sites(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """``site_name, robots_state, crawl_delay, robots_sitemaps`` of all sites at once.

    ``sites``: site_name, robots_url, user_agent; ``responses``: url, status, body, error.  A site without an answer is
    unreachable; rules count only where the state is ok.
    """
    asked = sites.select("site_name", "robots_url", "user_agent")
    got = responses.join(asked.select(F.col("robots_url").alias("url")).distinct(), "url", "left_semi").select("url", classify_response(F.col("status"), F.col("error")).alias("state"), "body")
    rules = parse(got.filter("state = 'ok'"), ["url"])
    j = asked.join(got.select(F.col("url").alias("robots_url"), "state"), "robots_url", "left").join(rules.withColumnRenamed("url", "robots_url"), "robots_url", "left")
    return j.select("site_name", F.coalesce("state", F.lit("unreachable")).alias("robots_state"), crawl_delay(F.col("stanzas"), F.col("user_agent")).alias("crawl_delay"), F.coalesce("sitemap_urls", F.array().cast("array<string>")).alias("robots_sitemaps"))
