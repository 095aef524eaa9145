"""Robots rules as rows against the standard library's parser, and host schedules against a loop."""

import random
import urllib.robotparser
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.operators import hosts, robots, scans


def library(body, agent, url):
    p = urllib.robotparser.RobotFileParser()
    p.parse((body or "").splitlines())
    return p.can_fetch(agent, url), (p.crawl_delay(agent) or p.crawl_delay("*")), p.site_maps() or []


def bodies(rng, n):
    fields = ["User-agent", "user-AGENT ", "Disallow", "Allow", "Crawl-delay", "Request-rate", "Sitemap", "Noise", ""]
    values = ["*", "bot", "Bot/2", "other", "", "/", "/a", "/a/b", "/a%2Fb", "/a b", "/é?q=1", "/a?", "/x#y", "*", "5", "0", "1/5", "https://h.example/s.xml", "/A", "http://h.example/a", "/%zz", "/a;", "+"]
    for _ in range(n):
        lines = [rng.choice(["", "", " ", "# note", "bare"]) if rng.random() < 0.3 else f"{rng.choice(fields)}:{rng.choice(['', ' '])}{rng.choice(values)}{rng.choice(['', '', ' # c', '  '])}" for _ in range(rng.randrange(14))]
        yield rng.choice(["\n", "\r\n"]).join(lines)


def test_rules_agree_with_the_library(spark):
    rng = random.Random(8)
    agents = ["bot", "Other/1.0", "robot", "x"]
    targets = ["https://h.example", "https://h.example/a", "https://h.example/a/b?x=1", "https://h.example/a%2Fb", "https://h.example/é?q=1", "https://h.example/a b", "https://h.example/x#y", "https://h.example//a", "https://h.example/A;p", "https://h.example/%zz+"]
    rows = [(i, body, rng.choice(agents), rng.choice(targets)) for i, body in enumerate(bodies(rng, 1500))] + [(-1, None, "bot", targets[1]), (-2, "", "bot", targets[1])]
    df = spark.createDataFrame(rows, "i long, body string, agent string, url string")
    got = robots.parse(df, ["i"]).join(df, "i").select("i", robots.allows(F.col("stanzas"), F.col("agent"), F.col("url")).alias("ok"), robots.crawl_delay(F.col("stanzas"), F.col("agent")).alias("d"), "sitemap_urls")
    found = {r.i: (r.ok, r.d, r.sitemap_urls) for r in got.collect()}
    assert len(found) == len(rows)
    for i, body, agent, url in rows:
        assert found[i] == library(body, agent, url), (body, agent, url)
    assert robots.parse(df.limit(0), ["i"]).count() == 0


def test_schedules_agree_with_a_loop(spark):
    rng, now = random.Random(3), datetime(2026, 8, 5)
    rows = []
    for host in ("hot", "a", "b"):
        for i in range(900 if host == "hot" else 60):
            status = rng.choice([200] * 9 + [429, 503, None])
            rows.append((host, i, now + timedelta(seconds=rng.randrange(2000)), rng.choice([0.5, 1.0, 2.25, None]), status, rng.choice([None, "7", "soon", "90.5", "4000"])))
    df = spark.createDataFrame(rows, "host string, ordinal long, arrived_at timestamp, delay double, status int, retry_after string").repartition(5)
    got = {(r.host, r.ordinal): r for r in hosts.schedule_requests(df, F.lit(3.0), took=F.lit(0.25)).collect()}
    free, over = defaultdict(lambda: datetime(1970, 1, 1)), set()
    for host, i, arrived, delay, status, header in rows:
        start = max(arrived, free[host])
        r = got[host, i]
        assert (r.starts_at, r.incomplete) == (start, host in over)
        free[host] = start + timedelta(seconds=delay or 0)
        if status in (429, 503):
            asked = {None: 3.0, "soon": 3.0, "7": 7.0, "90.5": 90.5, "4000": 3600.0}[header]
            assert r.suspended_for == asked
            free[host] = max(free[host], start + timedelta(seconds=0.25 + asked))
            over |= {host} if header == "4000" else set()
    assert len(got) == len(rows) and hosts.schedule_requests(df.limit(0), F.lit(3.0)).count() == 0


def test_numbers_go_on_over_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 1000).alias("o"))
    got = scans.numbered(df, ["g"], ["o"]).collect()
    for g in "ab":
        own = sorted((r.o, r.number) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
