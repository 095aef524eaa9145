"""Site and retrieval settings: checked on the driver, used as literals or as a small table in plans."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.urls import glob_to_regex


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}: {value}")


@dataclass(frozen=True)
class MarkdownOptions:
    ignore_links: bool = False
    body_width: int = 0
    protect_links: bool = True
    unicode_snob: bool = True  # text is kept as it is; False gives ASCII where there is a plain form
    ignore_images: bool = False
    ignore_tables: bool = False

    def __post_init__(self):
        _within("body_width", self.body_width, 0, float("inf"))


@dataclass(frozen=True)
class GapCrawl:
    enabled: bool = False
    seed_urls: tuple[str, ...] = ()
    max_depth: int = 2
    max_pages: int = 100

    strategy: str = "bfs"

    def __post_init__(self):
        if self.strategy != "bfs":
            raise ValueError(f"strategy of a gap crawl: {self.strategy}")
        _within("max_depth", self.max_depth, 0, 10)
        _within("max_pages", self.max_pages, 1, 1000)


@dataclass(frozen=True)
class Site:
    name: str
    base_url: str
    description: str | None = None
    discovery_source: str = "sitemap"
    sitemap_urls: tuple[str, ...] = ()
    trust_lastmod: bool = False
    cache_ttl_hours: float = 24.0
    allowed_domains: tuple[str, ...] = ()
    exclude_url_patterns: tuple[str, ...] = ()
    allowed_content_types: tuple[str, ...] = ()
    audit_days: int = 90
    inactive_grace_cycles: int = 2
    coverage_target: float = 95.0
    page_timeout: int = 30
    min_delay: float = 1.0
    max_delay: float = 3.0
    max_concurrent: int = 3
    minimum_content_length: int = 100
    word_count_threshold: int = 20
    robots_policy: str = "require"
    respect_crawl_delay: bool = True
    user_agent: str = "siltstone"
    css_selector: str | None = None
    target_elements: tuple[str, ...] = ()
    remove_consent_popups: bool = False
    remove_overlay_elements: bool = False
    markdown: MarkdownOptions = field(default_factory=MarkdownOptions)
    gap_crawl: GapCrawl = field(default_factory=GapCrawl)

    def __post_init__(self):
        if not self.base_url or not urlsplit(self.base_url).hostname:
            raise ValueError(f"no host in base_url of {self.name}: {self.base_url}")
        _within("page_timeout", self.page_timeout, 1, 120)
        _within("min_delay", self.min_delay, 0, float("inf"))
        _within("max_delay", self.max_delay, 0, float("inf"))
        _within("cache_ttl_hours", self.cache_ttl_hours, 0, float("inf"))
        _within("audit_days", self.audit_days, 1, float("inf"))
        _within("inactive_grace_cycles", self.inactive_grace_cycles, 1, float("inf"))
        _within("coverage_target", self.coverage_target, 0, 100)
        _within("minimum_content_length", self.minimum_content_length, 1, float("inf"))
        _within("word_count_threshold", self.word_count_threshold, 0, float("inf"))
        if self.discovery_source not in ("sitemap", "none"):
            raise ValueError(f"discovery_source of {self.name}: {self.discovery_source}")
        if self.robots_policy != "require":
            raise ValueError(f"robots_policy of {self.name}: {self.robots_policy}")
        _within("max_concurrent", self.max_concurrent, 1, 20)
        if self.min_delay > self.max_delay:
            raise ValueError("min_delay is above max_delay")

    @property
    def base_dir(self) -> str:
        return urlsplit(self.base_url).hostname

    def require_discovery(self) -> None:
        if self.discovery_source == "none" and not self.gap_crawl.enabled:
            raise ValueError(f"{self.name}: no sitemap discovery and no gap crawl")

    def fingerprint(self) -> str:
        """Digest of the settings on which the counts of a discovery run depend."""
        held = {
            "base_url": self.base_url.rstrip("/"),
            "discovery_source": self.discovery_source,
            "sitemap_urls": list(self.sitemap_urls),
            "allowed_domains": list(self.allowed_domains),
            "exclude_url_patterns": list(self.exclude_url_patterns),
            "allowed_content_types": list(self.allowed_content_types),
        }
        return "v1:" + hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest()


class Registry:
    """Sites by name, in the order given."""

    def __init__(self, sites: list[Site]):
        if not sites:
            raise ValueError("no sites are configured")
        self.sites = {s.name: s for s in sites}

    @classmethod
    def from_yaml(cls, text: str) -> Registry:
        import yaml

        data = yaml.safe_load(text)
        if not data or not data.get("sites"):
            raise ValueError("the configuration is empty")
        def fields(body: dict | None) -> dict:
            return {k: tuple(v) if isinstance(v, list) else v for k, v in (body or {}).items()}

        sites = []
        for name, body in data["sites"].items():
            own = fields(body)
            for part, made in (("markdown", MarkdownOptions), ("gap_crawl", GapCrawl)):
                if part in own:
                    own[part] = made(**fields(own[part]))
            sites.append(Site(name=name, **own))
        return cls(sites)

    def get(self, name: str) -> Site:
        if name not in self.sites:
            raise ValueError(f"unknown site {name}; known: {', '.join(self.sites)}")
        return self.sites[name]

    def names(self) -> list[str]:
        return list(self.sites)

    def descriptions(self) -> dict[str, str]:
        return {k: s.description or f"Configuration for {k}" for k, s in self.sites.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each site, as ``operators.sites`` reads it; its size is that of the configuration."""
        plain = "description discovery_source sitemap_urls trust_lastmod cache_ttl_hours exclude_url_patterns audit_days inactive_grace_cycles coverage_target page_timeout min_delay max_delay max_concurrent minimum_content_length word_count_threshold respect_crawl_delay user_agent".split()
        ddl = (
            "site_name string, base_url string, robots_url string, fingerprint string, allowed_domains array<string>, exclude_regexes array<string>, allowed_content_types array<string>, "
            "gap_seeds array<string>, gap_depth int, gap_pages int, "
            "description string, discovery_source string, sitemap_urls array<string>, trust_lastmod boolean, cache_ttl_hours double, exclude_url_patterns array<string>, audit_days int, inactive_grace_cycles int, coverage_target double, "
            "page_timeout int, min_delay double, max_delay double, max_concurrent int, minimum_content_length int, word_count_threshold int, respect_crawl_delay boolean, user_agent string"
        )
        floats = {"cache_ttl_hours", "coverage_target", "min_delay", "max_delay"}
        rows = []
        for s in self.sites.values():
            head = (s.name, s.base_url, urljoin(s.base_url, "/robots.txt"), s.fingerprint(), [d.lower() for d in s.allowed_domains], [glob_to_regex(p) for p in s.exclude_url_patterns], [t.lower() for t in s.allowed_content_types])
            gap = (list(s.gap_crawl.seed_urls), s.gap_crawl.max_depth, s.gap_crawl.max_pages)
            rest = (getattr(s, n) for n in plain)
            rows.append((*head, *gap, *(float(v) if n in floats else list(v) if isinstance(v, tuple) else v for n, v in zip(plain, rest, strict=True))))
        return spark.createDataFrame(rows, ddl)


@dataclass(frozen=True)
class RetrievalSettings:
    collection: str = "knowledge"
    max_tokens: int = 1024
    top_k: int = 5
    history_messages: int = 10
    snippet_length: int = 280
    chunk_size: int = 1000
    chunk_overlap: int = 200
