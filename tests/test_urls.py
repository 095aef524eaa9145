import hashlib
from urllib.parse import parse_qsl, urlencode, urlsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import discovery
from siltstone.operators import sites as site_settings

CANONICAL = [
    # What is written in any case is one address; a path isn't.
    ("hTTp://WWW.Shop.EXAMPLE/Cart/Items/", "http://www.shop.example/Cart/Items/"),
    ("http://shop.example:80", "http://shop.example/"),
    ("http://shop.example:443/a", "http://shop.example:443/a"),
    ("https://shop.example:/a", "https://shop.example/a"),
    ("ftp://files.example:21/x", "ftp://files.example:21/x"),
    ("https://me:secret@shop.example:8443/a#top?x=1", "https://shop.example:8443/a"),
    ("https://[2001:DB8::7]:9000/v6?z", "https://[2001:db8::7]:9000/v6?z="),
    ("http://[2001:db8::7]:80/", "http://[2001:db8::7]/"),
    # Parameters keep their order, their repeats and their empty values.
    ("https://shop.example/s?b=2&a=1&&b=3&=", "https://shop.example/s?b=2&a=1&b=3&="),
    ("https://shop.example/s?UTM_Term=t&Mc_cid=7&_ga=1.2&fbclid&msclkid=0&ref=home&reference=5", "https://shop.example/s?reference=5"),
    ("https://shop.example/s?utm=1&mc=2&gclidx=3", "https://shop.example/s?utm=1&mc=2&gclidx=3"),
    ("https://shop.example/s?q=caf%C3%A9+au+lait&p=50%", "https://shop.example/s?q=caf%C3%A9+au+lait&p=50%25"),
    ("https://shop.example/a;v=1/b;v=2?x=a;b", "https://shop.example/a;v=1/b;v=2?x=a%3Bb"),
    ("https://shop.example/%7Eme/%zz?t=~*", "https://shop.example/%7Eme/%zz?t=~%2A"),
    (None, None),
]


def ask(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(column).collect()]


def test_canonical_forms(spark):
    assert ask(spark, [(u,) for u, _ in CANONICAL], "u string", urls.canonicalize(F.col("u"))) == [c for _, c in CANONICAL]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abcXYZ09-_", min_size=1, max_size=6), st.text("ab +%~*é/=&;", max_size=6)), max_size=5), st.sampled_from(["", "/", "/A/b/", "/x.html"]))
def test_canonical_form_agrees_with_the_library_and_is_stable(spark, pairs, path):
    url = "https://Host.Example" + path + ("?" + urlencode(pairs) if pairs else "")
    kept = [(k, v) for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True) if not (k.lower() in urls.TRACKING_NAMES or k.lower().startswith(urls.TRACKING_PREFIXES))]
    want = "https://host.example" + (path or "/") + ("?" + urlencode(kept) if kept else "")
    got = ask(spark, [(url,)], "u string", urls.canonicalize(F.col("u")))[0]
    assert got == want
    assert ask(spark, [(got,)], "u string", urls.canonicalize(F.col("u")))[0] == got


SCOPED = [
    # (url, domains, patterns, reason)
    ("https://Docs.Example:8443/guide", ["docs.EXAMPLE"], [], None),
    ("https://sub.docs.example/guide", ["docs.example"], [], "domain_not_allowed"),
    ("https://docs.example.evil.test/guide", ["docs.example", "help.example"], [], "domain_not_allowed"),
    ("https://user@help.example/", ["docs.example", "help.example"], ["/?*"], None),
    ("mailto:someone@docs.example", ["docs.example"], [], "domain_not_allowed"),
    # The domain is looked at first, then the patterns, one of which is enough.
    ("https://other.example/print/1", ["docs.example"], ["/print/*"], "domain_not_allowed"),
    ("https://docs.example/print/1", ["docs.example"], ["*.pdf", "/print/*"], "excluded_by_pattern"),
    ("https://docs.example/en/print/1", ["docs.example"], ["*.pdf", "/print/*"], None),
    # Patterns see the path and the query and never host or fragment, and they mind the case.
    ("https://docs.example/a?sort=Asc", [], ["*sort=asc"], None),
    ("https://docs.example/a?sort=asc#z", [], ["*sort=asc"], "excluded_by_pattern"),
    ("https://docs.example/a", [], ["*docs.example*"], None),
    ("https://docs.example/v2/x", [], ["/v[0-9]/?"], "excluded_by_pattern"),
    ("https://docs.example/vx/x", [], ["/v[!a-m]/x"], "excluded_by_pattern"),
    ("https://docs.example/va/x", [], ["/v[!a-m]/x", "/v[]]/x", "/v.*"], None),
]


def test_scope(spark):
    for domains, exclude in {(tuple(d), tuple(e)) for _, d, e, _ in SCOPED}:
        rows = [(u, r) for u, d, e, r in SCOPED if (tuple(d), tuple(e)) == (domains, exclude)]
        assert ask(spark, [(u,) for u, _ in rows], "u string", discovery.scope_reason(F.col("u"), domains, exclude)) == [r for _, r in rows], (domains, exclude)


def test_scope_by_rows_is_the_same(spark):
    rows = [(u, [d.lower() for d in ds], [urls.glob_to_regex(p) for p in ps]) for u, ds, ps, _ in SCOPED]
    got = ask(spark, rows, "u string, d array<string>, p array<string>", site_settings.scope_reason(F.col("u"), F.col("d"), F.col("p")))
    assert got == [r for *_, r in SCOPED]


def test_file_name(spark):
    rows = [("https://shop.example/A/b c//d.html?x=1&y=%20",), ("https://shop.example/",), ("https://shop.example/" + "ä" * 9 + "?" + "z" * 400,)]
    got = ask(spark, rows, "u string", urls.artifact_filename(F.col("u")))
    digests = [hashlib.sha256(u.encode()).hexdigest()[:12] for (u,) in rows]
    assert got[0] == f"A-b-c-d.html-x-1-y-20-{digests[0]}.md"
    assert got[1] == f"index-{digests[1]}.md" and got[2].startswith("index-zzz") and got[2].endswith(f"-{digests[2]}.md") and len(got[2]) == 255
