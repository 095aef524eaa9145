"""URL identity: canonical form, tracking parameters, scope patterns and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track where a visitor came from.
TRACKING_PREFIXES = ("utm_", "mc_")
TRACKING_NAMES = ("gclid", "fbclid", "msclkid", "_ga", "ref")

# The generic URI pattern of RFC 3986, appendix B; it takes any string apart.
_URI = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_AUTHORITY = r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
STEM_LENGTH = 255 - len(".md") - 12 - 1


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URI, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without brackets; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(_part(url, 2), _AUTHORITY, 1), r"^\[|\]$", ""))


def is_tracking(key: Column) -> Column:
    low = F.lower(key)
    found = low.isin(*TRACKING_NAMES)
    for prefix in TRACKING_PREFIXES:
        found = found | low.startswith(prefix)
    return found


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(url: Column) -> Column:
    """The query's pairs as (key, value), decoded and in order; a key alone has an empty value."""
    raw = F.filter(F.split(_part(url, 4), "&", -1), lambda p: p != "")
    return F.transform(raw, lambda p: F.struct(_decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("key"), _decoded(F.regexp_extract(p, r"(?s)^[^=]*=?(.*)$", 1)).alias("value")))


def canonicalize(url: Column) -> Column:
    """Lower-case scheme and host without user names and default ports; no fragment and no tracking parameters.

    The other parameters keep their order and are encoded anew; an empty path becomes ``/``; a path's case and its
    last slash stay.  Null stays null.
    """
    sch, name = scheme(url), host(url)
    port = F.regexp_extract(_part(url, 2), _AUTHORITY, 2)
    plain = (port == "") | ((sch == "http") & (port == "80")) | ((sch == "https") & (port == "443"))
    shown = F.when(F.contains(name, F.lit(":")), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    authority = F.when(plain, shown).otherwise(F.concat(shown, F.lit(":"), port))
    path = F.when(_part(url, 3) == "", F.lit("/")).otherwise(_part(url, 3))
    kept = F.filter(query_pairs(url), lambda p: ~is_tracking(p["key"]))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.concat(sch, F.lit("://"), authority, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def scope_target(url: Column) -> Column:
    """What exclude patterns are matched against: the raw path, and the query if there is one."""
    return F.concat(_part(url, 3), F.when(_part(url, 4) == "", F.lit("")).otherwise(F.concat(F.lit("?"), _part(url, 4))))


def glob_to_regex(glob: str) -> str:
    """An anchored regex for a shell pattern: ``*`` any run, ``?`` any one character, ``[...]`` a set."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        end = glob.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]")
            at = end
        else:
            out.append(re.escape(c))
        at += 1
    return "(?s)^" + "".join(out) + "$"


def artifact_filename(canonical: Column) -> Column:
    """A file name made of the path, the query and a digest of the canonical URL, 255 characters at most."""

    def slug(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")

    path = F.regexp_replace(_part(canonical, 3), r"^/+|/+$", "")
    stem = slug(F.when(path == "", F.lit("index")).otherwise(path))
    stem = F.when(stem == "", F.lit("index")).otherwise(stem)
    query = slug(_part(canonical, 4))
    stem = F.when(query == "", stem).otherwise(F.concat(stem, F.lit("-"), query))
    stem = F.regexp_replace(F.substring(stem, 1, STEM_LENGTH), r"[-.]+$", "")
    stem = F.when(stem == "", F.lit("document")).otherwise(stem)
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(canonical, 256), 1, 12), F.lit(".md"))


def unquote(x: Column) -> Column:
    """Percent escapes as the characters that they stand for; what isn't a whole escape stays, and so does a plus."""
    whole = F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(whole), x)


def quote(x: Column) -> Column:
    """All but letters, digits and ``_.-~/`` as percent escapes of UTF-8."""
    out = _encoded(x)
    for sign, plain in (("+", "%20"), ("%2F", "/")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _tail(url: Column) -> Column:
    """Parameters, query and fragment as far as they aren't empty, behind the path."""
    query, fragment = _part(url, 4), _part(url, 5)
    return F.concat(F.regexp_replace(_part(url, 3), r"(?s);$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)))


def recomposed(url: Column) -> Column:
    """A URL or path put together again from its parts, so that an empty query or fragment leaves no sign."""
    u = _cleaned(url)
    authority = _part(u, 2)
    head = F.concat(F.when(scheme(u) == "", "").otherwise(F.concat(scheme(u), F.lit(":"))), F.when(authority == "", "").otherwise(F.concat(F.lit("//"), authority)))
    return F.concat(head, _tail(u))


def robots_target(url: Column) -> Column:
    """What the paths of robots rules are held against: a URL behind its host, decoded and encoded again; ``/`` if that is empty."""
    u = _cleaned(unquote(url))
    tail = _tail(u)
    tail = F.when(tail.startswith("//"), F.concat(F.lit("//"), tail)).otherwise(tail)
    return quote(F.when(tail == "", F.lit("/")).otherwise(tail))
