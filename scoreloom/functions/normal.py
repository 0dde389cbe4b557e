"""Normalizing Column functions.  Each takes and gives Columns; none needs a Python worker."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How paths and versions are spelled.
VERSION_SEGMENT = r"(?i)^(v\d+|beta|oauth|v20\d\d)$"
DOTTED_VERSION = r"(?i)^v?\d+(\.\d+)+$"
NO_VERSION = ("none", "n/a", "na", "null", "nil", "unversioned", "no version", "-", "--")

# Authentication styles, the most specific first, and what names each.
AUTH_STYLES = (
    ("hmac-signature", ("hmac", "message signature", "request signature", "request signing")),
    ("session-token", ("session", "logon")),
    ("oauth2-client-credentials", ("client credentials",)),
    ("oauth2-authorization-code", ("authorization code", "auth code", "pkce")),
    ("oauth2-implicit", ("implicit grant", "implicit flow")),
    ("bearer-token", ("bearer",)),
    ("basic-auth", ("basic auth", "basic authentication", "http basic")),
    ("api-key", ("api key", "apikey", "subscription key")),
    ("access-token", ("access token", "accesstoken")),
)
UNKNOWN_AUTH = "unknown"

# Hosts that hold copies of other publishers' pages.
REHOSTING_HOSTS = (
    "web.archive.org", "archive.org", "archive.is", "archive.ph", "archive.today",
    "webcache.googleusercontent.com", "cachedview.nl", "r.jina.ai", "12ft.io",
)


#: White space of any script.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (of any script) at either end; what stands between is not read."""
    return F.trim(c, F.lit(WHITE))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first_part(c: Column) -> Column:
    return F.substring_index(c, "/", 1)


def _has_bare_host(p: Column) -> Column:
    return ~p.startswith("/") & p.contains("/") & _first_part(p).contains(".")


def address_to_path(c: Column) -> Column:
    """The path of an address: scheme, host, query and fragment dropped; null is empty."""
    p = strip(_or_empty(c))
    rest = F.substring(p, F.instr(p, "://") + 3, F.length(p))
    from_slash = F.when(rest.contains("/"), F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise("/")
    bare = F.substring(p, F.instr(p, "/"), F.length(p))
    path = F.when(p.contains("://"), from_slash).when(_has_bare_host(p), bare).otherwise(p)
    return F.substring_index(F.substring_index(path, "?", 1), "#", 1)


def states_host(c: Column) -> Column:
    p = strip(_or_empty(c))
    return p.contains("://") | _has_bare_host(p)


def _is_version(segment: Column) -> Column:
    return segment.rlike(VERSION_SEGMENT) | segment.rlike(DOTTED_VERSION)


def normalize_version(c: Column) -> Column:
    """Canonical version: no slash in front, no brackets, no service, no v before a dotted number, '' for none."""
    v = F.lower(F.regexp_replace(strip(_or_empty(c)), "^/+", ""))
    v = F.when(v.rlike(r"(?s)^[<(\[].*[>)\]]$"), strip(F.regexp_replace(v, r"(?s)^.|.$", ""))).otherwise(v)
    v = F.when(v.rlike(r"^[^/]+/(v\d+|beta|oauth|v?\d+(\.\d+)+)$"), F.substring_index(v, "/", -1)).otherwise(v)
    v = F.when(v.rlike(DOTTED_VERSION), F.regexp_replace(v, "^v", "")).otherwise(v)
    return F.when(v.isin(*NO_VERSION), "").otherwise(v)


def _segments(c: Column) -> Column:
    return F.filter(F.split(address_to_path(c), "/"), lambda s: s != "")


def version_segments(c: Column) -> Column:
    return F.transform(F.filter(_segments(c), _is_version), normalize_version)


def normalize_path(c: Column) -> Column:
    """Comparable segments: versions dropped wherever they stand, placeholders one sign, lower case."""
    kept = F.filter(_segments(c), lambda s: ~_is_version(s))
    return F.transform(kept, lambda s: F.when(strip(s).rlike(r"(?s)^\{.*\}$"), "{}").otherwise(F.lower(strip(s))))


def normalize_method(c: Column) -> Column:
    return F.upper(strip(_or_empty(c)))


def strip_base_prefix(segments: Column, prefixes: Iterable[Iterable[str]]) -> Column:
    """``segments`` without the first declared prefix that it starts with; at most one goes."""
    out = segments
    for prefix in reversed([list(p) for p in prefixes if p]):
        head = F.array(*map(F.lit, prefix))
        n = len(prefix)
        out = F.when(F.slice(segments, 1, n) == head, F.slice(segments, F.lit(n + 1), F.greatest(F.size(segments) - n, F.lit(0)))).otherwise(out)
    return out


def auth_concepts(c: Column) -> Column:
    """The styles that a text names, in the order of the table."""
    t = F.translate(F.lower(_or_empty(c)), "-_", "  ")
    named = [F.when(_any(t.contains(m) for m in marks), F.lit(style)) for style, marks in AUTH_STYLES]
    return F.array_compact(F.array(*named))


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def canonical_auth_flow(c: Column) -> Column:
    return F.coalesce(F.get(auth_concepts(c), F.lit(0)), F.lit(UNKNOWN_AUTH))


def bare_scope(c: Column) -> Column:
    return F.lower(strip(F.substring_index(_or_empty(c), "#", 1)))


def normalize_catalog(c: Column) -> Column:
    return F.upper(F.regexp_replace(strip(_or_empty(c)), r"(?U)\s+", " "))


def version_tuples(c: Column) -> Column:
    """Every version number of a text as an array of integers: 35.011 and 35.11 are one."""
    found = F.regexp_extract_all(_or_empty(c), F.lit(r"(?iU)(?<![\w.])v?(\d+(?:\.\d+)*)(?![\w.])"), F.lit(1))
    return F.transform(found, lambda v: F.transform(F.split(v, r"\."), lambda n: n.cast("long")))


def version_satisfies(required: Column, answer: Column) -> Column:
    """The first required version is met by a version of the answer that starts with all its numbers."""
    want, got = F.get(version_tuples(required), F.lit(0)), version_tuples(answer)
    n = F.coalesce(F.size(want), F.lit(1))
    met = F.exists(got, lambda v: (F.size(v) >= n) & (F.slice(v, F.lit(1), n) == want))
    return F.when(want.isNull(), False).otherwise(F.coalesce(met, F.lit(False)))


def hedge_count(c: Column) -> Column:
    return F.size(F.array_distinct(version_tuples(c)))


def names_parameter(required: Column, answers: Column) -> Column:
    return F.exists(answers, lambda a: (a == required) | a.startswith(F.concat(required, F.lit("."))))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(_or_empty(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def rehosting_host(c: Column) -> Column:
    """The copying host that a URL is on, or null."""
    host = url_host(c)
    return F.coalesce(*[F.when((host == bad) | host.endswith("." + bad), F.lit(bad)) for bad in REHOSTING_HOSTS])


def path_spellings(path: Column, prefixes: Iterable[str]) -> Column:
    """The path, and with each declared prefix taken off or put in front."""
    out = [path]
    for prefix in prefixes:
        pre = "/" + prefix.strip("/")
        rest = F.substring(path, len(pre) + 1, 1 << 30)
        off = F.when(rest == "", "/").otherwise(rest)
        out.append(F.when(path.startswith(pre), off).otherwise(F.concat(F.lit(pre.rstrip("/")), path)))
    return F.array_distinct(F.filter(F.array(*out), lambda s: s != ""))


def server_segments(url: Column) -> Column:
    """Path segments of a server address or base path."""
    rest = F.substring(url, F.instr(url, "://") + 3, 1 << 30)
    path = F.when(url.contains("://"), F.when(rest.contains("/"), F.substring(rest, F.instr(rest, "/"), 1 << 30)).otherwise("")).otherwise(url)
    return F.filter(F.split(_or_empty(path), "/"), lambda s: s != "")


def anchor_paths(path: Column, prefix: Column) -> Column:
    """The path alone and behind each suffix of the prefix segments, the shortest first."""
    trimmed = F.regexp_replace(strip(path), "/+$", "")
    base = F.when(trimmed == "", "/").otherwise(trimmed)
    n = F.size(prefix)
    behind = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(F.lit("/"), F.array_join(F.slice(prefix, n - k + 1, k), "/"), base),
    )
    return F.concat(F.array(base), behind)


def slug_for(url: Column) -> Column:
    """A name for a file: letters and digits of the address joined by hyphens, the last 80 characters."""
    path = F.substring_index(F.substring_index(F.regexp_replace(url, "^https?://", ""), "?", 1), "#", 1)
    slug = F.lower(F.regexp_replace(F.regexp_replace(path, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(slug == "", "page").otherwise(F.right(slug, F.lit(80)))


def pct_cell(share: Column) -> Column:
    """A share as whole percent, half to even; n/a for null."""
    return F.coalesce(F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit("n/a"))


def delta_cell(a: Column, b: Column) -> Column:
    points = F.bround((b - a) * 100, 0).cast("int")
    sign = F.when(points < 0, "").otherwise("+")
    return F.coalesce(F.concat(sign, points.cast("string"), F.lit(" pts")), F.lit("n/a"))


def signature(text: Column) -> Column:
    """Sixteen hex digits that stand for a text, whatever its white space."""
    return F.substring(F.sha2(strip(F.regexp_replace(_or_empty(text), r"(?U)\s+", " ")), 256), 1, 16)
