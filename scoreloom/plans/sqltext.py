"""SQL expressions (DuckDB) that say what the normalizing functions do.  RE2 patterns; ASCII test data."""

from __future__ import annotations

# Fixed values, written out here once more, so that the SQL does not share a table with what it checks.
NO_VERSION = ("none", "n/a", "na", "null", "nil", "unversioned", "no version", "-", "--")
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
DROPPED = ("script", "style", "noscript", "svg", "head", "nav", "footer", "form")
LINE_ENDS = "p|div|section|article|li|ul|ol|table|tr|h[1-6]|pre|br|header|title"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
API_CATEGORIES = (
    "authenticate", "find-principal", "list-principal-accounts", "grant-access", "revoke-access", "search-filter",
    "audit-report", "connect-source", "policy-object-create-and-test", "review-campaign", "event-subscription",
)

VERSION = r"^(v\d+|beta|oauth|v20\d\d)$"
DOTTED = r"^v?\d+(\.\d+)+$"


def path_of(x: str) -> str:
    p = f"trim(coalesce({x}, ''))"
    rest = f"substr({p}, instr({p}, '://') + 3)"
    bare = f"NOT starts_with({p}, '/') AND contains({p}, '/') AND contains(split_part({p}, '/', 1), '.')"
    path = (
        f"CASE WHEN contains({p}, '://') THEN CASE WHEN contains({rest}, '/') THEN substr({rest}, instr({rest}, '/')) ELSE '/' END "
        f"WHEN {bare} THEN substr({p}, instr({p}, '/')) ELSE {p} END"
    )
    return f"split_part(split_part({path}, '?', 1), '#', 1)"


def states_host(x: str) -> str:
    p = f"trim(coalesce({x}, ''))"
    return f"(contains({p}, '://') OR (NOT starts_with({p}, '/') AND contains({p}, '/') AND contains(split_part({p}, '/', 1), '.')))"


def is_version(s: str) -> str:
    return f"(regexp_matches({s}, '{VERSION}', 'i') OR regexp_matches({s}, '{DOTTED}', 'i'))"


def version(x: str) -> str:
    none = ", ".join(f"'{n}'" for n in NO_VERSION)
    v = f"lower(ltrim(trim(coalesce({x}, '')), '/'))"
    v = f"regexp_replace({v}, '^[<(\\[](.*)[>)\\]]$', '\\1')"
    v = f"regexp_replace({v}, '^[^/]+/(v\\d+|beta|oauth|v?\\d+(\\.\\d+)+)$', '\\1')"
    v = f"regexp_replace({v}, '^v(\\d+(\\.\\d+)+)$', '\\1')"
    return f"CASE WHEN {v} IN ({none}) THEN '' ELSE {v} END"


def segments(x: str) -> str:
    return f"list_filter(string_split({path_of(x)}, '/'), lambda s: s <> '')"


def npath(x: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter({segments(x)}, lambda s: NOT {is_version('s')}), "
        "lambda s: CASE WHEN regexp_matches(trim(s), '^\\{.*\\}$') THEN '{}' ELSE lower(trim(s)) END), '/')"
    )


def mean(x: str) -> str:
    """The mean of values of up to six decimals, rounded half up to six: whole numbers only, so in any order."""
    total, n = f"sum(CAST(round({x} * 1000000) AS HUGEINT))", f"count({x})"
    return f"CASE WHEN {n} > 0 THEN CAST(sign({total}) * ((2 * abs({total}) + {n}) // (2 * {n})) AS DOUBLE) / 1000000 END"


def method(x: str) -> str:
    return f"upper(trim(coalesce({x}, '')))"


def concepts(x: str) -> str:
    t = f"translate(lower(coalesce({x}, '')), '-_', '  ')"
    parts = [f"CASE WHEN {' OR '.join(f'contains({t}, {m!r})' for m in marks)} THEN '{style}' END" for style, marks in AUTH_STYLES]
    return f"list_filter([{', '.join(parts)}], lambda s: s IS NOT NULL)"


def page_text(x: str) -> str:
    t = f"regexp_replace(regexp_replace(coalesce({x}, ''), '>\\s+<', '><', 'g'), '<!--.*?(?:-->|\\z)', '', 'gs')"
    for tag in DROPPED:
        t = f"regexp_replace({t}, '<{tag}(\\s[^>]*)?>.*?(?:</{tag}\\s*>|\\z)', '', 'gis')"
    t = f"regexp_replace({t}, '</?({LINE_ENDS})(\\s[^>]*)?/?>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '</?[A-Za-z][^>]*>|<[!?/][^>]*>', '', 'g')"
    for name, char in ENTITIES:
        t = f"replace({t}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[ \\n]+|[ \\n]+$', '', 'g') || chr(10)"
