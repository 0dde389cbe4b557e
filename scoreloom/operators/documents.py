"""Document and crawl-record jobs: page text, hashes, context under a budget, robots rules, probes."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions.scan import depths, let
from .running import summed_before

# Elements dropped with their content, and elements that end a line.
DROPPED = ("script", "style", "noscript", "svg", "head", "nav", "footer", "form")
LINE_ENDS = "p|div|section|article|li|ul|ol|table|tr|h[1-6]|pre|br|header|title"
#: Names of character references, as the HTML standard has them: those that a semicolon ends, and the old ones that may
#: go without (a lookup reads from the front: the frequent ones stand there); what numbers 128 to 159 stand for; and numbers that stand for nothing.
NAMED = {name: html5[f"{name};"] for name in ("amp", "lt", "gt", "quot", "nbsp", "apos", *(n[:-1] for n in html5 if n.endswith(";")))}
BARE = {name: chars for name, chars in html5.items() if not name.endswith(";")}
WINDOWS = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
NOTHING = [*range(1, 9), 11, *range(14, 32), 127]
#: What follows the name of a tag, up to its end: a quoted value may hold ">" but no "<"; a lone quote is a character.
_REST = r"(?=[\s/>])(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+>"
#: White space that is all there is between two tags.
_GAP = r"(?i)(?U)>(?:\s|&(?:nbsp|ensp|emsp|thinsp|#160|#xa0);)++<"
#: Line ends beside the plain one.
_LINES = r"\r\n?|[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# Page roles in the order of the budget, and where robots rules come from.
ROLES = ("api-reference", "topic-guide", "getting-started")
CHARS_PER_TOKEN = 4
CUT_MARK = "\n[... truncated to fit context budget ...]"
MIN_TEXT_BYTES = 200
MOST_REPLACED = 0.05
MOST_WAIT = 600.0
RULES, ABSENT, REFUSED, UNREACHABLE, NO_HOST, NO_GROUP = (
    "robots.txt", "no-robots-txt", "robots.txt-refused", "robots.txt-unreachable", "host-does-not-resolve", "robots.txt-no-group-for-agent",
)


def _outside_dropped(t: Column, tags: tuple[str, ...]) -> Column:
    """``t`` without the elements named, however they nest: text counts where as many have ended as have begun.

    The text is cut before each of their tags; the depth after each piece's tag says whether the piece stays.
    """
    tag = rf"</?(?:{'|'.join(tags)}){_REST}"

    def kept(pieces: Column) -> Column:
        heads = F.transform(pieces, lambda p: F.regexp_extract(p, f"(?i)^{tag}", 0))

        def outside(hs: Column) -> Column:
            change = lambda h: F.when((h == "") | h.endswith("/>") & ~h.startswith("</"), 0).when(h.startswith("</"), -1).otherwise(1)
            rest = lambda p, k: F.substring(p, F.length(F.get(hs, k)) + 1, F.length(p))
            return let(depths(F.transform(hs, change)), lambda ds: F.array_join(F.transform(pieces, lambda p, k: F.when(F.get(ds, k) == 0, rest(p, k)).otherwise("")), ""))

        return let(heads, outside)

    return let(F.split(t, f"(?i)(?={tag})"), kept)


def _references_decoded(t: Column, ended: bool) -> Column:
    """Character references by number and by name.  A name without a semicolon is the longest old one it begins with;
    with ``ended``, what no semicolon ends is text."""
    table = lambda values: F.from_json(F.lit(json.dumps(values)), "map<string,string>")
    number_at, name_at = rf"^&#([0-9]+|[xX][0-9A-Fa-f]+);{'' if ended else '?'}", r"^&([A-Za-z][A-Za-z0-9]{0,31});"
    old_at = f"^&({'|'.join(sorted(BARE, key=len, reverse=True))})"

    def by_number(number: Column) -> Column:
        hexed = F.lower(number).startswith("x")
        code = F.when(hexed, F.conv(F.substring(number, 2, 1 << 30), 16, 10)).otherwise(number).try_cast("bigint")
        valid = F.coalesce(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.lit(False))
        nothing = code.isin(*NOTHING) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        safe = F.when(valid, code).otherwise(0xFFFD)
        char = F.coalesce(F.element_at(table(WINDOWS), safe.cast("string")), F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))
        return F.when(valid & nothing, "").otherwise(char)

    def decoded(piece: Column) -> Column:
        number, name, old = (F.regexp_extract(piece, p, 1) for p in (number_at, name_at, old_at))
        rest = lambda pattern: F.substring(piece, F.length(F.regexp_extract(piece, pattern, 0)) + 1, F.length(piece))
        named = F.element_at(table(NAMED), F.when(name != "", name))
        out = F.when(number != "", F.concat(by_number(number), rest(number_at))).when(named.isNotNull(), F.concat(named, rest(name_at)))
        return (out if ended else out.when(old != "", F.concat(F.element_at(table(BARE), old), rest(old_at)))).otherwise(piece)

    # Most pieces begin with no reference, and only the first does not begin with "&".
    return F.array_join(F.transform(F.split(t, "(?=&)"), lambda piece: F.when(piece.startswith("&"), decoded(piece)).otherwise(piece)), "")


def page_text(html: Column, ended: bool = False) -> Column:
    """Text of a page: some elements dropped whole, one line a block, single spaces, at most one blank line in a row.

    A null page is empty.  White space alone between two tags is nothing.  A script or style ends at its first end tag,
    a comment at its first end; one that never ends drops the rest of the page, and so does one of the other dropped
    elements, which may nest.  A "<" that begins no tag, or after which no tag ends, is text.  Browsers also read old
    references that no semicolon ends; with ``ended`` these stay as they are written.  Linear in the page.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _GAP, "><"), r"(?s)<!--.*?(?:-->|\z)", "")
    last = F.substring_index(t, ">", -1)
    # After the last ">" no tag can end, so what looks like one there is text; no pattern has to look for its end.
    t = F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(last)), F.replace(last, F.lit("<"), F.lit("&lt;")))
    for tag in DROPPED[:2]:
        t = F.regexp_replace(t, rf"(?is)<{tag}{_REST}.*?(?:</{tag}\s*>|\z)", "")
    t = _outside_dropped(t, DROPPED[2:])
    t = F.regexp_replace(t, rf"(?i)</?(?:{LINE_ENDS}){_REST}", "\n")
    t = F.regexp_replace(t, rf"</?[A-Za-z][^\s/>]*+{_REST}|<[!?/][^>]*+>", "")
    t = F.regexp_replace(_references_decoded(t, ended), _LINES, "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?U)(?<![^\S\n])[^\S\n]*+\n[^\S\n]*+", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(t, r"(?U)^\s++|(?<!\s)\s++\z", ""), F.lit("\n"))


def document_record(texts: DataFrame) -> DataFrame:
    """Adds byte_size, content_hash and below_floor (unless ``short_ok`` gives a written reason)."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    reason = N.strip(F.coalesce("short_ok", F.lit("")))
    return texts.withColumns({
        "byte_size": size.cast("long"), "content_hash": F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256)),
        "below_floor": (size < MIN_TEXT_BYTES) & (reason == ""),
    })


def undecodable(text: Column) -> Column:
    n = F.length(text)
    return F.coalesce((n > 0) & ((n - F.length(F.replace(text, F.lit("�"), F.lit("")))) / n > MOST_REPLACED), F.lit(False))


def role_rank(role: Column) -> Column:
    out = F.lit(len(ROLES))
    for k, r in enumerate(ROLES):
        out = F.when(role == r, k).otherwise(out)
    return out


def assemble_context(pages: DataFrame, budget_tokens: int, label: str) -> DataFrame:
    """(task_id, used, context): pages by role and position, each under a header, until the budget is spent.

    ``pages``: task_id, pos, role, url, text.  A fold over one task's pages, since what a cut page leaves free
    depends on its trimmed end.  Pages that the headers and the shortest bodies of those before them leave no room for
    go first, so one row holds no more than the budget asks for, however many pages a task has.  Null positions come
    first, a null task_id is a task, a null url an empty one.
    """
    budget = budget_tokens * CHARS_PER_TOKEN
    text = F.substring(N.strip(F.coalesce("text", F.lit(""))), 1, budget + 1)
    head = F.concat(F.lit(f"\n===== {label}: "), F.coalesce("url", F.lit("")), F.lit(" =====\n"))
    usable = pages.select("task_id", "pos", role_rank(F.col("role")).alias("_rank"), head.alias("_head"), text.alias("_t")).filter(F.col("_t") != "")
    least = F.length("_head") + F.least(F.length("_t"), F.lit(len(CUT_MARK)))
    # Only lengths are run up; they grow along the order, so one place per task says which of its texts are read.
    lengths = usable.select("task_id", "pos", "_rank", least.cast("long").alias("_least"))
    fits = summed_before(lengths, ["task_id"], "pos", {"_before": F.col("_least")}, F.col("_rank")).filter(F.col("_before") < budget)
    last = fits.groupBy(F.col("task_id").alias("_task")).agg(F.max(F.struct("_rank", "pos")).alias("_last"))
    usable = usable.join(last, F.col("task_id").eqNullSafe(F.col("_task"))).filter(F.struct("_rank", "pos") <= F.col("_last"))
    rows = usable.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), "pos", F.col("_head").alias("head"), F.col("_t").alias("text")))).alias("p"))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("blocks"))

    def step(acc: Column, page: Column) -> Column:
        left = F.lit(budget) - acc["used"] - F.length(page["head"])
        cut = F.concat(F.regexp_replace(F.substring(page["text"], F.lit(1), F.greatest(left, F.lit(0))), r"(?U)\s+$", ""), F.lit(CUT_MARK))
        body = F.when(F.length(page["text"]) > left, cut).otherwise(page["text"])
        taken = F.struct((acc["used"] + F.length(page["head"]) + F.length(body)).alias("used"), F.lit(False).alias("done"),
                         F.concat(acc["blocks"], F.array(F.concat(page["head"], body))).alias("blocks"))
        stopped = F.struct(acc["used"].alias("used"), F.lit(True).alias("done"), acc["blocks"].alias("blocks"))
        return F.when(acc["done"], acc).when(left <= 0, stopped).otherwise(taken)

    folded = rows.withColumn("f", F.aggregate("p", start, step))
    return folded.select("task_id", F.col("f.used").alias("used"), F.array_join("f.blocks", "\n").alias("context"))


def _robots_lines(bodies: DataFrame) -> DataFrame:
    """(host, pos, field, value, grp) of the lines that count; a user-agent line after a rule begins a group."""
    lines = bodies.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
    clean = lines.withColumn("line", N.strip(F.substring_index("line", "#", 1))).filter(F.col("line").contains(":"))
    name = F.lower(N.strip(F.substring_index("line", ":", 1)))
    value = N.strip(F.substring(F.col("line"), F.instr("line", ":") + 1, F.length("line")))
    kept = clean.select("host", "pos", name.alias("field"), value.alias("value")).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("host").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("field") != "crawl-delay", F.col("field")), ignorenulls=True).over(before)
    starts = (F.col("field") == "user-agent") & (F.coalesce(last, F.lit("allow")) != "user-agent")
    return kept.withColumn("grp", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("grp > 0")


def robots_rules(bodies: DataFrame) -> DataFrame:
    """(host, agent, pos, kind, pattern): every rule for every agent of its group.  Windows run per host's file."""
    lines = _robots_lines(bodies)
    agents = lines.filter("field = 'user-agent'").select("host", "grp", F.lower("value").alias("agent")).distinct()
    rules = lines.filter(F.col("field").isin("allow", "disallow")).select("host", "grp", "pos", F.col("field").alias("kind"), F.col("value").alias("pattern"))
    return agents.join(rules, ["host", "grp"]).select("host", "agent", "pos", "kind", "pattern")


def robots_agents(bodies: DataFrame) -> DataFrame:
    """(host, agent, crawl_delay): every group name with the slowest delay that stands below it in its group."""
    lines = _robots_lines(bodies)
    agents = lines.filter("field = 'user-agent'").select("host", "grp", F.col("pos").alias("apos"), F.lower("value").alias("agent"))
    number = F.expr("try_cast(value AS double)")
    delays = lines.filter("field = 'crawl-delay'").select("host", "grp", F.col("pos").alias("dpos"), number.alias("d"))
    delays = delays.filter(F.col("d").isNotNull() & ~F.isnan("d") & (F.col("d") >= 0) & (F.col("d") < float("inf")))
    joined = agents.join(delays, ["host", "grp"], "left")
    return joined.groupBy("host", "agent").agg(F.max(F.when(F.col("apos") < F.col("dpos"), F.col("d"))).alias("crawl_delay"))


def robots_policy(responses: DataFrame, agents: DataFrame, user_agent: str) -> DataFrame:
    """(host, source, agent_group, crawl_delay).  ``responses``: host, status (-1 no host, 0 no answer)."""
    ua = user_agent.lower()
    named = agents.filter((F.col("agent") != "") & (F.col("agent") != "*") & F.contains(F.lit(ua), F.col("agent")))
    best = named.groupBy("host").agg(F.max_by(F.struct("agent", "crawl_delay"), F.struct(F.length("agent"), "agent")).alias("b"))
    star = agents.filter("agent = '*'").select("host", F.struct("agent", "crawl_delay").alias("s"))
    some = agents.select("host").distinct().withColumn("_some", F.lit(True))
    joined = responses.join(best, "host", "left").join(star, "host", "left").join(some, "host", "left")
    chosen = F.coalesce("b", "s")
    status = F.col("status")
    source = (
        F.when(status == -1, NO_HOST).when((status == 0) | (status >= 500), UNREACHABLE).when(status.isin(401, 403), REFUSED)
        .when(status >= 400, ABSENT).when(F.col("_some").isNull(), ABSENT).when(chosen.isNull(), NO_GROUP).otherwise(RULES)
    )
    ruled = F.col("source") == RULES
    return joined.withColumns({"source": source}).select(
        "host", "source", F.when(ruled, chosen["agent"]).otherwise("*").alias("agent_group"), F.when(ruled, chosen["crawl_delay"]).alias("crawl_delay")
    )


def _rule_pattern(pattern: Column) -> Column:
    """A robots pattern as a regular expression from the start: * any run, a last $ the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(body, r"([\\\[\](){}.+?^$|\-])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("(?s)^"), quoted, F.when(pattern.endswith("$"), r"\z").otherwise(""))


#: A rule with a wildcard and neither a longer start nor a fixed end is found by so many characters of its longest piece.
GRAM = 4


def _anchor(pattern: Column) -> Column:
    """(how, anchor): a string that every path has at its start, at its end, or somewhere, where the pattern matches it."""
    body, ends = F.regexp_replace(pattern, r"\$$", ""), pattern.endswith("$")
    parts = F.split(body, r"\*")
    start, end = F.get(parts, F.lit(0)), F.when(ends & (F.size(parts) > 1), F.element_at(parts, -1)).otherwise("")
    longest = F.array_max(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return (
        F.when((F.length(end) > F.length(start)), F.struct(F.lit("end").alias("how"), end.alias("anchor")))
        .when((F.length(start) < GRAM) & (F.length(longest) >= GRAM), F.struct(F.lit("piece").alias("how"), F.left(longest, F.lit(GRAM)).alias("anchor")))
        .otherwise(F.struct(F.lit("start").alias("how"), start.alias("anchor")))
    )


def _matching_rules(known: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, kind, pattern) of the rules of an address's host and group that match it.

    Rules meet addresses by equality of their anchors: the path's starts and ends of the lengths that occur among the
    host's rules, and its pieces of GRAM characters where the host has rules found by these.  Patterns are tried on what
    is found, so a host's addresses do not meet all its rules.
    """
    own = rules.filter("pattern <> ''").select("host", F.col("agent").alias("agent_group"), "kind", "pattern", _anchor(F.col("pattern")).alias("_a"))
    own = own.select("host", "agent_group", "kind", "pattern", "_a.how", "_a.anchor")
    lengths = lambda how: F.collect_set(F.when(F.col("how") == how, F.length("anchor")))
    shapes = own.groupBy("host", "agent_group").agg(lengths("start").alias("_starts"), lengths("end").alias("_ends"), F.bool_or(F.col("how") == "piece").alias("_pieces"))
    n = F.length("path")
    key = lambda how, text: F.struct(F.lit(how).alias("how"), text.alias("anchor"))
    fits = lambda column: F.filter(column, lambda k: k <= n)
    grams = F.when(F.col("_pieces") & (n >= GRAM), F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: key("piece", F.substring(F.col("path"), i, F.lit(GRAM)))))
    keys = F.array_distinct(F.concat(
        F.transform(fits("_starts"), lambda k: key("start", F.left(F.col("path"), k))), F.transform(fits("_ends"), lambda k: key("end", F.right(F.col("path"), k))),
        F.coalesce(grams, F.array().cast("array<struct<how:string,anchor:string>>")),
    ))
    found = known.select("url", "host", "agent_group", "path").distinct().join(shapes, ["host", "agent_group"]).select("url", "host", "agent_group", "path", F.inline(keys))
    hits = found.join(own, ["host", "agent_group", "how", "anchor"])
    plain = ~F.col("pattern").rlike(r"\*|\$$") & (F.col("how") == "start")
    return hits.filter(plain | F.regexp_like("path", _rule_pattern(F.col("pattern")))).select("url", "kind", "pattern")


def url_verdict(urls: DataFrame, policy: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds allowed and rule.  ``urls``: url, host, path (with query).  The longest matching pattern wins, allow on a tie."""
    known = urls.join(policy, "host", "left")
    hits = _matching_rules(known, rules)
    width = F.length(F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"\*", ""))
    order = F.struct(width, (F.col("kind") == "allow").cast("int"), F.col("pattern"))
    best = hits.groupBy("url").agg(F.max_by(F.struct("kind", "pattern"), order).alias("r"))
    joined = known.join(best, "url", "left")
    closed = F.coalesce(F.col("source") == UNREACHABLE, F.lit(False))
    ruled = ~closed & F.col("r").isNotNull()
    return joined.withColumns({
        "allowed": ~closed & (F.col("r").isNull() | (F.col("r.kind") == "allow")),
        "rule": F.when(ruled, F.concat(F.initcap("r.kind"), F.lit(": "), "r.pattern")),
    }).select("url", "host", "source", "agent_group", "allowed", "rule")


def robots_audit(verdicts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per source: addresses, refused ones, and those whose recorded flag (url, robots_disallowed) differs."""
    joined = verdicts.join(recorded, "url", "left")
    drift = (~F.col("allowed")) != F.coalesce("robots_disallowed", F.lit(False))
    return joined.groupBy("source").agg(
        F.count("*").alias("checked"), F.count_distinct("host").alias("hosts"), F.count_if(~F.col("allowed")).alias("disallowed"), F.count_if(drift).alias("drift")
    )


def soft404_baseline(probes: DataFrame) -> DataFrame:
    """Per host, from probes of paths that cannot exist: established, status, signature, soft404, honest404."""
    failed = F.col("error").isNotNull() | F.col("status").isNull()
    sign = N.signature(F.col("text"))
    rows = probes.withColumns({"_s": sign, "_bad": failed})
    out = rows.groupBy("host").agg(
        F.bool_or("_bad").alias("_bad"), F.count_distinct("status", "_s").alias("_n"), F.min("status").alias("status"), F.min("_s").alias("signature")
    )
    fine = ~F.col("_bad") & (F.col("_n") == 1)
    return out.select(
        "host", fine.alias("established"), F.when(fine, F.col("status")).alias("status"), F.when(fine, F.col("signature")).alias("signature"),
        (fine & F.col("status").between(200, 299)).alias("soft404"), (fine & (F.col("status") == 404)).alias("honest404"),
    )


def spec_probe_verdict(probes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds verdict.  ``probes``: host, path, status, error, text, body, disallowed."""
    base = baseline.select("host", "established", F.col("soft404").alias("_soft"), F.col("signature").alias("_sig"))
    status = F.col("status")
    body = F.expr("try_parse_json(body)")
    # A description says so by a key of its outermost mapping.
    is_object = F.schema_of_variant(body).startswith("OBJECT")
    is_spec = F.coalesce(is_object & (F.try_variant_get(body, "$.openapi", "variant").isNotNull() | F.try_variant_get(body, "$.swagger", "variant").isNotNull()), F.lit(False))
    established = F.coalesce("established", F.lit(False))
    verdict = (
        F.when(F.col("disallowed"), "disallowed").when(F.col("error").isNotNull() | status.isNull(), "unreachable").when(status == 404, "honest-404")
        .when((status >= 500) | (status < 200), "unreachable").when(status.between(300, 399), "not-a-spec")
        .when(established & F.col("_soft") & (N.signature(F.col("text")) == F.col("_sig")), "shell-indistinguishable")
        .when(~is_spec, "not-a-spec").when(~established, "spec-unverified").otherwise("spec")
    )
    return probes.join(base, "host", "left").withColumn("verdict", verdict).drop("established", "_soft", "_sig")


def crawl_wait(requests: DataFrame, policy: DataFrame, explicit: float | None = None, issued: int = 1, most: float = MOST_WAIT) -> DataFrame:
    """Seconds that the requests of each host would wait, where that number comes from, and whether it is refused."""
    counts = requests.groupBy("host").agg(F.count("*").alias("requests"))
    joined = counts.join(policy.select("host", "crawl_delay"), "host", "left")
    delay = F.lit(explicit).cast("double") if explicit is not None else F.coalesce("crawl_delay", F.lit(0.0))
    source = F.lit("explicit") if explicit is not None else F.when(F.col("crawl_delay").isNotNull(), "robots").otherwise("none-declared")
    owed = F.col("requests") if issued else F.greatest(F.col("requests") - 1, F.lit(0))
    return joined.select("host", "requests", source.alias("source"), (delay * owed).alias("wait"), (delay * owed > most).alias("refused"))
