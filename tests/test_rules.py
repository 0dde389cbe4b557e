"""The rules that tables rarely exercise, on literals."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import normal as N
from scoreloom.operators import aggregate as E
from scoreloom.operators import archive as A
from scoreloom.operators import documents as H
from scoreloom.operators import matching as M
from scoreloom.sources import answers as B
from scoreloom.sources import archive as S


def values(spark, column, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in rows.orderBy("k").select(column(F.col("t")).alias("v")).collect()]


def test_paths(spark):
    assert values(spark, N.normalize_path, "https://{tenant}.x/v3/Users/{id}?q=1", "host.tld/2.0/A", "/oauth/beta", None, "v99//x") == [["users", "{}"], ["a"], [], [], ["x"]]
    assert values(spark, N.states_host, "a.b/c", "/a.b/c", "http:x", None) == [True, False, False, False]


def test_versions(spark):
    assert values(spark, N.normalize_version, " /V2 ", "<none>", "ledger/v1", "v2.0", "a/b/v1", None, "(--)") == ["v2", "", "v1", "2.0", "a/b/v1", "", ""]
    assert values(spark, N.version_tuples, "35.011 and v35.11, not x9 nor 1.a", "") == [[[35, 11], [35, 11]], []]


def test_version_satisfies(spark):
    check = lambda a, b: spark.range(1).select(N.version_satisfies(F.lit(a), F.lit(b))).first()[0]
    assert check("38", "38.01") and check("31", "31 or 32") and check("35.011", "35.11")
    assert not check("31.00.01", "31") and not check("x", "31") and not check("3", "31")


def test_auth_order(spark):
    assert values(spark, N.canonical_auth_flow, "HMAC over the api key", "Bearer from client_credentials", "implicitly", None) == ["hmac-signature", "oauth2-client-credentials", "unknown", "unknown"]


def test_rounding_is_half_even(spark):
    cells = spark.createDataFrame([(0.125,), (0.135,), (None,)], "x double").select(N.pct_cell(F.col("x"))).collect()
    assert [c[0] for c in cells] == ["12%", "14%", "n/a"]


def test_prefix_goes_once(spark):
    out = spark.range(1).select(N.strip_base_prefix(F.array(*map(F.lit, ["a", "a", "b"])), [["a"], ["b"]])).first()[0]
    assert out == ["a", "b"]


def test_matching_equals_greedy(spark):
    """The rank join against the loop that takes the first unused equal path."""
    rng = random.Random(5)
    key = [(t, p, "GET", f"/{rng.choice('abc')}", "v1") for t in range(40) for p in range(rng.randint(0, 6))]
    ans = [(t, p, "GET", f"/{rng.choice('abc')}", "v1") for t in range(40) for p in range(rng.randint(0, 6))]
    schema = "task_id int, pos int, method string, path string, api_version string"
    got = {(r["task_id"], r["pos"]): r["matched"] for r in M.match_endpoints(spark.createDataFrame(key, schema), spark.createDataFrame(ans, schema), ["task_id"]).collect()}
    want = {}
    for t in range(40):
        free = [a[3] for a in ans if a[0] == t]
        for k in (k for k in key if k[0] == t):
            want[t, k[1]] = k[3] in free
            if k[3] in free:
                free.remove(k[3])
    assert got == want


def test_excused_score_needs_a_reason(spark):
    row = spark.createDataFrame([("bearer", "bearer", " ")], "k string, a string, e string")
    with pytest.raises(Exception, match="reason"):
        row.select(M.auth_score(F.col("k"), F.col("a"), None, F.col("e"))).collect()


BLOCK = "```answer-summary\n{}\n```"


def test_answer_blocks(spark):
    good = "endpoints:\n  - method: get\n    path: /x\n    api_version: 2.0\nrequired_scopes: a\nkey_parameters: [x[0].y, z]"
    texts = [BLOCK.format("endpoints: []") + BLOCK.format(good), "none", "", None, BLOCK.format("a: [b"), BLOCK.format("- 1"), BLOCK.format("endpoints: [1]"), BLOCK.format('endpoints: [{}]\nkey_parameters: ["a, b", x[0]]')]
    runs = spark.createDataFrame(list(enumerate(texts)), "k int, raw_response string")
    rows = B.decode_answers(runs).orderBy("k").collect()
    assert rows[0]["endpoints"][0]["api_version"] == "2.0" and rows[0]["required_scopes"] == ["a"] and rows[0]["key_parameters"] == ["x[0].y", "z"] and rows[0]["format_repaired"]
    reasons = ["no answer block", "empty response", "empty response", "invalid YAML", "not a mapping", "endpoints[0] is not a mapping", "invalid YAML"]
    assert [r["failure_reason"] for r in rows] == [None, *reasons]


def test_docs_answers_stay_as_written(spark):
    texts = [BLOCK.format("firmware_version: 35.010\ncatalog_numbers: null"), BLOCK.format("x: 1")]
    rows = B.decode_docs_answers(spark.createDataFrame(list(enumerate(texts)), "k int, raw_response string")).orderBy("k").collect()
    assert (rows[0]["firmware_version"], rows[0]["format_failure"], rows[1]["format_failure"]) == ("35.010", False, True)


def test_means_of_means_differ_from_pooled(spark):
    scores = spark.createDataFrame([("c", "t1", 0, "d", 1.0), ("c", "t1", 1, "d", 1.0), ("c", "t2", 0, "d", 0.0), ("c", "t2", 1, "d", None)], "condition string, task_id string, run_index int, dim string, score double")
    agg = E.aggregate_runs(scores)
    pooled = agg.filter("overall = 1").first()["mean"]
    groups = E.rollup_by_group(agg.filter("overall = 0").select("task_id", "dim", "mean"), spark.createDataFrame([("t1", "g"), ("t2", "g")], "task_id string, grp string"), spark.createDataFrame([("g", 0), ("none", 1)], "grp string, pos int"))
    rows = {r["grp"]: r for r in E.group_overall(groups).collect()}
    assert pooled == pytest.approx(2 / 3, abs=1e-6) and rows["g"]["overall"] == 0.5 and rows["none"]["overall"] is None


def test_one_cohort_only(spark):
    with pytest.raises(ValueError):
        E.require_one_cohort(spark.createDataFrame([("a",), ("b",)], "cohort string"))


def test_breaker_is_strict(spark):
    rows = [("c", k, k % 5 == 0) for k in range(20)] + [("d", k, k < 5) for k in range(30)]
    out = {r["condition"]: r["trip_pos"] for r in A.format_failure_breaker(spark.createDataFrame(rows, "condition string, pos int, format_failure boolean"), ["condition"]).collect()}
    assert out == {"c": None, "d": 19}


def test_reconcile_refuses_drift(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "k int, cost double, dims string")
    b = spark.createDataFrame([(1, 2.5, "y")], "k int, cost double, dims string")
    with pytest.raises(ValueError):
        A.reconciled(a, b, ["k"], ["cost"], ["dims"])
    assert A.reconciled(a, b.withColumn("cost", F.lit(2.0)), ["k"], ["cost"], ["dims"]).first()["dims"] == "y"


def test_context_budget(spark):
    pages = spark.createDataFrame([("t", 0, "other", "u0", "z" * 90), ("t", 1, "api-reference", "u1", "a" * 50), ("t", 2, "topic-guide", "u2", " \n")], "task_id string, pos int, role string, url string, text string")
    row = H.assemble_context(pages, 30, "doc").first()
    assert row["context"].startswith("\n===== doc: u1 =====\n" + "a" * 50 + "\n\n===== doc: u0 =====\n" + "z" * 28) and row["context"].endswith("budget ...]")


def test_robots_groups(spark):
    body = "Disallow: /early\nUser-agent: a\nCrawl-delay: 3\nUser-agent: b\nDisallow: /x # c\nCrawl-delay: 5\nUser-agent: a\nAllow: /x/y\n"
    bodies = spark.createDataFrame([("h", body)], "host string, body string")
    rules = {(r["agent"], r["kind"], r["pattern"]) for r in H.robots_rules(bodies).collect()}
    assert rules == {("a", "disallow", "/x"), ("b", "disallow", "/x"), ("a", "allow", "/x/y")}
    assert {r["agent"]: r["crawl_delay"] for r in H.robots_agents(bodies).collect()} == {"a": 5.0, "b": 5.0}


def test_html(spark):
    assert values(spark, H.page_text, "<head><title>t</title></head><p>a  b</p><script>x</script>\n\n<div>c &amp; d</div><nav>n</nav>", None) == ["a b\n\nc & d\n", "\n"]
    pages = [
        "<nav>a<nav>b</nav>c</nav>d<svg/>e</form>f", "x<FORM action='y'>a<footer>b</form>c</footer>d", "a<nav>b", "<header>h</header>i",
        "&#8217;&#x1F600;&#39 &eacute;&hellip;&amp;lt;&nosuch;&#0;&#128;&#xD800;&#9999999999; & &", "<p>&lt;nav&gt;a</p>",
        "a" + "<nav>" * 9 + "b<p>" * 50000 + "</nav>" * 9 + "c", "</nav>a<svg>b<form>c</nav>d</svg>e<nav>x<b>y</b></nav>" + "f<footer>g",
    ]
    assert values(spark, H.page_text, *pages) == ["def\n", "xd\n", "a\n", "h\ni\n", "\u2019\U0001F600' \u00e9\u2026&lt;&nosuch;\ufffd\u20ac\ufffd\ufffd & &\n", "<nav>a\n", "ac\n", "aef\n"]


def test_html_details(spark):
    cases = {
        "<html><head><title>T</title><style>.a{color:red}</style></head>\n<body><script>var x=1;</script><p>Hello <b>world</b></p></body></html>": "Hello world",
        "<p>one</p><p>two</p>": "one\n\ntwo", "<p>A&amp;B</p>": "A&B", "<p>a     b\t\tc</p>": "a b c", "<html><body></body></html>": "",
        "<nav>menu links</nav><p>real content</p><footer>copyright</footer>": "real content",
        # White space alone between two tags is nothing, beside text it counts.
        "<b>a</b> <b>b</b>&nbsp;<i>c</i>, <i>d</i>": "abc, d",
        # References: the longest old name where there is no semicolon; numbers that stand for nothing.
        "&ampx &copy2 &notit; &notin; &amp &nosuch &#65x&#1;&#xFFFE;y &#99999999999999999999;": "&x ©2 ¬it; ∉ & &nosuch Axy \ufffd",
        # What is no tag is text; an end in quotes ends no tag; comments and scripts without an end drop the rest.
        "a < b > c <3 <p title='x>y'>d": "a < b > c <3\nd", '<img alt="a > b">e <a x="1>f</a>': "e f", "g<!-- h": "g", "i<script>j</p>": "i", "k <p": "k <p", "l</>m</ n>o": "lmo",
        # Lines end in several ways, and are bare of any white space.
        "<pre>a\r\nb\rc\u2028d \u00a0\n\u00a0e</pre>": "a\nb\nc\nd\ne",
    }
    assert values(spark, H.page_text, *cases) == [v + "\n" for v in cases.values()]


@pytest.mark.parametrize(
    "page",
    ["</nav>x" * 150_000, "<nav>x" * 150_000, "<nav>" * 100_000 + "x" + "</nav>" * 100_000, "<a " * 350_000, "<script " * 120_000, "<script>" * 120_000, "<!--" * 250_000, "&x" * 300_000, "&amp" * 200_000,
     "\u00a0" * 500_000 + "x", " \n" * 300_000 + "x", "<p x='" * 150_000 + ">y", "<" * 1_000_000],
    ids=["ends", "begins", "nested", "open", "script", "scripts", "comments", "names", "old", "blank", "lines", "quotes", "less"],
)
def test_html_time_is_linear(spark, page):
    values(spark, H.page_text, "<p>warm</p>")
    began = time.perf_counter()
    values(spark, H.page_text, page)
    assert time.perf_counter() - began < 15


def test_search_equals_brute_force(spark):
    """Names over several automata, with bounds of any word, in texts with letters whose lower case is longer."""
    from scoreloom.operators import search

    rng = random.Random(6)
    parts = ["ab", "Ab", "é", "É", "İ", "ΑΣ", "_", "-", " ", "x", "\u0301", "中", "9"]
    texts = [(k, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for k in range(150)] + [(500, None), (501, "ab"), (501, "é")]
    names = sorted({"".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(60)}) + [" ", ""]
    every = [(n, f, b) for n in names for f in (False, True) for b in ("none", "ascii", "unicode")]
    word = {"ascii": "A-Za-z0-9_", "unicode": "\\w\u0301"}

    def holds(text: str, name: str, folds: bool, bounds: str) -> bool:
        low = lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s) if folds else s
        text, name = (low(text), low(name)) if folds else (text, name)
        # Bounds are those of the text as it stands; folding changes no letter into another kind of character.
        return re.search(re.escape(name) if bounds == "none" else rf"(?<![{word[bounds]}]){re.escape(name)}(?![{word[bounds]}])", text) is not None

    want = sorted((k, n, f, b) for k, t in texts if t for n, f, b in every if n.strip() and holds(t, n, f, b))
    df, declared = spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(every, "name string, f boolean, b string")
    old, search.AUTOMATON_CHARS = search.AUTOMATON_CHARS, 1500
    try:
        got = search.occurrences(df, declared, "k", F.col("name"), F.col("f"), F.col("b")).collect()
    finally:
        search.AUTOMATON_CHARS = old
    assert sorted(map(tuple, got)) == want
    assert search.occurrences(df, declared.limit(0), "k", F.col("name"), F.col("f"), F.col("b")).count() == 0


@pytest.mark.parametrize("text", ["aAb" * 350_000, "中文" * 500_000, "ab_" * 350_000], ids=["letters", "prose", "words"])
def test_search_time_is_linear(spark, text):
    tokens = spark.createDataFrame([(f"tok{k}" * (1 + k % 9), "word") for k in range(2000)] + [("aab", "substring"), ("ab", "word"), ("文中", "cased")], "token string, kind string")
    lines = spark.createDataFrame([(1, text)], "k int, text string")
    began = time.perf_counter()
    found = {r["token"] for r in A.token_leak_scan(lines, tokens, "k").collect()}
    assert time.perf_counter() - began < 15 and found == {"a": {"aab"}, "中": {"文中"}}.get(text[0], set()) if text[:3] != "ab_" else not found


def test_longest_rule_wins_among_many(spark):
    """Rules found by their anchors decide as all rules of a host would."""
    rng = random.Random(8)
    pieces = ["/", "a", "bc", "*", ".html", "?id=", "$", "longer-piece", "é"]
    rules = [("h" if k % 3 else "g", "*", k, rng.choice(["allow", "disallow"]), "/" + "".join(rng.choices(pieces, k=rng.randint(0, 5)))) for k in range(300)]
    rules = [(h, a, k, kind, p if rng.random() < 0.7 else p.rstrip("$") + "$") for h, a, k, kind, p in rules] + [("h", "*", 900, "allow", ""), ("h", "*", 901, "allow", "*"), ("h", "*", 902, "disallow", "$"), ("g", "other", 903, "disallow", "/")]
    paths = ["/" + "".join(rng.choices([p for p in pieces if p not in "*$"], k=rng.randint(0, 6))) for _ in range(200)] + ["", "/$", "/a*b"]
    urls = sorted({(f"{h}{p}", h, p) for p in paths for h in ("h", "g", "none")})

    def matches(pattern: str, path: str) -> bool:
        body = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$"))
        return re.match(f"(?s){body}" + (r"\Z" if pattern.endswith("$") else ""), path) is not None

    want = {}
    for url, host, path in urls:
        best = max(((len(p.removesuffix("$").replace("*", "")), kind == "allow", p.encode(), kind, p) for h, a, _, kind, p in rules if h == host and a == "*" and p and matches(p, path)), default=None)
        want[url] = (best is None or best[3] == "allow", None if best is None else f"{best[3].capitalize()}: {best[4]}")
    policy = spark.createDataFrame([(h, H.RULES, "*") for h in ("h", "g")], "host string, source string, agent_group string")
    out = H.url_verdict(spark.createDataFrame(urls, "url string, host string, path string"), policy, spark.createDataFrame(rules, "host string, agent string, pos int, kind string, pattern string"))
    assert {r["url"]: (r["allowed"], r["rule"]) for r in out.collect()} == want


def test_a_failed_audit_leaves_what_is_published(spark, tmp_path):
    from scoreloom.sources import publish as P

    base, keys = str(tmp_path / "out"), ["task_id", "run_index"]
    schema = "task_id string, run_index int, raw_response string, score double"
    archive = spark.createDataFrame([("t", k, f"text {k}", 0.0) for k in range(6)], schema)
    totals = lambda x: x.agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    publish = lambda rows, c="c": P.publish_condition(rows, archive, base, c, keys, ["raw_response"], ["score"], totals)
    files = lambda: sorted(str(f.relative_to(base)) for f in (tmp_path / "out").rglob("*.parquet"))
    assert publish(archive).first() == (6, 0.0) and publish(archive, "d").first() == (6, 0.0)
    before = files()
    bad = {
        "duplicate key": archive.union(archive.limit(1)), "not run": archive.limit(4), "drift: raw_response": archive.withColumn("raw_response", F.upper("raw_response")),
        "not published": archive.union(spark.createDataFrame([("u", 0, "x", 1.0)], schema)),
    }
    for problem, rows in bad.items():
        with pytest.raises(P.NotPublished, match=problem):
            publish(rows.withColumn("score", F.lit(1.0)))
        assert files() == before
    with pytest.raises(Exception, match="no aggregate"):
        P.publish_condition(archive, archive, base, "c", keys, ["raw_response"], ["score"], lambda x: x.select(F.raise_error(F.lit("no aggregate")).alias("n")))
    assert files() == before
    assert publish(archive.withColumn("score", F.lit(1.0))).first() == (6, 6.0)
    assert {(r["condition"], r["score"]) for r in P.published(spark, base).collect()} == {("c", 1.0), ("d", 0.0)}
    assert all("_staging" not in f and "_old" not in f for f in files())


def test_gates_run_only_on_packs_that_are_clean(spark):
    from scoreloom.operators import gates as G

    packs, seen = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "pack string"), []

    def gate(bad: list[str], problem: str):
        def run(clean):
            seen.append(sorted(r["pack"] for r in clean.collect()))
            return clean.filter(F.col("pack").isin(bad)).select("pack", F.explode(F.array(F.lit(problem), F.lit(f"{problem} too"))).alias("problem"))

        return run

    got = G.run_gates_by_pack(packs, [("one", gate(["b"], "x")), ("two", gate(["b", "a"], "y"))]).collect()
    assert {r["pack"]: tuple(r)[1:] for r in got} == {"a": ("two", "y", 2), "b": ("one", "x", 2), "c": (None, None, 0)}
    assert seen == [["a", "b", "c"], ["a", "c"]]
    seen.clear()
    G.run_gates_by_pack(packs, [("one", gate(["a", "b", "c"], "x")), ("two", gate([], "y"))]).collect()
    assert len(seen) == 1
    assert {tuple(r)[1:] for r in G.run_gates_by_pack(packs, []).collect()} == {(None, None, 0)}


def test_classified_as_the_rules_say(spark):
    """Random surfaces and endpoints against the rules applied one endpoint at a time."""
    rng = random.Random(11)
    markers = {f"s{k}": rng.sample(["v1", "v2", "v3", "beta"], rng.randint(0, 2)) for k in range(6)}
    placed = [(s, p) for s in markers for p in ("a", "b", "c", "d", "e") if rng.random() < 0.35]
    points = [(k, "/".join(["", *rng.sample(["v1", "v2", "beta"], rng.randint(0, 2)), rng.choice("abcdefz")]), rng.choice(["v1", "V2", "none", "", None, "v3"])) for k in range(250)]

    def bucket(path, version):
        by_path = {x for x in path.split("/") if x in ("v1", "v2", "beta")}
        field = {v for v in [(version or "").lower()] if v not in ("", "none")}
        own = path.split("/")[-1]
        have = sorted(s for s, p in placed if p == own)
        sole = lambda names, said: hits[0] if len(hits := [s for s in names if set(markers[s]) & said]) == 1 else None
        if not have:
            return "unrecognized"
        if len(have) == 1:
            stated = by_path | field
            elsewhere = sole([s for s in markers if s != have[0]], stated)
            return "conflicted" if markers[have[0]] and not set(markers[have[0]]) & stated and elsewhere else have[0]
        one, two = sole(have, by_path), sole(have, field)
        return "conflicted" if one and two and one != two else one or two or "ambiguous"

    df = spark.createDataFrame(points, "k int, path string, api_version string")
    got = A.classify_endpoints(df, spark.createDataFrame(placed, "id string, npath string"), spark.createDataFrame(list(markers.items()), "id string, markers array<string>"))
    want = {k: bucket(p, v) for k, p, v in points}
    assert {r["k"]: r["bucket"] for r in got.collect()} == want and len(set(want.values())) > 5


def test_run_folders(spark, tmp_path):
    for folder in ("2026-07-23-no-context", "odd"):
        (tmp_path / folder / "runs").mkdir(parents=True)
        (tmp_path / folder / "runs" / "a.json").write_text('{"task_id": "t", "run_index": 0, "dimensions": {"endpoint": 1.0, "method": null}}')
    rows = {r["condition"]: r for r in S.read_runs(spark, f"{tmp_path}/*/runs/*.json").collect()}
    assert rows["no-context"]["run_date"] == "2026-07-23" and rows["unknown"]["run_date"] == "odd" and rows["unknown"]["dimensions"] == {"endpoint": 1.0, "method": None}
    S.write_scores(spark.createDataFrame([("a", 1), ("b", 2)], "condition string, x int"), f"{tmp_path}/out")
    S.write_scores(spark.createDataFrame([("a", 3)], "condition string, x int"), f"{tmp_path}/out")
    assert {(r["condition"], r["x"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 3), ("b", 2)}
    assert S.spec_file_sizes(S.stored_files(spark, str(tmp_path / "odd"))).first()["files"] == 1


def test_one_line_lists(spark):
    assert B.listed("a[0].b, {c, d}, 'x, y', ") == ["a[0].b", "{c, d}", "'x, y'"] and B.listed("") == []
    assert [B.listed(x) for x in ("a]", "[a", "'a", 'a, "b', "a][b")] == [None] * 5
    assert B.repair("  key_parameters: [x[0].y, z]\nother: 1") == "  key_parameters:\n  - x[0].y\n  - z\nother: 1"
    assert B.repair("key_parameters: [x, y]") is None and B.repair("key_parameters: [x[0].y, a b]") is None


def test_running_sums_equal_a_window(spark):
    from pyspark.sql import Window

    from scoreloom.operators.running import summed_before

    rng = random.Random(2)
    rows = spark.createDataFrame([(k % 3, rng.randrange(3), p, rng.randrange(9)) for k, p in enumerate(rng.sample(range(10**7), 400))], "k int, f int, pos long, v int")
    order = Window.partitionBy("k").orderBy("f", "pos").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("s", F.coalesce(F.sum("v").over(order), F.lit(0)))
    assert sorted(map(tuple, summed_before(rows, ["k"], "pos", {"s": F.col("v")}, F.col("f")).collect())) == sorted(map(tuple, want.collect()))
    assert summed_before(rows.limit(0), ["k"], "pos", {"s": F.col("v")}).count() == 0


def test_running_sums_with_an_outlier_and_null_keys(spark):
    """One far position does not put the others into one range; null keys and positions stay."""
    from scoreloom.operators import running

    data = [(None if k % 2 else "c", p, 1) for k, p in enumerate([*range(4000), 10**15])] + [("c", None, 1)]
    rows = spark.createDataFrame(data, "k string, pos long, v int").repartition(3)
    seen = []
    old, running.stored = running.stored, lambda df, name: seen.append(out := old(df, name)) or out
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running.summed_before(rows, ["k"], "pos", {"s": F.col("v")}).collect()
    finally:
        running.stored = old
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, p, v in sorted(data, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        want[k, p] = want.get(k, 0)
        want[k] = want.get(k, 0) + v
    assert {(r["k"], r["pos"]): r["s"] for r in got} == {k: v for k, v in want.items() if isinstance(k, tuple)} and len(got) == len(data)
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * len(data)


def test_breaker_keeps_a_null_condition(spark):
    runs = spark.createDataFrame([(None, k, k % 3 == 0) for k in range(50)] + [("a", 10**12, True)], "condition string, pos long, format_failure boolean")
    got = {r["condition"]: (r["runs"], r["failures"], r["trip_pos"]) for r in A.format_failure_breaker(runs, ["condition"]).collect()}
    assert got == {None: (50, 17, 19), "a": (1, 1, None)}


def test_context_keeps_null_tasks_and_positions(spark):
    pages = [("t", None, "x", "u0", "first"), ("t", 1, "x", None, "second"), (None, 1, "x", "u2", "third")]
    got = {r["task_id"]: r["context"] for r in H.assemble_context(spark.createDataFrame(pages, "task_id string, pos int, role string, url string, text string"), 100, "d").collect()}
    assert got["t"].index("first") < got["t"].index("second") and "third" in got[None]


def test_tokens_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["ab", "Ab", "abc", "x-ab", "ab_c", "AB cd", "cd", ".", " ", "\n", "a b", "é"]
    texts = [(k, "".join(rng.choices(parts, k=rng.randint(0, 8)))) for k in range(120)] + [(500, None)]
    kinds = ["substring", "cased", "cased-word", "word", "product-cased"]
    tokens = [(t, kind) for t in ("ab", "AB cd", "x-ab", "cd", "b", "") for kind in kinds]

    def holds(text: str, token: str, kind: str) -> bool:
        if kind in ("substring", "cased"):
            return token.lower() in text.lower() if kind == "substring" else token in text
        flags = re.I | re.A if kind == "word" else re.A
        return re.search(rf"(?<![A-Za-z0-9_]){re.escape(token)}(?![A-Za-z0-9_])", text, flags) is not None

    want = {(k, t, kind) for k, text in texts if text for t, kind in tokens if t and holds(text, t, kind)}
    lines = spark.createDataFrame(texts, "k int, text string").withColumn("path", F.when(F.col("k") % 2 == 0, "keep.md").otherwise("vendor/x"))
    found = A.token_leak_scan(lines, spark.createDataFrame(tokens, "token string, kind string"), "k")
    assert {tuple(r) for r in found.collect()} == want
    part = A.token_leak_scan(lines, spark.createDataFrame(tokens, "token string, kind string"), "k", "^vendor/")
    assert {tuple(r) for r in part.collect()} == {w for w in want if w[0] % 2 == 0}
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_contracts_by_cohort(spark):
    contracts = {"api": M.Contract("api", ("endpoint",), {"endpoint": F.col("x")}), "docs": M.Contract("docs", ("catalog_number",), {"catalog_number": F.col("x") / 2})}
    assert M.contract_of("api", contracts).cohort == "api"
    with pytest.raises(ValueError, match="other"):
        M.contract_of("other", contracts)
    schema = "task_id int, run_index int, cohort string, format_failure boolean, x double"
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    runs = spark.createDataFrame([(1, 0, "api", False, 1.0), (2, 0, "docs", False, 1.0), (1, 1, "api", True, 1.0)], schema)
    assert {(r["task_id"], r["run_index"], r["dim"], r["score"]) for r in M.score_cohorts(runs, tasks, contracts).collect()} == {(1, 0, "endpoint", 1.0), (2, 0, "catalog_number", 0.5), (1, 1, "endpoint", None)}
    with pytest.raises(Exception, match="no contract"):
        M.score_cohorts(runs.union(spark.createDataFrame([(1, 2, "odd", False, 1.0)], schema)), tasks, contracts).collect()


def test_rescored_from_text(spark):
    """Answers are decoded again; stale fields go; a run of an unknown task stays as it is."""
    good = BLOCK.format("endpoints:\n  - method: GET\n    path: /x\n    api_version: v1")
    stored = "task_id int, run_index int, raw_response string, endpoint double, format_failure boolean, failure_reason string, cost double"
    runs = spark.createDataFrame([(1, 0, good, 0.0, True, "stale", 1.0), (1, 4, "no block", 1.0, False, None, 2.0), (9, 2, good, 0.25, True, "kept", 3.0)], stored)
    contract = M.Contract("api", ("endpoint",), {"endpoint": (F.get("endpoints", F.lit(0))["path"] == F.col("want")).cast("double")})
    tasks = spark.createDataFrame([(1, "/x")], "task_id int, want string")
    out = {(r["task_id"], r["run_index"]): r for r in M.rescored(runs, tasks, contract, B.decode_answers, ["format_failure", "failure_reason"]).collect()}
    seen = {k: (r["endpoint"], r["format_failure"], r["failure_reason"], r["cost"], r["n"]) for k, r in out.items()}
    assert seen == {(1, 0): (1.0, False, None, 1.0, 5), (1, 4): (None, True, "no answer block", 2.0, 5), (9, 2): (0.25, True, "kept", 3.0, 3)}


def test_coverage_and_overall_must_agree(spark):
    covered = spark.createDataFrame([("a", 2), ("b", 0)], "condition string, covered long")
    overall = lambda b: spark.createDataFrame([("a", 0.5), ("b", b)], "condition string, accuracy double")
    assert E.require_coverage(covered, overall(None)).count() == 2
    with pytest.raises(Exception, match="disagree"):
        E.require_coverage(covered, overall(0.1)).collect()


def test_spec_keys_count_at_the_top_only(spark):
    body = ['{"openapi": "3"}', '{"info": {"openapi": "3"}}', '[{"openapi": 1}]', '"openapi: 3"', None]
    probes = spark.createDataFrame([("h", str(k), 200, None, "t", b, False) for k, b in enumerate(body)], "host string, path string, status int, error string, text string, body string, disallowed boolean")
    base = spark.createDataFrame([("h", True, False, "none")], "host string, established boolean, soft404 boolean, signature string")
    out = {r["path"]: r["verdict"] for r in H.spec_probe_verdict(probes, base).collect()}
    assert out == {"0": "spec", "1": "not-a-spec", "2": "not-a-spec", "3": "not-a-spec", "4": "not-a-spec"}


def test_context_of_many_pages_equals_a_fold(spark):
    rng = random.Random(3)
    pages = [("t", k, rng.choice(["api-reference", "topic-guide", "x"]), f"u{k}", "a" * rng.randint(0, 60) + " " * rng.randint(0, 90) + "b" * rng.randint(0, 3)) for k in range(300)]
    used, blocks = 0, []
    for _, _, _, url, text in sorted(pages, key=lambda p: ({"api-reference": 0, "topic-guide": 1}.get(p[2], 3), p[1])):
        text, head = text.strip(), f"\n===== d: {url} =====\n"
        room = 800 - used - len(head)
        if not text:
            continue
        if room <= 0:
            break
        body = text if len(text) <= room else text[:room].rstrip() + H.CUT_MARK
        used += len(head) + len(body)
        blocks.append(head + body)
    df = spark.createDataFrame(pages, "task_id string, pos int, role string, url string, text string")
    row = H.assemble_context(df, 200, "d").first()
    assert (row["used"], row["context"]) == (used, "\n".join(blocks))
