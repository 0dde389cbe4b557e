"""The queries by operator id, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..operators import aggregate as E
from ..operators import archive as A
from ..operators import documents as H
from ..operators import gates as G
from ..operators import matching as M
from ..sources import answers as B
from ..sources import archive as S
from ..sources import publish as P
from ..sources.staging import fresh_folder
from . import sqltext as Q
from . import views as V
from .views import pick, table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views``: the stand-in views that its SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return f

    return add


# --- scans and sources ---


@query("a1_read_runs", "SELECT condition, '2024-01-02' AS run_date, task_id, pos AS run_index, format_failure, cost_usd FROM runs", "runs")
def a1(spark, d):
    """The runs written as folders of JSON, one a condition, and read back."""
    base = fresh_folder(spark, "runs")
    rows = V.runs(spark, d).select("condition", "task_id", F.col("pos").alias("run_index"), "format_failure", "cost_usd")
    for c in ("c0", "c1", "c2"):
        rows.filter(F.col("condition") == c).drop("condition").write.json(f"{base}/2024-01-02-{c}/runs")
    return S.read_runs(spark, f"{base}/*/runs/*.json", lines=True).select("condition", "run_date", "task_id", "run_index", "format_failure", "cost_usd")


@query("a6_write_scores", "SELECT condition, task_id, run_index, dim, score FROM scores WHERE condition <> 'c1' OR run_index % 2 = 0", "scores")
def a6(spark, d):
    """All scores written by condition, then one condition once more with half its rows."""
    base, rows = fresh_folder(spark, "scores"), V.scores(spark, d)
    S.write_scores(rows, base)
    S.write_scores(rows.filter("condition = 'c1' and run_index % 2 = 0"), base)
    return spark.read.parquet(base).select("condition", "task_id", "run_index", "dim", "score")


@query("a6_publish_condition", f"""SELECT condition, task_id, count(*) AS runs, {Q.mean('endpoint')} AS endpoint, count(*) FILTER (drifted) AS drifted
  FROM (SELECT condition, task_id, CASE WHEN condition = 'c1' THEN 0.0 ELSE (pos % 5) / 4.0 END AS endpoint, false AS drifted FROM runs) GROUP BY ALL""", "runs")
def a6b(spark, d):
    """Every condition published with stale scores, then with fresh ones; c1 is refused, as some of its costs drifted."""
    base, r = fresh_folder(spark, "published"), V.runs(spark, d).select("condition", "task_id", "pos", "cost_usd")
    keys, means = ["task_id", "pos"], lambda x: x.groupBy("task_id").agg(F.count("*").alias("runs"), E.mean("endpoint").alias("endpoint"), F.count_if("drifted").alias("drifted"))
    for fresh in (False, True):
        for c in ("c0", "c1", "c2"):
            mine = r.filter(F.col("condition") == c).drop("condition")
            drifted = F.lit(fresh and c == "c1") & (F.col("pos") % 97 == 0)
            score = F.col("pos") % 5 / 4.0 if fresh else F.lit(0.0)
            scored = mine.withColumns({"endpoint": score, "drifted": drifted, "cost_usd": F.when(drifted, F.col("cost_usd") + 1).otherwise(F.col("cost_usd"))})
            archive = mine.withColumns({"endpoint": F.lit(0.0), "drifted": F.lit(False)})
            try:
                P.publish_condition(scored, archive, base, c, keys, ["cost_usd"], ["endpoint"], means)
            except P.NotPublished:
                assert fresh and c == "c1"
    return P.published(spark, base, P.AGGREGATE).select("condition", "task_id", "runs", "endpoint", "drifted")


@query("a2_ground_truth_endpoints", "SELECT page_id // 10 AS task_id, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY pos) - 1 AS INTEGER) AS pos, method, path FROM endpoints WHERE side = 'gt'", "endpoints")
def a2(spark, d):
    """Tasks of up to ten pages, so that no list grows with the tables."""
    key = V.endpoints(spark, d).filter("side = 'gt'").withColumn("task_id", F.floor(F.col("page_id") / 10))
    tasks = key.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("k"), "method", "path"))).alias("endpoints"))
    return S.ground_truth_endpoints(tasks).select("task_id", "pos", "method", "path")


def _manifest_lists(spark, d):
    m = V.manifest(spark, d).withColumn("task_id", F.floor(F.col("pos") / 50))
    item = F.struct(F.col("pos").alias("k"), "url", "byte_size")
    lists = [F.array_sort(F.collect_list(F.when(F.col("list_key") == k, item))).alias(k) for k in ("pages", "anchors", "spec_documents", "gated_pages")]
    return m.groupBy("task_id").agg(*lists)


@query("a3_manifest_entries", "SELECT pos // 50 AS task_id, list_key, CAST(row_number() OVER (PARTITION BY pos // 50, list_key ORDER BY pos) - 1 AS INTEGER) AS pos, url, byte_size FROM manifest", "manifest")
def a3(spark, d):
    return S.manifest_entries(_manifest_lists(spark, d)).select("task_id", "list_key", "pos", "url", "byte_size")


@query("a4_manifest_urls", "SELECT DISTINCT url FROM manifest WHERE list_key = 'pages' AND url IS NOT NULL", "manifest")
def a4(spark, d):
    return S.manifest_urls(V.manifest(spark, d), include_anchors=False)


def _specs(spark, d):
    """Small API descriptions of each host, made from its pages: files of up to a thousand, so that none grows with the tables."""
    h = V.hosts(spark, d).select("host", "path", "page_id")
    first = h.groupBy("host").agg(F.min("page_id").alias("first"))
    op = F.concat(F.lit('"'), "path", F.lit('": {"get": {"operationId": "op'), "page_id", F.lit('"}, "trace": {"operationId": "t"}, "post": {}}'))
    files = h.groupBy("host", F.floor(F.col("page_id") / 1000).alias("file")).agg(F.array_join(F.sort_array(F.collect_set(op)), ", ").alias("ops"))
    whole = files.join(first, "host")
    head = F.when(F.col("first") % 2 == 0, F.concat(F.lit('"servers": [{"url": "https://'), "host", F.lit('/Vendor/api"}], '))).otherwise('"basePath": "/base", ')
    return whole.select(F.col("host").alias("spec"), "first", F.concat(F.lit("{"), head, F.lit('"paths": {'), "ops", F.lit("}}")).alias("body"))


@query("a5_spec_operations", """SELECT host AS spec, 'op' || page_id AS operation_id, 'GET' AS op_method, path AS spec_path,
  CASE WHEN first % 2 = 0 THEN p || ',/api' || p || ',/Vendor/api' || p ELSE p || ',/base' || p END AS accepted
  FROM (SELECT *, rtrim(path, '/') AS p, min(page_id) OVER (PARTITION BY host) AS first, row_number() OVER (PARTITION BY host, path ORDER BY page_id) AS k FROM hosts) WHERE k = 1""", "hosts")
def a5(spark, d):
    ops = S.spec_operations(_specs(spark, d))
    order = Window.partitionBy("spec", "spec_path").orderBy(F.length("operation_id"), "operation_id")
    return ops.withColumn("k", F.row_number().over(order)).filter("k = 1").select("spec", "operation_id", "op_method", "spec_path", F.array_join("accepted", ",").alias("accepted"))


_LINES = """SELECT conv_id AS run_id, count(*) FILTER (WHERE role = 'assistant') AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'tool' || turn END, ',' ORDER BY turn), '') AS tool_uses,
  's' || min(turn) FILTER (role <> 'assistant' AND turn % 4 = 0) AS server FROM conversations GROUP BY conv_id"""


def _event_lines(spark, d):
    c = table(spark, d, "conversations")
    tool = F.concat(F.lit('{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "tool'), "turn", F.lit('"}, {"type": "text", "text": "x"}]}}'))
    line = F.when(F.col("role") == "assistant", tool).when(F.col("turn") % 4 == 0, F.concat(F.lit('{"type": "system", "subtype": "init", "model": "m", "tools": ["a"], "mcp_servers": [{"name": "s'), "turn", F.lit('", "status": "connected"}]}'))).otherwise("{broken")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), line.alias("line"))


@query("a7_transcript_events", f"SELECT * FROM ({_LINES}) WHERE run_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant' OR turn % 4 = 0)")
def a7(spark, d):
    return S.transcript_events(_event_lines(spark, d)).select("run_id", F.col("turns").cast("long").alias("turns"), F.array_join("tool_uses", ",").alias("tool_uses"), F.get(F.col("servers.name"), F.lit(0)).alias("server"))


@query("a8_primary_model", """SELECT user_id, arg_max('m' || k, n * 1000 + k) AS model FROM (SELECT user_id, event_id % 4 AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def a8(spark, d):
    e = table(spark, d, "events")
    per = e.groupBy("user_id", (F.col("event_id") % 4).alias("k")).agg(F.count("*").alias("n"))
    name = F.when(F.col("k") % 2 == 0, "outputTokens").otherwise("output_tokens")
    usage = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), "k"), F.concat(F.lit('{"'), name, F.lit('": '), "n", F.lit("}"))))).alias("usage"))
    return S.primary_model(usage, "user_id")


@query("a9_spec_file_sizes", """SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, arg_max(path, (n_chars, path)) AS largest, (sum(n_chars) // 4)::BIGINT AS tokens,
  round_even((sum(n_chars) // 4) / 200000.0, 1)::DOUBLE AS windows FROM (SELECT 'spec/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.yaml' WHEN 1 THEN '.JSON' ELSE '.txt' END AS path, n_chars FROM documents) WHERE NOT path LIKE '%.txt'""")
def a9(spark, d):
    end = pick(F.col("doc_id") % 3, ".yaml", ".JSON", ".txt")
    files = table(spark, d, "documents").select(F.concat(F.lit("spec/"), "doc_id", end).alias("path"), F.col("n_chars").alias("length"))
    return S.spec_file_sizes(files, "spec/").withColumn("windows", F.col("windows").cast("double"))


# --- answers ---

_FENCE = "chr(96) || chr(96) || chr(96)"
_ANSWERS = f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || chr(10) || {_FENCE} || 'answer-summary' || chr(10) || 'n: 0' || chr(10) || {_FENCE} || chr(10) || {_FENCE} || 'Answer-Summary' || chr(10) || 'endpoints: ' || turn || chr(10) || {_FENCE}
  WHEN 1 THEN text WHEN 2 THEN '  ' ELSE NULL END AS raw_response FROM conversations"""


def _answers(spark, d):
    c = table(spark, d, "conversations")
    fence = F.lit("```")
    block = F.concat("text", F.lit("\n"), fence, F.lit("answer-summary\nn: 0\n"), fence, F.lit("\n"), fence, F.lit("Answer-Summary\nendpoints: "), "turn", F.lit("\n"), fence)
    k = F.col("turn") % 4
    return c.select("conv_id", "turn", F.when(k == 0, block).when(k == 1, F.col("text")).when(k == 2, "  ").alias("raw_response"))


@query("b1_answer_block", f"SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'endpoints: ' || turn END AS block FROM ({_ANSWERS})")
def b1(spark, d):
    return _answers(spark, d).select("conv_id", "turn", B.answer_block(F.col("raw_response")).alias("block"))


@query("b3_classify_format_failure", f"""SELECT conv_id, turn, CASE WHEN trim(coalesce(raw_response, '')) = '' THEN 'empty response' WHEN turn % 4 = 1 THEN 'no answer block' ELSE 'endpoints missing or empty' END AS reason FROM ({_ANSWERS})""")
def b3(spark, d):
    return B.decode_answers(_answers(spark, d)).select("conv_id", "turn", F.col("failure_reason").alias("reason"))


def _rendered(spark, d, some_broken: bool = True):
    """Each page's endpoint written as an answer block, one in five with a list that has to be repaired."""
    e = V.endpoints(spark, d)
    point = F.array(F.struct(F.trim("method").alias("method"), F.col("path"), F.col("api_version")))
    text = B.render_answers(point, F.lit("Bearer: token"), F.array(F.lit("a:read"), F.lit('b "q"')), F.array(F.lit("x")))
    if not some_broken:
        return e.select("page_id", text.alias("raw_response"))
    broken = F.replace(text, F.lit('key_parameters: ["x"]'), F.lit("key_parameters: [sortBy[0].name, scp.{id}]"))
    return e.select("page_id", "method", "path", "api_version", F.when(F.col("page_id") % 5 == 0, broken).otherwise(text).alias("raw_response"))


@query("b2_decode_answers", """SELECT page_id, trim(method) AS method, path, api_version, 'Bearer: token' AS auth_flow, 'a:read|b "q"' AS scopes FROM endpoints""", "endpoints")
def b2(spark, d):
    out = B.decode_answers(_rendered(spark, d).select("page_id", "raw_response"))
    e = F.get("endpoints", F.lit(0))
    return out.select("page_id", e["method"].alias("method"), e["path"].alias("path"), e["api_version"].alias("api_version"), "auth_flow", F.array_join("required_scopes", "|").alias("scopes"))


@query("b4_repair_flow_lists", "SELECT page_id, page_id % 5 = 0 AS format_repaired, CASE WHEN page_id % 5 = 0 THEN 'sortBy[0].name|scp.{id}' ELSE 'x' END AS params FROM endpoints", "endpoints")
def b4(spark, d):
    return B.decode_answers(_rendered(spark, d).select("page_id", "raw_response")).select("page_id", "format_repaired", F.array_join("key_parameters", "|").alias("params"))


def _docs_answers(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat(F.lit("```answer-summary\ncatalog_numbers: [AB-"), "turn", F.lit(", 0"), "turn", F.lit("]\nfirmware_version: 35.010\nsoftware_version: null\nlamp: 0"), "turn", F.lit("\n```"))
    none = F.lit("```answer-summary\nother: 1\n```")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, body).otherwise(none).alias("raw_response"))


@query("b5_decode_docs_answers", """SELECT conv_id, turn, turn % 2 <> 0 AS format_failure, CASE WHEN turn % 2 = 0 THEN 'AB-' || turn || '|0' || turn ELSE '' END AS catalogs,
  CASE WHEN turn % 2 = 0 THEN '35.010' END AS firmware, CAST(NULL AS VARCHAR) AS software FROM conversations""")
def b5(spark, d):
    out = B.decode_docs_answers(_docs_answers(spark, d))
    return out.select("conv_id", "turn", "format_failure", F.array_join("catalog_numbers", "|").alias("catalogs"), F.col("firmware_version").alias("firmware"), F.col("software_version").alias("software"))


@query("b6_observations", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '0' || turn END AS lamp FROM conversations")
def b6(spark, d):
    return B.decode_docs_answers(_docs_answers(spark, d), ("lamp",)).select("conv_id", "turn", F.col("observations")["lamp"].alias("lamp"))


@query("b7_render_answers", f"""SELECT page_id, {_FENCE} || 'answer-summary' || chr(10) || 'endpoints:' || chr(10) || '  - method: "' || trim(method) || '"' || chr(10) || '    path: "' || path || '"' || chr(10)
  || '    api_version: "' || api_version || '"' || chr(10) || 'auth_flow: "Bearer: token"' || chr(10) || 'required_scopes: ["a:read", "b ' || chr(92) || '"q' || chr(92) || '""]' || chr(10) || 'key_parameters: ["x"]' || chr(10) || {_FENCE} AS answer
  FROM endpoints""", "endpoints")
def b7(spark, d):
    return _rendered(spark, d, some_broken=False).select("page_id", F.col("raw_response").alias("answer"))


@query("b7_render_docs_answers", """SELECT page_id, page_id % 4 <> 0 AS readable, '0' || page_id || '|AB "' || page_id || '"' AS catalogs, CASE WHEN page_id % 3 <> 0 THEN '35.0' || page_id % 10 END AS firmware,
  CASE WHEN page_id % 2 = 0 THEN 'a' || chr(92) || chr(9) || 'b: #' || page_id END AS software, url AS publication, 'on ' || page_id AS lamp FROM (SELECT *, 1 AS one FROM pages) WHERE page_id % 4 <> 0
  UNION ALL SELECT page_id, false, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 4 = 0""")
def b7b(spark, d):
    """Docs answers written and read again: versions stay the text they are; one in four loses its end."""
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(
        "page_id", F.array(F.concat(F.lit("0"), k), F.concat(F.lit('AB "'), k, F.lit('"'))).alias("c"), F.when(k % 3 != 0, F.concat(F.lit("35.0"), k % 10)).alias("f"),
        F.when(k % 2 == 0, F.concat(F.lit("a\\\tb: #"), k)).alias("s"), "url", F.create_map(F.lit("lamp"), F.concat(F.lit("on "), k)).alias("o"),
    )
    text = B.render_docs_answers(F.col("c"), F.col("f"), F.col("s"), F.col("url"), F.col("o"))
    out = B.decode_docs_answers(rows.select("page_id", F.when(k % 4 == 0, F.regexp_replace(text, "`+$", "")).otherwise(text).alias("raw_response")), ("lamp",))
    return out.select(
        "page_id", (~F.col("format_failure")).alias("readable"), F.array_join("catalog_numbers", "|").alias("catalogs"), F.col("firmware_version").alias("firmware"), F.col("software_version").alias("software"), "publication",
        F.try_element_at("observations", F.lit("lamp")).alias("lamp"),
    )


_REASONS = ["empty response", "no answer block", "invalid YAML", "not a mapping", "endpoints missing or empty", "endpoints[1] is not a mapping"]


@query("b3_every_reason", f"SELECT page_id, {V.sql_pick('page_id % 7', *_REASONS)} AS reason FROM pages")
def b3b(spark, d):
    """One answer of each kind that fails, and one that does not."""
    block = lambda body: f"text\n```answer-summary\n{body}\n```\n"
    good = "- method: GET\n  path: /x\n"
    texts = [" \n", "no block", block("a: [b"), block("- a"), block("endpoints: []"), block("endpoints:\n" + good + "- b"), block("endpoints:\n" + good)]
    return B.decode_answers(table(spark, d, "pages").select("page_id", pick(F.col("page_id") % 7, *texts).alias("raw_response"))).select("page_id", F.col("failure_reason").alias("reason"))


@query("a9_stored_files", "SELECT lang, sum(7 + length(CAST(doc_id AS VARCHAR)))::BIGINT AS bytes, sum(7 + length(CAST(doc_id AS VARCHAR)))::BIGINT // 4 AS tokens FROM documents GROUP BY lang")
def a9b(spark, d):
    """Ids written as JSON files by language, and measured where they lie."""
    base, rows = fresh_folder(spark, "specs"), table(spark, d, "documents").select("lang", F.col("doc_id").alias("k"))
    rows.write.partitionBy("lang").json(base)
    files = S.stored_files(spark, base).withColumn("lang", F.regexp_extract("path", "/lang=([^/]+)/", 1))
    parts = [S.spec_file_sizes(files.filter(F.col("lang") == r["lang"]).select("path", "length")).select(F.lit(r["lang"]).alias("lang"), "bytes", "tokens") for r in files.select("lang").distinct().collect()]
    return G.union(parts)


# --- normalizing functions ---


def _addr(name: str, column, sql: str) -> None:
    query(name, f"SELECT page_id, {sql} AS out FROM addresses", "addresses")(lambda spark, d: V.addresses(spark, d).select("page_id", column(F.col("addr")).alias("out")))


_addr("c1_address_to_path", N.address_to_path, Q.path_of("addr"))
_addr("c2_states_host", N.states_host, Q.states_host("addr"))
_addr("c3_version_segments", lambda c: F.array_join(N.version_segments(c), ","), f"array_to_string(list_transform(list_filter({Q.segments('addr')}, lambda s: {Q.is_version('s')}), lambda s: {Q.version('s')}), ',')")
_addr("c4_normalize_path", lambda c: F.array_join(N.normalize_path(c), "/"), Q.npath("addr"))
_addr("c19_slug_for", N.slug_for, "CASE WHEN s = '' THEN 'page' ELSE right(s, 80) END AS out FROM (SELECT page_id, lower(trim(regexp_replace(split_part(split_part(regexp_replace(addr, '^https?://', ''), '?', 1), '#', 1), '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS s FROM addresses) --")
ORACLE_SQL["c19_slug_for"] = with_views("addresses", "SELECT page_id, CASE WHEN s = '' THEN 'page' ELSE right(s, 80) END AS out FROM (SELECT page_id, lower(trim(regexp_replace(split_part(split_part(regexp_replace(addr, '^https?://', ''), '?', 1), '#', 1), '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS s FROM addresses)")


@query("c5_normalize_method", f"SELECT page_id, {Q.method('method')} AS out FROM endpoints", "endpoints")
def c5(spark, d):
    return V.endpoints(spark, d).select("page_id", N.normalize_method(F.col("method")).alias("out"))


@query("c6_normalize_version", f"SELECT page_id, {Q.version('api_version')} AS out FROM endpoints", "endpoints")
def c6(spark, d):
    return V.endpoints(spark, d).select("page_id", N.normalize_version(F.col("api_version")).alias("out"))


@query("c7_strip_base_prefix", f"SELECT page_id, regexp_replace(p, '^(en|fr/{{}})(/|$)', '') AS out FROM (SELECT page_id, {Q.npath('path')} AS p FROM endpoints)".replace("fr/{}", "fr/\\{\\}"), "endpoints")
def c7(spark, d):
    stripped = N.strip_base_prefix(N.normalize_path(F.col("path")), [["en"], ["fr", "{}"]])
    return V.endpoints(spark, d).select("page_id", F.array_join(stripped, "/").alias("out"))


def _auth(spark, d):
    words = F.concat(pick(F.col("page_id") % 7, "Bearer token", "client_credentials then bearer", "Basic-auth login", "nothing known", "HMAC with api key", "sessionId", "access-token"), F.lit(" "), "page_id")
    return table(spark, d, "pages").select("page_id", words.alias("auth"))


_AUTH = f"SELECT page_id, {V.sql_pick('page_id % 7', 'Bearer token', 'client_credentials then bearer', 'Basic-auth login', 'nothing known', 'HMAC with api key', 'sessionId', 'access-token')} || ' ' || page_id AS auth FROM pages"


@query("c8_auth_concepts", f"SELECT page_id, array_to_string({Q.concepts('auth')}, ',') AS out FROM ({_AUTH})")
def c8(spark, d):
    return _auth(spark, d).select("page_id", F.array_join(N.auth_concepts(F.col("auth")), ",").alias("out"))


@query("c9_canonical_auth_flow", f"SELECT page_id, coalesce({Q.concepts('auth')}[1], 'unknown') AS out FROM ({_AUTH})")
def c9(spark, d):
    return _auth(spark, d).select("page_id", N.canonical_auth_flow(F.col("auth")).alias("out"))


@query("c10_bare_scope", "SELECT page_id, lower(trim(split_part(url, '#', 1))) AS out FROM pages")
def c10(spark, d):
    return table(spark, d, "pages").select("page_id", N.bare_scope(F.col("url")).alias("out"))


@query("c11_normalize_catalog", r"SELECT p_partkey, upper(regexp_replace(trim('  ' || p_name || '  ' || p_brand || ' '), '\s+', ' ', 'g')) AS out FROM part")
def c11(spark, d):
    name = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_brand", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", N.normalize_catalog(name).alias("out"))


def _versions(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("needs v"), (k % 40).cast("string"), F.lit(".0"), (k % 13).cast("string"), F.lit(" or "), (k % 40).cast("string"), F.lit(".0"), (k % 7).cast("string"), F.lit(", not x9.1"))
    # One in four needs a version that is not named, one in three a minor one that may not be.
    major = k % 40 + F.when(k % 4 == 0, 1).otherwise(0)
    need = F.concat(major.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("."), (k % 5).cast("string"))).otherwise(""))
    return o.select("o_orderkey", text.alias("text"), need.alias("need"))


_KEYED = "SELECT o_orderkey, o_orderkey % 40 AS major, o_orderkey % 13 AS m1, o_orderkey % 7 AS m2 FROM orders"


@query("c12_version_tuples", f"SELECT o_orderkey, major || '.' || m1 || ' ' || major || '.' || m2 AS out FROM ({_KEYED})")
def c12(spark, d):
    return _versions(spark, d).select("o_orderkey", F.array_join(F.transform(N.version_tuples(F.col("text")), lambda v: F.array_join(v.cast("array<string>"), ".")), " ").alias("out"))


@query("c13_version_satisfies", f"SELECT o_orderkey, o_orderkey % 4 <> 0 AS whole, o_orderkey % 4 <> 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 5 IN (m1, m2)) AS out FROM ({_KEYED})")
def c13(spark, d):
    v = _versions(spark, d)
    return v.select("o_orderkey", N.version_satisfies(F.split("need", r"\.")[0], F.col("text")).alias("whole"), N.version_satisfies(F.col("need"), F.col("text")).alias("out"))


@query("c14_hedge_count", f"SELECT o_orderkey, CASE WHEN m1 = m2 THEN 1 ELSE 2 END AS out FROM ({_KEYED})")
def c14(spark, d):
    return _versions(spark, d).select("o_orderkey", N.hedge_count(F.col("text")).alias("out"))


@query("c15_names_parameter", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'A' OR l_linestatus = 'O' AS out FROM lineitem")
def c15(spark, d):
    names = F.array(F.concat("l_returnflag", F.lit("_x")), F.when(F.col("l_returnflag") == "A", "need.total").otherwise("needless"), F.when(F.col("l_linestatus") == "O", "need").otherwise("nee"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.names_parameter(F.lit("need"), names).alias("out"))


def _evidence(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(pick(F.col("page_id") % 5, "https://web.archive.org/", "http://x.archive.is/", "https://notarchive.org/", "ftp://12ft.io/", "archive.org/"), "url").alias("evidence"))


@query("c16_rehosting_host", f"SELECT page_id, {V.sql_pick('page_id % 5', 'web.archive.org', 'archive.is', '', '12ft.io', '')} AS out FROM pages")
def c16(spark, d):
    return _evidence(spark, d).select("page_id", F.coalesce(N.rehosting_host(F.col("evidence")), F.lit("")).alias("out"))


@query("c17_path_spellings", "SELECT page_id, CASE WHEN starts_with(path, '/en') THEN path || ',' || substr(path, 4) || ',/fr' || path WHEN starts_with(path, '/fr') THEN path || ',/en' || path || ',' || substr(path, 4) ELSE path || ',/en' || path || ',/fr' || path END AS out FROM hosts", "hosts")
def c17(spark, d):
    return V.hosts(spark, d).select("page_id", F.array_join(N.path_spellings(F.col("path"), ["en/", "/fr"]), ",").alias("out"))


@query("c18_anchor_paths", "SELECT page_id, p || ',/api' || p || ',/Vendor/api' || p AS out FROM (SELECT page_id, rtrim(path, '/') AS p FROM hosts)", "hosts")
def c18(spark, d):
    prefix = N.server_segments(F.concat(F.lit("https://"), "host", F.lit("/Vendor/api/")))
    return V.hosts(spark, d).select("page_id", F.array_join(N.anchor_paths(F.col("path"), prefix), ",").alias("out"))


@query("c20_percent_cells", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round_even(l_discount * 1000 / 8, 0) AS INTEGER) AS VARCHAR) || '%' AS pct,
  CASE WHEN round_even((l_tax - l_discount) * 100, 0) < 0 THEN '' ELSE '+' END || CAST(CAST(round_even((l_tax - l_discount) * 100, 0) AS INTEGER) AS VARCHAR) || ' pts' AS delta FROM lineitem""")
def c20(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", N.pct_cell(F.col("l_discount") * 10 / 8).alias("pct"), N.delta_cell(F.col("l_discount"), F.col("l_tax")).alias("delta"))


ORACLE_SQL["c20_percent_cells"] = ORACLE_SQL["c20_percent_cells"].replace("l_discount * 1000 / 8", "l_discount * 10 / 8 * 100")

# --- matching and scoring ---

_RANKED = f"""r AS (SELECT *, {Q.npath('path')} AS full_path, regexp_replace({Q.npath('path')}, '^fr(/|$)', '') AS npath FROM endpoints),
k AS (SELECT *, row_number() OVER (PARTITION BY side, task_id, npath ORDER BY pos) AS rn FROM r),
m AS (SELECT g.task_id, g.pos, g.method AS gt_method, g.npath AS gt_path, g.api_version AS gt_api_version, a.pos IS NOT NULL AS matched,
  coalesce({Q.method('g.method')} = {Q.method('a.method')}, false) AS method_ok, {Q.version('g.api_version')} AS want, {Q.version('a.api_version')} AS got,
  a.method AS answer_method, a.full_path AS answer_path, a.api_version AS answer_api_version
  FROM (SELECT * FROM k WHERE side = 'gt') g LEFT JOIN (SELECT * FROM k WHERE side = 'ans') a USING (task_id, npath, rn)),
x AS (SELECT *, matched AND (want = got OR got = '2.0') AS version_ok, matched AND want <> got AND got = '2.0' AS via FROM m)"""


def _ranked_sql(body: str) -> str:
    return with_views("endpoints", "").rstrip() + ",\n" + _RANKED + "\n" + body


def _matches(spark, d):
    return M.match_endpoints(V.gt(spark, d), V.ans(spark, d), ["task_id"], [["fr"]], F.array(F.lit("V2.0")))


@query("d1_match_endpoints", _ranked_sql("SELECT task_id, pos, gt_path, matched, coalesce(answer_path, '') AS answer_path FROM x"))
def d1(spark, d):
    return _matches(spark, d).select("task_id", "pos", "gt_path", "matched", F.coalesce("answer_path", F.lit("")).alias("answer_path"))


@query("d2_match_record", _ranked_sql("SELECT task_id, pos, gt_method, gt_path, gt_api_version, matched, method_ok, version_ok, answer_method, answer_path, answer_api_version FROM x"))
def d2(spark, d):
    return _matches(spark, d).drop("version_via_alternate")


@query("d3_version_tolerance", _ranked_sql("SELECT task_id, pos, version_ok, via AS version_via_alternate FROM x"))
def d3(spark, d):
    return _matches(spark, d).select("task_id", "pos", "version_ok", "version_via_alternate")


@query("d4_endpoint_scores", _ranked_sql("SELECT task_id, round(avg(matched::INT), 6) AS endpoint, round(avg(method_ok::INT), 6) AS method, round(avg(version_ok::INT), 6) AS api_version FROM x GROUP BY task_id"))
def d4(spark, d):
    return M.endpoint_scores(_matches(spark, d), ["task_id"]).select("task_id", *[F.round(c, 6).alias(c) for c in ("endpoint", "method", "api_version")])


_PAIRS = f"SELECT a.page_id, a.auth AS key, b.auth AS answer FROM ({_AUTH}) a JOIN ({_AUTH}) b ON b.page_id = a.page_id + 3"


@query("d5_auth_score", f"""SELECT page_id, CASE WHEN page_id % 10 = 0 THEN NULL WHEN c = 'unknown' THEN (len(n) = 0)::DOUBLE
  ELSE (list_contains(n, c) OR list_contains(n, 'basic-auth'))::DOUBLE END AS score FROM (SELECT page_id, coalesce({Q.concepts('key')}[1], 'unknown') AS c, {Q.concepts('answer')} AS n FROM ({_PAIRS}))""")
def d5(spark, d):
    a = _auth(spark, d)
    b = a.select((F.col("page_id") - 3).alias("page_id"), F.col("auth").alias("answer"))
    excused = F.when(F.col("page_id") % 10 == 0, "not public")
    return a.join(b, "page_id").select("page_id", M.auth_score(F.col("auth"), F.col("answer"), F.array(F.lit("basic-auth")), excused).alias("score"))


@query("d6_scopes_score", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 4 = o_orderkey % 6 OR o_orderkey % 4 = o_orderkey % 3)::DOUBLE END AS score FROM orders")
def d6(spark, d):
    k = F.col("o_orderkey")
    scope = lambda n: F.concat(F.lit(" Scope:"), (k % n).cast("string"), F.lit(" # why"))
    key = F.when(k % 5 != 0, F.array(scope(4))).otherwise(F.array(F.lit("# none")))
    return table(spark, d, "orders").select("o_orderkey", M.scopes_score(key, F.array(scope(6), F.lower(scope(3)))).alias("score"))


@query("d7_params_score", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 2 = 0)::DOUBLE END AS score FROM orders")
def d7(spark, d):
    k = F.col("o_orderkey")
    key = F.array(F.struct(F.lit("a").alias("name"), (k % 3 != 0).alias("required")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("boolean").alias("required")))
    return table(spark, d, "orders").select("o_orderkey", M.params_score(key, F.array(F.when(k % 2 == 0, "a.b.c").otherwise("ab"))).alias("score"))


def _docs_rows(spark, d):
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    num = lambda n: (k % n).cast("string")
    return table(spark, d, "orders").select(
        "o_orderkey", F.array(text("ab-", num(5))).alias("gt_catalogs"), F.when(k % 4 != 0, text("35.0", num(3))).alias("gt_firmware"), F.when(k % 3 != 0, num(9)).alias("gt_software"),
        F.array(text(" AB-", num(4), " "), text("AB-", num(5), "-K")).alias("answer_catalogs"), text("v35.", num(2), " or 35.00", num(2), " or 36").alias("answer_firmware"), text(num(6), ".1").alias("answer_software"),
        F.when(k % 2 == 0, text("P-", num(7))).alias("answer_publication"),
        F.when(k % 3 == 1, F.create_map(F.lit("note"), text("n", num(4)), F.lit("lamp"), F.lit("on"))).when(k % 3 == 2, F.create_map(F.lit("lamp"), F.lit("off"))).alias("answer_observations"),
        F.when(k % 5 != 0, F.create_map(F.lit("note"), F.when(k % 2 == 0, "").otherwise("n1"))).alias("gt_observations"),
    )


_DOCS = """SELECT o_orderkey, (o_orderkey % 5 = o_orderkey % 4)::DOUBLE AS catalog_number, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 3 = o_orderkey % 2)::DOUBLE END AS firmware_version,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 9 = o_orderkey % 6)::DOUBLE END AS software_version FROM orders"""


@query("d8_docs_scores", _DOCS)
def d8(spark, d):
    return M.docs_scores(_docs_rows(spark, d)).select("o_orderkey", *M.DOCS_DIMENSIONS)


_EXPECTED = "o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1"


@query("d9_exhibit", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'P-' || (o_orderkey % 7) END AS publication, ' AB-' || (o_orderkey % 4) || ' |AB-' || (o_orderkey % 5) || '-K' AS catalogs,
  CASE WHEN firmware_version IS NOT NULL AND software_version IS NOT NULL THEN firmware_version = 1 AND software_version = 1 END AS pairing_ok, 2 AS firmware_hedges, 1 AS software_hedges,
  CASE o_orderkey % 3 WHEN 1 THEN 'n' || (o_orderkey % 4) || ',on' WHEN 2 THEN 'off' END AS observed, CASE WHEN {_EXPECTED} THEN 'n1,?' END AS observed_expected FROM ({_DOCS})""")
def d9(spark, d):
    values = lambda name: F.array_join(F.map_values(f"exhibit.{name}"), ",", "?").alias(name)
    return M.docs_scores(_docs_rows(spark, d)).select(
        "o_orderkey", "exhibit.publication", F.array_join("exhibit.catalogs", "|").alias("catalogs"), "exhibit.pairing_ok", "exhibit.firmware_hedges", "exhibit.software_hedges",
        values("observed"), values("observed_expected"),
    )


def _scored(spark, d):
    """Orders as runs, parts of the key by customer: known customers only; failures where the status is P."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") == "P").alias("format_failure"), "o_totalprice")
    tasks = table(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("task_id"), "c_acctbal")
    contract = M.Contract("api", ("endpoint", "method"), {"endpoint": (F.col("o_totalprice") > 100 * F.col("c_acctbal")).cast("double"), "method": F.when(F.col("c_acctbal") > 0, F.lit(1.0))})
    return M.score_runs(o, tasks, contract)


_SCORED = """SELECT o_orderkey, CASE WHEN valid THEN (o_totalprice > 100 * c_acctbal)::DOUBLE END AS endpoint, CASE WHEN valid AND c_acctbal > 0 THEN 1.0::DOUBLE END AS method
  FROM (SELECT *, o_orderstatus <> 'P' AND c_custkey IS NOT NULL AS valid FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey)"""


@query("d10_score_runs", f"SELECT o_orderkey, dim, score FROM ({_SCORED}) UNPIVOT INCLUDE NULLS (score FOR dim IN (endpoint, method))")
def d10(spark, d):
    return M.long_scores(_scored(spark, d), ["o_orderkey"], ("endpoint", "method"))


@query("d11_rescore", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE s.endpoint END AS endpoint, o_totalprice FROM orders JOIN ({_SCORED}) s USING (o_orderkey)")
def d11(spark, d):
    runs = table(spark, d, "orders").select("o_orderkey", F.lit(0.5).alias("endpoint"), "o_totalprice")
    return M.rescore(runs, _scored(spark, d).filter("o_orderkey % 4 <> 0"), ["o_orderkey"], ["endpoint"])


@query("d11_rescored", """SELECT page_id, page_id % 3 AS run_index, CAST(CASE WHEN page_id % 11 = 0 THEN 0.25 WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS endpoint,
  CASE WHEN page_id % 11 = 0 THEN true ELSE page_id % 4 = 1 END AS format_failure, CASE WHEN page_id % 11 = 0 THEN 'stale' WHEN page_id % 4 = 1 THEN 'no answer block' END AS failure_reason, length(url) AS cost, page_id % 3 + 1 AS n FROM pages""")
def d11b(spark, d):
    """Stored scores are stale: blocks are decoded and scored again; one page in eleven is of an unknown task."""
    k = F.col("page_id")
    point = lambda path: F.array(F.struct(F.lit("GET").alias("method"), path.alias("path"), F.lit("v1").alias("api_version")))
    none = F.array().cast("array<string>")
    text = B.render_answers(point(F.concat(F.when(k % 2 == 0, "/x/").otherwise("/y/"), k)), F.lit("bearer"), none, none)
    runs = table(spark, d, "pages").select(
        "page_id", (k % 3).alias("run_index"), F.when(k % 4 == 1, "nothing").otherwise(text).alias("raw_response"), F.lit(0.25).alias("endpoint"), F.lit(True).alias("format_failure"),
        F.lit("stale").alias("failure_reason"), F.length("url").alias("cost"),
    )
    tasks = table(spark, d, "pages").filter("page_id % 11 <> 0").select("page_id", F.concat(F.lit("/x/"), k).alias("want"))
    contract = M.Contract("api", ("endpoint",), {"endpoint": (F.get("endpoints", F.lit(0))["path"] == F.col("want")).cast("double")})
    out = M.rescored(runs, tasks, contract, B.decode_answers, ["format_failure", "failure_reason"], ("page_id",))
    return out.select("page_id", "run_index", "endpoint", "format_failure", "failure_reason", "cost", "n")


@query("d10_score_cohorts", """SELECT o_orderkey, 0 AS run_index, cohort, dim, CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 7 = 0 THEN NULL WHEN dim = 'endpoint' THEN (o_orderkey % 4) / 4.0 WHEN dim = 'method' THEN (o_orderkey % 2) / 1.0 ELSE (o_orderkey % 3) / 2.0 END AS score
  FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'api' ELSE 'docs' END AS cohort FROM orders) JOIN (VALUES ('api', 'endpoint'), ('api', 'method'), ('docs', 'catalog_number')) t(cohort, dim) USING (cohort)""")
def d10b(spark, d):
    """Orders of two cohorts, each scored by its contract; failures and orders of unknown customers have no score."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(0).alias("run_index"), F.when(k % 2 == 0, "api").otherwise("docs").alias("cohort"), (k % 5 == 0).alias("format_failure"))
    tasks = table(spark, d, "orders").filter("o_custkey % 7 <> 0").select("o_orderkey").distinct()
    kinds = {"api": M.Contract("api", ("endpoint", "method"), {"endpoint": k % 4 / 4.0, "method": (k % 2).cast("double")}), "docs": M.Contract("docs", ("catalog_number",), {"catalog_number": k % 3 / 2.0})}
    return M.score_cohorts(runs, tasks, kinds, ("o_orderkey",)).select("o_orderkey", "run_index", "cohort", "dim", "score")


# --- aggregation ---


@query("e1_aggregate_runs", "SELECT * FROM agg", "agg")
def e1(spark, d):
    return E.aggregate_runs(V.scores(spark, d))


@query("e1_run_counters", "SELECT condition, task_id, count(*) AS runs, count(*) FILTER (format_failure) AS format_failures, count(*) FILTER (format_repaired) AS format_repairs FROM runs GROUP BY ALL", "runs")
def e1b(spark, d):
    return E.run_counters(V.runs(spark, d))


@query("e2_overall_accuracy", f"SELECT condition, {Q.mean('mean')} AS accuracy, count(mean) AS dims FROM agg WHERE overall = 1 GROUP BY condition", "agg")
def e2(spark, d):
    return E.overall_accuracy(e1(spark, d))


@query("e3_task_accuracy", f"SELECT condition, task_id, {Q.mean('mean')} AS accuracy FROM agg WHERE overall = 0 GROUP BY ALL", "agg")
def e3(spark, d):
    return E.task_accuracy(e1(spark, d))


def _dimensions(spark, d):
    """Every dimension of the scores and one that is only declared."""
    dims = V.scores(spark, d).select("dim").distinct()
    return dims.union(dims.agg(F.lit("extra"))).withColumn("reason", F.when(F.col("dim") == "auth_flow", "not public"))


_COVERAGE = """SELECT condition, count(mean) AS covered, count(*) FILTER (mean IS NULL AND dim = 'auth_flow') AS declared, count(*) FILTER (mean IS NULL AND dim <> 'auth_flow') AS undeclared
  FROM (SELECT DISTINCT condition FROM agg) CROSS JOIN (SELECT DISTINCT dim FROM scores UNION ALL SELECT 'extra') LEFT JOIN (SELECT * FROM agg WHERE overall = 1) USING (condition, dim) GROUP BY condition"""


@query("e4_coverage", _COVERAGE, "agg")
def e4(spark, d):
    agg = e1(spark, d)
    return E.require_coverage(E.coverage(agg, _dimensions(spark, d)), E.overall_accuracy(agg))


@query("e5_cohort_coverage", f"SELECT covered, count(*) AS packs FROM ({_COVERAGE}) GROUP BY covered", "agg")
def e5(spark, d):
    return E.cohort_coverage(e4(spark, d))


@query("e5_coverage_misses", """SELECT dim, count(*) AS misses FROM (SELECT DISTINCT condition FROM agg) CROSS JOIN (SELECT DISTINCT dim FROM scores UNION ALL SELECT 'extra')
  LEFT JOIN (SELECT * FROM agg WHERE overall = 1) USING (condition, dim) WHERE mean IS NULL GROUP BY dim""", "agg")
def e5b(spark, d):
    return E.coverage_misses(e1(spark, d), _dimensions(spark, d))


@query("e6_docs_provenance", """SELECT task_id, count(*) AS entries, count(*) FILTER (byte_size > 2000) AS retrieved,
  coalesce(string_agg(DISTINCT CASE WHEN byte_size > 2000 THEN fetch_date END, ',' ORDER BY CASE WHEN byte_size > 2000 THEN fetch_date END), '') AS dates FROM manifest GROUP BY task_id""", "manifest")
def e6(spark, d):
    m = V.manifest(spark, d).withColumn("content_hash", F.when(F.col("byte_size") > 2000, F.col("content_hash")))
    return E.docs_provenance(m, ("task_id",))


def _rollup(spark, d):
    return E.rollup_by_group(V.group_means(spark, d), V.group_mapping(spark, d), V.groups(spark, d))


@query("e7_rollup_by_group", "SELECT * FROM rollup_", "rollup_")
def e7(spark, d):
    return _rollup(spark, d)


@query("e7_groups_not_applicable", f"""SELECT grp, pos, dim, {Q.mean('CASE WHEN grp <> 2 THEN mean END')} AS mean, count(DISTINCT CASE WHEN mean IS NOT NULL AND grp <> 2 THEN task_id END) AS tasks, CASE WHEN grp = 2 THEN 'no such product' END AS not_applicable
  FROM groups LEFT JOIN group_mapping USING (grp) LEFT JOIN group_means USING (task_id) WHERE grp <> 2 GROUP BY ALL UNION ALL SELECT grp, pos, NULL, NULL, 0, 'no such product' FROM groups WHERE grp = 2""", "group_means group_mapping groups")
def e7b(spark, d):
    excused = V.groups(spark, d).filter("grp = 2").select("grp", F.lit("no such product").alias("reason"))
    return E.rollup_by_group(V.group_means(spark, d), V.group_mapping(spark, d), V.groups(spark, d), excused)


def _category(spark, d):
    """Nations as tasks, categories by their key, from the fixed list and so with some that no task has."""
    names = spark.createDataFrame([(k, c) for k, c in enumerate(G.API_CATEGORIES)], "pos int, grp string")
    mapping = table(spark, d, "nation").select(F.col("n_nationkey").alias("task_id"), pick(F.col("n_nationkey") % 9, *G.API_CATEGORIES[:9]).alias("grp"))
    return E.group_overall(E.rollup_by_group(V.group_means(spark, d), mapping, names))


_CATEGORY_LIST = ", ".join(f"({k}, '{c}')" for k, c in enumerate(Q.API_CATEGORIES))


@query("e8_rollup_by_category", f"""SELECT grp, pos, {Q.mean('mean')} AS overall, max(tasks) AS tasks FROM (SELECT grp, pos, dim, {Q.mean('mean')} AS mean, count(DISTINCT CASE WHEN mean IS NOT NULL THEN task_id END) AS tasks
  FROM (VALUES {_CATEGORY_LIST}) c(pos, grp) LEFT JOIN (SELECT n_nationkey AS task_id, {V.sql_pick('n_nationkey % 9', *Q.API_CATEGORIES[:9])} AS grp FROM nation) USING (grp) LEFT JOIN group_means USING (task_id) GROUP BY ALL) GROUP BY grp, pos""", "group_means")
def e8(spark, d):
    return _category(spark, d)


@query("e9_cross_cohort_conflict", "SELECT count(DISTINCT r_name) AS cohorts, count(DISTINCT r_name) > 1 AS conflict FROM nation JOIN region ON n_regionkey = r_regionkey")
def e9(spark, d):
    packs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("cohort"))
    return E.cohort_conflict(packs)


def _by_segment(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_regionkey").alias("grp"), F.col("c_mktsegment").alias("source")).agg(E.mean("c_acctbal").alias("overall"))


_OF = "CASE WHEN c_mktsegment = '{}' THEN c_acctbal END"


@query("e10_category_by_source", f"""SELECT n_regionkey AS grp, {Q.mean(_OF.format('BUILDING'))} AS BUILDING, {Q.mean(_OF.format('MACHINERY'))} AS MACHINERY,
  CAST(NULL AS DOUBLE) AS absent FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def e10(spark, d):
    return E.by_source(_by_segment(spark, d), ["BUILDING", "MACHINERY", "absent"])


def _side(spark, d, condition: str, skip: str = ""):
    return e1(spark, d).filter((F.col("condition") == condition) & (F.coalesce("task_id", F.lit("")) != skip if skip else F.lit(True)))


@query("e11_compare_two", """SELECT task_id, dim, a, b, round(b - a, 6) AS delta FROM (SELECT coalesce(task_id, '') AS task_id, dim, mean AS a FROM agg WHERE condition = 'c0' AND coalesce(task_id, '') <> 'view')
  FULL JOIN (SELECT coalesce(task_id, '') AS task_id, dim, mean AS b FROM agg WHERE condition = 'c1' AND coalesce(task_id, '') <> 'click') USING (task_id, dim)""", "agg")
def e11(spark, d):
    return E.compare_two(_side(spark, d, "c0", "view"), _side(spark, d, "c1", "click"))


@query("e12_compare_many", """SELECT dim, c0, c1, c2, round(c2 - c0, 6) AS c2_minus_c0, round(c2 - c1, 6) AS c2_minus_c1 FROM (SELECT dim, max(mean) FILTER (condition = 'c0') AS c0, max(mean) FILTER (condition = 'c1') AS c1,
  max(mean) FILTER (condition = 'c2') AS c2 FROM agg WHERE overall = 1 GROUP BY dim)""", "agg")
def e12(spark, d):
    return E.compare_many(e1(spark, d), ["c0", "c1", "c2"])


@query("e12_format_failure_row", """SELECT 'format_failures' AS dim, max(c) FILTER (condition = 'c0') AS c0, max(c) FILTER (condition = 'c1') AS c1, max(c) FILTER (condition = 'c2') AS c2
  FROM (SELECT condition, count(*) FILTER (format_failure) || '/' || count(*) AS c FROM runs GROUP BY condition)""", "runs")
def e12b(spark, d):
    return E.format_failure_row(V.runs(spark, d), ["c0", "c1", "c2"])


@query("e13_delta_vs_baseline", """SELECT n.condition, n.dim, n.mean AS new, b.mean AS base, round(n.mean - b.mean, 6) AS delta FROM agg n LEFT JOIN (SELECT * FROM agg WHERE task_id = 'view' AND condition <> 'c2') b USING (condition, dim) WHERE n.overall = 1""", "agg")
def e13(spark, d):
    a = e1(spark, d)
    return E.delta_vs_baseline(a.filter("overall = 1"), a.filter("task_id = 'view' and condition <> 'c2'"))


_GROUP_SIDE = f"""SELECT grp, pos, {Q.mean('mean')} AS overall, max(tasks) AS tasks FROM (SELECT grp, pos, dim, {Q.mean('mean')} AS mean, count(DISTINCT CASE WHEN mean IS NOT NULL THEN task_id END) AS tasks
  FROM groups LEFT JOIN group_mapping USING (grp) LEFT JOIN (SELECT * FROM group_means WHERE dim {{}}) USING (task_id) GROUP BY ALL) GROUP BY grp, pos"""


@query("e14_compare_groups", f"""SELECT grp, pos, a.overall AS a, a.tasks AS a_tasks, b.overall AS b, b.tasks AS b_tasks, round(b.overall - a.overall, 6) AS delta
  FROM ({_GROUP_SIDE.format("<> 'BUILDING'")}) a FULL JOIN (SELECT grp, overall, tasks FROM ({_GROUP_SIDE.format("= 'BUILDING'")})) b USING (grp)""", "group_means group_mapping groups")
def e14(spark, d):
    means, m, g = V.group_means(spark, d), V.group_mapping(spark, d), V.groups(spark, d)
    side = lambda w: E.group_overall(E.rollup_by_group(means.filter(w), m, g))
    return E.compare_groups(side("dim <> 'BUILDING'"), side("dim = 'BUILDING'"))


@query("e15_usage_rollup", """SELECT condition, round(sum(cost_usd), 4) AS cost_usd, sum(duration_ms)::BIGINT AS duration_ms, count(DISTINCT model) AS models, count(*) FILTER (reused) AS reused, bool_and(discipline_ok) AS all_ok,
  count(*) FILTER (NOT discipline_ok) AS violations FROM runs GROUP BY condition""", "runs")
def e15(spark, d):
    return E.usage_rollup(V.runs(spark, d))
