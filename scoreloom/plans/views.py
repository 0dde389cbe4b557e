"""Run, key, manifest, page and probe tables as views over the given ones, in Spark and (``SQL``) in DuckDB.

The same columns come from the same rows in both, so that each operator over a view has an SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregate import mean
from . import sqltext as Q


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(index: Column, *values) -> Column:
    """values[index], null where the index is null."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def addresses(spark, d) -> DataFrame:
    p, k = table(spark, d, "pages"), F.col("page_id") % 6
    addr = (
        F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^https?://", "")).when(k == 2, F.concat(F.lit("  "), "url", F.lit(" ")))
        .when(k == 3, F.concat(F.lit("/v2/Items/{Id}/2.0/sub/"), F.col("page_id").cast("string"), F.lit("?x=1#y")))
        .when(k == 4, F.lit("https://{tenant}.example.com")).otherwise(F.concat(F.lit("/oauth/V1/Users/{user-id}/"), F.col("page_id").cast("string"), F.lit("/beta")))
    )
    return p.select("page_id", "url", addr.alias("addr"))


def endpoints(spark, d) -> DataFrame:
    """(page_id, side, task_id, pos, method, path, api_version): few distinct paths, so that equal ones repeat."""
    p = table(spark, d, "pages")
    bare = F.regexp_replace("url", r"/[0-9]+(\.html)?", "/{id}")
    versioned = F.regexp_replace(bare, F.lit(r"(\.(com|net|org))/"), F.concat(F.lit("$1/v"), (F.col("page_id") % 3).cast("string"), F.lit("/")))
    return p.select(
        "page_id", F.when(F.col("page_id") % 2 == 0, "gt").otherwise("ans").alias("side"), (F.col("page_id") % 11).alias("task_id"),
        F.col("page_id").alias("pos"), pick(F.col("page_id") % 3, "get", "POST", " Put ").alias("method"),
        F.when(F.col("page_id") % 3 == 0, bare).otherwise(versioned).alias("path"),
        pick(F.floor(F.col("page_id") / 2) % 6, "v1", "/V2", "none", "<v1>", "svc/v1", "v2.0").alias("api_version"),
    )


def gt(spark, d):
    return endpoints(spark, d).filter("side = 'gt'").drop("side", "page_id")


def ans(spark, d):
    return endpoints(spark, d).filter("side = 'ans'").drop("side", "page_id")


def runs(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("condition"), F.col("event_type").alias("task_id"),
        F.col("event_id").alias("pos"), (F.row_number().over(order) - 1).alias("run_index"), "user_id",
        (F.col("value") > 20).alias("format_failure"), (F.col("event_id") % 13 == 0).alias("format_repaired"), F.round("value", 2).alias("cost_usd"),
        (F.col("event_id") * 7 % 1000).alias("duration_ms"), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("model"),
        (F.col("event_id") % 5 == 0).alias("reused"), (F.col("event_id") % 17 != 0).alias("discipline_ok"),
    )


DIMENSIONS = ("endpoint", "method", "api_version", "auth_flow", "required_scopes", "key_parameters")


def scores(spark, d) -> DataFrame:
    """Long scores: null where (event_id + k) % 7 = 0, for failures, and always for c2's auth_flow."""
    r = runs(spark, d).filter(~F.col("format_failure"))
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), F.lit(k).alias("k")) for k, n in enumerate(DIMENSIONS)])
    wide = r.select("condition", "task_id", "pos", F.explode(dims).alias("x")).select("condition", "task_id", "pos", "x.dim", "x.k")
    value = F.when(((F.col("pos") + F.col("k")) % 7 != 0) & ~((F.col("condition") == "c2") & (F.col("k") == 3)), (F.col("pos") * (F.col("k") + 1) % 5) / 4.0)
    return wide.select("condition", "task_id", F.col("pos").alias("run_index"), "dim", value.alias("score"))


def group_means(spark, d):
    """task_id, dim, mean: customers' balances by nation and segment; groups are regions and one empty group."""
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_nationkey").alias("task_id"), F.col("c_mktsegment").alias("dim")).agg(mean("c_acctbal").alias("mean"))


def group_mapping(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("task_id"), F.col("n_regionkey").alias("grp"))


def groups(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("grp"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("rationale"))
    return r.union(r.agg(F.max("grp") + 1, F.max("pos") + 1, F.lit("")))


def manifest(spark, d) -> DataFrame:
    x = table(spark, d, "documents")
    i = F.col("doc_id")
    return x.select(
        F.col("source").alias("task_id"), pick(i % 4, "pages", "anchors", "spec_documents", "gated_pages").alias("list_key"), i.alias("pos"),
        F.concat(F.lit("https://docs.example/"), (i % 700).cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("byte_size"), F.when(i % 17 == 0, "timeout").alias("fetch_error"), F.when(i % 19 != 0, "2024-01-0").alias("_d"),
        F.when(i % 23 != 0, F.concat(F.lit("f"), i.cast("string"))).alias("cache_file"), "text", "lang",
    ).withColumn("fetch_date", F.concat("_d", (F.col("pos") % 9 + 1).cast("string"))).drop("_d")


def tool_runs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("run_id")).agg(F.sort_array(F.collect_list(F.concat("role", F.lit("_"), (F.col("turn") % 3).cast("string")))).alias("tools")).withColumn(
        "task_id", F.col("run_id") % 7
    )


def surfaces(spark, d) -> tuple[DataFrame, DataFrame]:
    """Surfaces are the first version segments of key paths: inventory (id, npath) and markers."""
    from ..functions import normal as N

    e = endpoints(spark, d).filter("side = 'gt'")
    ident = F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string"))
    inventory = e.select(ident.alias("id"), F.array_join(N.normalize_path(F.col("path")), "/").alias("npath")).filter("id <> 's2' or npath not like '%fr%'").distinct()
    return inventory, inventory.select("id").distinct().withColumn("markers", F.array(F.regexp_replace("id", "s", "v")))


def hosts(spark, d) -> DataFrame:
    """Pages with host, path, and whether it is one of the first three hosts in order of name."""
    p = table(spark, d, "pages")
    return p.select("page_id", "url", "html", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+([^#]*)", 1).alias("path"))


def robots_bodies(spark, d) -> DataFrame:
    """One robots file per host, made from its number of pages."""
    h = hosts(spark, d).groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    n = F.col("first").cast("string")
    body = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /en/1*\nAllow: /en/1"), (F.col("first") % 10).cast("string"), F.lit("\nCrawl-delay: "), n,
        F.lit("\n\nUser-agent: Reader\nUser-agent: other\nDisallow: /fr/\nDisallow: /*.html$\nAllow: /fr/"), (F.col("first") % 10).cast("string"), F.lit("\nCrawl-delay: 2\nCrawl-delay: x\n"),
    )
    return h.select("host", F.when(F.col("first") % 3 == 0, body).otherwise(F.regexp_replace(body, "(?s)\n\nUser-agent: Reader.*", "")).alias("body"), pick(F.col("first") % 9, 200, 200, 200, 200, 404, 403, 503, 0, -1).alias("status"))


# --- the same in DuckDB: pieces of WITH lists and expressions ---


def sql_pick(index: str, *values) -> str:
    return f"list_extract([{', '.join(repr(v) if isinstance(v, str) else str(v) for v in values)}], CAST({index} AS INTEGER) + 1)"


SQL = {
    "addresses": """SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN '  ' || url || ' '
      WHEN 3 THEN '/v2/Items/{Id}/2.0/sub/' || page_id || '?x=1#y' WHEN 4 THEN 'https://{tenant}.example.com'
      ELSE '/oauth/V1/Users/{user-id}/' || page_id || '/beta' END AS addr FROM pages""",
    "endpoints": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'gt' ELSE 'ans' END AS side, page_id % 11 AS task_id, page_id AS pos,
      {sql_pick('page_id % 3', 'get', 'POST', ' Put ')} AS method,
      CASE WHEN page_id % 3 = 0 THEN bare ELSE regexp_replace(bare, '(\\.(com|net|org))/', '\\1/v' || (page_id % 3) || '/', 'g') END AS path,
      {sql_pick('(page_id // 2) % 6', 'v1', '/V2', 'none', '<v1>', 'svc/v1', 'v2.0')} AS api_version
      FROM (SELECT page_id, regexp_replace(url, '/[0-9]+(\\.html)?', '/{{id}}', 'g') AS bare FROM pages)""",
    "runs": """SELECT 'c' || (user_id % 3) AS condition, event_type AS task_id, event_id AS pos,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS run_index, user_id, value > 20 AS format_failure,
      event_id % 13 = 0 AS format_repaired, round(value, 2) AS cost_usd, event_id * 7 % 1000 AS duration_ms, 'm' || (event_id % 4) AS model,
      event_id % 5 = 0 AS reused, event_id % 17 <> 0 AS discipline_ok FROM events""",
    "scores": """SELECT condition, task_id, pos AS run_index, dim, CASE WHEN (pos + k) % 7 <> 0 AND NOT (condition = 'c2' AND k = 3)
      THEN (pos * (k + 1) % 5) / 4.0 END AS score FROM runs, (VALUES ('endpoint', 0), ('method', 1), ('api_version', 2), ('auth_flow', 3),
      ('required_scopes', 4), ('key_parameters', 5)) t(dim, k) WHERE NOT format_failure""",
    "agg": f"""SELECT condition, task_id, dim, {Q.mean('score')} AS mean, count(score) AS n, CAST(grouping(task_id) AS INTEGER) AS overall
      FROM scores GROUP BY GROUPING SETS ((condition, task_id, dim), (condition, dim))""",
    "group_means": f"SELECT c_nationkey AS task_id, c_mktsegment AS dim, {Q.mean('c_acctbal')} AS mean FROM customer GROUP BY ALL",
    "group_mapping": "SELECT n_nationkey AS task_id, n_regionkey AS grp FROM nation",
    "groups": "SELECT r_regionkey AS grp, r_regionkey AS pos, r_name AS rationale FROM region UNION ALL SELECT max(r_regionkey) + 1, max(r_regionkey) + 1, '' FROM region",
    "rollup_": f"""SELECT grp, pos, dim, {Q.mean('mean')} AS mean, count(DISTINCT CASE WHEN mean IS NOT NULL THEN task_id END) AS tasks
      FROM groups LEFT JOIN group_mapping USING (grp) LEFT JOIN group_means USING (task_id) GROUP BY ALL""",
    "manifest": f"""SELECT source AS task_id, {sql_pick('doc_id % 4', 'pages', 'anchors', 'spec_documents', 'gated_pages')} AS list_key, doc_id AS pos,
      'https://docs.example/' || (doc_id % 700) AS url, sha256(text) AS content_hash, octet_length(encode(text))::BIGINT AS byte_size,
      CASE WHEN doc_id % 17 = 0 THEN 'timeout' END AS fetch_error, CASE WHEN doc_id % 23 <> 0 THEN 'f' || doc_id END AS cache_file, text, lang,
      CASE WHEN doc_id % 19 <> 0 THEN '2024-01-0' || (doc_id % 9 + 1) END AS fetch_date FROM documents""",
    "tool_runs": "SELECT conv_id AS run_id, list_sort(list(role || '_' || (turn % 3))) AS tools, conv_id % 7 AS task_id FROM conversations GROUP BY conv_id",
    "hosts": "SELECT page_id, url, html, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+([^#]*)', 1) AS path FROM pages",
}
_NEEDS = {"scores": ["runs"], "agg": ["scores"], "rollup_": ["group_means", "group_mapping", "groups"]}


def with_views(names: str, body: str) -> str:
    """``body`` behind a WITH list of the named views and what they need."""
    seen: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in seen:
            seen.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in seen) + "\n" + body
