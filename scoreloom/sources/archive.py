"""Reading archived runs, tasks, manifests, API descriptions and transcripts; writing scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N

MATCH = (
    "struct<gt_method:string,gt_path:string,gt_api_version:string,matched:boolean,method_ok:boolean,version_ok:boolean,"
    "answer_method:string,answer_path:string,answer_api_version:string>"
)
#: One archived run.  Free-form parts stay JSON text, so that no field of one tool widens the schema of all.
RUN_SCHEMA = (
    "task_id string, run_index long, format_failure boolean, failure_reason string, dimensions map<string,double>, "
    f"endpoint_matches array<{MATCH}>, input_tokens long, output_tokens long, cost_usd double, duration_ms long, "
    "tool_uses array<struct<name:string,input:string>>, transcript array<struct<role:string,tool_uses:array<string>,text:string>>, "
    "raw_response string, tool_discipline struct<ok:boolean,detail:string,attempts:long>, format_repaired boolean, "
    "repaired_block_text string, exhibit string, mock boolean"
)
HTTP_VERBS = ("get", "put", "post", "delete", "patch", "head", "options")
WINDOW_TOKENS = 200_000


def from_folder(path: Column) -> tuple[Column, Column]:
    """(run_date, condition) of a folder named YYYY-MM-DD-condition; otherwise the name and 'unknown'."""
    folder = F.regexp_extract(path, r"([^/]+)/runs/[^/]+$", 1)
    parts = F.split(folder, "-", 4)
    dated = F.size(parts) == 4
    return F.when(dated, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(folder), F.when(dated, F.get(parts, F.lit(3))).otherwise("unknown")


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Runs under ``path`` (folders of runs/*.json), with condition and date from the folder: one JSON object a file,
    or with ``lines`` one a line."""
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", not lines).json(path)
    date, condition = from_folder(F.col("_metadata.file_path"))
    return raw.select("*", F.col("_metadata.file_name").alias("file"), date.alias("run_date"), condition.alias("condition"))


def ground_truth_endpoints(tasks: DataFrame) -> DataFrame:
    """A task's key endpoints, one a row, with their position.  ``tasks``: task_id, endpoints (array of struct)."""
    return tasks.select("task_id", F.posexplode("endpoints").alias("pos", "e")).select("task_id", "pos", "e.*")


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """The four lists of each task as rows with list_key and pos."""
    lists = [c for c in ("pages", "anchors", "spec_documents", "gated_pages") if c in manifest.columns]
    parts = [manifest.select("task_id", F.lit(c).alias("list_key"), F.posexplode(c).alias("pos", "e")).select("task_id", "list_key", "pos", "e.*") for c in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def manifest_urls(entries: DataFrame, include_anchors: bool = True) -> DataFrame:
    rows = entries if include_anchors else entries.filter("list_key = 'pages'")
    return rows.filter("url is not null").select("url").distinct()


def spec_operations(specs: DataFrame) -> DataFrame:
    """(spec, operation_id, op_method, spec_path, accepted) of each operation with an id.  ``specs``: spec, body (JSON).

    A body is read once: what is said beside an explode in one select is worked out for each row that comes of it.
    """
    server = F.coalesce(F.get_json_object("body", "$.servers[0].url"), F.get_json_object("body", "$.basePath"), F.lit(""))
    paths = F.from_json(F.get_json_object("body", "$.paths"), "map<string,string>")
    read = specs.select("spec", N.server_segments(server).alias("prefix"), paths.alias("paths"))
    one = read.select("spec", "prefix", F.explode("paths").alias("spec_path", "item"))
    two = one.select("spec", "prefix", "spec_path", F.explode(F.from_json("item", "map<string,string>")).alias("verb", "op"))
    named = two.withColumn("operation_id", F.get_json_object("op", "$.operationId")).filter(F.lower("verb").isin(*HTTP_VERBS) & F.col("operation_id").isNotNull())
    return named.select("spec", "operation_id", F.upper("verb").alias("op_method"), "spec_path", N.anchor_paths(F.col("spec_path"), F.col("prefix")).alias("accepted"))


def write_scores(scored: DataFrame, path: str) -> None:
    """Scored runs by condition; only the conditions in ``scored`` are replaced."""
    writer = scored.write.mode("overwrite").partitionBy("condition").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


EVENT_SCHEMA = (
    "type string, subtype string, model string, tools array<string>, mcp_servers array<struct<name:string,status:string>>, "
    "message struct<model:string,content:array<struct<type:string,name:string,text:string>>>, modelUsage map<string,string>, num_turns long, total_cost_usd double"
)


def transcript_events(lines: DataFrame) -> DataFrame:
    """Per run: tool_uses in order, turns, model, offered tools, final usage and text.  ``lines``: run_id, pos, line."""
    events = lines.filter(F.trim("line") != "").withColumn("e", F.from_json("line", EVENT_SCHEMA, {"mode": "PERMISSIVE"})).filter("e.type is not null")
    turn = F.col("e.type") == "assistant"
    names = F.transform(F.filter("e.message.content", lambda c: c["type"] == "tool_use"), lambda c: c["name"])
    words = F.array_join(F.transform(F.filter("e.message.content", lambda c: c["type"] == "text"), lambda c: c["text"]), "")
    init = (F.col("e.type") == "system") & (F.col("e.subtype") == "init")
    last = F.when(F.col("e.type") == "result", F.col("pos"))
    out = events.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(turn, F.struct("pos", names.alias("names"), words.alias("text"))))).alias("t"),
        F.min_by("e.tools", F.when(init, F.col("pos"))).alias("offered"), F.min_by("e.model", F.when(init, F.col("pos"))).alias("model"),
        F.min_by("e.mcp_servers", F.when(init, F.col("pos"))).alias("servers"), F.max_by("e.modelUsage", last).alias("usage"),
    )
    return out.select("run_id", F.flatten("t.names").alias("tool_uses"), F.size("t").alias("turns"), F.array_join("t.text", "\n").alias("text"), "offered", "servers", "model", "usage")


def primary_model(usage: DataFrame, key: str) -> DataFrame:
    """The model with most output tokens of each usage map (model: JSON with either spelling); null if the map is empty."""
    rows = usage.select(key, F.explode_outer("usage").alias("model", "u"))
    tokens = F.coalesce(F.get_json_object("u", "$.outputTokens"), F.get_json_object("u", "$.output_tokens"), F.lit("0")).cast("long")
    return rows.groupBy(key).agg(F.max_by("model", F.struct(tokens, "model")).alias("model"))


def spec_file_sizes(files: DataFrame, prefix: str = "") -> DataFrame:
    """Count, bytes, largest file, tokens and share of a context window.  ``files``: path, length."""
    kept = files.filter(F.col("path").startswith(prefix) & F.lower("path").rlike(r"\.(yaml|yml|json)$"))
    out = kept.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max_by("path", F.struct("length", "path")).alias("largest"))
    return out.withColumns({"tokens": F.floor(F.col("bytes") / 4), "windows": F.bround(F.floor(F.col("bytes") / 4) / WINDOW_TOKENS, 1)})


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def first_by_position(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
