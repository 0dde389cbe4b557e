"""Analytics over archived runs: what answers missed, which tools they used, which surface they name, what to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from .running import summed_before
from .search import ASCII, NONE, UNICODE, occurrences

# Fields that scoring decides, and fields that the run itself produced.
DERIVED_FIELDS = ("format_failure", "failure_reason", "dimensions", "endpoint_matches", "format_repaired", "repaired_block_text", "exhibit")
TRANSPORT_FIELDS = ("raw_response", "transcript", "tool_uses", "tool_discipline", "input_tokens", "output_tokens", "cost_usd", "duration_ms", "mock")
AMBIGUOUS_CEILING = 0.10
BREAKER_THRESHOLD, BREAKER_FLOOR = 0.20, 20


def unmatched_endpoints(answers: DataFrame, key: DataFrame) -> DataFrame:
    """(task_id, method, path, n) of answer endpoints whose path is not among the task's key paths.

    Base prefixes are not taken off here, unlike in matching.  Tasks without a key are skipped.
    """
    paths = key.select("task_id", N.normalize_path(F.col("path")).alias("np")).distinct()
    tasks = key.select("task_id").distinct()
    known = answers.join(tasks, "task_id", "left_semi").withColumn("np", N.normalize_path(F.col("path")))
    left = known.join(paths, ["task_id", "np"], "left_anti")
    return left.groupBy("task_id", F.coalesce("method", F.lit("?")).alias("method"), F.coalesce("path", F.lit("?")).alias("path")).agg(F.count("*").alias("n"))


def unmatched_all_conditions(parts: list[DataFrame]) -> DataFrame:
    """Counts of several conditions added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("task_id", "method", "path").agg(F.sum("n").alias("n"))


def consultation_rates(runs: DataFrame, prefix: str) -> DataFrame:
    """Per task, and over all with a null task_id: runs, consulted, skipped and skip_rate.  ``runs``: task_id, tools."""
    used = F.exists(F.coalesce("tools", F.array().cast("array<string>")), lambda t: F.coalesce(t.startswith(prefix), F.lit(False)))
    flagged = runs.select("task_id", used.alias("used"))
    out = flagged.rollup("task_id").agg(F.count("*").alias("runs"), F.count_if("used").alias("consulted"), F.count_if(~F.col("used")).alias("skipped"))
    return out.withColumn("skip_rate", F.bround(F.col("skipped") / F.col("runs"), 3))


def _sole(wanted: DataFrame, index: DataFrame, within: list[str], versions: str, name: str) -> DataFrame:
    """(within, versions, name): the one surface of ``index`` (within, marker, id) that a version stands for, where there
    is one and no other.  Each distinct (within, versions) is looked up once, by equality of markers."""
    asked = wanted.select(*within, versions).distinct().withColumn("marker", F.explode(F.array_distinct(versions)))
    hits = asked.join(index, [*within, "marker"]).groupBy(*within, versions).agg(F.count_distinct("id").alias("_n"), F.min("id").alias(name))
    return hits.filter("_n = 1").drop("_n")


def classify_endpoints(endpoints: DataFrame, inventory: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``endpoints`` (path, api_version, ...) with bucket: a surface, unrecognized, ambiguous or conflicted.

    ``inventory``: id, npath (normalized, joined by /); ``surfaces``: id, markers (normalized array).  Surfaces are found
    through inverted indexes, path to surfaces and marker to surfaces, and "the only one" by counting what they give; no
    row meets all surfaces.
    """
    declared = surfaces.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("markers"))).alias("markers"))
    placed = inventory.select("id", "npath").distinct().join(declared, "id")
    by_marker = declared.select("id", F.explode("markers").alias("marker"))
    by_path_marker = placed.select("npath", "id", F.explode("markers").alias("marker"))
    paths = placed.groupBy("npath").agg(F.count("*").alias("_n"), F.min_by("id", "id").alias("_only"), F.min_by("markers", "id").alias("_markers"))
    rows = endpoints.withColumns(
        {
            "npath": F.array_join(N.normalize_path(F.col("path")), "/"),
            "_by_path": F.array_sort(F.array_distinct(N.version_segments(F.col("path")))),
            "_by_field": F.filter(F.array(N.normalize_version(F.col("api_version"))), lambda v: v != ""),
        }
    ).withColumn("_stated", F.array_sort(F.array_union("_by_path", "_by_field")))
    joined = rows.join(paths, "npath", "left")
    one, many = joined.filter("_n = 1"), joined.filter("_n > 1")
    joined = joined.join(_sole(one, by_marker, [], "_stated", "_elsewhere"), ["_stated"], "left")
    for versions, name in (("_by_path", "_p"), ("_by_field", "_f")):
        joined = joined.join(_sole(many, by_path_marker, ["npath"], versions, name), ["npath", versions], "left")
    misses = (F.size("_markers") > 0) & ~F.coalesce(F.arrays_overlap("_markers", "_stated"), F.lit(False))
    bucket = (
        F.when(F.col("_n").isNull(), "unrecognized")
        .when(F.col("_n") == 1, F.when(misses & F.col("_elsewhere").isNotNull(), "conflicted").otherwise(F.col("_only")))
        .when(F.col("_p") != F.col("_f"), "conflicted")
        .otherwise(F.coalesce("_p", "_f", F.lit("ambiguous")))
    )
    return joined.select(*[F.col(c) for c in endpoints.columns if c != "npath"], "npath", bucket.alias("bucket"))


def classify_runs(classified: DataFrame, matches: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per run the bucket of its first endpoint whose path a key endpoint matched, else no-match."""
    hit = matches.filter("matched").select(*keys, F.col("answer_path").alias("npath")).distinct()
    first = classified.join(hit, [*keys, "npath"], "left_semi").groupBy(*keys).agg(F.min_by("bucket", "pos").alias("bucket"))
    return runs.select(*keys).distinct().join(first, keys, "left").withColumn("bucket", F.coalesce("bucket", F.lit("no-match")))


def surface_report(classified: DataFrame, by: list[str]) -> DataFrame:
    """Endpoints per bucket with their share, and whether the share of ambiguous ones lets the split be reported."""
    counts = classified.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.count_if(N.states_host(F.col("path"))).alias("host_stated"))
    whole = Window.partitionBy(*by)
    total = F.sum("n").over(whole)
    ambiguous = F.sum(F.when(F.col("bucket") == "ambiguous", F.col("n")).otherwise(0)).over(whole)
    return counts.withColumns({"share": F.round(F.col("n") / total, 6), "reportable": (ambiguous / total) <= AMBIGUOUS_CEILING})


def residual_examples(classified: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent (method, path) that no surface claims."""
    left = classified.filter(F.col("bucket").isin("unrecognized", "ambiguous", "conflicted"))
    counts = left.groupBy("bucket", N.normalize_method(F.col("method")).alias("method"), "npath").agg(F.count("*").alias("n"))
    order = Window.partitionBy("bucket").orderBy(F.desc("n"), "method", "npath")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def operation_mentions(texts: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """Per text and surface the number of declared names (``operations``: id, name) that stand in it as whole words."""
    declared = operations.select("id", "name")
    hits = occurrences(texts, declared, key, F.col("name"), F.lit(False), F.lit(UNICODE))
    return hits.groupBy(key, "id").agg(F.count("*").alias("mentions"))


def key_surface_check(classified: DataFrame, measured: str) -> DataFrame:
    """Key endpoints that are not classified as the measured surface."""
    return classified.filter(F.col("bucket") != measured)


def tool_discipline(runs: DataFrame, prefix: str | None, discovery: str | None = None) -> DataFrame:
    """ok, offenders and layer_calls per run.  Without a prefix no tool may be named at all."""
    named = F.filter(F.coalesce("tools", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    allowed = (lambda t: F.lit(False)) if prefix is None else (lambda t: t.startswith(prefix) | (t == F.lit(discovery or "")))
    bad = F.array_sort(F.array_distinct(F.filter(named, lambda t: ~allowed(t))))
    calls = F.lit(0) if prefix is None else F.size(F.filter(named, lambda t: t.startswith(prefix)))
    return runs.withColumns({"ok": F.size(bad) == 0, "offenders": F.array_join(bad, ","), "layer_calls": calls})


def format_failure_breaker(runs: DataFrame, keys: list[str], threshold: float = BREAKER_THRESHOLD, floor: int = BREAKER_FLOOR) -> DataFrame:
    """Per condition the first position at which at least ``floor`` runs failed at a rate above ``threshold``."""
    failed = F.coalesce(F.col("format_failure"), F.lit(False)).cast("long")
    before = summed_before(runs.select(*keys, "pos", "format_failure"), keys, "pos", {"_n": F.lit(1), "_f": failed})
    rows = before.withColumns({"_n": F.col("_n") + 1, "_f": F.col("_f") + failed})
    trips = (F.col("_n") >= floor) & (F.col("_f") / F.col("_n") > threshold) & F.lit(threshold < 1)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if("format_failure").alias("failures"), F.min(F.when(trips, F.col("pos"))).alias("trip_pos"),
        F.min(F.when(trips, F.col("_n"))).alias("trip_runs"),
    )


def worst_tasks(runs: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    counts = runs.groupBy(*keys, "task_id").agg(F.count_if("format_failure").alias("failures")).filter("failures > 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("failures"), "task_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def plan_runs(tasks: DataFrame, conditions: DataFrame, n: int) -> DataFrame:
    """Every (condition, task_id, run_index) to have, indices 0 to n - 1."""
    return tasks.select("task_id").join(conditions.select("condition")).withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def pending_runs(plan: DataFrame, archive: DataFrame, mock: bool = False) -> DataFrame:
    """What of the plan is to be run, and why: missing, made with another mock setting, or undisciplined."""
    keys = ["condition", "task_id", "run_index"]
    have = archive.select(*keys, F.coalesce("mock", F.lit(False)).alias("_mock"), F.coalesce("discipline_ok", F.lit(True)).alias("_ok"), F.lit(True).alias("_have"))
    joined = plan.join(have, keys, "left")
    reason = F.when(F.col("_have").isNull(), "missing").when(F.col("_mock") != mock, "mock").when(~F.col("_ok"), "discipline")
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*keys, "reason")


def reconcile(runs: DataFrame, published: DataFrame, keys: list[str], transport: list[str], derived: list[str]) -> DataFrame:
    """One row per key of either side: a blocking problem, or the derived fields that change, or null for no change."""
    both = [*transport, *derived]
    left = runs.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"l_{c}") for c in both])
    right = published.groupBy(*keys).agg(F.count("*").alias("_m"), *[F.first(c).alias(f"r_{c}") for c in both])
    joined = left.join(right, keys, "full")
    drift = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in transport])), ",")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in derived])), ",")
    problem = (
        F.when((F.col("_n") > 1) | (F.col("_m") > 1), "duplicate key")
        .when(F.col("_m").isNull(), "not published")
        .when(F.col("_n").isNull(), "not run")
        .when(drift != "", F.concat(F.lit("drift: "), drift))
    )
    return joined.select(*keys, problem.alias("problem"), F.when(problem.isNull() & (changed != ""), changed).alias("changed"))


def reconciled(runs: DataFrame, published: DataFrame, keys: list[str], transport: list[str], derived: list[str]) -> DataFrame:
    """``runs`` with the derived fields of ``published``; refuses the whole directory if anything blocks it."""
    found = reconcile(runs, published, keys, transport, derived)
    blocked = found.filter(F.col("problem").isNotNull()).limit(1).collect()
    if blocked:
        raise ValueError(f"the archive and what is published do not agree: {blocked[0]['problem']}")
    new = published.select(*keys, *[F.col(c).alias(f"_{c}") for c in derived])
    return runs.join(new, keys).withColumns({c: F.col(f"_{c}") for c in derived}).select(*runs.columns)


def default_tokens(ids: DataFrame) -> DataFrame:
    """(token, kind): every id, and the id without its separators, as substrings.  ``ids``: id."""
    spelled = F.array_distinct(F.array("id", F.regexp_replace("id", "[^A-Za-z0-9]", "")))
    return ids.select(F.explode(spelled).alias("token"), F.lit("substring").alias("kind")).filter("token <> ''").distinct()


def ambiguous_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens declared both as whole words and as substrings, which is an error."""
    bounded = F.col("kind").isin("cased-word", "word", "product-cased")
    per = tokens.groupBy(F.lower("token").alias("token")).agg(F.bool_or(bounded).alias("b"), F.bool_or(~bounded).alias("u"))
    return per.filter("b and u").select("token")


def token_leak_scan(lines: DataFrame, tokens: DataFrame, key: str, excluded: str | None = None) -> DataFrame:
    """(key, token, kind) of declared tokens found in lines.

    ``tokens``: token, kind: substring, cased, cased-word, word or product-cased, with ASCII word bounds; ``excluded``:
    a pattern of the paths (column path) that are not scanned.
    """
    read = lines if excluded is None else lines.filter(~F.coalesce(F.col("path").rlike(excluded), F.lit(False)))
    kind = F.col("kind")
    bounds = F.when(kind.isin("substring", "cased"), NONE).otherwise(ASCII)
    return occurrences(read.select(key, "text"), tokens.select("token", "kind"), key, F.col("token"), kind.isin("substring", "word"), bounds)
