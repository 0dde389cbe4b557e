"""Data-quality gates.  Each returns its violations: one row per broken rule, with gate, subject and problem."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..sources import answers
from ..sources.staging import stored
from . import matching
from .search import UNICODE, occurrences

# What a task may say.
DIFFICULTIES = ("read", "write", "multi-step")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
API_CATEGORIES = (
    "authenticate", "find-principal", "list-principal-accounts", "grant-access", "revoke-access", "search-filter",
    "audit-report", "connect-source", "policy-object-create-and-test", "review-campaign", "event-subscription",
)
DOCS_CATEGORIES = ("select-hardware", "verify-compatibility", "plan-revision-upgrade", "identify-replacement")
MIN_DUPLICATE_BYTES = 200
MIN_NOTE = 40
#: Parts of a category that no list names.
SALTS = 256
OUTCOME_FIELDS = ("content_hash", "byte_size", "cache_file", "fetch_error")


def violations(rows: DataFrame, gate: str, subject: Column, rules: dict[str, Column], *keep: str) -> DataFrame:
    """The rules (problem: condition that breaks it) that each row breaks, with the columns ``keep``.  One pass, no shuffle."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(problem)) for problem, broken in rules.items()]))
    return rows.select(F.lit(gate).alias("gate"), subject.cast("string").alias("subject"), F.explode(named).alias("problem"), *keep)


def _blank(c: str) -> Column:
    return F.coalesce(N.strip(F.col(c)), F.lit("")) == ""


def task_schema(tasks: DataFrame) -> DataFrame:
    """``tasks``: task_id, category, difficulty, prompt, method, path, spec_ref, doc_only, doc_url (one key endpoint a row)."""
    spec, doc = ~_blank("spec_ref"), F.coalesce(F.col("doc_only"), F.lit(False)) & F.col("doc_url").rlike("^https?://")
    return violations(tasks, "task-schema", F.col("task_id"), {
        "no prompt": _blank("prompt"),
        "unknown category": ~F.coalesce(F.col("category"), F.lit("")).isin(*API_CATEGORIES),
        "unknown difficulty": ~F.coalesce(F.col("difficulty"), F.lit("")).isin(*DIFFICULTIES),
        "unknown method": ~F.coalesce(F.col("method"), F.lit("")).isin(*VERBS),
        "path does not start with a slash": ~F.coalesce(F.col("path"), F.lit("")).startswith("/"),
        "not anchored exactly once": spec == F.coalesce(doc, F.lit(False)),
    })


def task_lists(tasks: DataFrame, file_prefix: str | None = None) -> DataFrame:
    """Whole tasks with all their lists: a missing or empty one, a blank text, and every endpoint of the key by position.

    ``tasks``: task_id, category, difficulty, prompt, notes, auth_flow, success_shape, required_scopes, key_parameters,
    common_failure_modes (arrays), endpoints (array of method, path, api_version, operation_id, spec_file, spec_operation,
    doc_only, doc_url).  An operation's file is under ``file_prefix``, where one is given.
    """
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    of_task = violations(tasks, "task-lists", F.col("task_id"), {
        "no prompt": _blank("prompt"), "unknown category": ~F.coalesce(F.col("category"), F.lit("")).isin(*API_CATEGORIES),
        "unknown difficulty": ~F.coalesce(F.col("difficulty"), F.lit("")).isin(*DIFFICULTIES), "notes are blank": F.col("notes").isNotNull() & _blank("notes"),
        "no auth flow": _blank("auth_flow"), "no success shape": _blank("success_shape"), "no scopes list": F.col("required_scopes").isNull(),
        "no parameters": empty("key_parameters"), "no failure modes": empty("common_failure_modes"), "no endpoints": empty("endpoints"),
    })
    points = tasks.select("task_id", F.posexplode("endpoints").alias("pos", "e")).select("task_id", "pos", "e.*")
    spec = ~_blank("spec_operation") & ~_blank("spec_file")
    doc = F.coalesce(F.col("doc_only"), F.lit(False)) & F.coalesce(F.col("doc_url").rlike("^https?://"), F.lit(False))
    outside = F.lit(False) if file_prefix is None else spec & ~F.startswith("spec_file", F.lit(file_prefix))
    of_point = violations(points, "task-lists", F.concat_ws(":", F.col("task_id").cast("string"), F.col("pos").cast("string")), {
        "unknown method": ~F.coalesce(F.col("method"), F.lit("")).isin(*VERBS), "path does not start with a slash": ~F.coalesce(F.col("path"), F.lit("")).startswith("/"),
        "no version": _blank("api_version"), "no operation id": _blank("operation_id"), "not anchored exactly once": spec == doc, "file outside the prefix": outside,
    })
    return of_task.unionByName(of_point)


def docs_task_schema(tasks: DataFrame) -> DataFrame:
    """``tasks``: task_id, pub_number, pub_revision, pub_url; version and observations as variants: what was written,
    null or a text, and null or a map of texts."""
    return violations(tasks, "docs-task-schema", F.col("task_id"), {
        "no publication number": _blank("pub_number"),
        "no publication revision": _blank("pub_revision"),
        "no publication url": ~F.coalesce(F.col("pub_url").rlike("^https?://"), F.lit(False)),
        "version is not text": F.col("version").isNotNull() & (F.schema_of_variant("version") != "STRING"),
        "observation is not text": F.col("observations").isNotNull() & ~F.coalesce(F.schema_of_variant("observations").rlike(r"^OBJECT<(\S+: STRING(, |>$))+$"), F.lit(False)),
    })


def task_suite(tasks: DataFrame, expected: DataFrame | None, na: DataFrame, categories: Iterable[str]) -> DataFrame:
    """Task ids that differ from their file's stem, come twice, are missing or were not expected (None: any id is),
    tasks of a category that does not apply, categories said not to apply that are none, and a suite without tasks.

    ``tasks``: task_id, stem, category; ``expected``: task_id; ``na``: category.

    Categories are few and tasks many, so tasks do not move to meet them: those of ``categories`` that do not apply are
    broadcast, no more than there are in that list.  What tasks call by another name is dealt by task beside its category.
    """
    categories = list(categories)

    def say(df: DataFrame, subject: Column, problem: str) -> DataFrame:
        return df.select(F.lit("task-suite").alias("gate"), subject.cast("string").alias("subject"), F.lit(problem).alias("problem"))

    named = tasks.filter(~_blank("task_id"))
    # Counted before anything is joined: an anti join of plain ids is moved below their distinct, and sorts every task.
    counts = named.groupBy("task_id").agg(F.count("*").alias("n"))
    not_applicable = na.select("category").distinct()
    known = F.col("category").isin(*categories)
    salts = not_applicable.filter(~known).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = tasks.filter(~known).withColumn("_salt", F.pmod(F.xxhash64("task_id", "stem"), F.lit(SALTS)).cast("int"))
    parts = [
        say(named.filter(F.col("task_id").cast("string") != F.col("stem")), F.col("stem"), "id differs from the file's stem"),
        say(counts.filter("n > 1"), F.col("task_id"), "duplicate"),
        say(tasks.filter(known).join(F.broadcast(not_applicable.filter(known)), "category", "left_semi"), F.col("stem"), "category does not apply"),
        say(others.join(salts, ["category", "_salt"], "left_semi"), F.col("stem"), "category does not apply"),
        say(not_applicable.filter(~known), F.col("category"), "unknown category marked as not applicable"),
        say(tasks.agg(F.count("*").alias("n")).filter("n = 0"), F.lit("*"), "no tasks"),
    ]
    if expected is not None:
        both = counts.join(expected.select("task_id").distinct().withColumn("_wanted", F.lit(True)), "task_id", "full")
        problem = F.when(F.col("n").isNull(), "missing").otherwise("unexpected")
        parts.append(both.filter("n is null or _wanted is null").select(F.lit("task-suite").alias("gate"), F.col("task_id").cast("string").alias("subject"), problem.alias("problem")))
    return union(parts)


def task_groups_partition(groups: DataFrame, members: DataFrame, tasks: DataFrame) -> DataFrame:
    """``groups``: grp, rationale; ``members``: grp, task_id; ``tasks``: task_id."""
    def say(df: DataFrame, subject: str, problem: str) -> DataFrame:
        return df.select(F.lit("task-groups").alias("gate"), F.col(subject).cast("string").alias("subject"), F.lit(problem).alias("problem"))

    parts = [
        say(groups.join(members, "grp", "left_anti"), "grp", "no tasks"),
        say(groups.filter(_blank("rationale")), "grp", "no rationale"),
        say(members.join(tasks, "task_id", "left_anti").select("task_id").distinct(), "task_id", "unknown task"),
        say(members.groupBy("task_id").agg(F.count_distinct("grp").alias("n")).filter("n > 1"), "task_id", "in more than one group"),
        say(tasks.select("task_id").distinct().join(members, "task_id", "left_anti"), "task_id", "in no group"),
    ]
    return union(parts)


def union(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def surface_declarations(surfaces: DataFrame, inventory: DataFrame) -> DataFrame:
    """``surfaces``: id, measured, rationale, markers; ``inventory``: id, npath."""
    def say(df: DataFrame, subject: Column, problem: str) -> DataFrame:
        return df.select(F.lit("surfaces").alias("gate"), subject.cast("string").alias("subject"), F.lit(problem).alias("problem"))

    whole = surfaces.agg(F.count("*").alias("n"), F.count_if("measured").alias("m"))
    shared = inventory.distinct().join(surfaces.select("id", "markers"), "id")
    # A shared path is divided where each of its surfaces has markers and no marker is that of two of them.
    crowded = shared.groupBy("npath").agg(F.count_distinct("id").alias("n"), F.min(F.size("markers")).alias("least")).filter("n > 1 and least = 0")
    twice = shared.select("npath", "id", F.explode("markers").alias("marker")).groupBy("npath", "marker").agg(F.count_distinct("id").alias("n")).filter("n > 1")
    undivided = crowded.select("npath").union(twice.select("npath"))
    return union([
        say(whole.filter("n < 2"), F.lit("*"), "fewer than two surfaces"),
        say(whole.filter("m <> 1"), F.lit("*"), "not exactly one measured"),
        say(surfaces.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), F.col("id"), "declared more than once"),
        say(surfaces.join(inventory, "id", "left_anti"), F.col("id"), "empty inventory"),
        say(surfaces.filter(_blank("rationale")), F.col("id"), "no rationale"),
        say(undivided.distinct(), F.col("npath"), "shared path without markers that divide it"),
    ])


def manifest_consistency(entries: DataFrame, subject: str = "url") -> DataFrame:
    """``entries`` with a boolean has_<field> for each outcome field (its presence) beside the fields themselves."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    arrived = F.col("has_content_hash") | F.col("has_byte_size") | (text("cache_file") != "")
    outcome = F.col("has_content_hash") | F.col("has_byte_size") | F.col("has_cache_file") | F.col("has_fetch_error")
    error, dated = text("fetch_error") != "", text("fetch_date") != ""
    return violations(entries, "manifest", F.col(subject), {
        "error beside content": error & arrived,
        "file without hash": ~(error & arrived) & (text("cache_file") != "") & ~F.col("has_content_hash"),
        "outcome without date": outcome & ~dated,
        "date without outcome": dated & ~outcome,
    })


def prompt_names(prompts: DataFrame, names: DataFrame, key: str = "task_id") -> DataFrame:
    """Prompts that name no vendor or no product.  ``names``: name, kind (vendor or product); a blank one is an error.

    Without any declared name every prompt fails.
    """
    blank = names.filter(_blank("name")).select(F.lit("prompt-names").alias("gate"), F.col("kind").alias("subject"), F.lit("blank name").alias("problem"))
    # White space inside a name is as wide as it likes: one blank in the name and in the text stands for any.
    one_blank = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    texts = prompts.select(key, one_blank(F.col("text")).alias("text"))
    declared = names.filter(~_blank("name")).select("name", "kind")
    hits = occurrences(texts, declared, key, one_blank(N.strip(F.col("name"))), F.lit(True), F.lit(UNICODE))
    per = hits.groupBy(key).agg(F.bool_or(F.col("kind") == "vendor").alias("v"), F.bool_or(F.col("kind") == "product").alias("p"))
    named = violations(prompts.select(key).distinct().join(per, key, "left"), "prompt-names", F.col(key), {
        "names no vendor": ~F.coalesce(F.col("v"), F.lit(False)), "names no product": ~F.coalesce(F.col("p"), F.lit(False)),
    })
    return named.unionByName(blank)


def dual_listed(names: DataFrame) -> DataFrame:
    """Names declared as vendor and as product."""
    return names.groupBy(F.lower(N.strip(F.col("name"))).alias("name")).agg(F.count_distinct("kind").alias("n")).filter("n > 1").select("name")


def roundtrip_scores(keys: DataFrame) -> DataFrame:
    """(task_id, via, endpoint, method, api_version): keys scored against themselves, directly and by way of the text
    of an answer, which is written and decoded again.  ``keys``: task_id, pos, method, path, api_version.

    A row of text holds one task's endpoints.
    """
    point = F.struct("pos", "method", "path", "api_version")
    lists = keys.groupBy("task_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    bare = F.transform("p", lambda e: F.struct(e["method"].alias("method"), e["path"].alias("path"), e["api_version"].alias("api_version")))
    none = F.array().cast("array<string>")
    written = lists.select("task_id", answers.render_answers(bare, F.lit("bearer"), none, none).alias("raw_response"))
    back = answers.decode_answers(written).select("task_id", F.posexplode("endpoints").alias("pos", "e")).select("task_id", "pos", "e.*")
    ways = (("direct", keys), ("text", back))
    return union([matching.endpoint_scores(matching.match_endpoints(keys, other, ["task_id"]), ["task_id"]).select("task_id", F.lit(via).alias("via"), "endpoint", "method", "api_version") for via, other in ways])


def roundtrip(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Keys that do not score 1 against themselves.  ``scores``: task_id, dim, score; ``tasks``: task_id, auth_flow."""
    wrong = scores.filter("score < 1").select(F.col("task_id"), F.concat(F.lit("scores below 1: "), "dim").alias("problem"))
    empty = scores.groupBy("task_id").agg(F.count("score").alias("n")).filter("n = 0").select("task_id", F.lit("nothing is scored").alias("problem"))
    vague = tasks.filter(N.canonical_auth_flow(F.col("auth_flow")) == N.UNKNOWN_AUTH).select("task_id", F.lit("names no known style").alias("problem"))
    return union([wrong, empty, vague]).select(F.lit("roundtrip").alias("gate"), F.col("task_id").cast("string").alias("subject"), "problem")


def severity(found: DataFrame, cohort: Column) -> DataFrame:
    """``found`` with ``blocks``: violations of the docs cohort block, those of the API cohort warn."""
    return found.withColumn("blocks", cohort == "docs")


def dimension_coverage(dimensions: DataFrame, scores: DataFrame, declared: DataFrame) -> DataFrame:
    """``dimensions``: dim; ``scores``: dim, score; ``declared``: dim, reason."""
    used = scores.groupBy("dim").agg(F.bool_or(F.col("score").isNotNull()).alias("used"))
    every = dimensions.join(used, "dim", "left").join(declared.withColumn("_d", F.lit(True)), "dim", "left")
    seen, said = F.coalesce(F.col("used"), F.lit(False)), F.coalesce(F.col("_d"), F.lit(False))
    rules = violations(every, "dimension-coverage", F.col("dim"), {
        "not exercised and not declared": ~seen & ~said, "declared but exercised": seen & said, "declared without reason": said & _blank("reason"),
    })
    unknown = declared.join(dimensions, "dim", "left_anti").select(F.lit("dimension-coverage").alias("gate"), F.col("dim").alias("subject"), F.lit("unknown dimension").alias("problem"))
    return rules.unionByName(unknown)


def cited_tolerance_rules(tolerances: DataFrame, keys: DataFrame) -> DataFrame:
    """``tolerances``: task_id, kind (auth, version or prefix), value, evidence, note; ``keys``: task_id, kind, value."""
    value = F.when(F.col("kind") == "version", N.normalize_version(F.col("value"))).otherwise(F.lower(N.strip(F.coalesce("value", F.lit("")))))
    rows = tolerances.withColumn("_v", value)
    same = Window.partitionBy("task_id", "kind", "_v")
    own = keys.select("task_id", "kind", F.when(F.col("kind") == "version", N.normalize_version(F.col("value"))).otherwise(F.lower(N.strip(F.col("value")))).alias("_v"), F.lit(True).alias("_own")).distinct()
    rows = rows.withColumn("_n", F.count("*").over(same)).join(own, ["task_id", "kind", "_v"], "left")
    return violations(rows, "tolerances", F.concat_ws(":", F.col("task_id").cast("string"), "kind", "value"), {
        "no value": F.col("_v") == "",
        "evidence is not a web address": ~F.coalesce(F.col("evidence").rlike("^https?://"), F.lit(False)),
        "evidence is a copy": N.rehosting_host(F.col("evidence")).isNotNull(),
        "note too short": F.length(N.strip(F.coalesce("note", F.lit("")))) < MIN_NOTE,
        "declared twice": F.col("_n") > 1,
        "does not widen": F.coalesce(F.col("_own"), F.lit(False)),
        "unknown style": (F.col("kind") == "auth") & ~F.col("_v").isin(*[s for s, _ in N.AUTH_STYLES]),
        "prefix does not start with a slash": (F.col("kind") == "prefix") & ~F.col("_v").startswith("/"),
    })


def tolerance_sets(tolerances: DataFrame, tasks: DataFrame) -> DataFrame:
    """What a task's tolerances amount to together.  ``tolerances``: task_id, kind, value, evidence, note; ``tasks``:
    task_id, auth_flow.

    One without evidence and note is a bare string; one that stands for no version accepts every answer that names none; a
    style that the key's prose does not name is not what a reader sees; and styles that, with the key's own, are all the
    known ones accept everything.
    """
    known = [style for style, _ in N.AUTH_STYLES]
    rows = tolerances.join(tasks.select("task_id", "auth_flow"), "task_id", "left").withColumn("_v", F.lower(N.strip(F.coalesce("value", F.lit("")))))
    bare = F.col("evidence").isNull() & F.col("note").isNull()
    style = (F.col("kind") == "auth") & F.col("_v").isin(*known)
    one = violations(rows, "tolerances", F.concat_ws(":", F.col("task_id").cast("string"), "kind", "value"), {
        "bare string": bare, "stands for no version": ~bare & (F.col("kind") == "version") & (F.col("_v") != "") & (N.normalize_version(F.col("value")) == ""),
        "key does not name it": ~bare & style & ~F.array_contains(N.auth_concepts(F.col("auth_flow")), F.col("_v")),
    })
    own = N.canonical_auth_flow(F.first("auth_flow"))
    sets = rows.filter(style).groupBy("task_id").agg(F.array_union(F.collect_set("_v"), F.array(own)).alias("_all"), own.alias("_own"))
    every = sets.filter((F.col("_own") != N.UNKNOWN_AUTH) & (F.size("_all") == len(known)))
    return one.unionByName(every.select(F.lit("tolerances").alias("gate"), F.col("task_id").cast("string").alias("subject"), F.lit("accepts everything").alias("problem")))


def robots_refusals(hosts: DataFrame, declared: DataFrame) -> DataFrame:
    """``hosts``: host, refused; ``declared``: host, reason."""
    refused = hosts.filter("refused").select("host").distinct()
    missing = refused.join(declared.filter(~_blank("reason")), "host", "left_anti").select("host", F.lit("refused but not declared").alias("problem"))
    stale = declared.join(refused, "host", "left_anti").select("host", F.lit("declared but not refused").alias("problem"))
    return missing.union(stale).select(F.lit("robots").alias("gate"), F.col("host").alias("subject"), "problem")


def document_anchoring(endpoints: DataFrame, manifest: DataFrame, prefixed: DataFrame) -> DataFrame:
    """``endpoints``: task_id, operation_id, doc_ref; ``manifest``: url; ``prefixed``: task_id of tasks that declare a prefix.

    A cited page must be in the manifest, and a task that declares a prefix needs an endpoint anchored by operation.
    """
    cited = endpoints.filter(~_blank("doc_ref"))
    lost = cited.join(manifest.select(F.col("url").alias("doc_ref")).distinct(), "doc_ref", "left_anti").select("task_id", F.lit("cited page is not in the manifest").alias("problem"))
    anchored = endpoints.filter(~_blank("operation_id")).select("task_id").distinct()
    bare = prefixed.select("task_id").distinct().join(anchored, "task_id", "left_anti").select("task_id", F.lit("prefix without an operation").alias("problem"))
    return lost.union(bare).select(F.lit("anchoring").alias("gate"), F.col("task_id").cast("string").alias("subject"), "problem")


def anchoring(endpoints: DataFrame, operations: DataFrame) -> DataFrame:
    """``endpoints``: task_id, operation_id, method, path; ``operations``: operation_id, op_method, accepted (array)."""
    joined = endpoints.join(operations, "operation_id", "left")
    path = F.lower(F.regexp_replace(F.col("path"), "^/+|/+$", ""))
    accepted = F.transform("accepted", lambda p: F.lower(F.regexp_replace(p, "^/+|/+$", "")))
    known = F.col("op_method").isNotNull()
    return violations(joined, "anchoring", F.concat_ws(":", F.col("task_id").cast("string"), F.col("operation_id").cast("string")), {
        "no such operation": ~known,
        "method differs": known & (N.normalize_method(F.col("method")) != F.col("op_method")),
        "path differs": known & ~F.array_contains(accepted, path),
    })


def docs_anchoring(citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cited addresses (task_id, url) that the manifest (url) lacks."""
    lost = citations.join(manifest.select("url").distinct(), "url", "left_anti")
    return lost.select(F.lit("docs-anchoring").alias("gate"), F.col("task_id").cast("string").alias("subject"), F.lit("not in the manifest").alias("problem"))


def substitution(entries: DataFrame, least: int = MIN_DUPLICATE_BYTES) -> DataFrame:
    """Contents of at least ``least`` bytes that stand under more than one address."""
    big = entries.filter((F.col("byte_size") >= least) & (F.coalesce("content_hash", F.lit("")) != ""))
    return big.groupBy("content_hash").agg(F.count_distinct("url").alias("urls"), F.max("byte_size").alias("byte_size")).filter("urls > 1")


def truncation_audit(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``texts``: task_id, full, injected; ``items``: task_id, item, spellings (array)."""
    said = lambda c: F.exists("spellings", lambda s: F.contains(F.col(c), s))
    found = texts.join(items, "task_id").withColumns({"_full": said("full"), "_injected": said("injected")})
    return found.select(
        "task_id", "item", F.col("_full").alias("documented"), F.col("_injected").alias("injected"),
        (F.col("_full") & ~F.col("_injected")).alias("truncated"), (F.length("full") >= F.array_min(F.transform("spellings", F.length))).alias("searchable"),
    )


def truncation_gate(audit: DataFrame, cohort: Column) -> DataFrame:
    """(gate, subject, problem, blocks) of ``truncation_audit``'s rows that the budget cut away or that cannot be searched."""
    found = violations(audit.withColumn("_cohort", cohort), "truncation", F.concat_ws(":", F.col("task_id").cast("string"), F.col("item").cast("string")), {
        "cut away by the budget": F.col("truncated"), "text shorter than any spelling": ~F.col("searchable"),
    }, "_cohort")
    return severity(found, F.col("_cohort")).drop("_cohort")


def disclosure(injected: DataFrame, anchors: DataFrame, declared: DataFrame) -> DataFrame:
    """Injected addresses that also anchor the key must be declared, and only those.  All three: task_id, url."""
    keys = ["task_id", "url"]
    overlap = injected.select(*keys).distinct().join(anchors.select(*keys).distinct(), keys, "left_semi")
    hidden = overlap.join(declared, keys, "left_anti").withColumn("problem", F.lit("overlap not declared"))
    stale = declared.select(*keys).distinct().join(overlap, keys, "left_anti").withColumn("problem", F.lit("declared without overlap"))
    return hidden.union(stale).select(F.lit("disclosure").alias("gate"), F.concat_ws(" ", F.col("task_id").cast("string"), "url").alias("subject"), "problem")


def run_gates(stages: list[DataFrame]) -> DataFrame:
    """The first stage with a violation, and its first problem.  ``stages`` in order, each with gate, subject, problem."""
    tagged = union([s.withColumn("stage", F.lit(k)) for k, s in enumerate(stages)])
    order = F.struct("stage", "gate", "problem", "subject")
    per = tagged.groupBy("stage", "gate").agg(F.count("*").alias("violations"), F.min(order).alias("first"))
    return per.agg(F.min_by(F.struct("gate", "violations", F.col("first.problem").alias("problem")), "stage").alias("f"), F.sum("violations").alias("total")).select(
        F.col("f.gate").alias("gate"), F.col("f.problem").alias("problem"), F.col("f.violations").alias("violations"), "total"
    )


def run_gates_by_pack(packs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(pack, stage, problem, violations): for each pack the first stage that blocks it, nulls and 0 where none does.

    ``packs``: pack; ``stages``: in order, a name and what finds violations (pack, problem) of the packs that it is given.
    A stage is given only packs that no earlier one blocked, and nothing more is run once none is left.  What a stage
    found is stored, one row a blocked pack, so that it is worked out once.
    """
    clean = every = packs.select("pack").distinct()
    blocked: list[DataFrame] = []
    for name, gate in stages:
        found = gate(clean).groupBy("pack").agg(F.min("problem").alias("problem"), F.count("*").alias("violations")).withColumn("stage", F.lit(name))
        found = stored(found, "gates")
        blocked.append(found)
        clean = clean.join(found.select("pack"), "pack", "left_anti")
        if clean.isEmpty():
            break
    columns = ["stage", "problem", "violations"]
    if not blocked:
        return every.selectExpr("pack", "cast(null as string) stage", "cast(null as string) problem", "0L violations")
    return every.join(union(blocked), "pack", "left").select("pack", *columns[:2], F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))
