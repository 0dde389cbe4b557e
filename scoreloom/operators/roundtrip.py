"""Answer keys scored against themselves, for every cohort that has a contract: directly, and by way of an answer's text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal as N
from ..sources import answers as B
from ..sources.staging import stored
from . import matching as M

DIRECT, PARSED = "direct", "parsed"


@dataclass(frozen=True)
class Cohort:
    """What a cohort supplies: how a key is an answer, how that is written and read, how it is scored, what is wrong with
    a key (blocking) and what is worth a note."""

    dimensions: tuple[str, ...]
    #: Column of the answer: what it is in a row of the key.
    answer: dict[str, Column]
    render: Callable[[], Column]
    decode: Callable[[DataFrame], DataFrame]
    score: Callable[[DataFrame], DataFrame]
    problems: dict[str, Column] = field(default_factory=dict)
    notes: dict[str, Column] = field(default_factory=dict)


def _api_scores(rows: DataFrame) -> DataFrame:
    """task_id and the six dimensions.  A row holds one task; endpoints are matched as rows."""
    key = rows.select("task_id", F.posexplode("gt_endpoints").alias("pos", "e")).select("task_id", "pos", "e.method", "e.path", "e.api_version")
    got = rows.select("task_id", F.posexplode("endpoints").alias("pos", "e")).select("task_id", "pos", "e.method", "e.path", "e.api_version")
    points = M.endpoint_scores(M.match_endpoints(key, got, ["task_id"]), ["task_id"])
    rest = rows.select(
        "task_id", M.auth_score(F.col("gt_auth_flow"), F.col("auth_flow")).alias("auth_flow"), M.scopes_score(F.col("gt_scopes"), F.col("required_scopes")).alias("required_scopes"),
        M.params_score(F.col("gt_parameters"), F.col("key_parameters")).alias("key_parameters"),
    )
    return rest.join(points, "task_id", "left").select("task_id", *M.API_DIMENSIONS)


def _docs_scores(rows: DataFrame) -> DataFrame:
    return M.docs_scores(rows).select("task_id", *M.DOCS_DIMENSIONS)


def _docs_decoded(rows: DataFrame) -> DataFrame:
    out = B.decode_docs_answers(rows)
    names = {"catalog_numbers": "answer_catalogs", "firmware_version": "answer_firmware", "software_version": "answer_software", "publication": "answer_publication", "observations": "answer_observations"}
    return out.withColumnsRenamed(names)


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _parameters() -> Column:
    return F.coalesce("gt_parameters", F.array().cast("array<struct<name:string,required:boolean>>"))


def cohorts() -> dict[str, Cohort]:
    """The registered cohorts.  Keys of ``api``: task_id, gt_endpoints, gt_auth_flow, gt_scopes, gt_parameters; of
    ``docs``: task_id, gt_catalogs, gt_firmware, gt_software, gt_publication, gt_observations."""
    named = F.filter(F.transform(_parameters(), lambda p: p["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    has_value = (F.size(F.coalesce("gt_catalogs", F.array().cast("array<string>"))) > 0) | _said("gt_firmware") | _said("gt_software")
    return {
        "api": Cohort(
            M.API_DIMENSIONS,
            {"endpoints": F.col("gt_endpoints"), "auth_flow": F.col("gt_auth_flow"), "required_scopes": F.col("gt_scopes"), "key_parameters": named},
            lambda: B.render_answers(F.col("endpoints"), F.col("auth_flow"), F.col("required_scopes"), F.col("key_parameters")),
            B.decode_answers, _api_scores,
            {"names no known style": N.canonical_auth_flow(F.col("gt_auth_flow")) == N.UNKNOWN_AUTH},
            {"no parameter is required, so none is scored": (F.size(_parameters()) > 0) & ~F.exists(_parameters(), lambda p: F.coalesce(p["required"], F.lit(False)))},
        ),
        "docs": Cohort(
            M.DOCS_DIMENSIONS,
            {f"answer_{c}": F.col(f"gt_{c}") for c in ("catalogs", "firmware", "software", "publication", "observations")},
            lambda: B.render_docs_answers(F.col("answer_catalogs"), F.col("answer_firmware"), F.col("answer_software"), F.col("answer_publication"), F.col("answer_observations")),
            _docs_decoded, _docs_scores,
            {"declares neither a catalog number nor a version": ~has_value},
            {"declares one version without its partner": _said("gt_firmware") != _said("gt_software")},
        ),
    }


def both_ways(keys: DataFrame, cohort: Cohort) -> tuple[DataFrame, DataFrame]:
    """(task_id, via, dim, score) of keys against themselves, and (task_id, reason) of keys whose text cannot be read.

    Reading a text costs far more than a row's size says, so texts are dealt over a fixed number of tasks, which adaptive
    execution does not make few, and what was read is stored: scores and reasons start from there.
    """
    direct = keys.withColumns(cohort.answer)
    text = direct.withColumn("raw_response", cohort.render()).drop(*cohort.answer)
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = stored(cohort.decode(text.repartition(tasks)).drop("raw_response", "block_text", "repaired_block_text"), "parsed")
    unread = parsed.filter("format_failure").select("task_id", F.col("failure_reason").alias("reason"))
    ways = ((DIRECT, direct), (PARSED, parsed.filter("not format_failure")))
    parts = [M.long_scores(cohort.score(rows), ["task_id"], cohort.dimensions).select("task_id", F.lit(via).alias("via"), "dim", "score") for via, rows in ways]
    return parts[0].unionByName(parts[1]), unread


def roundtrip_contracts(keys: dict[str, DataFrame], registry: dict[str, Cohort] | None = None) -> DataFrame:
    """(gate, cohort, subject, problem, blocks): keys that do not survive their own contract, and notes (not blocking).

    ``keys``: by cohort; one without a contract is an error.  One row of ``keys`` is one task.
    """
    registry = cohorts() if registry is None else registry
    found = []
    for name, rows in keys.items():
        if name not in registry:
            raise ValueError(f"no contract for cohort {name!r}; known: {', '.join(sorted(registry))}")
        cohort = registry[name]
        scores, unread = both_ways(rows, cohort)
        # A few rows a task, read three times below: scored once.
        scores = stored(scores, "roundtrip")
        low = scores.filter("score < 1").select("task_id", F.concat("via", F.lit(": "), "dim", F.lit(" scores below 1")).alias("problem"))
        lost = unread.select("task_id", F.concat(F.lit(f"{PARSED}: "), "reason").alias("problem"))
        none = scores.filter(F.col("via") == DIRECT).groupBy("task_id").agg(F.count("score").alias("n")).filter("n = 0").select("task_id", F.lit("every dimension is n/a").alias("problem"))
        said = lambda rules: F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), p) for p, c in rules.items()]).cast("array<string>"))).alias("problem")
        blocking = [low, lost, none, rows.select("task_id", said(cohort.problems))]
        parts = [(p, True) for p in blocking] + [(rows.select("task_id", said(cohort.notes)), False)]
        found += [p.select(F.lit("roundtrip").alias("gate"), F.lit(name).alias("cohort"), F.col("task_id").cast("string").alias("subject"), "problem", F.lit(b).alias("blocks")) for p, b in parts]
    return reduce(DataFrame.unionByName, found)
