"""Matching answers to keys and scoring them (one row per run and key endpoint, then per run and dimension)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N

API_DIMENSIONS = ("endpoint", "method", "api_version", "auth_flow", "required_scopes", "key_parameters")
DOCS_DIMENSIONS = ("catalog_number", "firmware_version", "software_version")


def with_rank(endpoints: DataFrame, keys: list[str], prefixes: Iterable[Iterable[str]] = ()) -> DataFrame:
    """``endpoints`` (keys, pos, method, path, api_version) with npath, its base prefix off, and rn among equal ones."""
    npath = F.array_join(N.strip_base_prefix(N.normalize_path(F.col("path")), prefixes), "/")
    order = Window.partitionBy(*keys, "npath").orderBy("pos")
    return endpoints.withColumn("npath", npath).withColumn("rn", F.row_number().over(order))


def match_endpoints(key: DataFrame, answers: DataFrame, by: list[str], prefixes: Iterable[Iterable[str]] = (), alternates: Column | None = None) -> DataFrame:
    """Each key endpoint with the answer that it takes: the k-th of equal paths takes the k-th.

    Taking the first unused answer in key order pairs equal paths by their rank, so one equality join on
    (by, path, rank) does what the greedy loop does.  ``alternates``: array column of accepted versions on ``key``.
    """
    left = with_rank(key, by, prefixes).withColumn("_alt", alternates if alternates is not None else F.array().cast("array<string>"))
    right = with_rank(answers, by, prefixes).select(
        *by, "npath", "rn", F.col("method").alias("answer_method"), F.array_join(N.normalize_path(F.col("path")), "/").alias("answer_path"),
        F.col("api_version").alias("answer_api_version"), F.lit(True).alias("_found"),
    )
    joined = left.join(right, [*by, "npath", "rn"], "left")
    matched = F.coalesce(F.col("_found"), F.lit(False))
    want, got = N.normalize_version(F.col("api_version")), N.normalize_version(F.col("answer_api_version"))
    accepted = F.array_contains(F.transform("_alt", N.normalize_version), got)
    return joined.select(
        *by, "pos", F.col("method").alias("gt_method"), F.col("npath").alias("gt_path"), F.col("api_version").alias("gt_api_version"),
        matched.alias("matched"),
        (matched & (N.normalize_method(F.col("method")) == N.normalize_method(F.col("answer_method")))).alias("method_ok"),
        (matched & ((want == got) | accepted)).alias("version_ok"),
        (matched & (want != got) & accepted).alias("version_via_alternate"),
        "answer_method", "answer_path", "answer_api_version",
    )


def endpoint_scores(matches: DataFrame, by: list[str]) -> DataFrame:
    """endpoint, method and api_version: matched, method_ok and version_ok over the key's endpoints."""
    share = [F.avg(F.col(c).cast("double")).alias(a) for c, a in (("matched", "endpoint"), ("method_ok", "method"), ("version_ok", "api_version"))]
    return matches.groupBy(*by).agg(*share)


def auth_score(key: Column, answer: Column, alternates: Column | None = None, excused: Column | None = None) -> Column:
    """1 or 0; null where the key gives a written reason that its style cannot be checked."""
    required, named = N.canonical_auth_flow(key), N.auth_concepts(answer)
    accepted = F.array(required) if alternates is None else F.array_union(F.array(required), F.coalesce(alternates, F.array().cast("array<string>")))
    hit = F.when(required == N.UNKNOWN_AUTH, F.size(named) == 0).otherwise(F.arrays_overlap(accepted, named))
    score = hit.cast("double")
    if excused is None:
        return score
    reason = N.strip(excused)
    blank = F.raise_error(F.lit("a dimension that is not scored must give a reason"))
    return F.when(excused.isNotNull() & (reason == ""), blank.cast("double")).when(excused.isNotNull(), F.lit(None).cast("double")).otherwise(score)


def any_of_score(key: Column, answer: Column, normal) -> Column:
    """1 if any wanted value is among the answer's, 0 if not, null if the key wants none."""
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normal), lambda s: s != "")
    return F.when(F.size(clean(key)) > 0, F.arrays_overlap(clean(key), clean(answer)).cast("double"))


def scopes_score(key: Column, answer: Column) -> Column:
    return any_of_score(key, answer, N.bare_scope)


def params_score(key: Column, answer: Column) -> Column:
    """``key``: array of struct(name, required); 1 if the answer names every required one, null if there is none."""
    wanted = F.filter(key, lambda p: F.coalesce(p["required"], F.lit(False)) & (F.coalesce(p["name"], F.lit("")) != ""))
    have = F.coalesce(answer, F.array().cast("array<string>"))
    return F.when(F.size(wanted) > 0, F.forall(wanted, lambda p: N.names_parameter(p["name"], have)).cast("double"))


def version_score(key: Column, answer: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) != "", N.version_satisfies(key, answer).cast("double"))


def docs_scores(rows: DataFrame) -> DataFrame:
    """Adds catalog_number, firmware_version, software_version and exhibit.

    ``rows``: gt_catalogs, gt_firmware, gt_software, gt_observations, answer_catalogs, answer_firmware,
    answer_software, answer_publication, answer_observations (the observations are maps of text).  The exhibit is
    recorded and never scored; what the key expects to be observed is null where it says nothing on any of it.
    """
    scored = rows.withColumns(
        {
            "catalog_number": any_of_score(F.col("gt_catalogs"), F.col("answer_catalogs"), N.normalize_catalog),
            "firmware_version": version_score(F.col("gt_firmware"), F.col("answer_firmware")),
            "software_version": version_score(F.col("gt_software"), F.col("answer_software")),
        }
    )
    both = F.col("firmware_version").isNotNull() & F.col("software_version").isNotNull()
    observed = F.col("answer_observations")
    known = lambda name: F.nullif(F.element_at("gt_observations", name), F.lit(""))
    expected = F.transform_values(observed, lambda name, _: known(name))
    stated = F.exists(F.map_values(expected), lambda v: v.isNotNull())
    return scored.withColumn(
        "exhibit",
        F.struct(
            F.col("answer_publication").alias("publication"),
            F.coalesce("answer_catalogs", F.array().cast("array<string>")).alias("catalogs"),
            F.when(both, (F.col("firmware_version") == 1) & (F.col("software_version") == 1)).alias("pairing_ok"),
            N.hedge_count(F.col("answer_firmware")).alias("firmware_hedges"),
            N.hedge_count(F.col("answer_software")).alias("software_hedges"),
            F.when(F.size(observed) > 0, observed).alias("observed"),
            F.when(stated, expected).alias("observed_expected"),
        ),
    )


def long_scores(rows: DataFrame, keys: list[str], dimensions: Iterable[str]) -> DataFrame:
    """(keys, dim, score): one row per run and dimension, null where it does not apply."""
    dims = list(dimensions)
    return rows.unpivot(keys, dims, "dim", "score")


@dataclass
class Contract:
    """What a cohort scores: its dimensions, and what computes each from a row of run and key columns."""

    cohort: str
    dimensions: tuple[str, ...]
    columns: dict[str, Column] = field(default_factory=dict)


def contract_of(cohort: str, contracts: dict[str, Contract]) -> Contract:
    """The registered contract of a cohort; an unknown cohort is an error."""
    if cohort not in contracts:
        raise ValueError(f"no contract for cohort {cohort!r}; known: {', '.join(sorted(contracts))}")
    return contracts[cohort]


def score_cohorts(runs: DataFrame, tasks: DataFrame, contracts: dict[str, Contract], by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Long scores (all columns of ``by``, run_index, cohort, dim, score) of runs of several cohorts; a run of an
    unknown cohort fails the job."""
    known = F.col("cohort").isin(*contracts)
    checked = runs.withColumn("cohort", F.when(known, F.col("cohort")).otherwise(F.raise_error(F.concat(F.lit("no contract for cohort "), F.coalesce("cohort", F.lit("null"))))))
    parts = [long_scores(score_runs(checked.filter(F.col("cohort") == c), tasks, k, by), [*by, "run_index", "cohort"], k.dimensions) for c, k in contracts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_runs(runs: DataFrame, tasks: DataFrame, contract: Contract, by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """``runs`` with one column per dimension; a format failure or an unknown task has none (null).

    ``tasks`` is joined by key; Spark broadcasts it where its size allows.
    """
    known = tasks.withColumn("_known", F.lit(True))
    joined = runs.join(known, list(by), "left")
    valid = ~F.coalesce(F.col("format_failure"), F.lit(False)) & F.coalesce(F.col("_known"), F.lit(False))
    return joined.withColumns({d: F.when(valid, contract.columns[d]) for d in contract.dimensions}).drop("_known")


def rescored(runs: DataFrame, tasks: DataFrame, contract: Contract, decode: Callable[[DataFrame], DataFrame], derived: Iterable[str], by: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Every derived field anew from raw_response: blocks are decoded and scored again, stale fields go (a failed run
    has no scores), and ``n`` is the largest run_index of the task plus 1.  Runs of an unknown task and all other
    columns stay as they are.

    ``decode`` adds what the contract's columns read, and ``derived`` names the fields to replace; the contract's
    dimensions are among them.
    """
    derived = list(derived)
    known = tasks.select(*by).distinct().withColumn("_known", F.lit(True))
    kept = runs.drop(*derived, *contract.dimensions)
    fresh = score_runs(decode(kept), tasks, contract, by).join(known, list(by), "left_semi")
    old = runs.join(known, list(by), "left_anti")
    columns = [*kept.columns, *dict.fromkeys([*derived, *contract.dimensions])]
    both = fresh.select(*columns).unionByName(old.select(*[c for c in columns if c in old.columns]), allowMissingColumns=True)
    largest = runs.groupBy(*by).agg((F.max("run_index") + 1).alias("n"))
    return both.join(largest, list(by), "left")


def rescore(runs: DataFrame, scored: DataFrame, keys: list[str], derived: Iterable[str]) -> DataFrame:
    """``runs`` with its derived columns taken anew from ``scored``; runs that have no row there stay as they are."""
    new = scored.select(*keys, *[F.col(c).alias(f"_{c}") for c in derived], F.lit(True).alias("_new"))
    joined = runs.join(new, keys, "left")
    fresh = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in derived}
    return joined.withColumns(fresh).select(*runs.columns)
