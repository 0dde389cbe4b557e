"""Quality rules with thresholds learned per language and source (operator 10).

Native: DataFrame and SQL functions only.  Every document gets exact in-row measures; quantile sketches of the
measures (histograms over bins of one relative width) are built per (language, source), merged per language and over
everything, and give the fences that replace fixed cutoffs: the same fences in every run.  Quartiles of small groups are drawn to those of their language, and these to the corpus's,
by n / (n + 200), so that no size flips a rule.  The small fence table is joined back and filters the documents.

Defined results: a null text is an empty one; null ``lang`` or ``source`` form a group of their own; ties and
repeated rows are measured alike; an empty table gives an empty result; other input columns are kept when their
names do not clash with the measures (``measure`` selects, it does not add).
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Words are runs of other characters than these.
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A group's quartiles are drawn to its language's, and these to the whole corpus's, as if so many documents stood there.
PRIOR_DOCUMENTS = 200
#: Fences stand this many interquartile ranges beyond the upper quartile.
SPREAD = 3.0
#: Relative width of a bin of the quantile sketch, and the least value that it tells from 0.
BIN_STEP, LEAST = 0.01, 1e-6
#: Ratios: measure name, its numerator, its denominator, and the least interquartile range taken (so that a group
#: whose quartiles coincide does not reject every document that differs from them by one character).
RATIOS = (
    ("symbol_ratio", "n_symbols", "word_chars", 0.02),
    ("dup_line_ratio", "n_dup_lines", "n_lines", 0.15),
    ("repeat_ratio", "n_repeat_words", "n_words", 0.12),
    ("word_length", "word_chars", "n_words", 1.0),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _windows(words: Column) -> Column:
    """The 3-word windows as (64-bit hash, start), sorted; null where no window can repeat."""
    return F.when(
        F.size(words) >= 4,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
                ),
            )
        ),
    )


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    No shuffle: every measure is an expression over the row.  n log n in the length of a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(*keep, text.alias("_text"), _words(text).alias("_words"))
    two = one.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        _windows(F.col("_words")).alias("_win"),
    )
    three = two.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.transform(
                F.filter(
                    F.col("_win"),
                    lambda e, k: (e["h"] == F.get(F.col("_win"), k + 1)["h"])
                    | ((k > 0) & (e["h"] == F.get(F.col("_win"), k - 1)["h"])),
                ),
                lambda e: e["i"],
            )
        ).alias("_at"),
    )
    # A repeated window at position p covers 3 words, less those that the next repeated window covers again.
    covered = F.aggregate(
        F.coalesce(F.col("_at"), F.array().cast("array<int>")),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    four = three.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return four.withColumn("base_failed", failed)


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def _bin(value: Column) -> Column:
    """Bin of a value that is not negative: 0 for none, else by its logarithm, BIN_STEP relative width a bin."""
    return F.when(value < LEAST, 0).otherwise(1 + F.floor(F.log(value / LEAST) / math.log1p(BIN_STEP))).cast("int")


def _value(bin_: Column) -> Column:
    """The middle of a bin: off by half of BIN_STEP at most."""
    return F.when(bin_ == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(1 + BIN_STEP), bin_ - 0.5))


def _quartiles(bins: DataFrame, level: str, keys: list[str]) -> DataFrame:
    """``keys`` and a struct ``level``: n and both quartiles of every ratio, read off summed bins."""
    merged = bins.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "ratio").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto))
    totals = merged.groupBy(*keys, "ratio").agg(F.sum("n").alias("total"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "ratio"]]
    both = ranked.alias("r").join(totals.alias("t"), reduce(and_, same)).select(*[F.col(f"r.{k}").alias(k) for k in [*keys, "ratio"]], "bin", "upto", "total")
    first = lambda k, q: F.min(F.when((F.col("ratio") == k) & (F.col("upto") >= q * F.col("total")), F.col("bin")))
    read = [_value(first(k, q)).alias(f"{name}_q{int(100 * q)}") for k, (name, *_) in enumerate(RATIOS) for q in (0.25, 0.75)]
    return both.groupBy(*keys).agg(F.struct(F.max("total").alias("n"), *read).alias(level))


def fences(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): an upper fence per ratio and a lower one for word length.

    The sketch of a group is its histogram over bins of fixed relative width: it merges by adding, comes out the same
    however the rows are dealt, and a hot source moves one row per bin and task.
    """
    passing = measured.filter(~F.col("base_failed"))
    ratio = F.array(*[F.struct(F.lit(k).alias("ratio"), _bin(_ratio(top, bottom)).alias("bin")) for k, (_, top, bottom, _) in enumerate(RATIOS)])
    bins = passing.select("lang", "source", F.inline(ratio)).groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n"))
    g, la, w = _quartiles(bins, "g", ["lang", "source"]), _quartiles(bins, "la", ["lang"]), _quartiles(bins, "w", [])
    la = la.withColumnRenamed("lang", "_lang")
    both = g.join(la, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").crossJoin(F.broadcast(w))

    def drawn(quartile: str) -> Column:
        out = F.col(f"w.{quartile}")
        for level in ("la", "g"):
            n = F.col(f"{level}.n")
            out = (n * F.col(f"{level}.{quartile}") + PRIOR_DOCUMENTS * out) / (n + PRIOR_DOCUMENTS)
        return out

    limits = []
    for name, _, _, least in RATIOS:
        low, high = drawn(f"{name}_q25"), drawn(f"{name}_q75")
        reach = SPREAD * F.greatest(high - low, F.lit(least))
        limits.append((high + reach).alias(f"{name}_max"))
        if name == "word_length":
            limits.append((low - reach).alias(f"{name}_min"))
    return both.select("lang", "source", *limits)


def apply_fences(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``.  The fence table has one row per (lang, source) and joins by plain equality."""
    right = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *limits.columns[2:])
    joined = measured.join(
        right, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    inside = F.lit(True)
    for name, top, bottom, _ in RATIOS:
        inside = inside & F.coalesce(_ratio(top, bottom) <= F.col(f"{name}_max"), F.lit(True))
    inside = inside & F.coalesce(_ratio("word_chars", "n_words") >= F.col("word_length_min"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source", *limits.columns[2:])


def judged(docs: DataFrame, owner: str = "quality", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Measures and verdict of every document.  The measures are written once: both passes over them are cheap."""
    measured = scratch.written(measure(docs, keep), owner)
    return apply_fences(measured, scratch.written(fences(measured), owner))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    return judged(docs, "op10").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

