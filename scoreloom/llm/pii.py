"""Personal data by weak supervision (operator 11).

Native: DataFrame and SQL functions only.  Four kinds of candidates are found in every whole text: what the patterns of
the contract match (those that pass their check are base spans and always stay), and, between those matches, looser
forms: spelled-out addresses, hexadecimal addresses, cards with other separators, national telephone numbers.  Six
labelers vote on each candidate (for, against, silent): the check, the written form, gazetteers of domain endings, card
issuers, country codes and reserved networks, words of the context that speak for it and against it, and the characters
around it.  Expectation-maximisation over the counts of vote patterns (at most 3^6 a kind) estimates how reliable each
labeler is; its posteriors are the soft labels from which a span classifier is trained: naive Bayes over hashed features
of the span and its context.  Candidates that it scores at THRESHOLD or more are added.

Patterns are written so that a long run of characters is read once: possessive where nothing can be given back, and
starting only where a run starts.  Everything but the small counts stays inside the row of its text; nothing is shuffled
by text or by id.

Defined results: a null or empty text has no spans; repeated rows and rows that share an id get a row each; without
candidates the classifier is empty and nothing is added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: In the order in which the contract lists them.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The patterns of the contract.  A run of local characters, or of digits, can only match from its start or from the end
#: of the match before it.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, looked for between the matches of BASE.  Repeats are bounded, so each start reads a bounded stretch.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[\x20.-]|\([0-9]{3}\)\x20?|0?[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A cheap test that a text may hold the kind at all.
MAY_HOLD = {"email": r"@|[\[({][aA][tT][\])}]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"[0-9]"}

# Gazetteers and words of the context.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|it|nl|be|ch|at|pl|se|no|dk|fi|ru|uk|ie|pt|gr|cz|eu|us|ca|mx|br|ar|cl|jp|cn|in|au|nz|za|kr|tr"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|64[4-9]|65|62|50|5[6-9]|6[0379])"
COUNTRIES = "^(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[23]5[0-9]|42[013]|85[2356]|88[06]|9[679][0-9])"
RESERVED = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
SPEAKS_FOR = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|adresse",
    "ip": r"\bip\b|address|host|server|login|logged|connect|client|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta|zahlung",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp|sms|handy|llama|appel",
}
SPEAKS_AGAINST = r"(?:version|release|section|chapter|isbn|issn|serial|invoice|order no|part no|sku|token|hash|uuid|build|commit|checksum|doi)\W{0,4}$|[=#$/\\_]$"
LEFT, RIGHT = 40, 20

VOTES = ("check", "form", "gazetteer", "speaks for", "speaks against", "surroundings")
AGAINST, SILENT, FOR = range(3)
#: How often a labeler is thought to vote (against, silent, for) on personal data, and on other spans; these weigh as much
#: as all candidates of the kind.
PRIOR_TRUE = ((0.02, 0.18, 0.8), (0.1, 0.2, 0.7), (0.1, 0.3, 0.6), (0.01, 0.69, 0.3), (0.05, 0.9, 0.05), (0.1, 0.2, 0.7))
PRIOR_FALSE = ((0.8, 0.18, 0.02), (0.5, 0.3, 0.2), (0.4, 0.4, 0.2), (0.01, 0.94, 0.05), (0.3, 0.65, 0.05), (0.5, 0.2, 0.3))
ROUNDS = 25
BUCKETS = 4096
THRESHOLD = 0.9
#: A bucket's weight counts as if so many average candidates had it too.
DRAWN = 4.0
BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums up to each element.  In blocks, as adding to an array copies it."""
    grow = lambda start, xs: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def sums(ls: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / BLOCK).cast("int")), lambda b: F.slice(ls, b * BLOCK + 1, F.lit(BLOCK)))
        inside = lambda bs: _let(
            grow(F.lit(0), F.transform(bs, total)), lambda at: F.flatten(F.transform(bs, lambda xs, b: F.slice(grow(F.get(at, b), xs), F.lit(2), F.size(xs))))
        )
        return F.when(F.size(ls) > 0, _let(blocks, inside)).otherwise(F.array().cast("array<int>"))

    return _let(lengths, sums)


def _places(text: Column, pattern: str) -> tuple[Column, Column]:
    """(the texts between the matches, matches as (start, end, span, left, right)) in code points."""
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        gs, found = both["gaps"], both["found"]
        ends = _running(F.transform(found, lambda m, i: F.length(F.get(gs, i)) + F.length(m)))
        return _let(
            ends,
            lambda at: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(at, i) - F.length(m)).alias("start"), F.get(at, i).alias("end"), m.alias("span"),
                    F.right(F.get(gs, i), F.lit(LEFT)).alias("left"), F.left(F.get(gs, i + 1), F.lit(RIGHT)).alias("right"),
                ),
            ),
        )

    return gaps, _let(F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def one(k: Column) -> Column:
        d = F.substr(digits, n - k, F.lit(1)).cast("int") * (1 + k % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + one(k)) % 10 == 0


def _passes(kind: str, span: Column) -> Column:
    """The check of the contract for a match of BASE."""
    digits = _digits(span)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255, 3).otherwise(2)
        return F.forall(F.split(span, r"\."), part)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _vote(for_: Column, against: Column) -> Column:
    return F.when(F.coalesce(against, F.lit(False)), AGAINST).when(F.coalesce(for_, F.lit(False)), FOR).otherwise(SILENT)


def _votes(kind: str, loose: bool, passes: Column, c: Column) -> list[Column]:
    span, left, right, digits = c["span"], F.lower(c["left"]), c["right"], _digits(c["span"])
    if kind == "email":
        check = _vote(F.lit(True), F.lit(False))
        form = _vote(span.rlike("^[A-Za-z][^@]*[A-Za-z0-9][@ \\[({]"), span.rlike(r"\.\.|^[.-]|^.[@ ]"))
        gazetteer = _vote(F.lower(span).rlike(rf"(?:\.|dot[\])}}] ?)(?:{ENDINGS})$"), span.rlike(r"[0-9-]$"))
    elif kind == "ip":
        check = _vote(passes, ~passes)
        form = _vote(~span.rlike(r"(?:^|\.)0[0-9]"), span.rlike(r"(?:^|\.)0[0-9]"))
        gazetteer = _vote(~span.rlike(RESERVED) & span.rlike(r"[1-9]"), span.rlike(RESERVED))
    elif kind == "card":
        check = _vote(passes, ~passes)
        form = _vote(span.rlike("^[0-9]{14,16}$|^[0-9]{4}([ ._/-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$"), ~F.length(digits).between(14, 19))
        gazetteer = _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
    else:
        check = _vote(passes, ~passes)
        form = _vote(span.rlike(r"[0-9][)\x20.-]{1,2}[0-9]+[\x20.-][0-9]{2,}$"), span.rlike(r"[.(-]{3}|\x20\x20"))
        gazetteer = _vote(digits.rlike(COUNTRIES), F.lit(loose) & digits.rlike("^[01]{2}[^1-9]"))
    before, after = F.coalesce(F.right(c["left"], F.lit(1)), F.lit("")), F.coalesce(F.left(right, F.lit(1)), F.lit(""))
    return [
        check, form, gazetteer,
        _vote(left.rlike(SPEAKS_FOR[kind]), F.lit(False)),
        _vote(F.lit(False), left.rlike(SPEAKS_AGAINST)),
        _vote(before.rlike(r"^$|[\s(<\[:,;>|]") & after.rlike(r"^$|[\s)>\],;:.!?|]"), before.rlike(r"[A-Za-z0-9_=#/\\]") | after.rlike(r"[A-Za-z0-9_=#/\\@]")),
    ]


def _features(loose: bool, passes: Column, c: Column) -> Column:
    """Buckets of what the classifier sees of a candidate."""
    span = c["span"]
    shape = F.left(F.regexp_replace(F.regexp_replace(span, "[A-Za-z]+", "a"), "[0-9]+", "9"), F.lit(40))
    side = lambda x: F.coalesce(F.translate(F.regexp_replace(x, "[0-9]", "9"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "a" * 52), F.lit(""))
    word = lambda x, pattern: F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), pattern, 1))
    # What hangs together is one feature: the classifier takes features as independent.
    values = [
        F.concat(F.lit(f"{loose}"), passes.cast("string"), shape, F.least(F.length(span), F.lit(40)).cast("string")),
        F.concat(side(F.right(c["left"], F.lit(1))), F.lit("|"), side(F.left(c["right"], F.lit(1)))),
        word(c["left"], r"(\p{L}{1,20})[^\p{L}]{0,3}$"), word(c["right"], r"^[^\p{L}]{0,3}(\p{L}{1,20})"), F.regexp_extract(span, r"([A-Za-z]{2,12})$", 1),
    ]
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), v.cast("string")), F.lit(BUCKETS)).cast("int") for k, v in enumerate(values)])


def _described(kind: str, loose: bool, offset: Column, c: Column) -> Column:
    """What is kept of a match: its place, whether it is base, its votes, and what the classifier sees."""
    digits = _digits(c["span"])
    if loose:
        passes = {"email": F.lit(True), "ip": F.lit(True), "card": _luhn(digits), "phone": F.length(digits).between(10, 15)}[kind]
    else:
        passes = _passes(kind, c["span"])

    def one(ok: Column) -> Column:
        code = sum((v * 3**j for j, v in enumerate(_votes(kind, loose, ok, c))), F.lit(0))
        return F.struct(
            (c["start"] + offset).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (c["end"] + offset).alias("end"),
            (F.lit(not loose) & ok).alias("base"), code.alias("code"), _features(loose, ok, c).alias("features"),
        )

    return _let(F.coalesce(passes, F.lit(False)), one)


def _of_kind(text: Column, kind: str) -> Column:
    """All candidates of one kind, by start."""
    gaps, whole = _places(text, BASE[kind])
    strict = F.transform(whole, lambda c: _described(kind, False, F.lit(0), c))

    def between(gs: Column) -> Column:
        """Candidates of the looser form inside the texts between matches, each moved to its place."""
        offsets = F.concat(F.array(F.lit(0)), F.transform(whole, lambda m: m["end"]))
        inner = lambda at: F.transform(gs, lambda g, i: F.transform(_places(g, LOOSE[kind])[1], lambda c: _described(kind, True, F.get(at, i), c)))
        return F.flatten(_let(offsets, inner))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,code:int,features:array<int>>>")
    wider = F.when(text.rlike(LOOSE[kind]), _let(gaps, between)).otherwise(none)
    return F.when(text.rlike(MAY_HOLD[kind]), F.sort_array(F.concat(strict, wider))).otherwise(none)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and, per kind, ``<kind>``: array of (start, end, base, code, features) by start.  ``code``: votes, base 3."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, *[_of_kind(text, kind).alias(kind) for kind in KINDS])


def _all(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.concat(*KINDS)).alias("c")).select("c.kind", "c.code", "c.features")


def reliabilities(found: DataFrame) -> DataFrame:
    """Per kind: ``patterns`` (code, n), ``ratio`` (log-likelihood ratio of each labeler's three votes) and ``odds``.

    A fold over the rounds inside one row per kind, of at most 3^6 patterns.
    """
    counts = _all(found).groupBy("kind", "code").agg(F.count("*").alias("n"))
    one = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("code", F.col("n").cast("double").alias("n")))).alias("patterns"), F.sum("n").cast("double").alias("total"))
    n_votes = 3 * len(VOTES)
    true, false = (F.array(*[F.lit(x) for row in prior for x in row]) for prior in (PRIOR_TRUE, PRIOR_FALSE))
    first = F.array(*[F.lit(math.log(t / f)) for a, b in zip(PRIOR_TRUE, PRIOR_FALSE, strict=True) for t, f in zip(a, b, strict=True)])
    powers = F.array(*[F.lit(3**j) for j in range(len(VOTES))])
    vote = lambda code, j: F.floor(code / F.get(powers, j)).cast("int") % 3

    def improved(acc: Column) -> Column:
        belief = F.transform("patterns", lambda p: p["n"] * posterior(p["code"], acc["ratio"], acc["odds"]))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

        def fitted(yes: Column) -> Column:
            no = F.zip_with("patterns", yes, lambda p, y: p["n"] - y)

            def share(weights: Column, sum_: Column, prior: Column, k: Column) -> Column:
                hit = F.zip_with("patterns", weights, lambda p, w: F.when(vote(p["code"], F.floor(k / 3).cast("int")) == k % 3, w).otherwise(0.0))
                return (total(hit) + F.col("total") * F.get(prior, k)) / (sum_ + F.col("total"))

            return _let(
                F.struct(total(yes).alias("yes"), total(no).alias("no")),
                lambda s: F.struct(
                    F.transform(F.sequence(F.lit(0), F.lit(n_votes - 1)), lambda k: F.log(share(yes, s["yes"], true, k)) - F.log(share(no, s["no"], false, k))).alias("ratio"),
                    F.log((s["yes"] + 1) / (s["no"] + 1)).alias("odds"),
                ),
            )

        return _let(belief, fitted)

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(first.alias("ratio"), F.lit(0.0).alias("odds")), lambda acc, _: improved(acc))
    return one.select("kind", "patterns", fit.alias("fit")).select("kind", "patterns", "fit.ratio", "fit.odds")


def posterior(code: Column, ratio: Column, odds: Column) -> Column:
    """Chance that a span is personal data, from its votes."""
    evidence = sum((F.get(ratio, 3 * j + F.floor(code / 3**j).cast("int") % 3) for j in range(len(VOTES))), odds)
    return 1 / (1 + F.exp(-evidence))


def classifier(found: DataFrame) -> DataFrame:
    """Per kind: ``bias`` and ``weights`` (log-odds of each bucket), trained on the posteriors of all candidates."""
    soft = reliabilities(found).select("kind", F.explode("patterns.code").alias("code"), "ratio", "odds")
    soft = soft.select("kind", "code", posterior(F.col("code"), F.col("ratio"), F.col("odds")).alias("q"))
    # At most 4 * 3^6 rows: a proven bound.
    marked = _all(found).groupBy("kind", "code", "features").agg(F.count("*").alias("n")).join(F.broadcast(soft), ["kind", "code"])
    yes, no = F.sum(F.col("n") * F.round("q", 9)), F.sum(F.col("n") * (1 - F.round("q", 9)))
    sums = marked.select("kind", "n", "q", F.explode(F.array_append(F.array_distinct("features"), F.lit(-1))).alias("bucket")).groupBy("kind", "bucket").agg(yes.alias("yes"), no.alias("no"))
    whole = sums.filter("bucket < 0").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    # A bucket that few candidates have is drawn to the share of all, so its weight to 0.
    share = (F.col("all_yes") + 0.5) / (F.col("all_yes") + F.col("all_no") + 1)
    odds = F.log(share / (1 - share))
    weight = F.log((F.col("yes") + DRAWN * share) / (F.col("no") + DRAWN * (1 - share))) - odds
    parts = sums.filter("bucket >= 0").join(F.broadcast(whole), "kind")
    each = parts.groupBy("kind", odds.alias("bias")).agg(F.map_from_entries(F.collect_list(F.struct("bucket", weight.alias("w")))).alias("w"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("w", b), F.lit(0.0)))
    return each.select("kind", "bias", dense.alias("weights"))


def spans(docs: DataFrame, owner: str = "pii", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``base`` and ``spans``: arrays of (start, kind, end, score) by start, then kind.  ``base`` is part of ``spans``."""
    found = scratch.written(candidates(docs, keep), owner)
    model = scratch.written(classifier(found), owner)
    # One row: per kind a bias and BUCKETS weights.
    one = model.agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("bias", "weights")))).alias("_model"))

    def scored(c: Column) -> Column:
        m = F.try_element_at("_model", c["kind"])
        evidence = F.aggregate(F.array_distinct(c["features"]), m["bias"], lambda acc, b: acc + F.get(m["weights"], b))
        return F.struct(c["start"], c["kind"], c["end"], F.coalesce(1 / (1 + F.exp(-evidence)), F.lit(0.0)).alias("score"), c["base"])

    every = F.sort_array(F.transform(F.concat(*KINDS), scored))
    rows = found.join(F.broadcast(one)).select(*keep, every.alias("_all"))
    plain = lambda c: F.struct(c["start"], c["kind"], c["end"], c["score"])
    return rows.select(
        *keep,
        F.transform(F.filter("_all", lambda c: c["base"]), plain).alias("base"),
        F.transform(F.filter("_all", lambda c: c["base"] | (c["score"] >= THRESHOLD)), plain).alias("spans"),
    )


def joined(found: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    found = spans(scratch.table(spark, sf_dir, "documents"), "op11")
    of_kind = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
