"""Personal data: base spans against Python's patterns, the votes' reliabilities against plain arithmetic, and accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from scoreloom.llm import pii as P

from .fixtures import DOCS, documents, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind: str, span: str) -> bool:
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15 if kind == "phone" else True


def base(text: str | None) -> list[tuple]:
    found = [(m.start(), k, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if passes(kind, m.group())]
    return sorted(found)


def card(rng: random.Random, good: bool = True) -> str:
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(c for c in "0123456789" if luhn(digits + c))
    return digits + (last if good else str((int(last) + 3) % 10))


def texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    alphabet = "a1.9@+- (é\n😀0123456789.@-+"
    out: list = [None, "", "a@b.c_d@e.f", "@@a@b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "+1 (459) 555-9246 +12", "4111 1111 1111 1111", "4111-1111-1111-1111-2", "+1" + " " * 50 + "2345678901"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    out += ["😀 " * 30 + f"mail x.{k}@mail{k}.example.com, {card(rng)} {card(rng, False)} from 10.0.{k}.7 or +49 (030) 555-{1000 + k}" for k in range(40)]
    return out


def test_base_spans(spark):
    given = texts(1)
    docs = spark.createDataFrame([(k, t, "en", "s", 0, "x", 1) for k, t in enumerate(given)] + [(None, "a@b.cd", "en", None, 0, "y", 2)], DOCS + ", base string, email int")
    got = {r["doc_id"]: r for r in P.spans(docs, "t").collect()}
    assert len(got) == len(given) + 1
    for k, t in enumerate(given):
        assert [(c["start"], c["kind"], c["end"]) for c in got[k]["base"]] == base(t), t
        assert {tuple(c) for c in got[k]["base"]} <= {tuple(c) for c in got[k]["spans"]}


def test_query(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(900 + k, t, "en", "s", 0) for k, t in enumerate(texts(2)[:80])], DOCS).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((str(i), ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in base(t))) for i, t in rows)
    got = P.op11_personal_data(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((i, hashlib.sha256(b.encode()).hexdigest()) for i, b in want)
    assert sum(r["n_email"] for r in got) == sum(b.count("email") for _, b in want)
    assert all((r["spans"] == "") or re.fullmatch(r"((email|ip|card|phone):\d+:\d+,?)+", r["spans"]) for r in got)


def test_long_texts_are_read_in_linear_time(spark):
    hostile = ["a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "a@" * 300_000, "+1 " * 300_000, "1 2-" * 200_000, "x@y.zz " * 60_000, "+" + "1 " * 500_000]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(hostile)], DOCS)
    got = {r["doc_id"]: r for r in P.spans(docs, "t").select("doc_id", F.size("base").alias("n"), F.element_at("base", -1).alias("last")).filter("n > 0").collect()}
    assert got[6]["n"] == 60_000 and got[6]["last"]["end"] == 7 * 60_000 - 1
    assert set(got) == {2, 6}


def test_reliabilities_equal_plain_arithmetic(spark):
    rng = random.Random(4)
    codes = [sum(rng.choice((0, 1, 2)) * 3**j for j in range(6)) for _ in range(60)]
    counts = {(kind, code): rng.randint(1, 50) for kind in (0, 2) for code in codes[: 40 + kind]}
    rows = [(k, c, n) for (k, c), n in counts.items()]
    found = spark.createDataFrame(rows, "kind int, code int, n int").selectExpr("explode(array_repeat(struct(0 as start, kind, 1 as end, false as base, code, array(1) as features), n)) c")
    of_kind = lambda k: F.filter(F.array("c"), lambda c: c["kind"] == k)
    found = found.select(*[of_kind(k).alias(kind) for k, kind in enumerate(P.KINDS)])
    for r in P.reliabilities(found).collect():
        mine = {c: n for (k, c), n in counts.items() if k == r["kind"]}
        total, prior = sum(mine.values()), [[x for row in p for x in row] for p in (P.PRIOR_TRUE, P.PRIOR_FALSE)]
        ratio, odds = [math.log(a / b) for a, b in zip(*prior, strict=True)], 0.0
        for _ in range(P.ROUNDS):
            q = {c: 1 / (1 + math.exp(-odds - sum(ratio[3 * j + c // 3**j % 3] for j in range(6)))) for c in mine}
            yes, no = sum(n * q[c] for c, n in mine.items()), sum(n * (1 - q[c]) for c, n in mine.items())
            share = lambda k, w, s, p: (sum(w(c) for c in mine if c // 3 ** (k // 3) % 3 == k % 3) + total * p[k]) / (s + total)
            ratio = [math.log(share(k, lambda c: mine[c] * q[c], yes, prior[0])) - math.log(share(k, lambda c: mine[c] * (1 - q[c]), no, prior[1])) for k in range(18)]
            odds = math.log((yes + 1) / (no + 1))
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(r["ratio"], ratio, strict=True)) and math.isclose(r["odds"], odds, abs_tol=1e-9)


def test_added_spans(spark):
    """Looser forms are found, numbers that fail their check are left alone."""
    rng = random.Random(7)
    filler = lambda: " ".join(rng.choice("the river was long and we met near old town hall".split()) for _ in range(12))
    rows, planted, decoys = [], [], []
    for k in range(400):
        say = [
            (f"write to anna.{k} (at) mail.example.com now", f"anna.{k} (at) mail.example.com", True), (f"call (459) 555-{1000 + k} now", f"(459) 555-{1000 + k}", True),
            (f"code {card(rng, False)} here", None, False), (f"mail kim.{k}@example.org now", f"kim.{k}@example.org", True), (f"card {card(rng)} now", None, True),
            (f"version {k}.{k % 9 + 300}.1.2 is out", f"{k}.{k % 9 + 300}.1.2", False), (f"call +1 (459) 555-{1000 + k} now", f"+1 (459) 555-{1000 + k}", True),
        ][k % 7]
        text = f"{filler()} {say[0]} {filler()}"
        rows.append((k, text, "en", "s", 0))
        span = say[1] or re.search("[0-9]{16}", text).group()
        (planted if say[2] else decoys).append((k, text.index(span), text.index(span) + len(span)))
    got = {(r["doc_id"], c["start"], c["end"]) for r in P.spans(spark.createDataFrame(rows, DOCS), "t").collect() for c in r["spans"]}
    assert sum(p in got for p in planted) > 0.98 * len(planted)
    assert sum(d in got for d in decoys) == 0


def test_empty(spark):
    assert P.spans(empty(spark), "t").count() == 0
    assert [r["spans"] for r in P.spans(spark.createDataFrame([(1, "no data", "en", "s", 0)], DOCS), "t").collect()] == [[]]
