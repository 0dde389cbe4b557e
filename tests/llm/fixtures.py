"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, ties, extra and clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + rng.choice(["", "s", "ed"]) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.replace("alpha", "alpha", 1).rsplit(" ", 1)[0] + " changed"
    shared = words(rng, 15)
    texts = [
        base, base, near, words(rng, 80) + " " + shared, words(rng, 90) + "\n" + shared + "\n" + words(rng, 70), None, "", "one", "one", " \t\n ", "two words",
        "été " * 60, "x" * 400, "x" * 400, words(rng, 3000), "a b c " * 60, "under the MIT License. SPDX-License-Identifier: MIT OR Apache-2.0\nrest " + words(rng, 60),
        *[words(rng, rng.randint(1, 150)) for _ in range(40)],
    ]
    out = [(k, t, ["en", "de", None][k % 3], [f"s{k % 4}", None][k % 9 == 8], len(t) if t is not None else None) for k, t in enumerate(texts)]
    return [*out, out[3], (None, base, "en", "s0", 1), (None, None, None, None, None)]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
