"""Each operator against a brute-force version, and on nulls, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from scoreloom.llm import ann, bpe, html, licenses, mixing, neardup, quality, repeats, sharding, textnum, toxicity

from . import fixtures
from .fixtures import documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_near_duplicates(spark):
    found = neardup.classes(documents(spark)).collect()
    assert len(found) == len(rows())
    cls = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    data = [(i, t or "") for i, t, *_ in rows() if i is not None]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := WORD.findall(t.lower())) else set() for i, t in data}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                assert similar < 0.85 or cls[i] == cls[j], (i, j, similar)
                assert similar >= 0.75 or cls[i] != cls[j] or any(cls[k] == cls[i] for k in sets if k not in (i, j)), (i, j)
    assert cls[5] == 5 and cls[6] == 6 and cls[0] == cls[1] == cls[2] == 0 and cls[7] == cls[8] == 7
    kept = neardup.deduplicated(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {0, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()} and not {1, 2, 8} & {r["doc_id"] for r in kept.collect()}


def test_large_group_of_near_copies(spark):
    """Many copies of one text, each with a word changed: one class, and lone texts stay alone."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(120):
        t = list(base)
        t[rng.randrange(150)] = f"own{k}"
        texts.append(" ".join(t))
    far = [" ".join(rng.choice([w, f"f{k}"]) for w in base) for k in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + far)], "doc_id long, text string")
    cls = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert {cls[k] for k in range(120)} == {0} and all(cls[k] == k for k in range(120, 160))


def test_sampling_agrees_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    a, b = rng.uniform(1, 2, 300).astype(np.float32), rng.uniform(1, 2, 300).astype(np.float32)
    a[200:] = 0
    b[:60] = 0
    first = np.zeros(1, np.int64)
    neardup_keys = neardup._KEYS
    agree, n = 0, 0
    try:
        for seed in range(20):
            neardup._KEYS = np.random.default_rng(seed).integers(1, 1 << 63, (36, 2), dtype=np.uint64)
            for k in range(36):
                agree += neardup.samples(h[a > 0], first, a[a > 0], k)[0] == neardup.samples(h[b > 0], first, b[b > 0], k)[0]
                n += 1
    finally:
        neardup._KEYS = neardup_keys
    assert agree / n == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.06)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(7)
    parts = ["a", "É", "Σ", "ς", "İ", "ß", "'s", " ", "\n", "1", "½", "日本", "😀", "<|endoftext|>", "<|", "é", "ﬁ", "!!", "the", "ing", "\x00", "가"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + [t for _, t, *_ in rows()] + ["e" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("token_ids_", F.lit(1))
    image = bpe.lexicon(df)
    got = {r["doc_id"]: r for r in bpe.digests(df, image).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(df, image), image).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back[:50]] == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts[:50]]
    assert bpe.digests(empty(spark), bpe.lexicon(empty(spark))).count() == 0


def test_lexicon_is_minimal_and_exact():
    rules = bpe.Rules(bpe.default_vocabulary())
    words = ["walking", "talking", "talk", "walk", "été", "a", "wa"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words, rules))
    assert [lexicon.ids(w) for w in words] == [rules.merged(w) for w in words] == rules.merged_many(words)
    assert lexicon.ids("walkin") is None and lexicon.ids("zzz") is None and lexicon.ids("walkings") is None
    tail = bpe.Lexicon(bpe.compile_lexicon(["walking", "talking"], rules))
    assert len(tail.final) == 8  # the shared "alking" once
    assert bpe.Lexicon(bpe.compile_lexicon([], rules)).ids("a") is None


def test_mixing(spark):
    import duckdb

    df = documents(spark)
    got = mixing.mixed(df).collect()
    documents_table = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(documents_table.astype({"doc_id": "Int64", "n_chars": "Int64"}), preserve_index=False))
    want = con.execute(mixing.OP3_SQL).fetchall()
    key = lambda r: tuple((x is None, round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got])) == sorted(map(key, want))
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in got)
    counts = Counter((r["doc_id"], r["text"]) for r in mixing.repeated(df).collect())
    assert all(counts[r["doc_id"], t] in (r["copies"], 2 * r["copies"]) for r in got for i, t, *_ in rows() if i == r["doc_id"] and i is not None)
    assert mixing.mixed(empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><header>Site</header><nav><ul><li><a href=/>a</a></ul></nav>
<div class="cookie-notice">We use cookies for the and of</div><article><h1>Title &amp; more</h1><p>First&nbsp;para with   space<br>and more.<p><b>Second <i>x</i></b><div class=ad>Buy</div>
<p>tiny<script>var t="</p>";</script><form>f</form><section class="comments"><p>I think the and of to</p></section></article><aside>Side</aside><footer>F</footer></body>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Title & more\nFirst para with space and more.\nSecond x\ntiny"
    plain = "<div><p>" + "the cat and the dog of the house is in a garden " * 8 + "</p><p>Short one.</p><p>" + "and it was on the way to a town of that name " * 8 + "</p></div><div><a href=x>Home</a> <a href=y>About</a></div>"
    assert html.main_text(plain).count("\n") == 2 and "Home" not in html.main_text(plain)
    assert html.main_text("") == "" and html.main_text("<p") == "" and html.main_text("<article><p>a<p>b &lt;c&gt;") == "a\nb <c>"
    df = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    assert [r["n_chars"] for r in html.extracted(df).orderBy("page_id").collect()] == [58, 58, 0]
    assert html.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<b>" * 150_000 + "</i>" * 150_000, "<i>" * 150_000 + "<div>" * 100_000 + "</i>" * 150_000, "<svg>" * 200_000, "</nav>x" * 150_000, "<b>" * 150_000 + "<hr>x" * 150_000,
     "<b>" * 150_000 + "<p>x</p>" * 100_000, '<div class="ad">x' * 60_000 + "<article>y" * 60_000, '<a class="' + "advert_" * 100_000 + '!x">y', "<svg " * 200_000 + "</svg " * 200_000, "<!--" * 200_000],
    ids=["open", "stray", "below", "endless", "nav", "void", "inline", "lifted", "token", "ends", "comments"],
)
def test_html_time_is_linear(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 10


def test_words_of_equal_sums_have_different_hashes():
    """The Thue-Morse word of 4096 letters and its complement agree in every polynomial hash modulo 2**64."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + " " + two).encode(), np.uint8)
    h, of = textnum.shingles(data, np.array([0, 4096, 8193]))
    assert len(h) == 2 and h[0] != h[1]
    alike, _ = textnum.shingles(np.frombuffer((one + " x " + one).encode(), np.uint8), np.array([0, 4096, 4099, 8195]))
    assert alike[0] == alike[2] != alike[1]


def test_mix_without_ids(spark):
    """Targets are met when half of the rows have no id."""
    rng = random.Random(5)
    rows = [(None if k % 2 else k, fixtures.words(rng, rng.randint(20, 80)), "en", "abc"[k % 3], 0) for k in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, fixtures.DOCS)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 0.01 * r["max(target)"] for r in got)


def test_fences_are_the_same_in_every_run(spark):
    measured = quality.measure(fixtures.documents(spark)).cache()
    runs = [sorted(map(str, quality.fences(measured.repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_html_beside_an_article():
    body = "the cat and the dog of the house is in a garden " * 8
    teaser = "<article><h2>Teaser</h2><p>Read this one as well.</p></article>"
    text = html.main_text(f"{teaser}<div><p>{body}</p><p>{body}</p></div><div><p>Zzz qqq.</p></div>")
    assert text.count(body.strip()) == 2 and "Zzz" not in text
    advert = "Xylo Brumt Kwarz Plonk Vrest Drumb Splint Grotz Wreck Blast Crunch Flump Stomp"
    text = html.main_text(f"<article><p>{body}</p><p>{advert}</p><div><a href=x>more Xylo Brumt Kwarz</a></div></article>")
    assert text == body.strip()
    # No neighbour is decided, so the article decides for the second block, and nothing does for the third.
    near, short = "the cat and the dog of the house xylo brumt kwarz plonk vrest " * 3, "Xylo brumt kwarz plonk vrest drumb splint grotz wreck blast crunch flump stomp."
    assert html.main_text(f"<article><p>{short}</p></article><p>{short}</p>") == short
    assert html.main_text(f"<article><p>{near}</p></article><p>{short}</p>") == near.strip()


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'title="The hidden cost"', 'href="/the/hidden/valley"', 'data-id="social"', 'class="site has-sidebar"', 'class="entry-header"', 'data-class=ad'],
)
def test_html_attributes_are_names_and_whole_tokens(attributes):
    assert html.main_text(f"<article><div {attributes}><h1>The title</h1></div><p>One of the two.</p></article>") == "The title\nOne of the two."


def test_html_named_boilerplate():
    for attributes in ["hidden", "class='x ad'", "class=cookie-notice", "id=site-footer", "class=nav-menu", "aria-hidden=true", "ROLE=search"]:
        assert html.main_text(f"<article><div {attributes}>Buy</div><p>One of the two.</p></article>") == "One of the two.", attributes
        assert html.main_text(f"<div {attributes}><p>x</p><article><p>One of the two.</p></article></div>").endswith("One of the two."), attributes
    comments = "<section class=comments><article><p>I think so.</p></article></section>"
    assert html.main_text(f"<article><p>One of the two.</p></article>{comments}") == "One of the two."


def brute_licences(text: str):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["cc by nc ", "by-NC cc ", "under the MIT license", ", ", "é", "apache License", " version 2.0", " 2 ", "\n"], k=rng.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scanned(df).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_licences(t), t
        assert set(filter(None, got[k]["base_labels"].split(","))) <= set(got[k]["labels"].split(",")) and 0 <= got[k]["score"] <= 1
    assert got[9999]["first_word"] is None and got[9999]["n_words"] == 0
    assert licenses.scanned(empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("expression", "value"),
    [("mit or apache-2.0 and isc", ({"mit", "apache-2.0", "isc"}, True)), ("( mit and isc ) and x", ({"mit", "x", "isc"}, False)), ("gpl-2.0 with e", ({"gpl-2.0 with e"}, False)),
     ("mit or", None), ("( mit", None), ("mit mit", None), (")", None), ("( mit or isc ) with e", None), ("mit with ( a or b )", None)],
)
def test_licence_expressions(expression, value):
    rpn = licenses.postfix(expression.split())
    assert (licenses.evaluate(rpn) if rpn is not None else None) == value


def test_long_licence_expressions_are_quick():
    text = "SPDX-License-Identifier: " + " AND ".join("(MIT OR Apache-2.0)" for _ in range(5000))
    began = time.perf_counter()
    assert licenses.Scanner().scan(text)[5] == "apache-2,mit" and time.perf_counter() - began < 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: MIT and please see the rest", "mit"), ("SPDX-License-Identifier: see file COPYING", ""), ("spdx-license-identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2"),
        ("SPDX-License-Identifier: (MIT OR LicenseRef-Own.1) AND Zlib\nand isc", "licenseref-own.1,mit,zlib"), ("SPDX-License-Identifier: Apache-2.0.", "apache-2"), ("SPDX-License-Identifier: MIT WITH nothing", "mit"),
        ("SPDX-License-Identifier: LicenseRef-", ""), ("GNU General Public License version 3, all rights reserved", "all-rights-reserved,gpl,gpl-3"), ("CC BY-NC", "cc-by-nc"),
    ],
)
def test_licence_labels(text, labels):
    assert licenses.Scanner().scan(text)[5] == labels


def test_licence_labels_equal_brute_force():
    """Notice phrases word by word, tags by a pattern over whole expressions of known names."""
    rng = random.Random(12)
    names = ["MIT", "Apache-2.0", "ISC", "GPL-2.0-only", "Zlib"]
    phrases = licenses.BASE_PHRASES | licenses.NOTICE_PHRASES
    for _ in range(300):
        used = [rng.choice(names) for _ in range(rng.randint(1, 6))]
        tag = "SPDX-License-Identifier: " + "".join(n + rng.choice([" OR ", " and "]) for n in used[:-1]) + used[-1]
        parts = rng.choices([*phrases, "some words", "the mit", tag, "license version 2"], k=rng.randint(0, 8))
        text = ", ".join(parts)
        words = re.findall("[a-z0-9]+", text.lower())
        want = {label for p, label in phrases.items() if any(words[k : k + len(p.split())] == p.split() for k in range(len(words)))}
        want |= {licenses.label_of(n.lower()) for n in used} if tag in parts else set()
        assert licenses.Scanner().scan(text)[5] == ",".join(sorted(want)), text


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[700:760] = x[3]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 15 + [float("nan")]), (5003, [1.0]), (None, [1.0] * 16), (5004, [1.0] * 15 + [None]), (10, x[10].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    out = ann.searched(df, df.filter("vec_id % 20 = 0")).collect()
    full = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 900, 20):
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == 20
        assert all(r["score"] == pytest.approx(full[q] @ full[r["vec_id"]], rel=1e-12) and r["vec_id"] != q for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
        want = sorted((k for k in range(900) if k != q), key=lambda k: (-(full[q] * full[k]).sum(), k))[:20]
        hits += len({r["vec_id"] for r in mine} & set(want))
        total += 20
    assert hits / total >= 0.9
    assert ann.searched(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert ann.searched(few, few).count() <= 6


def test_search_of_clustered_vectors_visits_few():
    """Work follows the buckets: of clustered vectors few are candidates, and the nearest are among them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.2 * rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.linalg.norm(x, axis=1).max() * (1 + 1e-9)
    q, ids = x[::100], np.arange(6000)
    index = ann.Index(32, scale, ann.fitted_width(x[rng.permutation(6000)[:2000]], scale, 6000, 20))
    buckets, probes = index.rows(x), index.probes(q)
    at = ann.candidates(buckets, probes, 6000, 60)
    assert isinstance(at, tuple) and len(at[0]) < 0.1 * 60 * 6000
    got = ann.nearest_in_block(ids, x, buckets, ids[::100], q, probes, 20)
    best = {(i, j) for i in range(0, 6000, 100) for j in sorted(ids[ids != i], key=lambda j: -(x[i] * x[j]).sum())[:20]}
    assert len(best & set(zip(got[0].tolist(), got[1].tolist(), strict=True))) >= 0.9 * len(best)
    # The mask of many candidates says the same as the list of few.
    many = np.zeros((60, 6000), bool)
    for t in range(ann.TABLES):
        many |= (buckets[t][None, None, :] == probes[t][:, :, None]).any(1)
    assert (np.argwhere(many) == np.stack(at, 1)).all()


def test_probe_sequence_has_no_contradictions():
    sets = ann.probe_sequence(6, 200)
    assert not sets[0].any() and len(np.unique(sets, axis=0)) == len(sets)
    assert not (sets[:, :6] & sets[:, ::-1][:, :6]).any()


def brute_repeats(data):
    own: dict[bytes, int] = {}
    for d, t in sorted(data, key=lambda x: x[0]):
        for p in range(len(t) - 49):
            own.setdefault(t[p : p + 50], d)
    for d, t in data:
        hit = bytearray(len(t))
        for p in range(len(t) - 49):
            if own[t[p : p + 50]] < d:
                hit[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, h in zip(t, hit, strict=True) if not h)
        yield d, (len(t), len(t) - len(kept), sum(hit[k] and (not k or not hit[k - 1]) for k in range(len(hit))), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("ab é", k=rng.randint(30, 200))) for _ in range(8)] + ["a" * 150, "ab" * 60]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 5))) + "".join(rng.choices("xyz", k=rng.randint(0, 90))) for _ in range(60)]
    data = [*enumerate(texts), (3, texts[3]), (77, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit(0))
    out = repeats.with_spans(df).select("row.doc_id", "text", "spans").mapInPandas(repeats._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    got = defaultdict(set)
    for r in out.collect():
        got[r["doc_id"]].add((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = defaultdict(set)
    for d, v in brute_repeats([(d, (t or "").encode()) for d, t in data]):
        want[d].add(v)
    assert got == want


def test_repeats_edges(spark):
    df = documents(spark)
    cut = repeats.deduplicated(df)
    assert cut.columns == df.columns and cut.count() == len(rows())
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == "" and texts[0] == rows()[0][1] and texts[5] is None and texts[None] in ("", None)
    assert repeats.deduplicated(empty(spark)).count() == 0


def test_repeats_keep_clashing_columns(spark):
    df = documents(spark)
    more = df.withColumns({"_doc": F.lit(1), "_row": F.lit("x"), "spans": F.lit(2), "row": F.lit(3), "starts": F.lit(4)})
    got = repeats.deduplicated(more)
    assert got.columns == more.columns
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == sorted(repr(tuple(r)) for r in repeats.deduplicated(df).collect())


def test_minimizers_of_a_very_long_text():
    """Cut into parts, a long run of equal strings has the same minimizers."""
    data = np.frombuffer(b"x" * 300 + bytes(random.Random(3).choices(b"ab", k=700)) + b"yz" * 200, np.uint8)
    whole = repeats.minimizers(data)[0]
    assert all((repeats.minimizers(data, most)[0] == whole).all() for most in (1, 7, 64, 333, 5000))
    assert (whole >= np.arange(len(whole))).all() and (whole < np.arange(len(whole)) + repeats.SPAN).all()


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = fresh(100)
    data = [(5, passage + fresh(300)), (None, fresh(200) + passage), (None, fresh(400)), (9, fresh(150) + passage), (9, fresh(400)), (9, fresh(60) + passage)]
    data += [data[1]] * 3
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(r["text"] for r in repeats.deduplicated(df).collect())
    assert got == sorted(t if i == 5 else t.replace(passage, "") for i, t in data)


def test_repeats_of_many_documents_are_summed_up():
    """However many documents of a pack share a passage, the task of a minimizer gets two places and one piece."""
    text = "".join(random.Random(6).choices("abcdefgh", k=300))
    found = repeats.pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, 300]))
    n = 3000
    batch = pa.record_batch({
        "_doc": np.arange(n), "_row": np.zeros(n, np.int64), "text": pa.array([text] * n), "starts": pa.array([found[1].astype(np.uint32).tobytes()] * n),
    })
    for packed, most in (repeats.packed_anchors, 2), (repeats.packed_pieces, 1):
        sent: Counter = Counter()
        for out in packed(iter([batch]), 7):
            for r in out.to_pylist():
                sent.update(np.frombuffer(r["anchors"], np.uint32).tolist())
        assert set(sent) == set(found[3].astype(np.uint32).tolist()) and max(sent.values()) <= most


def test_repeats_of_many_packs_are_merged(spark):
    """Merged before they meet, packs give the same spans; a minimizer that all of them have sends two places."""
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcd", k=rng.randint(60, 200))) for _ in range(12)]
    data = [(rng.randint(0, 150), "".join(rng.choices(pool, k=rng.randint(1, 4))) + "".join(rng.choices("xyz", k=60))) for _ in range(200)]
    keyed = repeats._keyed(spark.createDataFrame(data, "doc_id long, text string").repartition(20))
    found = []
    for merges in 1, 3:
        rows_ = repeats.spans(keyed, parts=30, merges=merges).collect()
        found.append(sorted((r["_doc"], r["_row"], tuple(repeats.union(r["spans"]))) for r in rows_))
    assert found[0] == found[1] and len(found[0]) > 100
    text = "".join(rng.choices("abcdefgh", k=300))
    starts = repeats.pieces(np.frombuffer(text.encode(), np.uint8), np.array([0, 300]))[1].astype(np.uint32).tobytes()
    batches = [pa.record_batch({"_doc": np.arange(k, k + 3), "_row": np.zeros(3, np.int64), "text": pa.array([text] * 3), "starts": pa.array([starts] * 3)}) for k in range(0, 300, 3)]
    for packed, most in (repeats.packed_anchors, 2), (repeats.packed_pieces, 1):
        sent = pa.Table.from_batches([out for b in batches for out in packed(iter([b]), 1)])
        for order in np.arange(len(sent)), np.arange(len(sent))[::-1]:
            out = repeats.merged_packs(sent.take(order), 1).to_pylist()
            merged = [r for r in out if not r["known"]]
            assert len(merged) == 1 and max(Counter(np.frombuffer(merged[0]["anchors"], np.uint32).tolist()).values()) <= most
            grow = zstandard.ZstdDecompressor()
            docs_ = [np.frombuffer(grow.decompress(r["docs"]), np.int64).reshape(-1, 2)[:, 0].tolist() for r in out]
            assert {d for ids in docs_ for d in ids} == set(range(300)) and 0 in docs_[out.index(merged[0])]


@pytest.fixture
def shuffled(spark):
    """Plans as they are on tables that are too large for a broadcast, with their reused exchanges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_repeats_move_texts_once_and_compressed(spark, shuffled, tmp_path):
    """Both joins, with the starts and with the spans, read one exchange of the compressed texts."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in repeats.deduplicated(docs), repeats.op7_repeated_strings(spark, str(tmp_path)):
        plan = shuffled(out)
        assert plan.count("ReusedExchange") == 1 and "squeezed(text" in plan


def test_near_duplicates_move_texts_compressed(spark, shuffled, monkeypatch):
    """The join that picks the texts of a bucket's nodes moves compressed ones."""
    monkeypatch.setattr(neardup.scratch, "written", lambda df, owner: df)
    base = neardup._base(documents(spark))
    wanted = base.select("id", "digest", F.col("id").alias("node"))
    for many in False, True:
        plan = shuffled(neardup._texts(base, wanted, many, "test"))
        assert "Exchange" in plan and plan.index("Exchange") < plan.index("squeezed(")


@pytest.mark.parametrize("bits", [9, 25])
def test_rows_that_stay_do_not_move(spark, bits):
    """Of 2000 rows few meet the 20 that are gone; a table of bits that is too small still gives the same rows."""
    rows_ = spark.range(2000).select("id", F.md5(F.col("id").cast("string")).alias("digest"), F.struct("id").alias("row"))
    gone = rows_.filter("id % 100 = 7").select("id", "digest")
    assert sorted(r["id"] for r in neardup._without(rows_, gone, bits).collect()) == [k for k in range(2000) if k % 100 != 7]
    assert neardup._without(rows_, gone.limit(0), bits).count() == 2000
    may = rows_.filter(neardup._may_be(gone, bits)).count()
    assert may == 20 if bits == 25 else 20 <= may < 300


def test_compressed_texts_come_back_whole():
    """Nulls stay nulls, and a batch is cut where its texts pass the limit."""
    texts = ["", None, "é" * 40, "x" * 500, "ab"]
    small = textnum.squeezed(pa.array(texts))
    assert small.is_null().to_pylist() == [t is None for t in texts]
    assert textnum.expanded(small) == [(t or "").encode() for t in texts]
    batch = pa.record_batch({"_doc": pa.array(range(5)), "text": small})
    for part in (batch, 0), (batch.slice(2), 2):
        out = list(textnum.expanded_batches(iter([part[0]]), 100))
        assert [d for b in out for d in b.column(0).to_pylist()] == list(range(part[1], 5)) and len(out) == 3
        assert [t for b in out for t in b.column(1).to_pylist()] == [(t or "").encode() for t in texts[part[1] :]]


def test_tasks_of_repeats_are_bounded(spark):
    """Tasks loop over parts: their number follows the cores, and the bytes only where a task would pass 100 MB."""
    df = spark.createDataFrame([(0, b"")], "part int, docs binary")
    cores = spark.sparkContext.defaultParallelism
    for parts, tasks in (5, 5), (100_000, max(32 * cores, 391)):
        grouped = repeats._by_task(df, parts, 1, "part int, docs binary")
        plan = grouped.applyInArrow(lambda t: t, "part int, docs binary")._jdf.queryExecution().toString()
        assert "hashpartitioning(part#" in plan and f", {tasks})" in plan.split("Physical Plan")[-1].replace(", REPARTITION_BY_NUM", ")")


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    text = bytes(rng.choices(b"ab", k=300)) + b"a" * 70 + bytes(rng.choices(b"ab", k=60))
    data = np.concatenate([np.frombuffer(text, np.uint8).astype(np.uint16) + 1, [0], np.frombuffer(text[100:260], np.uint8).astype(np.uint16) + 1, [0]])
    sa, parted = repeats.common_prefix_classes(data.astype(np.uint16), 20)
    end = np.flatnonzero(data == 0)
    suffix = [tuple(data[k : end[np.searchsorted(end, k)]].tolist()) for k in sa]
    assert suffix == sorted(suffix)
    for k in range(1, len(sa)):
        a, b = suffix[k - 1], suffix[k]
        assert parted[k] == (a[:20] != b[:20] or len(a) < 20 or len(b) < 20)


def test_shards(spark):
    df = documents(spark)
    out = sharding.sharded(df, shards=4).collect()
    assert len(out) == len(rows())
    by_text = defaultdict(set)
    sums, slots = Counter(), defaultdict(list)
    texts = {i: t or "" for i, t, *_ in rows()}
    for r in out:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
            by_text[t].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[t or ""].append((i if i is not None else 1 << 60, len((t or "").encode()) + 1))
    sizes = [sum(z for _, z in g) for g in sorted(groups.values(), key=min)]

    def shards(cap: int) -> int:
        n, now = 1, 0
        for z in sizes:
            n, now = (n + 1, z) if now + z > cap else (n, now + z)
        return n if max(sizes) <= cap else 10**9

    assert max(sums.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 4)
    assert sharding.sharded(empty(spark)).count() == 0


def test_shards_of_rows_that_share_an_id(spark):
    data = [(1, "a" * 40), (1, "b" * 70), (2, "c" * 50), (2, "a" * 40), (3, "d" * 90), (3, "e" * 10), (None, "f" * 60), (None, "f" * 60), (None, "g" * 30)]
    out = sharding.sharded(spark.createDataFrame(data, "doc_id long, text string"), shards=3).collect()
    crc = lambda t: zlib.crc32(t.encode())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out) == Counter((i, crc(t)) for i, t in data)
    of_text = defaultdict(set)
    for r in out:
        of_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    assert min(of_text[crc("f" * 60)] | of_text[crc("g" * 30)]) >= max(max(of_text[crc(c * n)]) for c, n in [("a", 40), ("b", 70), ("c", 50), ("d", 90), ("e", 10)])


def test_shards_of_rows_without_ids_are_many_ranges(spark):
    """Rows without an id, or of one id, are split by the sums of their texts."""
    data = [(None if k % 2 else 7, f"text {k}") for k in range(4000)]
    out = sharding.sharded(spark.createDataFrame(data, "doc_id long, text string").repartition(8), shards=4).collect()
    slots = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"] is not None, r["text_crc32"])):
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 4000 and all(s == list(range(len(s))) for s in slots.values())


def test_toxicity(spark):
    rng = random.Random(6)
    fine = [f"w{k}" for k in range(80)]
    data, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        sentences = [[rng.choice(fine) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 12))]
        if toxic:
            rng.choice(sentences).insert(1, rng.choice(["nastyword", "vileness", "vilest"]))
        data.append((k, ". ".join(" ".join(s) for s in sentences)))
        labels.append((k, int(toxic)))
    data += [(2000, None), (2001, ""), (2002, "...")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit(1))
    truth = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.trained(docs, truth.filter(~toxicity.held_out(F.col("doc_id"))))
    out = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [(k, y) for k, y in labels if out[k]["held_out"]]
    assert {k for k, _ in held} == {k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(out[k]["predicted"] == y for k, y in held) / len(held) > 0.97
    assert all(re.search("nasty|vile", out[k]["worst_sentence"]) for k, y in held if y and out[k]["predicted"])
    assert all(0 <= out[k]["score"] < 0.01 for k in (2000, 2001, 2002))
    none = toxicity.trained(docs, truth.limit(0))
    assert toxicity.scored(empty(spark), none).count() == 0 and toxicity.scored(docs, none).filter("predicted = 1").count() == 0


def brute_quality(text: str):
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = len(covered)
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed


def test_quality_measures(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a ", "b ", "c\n", "#x ", "\t", "é ", "a b c\n", "\n", " ", "$ "], k=rng.randint(0, 150))) for _ in range(200)] + [t for _, t, *_ in rows()]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality.judged(df).collect():
        want = brute_quality(texts[r["doc_id"]] or "")
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, texts[r["doc_id"]]
        assert not (want[-1] and r["kept"])


def test_quality_fences(spark):
    """Clean documents stay, a document unlike its group goes, in every language and source."""
    rng = random.Random(9)
    clean = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))), ["en", "de", None][k % 3], [f"s{k % 2}", None][k % 5 == 4]) for k in range(900)]
    odd = [(1000, " ".join("###$$$" for _ in range(80)), "en", "s0"), (1001, " ".join(f"{'long' * 20}{k}" for k in range(80)), "de", "s1"), (1002, " ".join(f"w{k} ###" for k in range(90)), None, None)]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.judged(df).filter("kept").collect()}
    assert len(kept & set(range(900))) >= 890 and not kept & {1000, 1001, 1002}
    assert quality.judged(empty(spark)).count() == 0


def test_quality_verdict_equals_brute_force(spark):
    """Fences from exact quartiles; the bins of the sketches are finer than the gaps to any fence here."""
    rng = random.Random(10)
    data = []
    for k in range(150):
        w = [rng.choice(["w", "word", "#x", "a$"]) + str(rng.randrange(60)) * rng.choice([1, 1, 1, 4]) for _ in range(rng.randint(30, 120))]
        lines = [" ".join(w[j : j + 7]) for j in range(0, len(w), 7)]
        if rng.random() < 0.2:
            lines += lines[: rng.randint(1, 9)]
        data.append((k, "\n".join(lines), ["en", "de", None][k % 3 if k < 140 else 1], [f"s{k % 2}", None][k % 7 == 6]))
    measures = {}
    for k, text, lang, source in data:
        n, chars, symbols, dup, repeat, failed = brute_quality(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        measures[k] = failed, lang, source, {"symbol_ratio": symbols / chars, "dup_line_ratio": dup / lines, "repeat_ratio": repeat / n, "word_length": chars / n}

    def quartile(name, q, test):
        x = sorted(m[name] for failed, lang, source, m in measures.values() if not failed and test(lang, source))
        return x[max(0, -(-int(4 * q) * len(x) // 4) - 1)], len(x)

    def kept(failed, lang, source, m):
        for name, *_, least in quality.RATIOS:
            ends = []
            for q in (0.25, 0.75):
                out = quartile(name, q, lambda la, so: True)[0]
                for test in (lambda la, so: la == lang, lambda la, so: (la, so) == (lang, source)):
                    own, n = quartile(name, q, test)
                    out = (n * own + quality.PRIOR_DOCUMENTS * out) / (n + quality.PRIOR_DOCUMENTS)
                ends.append(out)
            reach = quality.SPREAD * max(ends[1] - ends[0], least)
            if m[name] > ends[1] + reach or name == "word_length" and m[name] < ends[0] - reach:
                return False
        return True

    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(df).collect()}
    assert got == {k: not m[0] and kept(*m) for k, m in measures.items()} and 0 < sum(got.values()) < sum(not m[0] for m in measures.values())


def test_mixing_keeps_clashing_columns(spark):
    df = documents(spark)
    more = df.withColumns({"_s": F.lit(1), "_below": F.lit("x"), "_copy": F.lit(7), "row": F.lit(2), "copies": F.lit(9), "hash": F.lit(0)})
    got = mixing.repeated(more)
    assert got.columns == more.columns
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == sorted(repr(tuple(r)) for r in mixing.repeated(df).collect())
    assert {tuple(r)[5:] for r in got.collect()} == {(1, "x", 7, 2, 9, 0)}


def test_pipeline_quality_keeps_clashing_columns(spark):
    import corpus_pipeline

    df = documents(spark)
    more = df.withColumn("n_words", F.lit(-1)).withColumn("n_lines", F.lit("x")).withColumn("kept", F.lit(None).cast("boolean")).withColumn("_words", F.lit(2))
    want = sorted(repr(tuple(r)) for r in corpus_pipeline.keep_good(spark, df, "").collect())
    got = corpus_pipeline.keep_good(spark, more, "")
    assert got.columns == more.columns and want
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == want and {tuple(r)[5:] for r in got.collect()} == {(-1, "x", None, 2)}


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain versions of what each may do."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(100), text(12)
    texts = [base, base, base + " more", text(70) + " " + passage, passage + " " + text(70), "short", None, "a b c " * 50] + [text(rng.randint(60, 160)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now.collect())
    good, unique, cut, mixed, last = seen
    assert {5, 6, 7}.isdisjoint(r["doc_id"] for r in good) and len(good) == len(texts) - 3
    assert {r["doc_id"] for r in good} - {r["doc_id"] for r in unique} == {1, 2}
    want = dict(brute_repeats([(r["doc_id"], r["text"].encode()) for r in unique]))
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut} == {d: v[3] for d, v in want.items()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(spark.createDataFrame(cut)).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: c for d, c in copies.items() if c})
    assert len(last) == len(mixed) and last[0].__fields__ == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert pipeline.run(spark, str(tmp_path)).count() == len(last)
