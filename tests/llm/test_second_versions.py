"""Main text and toxicity against second, plain implementations."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from scoreloom.llm import html, textnum, toxicity

from . import fixtures

CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
GONE = {"script", "style", "template", "noscript", "iframe", "svg", "head", "button", "select", "textarea"}
NAMES = re.compile(r"(^|[-_ ])(ads?|advert|banner|sponsor(ed)?|promo|sidebar|cookie|notice|comments?|share|social|related|newsletter|subscribe|breadcrumbs?)([-_ ]|$)")


class Plain(HTMLParser):
    """Blocks of a tidy page: their text, whether they stand in the article, in what is no article, and their links."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.now, self.links = [], [], [], 0

    def end(self):
        text = " ".join("".join(self.now).split())
        if text:
            inside = any(n in ("article", "main") for n, _ in self.stack)
            self.blocks.append((text, inside, any(d for _, d in self.stack), self.links))
        self.now, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        if tag in html._BLOCKS:
            self.end()
            if self.stack and self.stack[-1][0] in html._ENDS.get(tag, ()):
                self.stack.pop()
        if tag not in html._VOID:
            said = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            roles = {v for k, v in attrs if k == "role"}
            inside = any(n in ("article", "main") for n, _ in self.stack)
            dark = tag in CHROME and not (tag == "header" and inside) or bool(roles & set(html.ROLES)) or bool(said and NAMES.search(said) and tag not in ("article", "main"))
            self.stack.append((tag, dark))

    def handle_endtag(self, tag):
        if tag in html._BLOCKS:
            self.end()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if not any(n in GONE for n, _ in self.stack):
            self.now.append(data)
            self.links += len(data) if any(n == "a" for n, _ in self.stack) else 0


def test_main_text_of_tidy_pages(tmp_path):
    """On pages with an article the places decide: what is in it, not chrome, and not mostly links."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    same = 0
    for (page,) in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.end()
        want = "\n".join(t for t, inside, dark, links in plain.blocks if inside and not dark and links <= html.MOST_LINKS * len(t))
        same += html.main_text(page) == want
    assert same == len(pages) > 200


@pytest.mark.parametrize("cut", [0.0, 0.3])
def test_passes_decide_without_an_article(cut):
    """The same bodies in plain elements: density and length decide, and neighbours for what they leave open."""
    rng = np.random.default_rng(3)
    words = sorted(html.STOP_WORDS)
    prose = lambda n, share: " ".join(str(rng.choice(words)) if rng.random() < share else f"xq{rng.integers(999)}z" for _ in range(n))
    good, near, bad, short = prose(80, 0.6), prose(60, 0.2 + cut / 10), prose(25, 0.0), "xqz bcd."
    page = "".join(f"<div>{t}</div>" for t in (bad, good, short, good, near, bad, short, bad))
    assert html.main_text(page) == "\n".join([good, short, good, near])


def plain_hash(word: bytes) -> int:
    """What ``textnum.word_sums`` gives a word, in whole numbers."""
    m = (1 << 64) - 1
    total = 0
    for k, b in enumerate(word):
        x = (int(textnum.FOLDED_VALUES[b]) + k * textnum.MULTIPLIER) & m
        x ^= x >> 32
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & m
        total += x ^ x >> 32
    return total & m


def plain_score(text: str, model: toxicity.Model) -> float:
    weight = dict(zip(model.chosen.tolist(), model.weight.tolist(), strict=True))
    mixed = lambda h: int(textnum.mix(np.array([h & (1 << 64) - 1], np.uint64))[0]) >> (64 - toxicity.FEATURE_BITS)
    miss = 1.0
    for sentence in re.split(rb"[\n\r!.?]", text.encode()):
        found = set()
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        for w in words:
            found.add(mixed(plain_hash(w)))
            found |= {mixed(plain_hash(w[:n]) + n) for n in toxicity.STEMS if len(w) > n}
        if words:
            miss *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight.get(f, 0.0) for f in found)))
    return 1 - miss * math.exp(-1e-9)


def test_scores_equal_plain_noisy_or(spark):
    rows = [r for r in fixtures.rows() if r[1] is None or len(r[1]) < 6000]
    texts = [*[t or "" for _, t, *_ in rows], "You are awful! Awful.\nNice day, awfulness?", "ÄÖ. no"]
    used = sorted({mixed for t in texts for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode()) for mixed in [int(textnum.mix(np.array([plain_hash(w)], np.uint64))[0]) >> (64 - toxicity.FEATURE_BITS)]})
    rng = np.random.default_rng(1)
    chosen = np.array(used[::3], np.int64)
    model = toxicity.Model(chosen, rng.uniform(0, 4, len(chosen)).astype(np.float32).astype(float), -5.0)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    for k, t in enumerate(texts):
        assert math.isclose(got[k], plain_score(t, model), rel_tol=1e-5, abs_tol=1e-7), (k, t[:80])
