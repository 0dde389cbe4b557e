"""Licence scans (operator 5).

One Aho-Corasick automaton finds notice phrases in the words of a text and another the identifier tags in the text
itself; the expression after a tag is read by a shunting-yard parser for and / or / with and evaluated, in linear
time, to the licences it names and whether it leaves a choice.  An expression ends at the first word that is neither
an operator nor a known identifier, so prose after a tag names no licence.

Defined results: null text is empty (no words, score 0, null word places); repeated rows are scanned alike; empty
tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import scratch

# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases of the method's own, after the texts of common licence notices.
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx-license-identifier:"
# Identifiers of licences and of exceptions that an expression may name, in lower case; LicenseRef- names are free.
IDENTIFIERS = frozenset(
    "0bsd afl-3.0 agpl-1.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause "
    "bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-1.0 cc-by-nc-2.0 "
    "cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 "
    "cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 "
    "eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 "
    "mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0 unicode-3.0 "
    "unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()
)
EXCEPTIONS = frozenset(
    "autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 "
    "gpl-3.0-linking-exception lgpl-3.0-linking-exception linux-syscall-note llvm-exception openssl-exception qt-gpl-exception-1.0 u-boot-exception-2.0".split()
)
# Identifiers whose label is one of those above; any other identifier is its own label.
SPDX_LABELS = {
    "mit": "mit",
    "apache-2.0": "apache-2",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "cc-by-4.0": "cc-by",
    "cc0-1.0": "cc0",
}
#: Weights of the evidence in the score, combined as 1 - (1 - w1)(1 - w2)...
WEIGHTS = {"base": 0.9, "notice": 0.7, "tag": 0.95, "broken tag": 0.3}
#: Letters, digits, dots, plus and hyphens of an identifier, or a parenthesis.
_EXPRESSION = re.compile(r"[ \t]*([a-z0-9.+\-:]+|[()])")
_OPERATORS = {"or": 1, "and": 2, "with": 3}

#: Bytes of UTF-8: A-Z to a-z; what no word holds to a space.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def phrase_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, phrase.count(" ") + 1, len(phrase) + 2, label))
    found.make_automaton()
    return found


def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word(TAG, TAG)
    found.make_automaton()
    return found


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None where it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False
    for t in tokens:
        if t == "(":
            if operand:
                return None
            waiting.append(t)
        elif t == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in _OPERATORS:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and _OPERATORS[waiting[-1]] >= _OPERATORS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = False
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand:
        return None
    while waiting:
        t = waiting.pop()
        if t == "(":
            return None
        out.append(t)
    return out


def evaluate(rpn: list[str]) -> tuple[frozenset[str], bool] | None:
    """The licences that an expression names and whether it leaves a choice (an ``or``); linear in its length.

    ``with`` ties an exception to one licence; tied to a compound there is no value.
    """
    stack: list[str | None] = []  # a licence, or None for a compound whose licences are in ``names``
    names: list[str] = []
    choice = False
    for t in rpn:
        if t not in _OPERATORS:
            stack.append(t)
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            if left is None or right is None or " with " in left:
                return None
            stack.append(f"{left} with {right}")
        else:
            names += [x for x in (left, right) if x is not None]
            choice |= t == "or"
            stack.append(None)
    return frozenset([*names, *(x for x in stack if x is not None)]), choice


def is_known(token: str, exception: bool) -> bool:
    if exception:
        return token in EXCEPTIONS
    if token.startswith("licenseref-") and len(token) > len("licenseref-"):
        return True
    return token.removesuffix("+").removesuffix("-only").removesuffix("-or-later") in IDENTIFIERS


def expression_after(text: str, at: int) -> list[str]:
    """Tokens of the expression that starts at ``at`` and ends with its line or with what can't belong to it."""
    out, depth, operand = [], 0, False
    while m := _EXPRESSION.match(text, at):
        t = m.group(1)
        named = t not in _OPERATORS and t not in "()"
        if named:
            # A full stop after the last identifier ends a sentence.
            t = t if is_known(t, bool(out) and out[-1] == "with") else t.rstrip(".")
            if operand or not is_known(t, bool(out) and out[-1] == "with"):
                break
        if t == ")" and not depth:
            break
        depth += (t == "(") - (t == ")")
        operand = t == ")" or named
        out.append(t)
        at = m.end()
    while out and out[-1] in _OPERATORS and not operand:
        out.pop()
        operand = bool(out) and out[-1] not in _OPERATORS and out[-1] != "("
    return out


def label_of(licence: str) -> str:
    name = licence.split(" with ")[0].removesuffix("-only").removesuffix("-or-later").rstrip("+.")
    return SPDX_LABELS.get(name, name)


class Scanner:
    def __init__(self):
        self.phrases, self.tags = phrase_automaton(), tag_automaton()

    def scan(self, text: str) -> tuple:
        raw = text.encode()
        words = raw.translate(TO_WORDS).split()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base, labels, places, clear, expressions = set(), set(), [], 1.0, []
        hits = list(self.phrases.iter(joined))
        if hits:
            ends = np.array([end for end, _ in hits])
            blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
            at = np.searchsorted(blanks, ends)
            for k, (_, (kind, n, _, label)) in zip(at.tolist(), hits, strict=True):
                labels.add(label)
                clear *= 1 - WEIGHTS[kind]
                if kind == "base":
                    base.add(label)
                    places.append(k - n)
        if b":" in raw:
            lower = raw.translate(TO_LOWER).decode("latin-1")
            for end, _ in self.tags.iter(lower):
                tokens = expression_after(lower, end + 1)
                rpn = postfix(tokens)
                value = evaluate(rpn) if rpn is not None else None
                clear *= 1 - WEIGHTS["tag" if value else "broken tag"]
                if value:
                    labels |= {label_of(x) for x in value[0]}
                    expressions.append(" ".join(tokens))
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, 1 - clear), "; ".join(expressions),
        )


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and what the scan found in each whole text.  No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
        for pdf in batches:
            rows = [(d, *scanner.scan(t or "")) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {COLUMNS}")


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(scratch.table(spark, sf_dir, "documents"))
