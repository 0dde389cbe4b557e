"""Many declared names in many texts: one automaton over all names, one pass over each text."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of names (each name counts OVERHEAD more) that one automaton holds; beyond that several are built, and each
#: makes its own pass.  Some 50 bytes of memory a character in a Python worker, and what one broadcast moves.
AUTOMATON_CHARS = 2_000_000
OVERHEAD = 16
ASCII_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
#: What may not stand beside a name: nothing is said, a character of an ASCII word, one of any word.
NONE, ASCII, UNICODE = "none", "ascii", "unicode"


def _in_word(c: str) -> bool:
    if c < "\x80":
        return c in ASCII_WORD
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc") or c in "‌‍"


def folded(text: str) -> str:
    """Lower case, letter by letter: places in it are places in the text."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:
        return low
    return "".join(f if len(f := c.lower()) == 1 else c for c in text)


@dataclass
class Names:
    """Names by number, with what holds for each: whether case counts, and what a word is at its bounds."""

    spelled: list[str]
    folds: list[bool]
    bounds: list[str]
    exact: ahocorasick.Automaton | None = field(init=False)
    any_case: ahocorasick.Automaton | None = field(init=False)

    def __post_init__(self) -> None:
        groups: dict[tuple[bool, str], list[int]] = {}
        for k, (name, folds) in enumerate(zip(self.spelled, self.folds, strict=True)):
            groups.setdefault((folds, folded(name) if folds else name), []).append(k)
        made = [ahocorasick.Automaton(), ahocorasick.Automaton()]
        for (folds, name), numbers in groups.items():
            made[folds].add_word(name, (len(name), numbers))
        for a in made:
            if len(a):
                a.make_automaton()
        self.exact, self.any_case = (a if len(a) else None for a in made)

    def within(self, text: str) -> set[int]:
        """Numbers of the names that stand in a text."""
        found: set[int] = set()
        for automaton, hay in ((self.exact, text), (self.any_case, folded(text) if self.any_case else "")):
            for end, (length, numbers) in automaton.iter(hay) if automaton else ():
                for k in numbers:
                    if k not in found and self._bounded(text, end + 1 - length, end + 1, self.bounds[k]):
                        found.add(k)
        return found

    @staticmethod
    def _bounded(text: str, start: int, end: int, bounds: str) -> bool:
        if bounds == NONE:
            return True
        inside = _in_word if bounds == UNICODE else ASCII_WORD.__contains__
        return not (start and inside(text[start - 1]) or end < len(text) and inside(text[end]))


#: The automaton that this worker used last.
_BUILT: dict[str, Names] = {}


def _found(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Key and number of each name found, with the columns of the name."""
    ident, table = shared.value
    if ident not in _BUILT:
        _BUILT.clear()
        _BUILT[ident] = Names(*(table.column(c).to_pylist() for c in ("_spelled", "_folds", "_bounds")))
    names, columns = _BUILT[ident], table.drop_columns(["_spelled", "_folds", "_bounds"]).combine_chunks()
    for batch in batches:
        rows, numbers = [], []
        for k, text in enumerate(batch.column(1)):
            if text.is_valid:
                found = names.within(text.as_py())
                rows += [k] * len(found)
                numbers += sorted(found)
            if len(rows) > 100_000:
                yield _joined(batch, columns, rows, numbers)
                rows, numbers = [], []
        yield _joined(batch, columns, rows, numbers)


def _joined(batch: pa.RecordBatch, columns: pa.Table, rows: list[int], numbers: list[int]) -> pa.RecordBatch:
    taken = columns.take(pa.array(numbers, pa.int64())).combine_chunks()
    arrays = [c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in taken.columns]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], [batch.schema.names[0], *columns.column_names])


def occurrences(texts: DataFrame, names: DataFrame, key: str, spelled: Column, folds: Column, bounds: Column) -> DataFrame:
    """(key, columns of ``names``) of every name that stands in a text, once a text.

    ``texts``: key and text; ``spelled``: the string to look for, ``folds``: whether case is ignored, ``bounds``: none,
    ascii or unicode, the characters of a word that may not stand beside it.  Blank and null names stand nowhere, a null
    text holds nothing; rows of ``texts`` with one key are texts of their own and give a row each.

    Texts are not shuffled.  The names are measured first and cut by a hash into as many parts as AUTOMATON_CHARS asks
    for; each part is broadcast, so what is broadcast has a bound, and makes one pass that is linear in the text.
    """
    declared = names.distinct().select("*", spelled.alias("_spelled"), folds.alias("_folds"), bounds.alias("_bounds"))
    declared = declared.filter(F.regexp_like("_spelled", F.lit(r"(?U)\S")))
    chars = declared.agg(F.sum(F.length("_spelled") + OVERHEAD)).first()[0] or 0
    parts = max(1, -(-chars // AUTOMATON_CHARS))
    schema = texts.select(key).schema
    for f in names.schema.fields:
        schema = schema.add(f.name, f.dataType)
    out = None
    for k in range(parts):
        own = declared if parts == 1 else declared.filter(F.pmod(F.xxhash64("_spelled"), F.lit(parts)) == k)
        shared = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, own.toArrow()))
        found = texts.select(key, "text").mapInArrow(lambda batches, s=shared: _found(batches, s), schema)
        out = found if out is None else out.unionByName(found)
    return out
