"""BPE encoding and decoding with a minimal acyclic transducer lexicon (operator 2).

The frequent words of the corpus, with the ids that the merges give them, are compiled into a minimal acyclic
automaton: words with equal rests share states, each arc carries how many words end before it, and adding those up
along a word gives the word's number, which finds its ids.  The automaton is a few flat integer arrays in one file
that the workers memory-map.  Words outside the lexicon are merged exactly by rank, many side by side.

Defined results: null text is empty (no ids, empty decoding); repeated rows are encoded alike; an empty table gives
an empty result; extra columns are untouched by ``encoded`` and ``decoded``, but for the one named as the result.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Words in the lexicon at most; every other word is merged exactly.
LEXICON_WORDS = 50_000
#: Words that a worker remembers at most before it starts anew.
REMEMBERED = 400_000
#: Texts whose new words are looked up together.
TOGETHER = 256
END = "</w>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Rules:
    """Vocabulary, merge ranks and text rules of a tokenizer file of this kind (lower case, words with an end mark)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {(m[0], m[1]) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.numbers = {i: str(i) for i in self.tokens}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.letters = byte_letters()
        # The same as arrays, for many words at once.
        self.base = max(self.vocab.values()) + 1
        self.first_ids = np.array([self.vocab[c] for c in self.letters], np.int64)
        self.last_ids = np.array([self.vocab[c + END] for c in self.letters], np.int64)
        pairs = np.array([self.vocab[a] * self.base + self.vocab[b] for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], order
        self.merged_ids = np.array([self.vocab[a + b] for a, b in self.ranks], np.int64)

    def normalized(self, text: str) -> str:
        # The tokenizer also turns runs of white space into one space; no word holds any, so that has no effect here.
        # Lower-casing goes character by character, as the library does it: no rule looks at the neighbours.
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(c.lower() for c in text)
        return text.lower()

    def pieces(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """(words, special token after them) in order."""
        at = 0
        if "<|" in text:
            for m in self.specials.finditer(text):
                yield self.words.findall(self.normalized(text[at : m.start()])), m.group()
                at = m.end()
        yield self.words.findall(self.normalized(text[at:])), None

    def merged_many(self, words: list[str]) -> list[list[int]]:
        """``merged`` of many words at once: one merge per word and round, all words side by side in a matrix."""
        out: list[list[int]] = [[]] * len(words)
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        for low, high in ((0, 8), (8, 16), (16, 32)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                flat = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                n = sizes[part]
                ids = np.full((len(part), high), -1, np.int64)
                ids[np.arange(high) < n[:, None]] = self.first_ids[flat]
                ids[np.arange(len(part)), n - 1] = self.last_ids[flat[np.cumsum(n) - 1]]
                done = self._merge_rows(ids)
                counts = (done >= 0).sum(1)
                for i, row, c in zip(part.tolist(), done.tolist(), counts.tolist(), strict=True):
                    out[i] = row[:c]
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = self.merged(words[i])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of merges where a pair has none (or an id is missing, -1)."""
        key = left * self.base + right
        key[right < 0] = -1
        place = np.searchsorted(self.pair_keys, key)
        place[place == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place], len(self.pair_keys))

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge the leftmost pair of least rank of every row until no row has one."""
        none, columns = len(self.pair_keys), np.arange(ids.shape[1])
        active, rows, rank = np.arange(len(ids)), ids, self._ranks(ids[:, :-1], ids[:, 1:])
        while len(active):
            best = rank.argmin(1)
            least = rank[np.arange(len(rank)), best]
            go = least < none
            ids[active[~go]] = rows[~go]
            active, rows, rank, best, least = active[go], rows[go], rank[go], best[go], least[go]
            if not len(active):
                break
            # The right half of each pair goes; only the pairs beside the new id get another rank.
            moved = columns + (columns > best[:, None])
            rows = np.take_along_axis(rows, np.minimum(moved, ids.shape[1] - 1), 1)
            rows[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(moved[:, :-1], ids.shape[1] - 2), 1)
            rank[:, -1] = none
            at = np.arange(len(rows))
            rows[at, best] = self.merged_ids[least]
            before = np.maximum(best - 1, 0)
            rank[at, before] = np.where(best > 0, self._ranks(rows[at, before], rows[at, before + 1]), rank[at, before])
            after = np.minimum(best, ids.shape[1] - 2)
            rank[at, after] = self._ranks(rows[at, after], rows[at, after + 1])
        return ids

    def merged(self, word: str) -> list[int]:
        """Ids of one word: merge the neighbours of least rank, leftmost first, until none can be merged.

        A heap over a doubly linked list, so that very long words cost n log n.
        """
        parts = [self.letters[b] for b in word.encode()]
        if not parts:
            return []
        parts[-1] += END
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else -1
            if j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        out, i = [], 0
        while i >= 0:
            if (t := self.vocab.get(parts[i])) is not None:
                out.append(t)
            i = after[i]
        return out


def compile_lexicon(words: Iterable[str], rules: Rules) -> bytes:
    """The transducer of the sorted distinct words: built word by word, finished states shared through a register."""
    words = sorted(set(w.encode() for w in words if w))
    states: list[tuple[bool, dict[int, int]]] = [(False, {})]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def close(upto: int) -> None:
        for depth in range(len(path) - 1, upto, -1):
            state = path.pop()
            final, arcs = states[state]
            key = (final, tuple(arcs.items()))
            same = register.setdefault(key, state)
            states[path[-1]][1][last[depth - 1]] = same

    for word in words:
        common = len(os.path.commonprefix([word, last]))
        close(common)
        last = word
        for b in word[common:]:
            states.append((False, {}))
            states[path[-1]][1][b] = len(states) - 1
            path.append(len(states) - 1)
        states[path[-1]] = (True, states[path[-1]][1])
    close(0)
    # Number the states that are left, children first, and count the words below each.
    below: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            if s not in below:
                below[s] = states[s][0] + sum(below[t] for t in states[s][1].values())
                order.append(s)
        elif s not in below:
            stack.append((s, True))
            stack += [(t, False) for t in states[s][1].values()]
    number = {s: k for k, s in enumerate(order)}
    first, labels, targets, skips, final = [0], [], [], [], []
    for s in order:
        ends, arcs = states[s]
        passed = int(ends)
        final.append(int(ends))
        for b, t in sorted(arcs.items()):
            labels.append(b)
            targets.append(number[t])
            skips.append(passed)
            passed += below[t]
        first.append(len(labels))
    ids = rules.merged_many([w.decode() for w in words])
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [first, labels, targets, skips, final, starts, [i for x in ids for i in x]]
    head = np.array([number[0], *map(len, arrays)], np.int32)
    return b"".join([head.tobytes(), *(np.asarray(a, np.int32).tobytes() for a in arrays)])


class Lexicon:
    """A memory-mapped transducer: ``ids(word)`` or None."""

    def __init__(self, image: bytes):
        handle, name = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(image)
            with open(name, "rb") as f:
                self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(name)
        head = np.frombuffer(self._map, np.int32, 8)
        self.root = int(head[0])
        at, views = 32, []
        for n in head[1:]:
            views.append(np.frombuffer(self._map, np.int32, int(n), at))
            at += 4 * int(n)
        first, labels, self.targets, self.skips, self.final, self.starts, self.all_ids = views
        # Arcs lie in order of state and label, so one sorted array finds the arc of any (state, label).
        self.arcs = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) * 256 + labels

    def ids_many(self, words: list[str]) -> list[list[int] | None]:
        """The ids of each word, or None: all words walk side by side, one byte a step."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.arcs) else np.zeros(0, np.int64)
        if not len(alive):
            return [None] * len(words)
        found = np.zeros(len(words), bool)
        step = 0
        while len(alive):
            ended = sizes[alive] == step
            stop = alive[ended]
            found[stop] = self.final[state[stop]] == 1
            alive = alive[~ended]
            key = state[alive] * 256 + flat[begin[alive] + step]
            arc = np.searchsorted(self.arcs, key)
            arc[arc == len(self.arcs)] = 0
            hit = self.arcs[arc] == key
            alive, arc = alive[hit], arc[hit]
            number[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            step += 1
        from_, to = self.starts[np.where(found, number, 0)].tolist(), self.starts[np.where(found, number + 1, 1)].tolist()
        return [self.all_ids[f:t].tolist() if ok else None for ok, f, t in zip(found.tolist(), from_, to, strict=True)]

    def ids(self, word: str) -> list[int] | None:
        return self.ids_many([word])[0]


class Codec:
    """What a worker needs: rules, lexicon and a bounded memory of words already looked up."""

    def __init__(self, path: str, image: bytes):
        self.rules, self.lexicon = Rules(path), Lexicon(image)
        self.ids_of: dict[str, str] = {}
        self.tokens_of: dict[str, str] = {}

    def learn(self, words: set[str]) -> None:
        """Look up words not yet known: in the lexicon, and what it lacks by merging."""
        new = list(words - self.ids_of.keys())
        if not new:
            return
        if len(self.ids_of) + len(new) > REMEMBERED:
            self.ids_of.clear()
            self.tokens_of.clear()
            new = list(words)
        found = self.lexicon.ids_many(new)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.rules.merged_many([new[k] for k in unseen]), strict=True):
            found[k] = ids
        tokens, numbers = self.rules.tokens, self.rules.numbers
        for w, ids in zip(new, found, strict=True):
            if len(ids) == 1:
                self.ids_of[w], self.tokens_of[w] = numbers[ids[0]], tokens[ids[0]]
            else:
                self.ids_of[w] = " ".join([numbers[i] for i in ids])
                self.tokens_of[w] = " ".join([tokens[i] for i in ids])

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """For each text the decimal ids joined by a space, the decoded text, and how many ids."""
        pieces = [list(self.rules.pieces(t)) for t in texts]
        needed: set[str] = set()
        for text in pieces:
            for words, _ in text:
                needed.update(words)
        self.learn(needed)
        for text in pieces:
            ids, tokens = [], []
            for words, special in text:
                if words:
                    ids.append(" ".join(map(self.ids_of.__getitem__, words)))
                    tokens.append(" ".join(map(self.tokens_of.__getitem__, words)))
                if special is not None:
                    ids.append(str(self.rules.added[special]))
                    tokens.append(special)
            joined = " ".join(ids)
            yield joined, " ".join(tokens), joined.count(" ") + 1 if joined else 0

    def encode(self, text: str) -> tuple[str, str, int]:
        return next(self.encode_many([text]))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(t for i in ids if (t := self.rules.tokens.get(i)) is not None)


_CODECS: dict[tuple[str, bytes], Codec] = {}


def codec(path: str, image: bytes) -> Codec:
    key = (path, sha256(image).digest())
    if key not in _CODECS:
        _CODECS.clear()  # one lexicon at a time
        _CODECS[key] = Codec(path, image)
    return _CODECS[key]


def frequent_words(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents, at most ``limit``: counted per task and summed in a shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, seen = Rules(path), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    for words, _ in rules.pieces(text):
                        seen.update(words)
            if len(seen) > REMEMBERED:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})

    counts = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.written(counts.filter("n > 1").withColumn("level", F.floor(16 * F.log2("n")).cast("int")), "lexicon")
    # Levels of frequency instead of a sort: a few hundred rows say which levels fit, and only their words are fetched.
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy("level").agg(F.count("*").alias("words")).collect()), reverse=True)
    room, lowest = limit, None
    for level, words in levels:
        if words > room:
            break
        room, lowest = room - words, level
    if lowest is None:
        return []
    return sorted(r["word"] for r in counts.filter(F.col("level") >= lowest).select("word").collect())


def lexicon(docs: DataFrame, path: str | None = None) -> bytes:
    path = path or default_vocabulary()
    return compile_lexicon(frequent_words(docs, path), Rules(path))


def encoded(docs: DataFrame, image: bytes, path: str | None = None, into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids as array<int> in the column ``into``, which replaces one of that name."""
    path, shared = path or default_vocabulary(), docs.sparkSession.sparkContext.broadcast(image)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        c = codec(path, shared.value)
        return pd.Series([[int(x) for x in c.encode(t or "")[0].split()] for t in text], dtype=object)

    return docs.withColumn(into, ids("text"))


def decoded(encoded_docs: DataFrame, image: bytes, path: str | None = None, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """The column ``ids`` decoded into ``into``, the tokens joined by spaces (special tokens are not skipped)."""
    path, shared = path or default_vocabulary(), encoded_docs.sparkSession.sparkContext.broadcast(image)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        c = codec(path, shared.value)
        return pd.Series([c.decode(x) if x is not None else None for x in column], dtype=object)

    return encoded_docs.withColumn(into, text(ids))


def digests(docs: DataFrame, image: bytes, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, in one pass over the texts."""
    path, shared = path or default_vocabulary(), docs.sparkSession.sparkContext.broadcast(image)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, shared.value)
        for pdf in batches:
            rows = []
            docs, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"]]
            for i in range(0, len(docs), TOGETHER):
                for doc, (ids, tokens, n) in zip(docs[i : i + TOGETHER], c.encode_many(texts[i : i + TOGETHER]), strict=True):
                    rows.append((doc, n, sha256(ids.encode()).hexdigest(), sha256(tokens.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    return digests(docs, lexicon(docs))
