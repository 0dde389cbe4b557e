"""Suffix-array dedup of 50-byte strings across documents (operator 7).

Every 50-byte window of a text belongs to the piece around its minimizer (the smallest hash of a 16-byte string in
it), so equal windows have equal minimizers.  First only the minimizers move, packed: those that two or more
documents have are sent back to their documents.  Then the pieces around these, and no others, move to the task of
their minimizer.  What many documents share is summed up before it moves: of a minimizer that two documents of a pack
of texts have, two places go to its task; of equal pieces in a pack, those in the smallest document, as that document
already says that the others go whole.  Each task joins equal pieces and builds the Burrows-Wheeler transform of the distinct ones.
Breadth-first backward extension then derives the common prefixes of neighbouring suffixes by increasing value and
stops at 50: neighbours not parted by then share 50 bytes, and of such a run of suffixes all but those in the
smallest document are marked.  The marks go back to the rows by doc_id and, where rows share a doc_id or have none, a
digest of the text, so that they keep their marks apart.  No pairs of documents are made.

Defined results: null text is empty; a text under 50 bytes keeps everything; of rows with equal doc_id none removes
from another (only a smaller doc_id does); a null doc_id counts as larger than any other; empty tables give empty
results; columns beside doc_id and text are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum

WINDOW = 50
ANCHOR = 16
SPAN = WINDOW - ANCHOR + 1
#: Bytes of pieces that one group should hold, before they are packed; the number of parts follows from the input.
PART_BYTES = 4_000_000
#: Parts that one task takes in turn (about 100 MB packed), fewer only where cores would idle.
TASK_PARTS = 256
#: Packs whose rows are merged before they meet those of other packs.
MERGED_PACKS = 4096
LAST_DOC = np.int64(2**63 - 1)
#: What a row is known by: its document, which alone decides who is smaller, and a digest of its text.
ROW = ["_doc", "_row"]
#: Minimizers are small: a task takes those of this many parts of pieces.
ANCHOR_PARTS = 12
#: Places of known minimizers in one row.
KNOWN_PLACES = 50_000
#: Bytes of text whose pieces are packed together.
PACK_BYTES = 8_000_000


def minimizers(data: np.ndarray, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start the position of the smallest 16-byte hash in it (the leftmost of equal ones), the hashes,
    and the prefix hash of the data.  ``most``: windows at once, so that a place fits in 24 bits."""
    prefix = textnum.prefix_hash(data, textnum.BYTE_VALUES)
    inverse = textnum.powers(textnum.INVERSE, len(data))
    n = len(data) - ANCHOR + 1
    hashed = textnum.mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * inverse[:n])
    windows = n - SPAN + 1
    place = [a + _leftmost(hashed[a : min(a + most, windows) + SPAN - 1]) for a in range(0, windows, most)]
    return np.concatenate(place), hashed, prefix


def _leftmost(hashed: np.ndarray) -> np.ndarray:
    """The place of the leftmost smallest of SPAN neighbours, by doubling: it is kept in the low bits of the hash."""
    low = np.uint64((1 << 24) - 1)
    best = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = SPAN - width
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    return (best & low).astype(np.int64)


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, anchor hash, hash) of the pieces: runs of windows with the same minimizer, each as a string."""
    lengths = np.diff(off)
    if len(data) < WINDOW or not (lengths >= WINDOW).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place, hashed, prefix = minimizers(data)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[: len(place)] == text[WINDOW - 1 :]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1 : len(place)] != text[: len(place) - 1])
    starts = np.flatnonzero(new & inside)
    after = np.zeros(len(place), bool)
    after[1:] = inside[:-1] & ~inside[1:]
    bounds = np.flatnonzero((new & inside) | after)
    bounds = np.append(bounds, len(place))
    ends = bounds[np.searchsorted(bounds, starts, "right")]
    length = ends - starts + WINDOW - 1
    return text[starts], starts, length, hashed[place[starts]], _ident(prefix, starts, length)


def _ident(prefix: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return textnum.mix(textnum.substring_hash(prefix, start, start + length)) ^ length.astype(np.uint64)


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after another."""
    total = int(length.sum())
    begin = np.cumsum(length) - length
    return data[np.repeat(start - begin, length) + np.arange(total)]


def _differences(at: np.ndarray, start: np.ndarray, length: np.ndarray | None = None) -> bytes:
    """Texts and starts as differences, which compress to a few bytes, and lengths where wanted."""
    parts = [np.diff(at, prepend=0).astype(np.int32).tobytes(), np.diff(start, prepend=0).astype(np.int32).tobytes()]
    return b"".join([*parts, length.astype(np.uint8).tobytes()] if length is not None else parts)


def _places(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, start = (np.cumsum(np.frombuffer(raw, np.int32, n, 4 * n * k), dtype=np.int64) for k in (0, 1))
    return at, start, np.frombuffer(raw, np.uint8, -1, 8 * n).astype(np.int64) if len(raw) > 8 * n else np.zeros(n, np.int64)


def _found(data: np.ndarray, off: np.ndarray):
    """Pieces of a pack of texts: text, start in the pack, length, anchor, hash."""
    found = [pieces(data[off[a] : off[b]], off[a : b + 1] - off[a]) + (off[a], a) for a, b, _, _ in textnum.blocks(data, off)]
    return (
        np.concatenate([f[0] + f[6] for f in found]), np.concatenate([f[1] + f[5] for f in found]),
        *(np.concatenate([f[k] for f in found]) for k in (2, 3, 4)),
    )


def _packs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ROW], 1)
        raw, off = textnum.buffers(batch.column("text"))
        for i, j, data, own in textnum.blocks(raw, off, PACK_BYTES):
            yield batch.slice(i, j - i), ids[i:j], data, own, *_found(data, own)


def _by_part(anchor: np.ndarray, parts: int):
    """Order that puts pieces together by part, and (part, from, to) of each."""
    part = (anchor >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    edges = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, list(zip(sorted_[edges].tolist(), edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True)) if len(part) else []


def _extremes(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the smallest and the largest document among those with its key."""
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    out = np.empty((2, len(key)), np.int64)
    out[:, order] = np.stack([np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)])[:, group]
    return out[0], out[1]


def _one_each(key: np.ndarray, where: np.ndarray) -> np.ndarray:
    """One of the places ``where`` for each key."""
    return where[np.unique(key[where], return_index=True)[1]]


def _any_part(row: np.ndarray, parts: int) -> int:
    """A part for what is only passed on: by the row, so that no part gets more than its share."""
    return int(textnum.mix((row[:1] ^ row[1:2]).view(np.uint64))[0] % np.uint64(parts))


_BINARY = pa.binary()
#: ``known``: rows that the part passes on to their documents, unlike those it has to compare.
ANCHORS_SCHEMA = pa.schema([("part", pa.int32()), ("docs", _BINARY), ("anchors", _BINARY), ("places", _BINARY), ("known", pa.bool_())])
PIECES_SCHEMA = ANCHORS_SCHEMA.append(pa.field("bytes", _BINARY))


Split = Callable[[np.ndarray], tuple[np.ndarray, list[tuple[int, int, int]]]]


def _as_it_is(part: int) -> Split:
    """All minimizers are of one part."""
    return lambda anchor: (np.arange(len(anchor)), [(part, 0, len(anchor))] if len(anchor) else [])


def _anchor_rows(docs: np.ndarray, own: np.ndarray, text: np.ndarray, start: np.ndarray, anchor: np.ndarray, split: Split, parts: int) -> dict[str, list]:
    """Of minimizers that two documents have, one place in the smallest and one in the largest go to their part, the
    others are passed on; of the rest, all go to their part.  ``own``: where each text begins, ``start`` counts from 0."""
    shrink = zstandard.ZstdCompressor(level=3)
    rows: dict[str, list] = {n: [] for n in ANCHORS_SCHEMA.names}
    doc = docs[text, 0]
    least, most = _extremes(anchor, doc)
    sent = least == most
    for end in (least, most):
        sent[_one_each(anchor, np.flatnonzero((doc == end) & (least != most)))] = True
    passed = np.flatnonzero(~sent)
    for k in range(0, len(passed), KNOWN_PLACES):
        one = passed[k : k + KNOWN_PLACES]
        used, at = np.unique(text[one], return_inverse=True)
        rows["part"].append(_any_part(docs[used[0]], parts))
        rows["docs"].append(shrink.compress(docs[used].tobytes()))
        rows["anchors"].append(b"")
        rows["places"].append(shrink.compress(_differences(at, start[one] - own[text[one]])))
        rows["known"].append(True)
    text, start, anchor = text[sent], start[sent], anchor[sent]
    order, groups = split(anchor)
    text, start, anchor = text[order], start[order], anchor[order]
    for part, a, b in groups:
        used, at = np.unique(text[a:b], return_inverse=True)
        rows["part"].append(part)
        rows["docs"].append(shrink.compress(docs[used].tobytes()))
        rows["anchors"].append(anchor[a:b].astype(np.uint32).tobytes())
        rows["places"].append(shrink.compress(_differences(at, start[a:b] - own[text[a:b]])))
        rows["known"].append(False)
    return rows


def packed_anchors(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Minimizers by part: one row per pack of texts and part, and those that are passed on."""
    for _, docs, _, own, text, start, _, anchor, _ in _packs(batches):
        if len(text):
            yield pa.RecordBatch.from_pydict(_anchor_rows(docs, own, text, start, anchor, lambda a: _by_part(a, parts), parts), ANCHORS_SCHEMA)


def _piece_rows(
    docs: np.ndarray, own: np.ndarray, data: np.ndarray, begin: np.ndarray, text: np.ndarray, start: np.ndarray,
    length: np.ndarray, anchor: np.ndarray, ident: np.ndarray, split: Split, parts: int,
) -> dict[str, list]:
    """Of equal pieces, those in the smallest document go to their part: all windows of the others start in that document
    too, so they are repeated from end to end and their spans are passed on.  ``begin``: where a piece stands in ``data``."""
    shrink = zstandard.ZstdCompressor(level=3)
    rows: dict[str, list] = {n: [] for n in PIECES_SCHEMA.names}
    doc = docs[text, 0]
    sent = _extremes(ident, doc)[0] == doc
    passed = np.flatnonzero(~sent)
    if len(passed):
        of, low, high = _merged(text[passed], start[passed], start[passed] + length[passed])
        rows["part"].append(_any_part(docs[of[0]], parts))
        rows["docs"].append(shrink.compress(docs[of].tobytes()))
        rows["anchors"].append(b"")
        rows["places"].append(shrink.compress(np.stack([low - own[of], high - low], 1).tobytes()))
        rows["known"].append(True)
        rows["bytes"].append(b"")
    text, start, length, anchor, begin = text[sent], start[sent], length[sent], anchor[sent], begin[sent]
    order, groups = split(anchor)
    text, start, length, anchor, begin = text[order], start[order], length[order], anchor[order], begin[order]
    for part, a, b in groups:
        used, at = np.unique(text[a:b], return_inverse=True)
        rows["part"].append(part)
        rows["docs"].append(shrink.compress(docs[used].tobytes()))
        rows["anchors"].append(anchor[a:b].astype(np.uint32).tobytes())
        rows["places"].append(shrink.compress(_differences(at, start[a:b] - own[text[a:b]], length[a:b])))
        rows["known"].append(False)
        rows["bytes"].append(shrink.compress(_gather(data, begin[a:b], length[a:b]).tobytes()))
    return rows


def packed_pieces(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Pieces around shared minimizers by part.  Column ``starts``: packed starts."""
    for batch, docs, data, own, text, start, length, anchor, ident in _packs(batches):
        wanted = [
            np.frombuffer(x, np.uint32).astype(np.int64) + own[k] for k, x in enumerate(batch.column("starts").to_pylist()) if x
        ]
        keep = np.isin(start, np.concatenate(wanted)) if wanted else np.zeros(len(start), bool)
        text, start, length, anchor, ident = text[keep], start[keep], length[keep], anchor[keep], ident[keep]
        if len(text):
            yield pa.RecordBatch.from_pydict(
                _piece_rows(docs, own, data, start, text, start, length, anchor, ident, lambda a: _by_part(a, parts), parts), PIECES_SCHEMA
            )


def merged_packs(rows: pa.Table, parts: int) -> pa.Table:
    """What several packs send to one part, as one pack of all their texts would send it; rows that are passed on stay.

    So a minimizer sends two places, and a piece those of its smallest document, for all these packs.  The order in
    which the rows arrive does not matter."""
    schema = PIECES_SCHEMA if "bytes" in rows.column_names else ANCHORS_SCHEMA
    rows = rows.select(schema.names).cast(schema)
    known = rows.column("known").to_numpy()
    new = rows.filter(pa.array(~known)).to_pylist()
    if len(new) < 2:
        return rows
    ids, anchor, start, length = _unpacked(new)
    docs, text = np.unique(ids, axis=0, return_inverse=True)
    text = text.reshape(-1)
    own = np.arange(len(docs), dtype=np.int64) << 32  # texts one after another, none over 2^31 bytes
    order = np.lexsort((start, text))
    split = _as_it_is(new[0]["part"])
    if schema is ANCHORS_SCHEMA:
        text, start, anchor = text[order], start[order], anchor[order]
        out = _anchor_rows(docs, own, text, start + own[text], anchor, split, parts)
    else:
        grow = zstandard.ZstdDecompressor()
        data = np.concatenate([np.frombuffer(grow.decompress(r["bytes"]), np.uint8) for r in new])
        begin = np.cumsum(length) - length
        ident = _ident(textnum.prefix_hash(data, textnum.BYTE_VALUES), begin, length)
        text, start, length, anchor, begin, ident = (x[order] for x in (text, start, length, anchor, begin, ident))
        out = _piece_rows(docs, own, data, begin, text, start + own[text], length, anchor, ident, split, parts)
    return pa.concat_tables([rows.filter(pa.array(known)), pa.Table.from_pydict(out, schema)])


def _merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the runs that the spans cover."""
    order = np.argsort(start, kind="stable")
    text, start, end = text[order], start[order], np.maximum.accumulate(end[order])
    at = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (text[1:] != text[:-1])))
    return text[at], start[at], np.append(end[at[1:] - 1], end[-1])


def _unpacked(rows: list[dict]):
    """row (doc, digest), anchor, start and length of the pieces of a part."""
    grow = zstandard.ZstdDecompressor()
    places = [_places(raw, len(r["anchors"]) // 4 or len(raw) // 8) for r in rows for raw in [grow.decompress(r["places"])]]
    return (
        np.concatenate([np.frombuffer(grow.decompress(r["docs"]), np.int64).reshape(-1, 2)[p[0]] for r, p in zip(rows, places, strict=True)]),
        np.concatenate([np.frombuffer(r["anchors"], np.uint32) for r in rows]),
        np.concatenate([p[1] for p in places]), np.concatenate([p[2] for p in places]),
    )


def _shared(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Places, ascending, of the pieces whose minimizer more than one document has (32 bits: a clash keeps more)."""
    order = np.lexsort((doc, anchor))
    new = np.append(True, anchor[order][1:] != anchor[order][:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return np.sort(order[(doc[order][first] != doc[order][last])[group]])


def _by_bucket(ids: np.ndarray, values: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket of rows: their ids and values packed, without repeats (rows alike in id and text)."""
    bucket = (textnum.mix((ids[:, 0] ^ ids[:, 1]).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    columns = [*np.atleast_2d(values.T), ids[:, 1], ids[:, 0], bucket]
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[order][1:] != column[order][:-1]
    bucket, ids, values = bucket[order][new], ids[order][new], values[order][new]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(ids) else np.zeros(0, np.int64)
    shrink = zstandard.ZstdCompressor(level=3)
    pieces_ = list(zip(edges, np.append(edges[1:], len(ids)), strict=True)) if len(ids) else []
    return pa.table({
        "bucket": pa.array(bucket[edges], pa.int32()), "docs": pa.array([shrink.compress(ids[a:b].tobytes()) for a, b in pieces_], _BINARY),
        "values": pa.array([shrink.compress(values[a:b].tobytes()) for a, b in pieces_], _BINARY),
    })


def _per_row(rows: pa.Table, dtype: type, width: int, name: str) -> pa.Table:
    """One row per row of a bucket: its values packed."""
    grow = zstandard.ZstdDecompressor()
    ids = np.frombuffer(b"".join(map(grow.decompress, rows.column("docs").to_pylist())), np.int64).reshape(-1, 2)
    values = np.frombuffer(b"".join(map(grow.decompress, rows.column("values").to_pylist())), dtype).reshape(-1, width)
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ids, values = ids[order], values[order]
    edges = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1)))
    return pa.table({
        "_doc": pa.array(ids[edges, 0], pa.int64()), "_row": pa.array(ids[edges, 1], pa.int64()),
        name: pa.array([values[a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(ids)), strict=True)], _BINARY),
    })


def _shared_of_part(rows: pa.Table, buckets: int) -> pa.Table:
    packed = rows.to_pylist()
    known, new = [r for r in packed if r["known"]], [r for r in packed if not r["known"]]
    found = [(x[0], x[2]) for x in ([_unpacked(known)] if known else [])]
    if new:
        ids, anchor, start, _ = _unpacked(new)
        keep = _shared(ids[:, 0], anchor)
        found.append((ids[keep], start[keep]))
    return _by_bucket(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.uint32), buckets)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling of what is not yet told apart.  ``data``: symbols, every piece ended by a 0.

    Suffixes that are equal to the ends of their pieces come in the order of the pieces, as if terminators rose.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, data.dtype)])
    ends = np.flatnonzero(data == 0)
    room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the terminator
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(8)
        key |= np.where(room > k, padded[k : k + n] - 1, 0).astype(np.uint64)
    # Low byte: how many symbols count, so that a shorter piece sorts first.
    key = (key << np.uint64(8)) | np.minimum(room, 7).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    sorted_, slots = key[order], np.arange(n)
    rank = np.empty(n, np.int32)
    h, longest = 7, int(room.max()) if n else 0
    while True:
        # A suffix's rank is the first slot of those that equal it so far; what stands alone is in its place.
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        at = order[slots]
        if not len(at) or h > longest:
            break
        key = _pairs(rank[at], np.where(room[at] >= h, rank[np.minimum(at + h, n - 1)] + 1, 0))
        best = np.argsort(key)
        order[slots], sorted_ = at[best], key[best]
        h *= 2
    # Equal ones in order of their places, so that what stands before them is in the same order.
    order[slots] = np.sort(_pairs(rank[at], at)) & np.uint64(0xFFFFFFFF)
    return order


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def _extended(low: np.ndarray, high: np.ndarray, before: np.ndarray, to: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of c + w for every interval [low, high] of a string w and every symbol c that stands before w.

    ``before``: the transform; ``to``: the rank of the suffix one symbol longer; ``symbol``: the first one by rank.
    """
    alone = low == high
    one = low[alone]
    one = to[one[before[one] > 0]]
    low, high = low[~alone], high[~alone]
    size = high - low + 1
    begin = np.cumsum(size) - size
    places = np.repeat(low - begin, size) + np.arange(int(size.sum()))
    real = before[places] > 0
    rank, of = to[places[real]], np.repeat(np.arange(len(low), dtype=np.int32), size)[real]
    if not len(rank):
        return one, one
    order = np.argsort(rank)
    rank, of = rank[order], of[order]
    first = symbol[rank]
    new = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1] + 1) | (of[1:] != of[:-1]) | (first[1:] != first[:-1])))
    return np.concatenate([one, rank[new]]), np.concatenate([one, rank[np.append(new[1:], len(rank)) - 1]])


def common_prefix_classes(data: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``data`` and, by rank, whether a suffix shares fewer than ``least`` bytes with the one before.

    Breadth-first over the Burrows-Wheeler transform: the queue holds the intervals of strings of one length, and
    extending them to the left gives those that are one symbol longer.  The right end of an interval of length l + 1
    that no shorter string has ended is where neighbours share l bytes; only such intervals are extended again.  So
    the prefixes come out by increasing length, every boundary once, and the search stops at ``least``; the suffix
    array only tells where the suffixes stand.
    """
    sa = suffix_order(data)
    n = len(sa)
    inverse = np.empty(n, np.int32)
    inverse[sa] = np.arange(n, dtype=np.int32)
    symbol = data[sa]
    before = np.where(sa > 0, data[sa - 1], 0)
    to = inverse[sa - 1]
    ended = np.zeros(n + 1, bool)
    ended[[0, n]] = True
    # Strings of one symbol; terminators all differ.
    low = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)))
    high = np.append(low[1:], n) - 1
    ended[low] = True
    for _ in range(1, least):
        low, high = _extended(low, high, before, to, symbol)
        fresh = ~ended[high + 1]
        low, high = low[fresh], high[fresh]
        ended[high + 1] = True
        if not len(low):
            break
    return sa, ended[:n]


def repeated(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the spans covered by 50-byte strings that also start in a smaller document.

    ``rows``: the packed pieces of one part.
    """
    grow = zstandard.ZstdDecompressor()
    ids, anchor, start, length = _unpacked(rows)
    data = np.concatenate([np.frombuffer(grow.decompress(r["bytes"]), np.uint8) for r in rows])
    begin = np.cumsum(length) - length
    keep = _shared(ids[:, 0], anchor)
    none = np.zeros(0, np.int64)
    if not len(keep):
        return none.reshape(0, 2), none, none
    ids, anchor, length, start, begin = ids[keep], anchor[keep], length[keep], start[keep], begin[keep]
    doc = ids[:, 0]
    data = _gather(data, begin, length)
    begin = np.cumsum(length) - length
    # Equal pieces become one, with the smallest document that has it.
    prefix = textnum.prefix_hash(data, textnum.BYTE_VALUES)
    ident = _ident(prefix, begin, length)
    del prefix
    _, at, inverse = np.unique(ident, return_index=True, return_inverse=True)
    least = np.full(len(at), LAST_DOC)
    np.minimum.at(least, inverse, doc)
    # The transform over the distinct pieces; symbols are shifted by one so that 0 ends a piece.
    size = length[at]
    joined = np.zeros(int(size.sum()) + len(at), np.uint16)
    own = np.cumsum(size + 1) - (size + 1)
    places = np.repeat(own - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    joined[places] = _gather(data, begin[at], size).astype(np.uint16) + 1
    sa, parted = common_prefix_classes(joined)
    cls = np.cumsum(parted) - 1
    piece = np.repeat(np.arange(len(at)), size + 1)
    held = np.full(int(cls[-1]) + 1, LAST_DOC)
    np.minimum.at(held, cls, least[piece[sa]])
    smallest = np.empty(len(joined), np.int64)
    smallest[sa] = held[cls]
    # Every occurrence: windows of its piece whose string a smaller document has.
    count = length - WINDOW + 1
    total = int(count.sum())
    base = np.cumsum(count) - count
    offset = np.arange(total) - np.repeat(base, count)
    hit = smallest[np.repeat(own[inverse], count) + offset] < np.repeat(doc, count)
    owner = np.repeat(np.arange(len(doc)), count)
    edge = np.ones(total, bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], total)
    good = hit[runs]
    runs, ends = runs[good], ends[good]
    return ids[owner[runs]], start[owner[runs]] + offset[runs], ends - runs + WINDOW - 1


def _spans_of_part(rows: pa.Table, buckets: int) -> pa.Table:
    packed = rows.to_pylist()
    known = [r for r in packed if r["known"]]
    grow = zstandard.ZstdDecompressor()
    ids = [np.frombuffer(grow.decompress(r["docs"]), np.int64).reshape(-1, 2) for r in known]
    values = [np.frombuffer(grow.decompress(r["places"]), np.int64).reshape(-1, 2) for r in known]
    if len(known) < len(packed):
        row, start, length = repeated([r for r in packed if not r["known"]])
        ids.append(row)
        values.append(np.stack([start, length], 1))
    return _by_bucket(np.concatenate(ids), np.concatenate(values), buckets)


def union(spans: bytes) -> list[tuple[int, int]]:
    """Maximal runs [a, b) covered by the packed spans."""
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    start = pairs[:, 0]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((pairs[:, 0] + pairs[:, 1])[order])
    new = np.append(True, start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), np.append(end[at[1:] - 1], end[-1]).tolist(), strict=True))


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in runs:
        out.append(text[last:a])
        last = b
    out.append(text[last:])
    return b"".join(out)


def _by_task(packed: DataFrame, parts: int, merges: int, schema: str) -> DataFrame:
    """``packed`` grouped by part; a task takes its parts in turn.  With ``merges`` over 1 the rows of a part are first
    merged in that many groups, so that no minimizer sends a part more than two places for each."""
    cores = packed.sparkSession.sparkContext.defaultParallelism
    tasks = min(parts, max(32 * cores, -(-parts // TASK_PARTS)))
    if merges > 1:
        salted = packed.withColumn("salt", F.pmod(F.xxhash64("docs"), F.lit(merges)).cast("int"))
        groups = salted.repartition(min(parts * merges, max(32 * cores, tasks)), "part", "salt").groupBy("part", "salt")
        packed = groups.applyInArrow(lambda rows: merged_packs(rows, parts), schema)
    return packed.repartition(tasks, "part").groupBy("part")


def spans(docs: DataFrame, parts: int | None = None, merges: int | None = None, moved: DataFrame | None = None) -> DataFrame:
    """(_doc, _row, spans): for each row with something to remove, the packed spans.

    ``docs``: _doc and _row (not null) and text.  ``moved``: the same rows as ``_squeezed`` gives them, with whatever else
    the caller joins the spans to: as both joins then read the same columns, Spark shuffles the texts once.  The numbers of
    parts and of merged groups follow the bytes of the texts.
    """
    moved = _squeezed(docs) if moved is None else moved
    if parts is None or merges is None:
        size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
        parts = parts or max(docs.sparkSession.sparkContext.defaultParallelism, -(-size * 4 // PART_BYTES))
        merges = merges or max(1, -(-size // (MERGED_PACKS * PACK_BYTES)))
    few = max(1, parts // ANCHOR_PARTS)
    packed, bucketed = "part int, docs binary, anchors binary, places binary, known boolean", "bucket int, docs binary, values binary"

    def shared_of_part(rows: pa.Table) -> pa.Table:
        return _shared_of_part(rows, few)

    def spans_of_part(rows: pa.Table) -> pa.Table:
        return _spans_of_part(rows, few)

    def starts_of(rows: pa.Table) -> pa.Table:
        return _per_row(rows, np.uint32, 1, "starts")

    def spans_of(rows: pa.Table) -> pa.Table:
        return _per_row(rows, np.int64, 2, "spans")

    anchors = docs.select(*ROW, "text").mapInArrow(lambda b: packed_anchors(b, few), packed)
    shared = _by_task(anchors, few, merges, packed).applyInArrow(shared_of_part, bucketed)
    starts = shared.groupBy("bucket").applyInArrow(starts_of, "_doc long, _row long, starts binary")
    rows = moved.join(starts, ROW)
    cut = rows.mapInArrow(lambda b: packed_pieces(textnum.expanded_batches(b, PACK_BYTES), parts), f"{packed}, bytes binary")
    found = _by_task(cut, parts, merges, f"{packed}, bytes binary").applyInArrow(spans_of_part, bucketed)
    return found.groupBy("bucket").applyInArrow(spans_of, "_doc long, _row long, spans binary")


def _digest(raw: bytes, found: bytes | None) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and kept_sha256 of a text."""
    runs = union(found) if found else []
    kept = cut(raw, runs)
    return len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(doc, *_digest((text or "").encode(), found)) for doc, text, found in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True)]
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _digests_of_squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_digests`` of doc_id, compressed text and spans."""
    for batch in batches:
        out = [_digest(raw, found) for raw, found in zip(textnum.expanded(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        columns = [pa.array([row[k] for row in out], pa.string() if k == 3 else pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_text(text: pa.Array, found: pa.Array) -> pa.Array:
    """Compressed texts, opened, without their repeated bytes; a character that is cut in two goes whole."""
    whole, null = textnum.expanded(text), text.is_null().to_pylist()
    return pa.array(
        [
            None if none else cut(t, union(f)).decode("utf-8", "ignore").encode() if f else t
            for t, f, none in zip(whole, found.to_pylist(), null, strict=True)
        ],
        pa.binary(),
    )


def _whole_text(text: pa.Array) -> pa.Array:
    null = text.is_null().to_pylist()
    return pa.array([None if none else t for t, none in zip(textnum.expanded(text), null, strict=True)], pa.binary())


def _keyed(docs: DataFrame) -> DataFrame:
    """text and the other columns, as _0, _1 and so on, with the key of the row: its document (nulls last) and, where the
    table has rows that share or lack an id, a digest of the text."""
    digest = F.xxhash64("text")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").isEmpty():
        digest = F.when(F.col("doc_id").isNull(), digest).otherwise(F.lit(0).cast("long"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_DOC)))
    return docs.select(doc.alias("_doc"), digest.alias("_row"), "text", *[F.col(c).alias(n) for c, n in _others(docs).items()])


def _others(docs: DataFrame) -> dict[str, str]:
    """The columns beside text, and their names while they move."""
    return {c: f"_{k}" for k, c in enumerate(c for c in docs.columns if c != "text")}


def _squeezed(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("text", F.arrow_udf(textnum.squeezed, "binary")("text"))


def _marked(docs: DataFrame) -> DataFrame:
    """The columns of ``_keyed``, text compressed, and ``spans``, packed spans to remove or null.

    The columns are apart, not a struct: of a struct Spark would move only the fields that are read later, so that the
    rows of the two joins would differ and the texts move twice."""
    keyed = _keyed(docs)
    moved = _squeezed(keyed)
    return moved.join(spans(keyed, moved=moved), ROW, "left")


def with_spans(docs: DataFrame) -> DataFrame:
    """``text``, ``row`` (the other columns of ``docs``) and ``spans``, packed spans to remove or null."""
    row = F.struct(*[F.col(n).alias(c) for c, n in _others(docs).items()]).alias("row")
    return _marked(docs).select(row, F.arrow_udf(_whole_text, "binary")("text").cast("string").alias("text"), "spans")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated 50-byte strings cut from ``text``; all rows and columns stay, n_chars follows the text."""
    others = docs.drop("n_chars")
    names = _others(others)
    kept = F.arrow_udf(_kept_text, "binary")("text", "spans").cast("string").alias("kept")
    out = _marked(others).select(kept, *names.values())
    follow: dict[str, Column] = {"text": F.col("kept")} | {c: F.col(n) for c, n in names.items()}
    if "n_chars" in docs.columns:
        follow["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[follow[c].alias(c) for c in docs.columns])


def op7_repeated_strings(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = _marked(docs).select(_others(docs)["doc_id"], "text", "spans")
    return marked.mapInArrow(_digests_of_squeezed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP7_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc,
         strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
chunks AS (
  SELECT r, doc, start, substr(h, 2 * start + 1, 2 * (256 + 49)) AS c
  FROM (SELECT *, unnest(range(0, n - 49, 256)) AS start FROM texts)),
strings AS (
  SELECT r, doc, start + k AS i, substr(c, 2 * k + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, least(256, strlen(c) // 2 - 49))) AS k FROM chunks)),
firsts AS (SELECT s, min(doc) AS doc FROM strings GROUP BY s),
hits AS (SELECT r, i FROM strings JOIN firsts USING (s) WHERE firsts.doc < strings.doc),
marked AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS new FROM hits),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, run),
ends AS (SELECT r, a, b FROM runs UNION ALL SELECT r, n, n FROM texts),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS since, a AS upto FROM ends),
kept AS (
  SELECT r, sum(upto - since) AS n_kept, count(*) - 1 AS n_spans,
         coalesce(string_agg(substr(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since), '') AS h
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, (n - n_kept)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM texts JOIN kept USING (r)
"""
