"""Conversation structure repair over a suffix-shared automaton (operator 13).

Every row of a conversation becomes one symbol, its role (s, u, a, other) and its first fault; a conversation becomes
the string of its symbols.  Conversations with one signature are solved once, and signatures that end alike share what
lies at the end: two places from which the same symbols follow are one node of the automaton.  Signatures sorted from
their end pass through the nodes in the order of a depth-first walk, so a stack of the current path is all that a task
holds; each node gets its cost-to-go and the first edit of its best audit suffix once per grammar state.  A grammar
state allows each edit in one way only, so options of equal cost differ in their first letter and the least letter
gives the least audit.

Rows: the order inside a conversation is turn (nulls first), then role, then the MD5 of the text.  That order is built
by ranges, so one conversation may spread over many tasks.  What one task must see whole is what one result row holds:
the signature and the audit (one byte per row each), and, for the digest of the repaired text, the texts of the
conversation streamed through one hash.

Defined results: a null role or text is one space, in the key of the damage a null id or turn too; a null ``conv_id`` is a
conversation of its own; repeated rows count as rows; rows with equal turns follow role, then MD5; a conversation without
rows after the damage has zeros and empty results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

BLANK = r"[\x20\x09-\x0D]"
ROLES = "sua"
OK, TRUNCATED, BLANKED, DUPLICATE = range(4)
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: Grammar states: before anything, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that an added or given role leads to, and that role.
FORWARD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
GIVEN = (b"user", b"user", b"assistant", b"user")
#: (cost, first letter) of each state where no row is left.
END = ((0, ""), (2 * INSERT, "I"), (INSERT, "I"), (0, ""))
LEGAL = ("su", "ua", "au")
#: Characters of a signature that decide the range it is sorted in; all of them decide its place there.
RANGE_KEY = 64


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of copies (0: dropped) after the damage."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with the digest that orders equal turns."""
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def symbols(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text): how often it stands there, its first symbol, that of its copies."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?]" + BLANK + r"*\z")
    light = _kept(rows).select("conv_id", "turn", "role", "digest", "copies", blank.alias("blank"), cut.alias("cut"))
    once = light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # Only texts that stand at several turns have to be looked up; their first turn is the one that is no duplicate.
    again = once.filter("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_t"), F.lit(True).alias("_again"))
    both = once.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    later = F.coalesce(F.col("_again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_t"))
    role = F.position(F.substring("role", 1, 1), F.lit(ROLES))
    role = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)
    letter = lambda fault: F.lower(F.hex((fault * 4 + role).cast("long")))
    return both.select(
        "conv_id", "turn", "role", "digest", "n",
        letter(F.when(F.col("blank"), BLANKED).when(later, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(OK)).alias("symbol"),
        letter(F.when(F.col("blank"), BLANKED).otherwise(DUPLICATE)).alias("copy"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per conversation and partition."""
    began, conv, part, parts = False, None, 0, []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = [[r[k] for r in out] for k in range(3)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["conv_id", "part", "piece"])

    for rows in batches:
        for c, p, n, symbol, copy in zip(*(rows.column(k).to_pylist() for k in range(5)), strict=True):
            if not began or c != conv:
                if began:
                    out.append((conv, part, "".join(parts)))
                began, conv, part, parts = True, c, p, []
            if n:
                parts.append(symbol + copy * (n - 1))
        if len(out) > 5000:
            yield batch()
    if began:
        out.append((conv, part, "".join(parts)))
        yield batch()


def signatures(marked: DataFrame) -> DataFrame:
    """conv_id and signature.  ``marked``: what ``symbols`` gives, stored."""
    order = ["conv_id", "turn", "role", "digest"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.select("conv_id", F.spark_partition_id().alias("part"), "n", "symbol", "copy").mapInArrow(_packed, "conv_id long, part int, piece string")
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece"))), lambda p: p["piece"]), "").alias("signature"))


def node(symbol: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost-to-go of the four states before a row, from those after it, and the first edit of each."""
    fault, role = divmod(symbol, 4)
    best = []
    for state in range(4):
        options = [(DELETE + after[state], "D")]
        if fault in (OK, TRUNCATED):
            extra = UNFINISHED if fault == TRUNCATED else 0
            if role < 3 and (state, role) in ((START, 0), (START, 1), (AFTER_S, 1), (AFTER_U, 2), (AFTER_A, 1)):
                options.append((extra + after[role + 1], "K"))
            options.append((REROLE + extra + after[FORWARD[state]], "R"))
        best.append(min(options))
    # Adding a turn leads to another state before the same row; adding two leads from u and a back, so one is enough.
    u, a = best[AFTER_U], best[AFTER_A]
    best[AFTER_U], best[AFTER_A] = min(u, (INSERT + a[0], "I")), min(a, (INSERT + u[0], "I"))
    for state in (START, AFTER_S):
        best[state] = min(best[state], (INSERT + best[AFTER_U][0], "I"))
    return tuple(c for c, _ in best), "".join(e for _, e in best)


class Automaton:
    """The nodes on the current path, from the end of a signature; nodes of equal relative costs are worked out once."""

    def __init__(self) -> None:
        self.before = ""
        self.known: dict = {}
        costs = tuple(c for c, _ in END)
        #: Per node: least cost, costs above it, first edits, then how many rows are blank, duplicate, truncated, illegal.
        self.path: list[tuple] = [(min(costs), costs, "", 0, 0, 0, 0)]

    def solve(self, signature: str) -> tuple[int, int, int, int, int, str]:
        """blank, duplicate, truncated, illegal, cost and audit."""
        back = signature[::-1]
        same = 0
        for x, y in zip(back, self.before, strict=False):
            if x != y:
                break
            same += 1
        del self.path[same + 1 :]
        for k in range(same, len(back)):
            base, costs, _, *faults = self.path[-1]
            symbol = int(back[k], 16)
            if (symbol, costs) not in self.known:
                new, edits = node(symbol, costs)
                self.known[symbol, costs] = min(new), tuple(c - min(new) for c in new), edits
            more, new, edits = self.known[symbol, costs]
            fault = symbol // 4
            pair = k and ("suax"[symbol % 4] + "suax"[int(back[k - 1], 16) % 4]) not in LEGAL
            add = (fault == BLANKED, fault == DUPLICATE, fault == TRUNCATED, bool(pair))
            self.path.append((base + more, new, edits, *(a + b for a, b in zip(faults, add, strict=True))))
        self.before = back
        base, costs, _, blank, duplicate, truncated, illegal = self.path[-1]
        return blank, duplicate, truncated, illegal, base + costs[START], self.audit(signature)

    def audit(self, signature: str) -> str:
        state, at, out = START, len(signature), []
        while at:
            edit = self.path[at][2][state]
            out.append(edit)
            if edit == "K":
                state = int(signature[len(signature) - at], 16) % 4 + 1
            elif edit != "D":
                state = FORWARD[state]
            at -= edit != "I"
        out += {AFTER_S: "II", AFTER_U: "I"}.get(state, "")
        return "".join(out)


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for rows in batches:
        given = rows.column(0).to_pylist()
        found = [automaton.solve(s) for s in given]
        columns = [pa.array([f[k] for f in found], pa.int64() if k < 5 else pa.string()) for k in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(given, pa.string()), *columns], [c.split()[0] for c in SOLVED.split(", ")])


def solved(convs: DataFrame) -> DataFrame:
    """Faults, cost and audit of each distinct signature of ``convs``."""
    back = F.reverse("signature")
    distinct = convs.select("signature").distinct()
    ranged = distinct.repartitionByRange(F.substring(back, 1, RANGE_KEY)).sortWithinPartitions(back)
    return ranged.mapInArrow(_solved, SOLVED)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Repair:
    """The repaired text of one conversation on its way through a hash."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, START, hashlib.sha256(), True

    def line(self, role: bytes, text: bytes) -> None:
        if not self.first:
            self.sha.update(b"\n")
        self.first = False
        self.sha.update(role + b":")
        self.sha.update(text)

    def added(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(GIVEN[self.state], b"")
            self.state = FORWARD[self.state]
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self.added()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text)
            self.state = ROLES.index(role[:1].decode()) + 1
        elif edit == "R":
            self.line(GIVEN[self.state], text)
            self.state = FORWARD[self.state]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its result first: the result with the digest of the repaired text."""
    now, row, out = None, None, []

    def end() -> None:
        if now is not None:
            now.added()
            out.append((*row, now.sha.hexdigest()))

    def batch() -> pa.RecordBatch:
        cols = [pa.array([r[k] for r in out], pa.string() if k > 6 else pa.int64()) for k in range(9)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RESULT.split(", ")])

    for rows in batches:
        kind, copies, role, text = (rows.column(c).to_pylist() for c in ("kind", "copies", "role", "text"))
        for k in range(len(rows)):
            if kind[k] == 0:
                end()
                row = tuple(rows.column(c)[k].as_py() for c in ("conv_id", *_NUMBERS, "audit"))
                now = _Repair(row[-1])
            else:
                for _ in range(copies[k]):
                    now.row(role[k], text[k])
        if len(out) > 5000:
            yield batch()
    end()
    if out:
        yield batch()


def repaired(rows: DataFrame, owner: str = "conversations") -> DataFrame:
    """``rows``: conv_id, turn, role, text, copies.  One row per conv_id: its faults, the cheapest repair, its digest."""
    marked = scratch.written(symbols(rows), owner)
    turn = F.when(F.col("n") > 0, F.col("turn"))
    gaps = marked.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    convs = scratch.written(signatures(marked), owner)
    gaps = gaps.withColumnRenamed("conv_id", "_c")
    known = convs.join(solved(convs), "signature").join(gaps, F.col("conv_id").eqNullSafe(F.col("_c")))
    none = lambda kind: F.lit(None).cast(kind)
    heads = known.select(
        "conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("binary").alias("role"), none("binary").alias("digest"), none("binary").alias("text"),
        F.lit(0).alias("copies"), *_NUMBERS, "audit",
    )
    texts = _kept(rows).filter("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", F.col("role").cast("binary").alias("role"), "digest", F.col("text").cast("binary").alias("text"),
        "copies", *[none("long").alias(c) for c in _NUMBERS], none("string").alias("audit"),
    )
    together = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return together.mapInArrow(_hashed, RESULT)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(scratch.table(spark, sf_dir, "conversations")), "op13")


# The CRC table comes from its polynomial.  Backward over the rows of all conversations at once: for each of the four
# states the least (cost, audit), kept as one string of six digits, a bar and the audit.
OP13_SQL = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i, 0 AS step, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_bits WHERE step = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(crcs[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS kind
  FROM given, crc_table),
after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS stem
  FROM after),
faults AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS i_before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
              WHEN NOT regexp_matches(right(stem, 1), '[.!?]') THEN 't' ELSE 'k' END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pos > 1 AND (i_before || i) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
back AS (
  SELECT conv_id, n AS pos, '000000|' AS b0, '000006|II' AS bs, '000003|I' AS bu, '000000|' AS ba FROM counted
  UNION ALL
  SELECT conv_id, pos - 1, least(d0, iu0) AS b0, least(ds, iu0) AS bs, least(du, ia) AS bu, least(da, iu) AS ba
  FROM (
    SELECT *, printf('%06d|I%s', split_part(da, '|', 1)::INT + 3, split_part(da, '|', 2)) AS ia,
           printf('%06d|I%s', split_part(du, '|', 1)::INT + 3, split_part(du, '|', 2)) AS iu,
           printf('%06d|I%s', split_part(least(du, printf('%06d|I%s', split_part(da, '|', 1)::INT + 3, split_part(da, '|', 2))), '|', 1)::INT + 3,
                  split_part(least(du, printf('%06d|I%s', split_part(da, '|', 1)::INT + 3, split_part(da, '|', 2))), '|', 2)) AS iu0
    FROM (
      SELECT b.conv_id, b.pos,
             least(printf('%06d|D%s', split_part(b0, '|', 1)::INT + 4, split_part(b0, '|', 2)),
                   CASE WHEN fault IN ('k', 't') THEN printf('%06d|R%s', split_part(bu, '|', 1)::INT + 3 + x, split_part(bu, '|', 2)) END,
                   CASE WHEN fault IN ('k', 't') AND i = 's' THEN printf('%06d|K%s', split_part(bs, '|', 1)::INT + x, split_part(bs, '|', 2)) END,
                   CASE WHEN fault IN ('k', 't') AND i = 'u' THEN printf('%06d|K%s', split_part(bu, '|', 1)::INT + x, split_part(bu, '|', 2)) END) AS d0,
             least(printf('%06d|D%s', split_part(bs, '|', 1)::INT + 4, split_part(bs, '|', 2)),
                   CASE WHEN fault IN ('k', 't') THEN printf('%06d|R%s', split_part(bu, '|', 1)::INT + 3 + x, split_part(bu, '|', 2)) END,
                   CASE WHEN fault IN ('k', 't') AND i = 'u' THEN printf('%06d|K%s', split_part(bu, '|', 1)::INT + x, split_part(bu, '|', 2)) END) AS ds,
             least(printf('%06d|D%s', split_part(bu, '|', 1)::INT + 4, split_part(bu, '|', 2)),
                   CASE WHEN fault IN ('k', 't') THEN printf('%06d|R%s', split_part(ba, '|', 1)::INT + 3 + x, split_part(ba, '|', 2)) END,
                   CASE WHEN fault IN ('k', 't') AND i = 'a' THEN printf('%06d|K%s', split_part(ba, '|', 1)::INT + x, split_part(ba, '|', 2)) END) AS du,
             least(printf('%06d|D%s', split_part(ba, '|', 1)::INT + 4, split_part(ba, '|', 2)),
                   CASE WHEN fault IN ('k', 't') THEN printf('%06d|R%s', split_part(bu, '|', 1)::INT + 3 + x, split_part(bu, '|', 2)) END,
                   CASE WHEN fault IN ('k', 't') AND i = 'u' THEN printf('%06d|K%s', split_part(bu, '|', 1)::INT + x, split_part(bu, '|', 2)) END) AS da
      FROM back b JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS x FROM faults) f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.pos = f.pos))),
solved AS (SELECT conv_id, split_part(b0, '|', 1)::BIGINT AS cost, split_part(b0, '|', 2) AS audit FROM back WHERE pos = 0),
walk AS (
  SELECT conv_id, audit, 0 AS k, 0 AS pos, '0' AS state, []::VARCHAR[] AS lines FROM solved
  UNION ALL
  SELECT w.conv_id, audit, k + 1, CASE WHEN e = 'I' THEN w.pos ELSE w.pos + 1 END,
         CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN i WHEN state = 'u' THEN 'a' ELSE 'u' END,
         CASE WHEN e = 'D' THEN lines WHEN e = 'K' THEN list_append(lines, role || ':' || text)
              ELSE list_append(lines, CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (SELECT *, substr(audit, k + 1, 1) AS e FROM walk WHERE k < length(audit)) w
  LEFT JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.pos + 1),
hashed AS (SELECT conv_id, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256 FROM walk WHERE k = length(audit))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN hashed h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""
