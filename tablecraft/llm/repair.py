"""Conversation repair: cheapest edits that give a legal order of roles, by an auction for shortest paths.

A conversation is a path through a lattice: so many rows read, and the last role
written. Keeping a row costs 0, giving it another role 3, deleting it 4, inserting an
empty one 3; a cut-off row that stays costs 3 more; blank and repeated rows must go. The
roles that remain read ``(s?(ua)+)?`` by their initials.

The shortest path is found by an auction: every node has a price, no larger than the price of
any successor plus the arc between. A path starts at the origin. If its last node can
be dearer it takes that price and the path is shortened by it; else the path is extended
by a successor that fits. Where it arrives, prices are exact distances. The lattice
is worked off from its end in blocks of ``BLOCK`` rows whose prices start at the
least price behind them, so the work grows with the rows, not with their square. Arcs along
which prices differ by the arc's cost are tight; the edits are read off from the origin, the
ASCII-least tight arc first, after its head's price has been settled by the same auction.

Rows are put in order by one range shuffle, which splits long conversations, and stored with
their place. All else but the texts is narrow: repeated rows are found by grouping hashes,
letters (one a row) are gathered in pieces before they are gathered by conversation. What the
driver and the auction see of a row is that letter. Last, texts stream through the edits into
SHA-256, in constant memory; that hash is sequential by definition, so one conversation's texts
pass one task.

Defined results: null roles and texts, and null ids and turns in the checksum, are one space;
null turns come first; rows of one turn come by role, then text (code points), equal ones side by
side; a null conversation id is a conversation of its own; conversations of which no row is left
have zeros, an empty audit and the hash of the empty string; gaps beyond a long are null; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import stored

SPACE = " \t\n\x0b\f\r"
#: Rows of the lattice that are settled together.
BLOCK = 16
#: Rows whose letters are gathered in one piece before pieces are gathered by conversation.
PIECE = 4096
#: Results kept per worker; a memory bound without influence on results.
MEMO = 100_000
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
ROLES, FAULTS = "suao", ("sound", "blank", "duplicate", "truncated")
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _next(state: int) -> int:
    """What an inserted or renamed row becomes."""
    return ASSISTANT if state == USER else USER


def _kept(role: str, state: int) -> int | None:
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def _arcs(role: str, fault: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows read, state behind), by letter, of a node before a row."""
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, _next(state))]
    if fault in ("sound", "truncated"):
        more = CUT if fault == "truncated" else 0
        if (to := _kept(role, state)) is not None:
            arcs.append(("K", KEEP + more, 1, to))
        arcs.append(("R", REROLE + more, 1, _next(state)))
    return arcs


#: Letters 'a' to 'p': role and fault of a row.
LETTERS = {chr(97 + 4 * r + f): (role, fault) for r, role in enumerate(ROLES) for f, fault in enumerate(FAULTS)}
_BEFORE = {letter: [_arcs(*rf, state) for state in range(4)] for letter, rf in LETTERS.items()}
_AFTER = [[("", 0, 1, state)] * (state in (START, ASSISTANT)) + [("I", INSERT, 0, _next(state))] for state in range(4)]


def cheapest(letters: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of one conversation; see the module."""
    n = len(letters)
    arcs = [_BEFORE[x] for x in letters] + [_AFTER]
    price = [0] * (4 * n + 8)
    settled = bytearray(4 * n + 4) + b"\1" * 4  # behind the last row lies the destination

    def settle(origin: int) -> None:
        path = [origin]
        while not settled[at := path[-1]]:
            row = at // 4
            best, to = None, 0
            for _, cost, step, state in arcs[row][at % 4]:
                head = 4 * (row + step) + state
                if best is None or cost + price[head] < best:
                    best, to = cost + price[head], head
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            settled[node] = 1

    for first in range(n - n % block if n % block else n, -1, -block):
        rows = range(4 * first, 4 * min(first + block, n + 1))
        behind = price[rows.stop:rows.stop + 4]
        for node in rows:
            price[node] = min(behind)
        for state in range(4):
            settle(4 * first + state)
    audit, at = [], 0
    while at < 4 * n + 4:
        for letter, cost, step, state in arcs[at // 4][at % 4]:
            head = 4 * (at // 4 + step) + state
            if price[at] == cost + price[head]:
                settle(head)
                if price[at] == cost + price[head]:
                    audit.append(letter)
                    at = head
                    break
    return price[0], "".join(audit)


def judged(letters: str) -> tuple[int, int, int, int, int, str]:
    """(blank, duplicate, truncated, illegal, cost, audit) of a conversation."""
    faults = [LETTERS[x][1] for x in letters]
    roles = "".join(LETTERS[x][0] for x in letters)
    illegal = sum(roles[i:i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, *cheapest(letters)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that a checksum of id and turn decides."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.col("kind"), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", "role", "text", (F.crc32(name) % 20).alias("kind")).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def placed(rows: DataFrame) -> DataFrame:
    """Stored rows (conv_id, turn, role, text, copies) with place, initial, faults of their own and hashes.

    ``place`` ascends by conversation, turn, role and text over the whole table.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    return stored(ranged.select(
        "*", F.monotonically_increasing_id().alias("place"), F.when(initial.isin(*ROLES[:3]), initial).otherwise(ROLES[3]).alias("initial"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(11), "text", "role").alias("g")), "turns")


def lettered(turns: DataFrame) -> DataFrame:
    """(conv_id, letters): one letter for each row and copy, in order; conversations without rows have none."""
    first = stored(turns.where("copies > 0").groupBy("conv_id", "h", "g").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first")), "firsts")
    known = turns.select("conv_id", "place", "copies", "initial", "blank", "cut").join(first, "place", "left")

    def letter(duplicate: Column) -> Column:
        fault = F.when(F.col("blank"), 1).when(duplicate, 2).when(F.col("cut"), 3).otherwise(0)
        return F.char(97 + 4 * F.instr(F.lit(ROLES), F.col("initial")) - 4 + fault)

    own = F.when(F.col("copies") > 0, F.concat(letter(F.col("first").isNull()), F.when(F.col("copies") > 1, letter(F.lit(True))).otherwise(""))).otherwise("")
    rows = known.select("conv_id", "place", own.alias("letters"))

    def gathered(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "letters"))), lambda x: x["letters"]), "")
        return frame.groupBy(*keys).agg(joined.alias("letters"))

    pieces = gathered(rows.withColumn("piece", F.floor(F.col("place") / PIECE)), ["conv_id", "piece"], "place")
    return gathered(pieces, ["conv_id"], "piece")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers missing between the smallest and the largest."""
    distinct = turns.where("copies > 0 and turn is not null").select("conv_id", "turn").distinct()
    span = F.try_subtract(F.max("turn"), F.min("turn"))
    return distinct.groupBy("conv_id").agg(F.try_add(F.try_subtract(span, F.count("*")), F.lit(1).cast("long")).alias("gaps"), F.lit(True).alias("any"))


_memo: dict[str, tuple] = {}


def audited(letters: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from (conv_id, gaps, letters)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                found = _memo.get(x)
                if found is None:
                    found = judged(x)
                    if len(x) <= 4 * BLOCK:
                        if len(_memo) >= MEMO:
                            _memo.clear()
                        _memo[x] = found
                out.append(found)
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return letters.select("conv_id", "gaps", "letters").mapInArrow(solve, REPAIRED.rpartition(",")[0])


class Repaired:
    """SHA-256 of a repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.edits = iter(audit)
        self.state = START
        self.hash = hashlib.sha256()
        self.some = False

    def _write(self, state: int, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.state, self.some = state, True

    def _insert(self) -> None:
        to = _next(self.state)
        self._write(to, NAMES[to], "")

    def row(self, role: str, text: str) -> None:
        while (edit := next(self.edits)) == "I":
            self._insert()
        if edit == "K":
            self._write(_kept(role[:1], self.state), role, text)
        elif edit == "R":
            to = _next(self.state)
            self._write(to, NAMES[to], text)

    def end(self) -> str:
        for _ in self.edits:  # only insertions are left
            self._insert()
        return self.hash.hexdigest()


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The audits with the hash of the repaired text."""
    none = {"place": F.lit(-1).cast("long"), "copies": F.lit(0), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    numbers = [c for c in audits.columns if c != "conv_id"]
    head = audits.withColumns(none)
    rows = turns.where("copies > 0").select("conv_id", "place", "copies", "role", "text").withColumns({c: F.lit(None).cast(audits.schema[c].dataType) for c in numbers})
    dealt = head.unionByName(rows).select("conv_id", *numbers, "place", "copies", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[-4] < 0:
                    if now:
                        done.append((*now[0], now[1].end()))
                    now = row[:-4], Repaired(row[-5])
                else:
                    for _ in range(row[-3]):
                        now[1].row(row[-2], row[-1])
            if done:
                yield as_batch(done)
        if now:
            yield as_batch([(*now[0], now[1].end())])

    def as_batch(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=re.findall(r"(\w+) \w+", REPAIRED))

    return dealt.mapInArrow(fold, REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation, from rows (conv_id, turn, role, text, copies) such as :func:`damaged` gives."""
    turns = placed(rows)
    letters, missing = lettered(turns), gaps(turns).withColumnRenamed("conv_id", "of")
    joined = letters.join(missing, letters["conv_id"].eqNullSafe(missing["of"]), "left")
    counted = joined.select("conv_id", F.when(F.col("any").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"), "letters")
    return repaired(turns, stored(audited(counted), "audits"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _way(state: int, cost: str, letter: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN lpad((left(s{state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr(s{state}, 10) || '{letter}' END"


_DELETED = [_way(state, "4", "D") for state in range(4)]
_STAY = "fault NOT IN (1, 2)"


def _read(states: tuple[int, ...], role: str) -> list[str]:
    kept = [_way(state, "3 * (fault = 3)::INT", "K", f"{_STAY} AND initial = '{role}'") for state in states]
    return kept + ([] if role == "s" else [_way(state, "3 + 3 * (fault = 3)::INT", "R", _STAY) for state in states])


#: The same rows by dynamic programming over costs and edits together, row by row, and a replay of the edits.
OP11_SQL = rf"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY b) AS list FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS r
    FROM (SELECT unnest(range(256)) AS b))),
named AS (SELECT conv_id, turn, role, text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS digits FROM conversations),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(length(digits) // 2), lambda i: ('0x' || digits[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda crc, byte: xor(crc >> 8, list[(xor(crc, byte) & 255) + 1])), 4294967295) % 20 AS kind FROM named, remainders),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed),
rows_of AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM judged),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_of GROUP BY conv_id),
paths AS (
  SELECT conv_id, n, 0 AS step, '000000000' AS s0, NULL::VARCHAR AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM counts
  UNION ALL
  SELECT conv_id, n, step, s0, s1, s2, {_least("s3", _way(2, "3", "I"))} AS s3 FROM (
    SELECT conv_id, n, step, s0, s1, {_least("s2", _way(0, "3", "I"), _way(1, "3", "I"), _way(3, "3", "I"))} AS s2, s3 FROM (
      SELECT p.conv_id, n, step + 1 AS step, {_DELETED[0]} AS s0, {_least(_DELETED[1], *_read((0,), "s"))} AS s1,
        {_least(_DELETED[2], *_read((0, 1, 3), "u"))} AS s2, {_least(_DELETED[3], *_read((2,), "a"))} AS s3
      FROM paths p JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.step + 1))),
best AS (SELECT conv_id, least(s0, s3) AS best FROM paths WHERE step = n),
replay AS (
  SELECT conv_id, substr(best, 10) AS edits, 0 AS step, '' AS last, NULL::VARCHAR AS body FROM best
  UNION ALL
  SELECT conv_id, substr(edits, 2), step, CASE edit WHEN 'D' THEN last WHEN 'K' THEN left(role, 1) ELSE new[1] END,
    CASE edit WHEN 'D' THEN body ELSE coalesce(body || chr(10), '') || CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN new || ':' || text ELSE new || ':' END END FROM (
    SELECT p.conv_id, edits, p.step + (left(edits, 1) <> 'I')::INT AS step, last, body, left(edits, 1) AS edit, CASE WHEN last = 'u' THEN 'assistant' ELSE 'user' END AS new, role, text
    FROM replay p LEFT JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.step + 1 WHERE edits <> '')),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN (SELECT conv_id, body FROM replay WHERE edits = '') done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
