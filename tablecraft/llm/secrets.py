"""Secrets in texts: three fixed patterns, and values that are hard to guess.

The fixed patterns find assignments to credential names, access keys and long
hexadecimal runs. The method beside them looks at every value in a credential
context (a wider list of names, followed by a sign, or "bearer" and white space) and
computes what guessing it would cost: the cheapest way to cut the value into common
words, dates, repeats, sequences, keyboard walks, runs of letters that look like a
word, and single characters tried one by one. A value is a secret (kind ``guess``) if
that costs at least ``10 ** least_cost`` guesses. A quoted value ends at its own quote.
Values are cut at spans of fixed patterns: what lies inside is not reported again, what
lies before is a value still, and so is what follows up to the next delimiter.

Defined results: a null text is empty and has no spans; starts and ends count code
points, ends are exclusive; equal rows give equal rows; extra columns are not read.
Each text is scanned whole. The dynamic programme is linear in the value's length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import whole

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 9.0

# The base patterns. Letters of the names are of either case, and ASCII only.
_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(f"(?:{'|'.join(map(_either, NAMES))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CONTEXT_NAMES = ("pass", "pwd", "passphrase", "passcode", "credential", "credentials", "login", "auth", "bearer", "private_key",
                 "access_key", "client_key", "signing_key", "pin", "password", "passwd", "secret", "token", "apikey", "api_key")
# Any white space of the line, or a little across lines.
_GAP = r"(?:[^\S\r\n]*|\s{0,3})"
CONTEXT = re.compile(
    f"(?<![A-Za-z])(?:(?:{'|'.join(map(_either, CONTEXT_NAMES))})[\"']?{_GAP}(?:=>|->|[:=]){_GAP}|{_either('bearer')}[^\\S\\r\\n]+)"
    "(?:\"([!#-~]{6,})|'([!-&(-~]{6,})|`([!-_a-~]{6,})|([!#-&(-_a-~][!-&(-_a-~]{5,}))")
_ENDS = ".,;:)]}>"
_TAIL = re.compile("[^&,;:?\"'`<>()\\[\\]{}]*")
_CONTEXT_HINTS = ("pass", "pwd", "credential", "login", "auth", "bearer", "_key", "pin", "secret", "token", "apikey")

# Words that guessers try first, commonest first.
WORDS = ("password", "admin", "welcome", "login", "letmein", "dragon", "monkey", "master", "secret", "sunshine", "princess", "football",
         "baseball", "shadow", "superman", "iloveyou", "trustno", "hello", "freedom", "whatever", "test", "guest", "root", "user", "pass",
         "default", "changeme", "example", "none", "null", "true", "false", "required", "optional", "string", "value", "your", "here",
         "summer", "winter", "spring", "autumn", "server", "system", "account", "database", "qwerty", "love", "star", "the", "and")
_RANK = {word: rank + 1 for rank, word in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
# Rows of a keyboard.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_KEY = {c: (x, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
#: What an unlisted run of lower-case letters that looks like a word costs, and more for every letter above so many.
_UNLISTED, _MORE, _USUAL = 5.0, 0.5, 12
# Frequent letter pairs of words. A run looks like a word if half of its pairs are among them.
_PAIRS = frozenset((
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be "
    "ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa").split())


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _run(value: str, i: int, follows) -> int:
    j = i + 1
    while j < len(value) and follows(value[j - 1], value[j]):
        j += 1
    return j


def _adjacent(a: str, b: str) -> bool:
    p, q = _KEY.get(a), _KEY.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _follows(a: str, b: str) -> bool:
    return a.isalnum() and b.isalnum() and ord(b) == ord(a) + 1


def _word_cost(run: str) -> float:
    """Infinite for a run that does not look like a word: its letters are tried one by one."""
    frequent = sum(run[i:i + 2] in _PAIRS for i in range(len(run) - 1))
    return _UNLISTED + _MORE * max(0, len(run) - _USUAL) if 2 * frequent >= len(run) - 1 else math.inf


def guess_cost(value: str) -> float:
    """Log10 of the guesses for the value: the minimum over all its segmentations."""
    low, n = value.lower(), len(value)
    best = [0.0] + [math.inf] * n
    walk_end = run_end = row_end = letters_end = 0
    for i in range(n):
        at = best[i]

        def reach(j: int, cost: float, at: float = at) -> None:
            best[j] = min(best[j], at + cost)

        reach(i + 1, _alphabet(value[i]))
        # Runs are looked at once, at their start; a walk or run may also stop early.
        if i >= run_end - 1:
            run_end = _run(low, i, lambda a, b: a == b)
            if run_end - i >= 3:
                for j in range(i + 3, run_end + 1):
                    reach(j, _alphabet(value[i]) + math.log10(j - i))
        if i >= row_end - 1:
            row_end = _run(low, i, _follows)
            for j in range(i + 3, row_end + 1):
                reach(j, _alphabet(value[i]) + math.log10(j - i))
        if i >= walk_end - 1:
            walk_end = _run(low, i, _adjacent)
            if walk_end - i >= 4:
                for j in range(i + 4, walk_end + 1):
                    reach(j, math.log10(len(_KEY)) + 0.6 * math.log10(j - i) + 0.15 * (j - i))
        if i >= letters_end and value[i].islower():
            letters_end = _run(value, i, lambda a, b: b.islower())
            if letters_end - i >= 3:
                reach(letters_end, _word_cost(value[i:letters_end]))
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j])
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                reach(j, math.log10(rank + 1) + (0 if not upper else 0.3 if upper == j - i or value[i].isupper() and upper == 1 else 0.3 * upper))
        date = _DATE.match(value, i)
        if date:
            reach(date.end(), math.log10(120) if date.end() - i == 4 else math.log10(120 * 366))
    return best[n]


def _outside(text: str, start: int, end: int, begins: list[int], ends: list[int]) -> tuple[int, int]:
    """The part of a value outside the (merged) fixed spans: up to the next one, or from the end of the one it starts in."""
    k = bisect_right(begins, start)
    if k and start < ends[k - 1]:
        start = ends[k - 1]
        end = max(start, min(end, _TAIL.match(text, start).end()))
    return start, min([end, *begins[k:k + 1]])


def guesses(text: str, fixed: list[tuple[str, int, int]], least_cost: float) -> Iterator[tuple[str, int, int]]:
    begins, ends = [], []
    for _, a, b in sorted(fixed, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    at = 0
    while m := CONTEXT.search(text, at):
        start, end = _outside(text, m.start(m.lastindex), m.end(), begins, ends)
        # A quoted value is whole; one without quotes may have the marks of a sentence behind it.
        closed = m.lastindex < 4 and text[end:end + 1] == text[m.start(m.lastindex) - 1]
        if not closed:
            end = start + len(text[start:end].rstrip(_ENDS + '"'))
        if end - start >= 6 and guess_cost(text[start:end]) >= least_cost:
            yield "guess", start, end
            at = end
        else:  # a name inside, as in "auth: bearer ..."
            at = max(start, m.start(m.lastindex))


def spans_of(text: str, least_cost: float = LEAST_COST) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    low = text.lower()
    found = []
    if any(hint in low for hint in _HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(hint in low for hint in _CONTEXT_HINTS):
        found += list(guesses(text, found, least_cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame, text: str = "text", into: str = "spans", least_cost: float = LEAST_COST) -> DataFrame:
    """The rows with a column ``into``: array of (kind, start, end)."""

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in texts:
            yield pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, least_cost)] for t in batch.to_pylist()], kind)

    return docs.withColumn(into, _arrow(scan)(whole(F.col(text))))


def _arrow(function):
    from pyspark.sql.functions import arrow_udf

    function.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf("array<struct<kind:string,start:long,end:long>>")(function)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, and whatever overlaps it, replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        inside = span["start"] < state["at"]
        between = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(F.lit(0), span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], between, F.lit(mark))).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
