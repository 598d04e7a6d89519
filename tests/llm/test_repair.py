"""Conversation repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tablecraft.llm import repair

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEGAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def solve(rows):
    """(cost, audit, lines): the least (cost, audit) for every last role, row by row."""
    best = {"": (0, "")}

    def better(found, last, way):
        if last not in found or way < found[last]:
            found[last] = way

    def inserted(found):
        for _ in range(2):
            for last, (cost, audit) in list(found.items()):
                better(found, "a" if last == "u" else "u", (cost + 3, audit + "I"))
        return found

    best = inserted(best)
    for role, _, fault in rows:
        found = {}
        for last, (cost, audit) in best.items():
            better(found, last, (cost + 4, audit + "D"))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (last, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    better(found, role[:1], (cost + more, audit + "K"))
                better(found, "a" if last == "u" else "u", (cost + 3 + more, audit + "R"))
        best = inserted(found)
    cost, audit = min(best[last] for last in ("", "a") if last in best)
    lines, waiting, last = [], iter(rows), ""
    for letter in audit:
        new = "assistant" if last == "u" else "user"
        role, text, _ = (new, "", "") if letter == "I" else next(waiting)
        if letter != "D":
            lines.append((role if letter == "K" else new, text))
            last = lines[-1][0][:1]
    return cost, audit, lines


def by_hand(table, damage=True):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        role, text = " " if role is None else role, " " if text is None else text
        rows = groups[conv]
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        rows.extend([(turn is not None, turn or 0, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    out = {}
    for conv, rows in groups.items():
        rows.sort()
        seen, judged = set(), []
        for _, _, role, text in rows:
            body = re.sub("[ \t-\r]+$", "", text, flags=re.ASCII)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for known, t, *_ in rows if known}
        cost, audit, lines = solve(judged)
        assert LEGAL.fullmatch("".join(role[:1] for role, _ in lines))
        count = lambda f: sum(x[2] == f for x in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        body = "\n".join(f"{role}:{text}" for role, text in lines)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def found_by(frame):
    rows = frame.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_auction_finds_the_cheapest_least_edits(block):
    rng = random.Random(block)
    letters = list(repair.LETTERS)
    for _ in range(400):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 24)))
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[repair.LETTERS[x][0]], "x", repair.LETTERS[x][1]) for x in word]
        assert repair.cheapest(word, block) == solve(rows)[:2], word


def test_work_grows_with_the_rows():
    """Far fewer steps than the square of the rows; 20,000 rows in seconds."""
    word = "".join(random.Random(1).choice("aeimbfgho") for _ in range(20_000))
    cost, audit = repair.cheapest(word)
    assert cost > 0 and sum(x != "I" for x in audit) == len(word)


def random_table(rng, conversations):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", "User", None, "ünknown"]
    texts = ["Yes.", "No", "What? ", "", " \n", "Fine!\t", None, "Yes.", "a. ", "long " * 50 + "."]
    table = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, 14)):
            turn = rng.choice((turn, turn, turn + rng.randrange(9), None))
            table.append((rng.choice((conv, conv, conv, None)) if conv % 10 == 0 else conv, turn, rng.choice(roles[:5] if conv % 3 else roles), rng.choice(texts)))
    rng.shuffle(table)
    return table


def test_repair_by_hand(spark):
    table = random_table(random.Random(3), 150)
    assert found_by(repair.repair(repair.damaged(spark.createDataFrame(table, SCHEMA)))) == by_hand(table)


def test_all_kinds_of_damage_occur(spark):
    rows = repair.damaged(spark.range(4000).selectExpr("id AS conv_id", "0L AS turn", "'assistant' AS role", "'So. It is!' AS text")).collect()
    kinds = {(r["role"], r["text"], r["copies"]) for r in rows}
    assert kinds == {("assistant", "So. It is!", n) for n in (0, 1, 2)} | {("assistant", "", 1), ("assistant", "So It is", 1), ("user", "So. It is!", 1)}
    for conv in (r["conv_id"] for r in rows if r["copies"] == 0):
        assert by_hand([(conv, 0, "assistant", "x.")])[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark):
    """A conversation of more rows than one piece holds, with repeats far apart."""
    rng = random.Random(8)
    table = [(7, t, rng.choice(("user", "assistant")), f"Text {rng.randrange(3000)}{rng.choice('.?,')}") for t in range(6000)] + [(8, 1, "user", "Hm.")]
    found, wanted = found_by(repair.repair(repair.damaged(spark.createDataFrame(table, SCHEMA).repartition(9)))), by_hand(table)
    assert found == wanted and found[7][2] > 500


def test_odd_tables(spark):
    schema = SCHEMA + ", place string, copies string, letters string, kind string, audit string, cost string"
    table = random_table(random.Random(5), 12) + [(99, 2 ** 63 - 1, "user", "x" * 300_000), (99, -2 ** 63, "user", "Hm."), (98, 1, "user", "Eh."), (98, 1, "user", "Eh."), (98, 1, "assistant", "Eh.")]
    frame = spark.createDataFrame([(*r, *["clash"] * 6) for r in table], schema)
    found, wanted = found_by(repair.repair(repair.damaged(frame))), by_hand(table)
    wanted[99] = (None, *wanted[99][1:])  # beyond a long
    assert found == wanted
    assert repair.repair(repair.damaged(frame.limit(0))).count() == 0


def test_query_and_sql_agree_on_odd_tables(spark, tmp_path):
    table = [(i, t, r, x) for i, t, r, x in dict.fromkeys(random_table(random.Random(9), 40)) if r != "ünknown"]
    spark.createDataFrame(table, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = repair.op11_conversation_repair(spark, str(tmp_path)).select("conv_id", *COLUMNS).collect()
    wanted = con.execute(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({repair.OP11_SQL})").fetchall()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
