"""Conversation repair against a search of all states, row by row."""

import hashlib
import random
import zlib

import pytest

from epiflux.llm import conversation_repair, queries

SPACE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def brute(rows):
    """Faults and cheapest edits of ordered ``(turn, role, text)``."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(SPACE)
        fault = ("blank" if not shown else "duplicate" if (role, text) in seen
                 else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
        faults.append(fault)
    best = {0: (0, "", [])}
    relax = lambda to, q, value: to.__setitem__(q, min(to.get(q, value), value, key=lambda v: v[:2]))

    def with_inserts(at):
        for _ in range(3):
            for p, (cost, audit, lines) in list(at.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    if (p, letter) in NEXT:
                        relax(at, NEXT[p, letter], (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return at

    best = with_inserts(best)
    for (_, role, text), fault in zip(rows, faults):
        to = {}
        for p, (cost, audit, lines) in best.items():
            relax(to, p, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (p, role[:1]) in NEXT:
                relax(to, NEXT[p, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                if (p, name[0]) in NEXT:
                    relax(to, NEXT[p, name[0]], (cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"]))
        best = with_inserts(to)
    cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])
    turns = [turn for turn, _, _ in rows if turn is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(kind) for kind in ("blank", "duplicate", "truncated")],
        sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(rows):
    grouped = {}
    for key, turn, role, text in rows:
        grouped.setdefault(key, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {key: brute(sorted(found, key=order)) for key, found in grouped.items()}


def random_rows(rng, conversations, most):
    rows = []
    for key in range(conversations):
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "So it is! ", "a line", "", " \n", None, f"Number {rng.randint(0, 9)}.", "x…?\n"])
            rows.append((key if key else None, rng.choice([turn, turn, turn, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece, joined, most", [(256, 64, 9), (2, 2, 9), (4, 3, 60)])
def test_same_as_brute_force(spark, monkeypatch, piece, joined, most):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", piece)
    monkeypatch.setattr(conversation_repair, "JOINED", joined)
    rows = random_rows(random.Random(piece), 60 if most < 10 else 12, most)
    frame = spark.createDataFrame([(*row, "other") for row in rows], SCHEMA + ", audit string")
    got = {row.conv_id: tuple(row)[1:] for row in conversation_repair.repair(frame).collect()}
    assert got == expected(rows)


def test_deductions_of_a_piece_equal_all_ways():
    rng = random.Random(5)
    for _ in range(40):
        signs = "".join(rng.choice("suaoSUAO0123uaua") for _ in range(rng.randint(1, 14)))
        cut = rng.randint(1, len(signs))
        whole = conversation_repair.piece_table(signs)
        if cut < len(signs):
            halves = [conversation_repair.piece_table(part) for part in (signs[:cut], signs[cut:])]
            assert conversation_repair.join_tables(*halves) == whole


def test_long_conversation_of_repeated_rows(spark):
    rows = [(7, i % 3, "user" if i % 2 else "assistant", "Same." if i % 5 else f"Own {i}.") for i in range(3000)]
    got = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(row)[1:] for row in got] == [expected(rows)[7]]


def test_empty_table_and_long_text(spark):
    assert conversation_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "long " * 200_000 + " " * 100_000
    row = conversation_repair.repair(spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", "Ok.")], SCHEMA)).first()
    assert (row.truncated, row.cost, row.audit) == (1, 3, "KK")


def test_query_by_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(5000, t, "user", None) for t in range(3)]
    damaged = []
    for key, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else "".join(c for c in text or " " if fate != 2 or c not in ".!?")
        role = "user" if fate == 4 else role or " "
        damaged += [(key, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    want = expected(damaged)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, folder).collect()}
    rows = {key for key, *_ in rows if key != 5000}
    assert got == {key: want.get(key, empty) for key in rows}
