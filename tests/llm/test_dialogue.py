"""Conversation repair against dynamic programming over (cost, letters)."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from flowgauge.llm import dialogue
from flowgauge.llm.queries import QUERIES, SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if deal == 1:
            text = ""
        if deal == 2:
            text = re.sub("[.!?]", "", text)
        if deal == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(deal, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def plain_repair(rows):
    """Facts, cost, letters and checksum of one conversation, forward over all states."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}

    def offer(to, state, cost, letters, body):
        if state not in to or (cost, letters) < to[state][:2]:
            to[state] = (cost, letters, body)

    def inserted(best):
        for _ in range(3):
            for state, (cost, letters, body) in list(best.items()):
                for initial in "ua":
                    if initial in NEXT[state]:
                        offer(best, NEXT[state][initial], cost + 2, letters + "I", [*body, f"{NAMES[initial]}:"])
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, letters, body) in inserted(best).items():
            offer(new, state, cost + 3, letters + "D", body)
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] in NEXT[state]:
                    offer(new, NEXT[state][role[:1]], cost + extra, letters + "K", [*body, f"{role}:{text}"])
                for initial, name in NAMES.items():
                    if initial in NEXT[state]:
                        offer(new, NEXT[state][initial], cost + extra + 2, letters + "R", [*body, f"{name}:{text}"])
        best = new
    cost, letters, body = min(v for s, v in inserted(best).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(body).encode()).hexdigest())


def plain(rows):
    return {(c, *plain_repair(r)) for c, r in plain_damage(rows).items()}


def repaired(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS edit", "2 AS times")
    return dialogue.digest_messages(dialogue.repair_messages(dialogue.damage(frame)))


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \t", "Why?", "Yes. ", "x" * 200 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [
        (conv, turn if rng.random() > 0.05 else None, rng.choice(roles), rng.choice([*texts, None, f"{turn}."]))
        for conv in [*range(conversations), None]
        for turn in range(rng.randint(1, longest))
    ]


def test_query_equals_plain_version_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert {tuple(r) for r in found.collect()} == plain(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert set(db.execute(SQL["op11_conversation_repair"]).fetchall()) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 120, 9)
    found = repaired(spark, rows).collect()
    assert len(found) == 121 and {tuple(r) for r in found} == plain(rows)


def test_conversation_over_many_partitions(spark, monkeypatch):
    """One conversation holds nearly all rows; parts are joined by prices and states, pieces by their order."""
    monkeypatch.setattr(dialogue, "PIECE", 50)
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!", " "])) for t in range(900)]
    rows += random_rows(3, 8, 6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = dialogue.damage(spark.createDataFrame(rows, SCHEMA))
        assert len(dialogue._spread(dialogue._ordered(frame), "bigint")) > 5
        assert {tuple(r) for r in repaired(spark, rows).collect()} == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "Same.")] * 500 + [(1, 1, "assistant", "long " * 100_000)] + [(2, None, None, None)] * 3
    assert {tuple(r) for r in repaired(spark, rows).collect()} == plain(rows)
    assert repaired(spark, []).count() == 0


def test_lost_conversations_stay(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repaired(spark, [(lost, 0, "user", "Gone.")]).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_prices_are_distances():
    """Each price is below no arc's sum, and the least letters follow tight arcs."""
    kinds = [(i, f) for i in ("s", "u", "a", "t") for f in range(4)]
    rng = random.Random(2)
    for _ in range(50):
        chosen = [rng.choice(kinds) for _ in range(12)] + [dialogue.FINISH]
        prices, steps = dialogue.solve(chosen, (0, None, None, 0))
        behind = prices
        for k in range(len(chosen)):
            here, behind = behind, dialogue.solve(chosen[k + 1 :], (0, None, None, 0))[0]
            ends = [*here, *behind]
            for state, arcs in enumerate(dialogue._arcs(chosen[k])):
                sums = [(cost + ends[to], letter) for letter, cost, to in arcs if ends[to] is not None]
                assert here[state] == min(s for s, _ in sums)
                assert steps[k][state][0] == min(letter for s, letter in sums if s == here[state])
