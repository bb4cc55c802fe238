"""Conversation repair against an exhaustive search over edits, and its pieces."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from pharmlake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, pos int, fault string, copies int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying every edit at every place, up to three inserts in a row."""
    allowed, after = {0: "su", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}

    @lru_cache(None)
    def best(i, place, inserted):
        options = [(0, "", ())] if i == len(rows) and place in (0, 3) else []

        def then(cost, letter, name, text, i, inserted=0):
            if name[:1] and name[:1] in allowed[place]:
                c, a, t = best(i, after[name[:1]], inserted)
                options.append((c + cost, letter + a, ((name, text),) + t))

        if i < len(rows):
            fault, role, text = rows[i]
            c, a, t = best(i + 1, place, 0)
            options.append((c + 2, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                then(extra, "K", role, text, i + 1)
                then(extra + 1, "R", "user", text, i + 1)
                then(extra + 1, "R", "assistant", text, i + 1)
        if inserted < 3:
            then(5, "I", "user", "", i, inserted + 1)
            then(5, "I", "assistant", "", i, inserted + 1)
        return min(options, default=(10 ** 9, "~", ()))

    return best(0, 0, 0)


def expected(rows):
    """The contract's columns by conversation, from plain lists."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in damaged(rows) if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faulty = set(), []
        for _, _, role, text in mine:
            tail = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((fault, role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = cheapest(faulty)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        out[conv] = (gaps, *[sum(f[0] == x for f in faulty) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def random_rows(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, rng.choice([turn] * 9 + [None, 3]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         rng.choice(["Hello.", "Why?", "No end", "Yes!", " ", None, "", "A text. \n", "ß…", "Sure!\x0b"])))
    return rows + rows[:4]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_against_exhaustive_search(spark):
    rows = random_rows(1, 120, 9)
    got = repair.digests(frame(spark, rows))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(rows)


def test_long_conversation_in_many_pieces(spark):
    """One conversation over all range partitions, with long runs of equal symbols."""
    rng = random.Random(2)
    rows = []
    while len(rows) < 1500:
        role, text = rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Same.", "cut", "", f"Text {len(rows)}."])
        for _ in range(rng.choice([1, 1, 2, 40])):
            rows.append((5, len(rows), role, text))
    rows += [(6, 0, "user", "Hi."), (6, 1, "assistant", "Yes.")]
    df = frame(spark, rows).repartition(4)
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = repair.ordered_rows(repair.damage(df), "conv_id", "turn", "role", "text")
        assert ordered.where("conv = 5").select("piece").distinct().count() > 3
        got = {r[0]: tuple(r)[1:] for r in repair.digests(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert got == expected(rows)
    finally:
        sys.setrecursionlimit(limit)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hi!"), (1, 3, "user", "Well?"), (2, 0, "assistant", "Only."),
            (3, 0, "tool", "Text."), (3, 1, "tool", "More.")]
    got = sorted(map(tuple, repair.repaired(frame(spark, rows)).collect()))
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Well?"),
                   (3, 0, "user", "Text."), (3, 1, "assistant", "More.")]
    letters = repair.edits(frame(spark, rows)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "edit"))).alias("e"))
    assert {r.conv: "".join(x.edit for x in r.e) for r in letters.collect()} == {1: "KKDR", 2: "D", 3: "RR"}


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.digests(frame(spark, [(gone, 0, "user", "x")])).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.digests(frame(spark, [])).collect() == []
    assert repair.edits(frame(spark, [])).collect() == []


@pytest.mark.parametrize("count", [1, 2, 7, 64, 1000])
def test_powers_equal_repeated_steps(count):
    powers, rng = repair.Powers(), random.Random(count)
    for symbol in range(12):
        after = tuple(rng.randrange(50) for _ in range(4))
        plain, total = after, repair.IDENTITY
        for _ in range(count):
            plain = repair.apply(repair._row_matrix(symbol), plain)
            total = repair.product(total, repair._row_matrix(symbol))
        assert powers.before_run(symbol, count, after) == plain
        assert powers.of_run(symbol, count) == total


def test_turns_far_apart(spark):
    low, high = -(2 ** 63), 2 ** 63 - 1
    rows = [(1, low, "user", "A."), (1, high, "assistant", "B.")]
    got = repair.reports(repair.edits(frame(spark, rows))).collect()[0]
    assert got.gaps == 0 and got.audit == "KK"  # the true number does not fit a long
