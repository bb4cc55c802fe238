"""Conversation structure repair by a run-length min-plus programme.

Faults (the first that holds counts): blank (no character but white space), duplicate (role
and text seen earlier in the conversation), truncated (the last such character is not one
of ``.!?``). Edits: Keep (0), Rerole to user or assistant (1), Delete (2; required for blank
and duplicate rows), Insert an empty user or assistant turn (5); a truncated row that stays
adds 5. The cheapest edits that make the role initials ``(s?(ua)+)?`` are found, of equally
cheap ones those whose initials are least in ASCII order.

A row's transition is a 4 x 4 min-plus matrix over the places of that pattern (start, after
s, after u, after a), the same for all rows with one (role initial, fault) symbol. Equal
consecutive symbols are collapsed into runs, and a run of n rows is applied through the
cached powers M, M^2, M^4, ... of its matrix.

No conversation has to fit a task. Equal rows are counted first; rows are range-partitioned
by (conversation, turn, role, text), so a conversation is cut into pieces at the partition
borders. Each piece becomes its runs and one matrix; walking a conversation's pieces
backwards with a vector of four costs gives what follows each piece; then every piece is
unrolled on its own, from each of the four places it may be entered at; a last walk over
the sorted rows picks the unrolling that holds and writes the edits as a stream. A hash over
a conversation's text, if asked for, is sequential by nature and is taken in that stream.
The rows with their order are written to the shared folder once, so a lost executor costs
the tasks it ran.

Defined cases: null role or text is one space; an empty role has no initial and can only be
reroled or deleted; ties in turn are ordered by role, then text; null turns come first; a
null conversation is one conversation; repeated rows are duplicates of the first; extra
columns are ignored; an empty table gives no rows. ``gaps`` counts turns of an integer type
and is 0 where the number exceeds a long."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

INFINITE = 1 << 62
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: places: 0 start, 1 after s, 2 after u, 3 after a; the place an inserted or reroled turn leads to
NEXT = (2, 2, 3, 2)
#: role initial -> the places from which a kept row is allowed, and where it leads
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
INITIALS = ("s", "u", "a", "")
OK, CUT, GONE = 0, 1, 2  # a symbol is 3 * initial + one of these
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
ENDING = (0, 2 * INSERT, INSERT, 0)  # cost of inserts that complete the pattern from each place

Matrix = tuple


@lru_cache(1 << 14)  # short conversations repeat the same few steps
def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INFINITE, min(r[k] + b[k][j] for k in range(4))) for j in range(4)) for r in a)


@lru_cache(1 << 14)
def apply(a: Matrix, v: tuple) -> tuple:
    return tuple(min(INFINITE, min(r[k] + v[k] for k in range(4))) for r in a)


IDENTITY = tuple(tuple(0 if i == j else INFINITE for j in range(4)) for i in range(4))


def _row_matrix(symbol: int) -> Matrix:
    """Inserts before the row, then one edit of the row."""
    initial, kind = INITIALS[symbol // 3], symbol % 3
    inserts = product(*[tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else INFINITE for j in range(4)) for i in range(4))] * 2)
    edit = [[INFINITE] * 4 for _ in range(4)]
    for q in range(4):
        edit[q][q] = DELETE
        if kind != GONE:
            extra = TRUNCATED if kind == CUT else 0
            edit[q][NEXT[q]] = min(edit[q][NEXT[q]], REROLE + extra)
            if q in KEPT[initial]:
                to = KEPT[initial][q]
                edit[q][to] = min(edit[q][to], KEEP + extra)
    return product(inserts, tuple(map(tuple, edit)))


class Powers:
    """Binary powers of every symbol's matrix, computed when first needed."""

    def __init__(self):
        self.known: dict[int, list[Matrix]] = {}

    def power(self, symbol: int, k: int) -> Matrix:
        """M^(2^k)."""
        have = self.known.setdefault(symbol, [_row_matrix(symbol)])
        while len(have) <= k:
            have.append(product(have[-1], have[-1]))
        return have[k]

    def of_run(self, symbol: int, count: int) -> Matrix:
        out, k = IDENTITY, 0
        while count >> k:
            if count >> k & 1:
                out = product(out, self.power(symbol, k))
            k += 1
        return out

    def before_run(self, symbol: int, count: int, after: tuple) -> tuple:
        k = 0
        while count >> k:
            if count >> k & 1:
                after = apply(self.power(symbol, k), after)
            k += 1
        return after


def _edit(symbol: int, q: int, before: tuple, after: tuple) -> tuple[str, int]:
    """The letters for one row entered at place ``q``, and the place after it: at every
    step the least letter that still reaches the optimum."""
    initial, kind = INITIALS[symbol // 3], symbol % 3
    extra, letters = TRUNCATED if kind == CUT else 0, ""
    while True:
        cost = before[q]
        if DELETE + after[q] == cost:
            return letters + "D", q
        if INSERT + before[NEXT[q]] == cost:
            letters, q = letters + "I", NEXT[q]
        elif kind != GONE and q in KEPT[initial] and KEEP + extra + after[KEPT[initial][q]] == cost:
            return letters + "K", KEPT[initial][q]
        else:
            return letters + "R", NEXT[q]


def unroll(runs: list[tuple[int, int]], after: tuple, entries, last: bool, powers: Powers) -> dict[int, tuple[str, int]]:
    """place of entry -> (letters, place of exit) for a piece, given the costs that follow."""
    ends = [after]
    for symbol, count in reversed(runs):
        ends.append(powers.before_run(symbol, count, ends[-1]))
    ends.reverse()
    place = {q: q for q in entries}
    letters = {q: [] for q in entries}
    for (symbol, count), end in zip(runs, ends[1:]):
        rows = [end]
        one = powers.power(symbol, 0)
        for _ in range(count):
            rows.append(apply(one, rows[-1]))
        rows.reverse()
        for before, behind in zip(rows, rows[1:]):
            step = {}
            for q in entries:
                now = place[q]
                if now not in step:
                    step[now] = _edit(symbol, now, before, behind)
                letters[q].append(step[now][0])
                place[q] = step[now][1]
    if last:
        for q in entries:
            while ENDING[place[q]]:
                letters[q].append("I")
                place[q] = NEXT[place[q]]
    return {q: ("".join(letters[q]), place[q]) for q in entries}


def counted_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct (conv, turn, role, text) with how often they occur (``copies``) and whether
    the first row with that role and text in the conversation is among them (``fresh``).
    Both aggregates combine before they shuffle, and no key holds more than equal rows."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    first = rows.groupBy("conv", "role", "text").agg(F.min(F.struct("turn")).alias("t"))
    both = rows.withColumns({"copies": F.lit(1), "fresh": F.lit(0)}).unionByName(
        first.select("conv", F.col("t.turn").alias("turn"), "role", "text", F.lit(0).alias("copies"), F.lit(1).alias("fresh")))
    return both.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.max("fresh").alias("fresh"))


def ordered_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The counted rows in order: ``pos`` rises through a conversation, ``piece`` is the
    partition that held the row; with the symbol of the first copy and its fault (later
    copies are duplicates, or blank as the first). Written once."""
    rows = counted_rows(turns, conv, turn, role, text)
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(rest == "", 1).when(F.col("fresh") == 0, 2)
             .when(~F.substring(rest, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    initial = F.substring("role", 1, 1)
    base = 3 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumns({"fault": fault, "base": base})
    order = ["conv", "turn", "role", "text"]
    spread = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    return stored(spread.select(*order, "copies", "fault", "base", F.spark_partition_id().alias("piece"),
                                F.monotonically_increasing_id().alias("pos")), "conversation-rows")


def _groups(batches: Iterator, *keys: str) -> Iterator:
    """(key, row) for the rows of sorted batches, as tuples in column order."""
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(n).to_pylist() for n in names]
        at = [names.index(k) for k in keys]
        for row in zip(*columns):
            yield tuple(row[i] for i in at), row


def _batches(rows: Iterator[tuple], schema, size: int = 4096) -> Iterator:
    import pyarrow as pa

    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(conv_field, fields: str):
    """(Spark schema string, Arrow schema) of ``conv`` and the given long, int, string or
    boolean fields and their arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    spark_schema = StructType([conv_field, *_parse_datatype_string(fields).fields])
    return spark_schema, to_arrow_schema(spark_schema)


def pieces(rows: DataFrame) -> DataFrame:
    """Per (conv, piece): its first pos, its runs (symbol, count) and its matrix."""
    schema, arrow = _arrow(rows.schema["conv"], "piece int, pos long, symbols array<int>, counts array<long>, matrix array<long>")

    def collapse(batches: Iterator) -> Iterator[tuple]:
        powers, key, start, runs = Powers(), None, None, []

        def out():
            total = IDENTITY
            for symbol, count in runs:
                total = product(total, powers.of_run(symbol, count))
            return (*key, start, [s for s, _ in runs], [c for _, c in runs], [x for r in total for x in r])

        def add(symbol: int, count: int) -> None:
            if runs and runs[-1][0] == symbol:
                runs[-1] = (symbol, runs[-1][1] + count)
            else:
                runs.append((symbol, count))

        for this, (_, _, pos, base, fault, copies) in _groups(batches, "conv", "piece"):
            if this != key:
                if key is not None:
                    yield out()
                key, start, runs = this, pos, []
            for symbol, count in copies_of(base, fault, copies):
                add(symbol, count)
        if key is not None:
            yield out()

    compact = rows.select("conv", "piece", "pos", "base", "fault", "copies")
    dealt = compact.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "pos")
    return dealt.mapInArrow(lambda b: _batches(collapse(b), arrow), schema)


def copies_of(base: int, fault: int, copies: int) -> list[tuple[int, int]]:
    """Runs of symbols for ``copies`` equal rows whose first has ``fault``."""
    if fault in (1, 2):
        return [(base + GONE, copies)]
    first = [(base + (CUT if fault == 3 else OK), 1)]
    return first + [(base + GONE, copies - 1)] if copies > 1 else first


def unrolled(parts: DataFrame) -> DataFrame:
    """Per (conv, piece): letters and exit places for each place it may be entered at."""
    walk_schema, walk_arrow = _arrow(parts.schema["conv"],
                                     "piece int, pos long, symbols array<int>, counts array<long>, after array<long>, first boolean, last boolean")
    schema, arrow = _arrow(parts.schema["conv"], "piece int, pos long, letters array<string>, exits array<int>")

    def backwards(batches: Iterator) -> Iterator[tuple]:
        held, cost = None, None
        for _, (conv, piece, pos, symbols, counts, matrix) in _groups(batches, "conv"):
            same = held is not None and held[0] == conv
            if held is not None:
                yield (*held[:6], not same, held[6])
            if not same:
                cost = ENDING
            held = (conv, piece, pos, symbols, counts, list(cost), not same)
            cost = apply(tuple(tuple(matrix[4 * i:4 * i + 4]) for i in range(4)), cost)
        if held is not None:
            yield (*held[:6], True, held[6])

    def forwards(batches: Iterator) -> Iterator[tuple]:
        powers = Powers()
        for _, (conv, piece, pos, symbols, counts, after, first, last) in _groups(batches, "conv"):
            entries = (0,) if first else (0, 1, 2, 3)
            done = unroll(list(zip(symbols, counts)), tuple(after), entries, last, powers)
            yield (conv, piece, pos, [done[q][0] if q in done else "" for q in range(4)],
                   [done[q][1] if q in done else 0 for q in range(4)])

    walked = (parts.repartition("conv").sortWithinPartitions("conv", F.desc("piece"))
              .mapInArrow(lambda b: _batches(backwards(b), walk_arrow), walk_schema))
    return walked.repartition("conv", "piece").mapInArrow(lambda b: _batches(forwards(b), arrow), schema)


def edits(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per edit, in order within each conversation (and in each partition of the
    result): conv, seq (from 0), stays (the turn's number in the repaired conversation, null
    if deleted), edit (K, R, D or I), role and text after the edit, and of the edited row its
    turn, its role before (``was``, null for inserts) and its fault."""
    rows = ordered_rows(turns, conv, turn, role, text)
    heads = unrolled(pieces(rows))
    turn_type = rows.schema["turn"]
    schema, _ = _arrow(rows.schema["conv"], "seq long, stays long, edit string, role string, text string, was string, fault string")
    schema = schema.add("turn", turn_type.dataType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def write(batches: Iterator) -> Iterator[tuple]:
        key, seq, stays, place, letters, at = None, 0, 0, 0, "", 0

        def insert():
            nonlocal seq, stays, place, at
            place, at, seq, stays = NEXT[place], at + 1, seq + 1, stays + 1
            return (key[0], seq - 1, stays - 1, "I", "user" if place == 2 else "assistant", "", None, "", None)

        for this, (conv_, pos, head, all_letters, exits, turn_, role_, text_, copies, fault, base) in _groups(batches, "conv"):
            if head == 0:
                while at < len(letters):  # inserts after the last row
                    yield insert()
                if this != key:
                    key, seq, stays, place = this, 0, 0, 0
                letters, at = all_letters[place], 0
                continue
            for symbol, count in copies_of(base, fault, copies):
                for _ in range(count):
                    while letters[at] == "I":
                        yield insert()
                    letter, became = letters[at], role_
                    if letter == "R":
                        place = NEXT[place]
                        became = "user" if place == 2 else "assistant"
                    elif letter == "K":
                        place = KEPT[INITIALS[symbol // 3]][place]
                    why = FAULTS[fault] if symbol % 3 != GONE else ("blank" if fault == 1 else "duplicate")
                    yield (conv_, seq, None if letter == "D" else stays, letter, became, text_, role_, why, turn_)
                    at, seq, stays = at + 1, seq + 1, stays + (letter != "D")
        while at < len(letters):
            yield insert()

    none = F.lit(None)
    header = heads.select("conv", "pos", F.lit(0).alias("head"), "letters", "exits", none.cast(turn_type.dataType).alias("turn"),
                          none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("long").alias("copies"),
                          none.cast("int").alias("fault"), none.cast("int").alias("base"))
    body = rows.select("conv", "pos", F.lit(1).alias("head"), none.cast("array<string>").alias("letters"),
                       none.cast("array<int>").alias("exits"), "turn", "role", "text", "copies", "fault", "base")
    dealt = header.unionByName(body).repartition("conv").sortWithinPartitions("conv", "pos", "head")
    return dealt.mapInArrow(lambda b: _batches(write(b), arrow), schema)


def repaired(turns: DataFrame, **columns) -> DataFrame:
    """The repaired turns: conv, turn (from 0), role, text."""
    return edits(turns, **columns).where("edit <> 'D'").select("conv", F.col("stays").alias("turn"), "role", "text")


def reports(edited: DataFrame) -> DataFrame:
    """Per conversation of ``edits``: gaps, faults, illegal neighbours, cost, audit and the
    hash of the repaired turns. Streams through the partitions of ``edits`` as they are."""
    schema, arrow = _arrow(edited.schema["conv"], "turns long, low decimal(38,0), high decimal(38,0), blank long, duplicate long, "
                           "truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def digest(batches: Iterator) -> Iterator[tuple]:
        from decimal import Decimal

        key, state = None, None

        def out():
            low, high = (None if x is None else Decimal(x) for x in (state["low"], state["high"]))
            return (key[0], state["turns"], low, high, *[state[f] for f in FAULTS[1:]], state["illegal"], state["cost"],
                    "".join(state["audit"]), state["hash"].hexdigest())

        for this, (_, seq, _, edit, role, text, was, fault, turn) in _groups(batches, "conv"):
            if this != key or seq == 0:
                if key is not None:
                    yield out()
                key = this
                state = {"turns": 0, "low": None, "high": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                         "cost": 0, "audit": [], "hash": hashlib.sha256(), "was": None, "any": False}
            state["audit"].append(edit)
            state["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit != "I":
                if turn is not None and turn != state["high"]:  # sorted by turn
                    state["turns"] += 1
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                if fault:
                    state[fault] += 1
                if fault == "truncated" and edit != "D":
                    state["cost"] += TRUNCATED
                if state["was"] is not None and state["was"][:1] + was[:1] not in LEGAL:
                    state["illegal"] += 1
                state["was"] = was
            if edit != "D":
                state["hash"].update((("\n" if state["any"] else "") + role + ":" + text).encode())
                state["any"] = True
        if key is not None:
            yield out()

    found = edited.mapInArrow(lambda b: _batches(digest(b), arrow), schema)
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("turns")).try_cast("long"), F.lit(0))
    return found.select("conv", F.when(F.col("low").isNull(), F.lit(0)).otherwise(gaps).cast("long").alias("gaps"),
                        *FAULTS[1:], "illegal", "cost", "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def digests(conversations: DataFrame) -> DataFrame:
    """Damage, repair and report: one row per conversation of the original table."""
    found = reports(edits(damage(conversations))).withColumnRenamed("conv", "found_id")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
