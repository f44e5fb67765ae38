"""Conversation structure repair by Knuth's lightest derivation.

A conversation is well formed when the initials of its roles are ``(s?(ua)+)?``.  Edits
turn any conversation into such a one: keep a row (0), give it the role user or assistant
(3), delete it (4, and the only edit of blank and repeated rows), insert an empty user or
assistant row (3); a truncated row that stays adds 3.  The cheapest edits are wanted, of
equal ones those whose initials ``D I K R`` come first in ASCII order.

Items are *the rows from i on can be repaired from state p*, with the states of the
expression's automaton.  Deductions add one edit before an item; the item of value
``(cost, rows, audit)`` that is least on the agenda is final when it is popped, because
every deduction raises the value and keeps the order of two values of an item.

Conversations of any length are cut into pieces of sorted rows.  A piece becomes the
lightest edits from each state to each state; such tables are joined in order, a bounded
number at a time, until one is left for each conversation.  Inserts stand before a row,
those at the end are added last: edits of a piece are then never the beginning of other
edits of it, so that the choice within a piece holds whatever follows.

Edge cases: rows are ordered by turn (nulls first), then role and digest of the text;
a NULL role or text is one space, NULL ids form a conversation of their own; repeated
rows are repeated rows of the conversation; a conversation without rows has no edits;
an empty table gives no rows; other columns are ignored whatever they are called.
Texts of any length are read whole and hashed row by row, without being gathered.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiflux.session import stored

#: Rows of a piece, and pieces that are joined at once.
PIECE_ROWS = 256
JOINED = 64

#: Different pieces whose tables a Python worker remembers.
REMEMBERED = 50_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States: nothing yet, after the system row, after a user row, after an assistant row.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_BEFORE = {letter: [(p, q) for (p, x), q in _NEXT.items() if x == letter] for letter in "sua"}
_STATES = range(4)

#: What has to be inserted at the end of a conversation from each state.
_CLOSING = {0: "", 1: "II", 2: "I", 3: ""}

#: One sign a row: the initial, in capitals if truncated, and as a digit if it must go.
_SIGNS = "suao" + "SUAO" + "0123"

Cell = tuple[int, str] | None


def _steps(sign: str, q: int) -> list[tuple[int, int, str]]:
    """Edits of a row that lead to state ``q``: ``(state before, cost, initial)``."""
    at = _SIGNS.index(sign)
    steps = [(q, DELETE, "D")]
    if at < 8:
        more = TRUNCATED if at >= 4 else 0
        initial = _SIGNS[at % 4]
        steps += [(p, KEEP + more, "K") for p, to in _BEFORE.get(initial, []) if to == q]
        steps += [(p, REROLE + more, "R") for letter in "ua" for p, to in _BEFORE[letter] if to == q]
    return steps


_STEPS = {(sign, q): _steps(sign, q) for sign in _SIGNS for q in _STATES}
_INSERTS = {q: [p for letter in "ua" for p, to in _BEFORE[letter] if to == q] for q in _STATES}


def lightest(signs: str, end: int) -> list[Cell]:
    """Lightest edits of the rows from each state to ``end``, none where there are none.

    An agenda holds items ``(cost, rows covered, edits, state)``.  The first value popped
    for an item is its lightest; the search ends when the goal items, those that cover all
    rows, are final, or when nothing is left.
    """
    n = len(signs)
    final: dict[tuple[int, int], tuple[int, str]] = {}
    agenda = [(0, 0, "", end)]
    goals = 0
    while agenda and goals < 4:
        cost, rows, audit, state = heapq.heappop(agenda)
        if (rows, state) in final:
            continue
        final[rows, state] = (cost, audit)
        goals += rows == n
        if rows:
            for p in _INSERTS[state]:
                if (rows, p) not in final:
                    heapq.heappush(agenda, (cost + INSERT, rows, "I" + audit, p))
        if rows < n:
            for p, more, letter in _STEPS[signs[n - 1 - rows], state]:
                if (rows + 1, p) not in final:
                    heapq.heappush(agenda, (cost + more, rows + 1, letter + audit, p))
    return [final.get((n, p)) for p in _STATES]


def piece_table(signs: str) -> list[list[Cell]]:
    """Lightest edits of a piece from each state (first index) to each state (second)."""
    columns = [lightest(signs, q) for q in _STATES]
    return [[columns[q][p] for q in _STATES] for p in _STATES]


def join_tables(left: list[list[Cell]], right: list[list[Cell]]) -> list[list[Cell]]:
    """The table of two pieces in a row: the lightest way over any state between them."""
    table = []
    for p in _STATES:
        row = []
        for q in _STATES:
            ways = [
                (left[p][m][0] + right[m][q][0], left[p][m][1] + right[m][q][1])
                for m in _STATES if left[p][m] and right[m][q]
            ]
            row.append(min(ways) if ways else None)
        table.append(row)
    return table


def goal(table: list[list[Cell]]) -> tuple[int, str]:
    """Lightest edits of the whole conversation, with what has to be inserted at its end."""
    return min(
        (cell[0] + INSERT * len(_CLOSING[q]), cell[1] + _CLOSING[q])
        for q, cell in enumerate(table[0]) if cell
    )


def _flat(table: list[list[Cell]]) -> tuple[list[int], list[str]]:
    cells = [cell or (-1, "") for row in table for cell in row]
    return [cost for cost, _ in cells], [audit for _, audit in cells]


def _square(costs, audits) -> list[list[Cell]]:
    cells = [None if cost < 0 else (int(cost), audit) for cost, audit in zip(costs, audits)]
    return [cells[4 * p:4 * p + 4] for p in _STATES]


_TABLE = "key string, piece long, costs array<long>, audits array<string>, first string, last string, illegal long"


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple] = {}
    for batch in batches:
        out = []
        for signs in batch["signs"]:
            if signs not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                initials = "".join("suao"[_SIGNS.index(sign) % 4] for sign in signs)
                known[signs] = (*_flat(piece_table(signs)), initials[0], initials[-1], _illegal(initials))
            out.append(known[signs])
        columns = ["costs", "audits", "first", "last", "illegal"]
        found = pd.DataFrame(out, columns=columns, index=batch.index)
        yield pd.concat([batch[["key", "piece"]], found], axis=1)


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """At most ``JOINED`` neighbouring pieces of one conversation as one."""
    rows = rows.sort_values("piece")
    tables = [_square(*cells) for cells in zip(rows["costs"], rows["audits"])]
    table = tables[0]
    for right in tables[1:]:
        table = join_tables(table, right)
    between = sum(a + b not in ("su", "ua", "au") for a, b in zip(rows["last"], rows["first"].iloc[1:]))
    costs, audits = _flat(table)
    return pd.DataFrame({
        "key": [rows["key"].iloc[0]], "piece": [rows["up"].iloc[0]], "costs": [costs], "audits": [audits],
        "first": [rows["first"].iloc[0]], "last": [rows["last"].iloc[-1]],
        "illegal": [int(rows["illegal"].sum()) + between],
    })


def _goals(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([goal(_square(*cells)) for cells in zip(costs, audits)], columns=["cost", "audit"])


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with NULL texts and roles as a space, and what is wrong with each row alone."""
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumns({
        "key": F.to_json(F.struct("conv_id")),
        "blank": shown == "",
        "truncated": ~F.substring(shown, -1, 1).isin(".", "!", "?"),
        "digest": F.unhex(F.sha2("text", 256)),
    })


def _sign() -> Column:
    at = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((at == 0) | (F.col("role") == ""), 4).otherwise(at)
    part = F.when(F.col("blank") | F.col("repeated"), 8).when(F.col("truncated"), 4).otherwise(0)
    return F.substring(F.lit(_SIGNS), (part + initial).cast("int"), F.lit(1))


def _ordered(rows: DataFrame) -> DataFrame:
    """The faults of each row, and ``at``, its place in the order of all rows; written.

    Rows are dealt out by ranges of the order, so a conversation with most of the rows is
    spread over many tasks.  Rows that are equal in all but their place in the input are
    told apart by that, so that they can be dealt out too.
    """
    slim = rows.select(
        "key", "conv_id", "turn", "role", "digest", "blank", "truncated",
        F.monotonically_increasing_id().alias("number"),
    )
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "digest", "number")]
    dealt = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(dealt.drop("number").withColumn("at", F.monotonically_increasing_id()), "conversation-rows")


def _repeated(ordered: DataFrame) -> DataFrame:
    """Rows with ``repeated``: whether the same role and text stand earlier in the conversation.

    The first place of each text is an aggregate, reduced before its shuffle; only texts
    that occur more than once in a conversation are joined back.
    """
    keys = ["key", "role", "digest"]
    first = ordered.groupBy(*keys).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(*[F.col(key).alias(f"_{key}") for key in keys], F.col("at").alias("first"))
    same = [F.col(key) == F.col(f"_{key}") for key in keys]
    joined = ordered.join(first, same[0] & same[1] & same[2], "left")
    return joined.withColumn("repeated", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).drop(
        *[f"_{key}" for key in keys], "first")


def lightest_edits(pieces: DataFrame) -> DataFrame:
    """``key, cost, audit, illegal`` of each conversation from its pieces ``key, piece, signs``.

    Pieces are numbered from 0 within a conversation.  A round joins up to ``JOINED``
    neighbours, so there are as many rounds as the longest conversation asks for; those of
    one piece take part in none.
    """
    whole = Window.partitionBy("key")
    numbered = pieces.withColumns({
        "piece": F.row_number().over(whole.orderBy("piece")).cast("long") - 1, "of": F.count(F.lit(1)).over(whole)})
    numbered = stored(numbered, "conversation-pieces")
    alone = numbered.filter("of = 1").select("key", "piece", "signs").mapInPandas(_tables, _TABLE)
    rest, most = numbered.filter("of > 1"), numbered.agg(F.max("of")).first()[0] or 0
    tables = rest.select("key", "piece", "signs").mapInPandas(_tables, _TABLE)
    while most > 1:
        up = tables.withColumn("up", F.floor(F.col("piece") / JOINED))
        tables = stored(up.groupBy("key", "up").applyInPandas(_joined, _TABLE), "conversation-tables")
        most = -(-most // JOINED)
    goals = F.pandas_udf(_goals, "cost long, audit string")
    found = alone.unionByName(tables).withColumn("goal", goals("costs", "audits"))
    return found.select("key", "goal.cost", "goal.audit", "illegal")


def _pieces(rows: DataFrame) -> DataFrame:
    """``key, piece, signs``: up to ``PIECE_ROWS`` neighbouring rows of a conversation as a string of signs.

    ``at`` counts within a task from a multiple of 2 ** 33, so a run of ``at`` is in one task.
    """
    run = F.shiftright("at", PIECE_ROWS.bit_length() - 1)
    cells = F.array_sort(F.collect_list(F.struct("at", "sign")))
    return rows.groupBy("key", run.alias("piece")).agg(
        F.array_join(F.transform(cells, lambda cell: cell["sign"]), "").alias("signs"))


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash the repaired rows of sorted conversations; the edits come as the first row of each."""
    known, audit, at, state, digest, any_yet = None, "", 0, 0, None, False
    done: list[tuple] = []

    def put(role: str, text: str) -> None:
        nonlocal any_yet
        digest.update((("\n" if any_yet else "") + role + ":").encode())
        digest.update(text.encode())
        any_yet = True

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if state == 2 else "user"
            put(role, "")
            state = _NEXT[state, role[0]]
            at += 1

    def close() -> None:
        insert()
        done.append((known, digest.hexdigest()))

    for batch in batches:
        for key, kind, role, text in zip(batch["key"], batch["kind"], batch["role"], batch["text"]):
            if kind == 0:
                if digest is not None:
                    close()
                known, audit, at, state, digest, any_yet = key, text, 0, 0, hashlib.sha256(), False
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == 2 else "user"
            put(role, text)
            state = _NEXT[state, role[0]]
        yield pd.DataFrame(done, columns=["key", "repaired_sha256"])
        done = []
    if digest is not None:
        close()
        yield pd.DataFrame(done, columns=["key", "repaired_sha256"])


def _digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``key, repaired_sha256`` of each conversation.

    A digest takes its rows one after the other, so the rows of a conversation pass through
    one task, a batch at a time: sorted outside of memory, hashed and forgotten.
    """
    none = F.lit(None)
    lines = edits.select(
        "key", F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), none.cast("binary").alias("digest"),
    ).unionByName(rows.select("key", F.lit(1).alias("kind"), "turn", "role", "text", "digest"))
    order = ["key", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    sorted_rows = lines.repartition("key").sortWithinPartitions(*order).drop("digest", "turn")
    return sorted_rows.mapInPandas(_apply, "key string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, lightest edits and digest of the repaired rows of each conversation.

    ``rows`` has ``conv_id, turn, role, text``.  Returns ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``.  Counts of faults count the first
    fault of a row; ``illegal`` counts neighbours whose initials are not su, ua or au.
    """
    judged = with_faults(rows)
    signed = stored(_repeated(_ordered(judged)).withColumn("sign", _sign()), "conversation-signs")
    edits = stored(lightest_edits(_pieces(signed)), "conversation-edits")
    again, cut = ~F.col("blank") & F.col("repeated"), ~F.col("blank") & ~F.col("repeated") & F.col("truncated")
    counts = signed.groupBy("key", "conv_id", "turn").agg(
        F.count_if("blank").alias("blank"), F.count_if(again).alias("duplicate"), F.count_if(cut).alias("truncated"),
    ).groupBy("key", "conv_id").agg(
        F.coalesce(F.expr("try_add(try_subtract(max(turn), min(turn)), 1L - count(turn))"), F.lit(0)).alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    found = counts.join(edits, "key").join(_digests(judged, edits), "key")
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by a checksum of ``conv_id:turn``, for tests and figures.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes out ends of
    sentences, 3 repeats it and 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    whole = rows.select(
        "conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return whole.filter("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")
