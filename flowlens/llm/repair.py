"""Repair of the structure of conversations by depth-first branch and bound.

Rows of a conversation, in order of turns, become a string of codes: a forced deletion,
or the initial of a role, in capitals if the text is cut off. The cheapest edits that
make the roles read ``(s?(ua)+)?`` are searched with an explicit stack. A node is a place
in the string and the last role so far; a suffix bound, a backward pass that looks at
costs alone, says what finishing from it costs at least; the incumbent is the best
(cost, audit) that is complete; and a table of each node's best prefix drops worse ones.
Branches go in the order of their letters, so that the least audit comes first among
equal costs.

No task needs a whole conversation's texts at once. Codes are cut into pieces of bounded
length, and a piece is searched for every pair of roles before and after it; pieces of a
long conversation are in many tasks. What joins them is a chain of sixteen costs a
piece; a conversation of one piece needs one search. Texts are then streamed through the edits in order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowlens.llm.hot import join_groups
from flowlens.session import materialize

PIECE = 1024  # codes of a piece, and turns that are looked at together
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs; a row that is cut off and stays adds the last

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
GONE = "x"  # code of a row that must go
FAR = 1 << 60

#: The role that a user or assistant row has after each state, and the states a row kept
#: by its own initial can come after.
_NEXT = (USER, USER, ASSISTANT, USER)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}

#: What it takes to end well after each state.
_ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


# Search


def _bounds(codes: str, ends: list[int]) -> list[list[int]]:
    """The least cost from every place and state to the end, which costs ``ends`` by state."""
    after = ends
    bounds = [after]
    for code in reversed(codes):
        here = []
        cut = CUT if code.isupper() else 0
        keeps = _AFTER.get(code.lower(), {})
        for q in STATES:
            cost = DELETE + after[q]
            if code != GONE:
                cost = min(cost, REROLE + cut + after[_NEXT[q]])
                if q in keeps:
                    cost = min(cost, KEEP + cut + after[keeps[q]])
            here.append(cost)
        after = [min(here[q], INSERT + here[_NEXT[q]], 2 * INSERT + here[_NEXT[_NEXT[q]]]) for q in STATES]
        bounds.append(after)
    bounds.reverse()
    return bounds


def search(
    codes: str, first: int, ends: tuple[tuple[int, str], ...] = _ENDS, bounds: list[list[int]] | None = None
) -> tuple[int, str] | None:
    """The cheapest edits of all codes from state ``first`` on, and the least audit of these;
    none if there is no way. ``ends`` has the cost and the letters of ending in each state."""
    bounds = bounds or _bounds(codes, [cost for cost, _ in ends])
    if bounds[0][first] >= FAR or not codes and ends[first][0] >= FAR:
        return None
    best: tuple[int, str] | None = None
    reached: dict[int, tuple[int, str]] = {}
    stack = [(bounds[0][first], "", 0, first, 0)]
    while stack:
        least, audit, place, state, cost = stack.pop()
        if best and (least > best[0] or least == best[0] and audit > best[1][: len(audit)]):
            continue
        if place == len(codes):
            found = (cost + ends[state][0], audit + ends[state][1])
            if best is None or found < best:
                best = found
            continue
        node = 4 * place + state
        known = reached.get(node)
        if known and known <= (cost, audit):
            continue
        reached[node] = (cost, audit)
        code, then, free = codes[place], bounds[place + 1], _NEXT[state]
        branches = [(cost + DELETE + then[state], audit + "D", place + 1, state, cost + DELETE)]
        # Two insertions lead from any state to any role that insertions reach.
        if not audit.endswith("II"):
            # What follows an insertion is another one or an edit of this code.
            branches.append((cost + INSERT + bounds[place][free], audit + "I", place, free, cost + INSERT))
        if code != GONE:
            cut = CUT if code.isupper() else 0
            kept = _AFTER.get(code.lower(), {}).get(state)
            if kept is not None:
                branches.append((cost + KEEP + cut + then[kept], audit + "K", place + 1, kept, cost + KEEP + cut))
            branches.append((cost + REROLE + cut + then[free], audit + "R", place + 1, free, cost + REROLE + cut))
        # The most promising branch is looked at first, of equal ones that of the least letter.
        branches.sort(reverse=True)
        stack += [branch for branch in branches if branch[0] < FAR]
    return best


def ways(codes: str) -> tuple[list[int], bytes]:
    """Costs from every state to every state, and the audits that go with them."""
    costs, audits = [], []
    for target in STATES:
        ends = tuple((0 if q == target else FAR, "") for q in STATES)
        bounds = _bounds(codes, [cost for cost, _ in ends])
        for first in STATES:
            found = search(codes, first, ends, bounds)
            costs.append(found[0] if found else FAR)
            audits.append(found[1] if found else "")
    return costs, zlib.compress("\n".join(audits).encode(), 1)


class Remembered(dict):
    """Results of short strings, which come again and again; a bounded number of them."""

    def __init__(self, use):
        self.use = use

    def __missing__(self, codes: str):
        found = self.use(codes)
        if len(codes) <= 64 and len(self) < 1 << 15:
            self[codes] = found
        return found


def chain(pieces: list[tuple[list[int], bytes]]) -> tuple[int, list[str]]:
    """The cost of a conversation of several pieces, and each piece's audit.

    Audits up to the end of a piece have one letter for each code besides insertions and
    end in a code's, so none begins another, and the least can be chosen piece by piece.
    """
    rest = [[cost for cost, _ in _ENDS]]
    for costs, _ in reversed(pieces):
        rest.append([min(costs[4 * t + q] + rest[-1][t] for t in STATES) for q in STATES])
    rest.reverse()
    state, audits = START, []
    for (costs, packed), after in zip(pieces, rest[1:]):
        texts = zlib.decompress(packed).decode().split("\n")
        _, audit, state = min((costs[4 * t + state] + after[t], texts[4 * t + state], t) for t in STATES)
        audits.append(audit)
    if audits:
        audits[-1] += _ENDS[state][1]
    return rest[0][START], audits


# Rows in tasks


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _blocks(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*records) if records else [[]] * len(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _batched(records: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for record in records:
        held.append(record)
        weight += 1 + sum(len(v) for v in record if isinstance(v, (str, bytes))) // 4096
        if weight >= size:
            yield _blocks(held, schema)
            held, weight = [], 0
    if held:
        yield _blocks(held, schema)


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _pieces(schema: pa.Schema, piece: int):
    """Rows, sorted within blocks of turns, to pieces of codes with counts and ways."""

    def cut(records: Iterator[tuple]) -> Iterator[tuple]:
        for (conv, block), rows in groupby(records, key=lambda r: r[:2]):
            number, codes = 0, []
            fresh = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
            count = dict(fresh)
            low = high = first = last = None

            def done(codes):
                # A full piece is of a long conversation, whose pieces are searched here, side by side.
                found = ("".join(codes), None, None) if len(codes) < piece else (None, *ways("".join(codes)))
                return (
                    conv, block, number, count["blank"], count["duplicate"], count["truncated"], count["illegal"],
                    count["turns"], low, high, first, last, *found,
                )

            seen = None
            for _, _, turn, initial, blank, again, cut_off, copies in rows:
                if copies and turn is not None and turn != seen:
                    count["turns"] += 1
                    low, high, seen = turn if low is None else low, turn, turn
                left = copies
                while left:
                    if left == copies:
                        take = 1
                        fault = "blank" if blank else "duplicate" if again else "truncated" if cut_off else None
                        code = GONE if blank or again else initial if initial in ("s", "u", "a") else "o"
                        code = code.upper() if fault == "truncated" else code
                    else:
                        take = min(left, piece - len(codes))
                        fault, code = "blank" if blank else "duplicate", GONE
                    if fault:
                        count[fault] += take
                    # Pairs inside the piece; its first row meets the last one of the piece before later.
                    count["illegal"] += take - 1 + (last is not None and not _legal(last, initial))
                    codes.extend([code] * take)
                    first, last = initial if first is None else first, initial
                    left -= take
                    if len(codes) >= piece:
                        yield done(codes)
                        number, codes, count = number + 1, [], dict(fresh)
                        low = high = first = last = None
            if codes or not number:
                yield done(codes)

    return lambda batches: _batched(cut(_records(batches)), schema)


def _plans(schema: pa.Schema):
    """Pieces, sorted, to the edits of every block, the first with the conversation's facts."""

    def plan(records: Iterator[tuple]) -> Iterator[tuple]:
        whole, part = Remembered(lambda codes: search(codes, START)), Remembered(ways)
        for conv, rows in groupby(records, key=lambda r: r[0]):
            total = [0, 0, 0, 0, 0]
            low = high = last = None
            blocks, found = [], []
            for _, block, _, blank, again, cut_off, illegal, turns, least, most, first, final, codes, *known in rows:
                for i, n in enumerate((blank, again, cut_off, illegal, turns)):
                    total[i] += n
                if final is None:
                    blocks.append((block, False))
                    continue
                if last is not None and not _legal(last, first):
                    total[3] += 1
                last = final
                if least is not None:
                    low, high = least if low is None else low, most
                blocks.append((block, True))
                found.append((codes, known))
            if len(found) == 1 and found[0][0] is not None:
                cost, audit = whole[found[0][0]]
                audits = [audit]
            else:
                cost, audits = chain([known if codes is None else part[codes] for codes, known in found])
            gaps = 0 if low is None else high - low + 1 - total[4]
            facts = (gaps, *total[:4], cost)
            left = iter(audits)
            for block, pieces in groupby(blocks, key=lambda b: b[0]):
                yield (conv, block, "".join(next(left) for _, some in pieces if some), *(facts or (None,) * 6))
                facts = None

    return lambda batches: _batched(plan(_records(batches)), schema)


def _edited(records: Iterator[tuple]) -> Iterator[tuple]:
    """A conversation's records, plans before the rows of their block, to edits in order:
    ``letter, role, text``; inserted rows have an empty text, deleted ones their own."""
    state, letters = START, iter("")
    for record in records:
        _, _, is_row, _, role, _, text, copies, audit, *_ = record
        if not is_row:
            # What a block inserts after its last row comes before the next block.
            for letter in letters:
                state = _NEXT[state]
                yield letter, _NAMES[state], ""
            letters = iter(audit)
            continue
        for _ in range(copies):
            for letter in letters:
                if letter != "I":
                    break
                state = _NEXT[state]
                yield letter, _NAMES[state], ""
            if letter == "K":
                state = _AFTER[role[:1]][state]
            elif letter == "R":
                state = _NEXT[state]
                role = _NAMES[state]
            yield letter, role, text
    for letter in letters:
        state = _NEXT[state]
        yield letter, _NAMES[state], ""


def _digests(schema: pa.Schema):
    """Sorted plans and rows to a row per conversation."""

    def run(records: Iterator[tuple]) -> Iterator[tuple]:
        for conv, rows in groupby(records, key=lambda r: r[0]):
            head = next(rows)

            def every(head=head, rows=rows):
                yield head
                yield from rows

            sha, audit, some = hashlib.sha256(), [], False
            for letter, role, text in _edited(every()):
                audit.append(letter)
                if letter != "D":
                    sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            yield (conv, *head[-6:], "".join(audit), sha.hexdigest())

    return lambda batches: _batched(run(_records(batches)), schema)


def _rows(schema: pa.Schema):
    """Sorted plans and rows to the rows of repaired conversations."""

    def run(records: Iterator[tuple]) -> Iterator[tuple]:
        for conv, rows in groupby(records, key=lambda r: r[0]):
            kept = (e for e in _edited(rows) if e[0] != "D")
            for place, (letter, role, text) in enumerate(kept):
                yield conv, place, role, text, letter

    return lambda batches: _batched(run(_records(batches)), schema)


# Tables


def facts(rows: DataFrame, copies: Column, piece: int = PIECE) -> DataFrame:
    """Stored: equal rows of a conversation and turn as one, with their number ``copies``,
    ``initial, blank, cut`` and ``same``, a digest of conversation, role and text.

    Rows of no copies become one row for each conversation, which says that it is there.
    """
    there = copies > 0
    one = rows.select(
        F.col("conv"),
        *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")],
        F.when(there, copies).otherwise(0).cast("bigint").alias("copies"),
    )
    one = one.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ended = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    named = F.concat(
        F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")), F.lit("\0"),
        F.char_length("role").cast("string"), F.lit("\0"), F.col("role"), digest,
    )
    return materialize(
        one.select(
            "*",
            F.expr(f"turn div {piece}").alias("block"),
            F.substring("role", 1, 1).alias("initial"),
            (ended == "").alias("blank"),
            (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut"),
            digest.alias("digest"),
            F.sha2(named.cast("binary"), 256).alias("same"),
        ),
        "turns",
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: an earlier turn of the conversation has this role and text."""
    said = rows.where("copies > 0")
    least = said.groupBy("same").agg(
        F.when(F.count("*") == F.count("turn"), F.min("turn")).alias("least"), F.count("*").alias("n")
    )
    found = join_groups(said.drop("text"), least.where("n > 1"), "same", "n", "left")
    again = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("least"))
    none = rows.where("copies = 0").drop("text").withColumn("again", F.lit(False))
    return found.withColumn("again", again).drop("least", "n").unionByName(none)


def _stream(rows: DataFrame, copies: Column, piece: int) -> DataFrame:
    """Plans and rows of every conversation, one after another in a partition."""
    conv = rows.schema["conv"].dataType
    stored = facts(rows, copies, piece)
    cut = T.StructType().add("conv", conv).add("block", "long").add("number", "integer")
    for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high"):
        cut = cut.add(c, "long")
    cut = cut.add("first", "string").add("last", "string").add("codes", "string").add("costs", T.ArrayType(T.LongType())).add("audits", "binary")
    pieces = (
        with_repeats(stored)
        .select("conv", "block", "turn", "initial", "blank", "again", "cut", "copies", "role", "digest")
        .repartition("conv", "block")
        .sortWithinPartitions("conv", "block", "turn", "role", "digest")
        .drop("role", "digest")
        .mapInArrow(_pieces(to_arrow_schema(cut), piece), cut)
    )
    planned = T.StructType().add("conv", conv).add("block", "long").add("audit", "string")
    for c in (*_FACTS, "cost"):
        planned = planned.add(c, "long")
    plans = (
        pieces.repartition("conv")
        .sortWithinPartitions("conv", "block", "number")
        .mapInArrow(_plans(to_arrow_schema(planned)), planned)
    )
    plans = materialize(plans, "plans")
    texts = stored.where("copies > 0").select(
        "conv", "block", F.lit(True).alias("is_row"), "turn", "role", "digest", "text", "copies"
    )
    every = plans.withColumn("is_row", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    return (
        every.repartition("conv")
        .sortWithinPartitions("conv", "block", "is_row", "turn", "role", "digest")
        .select(
            "conv", "block", "is_row", "turn", "role", "digest", "text", "copies", "audit", *_FACTS, "cost"
        )
    )


def _given(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.col("copies"),
    )


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: Column | None = None, piece: int = PIECE,
) -> DataFrame:
    """A row per conversation: its id, ``gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``.

    Rows go by turn, null turns first; rows of one turn by role, then by the digest of their
    text. ``copies`` says how often a row stands there, with 0 for a row that is lost; a
    conversation that lost all has zeros, an empty audit and an empty text's digest. Null
    roles and texts are one space, so the text is blank; a null conversation is one. A
    role that begins with none of s, u, a can only be changed or deleted. Other columns are
    not looked at. An empty table gives an empty result.
    """
    given = _given(rows.withColumn("copies", F.lit(1) if copies is None else copies), conv, turn, role, text)
    out = T.StructType().add("conv", given.schema["conv"].dataType)
    for c in (*_FACTS, "cost"):
        out = out.add(c, "long")
    out = out.add("audit", "string").add("repaired_sha256", "string")
    stream = _stream(given, F.col("copies"), piece)
    return stream.mapInArrow(_digests(to_arrow_schema(out)), out).withColumnRenamed("conv", conv)


def repaired_rows(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: Column | None = None, piece: int = PIECE,
) -> DataFrame:
    """The repaired conversations: id, ``place`` from 0 on, role, text and the ``edit`` that
    made the row (K, R or I). Cases are as for ``repair``; a conversation that keeps nothing
    has no rows here."""
    given = _given(rows.withColumn("copies", F.lit(1) if copies is None else copies), conv, turn, role, text)
    out = T.StructType().add("conv", given.schema["conv"].dataType).add("place", "long")
    out = out.add("role", "string").add("text", "string").add("edit", "string")
    stream = _stream(given, F.col("copies"), piece)
    return stream.mapInArrow(_rows(to_arrow_schema(out)), out).toDF(conv, "place", role, text, "edit")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults by a hash of ``conversation:turn`` modulo 20, and ``copies``.

    0 loses the row, 1 its text, 2 its ``.!?``, 3 repeats it, 4 makes its role user. Nulls
    are one space, in the hashed key too; null turns stay null in the result.
    """
    key = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    )
    kind = F.crc32(key.cast("binary")) % 20
    role_, text_ = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    return rows.select(
        conv,
        turn,
        F.when(kind == 4, F.lit("user")).otherwise(role_).alias(role),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text_, "[.!?]", "")).otherwise(text_).alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )
