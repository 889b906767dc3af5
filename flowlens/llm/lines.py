"""Line deduplication by a segment-partition edit join.

Lines within a few edits of each other share a segment: if a line is cut into one segment
more than there are edits, one of them is in the other line unchanged, and not far from
its old place. Lines are indexed by their segments and probe, by length, the substrings
that can be such a segment. Lines that meet, and have enough smaller pieces in common, are
compared by a banded bit-parallel edit distance. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.linking import link_groups, lookup
from flowlens.llm.words import let, unused
from flowlens.session import materialize

EDITS = 2
FILLED = r"[^\x20\x09-\x0D]"  # what a line that is not blank has
LEAST = 20  # shorter lines are compared for equality only
PIECES = 8  # of a line, all but as many as there are edits are in a line near it


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row, doc_id, pos, line, id`` of all lines that are not blank.

    ``row`` stands for a row's id and text, ``id`` for a line.
    """
    lines = docs.select(
        F.xxhash64(F.col(doc_id), F.col(text)).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"),
    )
    return lines.where(F.col("line").rlike(FILLED)).withColumn("id", F.xxhash64("line"))


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """``bucket, id, lead`` of ``id, line, n``, n its length: index keys lead, probes do not.

    A line is cut into ``edits + 1`` segments; as many as the division leaves over, the
    last ones, are one longer. It probes lengths up to its own. Segment i of a line
    shorter by ``less`` can be found shifted by ``s`` only if the parts before it allow
    at most i edits and those behind it the rest, which bounds s on both sides.
    """
    parts = edits + 1
    kinds = [
        F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
        for less in range(parts)
        for i in range(parts)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]
    # One row for each key, so that its place is computed by a short expression.
    rows = lines.select("id", "line", "n", F.inline(F.array(*kinds)))
    rows = rows.selectExpr(
        "*", f"cast((n - less) div {parts} as int) as short", f"(n - less) % {parts} as longer"
    )
    rows = rows.selectExpr(
        "*",
        f"i * short + greatest(i - {parts} + longer, 0) + shift as start",
        f"short + cast(i >= {parts} - longer as int) as size",
    )
    return rows.where("start >= 0 and start + size <= n").selectExpr(
        "xxhash64(n - less, i, substring(line, start + 1, size)) as bucket", "id", "less = 0 and shift = 0 as lead"
    )


def _without_common(pair: Column) -> Column:
    """The texts ``x, y`` of a struct without their common beginning, both reversed.

    The beginning's length is found by halving steps.
    """

    def cut(p: Column) -> Column:
        most = F.least(F.char_length(p["x"]), F.char_length(p["y"]))
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda s: s <= most)
        begin = F.struct(F.lit(0).alias("at"), p["x"].alias("x"), p["y"].alias("y"))

        def step(acc: Column, s: Column) -> Column:
            fits = (acc["at"] + s <= F.least(F.char_length(acc["x"]), F.char_length(acc["y"]))) & (
                F.substr(acc["x"], acc["at"] + 1, s) == F.substr(acc["y"], acc["at"] + 1, s)
            )
            return F.struct(
                F.when(fits, acc["at"] + s).otherwise(acc["at"]).alias("at"), acc["x"].alias("x"), acc["y"].alias("y")
            )

        def rest(acc: Column, name: str) -> Column:
            return F.reverse(F.substr(acc[name], acc["at"] + 1, F.lit((1 << 31) - 1))).alias(name)

        return F.aggregate(steps, begin, step, lambda acc: F.struct(rest(acc, "x"), rest(acc, "y")))

    return let(pair, cut)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two texts if it is at most ``edits``, else a larger number.

    The vectors hold, for the rows of a band around the diagonal, where the distance
    grows or falls by one from row to row; bit 2 * edits is the band's last row. One
    step moves the band down the diagonal by one column. While the band's last row is
    above the text's last, the distance is followed along the diagonal; then along the
    last row. Both texts get the same start, so that the band begins inside them.
    """
    width = 2 * edits + 1
    ones = (1 << width) - 1
    pad = "\u0001" * (edits + 1)
    right = F.split(F.concat(F.lit(pad), b), "")

    def bits(x: Column) -> Column:
        return x.bitwiseAND(F.lit(ones))

    def flip(x: Column) -> Column:
        return F.lit(ones).bitwiseXOR(x)

    state = F.struct(
        F.lit(((1 << (edits + 1)) - 1) << edits).alias("up"),
        F.lit(0).alias("down"),
        F.lit(edits).alias("distance"),
        F.lit(0).alias("column"),
        F.split(F.concat(F.lit(pad), a), "").alias("left"),
    )

    def step(acc: Column, char: Column) -> Column:
        # No row of the band is lower than its last by more than the band's height, and the
        # least of a column never falls, so such a pair is lost and needs no more work.
        lost = acc["distance"] > 3 * edits
        return F.when(lost, acc).otherwise(advance(acc, char))

    def advance(acc: Column, char: Column) -> Column:
        column, left = acc["column"] + 1, acc["left"]
        same = F.lit(0)
        for k in range(width):  # the row that is k above the band's last
            row = column + (edits - k)
            same = same + F.when(F.get(left, row - 1) == char, 1 << (width - 1 - k)).otherwise(0)
        given = F.struct(
            same.alias("same"), column.alias("column"), acc["up"].alias("up"), acc["down"].alias("down"),
            acc["distance"].alias("distance"), acc["left"].alias("left"),
        )
        return let(let(given, diagonals), rest)

    def diagonals(x: Column) -> Column:
        same, up, down = x["same"], x["up"], x["down"]
        carried = bits(same.bitwiseAND(up) + up)
        diagonal = carried.bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down)
        return F.struct(
            up.alias("up"), down.alias("down"), diagonal.alias("d"), x["column"].alias("column"),
            x["distance"].alias("distance"), x["left"].alias("left"),
        )

    def rest(x: Column) -> Column:
        right_up = bits(x["down"].bitwiseOR(flip(x["d"].bitwiseOR(x["up"]))))
        right_down = x["d"].bitwiseAND(x["up"])
        # Bit of the last row of the text, once the band has reached it.
        over = x["column"] + edits - F.size(x["left"])
        bit = F.when(over < width, F.call_function("shiftright", F.lit(1 << (width - 1)), over)).otherwise(0)
        along = F.when(
            over <= 0, F.when(x["d"].bitwiseAND(F.lit(1 << (width - 1))) != 0, 0).otherwise(1)
        ).otherwise(
            F.when(right_up.bitwiseAND(bit) != 0, 1).otherwise(0)
            - F.when(right_down.bitwiseAND(bit) != 0, 1).otherwise(0)
        )
        below = F.shiftright(x["d"], 1)
        return F.struct(
            bits(right_down.bitwiseOR(flip(below.bitwiseOR(right_up)))).alias("up"),
            below.bitwiseAND(right_up).alias("down"),
            (x["distance"] + along).alias("distance"),
            x["column"].alias("column"),
            x["left"].alias("left"),
        )

    near = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    return F.when(near, F.aggregate(right, state, step, lambda acc: acc["distance"])).otherwise(edits + 1)


def _share_pieces(a: Column, b: Column, edits: int) -> Column:
    """Whether so many pieces of ``a`` are in ``b`` that both can be within some edits.

    An edit changes one piece at most; the others are somewhere in the other line.
    """
    n = F.char_length(a)
    cuts = [(n * F.lit(k) / PIECES).cast("int") for k in range(PIECES + 1)]
    pieces = [F.substr(a, low + 1, high - low) for low, high in zip(cuts, cuts[1:])]
    return sum((F.contains(b, piece).cast("int") for piece in pieces), F.lit(0)) >= PIECES - edits


def _near(texts: DataFrame, edits: int) -> DataFrame:
    """The pairs ``a, b`` of ``a, b, line_a, line_b`` within ``edits`` edits."""
    texts = texts.where(_share_pieces(F.col("line_a"), F.col("line_b"), edits))
    # What lines begin and end with alike does not change their distance.
    pair = F.struct(F.col("line_a").alias("x"), F.col("line_b").alias("y"))
    trimmed = _without_common(_without_common(pair))
    near = let(trimmed, lambda p: edit_distance(p["x"], p["y"], edits) <= edits)
    return texts.where(near).select("a", "b")


def line_classes(lines: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``id, component`` of the distinct lines that are within ``edits`` edits of another,
    or connected by such lines. Lines shorter than ``least`` characters are left out."""
    long = lines.select("id", "line", F.char_length("line").alias("n")).where(F.col("n") >= least)
    members = _keys(long, edits)

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        texts = long.select("id", "line").join(lookup(ids), "id").dropDuplicates(["id"])
        texts = materialize(texts, "line_texts")
        both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
        both = both.where(F.abs(F.char_length("line_a") - F.char_length("line_b")) <= edits)
        return _near(both, edits)

    return link_groups(members, confirm)


def repeated_lines(
    docs: DataFrame, edits: int = EDITS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row, pos`` of every line that repeats an earlier one.

    Lines are the parts of a text between line breaks that are not blank. Equal lines,
    and lines of at least ``least`` characters within ``edits`` edits of each other, are
    of one class, and so is what they connect. The first line of a class, by document id
    (null last), then row, then position, stays; the others repeat it. Null and empty
    texts have no lines. Rows equal in id and text count as one row: their lines do not
    repeat each other's, and both lose the same lines.
    """
    lines = split_lines(docs, doc_id, text)
    near = line_classes(lines, edits, least)
    places = lines.select("id", "row", "doc_id", "pos")
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    by_line = places.groupBy("id").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    named = by_line.join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialize(named, "line_firsts")
    class_first = (
        named.groupBy("component")
        .agg(F.min("first").alias("class_first"), F.max("last").alias("class_last"))
        .where("class_first <> class_last")
    )
    several = materialize(named.join(class_first, "component").select("id", "class_first"), "several")
    return (
        places.join(lookup(several), "id")
        .where((F.col("row") != F.col("class_first.row")) | (F.col("pos") != F.col("class_first.pos")))
        .select("row", "pos")
        .distinct()
    )


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: id, number of lines that are not blank, of those that repeat, and the
    positions of the latter among all lines, from 0, joined by commas."""
    gone = (
        repeated_lines(docs, doc_id=doc_id, text=text, **options)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    )
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    filled = F.filter(parts, lambda p: p.rlike(FILLED))
    rows = docs.select(
        F.xxhash64(F.col(doc_id), F.col(text)).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.size(filled).cast("bigint").alias("n_lines"),
    )
    none = F.expr("cast(array() as array<int>)")
    return rows.join(gone, "row", "left").select(
        "doc_id",
        "n_lines",
        F.size(F.coalesce("gone", none)).cast("bigint").alias("n_repeated"),
        F.array_join(F.coalesce("gone", none), ",").alias("repeated"),
    )


def drop_repeated_lines(
    docs: DataFrame, edits: int = EDITS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the lines that repeat earlier ones taken out of the texts.

    Rows, columns, blank lines and texts that lose nothing stay as they are, so a text
    may become empty; null texts stay null.
    """
    row, gone_row, gone = unused(docs.columns, "row", "gone_row", "gone")
    lost = (
        repeated_lines(docs, edits, least, doc_id, text)
        .groupBy(F.col("row").alias(gone_row))
        .agg(F.collect_set("pos").alias(gone))
    )
    left = F.filter(
        F.transform(
            F.split(F.col(text), "\n", -1),
            lambda line, i: F.when(~F.array_contains(F.col(gone), i), line),
        ),
        lambda line: line.isNotNull(),
    )
    return (
        docs.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text)))
        .join(lost, F.col(row) == F.col(gone_row), "left")
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
        .select(*docs.columns)
    )
