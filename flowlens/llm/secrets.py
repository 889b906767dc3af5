"""Secrets in texts: fixed patterns, and windows of high entropy in long runs.

Everything is a projection of the text column: no shuffle and no Python. Positions are
code points. A pattern's matches are read twice, as the matched texts and as the pieces
between them; summing the lengths of both gives where each match lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group to measure, least length of the group. In the order of kinds.
PATTERNS = (
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    # Runs end where their characters end, so asking for the least length at once
    # finds the same matches as dropping the short ones.
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class CharClass:
    """A class of characters, and when a window of them is too random to be a word."""

    kind: str
    alphabet: str  # as in a regular expression's brackets
    symbols: str  # the same, written out
    window: int
    bits: float  # least entropy per character
    digits: int  # least number of digits in the window


_LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "0-9a-f", "0123456789abcdef", 20, 3.0, 4),
    CharClass(
        "entropy_base64",
        "A-Za-z0-9+/_=-",
        "0123456789" + _LOWER + _LOWER.upper() + "+/_=-",
        24,
        4.0,
        3,
    ),
)

#: Runs that match one of these are never reported by entropy.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # identifiers
    r"(?i)example|sample|dummy|placeholder|your[_-]?(key|token|secret)",
    r"^[0-9+/_=-]*$",  # numbers and rules
    r"(?i)^(0123456789)?abcdefghijklmnopqrstuvwxyz",
    r"^data/|/[a-z]+/[a-z]+/",  # paths
)

_SCALE = 1_000_000  # entropies are compared as whole numbers of this part of a bit


def _spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, stop, hit>>`` of the matches of a pattern, in order."""
    quoted = F.lit(pattern)
    hits = F.regexp_extract_all(text, quoted, F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<start:bigint,stop:bigint,hit:string>>)")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        stop = start + F.char_length(pair["hit"])
        span = F.struct(
            start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), pair["hit"].alias("hit")
        )
        return F.struct(stop.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(empty)


def _pattern_spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    spans = _spans(text, pattern)
    if group:
        lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length)
        both = F.zip_with(spans, lengths, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
        spans = F.transform(F.filter(both, lambda x: x["n"] >= least), lambda x: x["s"])
        spans = F.when(text.rlike(pattern), spans).otherwise(F.expr(
            "cast(array() as array<struct<start:bigint,stop:bigint,hit:string>>)"))
    return F.transform(spans, lambda s: _span(s["start"], s["stop"], order, kind))


def _span(start: Column, stop: Column, order: int, kind: str) -> Column:
    return F.struct(
        start.cast("bigint").alias("start"),
        F.lit(order).alias("rank"),
        stop.cast("bigint").alias("stop"),
        F.lit(kind).alias("kind"),
    )


def _random_parts(run: Column, spec: CharClass) -> Column:
    """Where windows of a run are too random: ``array<struct<start, stop>>``.

    The state holds how often each symbol is in the window. A step counts one symbol
    in and one out and changes the sum of n * log2(n) by the two differences, so no
    window is counted anew. Overlapping windows give one span.
    """
    size, symbols = spec.window, spec.symbols
    weight = [0] + [round(n * math.log2(n) * _SCALE) for n in range(1, size + 2)]
    weights = F.array(*[F.lit(w).cast("bigint") for w in weight])
    most = round((math.log2(size) - spec.bits) * size * _SCALE)
    chars = F.split(run, "")
    places = F.transform(chars, lambda c: F.instr(F.lit(symbols), c) - 1)
    steps = F.transform(
        places,
        lambda p, i: F.struct(
            p.alias("new"), F.when(i >= size, F.get(places, i - size)).otherwise(-1).alias("old"), i.alias("i")
        ),
    )
    state = F.struct(
        F.array_repeat(F.lit(0), len(symbols)).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(0).alias("digits"),
        F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        counts, new, old = acc["counts"], x["new"], x["old"]
        same = new == old
        n_in, n_out = F.get(counts, new), F.get(counts, F.greatest(old, F.lit(0)))
        change = (
            F.when(same, F.lit(0))
            .otherwise(
                F.get(weights, n_in + 1) - F.get(weights, n_in)
                + F.when(old < 0, F.lit(0)).otherwise(F.get(weights, n_out - 1) - F.get(weights, n_out))
            )
            .cast("bigint")
        )
        after = F.when(same, counts).otherwise(
            F.transform(
                counts,
                lambda n, k: n + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0),
            )
        )
        total = acc["sum"] + change
        digits = (
            acc["digits"] + F.when(new < 10, 1).otherwise(0)
            - F.when((old >= 0) & (old < 10), 1).otherwise(0)
        )
        begin = (x["i"] - (size - 1)).cast("bigint")
        found = F.struct(begin.alias("start"), (x["i"] + 1).cast("bigint").alias("stop"))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = (F.size(acc["out"]) > 0) & (last["stop"] >= begin)
        out = (
            F.when(~((begin >= 0) & (total <= most) & (digits >= spec.digits)), acc["out"])
            .when(
                joins,
                F.concat(
                    F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))),
                    F.array(F.struct(last["start"].alias("start"), found["stop"].alias("stop"))),
                ),
            )
            .otherwise(F.concat(acc["out"], F.array(found)))
        )
        return F.struct(
            after.alias("counts"), total.alias("sum"), digits.cast("int").alias("digits"), out.alias("out")
        )

    return F.aggregate(steps, state, step, lambda acc: acc["out"])


def _without(runs: Column, pattern: str) -> Column:
    return F.filter(runs, lambda r: ~r["hit"].rlike(pattern))


def _entropy_spans(text: Column, order: int, spec: CharClass, allowed: tuple[str, ...]) -> Column:
    runs = _spans(text, f"[{spec.alphabet}]{{{spec.window},}}")
    for pattern in allowed:
        runs = _without(runs, pattern)
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                _random_parts(r["hit"], spec),
                lambda s: _span(r["start"] + s["start"], r["start"] + s["stop"], order, spec.kind),
            ),
        )
    )


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    classes: tuple[CharClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """Add ``base_spans`` and ``spans``, arrays of (start, rank, stop, kind) by start, then kind.

    ``base_spans`` has the matches of the fixed patterns. ``spans`` has these and every
    stretch of a run of one character class whose sliding windows have high entropy,
    unless the run is allowed or the stretch lies in a fixed match. Null texts count
    as empty, which have no spans. All rows and columns stay; columns that have the
    two names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(
        F.concat(*[_pattern_spans(body, i, *p) for i, p in enumerate(PATTERNS)])
    )
    rows = docs.withColumn("base_spans", base)
    extra = F.concat(
        *[_entropy_spans(body, len(PATTERNS) + i, c, allowed) for i, c in enumerate(classes)]
    )
    known = F.col("base_spans")
    extra = F.filter(
        extra,
        lambda s: ~F.exists(known, lambda b: (b["start"] <= s["start"]) & (b["stop"] >= s["stop"])),
    )
    return rows.withColumn("spans", F.array_sort(F.concat(known, extra)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, separated by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    def number(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        doc_id,
        *[number(kind).alias(f"n_{kind}") for kind, *_ in PATTERNS],
        F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
