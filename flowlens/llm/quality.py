"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Each document has a vector of transformed statistics. For every group the location and
scatter are minimum-covariance-determinant estimates: starting from two first guesses,
the three quarters of the documents that are nearest by the present estimate give the
next one, which never has a larger determinant; the start that ends with the smaller
one is taken, then re-estimated once from all documents that are not far away.
Documents beyond a high quantile of the distance are rejected.

A step is one aggregation: documents are counted and their products summed by group and
narrow range of distance, so a group's nearest part is a sum of ranges and no task sees
all documents of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.words import distinct, mix, shingles, tokenize
from flowlens.session import materialize

SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "words", "vocabulary", "symbols", "dup_lines", "repeats")
P = len(FEATURES)
#: Spread that every feature has at least: many are zero in most documents.
FLOORS = np.array([0.05, 0.25, 0.15, 0.04, 0.12, 0.12])
CORE = 0.75  # share of a group that makes its estimate
LEAST_GROUP = 100  # smaller groups go by the estimate of their language
STEPS = 8
QUANTILE = 1 - 1e-9
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_BATCH = 512


def chi2_cdf(x: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, p) < q else (low, middle)
    return (low + high) / 2


def _counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Statistics of texts, as whole numbers."""
    n = len(texts)
    data = [(t or "").encode() for t in texts]
    ids, ends, vocabulary = tokenize(data, lower=False)
    starts = np.concatenate([[0], ends[:-1]]) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), ends - starts)
    chars = np.zeros(n, np.int64)
    symbols, lines, dup_lines = chars.copy(), chars.copy(), chars.copy()
    for i, text in enumerate(texts):
        if text:
            chars[i] = len(text) - sum(map(text.count, " \t\n\v\f\r"))
            symbols[i] = sum(map(text.count, SYMBOLS))
            filled = [line for line in data[i].split(b"\n") if line.strip()]
            lines[i] = len(filled)
            dup_lines[i] = len(filled) - len(set(filled))
    repeats = chars * 0
    different = repeats
    if len(ids):
        known = mix(np.arange(1, len(vocabulary) + 1, dtype=np.uint64))
        runs, of = shingles(known[ids], ends, 3)
        order = np.lexsort((runs, of))
        a, o = runs[order], of[order]
        equal = (a[1:] == a[:-1]) & (o[1:] == o[:-1])
        again = np.zeros(len(a), bool)
        again[1:] |= equal
        again[:-1] |= equal
        # Run k of a text begins at its word k; three words belong to it.
        first_run = np.searchsorted(of, np.arange(n))
        begin = starts[o] + order - first_run[o]
        hit = np.zeros(len(ids) + 2, bool)
        for k in range(3):
            hit[begin[again] + k] = True
        repeats = np.bincount(owner[hit[: len(ids)]], minlength=n)
        _, holder = distinct(ids.astype(np.uint64), owner)
        different = np.bincount(holder, minlength=n)
    return {
        "n_words": ends - starts, "word_chars": chars, "n_symbols": symbols, "n_lines": lines,
        "n_dup_lines": dup_lines, "n_repeat_words": repeats, "n_distinct": different,
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")


def statistics(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """Id, language, source and statistics of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(begin, _BATCH)
                found = _counts(batch.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], *[pa.array(found[c].astype(np.int64)) for c in _LONGS]],
                    names=["doc_id", "lang", "source", *_LONGS],
                )

    kept = rows.drop("text").schema
    for c in _LONGS:
        kept = kept.add(c, T.LongType())
    return rows.mapInArrow(run, kept)


def features() -> list[Column]:
    """The transformed statistics; shares by the arcsine of the root, sizes by logarithm."""

    def share(part: str, whole: str) -> Column:
        ratio = F.col(part) / F.greatest(F.col(whole), F.lit(1))
        return F.asin(F.sqrt(F.least(ratio, F.lit(1.0))))

    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log(words),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


def _distance(mean: list[Column], inverse: dict, x: list[Column]) -> Column:
    d = [a - m for a, m in zip(x, mean)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1 if i == j else 2) * inverse[i, j] * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


_PARAMS = [f"m{i}" for i in range(P)] + [f"v{i}{j}" for i, j in _PAIRS]
_PARAM_SCHEMA = "grp string, start int, " + ", ".join(f"{c} double" for c in _PARAMS) + ", spread double"


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(P)]
    mean = [F.col(f"m{i}") for i in range(P)]
    inverse = {(i, j): F.col(f"v{i}{j}") for i, j in _PAIRS}
    joined = rows.join(params, ["grp", "start"])
    return joined.withColumn("distance", _distance(mean, inverse, x))


def _estimate(rows: DataFrame, share: float, limit: float | None = None) -> DataFrame:
    """New parameters from rows with a distance: from the nearest ``share`` of each group,
    or, with ``limit``, from those that are at most so far away."""
    if limit is None:
        bin_ = F.floor(F.log2(F.col("distance") + 1e-6) * 16)
    else:
        rows, bin_ = rows.where(F.col("distance") <= limit), F.lit(0).cast("bigint")
    sums = rows.groupBy("grp", "start", bin_.alias("bin")).agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS],
    )

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy(float)
        wanted = share * n.sum()
        # Of the range that the share ends in, the part that is still wanted.
        before = np.cumsum(n) - n
        part = np.clip((wanted - before) / n, 0, 1)
        total = (n * part).sum()
        mean = np.array([(pdf[f"s{i}"] * part).sum() for i in range(P)]) / total
        cov = np.zeros((P, P))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = (pdf[f"q{i}{j}"] * part).sum() / total - mean[i] * mean[j]
        # The nearest part of a normal sample is too narrow by a known factor.
        if share < 1:
            cov *= share / chi2_cdf(chi2_quantile(share, P), P + 2)
        cov[np.diag_indices(P)] = np.maximum(cov.diagonal(), 0) + FLOORS**2
        inverse = np.linalg.inv(cov)
        return pd.DataFrame(
            [[*key, *mean, *[inverse[i, j] for i, j in _PAIRS], np.linalg.slogdet(cov)[1]]],
            columns=["grp", "start", *_PARAMS, "spread"],
        )

    return sums.groupBy("grp", "start").applyInPandas(solve, _PARAM_SCHEMA)


def _first_guesses(rows: DataFrame) -> DataFrame:
    """Start 0: medians and quartile ranges. Start 1: mean and covariance of all."""
    quartiles = rows.where("start = 0").groupBy("grp").agg(
        *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(P)]
    )
    zero = F.lit(0.0)
    robust = quartiles.select(
        "grp",
        F.lit(0).alias("start"),
        *[F.get(f"p{i}", F.lit(1)).alias(f"m{i}") for i in range(P)],
        *[
            (
                1 / (F.pow((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349, F.lit(2)) + float(FLOORS[i] ** 2))
                if i == j
                else zero
            ).alias(f"v{i}{j}")
            for i, j in _PAIRS
        ],
        zero.alias("spread"),
    )
    # Without a distance all rows are equally near.
    plain = quartiles.select("grp", F.lit(1).alias("start"), *[zero.alias(c) for c in _PARAMS], zero.alias("spread"))
    return robust.unionByName(plain)


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    quantile: float = QUANTILE, least_group: int = LEAST_GROUP, steps: int = STEPS,
) -> DataFrame:
    """Id, statistics, ``base_failed``, ``distance`` and ``kept`` for every row.

    A document fails the base rules with fewer than 50 words, or when more than half of
    its words are in three-word runs that the text has twice. Others are kept unless
    their vector lies beyond ``quantile`` of the distance in its language and source.
    Null is a language and a source like others. Groups with fewer than ``least_group``
    documents that pass the base rules go by the estimate of all documents of their
    language, or, where these are fewer too, of all documents; if even these are fewer,
    the base rules alone decide. Null and empty texts
    have no words and fail. Repeated rows stay, an empty table gives an empty result.
    """
    stats = materialize(
        statistics(docs, doc_id, text, lang, source).withColumn(
            "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        ),
        "statistics",
    )
    good = stats.where(~F.col("base_failed"))
    enough = lambda n: F.col(n) >= least_group
    sizes = materialize(good.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    by_lang = sizes.groupBy(F.col("lang").alias("_l")).agg(
        F.sum("n").alias("lang_n"), F.min(enough("n")).alias("all_sources")
    )
    whole = by_lang.agg(F.sum("lang_n").alias("total"), F.min(enough("lang_n")).alias("all_langs"))
    one = F.when(enough("n"), F.concat(F.lit("1"), F.to_json(F.struct("lang", "source"))))
    language = F.when(enough("lang_n"), F.concat(F.lit("2"), F.to_json(F.struct("lang"))))
    every = F.when(enough("total"), F.lit("3"))
    groups = materialize(
        sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")))
        .join(F.broadcast(whole))
        .select(
            F.col("lang").alias("_lang"),
            F.col("source").alias("_source"),
            F.coalesce(one, language, every).alias("grp"),
            F.array_compact(
                F.array(one, F.when(~F.col("all_sources"), language), F.when(~F.col("all_langs"), every))
            ).alias("counted_in"),
        ),
        "groups",
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    vectors = materialize(
        good.join(groups, same).select(
            F.explode("counted_in").alias("grp"), *[x.alias(f"x{i}") for i, x in enumerate(features())]
        ),
        "vectors",
    )
    rows = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    params = materialize(_first_guesses(rows), "estimates")
    for _ in range(steps):
        params = materialize(_estimate(_with_distance(rows, params), CORE), "estimates")
    best = params.groupBy("grp").agg(F.min_by("start", F.struct("spread", "start")).alias("start"))
    best = params.join(best, ["grp", "start"])
    near = _with_distance(rows, best)
    final = materialize(_estimate(near, 1.0, chi2_quantile(0.975, P)), "estimates")

    x = {f"x{i}": f for i, f in enumerate(features())}
    judged = (
        stats.join(groups.drop("counted_in"), same, "left")
        .drop("_lang", "_source")
        .withColumns(x)
        .join(final.drop("start", "spread"), "grp", "left")
        .withColumn(
            "distance",
            F.when(
                ~F.col("base_failed") & F.col("m0").isNotNull(),
                _distance(
                    [F.col(f"m{i}") for i in range(P)],
                    {(i, j): F.col(f"v{i}{j}") for i, j in _PAIRS},
                    [F.col(f"x{i}") for i in range(P)],
                ),
            ),
        )
    )
    near_enough = F.coalesce(F.col("distance") <= chi2_quantile(quantile, P), F.lit(True))
    return judged.select(
        "doc_id", "lang", "source", *_LONGS, "base_failed", "distance",
        (~F.col("base_failed") & near_enough).alias("kept"),
    )
