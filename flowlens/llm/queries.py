"""One query for each operator, with its own parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (
    audit,
    bigrams,
    exact,
    fingerprints,
    language,
    lines,
    minhash,
    mixing,
    pieces,
    quality,
    repair,
    secrets,
    toxicity,
    urls,
)
from flowlens.queries import table


def toxicity_network(spark: SparkSession, sf_dir: str) -> toxicity.Network:
    """Trained on labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs, labels, ~language.held_out(F.col("doc_id"), 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity_network(spark, sf_dir)).select(
        "doc_id",
        language.held_out(F.col("doc_id"), 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every document, with its statistics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", "kept",
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"))
    model = bigrams.learn(docs, ~held)
    return bigrams.score(docs, ~held, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page. The number in a page's path is the document it shows;
    pages of toxic or low-quality documents are labelled block, others allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")
    )
    shown = F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint)")
    labelled = (
        pages.withColumn("doc_id", shown)
        .join(labels.where("bad is not null"), "doc_id")
        .select("url", F.when(F.col("bad"), urls.BLOCK).otherwise(urls.ALLOW).alias("label"))
    )
    return urls.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("source")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-equal documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=3, percent=85)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digest(pieces.encode_documents(docs, model))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edited copy."""
    return fingerprints.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that repeat earlier ones."""
    return lines.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(rows), copies=F.col("copies"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document, and the row of it that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.find(docs).select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and remove in every order, by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels")).drop("filter")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_secrets,
        op3_quality,
        op4_language,
        op5_urls,
        op6_mix,
        op7_minhash,
        op8_pieces,
        op9_fingerprints,
        op10_lines,
        op11_repair,
        op12_exact,
        op13_audit,
    )
}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_MIX_SQL = f"""
    WITH s AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size
               FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
    w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM src),
    x AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight FROM w),
    y AS (SELECT *, 2 * source_size / weight AS ratio FROM x),
    l AS (SELECT *, ((SELECT sum(source_size) FROM src) * 1.5::DOUBLE
                     - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, place
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY ratio, place
                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM y),
    t AS (SELECT source, source_size,
                 least(2.0::DOUBLE * source_size, max(level) OVER () * weight)::DOUBLE AS target FROM l),
    e AS (SELECT doc_id, source, size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM s WHERE size > 0),
    r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                                    ROWS UNBOUNDED PRECEDING) AS run FROM e),
    p AS (SELECT r.*, pass, (run + pass * source_size)::DOUBLE / target AS finish
          FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS v(pass)),
    g AS (SELECT doc_id, greatest(0, least(size, floor((SELECT sum(size) FROM s) * 1.5::DOUBLE)
                 - coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, size, pass
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM p),
    k AS (SELECT doc_id, sum(given) AS taken FROM g GROUP BY doc_id)
    SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON s.doc_id = k.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(1, len(ws) - 1),
                                     lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2])) END) AS sh
          FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
          FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM c JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
              WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach AS (SELECT doc_id AS id, doc_id AS r FROM n
              UNION SELECT ways.y, reach.r FROM reach JOIN ways ON reach.id = ways.x),
    comp AS (SELECT id, min(r) AS r FROM reach GROUP BY id)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r, w.doc_id) AS component_id,
           coalesce(r, w.doc_id) = w.doc_id AS kept
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.id = w.doc_id
"""



def _repair_sql() -> str:
    """Cheapest edits row by row: the best cost, audit and text for each last role so far
    (none, system, user, assistant), structs compared field by field."""
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"

    def add(state: str, cost: str, letter: str, *lines: str) -> str:
        text = f"{state}.r"
        for line in lines:
            text = f"{text} || CASE WHEN {text} = '' THEN '' ELSE chr(10) END || {line}"
        return (
            f"CASE WHEN {state} IS NULL THEN {none} ELSE "
            f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', r := {text}) END"
        )

    def least(*states: str) -> str:
        return f"list_aggregate([{', '.join(states)}], 'min')"

    u, a = "'user:'", "'assistant:'"
    kept, rerole = "(role || ':' || text)", "({} || text)"

    def row(before: str, initial: str, line: str) -> str:
        return least(
            f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(before, 'cut', 'K', kept)} END",
            f"CASE WHEN NOT gone THEN {add(before, '2 + cut', 'R', rerole.format(line))} END",
        )

    return f"""
    WITH RECURSIVE kinds AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda x: ascii(x)::BIGINT)),
                   lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)),
                       lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
        FROM conversations),
    convs AS (SELECT DISTINCT conv_id FROM kinds),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM kinds WHERE kind <> 0),
    placed AS (
        SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS ended,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place
        FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM placed),
    rows_ AS (
        SELECT conv_id, place, turn, role, text, left(role, 1) AS initial, ended = '' OR again AS gone,
               CASE WHEN ended = '' THEN 1 WHEN again THEN 2 WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 3 END AS fault,
               CASE WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
        FROM seen),
    walk AS (
        SELECT conv_id, 0::BIGINT AS place, struct_pack(c := 0::BIGINT, a := '', r := '') AS n,
               {none} AS s, {none} AS u, {none} AS a FROM convs
        UNION ALL
        SELECT conv_id, place, {add('n', '3', 'D')}, {least(add('s', '3', 'D'),
                   f"CASE WHEN NOT gone AND initial = 's' THEN {add('n', 'cut', 'K', kept)} END")},
               {least(add('u', '3', 'D'), row('nsa', 'u', u))}, {least(add('a', '3', 'D'), row('u', 'a', a))}
        FROM (SELECT *, {least('n', 's', 'a')} AS nsa
              FROM (SELECT w.conv_id, r.place, role, text, initial, gone, cut, n, s,
                           {least('w.u', add('n', '2', 'I', u), add('s', '2', 'I', u), add('w.a', '2', 'I', u))} AS u,
                           {least('w.a', add('w.u', '2', 'I', a), add('n', '4', 'II', u, a), add('s', '4', 'II', u, a))} AS a
                    FROM walk AS w JOIN rows_ AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1))),
    ends AS (
        SELECT conv_id, {least('n', add('s', '4', 'II', u, a), add('u', '2', 'I', a), 'a')} AS best,
               row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS back FROM walk),
    sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
               count(*) FILTER (fault = 3) AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
           coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
           sha256(best.r) AS repaired_sha256
    FROM ends AS e LEFT JOIN sums AS t ON e.conv_id IS NOT DISTINCT FROM t.conv_id WHERE back = 1
    """


_EXACT_SQL = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
    SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t ORDER BY n_chars DESC, doc_id)
"""

_AUDIT_SQL = f"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                         {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
    firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
    said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END)
                     | (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
                     | (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
                     | (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                     | (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
              FROM docs JOIN firsts USING (t) LEFT JOIN said USING (doc_id)),
    sums AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
               FROM l AS a, l AS b, l AS c, l AS d, l AS e
               WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
                     list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS done
              FROM orders, range(1, 6) AS r(step)),
    every AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (coalesce(done, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(done, 0) = 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(done, 0) <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(done, 0) = 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(done, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM sums, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
           redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
           toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM every
"""

#: The others train a model, hash in a way SQL does not offer, or encode; tests compare
#: them with brute force.
ORACLES = {"op6_mix": _MIX_SQL, "op7_minhash": _NEAR_SQL, "op11_repair": _repair_sql(), "op12_exact": _EXACT_SQL, "op13_audit": _AUDIT_SQL}
