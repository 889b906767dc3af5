"""URL filtering by host rules and by mined combinations of URL tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.words import ascii_lower
from flowlens.session import discard, materialize

BLOCK, ALLOW = "block", "allow"

SUPPORT, CONFIDENCE, LEAST = 0.002, 0.6, 10

#: Verdict, host, path. A rule fits the host and all hosts below it.
RULES = (
    (BLOCK, "net", "/"),
    (ALLOW, "example.net", "/en/"),
    (BLOCK, "example.com", "/de/"),
    (ALLOW, "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and texts without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, decision).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """All distinct tokens of a URL: scheme; host, every domain it is under and every
    label before the last; every folder with and without its place, the file name and
    its ending; whether it has a query or a fragment, and every query key with and
    without its value. With its place, a folder with a digit is ``#``."""
    host, path = host_and_path(url)
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    names = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda p: p != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p != "")

    def token(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(name + "="), value))

    def placed(name: Column, i: Column) -> Column:
        plain = F.when(name.rlike("[0-9]"), "#").otherwise(name)
        return F.concat(F.lit("folder"), (i + 1).cast("string"), F.lit("="), plain)

    one = F.array(
        token("scheme", ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1))),
        token("host", host),
        token("file", F.element_at(F.split(path, "/"), -1)),
        token("ending", ascii_lower(ending)),
        token(
            "rest",
            F.when(F.instr(url, "?") > 0, "query").when(F.instr(url, "#") > 0, "fragment"),
        ),
    )
    many = F.concat(
        F.transform(parts, lambda p, i: token("under", F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))),
        F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: token("part", p)),
        F.transform(names, placed),
        F.transform(folders, lambda p: token("folder", p)),
        F.transform(pairs, lambda p: token("key", F.substring_index(p, "=", 1))),
        F.transform(F.filter(pairs, lambda p: F.instr(p, "=") > 0), lambda p: token("arg", p)),
    )
    return F.array_distinct(F.array_compact(F.concat(one, many)))


def _frequent_sets(baskets: DataFrame, single: DataFrame, need: float):
    """Token sets of every size, ``tokens, block, allow``, from those of one token on.

    A set is counted if all sets with one token less are in ``need`` URLs of a label, are
    in more URLs than it, and have both labels: any other is dominated by a smaller one.
    """
    level, size = single, 1
    held = baskets.select(
        "block", "allow", F.posexplode("items").alias("at", "token"), "items"
    ).select("block", "allow", F.array("token").alias("tokens"), F.expr("slice(items, at + 2, size(items))").alias("rest"))
    used = []
    while True:
        yield level
        size += 1
        grown = held.select(
            "block", "allow", "tokens", F.posexplode("rest").alias("at", "token"), "rest"
        ).select(
            "block", "allow", F.array_append("tokens", F.col("token")).alias("tokens"),
            F.expr("slice(rest, at + 2, size(rest))").alias("rest"),
        )
        counted = grown.groupBy("tokens").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
        counted = counted.where(F.greatest("block", "allow") >= need)
        smaller = level.where("block > 0 and allow > 0").select(
            F.col("tokens").alias("part"), (F.col("block") + F.col("allow")).alias("n")
        )
        parts = F.transform(F.col("tokens"), lambda t: F.array_except(F.col("tokens"), F.array(t)))
        fits = (
            counted.withColumn("part", F.explode(parts))
            .join(smaller, "part")
            .where(F.col("n") > F.col("block") + F.col("allow"))
            .groupBy("tokens")
            .agg(F.max("block").alias("block"), F.max("allow").alias("allow"), F.count("*").alias("parts"))
            .where(F.col("parts") == size)
            .drop("parts")
        )
        level = materialize(fits, "sets")
        if level.isEmpty():
            discard(level)
            break
        before = held
        still = level.where("block > 0 and allow > 0").select("tokens")
        held = materialize(grown.where(F.size("rest") > 0).join(still, "tokens", "left_semi"), "held")
        used.append(held)
        if len(used) > 1:
            discard(before)
    if used:
        discard(used[-1])


def mine_rules(
    labelled: DataFrame, url: str, label: str, support: float = SUPPORT,
    confidence: float = CONFIDENCE, least: int = LEAST,
) -> DataFrame:
    """Rules ``tokens, verdict, support, confidence`` from labelled URLs.

    ``label`` is block or allow; rows with another label or without tokens are not
    counted. A rule holds for at least the share ``support`` of the labelled URLs, and
    for ``least`` of them, and is right for the share ``confidence`` of those that have its tokens. Rules to allow
    must also be right more often than allowing everything. A rule is dropped when
    another with fewer of its tokens has the same verdict and is as sure. Token sets grow
    by one token at a time; support and what smaller sets say bound them, not their size.
    """
    rows = labelled.select(tokens(F.col(url)).alias("tokens"), F.col(label).alias("label"))
    rows = rows.where(F.col("label").isin(BLOCK, ALLOW) & (F.size("tokens") > 0)).select(
        "tokens", (F.col("label") == BLOCK).cast("bigint").alias("block"), (F.col("label") == ALLOW).cast("bigint").alias("allow"),
    )
    schema = "tokens array<string>, verdict string, support double, confidence double"
    rows = materialize(rows, "labelled")
    total, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0))).first()
    if not total:
        return labelled.sparkSession.createDataFrame([], schema)
    need = min(total, max(support * total, least))
    single = (
        rows.select(F.explode("tokens").alias("token"), "block", "allow")
        .groupBy(F.array("token").alias("tokens"))
        .agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
        .where((F.greatest("block", "allow") >= need) & (F.col("block") + F.col("allow") < total))
    )
    single = materialize(single, "sets")
    open_tokens = single.where("block > 0 and allow > 0").select(F.get("tokens", F.lit(0)).alias("token"))
    baskets = (
        rows.withColumn("id", F.monotonically_increasing_id())
        .select("id", "block", "allow", F.explode("tokens").alias("token"))
        .join(F.broadcast(open_tokens), "token")
        .groupBy("id", "block", "allow")
        .agg(F.sort_array(F.collect_list("token")).alias("items"))
        .groupBy("items")
        .agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    )
    baskets = materialize(baskets, "baskets")
    levels = list(_frequent_sets(baskets, single, need))
    discard(baskets)
    discard(rows)
    sets = levels[0]
    for level in levels[1:]:
        sets = sets.unionByName(level)
    share = {BLOCK: blocked / total, ALLOW: (total - blocked) / total}
    each = [
        sets.where(F.col(v) >= need).select(
            F.array_sort("tokens").alias("tokens"),
            F.lit(v).alias("verdict"),
            (F.col(v) / total).alias("support"),
            (F.col(v) / (F.col("block") + F.col("allow"))).alias("confidence"),
        ).where((F.col("confidence") >= confidence) & (F.col("confidence") > share[v]))
        for v in (BLOCK, ALLOW)
    ]
    # Stored, so that the levels' plans are not repeated in what follows.
    rules = materialize(each[0].unionByName(each[1]), "rules")
    for level in levels:
        discard(level)
    # Each rule looks up those that share one of its tokens.
    smaller = rules.select(
        F.col("tokens").alias("t2"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"),
        F.explode("tokens").alias("token"),
    )
    dominated = (
        rules.withColumn("token", F.explode("tokens"))
        .join(smaller, "token")
        .where(
            (F.col("verdict") == F.col("v2"))
            & (F.size("t2") < F.size("tokens"))
            & (F.col("c2") >= F.col("confidence"))
            & (F.size(F.array_except("t2", "tokens")) == 0)
        )
        .select("tokens", "verdict")
        .distinct()
    )
    kept = rules.join(dominated, ["tokens", "verdict"], "left_anti").select(
        "tokens", "verdict", "support", "confidence"
    )
    stored = materialize(kept, "rules")
    discard(rules)
    return stored


def match_rules(urls: DataFrame, rules: DataFrame, token_col: str) -> DataFrame:
    """``token_col, mined``: the verdict of the surest rule for each distinct token set.

    Every rule is listed under its last token, which for a set in order of names is
    mostly the more telling one; a token set looks up the rules of its tokens and keeps
    those whose tokens it has. Equal confidence goes by support, then block, then the
    tokens.
    """
    index = rules.select(
        F.element_at("tokens", -1).alias("_token"),
        F.col("tokens").alias("_needs"), "verdict", "support", "confidence",
    )
    sets = urls.select(token_col).distinct()
    surest = F.max_by(
        "verdict",
        F.struct("confidence", "support", F.col("verdict"), F.col("_needs")),
    )
    return (
        sets.withColumn("_token", F.explode(token_col))
        .join(index, "_token")
        .where(F.size(F.array_except("_needs", token_col)) == 0)
        .groupBy(token_col)
        .agg(surest.alias("mined"))
    )


def judge(
    pages: DataFrame, labelled: DataFrame, url: str = "url", label: str = "label", rules=RULES,
    support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST,
) -> DataFrame:
    """Add host, path, rule and verdict to pages.

    The verdict is the longest fitting rule's; else that of the surest mined rule; else
    allow. ``labelled`` has URLs and labels to mine from; it may be empty. Null URLs,
    empty ones and repeated rows are judged like the others. Columns of the four names
    are replaced, the rest stays.
    """
    host, path = host_and_path(F.col(url))
    rule, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    mined_rules = mine_rules(labelled, url, label, support, confidence, least)
    rows = pages.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule).withColumn("_decided", decided)
    rows = rows.withColumn("_tokens", tokens(F.col(url)))
    open_sets = rows.where(F.col("_decided").isNull())
    mined = match_rules(open_sets, mined_rules, "_tokens")
    return (
        rows.join(mined, "_tokens", "left")
        .withColumn("verdict", F.coalesce("_decided", "mined", F.lit(ALLOW)))
        .drop("_tokens", "_decided", "mined")
    )
