"""Secrets, URLs, mixing and fingerprints against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import fingerprints, mixing, secrets, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int, size string"


def documents(spark, texts, sources=None, ids=None):
    """Documents with two columns whose names operators use themselves."""
    rows = [
        (
            (ids or range(len(texts)))[i], t, "en" if i % 3 else None,
            sources[i] if sources else f"s{i % 3}", len(t) if t else None, i, "x",
        )
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def entropy_spans(text):
    found = []
    for order, spec in enumerate(secrets.CLASSES, 3):
        for run in re.finditer(f"[{spec.alphabet}]{{{spec.window},}}", text):
            if any(re.search(p, run[0]) for p in secrets.ALLOWED):
                continue
            spans = []
            for i in range(len(run[0]) - spec.window + 1):
                window = run[0][i : i + spec.window]
                counts = Counter(window).values()
                bits = -sum(n / spec.window * math.log2(n / spec.window) for n in counts)
                if bits >= spec.bits - 1e-6 and sum(c.isdigit() for c in window) >= spec.digits:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + spec.window
                    else:
                        spans.append([i, i + spec.window])
            found += [(run.start() + a, order, run.start() + b, spec.kind) for a, b in spans]
    return found


def secret_texts():
    rng = random.Random(3)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
    texts = [
        None, "", "   ", "plain words only", "é🙂 password = 'abcdefgh1' x", "password=token=abcdefgh12",
        "token: secret: abcdefghij", "PassWord:short api_key=\"0123456789\" APIKEY = zzzzzzzzzz",
        "AKIA" + "A1" * 8 + " AKIAshort AKIAAKIAAKIAAKIA", f"日本 {hexes} {hexes[:31]} {hexes[:32]}",
        f"x{b64}y {b64[:20]}", "a" * 40 + b64 + "a" * 40 + b64, "0123456789abcdefghijklmnopqrstuvwxyz0",
        "example" + b64, hexes * 50, "password=" + b64 + "\ntoken=" + hexes, "abcdef0123" * 4,
        " ".join([f"secret={hexes[:9]}"] * 300), hexes[:22] + "g", "word " * 20000,
    ]
    alphabet = ["password", "=", ": ", '"', "token", "AKIA", "ABCD1234EFGH", hexes[:20], b64[:30], "é", " ", "\n", "x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    return texts


def test_secrets(spark):
    texts = secret_texts()
    docs = documents(spark, texts)
    found = secrets.find_secrets(docs)
    assert set(found.columns) == set(docs.columns) | {"base_spans", "spans"}
    got = {r["doc_id"]: r for r in secrets.digest(found).collect()}
    assert len(got) == len(texts)
    some = 0
    for i, text in enumerate(texts):
        base = base_spans(text or "")
        extra = [
            s for s in entropy_spans(text or "")
            if not any(b[0] <= s[0] and b[2] >= s[2] for b in base)
        ]
        some += len(extra)
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        row = got[i]
        assert row["spans"] == write(base + extra), text
        assert row["base_sha256"] == hashlib.sha256(write(base).encode()).hexdigest()
        kinds = Counter(k for *_, k in base)
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [
            kinds["assign"], kinds["access"], kinds["hex"]
        ]
    assert some > 20


def test_secrets_of_no_rows(spark):
    assert secrets.digest(secrets.find_secrets(documents(spark, []))).collect() == []


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/1", "https://example.net/de/5?x=/en/", "ftp://net",
    "http://net/", "http://net?x", "http://xnet/", "https://b.org/fr/2#f", "https://b.org/fr", "http://ÄB.org/fr/",
    "https://m.example.com/de/9", "https://m.example.com/en/9", "://net/a", "a://b://net/x", "http:///x",
    "https://x.example.com/en/8.html?q=1#z", "http://e\nf.net/\n/a b",
]


def plain_host_path(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path):
    fits = [
        (len(h + p), h + p, d) for d, h, p in urls.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    rng = random.Random(5)
    hosts = ["good.example.com", "bad.example.com", "some.example.org"]
    train = [
        (f"http://{h}/{lang}/{i}", "block" if h.startswith("bad") and lang == "en" or rng.random() < 0.1 else "allow")
        for i in range(600) for h in [rng.choice(hosts)] for lang in [rng.choice(["en", "fr"])]
    ]
    labelled = spark.createDataFrame([*train, (None, "block"), ("http://x.y/", None), ("", "odd")], "url string, label string")
    rows = [(i, u, "kept") for i, u in enumerate(URLS + URLS)] + [
        (None, "http://bad.example.com/en/77", "z"), (99, "http://bad.example.com/fr/77", "z"),
        (98, "http://some.example.org/en/1", "z"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    mined = urls.mine_rules(labelled, "url", "label", 0.02, 0.7, 5)
    rules = [(set(r["tokens"]), r["verdict"], r["support"], r["confidence"]) for r in mined.collect()]

    # Every rule by counting, and none missing.
    sets = [
        (set(r["t"]), r["label"])
        for r in labelled.where("label in ('allow', 'block')").select(urls.tokens(F.col("url")).alias("t"), "label").collect()
        if r["t"]
    ]
    every = {}
    for tokens, label in sets:
        names = sorted(tokens)
        for mask in range(1, 1 << len(names)):
            part = frozenset(n for k, n in enumerate(names) if mask >> k & 1)
            every.setdefault(part, Counter())[label] += 1
    share = Counter(label for _, label in sets)
    good = {
        (part, verdict): n / sum(c.values())
        for part, c in every.items() for verdict, n in c.items()
        if n >= max(5, 0.02 * len(sets)) and n / sum(c.values()) >= 0.7
        and n / sum(c.values()) > share[verdict] / len(sets)
    }
    pruned = {
        k: v for k, v in good.items()
        if not any(o[1] == k[1] and o[0] < k[0] and w >= v for o, w in good.items())
    }
    assert {(frozenset(t), v): c for t, v, _, c in rules} == pytest.approx(pruned)
    assert any(v == "block" for _, v, *_ in rules)

    judged = urls.judge(pages, labelled, support=0.02, confidence=0.7, least=5)
    got = judged.withColumn("t", urls.tokens(F.col("url"))).collect()
    assert len(got) == len(rows)
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert (r["host"], r["path"]) == plain_host_path(r["url"])
        rule, verdict = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule
        if verdict is None:
            fits = [(c, s, v, sorted(t)) for t, v, s, c in rules if t <= set(r["t"])]
            verdict = max(fits)[2] if fits else "allow"
        assert r["verdict"] == verdict
    assert urls.judge(pages, labelled.limit(0)).where("rule is null").select("verdict").distinct().collect()[0][0] == "allow"
    assert urls.judge(pages.limit(0), labelled).collect() == []


def test_url_rules_from_any_place(spark):
    """A middle label, a deep folder, a long or numbered one, a file and a query argument."""
    rng = random.Random(3)
    long = "x" * 40
    bad = {
        "part=ads-track": "http://{0}.ads-track.example.com/en/{0}",
        "folder=deep7": f"http://h.example.org/a/b/c/deep7/{{0}}",
        f"folder={long}1": f"http://h.example.org/{long}1/{{0}}",
        "file=win.php": "http://h{0}.example.net/p/q/r/win.php",
        "arg=mode=evil": "http://h.example.net/s/{0}?page=2&mode=evil#x",
    }
    good = [
        "http://{0}.shop.example.com/en/{0}", "http://h.example.org/a/b/c/deep8/{0}", f"http://h.example.org/{long}2/{{0}}",
        "http://h{0}.example.net/p/q/r/ok.php", "http://h.example.net/s/{0}?page=2&mode=good#x",
    ]
    train = [(u.format(f"k{i}"), "block") for u in bad.values() for i in range(20)]
    train += [(u.format(f"k{i}"), "allow") for u in good for i in range(20)]
    labelled = spark.createDataFrame(train, "url string, label string")
    pages = [(u.format("new"), "block") for u in bad.values()] + [(u.format("new"), "allow") for u in good]
    rows = spark.createDataFrame(pages, "url string, wanted string")
    mined = {tuple(r["tokens"]) for r in urls.mine_rules(labelled, "url", "label").where("verdict = 'block'").collect()}
    assert {(t,) for t in bad} <= mined
    judged = urls.judge(rows, labelled, rules=()).select("url", "wanted", "verdict").collect()
    assert [r for r in judged if r["wanted"] != r["verdict"]] == []


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget = share * sum(sizes.values())
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        rest = budget - sum(capped.values())
        shares = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if shares[s] > most * sizes[s]]
        if not over:
            return capped | shares
        capped |= {s: most * sizes[s] for s in over}


def plain_mix(rows):
    """Entries one by one in order of finish time."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    targets = plain_targets(sizes)
    groups = Counter(rows)
    entries = []
    for source in sizes:
        run = 0
        own = sorted(
            (hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0, z, n)
            for (d, s, z), n in groups.items() if s == source and z
        )
        for turn in range(2):
            for key, has, d, z, n in own:
                run += z * n
                entries.append((run / targets[source], source is None, source or "", key, has, d, z, turn, n, source))
    left = math.floor(1.5 * sum(sizes.values()))
    given = Counter()
    for e in sorted(entries, key=lambda e: e[:8]):
        take = min(left, e[6] * e[8])
        left -= take
        given[(e[5] if e[4] else None, e[9], e[6])] += take
    return sizes, targets, {k: v // groups[k] for k, v in given.items()}


def mix_rows():
    rng = random.Random(9)
    texts, sources, ids = [], [], []
    for i in range(400):
        n = rng.choice([0, 1, 5, 20, 100, 400])
        texts.append(" ".join(["w"] * n) if i % 50 else None)
        sources.append(rng.choice(["a", "b", "é", "z", None] + ["hot"] * 4))
        ids.append(i if i % 60 else None)
    texts += ["same words here"] * 5
    sources += ["a"] * 5
    ids += [1000] * 5
    return texts, sources, ids


def test_mix(spark, monkeypatch):
    texts, sources, ids = mix_rows()
    docs = documents(spark, texts, sources, ids)
    rows = [(d, s, len(WORD.findall(t or ""))) for d, s, t in zip(ids, sources, texts)]
    sizes, targets, taken = plain_mix(rows)
    for rows_in_range in (20_000, 7):  # one range, and many
        monkeypatch.setattr(mixing, "RANGE_ROWS", rows_in_range)
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(targets[r["source"]])
            assert r["taken"] == taken.get((r["doc_id"], r["source"], r["size"]), 0)
            assert 0 <= r["taken"] <= 2 * r["size"]
    per = defaultdict(int)
    for r in got:
        per[r["source"]] += r["taken"]
    assert all(abs(per[s] - targets[s]) <= 400 for s in sizes)


def test_mix_documents(spark):
    texts, sources, ids = mix_rows()
    docs = documents(spark, texts, sources, ids)
    whole = sum(r["taken"] for r in mixing.mix(docs).collect())
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in out.collect()) == whole
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_hash(words, i):
    """Hash of five words: each word's own hash, then these folded into one."""
    seed = 42
    for w in words[i : i + 5]:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    return signed(seed)


def plain_sketch(text):
    words = WORD.findall(text)
    every = {plain_hash(words, i) for i in range(max(1, len(words) - 4))} if words else set()
    below = {h for h in every if h < -(1 << 63) + (1 << 64) // fingerprints.SCALE}
    return sorted(below or ([min(every)] if every else []))


def test_fingerprints(spark):
    rng = random.Random(4)
    vocabulary = [f"wörd{i}" for i in range(60)]
    texts = [
        None, "", " \n ", "one", "a b c d", "a b c d e", "日本 語", "x" * 5000, "same text here now ok fine",
        "same text here now ok fine",
    ] + [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 300]))) for _ in range(40)]
    ids = [rng.choice([1, 1 << 12, 1 << 28, 1 << 40]) * (i + 1) - rng.choice([0, 1 << 62]) for i in range(len(texts))]
    assert len(set(ids)) == len(ids)
    docs = documents(spark, texts, ids=ids)
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    assert len(got) == len(texts)
    order = sorted(zip(ids, (t or "" for t in texts)), reverse=True)
    like = lambda a, b: 1.0 if a == b == [] else len({*a} & {*b}) / (min(len(a), len(b)) or 1)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        row, own = got[i], plain_sketch(text)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == ",".join(f"{h & (1 << 64) - 1:x}" for h in own)
        assert row["edited_fingerprint"] == ",".join(f"{h & (1 << 64) - 1:x}" for h in plain_sketch(edited))
        assert row["near_edited"] == pytest.approx(like(own, plain_sketch(edited)))
        assert row["near_next"] == pytest.approx(like(own, plain_sketch(after)))


def test_fingerprints_of_odd_tables(spark):
    docs = documents(spark, ["a b", "c d", "e f", "e f", None], ids=[7, 7, None, None, None])
    rows = fingerprints.with_edits(docs).collect()
    assert len(rows) == 5
    assert fingerprints.with_edits(docs.limit(0)).collect() == []
    assert len(fingerprints.with_edits(documents(spark, ["only one"])).collect()) == 1


def test_fingerprints_of_short_texts(spark):
    """What short texts share is seen exactly, however much longer the other text is."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in (12, 25, 25, 50, 50, 400, 12, 30)]
    texts[5] = texts[5] + " " + texts[4]  # holds the text with the next lower id as a whole
    got = {r["doc_id"]: r for r in fingerprints.with_edits(documents(spark, texts)).collect()}

    def shingles(text):
        words = WORD.findall(text)
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    def shared(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / min(len(a), len(b))

    for i, text in enumerate(texts):
        after = texts[(i - 1) % len(texts)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert shared(text, edited) > 0.2
        assert got[i]["near_edited"] == pytest.approx(shared(text, edited))
        assert got[i]["near_next"] == pytest.approx(shared(text, after))
    assert got[5]["near_next"] == 1
