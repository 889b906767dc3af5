"""Conversation repair against exhaustive search and a plain walk over all rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from flowlens.llm import hot, repair

GOOD = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, copies int, block string"


def outcomes(codes):
    """Every way to edit codes with at most two insertions before each and after the last:
    cost, audit and the rows' new roles, None for a deleted row."""
    places = [[]] + [["I"], ["I", "I"]]
    for gaps in product(range(3), repeat=len(codes) + 1):
        for letters in product("DKR", repeat=len(codes)):
            cost, audit = 0, ""
            options = [[]]
            for place in range(len(codes) + 1):
                cost += 2 * gaps[place]
                audit += "I" * gaps[place]
                for _ in places[gaps[place]]:
                    options = [o + [r] for o in options for r in "ua"]
                if place == len(codes):
                    continue
                code, letter = codes[place], letters[place]
                audit += letter
                if code == "x" and letter != "D":
                    break
                cost += {"D": 3, "K": 0, "R": 2}[letter] + (letter != "D" and code.isupper())
                if letter == "K":
                    options = [o + [code.lower()] for o in options]
                elif letter == "R":
                    options = [o + [r] for o in options for r in "ua"]
            else:
                for o in options:
                    if GOOD.fullmatch("".join(o)):
                        yield cost, audit


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_search_finds_the_cheapest(length):
    rng = random.Random(length)
    every = list(product("xsuaoSUAO", repeat=length))
    for codes in rng.sample(every, min(len(every), 60)):
        codes = "".join(codes)
        cost, audits = repair.chain([repair.ways(codes)])
        assert min(outcomes(codes)) == (cost, "".join(audits)) == repair.search(codes, repair.START), codes


def walk(codes):
    """The cheapest edits by a walk over all rows that keeps the best for each last role."""
    def least(*found):
        return min((f for f in found if f is not None), default=None)

    def add(found, cost, letters):
        return found and (found[0] + cost, found[1] + letters)

    n, s, u, a = (0, ""), None, None, None
    for code in [*codes, None]:
        u, a = (
            least(u, *(add(x, 2, "I") for x in (n, s, a))),
            least(a, add(u, 2, "I"), add(n, 4, "II"), add(s, 4, "II")),
        )
        if code is None:
            return least(n, a)
        cut = int(code.isupper())
        free = least(n, s, a)
        keep = code.lower()
        n, s, u, a = (
            add(n, 3, "D"),
            least(add(s, 3, "D"), add(n, cut, "K") if keep == "s" else None),
            least(add(u, 3, "D"), *([] if code == "x" else [add(free, 2 + cut, "R")]), add(free, cut, "K") if keep == "u" else None),
            least(add(a, 3, "D"), *([] if code == "x" else [add(u, 2 + cut, "R")]), add(u, cut, "K") if keep == "a" else None),
        )


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_pieces_make_no_difference(piece):
    rng = random.Random(piece)
    for length in [5, 9, 30, 90, 300]:
        for alphabet in ("uuaasxUAo", "ua", "xs", "uxA", "oO"):
            codes = "".join(rng.choice(alphabet) for _ in range(length))
            parts = [codes[i : i + piece] for i in range(0, length, piece)]
            cost, audits = repair.chain([repair.ways(p) for p in parts])
            assert (cost, "".join(audits)) == walk(codes) == repair.search(codes, repair.START), codes


def conversations():
    rng = random.Random(11)
    rows = []
    roles = ["user", "assistant", "system", "User", "tool", "", None, "unknown"]
    texts = ["Yes.", "No", "What?", "  \n", "", None, "ends. ", "ends\t", "é!", "Yes.", "line\nline."]
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {turn} of {conv}."
            rows.append((conv if conv != 7 else None, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 3]) - 2, role, text))
    rows += [(900, t, "user", "Again.") for t in range(80)] + [(901, 5, "user", "Same.")] * 60
    rows += [(902, None, "user", f"{i}.") for i in range(50)]
    rows += [(903, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)]
    rows += [(904, 1, "user", "word " * 200_000 + ".."), (904, 2**40, "assistant", "." + " " * 300_000)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        by_conv[conv].extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    out = {}
    for conv, here in by_conv.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, codes, seen = [], "", set()
        for _, role, text in here:
            ended = text.rstrip(SPACE)
            fault = "b" if not ended else "d" if (role, text) in seen else "t" if ended[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("b", "d") else code.upper() if fault else code
        turns = [t for t, *_ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = zip(here, here[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit = walk(codes)
        kept, at = [], 0
        for letter in audit:
            last = kept[-1][0][:1] if kept else ""
            free = "assistant" if last == "u" else "user"
            if letter == "I":
                kept.append((free, ""))
                continue
            _, role, text = here[at]
            at += 1
            if letter != "D":
                kept.append((role if letter == "K" else free, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha), kept
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("piece, rows_of_hot", [(repair.PIECE, hot.ROWS), (4, 30)])
def test_conversations(spark, monkeypatch, piece, rows_of_hot):
    monkeypatch.setattr(hot, "ROWS", rows_of_hot)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, 5, "x") for r in rows], SCHEMA)
    want = expected([(*r, 1) for r in rows])
    found = {r[0]: tuple(r)[1:] for r in repair.repair(frame, piece=piece).select(*COLUMNS).collect()}
    assert found == {conv: facts for conv, (facts, _) in want.items()}
    kept = defaultdict(list)
    for r in sorted(repair.repaired_rows(frame, piece=piece).collect(), key=lambda r: (str(r[0]), r[1])):
        kept[r[0]].append((r["role"], r["text"]))
    assert dict(kept) == {conv: lines for conv, (_, lines) in want.items() if lines}


def test_damage(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, 5, "x") for r in rows], SCHEMA)

    def harm(conv, turn, role, text):
        named = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(named.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        return conv, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)

    harmed = [harm(*r) for r in rows]
    damaged = repair.damage(frame)
    assert sorted(map(repr, map(tuple, damaged.collect()))) == sorted(map(repr, harmed))
    from pyspark.sql import functions as F

    found = repair.repair(damaged, copies=F.col("copies")).select(*COLUMNS).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {conv: facts for conv, (facts, _) in expected(harmed).items()}


def test_nothing_left_and_empty(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, 1, "user", "a."), (1, 2, "user", "b.")], "conv_id bigint, turn bigint, role string, text string")
    found = [tuple(r) for r in repair.repair(frame, copies=F.lit(0)).select(*COLUMNS).collect()]
    assert found == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(frame.limit(0)).count() == 0
    assert repair.repaired_rows(frame.limit(0)).count() == 0
