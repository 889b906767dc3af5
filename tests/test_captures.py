"""Capture formats and the ranges of large files, on bytes built here."""

from __future__ import annotations

import datetime as dt
import gzip
import random
import struct

import numpy as np
import pytest

from flowlens.sources import captures, formats
from flowlens.sources.captures import list_captures, parallel_ranges, read_capture
from flowlens.streaming.growing import frames_read, read_on

START = 1_700_000_000


def classic(frames, order="<", seconds=None):
    out = [struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 16, 1)]
    for i, frame in enumerate(frames):
        clock = START + i if seconds is None else seconds(i)
        out.append(struct.pack(order + "IIII", clock, i % 1_000_000, len(frame), len(frame)) + frame)
    return b"".join(out)


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def section(order="<"):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order="<", link=1, most=0, options=b""):
    return block(order, 1, struct.pack(order + "HHI", link, 0, most) + options)


def packet(order, number, ticks, frame):
    head = struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame) + 1)
    return block(order, 6, head + frame)


def option(order, code, value):
    return struct.pack(order + "HH", code, len(value)) + value + bytes(-len(value) % 4)


def pieces(rng, count, most=400):
    return [rng.randbytes(rng.randint(1, most)) for _ in range(count)]


def next_generation(frames, order="<", again=None):
    out = section(order) + interface(order)
    for i, frame in enumerate(frames):
        if again and i and i % again == 0:
            out += section(order) + interface(order, link=100 + i // again) + block(order, 4, bytes(8))
        out += packet(order, 0, (START + i) * 1_000_000 + i, frame)
    return out


def rows_of(spark, path, **options):
    return read_capture(spark, str(path), **options).orderBy("file", "idx").collect()


# --- formats ------------------------------------------------------------------------------


@pytest.mark.parametrize("order", ["<", ">"])
def test_interfaces_have_their_own_clocks(spark, tmp_path, order):
    second = START * 1_000_000
    nano = option(order, 9, b"\x09") + option(order, 14, struct.pack(order + "q", 1000)) + option(order, 0, b"")
    data = (
        section(order) + block(order, 10, b"secrets ") + interface(order, link=1, most=3)
        + packet(order, 0, second + 250_000, b"micro")
        + interface(order, link=101, options=option(order, 2, b"eth0") + nano)
        + packet(order, 1, (START - 1000) * 10**9 + 250_000_999, b"nano")
        + interface(order, options=option(order, 9, b"\x8a"))
        + packet(order, 2, START * 1024 + 512, b"halves")
        + block(order, 2, struct.pack(order + "HHIIII", 1, 0, 0, 2_000_000_000, 3, 9) + b"old")
        + block(order, 3, struct.pack(order + "I", 7) + b"simple.")
        + section(order) + interface(order, link=12) + packet(order, 0, second, b"new section")
    )
    (tmp_path / "a.pcapng").write_bytes(data)
    rows = rows_of(spark, tmp_path)
    assert [(r["idx"], bytes(r["frame"]), r["linktype"], r["caplen"], r["len"]) for r in rows] == [
        (0, b"micro", 1, 5, 6), (1, b"nano", 101, 4, 5), (2, b"halves", 1, 6, 7), (3, b"old", 101, 3, 9),
        (4, b"sim", 1, 3, 7), (5, b"new section", 12, 11, 12),
    ]
    base = dt.datetime(2023, 11, 14, 22, 13, 20)
    quarter = dt.timedelta(microseconds=250_000)
    assert [r["ts"] for r in rows] == [
        base + quarter, base + quarter, base + 2 * quarter, dt.datetime(1970, 1, 1, 0, 16, 42), None, base,
    ]


def test_packed_files(spark, tmp_path):
    rng = random.Random(1)
    frames = pieces(rng, 300) + [bytes([i % 7]) * 60_000 for i in range(40)]
    half = classic(frames[:100])
    (tmp_path / "a.pcap.gz").write_bytes(gzip.compress(classic(frames)))
    (tmp_path / "b.pcapng.gz").write_bytes(gzip.compress(next_generation(frames, ">", 90)))
    # Two members, as programs write that append to a packed file.
    (tmp_path / "c.pcap").write_bytes(gzip.compress(half) + gzip.compress(classic(frames)[len(half):]))
    for split_bytes in (1 << 20, 5000):
        rows = rows_of(spark, tmp_path, split_bytes=split_bytes)
        assert [bytes(r["frame"]) for r in rows] == frames * 3
        assert len(rows_of(spark, tmp_path, split_bytes=split_bytes, first=7)) == 21


def test_damaged_and_cut_off_blocks(spark, tmp_path):
    frames = pieces(random.Random(2), 40)
    data = next_generation(frames)
    (tmp_path / "a.pcapng").write_bytes(data[:-20])
    for split_bytes in (1 << 20, 1000):
        rows = rows_of(spark, tmp_path, split_bytes=split_bytes)
        assert [bytes(r["frame"]) for r in rows[:-1]] == frames[:-1]
        assert frames[-1].startswith(bytes(rows[-1]["frame"]))
        with pytest.raises(Exception, match="cut-off record"):
            rows_of(spark, tmp_path, split_bytes=split_bytes, strict=True)
    (tmp_path / "a.pcapng").write_bytes(data + packet("<", 5, 0, b"no such interface"))
    with pytest.raises(Exception, match="damaged record"):
        rows_of(spark, tmp_path)
    (tmp_path / "a.pcapng").write_bytes(data[:3000] + bytes(4000) + data[3000:])
    for split_bytes in (1 << 20, 500):
        with pytest.raises(Exception, match="damaged record"):
            rows_of(spark, tmp_path, split_bytes=split_bytes)


# --- ranges -------------------------------------------------------------------------------


def files(rng):
    """Files whose guesses are easy, hard, and wrong."""
    inner = classic([b"x" * 40] * 30)[24:]
    plain = pieces(rng, 500)
    return {
        "plain.pcap": (classic(plain), plain),
        "big.pcap": (classic(plain, ">"), plain),
        "zeros.pcap": (classic(z := [bytes(rng.randint(0, 300)) for _ in range(300)]), z),
        "nested.pcap": (classic(n := [inner + bytes([i]) for i in range(20)]), n),
        "long.pcap": (classic(g := [rng.randbytes(s) for s in (10, 90_000, 20, 70_000, 5, 40_000)]), g),
        "time.pcap": (classic(plain, seconds=lambda i: 0 if i % 7 else START), plain),
        "none.pcap": (classic([]), []),
        "one.pcapng": (next_generation(plain), plain),
        "many.pcapng": (next_generation(plain, ">", 37), plain),
        "inside.pcapng": (next_generation(m := [next_generation([b"abc"] * 20) for _ in range(15)]), m),
    }


@pytest.mark.parametrize("split_bytes", [700, 30_000])
def test_any_split_gives_the_same_rows(spark, tmp_path, split_bytes):
    cases = files(random.Random(3))
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = rows_of(spark, tmp_path, split_bytes=split_bytes, tasks=8)
    found: dict = {}
    for r in rows:
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["idx"], bytes(r["frame"]), r["linktype"]))
    for name, (_, frames) in cases.items():
        link = (lambda i: 100 + i // 37 if i >= 37 else 1) if name == "many.pcapng" else (lambda i: 1)
        assert found.get(name, []) == [(i, f, link(i)) for i, f in enumerate(frames)], name


def test_no_task_follows_a_whole_file(tmp_path, monkeypatch):
    """Following a range reads it, what a guess looks at, and what a piece is read ahead."""
    rng = random.Random(4)
    path = tmp_path / "a.pcap"
    path.write_bytes(classic(pieces(rng, 30_000)))
    size, split = path.stat().st_size, 1 << 19
    monkeypatch.setattr(formats, "GUESS_BYTES", 1 << 16)
    monkeypatch.setattr(formats, "READ_BYTES", 1 << 16)
    read = []

    class Counting:
        def __init__(self, source):
            self.source = source

        def read(self, n):
            data = self.source.read(n)
            read.append(len(data))
            return data

        def seek(self, position):
            return self.source.seek(position)

        def close(self):
            self.source.close()

    opened = formats.open_path
    monkeypatch.setattr(formats, "open_path", lambda p: Counting(opened(p)))
    before, wrong, total = formats.FILE_HEADER, 0, 0
    for begin in range(0, size, split):
        read.clear()
        start, end, frames, _, _ = captures._follow(str(path), None, begin, min(size, begin + split))
        assert sum(read) <= split + (5 << 16)
        wrong += start != before
        before, total = end, total + frames
    assert (wrong, total, before) == (0, 30_000, size)


def test_wrong_guesses_are_followed_again(spark, tmp_path, monkeypatch):
    data, frames = files(random.Random(3))["nested.pcap"]
    (tmp_path / "nested.pcap").write_bytes(data)
    guessed = [captures._follow(str(tmp_path / "nested.pcap"), None, b, b + 700)[0] for b in range(0, len(data), 700)]
    right = {24 + sum(16 + len(f) for f in frames[:i]) for i in range(len(frames) + 1)}
    assert any(g not in right for g in guessed)
    for rounds in (0, 40):
        monkeypatch.setattr(captures, "ROUNDS", rounds)
        splits = parallel_ranges(list_captures(spark, str(tmp_path)), 2000, 4).collect()
        assert all(s["start"] in right for s in splits) and len(splits) > 5


def test_guesses_in_random_bytes():
    """Nothing in random bytes looks like a chain of records."""
    noise = np.random.default_rng(0).bytes(200_000)

    class Source:
        def seek(self, position):
            self.at = position

        def read(self, n):
            return noise[self.at : self.at + n]

    head = classic([])
    assert formats.first_record(formats.Classic(head), Source(), 0, 100_000) is None
    assert formats.first_record(formats.NextGeneration(section()), Source(), 0, 100_000) is None


# --- files that grow ----------------------------------------------------------------------


def test_growing_files_lose_and_repeat_nothing(spark, tmp_path):
    rng = random.Random(6)
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    plain, blocks = pieces(rng, 60), pieces(rng, 60)
    data = {"a.pcap": classic(plain), "b.pcapng": next_generation(blocks, ">", 17), "late.pcap": classic(plain[:5])}
    assert frames_read(spark, store).count() == 0
    for trigger, share in enumerate((0.0005, 0.3, 0.3, 0.301, 0.8, 1.0)):
        for name, whole in data.items():
            if name != "late.pcap" or share == 1.0:
                (folder / name).write_bytes(whole[: int(len(whole) * share)])
        assert read_on(spark, str(folder), store) == trigger
        if trigger == 2:
            assert frames_read(spark, store, 2).count() == 0
    # A trigger that broke off has no mark of its end: it is done again.
    (tmp_path / "store" / "trigger=5" / "_SUCCESS").unlink()
    assert read_on(spark, str(folder), store) == 5
    found: dict = {}
    for r in frames_read(spark, store).orderBy("file", "idx").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["idx"], bytes(r["frame"]), r["linktype"]))
    assert found["a.pcap"] == [(i, f, 1) for i, f in enumerate(plain)]
    assert found["b.pcapng"] == [(i, f, 100 + i // 17 if i >= 17 else 1) for i, f in enumerate(blocks)]
    assert found["late.pcap"] == [(i, f, 1) for i, f in enumerate(plain[:5])]
    (folder / "c.pcap.gz").write_bytes(gzip.compress(classic(plain)))
    with pytest.raises(Exception, match="packed"):
        read_on(spark, str(folder), store)
