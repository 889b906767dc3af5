"""Capture files, dissection and the packet stream, on bytes built here."""

from __future__ import annotations

import datetime as dt
import struct

import oracle
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowlens.functions import packets as P
from flowlens.operators import layers as D
from flowlens.queries.traffic import event_frames, write_event_captures
from flowlens.schema import FRAME_SCHEMA
from flowlens.session import scratch_path
from flowlens.sources.captures import read_capture
from flowlens.streaming.packets import packet_lines, stream_capture, write_stream

ETHERNET = bytes.fromhex("020000000001" "060000000002")


def eth(kind: int, payload: bytes) -> bytes:
    return ETHERNET + struct.pack(">H", kind) + payload


def ipv4(proto: int, payload: bytes, fragment: int = 0, options: bytes = b"") -> bytes:
    words = 5 + len(options) // 4
    head = struct.pack(
        ">BBHHHBBH4s4s", 0x40 | words, 0, words * 4 + len(payload), 7, fragment, 64, proto, 0,
        bytes([10, 0, 0, 1]), bytes([192, 168, 1, 2]),
    )
    return head + options + payload


def tcp(payload: bytes = b"", sport=1234, dport=80, flags=0x12) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 99, 100, 0x50, flags, 8192, 0, 0) + payload


def udp(payload: bytes = b"") -> bytes:
    return struct.pack(">HHHH", 5353, 53, 8 + len(payload), 0) + payload


def ipv6(nh: int, payload: bytes) -> bytes:
    source = bytes.fromhex("20010db8000000000000000000000001")
    target = bytes.fromhex("fe800000000000000001000000000002")
    return struct.pack(">IHBB", 6 << 28, len(payload), nh, 64) + source + target + payload


ARP = struct.pack(
    ">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, 1, b"\x06\0\0\0\0\2", bytes([10, 0, 0, 1]), bytes(6),
    bytes([10, 0, 0, 9]),
)
ICMP_ERROR = struct.pack(">BBHI", 3, 1, 0, 0)

CASES = {
    "tcp": (eth(0x0800, ipv4(6, tcp(b"hello"))), "Ethernet IP TCP Raw"),
    "tcp bare": (eth(0x0800, ipv4(6, tcp())), "Ethernet IP TCP"),
    "udp": (eth(0x0800, ipv4(17, udp(b"x"))), "Ethernet IP UDP Raw"),
    "options": (eth(0x0800, ipv4(6, tcp(b"z"), options=b"\1" * 8)), "Ethernet IP TCP Raw"),
    "padding": (eth(0x0800, ipv4(17, udp())) + bytes(18), "Ethernet IP UDP Padding"),
    "arp": (eth(0x0806, ARP), "Ethernet ARP"),
    "echo": (eth(0x0800, ipv4(1, struct.pack(">BBHHH", 8, 0, 0, 5, 6))), "Ethernet IP ICMP"),
    "icmp tcp": (
        eth(0x0800, ipv4(1, ICMP_ERROR + ipv4(6, tcp()))),
        "Ethernet IP ICMP IP in ICMP TCP in ICMP",
    ),
    "icmp short tcp": (
        eth(0x0800, ipv4(1, ICMP_ERROR + ipv4(6, tcp()[:8]))),
        "Ethernet IP ICMP IP in ICMP TCP in ICMP",
    ),
    "icmp udp": (
        eth(0x0800, ipv4(1, ICMP_ERROR + ipv4(17, udp(b"q")))),
        "Ethernet IP ICMP IP in ICMP UDP in ICMP Raw",
    ),
    "icmp icmp": (
        eth(0x0800, ipv4(1, ICMP_ERROR + ipv4(1, struct.pack(">BBHHH", 8, 0, 0, 5, 6)))),
        "Ethernet IP ICMP IP in ICMP ICMP in ICMP",
    ),
    "ipv6": (eth(0x86DD, ipv6(17, udp(b"v6"))), "Ethernet IPv6 UDP Raw"),
    "vlan": (eth(0x8100, struct.pack(">HH", 0x2064, 0x0800) + ipv4(6, tcp())), "Ethernet 802.1Q IP TCP"),
    "provider tag": (
        eth(0x88A8, struct.pack(">HHHH", 5, 0x8100, 6, 0x0800) + ipv4(17, udp())), "Ethernet 802_1AD 802.1Q IP UDP",
    ),
    "many tags": (
        eth(0x8100, struct.pack(">HH", 1, 0x8100) * 60 + struct.pack(">HH", 2, 0x86DD) + ipv6(17, udp(b"z"))),
        "Ethernet " + "802.1Q " * 61 + "IPv6 UDP Raw",
    ),
    "cut tag": (eth(0x8100, struct.pack(">HHH", 1, 0x8100, 2)), "Ethernet 802.1Q Raw"),
    "tags to the end": (eth(0x8100, struct.pack(">HH", 1, 0x8100) * 5), "Ethernet " + "802.1Q " * 4 + "802.1Q"),
    "extensions": (
        eth(0x86DD, ipv6(0, b"\x3c\1" + bytes(14) + b"\x2b\0" + bytes(6) + b"\x33\2" + bytes(22) + b"\6\4" + bytes(22) + tcp(b"q"))),
        "Ethernet IPv6 IPv6 Extension Header - Hop-by-Hop Options Header "
        "IPv6 Extension Header - Destination Options Header IPv6 Option Header Routing AH TCP Raw",
    ),
    "long extension": (
        eth(0x86DD, ipv6(60, b"\x11\x60" + bytes(774) + udp(b"far"))),
        "Ethernet IPv6 IPv6 Extension Header - Destination Options Header UDP Raw",
    ),
    "cut extension": (eth(0x86DD, ipv6(0, b"\x3c\0" + bytes(6) + b"\x11\5" + bytes(9))), "Ethernet IPv6 "
        "IPv6 Extension Header - Hop-by-Hop Options Header Raw"),
    "later fragment": (
        eth(0x86DD, ipv6(44, b"\x11\0\0\x09\0\0\0\7" + udp())), "Ethernet IPv6 IPv6 Extension Header - Fragmentation header Raw",
    ),
    "first fragment": (
        eth(0x86DD, ipv6(44, b"\x11\0\0\1\0\0\0\7" + udp())), "Ethernet IPv6 IPv6 Extension Header - Fragmentation header UDP",
    ),
    "no next header": (eth(0x86DD, ipv6(0, b"\x3b\0" + bytes(6) + b"rest")), "Ethernet IPv6 "
        "IPv6 Extension Header - Hop-by-Hop Options Header Raw"),
    "fragment": (eth(0x0800, ipv4(6, tcp(b"tail"), fragment=100)), "Ethernet IP Raw"),
    "other protocol": (eth(0x0800, ipv4(47, b"gre")), "Ethernet IP Raw"),
    "unknown type": (eth(0x88CC, b"lldp"), "Ethernet Raw"),
    "length type": (eth(0x0004, b"\x42\x42\x03\x00"), "802.3 Raw"),
    "cut ip": (eth(0x0800, ipv4(6, tcp())[:10]), "Ethernet Raw"),
    "cut tcp": (eth(0x0800, ipv4(6, tcp())[:30]), "Ethernet IP Raw"),
    "cut ethernet": (b"\1\2\3", "Raw"),
    "empty": (b"", ""),
}


def frames(spark, cases=CASES, linktype=1):
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [
        (name, i, now, linktype, len(data), len(data), bytearray(data))
        for i, (name, (data, _)) in enumerate(cases.items())
    ]
    return spark.createDataFrame(rows, FRAME_SCHEMA)


@pytest.fixture(scope="module")
def packets(spark):
    return {r["file"]: r["layers"] for r in D.dissect(frames(spark)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_layer_chain(packets, name):
    assert " ".join(layer["name"] for layer in packets[name]) == CASES[name][1]
    assert [layer["idx"] for layer in packets[name]] == list(range(len(packets[name])))


def test_fields(packets):
    link, ip, transport, raw = (layer["fields"] for layer in packets["tcp"])
    assert link == {"dst": "02:00:00:00:00:01", "src": "06:00:00:00:00:02", "type": "2048"}
    assert (ip["src"], ip["dst"], ip["proto"], ip["len"], ip["ihl"]) == (
        "10.0.0.1", "192.168.1.2", "6", "45", "5",
    )
    assert (transport["sport"], transport["dport"], transport["seq"], transport["flags"]) == (
        "1234", "80", "99", "SA",
    )
    assert bytes.fromhex(raw["load"]) == b"hello"
    six = packets["ipv6"][1]["fields"]
    assert (six["src"], six["dst"], six["version"]) == ("2001:db8::1", "fe80::1:0:0:2", "6")
    tag = packets["vlan"][1]["fields"]
    assert (tag["prio"], tag["vlan"], tag["type"]) == ("1", "100", "2048")
    assert [layer["fields"]["vlan"] for layer in packets["many tags"][1:62]] == ["1"] * 60 + ["2"]
    assert packets["long extension"][3]["fields"]["dport"] == "53"
    assert packets["long extension"][2]["fields"]["options"] == "00" * 774
    part = packets["later fragment"][2]["fields"]
    assert (part["offset"], part["m"], part["id"], part["nh"]) == ("1", "1", "7", "17")
    arp = packets["arp"][1]["fields"]
    assert (arp["op"], arp["psrc"], arp["pdst"]) == ("1", "10.0.0.1", "10.0.0.9")
    assert packets["echo"][2]["fields"] == {"type": "8", "code": "0", "chksum": "0", "id": "5", "seq": "6"}
    assert packets["icmp short tcp"][-1]["fields"] == {"sport": "1234", "dport": "80", "seq": "99"}
    assert len(bytes.fromhex(packets["padding"][-1]["fields"]["load"])) == 18


@pytest.mark.parametrize(
    "groups,text",
    [
        ("0000" * 8, "::"),
        ("0001" * 8, "1:1:1:1:1:1:1:1"),
        ("0000" * 7 + "0001", "::1"),
        ("0001" + "0000" * 7, "1::"),
        ("0001" "0000" "0000" "0002" "0000" "0000" "0000" "0003", "1:0:0:2::3"),
        ("0001" "0000" "0000" "0002" "0003" "0000" "0000" "0004", "1::2:3:0:0:4"),
        ("0001" "0000" "0002" "0003" "0004" "0005" "0006" "abcd", "1:0:2:3:4:5:6:abcd"),
    ],
)
def test_ipv6_text(spark, groups, text):
    data = struct.pack(">IHBB", 6 << 28, 0, 59, 64) + bytes.fromhex(groups) + bytes(16)
    row = D.dissect(frames(spark, {"x": (data, "")}, linktype=101)).first()
    assert row["layers"][0]["fields"]["src"] == text


def test_raw_ip_links_have_no_ethernet(spark):
    row = D.dissect(frames(spark, {"x": (ipv4(6, tcp()), "")}, linktype=101)).first()
    assert [layer["name"] for layer in row["layers"]] == ["IP", "TCP"]


def test_protocol_tables(spark, tmp_path):
    packets = D.dissect(frames(spark))
    table = D.protocol_table(packets, "TCP in ICMP")
    assert table.columns[:3] == ["file", "idx", "layer"] and "urgptr" in table.columns
    short = table.where("file = 'icmp short tcp'").first()
    assert short["sport"] == "1234" and short["urgptr"] is None
    assert D.with_layer(packets, "ARP").count() == 1
    D.write_protocol_tables(packets, str(tmp_path / "tables"))
    back = spark.read.parquet(str(tmp_path / "tables"))
    assert back.count() == D.layer_rows(packets).count()
    assert back.where("name = 'UDP'").count() == table.sparkSession.read.parquet(
        str(tmp_path / "tables" / "name=UDP")
    ).count()


def test_summary_and_tokens(spark):
    rows = D.dissect(frames(spark)).select("file", P.summary(F.col("layers")).alias("s")).collect()
    lines = {r["file"]: r["s"] for r in rows}
    assert lines["tcp"] == "Ethernet / IP / TCP / Raw 10.0.0.1:1234 > 192.168.1.2:80"
    assert lines["arp"] == "Ethernet / ARP 10.0.0.1 > 10.0.0.9"
    assert lines["cut ethernet"] == "Raw"
    token = spark.range(1).select(P.last_token(F.lit("TCP in ICMP"))).first()[0]
    assert token == "ICMP"


# --- capture files ----------------------------------------------------------------------


def capture(data: list[bytes], order="<", nano=False, cut=0, linktype=1) -> bytes:
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for i, frame in enumerate(data):
        fraction = 250_000_000 if nano else 250_000
        out += struct.pack(order + "IIII", 1_700_000_000 + i, fraction, len(frame), len(frame) + 1) + frame
    return out[: len(out) - cut] if cut else out


SIXTY = [eth(0x0800, ipv4(17, udp(bytes([i]) * i))) for i in range(60)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nano", [False, True])
def test_byte_orders(spark, tmp_path, order, nano):
    (tmp_path / "a.pcap").write_bytes(capture(SIXTY[:3], order, nano))
    rows = read_capture(spark, str(tmp_path)).orderBy("idx").collect()
    assert [bytes(r["frame"]) for r in rows] == SIXTY[:3]
    assert rows[0]["ts"] == dt.datetime(2023, 11, 14, 22, 13, 20, 250_000)
    assert (rows[2]["caplen"], rows[2]["len"], rows[2]["linktype"]) == (44, 45, 1)


@pytest.mark.parametrize("split_bytes", [1 << 20, 500, 1])
def test_splits_cover_the_file_once(spark, tmp_path, split_bytes):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture(SIXTY))
    (tmp_path / "skip.txt").write_text("not a capture")
    df = read_capture(spark, str(tmp_path), split_bytes=split_bytes)
    rows = df.orderBy("file", "idx").collect()
    assert [r["idx"] for r in rows] == [*range(60)] * 2
    assert [bytes(r["frame"]) for r in rows] == SIXTY * 2
    first = read_capture(spark, str(tmp_path), split_bytes=split_bytes, first=51)
    assert sorted(r["idx"] for r in first.collect()) == sorted([*range(51)] * 2)


def test_truncated_and_foreign_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(SIXTY[:3], cut=5))
    for split_bytes in (1 << 20, 10):
        rows = read_capture(spark, str(tmp_path), split_bytes=split_bytes).orderBy("idx").collect()
        assert [len(r["frame"]) for r in rows] == [42, 43, 39]
        assert rows[2]["caplen"] == 44
    (tmp_path / "b.pcap").write_bytes(b"GIF89a" + bytes(40))
    with pytest.raises(PySparkException):
        read_capture(spark, str(tmp_path)).collect()


def test_stream_equals_batch(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part{i}.pcap").write_bytes(capture(SIXTY[i * 10 : i * 10 + 10]))
    source = str(tmp_path)
    lines = packet_lines(stream_capture(spark, source, files_per_trigger=2))
    assert lines.isStreaming
    out, checkpoint = scratch_path(spark, "lines"), scratch_path(spark, "lines-checkpoint")
    write_stream(lines, out, checkpoint).awaitTermination()
    batch = packet_lines(read_capture(spark, source))
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    # A file that arrives later is read once; the others are not read again.
    (tmp_path / "part9.pcap").write_bytes(capture(SIXTY[50:]))
    again = packet_lines(stream_capture(spark, source, files_per_trigger=2))
    write_stream(again, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 60


def test_options_are_fields(spark):
    """Every byte of the frame is in a field; headers without options have no such field."""
    segment = tcp(b"zz")
    segment = segment[:12] + b"\x70" + segment[13:20] + b"\2\4\5\xb4\1\1\1\0" + segment[20:]
    frames = [eth(0x0800, ipv4(6, segment, options=b"\7\4\0\0")), eth(0x0800, ipv4(6, tcp(b"zz")))]
    df = spark.createDataFrame(
        [(i, 1, bytearray(f)) for i, f in enumerate(frames)], "idx long, linktype int, frame binary"
    )
    with_options, without = [
        {x["name"]: x["fields"] for x in r["layers"]} for r in D.dissect(df).orderBy("idx").collect()
    ]
    assert with_options["IP"]["options"] == "07040000"
    assert with_options["TCP"]["options"] == "020405b401010100"
    assert with_options["Raw"]["load"] == without["Raw"]["load"] == "7a7a"
    assert "options" not in without["IP"] and "options" not in without["TCP"]


def test_cut_off_records_fail_on_request(spark, tmp_path):
    header = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for k, tail in enumerate((struct.pack("<IIII", 1, 0, 9, 9) + b"abc", b"\1\2\3")):
        path = tmp_path / f"c{k}"
        path.mkdir()
        (path / "a.pcap").write_bytes(header + struct.pack("<IIII", 1, 0, 2, 2) + b"xy" + tail)
        kept = read_capture(spark, str(path)).orderBy("idx").collect()
        assert [(r["caplen"], bytes(r["frame"])) for r in kept] == [(2, b"xy"), (9, b"abc")][: 2 - k]
        with pytest.raises(Exception, match="cut-off record"):
            read_capture(spark, str(path), strict=True).collect()


def test_frames_of_one_row_group_are_many_tasks(spark):
    """Splits of a file do not cut a row group: all but one of these are empty."""
    from flowlens.queries import traffic

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        for frames in (traffic.event_frames, traffic.deep_frames):
            tasks = frames(spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).count().collect()
            assert max(row["count"] for row in tasks) < 2 * traffic.FRAMES_PER_TASK
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_protocol_table_dissects_once(spark):
    looked = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    frames = event_frames(spark, f"{oracle.TESTDATA}/sf0.001").limit(40)
    rows = frames.count()
    counted = frames.mapInArrow(count, frames.schema)
    table = D.protocol_table(D.dissect(counted), "IP")
    named = D.protocol_table(D.dissect(frames), "IP", table.columns[3:])
    assert "src" in table.columns and table.collect() and sorted(table.collect()) == sorted(named.collect())
    assert looked.value == rows


def test_triggers_are_bounded_by_bytes(spark, tmp_path):
    """Small captures go together, so that triggers grow with the bytes, not with the files."""
    write_event_captures(spark, f"{oracle.TESTDATA}/sf0.01", str(tmp_path / "in"))
    size = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.pcap"))
    found = []
    for limit in (size * 2, size // 2):
        lines = packet_lines(stream_capture(spark, str(tmp_path / "in"), bytes_per_trigger=limit))
        out = str(tmp_path / f"out-{limit}")
        query = write_stream(lines, out, str(tmp_path / f"checkpoint-{limit}"))
        query.awaitTermination()
        found.append((query.lastProgress["batchId"], spark.read.parquet(out).count()))
    assert found[0] == (0, 10_000) and found[1][0] > 0 and found[1][1] == 10_000
