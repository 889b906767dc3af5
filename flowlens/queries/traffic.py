"""Traffic derived by Spark from the given tables.

The tables hold no packets and no connection records, so both are computed from
their rows: every event becomes one Ethernet frame, every line item one connection
record. The queries over them grow with the tables.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.queries import table
from flowlens.schema import CONNECTION_SCHEMA
from flowlens.session import spread
from flowlens.sources.captures import list_captures
from flowlens.sources.formats import open_path

RECORDS_PER_FILE = 2000
FRAMES_PER_TASK = 20_000  # frames take much longer to dissect than their events to move


# --- events as frames ---------------------------------------------------------------------


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event.

    view: TCP over IPv4; click: UDP over IPv4; signup: ARP with padding; purchase: an
    ICMP error that quotes a TCP header; error: UDP over IPv6 in a VLAN.
    """
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    payload = F.hex(F.col("props").cast("binary"))
    payload_size = F.octet_length("props")
    macs = F.concat(F.lit("02"), _hex(user, 10), F.lit("06"), _hex(event, 10))
    user_ip = F.concat(F.lit("0A"), _hex(user % (1 << 24), 6))
    event_ip = F.concat(F.lit("C0A8"), _hex(event % (1 << 16), 4))
    sport = _hex(1024 + user % 60000, 4)

    def ip(proto: str, size: Column) -> Column:
        return F.concat(
            F.lit("4500"), _hex(size + 20, 4), _hex(event % (1 << 16), 4), F.lit("400040" + proto),
            F.lit("0000"), user_ip, event_ip,
        )

    tcp = F.concat(
        sport, F.lit("0050"), _hex(event % (1 << 32), 8), F.lit("00000000" "5018" "2000" "00000000")
    )

    def udp(port: str) -> Column:
        return F.concat(sport, F.lit(port), _hex(payload_size + 8, 4), F.lit("0000"))

    arp = F.concat(
        F.lit("0001" "0800" "0604" "0001"),
        F.lit("06"), _hex(event, 10), user_ip, F.lit("000000000000"), event_ip, F.lit("00" * 18),
    )
    ipv6 = F.concat(
        F.lit("60000000"), _hex(payload_size + 8, 4), F.lit("1140"),
        F.lit("20010DB8" "00000000" "00000000"), _hex(user % (1 << 32), 8),
        F.lit("FE80" + "0000" * 5), _hex(event % (1 << 32), 8),
    )
    body = (
        F.when(kind == "view", F.concat(F.lit("0800"), ip("06", payload_size + 20), tcp, payload))
        .when(kind == "click", F.concat(F.lit("0800"), ip("11", payload_size + 8), udp("0035"), payload))
        .when(kind == "signup", F.concat(F.lit("0806"), arp))
        .when(
            kind == "purchase",
            F.concat(
                F.lit("0800"), ip("01", F.lit(48)), F.lit("0301000000000000"),
                ip("06", F.lit(20)), tcp,
            ),
        )
        .otherwise(F.concat(F.lit("8100" "2064" "86DD"), ipv6, udp("007B"), payload))
    )
    frame = F.unhex(F.concat(macs, body))
    return (
        spread(table(spark, sf_dir, "events"), "event_id", rows=FRAMES_PER_TASK)
        .select(
            F.lit("events").alias("file"),
            F.col("event_id").alias("idx"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.lit(1).alias("linktype"),
            frame.alias("frame"),
        )
        .select(
            "file",
            "idx",
            "ts",
            "linktype",
            F.length("frame").alias("caplen"),
            F.length("frame").alias("len"),
            "frame",
        )
    )


#: Formats that captures are written in, by turns.
FORMATS = ("pcap", "pcapng", "pcap.gz", "pcapng.gz")


def _block(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def _classic_bytes(frames: pd.DataFrame):
    yield struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 16, 1)
    for us, frame in zip(frames["us"], frames["frame"]):
        yield struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame


def _next_generation_bytes(frames: pd.DataFrame):
    """Frames by turns on an interface that counts microseconds and on one that counts
    nanoseconds from a later start; the second one comes in the middle of the file."""
    yield _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    yield _block(1, struct.pack("<HHI", 1, 0, 1 << 16))
    for number, (us, frame) in enumerate(zip(frames["us"], frames["frame"])):
        if number == 1:
            options = struct.pack("<HHB3xHHqHH", 9, 1, 9, 14, 8, 1000, 0, 0)
            yield _block(4, bytes(4)) + _block(1, struct.pack("<HHI", 1, 0, 1 << 16) + options)
        ticks = (us - 1_000_000_000) * 1000 if number % 2 else us
        head = struct.pack("<IIIII", number % 2, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame))
        yield _block(6, head + frame)


def _write_capture(path: str, formats: tuple[str, ...]):
    """Writer of one bounded group of frames as a capture file."""

    def write(frames: pd.DataFrame) -> pd.DataFrame:
        import gzip

        from pyarrow import fs

        frames = frames.sort_values("idx")
        part = int(frames["part"].iloc[0])
        form = formats[part % len(formats)]
        name = f"capture-{part:08d}.{form}"
        target = f"{path.removeprefix('file:')}/{name}"
        if "://" in path:
            filesystem, inner = fs.FileSystem.from_uri(target.replace("s3a://", "s3://", 1))
        else:
            filesystem, inner = fs.LocalFileSystem(), target
        filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        written = (_next_generation_bytes if "pcapng" in form else _classic_bytes)(frames)
        with filesystem.open_output_stream(inner, compression=None) as out:
            if not form.endswith(".gz"):
                for piece in written:
                    out.write(piece)
            else:
                with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1) as packed:
                    for piece in written:
                        packed.write(piece)
        return pd.DataFrame({"file": [name], "records": [len(frames)]})

    return write


def write_event_captures(spark: SparkSession, sf_dir: str, path: str, formats=("pcap",)) -> int:
    """Rotated capture files of at most ``RECORDS_PER_FILE`` frames; returns their number."""
    frames = event_frames(spark, sf_dir).select(
        F.floor(F.col("idx") / RECORDS_PER_FILE).alias("part"),
        "idx",
        F.unix_micros("ts").alias("us"),
        "frame",
    )
    written = frames.groupBy("part").applyInPandas(
        _write_capture(path, tuple(formats)), "file string, records bigint"
    )
    return written.count()


def grow_captures(spark: SparkSession, source: str, target: str, percent: int) -> int:
    """Copy that share of the bytes of every capture in ``source``, as if it were still written."""

    def copy(batches):
        from pyarrow import fs

        for batch in batches:
            for path, length in zip(*[c.to_pylist() for c in batch.columns]):
                name = f"{target.removeprefix('file:')}/{path.rsplit('/', 1)[1]}"
                if "://" in target:
                    filesystem, inner = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
                else:
                    filesystem, inner = fs.LocalFileSystem(), name
                filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with open_path(path) as data, filesystem.open_output_stream(inner, compression=None) as out:
                    left = length * percent // 100
                    while left and (piece := data.read(min(left, 1 << 20))):
                        out.write(piece)
                        left -= len(piece)
            yield batch

    return list_captures(spark, source).select("path", "length").mapInArrow(copy, "path string, length bigint").count()


def deep_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event with many tags or extension headers.

    view: three tags, then IPv6 with four extension headers, options of up to 320 bytes
    among them, and UDP; click: a later fragment of an IPv6 packet; signup: so many tags
    that ARP begins behind the 200th byte; purchase: a first fragment with TCP in two tags;
    error: IPv6 with an authentication header that is cut off.
    """
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    macs = F.concat(F.lit("02"), _hex(user, 10), F.lit("06"), _hex(event, 10))
    words = event % 40

    def ip6(next_header: str, size: Column) -> Column:
        return F.concat(
            F.lit("60000000"), _hex(size, 4), F.lit(next_header + "40"),
            F.lit("20010DB8" "00000000" "00000000"), _hex(user % (1 << 32), 8),
            F.lit("FE80" + "0000" * 5), _hex(event % (1 << 32), 8),
        )

    udp = F.concat(_hex(1024 + user % 60000, 4), F.lit("0035" "000C" "0000" "DEADBEEF"))
    tcp = F.concat(F.lit("01BB"), _hex(event % (1 << 16), 4), F.lit("0000000100000002" "5010" "2000" "00000000"))
    hops = F.concat(F.lit("3C"), _hex(words, 2), F.repeat(F.lit("01"), (words * 8 + 6).cast("int")))
    destination = F.lit("2B00" "010400000000")
    routing = F.concat(F.lit("3302" "0000" "00000000"), F.repeat(F.lit("AB"), 16))
    authentication = F.concat(F.lit("1104" "0000"), _hex(event % (1 << 32), 8), F.lit("00000007" + "CD" * 12))
    many = F.repeat(F.lit("00078100"), 47)
    body = (
        F.when(
            kind == "view",
            F.concat(
                F.lit("88A8"), _hex(user % 4096, 4), F.lit("8100" "2002" "8100" "4003" "86DD"),
                ip6("00", words * 8 + 8 + 8 + 24 + 24 + 12), hops, destination, routing, authentication, udp,
            ),
        )
        .when(
            kind == "click",
            F.concat(F.lit("86DD"), ip6("2C", F.lit(12)), F.lit("1100" "00B9"), _hex(event % (1 << 32), 8), F.lit("DEADBEEF")),
        )
        .when(
            kind == "signup",
            F.concat(
                F.lit("8100"), many, F.lit("0008" "0806" "0001" "0800" "0604" "0002" "060000000001" "0A000001" "000000000000"),
                F.lit("0A"), _hex(user % (1 << 24), 6),
            ),
        )
        .when(
            kind == "purchase",
            F.concat(
                F.lit("8100" "0001" "8100" "0002" "86DD"), ip6("2C", F.lit(28)), F.lit("0600" "0001"),
                _hex(event % (1 << 32), 8), tcp,
            ),
        )
        .otherwise(F.concat(F.lit("86DD"), ip6("33", F.lit(8)), F.lit("1108" "0000" "00000001")))
    )
    frame = F.unhex(F.concat(macs, body))
    return spread(table(spark, sf_dir, "events"), "event_id", rows=FRAMES_PER_TASK).select(
        F.lit("events").alias("file"), F.col("event_id").alias("idx"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(1).alias("linktype"), F.length(frame).alias("caplen"), F.length(frame).alias("len"), frame.alias("frame"),
    )


# --- line items as connection records --------------------------------------------------------

# The derivation is plain arithmetic that Spark SQL and DuckDB both read.
CONNECTION_SQL = """
  SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS conn_id,
    l_quantity AS duration,
    CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'icmp' END AS protocol_type,
    concat('svc_', (l_suppkey * l_suppkey) % 70) AS service,
    CASE l_partkey % 11 WHEN 0 THEN 'OTH' WHEN 1 THEN 'REJ' WHEN 2 THEN 'RSTO' WHEN 3 THEN 'RSTOS0'
      WHEN 4 THEN 'RSTR' WHEN 5 THEN 'S0' WHEN 6 THEN 'S1' WHEN 7 THEN 'S2' WHEN 8 THEN 'S3'
      WHEN 9 THEN 'SF' ELSE 'SH' END AS flag,
    l_extendedprice AS src_bytes,
    l_extendedprice * l_discount AS dst_bytes,
    CAST(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS DOUBLE) AS land,
    CAST(l_linenumber % 3 AS DOUBLE) AS wrong_fragment,
    CAST(l_orderkey % 4 AS DOUBLE) AS urgent,
    CAST(l_partkey % 78 AS DOUBLE) AS hot,
    CAST(l_suppkey % 6 AS DOUBLE) AS num_failed_logins,
    CAST(l_orderkey % 2 AS DOUBLE) AS logged_in,
    CAST(l_partkey % 100 AS DOUBLE) AS num_compromised,
    CAST(CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS root_shell,
    CAST(CASE WHEN l_suppkey % 50 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS su_attempted,
    CAST(l_orderkey % 75 AS DOUBLE) AS num_root,
    CAST(l_orderkey % 44 AS DOUBLE) AS num_file_creations,
    CAST(l_orderkey % 3 AS DOUBLE) AS num_shells,
    CAST(l_partkey % 10 AS DOUBLE) AS num_access_files,
    CAST(0 AS DOUBLE) AS num_outbound_cmds,
    CAST(CASE WHEN l_orderkey % 1000 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS is_host_login,
    CAST(CASE WHEN l_orderkey % 90 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS is_guest_login,
    CAST(l_partkey % 512 AS DOUBLE) AS "count",
    CAST(l_suppkey % 512 AS DOUBLE) AS srv_count,
    l_discount * 10 AS serror_rate,
    l_tax * 10 AS srv_serror_rate,
    l_discount * l_tax AS rerror_rate,
    l_quantity * l_tax AS srv_rerror_rate,
    l_quantity * l_discount AS same_srv_rate,
    CAST(l_partkey % 101 AS DOUBLE) / 100 AS diff_srv_rate,
    CAST(l_suppkey % 101 AS DOUBLE) / 100 AS srv_diff_host_rate,
    CAST(l_partkey % 256 AS DOUBLE) AS dst_host_count,
    CAST(l_suppkey % 256 AS DOUBLE) AS dst_host_srv_count,
    CAST(l_orderkey % 101 AS DOUBLE) / 100 AS dst_host_same_srv_rate,
    CAST(l_orderkey % 97 AS DOUBLE) / 96 AS dst_host_diff_srv_rate,
    CAST(l_partkey % 89 AS DOUBLE) / 88 AS dst_host_same_src_port_rate,
    CAST(l_suppkey % 83 AS DOUBLE) / 82 AS dst_host_srv_diff_host_rate,
    CAST(l_orderkey % 79 AS DOUBLE) / 78 AS dst_host_serror_rate,
    CAST(l_partkey % 73 AS DOUBLE) / 72 AS dst_host_srv_serror_rate,
    CAST(l_suppkey % 71 AS DOUBLE) / 70 AS dst_host_rerror_rate,
    CAST(l_orderkey % 67 AS DOUBLE) / 66 AS dst_host_srv_rerror_rate,
    CASE WHEN l_orderkey % 23 = 0 THEN 'guess_passwd'
         WHEN l_partkey % 256 > 170 AND l_quantity * l_discount > 1 THEN 'neptune'
         WHEN l_partkey % 512 < 90 THEN 'satan'
         WHEN l_orderkey % 79 > 60 AND l_suppkey % 2 = 0 THEN 'rootkit'
         ELSE 'normal' END AS labels,
    CAST(21 AS DOUBLE) AS labels_numeric
  FROM lineitem
"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection records with the extra key ``conn_id``."""
    items = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return spark.sql(
        CONNECTION_SQL.replace('"count"', "`count`").replace("lineitem", "{lineitem}"),
        lineitem=items,
    )


def connection_columns() -> list[str]:
    return CONNECTION_SCHEMA.fieldNames()
