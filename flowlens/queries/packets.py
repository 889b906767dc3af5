"""Dissection, per-protocol tables, capture files and the packet stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import packets as P
from flowlens.operators import layers as D
from flowlens.operators.ragged import union_ragged as append_ragged
from flowlens.queries.traffic import (
    FORMATS,
    RECORDS_PER_FILE,
    deep_frames,
    event_frames,
    grow_captures,
    write_event_captures,
)
from flowlens.session import scratch_path
from flowlens.sources.captures import read_capture
from flowlens.streaming.growing import frames_read, read_on
from flowlens.streaming.packets import packet_lines, stream_capture, write_stream

TRIGGER_BYTES = 128 << 20

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# --- what the derived frames must contain, per event type ---------------------------------------

_CHAINS = """
    chains(event_type, chain) AS (VALUES
      ('view', 'Ethernet / IP / TCP / Raw'),
      ('click', 'Ethernet / IP / UDP / Raw'),
      ('signup', 'Ethernet / ARP / Padding'),
      ('purchase', 'Ethernet / IP / ICMP / IP in ICMP / TCP in ICMP'),
      ('error', 'Ethernet / 802.1Q / IPv6 / UDP / Raw')),
"""
_FACTS = (
    "WITH "
    + _CHAINS
    + """
    facts AS (
      SELECT e.*, c.chain, string_split(c.chain, ' / ') AS names,
             '10.' || (user_id >> 16) % 256 || '.' || (user_id >> 8) % 256 || '.' || user_id % 256
               AS user_ip,
             '192.168.' || ((event_id % 65536) >> 8) || '.' || event_id % 256 AS event_ip,
             (1024 + user_id % 60000)::VARCHAR AS sport,
             length(props) AS n,
             CASE event_type WHEN 'view' THEN 54 + length(props) WHEN 'click' THEN 42 + length(props)
                  WHEN 'signup' THEN 60 WHEN 'purchase' THEN 82 ELSE 66 + length(props) END AS size,
             lpad(lower(to_hex(user_id)), 10, '0') AS user_hex,
             lpad(lower(to_hex(event_id)), 10, '0') AS event_hex
      FROM events e JOIN chains c USING (event_type)),
    ends AS (
      SELECT *,
        '2001:db8::' || CASE WHEN user_id < 65536 THEN lower(to_hex(user_id))
          ELSE lower(to_hex(user_id >> 16)) || ':' || lower(to_hex(user_id % 65536)) END AS user_ip6,
        'fe80::' || CASE WHEN event_id = 0 THEN '' WHEN event_id < 65536 THEN lower(to_hex(event_id))
          ELSE lower(to_hex(event_id >> 16)) || ':' || lower(to_hex(event_id % 65536)) END AS event_ip6
      FROM facts),
    lines AS (
      SELECT *, chain || ' ' || CASE event_type
          WHEN 'view' THEN user_ip || ':' || sport || ' > ' || event_ip || ':80'
          WHEN 'click' THEN user_ip || ':' || sport || ' > ' || event_ip || ':53'
          WHEN 'signup' THEN user_ip || ' > ' || event_ip
          WHEN 'purchase' THEN user_ip || ' > ' || event_ip
          ELSE CASE WHEN user_id = 0 THEN '2001:db8::' ELSE user_ip6 END || ':' || sport || ' > '
               || event_ip6 || ':123' END AS summary
      FROM ends)
"""
)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dissect(event_frames(spark, sf_dir))


# --- dissection ------------------------------------------------------------------------------


@query(
    _FACTS
    + """
    SELECT event_id, list_aggregate(names, 'string_agg', ' ') AS chain,
           string_split(names[-1], ' ')[-1] AS innermost, size::INTEGER AS size, summary
    FROM lines
    """
)
def layer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = F.col("layers")
    return _packets(spark, sf_dir).select(
        F.col("idx").alias("event_id"),
        F.array_join(P.layer_chain(layers), " ").alias("chain"),
        P.last_token(F.element_at(P.layer_chain(layers), -1)).alias("innermost"),
        "size",
        P.summary(layers).alias("summary"),
    )


@query(
    _FACTS
    + """
    , l AS (SELECT *, unnest(range(len(names)))::INTEGER AS layer FROM lines)
    SELECT event_id, layer, names[layer + 1] AS name,
      CASE names[layer + 1] WHEN 'IP' THEN user_ip WHEN 'IP in ICMP' THEN user_ip
        WHEN 'Ethernet' THEN concat_ws(':', '06', event_hex[1:2], event_hex[3:4], event_hex[5:6],
                                       event_hex[7:8], event_hex[9:10])
        WHEN 'IPv6' THEN CASE WHEN user_id = 0 THEN '2001:db8::' ELSE user_ip6 END END AS src,
      CASE WHEN names[layer + 1] IN ('TCP', 'UDP', 'TCP in ICMP') THEN sport END AS sport,
      CASE names[layer + 1] WHEN 'IP' THEN (CASE event_type WHEN 'view' THEN 40 + n
             WHEN 'click' THEN 28 + n ELSE 68 END)::VARCHAR
        WHEN 'IP in ICMP' THEN '40' WHEN 'UDP' THEN (8 + n)::VARCHAR END AS len,
      CASE names[layer + 1] WHEN 'Raw' THEN lower(hex(props)) WHEN 'Padding' THEN repeat('00', 18)
        END AS load
    FROM l
    """
)
def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.layer_rows(_packets(spark, sf_dir))
    return rows.select(
        F.col("idx").alias("event_id"),
        "layer",
        "name",
        *[F.try_element_at("fields", F.lit(c)).alias(c) for c in ("src", "sport", "len", "load")],
    )


@query(
    _FACTS
    + """
    , l AS (SELECT unnest(names) AS name FROM facts),
    known(name, fields) AS (VALUES
      ('Ethernet', 'dst src type'), ('802.1Q', 'prio id vlan type'),
      ('IP', 'version ihl tos len id flags frag ttl proto chksum src dst'),
      ('IP in ICMP', 'version ihl tos len id flags frag ttl proto chksum src dst'),
      ('IPv6', 'version tc fl plen nh hlim src dst'),
      ('ARP', 'hwtype ptype hwlen plen op hwsrc psrc hwdst pdst'),
      ('TCP', 'sport dport seq ack dataofs reserved flags window chksum urgptr'),
      ('TCP in ICMP', 'sport dport seq ack dataofs reserved flags window chksum urgptr'),
      ('UDP', 'sport dport len chksum'), ('ICMP', 'type code chksum unused'),
      ('Raw', 'load'), ('Padding', 'load'))
    SELECT name, field, count(*) AS n
    FROM (SELECT name, unnest(string_split(fields, ' ')) AS field FROM l JOIN known USING (name))
    GROUP BY name, field
    """
)
def layer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.layer_fields(_packets(spark, sf_dir))


@query(
    """
    SELECT event_id FROM events WHERE event_type IN ('click', 'error')
    """
)
def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_layer(_packets(spark, sf_dir), "UDP").select(F.col("idx").alias("event_id"))


@query(
    _FACTS
    + """
    SELECT event_id, user_ip AS src, event_ip AS dst, '64' AS ttl, '2' AS flags,
           CASE event_type WHEN 'view' THEN '6' WHEN 'click' THEN '17' ELSE '1' END AS proto,
           (event_id % 65536)::VARCHAR AS id
    FROM facts WHERE event_type IN ('view', 'click', 'purchase')
    """
)
def protocol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = D.protocol_table(_packets(spark, sf_dir), "IP")
    return table.select(
        F.col("idx").alias("event_id"), "src", "dst", "ttl", "flags", "proto", "id"
    )


@query(
    _FACTS
    + """
    SELECT event_id, sport, '80' AS dport, (event_id % 4294967296)::VARCHAR AS seq, 'PA' AS flags,
           NULL::VARCHAR AS psrc, NULL::VARCHAR AS pdst
    FROM facts WHERE event_type = 'view'
    UNION ALL
    SELECT event_id, NULL, NULL, NULL, NULL, user_ip, event_ip
    FROM facts WHERE event_type = 'signup'
    """
)
def union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = _packets(spark, sf_dir)
    tcp = D.protocol_table(packets, "TCP", ["sport", "dport", "seq", "flags"])
    arp = D.protocol_table(packets, "ARP", ["psrc", "pdst"])
    return (
        append_ragged(tcp, arp)
        .withColumnRenamed("idx", "event_id")
        .select("event_id", "sport", "dport", "seq", "flags", "psrc", "pdst")
    )


@query(
    _FACTS
    + """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, size::INTEGER AS length FROM facts
    """
)
def packet_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).select(
        F.col("idx").alias("event_id"),
        P.time_text(F.col("ts")).alias("time"),
        P.packet_length(F.col("frame")).alias("length"),
    )


_HOPS = "IPv6 Extension Header - Hop-by-Hop Options Header"
_DESTINATION = "IPv6 Extension Header - Destination Options Header"
_FRAGMENT = "IPv6 Extension Header - Fragmentation header"
_DEEP = f"""
    WITH chains(event_type, chain) AS (VALUES
      ('view', 'Ethernet / 802_1AD / 802.1Q / 802.1Q / IPv6 / {_HOPS} / {_DESTINATION} / IPv6 Option Header Routing / AH / UDP / Raw'),
      ('click', 'Ethernet / IPv6 / {_FRAGMENT} / Raw'),
      ('signup', 'Ethernet' || repeat(' / 802.1Q', 48) || ' / ARP'),
      ('purchase', 'Ethernet / 802.1Q / 802.1Q / IPv6 / {_FRAGMENT} / TCP'),
      ('error', 'Ethernet / IPv6 / Raw')),
    f AS (SELECT *, event_id % 40 AS w FROM events JOIN chains USING (event_type))
"""


@query(
    _DEEP
    + """
    SELECT event_id, chain,
           (CASE event_type WHEN 'view' THEN 14 + 12 + 40 + w * 8 + 76 WHEN 'click' THEN 14 + 40 + 12
                WHEN 'signup' THEN 14 + 48 * 4 + 28 WHEN 'purchase' THEN 14 + 8 + 40 + 28
                ELSE 14 + 40 + 8 END)::INTEGER AS size,
           CASE event_type WHEN 'view' THEN (1024 + user_id % 60000)::VARCHAR WHEN 'purchase' THEN '443' END AS sport,
           CASE event_type WHEN 'view' THEN 'deadbeef' WHEN 'click' THEN 'deadbeef'
                WHEN 'error' THEN '1108000000000001' END AS load,
           CASE event_type WHEN 'signup' THEN '10.' || (user_id >> 16) % 256 || '.' || (user_id >> 8) % 256 || '.'
                || user_id % 256 END AS pdst
    FROM f
    """
)
def layer_chain_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = F.col("layers")
    ports = [P.layer_field(layers, name, "sport") for name in ("UDP", "TCP")]
    return D.dissect(deep_frames(spark, sf_dir)).select(
        F.col("idx").alias("event_id"),
        F.array_join(P.layer_chain(layers), " / ").alias("chain"),
        "size",
        F.coalesce(*ports).alias("sport"),
        P.layer_field(layers, "Raw", "load").alias("load"),
        P.layer_field(layers, "ARP", "pdst").alias("pdst"),
    )


@query(
    _DEEP
    + f"""
    , l AS (SELECT event_id, event_type, user_id, w, unnest(string_split(chain, ' / ')) AS name,
                   unnest(range(len(string_split(chain, ' / '))))::INTEGER AS layer FROM f)
    SELECT event_id, layer, name,
      CASE name WHEN '802_1AD' THEN (user_id % 4096)::VARCHAR
        WHEN '802.1Q' THEN CASE event_type WHEN 'view' THEN layer::VARCHAR WHEN 'purchase' THEN layer::VARCHAR
          ELSE CASE WHEN layer = 48 THEN '8' ELSE '7' END END END AS vlan,
      CASE name WHEN 'IPv6' THEN CASE event_type WHEN 'view' THEN '0' WHEN 'error' THEN '51' ELSE '44' END
        WHEN '{_HOPS}' THEN '60' WHEN '{_DESTINATION}' THEN '43' WHEN 'IPv6 Option Header Routing' THEN '51'
        WHEN 'AH' THEN '17' WHEN '{_FRAGMENT}' THEN CASE event_type WHEN 'click' THEN '17' ELSE '6' END END AS nh,
      CASE name WHEN '{_HOPS}' THEN repeat('01', (w * 8 + 6)::INTEGER) WHEN '{_DESTINATION}' THEN '010400000000' END AS options,
      CASE name WHEN '{_FRAGMENT}' THEN CASE event_type WHEN 'click' THEN '23' ELSE '0' END END AS "offset",
      CASE name WHEN '{_FRAGMENT}' THEN (event_id % 4294967296)::VARCHAR END AS id,
      CASE name WHEN 'AH' THEN (event_id % 4294967296)::VARCHAR END AS spi,
      CASE name WHEN 'AH' THEN repeat('cd', 12) END AS icv,
      CASE name WHEN 'IPv6 Option Header Routing' THEN repeat('ab', 16) END AS addresses
    FROM l WHERE name NOT IN ('Ethernet', 'Raw', 'ARP', 'UDP', 'TCP')
    """
)
def layer_rows_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.layer_rows(D.dissect(deep_frames(spark, sf_dir)))
    names = ("vlan", "nh", "options", "offset", "spi", "icv", "addresses")
    fragment = F.when(F.col("name") == _FRAGMENT, F.try_element_at("fields", F.lit("id")))
    return rows.where(~F.col("name").isin("Ethernet", "Raw", "ARP", "UDP", "TCP")).select(
        F.col("idx").alias("event_id"),
        "layer",
        "name",
        *[F.try_element_at("fields", F.lit(c)).alias(c) for c in names],
        fragment.alias("id"),
    )


# --- capture files and the stream ---------------------------------------------------------------

_IN_FILES = (
    _FACTS
    + f"""
    , filed AS (
      SELECT *, 'capture-' || lpad((event_id // {RECORDS_PER_FILE})::VARCHAR, 8, '0') || '.pcap' AS file,
             row_number() OVER (PARTITION BY event_id // {RECORDS_PER_FILE} ORDER BY event_id) - 1
               AS idx
      FROM lines)
"""
)


def _captures(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "captures")
    write_event_captures(spark, sf_dir, path)
    return path


@query(
    _IN_FILES
    + """
    SELECT file, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, size::INTEGER AS caplen,
           size::INTEGER AS len, 1 AS linktype, right(event_hex, 6) AS mac_end
    FROM filed
    """
)
def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Splits far below the file size, so that the ranges of large files are exercised.
    frames = read_capture(spark, _captures(spark, sf_dir), split_bytes=20_000, tasks=16)
    return frames.select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "idx",
        P.time_text(F.col("ts")).alias("time"),
        "caplen",
        "len",
        "linktype",
        F.lower(F.hex(F.substring("frame", 10, 3))).alias("mac_end"),
    )


@query(
    _FACTS
    + f"""
    SELECT 'capture-' || lpad((event_id // {RECORDS_PER_FILE})::VARCHAR, 8, '0') || '.'
             || (['pcap', 'pcapng', 'pcap.gz', 'pcapng.gz'])[(event_id // {RECORDS_PER_FILE}) % 4 + 1] AS file,
           row_number() OVER (PARTITION BY event_id // {RECORDS_PER_FILE} ORDER BY event_id) - 1 AS idx,
           epoch_us(ts) AS us, size::INTEGER AS caplen, size::INTEGER AS len, 1 AS linktype,
           right(event_hex, 6) AS mac_end
    FROM facts
    """
)
def capture_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classic and next-generation captures, plain and packed, with two clocks."""
    path = scratch_path(spark, "capture-formats")
    write_event_captures(spark, sf_dir, path, FORMATS)
    return read_capture(spark, path, split_bytes=60_000, tasks=16).select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "idx",
        F.unix_micros("ts").alias("us"),
        "caplen",
        "len",
        "linktype",
        F.lower(F.hex(F.substring("frame", 10, 3))).alias("mac_end"),
    )


@query(
    _IN_FILES
    + """
    SELECT file, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, size::INTEGER AS caplen, size::INTEGER AS len,
           1 AS linktype, right(event_hex, 6) AS mac_end
    FROM filed
    """
)
def capture_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures read in three triggers while they grow, cut anywhere in between."""
    whole, folder, store = (scratch_path(spark, f"growing-{part}") for part in ("whole", "folder", "store"))
    write_event_captures(spark, sf_dir, whole)
    for share in (40, 73, 100):
        grow_captures(spark, whole, folder, share)
        read_on(spark, folder, store)
    return frames_read(spark, store).select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "idx",
        P.time_text(F.col("ts")).alias("time"),
        "caplen",
        "len",
        "linktype",
        F.lower(F.hex(F.substring("frame", 10, 3))).alias("mac_end"),
    )


def _streamed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    lines = packet_lines(
        stream_capture(spark, _captures(spark, sf_dir), bytes_per_trigger=TRIGGER_BYTES, **options)
    )
    path = scratch_path(spark, "packet-lines")
    write_stream(lines, path, scratch_path(spark, "packet-lines-checkpoint")).awaitTermination()
    return (
        spark.read.schema(lines.schema)
        .parquet(path)
        .withColumn("file", F.element_at(F.split("file", "/"), -1))
    )


_LINES = """
    SELECT file, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time,
           list_aggregate(names, 'string_agg', ' ') AS chain, size::INTEGER AS length, summary
    FROM filed
"""


@query(_IN_FILES + _LINES)
def stream_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir)


@query(_IN_FILES + _LINES + " WHERE idx < 51")
def stream_prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 51 packets of each capture, which is where the stream demo stops."""
    return _streamed(spark, sf_dir, first=51)
