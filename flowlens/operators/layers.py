"""Dissection of frames into layers, and tables per protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import packets as P
from flowlens.session import materialize


def _step(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns, given as SQL, that later steps refer to by name.

    A plain projection would not do: the optimizer pushes filters through it by
    pasting the expressions in, which multiplies with every step. It does not do
    that through a generator, and ``inline`` of a one-element array keeps one row.
    """
    values = ", ".join(f"{sql} as {name}" for name, sql in columns.items())
    return df.select("*", F.expr(f"inline(array(struct({values})))"))


def _is(condition: str) -> str:
    return f"coalesce({condition}, false)"


def dissect(frames: DataFrame) -> DataFrame:
    """Replace ``frame`` by ``layers``: an array of ``(idx, name, fields)``.

    Everything is an expression over the bytes of the frame. Offsets are computed
    first, in steps, so that each header is decoded at a plain column offset. Tags and
    IPv6 extension headers are followed to any depth; only frames that have more of
    them than usual are looked at beyond their first bytes. Bytes
    that no known header covers, or that are cut off, become the layer ``Raw``; bytes
    behind the IP length become ``Padding``. Layers keep their position, so a header
    inside an ICMP error does not hide the outer one.
    """
    fragment = P.low_bits(P.u16("_net", 6), 13)
    quoted_version = P.high_bits(P.u8("_body"), 4)

    def header_end(at: str, words: str, least: int) -> str:
        return f"{at} + greatest({words} * 4, {least})"

    d = frames.withColumn("size", F.length("frame"))
    count = F.expr(f"if({_is(P.is_deep())}, size, {P.HEADER_BYTES})")
    d = d.select("*", F.inline(F.array(F.struct(P.header_bytes(F.col("frame"), count).alias("_b")))))
    d = _step(
        d,
        _type=f"if(linktype = {P.LINK_ETHERNET} and size >= 14, {P.u16(0, 12)}, null)",
        _version=f"if(linktype in {P.LINK_RAW_IP} and size >= 1, {P.high_bits(P.u8(0), 4)}, null)",
    )
    d = _step(
        d,
        _dot3=_is("_type <= 1500"),
        _tags=f"if({_is(f'_type in {P.ETHER_TAGS}')}, {P.tag_count()}, 0)",
    )
    # Start of the network header and what it is.
    d = _step(
        d,
        _net="if(_type is not null, 14 + 4 * _tags, 0)",
        _inner=f"case when _tags > 0 then {P.u16(12, '4 * _tags')} when _version = 4 then {P.ETHER_IPV4} "
        f"when _version = 6 then {P.ETHER_IPV6} else _type end",
    )
    d = _step(
        d,
        _ip=_is(f"_inner = {P.ETHER_IPV4} and size - _net >= 20"),
        _ip6=_is(f"_inner = {P.ETHER_IPV6} and size - _net >= 40"),
        _arp=_is(f"_inner = {P.ETHER_ARP} and size - _net >= 28"),
    )
    # End of the packet proper, start of the transport header and its protocol.
    d = _step(
        d,
        _end=f"case when _ip and {P.u16('_net', 2)} >= 20 "
        f"then least(size, _net + {P.u16('_net', 2)}) "
        f"when _ip6 then least(size, _net + 40 + {P.u16('_net', 4)}) "
        "when _arp then _net + 28 else size end",
    )
    d = _step(d, _ext=f"if(_ip6, {P.extensions('_net + 40', P.u8('_net', 6), '_end')}, null)")
    d = _step(
        d,
        _l4=f"case when _ip then {header_end('_net', P.low_bits(P.u8('_net'), 4), 20)} "
        "when _ip6 then _ext.at when _arp then _net + 28 else _net end",
        _proto=f"case when _ip and {fragment} = 0 then {P.u8('_net', 9)} when _ip6 then _ext.nh end",
    )
    d = _step(
        d,
        _tcp=_is(f"_proto = {P.PROTO_TCP} and _end - _l4 >= 20"),
        _udp=_is(f"_proto = {P.PROTO_UDP} and _end - _l4 >= 8"),
        _icmp=_is(f"_proto = {P.PROTO_ICMP} and _ip and _end - _l4 >= 8"),
    )
    d = _step(
        d,
        _body=f"case when _tcp then {header_end('_l4', P.high_bits(P.u8('_l4', 12), 4), 20)} "
        "when _udp or _icmp then _l4 + 8 else _l4 end",
        _error=_is(f"_icmp and {P.u8('_l4')} in {P.ICMP_ERRORS}"),
    )
    # The packet an ICMP error quotes.
    d = _step(d, _qip=_is(f"_error and _end - _body >= 20 and {quoted_version} = 4"))
    d = _step(
        d,
        _q4=f"if(_qip, {header_end('_body', P.low_bits(P.u8('_body'), 4), 20)}, _body)",
        _qproto=f"if(_qip, {P.u8('_body', 9)}, null)",
    )
    d = _step(
        d,
        _qtcp=_is(f"_qproto = {P.PROTO_TCP} and _end - _q4 >= 8"),
        _qudp=_is(f"_qproto = {P.PROTO_UDP} and _end - _q4 >= 8"),
        _qicmp=_is(f"_qproto = {P.PROTO_ICMP} and _end - _q4 >= 8"),
    )
    d = _step(
        d,
        _raw="case when _qtcp and _end - _q4 >= 20 then _q4 + 20 "
        "when _qtcp or _qudp or _qicmp then _q4 + 8 else _q4 end",
    )
    slots = [
        f"case when _dot3 then {P.dot3()} when _type is not null then {P.ethernet()} end",
        f"case when _ip then {P.ip('_net')} when _ip6 then {P.ip6('_net')} "
        f"when _arp then {P.arp('_net')} end",
        f"case when _tcp then {P.tcp('_l4')} when _udp then {P.udp('_l4')} "
        f"when _icmp then {P.icmp('_l4')} end",
        f"case when _qip then {P.ip('_body', 'IP in ICMP')} end",
        f"case when _qtcp and _end - _q4 >= 20 then {P.tcp('_q4', 'TCP in ICMP')} "
        f"when _qtcp then {P.tcp_start('_q4', 'TCP in ICMP')} "
        f"when _qudp then {P.udp('_q4', 'UDP in ICMP')} "
        f"when _qicmp then {P.icmp('_q4', 'ICMP in ICMP')} end",
        f"case when _raw < _end then {P.rest('Raw', '_raw', '_end')} end",
        f"case when greatest(_raw, _end) < size "
        f"then {P.rest('Padding', 'greatest(_raw, _end)', 'size')} end",
    ]
    link, net, *others = slots
    parts = [
        f"array({link})", P.tags("_tags"), f"array({net})",
        "if(_ip6, _ext.layers, array())", f"array({', '.join(others)})",
    ]
    d = _step(
        d,
        layers=f"transform(filter(concat({', '.join(parts)}), s -> s is not null), "
        "(s, i) -> struct(i as idx, s.name as name, s.fields as fields))",
    )
    return d.select(*[c for c in frames.columns if c != "frame"], "size", "layers")


def layer_rows(packets: DataFrame) -> DataFrame:
    """One row per layer of a packet: ``file, idx, layer, name, fields``."""
    return packets.select("file", "idx", F.explode("layers").alias("l")).select(
        "file", "idx", F.col("l.idx").alias("layer"), "l.name", "l.fields"
    )


def layer_fields(packets: DataFrame) -> DataFrame:
    """The fields seen per protocol, with the number of layers that have them."""
    return (
        layer_rows(packets)
        .select("name", F.explode(F.map_keys("fields")).alias("field"))
        .groupBy("name", "field")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def protocol_table(packets: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """The layers of one protocol, a column per field; missing fields are null.

    Without ``columns`` the fields are looked up first, in the layers of that protocol,
    which are stored for it, so that the packets are dissected once; a protocol has no
    more fields than its header description and options name.
    """
    rows = layer_rows(packets.where(P.has_layer(F.col("layers"), name))).where(
        F.col("name") == name
    )
    if columns is None:
        rows = materialize(rows, "protocol")
        found = rows.select(F.explode(F.map_keys("fields")).alias("field")).distinct()
        columns = sorted(row["field"] for row in found.collect())
    return rows.select(
        "file",
        "idx",
        "layer",
        *[F.try_element_at("fields", F.lit(c)).alias(c) for c in columns],
    )


def write_protocol_tables(packets: DataFrame, path: str) -> None:
    """All protocols as one partitioned table, ``name=<protocol>``, without a shuffle."""
    layer_rows(packets).write.partitionBy("name").parquet(path)


def with_layer(packets: DataFrame, name: str) -> DataFrame:
    """The packets that have a layer of that name."""
    return packets.where(P.has_layer(F.col("layers"), name))
