"""Header decoding as SQL text, and text forms of packets as column expressions.

Headers are decoded from ``_b``, the first bytes of a frame as an array of numbers,
at offsets that are columns themselves; longer pieces are cut from the binary column
``frame``. A header needs dozens of expressions, so they are written as SQL text and
parsed once per layer. Field values are text: a layer is one ``map<string,string>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link types, ether types, IP protocol numbers, ICMP message types.
LINK_ETHERNET = 1
LINK_RAW_IP = (12, 14, 101, 228, 229)
ETHER_IPV4 = 0x0800
ETHER_ARP = 0x0806
ETHER_VLAN = 0x8100
ETHER_PROVIDER_VLAN = 0x88A8
ETHER_IPV6 = 0x86DD
PROTO_ICMP = 1
PROTO_TCP = 6
PROTO_UDP = 17
ICMP_ERRORS = (3, 4, 5, 11, 12)
ICMP_ECHOES = (0, 8)
TCP_FLAGS = "FSRPAUEC"
ETHER_TAGS = (ETHER_VLAN, ETHER_PROVIDER_VLAN)
EXT_HOPS = 0
EXT_ROUTING = 43
EXT_FRAGMENT = 44
EXT_AUTHENTICATION = 51
EXT_DESTINATION = 60
EXTENSIONS = (EXT_HOPS, EXT_ROUTING, EXT_FRAGMENT, EXT_AUTHENTICATION, EXT_DESTINATION)

# Link with two tags, network, ICMP and quoted headers together are at most 170 bytes long.
HEADER_BYTES = 192


def header_bytes(frame: Column, count) -> Column:
    """The leading bytes of a frame as ``array<int>``."""
    text = F.decode(F.substring(frame, F.lit(1), count), "ISO-8859-1")
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def is_deep() -> str:
    """Whether headers may go on behind ``HEADER_BYTES``: behind a third tag, or in an IPv6
    packet with extension headers. Looks at a few bytes of ``frame`` alone."""

    def code(at, length: int) -> str:
        return f"hex(substring(frame, {at} + 1, {length}))"

    def among(at, length: int, values: tuple[int, ...]) -> str:
        texts = ", ".join(f"'{v:0{2 * length}X}'" for v in values)
        return f"{code(at, length)} in ({texts})"

    tags = [among(12 + 4 * k, 2, ETHER_TAGS) for k in range(3)]
    net = (
        f"case when linktype <> {LINK_ETHERNET} then 0 when not {tags[0]} then 14 "
        f"when not {tags[1]} then 18 else 22 end"
    )
    extended = (
        f"exists(array({net}), n -> substring({code('n', 1)}, 1, 1) = '6' and {among('n + 6', 1, EXTENSIONS)})"
    )
    return f"linktype = {LINK_ETHERNET} and {' and '.join(tags)} or {extended}"


# --- pieces of SQL: a number or text at byte ``i`` behind the offset ``at`` ------------------


def u8(at, i: int | str = 0) -> str:
    return f"get(_b, cast({at} + {i} as int))"


def u16(at, i: int | str = 0) -> str:
    return f"({u8(at, i)} * 256 + {u8(at, f'{i} + 1')})"


def u32(at, i: int = 0) -> str:
    return f"(cast({u16(at, i)} as bigint) * 65536 + {u16(at, i + 2)})"


def high_bits(number: str, skip: int) -> str:
    return f"shiftright({number}, {skip})"


def low_bits(number: str, keep: int) -> str:
    return f"({number} & {(1 << keep) - 1})"


def piece(at, i: int, length) -> str:
    return f"lower(hex(substring(frame, cast({at} + {i + 1} as int), cast({length} as int))))"


def mac(at, i: int) -> str:
    return f"concat_ws(':', {', '.join(piece(at, i + n, 1) for n in range(6))})"


def ipv4(at, i: int) -> str:
    return f"concat_ws('.', {', '.join(u8(at, i + n) for n in range(4))})"


def ipv6(at, i: int) -> str:
    """Eight groups without leading zeros; the longest run of zero groups becomes ``::``.

    With a colon at both ends, a run of zero groups is the text ``:0:0:``.
    """
    groups = ", ".join(f"lower(hex({u16(at, i + 2 * n)}))" for n in range(8))
    cases = " ".join(
        f"when instr(g, ':{'0:' * run}') > 0 then concat("
        f"substring(g, 2, instr(g, ':{'0:' * run}') - 2), '::', "
        f"rtrim(':', substring(g, instr(g, ':{'0:' * run}') + {2 * run + 1})))"
        for run in range(8, 1, -1)
    )
    whole = "substring(g, 2, length(g) - 2)"
    return f"transform(array(concat(':', concat_ws(':', {groups}), ':')), g -> case {cases} else {whole} end)[0]"


def layer(name: str, options: tuple[str, str] | None = None, **values: str) -> str:
    """A layer with its fields in the order given.

    ``options`` are the start and the length of bytes that only some headers have; as
    hex text they become a field of that name where there are any.
    """
    items = ", ".join(f"'{field}', cast({sql} as string)" for field, sql in values.items())
    fields = f"map({items})"
    if options:
        start, length = options
        some = f"if({length} > 0, map('options', {piece(start, 0, length)}), cast(map() as map<string,string>))"
        fields = f"map_concat({fields}, {some})"
    return f"struct('{name}' as name, {fields} as fields)"


def beyond(at, least: int, words: str) -> tuple[str, str]:
    """Start and length of what a header of so many words has after its fixed bytes."""
    return f"({at} + {least})", f"(greatest({words} * 4, {least}) - {least})"


# --- headers ------------------------------------------------------------------------------


def ethernet() -> str:
    return layer("Ethernet", dst=mac(0, 0), src=mac(0, 6), type=u16(0, 12))


def dot3() -> str:
    return layer("802.3", dst=mac(0, 0), src=mac(0, 6), len=u16(0, 12))


def is_tag(k) -> str:
    """Whether the k-th tag, from 0 on, is there in full."""
    return f"({u16(12, f'4 * {k}')} in {ETHER_TAGS} and size >= 18 + 4 * {k})"


def tag_count() -> str:
    """Tags in a row behind the addresses; a third one starts a walk over the frame."""
    walk = (
        "aggregate(sequence(3, greatest(3, (size - 14) div 4)), 3, "
        f"(n, k) -> if(n = k and {is_tag('k')}, n + 1, n))"
    )
    cases = " ".join(f"when not {is_tag(k)} then {k}" for k in range(3))
    return f"case {cases} else {walk} end"


def vlan(at, name: str = "802.1Q") -> str:
    tag = u16(at)
    return layer(
        name,
        prio=high_bits(tag, 13),
        id=low_bits(high_bits(tag, 12), 1),
        vlan=low_bits(tag, 12),
        type=u16(at, 2),
    )


_LAYERS = "array<struct<name:string,fields:map<string,string>>>"


def tags(count: str) -> str:
    """The layers of so many tags; the type before a tag tells its kind."""
    at = "(14 + 4 * k)"
    one = f"if({u16(at, -2)} = {ETHER_PROVIDER_VLAN}, {vlan(at, '802_1AD')}, {vlan(at)})"
    return f"if({count} > 0, transform(sequence(0, {count} - 1), k -> {one}), cast(array() as {_LAYERS}))"


def _extension(at: str) -> str:
    """The layer of the extension header of type ``s.nh`` at an offset."""
    size = extension_size(at)
    common = {"nh": u8(at), "len": u8(at, 1)}

    def options(name: str) -> str:
        return layer(f"IPv6 Extension Header - {name} Options Header", (f"({at} + 2)", f"({size} - 2)"), **common)

    routing = layer(
        "IPv6 Option Header Routing", **common, type=u8(at, 2), segleft=u8(at, 3),
        reserved=u32(at, 4), addresses=piece(at, 8, f"{size} - 8"),
    )
    fragment = layer(
        "IPv6 Extension Header - Fragmentation header", nh=u8(at), res1=u8(at, 1),
        offset=high_bits(u16(at, 2), 3), res2=low_bits(high_bits(u8(at, 3), 1), 2), m=low_bits(u8(at, 3), 1),
        id=u32(at, 4),
    )
    authentication = layer(
        "AH", nh=u8(at), payloadlen=u8(at, 1), reserved=u16(at, 2), spi=u32(at, 4), seq=u32(at, 8),
        icv=piece(at, 12, f"{size} - 12"),
    )
    return (
        f"case s.nh when {EXT_HOPS} then {options('Hop-by-Hop')} when {EXT_DESTINATION} then {options('Destination')} "
        f"when {EXT_ROUTING} then {routing} when {EXT_FRAGMENT} then {fragment} else {authentication} end"
    )


def extension_size(at: str) -> str:
    return (
        f"(case s.nh when {EXT_FRAGMENT} then 8 when {EXT_AUTHENTICATION} then ({u8(at, 1)} + 2) * 4 "
        f"else ({u8(at, 1)} + 1) * 8 end)"
    )


def extensions(start: str, first: str, end: str) -> str:
    """What is behind an IPv6 header: ``at``, where the extension headers end, ``nh``, what
    follows them, and their ``layers``.

    A fold over the type of the next header, which ends at the first one that is no
    extension or not all there. A later fragment holds no header, its ``nh`` is -1.
    """
    size = extension_size("s.at")
    later = f"s.nh = {EXT_FRAGMENT} and {high_bits(u16('s.at', 2), 3)} > 0"
    step = (
        f"if(s.nh in {EXTENSIONS} and s.at + 8 <= {end} and s.at + {size} <= {end}, "
        f"struct(cast(s.at + {size} as int) as at, if({later}, -1, {u8('s.at')}) as nh, "
        f"concat(s.layers, array({_extension('s.at')})) as layers), s)"
    )
    none = f"struct(cast({start} as int) as at, cast({first} as int) as nh, cast(array() as {_LAYERS}) as layers)"
    return (
        f"if({first} in {EXTENSIONS}, "
        f"aggregate(sequence(1, greatest(1, ({end} - {start}) div 8)), {none}, (s, k) -> {step}), {none})"
    )


def arp(at) -> str:
    return layer(
        "ARP",
        hwtype=u16(at),
        ptype=u16(at, 2),
        hwlen=u8(at, 4),
        plen=u8(at, 5),
        op=u16(at, 6),
        hwsrc=mac(at, 8),
        psrc=ipv4(at, 14),
        hwdst=mac(at, 18),
        pdst=ipv4(at, 24),
    )


def ip(at, name: str = "IP") -> str:
    return layer(
        name,
        beyond(at, 20, low_bits(u8(at), 4)),
        version=high_bits(u8(at), 4),
        ihl=low_bits(u8(at), 4),
        tos=u8(at, 1),
        len=u16(at, 2),
        id=u16(at, 4),
        flags=high_bits(u8(at, 6), 5),
        frag=low_bits(u16(at, 6), 13),
        ttl=u8(at, 8),
        proto=u8(at, 9),
        chksum=u16(at, 10),
        src=ipv4(at, 12),
        dst=ipv4(at, 16),
    )


def ip6(at) -> str:
    return layer(
        "IPv6",
        version=high_bits(u8(at), 4),
        tc=low_bits(high_bits(u16(at), 4), 8),
        fl=low_bits(u32(at), 20),
        plen=u16(at, 4),
        nh=u8(at, 6),
        hlim=u8(at, 7),
        src=ipv6(at, 8),
        dst=ipv6(at, 24),
    )


def tcp_flags(bits: str) -> str:
    letters = ", ".join(
        f"if({low_bits(high_bits(bits, i), 1)} = 1, '{letter}', '')"
        for i, letter in enumerate(TCP_FLAGS)
    )
    return f"concat({letters})"


def tcp(at, name: str = "TCP") -> str:
    """Behind a quoted header the options are part of the rest, so only ``TCP`` has them."""
    return layer(
        name,
        beyond(at, 20, high_bits(u8(at, 12), 4)) if name == "TCP" else None,
        sport=u16(at),
        dport=u16(at, 2),
        seq=u32(at, 4),
        ack=u32(at, 8),
        dataofs=high_bits(u8(at, 12), 4),
        reserved=low_bits(high_bits(u8(at, 12), 1), 3),
        flags=tcp_flags(u8(at, 13)),
        window=u16(at, 14),
        chksum=u16(at, 16),
        urgptr=u16(at, 18),
    )


def tcp_start(at, name: str) -> str:
    """The first 8 bytes of a TCP header, all that an ICMP error has to carry."""
    return layer(name, sport=u16(at), dport=u16(at, 2), seq=u32(at, 4))


def udp(at, name: str = "UDP") -> str:
    return layer(name, sport=u16(at), dport=u16(at, 2), len=u16(at, 4), chksum=u16(at, 6))


def icmp(at, name: str = "ICMP") -> str:
    common = {"type": u8(at), "code": u8(at, 1), "chksum": u16(at, 2)}
    echo = layer(name, **common, id=u16(at, 4), seq=u16(at, 6))
    return f"if({u8(at)} in {ICMP_ECHOES}, {echo}, {layer(name, **common, unused=u32(at, 4))})"


def rest(name: str, start: str, stop: str) -> str:
    return layer(name, load=piece(start, 0, f"{stop} - {start}"))


# --- functions over the column ``layers`` -----------------------------------------------------


def layer_chain(layers: Column) -> Column:
    """Layer names from the link layer inward."""
    return F.transform(layers, lambda item: item["name"])


def last_token(name: Column) -> Column:
    """Protocol at the end of a layer name: ``TCP in ICMP`` gives ``ICMP``."""
    return F.element_at(F.split(name, " "), -1)


def has_layer(layers: Column, name: str) -> Column:
    return F.exists(layers, lambda item: item["name"] == name)


def layer_field(layers: Column, name: str, field: str) -> Column:
    """Field of the first layer with that name, null if there is none."""
    found = F.filter(layers, lambda item: item["name"] == name)
    return F.try_element_at(F.get(found, F.lit(0))["fields"], F.lit(field))


def packet_length(frame: Column) -> Column:
    return F.length(frame)


def time_text(ts: Column) -> Column:
    """Capture time as text in the session time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _end(layers: Column, port: str, address: str, arp_address: str) -> Column:
    """Address, with the port if there is one, at one end of the outermost packet."""
    number = F.coalesce(layer_field(layers, "TCP", port), layer_field(layers, "UDP", port))
    with_port = F.coalesce(F.concat(F.lit(":"), number), F.lit(""))
    host = F.coalesce(layer_field(layers, "IP", address), layer_field(layers, "IPv6", address))
    return F.coalesce(
        F.concat(host, with_port),
        layer_field(layers, "ARP", arp_address),
        layer_field(layers, "Ethernet", address),
    )


def summary(layers: Column) -> Column:
    """One line: the layer names, then source and destination."""
    ends = F.concat_ws(
        " > ", _end(layers, "sport", "src", "psrc"), _end(layers, "dport", "dst", "pdst")
    )
    return F.concat_ws(
        " ", F.array_join(layer_chain(layers), " / "), F.when(ends != "", ends)
    )
