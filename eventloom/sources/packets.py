"""Packet tables: rows of ``ts`` and ``data`` (an Ethernet frame), decoded by column expressions.

Headers are read from the hexadecimal text of the frame. The DNS question name, whose
length is in the data, is a fold over the message's bytes, and only DNS packets have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lines import source_column

# Ethernet types, transport numbers, header sizes, DNS port and header size.
VLAN_TYPES = ("8100", "88A8", "9100")
IPV4_TYPE, IPV6_TYPE = "0800", "86DD"
TCP, UDP = 6, 17
ETHERNET_BYTES, VLAN_BYTES, IPV4_BYTES, IPV6_BYTES, TCP_BYTES, UDP_BYTES = 14, 4, 20, 40, 20, 8
DNS_PORT, DNS_HEADER_BYTES = 53, 12


def _hex(text: Column, at: Column | int, size: int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.substr(text, at * 2 + 1, F.lit(size * 2))


def _number(text: Column, at: Column | int, size: int) -> Column:
    return F.conv(_hex(text, at, size), 16, 10).cast("int")


def _ipv4_text(text: Column, at: Column) -> Column:
    return F.concat_ws(".", *[_number(text, at + i, 1).cast("string") for i in range(4)])


def _ipv6_text(text: Column, at: Column) -> Column:
    return F.lower(F.concat_ws(":", *[_hex(text, at + 2 * i, 2) for i in range(8)]))


def dns_question_name(message: Column) -> Column:
    """Labels of the first question joined by dots; null when there are none or they overrun.

    A walk over the bytes with the offset as state; a label takes two bytes at least, which bounds the steps.
    """
    size_of = F.length(message)
    walking, ended, broken = F.lit(0), F.lit(1), F.lit(2)

    def state(at, text, phase):
        return F.struct(at.cast("int").alias("at"), text.cast("string").alias("text"), phase.cast("int").alias("phase"))

    def step(s, _):
        size = F.conv(F.hex(F.substr(message, s["at"] + 1, F.lit(1))), 16, 10).cast("int")
        label = F.substr(message, s["at"] + 2, size)
        shown = label.cast("string")
        whole = (F.length(label) == size) & F.is_valid_utf8(shown)
        joined = F.when(s["at"] == DNS_HEADER_BYTES, shown).otherwise(F.concat(s["text"], F.lit("."), shown))
        return (
            F.when(s["phase"] != walking, s)
            .when(s["at"] >= size_of, state(s["at"], s["text"], broken))
            .when((size == 0) | (size >= 0xC0), state(s["at"], s["text"], ended))
            .when(whole, state(s["at"] + 1 + size, joined, walking))
            .otherwise(state(s["at"], s["text"], broken))
        )

    steps = F.sequence(F.lit(0), F.call_function("div", size_of - DNS_HEADER_BYTES, F.lit(2)).cast("int") + 1)
    name = F.aggregate(steps, state(F.lit(DNS_HEADER_BYTES), F.lit(""), walking), step, lambda s: F.when((s["phase"] == ended) & (s["text"] != ""), s["text"]))
    return F.when(size_of > DNS_HEADER_BYTES, name)


def decode_packets(packets: DataFrame) -> DataFrame:
    """Add ``event_type``, ``protocol``, ``src_ip``, ``dst_ip``, ``src_port``, ``dst_port`` and ``query``."""
    t = F.col("_hex")
    size = F.col("_size")
    start = packets.withColumns({"_hex": F.hex("data"), "_size": F.length("data")})
    one = _hex(t, 12, 2).isin(*VLAN_TYPES)
    two = one & _hex(t, 16, 2).isin(*VLAN_TYPES)
    start = start.withColumn("_tags", F.when(two, 2).when(one, 1).otherwise(0))
    start = start.withColumns(
        {
            "_ip": F.col("_tags") * VLAN_BYTES + ETHERNET_BYTES,
            "_ether": _hex(t, F.col("_tags") * VLAN_BYTES + 12, 2),
        }
    )
    ip = F.col("_ip")
    is_v4, is_v6 = F.col("_ether") == IPV4_TYPE, F.col("_ether") == IPV6_TYPE
    first = _number(t, ip, 1)
    v4_head = (first % 16) * 4
    v4_total = _number(t, ip + 2, 2)
    v6_payload = _number(t, ip + 4, 2)
    v4_ok = (
        (size >= ip + IPV4_BYTES) & (first.between(0x45, 0x4F)) & (v4_total >= v4_head) & (size >= ip + v4_total)
    )
    v6_ok = (size >= ip + IPV6_BYTES) & first.between(0x60, 0x6F) & (size >= ip + IPV6_BYTES + v6_payload)
    fragment = _number(t, ip + 6, 2) % 0x4000 != 0
    net = start.withColumns(
        {
            "_net": F.when(size < F.col("_ip"), "raw")
            .when(is_v4, F.when(v4_ok, "ipv4").otherwise("raw"))
            .when(is_v6, F.when(v6_ok, "ipv6").otherwise("raw"))
            .otherwise("unknown"),
            "_body": F.when(is_v4, ip + v4_head).otherwise(ip + IPV6_BYTES),
            "_end": F.when(is_v4, ip + v4_total).when(v6_payload == 0, size).otherwise(ip + IPV6_BYTES + v6_payload),
            "_next": F.when(is_v4, F.when(~fragment, _number(t, ip + 9, 1))).otherwise(_number(t, ip + 6, 1)),
        }
    )
    body, end, following = F.col("_body"), F.col("_end"), F.col("_next")
    tcp_head = F.call_function("div", _number(t, body + 12, 1), F.lit(16)).cast("int") * 4
    udp_size = _number(t, body + 4, 2)
    tcp_ok = (end - body >= TCP_BYTES) & (tcp_head >= TCP_BYTES) & (end - body >= tcp_head)
    udp_ok = (end - body >= UDP_BYTES) & ((udp_size == 0) | ((udp_size >= UDP_BYTES) & (udp_size <= end - body)))
    is_ip = F.col("_net").isin("ipv4", "ipv6")
    sent = net.withColumns(
        {
            "_kind": F.when(is_ip & (following == TCP), F.when(tcp_ok, "tcp").otherwise("raw"))
            .when(is_ip & (following == UDP), F.when(udp_ok, "udp").otherwise("raw"))
            .otherwise(F.col("_net")),
            "_message": F.when(following == TCP, body + tcp_head).otherwise(body + UDP_BYTES),
            "_stop": F.when((following == UDP) & (udp_size != 0), body + udp_size).otherwise(end),
        }
    )
    ported = F.col("_kind").isin("tcp", "udp")
    sent = sent.withColumns(
        {
            "_from": F.when(ported, _number(t, body, 2)),
            "_to": F.when(ported, _number(t, body + 2, 2)),
        }
    )
    is_dns = F.coalesce((F.col("_from") == DNS_PORT) | (F.col("_to") == DNS_PORT), F.lit(False))
    message = F.substr(F.col("data"), F.col("_message") + 1, F.greatest(F.col("_stop") - F.col("_message"), F.lit(0)))
    addressed = ported | F.col("_kind").isin("ipv4", "ipv6")
    v4 = F.col("_net") == "ipv4"
    return sent.select(
        *packets.columns,
        F.when(is_dns, "dns_query").otherwise("network_connection").alias("event_type"),
        F.col("_kind").alias("protocol"),
        F.when(addressed, F.when(v4, _ipv4_text(t, ip + 12)).otherwise(_ipv6_text(t, ip + 8))).alias("src_ip"),
        F.when(addressed, F.when(v4, _ipv4_text(t, ip + 16)).otherwise(_ipv6_text(t, ip + 24))).alias("dst_ip"),
        F.col("_from").cast("string").alias("src_port"),
        F.col("_to").cast("string").alias("dst_port"),
        F.when(is_dns, message).alias("_dns"),
        is_dns.alias("_is_dns"),
    ).withColumn(
        "query", F.when(F.col("_is_dns"), F.coalesce(dns_question_name(F.col("_dns")), F.lit("")))
    ).drop("_dns", "_is_dns")


def packet_records(packets: DataFrame, interface: str = "table") -> DataFrame:
    """Raw records of a packet table (``ts``, ``data`` and optionally ``seq``); the event time
    is the time of the packet."""
    if "seq" not in packets.columns:
        packets = packets.withColumn("seq", F.monotonically_increasing_id())
    decoded = decode_packets(packets.select("seq", "ts", "data"))
    return decoded.select(
        source_column("pcap", interface).alias("source"),
        "seq",
        F.col("ts").cast("timestamp").alias("received_at"),
        F.to_json(
            F.struct("event_type", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "query")
        ).alias("raw"),
    )
