"""IP address expressions: validity, integer form, internal ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4_BODY = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
IPV4 = rf"\A{_V4_BODY}\z"
_H = "[0-9A-Fa-f]{1,4}"
# eight groups, or "::" standing for at least one group
IPV6_HEX = (
    rf"\A(?:(?:{_H}:){{7}}{_H}"
    rf"|(?!:*(?:[0-9A-Fa-f]+:+){{7}}[0-9A-Fa-f])(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?)\z"
)

# Ranges that count as internal without configuration.
INTERNAL_CIDRS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def is_ipv6(ip: Column) -> Column:
    # an embedded dotted quad fills two groups
    hexed = F.regexp_replace(ip, rf"(?<=:){_V4_BODY}\z", "0:0")
    return ip.contains(":") & hexed.rlike(IPV6_HEX)


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ipv4_to_long(ip: Column) -> Column:
    """The address as a number in 0 … 2^32-1, NULL when it is not a valid IPv4 address."""
    octets = F.split(F.regexp_extract(ip, IPV4, 0), r"\.")
    return F.aggregate(octets, F.lit(0).cast("long"), lambda acc, part: acc * F.lit(256) + part.try_cast("long"))


def ipv6_to_hex(ip: Column) -> Column:
    """32 hex digits for a valid IPv6 address, else NULL."""
    quad = F.regexp_extract(ip, rf":({_V4_BODY})\z", 1)
    as_long = ipv4_to_long(quad)
    high = F.hex(F.shiftright(as_long, 16))
    low = F.hex(as_long.bitwiseAND(F.lit(65535)))
    plain = F.when(
        quad != "",
        F.concat(F.regexp_replace(ip, r"[0-9.]+\z", ""), high, F.lit(":"), low),
    ).otherwise(ip)
    halves = F.split(plain, "::", -1)

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    fill = F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
    padded = F.transform(F.concat(left, F.array_repeat(F.lit("0"), fill), right), lambda g: F.lpad(F.lower(g), 4, "0"))
    return F.when(is_ipv6(ip), F.array_join(padded, ""))


def in_cidrs(ip_long: Column, cidrs: tuple[str, ...] | list[str]) -> Column:
    """Is a numeric IPv4 address inside any of the given networks?"""
    hit = F.lit(False)
    for text in cidrs:
        net = ipaddress.ip_network(text, strict=False)
        if net.version == 4:
            hit = hit | ip_long.between(F.lit(int(net.network_address)), F.lit(int(net.broadcast_address)))
    return hit


def in_v6_cidrs(ip_hex: Column, cidrs: tuple[str, ...] | list[str]) -> Column:
    hit = F.lit(False)
    for text in cidrs:
        net = ipaddress.ip_network(text, strict=False)
        if net.version == 6:
            lo, hi = f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"
            hit = hit | ip_hex.between(F.lit(lo), F.lit(hi))
    return hit


def is_internal(ip: Column, extra: tuple[str, ...] | list[str] = (), number: Column | None = None) -> Column:
    """True/False for a valid address, NULL when absent or not an address.

    `number` is the IPv4 value where a column already holds it; every range compares it again.
    """
    cidrs = [*INTERNAL_CIDRS, *extra]
    number = ipv4_to_long(ip) if number is None else number
    v4 = F.when(number.isNotNull(), in_cidrs(number, cidrs))
    if any(":" in c for c in extra):
        v6 = F.when(is_ipv6(ip), in_v6_cidrs(ipv6_to_hex(ip), cidrs))
    else:
        v6 = F.when(is_ipv6(ip), F.lit(False))
    return F.coalesce(v4, v6)
