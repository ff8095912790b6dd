"""Kinds of IPv4 and IPv6 addresses, by prefixes over numbers of 32 and of twice 64 bits."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks by kind, the first kind that matches wins; at the end private blocks, without what is taken out of them.
METADATA = ("169.254.169.254/32", "fd00:ec2::254/128")
BLOCKS = {
    "metadata": METADATA,
    "unspecified": ("0.0.0.0/32", "::/128"),
    "loopback": ("127.0.0.0/8", "::1/128"),
    "link_local": ("169.254.0.0/16", "fe80::/10"),
    "multicast": ("224.0.0.0/4", "ff00::/8"),
    "reserved": ("240.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"),
    "private": (
        "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
        "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7",
    ),
}
PUBLIC = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _let(value: Column, use) -> Column:
    """use(value) with the value reckoned once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for others, also for parts with leading zeros."""

    def number(parts: Column) -> Column:
        good = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
        return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))

    return _let(F.transform(F.split(ip, r"\."), lambda p: F.when(p.rlike(r"^(?:0|[1-9][0-9]{0,2})\z"), p.cast("long"))), number)


def groups(ip: Column) -> Column:
    """The eight groups of an IPv6 address as numbers, `::` and an IPv4 tail written out, a zone dropped; null for others."""

    def dotted(low: Column) -> Column:
        tail = lambda t: F.concat(F.regexp_extract(low, r"^(.*:)[0-9.]+\z", 1), F.lower(F.hex(F.shiftright(t, 16))), F.lit(":"), F.lower(F.hex(t.bitwiseAND(F.lit(65535)))))
        return F.when(F.contains(low, F.lit(".")), _let(ip_number(F.regexp_extract(low, r":([0-9.]+)\z", 1)), tail)).otherwise(low)

    def filled(halves: Column) -> Column:
        side = lambda i: F.when(F.get(halves, F.lit(i)) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, F.lit(i)), ":"))
        both = lambda s: F.when(F.size(s["a"]) + F.size(s["b"]) <= 7, F.concat(s["a"], F.array_repeat(F.lit("0"), 8 - F.size(s["a"]) - F.size(s["b"])), s["b"]))
        return F.when(F.size(halves) == 2, _let(F.struct(side(0).alias("a"), side(1).alias("b")), both)).when(F.size(halves) == 1, side(0))

    def numbers(every: Column) -> Column:
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        return F.when(good, F.transform(every, lambda g: F.conv(g, 16, 10).cast("long")))

    low = F.lower(F.regexp_replace(ip, r"%[^%]+\z", ""))
    return _let(_let(_let(low, dotted), lambda plain: filled(F.split(plain, "::"))), numbers)


def _word(numbers: Column, start: int) -> Column:
    return F.aggregate(F.slice(numbers, start, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(g))


def _narrow(number: Column, blocks: tuple[str, ...]) -> Column:
    nets = [n for b in blocks if (n := ipaddress.ip_network(b)).version == 4]
    return reduce(Column.__or__, [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets])


def _wide(high: Column, low: Column, blocks: tuple[str, ...]) -> Column:
    def inside(net) -> Column:
        base, bits = int(net.network_address), net.prefixlen
        top, rest = base >> 64, base & (1 << 64) - 1
        if bits <= 64:
            return F.shiftrightunsigned(high, 64 - bits) == F.lit(_signed(top >> 64 - bits)) if bits < 64 else high == F.lit(_signed(top))
        return (high == F.lit(_signed(top))) & (F.shiftrightunsigned(low, 128 - bits) == F.lit(_signed(rest >> 128 - bits)) if bits < 128 else (high == F.lit(_signed(top))) & (low == F.lit(_signed(rest))))

    return reduce(Column.__or__, [inside(n) for b in blocks if (n := ipaddress.ip_network(b)).version == 6])


def address_kind(ip: Column) -> Column:
    """Kind of an address, `public` outside the blocks, `invalid` for what is none. IPv4 in IPv6 is judged as IPv4."""

    def judged(narrow: bool, number: Column, high: Column, low: Column) -> Column:
        inside = (lambda b: _narrow(number, b)) if narrow else (lambda b: _wide(high, low, b))
        out = F.when(F.lit(False), F.lit(""))
        for kind, blocks in BLOCKS.items():
            out = out.when(inside(blocks) & ~inside(PUBLIC) if kind == "private" else inside(blocks), kind)
        return out.otherwise("public")

    def kind(a: Column) -> Column:
        mapped = (a["high"] == 0) & (F.shiftrightunsigned(a["low"], 32) == 0xFFFF)
        number = F.coalesce(a["number"], F.when(mapped, a["low"].bitwiseAND(F.lit(0xFFFFFFFF))))
        narrow = _let(number, lambda n: F.when(n.isNotNull(), judged(True, n, a["high"], a["low"])))
        return F.coalesce(narrow, F.when(a["high"].isNotNull(), judged(False, number, a["high"], a["low"])), F.lit("invalid"))

    words = lambda g: F.struct(ip_number(ip).alias("number"), _word(g, 1).alias("high"), _word(g, 5).alias("low"))
    return F.coalesce(_let(_let(groups(ip), words), kind), F.lit("invalid"))
