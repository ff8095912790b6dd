"""Kinds of addresses against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from tarnbeck.operators.addresses import BLOCKS, METADATA, PUBLIC, address_kind


def expected(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return "invalid"
    if ip.version == 6 and ip.ipv4_mapped is not None:
        ip = ip.ipv4_mapped
    if str(ip).split("%")[0] in {m.split("/")[0] for m in METADATA}:
        return "metadata"
    kinds = {"unspecified": ip.is_unspecified, "loopback": ip.is_loopback, "link_local": ip.is_link_local, "multicast": ip.is_multicast, "reserved": ip.is_reserved, "private": ip.is_private}
    return next((k for k, on in kinds.items() if on), "public")


def addresses(seed=1):
    rnd = random.Random(seed)
    nets = [ipaddress.ip_network(b) for blocks in (*BLOCKS.values(), PUBLIC) for b in blocks]
    for _ in range(20000):  # at, in and beside every block
        net = rnd.choice(nets)
        size, most = net.num_addresses, (1 << net.max_prefixlen) - 1
        n = int(net.network_address) + rnd.choice((0, -1, 1, size - 1, size, rnd.randrange(size)))
        ip = (ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address)(min(max(n, 0), most))
        yield rnd.choice((str(ip), ip.exploded, str(ip).upper(), f"::ffff:{ip}" if ip.version == 4 else str(ip)))
    for _ in range(6000):
        yield str(ipaddress.IPv6Address(rnd.getrandbits(128)))
        yield str(ipaddress.IPv4Address(rnd.getrandbits(32)))
    yield from ["2001:10::1", "2002:a00:1::1", "fe80::1%eth0", "::ffff:0:7f00:1", "::ffff:7f00:1", "64:ff9b::10.0.0.1", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", ":::", "::", ":", "", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", " ::1", "::1.2.3.400", "1.2.3.4::", "::1%", "localhost", "::ffff:1.2.3.4%1"]


def test_equal_to_the_standard_library(spark):
    texts = list(dict.fromkeys(addresses()))
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", address_kind(F.col("ip")).alias("kind")).collect()
    wrong = [(r.ip, r.kind, expected(r.ip)) for r in rows if r.kind != expected(r.ip)]
    assert len(rows) > 10_000 and wrong == []


def test_null(spark):
    assert spark.createDataFrame([(None,)], "ip string").select(address_kind(F.col("ip")).alias("k")).first().k == "invalid"
