"""IP networks and ports as columns.

A network is ``struct<ver:int, len:int, lo:string, hi:string>`` with 32-digit hex bounds, so
IPv4 and IPv6 compare the same way.  IPv4 text is read with JVM expressions; IPv6 text is
expanded with JVM expressions too, so no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

NET = "struct<ver:int,len:int,lo:string,hi:string>"

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V6_CHARS = r"^[0-9A-Fa-f:]{2,39}$"

# The port names understood in access lists.
NAMED_PORTS = {
    "www": 80, "http": 80, "https": 443, "telnet": 23, "ssh": 22, "domain": 53, "ftp": 21,
    "smtp": 25, "snmp": 161, "syslog": 514, "ntp": 123, "bgp": 179, "tacacs": 49,
}
PORT_MIN, PORT_MAX = 0, 65535


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def v4_long(address: Column) -> Column:
    """Dotted quad as a number; NULL for anything else."""

    def join(parts: Column) -> Column:
        nums = [parts[i].cast("bigint") for i in range(4)]
        return ((nums[0] * 256 + nums[1]) * 256 + nums[2]) * 256 + nums[3]

    return F.when(address.rlike(V4), let(F.split(address, r"\."), join))


def v4_text(value: Column) -> Column:
    return F.concat_ws(
        ".",
        *[F.shiftrightunsigned(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)],
    )


def prefix_length(cidr: Column, host_length: int) -> Column:
    """Length after the slash, the host length without one, NULL when out of range."""
    tail = F.regexp_extract(cidr, r"/(\d{1,3})$", 1)
    length = F.when(~cidr.contains("/"), F.lit(host_length)).otherwise(tail.try_cast("int"))
    return F.when((length >= 0) & (length <= host_length), length)


def _v6_hex(address: Column) -> Column:
    """32 hex digits of an IPv6 address without an embedded dotted quad; NULL when malformed."""
    halves = F.split(address, "::", -1)
    double = F.size(halves) == 2
    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))
    left, right = groups(halves[0]), F.when(double, groups(halves[1])).otherwise(F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    ok = (
        address.rlike(_V6_CHARS)
        & (F.size(halves) <= 2)
        & F.when(double, missing >= 1).otherwise(missing == 0)
        & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    )
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    return F.when(ok, F.lower(F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")))


def _clear_hex(digits: Column, length: Column, fill: str) -> Column:
    """Keep the first ``length`` bits of 32 hex digits and set the rest to 0 (or 1 for ``fill='f'``)."""
    whole = (length / 4).cast("int")
    rest = length % 4
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), F.lit(4) - rest).cast("int")
    low = nibble - nibble % step
    mixed = low if fill == "0" else low + step - 1
    cut = F.concat(F.substring(digits, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(mixed))).otherwise(""))
    return F.rpad(cut, 32, fill)


def _v4_net(cidr: Column, build: Callable[[Column, Column, Column], Column]) -> Column:
    """``build(first address, block size, prefix length)`` of an IPv4 network, else NULL."""
    length = prefix_length(cidr, 32)
    block = F.pow(F.lit(2), F.lit(32) - length).cast("bigint")
    parts = F.struct(v4_long(F.substring_index(cidr, "/", 1)).alias("a"), block.alias("b"), length.alias("n"))
    return let(
        parts, lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), build(p["a"] - p["a"] % p["b"], p["b"], p["n"]))
    )


def network(cidr: Column) -> Column:
    """``NET`` of CIDR or host text with host bits cleared; NULL when it is not a network."""
    hex32 = lambda n: F.lpad(F.lower(F.hex(n)), 32, "0")
    four = _v4_net(
        cidr,
        lambda lo, block, n: F.struct(
            F.lit(4).alias("ver"), n.alias("len"), hex32(lo).alias("lo"), hex32(lo + block - 1).alias("hi")
        ),
    )
    len6 = prefix_length(cidr, 128)
    six = let(
        _v6_hex(F.substring_index(cidr, "/", 1)),
        lambda d: F.when(
            d.isNotNull() & len6.isNotNull(),
            F.struct(F.lit(6).alias("ver"), len6.alias("len"), _clear_hex(d, len6, "0").alias("lo"), _clear_hex(d, len6, "f").alias("hi")),
        ),
    )
    return F.when(cidr.contains(":"), six).otherwise(four)


def _v6_text(digits: Column) -> Column:
    """Compressed IPv6 text: the longest run of two or more zero groups becomes ``::``."""

    def compress(plain: Column) -> Column:
        padded = F.concat(F.lit(":"), plain, F.lit(":"))
        out = plain
        for run in range(2, 9):
            zeros = ":".join(["0"] * run)
            cut = F.regexp_replace(padded, f"^(.*?):{zeros}:(.*)$", "$1::$2")
            text = F.regexp_replace(F.regexp_replace(cut, "^:(?!:)", ""), "(?<!:):$", "")
            out = F.when(padded.contains(f":{zeros}:"), text).otherwise(out)
        return out

    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.lower(F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", "")),
    )
    return let(F.array_join(groups, ":"), compress)


def cidr_text(cidr: Column) -> Column:
    """Canonical CIDR text, NULL when the input is not a network."""
    six = let(network(cidr), lambda n: F.when(n.isNotNull(), F.concat(_v6_text(n["lo"]), F.lit("/"), n["len"])))
    four = _v4_net(cidr, lambda lo, _, n: F.concat(v4_text(lo), F.lit("/"), n))
    return F.when(cidr.contains(":"), six).otherwise(four)


def wildcard_to_cidr(address: Column, wildcard: Column) -> Column:
    """CIDR of an address and an inverse mask; NULL unless the mask is contiguous."""

    def build(p: Column) -> Column:
        size = p["w"] + 1
        ok = p["a"].isNotNull() & (p["w"].bitwiseAND(size) == 0)
        return F.when(ok, F.concat(v4_text(p["a"] - p["a"] % size), F.lit("/"), F.lit(32) - F.bit_count(p["w"])))

    return let(F.struct(v4_long(address).alias("a"), v4_long(wildcard).alias("w")), build)


def port_number(token: Column) -> Column:
    """Number or one of the named ports; NULL for an unknown name or a number out of range."""
    digits = token.rlike(r"^\d+$")
    value = token.try_cast("bigint")
    named = F.create_map(*[F.lit(x) for kv in NAMED_PORTS.items() for x in kv])
    return F.when(digits, F.when(value.between(PORT_MIN, PORT_MAX), value.cast("int"))).otherwise(
        F.try_element_at(named, F.lower(token))
    )


def port_interval(op: Column, low: Column, high: Column) -> Column:
    """``struct<lo,hi>`` of a parsed port clause, clamped at both ends.

    ``lt 0`` and ``gt 65535`` clamp to a single port, and ``neq`` is stored as the named port:
    both are reproduced because downstream coverage relies on the same intervals.
    """
    lo = F.when(op == "any", F.lit(PORT_MIN)).when(op == "lt", F.lit(PORT_MIN)).when(
        op == "gt", F.least(F.lit(PORT_MAX), low + 1)
    ).otherwise(low)
    hi = (
        F.when(op == "any", F.lit(PORT_MAX))
        .when(op == "lt", F.greatest(F.lit(PORT_MIN), low - 1))
        .when(op == "gt", F.lit(PORT_MAX))
        .when(op == "range", high)
        .otherwise(low)
    )
    return F.when((op == "any") | (lo.isNotNull() & (lo <= hi)), F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))


def neq_intervals(port: Column) -> Column:
    """The two ranges around one excluded port, for callers that want ``neq`` by its meaning."""
    below = F.when(port > PORT_MIN, F.struct(F.lit(PORT_MIN).alias("lo"), (port - 1).cast("int").alias("hi")))
    above = F.when(port < PORT_MAX, F.struct((port + 1).cast("int").alias("lo"), F.lit(PORT_MAX).alias("hi")))
    return F.array_compact(F.array(below, above))
