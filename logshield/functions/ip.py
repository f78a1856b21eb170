"""IP addresses as columns: strict parsing, 16-byte keys, CIDR ranges. All native expressions.

A key is 32 hex digits (IPv4 as its v4-mapped IPv6 form), which order like the addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
_H = "[0-9a-fA-F]{1,4}"
_FORMS = (
    f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:", f"(?:{_H}:){{1,6}}:{_H}", *(f"(?:{_H}:){{1,{6 - k}}}(?::{_H}){{1,{k + 1}}}" for k in range(1, 6)), f":(?:(?::{_H}){{1,7}}|:)",
    f"(?:{_H}:){{6}}{V4[1:-1]}", f"::(?:{_H}:){{0,5}}{V4[1:-1]}", *(f"(?:{_H}:){{{k}}}:(?:{_H}:){{0,{5 - k}}}{V4[1:-1]}" for k in range(1, 6)),
)
#: Either family: every way to write an IPv6 address, with or without a dotted tail.
ANY = f"^(?:{V4[1:-1]}|{'|'.join(_FORMS)})$"
#: A network: a base of either family, aligned or not, and a prefix length.
CIDR = f"^(?:{V4[1:-1]}/(?:[12]?[0-9]|3[0-2])|(?:{'|'.join(_FORMS)})/(?:[1-9]?[0-9]|1[01][0-9]|12[0-8]))$"
#: Private addresses: 127/8, 10/8, 172.16/12, 192.168/16, 100.64/10, 169.254/16, fc00::/7, fe80::/10 and ::1.
_WIDE, _NARROW = rf"\.{_OCTET}\.{_OCTET}\.{_OCTET}$", rf"\.{_OCTET}\.{_OCTET}$"
PRIVATE = (
    rf"^(?:(?:127|10){_WIDE}|(?:172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|169\.254){_NARROW}"
    r"|[fF](?:[cCdD][0-9a-fA-F]{2}|[eE][89abAB][0-9a-fA-F]):|(?:::|(?:0{1,4}:){1,7}:?)(?:0{1,4}:)*0{0,3}1$)"
)
_MAPPED = "00000000000000000000ffff"


def ip_v4(ip: Column) -> Column:
    """The address as a number; null unless it is a dotted quad without leading zeros."""
    part = F.split(ip, "\\.")
    number = sum((F.element_at(part, i).cast("long") * (1 << (32 - 8 * i)) for i in range(2, 5)), F.element_at(part, 1).cast("long") * (1 << 24))
    return F.when(ip.rlike(V4), number)


def v4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def ip_key(ip: Column) -> Column:
    """32 hex digits, null if the text is no address. No zone ids, no white space."""
    low = F.lower(ip)
    tail = F.regexp_extract(low, r":([0-9.]+)$", 1)
    v4 = ip_v4(F.when(tail.contains("."), tail))
    hexed = F.when(tail.contains("."), F.concat(F.regexp_extract(low, r"^(.*:)[0-9.]+$", 1), F.lower(F.hex(F.shiftright(v4, 16))), F.lit(":"), F.lower(F.hex(v4.bitwiseAND(65535))))).otherwise(low)
    halves = F.split(hexed, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    left, right = groups(0), groups(1)
    n = F.size(left) + F.size(right)
    shape = hexed.rlike("^[0-9a-f:]+$") & ~hexed.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}") & (F.size(halves) <= 2)
    fits = F.when(F.size(halves) == 2, n <= 7).otherwise(n == 8)
    pad = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    six = F.concat(pad(left), F.repeat(F.lit("0000"), F.greatest(8 - n, F.lit(0))), pad(right))
    six = F.when(ip.rlike(ANY), six)
    return F.when(ip.rlike(V4), F.concat(F.lit(_MAPPED), _hex(ip_v4(ip), 8))).when(ip.contains(":") & shape & fits, six)


def is_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(ANY), F.lit(False))


def ip_text(key: Column) -> Column:
    """A key as text: a dotted quad if v4-mapped, else eight groups, not compressed."""
    number = F.conv(F.substring(key, 25, 8), 16, 10).cast("long")
    groups = F.concat_ws(":", *(F.regexp_replace(F.substring(key, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)))
    return F.when(F.substring(key, 1, 24) == _MAPPED, v4_text(number)).otherwise(groups)


def is_private(ip: Column) -> Column:
    """Loopback, private, shared and link-local addresses; v4-mapped texts are not among them. One
    pattern over the text, so that nothing is parsed for it."""
    return F.coalesce(ip.rlike(PRIVATE), F.lit(False))


def is_cidr(text: Column) -> Column:
    return F.coalesce(text.rlike(CIDR), F.lit(False))


def cidr_bounds(text: Column) -> Column:
    """struct(lo, hi, family) of keys, for texts of the form CIDR."""
    part = F.split(text, "/")
    base, bits = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    key, v4 = ip_key(base), ip_v4(base)
    n = F.when(bits.rlike("^[0-9]{1,3}$"), bits.cast("int"))
    host = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(32 - n, F.lit(0))) - 1
    lo4 = v4.bitwiseAND(F.bitwise_not(host))
    full, cut = F.floor(n / 4).cast("int"), n % 4
    digit = F.conv(F.substring(key, full + 1, F.lit(1)), 16, 10).cast("int")
    low = F.when(cut > 0, F.lower(F.hex(digit.bitwiseAND(F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), cut + 1)))))
    high = F.when(cut > 0, F.lower(F.hex(digit.bitwiseOR(F.element_at(F.array(*map(F.lit, (15, 7, 3, 1))), cut + 1)))))
    six = lambda mid, fill: F.rpad(F.concat(F.substring(key, F.lit(1), full), F.coalesce(mid, F.lit(""))), 32, fill)
    return F.when(v4.isNotNull(), F.struct(F.concat(F.lit(_MAPPED), _hex(lo4, 8)).alias("lo"), F.concat(F.lit(_MAPPED), _hex(lo4 + host, 8)).alias("hi"), F.lit(4).alias("family"))).otherwise(
        F.struct(six(low, "0").alias("lo"), six(high, "f").alias("hi"), F.lit(6).alias("family"))
    )


def range_cidrs(lo: Column, hi: Column) -> Column:
    """array<struct<start, prefix>>: the least aligned cover of an IPv4 range; empty if lo > hi."""
    block = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    up = lambda k: F.ceil(lo / block(k)).cast("long") * block(k)
    down = lambda k: F.floor((hi + 1) / block(k)).cast("long") * block(k)
    ks = F.sequence(F.lit(0), F.lit(32))
    first = F.filter(ks, lambda k: (up(k) < down(k)) & ((F.call_function("shiftright", up(k), k) % 2 == 1) | (k == 32)))
    last = F.filter(ks, lambda k: (k < 32) & (F.call_function("shiftright", down(k), k) % 2 == 1) & (up(k) < down(k)) & (up(k + 1) < down(k)))
    made = F.concat(
        F.transform(first, lambda k: F.struct(up(k).alias("start"), (32 - k).alias("prefix"))),
        F.transform(last, lambda k: F.struct((down(k) - block(k)).alias("start"), (32 - k).alias("prefix"))),
    )
    return F.array_sort(made)


def target_kind(target: Column) -> Column:
    return F.when(is_ip(target), "IP").when(target.contains("/"), "CIDR").otherwise("Unknown")
