"""Addresses: whether one is private, reserved or special, from its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import fixed as X
from wardline.operators.spans import let

_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_BYTE}(?:\.{_BYTE}){{3}}"


def _number(quad: Column) -> Column:
    """A dotted quad as a whole number."""
    parts = F.split(quad, r"\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))


def _private_number(n: Column) -> Column:
    out = F.lit(False)
    for base, bits in X.PRIVATE_V4:
        low = 0
        for part in base.split("."):
            low = low << 8 | int(part)
        out = out | n.between(low, low + (1 << (32 - bits)) - 1)
    return out


def ipv6_hex(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address (zone stripped, a trailing dotted quad read), null if it is none."""
    bare = F.lower(F.regexp_replace(F.trim(text), "%.*$", ""))
    quad = F.regexp_extract(bare, rf"(?<=:)({_QUAD})$", 1)
    words = F.lpad(F.hex(_number(quad)), 8, "0")
    whole = F.when(quad != "", F.concat(F.left(bare, F.length(bare) - F.length(quad)), F.lower(F.left(words, F.lit(4))), F.lit(":"), F.lower(F.right(words, F.lit(4))))).otherwise(bare)

    def expanded(t: Column) -> Column:
        halves = F.split(t, "::", -1)
        groups = lambda h: F.filter(F.split(h, ":", -1), lambda g: g != "")
        head, tail = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        gap = 8 - F.size(head) - F.size(tail)
        short = F.size(halves) == 2
        fits = (F.size(halves) <= 2) & F.when(short, gap >= 0).otherwise(gap == 0) & t.rlike("^[0-9a-f:]+$") & ~t.rlike("(?<!:):$|^:(?!:)|:::")
        every = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), tail)
        return F.when(fits & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return let(whole, expanded)


def _private_hex(h: Column) -> Column:
    last = F.conv(F.right(h, F.lit(8)), 16, 10).cast("long")
    out = F.lit(False)
    for first, bits in X.PRIVATE_V6:
        digits = -(-bits // 4)
        low = int(first.ljust(digits, "0")[:digits], 16) >> (4 * digits - bits) << (4 * digits - bits)
        high = low + (1 << (4 * digits - bits)) - 1
        out = out | F.left(h, F.lit(digits)).between(f"{low:0{digits}x}", f"{high:0{digits}x}")
    mapped, compatible, nat = (F.startswith(h, F.lit(p)) for p in ("0" * 20 + "ffff", "0" * 24, "0064ff9b"))
    # addresses that hold an IPv4 address are judged by it; :: and ::1 are reserved
    inner = (compatible & (last < 65536)) | _private_number(last)
    six_to_four = _private_number(F.conv(F.substr(h, F.lit(5), F.lit(8)), 16, 10).cast("long"))
    return F.when(mapped | compatible | nat, inner).when(F.startswith(h, F.lit("2002")), six_to_four).otherwise(out)


def is_private(address: Column) -> Column:
    """Whether an address must not be called: private, reserved, special, or no address at all."""
    six = ipv6_hex(address)
    return F.when(address.rlike(f"^{_QUAD}$"), _private_number(_number(address))).otherwise(F.coalesce(let(six, lambda h: F.when(h.isNotNull(), _private_hex(h))), F.lit(True)))
