"""Check digits and entropy of strings, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d5(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon."""
    x, y = a % 5, b % 5
    if a < 5:
        return (x + y) % 5 if b < 5 else (x + y) % 5 + 5
    return (x - y) % 5 + 5 if b < 5 else (x - y) % 5


#: the scheme's digit permutation, applied once per place
_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _permuted(place: int, digit: int) -> int:
    for _ in range(place % 8):
        digit = _STEP[digit]
    return digit


PRODUCTS = [_d5(a, b) for a in range(10) for b in range(10)]
PERMUTED = [_permuted(p, d) for p in range(8) for d in range(10)]


def verhoeff(digits: Column) -> Column:
    """Whether a string of digits ends in its right check digit; false for anything else."""
    products, permuted = (F.array(*map(F.lit, t)) for t in (PRODUCTS, PERMUTED))
    back = F.split(F.reverse(digits), "")
    digit = lambda i: F.get(back, i).cast("int")
    check = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda c, i: F.get(products, c * 10 + F.get(permuted, (i % 8) * 10 + digit(i))))
    return F.when(F.coalesce(digits.rlike(r"^[0-9]+$"), F.lit(False)), check == 0).otherwise(False)


def luhn(digits: Column) -> Column:
    """Whether the digits of a string, separators aside, pass the card check."""
    plain = F.regexp_replace(digits, "[ -]", "")
    return F.when(F.coalesce(plain.rlike(r"^[0-9]{2,}$"), F.lit(False)), F.call_function("luhn_check", plain)).otherwise(False)


def entropy(text: Column) -> Column:
    """Bits per character; 0 of the empty string."""
    # sort_array, as the order of array_sort is a lambda, asked for every pair
    part = lambda t: F.transform(F.sort_array(F.array_distinct(F.split(t["text"], ""))), lambda c: F.try_divide(t["n"] - F.length(F.replace(t["text"], c, F.lit(""))), t["n"]))
    bits = lambda t: F.aggregate(part(t), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    # the text may be an expression, and every sign asks for it
    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.length(text).alias("n"))), lambda t: F.when(t["n"] > 0, bits(t)).otherwise(0.0)), F.lit(0))


def charset_size(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(F.array_distinct(F.split(text, "")))).otherwise(0)


def normalised_entropy(text: Column) -> Column:
    """Entropy against the most that a string of this length and character set could have."""
    most = F.log2(F.least(F.length(text), charset_size(text)).cast("double"))
    return F.when((F.length(text) < 2) | (most <= 0), 0.0).otherwise(F.least(F.try_divide(entropy(text), most), F.lit(1.0)))


def confidence_modifier(h: Column) -> Column:
    return F.when(h >= 4.5, 0.10).when(h >= 3.5, 0.05).when(h >= 2.5, 0.0).when(h >= 1.5, -0.05).otherwise(-0.10)


def character_classes(text: Column) -> Column:
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))


def mask_preview(value: Column) -> Column:
    """Short values all stars, longer ones with two or four signs left at either end, at most twelve stars."""
    n = F.length(value)

    def ends(k: int) -> Column:
        return F.concat(F.substring(value, 1, k), F.expr("repeat('*', 0)"), F.lpad(F.lit(""), F.least(F.lit(12), n - 2 * k), F.lit("*")), F.right(value, F.lit(k)))

    return F.when(n <= 8, F.lpad(F.lit(""), n, F.lit("*"))).when(n <= 12, ends(2)).otherwise(ends(4))


def fingerprint(*parts: Column) -> Column:
    """Sixteen hex digits of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)
