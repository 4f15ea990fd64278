"""Validation and classification of values, on columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), "[^0-9]", "")


def _luhn_sum(number: Column, doubled: int) -> Column:
    """The weighted sum of digits, from the right; every second digit is doubled, the first such at `doubled`."""
    back = F.reverse(number)
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice
    return F.when(F.length(number) > 0, F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add)).otherwise(0)


def luhn_ok(value: Column | str) -> Column:
    """Whether the digits number 13 to 19 and pass the checksum; false for null."""
    return F.coalesce(bound(digits(value), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0)), F.lit(False))


def luhn_check_digit(value: Column | str) -> Column:
    """The digit that makes the number pass."""
    return ((10 - _luhn_sum(digits(value), 0) % 10) % 10).cast("string")


def issuer(value: Column | str) -> Column:
    """A card's issuer by its first digits."""
    named = F.create_map(*(F.lit(x) for kv in fixed.BINS.items() for x in kv))

    def by_digits(d: Column) -> Column:
        bank = F.try_element_at(named, F.substring(d, 1, 6))
        return (
            F.when(d.startswith("3") & (F.length(d) == 15), "Amex")
            .when(d.startswith("6011"), "Discover")
            .when(F.substring(d, 1, 2).isin("30", "36", "38"), "Diners Club")
            .when(bank.isNotNull(), F.concat(F.lit("Visa/MC - "), bank))
            .when(d.startswith("4"), "Visa (Generic)")
            .when(d.startswith("5"), "Mastercard (Generic)")
            .otherwise("Unknown Issuer")
        )

    return bound(digits(value), by_digits)


def card(value: Column | str) -> Column:
    """struct(number, original, is_valid_luhn, issuer, length)."""
    d = digits(value)
    return F.struct(d.alias("number"), _col(value).alias("original"), luhn_ok(value).alias("is_valid_luhn"), issuer(value).alias("issuer"), F.length(d).alias("length"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used, and a small expression."""
    return F.get(F.transform(F.array(value), use), 0)


def octets(ip: Column | str) -> Column:
    """The four numbers of a dotted address, its port cut off; null if it isn't one."""
    whole = F.transform(F.split(F.split_part(_col(ip), F.lit(":"), F.lit(1)), r"\."), lambda p: F.when(p.rlike(r"(?U)^\s*[+-]?\d+\s*$"), F.trim(p).try_cast("int")))
    return bound(whole, lambda w: F.when((F.size(w) == 4) & F.forall(w, lambda n: n.isNotNull() & n.between(0, 255)), w))


def classify_ip(ip: Column | str) -> Column:
    """Private, Loopback, Link-Local, Multicast, Reserved, Reserved/Bogus, Public, or Invalid (as is every address with colons first)."""
    def kind(o: Column) -> Column:
        a, b = F.get(o, 0), F.get(o, 1)
        return (
            F.when(o.isNull(), "Invalid")
            .when(a == 0, "Reserved/Bogus")
            .when(a == 10, "Private")
            .when(a == 127, "Loopback")
            .when((a == 169) & (b == 254), "Link-Local")
            .when((a == 172) & b.between(16, 31), "Private")
            .when((a == 192) & (b == 168), "Private")
            .when(a.between(224, 239), "Multicast")
            .when(a >= 240, "Reserved")
            .otherwise("Public")
        )

    return bound(octets(ip), kind)


def ip_number(ip: Column | str) -> Column:
    """A dotted address as one number; null if it isn't one."""
    return F.aggregate(octets(ip), F.lit(0).cast("long"), lambda acc, n: acc * 256 + n)


#: Networks that aren't global, of the public registries as of 2024 (those of Python 3.13's ipaddress), and addresses within them that are.
NON_GLOBAL = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
GLOBAL_WITHIN = ["192.0.0.9/32", "192.0.0.10/32"]


def _range(net: str) -> tuple[int, int]:
    """The first and last address of a network, as numbers."""
    base, bits = net.split("/")
    first = reduce(lambda acc, x: acc * 256 + int(x), base.split("."), 0)
    return first, first + (1 << (32 - int(bits))) - 1


def non_global_ip(ip: Column | str) -> Column:
    """Whether an address is private, loopback, reserved or multicast; true for what isn't an address as it is written (no leading zeros)."""
    among = lambda n, nets: reduce(lambda a, b: a | b, (n.between(*_range(net)) for net in nets))
    number = F.when(~F.contains(_col(ip), F.lit(":")) & valid_ip(ip), ip_number(ip))
    return F.coalesce(bound(number, lambda n: among(n, NON_GLOBAL) & ~among(n, GLOBAL_WITHIN)), F.lit(True))


def valid_ip(ip: Column | str) -> Column:
    """Whether a value is an IPv4 or IPv6 address as written in RFC 4291, with no more than one `::`."""
    ip = _col(ip)
    v4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    shape = ip.rlike(rf"(?i)^[0-9a-f:]*(?::{v4})?$") & F.contains(ip, F.lit(":")) & ~ip.rlike(r":::|[0-9a-f]{5}|^:[^:]|[^:]:$|::.*::")
    groups = F.size(F.filter(F.split(ip, ":"), lambda g: g != "")) + F.when(F.contains(ip, F.lit(".")), 1).otherwise(0)
    v6 = shape & F.when(F.contains(ip, F.lit("::")), groups <= 7).otherwise(groups == 8)
    return F.coalesce(ip.rlike(f"^{v4}$") | v6, F.lit(False))


def valid_email(email: Column | str) -> Column:
    e = _col(email)
    return F.coalesce((F.length(e) >= 5) & e.rlike(r"(?U)^[\p{L}\p{N}]") & F.contains(e, F.lit("@")) & F.contains(F.split_part(e, F.lit("@"), F.lit(2)), F.lit(".")), F.lit(False))


def valid_area_code(code: Column | str) -> Column:
    c = _col(code)
    return F.coalesce(c.rlike("^[2-9][0-9]{2}$") & ~c.isin(*fixed.BAD_AREA_CODES), F.lit(False))


def valid_phone(phone: Column | str) -> Column:
    bare = F.regexp_replace(_col(phone), "[^0-9+]", "")
    own = F.when(bare.startswith("+1"), F.substring(bare, F.lit(3), F.length(bare))).when(bare.startswith("1") & F.length(bare).isin(10, 11), F.substring(bare, F.lit(2), F.length(bare))).otherwise(bare)
    return F.coalesce(own.rlike("^[2-9][0-9]{9}$") & valid_area_code(F.substring(own, 1, 3)), F.lit(False))


def valid_ssn(ssn: Column | str) -> Column:
    return F.coalesce(digits(ssn).rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$"), F.lit(False))


def routing_checksum(number: Column | str) -> Column:
    """Whether nine digits pass the 3-7-1 checksum."""
    n = _col(number)
    d = [F.substring(n, k + 1, 1).cast("int") for k in range(9)]
    total = sum((d[k] * (3, 7, 1)[k % 3] for k in range(1, 9)), d[0] * 3)
    return F.coalesce(F.when(n.rlike("^[0-9]{9}$"), total % 10 == 0), F.lit(False))


def irrelevant(category: Column | str, value: Column | str, strict: bool = False) -> Column:
    """Whether a value is left out: denied IPv4 addresses, short values (but for IPv4), words for nothing.

    `strict` also drops URLs and e-mail addresses of the denied domains."""
    c, v = _col(category), _col(value)
    out = ((c == "IPv4") & v.rlike("|".join(fixed.IRRELEVANT_IPS))) | ((c != "IPv4") & (F.length(v) < 5)) | F.lower(v).isin(*fixed.NULL_WORDS)
    if strict:
        out = out | ((c == "URLs") & v.rlike("(?i)" + "|".join(fixed.IRRELEVANT_DOMAINS))) | ((c == "Email_Addresses") & v.rlike("(?i)" + "|".join(fixed.FALSE_EMAILS)))
    return out
