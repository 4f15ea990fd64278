"""Scalar functions on the cases that decide them, and by property."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelode.functions import fixed, text as tx, validate as va
from tracelode.operators import extract


def run(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(fn(F.col("v")).alias("r"), "i").orderBy("i").collect()]


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_luhn(spark):
    rng = random.Random(0)
    nums = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(11, 21))) for _ in range(400)] + ["4111 1111-1111 1111", "", None, "0" * 12, "0" * 13, "0" * 19, "0" * 20, "abc"]
    assert run(spark, nums, va.luhn_ok) == [luhn(n or "") for n in nums]
    stems = [n for n in nums[:300] if 12 <= len(n) <= 18]
    digits = run(spark, stems, va.luhn_check_digit)
    assert all(luhn(s + d) for s, d in zip(stems, digits, strict=True))


@pytest.mark.parametrize(
    ("number", "want"),
    [("378282246310005", "Amex"), ("6011000000000004", "Discover"), ("30569309025904", "Diners Club"), ("4147200000000000", "Visa/MC - Chase (Signature Visa)"), ("4000000000000002", "Visa (Generic)"), ("5105105105105100", "Mastercard (Generic)"), ("9", "Unknown Issuer"), ("", "Unknown Issuer"), ("3000000000000000", "Diners Club")],
)
def test_issuer(spark, number, want):
    assert run(spark, [number], va.issuer) == [want]


def test_ip_classes(spark):
    cases = {"10.0.0.1": "Private", "172.31.0.1:80": "Private", "172.32.0.1": "Public", "192.168.1.1": "Private", "127.0.0.1": "Loopback", "169.254.1.1": "Link-Local", "169.1.1.1": "Public", "224.0.0.1": "Multicast", "240.0.0.1": "Reserved", "0.1.2.3": "Reserved/Bogus", "8.8.8.8": "Public", "256.1.1.1": "Invalid", "1.2.3": "Invalid", "2001:db8::1": "Invalid", "a.b.c.d": "Invalid"}
    assert run(spark, list(cases), va.classify_ip) == list(cases.values())
    assert run(spark, ["8.8.8.8", "192.0.2.5", "10.1.1.1", "x", "::1", "198.20.0.1"], va.non_global_ip) == [False, True, True, True, True, False]
    assert run(spark, ["1.2.3.4", "1.2.3.256", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "a::b::c", "", "g::1"], va.valid_ip) == [True, False, True, True, True, False, True, False, False, False]


def test_other_validators(spark):
    assert run(spark, ["a@b.c", "a@bc", "@b.co", "ab.co", "", None], va.valid_email) == [True, False, False, False, False, False]
    assert run(spark, ["+1 (212) 555-0123", "2125550123", "12125550123", "5555550123", "1125550123", "212555012", None], va.valid_phone) == [True, True, True, False, False, False, False]
    assert run(spark, ["123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000", "12345678"], va.valid_ssn) == [True, False, False, False, False, False, False]
    assert run(spark, ["021000021", "021000022", "02100002", None], va.routing_checksum) == [True, False, False, False]
    rows = [("IPv4", "10.9.9.9", True), ("IPv4", "8.8.8.8", False), ("IPv4_with_Port", "10.9.9.9:80", False), ("Phone", "1234", True), ("X", "undefined", True), ("URLs", "http://example.com", False)]
    df = spark.createDataFrame(rows, "c string, v string, want boolean")
    assert df.where(va.irrelevant("c", "v") != F.col("want")).count() == 0
    assert df.where(va.irrelevant("c", "v", strict=True)).where("c = 'URLs'").count() == 1


def test_text_functions(spark):
    cases = {"a [.] b": "a.b", "a(DOT)b": "a.b", "x [at] y": "x@y", "HXXPS://a": "httpS://a", "1 . 2 . 3 . 4": "1.2.3.4", "plain": "plain"}
    assert run(spark, list(cases), tx.deobfuscate) == list(cases.values())
    assert run(spark, [0.0, 1023.0, 1024.0, 1536.0, float(5 << 30)], tx.format_size, "double") == ["0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "5.00 GB"]
    assert run(spark, [0, 25, 26, 701, 702], tx.letter_suffix, "long") == ["A", "Z", "AA", "ZZ", "AAA"]
    assert len(set(run(spark, list(range(3000)), tx.letter_suffix, "long"))) == 3000
    assert run(spark, ["a/b<c>.txt", "", None, "x/", "..", "n" * 300 + ".txt"], tx.sanitize_filename) == ["b_c_.txt", "unnamed_file", "unnamed_file", "sanitized_file", "sanitized_file", "n" * 250 + ".txt"]
    assert run(spark, ["ok", "", "a/../b", "x..y", "n" * 101], lambda c: tx.project_name_check(c)["ok"]) == [True, False, False, False, False]
    assert run(spark, ["8.8.8.8", "drop table", "a;b", "updated", "", "x" * 1001], lambda c: tx.search_term_check(c)["ok"]) == [True, False, False, True, False, False]
    assert run(spark, ["<a href='x'>&\"", None], tx.escape_html) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", ""]
    assert run(spark, ["File: a.txt | Position: 5 | Type: Public", "Position: 3", None], lambda c: tx.parse_context(c, "File")) == ["a.txt", None, None]
    assert run(spark, ["IPv4", "Email_Addresses", "URLs", "X_Hash", "Phone_Numbers", "Other"], tx.badge_class) == ["category-ip", "category-email", "category-url", "category-hash", "category-financial", "category-default"]
    assert run(spark, ["http://A.com:80/x", "ftp://u@h.org?q", "none"], tx.domain_of) == ["a.com", "h.org", ""]
    assert run(spark, ["short/name.txt"], tx.short_name) == ["name.txt"] and len(run(spark, ["d/" + "n" * 300 + ".txt"], tx.short_name)[0]) == 20 + 1 + 8 + 4


def test_patterns_against_re(spark):
    """Every pattern finds the values and places that Python's engine finds, on data and on made-up lines."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(6)
    bits = ["8.8.8.8", ":443", " ", "a@b.com", "..", "http://x.org/p?q", "4111111111111111", "\n", "2024-01-02T03:04:05Z", "é", "-", "1300000000", "00:1b:44:11:3a:b7", "(212) 555-0123", "+44 7911 123456", "fe80::1", "gb82west12345698765432", "0x" + "aB" * 20, "1" + "A1" * 14, "550e8400-e29b-41d4-a716-446655440000", "123-45-6789", "User-Agent: Mozilla/5.0 (X11; Linux x86)", "."]
    texts = docs + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r.i, r.category, r.value, r.position) for r in extract.matches(df).collect()}
    want = {(i, c, m.group(0).strip(), m.start()) for i, t in enumerate(texts) for c, p in fixed.PATTERNS.items() for m in re.compile(p, re.I | re.M).finditer(t) if m.group(0).strip()}
    assert got == want
