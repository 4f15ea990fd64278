"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def universal_newlines(text: Column | str) -> Column:
    """Line ends as a text-mode read gives them."""
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def _where(text: Column, test: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """`then(text)` where the text passes a test, cheaper than `then` is; the text is computed once."""
    return F.get(F.transform(F.array(text), lambda t: F.when(test(t), then(t)).otherwise(t)), 0)


def deobfuscate(text: Column | str) -> Column:
    """Undoes the usual ways of hiding addresses: [.] (dot) [dot], [@] (at) [at], hxxp, digits and dots spaced out."""
    marks = [(r"\[\.\]", "."), (r"\(dot\)", "."), (r"\[dot\]", "."), (r"\[@\]", "@"), (r"\(at\)", "@"), (r"\[at\]", "@")]
    any_mark = "(?i)" + "|".join(m[0] for m in marks)
    # most texts hold none of these: one pass finds out
    out = _where(_col(text), lambda t: (F.contains(t, F.lit("[")) | F.contains(t, F.lit("("))) & t.rlike(any_mark), lambda t: reduce(lambda c, m: F.regexp_replace(c, rf"(?iU)\s?{m[0]}\s?", m[1]), marks, t))
    out = _where(out, lambda t: t.rlike("(?i)hxxp"), lambda t: F.regexp_replace(t, "(?iU)hxxp", "http"))
    return _where(out, lambda t: t.rlike(r"(?U)\d\s+\.\s"), lambda t: F.regexp_replace(t, r"(?U)(\d+)\s+\.\s+(\d+)\s+\.\s+(\d+)\s+\.\s+(\d+)", "$1.$2.$3.$4"))


def render_context(file: Column | str, position: Column | str, ip_class: Column | str, issuer: Column | str) -> Column:
    """`File: f | Position: p[ | Type: t][ | Issuer: i | Luhn: Valid]`; nulls leave their part out."""
    part = lambda key, c: F.concat(F.lit(f"{key}: "), _col(c).cast("string"))
    return F.concat_ws(" | ", part("File", file), part("Position", position), part("Type", ip_class), F.concat(part("Issuer", issuer), F.lit(" | Luhn: Valid")))


def parse_context(context: Column | str, key: str) -> Column:
    """What stands between `key:` and the next bar, trimmed; null without the key."""
    after = F.regexp_extract(_col(context), rf"(?s)\Q{key}:\E(.*?)(?:\||\Q{key}:\E|\z)", 1)
    return F.when(F.contains(_col(context), F.lit(f"{key}:")), F.trim(after))


def window(text: Column | str, position: Column | str, length: Column | str, around: int = 100) -> Column:
    """The text from `around` characters before a match to as many after it."""
    start = F.greatest(_col(position) - around, F.lit(0))
    return F.substring(_col(text), start + 1, _col(position) + _col(length) + around - start)


def one_line(text: Column | str) -> Column:
    """Line feeds as spaces, no carriage returns, no white space at either end."""
    bare = F.regexp_replace(F.replace(F.replace(_col(text), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), r"(?U)^\s+", "")
    return F.regexp_replace(bare, r"(?U)\s+\z", "")


def display_category(category: Column | str) -> Column:
    """Underscores as spaces, each word capitalised."""
    return F.initcap(F.replace(_col(category), F.lit("_"), F.lit(" ")))


def domain_of(url: Column | str) -> Column:
    """The host of a URL, lower-cased, without port."""
    return F.lower(F.regexp_extract(_col(url), r"://(?:[^/?#]*@)?([^/?#:]*)", 1))


def format_size(size: Column | str) -> Column:
    """Bytes in steps of 1024 with two decimals."""
    size = _col(size)
    shown = lambda k, unit: F.format_string(f"%.2f {unit}", F.bround(size / 1024.0**k, 2))  # noqa: E731  halves to even
    out = shown(4, "TB")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (k + 1), shown(k, unit)).otherwise(out)
    return out


def _split_name(path: Column) -> tuple[Column, Column]:
    """The last path part, and its extension: from the last dot on, if something other than dots stands before it. In time that grows with the length."""
    base = F.substring_index(path, "/", -1)
    after = F.substring_index(base, ".", -1)
    before = F.left(base, F.length(base) - F.length(after) - 1)
    return base, F.when(F.contains(base, F.lit(".")) & (F.btrim(before, F.lit(".")) != ""), F.concat(F.lit("."), after)).otherwise("")


def sanitize_filename(name: Column | str, most: int = 255) -> Column:
    """The last path part with the characters that file systems refuse as `_`, shortened before its extension."""
    name = _col(name)
    base, ext = _split_name(F.concat(F.lit("/"), F.regexp_replace(F.substring_index(name, "/", -1), r'[<>:"/\\|?*\x00]', "_")))
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    short = F.concat(F.substring(stem, F.lit(1), F.lit(most) - F.length(ext) - 1), ext)
    cut = F.when(F.length(base) > most, short).otherwise(base)
    safe = F.when(cut.isin("", ".", ".."), "sanitized_file").otherwise(cut)
    return F.when(name.isNull() | (name == ""), "unnamed_file").otherwise(safe)


def project_name_check(name: Column | str, most: int = 100) -> Column:
    """struct(ok, message)."""
    name = _col(name)
    why = (
        F.when(name.isNull() | (name == ""), "Project name cannot be empty")
        .when(F.length(name) > most, f"Project name too long (max {most} characters)")
        .when(name.rlike(r'[<>:"/\\|?*]'), "Project name contains invalid characters")
        .when(F.contains(name, F.lit("..")), "Project name contains traversal attempts")
        .otherwise("Valid")
    )
    return F.struct((why == "Valid").alias("ok"), why.alias("message"))


def search_term_check(term: Column | str, most: int = 1000) -> Column:
    """struct(ok, message): refuses empty and long terms, SQL words and comment signs."""
    term = _col(term)
    words = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|UNION|WAITFOR)\b|--|;|/\*|\*/"
    why = F.when(term.isNull() | (term == "") | (F.length(term) > most), "Search term is empty or too long").when(term.rlike(words), "Search term contains potentially malicious patterns").otherwise("Valid")
    return F.struct((why == "Valid").alias("ok"), why.alias("message"))


def escape_html(text: Column | str, most: int = 10000) -> Column:
    """The five special characters as entities, then cut; null is empty."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return F.left(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(_col(text), F.lit(""))), F.lit(most))


def short_name(path: Column | str, most: int = 200) -> Column:
    """A long path's last part as the first 20 characters of its name, eight of the path's MD5, and its extension."""
    path = _col(path)
    base, ext = _split_name(path)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return F.when(F.length(path) > most, F.concat(F.left(stem, F.lit(20)), F.lit("_"), F.substring(F.md5(path.cast("binary")), 1, 8), ext)).otherwise(base)


def letter_suffix(n: Column | str) -> Column:
    """0, 1, ... as A .. Z, AA, AB, ... (seven letters suffice for 64 bits of files)."""
    n, out = _col(n).cast("long"), F.lit("")
    for _ in range(7):
        out = F.when(n >= 0, F.concat(F.char((n % 26 + 65).cast("int")), out)).otherwise(out)
        n = F.floor(n / 26) - 1
    return out


def badge_class(category: Column | str) -> Column:
    """The style of a category's badge."""
    low = F.replace(F.lower(_col(category)), F.lit("_"), F.lit("-"))
    has = lambda w: F.contains(low, F.lit(w))
    return F.when(has("ip"), "category-ip").when(has("email"), "category-email").when(has("url"), "category-url").when(has("hash"), "category-hash").when(has("card") | has("phone"), "category-financial").otherwise("category-default")


def enrichment_text(country: Column | str, city: Column | str, asn: Column | str, error: Column | str) -> Column:
    """`Country: ... | City: ... | AS: ...`, or the error."""
    part = lambda key, c: F.when(_col(c) != "", F.concat(F.lit(f"{key}: "), _col(c)))
    return F.when(_col(error) != "", F.concat(F.lit("Enrichment Error: "), _col(error))).otherwise(F.concat_ws(" | ", part("Country", country), part("City", city), part("AS", asn)))


def file_class(extension: Column | str) -> Column:
    """The class of a file by its extension; null for others."""
    ext = F.lower(_col(extension))
    return reduce(lambda c, kv: c.when(ext.isin(*kv[1]), kv[0]), list(fixed.EXTENSIONS.items())[1:], F.when(ext.isin(*fixed.EXTENSIONS["text"]), "text"))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Degrees, minutes and seconds as a signed number; anything but N and E is negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(hemisphere.isin("N", "E"), value).otherwise(-value)
