"""SQL building blocks: what the queries say, once more, for an independent engine (RE2 patterns, list functions)."""

from __future__ import annotations

from ..functions import fixed

OCT = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP = rf"(?:{OCT}\.){{3}}{OCT}"
LC = "a-zA-Z0-9._%+-"
#: Categories whose patterns RE2 compiles as they are.
PLAIN = ["IPv6", "Onion_Addresses", "Credit_Card_VisaMcDiscover", "Credit_Card_Amex", "Credit_Card_Numbers", "Bitcoin_Addresses", "Monero_Addresses", "IBAN", "Phone_Numbers", "ISO_Timestamps", "Unix_Timestamps_Recent", "Unix_Timestamps", "Device_IDs_UUIDs", "User_Agents"]


#: Further categories, whose look-arounds say nothing that word borders don't, or are written out as alternatives.
REWRITTEN = {
    "Ethereum_Addresses": r"\b0x[a-fA-F0-9]{40}\b",
    "SSN": r"\b(?:00[1-9]|0[1-9]\d|[1-5]\d\d|6[0-57-9]\d|66[0-57-9]|7[0-6]\d|77[0-2])[- ]?(?:0[1-9]|[1-9]\d)[- ]?(?:[1-9]\d{3}|0[1-9]\d\d|00[1-9]\d|000[1-9])\b",
    "MAC_Addresses": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
}
PORT = r"(?:[1-9]\d{0,3}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def deobfuscated(c: str) -> str:
    for mark, to in ((r"\[\.\]", "."), (r"\(dot\)", "."), (r"\[dot\]", "."), (r"\[@\]", "@"), (r"\(at\)", "@"), (r"\[at\]", "@")):
        c = f"regexp_replace({c}, '\\s?{mark}\\s?', '{to}', 'gi')"
    c = f"regexp_replace({c}, 'hxxp', 'http', 'gi')"
    return f"regexp_replace({c}, '(\\d+)\\s+\\.\\s+(\\d+)\\s+\\.\\s+(\\d+)\\s+\\.\\s+(\\d+)', '\\1.\\2.\\3.\\4', 'g')"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn_sum(d: str, doubled: int) -> str:
    x = f"substr(reverse({d}), i::BIGINT + 1, 1)::INT"
    return f"list_sum([CASE WHEN i % 2 = {doubled} THEN (CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END) ELSE {x} END for i in range(length({d}))])"


def luhn_ok(v: str) -> str:
    d = digits(v)
    return f"(length({d}) BETWEEN 13 AND 19 AND {luhn_sum(d, 1)} % 10 = 0)"


def issuer(v: str) -> str:
    d = digits(v)
    banks = " ".join(f"WHEN {d}[1:6] = '{k}' THEN 'Visa/MC - {b}'" for k, b in fixed.BINS.items())
    return f"CASE WHEN starts_with({d}, '3') AND length({d}) = 15 THEN 'Amex' WHEN starts_with({d}, '6011') THEN 'Discover' WHEN {d}[1:2] IN ('30', '36', '38') THEN 'Diners Club' {banks} WHEN starts_with({d}, '4') THEN 'Visa (Generic)' WHEN starts_with({d}, '5') THEN 'Mastercard (Generic)' ELSE 'Unknown Issuer' END"


def ip_class(v: str) -> str:
    o = lambda k: f"try_cast(split_part(split_part({v}, ':', 1), '.', {k}) AS INT)"
    bad = " OR ".join(f"{o(k)} IS NULL OR {o(k)} NOT BETWEEN 0 AND 255" for k in (1, 2, 3, 4))
    return f"""CASE WHEN len(string_split(split_part({v}, ':', 1), '.')) <> 4 OR {bad} THEN 'Invalid' WHEN {o(1)} = 0 THEN 'Reserved/Bogus' WHEN {o(1)} = 10 THEN 'Private' WHEN {o(1)} = 127 THEN 'Loopback'
  WHEN {o(1)} = 169 AND {o(2)} = 254 THEN 'Link-Local' WHEN {o(1)} = 172 AND {o(2)} BETWEEN 16 AND 31 THEN 'Private' WHEN {o(1)} = 192 AND {o(2)} = 168 THEN 'Private'
  WHEN {o(1)} BETWEEN 224 AND 239 THEN 'Multicast' WHEN {o(1)} >= 240 THEN 'Reserved' ELSE 'Public' END"""


TEXTS = f"t AS (SELECT source AS case_name, 'doc_' || doc_id || '.txt' AS file_name, doc_id AS ord, {deobfuscated('text')} AS text FROM documents WHERE text IS NOT NULL)"


def plain(category: str, source: str = "t") -> str:
    """case_name, file_name, ord, category, value, position of a category that RE2 takes as it is, or rewritten."""
    p = q(REWRITTEN.get(category) or fixed.PATTERNS[category])
    return f"""SELECT case_name, file_name, ord, '{category}' AS category, trim(m[i]) AS value,
  (list_sum([length(x) for x in parts[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::INT AS position
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT case_name, file_name, ord, regexp_extract_all(text, {p}, 0, 'i') AS m, regexp_split_to_array(text, {p}, 'i') AS parts FROM {source} WHERE regexp_matches(text, {p}, 'i')))"""


def ipv4(source: str = "t", category: str = "IPv4", tail: str = "") -> str:
    each = f"regexp_extract_all(regexp_replace(text, '([^\\w.])', '\\1\\1', 'g'), '(?:^|[^\\w.])({IP}{tail})(?:$|[^\\w.])', 1, 'm')"
    return f"SELECT case_name, file_name, ord, '{category}' AS category, value, (instr(text, value) - 1)::INT AS position FROM (SELECT *, unnest({each}) AS value FROM {source} WHERE text IS NOT NULL)"


def emails(source: str = "t") -> str:
    return f"""SELECT case_name, file_name, ord, 'Email_Addresses' AS category, lo || '@' || d AS value, (instr(text, lo || '@' || d) - 1)::INT AS position
FROM (SELECT *, regexp_extract(line, '(?:^|[^{LC}])([a-zA-Z0-9](?:[{LC}]{{0,61}}[a-zA-Z0-9])?)@[^@]*$', 1, 'i') AS lo, regexp_extract(line, '@([^@]*)$', 1) AS tl,
      regexp_extract(regexp_extract(line, '@([^@]*)$', 1), '^([a-zA-Z0-9](?:[a-zA-Z0-9.-]{{0,61}}[a-zA-Z0-9])?\\.[a-zA-Z]{{2,}})(?:[^{LC}]|$)', 1, 'i') AS d
      FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM {source}) WHERE contains(line, '@'))
WHERE lo <> '' AND d <> '' AND NOT contains(tl, '..')"""


def urls(source: str = "t") -> str:
    p = fixed.PATTERNS["URLs"].replace(r"(?!.*\.\.)", "")
    return f"""SELECT case_name, file_name, ord, 'URLs' AS category, unnest(regexp_extract_all(regexp_replace(line, '^.*\\.\\.', '.'), {q(p)}, 0, 'i')) AS value
FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM {source}) WHERE contains(line, '://')"""


def irrelevant(c: str = "category", v: str = "value") -> str:
    denied = "|".join(fixed.IRRELEVANT_IPS)
    return f"(({c} = 'IPv4' AND regexp_matches({v}, {q(denied)})) OR ({c} <> 'IPv4' AND length({v}) < 5) OR lower({v}) IN ('null', 'none', 'undefined', 'n/a'))"


CARDS = ", ".join(q(c) for c in fixed.CARDS)


def with_port(source: str = "t") -> str:
    """Colons part an address from its port, so they aren't doubled as other separators are."""
    each = f"regexp_extract_all(regexp_replace(text, '([^\\w.:])', '\\1\\1', 'g'), '(?:^|[^\\w.])({IP}:{PORT})(?:$|[^\\w.])', 1, 'm')"
    return f"SELECT case_name, file_name, ord, 'IPv4_with_Port' AS category, value, (instr(text, value) - 1)::INT AS position FROM (SELECT *, unnest({each}) AS value FROM {source} WHERE text IS NOT NULL)"


def placed_urls(source: str = "t") -> str:
    return f"SELECT u.case_name, u.file_name, u.ord, u.category, u.value, (instr({source}.text, u.value) - 1)::INT AS position FROM ({urls(source)}) u JOIN {source} USING (case_name, file_name, ord)"


def found(texts: str) -> str:
    """The findings of texts (t), as common table expressions: t, occ, ok, fin, f."""
    return f"""{texts}, occ AS (
{' UNION ALL '.join(plain(c) for c in PLAIN)}
UNION ALL {' UNION ALL '.join(plain(c) for c in REWRITTEN)}
UNION ALL {ipv4()} UNION ALL {with_port()} UNION ALL {emails()}
UNION ALL SELECT case_name, file_name, ord, category, value, position FROM ({placed_urls()})
), ok AS (
  SELECT case_name, file_name, ord, category, value, min(position) AS position FROM occ
  WHERE value <> '' AND NOT {irrelevant()} AND (category NOT IN ({CARDS}) OR {luhn_ok('value')}) GROUP BY ALL
), merged AS (
  SELECT case_name, category, value, arg_max(file_name, ord) AS file, arg_max(position, ord) AS position, min({{'o': ord, 'p': position}}) AS seen FROM ok GROUP BY ALL
), fin0 AS (
  SELECT m.* FROM merged m WHERE category <> 'Email_Addresses' OR NOT EXISTS (
    SELECT 1 FROM merged b WHERE b.category = 'Email_Addresses' AND b.case_name = m.case_name AND b.value <> m.value AND contains(b.value, m.value))
), fin AS (
  SELECT *, CASE WHEN contains(category, 'IP') THEN {ip_class('value')} END AS ip_class, CASE WHEN category IN ({CARDS}) THEN {issuer('value')} END AS issuer FROM fin0
), f AS (
  SELECT *, 'File: ' || file || ' | Position: ' || position || coalesce(' | Type: ' || ip_class, '') || coalesce(' | Issuer: ' || issuer || ' | Luhn: Valid', '') AS context FROM fin
)"""


FOUND = found(TEXTS)


def over_findings(select: str) -> str:
    return f"WITH {FOUND} {select}"
