"""Patterns, lists and tables that results depend on.

They are given values, stated as they are and in their natural order; everything else in this package is built on them.
"""

# Indicator patterns by category. All are applied ignoring case, `^` and `$` at lines.
PATTERNS = {
    "IPv4": r"(?:^|(?<=[^\w.]))((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:$|(?=[^\w.]))",
    "IPv4_with_Port": r"(?:^|(?<=[^\w.]))((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?):([1-9]\d{0,3}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5])(?:$|(?=[^\w.]))",
    "IPv6": r"\b(([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})|:((:[0-9a-fA-F]{1,4}){1,7}|:)|fe80:(:[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}|::(ffff(:0{1,4}){0,1}:){0,1}((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])|([0-9a-fA-F]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9]))\b",
    "URLs": r"\b(?:https?|sftp|ftp|ws)://(?!.*\.\.)(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?::[1-9]\d{0,3}|[1-5]\d{4}|6[0-4]\d{3}|65[0-4]\d{2}|655[0-2]\d|6553[0-5])?(?:/[^\s<>\"'{}|\\^`\[\]]*)?\b",
    "Onion_Addresses": r"\b[a-z2-7]{16}\.onion\b|\b[a-z2-7]{56}\.onion\b",
    "Email_Addresses": r"(?<![a-fA-F0-9])(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9](?:[a-zA-Z0-9._%+-]{0,61}[a-zA-Z0-9])?@(?!.*\.\.)(?!.*@)[a-zA-Z0-9](?:[a-zA-Z0-9.-]{0,61}[a-zA-Z0-9])?\.[a-zA-Z]{2,}(?![a-fA-F0-9])(?![a-zA-Z0-9._%+-])\b",
    "Credit_Card_VisaMcDiscover": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6(?:011|5[0-9][0-9])[0-9]{12})\b",
    "Credit_Card_Amex": r"\b3[47][0-9]{13}\b",
    "Credit_Card_Numbers": r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b3[47][0-9]{13}\b",
    "Bitcoin_Addresses": r"\b(bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}\b",
    "Ethereum_Addresses": r"\b0x[a-fA-F0-9]{40}\b(?![\da-fA-F])",
    "Monero_Addresses": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b",
    "IBAN": r"\b[A-Z]{2}[0-9]{2}[a-zA-Z0-9]{4}[0-9]{7}([a-zA-Z0-9]?){0,16}\b",
    "SSN": r"\b(?!000|666|9\d{2})([0-6]\d{2}|7[0-6]\d|77[0-2])[- ]?(?!00)([0-9]\d)[- ]?(?!0000)(\d{4})\b",
    "Phone_Numbers": r"\b(?:\+?1[-.\s]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[-.\s]?[2-9]\d{2}[-.\s]?\d{4}\b|\b\+\d{1,3}[-.\s]?\d{3,}[-.\s]?\d{3,}\b",
    "ISO_Timestamps": r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?\b",
    "Unix_Timestamps_Recent": r"\b1(?:5[7-9]|6\d|7[0-5])\d{7}(?:\.\d{1,3})?\b",
    "Unix_Timestamps": r"\b(?:1[0-3]\d{8}|[2-9]\d{9})(?:\.\d{1,3})?\b",
    "Device_IDs_UUIDs": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1345][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b",
    "MAC_Addresses": r"\b(?<![\da-fA-F])([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})(?![\da-fA-F])\b",
    "User_Agents": r"\bUser-Agent\s*:\s*[^\r\n]{20,}\b",
}

# Addresses that are never reported as IPv4.
IRRELEVANT_IPS = [r"^127\.0\.0\.1$", r"^0\.0\.0\.0$", r"^255\.255\.255\.255$", r"^169\.254\.", r"^10\.", r"^192\.168\.", r"^172\.(1[6-9]|2[0-9]|3[0-1])\."]
# What the strict variant also leaves out of URLs and e-mail addresses.
IRRELEVANT_DOMAINS = [r"example\.com", r"w3\.org", r"schemas\.microsoft\.com", r"googleapis\.com", r"gstatic\.com"]
FALSE_EMAILS = [r"example\.com", r"domain\.com", r"server\.com", r"test\.com", r"yourdomain\.com"]
NULL_WORDS = ["null", "none", "undefined", "n/a"]

# File extensions by class.
EXTENSIONS = {
    "text": [".txt", ".log", ".csv", ".json", ".xml", ".html", ".md"],
    "email": [".eml", ".msg", ".mbox"],
    "documents": [".pdf", ".docx", ".xlsx", ".pptx"],
    "archives": [".zip", ".rar", ".7z", ".tar", ".gz"],
    "data": [".db", ".sqlite"],
    "images": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff"],
    "audio": [".mp3", ".wav", ".flac"],
    "video": [".mp4", ".avi", ".mkv", ".mov"],
}

# Categories whose values are card numbers; categories of the timeline, of links, of exposures.
CARDS = ["Credit_Card_VisaMcDiscover", "Credit_Card_Amex", "Credit_Card_Numbers"]
TIMELINE = ["Timestamps", "ISO_Timestamps", "Unix_Timestamps"]
LINKING = ["Email_Addresses", "Phone_Numbers", "Bitcoin_Addresses", "Credit_Card_Numbers", "Device_IDs_UUIDs", "MD5_Hashes"]
EXPOSED = ["Email_Addresses", "Phone_Numbers", "Credit_Cards", "SSN"]
# Categories of the exported security dataset (extraction gives none of them).
SECURITY_EXPORT = ["IPv4_Suspect", "Malicious_URL", "CVE", "Suspicious_Process", "YARA_Match"]

# Issuers by the first six digits.
BINS = {
    "414720": "Chase (Signature Visa)",
    "414709": "Capital One",
    "400022": "Bank of America",
    "473702": "Wells Fargo",
    "542418": "Citibank",
    "434256": "TD Bank",
    "411111": "Visa Test",
    "555555": "Mastercard Test",
}

# Area code, state, city, time zone.
AREA_CODES = [
    ("803", "South Carolina", "Columbia", "EST"),
    ("212", "New York", "New York", "EST"),
    ("310", "California", "Los Angeles", "PST"),
    ("312", "Illinois", "Chicago", "CST"),
    ("404", "Georgia", "Atlanta", "EST"),
    ("415", "California", "San Francisco", "PST"),
    ("512", "Texas", "Austin", "CST"),
    ("617", "Massachusetts", "Boston", "EST"),
    ("713", "Texas", "Houston", "CST"),
    ("832", "Texas", "Houston", "CST"),
]
# Area codes that no phone number has.
BAD_AREA_CODES = ["555", "000", "111", "222", "333", "444", "666", "777", "888", "999"]

# Countries by risk, for the live and the exported dataset.
LIVE_HIGH, LIVE_LOW = ["RU", "CN", "KP", "IR", "UA", "BY"], ["US", "GB", "DE", "FR", "CA", "AU", "JP", "KR"]
EXPORT_MEDIUM = ["RU", "CN", "KP", "IR"]
THREAT_LOW = ["US", "GB", "DE", "FR", "CA", "AU"]
# What makes a URL suspicious.
URL_MALWARE = ["phishing", "malware", "virus", "trojan", "botnet"]
URL_SHORT = ["bit.ly", "tinyurl", "t.co", "goo.gl"]
URL_CHEAP = [".tk", ".ml", ".ga", ".cf"]

# The rates at which a fractal's colours change with the steps.
WAVES = {"red": 0.09, "green": 0.05, "blue": 0.03}

# From which confidence or number of reports on an address is malicious, or suspicious (more than these).
ABUSE_BAD, ABUSE_SOME = (75, 10), (25, 0)
# How sure the rule for addresses is: for malicious and suspicious ones what is added to the abuse confidence, and
# the most; for others; for each known weakness, and the most; by country; and the number of weaknesses that is severe (more than).
SURE_BAD, SURE_SOME, SURE_OTHER = (60, 95), (50, 80), 60
SURE_WEAK, WEAK_SEVERE = (10, 90), 3
SURE_HIGH, SURE_MIDDLE, SURE_LOW = 80, 60, 40
# The same for URLs: what is added to the share of positive scans, and the most; positives that are severe (more
# than); clean ones; by malware words, shorteners, cheap domains; and others.
SURE_SCAN, SCANS_SEVERE, SURE_CLEAN = (70, 95.0), 5, 20.0
SURE_MALWARE, SURE_SHORT, SURE_CHEAP, SURE_NOTHING = 85.0, 60.0, 70.0, 30.0
# How sure the rule for exposed data is, for the worst categories and for the others.
SURE_WORST, SURE_EXPOSED = 90.0, 70.0
