"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions.nfc import nfc

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
GUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
# What must not stand in a narrated claim, in the order in which it is looked for.
FORBIDDEN = {
    "CONTROL_CHARACTER": CONTROL,
    "EXTERNAL_LINK": r"(?i)!?\[[^\]]*\]\(\s*(?:https?:|www\.)[^)]*\)",
    "HTML_TAG": r"(?i)</?[a-z][^>]*>",
    "MARKDOWN_FENCE": r"```",
    "URL": r"(?i)\b[a-z][a-z0-9+.-]*://\S+|\bwww\.\S+\.\S+",
    "EMAIL": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "CREDENTIAL_SHAPED": r"(?i)\b(client[\s_-]?secret|access[\s_-]?token|refresh[\s_-]?token|private[\s_-]?key|api[\s_-]?key|secret[\s_-]?key|bearer\s+\S+|authorization\s*[:=])",
    "BASE64_BLOB": r"[A-Za-z0-9+/]{80,}={0,2}",
    "PHONE": r"\+?\d[\d\s().-]{6,}\d",
}
# Words that make an id next to them read as a secret, and how far they may be from it.
SECRET_WORD, SECRET_REACH = "(?i)(secret|key|token|password)", 60
# Keys (lower case, letters and _) whose values are secret, and their kinds.
SENSITIVE = {
    "authorization": "authorization", "clientsecret": "client-secret", "client_secret": "client-secret", "accesstoken": "access-token", "access_token": "access-token",
    "refreshtoken": "access-token", "password": "password", "privatekey": "private-key", "cookie": "authorization",
}
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _java(pattern: str) -> str:
    """The pattern with word edges between ASCII letters, digits and _ only."""
    return pattern.replace(r"\b", _EDGE)


def strip_control(c):
    return F.regexp_replace(c, CONTROL, "")


def strip_invisible(c):
    return F.regexp_replace(c, INVISIBLE, "")


def bounded(c, most: int):
    """The text cut to a number of code points, and where it was cut (null if it was not)."""
    return F.struct(F.left(c, F.lit(most)).alias("text"), F.when(F.length(c) > most, F.lit(most)).alias("truncated_at"))


def strip_url_credentials(c):
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+@", "$1")


def id_near_secret(c):
    """Whether a secret's word stands near the first id-shaped string of the text."""
    before = F.regexp_extract(c, "(?s)^(.*?)" + _EDGE + GUID + _EDGE, 0)
    at = F.length(before)
    near = F.concat(F.right(F.left(before, at - 36), F.lit(SECRET_REACH)), F.lit(" "), F.substring(c, at + 1, F.lit(SECRET_REACH)))
    return (at > 0) & F.rlike(near, F.lit(SECRET_WORD))


def forbidden_pattern(c):
    """The first forbidden kind found in the text, or null; phones are looked for with GUIDs taken out."""
    found = None
    for name, pattern in FORBIDDEN.items():
        hit = F.rlike(F.regexp_replace(c, _java(r"\b" + GUID.replace("(?i)", "(?i:") + r")\b"), "") if name == "PHONE" else c, F.lit(_java(pattern)))
        if name == "CREDENTIAL_SHAPED":
            hit = hit | id_near_secret(c)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def quotations(c):
    """Non-empty texts inside straight quotes, back-ticks and curly quotes."""
    parts = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in ('"([^"]*)"', "`([^`]*)`", "“([^”]*)”")]
    return F.filter(F.concat(*parts), lambda q: F.length(q) > 0)


def safe_segment(c, most: int = 120):
    """A path segment in NFC: other characters become -, - and . are trimmed, reserved names get -, empty is unnamed."""
    s = F.regexp_replace(strip_control(nfc(c)), r"[^A-Za-z0-9._-]+", "-")
    s = F.left(F.regexp_replace(s, r"^[-.]+|[-.]+$", ""), F.lit(most))
    return F.when(F.length(s) == 0, "unnamed").when(F.rlike(s, F.lit(RESERVED)), F.concat(s, F.lit("-"))).otherwise(s)


def flow_directory(name, flow_id):
    return F.concat_ws("-", safe_segment(name), F.left(flow_id, F.lit(8)))


def delimit_untrusted(c, most: int = 2000):
    s = F.left(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""), F.lit(most))
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def kebab_case(c):
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"), r"[_\s]+", "-"))


def content_hash(c):
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def sensitive_kind(key):
    """The kind of secret that a key names, or null."""
    kinds = F.create_map(*(F.lit(x) for p in SENSITIVE.items() for x in p))
    return F.element_at(kinds, F.regexp_replace(F.lower(key), "[^a-z_]", ""))


def redact(paths):
    """Flattened JSON (flow_id, pointer, key, type, scalar) with secrets taken out: pointer, value, category. A sensitive key's
    value becomes [REDACTED:kind], whatever lies below it; other strings lose URL credentials and control characters
    (category url-credential or control-characters, the former first); what is redacted already stays, without a category."""
    above = F.slice(F.split("pointer", "/"), 2, F.greatest(F.size(F.split("pointer", "/")) - 2, F.lit(0)))
    rows = paths.where(~F.exists(above, lambda k: sensitive_kind(F.replace(F.replace(k, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))).isNotNull()))
    kind, done = sensitive_kind(F.col("key")), F.rlike(F.coalesce("scalar", F.lit("")), F.lit(r"^\[REDACTED:[a-z-]+\]$"))
    text = F.col("type") == "STRING"
    clean = strip_url_credentials(F.col("scalar"))
    value = F.when(done, F.col("scalar")).when(kind.isNotNull(), F.concat(F.lit("[REDACTED:"), kind, F.lit("]"))).when(text, strip_control(clean)).otherwise(F.col("scalar"))
    category = F.when(done, None).when(kind.isNotNull(), kind).when(text & (clean != F.col("scalar")), "url-credential").when(text & (strip_control(clean) != clean), "control-characters")
    return rows.select("flow_id", "pointer", value.alias("value"), category.alias("category"))


def bounded_bytes(c, most: int):
    """The longest start of a text within a number of UTF-8 bytes: the cut steps back over the bytes of a character begun."""
    raw = F.encode(c, "UTF-8")
    inner = lambda at: F.substr(F.hex(raw), F.lit(2 * at + 1), F.lit(1)).isin("8", "9", "A", "B")
    at = F.lit(max(most - 3, 0))
    for n in range(max(most - 2, 0), most + 1):
        at = F.when(~inner(n), F.lit(n)).otherwise(at)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substr(raw, F.lit(1), at), "UTF-8"))
