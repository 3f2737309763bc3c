"""Redaction of secrets and personal data, as chains of JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import matches, replace

MASK = "****"

#: Rules in their order, with what replaces a match.
SECRETS = (
    ("url_password", r"(://[^:@]+:)([^@]+?)(@)", "$1****$3"),
    ("bearer_token", r"(?i)(bearer\s+)([a-zA-Z0-9\-._~+/]+=*)", "$1****"),
    ("jwt", r"(eyJ[a-zA-Z0-9\-._~+/]+=*\.eyJ[a-zA-Z0-9\-._~+/]+=*\.[a-zA-Z0-9\-._~+/]+=*)", "****"),
    ("api_key_header", r"(?i)(api[_-]?key\s*[=:]\s*)([a-zA-Z0-9\-._~+/]+)", "$1****"),
    ("x_api_key", r"(?i)(x-api-key\s*[=:]\s*)([a-zA-Z0-9\-._~+/]+)", "$1****"),
    ("authorization", r"(?i)(authorization\s*[=:]\s*)(.+?)(\s|$)", "$1****$3"),
    ("aws_access_key", r"(?i)(aws[_-]?access[_-]?key[_-]?id\s*[=:]\s*)([A-Z0-9]{20})", "$1****"),
    ("aws_secret_key", r"(?i)(aws[_-]?secret[_-]?access[_-]?key\s*[=:]\s*)([A-Za-z0-9/+=]{40})", "$1****"),
    ("password", r"(?i)(password\s*[=:]\s*)([^\s,&]+)", "$1****"),
    ("passwd", r"(?i)(passwd\s*[=:]\s*)([^\s,&]+)", "$1****"),
    ("pwd", r"(?i)(pwd\s*[=:]\s*)([^\s,&]+)", "$1****"),
    ("token", r"(?i)(token\s*[=:]\s*)([a-zA-Z0-9\-._~+/]{16,})", "$1****"),
    ("secret", r"(?i)(secret\s*[=:]\s*)([a-zA-Z0-9\-._~+/]{16,})", "$1****"),
)
CARD = ("credit_card", r"\b(?:\d{4}[-\s]?){3}(\d{4})\b", "****-****-****-$1")
EMAIL = ("email", r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", "$1****@$2")
IPV4 = ("ipv4", r"\b(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}\b", "$1.$2.***.***")
IPV6 = ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "****")
IDS = (("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****"), ("cpf", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "***.***.***-**"))
#: Query parameters whose values are masked in URLs.
URL_PARAMS = ("token", "key", "password", "secret", "api_key", "apikey", "access_token", "auth")


def rules(cards: bool = True, emails: bool = False, ips: bool = False, custom: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """The rules in the order in which they apply; custom ones last, by name."""
    out = list(SECRETS)
    out += [CARD] if cards else []
    out += [EMAIL] if emails else []
    out += [IPV4] if ips else []
    out += IDS
    return out + [(name, pattern, MASK) for name, pattern in sorted((custom or {}).items())]


def redact(col: Column, **options) -> Column:
    for _, pattern, by in rules(**options):
        col = replace(col, pattern, by)
    return col


def is_sensitive(col: Column, cards: bool = True, emails: bool = False, ips: bool = False, custom: dict[str, str] | None = None) -> Column:
    found = F.lit(False)
    for _, pattern, _ in [*rules(cards, emails, ips, custom), *([IPV6] if ips else [])]:
        found = found | matches(col, pattern)
    return found


def sensitive_rules(col: Column, **options) -> Column:
    """The names of the rules that match, in order (for ``sanitized_fields``)."""
    return F.filter(F.array(*(F.when(matches(col, p), F.lit(n)) for n, p, _ in rules(**options))), lambda x: x.isNotNull())


def redact_map(col: Column, **options) -> Column:
    """Keys and values of a map; of keys that become equal the last stays."""
    entries = F.transform(F.map_entries(col), lambda e: F.struct(redact(e["key"], **options).alias("key"), redact(e["value"], **options).alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def redact_url(col: Column) -> Column:
    """Userinfo and the values of the listed parameters become an encoded mask; parameters come in order of name.

    A text that is no URL with a scheme is redacted like any other.
    """
    masked = "%2A%2A%2A%2A"
    base = F.regexp_extract(col, r"^([^?#]*)", 1)
    base = F.regexp_replace(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)([^/@:]*):[^/@]*@", f"$1$2:{masked}@")
    query = F.regexp_extract(col, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(col, r"(#.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda x: x != ""))
    names = "|".join(URL_PARAMS)
    pairs = F.transform(pairs, lambda p: F.regexp_replace(p, rf"^((?i:{names}))=.*$", f"$1={masked}"))
    rebuilt = F.concat(base, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")), fragment)
    return F.when(col.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), rebuilt).otherwise(redact(col))
