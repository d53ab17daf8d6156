"""Token counting, trimming and name/secret/date/JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of at most 24 letters and digits, or of at most 8 other visible characters. Longer runs, as in scripts without
# spaces, rules and encoded data, are several tokens, so that a number of tokens bounds a length.
TOKEN_PATTERN = r"[\p{L}\p{N}]{1,24}|[^\s\p{L}\p{N}]{1,8}"

# Fixed value: whitespace stripped from chunk ends (all Unicode separators, controls, byte-order mark).
BLANK_EDGES = r"^[\s\x{0B}\p{Z}\x{FEFF}]+|[\s\x{0B}\p{Z}\x{FEFF}]+\z"

# Fixed value: the stars put in place of the middle of a secret.
MASK = "*******"


def tokens(text: Column) -> Column:
    """All tokens of ``text``, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens in ``text``."""
    return F.size(tokens(text))


def strip_blank(text: Column) -> Column:
    """Remove blank characters from both ends."""
    return F.regexp_replace(text, BLANK_EDGES, "")


def sanitize_name(name: Column) -> Column:
    """Every character but ASCII letters and digits becomes ``_``."""
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")


def capitalize_first(value: Column) -> Column:
    """Upper-case the first character and leave the others alone."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substr(value, F.lit(2)))


def mask_middle(secret: Column, keep: int = 8) -> Column:
    """Keep ``keep`` characters at both ends of longer secrets; empty becomes null."""
    return F.when(
        F.length(secret) > 2 * keep,
        F.concat(F.left(secret, F.lit(keep)), F.lit(MASK), F.right(secret, F.lit(keep))),
    ).otherwise(F.nullif(secret, F.lit("")))


def join_spaced(*parts: Column) -> Column:
    """Concatenate with single spaces."""
    return F.concat_ws(" ", *parts)


def iso_timestamp(ts: Column) -> Column:
    """Timestamp to ISO-8601 UTC text with milliseconds (session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso_timestamp(text: Column) -> Column:
    """ISO-8601 UTC text with milliseconds to timestamp; null when unreadable."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))


def params_to_json(params: Column) -> Column:
    """Struct or map to JSON text."""
    return F.to_json(params)


def params_from_json(text: Column, schema: str = "map<string,string>") -> Column:
    """JSON text to a map (or the given schema); null when unreadable."""
    return F.from_json(text, schema)
