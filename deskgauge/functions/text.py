"""Text expressions: normalisation, quality classes, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: missing markers and message-quality patterns ---------------------------------------------------
MISSING_TOKENS = ("", "na", "n/a", "null", "none")
JUNK_PATTERNS = (
    r"(?i)\b(?:ivr|transcript)\b[^\n]*\b(?:failed|error|unavailable|technical issue)\b",
    r"(?i)^(?:[\[<])?\s*(?:no input|silence|unintelligible|call disconnected|ivr error)\b",
)
# --- fixed values: Unicode white space ------------------------------------------------------------------------------
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_space(c: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(WHITE))


def normalize_text(c: Column) -> Column:
    """Collapse white space; missing markers and blanks become NULL."""
    squeezed = F.trim(F.regexp_replace(F.translate(c, WHITE, " " * len(WHITE)), " {2,}", " "))
    return once(squeezed, lambda x: F.when(~F.lower(x).isin(*MISSING_TOKENS), x))


def once(c: Column, then) -> Column:
    """``then(c)``, with ``c`` evaluated a single time however often ``then`` names it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def at_most_two_distinct_chars(c: Column) -> Column:
    """True when the string uses one or two different characters, without splitting it into an array."""
    rest = F.replace(c, F.substring(c, 1, 1), F.lit(""))
    return F.replace(rest, F.substring(rest, 1, 1), F.lit("")) == ""


def message_quality(message: Column) -> Column:
    """``struct(flag, reason)`` for one customer message; the first rule that applies wins."""

    def rules(text: Column) -> Column:
        packed = F.replace(F.lower(text), F.lit(" "), F.lit(""))
        return (
            F.when(text == "", "empty_message")
            .when(text.rlike(JUNK_PATTERNS[0]) | text.rlike(JUNK_PATTERNS[1]), "known_ivr_or_transcript_marker")
            .when((F.length(text) < 3) | ~text.rlike("[A-Za-z0-9]"), "insufficient_text")
            .when((F.length(text) >= 12) & at_most_two_distinct_chars(packed), "repetitive_text")
            .otherwise("")
        )

    reason = once(strip_space(F.coalesce(message, F.lit(""))), rules)
    return once(reason, lambda r: F.struct(F.when(r == "", "usable").otherwise("degraded").alias("flag"), r.alias("reason")))


def clip(c: Column, limit: int | None) -> Column:
    """First ``limit`` characters, or the whole text when no limit is configured."""
    return c if limit is None else F.substring(c, 1, limit)


def token_estimate(c: Column) -> Column:
    """Four characters per token, at least one token."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("bigint")
