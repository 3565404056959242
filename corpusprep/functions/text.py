"""Column functions that clean corpus text.

Every function takes and returns a Column and stays inside the JVM. They are
meant to be applied in the order of `clean_text`: a decoded newline tag opens a
new line that the fence rule must see.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns below decide which characters survive.
HEX_TAG = r"<0x([0-9A-Fa-f]{2})>"
DIAG_MARKERS = r"(?:CR13|LF10|CR|LF)"
WORD_CHAR = r"[\p{L}\p{N}_]"
FENCE_LINE = r"(?md)^```[^\n]*"
CONTROLS = (
    r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
)
OUTER_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
ANY_NEWLINE = r"\r\n|\r|\n"


def decode_hex_tags(text: Column) -> Column:
    """Turn ``<0xHH>`` tags into the character with that code (Latin-1 above 0x7F)."""
    parts = F.split(text, HEX_TAG, -1)
    codes = F.regexp_extract_all(text, F.lit(HEX_TAG), F.lit(1))

    def glue(part: Column, code: Column) -> Column:
        char = F.char(F.conv(code, 16, 10).cast("long"))
        return F.concat(part, F.coalesce(char, F.lit("")))

    decoded = F.array_join(F.zip_with(parts, codes, glue), "")
    return F.when(F.contains(text, F.lit("<0x")), decoded).otherwise(text)


def strip_diag_markers(text: Column, mode: str = "exact") -> Column:
    """Delete CR/LF diagnostic words.

    ``exact`` anchors only the end, so it also eats word endings (``self`` -> ``se``).
    ``whole_word`` wants a word start too and is the choice for new corpora.
    """
    if mode not in ("exact", "whole_word"):
        raise ValueError(f"unknown mode {mode!r}")
    start = f"(?<!{WORD_CHAR})" if mode == "whole_word" else ""
    pattern = f"(?i){start}{DIAG_MARKERS}(?!{WORD_CHAR})"
    return F.regexp_replace(text, pattern, "")


def strip_fence_lines(text: Column) -> Column:
    """Blank each line that starts with three backticks; its newline stays."""
    return F.regexp_replace(text, FENCE_LINE, "")


def strip_controls(text: Column) -> Column:
    """Delete ASCII controls (but tab, LF and CR) and Unicode noncharacters."""
    return F.regexp_replace(text, CONTROLS, "")


def strip_fences_and_controls(text: Column) -> Column:
    return strip_controls(strip_fence_lines(text))


def clean_text(text: Column, mode: str = "exact", null_policy: str = "empty") -> Column:
    """Decode tags, then drop markers, fence lines and controls.

    ``null_policy='empty'`` is the corpus rule (null gives ``''``),
    ``'keep'`` the chat-record rule (null stays null).
    """
    if null_policy not in ("empty", "keep"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    if null_policy == "empty":
        text = F.coalesce(text, F.lit(""))
    return strip_fences_and_controls(strip_diag_markers(decode_hex_tags(text), mode))


def ustrip(text: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only spaces."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def normalise_newlines(text: Column) -> Column:
    """CRLF to LF, then trim."""
    return ustrip(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def is_blank(text: Column) -> Column:
    """True for a text of whitespace only."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


# Well-formed UTF-8 sequences, one byte per Latin-1 character.
UTF8_SEQUENCES = "|".join(
    [
        r"[\x00-\x7F]",
        r"[\xC2-\xDF][\x80-\xBF]",
        r"\xE0[\xA0-\xBF][\x80-\xBF]",
        r"[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}",
        r"\xED[\x80-\x9F][\x80-\xBF]",
        r"\xF0[\x90-\xBF][\x80-\xBF]{2}",
        r"[\xF1-\xF3][\x80-\xBF]{3}",
        r"\xF4[\x80-\x8F][\x80-\xBF]{2}",
    ]
)


def drop_bad_utf8(data: Column) -> Column:
    """Text of a binary or string column without its undecodable bytes."""
    raw = data.cast("binary")
    latin = F.decode(raw, "ISO-8859-1")
    kept = F.regexp_replace(latin, f"(?s)((?:{UTF8_SEQUENCES})++)|.", "$1")
    repaired = F.encode(kept, "ISO-8859-1").cast("string")
    as_text = raw.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(repaired)
