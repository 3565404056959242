"""Byte-level token ids as column expressions.

Layout of the reserved ids: unknown, begin, end, the five chat markers, then
one id for each byte value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.functions.chat import MARKERS, has_marker

# Reserved ids.
UNK, BOS, EOS = 0, 1, 2
FIRST_MARKER = 3
FIRST_BYTE = FIRST_MARKER + len(MARKERS)
FIRST_LEARNED = FIRST_BYTE + 256

MARKER_IDS = {marker: FIRST_MARKER + i for i, marker in enumerate(MARKERS)}
MARKER_PATTERN = "|".join(re.escape(m) for m in MARKERS)


def byte_ids(text: Column) -> Column:
    """begin + one id per UTF-8 byte (one per chat marker) + end."""
    # Latin-1 gives one character per byte, so splitting it yields the bytes.
    latin = F.decode(text.cast("binary"), "ISO-8859-1")

    def byte_id(char: Column) -> Column:
        return F.ascii(char) + FIRST_BYTE

    def piece_id(piece: Column) -> Column:
        choice = None
        for marker, marker_id in MARKER_IDS.items():
            test = piece == marker
            choice = F.when(test, marker_id) if choice is None else choice.when(test, marker_id)
        return choice.otherwise(byte_id(piece))

    plain = F.transform(F.split(latin, ""), byte_id)
    pieces = F.regexp_extract_all(latin, F.lit(f"(?s){MARKER_PATTERN}|."), F.lit(0))
    body = (
        F.when(text == "", F.array().cast("array<int>"))
        .when(has_marker(text), F.transform(pieces, piece_id))
        .otherwise(plain)
    )
    return F.concat(F.array(F.lit(BOS)), body, F.array(F.lit(EOS)))


def byte_token_count(text: Column) -> Column:
    """Size of `byte_ids` without building the array."""
    count = F.octet_length(text).cast("bigint") + 2
    for marker in MARKERS:
        found = F.when(
            F.contains(text, F.lit(marker)), F.regexp_count(text, F.lit(re.escape(marker)))
        ).otherwise(0)
        count = count - found * (len(marker.encode()) - 1)
    return count


def normalise_spaces(text: Column) -> Column:
    """Collapse runs of spaces and trim spaces; newlines and tabs stay."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


# Fixed value: the visible stand-in for a space inside pieces.
SPACE_MARK = "▁"
WORD_PATTERN = f"{SPACE_MARK}?[^{SPACE_MARK}]+|{SPACE_MARK}"


def spaced(text: Column) -> Column:
    """The words of one line with single spaces between them: `normalise_spaces`, and a space for each mark.

    Patterns only run on texts that need them.
    """
    trimmed = F.when(F.contains(text, F.lit("  ")), normalise_spaces(text)).otherwise(F.trim(text))
    return F.when(F.contains(text, F.lit(SPACE_MARK)), F.replace(trimmed, F.lit(SPACE_MARK), F.lit(" "))).otherwise(trimmed)
