"""Column functions for chat examples: field choice and rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.functions.text import strip_fences_and_controls, ustrip

# The chat markers, in the order of their reserved ids.
BEGIN = "<|begin_of_text|>"
END = "<|end_of_text|>"
HEADER_START = "<|start_header_id|>"
HEADER_END = "<|end_header_id|>"
TURN_END = "<|eot_id|>"
MARKERS = (BEGIN, END, HEADER_START, HEADER_END, TURN_END)


@dataclass(frozen=True)
class Template:
    begin: str
    before_role: str
    after_role: str
    after_text: str


TEMPLATES = {
    "header": Template(BEGIN, HEADER_START, HEADER_END + "\n\n", TURN_END),
    "chatml": Template("", "<|im_start|>", "\n", "<|im_end|>\n"),
}


def first_truthy(*columns: Column) -> Column:
    """First non-empty value; the last column counts even when it is empty."""
    *head, last = columns
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def render_chat(
    system: Column | None, user: Column, assistant: Column | None, template: str = "header"
) -> Column:
    """One training text from its turns.

    A null or blank system turn and a null assistant turn are left out; a null
    user turn makes the whole text null.
    """
    t = TEMPLATES[template]

    def turn(role: str, text: Column) -> Column:
        body = strip_fences_and_controls(ustrip(text))
        return F.concat(F.lit(t.before_role + role + t.after_role), body, F.lit(t.after_text))

    parts = [F.lit(t.begin)]
    if system is not None:
        parts.append(F.when(ustrip(system) != "", turn("system", system)).otherwise(""))
    parts.append(turn("user", user))
    if assistant is not None:
        parts.append(F.coalesce(turn("assistant", assistant), F.lit("")))
    return F.concat(*parts)


def has_marker(text: Column) -> Column:
    """True where the text already holds a chat marker, which tokenises to a control id."""
    found = F.lit(False)
    for marker in MARKERS:
        found = found | F.contains(text, F.lit(marker))
    return found
