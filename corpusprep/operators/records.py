"""Chat examples out of loosely-typed JSON lines and turn tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.chat import has_marker, render_chat
from corpusprep.functions.text import clean_text, is_blank, ustrip
from corpusprep.session import compute_once

# The record members that hold text, in corpus order, and the
# members that may hold the two sides of a chat example, in order of preference.
TEXT_FIELDS = (
    "text", "system", "user", "prompt", "input", "question", "response", "assistant", "answer",
)
USER_FIELDS = ("prompt", "user", "input", "question")
ANSWER_FIELDS = ("response", "assistant", "answer")


def parse_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Non-blank lines with ``record`` (VARIANT, null if unparsable) and ``reject``."""
    others = [c for c in lines.columns if c != raw]
    trimmed = compute_once(lines, others, **{raw: ustrip(F.col(raw))}).filter(F.col(raw) != "")
    parsed = compute_once(trimmed, [*others, raw], record=F.try_parse_json(F.col(raw)))
    reason = F.when(F.col("record").isNull(), "unparsable").when(
        ~F.startswith(F.col(raw), F.lit("{")), "not an object"
    )
    return parsed.withColumn("reject", reason)


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) halves of a frame with a ``reject`` reason."""
    good = parsed.filter(F.col("reject").isNull()).drop("reject")
    return good, parsed.filter(F.col("reject").isNotNull())


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column) -> Column:
    """The text of a JSON string; null for every other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def corpus_fields(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per text member that is a non-blank string, cleaned, in fixed member order."""
    members = F.array(
        *[
            F.struct(F.lit(name).alias("field"), _string(_member(F.col("record"), name)).alias("value"))
            for name in TEXT_FIELDS
        ]
    )
    rows = records.select(*keep, F.posexplode(members).alias("field_rank", "m"))
    return _cleaned(rows.select(*keep, "field_rank", "m.field", "m.value"))


def corpus_messages(records: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per message with non-blank string content, cleaned."""
    messages = F.try_variant_get(F.col("record"), "$.messages", "array<variant>")
    # Outer, as an inner explode infers a filter on the array and computes it twice.
    rows = records.select(*keep, F.posexplode_outer(messages).alias("message_rank", "m"))
    value = _string(_member(F.col("m"), "content"))
    return _cleaned(rows.select(*keep, "message_rank", value.alias("value")))


def _cleaned(rows: DataFrame) -> DataFrame:
    kept = rows.filter(F.col("value").isNotNull() & ~is_blank(F.col("value")))
    others = [c for c in rows.columns if c != "value"]
    return compute_once(kept, others, text=clean_text(F.col("value"))).filter(F.col("text") != "")


def pair_from_messages(
    turns: DataFrame, conversation: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """First system, last user and last assistant text of each conversation.

    Running aggregates only, so a conversation of any length is merged from
    partial results and never gathered.
    """

    def pick(function, role: str) -> Column:
        mine = F.col("role") == role
        return function(F.when(mine, F.col("text")), F.when(mine, F.col(order))).alias(role)

    return turns.groupBy(conversation).agg(
        pick(F.min_by, "system"), pick(F.max_by, "user"), pick(F.max_by, "assistant")
    )


def complete_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides present; empty texts count as present."""
    return pairs.filter(F.col("user").isNotNull() & F.col("assistant").isNotNull())


def _judged(value: Column, missing: str | None = None) -> Column:
    """What a JSON value is worth as text: (text, truthy, odd).

    `odd` marks a truthy value of another type, which no example can use; falsy
    values of other types count as ``''``. JSON null is a null text.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    falsy = F.to_json(value).isin("false", "[]", "{}") | (is_number & (number == 0))
    worth = (
        F.when(value.isNull(), F.lit(missing).cast("string"))
        .when(kind == "STRING", text)
        .when(kind != "VOID", "")
    )
    truthy = (
        F.when(value.isNull() | (kind == "VOID"), False)
        .when(kind == "STRING", text != "")
        .otherwise(~falsy)
    )
    return F.struct(
        worth.alias("text"),
        truthy.alias("truthy"),
        (F.coalesce(kind != "STRING", F.lit(False)) & truthy).alias("odd"),
    )


def _first_truthy(judged: Column, names: Sequence[str]) -> Column:
    options = F.array(*[F.get(judged, F.lit(TEXT_FIELDS.index(n))) for n in names])
    truthy = F.filter(options, lambda v: v["truthy"])
    return F.coalesce(F.get(truthy, F.lit(0)), F.element_at(options, -1))


def sft_examples(
    records: DataFrame, keep: Sequence[str], include_system: bool = False, template: str = "header"
) -> tuple[DataFrame, DataFrame]:
    """(examples, rejected) of parsed records.

    A truthy ``text`` wins and is used as it is. Otherwise user and answer come
    from the first truthy member of each list, and what is still null from the
    last user and assistant message. Incomplete pairs are dropped; records whose
    chosen value is not a string are rejected.
    """
    keep = list(keep)
    members = F.array(*[_member(F.col("record"), n) for n in TEXT_FIELDS])
    # Judging inside a lambda keeps the plan small: each value is named once.
    judged = records.select(*keep, "record", F.transform(members, lambda v: _judged(v)).alias("judged"))
    chosen = judged.select(
        *keep,
        F.get("judged", F.lit(TEXT_FIELDS.index("text"))).alias("t"),
        F.get("judged", F.lit(TEXT_FIELDS.index("system"))).alias("s"),
        _first_truthy(F.col("judged"), USER_FIELDS).alias("u"),
        _first_truthy(F.col("judged"), ANSWER_FIELDS).alias("a"),
        F.try_variant_get(F.col("record"), "$.messages", "array<variant>").alias("messages"),
    )
    consult = ~F.col("t.truthy") & (F.col("u.text").isNull() | F.col("a.text").isNull())
    chosen = chosen.withColumn("messages", F.when(consult, F.col("messages")))

    def content(role: str, position: int) -> Column:
        mine = F.filter(
            F.col("messages"), lambda m: F.try_variant_get(m, "$.role", "string") == role
        )
        picked = F.slice(mine, position, 1)
        return F.get(F.transform(picked, lambda m: _judged(_member(m, "content"), "")), F.lit(0))

    bad_message = F.exists(
        F.col("messages"), lambda m: ~F.startswith(F.to_json(m), F.lit("{"))
    )
    filled = chosen.select(
        *keep,
        "t",
        F.when(F.col("s.truthy"), F.col("s"))
        .otherwise(F.coalesce(content("system", 1), F.col("s")))
        .alias("s"),
        F.when(F.col("u.text").isNull(), content("user", -1)).otherwise(F.col("u")).alias("u"),
        F.when(F.col("a.text").isNull(), content("assistant", -1)).otherwise(F.col("a")).alias("a"),
        F.coalesce(bad_message, F.lit(False)).alias("bad_message"),
    )
    is_text = F.col("t.truthy")

    def odd(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.odd"), F.lit(False))

    reject = F.when(odd("t"), "text is not a string").when(
        ~is_text,
        F.when(F.col("bad_message"), "message is not an object").when(
            odd("u") | odd("a") | odd("s"), "field is not a string"
        ),
    )

    def cleaned(name: str) -> Column:
        return clean_text(F.col(f"{name}.text"), null_policy="keep")

    judged = compute_once(
        filled, keep, is_text=is_text, reject=reject, t=cleaned("t"), s=cleaned("s"),
        u=cleaned("u"), a=cleaned("a"),
    )
    good, rejected = split_rejects(judged)
    system = F.col("s") if include_system else None
    rendered = F.when(F.col("is_text"), F.col("t")).otherwise(
        render_chat(system, F.col("u"), F.col("a"), template)
    )
    whole = F.when(F.col("is_text"), F.col("t") != "").otherwise(
        F.col("u").isNotNull() & F.col("a").isNotNull()
    )
    source = F.when(F.col("is_text"), F.col("t")).otherwise(F.concat("u", "a"))
    examples = good.filter(whole).select(
        *keep,
        F.when(F.col("is_text"), "text").otherwise("pair").alias("kind"),
        rendered.alias("example"),
        has_marker(source).alias("has_marker"),
    )
    return examples, rejected.select(*keep, "reject")
