"""Queries of the run-sizing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import tokens as K
from corpusprep.functions.labels import size_label
from corpusprep.operators import records as R
from corpusprep.operators import sizing as Z
from corpusprep.operators.encode import bpe_ids
from corpusprep.plans import duck
from corpusprep.plans.fixtures import configs, ctes, json_lines
from corpusprep.plans.records import _SFT, _examples
from corpusprep.plans.registry import Tables, query
from corpusprep.plans.tokens import corpus_vocab
from corpusprep.session import cut_lineage

_BLOCK, _BATCH, _EPOCHS = 64, 4, 2
_TEXT = duck.byte_list("text")


@query(
    f"""SELECT lang, count(*) AS examples, cast(sum(len({_TEXT})) AS bigint) AS tokens FROM documents GROUP BY lang"""
)
def token_totals(t: Tables) -> DataFrame:
    return Z.token_totals(t.documents, K.byte_token_count(F.col("text")), ["lang"])


@query(
    f"""WITH n AS (SELECT cast(sum(len({_TEXT})) AS bigint) AS tokens FROM documents),
      w AS (SELECT tokens, greatest(0, tokens - {_BLOCK} - 1) AS windows FROM n),
      b AS (SELECT *, windows // {_BATCH} AS batches FROM w)
    SELECT tokens, windows, batches, greatest(1, batches * {_EPOCHS}) AS steps FROM b"""
)
def exact_steps(t: Tables) -> DataFrame:
    return Z.exact_steps(t.documents, K.byte_token_count(F.col("text")), _BLOCK, _BATCH, _EPOCHS)


@query()
def exact_steps_bpe(t: Tables) -> DataFrame:
    """Steps of the chat examples, counted in tokens of the vocabulary learned on the merged corpus."""
    pieces, _, words = corpus_vocab(t)
    coded = _examples(t)[0].select(bpe_ids(pieces, words)(F.col("example")).alias("ids"))
    return Z.exact_steps(coded, F.size("ids"), _BLOCK, _BATCH, _EPOCHS)


def _estimate_sql(max_bytes: int, max_examples: int) -> str:
    return f"""SELECT cast(sum(n_bytes) AS bigint) AS file_bytes,
        cast(sum(n_bytes) FILTER (line_no <= last) AS bigint) AS sample_bytes,
        cast(coalesce(sum(valid) FILTER (line_no <= last), 0) AS bigint) AS sample_lines,
        cast(coalesce(sum(n_tokens) FILTER (line_no <= last), 0) AS bigint) AS sample_tokens
      FROM counted, (SELECT coalesce(min(line_no), 9223372036854775807) AS last FROM counted
        WHERE parsed AND (bytes_read >= {max_bytes} OR lines_seen >= {max_examples}))"""


def _estimates(limits: list[tuple[int, int]]) -> str:
    rows = " UNION ALL ".join(f"SELECT {a} AS max_bytes, {b} AS max_examples, * FROM ({_estimate_sql(a, b)})" for a, b in limits)
    return f"""{_SFT}, sized AS (SELECT l.line_no, octet_length(encode(l.raw)) + 1 AS n_bytes,
        coalesce(json_valid({duck.strip("l.raw")}), false) AND {duck.strip("l.raw")}[1] = '{{' AS parsed,
        CASE WHEN e.line_no IS NULL THEN 0 ELSE 1 END AS valid,
        CASE WHEN e.line_no IS NOT NULL THEN len({duck.byte_list("e.example")}) END AS n_tokens
      FROM json_lines l LEFT JOIN examples e USING (line_no)),
    counted AS (SELECT *, sum(n_bytes) OVER (ORDER BY line_no) AS bytes_read, sum(valid) OVER (ORDER BY line_no) AS lines_seen FROM sized),
    totals AS ({rows})
    SELECT cast(max_bytes AS integer) AS max_bytes, cast(max_examples AS integer) AS max_examples, file_bytes, sample_bytes, sample_lines, sample_tokens,
      cast(CASE WHEN sample_bytes = 0 OR sample_tokens = 0 THEN 1 ELSE greatest(1, floor(floor(sample_tokens
        * (cast(file_bytes AS double) / sample_bytes)) / {_BLOCK * _BATCH})) END AS bigint) AS steps FROM totals"""


_LIMITS = [(200_000, 5000), (16 * 1024 * 1024, 50), (16 * 1024 * 1024, 1_000_000)]


@query(_estimates(_LIMITS))
def estimate_steps(t: Tables) -> DataFrame:
    """The estimate when bytes end the sample, when examples do, and when nothing does."""
    lines = json_lines(t).withColumn("n_bytes", F.octet_length("raw") + 1)
    good, _ = R.split_rejects(R.parse_lines(json_lines(t)))
    examples, _ = R.sft_examples(good, ["line_no"])
    sized = examples.select("line_no", K.byte_token_count(F.col("example")).alias("n_tokens"))
    facts = (
        lines.select("line_no", "n_bytes")
        .join(good.select("line_no", F.lit(True).alias("parsed")), "line_no", "left")
        .join(sized, "line_no", "left")
        .withColumn("parsed", F.coalesce("parsed", F.lit(False)))
        .withColumn("valid", F.col("n_tokens").isNotNull())
    )
    facts = cut_lineage(facts)  # three estimates read it, twice each

    def estimate(max_bytes: int, max_examples: int) -> DataFrame:
        row = Z.estimate_steps(facts, _BLOCK, _BATCH, max_bytes, max_examples)
        return row.select(
            F.lit(max_bytes).alias("max_bytes"), F.lit(max_examples).alias("max_examples"), "*"
        )

    first, *others = [estimate(*limits) for limits in _LIMITS]
    for other in others:
        first = first.unionByName(other)
    return first


_AMOUNTS = """SELECT o_orderkey, cast(round(o_totalprice * 100) AS bigint) * CASE o_orderkey % 5
    WHEN 0 THEN 1 WHEN 1 THEN 37 WHEN 2 THEN 1000 ELSE 100003 END % CASE o_orderkey % 7 WHEN 0 THEN 1200 ELSE 900000000000 END AS n
  FROM {orders}"""


@query(
    f"""SELECT o_orderkey, n, CASE WHEN n >= 1000000000 THEN rtrim(rtrim(printf('%.1f', n / 1e9), '0'), '.') || 'B'
      WHEN n >= 1000000 THEN rtrim(rtrim(printf('%.1f', n / 1e6), '0'), '.') || 'M'
      WHEN n >= 1000 THEN rtrim(rtrim(printf('%.1f', n / 1e3), '0'), '.') || 'K' ELSE cast(n AS varchar) END AS label
    FROM ({_AMOUNTS.format(orders="orders")})"""
)
def size_labels(t: Tables) -> DataFrame:
    return t.sql(_AMOUNTS, orders=t.orders).withColumn("label", size_label(F.col("n")))


@query(
    f"""{ctes(configs=None)} SELECT model, 2 * vocab_size::bigint * n_embd + n_embd + n_layer::bigint * (2 * n_embd + 2 * n_embd * n_embd
      + 2 * n_embd * n_kv_head * (n_embd // n_head) + 3 * n_embd * (8 * n_embd // 3)) AS params FROM configs"""
)
def config_params(t: Tables) -> DataFrame:
    return Z.config_params(configs(t)).select("model", "params")
