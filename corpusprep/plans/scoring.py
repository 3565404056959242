"""Queries of the score-table operators, over the components of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.vectors import rms_normalise as normalise
from corpusprep.operators import scoring as S
from corpusprep.plans.fixtures import ctes, scores
from corpusprep.plans.registry import Tables, query

_SCORES = ctes(scores=None)
_TOP, _TEMPERATURE, _SEED = 5, 0.9, 11


@query(
    f"""{_SCORES} SELECT group_id, cand_id, score FROM scores
      QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, cand_id) = 1"""
)
def argmax(t: Tables) -> DataFrame:
    return S.argmax(scores(t))


@query(
    f"""{_SCORES}, ranked AS (SELECT group_id, cand_id, score, cast(row_number() OVER
        (PARTITION BY group_id ORDER BY score DESC, cand_id) AS integer) AS rank FROM scores)
      SELECT * FROM ranked WHERE rank <= {_TOP}"""
)
def top_k(t: Tables) -> DataFrame:
    return S.top_k(scores(t), _TOP).drop("target")


@query(
    f"""{_SCORES} SELECT group_id, cand_id, round(exp(score / {_TEMPERATURE}
        - ln(sum(exp(score / {_TEMPERATURE})) OVER (PARTITION BY group_id))), 6) AS probability FROM scores"""
)
def softmax(t: Tables) -> DataFrame:
    soft = S.softmax(scores(t), _TEMPERATURE)
    return soft.select("group_id", "cand_id", F.round("probability", 6).alias("probability"))


@query(
    f"""{_SCORES}, kept AS (SELECT * FROM scores QUALIFY row_number() OVER
        (PARTITION BY group_id ORDER BY score DESC, cand_id) <= {_TOP})
      SELECT group_id, cand_id, round(exp(score / {_TEMPERATURE}
        - ln(sum(exp(score / {_TEMPERATURE})) OVER (PARTITION BY group_id))), 6) AS probability FROM kept"""
)
def softmax_top_k(t: Tables) -> DataFrame:
    """Probabilities when only the best candidates stay in."""
    soft = S.softmax(S.top_k(scores(t), _TOP).drop("rank"), _TEMPERATURE)
    return soft.select("group_id", "cand_id", F.round("probability", 6).alias("probability"))


@query(
    f"""{_SCORES}, logs AS (SELECT *, ln(sum(exp(score)) OVER (PARTITION BY group_id)) AS log_sum FROM scores)
      SELECT count(*) AS groups, round(avg(log_sum - score), 6) AS loss FROM logs WHERE cand_id = target"""
)
def cross_entropy(t: Tables) -> DataFrame:
    return S.cross_entropy(scores(t)).withColumn("loss", F.round("loss", 6))


@query(
    f"""{_SCORES}, noisy AS (SELECT group_id, cand_id, score / {_TEMPERATURE} - ln(-ln(
        (cast('0x' || substr(md5('{_SEED}:' || group_id || ':' || cand_id), 1, 12) AS bigint) + 0.5::double) / 281474976710656.0::double)) AS s FROM scores)
      SELECT group_id, cand_id FROM noisy QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY s DESC, cand_id) = 1"""
)
def weighted_draw(t: Tables) -> DataFrame:
    return S.weighted_draw(scores(t), _SEED, _TEMPERATURE)


@query(
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))
        / len(embedding) + 1e-5::double) AS scale FROM embeddings)
      SELECT vec_id, i AS place, round(embedding[i + 1]::double / scale, 6) AS value
      FROM (SELECT *, cast(unnest(range(0, len(embedding))) AS integer) AS i FROM n)"""
)
def rms_normalise(t: Tables) -> DataFrame:
    values = t.embeddings.select(
        "vec_id", F.posexplode(normalise(F.col("embedding"))).alias("place", "value")
    )
    return values.withColumn("value", F.round("value", 6))
