"""The registered queries of this subpackage, with the SQL they must agree with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.llm import (
    centroids, decontaminate, exact_dedup, langid, minhash, mixing, prefix_trie, quotes, sharding, simhash_lines,
    toxicity, vantage, warc,
)
from corpusprep.llm.common import small_side
from corpusprep.session import cut_lineage, local_frame

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, folder, "documents"), keep="largest")
    return found.withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


@query("""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
v AS (SELECT *, [3.0, 1.0, 2.0][k % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
        (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before,
        sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
      FROM v WINDOW o AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before) * weight / weight_left >= cap AS capped FROM o),
f AS (SELECT total AS ft, cap_before AS fc, weight_left AS fw FROM c WHERE NOT capped ORDER BY source_size / weight, k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (ft - fc) * weight / fw END AS target FROM c LEFT JOIN f ON true),
p AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS need,
        (sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  greatest(0, least(start + size, need) - start) + greatest(0, least(start + source_size + size, need) - start - source_size) AS taken
FROM p
""")
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, folder, "documents"))
    return documents.withColumnRenamed("id", "doc_id")


@query()
def op6_uniform_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    return sharding.shuffle_to_shards(rows, 40, extra=["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _leak_sql() -> str:
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

    def seeds(side: str, row: str) -> str:
        parts = []
        for k, mask in enumerate(decontaminate.MASKS):
            key = " || ' ' || ".join(f"w[p + {i}]" for i, used in enumerate(mask) if used == "1")
            parts.append(f"SELECT {row}, w, p, {k} AS m, {key} AS seed FROM (SELECT *, unnest(range(1, len(w) - {len(mask)} + 2)) AS p FROM {side})")
        return " UNION ALL ".join(parts)

    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {decontaminate.MIN_WORDS}),
ds AS ({seeds('d', 'doc_id')}), bs AS ({seeds('b', 'item_id')}),
h AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS diagonal, least(len(bs.w), 13) AS n, ds.w AS dw, bs.w AS bw
      FROM ds JOIN bs USING (m, seed)),
v AS (SELECT doc_id, item_id, n, list_transform(range(1, (len(bw) - n + 2)::BIGINT), lambda s: list_sum(list_transform(range(s, s + n),
        lambda j: CASE WHEN j + diagonal >= 1 AND dw[(j + diagonal)::INT] = bw[j] THEN 1 ELSE 0 END))) AS same FROM h),
f AS (SELECT doc_id, min(item_id) AS item_id, max(list_max(same) / n) AS best_share
      FROM v WHERE list_max(same) >= ceil(n * 0.8 - 1e-9) GROUP BY doc_id)
SELECT doc_id, item_id IS NOT NULL AS contaminated, coalesce(best_share, 0.0)::DOUBLE AS best_share, item_id FROM documents LEFT JOIN f USING (doc_id)
"""


@query(_leak_sql())
def op10_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.mark_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def held_out(part: int, parts: int) -> Column:
    """Whether a document belongs to the fold that no model learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part


def toxicity_model(spark: SparkSession, documents: DataFrame, folder: str) -> toxicity.ToxicityModel:
    """Learned from the labels of documents outside the held-out fold."""
    labels = table(spark, folder, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = labels.filter(~held_out(0, 5)).withColumnRenamed("doc_id", "_labelled")
    texts = documents.select("doc_id", "text")  # other columns may have the names of labels
    return toxicity.learn(texts.join(small_side(known), F.col("doc_id") == F.col("_labelled")).select("text", "toxic"))


@query()
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = toxicity.score(documents, toxicity_model(spark, documents, folder)).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id", F.coalesce(held_out(0, 5), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits",
    )


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS full_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = full_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> full_id THEN full_id END AS refers_to, true AS valid FROM m
""")
def op8_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    place = warc.archive_folder(spark)
    manifest = warc.write_archives(warc.plan_records(table(spark, folder, "pages")), place)
    return warc.read_archives(spark, manifest, place).drop("url")


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (WITH RECURSIVE t AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT t.x, u.b FROM t JOIN u ON t.y = u.a) SELECT x, min(y) AS component_id FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query()
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    known = documents.filter(F.coalesce(~held_out(1, 3), F.lit(True)) & F.col("lang").isNotNull())
    model = langid.calibrate(langid.collect_model(langid.learn(known)), known)
    found = langid.identify(documents, model, reject=False).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out(1, 3), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "rejected")


@query()
def op5_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_lines.fuzzy_lines(table(spark, folder, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "keep_id": "keep_doc_id"})


def mail(conversations: DataFrame) -> DataFrame:
    """The turns as messages, each quoting the two before it at two levels; every other one replies below the quote."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    before, older = F.lag("text", 1).over(turns), F.lag("text", 2).over(turns)

    def quote(text: Column) -> Column:
        return F.regexp_replace(text, "(?m)^", "> ")

    block = F.concat_ws("\n", before, quote(older))
    quoted = F.concat(F.lit("They wrote:\n"), quote(block))
    text = (
        F.when(before.isNull(), F.col("text"))
        .when(F.col("turn") % 2 == 0, F.concat_ws("\n\n", "text", quoted))
        .otherwise(F.concat_ws("\n\n", quoted, "text"))
    )
    return conversations.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("message_id"), text.alias("text"))


@query("""
WITH m AS (SELECT conv_id * 100000 + turn AS id, text, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS norm,
    row_number() OVER w AS k, lag(conv_id * 100000 + turn) OVER w AS p1, lag(conv_id * 100000 + turn, 2) OVER w AS p2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
o AS (SELECT norm, min(id) AS owner FROM m WHERE len(string_split(norm, ' ')) >= 4 GROUP BY norm),
e AS (SELECT m.id, m.text, (m.p1 IS NOT NULL)::BIGINT + (m.p2 IS NOT NULL)::BIGINT AS n_quotes,
    CASE WHEN o1.owner < m.id THEN o1.owner END AS q1, CASE WHEN o2.owner < m.id THEN o2.owner END AS q2
  FROM m LEFT JOIN m m1 ON m1.id = m.p1 LEFT JOIN o o1 ON o1.norm = m1.norm LEFT JOIN m m2 ON m2.id = m.p2 LEFT JOIN o o2 ON o2.norm = m2.norm),
l AS (SELECT id, text, n_quotes, coalesce(q1, q2) AS parent_id, (q1 IS NOT NULL)::BIGINT + (q2 IS NOT NULL)::BIGINT AS n_linked FROM e),
t AS (WITH RECURSIVE r AS (SELECT id, id AS up, 0 AS depth FROM l UNION ALL SELECT r.id, l.parent_id, depth + 1 FROM r JOIN l ON l.id = r.up WHERE l.parent_id IS NOT NULL)
  SELECT id, arg_max(up, depth) AS thread_id, max(depth) AS depth FROM r GROUP BY id)
SELECT id AS message_id, parent_id, thread_id, depth, n_quotes, n_linked, md5(trim(text)) AS own_md5 FROM l JOIN t USING (id)
""")
def op9_quote_threads(spark: SparkSession, folder: str) -> DataFrame:
    found = quotes.link_quotes(mail(table(spark, folder, "conversations")), id_col="message_id")
    return found.withColumnRenamed("id", "message_id").withColumn("own_md5", F.md5("own_text")).drop("own_text")


@query()
def op11_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return vantage.simhash_duplicates(table(spark, folder, "documents"), width=3, distance=3).withColumnRenamed("id", "doc_id")


def shared_openings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of which the first turns are replaced by those of the first one of their hundred; and all ids."""
    placed = cut_lineage(prefix_trie.place_turns(conversations))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    columns = ["conv_id", "part", "pos", "d1", "d2", "size"]
    own = placed.filter(F.col("pos") > h).withColumn("part", F.lit(1)).select(*columns)
    heads = placed.filter("conv_id % 100 = 0 and pos <= 5").withColumnRenamed("conv_id", "base")
    ids = conversations.select(F.col("conv_id").cast("bigint")).filter("conv_id is not null").distinct()
    opened = ids.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base").filter(F.col("pos") <= h)
    return own.unionByName(opened.withColumn("part", F.lit(0)).select(*columns)), ids


_CRC_STEP = "xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda y: [unicode(y)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))), lambda c, x: {_CRC_STEP}), 4294967295::UBIGINT)"""


@query(f"""
WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[1:30]) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS MATERIALIZED (SELECT conv_id, ({_CRC} % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT conv_id, 1 AS part, pos, role, text FROM o JOIN i USING (conv_id) WHERE pos > h
  UNION ALL SELECT i.conv_id, 0, pos, role, text FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 100 WHERE pos <= h),
n AS (SELECT conv_id, row_number() OVER w AS depth, text, list({{'r': role, 't': text}}) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS MATERIALIZED (SELECT conv_id, depth, text, md5(path::VARCHAR) AS k FROM n UNION ALL SELECT conv_id, 0, '', '' FROM i),
t AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS own FROM p GROUP BY depth, k),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY depth, k),
u AS (SELECT c.depth, c.k, q.k AS parent_k, f.conv_id AS parent FROM t c JOIN p q ON q.conv_id = c.conv_id AND q.depth = c.depth - 1 JOIN t f ON f.depth = q.depth AND f.k = q.k),
c AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n FROM u GROUP BY ALL),
s AS (SELECT a.depth, a.k, sum(b.own) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM t b LEFT JOIN c ON c.depth = b.depth AND c.k = b.k JOIN p a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.depth, a.k)
SELECT t.conv_id, t.depth::BIGINT AS depth, u.parent AS parent_conv_id, t.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM t LEFT JOIN u USING (depth, k) LEFT JOIN c USING (depth, k) LEFT JOIN e USING (depth, k) JOIN s USING (depth, k)
""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, members = shared_openings(table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(turns, members, ["part", "pos"]).drop("enter", "exit")


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Distances to all centroids, compared; one chain of steps a round."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v ORDER BY c LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, any_value(v.v) AS v, any_value(vec_id) AS vec_id, min({{'d':
              list_sum(list_transform(list_zip(v.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS m FROM v, c{i} GROUP BY r)"""
        )
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(u.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
              SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY d) AS v FROM (SELECT m.c AS c, d, sum(x) AS t, count(*) AS n FROM (
                SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY ALL) GROUP BY c) u USING (c))"""
        )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.c::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = m.c"""


@query(_cluster_sql())
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    assigned, found = centroids.cluster(table(spark, folder, "embeddings"))
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(found)]
    names = local_frame(spark, digests, "cluster int, centroid_sha256 string")  # one row a centroid
    return centroids.with_inertia(assigned).join(F.broadcast(names), "cluster").withColumnRenamed("id", "vec_id")
