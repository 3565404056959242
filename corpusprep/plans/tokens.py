"""Queries of the vocabulary, encoding and decoding operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import tokens as K
from corpusprep.operators import encode, vocab
from corpusprep.plans import duck
from corpusprep.plans.fixtures import configs, ctes
from corpusprep.plans.records import _HEADER_SQL, _PAIRS, _rendered, corpus_messages, corpus_union
from corpusprep.plans.registry import Tables, query
from corpusprep.session import cut_lineage

# Merges of the queries whose SQL spells them out, and of those over the merged corpus.
N_MERGES, CORPUS_MERGES = 12, 2000


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


@query(
    f"""SELECT doc_id, len(ids) AS n_tokens, array_to_string(ids, ' ') AS ids
      FROM (SELECT doc_id, {duck.byte_list("text")} AS ids FROM documents)"""
)
def encode_bytes(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select(
        "doc_id", K.byte_token_count(text).alias("n_tokens"), joined(K.byte_ids(text)).alias("ids")
    )


@query(
    f"""{_PAIRS}, rendered AS ({_HEADER_SQL})
    SELECT conv_id, len(ids) AS n_tokens, array_to_string(ids, ' ') AS ids
    FROM (SELECT conv_id, {duck.byte_list("example")} AS ids FROM rendered)"""
)
def encode_chat_bytes(t: Tables) -> DataFrame:
    example = F.col("example")
    return _rendered(t, "header").select(
        "conv_id",
        K.byte_token_count(example).alias("n_tokens"),
        joined(K.byte_ids(example)).alias("ids"),
    )


# Words as the counts see them.
_NORMAL = "trim(regexp_replace({}, ' {{2,}}', ' ', 'g'), ' ')"
_WORDS = rf"""WITH lines AS (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents),
  found AS (SELECT unnest(regexp_extract_all(replace({_NORMAL.format("line")}, ' ', '▁'), '▁?[^▁]+|▁')) AS word FROM lines),
  counts AS (SELECT word, count(*) AS n FROM found GROUP BY word)"""


@query(_WORDS + " SELECT * FROM counts")
def word_counts(t: Tables) -> DataFrame:
    return vocab.word_counts(t.documents)


_PAIR_COUNTS = """SELECT p.l AS "left", p.r AS "right", cast(sum(n) AS bigint) AS n FROM (
    SELECT n, unnest(list_transform(range(1, len(c)), lambda i: {'l': unicode(c[i]), 'r': unicode(c[i + 1])})) AS p
    FROM (SELECT string_split(word, '') AS c, n FROM counts)) GROUP BY ALL"""


@query(f"{_WORDS} {_PAIR_COUNTS}")
def pair_counts(t: Tables) -> DataFrame:
    return vocab.pair_counts(vocab.symbol_strings(vocab.word_counts(t.documents)))


def _merge_steps(n: int) -> str:
    """Textbook merging, one pair a step, over strings of ``,piece;`` symbols."""
    steps = [
        """s0 AS (SELECT word, n, array_to_string(list_transform(string_split(word, ''),
          lambda c: ',' || c || ';'), '') AS s FROM counts WHERE NOT regexp_matches(word, '[,;]')
          UNION ALL SELECT word, n, array_to_string(list_transform(string_split(word, ''),
          lambda c: ',' || CASE c WHEN ',' THEN chr(1) WHEN ';' THEN chr(2) ELSE c END || ';'), '')
          FROM counts WHERE regexp_matches(word, '[,;]'))"""
    ]
    for i in range(n):
        steps.append(
            f"""b{i} AS (SELECT p.l AS l, p.r AS r, sum(n) AS n FROM (
              SELECT n, unnest(list_transform(range(1, len(c)), lambda i: {{'l': c[i], 'r': c[i + 1]}})) AS p
              FROM (SELECT n, regexp_extract_all(s, ',([^;]+);', 1) AS c FROM s{i}))
              GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 1)"""
        )
        steps.append(
            f"""s{i + 1} AS (SELECT word, s{i}.n, replace(s, ',' || l || ';,' || r || ';', ',' || l || r || ';') AS s
              FROM s{i}, b{i})"""
        )
    return ", ".join(steps)


def _plain(x: str) -> str:
    return f"replace(replace({x}, chr(1), ','), chr(2), ';')"


_MERGED = f"{_WORDS}, {_merge_steps(N_MERGES)}, merges AS (" + " UNION ALL ".join(
    f"SELECT cast({i} AS integer) AS rank, {_plain('l')} AS \"left\", {_plain('r')} AS \"right\", "
    f"cast(n AS bigint) AS n FROM b{i}"
    for i in range(N_MERGES)
) + ")"


@query(_MERGED + " SELECT * FROM merges")
def bpe_merges(t: Tables) -> DataFrame:
    counts = vocab.word_counts(t.documents)
    merges = vocab.learn_merges(counts, N_MERGES)
    return vocab.local_frame(t.spark, merges, vocab.MERGES_SCHEMA)


# --- encoding with characters only, and with the learned merges ---------------


def _learned(texts: DataFrame, n_merges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary with exactly `n_merges` merged pieces asked for, the merges, and the word counts of the texts."""
    counts = cut_lineage(vocab.word_counts(texts))
    size = K.FIRST_LEARNED + vocab.char_counts(counts).count() + n_merges
    return *vocab.train_on_words(counts, size), counts


def _vocab(t: Tables, n_merges: int) -> DataFrame:
    return _learned(t.documents, n_merges)[0]


def _vocab_sql(n_merges: int, merged: str) -> str:
    return f"""chars AS (SELECT c, cast({K.FIRST_LEARNED + n_merges} - 1 + row_number() OVER (ORDER BY sum(n) DESC, c) AS integer) AS id
      FROM (SELECT unnest(string_split(word, '')) AS c, n FROM counts) GROUP BY c),
    vocab AS (SELECT c AS piece, id FROM chars {merged})"""


def _encode_sql(state: str) -> str:
    """Ids of every document: pieces by lookup, other characters by bytes."""
    return f"""normal AS (SELECT doc_id, replace({_NORMAL.format("text")}, ' ', '▁') AS t FROM documents),
    dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS wi FROM (
      SELECT doc_id, regexp_extract_all(t, '▁?[^▁]+|▁') AS w FROM normal)),
    dp AS (SELECT doc_id, wi, unnest(p) AS piece, generate_subscripts(p, 1) AS pi FROM (
      SELECT doc_id, wi, {state} AS p FROM dw)),
    di AS (SELECT doc_id, wi, pi, CASE WHEN vocab.id IS NULL
        THEN list_transform(regexp_extract_all(hex(encode(dp.piece)), '..'), lambda h: cast('0x' || h AS integer) + {K.FIRST_BYTE})
        ELSE [vocab.id] END AS ids FROM dp LEFT JOIN vocab ON dp.piece = vocab.piece),
    encoded AS (SELECT doc_id, list_concat([1], flatten(list(ids ORDER BY wi, pi)), [2]) AS ids FROM di GROUP BY doc_id)
    SELECT doc_id, len(ids) AS n_tokens, array_to_string(ids, ' ') AS ids FROM encoded"""


def _encoded(t: Tables, n_merges: int) -> DataFrame:
    pieces, _, counts = _learned(t.documents, n_merges)
    ids = encode.bpe_ids(pieces, encode.word_table(counts, pieces))(F.col("text"))
    coded = t.documents.select("doc_id", ids.alias("ids"))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), joined(F.col("ids")).alias("ids")
    )


@query(f"""{_WORDS}, {_vocab_sql(0, "")}, {_encode_sql("string_split(word, '')")}""")
def encode_words(t: Tables) -> DataFrame:
    return _encoded(t, 0)


def _apply_merges(n: int) -> str:
    """The learned merges applied in order to the characters of a word."""
    marked = (
        "array_to_string(list_transform(string_split(word, ''), lambda c: ',' || "
        "CASE c WHEN ',' THEN chr(1) WHEN ';' THEN chr(2) ELSE c END || ';'), '')"
    )
    for i in range(n):
        marked = (
            f"replace({marked}, (SELECT ',' || l || ';,' || r || ';' FROM b{i}), "
            f"(SELECT ',' || l || r || ';' FROM b{i}))"
        )
    return (
        f"list_transform(regexp_extract_all({marked}, ',([^;]+);', 1), lambda p: {_plain('p')})"
    )


_PIECES = f"UNION ALL SELECT \"left\" || \"right\", cast({K.FIRST_LEARNED} + rank AS integer) FROM merges"


@query(f"{_MERGED}, {_vocab_sql(N_MERGES, _PIECES)}, {_encode_sql(_apply_merges(N_MERGES))}")
def encode_bpe(t: Tables) -> DataFrame:
    return _encoded(t, N_MERGES)


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS text FROM documents")
def decode_roundtrip(t: Tables) -> DataFrame:
    pieces, _, counts = _learned(t.documents, N_MERGES)
    ids = encode.bpe_ids(pieces, encode.word_table(counts, pieces))(F.col("text"))
    return t.documents.select("doc_id", encode.bpe_text(pieces)(ids).alias("text"))


# --- a vocabulary of the merged corpus ----------------------------------------


def merged_corpus(t: Tables) -> DataFrame:
    """Text lines, record fields and chat messages, in one column ``text``."""
    return corpus_union(t).select("text").unionByName(corpus_messages(t).select("text"))


def corpus_vocab(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary, merges and encoded head words of the merged corpus."""
    pieces, merges, counts = _learned(merged_corpus(t), CORPUS_MERGES)
    return pieces, merges, encode.word_table(counts, pieces)


@query()
def bpe_merges_corpus(t: Tables) -> DataFrame:
    """Two thousand merges of the merged corpus; too many for SQL."""
    return _learned(merged_corpus(t), CORPUS_MERGES)[1]


@query()
def encode_bpe_corpus(t: Tables) -> DataFrame:
    """The documents with the vocabulary of the merged corpus."""
    pieces, _, words = corpus_vocab(t)
    coded = t.documents.select("doc_id", encode.bpe_ids(pieces, words)(F.col("text")).alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), joined(F.col("ids")).alias("ids"))


# --- reserved pieces and their use ------------------------------------------

_BASE = f"""base AS (
    SELECT 0 AS id, '<unk>' AS piece, 'unknown' AS kind UNION ALL SELECT 1, '<s>', 'control'
    UNION ALL SELECT 2, '</s>', 'control'
    UNION ALL SELECT 2 + generate_subscripts(m, 1), unnest(m), 'marker' FROM (SELECT
      ['<|begin_of_text|>', '<|end_of_text|>', '<|start_header_id|>', '<|end_header_id|>', '<|eot_id|>'] AS m)
    UNION ALL SELECT b + 8, '<0x' || printf('%02X', b) || '>', 'byte' FROM (SELECT unnest(range(256)) AS b)),
  used AS (SELECT id, count(*) AS n FROM (SELECT unnest({duck.byte_list("text")}) AS id FROM documents) GROUP BY id)"""


def _document_tokens(t: Tables) -> DataFrame:
    return t.documents.select(F.explode_outer(K.byte_ids(F.col("text"))).alias("token"))


@query(
    f"""WITH {_BASE} SELECT cast(id AS integer) AS id, piece, kind, coalesce(n, 0) AS n FROM base LEFT JOIN used USING (id)"""
)
def base_vocab(t: Tables) -> DataFrame:
    """All reserved pieces with their use in the documents."""
    return encode.token_lookup(_document_tokens(t), vocab.base_vocab(t.spark))


@query(
    f"""WITH {_BASE} SELECT kind, count(*) AS pieces, cast(sum(n) AS bigint) AS tokens
      FROM base JOIN used USING (id) GROUP BY kind"""
)
def token_lookup(t: Tables) -> DataFrame:
    """Tokens of the documents by kind of piece."""
    used = encode.token_lookup(_document_tokens(t), vocab.base_vocab(t.spark))
    return (
        used.filter("n > 0")
        .groupBy("kind")
        .agg(F.count("*").alias("pieces"), F.sum("n").alias("tokens"))
    )


@query(
    f"""{_PAIRS}, chat AS (SELECT count(*) AS n FROM pairs WHERE "user" IS NOT NULL AND assistant IS NOT NULL),
    docs AS (SELECT count(*) AS n FROM documents WHERE text LIKE '%<|eot_id|>%')
    SELECT 'conversations' AS source, CASE WHEN n > 0 THEN '2 7' ELSE '2' END AS stop_ids FROM chat
    UNION ALL SELECT 'documents', CASE WHEN n > 0 THEN '2 7' ELSE '2' END FROM docs"""
)
def stop_ids(t: Tables) -> DataFrame:
    """Stop ids of the vocabulary that each table uses."""
    base = vocab.base_vocab(t.spark)
    chat = _rendered(t, "header").select(F.explode_outer(K.byte_ids(F.col("example"))).alias("token"))

    def stops(source: str, tokens: DataFrame) -> DataFrame:
        used = encode.token_lookup(tokens, base).filter("n > 0")
        ids = joined(F.col("stop_ids")).alias("stop_ids")
        return vocab.stop_ids(used).select(F.lit(source).alias("source"), ids)

    return stops("conversations", chat).unionByName(stops("documents", _document_tokens(t)))


@query(
    f"""{ctes(configs=None)}, {_WORDS[5:]}, size AS (SELECT cast({K.FIRST_LEARNED} + count(DISTINCT c) AS bigint) AS pieces
      FROM (SELECT unnest(string_split(word, '')) AS c FROM counts))
    SELECT model, vocab_size, pieces FROM configs, size WHERE vocab_size <> pieces"""
)
def vocab_check(t: Tables) -> DataFrame:
    """Configs made for another vocabulary than that of the documents' characters."""
    return vocab.check_vocab(configs(t).select("model", "vocab_size"), _vocab(t, 0))
