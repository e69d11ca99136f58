"""The operators over their whole tables, each as the digest its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.llm import conversations, hyperminhash, language, mixing, negatives, packing, quality, sharding, suffixes, superkmers, tokens, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = superkmers.repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = tokens.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    out = tokens.decode(tokens.encode(table(spark, sf_dir, "documents"), definition), definition)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = tokens.tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), definition)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs.where(~language.held_out()))
    told = language.predict(docs.select("doc_id", "text"), profiles)
    return told.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


_QUALITY_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_id, w, i FROM (
    SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM base)
  )
), windows AS (
  SELECT row_id, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM words
  WINDOW p AS (PARTITION BY row_id ORDER BY i)
), repeated AS (
  SELECT row_id, i FROM windows WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY row_id, a, b, c) > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words
  FROM repeated CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id
), lines AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
), measured AS (
  SELECT doc_id,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (row_id) LEFT JOIN lines USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM measured
"""


@query("op9_quality_rules", _QUALITY_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.POLICIES["base"])).alias("base_failed"),
        quality.passes(quality.POLICIES[quality.CURRENT]).alias("kept"),
    )


@query("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_SITES_SQL = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"
_PATTERNS_SQL = "|".join(rule.text.strip("^") for rule in urls.PATTERNS)


@query("op3_url_filters", rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, row_number() OVER () AS row_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest
), sites AS (SELECT * FROM ({_SITES_SQL}) AS t(site, prefix, verdict)
), fits AS (
  SELECT row_id, arg_max(site || prefix, length(site || prefix)) AS rule, arg_max(verdict, length(site || prefix)) AS verdict
  FROM parts JOIN sites ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix)
  GROUP BY row_id
)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({_PATTERNS_SQL})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END
) AS verdict
FROM parts LEFT JOIN fits USING (row_id)
""")
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op8_embedding_near_dedup")
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_hard_negatives", """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    relabelled = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(relabelled, F.col("vec_id") % 100 == 0)


def _damaged(spoken: DataFrame) -> DataFrame:
    """Drop, empty, cut or repeat turns, or turn their role to user, by a checksum of conversation and turn."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    kind = F.col("kind")
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return spoken.withColumn("kind", F.crc32(name) % 20).where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    )


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mended = conversations.repair(_damaged(spoken))
    every = spoken.select("conv_id").distinct().withColumn("key", conversations.conversation_key(F.col("conv_id")))
    told = every.join(mended.conversations, "key", "left").join(conversations.digests(mended.turns), "key", "left")
    zero = F.lit(0).cast("long")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return told.select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


_MIX_SQL = rf"""
WITH named AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS sum,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), grouped AS (
  SELECT doc_id, source, sum, size, count(*) AS n FROM named GROUP BY ALL
), sizes AS (
  SELECT source, sum(size * n)::BIGINT AS source_size, sum(n)::BIGINT AS documents,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank
  FROM grouped GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(rank % 3 + 1)::INT] AS weight, 200 * source_size AS top FROM sizes
), shares AS (
  SELECT *, 150 * sum(source_size) OVER () - coalesce(sum(top) OVER w, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
    row_number() OVER (ORDER BY top / weight, rank) AS place
  FROM weighed WINDOW w AS (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT place, rest, open_weight FROM shares WHERE NOT top * open_weight < weight * rest ORDER BY place LIMIT 1
), sources AS (
  SELECT s.source, s.rank, s.source_size,
    CASE WHEN s.place >= l.place THEN (s.weight * l.rest)::DOUBLE / (100 * l.open_weight)::DOUBLE
      ELSE s.source_size::DOUBLE * 2 END AS target,
    greatest(1, ceil((s.source_size + s.documents) / {mixing.SHARD_WORDS}))::BIGINT AS shards
  FROM shares s, level l
), bundles AS (
  SELECT *, greatest(1, least({mixing._COPIES}, {mixing.SHARD_WORDS} // greatest(size, 1))) AS per FROM grouped
), dealt AS (
  SELECT doc_id, source, sum, size, per, n, unnest(range(0, ceil(n / per)::BIGINT)) AS bundle FROM bundles
), pieces AS (
  SELECT d.doc_id, d.source, d.size, least(per, n - bundle * per) AS copies, s.rank, s.source_size, s.target, s.shards,
    md5(concat_ws('|', '{mixing.SEED}', coalesce(d.doc_id::VARCHAR, ''), d.sum, bundle)) AS deal
  FROM dealt d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), placed AS (
  SELECT *, ('0x' || substr(deal, 1, 15))::BIGINT % shards AS shard FROM pieces
), cells AS (
  SELECT rank, shard, sum(size * copies)::BIGINT AS words,
    coalesce(max(target) * sum(size * copies)::BIGINT / nullif(max(source_size), 0), 0) AS claim
  FROM placed GROUP BY rank, shard
), seats AS (
  SELECT (150 * sum(source_size) + 50 * {mixing.BLOCK})::BIGINT // (100 * {mixing.BLOCK}) AS seats FROM sources
), bids AS (
  SELECT rank, shard, claim / (2 * k + 1) AS bid
  FROM (SELECT rank, shard, claim, unnest(range(0, (claim / {mixing.BLOCK})::BIGINT + 100)) AS k FROM cells)
), won AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY bid DESC, rank, shard) AS place FROM bids
  ), seats WHERE place <= seats GROUP BY rank, shard
), known AS (
  SELECT rank, shard, words, words // {mixing.BLOCK} AS full_blocks,
    least(coalesce(quota, 0) * {mixing.BLOCK}, 2 * words) AS wanted,
    ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', rank, shard)), 1, 15))::BIGINT AS turn
  FROM cells LEFT JOIN won USING (rank, shard)
), laid AS (
  SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY rank, shard ORDER BY deal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed
), copied AS (
  SELECT doc_id, source, size, source_size, target, rank, shard, row_number() OVER () AS row_id, low, low + size AS high
  FROM (SELECT *, start + unnest(range(0, copies::BIGINT)) * size AS low FROM laid)
), blocks AS (
  SELECT row_id, low, high, wanted % words - {mixing.BLOCK} * CASE WHEN j < full_blocks
      THEN (j * {mixing._PRIME} + turn % full_blocks) % full_blocks ELSE full_blocks END AS open_words, j
  FROM (
    SELECT *, unnest(range(low // {mixing.BLOCK}, (high - 1) // {mixing.BLOCK} + 1)) AS j
    FROM copied JOIN known USING (rank, shard) WHERE size > 0
  )
), extra AS (
  SELECT row_id, sum(greatest(0, least(high, j * {mixing.BLOCK} + greatest(0, least({mixing.BLOCK}, open_words)))
    - greatest(low, j * {mixing.BLOCK}))) AS words FROM blocks GROUP BY row_id
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE wanted // k.words * size + coalesce(extra.words, 0) END)::BIGINT AS taken
FROM copied JOIN known k USING (rank, shard) LEFT JOIN extra USING (row_id)
"""


@query("op11_mixing", _MIX_SQL)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
