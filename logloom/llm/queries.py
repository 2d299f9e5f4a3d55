"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, brown, cdc, digest, mixing, phrases, pieces, simhash, suffix, token_counts, topk, toxicity
from .shared import WORD, crc_fold, cut, documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = cdc.dedupe(documents(spark, sf_dir).select("doc_id", "text"))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return deduped.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), size("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"), size("shared").alias("n_shared"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)
    return both.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(rows, lambda vec_id: F.col(vec_id) % 100 == 0)


# Ranks over whole tables: every hundredth vector against all others, in exact integers.
OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    mixed = mixing.mix(cut(sized), measured=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = crc_fold("doc_id", 10) == 0
    model, counts = brown.fit(docs.filter(~held))
    scored = brown.score(docs, model, counts)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_fold("doc_id", 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir)).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text after three edits that follow from it: a deletion, its beginning put into its middle, a piece in capitals near its end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, cut, put: F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), put.alias("put"))
    edits = F.array(edit(F.floor(n / 3), 17, F.lit("")), edit(F.floor(n / 2), 0, F.substring("text", 1, 40)), edit(n - 30, 10, F.upper(F.substring("text", F.floor(n / 4).cast("int"), F.lit(12)))))
    docs = documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))
    done = token_counts.build_and_apply(docs, TOKENIZER)
    return done.select("doc_id", "n_tokens_before", "n_tokens", "n_words", "n_reencoded", F.sha2("edited", 256).alias("edited_sha256"))


def op9_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumns({"n_chars": F.length("text").cast("long"), "tie": F.xxhash64("text"), "fingerprint": digest.fingerprint(digest.canonical(F.col("text")))})
    led = digest.with_next(rows, ["text", "fingerprint"], "doc_id", "tie")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    named = led.withColumn("edited", edited).withColumn("edited_fingerprint", digest.fingerprint(digest.canonical(F.col("edited"))))
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    out = named.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))
    known = digest.classes(docs).withColumnsRenamed({"doc_id": "id", "fingerprint": "print"})
    joined = out.join(known, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fingerprint") == F.col("print")), "left")
    return joined.select(*out.columns, "class_id", "copies")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.round_trip(documents(spark, sf_dir).select("doc_id", "text"), PIECES)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(pieces.decimal(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = alignment.index(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER, PIECES)
    scored = alignment.scores(indexed, alignment.pairs(indexed))
    return scored.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir).select("text", "lang"))


# All phrases of one to three words, counted by language, in whole numbers of 128 bits.
OP13_SQL = """
WITH p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents)
), g AS MATERIALIZED (
  SELECT lang, k, phrase, lang || chr(9) || phrase AS key, count(*) AS c FROM (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p
  ) GROUP BY ALL
), c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND c >= 10),
x AS (
  SELECT c.lang, c.phrase, c.a, 1 AS k1, l.c AS l, r.c AS r FROM c
  JOIN g l ON l.key = c.lang || chr(9) || c.w[1] JOIN g r ON r.key = c.lang || chr(9) || array_to_string(c.w[2:], ' ')
  UNION ALL SELECT c.lang, c.phrase, c.a, 2, l.c, r.c FROM c
  JOIN g l ON l.key = c.lang || chr(9) || array_to_string(c.w[:2], ' ') JOIN g r ON r.key = c.lang || chr(9) || c.w[3] WHERE c.k = 3
), s AS (SELECT *, 1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS score FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) AS best FROM s),
d AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM b LEFT JOIN d ON d.lang = b.lang AND d.part = b.phrase WHERE best = 1 AND (most IS NULL OR 100 * most < 50 * a)
)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_cdc": op1_cdc, "op2_bpe": op2_bpe, "op3_topk": op3_topk, "op4_mixing": op4_mixing, "op5_brown": op5_brown, "op6_toxicity": op6_toxicity, "op7_simhash": op7_simhash, "op8_token_counts": op8_token_counts, "op9_digest": op9_digest, "op10_suffix": op10_suffix, "op11_pieces": op11_pieces, "op12_alignment": op12_alignment, "op13_phrases": op13_phrases}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op13_phrases": OP13_SQL}
