"""A training-text pipeline: toxicity, near duplicates, repeated substrings, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of ``documents`` for all but the last. Null
texts are never toxic, count as empty texts and never enter the mix. An empty table passes through. Columns besides those of ``documents`` are dropped.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, cdc, jaccard, mixing, toxicity
from logloom.llm.queries import TOKENIZER
from logloom.llm.shared import cut, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle; near duplicates share four fifths of their shingles or more.
WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model learned from all labels; the labels themselves decide nothing."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, score_col="_score").filter("_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (a null id comes first); of repeated rows one stays."""
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64(*COLUMNS).alias("hash")).alias("_row"))
    grouped = cut(jaccard.groups(keyed, WORDS, id_col="_row"))
    lost = grouped.filter("_row != component_id").select("_row").distinct()
    repeated = grouped.groupBy("_row").count().filter("count > 1").select("_row")
    gone = lost.union(repeated)
    once = keyed.join(gone, "_row", "left_anti").select(*COLUMNS)
    again = keyed.join(repeated.join(lost, "_row", "left_anti"), "_row", "left_semi").dropDuplicates(["_row"])
    return once.union(again.select(*COLUMNS))


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of chunks that an earlier place has."""
    deduped = cdc.dedupe(docs.select(*COLUMNS))
    return deduped.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, none to two times, shuffled in their shards."""
    return mixing.shards(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    done = bpe.checked(docs.select("doc_id", "source", "text"), TOKENIZER)
    return done.select("doc_id", "source", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_substrings", drop_repeated_substrings),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]

#: No stage but the first filter could be SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
