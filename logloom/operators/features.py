"""Vocabulary, counts and TF-IDF as long tables (session_id, term or col, count)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import with_rank

UNK = 0


def message_counts(rows: DataFrame, header_tokens: int) -> DataFrame:
    """(session_id, term, first_line, cnt): messages are masked where they are read and counted there, so that no message is shuffled."""
    term = S.mask(S.content(F.col("line"), header_tokens)).alias("term")
    return rows.groupBy("session_id", term).agg(F.count("*").alias("cnt"), F.min("line_id").alias("first_line"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, term_id from 0 by first appearance)."""
    firsts = counts.groupBy("term").agg(F.min("first_line").alias("first_line"))
    return with_rank(firsts, F.col("first_line"), F.col("term"), rank="term_id").select("term", "term_id")


def bucket_counts(rows: DataFrame, header_tokens: int) -> DataFrame:
    """(session_id, bucket, cnt): unmasked messages in hash buckets."""
    return rows.groupBy("session_id", S.hash_bucket(S.content(F.col("line"), header_tokens)).alias("bucket")).agg(F.count("*").alias("cnt"))


def train_frequency(counts: DataFrame, sessions: DataFrame) -> DataFrame:
    """(term, freq) over the sessions whose split is train."""
    train = sessions.filter("split = 'train'").select("session_id")
    return counts.join(train, "session_id", "left_semi").groupBy("term").agg(F.sum("cnt").alias("freq"))


def top_terms(freq: DataFrame, vocab: DataFrame, k: int = 5000) -> DataFrame:
    """(term, col from 1): the k most frequent train terms, ties by first appearance; every other term is column 0."""
    best = freq.filter("freq > 0").join(vocab, "term").orderBy(F.desc("freq"), "term_id").limit(k)
    return best.withColumn("col", F.row_number().over(Window.orderBy(F.desc("freq"), "term_id"))).select("term", "col")  # k rows at most


def to_columns(counts: DataFrame, columns: DataFrame) -> DataFrame:
    """(session_id, col, cnt): counts by feature column, unknown terms in column 0."""
    return counts.join(columns, "term", "left").groupBy("session_id", F.coalesce("col", F.lit(UNK)).alias("col")).agg(F.sum("cnt").alias("cnt"))


def fit_idf(counts: DataFrame, sessions: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(col, idf): ln((1 + n) / (1 + df)) + 1 over train sessions; columns that no train session has count with df 0."""
    train = sessions.filter("split = 'train'").select("session_id")
    n = train.agg(F.count("*").alias("n"))
    df = counts.join(train, "session_id", "left_semi").filter("cnt > 0").groupBy("col").agg(F.count("*").alias("df"))
    if columns is not None:
        every = columns.select("col").union(columns.sparkSession.range(1).select(F.lit(UNK).alias("col"))).distinct()
        df = every.join(df, "col", "left").select("col", F.coalesce("df", F.lit(0)).alias("df"))
    return df.crossJoin(n).select("col", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n: one row


def tfidf(counts: DataFrame, idf: DataFrame, kind: str = "tfidf") -> DataFrame:
    """(session_id, col, w): weighted counts times idf, each session of length 1; an empty session has no rows."""
    raw = counts.filter("cnt > 0").join(idf, "col").withColumn("w", S.weight(F.col("cnt"), kind) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("session_id")))
    return raw.select("session_id", "col", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))


def vectors(counts: DataFrame, idf: DataFrame, kind: str = "tfidf") -> DataFrame:
    """(session_id, col, w): tfidf and plain as ``tfidf``; counts and binary as they are, without idf and length."""
    if kind in ("tfidf", "plain"):
        return tfidf(counts, idf, kind)
    return counts.filter("cnt > 0").select("session_id", "col", S.weight(F.col("cnt"), kind).alias("w"))


def snapshot_counts(seq: DataFrame, age: int) -> DataFrame:
    """(session_id, col, cnt) of the lines up to ``age`` seconds after a session's first."""
    return seq.filter(F.col("dt") <= age).groupBy("session_id", "col").agg(F.count("*").alias("cnt"))


def prefix_counts(seq: DataFrame, longest: int = 64) -> DataFrame:
    """(session_id, pos, dt, col, cnt): the counts of each column that a line has, after each of the first lines."""
    order = Window.partitionBy("session_id", "col").orderBy("pos")
    return first_lines(seq, longest).select("session_id", "pos", "dt", "col", F.row_number().over(order).alias("cnt"))


def first_lines(seq: DataFrame, longest: int = 64) -> DataFrame:
    return seq.filter(F.col("pos") < longest)
