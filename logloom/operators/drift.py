"""Drift: reworded terms, chunks in time, unknown share, chunk metrics, and penalties against a control."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import metrics
from .ranking import Scan, with_rank


def drift_map(vocab: DataFrame, share: DataFrame, k: int, suffix: str = " status=ok") -> DataFrame:
    """(term, term_after, share, drifted): the k terms with the largest share of lines are reworded after the drift; totals stay."""
    top = share.join(vocab, "term").orderBy(F.desc("share"), "term_id").limit(k).select("term", F.lit(True).alias("drifted"))
    out = vocab.join(share, "term", "left").join(F.broadcast(top), "term", "left")  # k rows at most
    drifted = F.coalesce("drifted", F.lit(False))
    return out.select("term", S.reword(F.col("term"), drifted, suffix).alias("term_after"), F.coalesce("share", F.lit(0.0)).alias("share"), drifted.alias("drifted"))


def apply_drift(counts: DataFrame, mapping: DataFrame, chunks: DataFrame, drift_at: int) -> DataFrame:
    """``counts`` (session_id, term, cnt) with terms as they read in the session's chunk."""
    joined = counts.join(mapping.select("term", "term_after"), "term", "left").join(chunks.select("session_id", "chunk"), "session_id")
    term = F.when(F.col("chunk") >= drift_at, F.coalesce("term_after", "term")).otherwise(F.col("term"))
    return joined.withColumn("term", term).groupBy("session_id", "term").agg(F.sum("cnt").alias("cnt"))


def chunks(sessions: DataFrame, n: int = 10) -> DataFrame:
    """``sessions`` with chunk from 0, in order of (ts, session_id): the first chunks get one more if they cannot be equal."""
    ranked = with_rank(sessions, F.col("ts"), F.col("session_id"), rank="_rank", total="_n")
    base, more = F.floor(F.col("_n") / n), F.pmod("_n", F.lit(n))
    large = more * (base + 1)
    chunk = F.when(F.col("_rank") < large, F.floor(F.col("_rank") / (base + 1))).otherwise(more + F.floor((F.col("_rank") - large) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("chunk", chunk.cast("int")).drop("_rank", "_n")


def unknown_share(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and unk_share: lines in column 0 of all lines, 0 without lines."""
    all_, unk = F.sum("cnt"), F.sum(F.when(F.col("col") == 0, F.col("cnt")).otherwise(0))
    return counts.groupBy(*by).agg(F.when(all_ > 0, unk / all_).otherwise(0.0).alias("unk_share"))


def chunk_metrics(scores: DataFrame, threshold: float) -> DataFrame:
    """(chunk, tp .. f1, fpr, alert_rate, roc_auc) of rows (chunk, s, y) at a threshold; tied scores count half."""
    base = metrics.confusion(scores, F.col("s") >= threshold, by=["chunk"])
    n = F.col("fp") + F.col("tn")
    rated = base.withColumns({"fpr": F.when(n > 0, F.col("fp") / n).otherwise(0.0), "alert_rate": (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    grouped = scores.groupBy("chunk", "s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("all")).withColumn("neg", F.col("all") - F.col("pos"))
    ranked = Scan(grouped, ["chunk"], ["s"]).running(_upto=("sum", "neg")).done()
    area = ranked.groupBy("chunk").agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum(F.col("pos") * (F.col("_upto") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).otherwise(float("nan")).alias("roc_auc"))
    return rated.join(area, "chunk")


def penalty(metrics_: DataFrame, control: str, drift_at: int, value: str = "f1") -> DataFrame:
    """(arm, condition, penalty): mean of the control's value less the condition's, over the chunks from the drift on."""
    after = metrics_.filter(F.col("chunk") >= drift_at)
    base = after.filter(F.col("condition") == control).select("arm", "chunk", F.col(value).alias("_base"))
    other = after.filter(F.col("condition") != control).join(base, ["arm", "chunk"])
    return other.groupBy("arm", "condition").agg(F.avg(F.col("_base") - F.col(value)).alias("penalty"))
