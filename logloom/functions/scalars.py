"""Column functions for log lines, feature weights and latencies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of session keys, the mask of volatile tokens, header tokens before the message.
KEY = r"blk_-?\d+"
MASK = r"blk_-?\d+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b|\b0x[0-9a-fA-F]+\b|(?<![A-Za-z])-?\d+(?:\.\d+)?"
HEADER_TOKENS = {"hdfs": 4, "bgl": 9, "thunderbird": 8}
BUCKETS = 4096


def content(line: Column, header_tokens: int) -> Column:
    """The message after ``header_tokens`` tokens; '' if nothing follows them. Labels in the header never get further."""
    head = rf"^\s*(?:\S+\s+){{{header_tokens}}}"
    return F.when(line.rlike(head + r"\S"), F.regexp_replace(line, head, "")).otherwise(F.when(line.isNotNull(), F.lit("")))


def mask(text: Column) -> Column:
    """Block ids, addresses, hexadecimal and other numbers become <*>; white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MASK, "<*>"), r"\s+", " "))


def first_key(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, KEY, 0), F.lit(""))


def all_keys(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(KEY), F.lit(0)))


def log_time(line: Column) -> Column:
    """Seconds on the scale (day + 31 month + 372 year) * 86400 + second of the day, of a 'YYMMDD HHMMSS' prefix; null if malformed."""
    part = lambda at: F.substring(line, at, 2).try_cast("long")
    y, m, d, h, i, s = (part(k) for k in (1, 3, 5, 8, 10, 12))
    return (d + 31 * m + 372 * y) * 86400 + h * 3600 + i * 60 + s


def format_log_time(t: Column) -> Column:
    """The prefix that ``log_time`` reads. Day 31 comes out as day 0 of the next month: the scale cannot tell them apart."""
    days, sec = F.floor(t / 86400), F.pmod(t, F.lit(86400))
    rem = F.pmod(days, F.lit(372))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(*map(two, (F.floor(days / 372), F.floor(rem / 31), F.pmod(rem, F.lit(31)))), F.lit(" "), *map(two, (F.floor(sec / 3600), F.floor(F.pmod(sec, F.lit(3600)) / 60), F.pmod(sec, F.lit(60)))))


def time_or_watermark(line: Column, watermark: Column) -> Column:
    """A malformed time means no progress: the watermark so far, or 0."""
    return F.coalesce(log_time(line), watermark, F.lit(0))


def hash_bucket(text: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(text.cast("binary")) % buckets).cast("int")


def sublinear(count: Column) -> Column:
    return 1 + F.log(count)


def weight(count: Column, kind: str = "tfidf") -> Column:
    """Weighting of a positive count: tfidf (sublinear), plain, counts or binary."""
    return {"tfidf": sublinear(count), "plain": count.cast("double"), "counts": count.cast("double"), "binary": (count > 0).cast("double")}[kind]


def score_ratio(score: Column, threshold: Column) -> Column:
    """Score over threshold; the score itself where the threshold is null or 0."""
    return F.when(threshold.isNotNull() & (threshold != 0), score / threshold).otherwise(score)


def reword(term: Column, chosen: Column, suffix: str = " status=ok") -> Column:
    return F.when(chosen, F.concat(term, F.lit(suffix))).otherwise(term)


def second(ts_ns: Column) -> Column:
    return F.floor(ts_ns / 1_000_000_000)


def stage_ms(start_ns: Column, end_ns: Column) -> Column:
    """Milliseconds between two clocks, never below 0."""
    return F.greatest(F.lit(0.0), (end_ns - start_ns) / 1e6)


def is_live(alerted: Column, kind: Column, broker_ts: Column) -> Column:
    """Whether an alert was raised while its stream ran."""
    return alerted & (kind != "deadline_eos") & broker_ts.isNotNull()
