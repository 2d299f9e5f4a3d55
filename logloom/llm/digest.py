"""Exact document fingerprints: a wide digest of the canonical text; DataFrame functions only.

Canonical means: Unicode compatibility composition (NFKC) before and after full case folding, runs of white space as one space,
none at the ends. White space is U+0009-000D, U+001C-0020, U+0085 and the separators of Unicode's category Z. The
fingerprint is four 64-bit xxhash values of the canonical text under different prefixes, 64 hexadecimal digits. Rows of equal
fingerprint are grouped with their canonical text, so that bytes decide; only texts whose fingerprint is not alone are
shuffled for that. As the digest is exact, two fingerprints are alike (1.0) or not (0.0).

A null text counts as empty. Null ids sort last; neighbours with equal ids are ordered by their text's hash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free

#: Rows of a range of ids in which neighbours are sought at once, and the most quantiles that ids are cut at.
RANGE_ROWS, COARSE = 2000, 1000
FILTER_BITS = 1 << 22


def canonical(text: Column) -> Column:
    """ICU's composition and case folding, which Spark ships for collations, then white space."""
    icu = lambda name, method, x: F.call_function("java_method", F.lit(f"com.ibm.icu.{name}"), F.lit(method), x, F.lit(True))
    compose = lambda x: icu("text.Normalizer", "compose", x)
    folded = compose(icu("lang.UCharacter", "foldCase", compose(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"[\s\x1C-\x1F\x85\p{Z}]+", " "))


def fingerprint(canonical_text: Column) -> Column:
    lanes = F.transform(F.array(canonical_text), lambda t: F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(lane), t)), 16, "0") for lane in range(4)]))
    return F.lower(F.element_at(lanes, 1))  # through an array, so that the text is made once


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, fingerprint, class_id, copies LONG), distinct: the smallest id and the number of rows with the same canonical bytes."""
    marked = docs.select(id_col, canonical(F.col(text_col)).alias("canonical")).withColumn("fingerprint", fingerprint(F.col("canonical")))
    prints = cut(marked.select(id_col, "fingerprint"))
    lane = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long")
    many = cut(prints.groupBy(lane.alias("lane")).count().filter("count > 1").select("lane"))
    # A filter of fixed size lets only texts through that may not be alone, so that no others are shuffled.
    texts = marked.filter(_held(lane, _filter(many)))
    # Grouping by the text itself compares bytes; a digest of another kind then stands for it.
    equal = texts.groupBy("fingerprint", "canonical").agg(F.min(id_col).alias("class_id"), F.count("*").alias("copies"))
    equal = equal.select("fingerprint", F.sha2("canonical", 256).alias("check"), "class_id", "copies")
    grouped = texts.select(id_col, "fingerprint", F.sha2("canonical", 256).alias("check")).join(equal, ["fingerprint", "check"]).select(id_col, "fingerprint", "class_id", "copies").distinct()
    alone = prints.join(grouped.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return grouped.union(alone.select(id_col, "fingerprint", F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("copies")))


def _filter(lanes: DataFrame) -> DataFrame:
    """One row with an array of ``FILTER_BITS`` bits, set where a lane's remainder is."""
    bit = F.pmod("lane", F.lit(FILTER_BITS))
    words = lanes.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(lane, {FILTER_BITS}) % 64 as int))")).alias("bits"))
    every = lanes.sparkSession.range(FILTER_BITS // 64).join(words, F.col("id") == F.col("word"), "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("x")).select("x.bits")


def _held(lane: Column, bits: DataFrame) -> Column:
    at = F.pmod(lane, F.lit(FILTER_BITS))
    word = F.element_at(bits.scalar(), (F.floor(at / 64) + 1).cast("int"))
    return F.call_function("getbit", word, (at % 64).cast("int")) == 1


def with_next(rows: DataFrame, columns: list[str], id_col: str, tie_col: str) -> DataFrame:
    """``rows`` with next_<column> for ``columns`` of the next row by descending id; after the last comes the first.

    Ids are cut into ranges by quantiles and, between two of these, into even steps, about ``RANGE_ROWS`` rows each. The first
    row of a range is also sent to the range before it, so that rows are shuffled once, by range.
    """
    range_col, guest_col = free("_range", rows.columns), free("_guest", rows.columns)
    n = rows.count()
    coarse = max(1, min(COARSE, n // RANGE_ROWS))
    marks = rows.select(F.percentile_approx(id_col, [k / coarse for k in range(coarse + 1)], 100_000)).first()[0] or [0]
    bounds, steps = sorted(set(marks)), max(1, n // coarse // RANGE_ROWS)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(id_col)))
    low, high = (F.element_at(F.array(*map(F.lit, bounds)), F.greatest(F.lit(1), F.least(at + k, F.lit(len(bounds))))) for k in (0, 1))
    step = F.floor((F.col(id_col) - low) / F.greatest(high - low, F.lit(1)) * steps)
    ranged = rows.withColumn(range_col, F.when(F.col(id_col).isNull(), F.struct(F.lit(-1).alias("c"), F.lit(0).cast("bigint").alias("s"))).otherwise(F.struct(at.alias("c"), F.coalesce(step, F.lit(0)).cast("bigint").alias("s"))))

    tops = cut(ranged.groupBy(F.col(range_col).alias("_range")).agg(F.max(F.struct(F.col(id_col).alias("id"), F.bitwise_not(tie_col).alias("tie"))).alias("top")))
    firsts = tops.groupBy(F.col("_range.c").alias("c")).agg(F.max("_range").alias("_range"))
    # The range before another one: inside a quantile by its steps, across quantiles (COARSE rows at most) by their last steps.
    lasts = tops.groupBy(F.col("_range.c").alias("c")).agg(F.min("_range").alias("low"))
    across = firsts.join(lasts, "c").select("_range", F.lead("low").over(Window.orderBy("c")).alias("over"), F.min("low").over(Window.partitionBy()).alias("bottom"))
    inside = tops.select("_range", "top", F.lead("_range").over(Window.partitionBy("_range.c").orderBy("_range.s")).alias("before"))
    heads = cut(inside.join(across, "_range", "left").select("top", F.coalesce("before", "over", "bottom").alias("to")))

    head_col = free("_head", rows.columns)
    heads = heads.select(F.struct("top", "to").alias(head_col))
    joined = ranged.join(heads, F.col(id_col).eqNullSafe(F.col(f"{head_col}.top.id")) & (F.col(tie_col) == F.bitwise_not(f"{head_col}.top.tie")))
    guests = joined.select(*rows.columns, F.col(f"{head_col}.to").alias(range_col), F.lit(1).alias(guest_col))
    every = ranged.withColumn(guest_col, F.lit(0)).unionByName(guests)
    order = Window.partitionBy(range_col).orderBy(guest_col, F.desc_nulls_last(id_col), tie_col)
    led = every.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.filter(F.col(guest_col) == 0).drop(guest_col, range_col)
