"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.common import WORD, staged

#: Weights of the sources in their order, repeating, and the most often that a source may be taken.
WEIGHTS, MOST = (5, 2, 1), 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size), one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target
    stops at ``most`` times its source's size and the excess is shared again by weight until none is above.
    The limit is target = min(cap, level * weight): in order of cap / weight, the sources that stop are
    those whose ratio is at most the level that the rest would get. The windows run over one row a source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    at = (
        capped.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    # The level if this source and all after it stay under their caps; it holds from the first that does.
    level = (F.col("total") - F.col("before")) / F.col("open")
    held = at.withColumn("level", level).withColumn("under", F.col("level") * F.col("weight") < F.col("cap"))
    final = held.withColumn("level", F.min(F.when(F.col("under"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(whole)["level"])
    return final.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate), and one more with probability of the fraction, decided by a hash of ``key`` and seed."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, rate, copies, taken) of each row of ``docs``.

    size: words of the text (null: 0). rate: target over size of the row's source (0 where that is 0).
    copies: floor(rate) and one hash-seeded draw more; taken: copies times size. The draw depends on id,
    text and seed alone, so reruns agree and rows that repeat an id and its text share it. Null sources
    form one source, ordered last; null ids draw by their text; an empty table gives no rows."""
    text_id = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sized = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_id.alias("text_key"), F.col(source_col).alias("source"), size_of(text_col).alias("size")), "mix-sizes")
    joined = sized.join(rates(sized, weights, most), [F.coalesce("source", F.lit("")) == F.col("__source"), F.col("source").isNull() == F.col("__none")])
    drawn = joined.withColumn("copies", copies(F.col("__rate"), F.struct("doc_id", "text_key"), seed))
    return drawn.select("doc_id", "text_key", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__rate").alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(__source, __none, __size, __target, __rate), a row a source of ``sized`` (source, size). The rows are
    written first, so that their measured size decides whether a join broadcasts them or sorts and splits."""
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return staged(
        sources.select(F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), rate.alias("__rate")), "mix-rates"
    )


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as mix() says, all columns unchanged.

    Rows meet only the rate of their source, and draw by their own id and text; so null ids and rows that
    repeat an id draw as in mix(), each once. Null and empty texts come by the rate of their source; an empty
    table gives an empty one."""
    each = rates(docs.select(F.col(source_col).alias("source"), size_of(text_col).alias("size")))
    joined = docs.join(each, [F.coalesce(docs[source_col], F.lit("")) == F.col("__source"), docs[source_col].isNull() == F.col("__none")])
    key = F.struct(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("text_key"))
    often = joined.withColumn("__copies", copies(F.col("__rate"), key, seed)).where("__copies > 0")
    return often.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
