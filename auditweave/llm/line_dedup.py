"""Line dedup by overlapping three-line windows: windows that repeat anywhere lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import staged, text_key

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, starts): for each document with later occurrences, the sorted line numbers (from 0)
    at which windows start that also start at a smaller (doc_id, text_key, line) somewhere.

    Windows are counted by partial aggregation of fixed-width rows, so a frequent one costs a row a task. The
    occurrences then meet only the repeated ones; Spark splits that join where one window is hot."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), lines_of(F.col(text_col)).alias("lines"))
    # 128 bits of hash stand for a window: two hashes of its lines' hashes.
    hashes = lines.where(F.size("lines") >= window).select(
        "doc_id", "text_key", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("b")
    )
    keys = F.transform(
        F.sequence(F.lit(1), F.size("a") - window + 1), lambda k: F.struct(F.xxhash64(F.slice("a", k, window)).alias("k1"), F.xxhash64(F.lit(7), F.slice("b", k, window)).alias("k2"))
    )
    windows = staged(hashes.select("doc_id", "text_key", F.posexplode(keys).alias("line", "key")).select("doc_id", "text_key", "line", "key.k1", "key.k2"), "line-windows")
    # One number in order of (doc_id, text_key): a minimum of numbers needs no sort.
    order = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.shiftrightunsigned("text_key", 2).cast("decimal(19,0)")
    repeated = windows.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = windows.join(repeated, ["k1", "k2"]).withColumn("later", order > F.col("first"))
    # In order of window and line, so that a window's first line in this text comes first; rows that repeat fall together.
    each = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("k1", "k2", "line", "later"))).alias("each"))
    again = F.filter("each", lambda x, k: x["later"] | ((k > 0) & (F.get("each", k - 1)["k1"] == x["k1"]) & (F.get("each", k - 1)["k2"] == x["k2"])))
    return each.select("doc_id", "text_key", F.sort_array(F.transform(again, lambda x: x["line"])).alias("starts")).where(F.size("starts") > 0)


def cover(starts: Column, lines: Column, window: int = WINDOW) -> Column:
    """The lines outside the merged spans [start, start + window) of the sorted ``starts``."""
    opens = F.filter(starts, lambda x, k: (k == 0) | (x - F.get(starts, k - 1) > window))
    ends = F.transform(F.filter(starts, lambda x, k: (k == F.size(starts) - 1) | (F.get(starts, k + 1) - x > window)), lambda x: x + window)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(opens, F.array(F.size(lines))).alias("b"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with later occurrences of repeated windows removed from the text, and the columns
    ``__n_lines`` and ``__n_removed``.

    A window is ``window`` consecutive lines (cut at line feeds, compared as they are). Occurrences are
    ordered by (id, text hash, line); all lines that a later occurrence covers go, overlaps counted once.
    Texts of fewer lines, null texts and rows with a null id stay as they are; rows that repeat an id and
    its text count as one document; an empty table gives an empty one. All columns pass through."""
    found = repeats(docs, id_col, text_col, window).select(F.col("doc_id").alias(id_col), F.col("text_key").alias("__key"), F.col("starts").alias("__starts"))
    keyed = docs.withColumn("__key", text_key(text_col))
    lines = lines_of(F.col(text_col))
    joined = keyed.join(found, [id_col, "__key"], "left").withColumn("__n_lines", F.size(lines).cast("long"))
    joined = joined.withColumn("__kept", F.when(F.col("__starts").isNotNull(), cover(F.col("__starts"), lines, window)))
    removed = F.when(F.col("__kept").isNull(), 0).otherwise(F.col("__n_lines") - F.size("__kept")).cast("long")
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    return joined.withColumn("__n_removed", removed).withColumn(text_col, text).select(*docs.columns, "__n_lines", "__n_removed")


def digests(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each row of dedup_lines(); null texts count as empty."""
    return deduped.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL for digests(dedup_lines(documents)) where ids are unique.
SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, k AS line, lines[k] || chr(10) || lines[k + 1] || chr(10) || lines[k + 2] AS win
      FROM d, unnest(range(1, len(lines) - 1)) AS t(k)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS nth FROM w WHERE doc_id IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, line + k AS line FROM f, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1),
l AS (SELECT doc_id, k AS line, lines[k] AS txt FROM d, unnest(range(1, len(lines) + 1)) AS t(k)),
kept AS (SELECT l.doc_id, string_agg(l.txt, chr(10) ORDER BY l.line) AS txt, count(*) AS n
         FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line GROUP BY l.doc_id)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, (len(d.lines) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
