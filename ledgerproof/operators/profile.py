"""What the text columns of a sheet hold: kinds, widths, decorations and the first cell that deviates, in one pass over the rows.

Everything is a count, a maximum or the least place of something, so tasks hand on a row for each column and decoration, and these are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts


def profile(frame: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """A row for each column: column, n, filled, nums, dates, strings (of the filled cells), width (most decimals shown), decorations (different ones of numbers), decoration
    (prefix|suffix of the first number in the order of `order_by`), deviant_at and deviant (place and text of the first number that is decorated otherwise, null without one),
    constant (all filled cells hold one value). Blank and null cells aren't filled. Of cells in one place the least text comes first.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for c in columns]))
    t = F.col("cell.text")
    rows = frame.select(F.col(f"`{order_by}`").alias("place"), cells.alias("cell")).select("place", "cell.column", t.alias("text"), (F.trim(t) != "").alias("filled"))
    t = F.col("text")
    kind, value = texts.kind_of(t), F.coalesce(texts.number(t).cast("string"), F.trim(t))
    filled = F.coalesce(F.col("filled"), F.lit(False))
    rows = rows.select("place", "column", "text", filled.alias("filled"), F.when(filled, kind).alias("kind"), F.when(filled, value).alias("value"), F.when(filled, texts.places(t)).alias("places"), F.when(filled, texts.decoration(t)).alias("decoration"))
    first = F.min(F.when(F.col("decoration").isNotNull(), F.struct("place", "text"))).alias("first")
    count = lambda k: F.count_if(F.col("kind") == k)
    parts = rows.groupBy("column", "decoration").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("filled"), count("num").alias("nums"), count("date").alias("dates"), count("str").alias("strings"),
        F.max("places").alias("width"), F.min("value").alias("low"), F.max("value").alias("high"), first,
    )
    # decorations in the order of their first cells: the second one's is the first that deviates
    nth = F.row_number().over(Window.partitionBy("column").orderBy(F.asc_nulls_last("first.place"), F.asc_nulls_last("first.text"), "decoration"))
    parts = parts.withColumn("nth", F.when(F.col("decoration").isNotNull(), nth))
    at = lambda k, c: F.max(F.when(F.col("nth") == k, F.col(c)))
    out = parts.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("n", "filled", "nums", "dates", "strings")], F.max("width").alias("width"), F.count("decoration").alias("decorations"), at(1, "decoration").alias("decoration"),
        at(2, "first.place").alias("deviant_at"), at(2, "first.text").alias("deviant"), (F.min("low") == F.max("high")).alias("constant"),
    )
    return out.withColumn("constant", F.coalesce("constant", F.lit(False)))
