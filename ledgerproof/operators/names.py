"""Suggestions for many refused names against a dictionary of any size.

Two names within an edit distance of `most` become equal when each loses at most `most` letters. So every name files the names that are left of it after up to so many deletions, and what is
filed under one spelling by both sides is compared; nothing else can be near. Long names, which would file too many, are cut into most + 1 pieces, of which one
stands unchanged in any near name, moved by no more than the distance. Pairs are tested where they meet, so only near ones leave the join, and the dictionary is never sent anywhere whole.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters up to which a name is filed by its deletions.
SHORT = 40


def deletions(name: str, most: int) -> list[str]:
    """What is left of a name after 0 to `most` deletions, each spelling once."""
    return sorted({"".join(c for i, c in enumerate(name) if i not in gone) for n in range(min(most, len(name)) + 1) for gone in map(set, combinations(range(len(name)), n))})


def _filed(names: DataFrame, most: int) -> DataFrame:
    """(name, key) of names of up to SHORT + most letters."""

    @F.pandas_udf("array<string>")
    def spellings(column: pd.Series) -> pd.Series:
        return column.map(lambda name: deletions(name, most))

    return names.filter(F.length("name") <= SHORT + most).select("name", F.explode(F.transform(spellings("name"), lambda s: F.xxhash64(s))).alias("key"))


def _pieces(names: DataFrame, most: int) -> DataFrame:
    """(name, length, piece, key): the most + 1 pieces of names of more than SHORT letters."""
    size = F.length("name")
    cut = lambda k: F.floor(size * k / (most + 1)).cast("int")
    items = F.array(*[F.struct(F.lit(k).alias("piece"), cut(k).alias("at"), F.substring("name", cut(k) + 1, cut(k + 1) - cut(k)).alias("key")) for k in range(most + 1)])
    return names.filter(size > SHORT).select("name", size.alias("length"), F.explode(items).alias("x")).select("name", "length", "x.*")


def _asked(names: DataFrame, most: int) -> DataFrame:
    """(name, length, piece, key): what names of more than SHORT letters hold where a near name's pieces may stand, for each length such a name can have."""
    lengths = F.explode(F.sequence(F.length("name") - most, F.length("name") + most))
    rows = names.filter(F.length("name") > SHORT).select("name", lengths.alias("length")).filter(F.col("length") > SHORT)
    cut = lambda k: F.floor(F.col("length") * k / (most + 1)).cast("int")
    moves = [F.struct(F.lit(k).alias("piece"), F.substring("name", cut(k) + 1 + move, cut(k + 1) - cut(k)).alias("key"), (cut(k) + move).alias("from")) for k in range(most + 1) for move in range(-most, most + 1)]
    return rows.select("name", "length", F.explode(F.array(*moves)).alias("x")).filter("x.from >= 0").select("name", "length", "x.piece", "x.key").distinct()


def common_beginning(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.left(a, k) == F.left(b, k))) - 1


def suggestions(refused: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(name, nearest, distance) of each different refused name: the dictionary's name within `most` edits that `closest` would take (least distance, then longest common beginning,
    then alphabet); null where there is none. Both tables have a column name; nulls are left out, repeats count once."""
    asked, known = (t.select(F.col("name").cast("string").alias("name")).filter("name is not null").distinct() for t in (refused, dictionary))
    q, n = F.col("q.name"), F.col("n.name")
    near = F.levenshtein(q, n, most) >= 0
    short = _filed(asked, most).alias("q").join(_filed(known, most).alias("n"), (F.col("q.key") == F.col("n.key")) & near)
    long = _asked(asked, most).alias("q").join(_pieces(known, most).alias("n"), (F.col("q.length") == F.col("n.length")) & (F.col("q.piece") == F.col("n.piece")) & (F.col("q.key") == F.col("n.key")) & near)
    pairs = short.select(q.alias("name"), n.alias("nearest")).unionByName(long.select(q.alias("name"), n.alias("nearest")))
    rank = F.struct(F.levenshtein("name", "nearest").alias("distance"), (-common_beginning(F.col("name"), F.col("nearest"))).alias("apart"), F.col("nearest"))
    best = pairs.groupBy("name").agg(F.min(rank).alias("best"))  # a pair that meets several times is one for a minimum
    return asked.join(best, "name", "left").select("name", F.col("best.nearest").alias("nearest"), F.col("best.distance").alias("distance"))
