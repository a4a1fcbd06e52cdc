"""Matching of keys between data sets that spell them differently.

Lookup sides are joined without a hint: the planner broadcasts them when their
size allows and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalars import normalized_name
from factorloom.session import materialize


def left_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                columns, prefix: str = "") -> DataFrame:
    """All rows of ``left`` with ``columns`` of the matching row of ``right``."""
    taken = right.select(F.col(right_key).alias("_key"),
                         *[F.col(c).alias(prefix + c) for c in columns])
    return left.join(taken, F.col(left_key) == F.col("_key"), "left").drop("_key")


def unmatched_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` without a match."""
    taken = right.select(F.col(right_key).alias("_key"))
    return left.join(taken, F.col(left_key) == F.col("_key"), "left_anti")


def repair_keys(df: DataFrame, overrides: DataFrame, on: str, code: str,
                override: str = "override_code") -> DataFrame:
    """Fill a missing ``code`` from a table keyed by ``on``; others stay as they are."""
    filled = df.join(overrides.select(on, F.col(override).alias("_override")), on, "left")
    return filled.withColumn(code, F.coalesce(code, "_override")) \
        .select(*df.columns)


def rejoin_after_repair(df: DataFrame, right: DataFrame, code: str, columns) -> DataFrame:
    """Look the repaired code up again; the columns looked up earlier are replaced."""
    base = df.drop(*[c for c in columns if c in df.columns])
    return left_lookup(base, right, code, code, columns)


def label_countries(rows: DataFrame, groups: DataFrame, country: str, group_country: str,
                    columns, overrides: DataFrame | None = None) -> DataFrame:
    """Join by country name, ignoring case, blanks and punctuation.

    ``overrides`` (name, other_name) renames countries that still differ.
    """
    name = F.col(country)
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("name").alias(country), "other_name"),
                         country, "left")
        name = F.coalesce("other_name", country)
    taken = groups.select(normalized_name(group_country).alias("_name"), *columns)
    joined = rows.join(taken, normalized_name(name) == F.col("_name"), "left")
    return joined.drop("_name", "other_name")


# --- names that differ in spelling ---------------------------------------------------

def _grams(name: Column, q: int) -> Column:
    """The substrings of ``q`` characters of a padded name, numbered where one occurs again."""
    padded = F.concat(F.lit("\u0001" * (q - 1)), name, F.lit("\u0002" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q)))
    return F.transform(grams, lambda g, i: F.concat_ws("\u0003", g, F.size(
        F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g)).cast("string")))


def similar_names(left: DataFrame, right: DataFrame, similarity: float = 0.8, q: int = 2) -> DataFrame:
    """``left``, ``right`` and ``distance`` of all pairs of names whose edit distance is at most
    1 - ``similarity`` of the longer one.  Both frames have one column of names.

    Names are compared only if they share one of their rarest substrings: a name of n
    characters that is similar to another shares with it all but q times the allowed
    distance of its substrings, so in any order of the substrings the first ones, one
    more than that, have one in common.  Rare ones come first, which keeps the
    groups small; no pair is missed.
    """
    if not 0 < similarity <= 1 or q * (1 - similarity) >= 1:
        raise ValueError(f"a similarity of {similarity} cannot be found by substrings of {q} characters")
    ratio_ = (1 - similarity) / similarity
    sides = [df.select(F.col(df.columns[0]).alias("name")).filter("name <> ''").distinct() for df in (left, right)]
    split = [side.select("name", F.explode(_grams(F.col("name"), q)).alias("gram")) for side in sides]
    counts = materialize(split[0].unionByName(split[1]).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    rarest = Window.partitionBy("name").orderBy("n", "gram")
    first = [x.join(counts, "gram").withColumn("place", F.row_number().over(rarest)).filter(
        F.col("place") <= q * F.floor(F.length("name") * ratio_ + 1e-9) + 1).select("name", "gram") for x in split]
    pairs = (first[0].withColumnRenamed("name", "left").join(first[1].withColumnRenamed("name", "right"), "gram")
             .select("left", "right").distinct())
    longer = F.greatest(F.length("left"), F.length("right"))
    allowed = F.floor(longer * (1 - similarity) + 1e-9)
    return (pairs.filter(F.abs(F.length("left") - F.length("right")) <= allowed)
            .withColumn("distance", F.levenshtein("left", "right")).filter(F.col("distance") <= allowed))


def propose_repairs(unmatched: DataFrame, known: DataFrame, name: str, known_name: str, code: str,
                    similarity: float = 0.8, q: int = 2) -> DataFrame:
    """``name``, ``proposed_name``, its ``code`` and ``distance``: the nearest known names of every name.

    Names are compared without case, blanks and punctuation; all nearest ones are
    proposed where several are as near.  The result has the columns that
    ``repair_keys`` takes, once it has been looked over.
    """
    found = similar_names(unmatched.select(normalized_name(name).alias("name")),
                          known.select(normalized_name(known_name).alias("name")), similarity, q)
    nearest = found.join(found.groupBy("left").agg(F.min("distance").alias("distance")), ["left", "distance"])
    return (unmatched.select(F.col(name).alias("name"), normalized_name(name).alias("left")).distinct()
            .join(nearest, "left")
            .join(known.select(F.col(known_name).alias("proposed_name"), F.col(code).alias("code"),
                               normalized_name(known_name).alias("right")), "right")
            .select(F.col("name").alias(name), "proposed_name", F.col("code").alias(code), "distance"))
