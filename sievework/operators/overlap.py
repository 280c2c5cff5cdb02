"""Overlap of two digest tables, with row-level evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import column, json_of, python_str
from ..functions.text import display


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared_records, only_in_a, only_in_b, over distinct digests; one aggregation finds all three."""
    sides = a.select("digest", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("digest", F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = sides.groupBy("digest").agg(F.max("a").alias("a"), F.max("b").alias("b"))

    def n(x: int, y: int) -> Column:
        return F.count(F.when((F.col("a") == x) & (F.col("b") == y), 1))

    return seen.agg(n(1, 1).alias("shared_records"), n(1, 0).alias("only_in_a"), n(0, 1).alias("only_in_b"))


def overlap_rate(shared: int, only_a: int, only_b: int) -> float:
    """Shared digests over the smaller side's distinct digests."""
    smaller = shared + min(only_a, only_b)
    return shared / smaller if smaller > 0 else 0.0


def match_rate(matches: int, rows: int) -> float:
    return matches / rows if rows > 0 else 0.0


def shared_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("digest").distinct().join(b.select("digest").distinct(), "digest", "left_semi")


def evidence(a: DataFrame, b: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` pairs (a_row, b_row) of equal digests in row order, and one more if there are more.

    ``a`` and ``b`` have row and digest; other columns of ``a`` are kept. No more than cap + 1 rows of ``a`` and, for
    each of their digests, of ``b`` can be among these pairs, so a digest that fills a third of both sides costs no more
    than any other: neither side's full product is ever formed.
    """
    left = a.join(b.select("digest").distinct(), "digest", "left_semi").orderBy("row").limit(cap + 1)
    wanted = F.broadcast(left.select("digest").distinct())  # at most cap + 1 rows
    order = Window.partitionBy("digest").orderBy("row")
    right = b.join(wanted, "digest", "left_semi").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap + 1)
    pairs = F.broadcast(left.withColumnRenamed("row", "a_row")).join(right.select("digest", F.col("row").alias("b_row")), "digest")
    return pairs.drop("digest").orderBy("a_row", "b_row").limit(cap + 1)


def _shown(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return display(python_str(column(name), kind))


def field_differences(a: DataFrame, b: DataFrame, key_a: str, key_b: str, pairs: DataFrame) -> DataFrame:
    """(a_row, b_row, differing): for each pair of rows, the fields whose raw values differ, with both values as shown.

    A NaN differs from every value, itself included. Fields that one side lacks are shown as ``<missing>``.
    """
    names = sorted((set(a.columns) | set(b.columns)) - {key_a, key_b})
    few = F.broadcast(pairs.select("a_row", "b_row"))  # evidence, of a fixed number of rows
    # only the rows that the pairs name are spelled out
    a = a.join(few.select(F.col("a_row").alias("__wanted")).distinct(), column(key_a) == F.col("__wanted"), "left_semi")
    b = b.join(few.select(F.col("b_row").alias("__wanted")).distinct(), column(key_b) == F.col("__wanted"), "left_semi")
    left = a.select(column(key_a).alias("a_row"), *[_shown(a, n).alias(f"a{i}") for i, n in enumerate(names) if n in a.columns], *[json_of(column(n), a.schema[n].dataType, False).alias(f"x{i}") for i, n in enumerate(names) if n in a.columns])
    right = b.select(column(key_b).alias("b_row"), *[_shown(b, n).alias(f"b{i}") for i, n in enumerate(names) if n in b.columns], *[json_of(column(n), b.schema[n].dataType, False).alias(f"y{i}") for i, n in enumerate(names) if n in b.columns])
    kind = "struct<field:string,a:string,b:string>"
    found = []
    for i, n in enumerate(names):
        if n in a.columns and n in b.columns:
            differs = (F.col(f"x{i}") != F.col(f"y{i}")) | (F.col(f"x{i}") == "NaN")
            item = F.struct(F.lit(n).alias("field"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"))
            found.append(F.when(differs, item))
        else:
            found.append(F.struct(F.lit(n).alias("field"), (F.col(f"a{i}") if n in a.columns else F.lit("<missing>")).alias("a"), (F.col(f"b{i}") if n in b.columns else F.lit("<missing>")).alias("b")))
    differing = F.filter(F.array(*[f.cast(kind) for f in found]), lambda x: x.isNotNull()) if found else F.array().cast(f"array<{kind}>")
    return few.join(left, "a_row").join(right, "b_row").select("a_row", "b_row", differing.alias("differing"))
