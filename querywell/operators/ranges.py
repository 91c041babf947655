"""Running sums, running maxima and exact quantiles over rows in order, without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import cut


def prefixes(rows: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """rows with the sum or maximum of a column over all rows before in the order: 0 or null for the first.

    Rows are sorted into ranges over the tasks; each range gives one row, which in one small window become the
    ranges' own prefixes; a window within a range does the rest. Rows that are equal in the order are in one range and go in any order.
    """
    sums, maxima = sums or {}, maxima or {}
    ranged = cut(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range_number")))
    parts = [*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in maxima.items())]
    before = Window.orderBy("at_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    whole = ranged.groupBy(F.col("range_number").alias("at_range")).agg(*parts)
    offsets = whole.select("at_range", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_of_ranges") for n in sums), *(F.max(n).over(before).alias(f"{n}_of_ranges") for n in maxima))
    within = Window.partitionBy("range_number").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = [*(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{n}_of_rows") for n, c in sums.items()), *(F.max(c).over(within).alias(f"{n}_of_rows") for n, c in maxima.items())]
    placed = ranged.select("*", *own).join(F.broadcast(offsets), F.col("range_number") == F.col("at_range"))
    found = [*((F.col(f"{n}_of_ranges") + F.col(f"{n}_of_rows")).alias(n) for n in sums), *(F.greatest(f"{n}_of_ranges", f"{n}_of_rows").alias(n) for n in maxima)]
    return placed.select(*rows.columns, *found)


def numbered(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """rows with ``number``: their place from 0 among those of their group, in order. A group of any size is spread over ranges."""
    placed = prefixes(rows, [F.asc_nulls_first(by), *order], {"number": F.lit(1).cast("long")})
    first = placed.groupBy(F.col(by).alias("of_group")).agg(F.min("number").alias("first_number"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("of_group"))).withColumn("number", F.col("number") - F.col("first_number")).select(*rows.columns, "number")


def quantiles(rows: DataFrame, by: list[str], value: str, nearest: dict[str, float] | None = None, between: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles of a column by group -> by, n, a column a quantile. Nulls do not count; a group of nulls has no row.

    ``nearest`` takes the value at place ceil(p n), ``between`` the point p between the two values next to it (p = 0.5: the median).
    Equal values of a group are counted first, in each task; the places come from prefix sums over ranges of
    (group, value), so neither a large group nor a frequent value meets in one task.
    """
    nearest, between = nearest or {}, between or {}
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("one_value")).agg(F.count(F.lit(1)).alias("of_value"))
    placed = prefixes(counts, [*(F.asc_nulls_first(c) for c in by), F.col("one_value").asc()], {"upto": F.col("of_value")})
    totals = placed.groupBy(*(F.col(c).alias(f"total_{c}") for c in by)).agg(F.sum("of_value").alias("n"), F.min("upto").alias("first"))
    same = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"total_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"total_{c}"))
    joined = placed.join(totals, same) if by else placed.crossJoin(F.broadcast(totals))  # one row
    begin = F.col("upto") - F.col("first")
    at = lambda place: F.max(F.when((begin < place) & (place <= begin + F.col("of_value")), F.col("one_value")))
    wanted, made = [], [F.col("n")]
    for name, p in nearest.items():
        wanted.append(at(F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9))).alias(name))
        made.append(F.col(name))
    for name, p in between.items():
        low = F.floor(F.lit(p) * (F.col("n") - 1))
        wanted += [at(low + 1).alias(f"{name}_low"), at(F.ceil(F.lit(p) * (F.col("n") - 1)) + 1).alias(f"{name}_high")]
        made.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (F.lit(p) * (F.col("n") - 1) - low)).alias(name))
    return joined.groupBy(*by, "n").agg(*wanted).select(*by, *made)


def skyline(rows: DataFrame, quality: str, price: str) -> DataFrame:
    """Rows that no other beats: their quality is above that of all cheaper ones, and the best at their price. Rows without either are left out."""
    known = rows.where(F.col(price).isNotNull() & F.col(quality).isNotNull())
    best = known.groupBy(F.col(price).alias("at_price")).agg(F.max(quality).alias("best"))
    placed = prefixes(best, [F.col("at_price").asc()], maxima={"cheaper": F.col("best")})
    front = placed.where("cheaper is null or best > cheaper").select("at_price", "best")
    return known.join(front, (F.col(price) == F.col("at_price")) & (F.col(quality) == F.col("best"))).drop("at_price", "best")
