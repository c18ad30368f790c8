"""The sheet operations: each takes a DataFrame and returns one, as a declarative plan.

Sheets have a row order only where a column says so; operations that need one take it as an argument. Ties are always
broken by the given id columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: More columns than this are refused by pivot.
MAX_PIVOT = 1000
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct,
    "median": lambda c: F.percentile(c, 0.5),
}


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def condition(spec) -> Column:
    """(op, column, value), ("and"|"or", [specs]) or ("not", spec) as a Column."""
    op = spec[0]
    if op in ("and", "or"):
        return reduce(lambda a, b: a & b if op == "and" else a | b, map(condition, spec[1]))
    if op == "not":
        return ~condition(spec[1])
    c, value = F.col(spec[1]), spec[2] if len(spec) > 2 else None
    return {
        "=": lambda: c == value, "<>": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value,
        ">=": lambda: c >= value, "in": lambda: c.isin(*value), "contains": lambda: c.contains(value), "between": lambda: c.between(*value),
        "is_null": c.isNull, "not_null": c.isNotNull,
    }[op]()


def filter_rows(df: DataFrame, spec) -> DataFrame:
    return df.where(condition(spec))


def fill_value(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fill_forward(df: DataFrame, columns: Sequence[str], order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """The last value above, inside each group of `within`: a whole sheet in one window would be one task."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def cast_type(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """What can't be read as the type becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def split_column(df: DataFrame, column: str, separator: str, into: Sequence[str]) -> DataFrame:
    parts = F.split(column, f"\\Q{separator}\\E", len(into))
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(into)})


def merge_columns(df: DataFrame, columns: Sequence[str], separator: str, into: str) -> DataFrame:
    """Nulls are skipped."""
    return df.withColumn(into, F.concat_ws(separator, *columns))


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """aggregates: output name -> (function, column)."""
    return df.groupBy(*keys).agg(*[AGGREGATES[f](c).alias(n) for n, (f, c) in aggregates.items()])


def money(column: str) -> Column:
    """Exact in the order of addition: cents as decimals."""
    return F.col(column).cast("decimal(18,2)")


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, aggregate: Column) -> DataFrame:
    """A column for each of values; empty cells are 0."""
    if len(values) > MAX_PIVOT:
        raise ValueError(f"a pivot has at most {MAX_PIVOT} columns")
    wide = df.groupBy(*rows).pivot(column, list(values)).agg(aggregate)
    return wide.fillna(0, [str(v) for v in values])


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    if how not in ("inner", "left"):
        raise ValueError("sheets join by inner or left")
    return left.join(right, list(keys), how)


def append(*sheets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def deduplicate(df: DataFrame, keys: Sequence[str] | None = None, keep_first_by: Sequence[str] = ()) -> DataFrame:
    if not keep_first_by:
        return df.dropDuplicates(list(keys)) if keys else df.distinct()
    w = Window.partitionBy(*(keys or df.columns)).orderBy(*keep_first_by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sort(df: DataFrame, by: Sequence[tuple[str, bool]]) -> DataFrame:
    """by: (column, descending); nulls last."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in by])


def top_n(df: DataFrame, n: int, by: str, ids: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *ids).limit(n)


def profile(df: DataFrame) -> DataFrame:
    """A row per column: its type, rows, blanks and distinct values, and how many rows of the table repeat another.

    Cells are counted by column and value first, so what is shuffled is one row for each value that a task has met.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(df.columns)]))
    values = df.select(cells.alias("cell")).groupBy("cell.i", "cell.v").agg(F.count(F.lit(1)).alias("c"))
    by = values.groupBy("i").agg(F.sum("c").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("blanks"), F.count("v").alias("distinct_values"))
    repeated = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))  # one row
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in df.dtypes])
    return by.crossJoin(F.broadcast(repeated)).select(F.get(names, F.col("i"))["column"].alias("column"), F.get(names, F.col("i"))["type"].alias("type"), "rows", "blanks", "distinct_values", "duplicate_rows")
