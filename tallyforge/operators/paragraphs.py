"""Where the items of a document stand among its paragraphs."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def locate(items: DataFrame, paragraphs: DataFrame, doc: str, order: str, text: str, para: str = "para") -> DataFrame:
    """items with `para`, the number (from 1, in order) of their document's paragraph that has the same text, white space aside.

    Both are gone through once, forwards: an item is looked for behind the one found before it. One that isn't found stands where the
    last one was found (at first: 1). Null texts are empty ones. One document's items and paragraphs meet in one task; a look-up is
    a binary search among the places of its text, so repeated paragraphs don't make it slow. Ties in the order: by text.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    left = items.withColumn("_plain", plain).repartition(doc)
    right = paragraphs.select(F.col(doc), F.col(order).alias("_order"), plain.alias("_plain"))
    schema = StructType([*items.schema.fields, StructField(para, IntegerType())])

    def place(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = mine.sort_by([(order, "ascending"), ("_plain", "ascending")])
        where: dict[str, list[int]] = {}
        for k, t in enumerate(theirs.sort_by([("_order", "ascending"), ("_plain", "ascending")]).column("_plain").to_pylist()):
            where.setdefault(t, []).append(k)
        following, last, out = 0, 1, []
        for t in mine.column("_plain").to_pylist():
            places = where.get(t, ())
            at = bisect.bisect_left(places, following)
            if at < len(places):
                following = last = places[at] + 1
            out.append(last)
        return mine.drop_columns(["_plain"]).append_column(para, pa.array(out, pa.int32()))

    return left.groupBy(doc).cogroup(right.groupBy(doc)).applyInArrow(place, schema)
