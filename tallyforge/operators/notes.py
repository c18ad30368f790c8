"""Notes merged level by level until each key has one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written
from .ordered import packed


def merge_tree(notes: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, source: str, budget: int, merge: Callable[[Column], Column], least: int = 1) -> DataFrame:
    """One row for each key: body, sources (of all its notes, in order), level.

    On each level notes are packed in order under a budget of characters, and a pack's texts (an array) become one by merge(). A note of a
    key that has others never stays alone for good: where a level packs nothing together, that level takes notes two by two. A text
    counts `least` characters at least. Null texts are empty. Levels are written, so the plan doesn't grow with their number, which is
    the logarithm of a key's notes.
    """
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    rows = notes.select(*keys, place.alias("place"), F.coalesce(text, F.lit("")).alias("body"), F.array(source).alias("sources"), F.lit(0).alias("level"))
    level = written(rows, "notes")
    while True:
        many = level.where("place > 1").count()
        if not many:
            return level.drop("place")
        sized = level.withColumn("_size", F.greatest(F.char_length("body"), F.lit(least)).cast("long"))
        packs = packed(sized, keys, ["place"], "_size", budget)
        alone = packs.groupBy(*keys).agg((F.max("pack") == F.max("place")).alias("_alone"))  # nothing of the key fits together
        packs = packs.join(alone, list(keys)).withColumn("pack", F.when(F.col("_alone"), F.ceil(F.col("place") / 2)).otherwise(F.col("pack")).cast("long"))
        together = F.array_sort(F.collect_list(F.struct("place", "body", "sources", "level")))
        met = packs.groupBy(*keys, "pack").agg(together.alias("_notes"))
        one = F.size("_notes") == 1
        following = met.select(
            *keys, F.col("pack").alias("place"), F.when(one, F.col("_notes")[0]["body"]).otherwise(merge(F.transform("_notes", lambda n: n["body"]))).alias("body"),
            F.flatten(F.transform("_notes", lambda n: n["sources"])).alias("sources"), (F.array_max(F.transform("_notes", lambda n: n["level"])) + F.when(one, 0).otherwise(1)).alias("level"),
        )
        before, level = level, written(following, "notes")
        discard(before)
