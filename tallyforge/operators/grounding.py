"""Grounding of figures: whether each figure of an answer stands in the answer's sources, at the precision it is shown with.

answers(id, text) and sources(id, text), or sources with unit and scale for cells of a table. Figures are read from both;
a source's figures become entries, a figure of the answer an interval as wide as its last digit, and a range join brings
them together by answer and dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calc, figures
from ..storage import written
from .relational import range_join

MATCHED, EXEMPT, CROSS_CURRENCY, NOT_FOUND = "matched", "exempt", "cross_currency", "not_found"
DECIMAL = figures.DECIMAL
CURRENCIES = ("INR", "USD", "EUR")


def _money(unit: Column) -> Column:
    return unit.isin(*CURRENCIES)


def _date_parts(value: Column) -> Column:
    """A date as entries of its year, month and day, as far as it is known. value: YYYYMMDD with 00 for what isn't."""
    code = value.cast("long")
    part = lambda name, digits, known: F.when(known, F.struct(F.lit(f"DATE:{name}").alias("dim"), (code - code % digits).cast("double").alias("key")))
    return F.array_compact(F.array(part("Y", 10_000, code >= 10_000), part("M", 100, code % 10_000 >= 100), part("D", 1, code % 100 > 0)))


def _precision(value: Column) -> Column:
    code = value.cast("long")
    return F.when(code % 100 > 0, "DATE:D").when(code % 10_000 >= 100, "DATE:M").otherwise("DATE:Y")


def _dealt(df: DataFrame) -> DataFrame:
    """By id into as many parts as a shuffle has: reading texts takes far longer than their size tells, so parts aren't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def entries(sources: DataFrame, dims: list[str]) -> DataFrame:
    """sources(id, text[, unit, scale]) -> id, dim, key: what may be matched, of these dimensions.

    Dates are listed by year, month and day. Money is also a number, as it is and as its numeral was written. Signs: each entry
    is listed signed and by its size. unit and scale, where given, hold for numbers of a cell that say none of their own.
    """
    has = set(sources.columns)
    unit, scale = (F.col(c) if c in has else F.lit(None).cast("string") for c in ("unit", "scale"))
    f = figures.each(_dealt(sources.select("id", unit.alias("_unit"), scale.alias("_scale"), "text")), "text", ["id", "_unit", "_scale"])
    bare = F.col("unit").isin("PLAIN", "COUNT") & (F.col("kind") == "number")
    f = f.withColumn("value", F.when(bare & F.col("_scale").isNotNull(), (F.col("value") * calc.scale_factor(F.col("_scale"))).cast(DECIMAL)).otherwise(F.col("value")))
    f = f.withColumn("unit", F.when(bare & F.col("_unit").isNotNull(), F.col("_unit")).otherwise(F.col("unit")))
    value = figures.key(F.col("unit"), F.col("value")).cast("double")
    one = lambda dim, key: F.struct(dim.alias("dim"), key.cast("double").alias("key"))
    number = F.lit("NUMBER")
    listed = (
        F.when(F.col("unit") == "DATE", _date_parts(F.col("value")))
        .when(_money(F.col("unit")), F.array(one(figures.dimension(F.col("unit")), value), one(number, value), one(number, F.col("number"))))
        .when(F.col("unit").isin("PLAIN", "COUNT"), F.array(one(number, value), one(number, F.col("number"))))
        .otherwise(F.array(one(figures.dimension(F.col("unit")), value)))
    )
    rows = f.where("value is not null").select("id", F.explode(listed).alias("e")).select("id", "e.*")
    signs = F.explode(F.array(F.struct(F.lit("signed:").alias("s"), F.col("key").alias("k")), F.struct(F.lit("size:").alias("s"), F.abs("key").alias("k"))))
    both = rows.select("id", "dim", signs.alias("x")).select("id", F.concat("x.s", "dim").alias("dim"), F.col("x.k").alias("key"))
    return both.where(F.col("dim").isin(*dims)).distinct()


def verdicts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers(id, text) -> id, start, raw, reason for each of its figures.

    A figure matches an entry that rounds to it: half its last digit below is included, half above is not. A figure with a minus
    sign is compared with signs, others by size. One that stands only in another currency is told apart from one that stands
    nowhere; labels, places, small counts, years of a period phrase ("fiscal 2025") and all inside links to sources are exempt.
    """
    cited = _dealt(answers).select("id", "text", figures.cited_spans(F.col("text")).alias("_spans"))
    each = figures.each(cited, "text", ["id", "text", "_spans"])
    exempt = figures.is_exempt({c: F.col(c) for c in ("kind", "unit", "value", "start", "stop")}, F.col("text"), F.col("_spans"))
    value = figures.key(F.col("unit"), F.col("value")).cast("double")
    step = figures.key(F.col("unit"), F.col("step")).cast("double")
    signed, date = F.col("signed"), F.col("unit") == "DATE"
    at = F.when(signed, value).otherwise(F.abs(value))
    dims = F.when(date, F.array(_precision(F.col("value")))).when(_money(F.col("unit")), F.concat(F.array(figures.dimension(F.col("unit"))), F.filter(F.array(*[F.lit(f"MONEY:{c}") for c in CURRENCIES]), lambda c: c != figures.dimension(F.col("unit"))))).otherwise(F.array(figures.dimension(F.col("unit"))))
    sought = ~exempt & F.col("value").isNotNull()
    f = written(
        each.select(
            "id", "start", "raw", exempt.alias("exempt"), F.when(date, at).otherwise(at - step / 2).alias("lo"), F.when(date, at + 1).otherwise(at + step / 2).alias("hi"),
            F.when(signed, "signed:").otherwise("size:").alias("sign"), F.when(sought, dims).alias("dims"),
        ),
        "figures",
    )  # read several times, so all that is calculated of a figure is in it
    asked = f.where("dims is not null").select("id", "start", "lo", "hi", "sign", F.posexplode("dims").alias("rank", "d"))
    by = lambda df, dim: df.select(*[c for c in df.columns if c not in ("id", "dim")], F.struct(F.col("id"), dim.alias("dim")).alias("dim"), *([F.col("id")] if "start" in df.columns else []))
    kinds = [r[0] for r in asked.select(F.concat("sign", "d")).distinct().collect()]  # two signs, and as many dimensions as there are units
    found = by(entries(sources, kinds), F.col("dim")).select("dim", "key")
    hits = range_join(found, by(asked, F.concat("sign", "d")).select("dim", "lo", "hi", "id", "start", "rank"), lambda dim: dim["dim"])
    best = hits.groupBy("id", "start").agg(F.min("rank").alias("rank"))
    reason = F.when(F.col("exempt"), EXEMPT).when(F.col("rank") == 0, MATCHED).when(F.col("rank") > 0, CROSS_CURRENCY).otherwise(NOT_FOUND)
    return f.join(best.hint("merge"), ["id", "start"], "left").select("id", "start", "raw", reason.alias("reason"))
