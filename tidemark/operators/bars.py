"""Daily bars from trades or order lines: one row for each instrument and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Years by which the order lines' dates move, a multiple of four, so that every fold has rows.
SHIFT_YEARS = 16


def int_date(d):
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def instrument(exchange, ticker):
    return F.concat_ws(":", F.lit("US"), exchange, F.lit("STOCKS"), ticker)


def order_lines(spark: SparkSession, sf_dir: str, by: str = "supplier", keep=None) -> DataFrame:
    """``l_suppkey, exchange, ticker, date, price, at, l_quantity``, a row for each order line; ``at`` is the order within a day.

    ``keep`` is a rule for the instruments of suppliers, applied before their lines are joined.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    place = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("s_suppkey", F.upper(F.regexp_replace("r_name", " ", "_")).alias("exchange"))
    if keep is not None:
        place = place.filter(keep(instrument("exchange", F.col("s_suppkey").cast("string"))))
    key = F.col("l_suppkey").cast("string") if by == "supplier" else F.lit("ALL")
    date = F.make_date(F.year("l_shipdate") + SHIFT_YEARS, F.month("l_shipdate"), F.dayofmonth("l_shipdate"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "exchange", key.alias("ticker"), date.alias("date"), price.alias("price"), order.alias("at"), "l_quantity")


def bars(spark: SparkSession, sf_dir: str, by: str = "supplier", gap_after: int = 0) -> DataFrame:
    """``instrument_id, ticker, exchange, instrument_class, date, signal_date, source_row_number, open, high, low, close, volume``.

    ``by`` is supplier or region. With ``gap_after`` row numbers jump by one after so many rows, as a quarantined line leaves.
    """
    rows = order_lines(spark, sf_dir, by)
    daily = rows.groupBy("exchange", "ticker", "date").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume")
    )
    daily = daily.withColumn("instrument_id", instrument("exchange", "ticker"))
    number = F.row_number().over(Window.partitionBy("instrument_id").orderBy("date"))
    if gap_after:
        number = number + F.when(number > gap_after, 1).otherwise(0)
    return daily.select(
        "instrument_id", "ticker", "exchange", F.lit("stocks").alias("instrument_class"), "date", int_date("date").alias("signal_date"), (number + 1).cast("long").alias("source_row_number"), "open", "high", "low", "close", "volume"
    )
