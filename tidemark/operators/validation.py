"""Classification of raw lines: the first rule that fails names the reason; a line that passes all is a bar.

``lines`` has ``member``, ``row_number`` (physical, the header is 1) and ``line``. Blank lines (of any ASCII whitespace) are
skipped but keep their number. Numbers may have whitespace around them and underscores between digits; ticker, period and
time are compared as they stand. A line with characters beyond ASCII is no number anywhere: ``parse_error``. Whether a date repeats or goes back is judged against the last accepted date, which is the running maximum of the
dates that pass every other rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The header and the shape of member paths.
HEADER = ("<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>", "<OPENINT>")
MEMBER = r"(?i)^data/daily/us/(nasdaq|nyse|nysemkt) (stocks|etfs)(?:/[123])?/([^/]+)\.us\.txt$"
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10)))
BLANKS = " \t\r\f\x0b\n"
DIGITS = "[0-9](_?[0-9])*"
INTEGER = f"^[+-]?{DIGITS}$"
NUMBER = f"^[+-]?({DIGITS}([.]({DIGITS})?)?|[.]{DIGITS})([eE][+-]?{DIGITS})?$"
SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"


def classify_paths(members: DataFrame, column: str = "member") -> DataFrame:
    """Adds ``exchange, instrument_class, ticker, instrument_id``; null where the path is of another kind."""
    part = lambda i: F.nullif(F.regexp_extract(column, MEMBER, i), F.lit(""))
    raw = F.upper(part(3))
    alias = raw.startswith("_") & F.substring(raw, 2, 100).isin(*RESERVED)
    ticker = F.when(alias, F.substring(raw, 2, 100)).otherwise(raw)
    out = members.withColumns({"exchange": F.upper(part(1)), "instrument_class": F.lower(part(2)), "ticker": ticker})
    key = F.concat(F.lit("US:"), F.col("exchange"), F.lit(":"), F.upper("instrument_class"), F.lit(":"), F.col("ticker"))
    return out.withColumn("instrument_id", key)


def _number(c):
    text = F.btrim(c, F.lit(BLANKS))
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(
        text.rlike(SPECIAL), F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )


def _integer(c):
    text = F.btrim(c, F.lit(BLANKS))
    return F.when(text.rlike(INTEGER), F.replace(text, F.lit("_"), F.lit("")))


def validate(lines: DataFrame, valid_header: str = "true") -> DataFrame:
    """Adds ``ticker_field, bar_date, open, high, low, close, volume, reason``; reason is null for a valid bar."""
    rows = lines.filter(F.btrim("line", F.lit(BLANKS)) != "").withColumn("fields", F.split("line", ",", -1)).withColumn("n", F.size("fields"))
    get = lambda i: F.when(F.col("n") == len(HEADER), F.col("fields")[i])
    rows = rows.withColumns({
        "ticker_field": get(0), "period": get(1), "date_text": _integer(get(2)), "time_text": get(3),
        "open": _number(get(4)), "high": _number(get(5)), "low": _number(get(6)), "close": _number(get(7)), "volume": _number(get(8)), "interest": _integer(get(9)),
    })
    # a whole number of any size parses; only one of eight digits can be a date
    rows = rows.withColumn("bar_date", F.expr("try_to_date(lpad(cast(try_cast(date_text as bigint) as string), 8, '0'), 'yyyyMMdd')"))
    rows = rows.withColumn("bar_date", F.when(F.expr("try_cast(date_text as bigint) between 18000101 and 22001231"), F.col("bar_date")))
    prices = [F.col(x) for x in ("open", "high", "low", "close")]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    parse_error = F.col("date_text").isNull() | F.col("interest").isNull() | F.col("line").rlike(r"[^\x00-\x7F]")
    for c in (*prices, F.col("volume")):
        parse_error = parse_error | c.isNull()
    any_bad = bad(prices[0]) | bad(prices[1]) | bad(prices[2]) | bad(prices[3])
    o, h, l, c = prices  # noqa: E741
    first = (
        F.when(~F.expr(valid_header), "invalid_header")
        .when(F.col("n") != len(HEADER), "wrong_column_count")
        .when(parse_error, "parse_error")
        .when(F.upper("ticker_field") != F.concat(F.upper("ticker"), F.lit(".US")), "ticker_mismatch")
        .when(F.upper("period") != "D", "non_daily_period")
        .when(F.col("time_text") != "000000", "unexpected_time")
        .when(F.col("bar_date").isNull(), "invalid_date")
        .when(any_bad, "non_finite_ohlc")
        .when(F.least(*prices) <= 0, "non_positive_ohlc")
        .when(bad(F.col("volume")), "non_finite_volume")
        .when(F.col("volume") < 0, "negative_volume")
        .when(h < F.greatest(o, l, c), "high_below_ohlc")
        .when(l > F.least(o, h, c), "low_above_ohlc")
    )
    rows = rows.withColumn("first_reason", first)
    seen = Window.partitionBy("member").orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_date", F.max(F.when(F.col("first_reason").isNull(), F.col("bar_date"))).over(seen))
    reason = F.coalesce("first_reason", F.when(F.col("bar_date") == F.col("last_date"), "duplicate_date").when(F.col("bar_date") < F.col("last_date"), "non_increasing_date"))
    return rows.withColumn("reason", reason).drop("fields", "n", "period", "date_text", "time_text", "interest", "first_reason", "last_date")


def load_valid(validated: DataFrame, policy: str = "drop") -> DataFrame:
    """Typed bars; ``raise`` fails on the first invalid row, ``drop`` leaves invalid rows out."""
    if policy not in ("drop", "raise"):
        raise ValueError("policy is drop or raise")
    if policy == "raise":
        ok = F.assert_true(F.col("reason").isNull(), F.concat(F.lit("invalid row: "), F.coalesce("reason", F.lit(""))))
        validated = validated.withColumn("_ok", ok).filter(F.col("_ok").isNull()).drop("_ok")
    return validated.filter("reason is null").drop("reason")


def quarantine(validated: DataFrame, preview: int = 300) -> DataFrame:
    return validated.filter("reason is not null").select("member", "row_number", "reason", F.btrim(F.substring("line", 1, preview), F.lit(BLANKS)).alias("preview"))


def reason_histogram(validated: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Rows by reason; an invalid header (``headers``: member, header_valid) counts once besides the rows below it."""
    reasons = validated.filter("reason is not null").select("reason")
    if headers is not None:
        reasons = reasons.unionByName(headers.filter("not header_valid").select(F.lit("invalid_header").alias("reason")))
    return reasons.groupBy("reason").agg(F.count("*").alias("rows"))


def member_summary(validated: DataFrame) -> DataFrame:
    good = F.col("reason").isNull()
    date = F.when(good, F.year("bar_date") * 10000 + F.month("bar_date") * 100 + F.dayofmonth("bar_date"))
    return validated.groupBy("member").agg(
        F.count("*").alias("row_count"), F.count_if(good).alias("valid_rows"), F.count_if(~good).alias("invalid_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.count_if(good & (F.col("volume") == 0)).alias("zero_volume"), F.round(F.min(F.when(good, F.col("close"))), 6).alias("min_close"), F.round(F.max(F.when(good, F.col("close"))), 6).alias("max_close"),
    )


def extreme_moves(validated: DataFrame) -> DataFrame:
    """Per member: moves of over 50 % and 100 % between consecutive valid closes, and the largest."""
    w = Window.partitionBy("member").orderBy("row_number")
    moves = validated.filter("reason is null").withColumn("move", F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1))
    return moves.groupBy("member").agg(F.count_if(F.col("move") > 0.5).alias("over_50"), F.count_if(F.col("move") > 1.0).alias("over_100"), F.round(F.max("move"), 6).alias("largest"))


def survivors(summary: DataFrame, days: int = 10) -> DataFrame:
    """Share of instruments whose last date is within ``days`` of the latest; input ``last`` is a date."""
    top = summary.agg(F.max("last").alias("top"))
    both = summary.join(F.broadcast(top))  # one row
    return both.agg(F.count("*").alias("instruments"), F.count_if(F.col("last") >= F.date_sub("top", days)).alias("survivors"))


def last_wins(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
