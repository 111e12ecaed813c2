"""Instruments of an audited archive, and their bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import classify_paths, load_valid, validate
from . import archive

#: The columns of a symbol manifest.
MANIFEST = (
    "source_member string, instrument_id string, ticker string, exchange string, instrument_class string, compressed_size long, uncompressed_size long, crc32 string, header_valid boolean, empty_file boolean, row_count long, "
    "valid_row_count long, invalid_row_count long, first_date string, last_date string, zero_volume_count long, extreme_return_50_count long, extreme_return_100_count long, max_abs_return double, min_close double, max_close double"
)
REQUIRED = ("instrument_id", "ticker", "exchange", "instrument_class", "source_member", "valid_row_count", "invalid_row_count", "first_date", "last_date")
BARS = ("instrument_id", "ticker", "exchange", "instrument_class", "date", "open", "high", "low", "close", "volume", "source_member", "source_row_number")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A symbol manifest; columns it lacks, and repeated ids or members, are fatal. Only the empty string is null."""
    names = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"the manifest has no columns {missing}")
    kinds = dict(x.split() for x in MANIFEST.split(", "))
    df = spark.read.option("header", True).option("nullValue", "").schema(", ".join(f"{c} string" for c in names)).csv(path)
    df = df.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in names))
    for key in ("instrument_id", "source_member"):
        if again := df.groupBy(key).count().filter("count > 1").orderBy(key).limit(10).collect():
            raise ValueError(f"repeated {key}: {[r[key] for r in again]}")
    return df


class Catalog:
    """``list`` filters the universe, ``bars`` gives all its valid bars as one table, ``load`` those of one instrument."""

    def __init__(self, spark: SparkSession, archive_path: str, manifest_path: str, policy: str = "drop"):
        if policy not in ("drop", "raise"):
            raise ValueError("policy is drop or raise")
        self.spark, self.archive, self.policy = spark, archive_path, policy
        self.manifest = read_manifest(spark, manifest_path)

    def list(self, **selection) -> DataFrame:
        """By exchange, instrument_class, require_rows, explicit and limit, as ``select_universe`` has them."""
        from ..operators.signals import select_universe

        return select_universe(self.manifest, **selection)

    def member_for(self, instrument_id: str) -> str:
        found = self.manifest.filter(F.col("instrument_id") == instrument_id).select("source_member").first()
        if found is None:
            raise KeyError(f"unknown instrument_id: {instrument_id}")
        return found[0]

    def load(self, instrument_id: str) -> DataFrame:
        """Only the instrument's member is read."""
        return bars_of(archive.read_zip(self.spark, self.archive, only=[self.member_for(instrument_id)]), self.policy)

    def bars(self, universe: DataFrame | None = None) -> DataFrame:
        """Bars of the universe, or of all instruments; sets instead of one instrument after the other."""
        members = (universe if universe is not None else self.manifest).select(F.col("source_member").alias("member"))
        return bars_of(archive.read_zip(self.spark, self.archive).join(members, "member", "left_semi"), self.policy)


def bars_of(lines: DataFrame, policy: str = "drop") -> DataFrame:
    """Typed bars of an archive's lines."""
    rows = load_valid(validate(classify_paths(archive.data_lines(lines)), "header_valid"), policy)
    return rows.withColumnsRenamed({"member": "source_member", "row_number": "source_row_number", "bar_date": "date"}).select(*BARS)
