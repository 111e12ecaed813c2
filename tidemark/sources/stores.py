"""Stores: Parquet (or CSV) below a root with a manifest; content hashes do not depend on file order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder, put_in_place


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """``rows, content_sha256``: the hash of the sorted hashes of 4096 buckets, each a sum of its rows' hashes, so no task holds all rows."""
    body = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring("h", i, 8), 16, 10).cast("long")
    rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(4096)).alias("b"), body.alias("h"))
    sums = rows.groupBy("b").agg(F.count("*").alias("n"), *(F.sum(part(i)).cast("string").alias(f"s{i}") for i in (1, 9, 17, 25)))
    line = F.concat_ws(":", F.lpad(F.col("b").cast("string"), 4, "0"), F.col("n").cast("string"), "s1", "s9", "s17", "s25")
    return sums.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("content_sha256"))


def write_store(df: DataFrame, root: str, keys: list[str], schema_version: str, partitions: int = 16, replace: bool = False) -> dict:
    """Writes to a staging folder, counts and hashes what was written, and moves it to ``root``; refuses an existing target unless ``replace``.

    The manifest has the rows, their hash, and the schema, so that a read can tell a store of another shape.
    """
    spark = df.sparkSession
    if not replace and Folder(spark, root).exists():
        raise FileExistsError(root)
    staging = f"{root.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.repartition(partitions, *keys).write.option("compression", "zstd").parquet(f"{staging}/data")
    found = fingerprint(spark.read.parquet(f"{staging}/data"), keys).first()
    manifest = {"schema_version": schema_version, "keys": keys, "rows": found["rows"] or 0, "content_sha256": found["content_sha256"], "columns": df.schema.simpleString()}
    Folder(spark, staging).write_json("manifest.json", manifest)
    put_in_place(spark, staging, root, replace)
    return manifest


def read_manifest(spark: SparkSession, root: str) -> dict:
    return Folder(spark, root).read_json("manifest.json")


def read_store(spark: SparkSession, root: str, schema_version: str | None = None, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """A store's rows, or only some columns of them; ``verify`` hashes the content first."""
    manifest = read_manifest(spark, root)
    if schema_version and manifest["schema_version"] != schema_version:
        raise ValueError(f"{root} has schema {manifest['schema_version']}")
    df = spark.read.parquet(f"{root}/data")
    if verify and fingerprint(df, manifest["keys"]).first()["content_sha256"] != manifest["content_sha256"]:
        raise ValueError(f"{root} does not have the content of its manifest")
    return df.select(*columns) if columns else df


def catalog(spark: SparkSession, roots: dict[str, str], schema_version: str) -> DataFrame:
    """Several candidate stores as one, with ``generator_root``; a generator that two stores have is fatal, as is a repeated id."""
    out = None
    for name, root in sorted(roots.items()):
        own = read_store(spark, root, schema_version).withColumn("generator_root", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("a catalog needs a store")
    key = F.concat_ws("|", "setup_family", "setup_version", "direction")
    shared = out.groupBy(key.alias("key")).agg(F.countDistinct("generator_root").alias("n")).filter("n > 1").orderBy("key").limit(10).collect()
    if shared:
        raise ValueError(f"generators in several stores: {[r['key'] for r in shared]}")
    if again := out.groupBy("candidate_id").count().filter("count > 1").limit(3).collect():
        raise ValueError(f"repeated candidate ids: {[r['candidate_id'] for r in again]}")
    return out


def verify_store(spark: SparkSession, root: str, protected: str | None = None) -> dict:
    """Rows, content and schema against the manifest, repeated keys, and rows that fulfil the SQL condition ``protected``."""
    manifest = read_manifest(spark, root)
    df = spark.read.parquet(f"{root}/data")
    found = fingerprint(df, manifest["keys"]).first()
    twice = df.groupBy(*manifest["keys"]).count().filter("count > 1").count()
    out = {"rows": (found["rows"] or 0) == manifest["rows"], "content": found["content_sha256"] == manifest["content_sha256"], "duplicate_keys": twice}
    return out if protected is None else out | {"protected_rows": df.filter(protected).count()}


def passed(report: dict) -> bool:
    return bool(report["rows"] and report["content"] and not report["duplicate_keys"] and not report.get("protected_rows", 0))


def compare_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b``: rows of either that the other lacks."""
    columns = sorted(a.columns)
    left, right = a.select(columns), b.select(columns)
    only_a = left.exceptAll(right).agg(F.count("*").alias("only_a"))
    return only_a.join(F.broadcast(right.exceptAll(left).agg(F.count("*").alias("only_b"))))  # one row each


def csv_cells(df: DataFrame) -> DataFrame:
    """Cells as text: doubles with at most 12 significant digits, arrays, maps and structs as JSON, null as the empty string."""
    cells = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            cells.append(significant(F.col(c)).alias(c))
        elif kind.startswith(("array", "map", "struct")):
            cells.append(F.to_json(c).alias(c))
        else:
            cells.append(F.col(c).cast("string").alias(c))
    return df.select(*(F.coalesce(x, F.lit("")) for x in cells)).toDF(*df.columns)


def significant(c: Column, digits: int = 12) -> Column:
    """A double as C's %.12g writes it: the shorter of fixed and exponent form, without trailing zeros."""
    text = F.format_string(f"%.{digits - 1}e", c)
    exponent = F.regexp_extract(text, "e([+-][0-9]+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(-?[0-9.]+)e", 1), "[.]?0+$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), F.abs(exponent).cast("string"))).otherwise(F.abs(exponent).cast("string")))
    forms = F.lit(None).cast("string")
    for places in range(digits + 4):  # as many places as the exponent leaves
        forms = F.when(digits - 1 - exponent == places, F.format_string(f"%.{places}f", c)).otherwise(forms)
    plain = F.when(forms.contains("."), F.regexp_replace(forms, "[.]?0+$", "")).otherwise(forms)
    return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when((exponent < -4) | (exponent >= digits), scientific).otherwise(plain)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of gzip files, published when complete; with ``order`` its files follow each other in that order."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    csv_cells(df.orderBy(*order) if order else df).write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(staging)
    put_in_place(spark, staging, path, True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, after those that are there."""
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a line that is none raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_predictions(oof: DataFrame, root: str) -> dict:
    """Out-of-fold predictions as a folder of CSV for each family, and a manifest with their rows and content hashes."""
    spark, out = oof.sparkSession, {}
    for (family,) in oof.select("setup_family").distinct().orderBy("setup_family").collect():  # one row a family
        own = oof.filter(F.col("setup_family") == family)
        found = fingerprint(own, ["candidate_id"]).first()
        write_csv(own, f"{root}/{family}.csv", ["signal_date", "instrument_id", "candidate_id"])
        out[family] = {"oof_rows": found["rows"], "content_sha256": found["content_sha256"], "relative_path": f"{family}.csv"}
    Folder(spark, root).make().write_json("manifest.json", out)
    return out


def pending(work: DataFrame, done: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Work items that no earlier run finished, at most ``most`` of them, by key."""
    rest = work.join(done.select(*keys).distinct(), keys, "left_anti")
    return rest.orderBy(*keys).limit(most) if most else rest
