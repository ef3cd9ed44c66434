"""Tables by extension, directories, run manifests and PMU files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"{path}: only .csv and .parquet are read")


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Parquet, or CSV with a header, partitioned by columns if asked for."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partitions) if partitions else w
    if path.endswith(".csv"):
        w.csv(path, header=True)
    else:
        w.parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_directory(spark: SparkSession, path: str, required: tuple[str, ...] = ("branch_id", "flow_mw")) -> DataFrame:
    """All Parquet files below path with one merged schema; the required columns must be among them."""
    d = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    missing = [c for c in required if c not in d.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return d.dropna(subset=list(required))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of the manifest's jobs with status ok, with scenario_id and time put in where a file lacks them."""
    jobs = spark.read.option("multiLine", True).json(path).select(F.explode("jobs").alias("j")).select("j.*").where("status = 'ok'").collect()
    if not jobs:
        raise ValueError(f"{path} has no job with status ok")
    parts = []
    for j in jobs:
        d, row = spark.read.parquet(j["output"]), j.asDict()
        for c in ("scenario_id", "time"):
            if c not in d.columns:
                d = d.withColumn(c, F.lit(row.get(c)))
        parts.append(d)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_pmu_csv(spark: SparkSession, path: str) -> DataFrame:
    """PMU frames by time: header names in any case; a value that can't be read becomes its default."""
    d = spark.read.csv(path, header=True)
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    at = lambda c, t, v: (F.coalesce(F.col(c).try_cast(t), F.lit(v).cast(t)) if c in d.columns else F.lit(v).cast(t)).alias(c)
    return d.select(at("timestamp", "long", 0), at("station", "string", ""), at("vm", "double", 1.0), at("va", "double", 0.0), at("frequency", "double", 60.0)).orderBy("timestamp")
