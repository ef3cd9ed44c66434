"""Scenarios: defaults filled in, tables per scenario, batches with captured errors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(scenarios: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Every scenario with the defaults where it has nulls, one row for each of its time slices; raises where none is left."""
    d = scenarios.select([F.coalesce(F.col(c), F.lit(defaults[c]).cast(t)).alias(c) if defaults.get(c) is not None else F.col(c) for c, t in scenarios.dtypes])
    slices = F.when(F.coalesce(F.size("time_slices"), F.lit(0)) <= 0, F.raise_error(F.concat(F.lit("no time slice in scenario "), F.coalesce("scenario_id", F.lit("?"))))).otherwise(F.col("time_slices"))
    return d.select(*[c for c in d.columns if c != "time_slices"], F.explode(slices).alias("time"))


def apply_generators(scenarios: DataFrame, generators: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every scenario's units: renewables scaled, and output set where overrides (scenario_id, id, p_mw) name it. Both sides of the product are short: scenarios times units is the result's own size."""
    o = overrides.select("scenario_id", "id", F.col("p_mw").alias("_p"))
    d = generators.crossJoin(scenarios.select("scenario_id", "renewable_scale")).join(o, ["scenario_id", "id"], "left")
    scale = F.when(F.col("is_renewable"), F.coalesce("renewable_scale", F.lit(1.0))).otherwise(1.0)
    return d.select("scenario_id", "id", "bus", F.coalesce("_p", F.col("pmax_mw") * scale).alias("pmax_mw"))


def named(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (wanted, id): entities whose name equals the wanted text, else whose id it is."""
    by_name = wanted.join(df.select("id", "name"), F.col("wanted") == F.col("name")).select("wanted", "id")
    rest = wanted.join(by_name.select("wanted").distinct(), "wanted", "left_anti").withColumn("id", F.col("wanted").try_cast("long"))
    return by_name.unionByName(rest.join(df.select("id"), "id").select("wanted", "id"))


def materialise(per_scenario: DataFrame, path: str) -> None:
    """One folder a scenario."""
    per_scenario.write.mode("overwrite").partitionBy("scenario_id").parquet(path)


def run_batch(rows: DataFrame, study: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "scenario_id") -> DataFrame:
    """study of each scenario's rows, with status and error: a study that raises gives one row of nulls and its message, and the others go on. A scenario's rows must fit one task."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields: StructType = _parse_datatype_string(schema)
    names = fields.fieldNames()

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        try:
            out, status, error = study(g)[names], "ok", None
        except Exception as e:  # noqa: BLE001
            out, status, error = pd.DataFrame({n: [None] for n in names}), "error", f"{type(e).__name__}: {e}"
        return out.assign(**{key: k[0], "status": status, "error": error})[[key, *names, "status", "error"]]

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}, status string, error string")


def batch_manifest(results: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Numbers of scenarios, of those that went well and of those that failed."""
    per = results.groupBy(key).agg(F.max(F.col("status") == "ok").alias("ok"))
    return per.agg(F.count("*").alias("n_jobs"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum((~F.col("ok")).cast("long")).alias("n_failed"))
