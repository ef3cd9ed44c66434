"""PowerModels JSON cases, any number of files at once, as grid tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The elements of a case that are read, with their fields. The names are those of the file format.
FIELDS = {
    "bus": "index long, name string, base_kv double, vm double, va double, vmin double, vmax double, area long, zone long",
    "gen": "index long, name string, gen_bus long, pg double, qg double, pmin double, pmax double, qmin double, qmax double, vg double, mbase double, gen_status long, model long, cost array<double>",
    "load": "index long, name string, load_bus long, pd double, qd double, status long",
    "shunt": "index long, shunt_bus long, gs double, bs double, status long",
    "branch": "index long, name string, f_bus long, t_bus long, br_r double, br_x double, b_fr double, b_to double, tap double, shift double, rate_a double, rate_b double, rate_c double, br_status long, transformer boolean",
}
SCHEMA = "baseMVA double, per_unit boolean, " + ", ".join(f"{k} map<string, struct<{', '.join(f.replace(' ', ': ', 1) for f in v.split(', '))}>>" for k, v in FIELDS.items())


def _or(c: str, default: float | int) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _named(prefix: str) -> Column:
    return F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, F.concat(F.lit(prefix), F.col("index"))).otherwise(F.col("name"))


def read_powermodels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cases (case, base_mva, per_unit), buses, generators, loads, shunts and branches of all files of path, each with its case, the file's name.

    Quantities are taken as the file states them, per unit or not. A tap of 0 is 1, a missing or zero base_kv 138; polynomial costs are turned to rise by power and have three terms, piecewise ones keep their points. Elements at buses that their case lacks are in the table skipped (case, entity, id, bus) instead.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path).withColumn("case", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = lambda kind: raw.select("case", F.explode(F.map_values(kind)).alias("e")).select("case", "e.*")
    bus = rows("bus").select("case", F.col("index").alias("id"), _named("Bus_").alias("name"), F.when(F.col("base_kv") > 0, F.col("base_kv")).otherwise(138.0).alias("voltage_kv"), _or("vm", 1.0).alias("voltage_pu"), _or("va", 0.0).alias("angle_rad"), "vmin", "vmax", F.col("area").alias("area_id"), F.col("zone").alias("zone_id"))
    last = lambda n: F.when(F.size("cost") >= n, F.element_at("cost", -n)).otherwise(0.0)
    some = F.coalesce(F.size("cost"), F.lit(0)) > 0
    coeffs = F.when((_or("model", 2) == 2) & some, F.array(last(1), last(2), last(3))).otherwise(F.array().cast("array<double>"))
    points = F.when((F.col("model") == 1) & some, F.slice("cost", 1, F.size("cost") - F.size("cost") % 2)).otherwise(F.array().cast("array<double>"))
    gen = rows("gen").select("case", F.col("index").alias("id"), _named("Gen_").alias("name"), F.col("gen_bus").alias("bus"), _or("pg", 0.0).alias("active_power_mw"), _or("qg", 0.0).alias("reactive_power_mvar"), _or("pmin", 0.0).alias("pmin_mw"), _or("pmax", 0.0).alias("pmax_mw"), _or("qmin", 0.0).alias("qmin_mvar"), _or("qmax", 0.0).alias("qmax_mvar"), _or("vg", 1.0).alias("voltage_setpoint_pu"), (_or("gen_status", 1) == 1).alias("status"), coeffs.alias("cost_coeffs"), points.alias("cost_values"))
    load = rows("load").select("case", F.col("index").alias("id"), _named("Load_").alias("name"), F.col("load_bus").alias("bus"), _or("pd", 0.0).alias("active_power_mw"), _or("qd", 0.0).alias("reactive_power_mvar"))
    shunt = rows("shunt").select("case", F.col("index").alias("id"), F.col("shunt_bus").alias("bus"), _or("gs", 0.0).alias("gs"), _or("bs", 0.0).alias("bs"), (_or("status", 1) == 1).alias("status"))
    tap = F.when(_or("tap", 0.0) == 0, 1.0).otherwise(F.col("tap"))
    branch = rows("branch").select("case", F.col("index").alias("id"), _named("Branch_").alias("name"), F.col("f_bus").alias("from_bus"), F.col("t_bus").alias("to_bus"), _or("br_r", 0.0).alias("resistance_pu"), _or("br_x", 0.0).alias("reactance_pu"), (_or("b_fr", 0.0) + _or("b_to", 0.0)).alias("charging_b_pu"), tap.alias("tap_ratio"), _or("shift", 0.0).alias("phase_shift_rad"), F.col("rate_a").alias("rate_a_mva"), "rate_b", "rate_c", (_or("br_status", 1) == 1).alias("status"), F.when(_or("transformer", False), "transformer").otherwise("line").alias("element_type"))
    known = bus.select("case", F.col("id").alias("bus"))
    found, skipped = {"cases": raw.select("case", _or("baseMVA", 100.0).alias("base_mva"), _or("per_unit", True).alias("per_unit")), "buses": bus}, None
    for name, entity, d, ends in (("generators", "generator", gen, ["bus"]), ("loads", "load", load, ["bus"]), ("shunts", "shunt", shunt, ["bus"]), ("branches", "branch", branch, ["from_bus", "to_bus"])):
        for end in ends:
            at = known.withColumnRenamed("bus", end)
            lost = d.join(at, ["case", end], "left_anti").select("case", F.lit(entity).alias("entity"), "id", F.col(end).alias("bus"))
            skipped = lost if skipped is None else skipped.unionByName(lost)
            d = d.join(at, ["case", end], "left_semi")
        found[name] = d
    return found | {"skipped": skipped}


def write_powermodels(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON line a case, elements by their id as text, each case made on the executors; read_powermodels reads the files back under other names."""

    def by_id(table: str, out: str, /, **fields: Column) -> DataFrame:
        e = F.struct(F.col("id").alias("index"), *[v.alias(k) for k, v in fields.items()])
        return tables[table].groupBy("case").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string"), e)))).alias(out))

    c, flag = F.col, lambda x: F.col(x).cast("int")
    polynomial = F.size("cost_coeffs") > 0
    parts = [
        by_id("buses", "bus", name=c("name"), base_kv=c("voltage_kv"), vm=c("voltage_pu"), va=c("angle_rad"), vmin=c("vmin"), vmax=c("vmax"), area=c("area_id"), zone=c("zone_id")),
        by_id("generators", "gen", name=c("name"), gen_bus=c("bus"), pg=c("active_power_mw"), qg=c("reactive_power_mvar"), pmin=c("pmin_mw"), pmax=c("pmax_mw"), qmin=c("qmin_mvar"), qmax=c("qmax_mvar"), vg=c("voltage_setpoint_pu"), gen_status=flag("status"), model=F.when(polynomial, 2).otherwise(1), cost=F.when(polynomial, F.reverse("cost_coeffs")).otherwise(c("cost_values"))),
        by_id("loads", "load", name=c("name"), load_bus=c("bus"), pd=c("active_power_mw"), qd=c("reactive_power_mvar"), status=F.lit(1)),
        by_id("shunts", "shunt", shunt_bus=c("bus"), gs=c("gs"), bs=c("bs"), status=flag("status")),
        by_id("branches", "branch", name=c("name"), f_bus=c("from_bus"), t_bus=c("to_bus"), br_r=c("resistance_pu"), br_x=c("reactance_pu"), b_fr=c("charging_b_pu") / 2, b_to=c("charging_b_pu") / 2, tap=c("tap_ratio"), shift=c("phase_shift_rad"), rate_a=c("rate_a_mva"), rate_b=c("rate_b"), rate_c=c("rate_c"), br_status=flag("status"), transformer=c("element_type") == "transformer"),
    ]
    d = tables["cases"]
    for p in parts:
        d = d.join(p, "case", "left")
    d = d.withColumnRenamed("base_mva", "baseMVA")
    d.repartition("case").select(F.to_json(F.struct(*[x for x in d.columns if x != "case"])).alias("value"), "case").write.mode("overwrite").partitionBy("case").text(path)
