"""Grid tables derived from the star schema, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: SQL by name; braces name star tables and other views. {epoch} is the dialect's seconds since 1970 of a timestamp.
VIEWS: dict[str, str] = {
    "buses": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS area_id, CAST(NULL AS BIGINT) AS zone_id, CAST(138 AS DOUBLE) AS voltage_kv, CAST(0.94 AS DOUBLE) AS vmin_pu, CAST(1.06 AS DOUBLE) AS vmax_pu, CAST((n_nationkey * 7) % 19 AS DOUBLE) AS lat, CAST((n_nationkey * 5) % 23 AS DOUBLE) AS lon FROM {nation}",
    "branches": "SELECT id, from_bus, to_bus, CAST(0.05 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (id % 7) AS reactance_pu, (CAST(0.05 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (id % 7)) / 5 AS resistance_pu, CAST(0.02 AS DOUBLE) AS charging_b_pu, CAST(1 AS DOUBLE) AS tap_ratio, CAST(0 AS DOUBLE) AS phase_shift_rad, CAST(100 + 10 * (id % 11) AS DOUBLE) AS rate_a_mva, id % 13 <> 0 AS status FROM (SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_nationkey + 1 AS BIGINT) AS from_bus, CAST((n_nationkey + 1) % 25 + 1 AS BIGINT) AS to_bus FROM {nation} UNION ALL SELECT CAST(n_nationkey + 26 AS BIGINT), CAST(n_nationkey + 1 AS BIGINT), CAST((n_nationkey + 6) % 25 + 1 AS BIGINT) FROM {nation}) b",
    "generators": "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_nationkey + 1 AS BIGINT) AS bus, CAST(0 AS DOUBLE) AS pmin_mw, greatest(s_acctbal, CAST(0 AS DOUBLE)) / 100 + 10 AS pmax_mw, CAST(10 + s_suppkey % 17 AS DOUBLE) AS c1, CAST(s_suppkey % 5 AS DOUBLE) AS c0, s_suppkey % 29 <> 0 AS status FROM {supplier}",
    "loads": "SELECT CAST(c_nationkey + 1 AS BIGINT) AS id, CAST(c_nationkey + 1 AS BIGINT) AS bus, sum(greatest(c_acctbal, CAST(0 AS DOUBLE))) / 2000 AS active_power_mw, sum(greatest(c_acctbal, CAST(0 AS DOUBLE))) / 8000 AS reactive_power_mvar FROM {customer} GROUP BY c_nationkey",
    "flows": "SELECT o_orderpriority AS scenario_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time, CAST(l_partkey % 50 + 1 AS BIGINT) AS branch_id, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS flow_mw, sum(CASE WHEN l_discount > CAST(0.09 AS DOUBLE) THEN l_tax ELSE CAST(0 AS DOUBLE) END) AS unserved_energy_mw FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY 1, 2, 3",
    "limits": "SELECT id AS branch_id, rate_a_mva AS flow_limit FROM ({branches}) b WHERE status",
    "series": "SELECT CAST({epoch} AS BIGINT) AS timestamp, event_type AS sensor, user_id, value FROM {events}",
    "assets": "SELECT CAST(s_suppkey AS BIGINT) AS asset_id, CAST(s_nationkey + 1 AS BIGINT) AS bus, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('agg', CAST(s_suppkey % 4 AS VARCHAR(9))) END AS agg_id, CAST(0 - s_suppkey % 5 AS DOUBLE) AS p_min, CAST(1 + s_suppkey % 7 AS DOUBLE) AS p_max, CAST(0 - s_suppkey % 3 AS DOUBLE) AS q_min, CAST(s_suppkey % 4 AS DOUBLE) AS q_max FROM {supplier}",
    "elements": "SELECT CAST(p_partkey AS BIGINT) AS element_id, CAST(p_size % 10 AS DOUBLE) / 100 AS failure_rate, CAST(1 + p_size % 8 AS DOUBLE) AS repair_hours FROM {part}",
    "lmp": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS bus_id, CAST(20 + (n_nationkey * 3) % 11 AS DOUBLE) AS lmp FROM {nation}",
    "scenarios": "SELECT o_orderpriority AS scenario_id, CAST(count(*) % 3 = 0 AS BOOLEAN) AS storm, CAST(count(*) % 2 = 0 AS BOOLEAN) AS storage, sum(o_totalprice) AS cost, CAST(1 + count(*) % 4 AS DOUBLE) / 2 AS load_scale FROM {orders} GROUP BY 1",
    "evaluations": "SELECT CAST(p_partkey AS BIGINT) AS contingency, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 1000 END AS probability, CAST(p_partkey % 7 AS DOUBLE) AS load_shed_mw, CAST(40 + p_partkey % 97 AS DOUBLE) / 80 AS max_loading, CAST(CASE WHEN p_partkey % 97 > 40 THEN 1 + p_partkey % 4 ELSE 0 END AS BIGINT) AS violations, p_partkey % 11 <> 0 AS converged FROM {part}",
    "trials": "SELECT CAST(o_orderkey AS BIGINT) AS trial, o_orderkey % 9 <> 0 AS converged, o_totalprice / 100000 AS mae_deg, o_totalprice / 80000 AS rmse_deg, o_totalprice / 50000 AS max_error_deg, CAST(o_custkey % 977 AS DOUBLE) / 10 AS se_time_ms FROM {orders}",
    "opf_limits": "SELECT id AS bus_id, pmax_mw / 10 AS pmin, pmax_mw AS pmax, pmax_mw * CAST(0.4 AS DOUBLE) AS demand FROM ({generators}) u",
    "opf_costs": "SELECT id AS bus_id, c1 AS marginal_cost FROM ({generators}) u WHERE status",
    "segments": "SELECT id AS bus_id, CAST(0 AS DOUBLE) AS start, pmax_mw / 2 AS end, c1 AS slope FROM ({generators}) u WHERE id % 3 = 0 UNION ALL SELECT id, pmax_mw / 2, pmax_mw, c1 + 5 FROM ({generators}) w WHERE id % 3 = 0",
    "corridors": "SELECT CAST(n_nationkey AS BIGINT) AS corridor_id, CAST(n_regionkey AS BIGINT) AS area_a, CAST(n_nationkey % 5 AS BIGINT) AS area_b, CAST(100 + n_nationkey AS DOUBLE) AS capacity_mw FROM {nation}",
    "windows": "SELECT CAST(c_nationkey % 5 AS BIGINT) AS area, CAST(c_custkey % 30 AS BIGINT) AS day FROM {customer} WHERE c_acctbal > 9000",
    "voltages": "SELECT CAST(c_custkey AS BIGINT) AS bus_id, CAST(90 + c_custkey % 21 AS DOUBLE) / 100 AS vm, CAST(c_custkey % 41 AS DOUBLE) / 30 AS va, CAST(c_nationkey AS BIGINT) AS case_id FROM {customer}",
}
EPOCH = {"spark": "CAST(datediff(ts, DATE '1970-01-01') AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)", "duckdb": "epoch(date_trunc('second', ts))"}


def text_of(view: str, dialect: str) -> str:
    """A view's SQL with the views that it reads put in; star tables stay in braces for Spark and plain for DuckDB."""
    sql = VIEWS[view]
    for v in VIEWS:
        if "{" + v + "}" in sql:
            sql = sql.replace("{" + v + "}", text_of(v, "raw"))
    if dialect == "raw":
        return sql
    sql = sql.replace("{epoch}", EPOCH[dialect])
    if dialect == "duckdb":
        for t in STAR:
            sql = sql.replace("{" + t + "}", t)
    return sql


class Grid:
    """The grid tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def star(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, view: str) -> DataFrame:
        if view not in VIEWS:
            raise AttributeError(view)
        sql = text_of(view, "spark")
        return self.spark.sql(sql, **{t: self.star(t) for t in STAR if "{" + t + "}" in sql})


def with_views(sql: str, *views: str) -> str:
    """DuckDB SQL with the named views as common table expressions."""
    parts = ", ".join(f"{v} AS ({text_of(v, 'duckdb')})" for v in views)
    head, body = ("WITH RECURSIVE ", sql.lstrip()[len("WITH RECURSIVE ") :]) if sql.lstrip().startswith("WITH RECURSIVE ") else ("WITH ", sql.lstrip()[5:]) if sql.lstrip().startswith("WITH ") else ("WITH ", None)
    return f"{head}{parts}, {body}" if body is not None else f"{head}{parts} {sql.lstrip()}"
