"""Linear and Newton kernels in numpy, one network a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve_dc(buses: list[int], frm: np.ndarray, to: np.ndarray, x: np.ndarray, injection: dict[int, float], slack: int | None = None) -> dict[int, float]:
    """Bus angles of a DC power flow; the slack, by default the first bus, has angle 0. Islands without the slack are singular."""
    at = {b: i for i, b in enumerate(buses)}
    b = np.zeros((len(buses), len(buses)))
    for f, t, v in zip(frm, to, 1 / np.maximum(np.abs(x), 1e-6), strict=True):
        i, j = at[f], at[t]
        b[i, i] += v
        b[j, j] += v
        b[i, j] -= v
        b[j, i] -= v
    s = at[slack if slack is not None else buses[0]]
    keep = [i for i in range(len(buses)) if i != s]
    p = np.array([injection.get(bus, 0.0) for bus in buses])
    theta = np.zeros(len(buses))
    theta[keep] = np.linalg.solve(b[np.ix_(keep, keep)], p[keep])
    return dict(zip(buses, theta, strict=True))


def _gathered(buses: DataFrame, branches: DataFrame, injections: DataFrame | None, key: str) -> DataFrame:
    """All rows of a network as one table, tagged by kind."""
    none = lambda t: F.lit(None).cast(t)
    b = buses.select(F.lit(0).alias("kind"), F.col("id"), none("long").alias("f"), none("long").alias("t"), none("double").alias("v"))
    e = branches.where("status").select(F.lit(1).alias("kind"), "id", F.col("from_bus").alias("f"), F.col("to_bus").alias("t"), (F.col("reactance_pu") * F.col("tap_ratio")).alias("v"))
    d = b.unionAll(e)
    if injections is not None:
        d = d.unionAll(injections.select(F.lit(2).alias("kind"), F.col("bus").alias("id"), none("long").alias("f"), none("long").alias("t"), F.col("injection_mw").alias("v")))
    return d.withColumn(key, F.lit(0))


def dc_flow(buses: DataFrame, branches: DataFrame, injections: DataFrame) -> DataFrame:
    """branch_id, from_bus, to_bus, flow_mw of the in-service branches; the slack takes the imbalance."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(g[g.kind == 0]["id"])
        e = g[g.kind == 1].sort_values("id")
        theta = solve_dc(ids, e.f.to_numpy().astype(int), e.t.to_numpy().astype(int), e.v.to_numpy(), dict(zip(g[g.kind == 2]["id"], g[g.kind == 2]["v"])))
        flow = (e.f.map(theta) - e.t.map(theta)) / np.maximum(np.abs(e.v), 1e-6)
        return pd.DataFrame({"branch_id": e.id.astype("int64"), "from_bus": e.f.astype("int64"), "to_bus": e.t.astype("int64"), "flow_mw": flow.astype(float)})

    return _gathered(buses, branches, injections, "net").groupBy("net").applyInPandas(run, "branch_id long, from_bus long, to_bus long, flow_mw double")


def ptdf(buses: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch_id, bus_id, ptdf) against the slack, the first bus, whose column is 0."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(g[g.kind == 0]["id"])
        at = {b: i for i, b in enumerate(ids)}
        e = g[g.kind == 1].sort_values("id")
        f, t = e.f.map(at).to_numpy().astype(int), e.t.map(at).to_numpy().astype(int)
        b = 1 / np.maximum(np.abs(e.v.to_numpy()), 1e-6)
        inc = np.zeros((len(e), len(ids)))
        inc[np.arange(len(e)), f] += 1
        inc[np.arange(len(e)), t] -= 1
        m = inc.T @ (b[:, None] * inc)
        h = np.zeros((len(e), len(ids)))
        h[:, 1:] = np.linalg.solve(m[1:, 1:], (b[:, None] * inc)[:, 1:].T).T
        return pd.DataFrame({"branch_id": np.repeat(e.id.to_numpy().astype("int64"), len(ids)), "bus_id": np.tile(np.array(ids, "int64"), len(e)), "ptdf": h.ravel()})

    return _gathered(buses, branches, None, "net").groupBy("net").applyInPandas(run, "branch_id long, bus_id long, ptdf double")


def newton(y: np.ndarray, p: np.ndarray, q: np.ndarray, v0: np.ndarray, kinds: list[str], tol: float = 1e-8, max_iter: int = 30) -> tuple[np.ndarray, np.ndarray, int, float]:
    """AC power flow in polar form; kinds are slack, pv or pq. Returns magnitudes, angles, iterations and the last mismatch."""
    n = len(p)
    vm, va = v0.copy(), np.zeros(n)
    pvpq = [i for i in range(n) if kinds[i] != "slack"]
    pq = [i for i in range(n) if kinds[i] == "pq"]
    worst = np.inf
    for it in range(max_iter + 1):
        v = vm * np.exp(1j * va)
        s = v * np.conj(y @ v)
        miss = np.r_[(p - s.real)[pvpq], (q - s.imag)[pq]]
        worst = float(np.abs(miss).max(initial=0.0))
        if worst < tol:
            return vm, va, it, worst
        i = y @ v
        dva = 1j * np.diag(v) @ np.conj(np.diag(i) - y @ np.diag(v))
        dvm = np.diag(v / vm) @ np.conj(np.diag(i)) + np.diag(v) @ np.conj(y @ np.diag(v / vm))
        j = np.block([[dva.real[np.ix_(pvpq, pvpq)], dvm.real[np.ix_(pvpq, pq)]], [dva.imag[np.ix_(pq, pvpq)], dvm.imag[np.ix_(pq, pq)]]])
        step = np.linalg.solve(j, miss)
        va[pvpq] += step[: len(pvpq)]
        vm[pq] += step[len(pvpq) :]
    return vm, va, max_iter, worst


def ac_flow(buses: DataFrame, ybus: DataFrame, injections: DataFrame, base_mva: float = 100.0) -> DataFrame:
    """bus_id, vm_pu, va_deg, iterations, mismatch: Newton's method with the first bus as slack and all others PQ."""
    b = buses.select(F.lit(0).alias("net"), F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    y = ybus.select(F.lit(0).alias("net"), "i", "j", "g", "b", F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    s = injections.select(F.lit(0).alias("net"), F.col("bus").alias("i"), F.col("bus").alias("j"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), (F.col("injection_mw") / base_mva).alias("p"), (F.col("injection_mvar") / base_mva).alias("q"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(g.i))
        at = {k: n for n, k in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)), complex)
        np.add.at(m, (g.i.map(at).to_numpy(), g.j.map(at).to_numpy()), g.g.to_numpy() + 1j * g.b.to_numpy())
        p, q = (np.bincount(g.i.map(at), g[c], len(ids)) for c in ("p", "q"))
        vm, va, it, worst = newton(m, p, q, np.ones(len(ids)), ["slack"] + ["pq"] * (len(ids) - 1))
        return pd.DataFrame({"bus_id": np.array(ids, "int64"), "vm_pu": vm, "va_deg": np.degrees(va), "iterations": np.int64(it), "mismatch": worst})

    return b.unionAll(y).unionAll(s).groupBy("net").applyInPandas(run, "bus_id long, vm_pu double, va_deg double, iterations long, mismatch double")
