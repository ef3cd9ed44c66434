"""Electrical and financial Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apparent_power(p: Column, q: Column) -> Column:
    return F.hypot(p, q)


def power_factor(p: Column, q: Column) -> Column:
    """P over apparent power with the sign of P, held to [-1, 1]; 1 without power."""
    s = apparent_power(p, q)
    return F.when(s > 0, clamp(p / s, -1.0, 1.0)).otherwise(1.0)


def active_power(s: Column, pf: Column) -> Column:
    return s * pf


def reactive_power(s: Column, pf: Column) -> Column:
    return s * F.sqrt(F.greatest(1 - pf * pf, F.lit(0.0)))


def admittance(r: Column, x: Column) -> Column:
    """(g, b) of an impedance; null for zero impedance."""
    z2 = r * r + x * x
    return F.when(z2 > 0, F.struct((r / z2).alias("g"), (-x / z2).alias("b")))


def whole_number(v: Column, bits: int = 64, signed: bool = True) -> Column:
    """A double as a whole number; null where it isn't one or is out of range, as for NaN."""
    low = F.lit(-(2.0 ** (bits - 1)) if signed else 0.0)
    return F.when((v == F.floor(v)) & (v >= low) & (v < F.lit(2.0 ** (bits - 1))), v).try_cast("int" if bits == 32 else "long")


def to_per_unit(kv: Column, base_kv: Column) -> Column:
    return F.when(base_kv > 0, kv / base_kv)


def to_kilovolts(pu: Column, base_kv: Column) -> Column:
    return pu * base_kv


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def capital_recovery(rate: Column, years: Column) -> Column:
    """r (1 + r)^n / ((1 + r)^n - 1); 1 / n at rates near 0."""
    g = F.pow(1 + rate, years)
    return F.when(rate < 1e-10, 1 / years).otherwise(rate * g / (g - 1))


def annualised_cost(cost: Column, rate: Column, years: Column) -> Column:
    return cost * capital_recovery(rate, years)
