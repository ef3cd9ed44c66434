"""Column functions: units, costs and finance."""

from gridloom.functions.units import annualised_cost, apparent_power, capital_recovery, clamp, power_factor, to_kilovolts, to_per_unit

__all__ = ["annualised_cost", "apparent_power", "capital_recovery", "clamp", "power_factor", "to_kilovolts", "to_per_unit"]
