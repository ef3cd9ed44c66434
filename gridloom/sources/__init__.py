"""Readers and writers."""

from gridloom.sources.formats import detect_format
from gridloom.sources.matpower import parse_matpower, read_matpower
from gridloom.sources.powermodels import read_powermodels, write_powermodels
from gridloom.sources.tables import read_directory, read_manifest, read_pmu_csv, read_table, write_json_lines, write_table

__all__ = ["detect_format", "parse_matpower", "read_directory", "read_manifest", "read_matpower", "read_pmu_csv", "read_powermodels", "read_table", "write_json_lines", "write_powermodels", "write_table"]
