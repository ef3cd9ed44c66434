"""Which file format a network file has."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: The extensions of each format.
EXTENSIONS = {"matpower": ("m", "mat", "matpower", "case"), "psse": ("raw",), "cim": ("rdf", "xml"), "pandapower": ("json",), "powermodels": ("json",)}
#: Characters looked at; text that is in every file of the format, and text that one that names itself has.
LOOKED_AT = 4096
MARKS = {"cim": (("rdf:RDF",), ("cim:",)), "pandapower": (("pandapower",), ("pandapowerNet",)), "powermodels": (('"bus"', '"branch"'), ('"baseMVA"',))}


def detect_format(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(format, confidence) by extension and, for XML and JSON, by the start of the file; None for other extensions.

    low: the extension alone; medium: .m, .raw and their like, or some marks; high: all marks. Of the two JSON formats the one with more marks is taken, pandapower on a tie.
    """
    extension = os.path.splitext(path)[1][1:].lower()
    named = [f for f, found in EXTENSIONS.items() if extension in found]
    if not named or named[0] not in MARKS:
        return (named[0], "medium") if named else None
    start = spark.read.text(path, wholetext=True).select(F.substring("value", 1, LOOKED_AT)).first()
    start = start[0] if start else ""

    def score(name: str) -> int:
        general, own = (all(m in start for m in marks) for marks in MARKS[name])
        return general + own

    best = max(named, key=score)
    return best, ("low", "medium", "high")[score(best)]
