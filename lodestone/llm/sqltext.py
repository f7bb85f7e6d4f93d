"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of one byte per character take the vectorised lower(), the others translate()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def column(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(*names: str) -> list[Column]:
    """Those columns, each once."""
    return [column(n) for n in dict.fromkeys(names)]
