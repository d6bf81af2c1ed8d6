"""Binary data as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_lines(data: Column) -> Column:
    """base64 in lines of 72 characters, each ended by a line feed; nothing gives one line feed."""
    flat = F.regexp_replace(F.base64(data), "[\\r\\n]", "")
    cut = F.regexp_replace(flat, "(.{72})", "$1\n")
    return F.when(F.endswith(cut, F.lit("\n")), cut).otherwise(F.concat(cut, F.lit("\n")))
