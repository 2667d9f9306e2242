"""Joins of many unit rows with few rows for each group.

Shuffling units by their group would gather a whole group in one task. Instead the group table is written once and counted:
within a bound it is sent to every task; beyond it, its rows are copied over salts and units meet the copy of their own salt,
so a group is spread over that many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopanel.session import materialised

#: Numbers (rows times numbers in a row) that may be sent to every task: 64 MB.
BROADCAST_NUMBERS = 8_000_000
SALTS = 64


def with_groups(units: DataFrame, groups: DataFrame, on: Sequence[str], width: int = 8, how: str = "inner", salt: str = "unit", bound: int = BROADCAST_NUMBERS) -> DataFrame:
    """``units`` joined with ``groups``, each row of which holds about ``width`` numbers."""
    groups = materialised(groups)
    if groups.count() * width <= bound:
        return units.join(F.broadcast(groups), list(on), how)
    salted = units.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
