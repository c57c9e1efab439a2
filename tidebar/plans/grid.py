"""Parameter grids made lazily: a grid is a range of numbers and a rule that decodes them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
TIMEFRAMES = ("4h", "1h", "15m", "5m", "1m")
ATR_MULTIPLES = (0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0)
AVERAGES, CONFIRMS = (20, 60, 120), (1, 2, 3)
BAD_CLOSES = (5, 10, 15, 30)


def decode(id_: Column, **sizes: int) -> dict[str, Column]:
    """Digits of a number in a mixed radix; the last name counts fastest."""
    out, radix = {}, 1
    for name, size in reversed(sizes.items()):
        out[name] = (F.floor(id_ / radix) % size).cast("int")
        radix *= size
    return dict(reversed(out.items()))


def grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """config_id and one index for each dimension; nothing is multiplied out before it is read."""
    ids = spark.range(math.prod(sizes.values())).withColumnRenamed("id", "config_id")
    return ids.select("config_id", *(c.alias(n) for n, c in decode(F.col("config_id"), **sizes).items()))


def pairs(spark: SparkSession, n: int) -> DataFrame:
    """(pair_id, a, b) of all a < b < n in lexical order, each found from its number alone.

    Counted from the end, the rows of the last a's form triangles, so a follows from a square root."""
    total = n * (n - 1) // 2
    left = F.lit(total - 1) - F.col("id")
    row = F.floor((F.sqrt(8.0 * left + 1) - 1) / 2)
    a = F.lit(n - 2) - row
    b = F.lit(n - 1) - (left - row * (row + 1) / 2)
    return spark.range(total).select(F.col("id").alias("pair_id"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def all_stop_codes() -> list[str]:
    """The codes of all stop definitions, each at its frozen number: 912 older ones, 84 single, 84 x 26 and C(84, 2) pairs."""
    from itertools import combinations

    times = TIMEFRAMES[::-1]
    base = ["S1"]
    for t in times:
        for n in range(1, 5):
            for some in combinations([f"S{k}_{t}" for k in (3, 4, 5, 6)], n):
                base += ["+".join(some), "+".join(("S1", *some))]
    base.append("OFF")
    codes = base + [f"{b}+S9_{t}" for t in times for b in base]
    old = ["S1"] + [f"S{k}_{t}" for t in times for k in (3, 4, 5, 6, 9)]
    new = []
    for t in times:
        new += [f"ATR{int(k * 100)}_{t}" for k in ATR_MULTIPLES] + [f"MA{n}C{k}_{t}" for n in AVERAGES for k in CONFIRMS]
    new += [f"BAD{n}_1m" for n in BAD_CLOSES]
    return codes + new + [f"{o}+{x}" for x in new for o in old] + [f"{a}+{b}" for a, b in combinations(new, 2)]


def compound_id(kind: str, logic: str, members: list[str]) -> int:
    """A negative id that follows from what a compound rule is, in whatever order its members are given."""
    import hashlib
    import json

    text = json.dumps([kind, logic, sorted(set(members))], separators=(",", ":"))
    return -(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 1) - 1


def rate_code(percent: str) -> str:
    """The exact spelling of a percent rate: no float in between, no trailing zeros."""
    from decimal import Decimal

    value = Decimal(percent.strip().removesuffix("%")).normalize()
    return f"{value:f}"
