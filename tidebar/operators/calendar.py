"""A calendar of allowed directions: coloured bands of days, switched at their middles.

Each day (UTC+8) has a month index by twelve fixed boundaries and a colour by year and index. Successive days of one colour are a band;
the middle of a red band allows shorts only from the second two-hour candle's edge on, that of a green one longs only.
"""

from __future__ import annotations

from datetime import date, timedelta
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import DAY, DataError

EAST, TWO_HOURS = 8 * 3_600_000, 2 * 3_600_000
# fixed values: the first days of the months, as (month, day); what lies before the first and from the last on has index 11
BOUNDARIES = ((2, 4), (3, 6), (4, 5), (5, 6), (6, 6), (7, 7), (8, 7), (9, 8), (10, 8), (11, 7), (12, 7))


def colour(day: date) -> int:
    """+1 green, -1 red, 0 neither."""
    passed = sum((day.month, day.day) >= b for b in BOUNDARIES)
    index = 11 if passed in (0, len(BOUNDARIES)) else passed - 1
    stem = (2 * ((day.year - 4) % 5) + 2 + index) % 10
    return -1 if stem <= 5 else 1 if stem >= 8 else 0


def switches(first_year: int, last_year: int) -> list[tuple[int, int]]:
    """(time in ms, direction from then on) of the years and what surrounds them; about two a year."""
    start, stop = date(first_year - 2, 1, 1), date(last_year + 3, 1, 1)
    days = [start + timedelta(n) for n in range((stop - start).days)]
    bands = [(c, list(g)) for c, g in groupby(days, colour)]
    out = []
    for c, g in bands[1:-1]:  # the outer ones are cut off by the window
        if c:
            middle = (g[0] - date(1970, 1, 1)).days * DAY - EAST + len(g) * DAY // 2
            out.append((-(-middle // TWO_HOURS) * TWO_HOURS + TWO_HOURS, c))
    return out


def allowed_direction(at: Column, first_year: int, last_year: int) -> Column:
    """The direction allowed at a time in ms: a search in a short literal list, no join. Times before the first switch have none."""
    events = switches(first_year, last_year)
    if not events:
        raise DataError("no switch of direction in these years")
    times, ways = F.array(*(F.lit(t) for t, _ in events)), F.array(*(F.lit(d) for _, d in events))
    return F.try_element_at(ways, F.nullif(F.size(F.filter(times, lambda t: t <= at)), F.lit(0)))
