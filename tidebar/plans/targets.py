"""The catalogue of take-profit plans: every plan of the bounded grids, at its frozen number.

A grid is a kind with axes; its plans are the product of the axes, the last fastest. Later grids only follow earlier ones and leave
out what is there already, so a number once given stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

FRAMES = ("1m", "5m", "15m", "1h", "4h")
SUBSETS = tuple("+".join(c) for n in range(1, 6) for c in combinations(FRAMES, n))


@dataclass(frozen=True)
class Target:
    id: int
    kind: str
    frames: str = ""
    indicator: str = ""
    p1: float = 0.0
    p2: float = 0.0
    p3: float = 0.0


def _rates(a: int, b: int, step: int = 1, scale: int = 1000) -> tuple[float, ...]:
    return tuple(x / scale for x in range(a, b + 1, step))


# fixed values: the axes of the grids
WHOLE = _rates(1, 10)
FINE = _rates(1, 9, scale=10_000)
ACTIVATIONS = _rates(1, 20)
EARLY = (0.0005, 0.00075, 0.001, 0.00125, 0.0015, 0.00175, 0.002, 0.0025)
EARLY_SHARES = (0.01, 0.02, 0.03, 0.05, 0.075, 0.10, 0.125, 0.15, 0.20)


def _grid(kind: str, frames=("",), indicators=("",), p1=(0.0,), p2=(0.0,), p3=(0.0,)) -> Iterator[tuple]:
    return ((kind, f, i, float(a), float(b), float(c)) for f, i, a, b, c in product(frames, indicators, p1, p2, p3))


def _first_round() -> Iterator[tuple]:
    yield from _grid("none")
    yield from _grid("fixed", p1=WHOLE)
    yield from _grid("fixed_by_day", p1=WHOLE, p2=WHOLE)
    yield from _grid("reversal", SUBSETS, ("hist", "dif"), (1, 2, 3))
    yield from _grid("deviation", SUBSETS, ("ma20", "ma120"), (1, 2, 3), (0.002, 0.004, 0.006, 0.008, 0.010))
    yield from _grid("structure", SUBSETS, ("pivots",), (0.0, 0.0005, 0.001, 0.002))
    yield from _grid("risk", ("",), ("r",), (0.5, 1.0, 1.5, 2.0, 3.0, 4.0))
    yield from _grid("trail", ("",), ("share",), ACTIVATIONS, _rates(5, 50, 5, 100))
    yield from _grid("trail", ("",), ("price",), ACTIVATIONS, _rates(5, 50, 5, 10_000))
    yield from _grid("lock", ("",), ("close",), ACTIVATIONS, (0.0, 0.0005, 0.001, 0.0015, 0.002))
    yield from _grid("time", ("",), ("minutes",), (15, 30, 60, 120, 240))
    yield from _grid("divergence", SUBSETS, ("hist", "dif"), (5, 10, 20), (1, 2, 3))


def _parts(rows: list[tuple]) -> Iterator[tuple]:
    """Half closed at a fixed rate, the rest by a reversal or a trailing plan, which p3 names by its number."""
    rest = [(n, r) for kind in ("reversal", "trail") for n, r in enumerate(rows, 1) if r[0] == kind]
    return (("parts", r[1], r[2], rate, 0.5, float(n)) for rate in WHOLE for n, r in rest)


def _second_round(shares: list[float]) -> Iterator[tuple]:
    for f in FRAMES:
        yield from _grid("ma_cross", (f,), ("ma20", "ma120"), (1, 2, 3))
        yield from _grid("fade", (f,), ("volume20",), (0.3, 0.5, 0.7), (1, 2, 3))
    yield from _grid("time", ("",), ("minutes",), (1, 3, 5, 10, 45, 90))
    yield from _grid("trail", ("",), ("share",), shares, tuple(x / 200 for x in range(2, 21)))
    yield from _grid("atr", FRAMES, ("atr14",), (0.5, 1.0, 1.5, 2.0, 3.0, 4.0))
    yield from _grid("fixed", p1=FINE)
    both = tuple(sorted({*FINE, *WHOLE}))
    yield from (r for r in _grid("fixed_by_day", p1=both, p2=both) if r[3] in FINE or r[4] in FINE)
    yield from _grid("time", ("",), ("minutes",), (2, 20, 180, 360, 480, 720, 1440))


def target_catalogue() -> list[Target]:
    """All plans in the order of their numbers, from 1."""
    rows = list(_first_round())
    rows += list(_parts(rows))
    known = {(r[2], r[3], r[4]) for r in rows if r[0] == "trail"}

    def add(more: Iterator[tuple]) -> None:
        for r in more:
            key = r[2], r[3], r[4]
            if r[0] != "trail" or key not in known:
                known.add(key) if r[0] == "trail" else None
                rows.append(r)

    add(_grid("trail", ("",), ("share",), EARLY, EARLY_SHARES))
    add(_second_round(sorted({r[3] for r in rows if r[0] == "trail" and r[2] == "share"})))
    return [Target(n, *r) for n, r in enumerate(rows, 1)]
