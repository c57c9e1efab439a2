"""The catalogue of entry rules: data only; functions/predicates.py says what an algorithm means."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: rule number, algorithm, parameter
_SINGLE = (
    (5, "zero", 0), (6, "wick", 0.5), (7, "wick", 0.6), (8, "wick", 0.7),
    (9, "body", 0.3), (10, "body", 0.5), (11, "body", 0.7), (12, "slope", 1),
    (13, "slope", 3), (14, "slope", 5), (15, "distance", 0.001), (16, "distance", 0.002),
    (17, "distance", 0.004), (18, "macd_accel", 1), (19, "macd_accel2", 2), (20, "macd_amp_std", 0.5),
    (21, "macd_amp_std", 1), (22, "clv", 0.5), (23, "clv", 0.75), (24, "candle_align", 0),
    (25, "candle_body_align", 0.5), (26, "range_ratio_min", 1.5), (27, "range_ratio_max", 0.6), (28, "volume_ratio_min", 1.5),
    (29, "volume_ratio_min", 2.5), (30, "volume_ratio_max", 0.6), (31, "momentum_run", 3), (32, "momentum_run", 5),
    (33, "donchian_break", 20), (34, "donchian_break", 60), (35, "donchian_near", 0.1), (36, "boll_trend", 1),
    (37, "boll_contra", 1), (38, "rsi_trend", 55), (39, "rsi_contra", 35), (40, "efficiency_min", 0.5),
    (41, "efficiency_max", 0.25), (42, "distance_min", 0.002), (43, "distance", 0.0005), (44, "vwap_side", 20),
    (45, "vwap_distance", 0.001), (46, "close_break", 3), (47, "close_break", 10), (48, "inside_break", 0),
    (49, "sweep_reclaim", 0), (50, "micro_reversal", 0), (51, "candle_run", 3), (52, "candle_run", 5),
    (53, "taker_ratio", 0.6), (54, "taker_ratio", 0.7), (55, "taker_z", 1), (56, "delta_side", 0),
    (57, "cvd_slope", 5), (58, "trades_ratio", 1.5), (59, "avg_trade_ratio", 1.5), (60, "price_cvd_div", 3),
    (61, "minute_tail7", 0), (62, "price_tail78", 0), (63, "minute_fib", 0), (64, "macd_slope_run", 2),
    (65, "macd_slope_run", 3), (66, "macd_decel", 0), (67, "macd_z", 0.5), (68, "macd_z", 1.5),
    (69, "macd_near_zero", 0.25), (70, "zero_cross_event", 0), (71, "dual_macd_dir", 0), (72, "macd_dir_disagree", 0),
    (73, "hist_sign_align", 0), (74, "engulf", 0), (75, "outside_align", 0), (76, "pin_reversal", 0.6),
    (77, "close_extreme", 0.2), (78, "doji_break", 0.1), (79, "nr_n", 4), (80, "nr_n", 7),
    (81, "wr_n", 7), (82, "return2_min", 0.001), (83, "return5_min", 0.002), (84, "return5_contra", 0.002),
    (85, "two_bar_reversal", 0), (86, "failed_break_strong", 0), (87, "alternating", 3), (88, "alternating", 5),
    (89, "atr_regime_low", 0.75), (90, "atr_regime_high", 1.25), (91, "rv_regime_low", 0.75), (92, "rv_regime_high", 1.25),
    (93, "boll_width_low", 0.7), (94, "boll_width_high", 1.5), (95, "tr_z_high", 1.5), (96, "volume_z_high", 1),
    (97, "volume_z_low", 1), (98, "volume_falling", 3), (99, "taker_ratio", 0.55), (100, "taker_ratio", 0.65),
    (101, "taker_z", 2), (102, "cvd_slope", 3), (103, "cvd_slope", 10), (104, "trades_ratio_max", 0.6),
    (105, "avg_trade_ratio_max", 0.6), (106, "trades_z_high", 2), (107, "delta_z_side", 1), (108, "taker_contra", 0.65),
    (109, "flow_candle_align", 0), (110, "flow_absorption", 0), (111, "price_cvd_div", 10), (112, "minute_mod5", 0),
    (113, "minute_prime", 0), (114, "hour_odd", 0), (115, "hour_fib", 0), (116, "price_integer_tail7", 0),
    (117, "price_cents_0050", 0), (118, "volume_tail7", 0), (119, "trades_odd", 0), (120, "time_price_match", 0),
    (121, "time_hash20", 0), (122, "minute_mod13", 0), (123, "minute_13_37", 0), (124, "minute_double", 0),
    (125, "day_hour_match", 0), (126, "price_cents_special", 0), (127, "avg_size_tail7", 0), (128, "funding_contra", 0.0001),
    (129, "funding_contra", 0.0003), (130, "funding_align", 0), (131, "funding_flip_contra", 0), (132, "oi_change_min", 0.003),
    (133, "oi_change60_min", 0.01), (134, "oi_change_max", -0.003), (135, "oi_expand_confirm", 0.002), (136, "price_oi_squeeze", 0.002),
    (137, "oi_z_high", 1.5), (138, "oi_value_change_min", 0.003), (139, "oi_delever_trend", 0.003), (140, "quote_volume_ratio_min", 1.5),
    (141, "quote_volume_ratio_max", 0.6), (142, "taker_quote_ratio", 0.6), (143, "quote_delta_side", 0),
)

# fixed values: families of four rules each from number 144 on, with the parameters of the four
_FAMILIES = (
    ("kama", (10, 0), (10, .1), (20, 0), (20, .1)), ("dema", (10,), (20,), (40,), (80,)),
    ("hma", (9,), (16,), (25,), (36,)), ("tema", (10,), (20,), (40,), (60,)),
    ("trix", (5,), (10,), (20,), (30,)), ("reg_reentry", (20, 1), (20, 2), (60, 1), (60, 2)),
    ("reg_t", (20, 1), (20, 2), (60, 1), (60, 2)), ("rank_reentry", (20, .1), (20, .2), (60, .1), (60, .2)),
    ("stoch", (9, 20), (9, 30), (14, 20), (14, 30)), ("cci", (14, 100), (14, 150), (20, 100), (20, 150)),
    ("dmi", (14, 15), (14, 25), (28, 15), (28, 25)), ("aroon", (14, 50), (14, 70), (25, 50), (25, 70)),
    ("ha_turn", (3, 1), (3, 2), (5, 1), (5, 2)), ("pv_corr", (20, 0), (20, .3), (60, 0), (60, .3)),
    ("volume_absorb", (1.5, .25), (1.5, .5), (2, .25), (2, .5)), ("mfi", (14, 20), (14, 30), (28, 20), (28, 30)),
    ("chaikin", (3, 10), (3, 20), (5, 10), (5, 20)), ("semivar", (20, 1.5), (20, 2), (60, 1.5), (60, 2)),
    ("autocorr", (20, .1), (20, .25), (60, .1), (60, .25)), ("skew", (20, .5), (20, 1), (60, .5), (60, 1)),
    ("park_release", (10, 1.2), (10, 1.5), (20, 1.2), (20, 1.5)), ("squeeze_break", (20, .5), (20, .75), (60, .5), (60, .75)),
    ("daily_pivot", (0, 1), (.1, 1), (0, 2), (.1, 2)), ("range_reclaim", (10, 0), (10, .1), (20, .1), (60, .1)),
    ("opening_range", (15, 0), (15, .1), (60, 0), (60, .1)), ("impulse_pullback", (3, .5), (3, .8), (5, .5), (5, .8)),
    ("scale_div", (3, 20), (3, 60), (5, 20), (5, 60)), ("trade_intensity", (20, 1.2), (20, 1.5), (60, 1.2), (60, 1.5)),
    ("flow_accel", (3, .5), (3, 1), (10, .5), (10, 1)), ("flow_residual", (20, 1), (20, 2), (60, 1), (60, 2)),
)

# fixed values: numbers within the third catalogue (rule number less 263) that may run; the last 18 need feeds that there are none of
ACTIVE_THIRD = (15, 22, 23, 25, 26, 27, 28, 29, 31, 34, 35, 36, 37, 38, 39, 40, 41, 51, 55, 59, 70, 71, 72, 73, 77, 79, 81, 84, 85, 86, 87, 88, 90, 96, 97, 98, 99, 101, 102)
UNAVAILABLE_THIRD = tuple(range(103, 121))

#: Rules on labels without market meaning, kept to show what chance finds; they are never promoted.
PLACEBO = frozenset((61, 62, 63, *range(112, 128)))
#: What a rule needs beside prices and volume.
_NEEDS = {
    "ratio": ("taker_ratio", "taker_z", "taker_contra"),
    "delta": ("delta_side", "cvd_slope", "price_cvd_div", "delta_z_side", "flow_candle_align", "flow_absorption", "flow_accel", "flow_residual"),
    "trades": ("trades_ratio", "trades_ratio_max", "trades_z_high", "trades_odd", "trade_intensity"),
    "avg_size": ("avg_trade_ratio", "avg_trade_ratio_max", "avg_size_tail7"),
    "funding": ("funding_contra", "funding_align", "funding_flip_contra"),
    "oi": ("oi_change_min", "oi_change60_min", "oi_change_max", "oi_expand_confirm", "price_oi_squeeze", "oi_z_high", "oi_delever_trend"),
    "oiv": ("oi_value_change_min",),
    "qv": ("quote_volume_ratio_min", "quote_volume_ratio_max"),
    "tq_ratio": ("taker_quote_ratio",),
    "delta_quote": ("quote_delta_side",),
}


@dataclass(frozen=True)
class Rule:
    id: int
    algorithm: str
    params: tuple[float, ...]
    batch: str
    needs: tuple[str, ...] = ()
    status: str = "active"

    @property
    def placebo(self) -> bool:
        return self.id in PLACEBO


def _needs(algorithm: str) -> tuple[str, ...]:
    return tuple(k for k, v in _NEEDS.items() if algorithm in v)


def single_rules() -> list[Rule]:
    return [Rule(i, a, (float(p),), "single", _needs(a)) for i, a, p in _SINGLE]


def family_rules() -> list[Rule]:
    out: list[Rule] = []
    for name, *variants in _FAMILIES:
        out += [Rule(144 + len(out) + k, name, tuple(map(float, v)), "family", _needs(name)) for k, v in enumerate(variants)]
    return out


def third_rules() -> list[Rule]:
    status = lambda n: "unavailable" if n in UNAVAILABLE_THIRD else "active" if n in ACTIVE_THIRD else "retired"
    return [Rule(263 + n, f"t{n:03d}", (), "third", (), status(n)) for n in range(1, 121)]


def catalogue() -> list[Rule]:
    return single_rules() + family_rules() + third_rules()


def unavailable(rules: list[Rule], have: set[str], minutes: int) -> dict[int, str]:
    """Rules that cannot run on the columns at hand, with the reason; they are refused, not silently empty."""
    out = {}
    for r in rules:
        missing = [n for n in r.needs if n not in have]
        if r.status != "active":
            out[r.id] = r.status
        elif missing:
            out[r.id] = "needs " + ", ".join(missing)
        elif r.algorithm == "opening_range" and (minutes > r.params[0] or r.params[0] % minutes):
            out[r.id] = f"no opening range of {r.params[0]:.0f} minutes on {minutes}-minute bars"
    return out
