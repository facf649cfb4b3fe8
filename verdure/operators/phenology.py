"""Dates and quality of one growing cycle per pixel, as one window programme."""

from __future__ import annotations

from pyspark.sql import DataFrame

from verdure.config import DATES, Phenology
from verdure.operators.layers import PIXEL, SERIES, Layers, apply, at, best, render
from verdure.operators.series import clean_layers, gradient_layers

#: Columns of the result.
OUTPUT = ("pixel_id", *DATES, "season_length", "ndvi_min", "ndvi_max", "ndvi15", "n_obs", "max_gap_days", "last_obs", "qc")


def _parabola(series: str, index: str) -> Layers:
    """Sub-step offset of an extremum, at most half a step; none at the ends or where flat."""
    a, b, c = (f"{index}_{x}" for x in "abc")
    den = f"({a} - 2 * {b} + {c})"
    off = f"CASE WHEN {index} > 0 AND {index} < n_k - 1 AND {den} <> 0 THEN greatest(-0.5, least(0.5, 0.5 * ({a} - {c}) / {den})) ELSE 0.0 END"
    return [{a: at(index, series, -1), b: at(index, series), c: at(index, series, 1)}, {f"{index}_off": off}]


def _crossing(index: str, threshold: str, days: float, base: str = "t0") -> Layers:
    """Day at which the smoothed series crosses a threshold between an index and the next."""
    a, b = f"{index}_s0", f"{index}_s1"
    frac = f"CASE WHEN {b} - {a} <> 0 THEN greatest(0.0, least(1.0, ({threshold} - {a}) / ({b} - {a}))) ELSE 0.5 END"
    return [{a: at(index, "s"), b: at(index, "s", 1)}, {f"{index}_day": f"{base} + {days} * {index} + ({frac}) * {days}"}]


def _merge(*many: Layers) -> Layers:
    """Runs programmes side by side, layer by layer, so that their windows share nodes."""
    return [dict(x for own in many if i < len(own) for x in own[i].items()) for i in range(max(map(len, many)))]


def cycle_layers(n: int, days: float, start_day: int, c: Phenology) -> Layers:
    """The rules in their order; ``n`` composites, ``days`` apart, ``start_day`` the window's first day."""
    pre, post = round(c.pre_peak_days / days), round(c.post_peak_days / days)
    inside = "k BETWEEN p_lo AND p_hi"
    out = [*clean_layers(n, c), *gradient_layers("s", "g", n, days), *gradient_layers("g", "gg", n, days)]
    out += [
        {"t0": f"min(t) {PIXEL}", "lo_k": f"coalesce(min(CASE WHEN t - {start_day} >= {c.peak_search[0]} THEN k END) {PIXEL}, {n})", "hi_k": f"coalesce(max(CASE WHEN t - {start_day} <= {c.peak_search[1]} THEN k END) {PIXEL}, -1)"},
        {"p_lo": "greatest(lo_k, first_obs)", "p_hi": "least(hi_k, last_obs)"},
        {"s_top": best("max", inside, "s"), "left_min": f"min(CASE WHEN k >= first_obs THEN s END) OVER ({SERIES} ROWS BETWEEN {pre} PRECEDING AND 1 PRECEDING)"},
        {"ip_max": f"coalesce({best('min', f'{inside} AND s = s_top', 'k')}, 0)"},
    ]
    if c.peak_select == "last":
        local = "((g_p IS NULL OR s >= g_p) AND g_q IS NOT NULL AND s > g_q) OR (k = last_obs AND (g_p IS NULL OR s > g_p))"
        out += [{"ip_last": best("max", f"({local}) AND {inside} AND s - left_min >= {c.min_amplitude}", "k")}, {"ip": "coalesce(ip_last, ip_max)"}]
    else:
        out += [{"ip": "ip_max"}]
    out += [{"l_lo": f"greatest(first_obs, ip - {pre})", "r_hi": f"least(last_obs, ip + {post})"}]
    out += _merge(_parabola("s", "ip"), [{"vmin_l": best("min", "k BETWEEN l_lo AND ip - 1", "s"), "vmin_r": best("min", "k BETWEEN ip + 1 AND r_hi", "s")}])
    rise = "vmin_l" if c.base_mode == "separate" else "coalesce(least(vmin_l, vmin_r), vmin_l)"
    fall = "coalesce(vmin_r, vmin_l)" if c.base_mode == "separate" else rise
    out += [
        {"enough": f"n_obs >= {c.min_obs}", "left_ok": "coalesce(ip - 1 >= first_obs AND ip_a <= ip_b, false)", "right_ok": "coalesce(ip + 1 <= last_obs AND ip_c <= ip_b, false)", "vmax": "ip_b", "base_rise": rise, "fall_amp": "coalesce(ip_b - vmin_r, 0.0)"},
        {"rising": "p_hi >= p_lo AND left_ok AND ip = last_obs", "amp": "vmax - base_rise"},
        {"is_peak": "p_hi >= p_lo AND left_ok AND (right_ok OR rising)", "base_fall": f"CASE WHEN fall_amp < {c.min_fall} * amp THEN base_rise ELSE {fall} END"},
        {"pre_peak": f"rising OR (is_peak AND fall_amp < {c.peak_confirm} * amp)", "thr_rise": f"base_rise + {c.threshold} * (vmax - base_rise)", "thr_fall": f"base_fall + {c.threshold} * (vmax - base_fall)", "thr_head": f"base_rise + {c.heading} * (vmax - base_rise)", "thr_til": f"base_rise + {c.tiller_norm} * (vmax - base_rise)"},
        {"j": best("max", "s < thr_rise AND k < ip AND k >= l_lo", "k"), "kf": best("min", "s <= thr_fall AND k > ip AND k <= last_obs", "k"), "pi_hi": "CASE WHEN pre_peak THEN ip ELSE ip - 1 END"},
        {"has_harv": "kf IS NOT NULL AND NOT pre_peak", "kh": "kf - 1"},
        {"m_hi": "CASE WHEN has_harv THEN kf ELSE last_obs END", "jh": best("max", "s < thr_head AND k < ip AND k >= j", "k"), "jt": best("max", "s < thr_til AND k < ip AND k >= j", "k")},
    ]
    p = "s" if c.plant_from == "smoothed" else "f"
    out += [
        {"p_min": best("min", "k BETWEEN l_lo AND j", p), "g_max": best("max", "k BETWEEN j AND greatest(pi_hi, j)", "g"), "g_min": best("min", "k BETWEEN ip + 1 AND m_hi", "g")},
        {"i_plant": best("min", f"k BETWEEN l_lo AND j AND {p} = p_min", "k"), "i_pi": best("min", "k BETWEEN j AND greatest(pi_hi, j) AND g = g_max", "k"), "i_mat": best("min", "k BETWEEN ip + 1 AND m_hi AND g = g_min", "k")},
        {"gg_max": best("max", "k BETWEEN j AND greatest(i_pi, j)", "gg")},
        {"i_til": best("min", "k BETWEEN j AND greatest(i_pi, j) AND gg = gg_max", "k")},
    ]
    out += _merge(_crossing("j", "thr_rise", days), _crossing("jh", "thr_head", days), _crossing("jt", "thr_til", days), _crossing("kh", "thr_fall", days), _parabola(p, "i_plant"), _parabola("g", "i_pi"), _parabola("g", "i_mat"), _parabola("gg", "i_til"))
    day = lambda i: f"t0 + {days} * {i} + {i}_off * {days}"
    til_ok = "coalesce(i_til > j AND i_til < i_pi, false) AND pi0" if c.tiller_rule == "max_accel" else "jt IS NOT NULL"
    out += [
        {"d_emerg": "j_day", "d_harv": "kh_day", "d_head": "jh_day", "d_peak": day("ip"), "d_plant": day("i_plant"), "d_pi": day("i_pi"), "d_mat": day("i_mat"), "d_til": day("i_til") if c.tiller_rule == "max_accel" else "jt_day", "pi0": "coalesce((NOT pre_peak OR i_pi < ip - 1) AND i_pi > j AND i_pi < pi_hi, false)"},
        {"pi_ok": "pi0 AND d_pi >= d_emerg", "season": "d_harv - d_emerg", "m_ok": f"coalesce(i_mat IS NOT NULL AND NOT pre_peak AND (has_harv OR i_mat < m_hi) AND fall_amp >= {c.min_fall} * amp AND d_mat >= d_peak AND (NOT has_harv OR d_mat <= d_harv), false)", "plant_ok": "coalesce(i_plant > first_obs AND d_plant <= d_emerg, false)", "til0": til_ok},
        {"til_ok": "coalesce(til0 AND d_til >= d_emerg AND (NOT pi_ok OR d_til <= d_pi), false)", "head_ok": "coalesce(jh IS NOT NULL AND NOT pre_peak AND d_head <= d_peak AND (NOT pi_ok OR d_head >= d_pi), false)"},
        {
            "qc": f"CASE WHEN NOT enough THEN 10 WHEN NOT coalesce(is_peak, false) THEN 11 WHEN amp < {c.min_amplitude} THEN 12 WHEN NOT pre_peak AND vmax < {c.min_peak} THEN 13 WHEN base_rise > {c.max_base} THEN 14 WHEN j IS NULL THEN 15 "
            f"WHEN has_harv AND (season < {c.season_length[0]} OR season > {c.season_length[1]}) THEN 16 WHEN pre_peak THEN 2 WHEN has_harv THEN 0 ELSE 1 END"
        },
    ]
    return out


def _projection(days: float) -> dict[str, str]:
    put = lambda value, ok="true": f"CASE WHEN qc < 10 AND ({ok}) THEN {value} END"
    return {
        "pixel_id": "pixel_id", "plant": put("d_plant", "plant_ok"), "emergence": put("d_emerg"), "tillering": put("d_til", "til_ok"), "panicle_init": put("d_pi", "pi_ok"), "heading": put("d_head", "head_ok"), "peak": put("d_peak", "NOT pre_peak"),
        "maturity": put("d_mat", "m_ok"), "harvest": put("d_harv", "has_harv"), "season_length": put("season", "has_harv"), "ndvi_min": put("base_rise"), "ndvi_max": put("vmax"), "ndvi15": put("thr_rise"),
        "n_obs": "n_obs", "max_gap_days": f"CASE WHEN enough THEN max_gap * {days} END", "last_obs": "last_obs_day", "qc": "qc",
    }


def extract(series: DataFrame, n: int, days: float, start_day: int, c: Phenology | None = None) -> DataFrame:
    """One row per pixel from its series (pixel_id, k, t, v); pixels without any value have quality 10."""
    done = apply(series, cycle_layers(n, days, start_day, c or Phenology())).where("k = 0")
    return done.selectExpr(*(f"{e} AS {name}" for name, e in _projection(days).items()))


def extract_sql(source: str, n: int, days: float, start_day: int, c: Phenology | None = None) -> str:
    """The same programme for another engine."""
    parts = ", ".join(f"{e} AS {name}" for name, e in _projection(days).items())
    return f"SELECT {parts} FROM ({render(source, cycle_layers(n, days, start_day, c or Phenology()))}) WHERE k = 0"
