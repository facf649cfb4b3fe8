"""The whole cycle detection against plain code, rule by rule, on random series and settings."""

import math
from dataclasses import replace

import numpy as np
import pytest
from test_cycles import bell, dates, days, frame, smooth_by_hand, two_crops

from verdure.config import DATES, Phenology
from verdure.operators import phenology


def offset(a, i):
    """Sub-step place of an extremum; none at the ends or where flat."""
    if i <= 0 or i >= len(a) - 1:
        return 0.0
    den = a[i - 1] - 2 * a[i] + a[i + 1]
    return 0.0 if den == 0 else max(-0.5, min(0.5, 0.5 * (a[i - 1] - a[i + 1]) / den))


def crossing(s, i, threshold, t0, dt):
    rise = s[i + 1] - s[i]
    return t0 + dt * i + dt * (0.5 if rise == 0 else max(0.0, min(1.0, (threshold - s[i]) / rise)))


def first_best(values, indices, sign):
    """The first index of the greatest (sign 1) or least (sign -1) value; None without indices."""
    best = None
    for i in indices:
        if best is None or sign * values[i] > sign * values[best]:
            best = i
    return best


def last_cycle(s, lo, hi, first, last, pre, amplitude):
    """The latest local maximum, or the still rising end, that rises enough over what came before; else the highest."""
    found = None
    for k in range(lo, hi + 1):
        top = (k > 0 and s[k] >= s[k - 1] and k < len(s) - 1 and s[k] > s[k + 1]) or (k == last and k > 0 and s[k] >= s[k - 1])
        before = [s[i] for i in range(max(first, k - pre), k)]
        if top and before and s[k] - min(before) >= amplitude:
            found = k
    return first_best(s, range(lo, hi + 1), 1) if found is None else found


def cycle_by_hand(v, t0, dt, start, c):
    n = len(v)
    seen = [k for k in range(n) if v[k] is not None]
    out = dict.fromkeys((*DATES, "season_length"))
    out |= {"n_obs": len(seen), "last_obs": t0 + dt * seen[-1] if seen else None, "max_gap_days": dt * max([b - a for a, b in zip(seen, seen[1:], strict=False)], default=0)}
    if len(seen) < c.min_obs:
        return out | {"qc": 10, "max_gap_days": None}
    f, s = smooth_by_hand(v)
    g = np.gradient(s, dt)
    gg = np.gradient(g, dt)
    first, last = seen[0], seen[-1]
    pre, post = round(c.pre_peak_days / dt), round(c.post_peak_days / dt)
    inside = [k for k in range(n) if c.peak_search[0] <= t0 + dt * k - start <= c.peak_search[1] and first <= k <= last]
    if not inside:
        return out | {"qc": 11}
    lo, hi = inside[0], inside[-1]
    ip = last_cycle(s, lo, hi, first, last, pre, c.min_amplitude) if c.peak_select == "last" else first_best(s, inside, 1)
    left_ok = ip - 1 >= first and s[ip - 1] <= s[ip]
    right_ok = ip + 1 <= last and s[ip + 1] <= s[ip]
    rising = left_ok and ip == last
    if not (left_ok and (right_ok or rising)):
        return out | {"qc": 11}
    l_lo, m_hi = max(first, ip - pre), min(last, ip + post)
    left = first_best(s, range(l_lo, ip), -1)
    right = first_best(s, range(ip + 1, m_hi + 1), -1)
    top = s[ip]
    rise_base = s[left]
    fall_base = rise_base if right is None else s[right]
    if c.base_mode == "single":
        rise_base = fall_base = min(rise_base, fall_base)
    amp = top - rise_base
    fall = 0.0 if right is None else top - s[right]
    if fall < c.min_fall * amp:
        fall_base = rise_base
    rising = rising or fall < c.peak_confirm * amp
    up, down = rise_base + c.threshold * (top - rise_base), fall_base + c.threshold * (top - fall_base)
    head = rise_base + c.heading * (top - rise_base)
    if amp < c.min_amplitude:
        return out | {"qc": 12}
    if top < c.min_peak and not rising:
        return out | {"qc": 13}
    if rise_base > c.max_base:
        return out | {"qc": 14}
    below = [k for k in range(l_lo, ip) if s[k] < up]
    if not below:
        return out | {"qc": 15}
    j, day = below[-1], lambda i, a: t0 + dt * (i + offset(a, i))
    d = dict.fromkeys(DATES)
    d["emergence"] = emergence = crossing(s, j, up, t0, dt)
    basis = f if c.plant_from == "raw" else s
    ipl = first_best(basis, range(l_lo, j + 1), -1)
    if ipl > first and day(ipl, basis) <= emergence:
        d["plant"] = day(ipl, basis)
    # on stretches that gap filling made flat or straight, rounding alone decides: any place on them will do
    bend = abs(basis[ipl - 1] - 2 * basis[ipl] + basis[ipl + 1]) if ipl else 1.0
    out["flat"] = bend < 1e-9 or sum(abs(basis[k] - basis[ipl]) < 1e-9 for k in range(max(0, l_lo - 1), min(n, j + 2))) > 1
    peak = day(ip, s)
    last_rise = ip if rising else ip - 1
    ipi = first_best(g, range(j, max(j, last_rise) + 1), 1)
    inner = j < ipi < last_rise and (not rising or ipi < ip - 1)
    if inner and day(ipi, g) >= emergence:
        d["panicle_init"] = day(ipi, g)
    tillering = None
    if c.tiller_rule == "max_accel":
        it = first_best(gg, range(j, max(j, ipi) + 1), 1)
        if inner and j < it < ipi:
            tillering = day(it, gg)
    else:
        level = rise_base + c.tiller_norm * (top - rise_base)
        under = [k for k in range(j, ip) if s[k] < level]
        if under:
            tillering = crossing(s, under[-1], level, t0, dt)
    if tillering is not None and tillering >= emergence and (d["panicle_init"] is None or tillering <= d["panicle_init"]):
        d["tillering"] = tillering
    harvest = None
    ended = next((k for k in range(ip + 1, last + 1) if s[k] <= down), None)
    if ended is not None and not rising:
        harvest = crossing(s, ended - 1, down, t0, dt)
    if not rising:
        d["peak"] = peak
        under = [k for k in range(j, ip) if s[k] < head]
        if under:
            heading = crossing(s, under[-1], head, t0, dt)
            if heading <= peak and (d["panicle_init"] is None or heading >= d["panicle_init"]):
                d["heading"] = heading
        m_end = last if harvest is None else ended
        im = first_best(g, range(ip + 1, m_end + 1), -1)
        if im is not None and (harvest is not None or im < m_end) and fall >= c.min_fall * amp:
            maturity = day(im, g)
            if maturity >= peak and (harvest is None or maturity <= harvest):
                d["maturity"] = maturity
    d["harvest"] = harvest
    season = None if harvest is None else harvest - emergence
    if season is not None and not c.season_length[0] <= season <= c.season_length[1]:
        return out | {"qc": 16}
    return out | d | {"season_length": season, "qc": 2 if rising else 1 if harvest is None else 0}


def random_series(rng, n, count):
    ts = [10 * k for k in range(n)]
    for i in range(count):
        kind = i % 4
        centre, width, base, amp = rng.uniform(40, 10 * n), rng.uniform(14, 40), rng.uniform(0.1, 0.5), rng.uniform(0.1, 0.7)
        curve = [bell(t, centre, width, base, amp) for t in ts] if kind < 3 else [two_crops(days("2025-07-23") + t) for t in ts]
        noise, gaps = rng.choice([0.004, 0.03, 0.08]), rng.choice([0.0, 0.2, 0.5])
        end = n if kind != 2 else int(rng.integers(n // 2, n))
        yield [float(x + rng.normal(0, noise)) if k < end and rng.random() >= gaps else None for k, x in enumerate(curve)]


CONFIGS = [Phenology(), Phenology(base_mode="single", plant_from="raw", tiller_rule="norm"), Phenology(peak_select="last", peak_search=(30, 240)), Phenology(min_amplitude=0.05, min_peak=0.3, max_base=0.7, season_length=(5, 300))]


@pytest.mark.parametrize("c", CONFIGS)
def test_cycles_against_plain_code(spark, c):
    rng, n, start = np.random.default_rng(17), 25, days("2025-11-01")
    values = dict(enumerate(random_series(rng, n, 400)))
    t0 = dates("2025-11-01", "2026-06-30")[0]
    got = {r["pixel_id"]: r for r in phenology.extract(frame(spark, values, t0), n, 10, start, c).collect()}
    kinds = set()
    for p, v in values.items():
        r, want = got[p], cycle_by_hand(v, t0, 10, start, c)
        assert all(r[x] == want[x] for x in ("qc", "n_obs", "last_obs", "max_gap_days")), (p, r, want)
        for x in (*DATES, "season_length")[int(want.get("flat", False)) :]:
            assert (r[x] is None) == (want[x] is None) and (r[x] is None or math.isclose(r[x], want[x], abs_tol=1e-6)), (p, x, r, want)
        kinds.add(r["qc"])
    assert len(kinds) >= 4 and min(kinds) == 0


def test_plain_rules_see_the_settings():
    """The plain code itself tells settings apart."""
    v = list(random_series(np.random.default_rng(3), 25, 1))[0]
    one = cycle_by_hand(v, 0, 10, 0, Phenology())
    assert cycle_by_hand(v, 0, 10, 0, replace(Phenology(), min_obs=30))["qc"] == 10 and one["n_obs"] == sum(x is not None for x in v)
