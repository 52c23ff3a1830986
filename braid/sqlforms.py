"""DuckDB forms of the array functions, for the SQL beside the registered queries.

They are written from the operators' definitions over DuckDB's list functions, apart
from the Spark expressions, so that the two sides check each other.
"""

from __future__ import annotations

EPS = "1e-8"
X = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def mean(a: str) -> str:
    return f"list_avg({a})"


def std(a: str) -> str:
    return f"list_aggregate({a}, 'stddev_pop')"


def sstd(a: str) -> str:
    return f"greatest({std(a)}, {EPS})"


def q(a: str, p: float) -> str:
    return f"list_aggregate({a}, 'quantile_cont', {p})"


def iqr(a: str) -> str:
    return f"({q(a, 0.75)} - {q(a, 0.25)})"


def diffs(a: str) -> str:
    return f"list_transform(range(2, len({a}) + 1), lambda d: {a}[d] - {a}[d - 1])"


def mean_abs(a: str) -> str:
    return f"list_avg(list_transform({a}, lambda u: abs(u)))"


def slope(a: str) -> str:
    t = f"(-1 + 2.0 * (i - 1) / (len({a}) - 1))"
    return f"(list_sum(list_transform({a}, lambda x, i: x * {t})) / greatest(list_sum(list_transform({a}, lambda x, i: {t} * {t})), {EPS}))"


def width(a: str) -> str:
    return f"greatest(2, len({a}) // 4)"


def head(a: str, w: str | None = None) -> str:
    return f"{a}[1 : least({w or width(a)}, len({a}))]"


def tail(a: str, w: str | None = None) -> str:
    return f"{a}[len({a}) - least({w or width(a)}, len({a})) + 1 : len({a})]"


def down(a: str) -> str:
    return f"(list_max(list_transform(range(1, len({a}) + 1), lambda i: list_max({a}[1 : i]) - {a}[i])) / {sstd(a)})"


def up(a: str) -> str:
    return f"(list_max(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] - list_min({a}[1 : i]))) / {sstd(a)})"


def cusums(a: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: list_sum({a}[1 : i]) - i * list_avg({a}))"


def energy(a: str) -> str:
    return f"list_transform({a}, lambda u: abs(u - list_avg({a})))"


def autocorr(a: str) -> str:
    c = f"({a}[k] - list_avg({a}))"
    d = f"({a}[k + 1] - list_avg({a}))"
    return f"(list_sum(list_transform(range(1, len({a})), lambda k: {c} * {d})) / greatest(list_sum(list_transform(range(1, len({a})), lambda k: {c} * {c})), {EPS}))"


def fft(a: str) -> str:
    turn = f"2 * pi() * k * (j - 1) / len({a})"
    part = lambda f: f"pow(list_sum(list_transform({a}, lambda v, j: v * {f}({turn}))), 2)"
    return f"list_transform(range(0, len({a}) // 2 + 1), lambda k: sqrt({part('cos')} + {part('sin')}))"


def with_abs(name: str, e: str) -> dict[str, str]:
    return {name: e, f"{name}_abs": f"abs({e})"}


def finite(e: str) -> str:
    return f"round((CASE WHEN isfinite({e}) THEN {e} ELSE 0 END)::DOUBLE + 3e-8, 6) + 0.0"


SERIES = {
    "embeddings": ("vec_id", "SELECT vec_id, embedding::DOUBLE[] AS s, 32 AS b FROM embeddings"),
    "events": ("user_id", "SELECT user_id, s, len(s) // 2 AS b FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS s FROM events GROUP BY user_id)"),
}


def series_query(table: str, features: dict[str, str], extra: str = "") -> str:
    """The features of each series; their expressions may use s, b, pre, post, ph, pt (head and tail of post), et (tail of pre), pd, ed (differences), c (cusum)."""
    key, base = SERIES[table]
    names = ", ".join(f"{finite('x' + str(i))} AS {n}" for i, n in enumerate(features))
    raw = ", ".join(f"({e}) AS x{i}" for i, e in enumerate(features.values()))
    return f"""
WITH base AS ({base}),
cut AS (SELECT {key}, s, b, s[1 : b] AS pre, s[b + 1 : len(s)] AS post FROM base),
parts AS (SELECT *, {head('post')} AS ph, {tail('post')} AS pt, {tail('pre')} AS et, {head('pre')} AS eh, {diffs('post')} AS pd, {diffs('pre')} AS ed, {cusums('s')} AS c FROM cut),
more AS (SELECT *, {energy('post')} AS pe, {energy('pre')} AS ee, list_max(list_transform(c, lambda u: abs(u))) AS peak{extra} FROM parts),
raw AS (SELECT {key}, {raw} FROM more)
SELECT {key}, {names} FROM raw
"""


def _features() -> dict[str, dict[str, str]]:
    jump, drift = f"{mean('ph')} - {mean('et')}", f"{mean('pt')} - {mean('ph')}"
    share = f"list_sum({tail('pe', width('post'))}) / greatest(list_sum(pe), {EPS})"
    share_pre = f"list_sum({tail('ee', width('post'))}) / greatest(list_sum(ee), {EPS})"
    centroid = f"list_sum(list_transform(pe, lambda u, i: u * (i - 1) / (len(pe) - 1))) / greatest(list_sum(pe), {EPS})"
    peak_at = "(list_position(list_transform(c, lambda u: abs(u)), peak) - 1) / (len(s) - 1.0)"
    late_peak = "list_max(list_transform(c[b + 1 : len(c)], lambda u: abs(u)))"
    stds = f"ln({sstd('post')} / {sstd('pre')})"
    f: dict[str, dict[str, str]] = {}
    f["segment_basic"] = with_abs("mean_delta", f"{mean('post')} - {mean('pre')}") | with_abs("std_log_ratio", stds)
    f["segment_robust"] = with_abs("median_delta", f"{q('post', 0.5)} - {q('pre', 0.5)}") | with_abs("iqr_log_ratio", f"ln(greatest({iqr('post')}, {EPS}) / greatest({iqr('pre')}, {EPS}))")
    f["trend_basic"] = {"pre_slope": slope("pre"), "post_slope": slope("post")} | with_abs("slope_delta", f"{slope('post')} - {slope('pre')}")
    f["trend_late_window"] = {"post_tail_slope": slope("pt"), "tail_pre_slope_delta": f"{slope('pt')} - {slope('et')}"} | with_abs("post_slope_accel", f"{slope('pt')} - {slope('ph')}")
    f["cusum_basic"] = {"cusum_peak": f"peak / {sstd('s')}", "boundary_alignment": f"abs(c[b]) / greatest(peak, {EPS})"}
    f["segment_late_shift"] = with_abs("tail_jump", jump) | with_abs("post_late_drift", drift) | {"tail_std_log_ratio": f"ln({sstd('pt')} / {sstd('et')})"}
    swings = {"post_drawdown": down("post"), "post_drawup": up("post"), "drawdown_delta": f"{down('post')} - {down('pre')}", "drawup_delta": f"{up('post')} - {up('pre')}"}
    f["shape_drawdown"] = swings | {f"{n}_abs": f"abs({swings[n]})" for n in ("drawdown_delta", "drawup_delta")}
    where = {"post_tail_energy_share": share, "tail_energy_delta": f"{share} - {share_pre}", "post_energy_centroid": centroid}
    f["shape_post_concentration"] = where | {"post_peak_location": "(list_position(pe, list_max(pe)) - 1) / (len(pe) - 1.0)", "late_centroid_excess": f"greatest({centroid} - 0.5, 0)"}
    f["event_detection_outputs"] = with_abs("tail_jump", jump) | with_abs("post_late_drift", drift) | swings | where | {"late_centroid_excess": f"greatest({centroid} - 0.5, 0)"}
    f["row_recent_change"] = with_abs("recent_mean_delta", f"{mean('post')} - {mean('pre')}") | with_abs("recent_entry_jump", jump) | with_abs("recent_tail_drift", drift) | {"last_vs_older_tail": f"s[len(s)] - {mean('et')}", "last_vs_recent_head": f"s[len(s)] - {mean('ph')}"}
    log_abs = lambda a, b: f"ln(({mean_abs(a)} + {EPS}) / ({mean_abs(b)} + {EPS}))"
    f["row_volatility_burst"] = with_abs("absdiff_log_ratio", log_abs("pd", "ed")) | with_abs("diff_std_log_ratio", f"ln({sstd('pd')} / {sstd('ed')})") | with_abs("tail_absdiff_log_ratio", log_abs(tail("pd", f"{width('post')} - 1"), tail("ed", f"{width('post')} - 1")))
    f["row_cusum_local"] = {"local_cusum_peak": f"peak / {sstd('s')}", "local_cusum_peak_location": peak_at, "recent_cusum_share": f"{late_peak} / greatest(peak, {EPS})", "terminal_cusum_balance": f"c[len(c)] / greatest(peak, {EPS})", "late_cusum_excess": f"greatest({peak_at} - 0.5, 0)"}
    levels = {"last_value": "s[len(s)]", "last_vs_older_mean": f"s[len(s)] - {mean('pre')}", "last_vs_recent_mean": f"s[len(s)] - {mean('post')}", "recent_vs_older_mean": f"{mean('post')} - {mean('pre')}"}
    context = {n: "0.0::DOUBLE" for n in ("sample_time_norm", "sample_time_log_norm", "sample_period_two", "lookback_observed_fraction")}
    slopes = {"full_window_slope": slope("s"), "recent_slope_delta": f"{slope('post')} - {slope('pre')}"}
    f["row_context_outputs"] = context
    f["row_local_outputs"] = levels | with_abs("recent_tail_vs_older_tail", f"{mean('pt')} - {mean('et')}") | with_abs("recent_std_log_ratio", stds) | slopes | {"recent_tail_slope_delta": f"{slope('pt')} - {slope('post')}", "recent_drawdown": down("post"), "recent_drawup": up("post")} | context
    f["row_baseline_outputs"] = levels | {"recent_entry_jump": jump, "recent_tail_drift": drift, "recent_std_log_ratio": stds, "absdiff_delta": f"{mean_abs('pd')} - {mean_abs('ed')}", "absdiff_log_ratio": log_abs("pd", "ed")} | slopes | {"recent_tail_slope": slope("pt"), "recent_drawdown": down("post"), "recent_drawup": up("post"), "local_cusum_peak": f"greatest(peak, {EPS}) / {sstd('s')}", "local_cusum_peak_location": peak_at, "recent_cusum_share": f"{late_peak} / greatest(peak, {EPS})"} | context
    band = lambda a, lo, hi: f"list_avg({a}[{lo} : {hi}])"
    tilt = lambda a: f"ln(({band(a, 5, f'len({a})')} + {EPS}) / ({band(a, 2, 4)} + {EPS}))"
    f["spectral_basic"] = with_abs("high_low_delta", f"{tilt('pf')} - {tilt('ef')}")
    gaps = "[" + ", ".join(f"abs({q('post', k / 10)} - {q('pre', k / 10)})" for k in range(1, 10)) + "]"
    ordered = "list_transform(range(1, least(len(pre), len(post)) + 1), lambda i: list_sort(post)[i] - list_sort(pre)[i])"
    peak_of = lambda a: f"list_max(list_transform({cusums(a)}, lambda u: abs(u)))"
    f["structural_break_baseline_outputs"] = {
        f"baseline_{n}": e
        for n, e in {
            "mean_delta": f"{mean('post')} - {mean('pre')}",
            "mean_delta_abs": f"abs({mean('post')} - {mean('pre')})",
            "mean_delta_scaled": f"({mean('post')} - {mean('pre')}) / {sstd('pre')}",
            "median_delta": f"{q('post', 0.5)} - {q('pre', 0.5)}",
            "std_log_ratio": f"ln(({sstd('post')} + {EPS}) / ({sstd('pre')} + {EPS}))",
            "iqr_delta": f"{iqr('post')} - {iqr('pre')}",
            "iqr_log_ratio": f"ln(({iqr('post')} + {EPS}) / ({iqr('pre')} + {EPS}))",
            "absdiff_delta": f"{mean_abs('pd')} - {mean_abs('ed')}",
            "diff_std_log_ratio": f"ln(({sstd('pd')} + {EPS}) / ({sstd('ed')} + {EPS}))",
            "autocorr_delta": f"{autocorr('post')} - {autocorr('pre')}",
            "slope_delta": f"{slope('post')} - {slope('pre')}",
            "tail_slope_delta": f"{slope('pt')} - {slope('et')}",
            "boundary_jump": jump,
            "post_tail_drift": drift,
            "quantile_l1_distance": f"list_avg({gaps})",
            "quantile_max_distance": f"list_max({gaps})",
            "sorted_signed_distance": f"list_avg({ordered})",
            "sorted_l1_distance": f"list_avg(list_transform({ordered}, lambda u: abs(u)))",
            "post_cusum_peak": f"{peak_of('post')} / {sstd('post')}",
            "pre_cusum_peak": f"{peak_of('pre')} / {sstd('pre')}",
            "cusum_peak_ratio": f"{peak_of('post')} / greatest({peak_of('pre')}, {EPS})",
            "low_freq_log_ratio": f"ln(({band('pf', 2, 4)} + {EPS}) / ({band('ef', 2, 4)} + {EPS}))",
            "high_freq_log_ratio": f"ln(({band('pf', 5, 'len(pf)')} + {EPS}) / ({band('ef', 5, 'len(ef)')} + {EPS}))",
            "spectral_shape_delta": f"{tilt('pf')} - {tilt('ef')}",
            "drawdown_delta": f"{down('post')} - {down('pre')}",
            "drawup_delta": f"{up('post')} - {up('pre')}",
            "last_vs_pre_mean": f"s[len(s)] - {mean('pre')}",
            "last_vs_pre_tail": f"s[len(s)] - {mean('et')}",
        }.items()
    }
    many: dict[str, str] = {}
    for w in (4, 8, 16, 32):
        t, o = tail("post", str(w)), tail("pre", str(w))
        p = f"post[{33 - 2 * w} : {32 - w}]" if w < 32 else o
        dt, dp, do = diffs(t), diffs(p), diffs(o)
        many |= {
            f"tail_last_vs_mean_{w}": f"s[64] - {mean(t)}",
            f"tail_prev_mean_delta_{w}": f"{mean(t)} - {mean(p)}",
            f"tail_old_mean_delta_{w}": f"{mean(t)} - {mean(o)}",
            f"tail_prev_std_log_ratio_{w}": f"ln({sstd(t)} / {sstd(p)})",
            f"tail_old_std_log_ratio_{w}": f"ln({sstd(t)} / {sstd(o)})",
            f"tail_prev_absdiff_delta_{w}": f"{mean_abs(dt)} - {mean_abs(dp)}",
            f"tail_prev_absdiff_log_ratio_{w}": f"ln(({mean_abs(dt)} + {EPS}) / ({mean_abs(dp)} + {EPS}))",
            f"tail_old_absdiff_log_ratio_{w}": f"ln(({mean_abs(dt)} + {EPS}) / ({mean_abs(do)} + {EPS}))",
            f"tail_slope_{w}": slope(t),
            f"tail_prev_slope_delta_{w}": f"{slope(t)} - {slope(p)}",
            f"tail_drawdown_{w}": down(t),
            f"tail_drawup_{w}": up(t),
            f"tail_range_{w}": f"list_max({t}) - list_min({t})",
        }
    f["row_multiscale_tail_outputs"] = many
    f["source_shift"] = {"src_mean_delta": f"{mean('post')} - {mean('pre')}", "src_mean_delta_abs": f"abs({mean('post')} - {mean('pre')})", "src_std_log_ratio": f"ln(({std('post')} + {EPS}) / ({std('pre')} + {EPS}))", "src_median_delta": f"{q('post', 0.5)} - {q('pre', 0.5)}"}
    biggest = lambda a: f"list_max(list_transform({a}, lambda u: abs(u)))"
    f["source_volatility"] = {"src_diff_std_delta": f"{std('pd')} - {std('ed')}", "src_abs_diff_mean_delta": f"{mean_abs('pd')} - {mean_abs('ed')}", "src_abs_max_delta": f"{biggest('post')} - {biggest('pre')}"}
    lt, lh = tail("s", "greatest(2, len(s) // 8)"), head("s", "greatest(2, len(s) // 8)")
    f["source_tail_head"] = {"src_tail_head_mean_delta": f"{mean(lt)} - {mean(lh)}", "src_tail_head_std_delta": f"{std(lt)} - {std(lh)}", "src_tail_head_abs_delta": f"abs({mean(lt)} - {mean(lh)})"}
    f["energy_weights"] = {"boundary_energy_weight": f"least(greatest(0.5 + abs(c[b]) / greatest(peak, {EPS}), 0.25), 3)", "late_energy_weight": f"least(greatest(0.75 + {share}, 0.5), 2.5)"}
    return f


SERIES_FEATURES = _features()
NEEDS_FFT = {"spectral_basic", "structural_break_baseline_outputs"}


def series_sql(table: str, block: str) -> str:
    extra = f", {fft('post')} AS pf, {fft('pre')} AS ef" if block in NEEDS_FFT else ""
    return series_query(table, SERIES_FEATURES[block], extra)
