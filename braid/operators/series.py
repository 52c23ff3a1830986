"""Features of one series in one row: an ARRAY<DOUBLE> column cut at a boundary.

Everything is computed inside the row, so these operators never shuffle; only the
batch's time scale is a one-row aggregate. A ``Part`` is a piece of the series whose
measures are intermediate columns, shared by all features that need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.expr import EPS, Block, Steps, clip, floor_at, log_ratio, nz, select_block, sign_abs


class Part:
    def __init__(self, steps: Steps, key: str, values: Column, level: int):
        self.steps, self.key, self.level = steps, key, level
        self.values = steps.let(key, values, level)

    def _let(self, name: str, c: Column, above: int = 1) -> Column:
        return self.steps.let(f"{self.key}.{name}", c, self.level + above)

    def _part(self, name: str, values: Column, above: int = 1) -> Part:
        return Part(self.steps, f"{self.key}.{name}", values, self.level + above)

    @property
    def size(self) -> Column:
        return F.size(self.values)

    @property
    def moments(self) -> Column:
        return self._let("moments", A.moments(self.values))

    @property
    def mean(self) -> Column:
        return self._let("mean", A.mean(self.values))

    @property
    def std(self) -> Column:
        return self._let("std", A.std_of(self.moments), 2)

    @property
    def safe_std(self) -> Column:
        return floor_at(self.std)

    @property
    def head(self) -> Part:
        return self._part("head", A.head(self.values))

    @property
    def tail(self) -> Part:
        return self._part("tail", A.tail(self.values))

    def last(self, width: Column | int, name: str) -> Part:
        return self._part(f"last{name}", A.tail(self.values, F.lit(width) if isinstance(width, int) else width), 2)

    @property
    def diffs(self) -> Part:
        return self._part("diffs", A.diffs(self.values))

    @property
    def mean_abs(self) -> Column:
        return self._let("mean_abs", A.mean_abs(self.values))

    @property
    def slope(self) -> Column:
        return self._let("slope", A.slope(self.values))

    @property
    def sorted(self) -> Column:
        return self._let("sorted", F.sort_array(self.values))

    def quantile(self, q: float) -> Column:
        return self._let(f"q{q}", A.quantile_sorted(self.sorted, q), 2)

    @property
    def iqr(self) -> Column:
        return self.quantile(0.75) - self.quantile(0.25)

    @property
    def swing(self) -> Column:
        return self._let("swing", A.swing(self.values))

    @property
    def drawdown(self) -> Column:
        return self.swing["down"] / self.safe_std

    @property
    def drawup(self) -> Column:
        return self.swing["up"] / self.safe_std

    @property
    def autocorrelation(self) -> Column:
        return self._let("ac", A.autocorrelation(self.values, self.mean), 3)

    def cusum(self, boundary: Column | None = None) -> Column:
        return self._let("cusum", A.cusum(self.values, self.mean, boundary), 3)

    @property
    def energy(self) -> Part:
        return self._part("energy", F.transform(self.values, lambda x: F.abs(x - self.mean)), 3)

    @property
    def end(self) -> Column:
        return F.try_element_at(self.values, F.lit(-1))


class Series:
    """A series column with its boundary: ``whole``, ``pre`` and ``post``.

    ``length`` and ``cut`` are the series' length and boundary where all rows share
    them; spectra need them when the plan is built.
    """

    def __init__(self, df: DataFrame, column: str, boundary: int | Column | None = None, length: int | None = None):
        self.steps = Steps(df)
        self.length = length
        self.cut = boundary if isinstance(boundary, int) else (length // 2 if boundary is None and length else None)
        self.whole = Part(self.steps, "whole", F.col(column).cast("array<double>"), 1)
        edge = F.lit(boundary) if isinstance(boundary, int) else F.floor(self.whole.size / 2) if boundary is None else boundary
        self.boundary = self.steps.let("boundary", edge.cast("int"), 2)
        self.pre = Part(self.steps, "pre", F.slice(self.whole.values, F.lit(1), F.greatest(self.boundary, F.lit(0))), 3)
        self.post = Part(self.steps, "post", F.slice(self.whole.values, self.boundary + 1, F.greatest(self.whole.size - self.boundary, F.lit(0))), 3)

    def select(self, keys: list[str], block: Block) -> DataFrame:
        return select_block(self.steps.build(), keys, block)

    def spectrum(self, part: Part, n: int) -> Column:
        return part._let("fft", A.amplitudes(part.values, n))

    def sizes(self) -> tuple[int, int]:
        if self.length is None or self.cut is None:
            raise ValueError("spectra need the length and boundary that all rows share")
        return self.cut, self.length - self.cut


def _log_change(after: Column, before: Column, eps: float = 0.0) -> Column:
    return log_ratio(after + eps, before + eps)


def segment_basic(s: Series) -> Block:
    return [*sign_abs("mean_delta", s.post.mean - s.pre.mean), *sign_abs("std_log_ratio", _log_change(s.post.safe_std, s.pre.safe_std))]


def segment_robust(s: Series) -> Block:
    spread = _log_change(floor_at(s.post.iqr), floor_at(s.pre.iqr))
    return [*sign_abs("median_delta", s.post.quantile(0.5) - s.pre.quantile(0.5)), *sign_abs("iqr_log_ratio", spread)]


def trend_basic(s: Series) -> Block:
    return [("pre_slope", s.pre.slope), ("post_slope", s.post.slope), *sign_abs("slope_delta", s.post.slope - s.pre.slope)]


def trend_late_window(s: Series) -> Block:
    late = s.post.tail.slope
    return [("post_tail_slope", late), ("tail_pre_slope_delta", late - s.pre.tail.slope), *sign_abs("post_slope_accel", late - s.post.head.slope)]


def cusum_basic(s: Series) -> Block:
    c = s.whole.cusum(s.boundary)
    return [("cusum_peak", c["peak"] / s.whole.safe_std), ("boundary_alignment", F.abs(c["edge"]) / floor_at(c["peak"]))]


def _jumps(s: Series) -> tuple[Column, Column]:
    return s.post.head.mean - s.pre.tail.mean, s.post.tail.mean - s.post.head.mean


def segment_late_shift(s: Series) -> Block:
    jump, drift = _jumps(s)
    return [*sign_abs("tail_jump", jump), *sign_abs("post_late_drift", drift), ("tail_std_log_ratio", _log_change(s.post.tail.safe_std, s.pre.tail.safe_std))]


def shape_drawdown(s: Series) -> Block:
    down, up = s.post.drawdown - s.pre.drawdown, s.post.drawup - s.pre.drawup
    return [("post_drawdown", s.post.drawdown), ("post_drawup", s.post.drawup), ("drawdown_delta", down), ("drawup_delta", up), ("drawdown_delta_abs", F.abs(down)), ("drawup_delta_abs", F.abs(up))]


def _tail_share(s: Series, part: Part) -> Column:
    """Energy of the last quarter (of the later side's length) in all energy of ``part``."""
    energy = part.energy
    width = s.post._let("width", A.window_width(s.post.values))
    return A.total(energy.last(width, "w").values) / floor_at(A.total(energy.values))


def _centroid(s: Series) -> tuple[Column, Column]:
    """Where the later side's energy lies in 0..1, and where it peaks first."""
    energy = s.post.energy.values
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("e"), F.lit(0.0).alias("ie"))
    sums = s.post._let("where", F.aggregate(energy, start, lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["e"] + x).alias("e"), (a["ie"] + a["i"] * x).alias("ie"))), 5)
    last = F.greatest(s.post.size - 1, F.lit(1))
    return sums["ie"] / last / floor_at(sums["e"]), (F.array_position(energy, F.array_max(energy)) - 1) / last


def _concentration(s: Series) -> dict[str, Column]:
    share = s.post._let("share", _tail_share(s, s.post), 7)
    centroid, peak = _centroid(s)
    return {"post_tail_energy_share": share, "tail_energy_delta": share - _tail_share(s, s.pre), "post_energy_centroid": centroid, "post_peak_location": peak, "late_centroid_excess": F.greatest(centroid - 0.5, F.lit(0.0))}


def shape_post_concentration(s: Series) -> Block:
    return list(_concentration(s).items())


def spectral_basic(s: Series) -> Block:
    """Log ratio of the means of amplitudes from bin 4 on and of bins 1 to 3, after minus before; 0 where a band is empty."""

    def shape(part: Part, n: int) -> Column:
        bins, k = s.spectrum(part, n), n // 2 + 1
        return _log_change(A.band_mean(bins, k, 4, None), A.band_mean(bins, k, 1, 4), EPS)

    n_pre, n_post = s.sizes()
    return sign_abs("high_low_delta", shape(s.post, n_post) - shape(s.pre, n_pre))


def event_detection(s: Series) -> Block:
    shift, swings = segment_late_shift(s)[:4], shape_drawdown(s)[:4]
    return [*shift, *swings, *((n, c) for n, c in _concentration(s).items() if n != "post_peak_location")]


def structural_break_baseline(s: Series) -> Block:
    pre, post = s.pre, s.post
    delta, last = post.mean - pre.mean, s.whole.end
    jump, drift = _jumps(s)
    deciles = [k / 10 for k in range(1, 10)]
    gaps = [F.abs(post.quantile(q) - pre.quantile(q)) for q in deciles]
    gap_sum = sum(gaps[1:], gaps[0])
    pairs = F.least(pre.size, post.size)
    ordered = s.post._let("gap", F.zip_with(F.slice(post.sorted, F.lit(1), pairs), F.slice(pre.sorted, F.lit(1), pairs), lambda a, b: a - b), 2)
    peak_pre, peak_post = pre.cusum()["peak"], post.cusum()["peak"]
    n_pre, n_post = s.sizes()
    bands = {}
    for name, part, n in (("pre", pre, n_pre), ("post", post, n_post)):
        bins, k = s.spectrum(part, n), n // 2 + 1
        bands[name] = A.band_mean(bins, k, 1, 4, clamp=True), A.band_mean(bins, k, 4, k, clamp=True)
    (low_pre, high_pre), (low_post, high_post) = bands["pre"], bands["post"]
    named = {
        "mean_delta": delta,
        "mean_delta_abs": F.abs(delta),
        "mean_delta_scaled": delta / pre.safe_std,
        "median_delta": post.quantile(0.5) - pre.quantile(0.5),
        "std_log_ratio": _log_change(post.safe_std, pre.safe_std, EPS),
        "iqr_delta": post.iqr - pre.iqr,
        "iqr_log_ratio": _log_change(post.iqr, pre.iqr, EPS),
        "absdiff_delta": post.diffs.mean_abs - pre.diffs.mean_abs,
        "diff_std_log_ratio": _log_change(post.diffs.safe_std, pre.diffs.safe_std, EPS),
        "autocorr_delta": post.autocorrelation - pre.autocorrelation,
        "slope_delta": post.slope - pre.slope,
        "tail_slope_delta": post.tail.slope - pre.tail.slope,
        "boundary_jump": jump,
        "post_tail_drift": drift,
        "quantile_l1_distance": gap_sum / 9,
        "quantile_max_distance": F.greatest(*gaps),
        "sorted_signed_distance": A.mean(ordered),
        "sorted_l1_distance": A.mean_abs(ordered),
        "post_cusum_peak": peak_post / post.safe_std,
        "pre_cusum_peak": peak_pre / pre.safe_std,
        "cusum_peak_ratio": peak_post / floor_at(peak_pre),
        "low_freq_log_ratio": _log_change(low_post, low_pre, EPS),
        "high_freq_log_ratio": _log_change(high_post, high_pre, EPS),
        "spectral_shape_delta": _log_change(high_post, low_post, EPS) - _log_change(high_pre, low_pre, EPS),
        "drawdown_delta": post.drawdown - pre.drawdown,
        "drawup_delta": post.drawup - pre.drawup,
        "last_vs_pre_mean": last - pre.mean,
        "last_vs_pre_tail": last - pre.tail.mean,
    }
    return [(f"baseline_{n}", c) for n, c in named.items()]


def row_recent_change(s: Series) -> Block:
    jump, drift = _jumps(s)
    last = s.whole.end
    return [
        *sign_abs("recent_mean_delta", s.post.mean - s.pre.mean),
        *sign_abs("recent_entry_jump", jump),
        *sign_abs("recent_tail_drift", drift),
        ("last_vs_older_tail", last - s.pre.tail.mean),
        ("last_vs_recent_head", last - s.post.head.mean),
    ]


def row_volatility_burst(s: Series) -> Block:
    width = s.post._let("width", A.window_width(s.post.values))
    late, early = (p.last(width, "w").diffs.mean_abs for p in (s.post, s.pre))
    return [
        *sign_abs("absdiff_log_ratio", _log_change(s.post.diffs.mean_abs, s.pre.diffs.mean_abs, EPS)),
        *sign_abs("diff_std_log_ratio", _log_change(s.post.diffs.safe_std, s.pre.diffs.safe_std)),
        *sign_abs("tail_absdiff_log_ratio", _log_change(late, early, EPS)),
    ]


def row_cusum_local(s: Series) -> Block:
    c = s.whole.cusum(s.boundary)
    place = c["at"] / F.greatest(s.whole.size - 1, F.lit(1))
    peak = floor_at(c["peak"])
    return [
        ("local_cusum_peak", c["peak"] / s.whole.safe_std),
        ("local_cusum_peak_location", place),
        ("recent_cusum_share", c["late"] / peak),
        ("terminal_cusum_balance", c["c"] / peak),
        ("late_cusum_excess", F.greatest(place - 0.5, F.lit(0.0))),
    ]


CONTEXT = ("sample_time", "sample_period", "lookback_observed", "sample_time_scale")


def with_time_scale(df: DataFrame, out: str = "time_scale") -> DataFrame:
    """``df`` with the batch's time scale: the greatest positive ``sample_time_scale``, else the greatest time, 1 at least.

    A one-row aggregate, broadcast to all rows. Missing context columns count as zeros.
    """
    known = [nz(F.col(c).cast("double")) if c in df.columns else F.lit(0.0) for c in CONTEXT]
    top = df.agg(F.max(known[3]).alias("s"), F.max(known[0]).alias("t"))
    scale = top.select(F.greatest(F.when(F.col("s") > 0, F.col("s")).otherwise(F.coalesce("t", F.lit(0.0))), F.lit(1.0)).alias(out))
    return df.crossJoin(F.broadcast(scale))


def _context(s: Series, scale: str) -> tuple[Column, Column, Column, Column]:
    time, period, seen, _ = (nz(F.col(c).cast("double")) if c in s.steps.df.columns else F.lit(0.0) for c in CONTEXT)
    u = time / F.col(scale)
    log_u = F.log1p(F.greatest(time, F.lit(0.0))) / F.greatest(F.log1p(F.col(scale)), F.lit(1.0))
    return u, log_u, (period >= 2).cast("double"), clip(seen / F.greatest(s.whole.size, F.lit(1)), 0, 1)


def row_context(s: Series, scale: str = "time_scale") -> Block:
    u, log_u, two, seen = _context(s, scale)
    return [("sample_time_norm", u), ("sample_time_log_norm", log_u), ("sample_period_two", two), ("lookback_observed_fraction", seen)]


def row_time_basis(s: Series, scale: str = "time_scale") -> Block:
    u, log_u, two, seen = _context(s, scale)
    turns = [(f"time_basis_{f.__name__}{k}", f(k * F.pi() * u)) for k in (1, 2) for f in (F.sin, F.cos)]
    powers = [("time_basis_norm", u), ("time_basis_log_norm", log_u), ("time_basis_sq", u * u), ("time_basis_cube", u * u * u), ("time_basis_sqrt", F.sqrt(F.greatest(u, F.lit(0.0))))]
    return [*powers, *turns, ("observed_basis_fraction", seen), ("observed_basis_sq", seen * seen), ("time_observed_interaction", u * seen), ("time_basis_period_two", two)]


def _levels(s: Series) -> Block:
    last = s.whole.end
    return [("last_value", last), ("last_vs_older_mean", last - s.pre.mean), ("last_vs_recent_mean", last - s.post.mean), ("recent_vs_older_mean", s.post.mean - s.pre.mean)]


def row_local(s: Series, scale: str = "time_scale") -> Block:
    return [
        *_levels(s),
        *sign_abs("recent_tail_vs_older_tail", s.post.tail.mean - s.pre.tail.mean),
        *sign_abs("recent_std_log_ratio", _log_change(s.post.safe_std, s.pre.safe_std)),
        ("full_window_slope", s.whole.slope),
        ("recent_slope_delta", s.post.slope - s.pre.slope),
        ("recent_tail_slope_delta", s.post.tail.slope - s.post.slope),
        ("recent_drawdown", s.post.drawdown),
        ("recent_drawup", s.post.drawup),
        *row_context(s, scale),
    ]


def row_baseline(s: Series, scale: str = "time_scale") -> Block:
    jump, drift = _jumps(s)
    c = s.whole.cusum(s.boundary)
    late, early = s.post.diffs.mean_abs, s.pre.diffs.mean_abs
    return [
        *_levels(s),
        ("recent_entry_jump", jump),
        ("recent_tail_drift", drift),
        ("recent_std_log_ratio", _log_change(s.post.safe_std, s.pre.safe_std)),
        ("absdiff_delta", late - early),
        ("absdiff_log_ratio", _log_change(late, early, EPS)),
        ("full_window_slope", s.whole.slope),
        ("recent_slope_delta", s.post.slope - s.pre.slope),
        ("recent_tail_slope", s.post.tail.slope),
        ("recent_drawdown", s.post.drawdown),
        ("recent_drawup", s.post.drawup),
        ("local_cusum_peak", floor_at(c["peak"]) / s.whole.safe_std),
        ("local_cusum_peak_location", c["at"] / F.greatest(s.whole.size - 1, F.lit(1))),
        ("recent_cusum_share", c["late"] / floor_at(c["peak"])),
        *row_context(s, scale),
    ]


#: The tail widths that are asked for.
TAIL_WIDTHS = (4, 8, 16, 32, 64, 128, 240)


def row_multiscale_tail(s: Series) -> Block:
    """13 measures of each tail width that fits the later side; needs the shared length and boundary."""
    n_pre, n_post = s.sizes()
    block: Block = []
    for w in dict.fromkeys(min(w, n_post) for w in TAIL_WIDTHS):
        if w < 2:
            continue
        tail = s.post.last(w, str(w))
        old = s.pre.last(w, str(w))
        before = max(0, n_post - 2 * w), n_post - w
        prev = s.post._part(f"prev{w}", F.slice(s.post.values, F.lit(before[0] + 1), F.lit(before[1] - before[0]))) if before[1] - before[0] >= 2 else old
        named = {
            "last_vs_mean": s.whole.end - tail.mean,
            "prev_mean_delta": tail.mean - prev.mean,
            "old_mean_delta": tail.mean - old.mean,
            "prev_std_log_ratio": _log_change(tail.safe_std, prev.safe_std),
            "old_std_log_ratio": _log_change(tail.safe_std, old.safe_std),
            "prev_absdiff_delta": tail.diffs.mean_abs - prev.diffs.mean_abs,
            "prev_absdiff_log_ratio": _log_change(tail.diffs.mean_abs, prev.diffs.mean_abs, EPS),
            "old_absdiff_log_ratio": _log_change(tail.diffs.mean_abs, old.diffs.mean_abs, EPS),
            "slope": tail.slope,
            "prev_slope_delta": tail.slope - prev.slope,
            "drawdown": tail.drawdown,
            "drawup": tail.drawup,
            "range": F.array_max(tail.values) - F.array_min(tail.values),
        }
        block += [(f"tail_{n}_{w}", c) for n, c in named.items()]
    return block


def source_shift(s: Series) -> Block:
    delta = s.post.mean - s.pre.mean
    return [("src_mean_delta", delta), ("src_mean_delta_abs", F.abs(delta)), ("src_std_log_ratio", _log_change(s.post.std, s.pre.std, EPS)), ("src_median_delta", s.post.quantile(0.5) - s.pre.quantile(0.5))]


def source_volatility(s: Series) -> Block:
    d, e = s.post.diffs, s.pre.diffs
    biggest = lambda p: F.array_max(F.transform(p.values, F.abs))
    return [("src_diff_std_delta", d.std - e.std), ("src_abs_diff_mean_delta", d.mean_abs - e.mean_abs), ("src_abs_max_delta", biggest(s.post) - biggest(s.pre))]


def source_tail_head(s: Series) -> Block:
    width = s.whole._let("eighth", F.greatest(F.lit(2), F.floor(s.whole.size / 8).cast("int")))
    late, early = s.whole.last(width, "8"), s.whole._part("first8", A.head(s.whole.values, width), 2)
    delta = late.mean - early.mean
    return [("src_tail_head_mean_delta", delta), ("src_tail_head_std_delta", late.std - early.std), ("src_tail_head_abs_delta", F.abs(delta))]


def boundary_energy_weight(s: Series) -> Column:
    c = s.whole.cusum(s.boundary)
    return clip(0.5 + F.abs(c["edge"]) / floor_at(c["peak"]), 0.25, 3.0)


def late_energy_weight(s: Series) -> Column:
    return clip(0.75 + _tail_share(s, s.post), 0.5, 2.5)


SERIES_BLOCKS: dict[str, Callable[[Series], Block]] = {
    "segment_basic": segment_basic,
    "segment_robust": segment_robust,
    "trend_basic": trend_basic,
    "trend_late_window": trend_late_window,
    "cusum_basic": cusum_basic,
    "segment_late_shift": segment_late_shift,
    "shape_drawdown": shape_drawdown,
    "shape_post_concentration": shape_post_concentration,
    "spectral_basic": spectral_basic,
    "event_detection_outputs": event_detection,
    "structural_break_baseline_outputs": structural_break_baseline,
    "row_recent_change": row_recent_change,
    "row_volatility_burst": row_volatility_burst,
    "row_cusum_local": row_cusum_local,
    "row_context_outputs": row_context,
    "row_local_outputs": row_local,
    "row_time_basis_outputs": row_time_basis,
    "row_multiscale_tail_outputs": row_multiscale_tail,
    "row_baseline_outputs": row_baseline,
}


def series_features(df: DataFrame, keys: list[str], blocks: list[str], column: str = "series", boundary: int | Column | None = None, length: int | None = None) -> DataFrame:
    """``keys`` and the features of the named blocks, in one pass over ``df``."""
    timed = {"row_context_outputs", "row_local_outputs", "row_time_basis_outputs", "row_baseline_outputs"}
    if timed & set(blocks):
        df = with_time_scale(df)
    s = Series(df, column, boundary, length)
    out = [x for b in blocks for x in SERIES_BLOCKS[b](s)]
    return s.select(keys, out)
