"""Features of a window of consecutive messages, as expressions over an array of
(t_us, can_id, dlc, label, dt_us) structs in order.  Times are whole microseconds
until they are differences, so that no precision is lost; features are in
seconds, and the statistics of a window are population statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12

# The features of each group, in the order that models expect.
GROUPS: dict[str, tuple[str, ...]] = {
    "basic": ("msg_count", "window_duration", "n_unique_ids_basic"),
    "temporal": ("iat_mean", "iat_std", "iat_min", "iat_max", "iat_median", "iat_cv", "iat_range", "msg_rate_hz"),
    "temporal_id": ("dt_id_mean", "dt_id_std", "dt_id_min", "dt_id_max", "dt_id_cv"),
    "frequency": ("n_unique_ids", "id_diversity", "cmafid", "cmifid", "id_entropy", "n_repeated_ids", "max_id_share"),
    "dlc": ("dlc_mean", "dlc_std", "dlc_max"),
}
DEFAULT_GROUPS = ("temporal", "temporal_id", "frequency", "dlc")


def feature_names(groups=DEFAULT_GROUPS) -> list[str]:
    """Names in canonical order, whatever the order of ``groups``."""
    unknown = set(groups) - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown feature groups: {sorted(unknown)}")
    return [name for group, names in GROUPS.items() if group in groups for name in names]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _mean(x: Column) -> Column:
    return F.coalesce(F.try_divide(_sum(x), F.size(x)), F.lit(0.0))


def _std(x: Column, mean: Column, least: int = 1) -> Column:
    spread = F.sqrt(F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)), F.size(x)))
    return F.when(F.size(x) >= least, spread).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return a / (F.abs(b) + EPS)


def helpers(frame: Column) -> dict[str, Column]:
    """Arrays that the features share; select them before the features."""
    t = F.transform(frame, lambda m: m["t_us"])
    gaps = F.zip_with(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda b, a: (b - a) / 1e6)
    ids = F.transform(frame, lambda m: m["can_id"])
    return {
        "gaps": gaps, "dts": F.filter(F.transform(frame, lambda m: m["dt_us"] / 1e6), lambda v: v.isNotNull()),
        "counts": F.transform(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda x: x == i)).cast("double")),
        "dlcs": F.transform(F.filter(frame, lambda m: m["dlc"] >= 0), lambda m: m["dlc"].cast("double")),
        "duration": (F.element_at(t, -1) - F.element_at(t, 1)) / 1e6, "y": F.array_max(F.transform(frame, lambda m: (m["label"] > 0).cast("int"))),
    }


def moments() -> dict[str, Column]:
    """Means over the helpers' columns; select them before the features."""
    return {f"{name}_mean": _mean(F.col(name)) for name in ("gaps", "dts", "dlcs")}


def features(window: int, groups=DEFAULT_GROUPS) -> dict[str, Column]:
    """name -> expression over the columns of ``helpers`` and ``moments``."""
    gaps, dts, counts, dlcs, duration = (F.col(c) for c in ("gaps", "dts", "counts", "dlcs", "duration"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    ordered = F.array_sort(gaps)
    low = F.element_at(ordered, F.floor((F.size(gaps) + 1) / 2).cast("int"))
    high = F.element_at(ordered, (F.floor(F.size(gaps) / 2) + 1).cast("int"))
    unique = F.size(counts).cast("double")
    gap_std, dt_std = _std(gaps, F.col("gaps_mean")), _std(dts, F.col("dts_mean"), 2)
    made = {
        "msg_count": F.lit(float(window)), "window_duration": duration, "n_unique_ids_basic": unique,
        "iat_mean": F.col("gaps_mean"), "iat_std": gap_std, "iat_min": zero(F.array_min(gaps)), "iat_max": zero(F.array_max(gaps)), "iat_median": zero((low + high) / 2),
        "iat_range": zero(F.array_max(gaps) - F.array_min(gaps)), "iat_cv": _ratio(gap_std, F.col("gaps_mean")), "msg_rate_hz": F.lit(float(window)) / (duration + EPS),
        "dt_id_mean": F.col("dts_mean"), "dt_id_std": dt_std, "dt_id_min": zero(F.array_min(dts)), "dt_id_max": zero(F.array_max(dts)), "dt_id_cv": _ratio(dt_std, F.col("dts_mean")),
        "n_unique_ids": unique, "id_diversity": unique / window, "cmafid": F.array_max(counts), "cmifid": F.array_min(counts),
        "id_entropy": -F.aggregate(counts, F.lit(0.0), lambda s, c: s + c / window * F.log(c / window + EPS)),
        "n_repeated_ids": F.size(F.filter(counts, lambda c: c > 1)).cast("double"), "max_id_share": F.array_max(counts) / window,
        "dlc_mean": F.col("dlcs_mean"), "dlc_std": _std(dlcs, F.col("dlcs_mean"), 2), "dlc_max": zero(F.array_max(dlcs)),
    }
    return {name: made[name] for name in feature_names(groups)}
