"""Scalar column functions. All JVM-side expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names, limits and formats that callers compare against.
PATCH_SIDE = 32
POSITIVE_PX = 5.0
NEGATIVE_PX = 10.0
LABELS = ("positive", "ambiguous", "negative")
PATCH_STATUS = ("edge_excluded", "train_saved", "not_saved")
PATCH_NAME = r"^(.*)_(\d+)_(\d+)_(\d+)\.npy$"
UNITS_REAL = "um/min"
UNITS_PIXEL = "px/frame"
MINUTE, HOUR, DAY = 60, 3600, 86400
DAYS_AS_DAYS, DAYS_AS_WEEKS = 7, 90
WILSON_Z = 1.959963985


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def euclidean(y1, x1, y2, x2) -> Column:
    """Plane distance. Written as a root of a sum so the engine and SQL agree to the last bit."""
    dy, dx = col(y1) - col(y2), col(x1) - col(x2)
    return F.sqrt(dy * dy + dx * dx)


def sigmoid(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(logit)))


def calibration(px_um, frame_min, default_px=None, default_min=None) -> dict[str, Column]:
    """Columns ``scale``, ``dt``, ``units``; real units only when both values are known."""
    px, mins = col(px_um), col(frame_min)
    if default_px is not None:
        px = F.coalesce(px, F.lit(float(default_px)))
    if default_min is not None:
        mins = F.coalesce(mins, F.lit(float(default_min)))
    known = px.isNotNull() & mins.isNotNull()
    return {
        "scale": F.when(known, px).otherwise(F.lit(1.0)),
        "dt": F.when(known, mins).otherwise(F.lit(1.0)),
        "units": F.when(known, F.lit(UNITS_REAL)).otherwise(F.lit(UNITS_PIXEL)),
    }


def label_by_distance(distance, positive: float = POSITIVE_PX, negative: float = NEGATIVE_PX) -> Column:
    if not positive < negative:
        raise ValueError(f"positive limit {positive} must lie below negative limit {negative}")
    d = col(distance)
    return (
        F.when(d <= positive, F.lit("positive")).when(d > negative, F.lit("negative")).otherwise(F.lit("ambiguous"))
    )


def in_patch(gy, gx, cy, cx, half: float = PATCH_SIDE / 2) -> Column:
    """Half-open box of side ``2*half`` centred on the candidate."""
    gy, gx, cy, cx = col(gy), col(gx), col(cy), col(cx)
    return (gy >= cy - half) & (gy < cy + half) & (gx >= cx - half) & (gx < cx + half)


def fits_frame(y, x, height, width, size: int = PATCH_SIDE) -> Column:
    """True when the crop around the truncated centre lies inside the frame (upper bound exclusive)."""
    half = size // 2
    top, left = col(y).cast("int") - half, col(x).cast("int") - half
    bottom, right = top + size, left + size
    return (top >= 0) & (left >= 0) & (bottom < col(height)) & (right < col(width))


def edge_status(label, fits) -> Column:
    return (
        F.when(~col(fits), F.lit("edge_excluded"))
        .when(col(label) == "ambiguous", F.lit("not_saved"))
        .otherwise(F.lit("train_saved"))
    )


def jaccard(tp, fp, fn) -> Column:
    total = col(tp) + col(fp) + col(fn)
    return F.when(total > 0, col(tp) / total).otherwise(F.lit(0.0))


def adjusted_jaccard(value, n_pred, n_estimate, a: float = 0.1) -> Column:
    """Penalise (or reward) a count above (or below) the estimate; never below zero."""
    j, n, est = col(value), col(n_pred), col(n_estimate)
    surplus = (n - est) / F.when(est > 0, est)
    return F.when(est > 0, F.greatest(F.lit(0.0), j * (F.lit(1.0) - F.lit(a) * surplus))).otherwise(j)


def final_score(adjusted_edges, division, w: float = 0.1) -> Column:
    return col(adjusted_edges) + F.lit(w) * col(division)


def prf1(tp, fp, fn) -> dict[str, Column]:
    """Precision, recall, F1; NULL where undefined."""
    tp, fp, fn = col(tp).cast("double"), col(fp), col(fn)
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.try_divide(F.lit(2.0) * p * r, p + r)}


def wilson_interval(k, n, z: float = WILSON_Z) -> dict[str, Column]:
    k, n = col(k).cast("double"), col(n).cast("double")
    n = F.when(n > 0, n)
    p = k / n
    z2 = z * z
    centre = (p + F.lit(z2) / (2 * n)) / (F.lit(1.0) + F.lit(z2) / n)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / (F.lit(1.0) + F.lit(z2) / n)
    return {
        "lower": F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - spread)),
        "upper": F.when(n.isNotNull(), F.least(F.lit(1.0), centre + spread)),
    }


def basename(path) -> Column:
    """Last component, whichever slash the path uses."""
    return F.element_at(F.split(F.regexp_replace(col(path), r"\\", "/"), "/"), -1)


def parse_patch_name(filename) -> dict[str, Column]:
    """``sample_t_y_x.npy`` read from the right, since a sample name may hold underscores."""
    name = col(filename)
    good = name.rlike(PATCH_NAME)
    checked = F.when(good, name).otherwise(
        F.raise_error(F.concat(F.lit("malformed patch name: "), F.coalesce(name, F.lit("NULL"))))
    )
    part = lambda i: F.regexp_extract(checked, PATCH_NAME, i)
    return {
        "sample_id": part(1),
        "frame_idx": part(2).cast("int"),
        "candidate_y": part(3).cast("int"),
        "candidate_x": part(4).cast("int"),
    }


def micros(ts) -> Column:
    """Microseconds since the epoch; a naive timestamp counts as session time (UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def relative_time(then, now) -> Column:
    """Human distance in time; the future counts as just now."""
    then, now = col(then), col(now)
    secs = (micros(now) - micros(then)) / F.lit(1e6)

    def unit(seconds: int, word: str) -> Column:
        n = F.floor(secs / seconds).cast("bigint")
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    return (
        F.when(secs < MINUTE, F.lit("just now"))
        .when(secs < HOUR, unit(MINUTE, "minute"))
        .when(secs < DAY, unit(HOUR, "hour"))
        .when(secs < DAYS_AS_DAYS * DAY, unit(DAY, "day"))
        .when(secs < DAYS_AS_WEEKS * DAY, unit(DAYS_AS_DAYS * DAY, "week"))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def shape_from_json(text) -> Column:
    return F.from_json(col(text), "array<int>")


def shape_to_json(shape) -> Column:
    return F.to_json(col(shape))
