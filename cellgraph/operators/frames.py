"""Image frames: projection, smoothing, peaks, thresholds, regions, detection.

Two layouts are served. Pixel tables (one row per pixel) go through windows and joins. Frame
tables (one array per frame) are handled where they lie, frame by frame, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .graph import components
from .spatial import FRAME

# Detector defaults.
SIGMA, THRESHOLD, MIN_DISTANCE = 1.0, 10.0, 5
OTSU_BINS = 256


def max_project(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*FRAME, "y", "x").agg(F.max("v").alias("v"))


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(pixels: DataFrame, sigma: float, truncate: bool = False) -> DataFrame:
    """Separable smoothing with mirrored edges: one weighted window down the columns, one along the rows.

    ``truncate`` drops fractions between the passes, as integer images do.
    """
    w = gaussian_weights(sigma)
    r = len(w) // 2
    if r == 0:
        return pixels
    size = pixels.groupBy(*FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    out = pixels.join(size, FRAME)
    for axis, other, length in (("y", "x", "h"), ("x", "y", "w")):
        n = F.col(length)
        turns = F.sequence(-F.ceil(F.lit(r) / (2 * n)).cast("int"), F.ceil(F.lit(r) / (2 * n)).cast("int"))
        a = F.col(axis)
        places = F.concat(F.transform(turns, lambda k: a + 2 * n * k), F.transform(turns, lambda k: 2 * n - 1 - a + 2 * n * k))
        wide = out.withColumn("_p", F.explode(places)).where((F.col("_p") >= -r) & (F.col("_p") < n + r))
        line = W.partitionBy(*FRAME, other).orderBy("_p")
        total = sum((F.lag("v", -k).over(line) * F.lit(w[k + r]) for k in range(-r, r + 1)), F.lit(0.0))
        v = F.when(total >= 0, F.floor(total)).otherwise(F.ceil(total)).cast("double") if truncate else total
        out = wide.withColumn("_v", v).where((F.col("_p") >= 0) & (F.col("_p") < n)).select(
            *FRAME, F.col("_p").alias(axis), other, F.col("_v").alias("v"), "h", "w")
    return out.select(*FRAME, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")


def local_maxima(pixels: DataFrame, d: int, threshold: float) -> DataFrame:
    """Peaks: equal to the greatest value within d on both axes, above the threshold, off the border.

    Peaks closer than d (only plateaus can be) are thinned, brightest and topmost first.
    """
    span = lambda axis, other: W.partitionBy(*FRAME, other).orderBy(axis).rangeBetween(-d, d)
    size = pixels.groupBy(*FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    top = pixels.withColumn("_m", F.max("v").over(span("y", "x"))).withColumn("_m", F.max("_m").over(span("x", "y")))
    peaks = (top.where((F.col("v") == F.col("_m")) & (F.col("v") > threshold)).join(size, FRAME)
             .where((F.col("y") >= d) & (F.col("y") < F.col("h") - d) & (F.col("x") >= d) & (F.col("x") < F.col("w") - d))
             .select(*FRAME, "y", "x", "v"))

    # peaks within d of each other are equally bright: only brightness that a frame has twice needs thinning
    alike = peaks.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*FRAME, "v")))

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        yx, v = pdf[["y", "x"]].to_numpy(), pdf["v"].to_numpy()
        return pdf.iloc[_thin(yx, v, d)]

    # a given number of tasks is not merged into one; a frame holds at most (size / d)^2 peaks plus plateaus
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    twice = alike.where("_n > 1").drop("_n").repartition(tasks, *FRAME)
    return alike.where("_n = 1").drop("_n").unionByName(twice.groupBy(*FRAME).applyInPandas(thin, peaks.schema))


def _thin(yx: np.ndarray, v: np.ndarray, d: int) -> np.ndarray:
    order = np.lexsort((yx[:, 1], yx[:, 0], -v))
    gone = np.zeros(len(v), dtype=bool)
    keep = []
    for i in order:
        if not gone[i]:
            keep.append(i)
            gone |= np.abs(yx - yx[i]).max(axis=1) < d
    return np.array(keep, dtype=int)


def find_peaks(image: np.ndarray, sigma: float, threshold: float, d: int, truncate: bool = False) -> np.ndarray:
    """Peaks of one frame, brightest first: smooth, compare with the box maximum, thin.

    ``truncate`` drops fractions after each smoothing pass, as integer images do.
    """
    _, y, x = _stack_peaks(_smooth_stack(image[None], sigma, truncate), np.array([threshold], dtype=float), d)
    return np.stack([y, x], axis=1)


def _smooth_stack(images: np.ndarray, sigma: float, truncate: bool) -> np.ndarray:
    w = np.array(gaussian_weights(sigma)) if sigma > 0 else np.ones(1)
    r = len(w) // 2
    out = images.astype(np.float64)
    for axis in (1, 2):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        out = sum(c * part for c, part in zip(w, _shifted(wide, axis, 2 * r + 1)))
        out = np.trunc(out) if truncate else out
    return out


def _shifted(wide: np.ndarray, axis: int, n: int) -> list[np.ndarray]:
    size = wide.shape[axis] - n + 1
    return [wide[:, k:k + size] if axis == 1 else wide[:, :, k:k + size] for k in range(n)]


def _stack_peaks(out: np.ndarray, threshold: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, y and x of the peaks of a stack of frames, each with its threshold; by frame, brightest first."""
    box = out
    for axis in (1, 2):
        wide = np.pad(box, [(d, d) if a == axis else (0, 0) for a in range(3)], mode="constant", constant_values=-np.inf)
        box = reduce(np.maximum, _shifted(wide, axis, 2 * d + 1))
    hit = (out == box) & (out > threshold[:, None, None])
    inner = np.zeros_like(hit)
    inner[:, d:hit.shape[1] - d, d:hit.shape[2] - d] = True
    f, y, x = np.nonzero(hit & inner)
    v = out[f, y, x]
    order = np.lexsort((x, y, -v, f))
    f, y, x, v = f[order], y[order], x[order], v[order]
    # peaks within d of each other are equally bright
    keep = np.ones(len(f), dtype=bool)
    for k in np.unique(f[1:][(f[1:] == f[:-1]) & (v[1:] == v[:-1])]):
        lo, hi = np.searchsorted(f, [k, k + 1])
        keep[lo:hi] = False
        keep[lo + _thin(np.stack([y, x], axis=1)[lo:hi], v[lo:hi], d)] = True
    return f[keep], y[keep], x[keep]


STACK_PIXELS = 1 << 20  # frames of one size are handled together, so many pixels at once
DETECTED = "sample_id string, t int, sigma double, threshold double, min_distance int, idx int, y double, x double"


def frames_of_pixels(pixels: DataFrame) -> DataFrame:
    """One row per frame (sample_id, t, height, width, pix), pixels row by row; absent pixels are 0."""
    size = pixels.groupBy(*FRAME).agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"),
                                      F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))).alias("_p"))

    def fill(batches):
        for pdf in batches:
            out = []
            for h, w, px in zip(pdf["height"], pdf["width"], pdf["_p"]):
                image = np.zeros((h, w))
                image[[p["y"] for p in px], [p["x"] for p in px]] = [p["v"] for p in px]
                out.append(image.ravel())
            yield pdf[[*FRAME, "height", "width"]].assign(pix=out)

    dense = F.size("_p") == F.col("height") * F.col("width")
    given = size.where(dense).select(*FRAME, "height", "width", F.transform("_p", lambda p: p["v"]).alias("pix"))
    return given.unionByName(size.where(~dense).mapInPandas(fill, given.schema))


def detect(frames: DataFrame, sigma=SIGMA, threshold: float | str = THRESHOLD, min_distance=MIN_DISTANCE, grid: list[tuple[float, float, int]] | None = None,
           detector: Callable | None = None, truncate: bool = False) -> DataFrame:
    """Detections of each frame (sample_id, t, height, width, pix) for one or many settings.

    ``threshold`` may name a column of ``frames``: every frame then has its own (see ``frame_threshold``).
    ``truncate`` treats the images as integers.

    Frames stay on their partition and are read once for all settings; those of one size are handled as
    stacks, smoothed once per sigma.
    ``detector(image, sigma, threshold, min_distance) -> N x 2`` replaces the built-in one.
    """
    settings = [(float(s), t, int(d)) for s, t, d in grid or [(sigma, threshold, min_distance)]]
    level = lambda t: F.col(t).cast("double") if isinstance(t, str) else F.lit(float(t))
    rows = frames.select(*FRAME, "height", "width", "pix", *[level(t).alias(f"_t{k}") for k, (_, t, _) in enumerate(settings)])

    def found(images: np.ndarray, levels: list[np.ndarray]):
        smooth = {}
        for (s, _, d), own in zip(settings, levels):
            if detector:
                each = [np.asarray(detector(image, s, t, d), dtype=float).reshape(-1, 2) for image, t in zip(images, own)]
                f, yx = np.repeat(np.arange(len(each)), [len(e) for e in each]), np.concatenate(each)
                yield s, own, d, f, yx[:, 0], yx[:, 1]
            else:
                if s not in smooth:
                    smooth[s] = _smooth_stack(images, s, truncate)
                yield s, own, d, *_stack_peaks(smooth[s], own, d)

    def run(batches):
        for pdf in batches:
            for (h, w), same in pdf.groupby(["height", "width"]):
                step = max(1, STACK_PIXELS // max(1, h * w))
                for k in range(0, len(same), step):
                    part = same.iloc[k:k + step]
                    images = np.array(list(part["pix"]), dtype=np.float64).reshape(len(part), h, w)
                    levels = [part[f"_t{i}"].to_numpy(dtype=float) for i in range(len(settings))]
                    for s, own, d, f, y, x in found(images, levels):
                        yield pd.DataFrame({
                            "sample_id": part["sample_id"].to_numpy()[f], "t": part["t"].to_numpy()[f], "sigma": s, "threshold": own[f],
                            "min_distance": d, "idx": np.arange(len(f)) - np.searchsorted(f, f), "y": y.astype(float), "x": x.astype(float)})

    return rows.mapInPandas(run, DETECTED)


def frame_threshold(pixels: DataFrame, method: str = "percentile", percentile: float = 99.0, k: float = 3.0,
                    floor: float = THRESHOLD) -> DataFrame:
    """One threshold per frame, never below the floor: percentile, robust (median + k MAD) or otsu.

    A frame's pixels are bounded by the sensor, so a per-frame percentile is safe here.
    """
    if method == "percentile":
        raw = pixels.groupBy(*FRAME).agg(F.percentile("v", percentile / 100).alias("raw"))
    elif method == "robust":
        mid = pixels.groupBy(*FRAME).agg(F.percentile("v", 0.5).alias("_m"))
        dev = pixels.join(mid, FRAME).groupBy(*FRAME).agg(
            F.max("_m").alias("_m"), F.percentile(F.abs(F.col("v") - F.col("_m")), 0.5).alias("_d"))
        raw = dev.select(*FRAME, (F.col("_m") + F.lit(float(k)) * F.col("_d")).alias("raw"))
    elif method == "otsu":
        raw = _otsu(pixels)
    else:
        raise ValueError(f"unknown threshold method {method!r}")
    return raw.select(*FRAME, "raw", F.greatest("raw", F.lit(float(floor))).alias("threshold"))


def _otsu(pixels: DataFrame) -> DataFrame:
    ends = pixels.groupBy(*FRAME).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / OTSU_BINS
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) * OTSU_BINS / (
        F.col("hi") - F.col("lo"))), F.lit(OTSU_BINS - 1))).otherwise(F.lit(0))
    hist = pixels.join(ends, FRAME).withColumn("bin", at.cast("int")).groupBy(*FRAME, "lo", "hi", "bin").agg(
        F.count(F.lit(1)).cast("double").alias("n")).withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * width)
    up = W.partitionBy(*FRAME).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*FRAME).orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    m = F.col("n") * F.col("c")
    scored = hist.select(*FRAME, "lo", "hi", "bin", "c", F.sum("n").over(up).alias("w1"), F.sum("n").over(down).alias("w2"),
                         F.sum(m).over(up).alias("s1"), F.sum(m).over(down).alias("s2"))
    gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    var = F.round(F.col("w1") * F.col("w2") * gap * gap, 9)
    best = F.max_by("c", F.struct(F.when(F.col("w2").isNotNull(), var), -F.col("bin")))
    flat = F.max("hi") == F.min("lo")
    return scored.groupBy(*FRAME).agg(F.when(flat, F.min("lo")).otherwise(best).alias("raw"))


def frame_profile(pixels: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Brightness figures of a frame, or of its crop (top, left, bottom, right; ends excluded)."""
    if box:
        top, left, bottom, right = box
        pixels = pixels.where((F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right))
    return pixels.groupBy(*FRAME).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.percentile("v", [0.01, 0.99, 0.995, 0.999]).alias("_p")).select(
        *FRAME, "min", "max", "mean", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p1", "p99", "p995", "p999"))])


def region_candidates(pixels: DataFrame, threshold: float, least: int = 10, most: int = 200, diagonal: bool = False) -> DataFrame:
    """Connected bright regions with centroid, area and greatest value, for areas within limits.

    Pixels join along edges; over corners too if ``diagonal`` is set.
    """
    bright = pixels.where(F.col("v") > threshold)
    key = F.concat_ws("\u0001", "sample_id", F.col("t").cast("string"))
    # one number per pixel of a frame, for every pair of int coordinates
    node = F.col("y").cast("bigint") * (1 << 32) + F.col("x")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    moved = bright.withColumn("_m", moves).select(
        *FRAME, node.alias("src"), (F.col("y") + F.col("_m.a")).alias("y"), (F.col("x") + F.col("_m.b")).alias("x"))
    edges = moved.join(bright.select(*FRAME, "y", "x"), [*FRAME, "y", "x"]).select(
        key.alias("sample_id"), "src", node.alias("dst"))
    labels = components(edges).withColumnRenamed("sample_id", "_f").withColumnRenamed("node", "_n")
    tagged = bright.withColumn("_f", key).withColumn("_n", node).join(labels, ["_f", "_n"], "left").withColumn(
        "region", F.coalesce("component", "_n"))
    return tagged.groupBy(*FRAME, "region").agg(
        F.avg("y").alias("y"), F.avg("x").alias("x"), F.count(F.lit(1)).alias("area"), F.max("v").alias("max_v")
    ).where((F.col("area") >= least) & (F.col("area") <= most))
