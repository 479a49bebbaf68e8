"""Patches around candidates: extraction, statistics, normalisation, splits and draws."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays
from ..functions.scalar import PATCH_SIDE, fits_frame
from ..session import cut_lineage
from .ranking import exact_percentiles, rank_rows
from .spatial import FRAME, hashed_number, hashed_unit

# Fixed values of the normalisation and augmentation contract.
MAD_SCALE = 1.4826
EPS_FLOOR = 1e-6
EPS_SHARE = 0.02
GLOBAL_EPS = 1e-8
FEW_PATCHES = 20
BRIGHTNESS, NOISE = 0.2, 0.05
CONTRAST_RANGE = (0.5, 1.8)


def extract_patches(frames: DataFrame, centers: DataFrame, size: int = PATCH_SIDE) -> DataFrame:
    """size x size crops around centers; those that leave the frame are dropped."""
    half = size // 2
    j = centers.join(frames.select(*FRAME, "height", "width", F.col("pix").alias("_pix")), FRAME)
    j = j.where(fits_frame("y", "x", "height", "width", size))
    cut = arrays.crop("_pix", "width", F.col("y").cast("int") - half, F.col("x").cast("int") - half, size)
    return j.withColumn("pix", cut).select(*centers.columns, "pix")


def patch_stats(patches: DataFrame) -> DataFrame:
    return patches.withColumn("mean", arrays.pixel_mean("pix")).withColumn("std", arrays.pixel_std("pix"))


def validate_patches(patches: DataFrame, n_pixels: int) -> DataFrame:
    """Rows with a violation: wrong_size, nan, inf or null."""
    inf = F.lit(float("inf"))
    broken = (F.when(F.col("pix").isNull(), "null").when(F.size("pix") != n_pixels, "wrong_size")
              .when(F.exists("pix", lambda v: v.isNull()), "null").when(F.exists("pix", lambda v: F.isnan(v)), "nan")
              .when(F.exists("pix", lambda v: F.abs(v) == inf), "inf"))
    return patches.withColumn("violation", broken).where("violation IS NOT NULL").drop("pix")


def pixel_distribution(patches: DataFrame) -> DataFrame:
    """Pooled pixel figures per sample from per-row sums; a non-finite pixel is an error."""
    inf = F.lit(float("inf"))
    bad = F.exists("pix", lambda v: F.isnan(v) | (F.abs(v) == inf))
    ok = F.when(~bad, F.col("pix")).otherwise(F.raise_error(F.lit("non-finite pixel")).cast("array<float>"))
    rows = patches.withColumn("pix", ok).select(
        "sample_id", "label", arrays.pixel_sum("pix").alias("s"), F.size("pix").alias("n"),
        F.aggregate("pix", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")).alias("q"),
        F.array_min("pix").cast("double").alias("lo"), F.array_max("pix").cast("double").alias("hi"))
    g = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_patches"), F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_negative"), F.sum("s").alias("_s"), F.sum("q").alias("_q"),
        F.sum("n").alias("_n"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    mean = F.col("_s") / F.col("_n")
    var = F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean)
    return g.select("sample_id", "n_patches", "n_positive", "n_negative",
                    (F.col("n_positive") / F.col("n_patches")).alias("positive_ratio"), mean.alias("mean"),
                    F.sqrt(var).alias("std"), "min", "max")


def robust_stats(patches: DataFrame, few: int = FEW_PATCHES) -> DataFrame:
    """Median, MAD and scale of all pixels of a sample. Labels are never read.

    No patches at all is an error; a sample with few of them is flagged.
    """
    if patches.isEmpty():
        raise ValueError("robust statistics need at least one patch")
    pixels = patches.select("sample_id", F.explode("pix").alias("v"))
    mid = cut_lineage(exact_percentiles(pixels, "v", {"median": 0.5}, ["sample_id"]))
    apart = pixels.join(mid, "sample_id").select("sample_id", F.abs(F.col("v").cast("double") - F.col("median")).alias("d"))
    mad = exact_percentiles(apart, "d", {"mad": 0.5}, ["sample_id"])
    n = patches.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_patches"))
    return n.join(mid, "sample_id").join(mad, "sample_id").select(
        "sample_id", "n_patches", "median", "mad", (F.lit(MAD_SCALE) * F.col("mad")).alias("scale"),
        (F.col("n_patches") < few).alias("few_patches"))


def robust_eps(patches: DataFrame, share: float = EPS_SHARE) -> DataFrame:
    """Stabiliser from the median per-patch deviation of the training split only."""
    train = patches.where("split = 'train'").select(arrays.pixel_std("pix").alias("std"))
    return exact_percentiles(train, "std", {"median_std": 0.5}).select(
        "median_std", F.greatest(F.lit(EPS_FLOOR), F.lit(share) * F.col("median_std")).alias("eps"))


def normalise(patches: DataFrame, method: str, eps: float = EPS_FLOOR, stats: DataFrame | None = None) -> DataFrame:
    """``patch``: own mean and deviation; ``sample``: pooled median and scale (``stats`` by sample);
    ``global``: one mean and deviation (one-row ``stats``)."""
    if method == "patch":
        p = patch_stats(patches)
        return p.withColumn("pix", arrays.affine("pix", "mean", F.col("std") + F.lit(eps))).drop("mean", "std")
    if stats is None:
        raise ValueError(f"method {method!r} needs stats")
    if method == "sample":
        j = patches.join(stats.select("sample_id", F.col("median").alias("_m"), F.col("scale").alias("_s")), "sample_id")
    elif method == "global":
        one = stats.select(F.col("mean").alias("_m"), F.col("std").alias("_s")).limit(1)
        j, eps = patches.join(F.broadcast(one)), GLOBAL_EPS  # a single row
    else:
        raise ValueError(f"unknown method {method!r}")
    return j.withColumn("pix", arrays.affine("pix", "_m", F.col("_s") + F.lit(eps))).drop("_m", "_s")


def score_patches(patches: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int,
                  keep: float | None = 0.5, batch_size: int = 256) -> DataFrame:
    """Probability of every patch. ``model()`` runs once per worker and returns a batch function."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    def make() -> Callable[[np.ndarray], np.ndarray]:
        predict = model()
        return lambda x: np.asarray(predict(x), dtype=np.float64).reshape(-1)

    udf = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[side, side]])
    scored = patches.withColumn("probability", udf(F.col("pix").cast("array<double>")))
    return scored.where(F.col("probability") >= keep) if keep is not None else scored


def _ordered(df: DataFrame, key: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows in a seeded random order: column ``rank`` from 0, plus the group size ``n``."""
    by = list(by)
    mixed = df.withColumn("_h", hashed_number(F.lit(seed), key))
    ranked = rank_rows(mixed, "_h", key, by, "rank").drop("_h")
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(size, by) if by else ranked.join(F.broadcast(size))  # one row


def split_samples(samples: DataFrame, seed: int, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Whole samples to train, val and test; counts are rounded half to even, the rest is test."""
    ids = samples.select("sample_id").distinct()
    o = _ordered(ids, "sample_id", seed)
    n_train = F.least(F.bround(F.lit(train) * F.col("n"), 0), F.col("n"))
    n_val = F.least(F.bround(F.lit(val) * F.col("n"), 0), F.col("n") - n_train)
    return o.select("sample_id", F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val")
                    .otherwise("test").alias("split"))


def holdout(patches: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Row-level train/val split that keeps the class shares."""
    o = _ordered(patches, key, seed, ["label"])
    return o.withColumn("part", F.when(F.col("rank") < F.bround(F.lit(share) * F.col("n"), 0), "val").otherwise("train")).drop("rank", "n")


def balanced_sample(patches: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Draws with replacement, every class equally likely, every row of a class equally likely."""
    sizes = {r["label"]: r["n"] for r in patches.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    if len(sizes) < 2:
        raise ValueError(f"balanced draws need two classes, found {sorted(sizes)}")
    total = n or sum(sizes.values())
    labels = sorted(sizes)
    mix = lambda tag: hashed_number("id", F.lit(seed), F.lit(tag))
    pick = F.get(F.array(*[F.lit(k) for k in labels]), F.pmod(mix("class"), F.lit(len(labels))).cast("int"))
    size = F.get(F.array(*[F.lit(sizes[k]) for k in labels]), F.pmod(mix("class"), F.lit(len(labels))).cast("int"))
    draws = patches.sparkSession.range(total).select(F.col("id").alias("draw"), pick.alias("label"), F.pmod(mix("row"), size).alias("rank"))
    return draws.join(rank_rows(patches, key, key, ["label"], "rank"), ["label", "rank"]).drop("rank")


def augment(patches: DataFrame, key: str, side: int, copies: int = 1, seed: int = 0) -> DataFrame:
    """Changed copies of training patches: contrast, flips, quarter turns, brightness, noise. Other splits pass through."""
    train = patches.where("split = 'train'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    u = lambda tag: hashed_unit(F.col(key), F.col("copy"), F.lit(seed), F.lit(tag))
    low, high = CONTRAST_RANGE
    scale, shift = F.lit(low) + u("contrast") * F.lit(high - low), (u("bright") * 2 - 1) * F.lit(BRIGHTNESS)
    out = train.withColumn("_m", arrays.pixel_mean("pix")).withColumn(
        "pix", F.transform("pix", lambda v: (v.cast("double") - F.col("_m")) * scale + F.col("_m"))).drop("_m")
    pick = lambda cond, a: F.when(cond, a).otherwise(F.col("pix"))
    out = out.withColumn("pix", pick(u("lr") < 0.5, arrays.flip_columns("pix", side)))
    out = out.withColumn("pix", pick(u("ud") < 0.5, arrays.flip_rows("pix", side)))
    for turn in (1, 2, 3):
        out = out.withColumn("pix", pick(u("turn") * 4 >= turn, arrays.quarter_turn("pix", side)))
    # normal draws by the polar form of two uniform numbers per pixel
    draw = lambda i, tag: hashed_unit(F.col(key), F.col("copy"), F.lit(seed), i, F.lit(tag))
    noise = lambda i: F.sqrt(-2 * F.ln(1 - draw(i, "n1"))) * F.cos(draw(i, "n2") * F.lit(2 * np.pi)) * F.lit(NOISE)
    out = out.withColumn("pix", F.transform("pix", lambda v, i: (v + shift + noise(i)).cast("float")))
    rest = patches.where("split <> 'train'").withColumn("copy", F.lit(0))
    originals = patches.where("split = 'train'").withColumn("copy", F.lit(0))
    return out.unionByName(originals).unionByName(rest)

