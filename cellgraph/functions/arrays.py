"""Expressions over row-major pixel arrays; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import col


def pixel_sum(pix) -> Column:
    return F.aggregate(col(pix), F.lit(0.0), lambda a, v: a + v.cast("double"))


def pixel_mean(pix) -> Column:
    return pixel_sum(pix) / F.size(col(pix))


def pixel_std(pix) -> Column:
    """Population deviation, about the mean (no difference of large sums)."""
    p, mean = col(pix), pixel_mean(pix)
    spread = F.aggregate(
        p, F.struct(F.lit(0.0).alias("s"), mean.alias("m")),
        lambda a, v: F.struct((a["s"] + (v.cast("double") - a["m"]) * (v.cast("double") - a["m"])).alias("s"), a["m"].alias("m")),
        lambda a: a["s"])
    return F.sqrt(spread / F.size(p))


def affine(pix, shift, scale) -> Column:
    """(v - shift) / scale for every pixel."""
    shift, scale = col(shift), col(scale)
    return F.transform(col(pix), lambda v: (v.cast("double") - shift) / scale)


def crop(pix, width, top, left, size: int) -> Column:
    """size x size crop of a row-major frame."""
    p, w, y, x = col(pix), col(width), col(top), col(left)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(p, (y + r) * w + x + 1, F.lit(size))))


def rows_of(pix, side: int) -> Column:
    p = col(pix)
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.slice(p, r * side + 1, F.lit(side)))


def crop_resize(pix, side: int, half: int) -> Column:
    """Central 2*half square stretched back to side x side, bilinear with corners aligned, as float."""
    if half < 1 or 2 * half > side:
        raise ValueError(f"crop of {2 * half} does not fit a side of {side}")
    n = 2 * half
    top = side // 2 - half
    at = [i * (n - 1) / (side - 1) for i in range(side)]
    low = [min(int(a), n - 2) if n > 1 else 0 for a in at]
    base = F.array(*[F.lit(top + k) for k in low])
    part = F.array(*[F.lit(a - k) for a, k in zip(at, low)])
    p = col(pix)
    square = F.when(F.size(p) == side * side, p).otherwise(F.raise_error(F.lit("patch is not square")).cast("array<float>"))

    def value(k: Column) -> Column:
        i, j = F.floor(k / side).cast("int"), (k % side).cast("int")
        y, x, fy, fx = F.get(base, i), F.get(base, j), F.get(part, i), F.get(part, j)
        v = lambda dy, dx: F.get(square, (y + dy) * side + x + dx).cast("double")
        return ((1 - fy) * ((1 - fx) * v(0, 0) + fx * v(0, 1)) + fy * ((1 - fx) * v(1, 0) + fx * v(1, 1))).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), value)


def flip_columns(pix, side: int) -> Column:
    return F.flatten(F.transform(rows_of(pix, side), lambda r: F.reverse(r)))


def flip_rows(pix, side: int) -> Column:
    return F.flatten(F.reverse(rows_of(pix, side)))


def quarter_turn(pix, side: int) -> Column:
    """Counter-clockwise by 90 degrees."""
    p = col(pix)
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.get(
        p, (k % side).cast("int") * side + (side - 1) - F.floor(k / side).cast("int")))
