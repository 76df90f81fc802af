"""Decisions about images from measurements; pixels are not read here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of measurements and sizes.
BLUR, DARK, BRIGHT, CONTRAST, SKEW = 60.0, 45.0, 225.0, 28.0, 0.4
SHORT, LONG, SMALLEST, MEGAPIXELS = 900, 3000, 200, 40


def verdict(width: Column, height: Column, blur: Column, brightness: Column, contrast: Column) -> Column:
    """good without a failed limit, acceptable with one, else poor."""
    limits = ((width < SMALLEST) | (height < SMALLEST), blur < BLUR, (brightness < DARK) | (brightness > BRIGHT), contrast < CONTRAST)
    failed = sum((x.cast("int") for x in limits), F.lit(0))
    return F.when(failed == 0, "good").when(failed == 1, "acceptable").otherwise("poor")


def size_error(width: Column, height: Column) -> Column:
    return F.when((width < SMALLEST) | (height < SMALLEST), "IMAGE_TOO_SMALL").when(width * height > MEGAPIXELS * 1_000_000, "IMAGE_TOO_LARGE")


def scale(width: Column, height: Column) -> Column:
    """The factor that brings the short side to its least and the long side under its most; near 1 is 1."""
    short, long = F.least(width, height), F.greatest(width, height)
    up = F.greatest(F.lit(1.0), F.lit(float(SHORT)) / short)
    s = F.least(up, F.lit(float(LONG)) / long)
    return F.when(F.abs(s - 1) < 0.02, 1.0).otherwise(s)


def plan(blur: Column, brightness: Column, contrast: Column, skew: Column, width: Column, height: Column, sharpen: bool = False, threshold: bool = False) -> Column:
    """struct<applied, skipped> of steps in order, each applied only where a measurement asks for it."""
    steps = (
        ("deskew", F.coalesce(F.abs(skew) >= SKEW, F.lit(False)), F.when(skew.isNull(), "no_estimate").otherwise("below_threshold")),
        ("resize", scale(width, height) != 1.0, F.lit("not_needed")),
        ("grayscale", F.lit(True), F.lit("disabled")),
        ("denoise", blur < 3 * BLUR, F.lit("image_already_sharp")),
        ("contrast", (contrast < CONTRAST) | (brightness < DARK) | (brightness > BRIGHT), F.lit("not_needed")),
        ("sharpen", F.lit(sharpen) & (blur < BLUR), F.lit("not_needed" if sharpen else "disabled")),
        ("threshold", F.lit(threshold), F.lit("disabled")),
    )
    applied = F.array_compact(F.array(*[F.when(wanted, name) for name, wanted, _ in steps]))
    skipped = F.array_compact(F.array(*[F.when(~wanted, F.concat(F.lit(name + ":"), why)) for name, wanted, why in steps]))
    return F.struct(applied.alias("applied"), skipped.alias("skipped"))


def image_issues(width: Column, height: Column, blur: Column, brightness: Column, contrast: Column, skew: Column) -> Column:
    """Codes of what is wrong with an image, in order."""
    return F.array_compact(
        F.array(
            F.when((width < SMALLEST) | (height < SMALLEST), "IMAGE_LOW_RESOLUTION"),
            F.when(blur < BLUR, "IMAGE_BLURRY"),
            F.when(brightness < DARK, "IMAGE_TOO_DARK").when(brightness > BRIGHT, "IMAGE_TOO_BRIGHT"),
            F.when(contrast < CONTRAST, "IMAGE_LOW_CONTRAST"),
            F.when(F.abs(skew) > 5 * SKEW, "IMAGE_SKEWED"),
        )
    )
