"""Colour, exposure and score column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Appearance colour of surfaces no photo observed, and class colours.
FALLBACK_RGB = (145, 120, 90)
COMPLETION_RGB = (197, 88, 235)
LEARNED_RGB = (244, 160, 42)
UNOBSERVED_RGB = (125, 125, 125)


def clip(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(low) if not isinstance(low, Column) else low),
                   F.lit(high) if not isinstance(high, Column) else high)


def srgb_linear(value: Column) -> Column:
    """0..255 display value -> linear 0..1."""
    c = value / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(value: Column) -> Column:
    """Linear value -> display 0..255, negative light counts as 0."""
    c = F.greatest(value, F.lit(0.0))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255.0


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of a 0..255 display colour under D65."""
    lr, lg, lb = srgb_linear(r), srgb_linear(g), srgb_linear(b)
    x = (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    z = (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)

    lightness = F.when(y > 0.008856, F.pow(y, F.lit(1 / 3)) * 116.0 - 16.0).otherwise(y * 903.3)
    return F.struct(lightness.alias("l"), ((f(x) - f(y)) * 500.0).alias("a"), ((f(y) - f(z)) * 200.0).alias("b"))


def delta_e76(p: Column, q: Column) -> Column:
    """Euclidean distance of two Lab structs."""
    dl, da, db = p["l"] - q["l"], p["a"] - q["a"], p["b"] - q["b"]
    return F.sqrt(dl * dl + da * da + db * db)


def exposure_quality(luminance: Column) -> Column:
    """Penalty for near-black and clipped light, never a bonus for the brighter photo."""
    return clip(luminance / 24.0, 0.35, 1.0) * clip((F.lit(255.0) - luminance) / 12.0, 0.35, 1.0)


def quality_code(source_code: Column, mask_distance: Column, score: Column) -> Column:
    """0 no photo, 1 photo sample near an edge or oblique, 2 visible interior photo sample."""
    return F.when(source_code == 0, 0).when((mask_distance >= 2) & (score >= 0.15), 2).otherwise(1)


def palette_rgb(code: Column, n: Column) -> Column:
    """array(r, g, b) shown for a source code: grey for 0, else hue (code-1)/n at saturation .75, value .95."""
    hue = (code - 1) / n
    sector = F.floor(hue * 6)
    part = hue * 6 - sector
    value, low = F.lit(0.95), F.lit(0.95 * (1 - 0.75))
    fall = value * (F.lit(1.0) - part * 0.75)
    rise = value * (F.lit(1.0) - (F.lit(1.0) - part) * 0.75)
    table = {0: (value, rise, low), 1: (fall, value, low), 2: (low, value, rise),
             3: (low, fall, value), 4: (rise, low, value), 5: (value, low, fall)}
    chosen = None
    for key, rgb in table.items():
        item = F.array(*[F.rint(c * 255).cast("int") for c in rgb])
        cond = F.pmod(sector, F.lit(6)) == key
        chosen = F.when(cond, item) if chosen is None else chosen.when(cond, item)
    return F.when(code == 0, F.array(*[F.lit(c) for c in UNOBSERVED_RGB])).otherwise(chosen)


def sky(r: Column, g: Column, b: Column, blue_red=1.25, blue_green=1.08, minimum=25.0) -> Column:
    """Blue background pixel; the three thresholds come from the annotation."""
    return (b > r * blue_red) & (b > g * blue_green) & (b - r > minimum)


def class_color(completion: Column) -> Column:
    """Display colour of a geometry class: silhouette completion or learned depth."""
    return F.when(completion, F.array(*[F.lit(c) for c in COMPLETION_RGB])) \
        .otherwise(F.array(*[F.lit(c) for c in LEARNED_RGB]))


def signed_evidence(observed: Column, z: Column, seen_inside: Column, confidence: Column, tau: Column) -> Column:
    """struct(use, d, certainty): truncated depth difference and its weight for one voxel in one view."""
    diff = observed - z
    use = F.coalesce(seen_inside & (diff >= -tau), F.lit(False))
    weight = F.when(use, clip(confidence - 1.0, 0.1, 5.0)).otherwise(0.0)
    return F.struct(use.alias("use"), F.when(use, clip(diff, -tau, tau)).otherwise(0.0).alias("d"),
                    weight.alias("certainty"))


def silhouette_distance(pixels: Column, z: Column, fx: Column, fy: Column, seen: Column, tau: Column,
                        tolerance: float = 2.0) -> Column:
    """Signed pixel distance to the silhouette in world units; -tau where the view does not see the voxel."""
    return F.when(seen, (pixels - tolerance) * z / ((fx + fy) / 2)).otherwise(-tau)
