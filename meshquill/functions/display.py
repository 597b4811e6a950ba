"""Colours, radii, and values shown as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the display.
GOLDEN_ANGLE, SATURATION, LIGHTNESS = 137.508, 0.85, 0.66
MIN_RADIUS, BASE_RADIUS, RADIUS_SCALE = 5.0, 2.0, 1.6


def radius(in_degree: Column, out_degree: Column) -> Column:
    """Grows with the root of the larger degree, from a floor."""
    return F.greatest(F.lit(MIN_RADIUS), BASE_RADIUS + RADIUS_SCALE * F.sqrt(F.greatest(in_degree, out_degree).cast("double")))


def community_rgb(community: Column) -> Column:
    """r | g << 8 | b << 16 of a community: hues a golden angle apart."""
    hue = F.pmod(community.cast("double") * GOLDEN_ANGLE, F.lit(360.0))
    chroma = (1 - abs(2 * LIGHTNESS - 1)) * SATURATION
    floor = LIGHTNESS - chroma / 2

    def channel(turn: int) -> Column:
        k = F.pmod(F.lit(float(turn)) + hue / 60, F.lit(6.0))
        level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(k - 3) - 1))
        return F.floor((floor + chroma * level) * 255 + 0.5).cast("long")

    return channel(0) + channel(4) * 256 + channel(2) * 65536


def with_alpha(rgb: Column, alpha: float | Column) -> Column:
    """Packed RGB with an alpha byte on top."""
    byte = F.floor(F.lit(alpha) * 255 + 0.5).cast("long") if not isinstance(alpha, Column) else F.floor(alpha * 255 + 0.5).cast("long")
    return byte * 16777216 + rgb


def variant_text(v: Column) -> Column:
    """Strings raw, numbers and booleans as written, the rest as JSON."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
