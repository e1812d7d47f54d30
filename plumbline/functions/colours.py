"""Colour values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first nine indexed colours as red, green, blue.
BASE = {1: (255, 0, 0), 2: (255, 255, 0), 3: (0, 255, 0), 4: (0, 255, 255), 5: (0, 0, 255), 6: (255, 0, 255), 7: (0, 0, 0), 8: (128, 128, 128), 9: (192, 192, 192)}
#: Bits of a polyline's flags.
FLAGS = ("closed", "curve_fit", "spline_fit", "is_3d_polyline", "is_3d_mesh", "is_closed_mesh", "is_polyface_mesh", "continuous_linetype")


def _hex(*rgb: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in rgb])


def true_hex(colour: Column) -> Column:
    """#rrggbb of the low 24 bits."""
    c = colour.cast("long").bitwiseAND(0xFFFFFF)
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(c)), 6, "0"))


def index_hex(index: Column) -> Column:
    """#rrggbb of a colour index: nine base colours, 24 hues in ten bands, six greys; null outside 1..255.

    A channel of a hue is 1 within a sixth of the circle of its own, falls to
    0 over the next sixth on either side, and is scaled by saturation and value.
    """
    step = index - 10
    band = F.floor(step / 24)
    sat, val = F.when(band < 5, F.lit(1.0)).otherwise(F.lit(0.7)), F.greatest(F.lit(0.28), 1 - band * 0.08)

    def channel(at: int) -> Column:
        k = F.pmod(F.lit(float(at)) + F.pmod(step, F.lit(24)) / 4, F.lit(6.0))
        return F.bround((val - val * sat * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255, 0)

    grey = F.bround((index - 250) / 5 * 255, 0)
    out = F.when(index.between(10, 249), _hex(channel(5), channel(3), channel(1))).when(index.between(250, 255), _hex(grey, grey, grey))
    for i, rgb in BASE.items():
        out = out.when(index == i, F.lit("#%02x%02x%02x" % rgb))
    return out


def valid_index(index: Column) -> Column:
    return F.when(index.between(1, 255), index)


def flags(value: Column) -> list[Column]:
    """A column for each bit of a polyline's flags."""
    return [(value.bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(FLAGS)]


def light_closed(value: Column) -> Column:
    """A light polyline is closed by bit 0 or bit 9."""
    return value.bitwiseAND(0x201) != 0
