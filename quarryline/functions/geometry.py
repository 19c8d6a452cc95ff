"""Bounds of drawn shapes, as columns. Coordinates run to the right and down."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: degrees up to which a wire counts as straight.
STRAIGHT = 0.001
#: What of a text stands at its point, across and down, by its alignment.
ALIGNMENTS = {"bottom-left": (-1, 1), "bottom-center": (0, 1), "bottom-right": (1, 1), "center-left": (-1, 0), "center": (0, 0), "center-right": (1, 0),
              "top-left": (-1, -1), "top-center": (0, -1), "top-right": (1, -1)}
#: Fixed values, in units of a text's size: distance of lines, room above and below the outer line by its place.
PITCH, OVER, UNDER, HALF = 1.25, 1.3, 0.1, 0.7


def _box(xs: list[Column], ys: list[Column]) -> Column:
    """x1, y1, x2, y2 around points; null ones don't count."""
    return F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))


def arc_bounds(x1: Column, y1: Column, x2: Column, y2: Column, curve: Column, mirrored: Column) -> Column:
    """The box around a wire that turns by curve degrees on its way (to the other side if mirrored), width left out.

    An arc reaches beyond its ends where the direction from its centre passes a multiple of a right angle, so the
    four points of the circle in these directions count if the way from the first end to them is within the arc's
    angle. Null for what is no arc: a curve that is not finite or a full turn or more, or equal ends."""
    turn = F.radians(curve) * F.when(mirrored, 1.0).otherwise(-1.0)
    slope = 2 * F.tan(turn / 2)
    cx, cy = (x1 + x2) / 2 - (y2 - y1) / slope, (y1 + y2) / 2 + (x2 - x1) / slope
    radius = F.hypot(x2 - x1, y2 - y1) / (2 * F.abs(F.sin(turn / 2)))
    first = F.atan2(y1 - cy, x1 - cx)
    xs, ys = [x1, x2], [y1, y2]
    for k in range(4):
        at = k * math.pi / 2
        way = F.pmod(F.when(turn > 0, F.lit(at) - first).otherwise(first - F.lit(at)), F.lit(math.tau))
        within = way <= F.abs(turn) + 1e-12
        xs.append(F.when(within, cx + radius * math.cos(at)))
        ys.append(F.when(within, cy + radius * math.sin(at)))
    finite = ~F.isnan(curve) & (F.abs(curve) < F.lit(float("inf")))
    arc = (F.abs(curve) < 360) & ((x1 != x2) | (y1 != y2))
    return F.when(finite & (F.abs(curve) <= STRAIGHT), _box([x1, x2], [y1, y2])).when(finite & arc, _box(xs, ys))


def text_bounds(text: Column, x: Column, y: Column, size: Column, angle: Column, mirrored: Column, align: Column) -> Column:
    """A box that is sure to hold a text of lines set at (x, y), each character a square of size, turned by angle degrees
    against the clock. Mirrored texts stay readable, so only the side flips on which they stand; so do texts that would
    be upside down (over 90 and up to 270 degrees), which are turned half around. Null for an unknown alignment; an empty
    text has no extent across."""
    lines = F.split(F.regexp_replace(text, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    known = lambda i: F.coalesce(*(F.when(align == name, F.lit(side[i])) for name, side in ALIGNMENTS.items()))
    turned = F.pmod(angle.cast("double"), F.lit(360.0))
    # An expression that is used twice is worked out twice, so each step is the element of an array that the next one is a function of.
    step = lambda values, f: F.element_at(F.transform(F.array(values), f), 1)

    def placed(v):
        flip = F.when((v.turned > 90) & (v.turned <= 270), -1).otherwise(1)
        return F.struct(F.when(flip < 0, F.pmod(v.turned + 180, F.lit(360.0))).otherwise(v.turned).alias("turned"), (v.across * F.when(v.mirrored, -1).otherwise(1) * flip).alias("across"),
                        (v.down * flip).alias("down"), v.wide.alias("wide"), v.span.alias("span"), v["size"].alias("size"), v.x.alias("x"), v.y.alias("y"))

    def spread(v):
        left = F.when(v.across > 0, -v.wide).when(v.across == 0, -v.wide / 2).otherwise(0.0)
        top = F.when(v.down > 0, -v.span - v["size"] * OVER).when(v.down == 0, -v.span / 2 - v["size"] * HALF).otherwise(-v["size"] * UNDER)
        bottom = F.when(v.down > 0, v["size"] * UNDER).when(v.down == 0, v.span / 2 + v["size"] * HALF).otherwise(v.span + v["size"] * OVER)
        return F.struct(left.alias("left"), (left + v.wide).alias("right"), top.alias("top"), bottom.alias("bottom"), F.sin(F.radians(-v.turned)).alias("sin"), F.cos(F.radians(-v.turned)).alias("cos"),
                        v.x.alias("x"), v.y.alias("y"))

    def around(v):
        corners = [(a, b) for a in (v.left, v.right) for b in (v.top, v.bottom)]
        return _box([v.x + a * v.cos - b * v.sin for a, b in corners], [v.y + a * v.sin + b * v.cos for a, b in corners])

    told = step(lines, lambda own: F.struct(
        turned.alias("turned"), known(0).alias("across"), known(1).alias("down"), mirrored.alias("mirrored"), (F.array_max(F.transform(own, F.length)) * size).alias("wide"),
        ((F.size(own) - 1) * size * PITCH).alias("span"), size.cast("double").alias("size"), x.cast("double").alias("x"), y.cast("double").alias("y")))
    box = step(step(step(told, placed), spread), around)
    return F.when(align.isin(*ALIGNMENTS), box)
