"""Normalised layers, feature vectors, and the eight symmetries of a patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spheregrid.operators.windows import slope

# What each layer is divided by (those in LOG after log1p of its positive part).
SCALE = {"height": 4000.0, "slope": 6.0, "flowacc": 6.0, "dist_up": 8.0, "dist_down": 8.0, "dist_left": 8.0, "dist_right": 8.0, "lat": 90.0, "tavg": 30.0, "trange": 40.0, "prec": 9.0}
LOG = {"slope", "prec"}
#: Layers that are taken as they are.
PLAIN = {"ocean", "water", "noise"}
# Channel orders of the conditioning and of the context vector.
COND = ("height", "slope", "ocean", "water", "flowacc", "dist_up", "dist_down", "dist_left", "dist_right", "lat", "tavg", "trange", "prec", "noise")
CTX = ("height", "water", "flowacc", "dist_up", "dist_down", "dist_left", "dist_right", "tavg", "trange", "prec", "lat")
# Fixed values, from geometry: where each directional layer's content goes when a patch turns a quarter counter-clockwise.
TURN = {"dist_up": "dist_left", "dist_left": "dist_down", "dist_down": "dist_right", "dist_right": "dist_up"}
FLIP = {"dist_left": "dist_right", "dist_right": "dist_left"}


def norm(name: str, x: Column) -> Column:
    """A layer in the units of the model; a name that isn't known raises."""
    if name not in SCALE and name not in PLAIN:
        raise KeyError(name)
    value = F.log1p(F.greatest(x, F.lit(0.0))) if name in LOG else x.cast("double")
    return value / SCALE.get(name, 1.0)


def vector(names: tuple[str, ...]) -> Column:
    """The named layers, normalised, as one array."""
    return F.array(*[norm(n, F.col(n)) for n in names])


def conditioning(cells: DataFrame, px_km: float, trained_px_km: float, sea: float = 0.0, coarse: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``cells(keys, i, j, layers)`` with ``cond``.

    Heights count from ``sea``, ocean is what lies below it, and the slope of
    the heights is rescaled to the resolution of training.  With ``coarse``
    (joint mode) the height and what derives from it come from that table.
    """
    if coarse is not None:
        given = [c for c in coarse.columns if c not in (*keys, "i", "j")]
        cells = cells.drop(*given).join(coarse, [*keys, "i", "j"])
    level = cells.withColumn("height", F.col("height") - sea)
    ready = slope(level, "height", trained_px_km / px_km, "slope", keys).withColumn("ocean", (F.col("height") < 0).cast("double"))
    return ready.withColumn("cond", vector(COND))


#: What joint mode takes from the context.
JOINT = ("height", "water", "flowacc", "dist_up", "dist_down", "dist_left", "dist_right")


def joint_conditioning(cells: DataFrame, context: DataFrame, size: int, pad: int, factor: int, px_km: float, trained_px_km: float, sea: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``conditioning`` in joint mode: heights, water, flow and distances are what the middle of each patch's context ``(keys, i, j, layers)`` tells at coarse scale.

    Patches are ``size`` cells a side and their context reaches ``pad`` of them beyond; heights keep their means, the others are bilinear.
    """
    from spheregrid.operators.resample import coarse_layers

    plain = context.select(*keys, "i", "j", *[F.col(c).cast("double").alias(c) for c in JOINT])
    return conditioning(cells, px_km, trained_px_km, sea, coarse_layers(plain, list(JOINT), size, pad, factor, list(keys)), keys)


def stacked(colour: Column, height: Column) -> Column:
    """The channels of a patch's cell as one array: its colour, then its height in the model's units."""
    return F.concat(colour.cast("array<double>"), F.array(norm("height", height)))


def unit_rgb(x: Column) -> Column:
    return x.cast("float") / 255


def augment(patches: DataFrame, n: int, quarter_turns: int, flip: bool, i: str = "i", j: str = "j") -> DataFrame:
    """Cells turned counter-clockwise, then mirrored left to right; directional layers, of the context too, change names with them."""

    def moved(df: DataFrame, new_i: Column, new_j: Column, names: dict[str, str]) -> DataFrame:
        names = names | {f"ctx_{a}": f"ctx_{b}" for a, b in names.items()}
        others = [F.col(c).alias(names.get(c, c)) for c in df.columns if c not in (i, j)]
        return df.select(new_i.cast("int").alias(i), new_j.cast("int").alias(j), *others)

    for _ in range(quarter_turns % 4):
        patches = moved(patches, F.lit(n - 1) - F.col(j), F.col(i), TURN)
    if flip:
        patches = moved(patches, F.col(i), F.lit(n - 1) - F.col(j), FLIP)
    return patches


def l1(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def hinge_critic(real: Column, fake: Column) -> Column:
    return F.avg(F.greatest(F.lit(0.0), 1 - real)) + F.avg(F.greatest(F.lit(0.0), 1 + fake))


def hinge_generator(fake: Column) -> Column:
    return -F.avg(fake)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
