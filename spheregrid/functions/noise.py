"""Deterministic noise keyed by position, seed or cell: 64-bit wrapping hashes as Column expressions, gradient noise in Arrow batches.

ANSI arithmetic raises on overflow, so products modulo 2^64 are put together
from halves and quarters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Odd multipliers of the position hash (x, y, z, seed, and its last mixing step).
KEY_X, KEY_Y, KEY_Z, KEY_SEED = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x2545F4914F6CDD1D
LAST = 0x7FB5D329728EA185
# The multipliers of the cell hash.
CELL_A, CELL_B, CELL_MIX = 73856093, 19349663, 1274126177
OFFSET = 1 << 20
_LOW = (1 << 32) - 1


Points = tuple[np.ndarray, np.ndarray, np.ndarray]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f reads it."""
    return F.transform(F.array(x), f)[0]


def _halves(x: Column) -> tuple[Column, Column]:
    """The low and high 32 bits of a BIGINT column."""
    return x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)


def _product(low: Column, high: Column, factor: int) -> Column:
    """(high, low) * factor modulo 2^64: products of 32 by 16 bits, which never overflow."""
    k = [(factor >> (16 * n)) & 0xFFFF for n in range(4)]
    a, b = low * F.lit(k[0]), low * F.lit(k[1])
    t = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    top = F.shiftrightunsigned(t, 32) + F.shiftrightunsigned(b, 16)
    for part, n in ((low, 2), (high, 0)):
        top = top + part * F.lit(k[n]) + F.shiftleft((part * F.lit(k[n + 1])).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftleft(top, 32).bitwiseOR(t.bitwiseAND(F.lit(_LOW)))


def times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^64 of a BIGINT column."""
    return bound(x, lambda v: _product(*_halves(v), factor))


def _finish(x: Column) -> Column:
    return bound(x, lambda v: bound(times(v.bitwiseXOR(F.shiftrightunsigned(v, 31)), LAST), lambda w: w.bitwiseXOR(F.shiftrightunsigned(w, 27))))


def position_bits(face: Column, i: Column, j: Column, seed: int = 0) -> Column:
    """53 random bits of a face pixel (BIGINT)."""
    i, j = (c.cast("long") + OFFSET for c in (i, j))
    x = times(i, KEY_X).bitwiseXOR(times(j, KEY_Y)).bitwiseXOR(times(face.cast("long") + 1, KEY_Z)).bitwiseXOR(F.lit(_signed(seed * KEY_SEED)))
    return F.shiftrightunsigned(_finish(x), 11)


def position_noise(face: Column, i: Column, j: Column, seed: int = 0) -> Column:
    """White noise in [-1, 1) of a face pixel, the same in whatever window it is read."""
    return position_bits(face, i, j, seed) / F.lit(float(1 << 53)) * 2 - 1


def hash01(a: Column, b: Column) -> Column:
    """[0, 1) of two integers, by signed wrapping products and arithmetic shifts; 24 bits."""
    x = times(a.cast("long"), CELL_A).bitwiseXOR(times(b.cast("long"), CELL_B))
    x = times(bound(x, lambda v: v.bitwiseXOR(F.shiftright(v, 13))), CELL_MIX)
    x = bound(x, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))
    return x.bitwiseAND(F.lit((1 << 24) - 1)) / F.lit(float(1 << 24))


def smooth(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def value_noise(df: DataFrame, p: tuple[Column, Column, Column], seed: int, name: str) -> DataFrame:
    """``df`` with smooth noise in ``name``: the eight lattice corners around ``p``, weighted.

    Every step is a column of its own, so nothing is worked out twice and all
    of it stays in generated code: two products for each axis (base and base +
    1) and one for each corner.
    """
    axes = tuple(zip("xyz", p, (KEY_X, KEY_Y, KEY_Z), strict=True))
    df = df.withColumns({f"_p{n}": c.cast("double") for n, c, _ in axes})
    df = df.withColumns({f"_b{n}": F.floor(f"_p{n}") for n, _, _ in axes})
    df = df.withColumns({f"_w{n}": smooth(F.col(f"_p{n}") - F.col(f"_b{n}")) for n, _, _ in axes})
    df = df.withColumns({f"_h{n}{d}": _product(*_halves(F.col(f"_b{n}") + d), k) for n, _, k in axes for d in (0, 1)})
    corners = [[(c >> k) & 1 for k in range(3)] for c in range(8)]
    mixed = {f"_m{c}": F.col(f"_hx{x}").bitwiseXOR(F.col(f"_hy{y}")).bitwiseXOR(F.col(f"_hz{z}")).bitwiseXOR(F.lit(_signed(seed * KEY_SEED))) for c, (x, y, z) in enumerate(corners)}
    df = df.withColumns(mixed)
    df = df.withColumns({m: F.col(m).bitwiseXOR(F.shiftrightunsigned(m, 31)) for m in mixed})
    df = df.withColumns({m: _product(*_halves(F.col(m)), LAST) for m in mixed})
    total = F.lit(0.0)
    for m, bits in zip(mixed, corners, strict=True):
        weight = F.lit(1.0)
        for n, bit in zip("xyz", bits, strict=True):
            weight = weight * (F.col(f"_w{n}") if bit else 1 - F.col(f"_w{n}"))
        value = F.shiftrightunsigned(F.col(m).bitwiseXOR(F.shiftrightunsigned(m, 27)), 11) / F.lit(float(1 << 53)) * 2 - 1
        total = total + weight * value
    return df.withColumn(name, total).drop(*mixed, *[f"_{a}{n}" for a in "pbw" for n in "xyz"], *[f"_h{n}{d}" for n in "xyz" for d in (0, 1)])


def lattice_noise(p: Points, seed: int) -> np.ndarray:
    """``value_noise`` at many points at once; products of unsigned 64-bit numbers wrap by themselves."""
    base = [np.floor(v) for v in p]
    weight = [t * t * (3 - 2 * t) for t in (v - f for v, f in zip(p, base, strict=True))]
    keys = [[(f.astype(np.int64) + d).astype(np.uint64) * np.uint64(k) for d in (0, 1)] for f, k in zip(base, (KEY_X, KEY_Y, KEY_Z), strict=True)]
    total, own = np.zeros_like(p[0], dtype=float), np.uint64(seed * KEY_SEED % (1 << 64))
    for corner in range(8):
        bits = [corner >> k & 1 for k in range(3)]
        x = keys[0][bits[0]] ^ keys[1][bits[1]] ^ keys[2][bits[2]] ^ own
        x = (x ^ (x >> np.uint64(31))) * np.uint64(LAST)
        value = ((x ^ (x >> np.uint64(27))) >> np.uint64(11)).astype(float) / (1 << 53) * 2 - 1
        share = 1.0
        for w, bit in zip(weight, bits, strict=True):
            share = share * (w if bit else 1 - w)
        total += share * value
    return total


def detail_height(df: DataFrame, p: tuple[Column, Column, Column], radius: float, coarse: float, fine: Column | float, roughness: float, seed: int, name: str = "detail", octaves: int = 16) -> DataFrame:
    """``df`` with octaves of value noise in ``name``, from wavelength ``coarse`` and halved while above ``fine`` (``octaves`` at most)."""
    least = fine if isinstance(fine, Column) else F.lit(float(fine))

    def fields(q: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        *place, floor = q
        total, wave = np.zeros_like(floor), coarse
        for octave in range(octaves):
            going = floor < wave
            if not going.any():
                break
            total[going] += wave * roughness * lattice_noise(tuple(v[going] * (radius / wave) for v in place), seed + octave)
            wave /= 2
        return [total]

    df = df.withColumns({f"_d{k}": c.cast("double") for k, c in enumerate((*p, least))})
    return with_noise(df, tuple(f"_d{k}" for k in range(4)), [name], fields).drop(*[f"_d{k}" for k in range(4)])


def surface_height(base: Column, detail: Column) -> Column:
    """Baked height with detail that fades in over the first 20 m; land stays above 0.5, ocean has none."""
    fade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base / 20.0))
    return F.when(base > 0, F.greatest(F.lit(0.5), base + detail * fade)).otherwise(F.lit(0.0))


# The twelve edge gradients of improved gradient noise.
GRADIENTS = ((1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1))


class Perlin:
    """Seeded gradient noise over a permutation of 256, at many points at once.

    Arrays in an Arrow batch: a chain of a dozen octaves as columns outgrows
    the generated code of a stage, and as nested functions of arrays it is
    interpreted row by row.
    """

    def __init__(self, seed: int):
        order = np.random.default_rng(seed).permutation(256)
        self.table = np.concatenate([order, order]).astype(np.int64)
        self.slopes = np.array([[g[k] for g in GRADIENTS] for k in range(3)], float)[:, self.table % len(GRADIENTS)]

    def __call__(self, p: Points) -> np.ndarray:
        floors = [np.floor(v) for v in p]
        inside = [v - f for v, f in zip(p, floors, strict=True)]
        cell = [f.astype(np.int64) & 255 for f in floors]
        # Weights of the lower and the upper corner along each axis.
        upper = [t * t * t * (t * (t * 6 - 15) + 10) for t in inside]
        weight = [(1 - w, w) for w in upper]
        total = np.zeros_like(p[0], dtype=float)
        for a in (0, 1):
            row = self.table[cell[0] + a] + cell[1]
            for b in (0, 1):
                column, both = self.table[row + b] + cell[2], weight[0][a] * weight[1][b]
                for c in (0, 1):
                    slope = self.slopes[:, column + c]
                    total += both * weight[2][c] * (slope[0] * (inside[0] - a) + slope[1] * (inside[1] - b) + slope[2] * (inside[2] - c))
        return total


def scaled(p: Points, by: float, shift: float = 0.0) -> Points:
    return tuple(v * by + shift for v in p)


def fbm(noise: Perlin, p: Points, frequency: float, octaves: int, lacunarity: float = 2.0, gain: float = 0.5) -> np.ndarray:
    """Octave sum, divided by the sum of its amplitudes."""
    amplitudes = gain ** np.arange(octaves)
    return sum(a * noise(scaled(p, frequency * lacunarity**o)) for o, a in enumerate(amplitudes)) / amplitudes.sum()


def ridged(noise: Perlin, p: Points, frequency: float, octaves: int, lacunarity: float = 2.0, gain: float = 0.5) -> np.ndarray:
    """Ridges where the noise crosses zero; each octave is weighted by the one before."""
    amplitudes = gain ** np.arange(octaves)
    total, ridge = 0.0, None
    for o, a in enumerate(amplitudes):
        before = 1.0 if ridge is None else np.clip(2 * ridge, 0, 1)
        ridge = (1 - np.abs(noise(scaled(p, frequency * lacunarity**o)))) ** 2 * before
        total = total + a * ridge
    return total / amplitudes.sum()


def domain_warp(noise: Perlin, p: Points, frequency: float, strength: float, offset: float = 17.3) -> Points:
    """Points moved by three noise samples taken ``offset`` apart."""
    return tuple(v + strength * noise(scaled(p, frequency, k * offset)) for k, v in enumerate(p))


def with_noise(df: DataFrame, p: tuple[str, ...], names: list[str], fields: Callable[[tuple[np.ndarray, ...]], list[np.ndarray]]) -> DataFrame:
    """``df`` with the double columns ``names``, which ``fields`` makes of the columns ``p`` a batch at a time; a null among them gives nulls."""

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def made(*values: pd.Series) -> pd.DataFrame:
        there = np.logical_and.reduce([v.notna().to_numpy() for v in values])
        found = fields(tuple(v.to_numpy(float)[there] for v in values))
        out = np.full((len(there), len(names)), np.nan)
        out[there] = np.column_stack(found)
        return pd.DataFrame({n: pd.Series(np.where(there, column, None), dtype=object) for n, column in zip(names, out.T, strict=True)} if not there.all() else dict(zip(names, out.T, strict=True)))

    return df.withColumn("_made", made(*p)).select("*", "_made.*").drop("_made")
