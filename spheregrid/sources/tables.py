"""Grids as tables: reading, writing, cataloguing, and cutting lineage."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = T.StructType(
    [
        T.StructField("faces", T.ArrayType(T.StringType())),
        T.StructField("n", T.IntegerType()),
        T.StructField("ctx_factor", T.IntegerType()),
        T.StructField("ctx_pad", T.IntegerType()),
        T.StructField("fine_pad", T.IntegerType()),
        T.StructField("holdout", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]))),
        T.StructField("layers", T.MapType(T.StringType(), T.StructType([T.StructField("dtype", T.StringType()), T.StructField("rows", T.LongType())]))),
    ]
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spheregrid-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that each session of this process has written intermediate tables to, in order.
_WRITTEN: dict[str, list[str]] = {}


def _of_session(spark: SparkSession) -> list[str]:
    return _WRITTEN.setdefault(spark._jsparkSession.sessionUUID(), [])


def scratch(spark: SparkSession) -> str:
    """A new path for an intermediate table in the shared folder."""
    paths = _of_session(spark)
    paths.append(f"{shared_folder(spark)}/spheregrid-{uuid.uuid4().hex}")
    return paths[-1]


def written(spark: SparkSession) -> int:
    """How many intermediate tables this session has: a mark for ``discard``."""
    return len(_of_session(spark))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes the intermediate tables of this session from the ``since``-th on: to be called when the results that came from them have been read or written."""
    paths = _of_session(spark)
    while len(paths) > since:
        remove(spark, paths.pop())


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so a loop's plans stay short and survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Face rasters as one table, a folder for each face; sorted, so row groups prune by ``i`` and ``j``."""
    cells.repartitionByRange("face", "i").sortWithinPartitions("face", "i", "j").write.mode(mode).partitionBy("face").parquet(path)


def read_cells(spark: SparkSession, path: str, face: int | None = None, layers: list[str] | None = None) -> DataFrame:
    """``(face, i, j, layers)``: face rasters, pruned to one face and some layers; a layer that isn't there raises."""
    cells = spark.read.parquet(path)
    missing = set(layers or ()) - set(cells.columns)
    if missing:
        raise ValueError(f"no layer {', '.join(sorted(missing))} in {path}")
    if face is not None:
        cells = cells.where(F.col("face") == face)
    return cells.select("face", "i", "j", *(layers if layers is not None else [c for c in cells.columns if c not in ("face", "i", "j")]))


def open_cube(spark: SparkSession, path: str, n: int, radius: float, texture: int = 1024) -> tuple[DataFrame, float, int | None]:
    """A cube's cells with ``height`` (without it this raises) and ``rgb`` if there, metres a pixel, and every how many pixels its texture takes."""
    named = spark.read.parquet(path).columns
    layers = ["height", *(["rgb"] if "rgb" in named else [])]
    return read_cells(spark, path, layers=layers), math.pi / 2 * radius / n, max(1, n // max(1, texture)) if "rgb" in named else None


def aligned(layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Tables ``(keys, value)`` on the same grid as one, a column for each name; a cell that one of them lacks raises."""
    out = None
    for name, df in layers.items():
        one = df.select(*keys, F.struct(F.col([c for c in df.columns if c not in keys][0]).alias("v")).alias(name))
        out = one if out is None else out.join(one, keys, "full")
    checked = lambda n: F.when(F.col(n).isNotNull(), F.col(n)["v"]).otherwise(F.raise_error(F.lit(f"{n} lacks a cell")))
    return out.select(*keys, *[checked(n).cast(dict(layers[n].dtypes)[[c for c in layers[n].columns if c not in keys][0]]).alias(n) for n in layers])


def overlaid(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Layers of both tables; of those with the same name the second table's."""
    own = [c for c in over.columns if c not in keys]
    return base.drop(*own).join(over, keys)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log of CSV files, each with its header."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def with_provenance(meta: DataFrame, run: dict[str, str]) -> DataFrame:
    """A catalogue with what a run was made with, added to what is noted already."""
    noted = F.create_map(*[F.lit(x) for kv in sorted(run.items()) for x in kv])
    if "run" in meta.columns:
        noted = F.map_concat(F.map_filter("run", lambda k, v: ~k.isin(*run)), noted)
    return meta.withColumn("run", noted)


def write_meta(cells: DataFrame, path: str, n: int, ctx_factor: int, ctx_pad: int, boxes: Sequence[tuple[float, float, float, float]] = (), fine_pad: int = 0) -> None:
    """The catalogue of a baked cube: faces, resolution, context window, what is held out, the fine layers' padding, and each layer's type and row count."""
    from spheregrid.functions.geometry import FACE_NAMES

    layers = [f for f in cells.schema.fields if f.name not in ("face", "i", "j")]
    counts = cells.agg(*[F.count(f.name).alias(f.name) for f in layers])
    entries = [x for f in layers for x in (F.lit(f.name), F.struct(F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f.name).alias("rows")))]
    held = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("lat_min", "lat_max", "lon_min", "lon_max"), b, strict=True)]) for b in boxes]).cast(META["holdout"].dataType)
    counts.select(F.array(*map(F.lit, FACE_NAMES)).alias("faces"), F.lit(n).alias("n"), F.lit(ctx_factor).alias("ctx_factor"), F.lit(ctx_pad).alias("ctx_pad"), F.lit(fine_pad).alias("fine_pad"), held.alias("holdout"), F.create_map(*entries).alias("layers")).coalesce(1).write.mode("overwrite").json(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue; reading it fails where the faces aren't in their fixed order."""
    from spheregrid.functions.geometry import FACE_NAMES

    meta = spark.read.schema(META).json(path)
    right = F.array(*map(F.lit, FACE_NAMES))
    return meta.withColumn("faces", F.when(F.col("faces") == right, F.col("faces")).otherwise(F.raise_error(F.lit("unexpected face order")).cast("array<string>")))


def layer_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """``(layer, columns, rows)`` of named tables."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), F.lit(len(df.columns)).cast("long").alias("columns"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def monthly_summary(months: DataFrame, keys: list[str], value: str, nodata: float | None = None, expected: int = 12) -> DataFrame:
    """Annual mean, range and total of each cell, and its validity.

    ``months`` holds ``keys``, ``month`` and ``value``.  A cell is valid if no
    month is nodata (or null, or not a number) and not all are zero; sentinels
    stay out of the sums.  With another number of months than expected the cell raises.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    if nodata is not None:
        v = F.when(F.col(value) != nodata, v)
    out = months.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("range"), F.sum(v).alias("total"), (F.count(v) == F.count("*")).alias("_full"), F.bool_and(v == 0).alias("_zero"), F.countDistinct("month").alias("_months"))
    if expected:
        out = out.withColumn("_full", F.when(F.col("_months") == expected, F.col("_full")).otherwise(F.raise_error(F.lit(f"a cell hasn't {expected} months")).cast("boolean")))
    return out.withColumn("valid", F.col("_full") & ~F.coalesce("_zero", F.lit(False))).drop("_full", "_zero", "_months")


def strided(grid: DataFrame, step: int, i: str = "i", j: str = "j") -> DataFrame:
    return grid.where((F.col(i) % step == 0) & (F.col(j) % step == 0))


def last_row(log: DataFrame, step: str = "step") -> DataFrame:
    """The row of a log with the largest step."""
    return log.agg(F.max_by(F.struct("*"), step).alias("_row")).select("_row.*")


def stretch(value: Column, low: Column | float, high: Column | float) -> Column:
    """Contrast stretch to 0..255."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    scaled = (value - low) / F.greatest(high - low, F.lit(1e-9))
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) * 255).cast("int")


def percentiles(df: DataFrame, value: str, shares: list[float], bins: int = 4096) -> list[float]:
    """Exact percentiles (linear between neighbours) of a column, nulls left out.

    Each pass counts the values of a rank's interval in equal bins and goes on
    with the bin that holds the rank, until the bin has one distinct value; only
    ``bins`` counts for each rank come to the driver, whatever the table's size.
    """
    v = F.col(value).cast("double")
    values = df.where(v.isNotNull()).select(v.alias("v"))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [math.nan] * len(shares)
    ranks = sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    state = {r: (low, high, 0) for r in ranks}
    while True:
        open_ = sorted({(a, b) for a, b, _ in state.values() if a < b})
        if not open_:
            break
        # Which interval of this pass a value is in, its bin there, and the bin's true ends.
        at = F.array(*[F.when((F.col("v") >= a) & (F.col("v") <= b), F.struct(F.lit(k).alias("k"), F.least(F.floor((F.col("v") - a) / (b - a) * bins), F.lit(bins - 1)).alias("b"))) for k, (a, b) in enumerate(open_)])
        rows = values.select("v", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "b").collect()
        for r, (a, b, before) in list(state.items()):
            if a == b:
                continue
            for row in rows:
                if row["k"] == open_.index((a, b)):
                    if before + row["n"] > r:
                        state[r] = (row["low"], row["high"], before)
                        break
                    before += row["n"]
    out = []
    for s in shares:
        a, b = math.floor(s * (n - 1)), math.ceil(s * (n - 1))
        out.append(state[a][0] + (state[b][0] - state[a][0]) * (s * (n - 1) - a))
    return out


def preview(df: DataFrame, layer: str) -> Column:
    """A layer as 0..255: heights between -8000 and 8000 m, others between their first and last percentile."""
    low, high = (-8000.0, 8000.0) if layer == "height" else percentiles(df, layer, [0.01, 0.99])
    return stretch(F.col(layer), low, high)
