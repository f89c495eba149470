"""The registry of public rasters, and files of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spheregrid.functions.geometry import dir_to_face, dir_to_latlon, dir_to_uv

SOURCE = "name string, filename string, bytes long, description string, license string"


def sources(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of sources; ``subdir`` is the first part of a name."""
    return spark.createDataFrame(rows, SOURCE).withColumn("subdir", F.split_part("name", F.lit("/"), F.lit(1)))


def raw_path(root: Column, subdir: Column, filename: Column) -> Column:
    return F.concat_ws("/", root, subdir, filename)


def month_of_2004(yyyymm: Column) -> Column:
    """The English month name of ``2004MM``; anything else raises."""
    month = F.date_format(F.to_date(F.concat(yyyymm, F.lit("01")), "yyyyMMdd"), "MMMM")
    return F.when(yyyymm.rlike("^2004(0[1-9]|1[0-2])$"), month).otherwise(F.raise_error(F.concat(F.lit("not a month of 2004: "), yyyymm)).cast("string"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, col, channel, value)`` of two- or three-dimensional arrays in .npy files.

    Little-endian float32 and float64, uint8 and bool in C order; others raise.
    """
    import io

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.dtype.str not in ("<f4", "<f8", "|u1", "|b1") or not array.flags.c_contiguous or array.ndim not in (2, 3):
                    raise ValueError(f"{name}: unsupported array {array.dtype} {array.shape}")
                cube = array.reshape(*array.shape[:2], -1)
                for k in range(0, len(cube), 256):
                    part = cube[k : k + 256]
                    r, c, ch = (np.broadcast_to(x, part.shape).ravel() for x in np.ogrid[tuple(map(slice, part.shape))])
                    yield pd.DataFrame({"path": name, "row": (r + k).astype(np.int32), "col": c.astype(np.int32), "channel": ch.astype(np.int32), "value": part.ravel().astype(np.float32)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, col int, channel int, value float")


def write_vectors(directions: DataFrame, path: str) -> None:
    """Unit directions ``(x, y, z)`` with their face, place on it, latitude and longitude, as JSON lines for tests elsewhere."""
    d = [F.col(c) for c in "xyz"]
    at = directions.withColumn("face", dir_to_face(d))
    u, v = dir_to_uv(d, F.col("face"))
    lat, lon = dir_to_latlon(d)
    at.select(F.array(*d).alias("dir"), "face", u.alias("u"), v.alias("v"), lat.alias("lat"), lon.alias("lon")).write.json(path)
