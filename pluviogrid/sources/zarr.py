"""Zarr stores (version 2, uncompressed or zlib chunks): a Spark data source, a writer and a probe.

    register(spark)
    spark.read.format("zarr").option("path", "/data/cube.zarr").option("variable", "RAIN").load()

One partition reads one chunk; a filter on a dimension's index prunes chunks before any is read.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def metadata(path: str, variable: str) -> tuple[dict, dict]:
    """The array's and its attributes' metadata, from the consolidated file if there is one."""
    joined = os.path.join(path, ".zmetadata")
    if os.path.exists(joined):
        with open(joined) as f:
            m = json.load(f)["metadata"]
        return m[f"{variable}/.zarray"], m.get(f"{variable}/.zattrs", {})
    with open(os.path.join(path, variable, ".zarray")) as f:
        array = json.load(f)
    attrs = os.path.join(path, variable, ".zattrs")
    return array, json.load(open(attrs)) if os.path.exists(attrs) else {}


def is_consolidated(path: str) -> bool:
    return os.path.exists(os.path.join(path, ".zmetadata"))


class Chunk(InputPartition):
    def __init__(self, index: tuple[int, ...]):
        self.index = index


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options["variable"]
        self.array, attrs = metadata(self.path, self.variable)
        self.dims = attrs.get("_ARRAY_DIMENSIONS") or [f"d{i}" for i in range(len(self.array["shape"]))]
        self.limits = {d: [0, n - 1] for d, n in zip(self.dims, self.array["shape"])}
        if self.array.get("filters") or (self.array.get("compressor") or {"id": "zlib"})["id"] != "zlib":
            raise ValueError("only uncompressed and zlib chunks can be read")

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.limits and isinstance(getattr(f, "value", None), int):
                lim = self.limits[name]
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    lim[0] = max(lim[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                    lim[1] = min(lim[1], f.value - isinstance(f, LessThan))
            yield f  # Spark checks the rows again

    def partitions(self):
        ranges = [range(max(0, self.limits[d][0]) // c, min(n - 1, self.limits[d][1]) // c + 1 if self.limits[d][0] <= self.limits[d][1] else 0) for d, n, c in zip(self.dims, self.array["shape"], self.array["chunks"])]
        return [Chunk(i) for i in itertools.product(*ranges)]

    def read(self, partition: Chunk):
        shape, chunks, kind = self.array["shape"], self.array["chunks"], np.dtype(self.array["dtype"])
        name = os.path.join(self.path, self.variable, self.array.get("dimension_separator", ".").join(map(str, partition.index)))
        fill = self.array.get("fill_value")
        if os.path.exists(name):
            with open(name, "rb") as f:
                raw = f.read()
            data = np.frombuffer(zlib.decompress(raw) if self.array.get("compressor") else raw, kind).reshape(chunks, order=self.array.get("order", "C"))
        else:
            data = np.full(chunks, np.nan if fill in (None, "NaN") else fill, float)
        start = [i * c for i, c in zip(partition.index, chunks)]
        data = data[tuple(slice(0, min(c, n - s)) for c, n, s in zip(chunks, shape, start))].astype(np.float64)
        where = np.indices(data.shape).reshape(data.ndim, -1)
        value = data.ravel()
        missing = np.isnan(value)
        if isinstance(fill, (int, float)) and fill:  # a fill of 0 is a value
            missing |= value == float(np.asarray(fill, kind))
        cols = [pa.array(w + s, pa.int32()) for w, s in zip(where, start)] + [pa.array(value, pa.float64(), mask=missing)]
        yield pa.RecordBatch.from_arrays(cols, names=[*self.dims, "value"])


class ZarrSource(DataSource):
    """Options: path, variable. Columns: the index along each dimension (int), and value (double, NULL for fills)."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> str:
        _, attrs = metadata(self.options["path"], self.options["variable"])
        array, _ = metadata(self.options["path"], self.options["variable"])
        dims = attrs.get("_ARRAY_DIMENSIONS") or [f"d{i}" for i in range(len(array["shape"]))]
        return ", ".join(f"{d} int" for d in dims) + ", value double"

    def reader(self, schema) -> DataSourceReader:
        return ZarrReader(self.options)


def register(spark) -> None:
    """Makes the format known to a session, and lets it push filters to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrSource)


def write_zarr(df: DataFrame, path: str, variable: str, dims: list[str], shape: list[int], chunks: list[int], fill: float = 1e20, consolidated: bool = True) -> None:
    """Chunks of a long table (index columns and value) as uncompressed float32: one group of rows is one chunk file, so retries write the same bytes.

    The folder must be one that all executors write to.
    """
    from pyspark.sql import functions as F

    os.makedirs(os.path.join(path, variable), exist_ok=True)
    array = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": "<f4", "compressor": None, "fill_value": fill, "order": "C", "filters": None}
    attrs = {"_ARRAY_DIMENSIONS": dims}
    files = {".zgroup": {"zarr_format": 2}, f"{variable}/.zarray": array, f"{variable}/.zattrs": attrs}
    for name, content in files.items():
        with open(os.path.join(path, name), "w") as f:
            json.dump(content, f)
    if consolidated:
        with open(os.path.join(path, ".zmetadata"), "w") as f:
            json.dump({"zarr_consolidated_format": 1, "metadata": files}, f)

    def put(pdf):
        import pandas as pd

        data = np.full(chunks, fill, np.float32)
        where = tuple(pdf[d].to_numpy() % c for d, c in zip(dims, chunks))
        data[where] = pdf["value"].fillna(fill).to_numpy(np.float32)
        name = ".".join(str(int(pdf[d].iloc[0]) // c) for d, c in zip(dims, chunks))
        temporary = os.path.join(path, variable, f".{name}.{os.getpid()}")
        with open(temporary, "wb") as f:
            f.write(data.tobytes())
        os.replace(temporary, os.path.join(path, variable, name))
        return pd.DataFrame({"chunk": [name], "n": [len(pdf)]})

    keys = [F.floor(F.col(d) / c) for d, c in zip(dims, chunks)]
    df.select(*dims, "value").groupBy(*keys).applyInPandas(put, "chunk string, n long").agg(F.sum("n")).collect()
