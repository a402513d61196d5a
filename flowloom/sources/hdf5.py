"""HDF5 files as a Python data source (SRC-04 to SRC-07), where the library h5py is installed.

    spark.dataSource.register(Hdf5Events)
    spark.read.format("hdf5_events").load("/data/run.h5")

Scalar features of the group `events` become double columns beside event_idx; a file is read in ranges of rows, one task
each. Files lie where every executor sees them under the same path.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 files needs the library h5py") from e
    return h5py


class Hdf5Events(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5_events"

    def schema(self) -> StructType:
        with _h5py().File(self.options["path"], "r") as h:
            names = sorted(k for k, v in h["events"].items() if hasattr(v, "ndim") and v.ndim == 1)
        return StructType([StructField("event_idx", LongType())] + [StructField(n, DoubleType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names, int(self.options.get("rows", 1_000_000)))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], rows: int):
        self.path, self.names, self.rows = path, names, rows

    def partitions(self) -> list[_Range]:
        with _h5py().File(self.path, "r") as h:
            n = max((len(h["events"][c]) for c in self.names[1:]), default=0)
        return [_Range(lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)] or [_Range(0, 0)]

    def read(self, part: _Range):
        import numpy as np
        import pyarrow as pa

        with _h5py().File(self.path, "r") as h:
            columns = [pa.array(np.arange(part.lo, part.hi))] + [pa.array(np.asarray(h["events"][c][part.lo : part.hi], float)) for c in self.names[1:]]
        yield pa.RecordBatch.from_arrays(columns, self.names)


def metadata_of(path: str) -> dict[str, dict]:
    """Attributes named "section:key" as nested metadata."""
    out: dict[str, dict] = {}
    with _h5py().File(path, "r") as h:
        for k, v in h.attrs.items():
            if ":" in k:
                section, key = k.split(":", 1)
                out.setdefault(section, {})[key] = v.decode() if isinstance(v, bytes) else v
    return out
