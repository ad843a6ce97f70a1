"""Sparse vectors as text and binary, arrays of up to four dimensions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.functions import vectors as vec
from tessella.session import ship


def read_sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """(class, features map<int,double>) of lines 'class index:value ..'; indices count from 0, classes from 1."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    cls = F.regexp_extract("value", r"^\s*(-?\d+)", 1).cast("int")
    good = F.assert_true(cls >= 1, F.concat(F.lit("not a class: "), F.col("value")))
    return lines.select(cls.alias("class"), vec.parse_sparse(F.col("value")).alias("features"), good.alias("checked")).where(F.col("checked").isNull()).drop("checked")


def sizes(examples: DataFrame) -> DataFrame:
    """(features, classes): what the data imply, the largest index and one, and the largest class."""
    return examples.agg((F.max(F.array_max(F.map_keys("features"))) + 1).alias("features"), F.max("class").alias("classes"))


def write_sparse_text(examples: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("class").cast("string"), vec.format_sparse(F.col("features")))
    examples.select(line.alias("value")).write.mode("overwrite").text(path)


_ELEMENT = np.dtype([("i", "<i4"), ("pad", "<i4"), ("v", "<f8")])


def decode_sparse(raw: bytes) -> Iterator[tuple[int, dict[int, float]]]:
    """(class, vector) after vector of a binary file: int32 class, int32 kind, then the dense or the sparse form."""
    at = 0
    while at < len(raw):
        cls, is_dense = struct.unpack_from("<ii", raw, at)
        at += 8
        if is_dense:
            (top,) = struct.unpack_from("<i", raw, at)
            values = np.frombuffer(raw, "<f8", top + 1, at + 4)
            at += 4 + 8 * (top + 1)
            yield cls, {int(i): float(values[i]) for i in np.flatnonzero(values)}
        else:
            n, _ = struct.unpack_from("<ii", raw, at)
            items = np.frombuffer(raw, _ELEMENT, n, at + 8)
            at += 8 + _ELEMENT.itemsize * n
            yield cls, dict(zip(items["i"].tolist(), items["v"].tolist()))


def encode_sparse(examples: list[tuple[int, dict[int, float]]]) -> bytes:
    out = []
    for cls, vector in examples:
        items = np.array([(i, 0, v) for i, v in sorted(vector.items())], _ELEMENT)
        out.append(struct.pack("<iiii", cls, 0, len(items), max(vector, default=-1)) + items.tobytes())
    return b"".join(out)


def _decoded(files: DataFrame, decode, schema: str, build) -> DataFrame:
    """Rows of binary files, decoded where Spark has read them: any store that Spark reads will do."""

    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [build(path, r) for r in decode(content)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow(schema))

    return files.select("path", "content").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "map<int,double>": pa.map_(pa.int32(), pa.float64())}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")])


def read_sparse_binary(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return _decoded(files, decode_sparse, "path string, class int, features map<int,double>", lambda p, r: {"path": p, "class": r[0], "features": list(r[1].items())})


_TYPES = {1: "<i1", 2: "<i2", 4: "<f4", 8: "<f8"}


def encode_arrays(arrays: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """name -> (type name, array) as one file: the number of arrays, then name, type name, dimensions, item size and values of each."""
    out = [struct.pack("<i", len(arrays))]
    for name, (kind, a) in arrays.items():
        a = np.ascontiguousarray(a)
        for word in (name.encode(), kind.encode()):
            out.append(struct.pack("<i", len(word)) + word)
        out.append(struct.pack(f"<i{a.ndim}ii", a.ndim, *a.shape, a.itemsize) + a.tobytes())
    return b"".join(out)


def decode_arrays(raw: bytes) -> Iterator[tuple[str, str, np.ndarray]]:
    (count,) = struct.unpack_from("<i", raw, 0)
    at = 4
    for _ in range(count):
        words = []
        for _ in range(2):
            (n,) = struct.unpack_from("<i", raw, at)
            words.append(raw[at + 4 : at + 4 + n].decode())
            at += 4 + n
        (dims,) = struct.unpack_from("<i", raw, at)
        if not 1 <= dims <= 4:
            raise ValueError("an array has one to four dimensions")
        *shape, size = struct.unpack_from(f"<{dims + 1}i", raw, at + 4)
        at += 4 * (dims + 2)
        kind = np.dtype("<i4") if size == 4 and words[1].startswith("int") else np.dtype(_TYPES[size])
        a = np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape)
        at += a.nbytes
        yield words[0], words[1], a


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, type, dims, i, j, k, l, value): every cell of every array of the files."""

    def cells(raw: bytes) -> Iterator[dict]:
        for name, kind, a in decode_arrays(raw):
            for place, value in np.ndenumerate(a):
                yield dict(zip("ijkl", [*place, 0, 0, 0][:4]), name=name, type=kind, dims=a.ndim, value=float(value))

    files = spark.read.format("binaryFile").load(path)
    return _decoded(files, cells, "path string, name string, type string, dims int, i int, j int, k int, l int, value double", lambda p, r: {"path": p, **r})


class SparseFiles(DataSource):
    """``spark.read.format("sparse_binary").load(folder)``: files of class and vector, one partition a file, on a shared file system."""

    @classmethod
    def name(cls) -> str:
        return "sparse_binary"

    def schema(self) -> str:
        return "path string, class int, features map<int,double>"

    def reader(self, schema) -> DataSourceReader:
        return _SparseReader(self.options["path"], self.options.get("suffix", ".bin"))


class _SparseReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path.removeprefix("file://"), suffix

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        place = Path(self.path)
        files = sorted(str(p) for p in place.rglob(f"*{self.suffix}")) if place.is_dir() else [str(place)]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as file:
            for cls, vector in decode_sparse(file.read()):
                yield partition.value, cls, vector
