"""Array files as tables of voxels, read in slabs by byte range; and files written by tasks."""

from __future__ import annotations

import ast
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a slab, and cells that are turned into rows at once.
SLAB, CELLS = 64 << 20, 4 << 20
#: Bytes that one task reads at most in small slabs, what opening a file counts for, and how many tasks small inputs get.
TASK, OPEN, LEAST_TASKS = 64 << 20, 256 << 10, 32


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, body: bytes) -> None:
    """Write a file as a whole: attempts of a task write under names of their own and rename, so none leaves a part."""
    fs, at = _located(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(body)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:  # of an earlier attempt
        fs.delete_file(at)
    fs.move(own, at)


def write_files(files: DataFrame, root: str) -> int:
    """Write rows (path below the root, body as text) as files, by the tasks that hold them; how many there are."""
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"], strict=True):
                put(f"{root}/{path}", body.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "body").mapInPandas(written, "n long").agg(F.sum("n")).head()[0] or 0


def write_volumes(vox: DataFrame, scans: DataFrame, root: str, value_col: str) -> DataFrame:
    """Each scan of ``vox`` as a dense array file ``<scan_id>.npz`` with its zoom: (scan_id, path).

    ``scans`` (scan_id, np, ni, nr, zp, zi, zr). A group is one scan, so a task holds one
    array of the declared shape. Missing voxels and null values are 0; of repeated ones any
    is written. Voxels outside of the shape are an error.
    """
    facts = ["np", "ni", "nr", "zp", "zi", "zr"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        first = {c: rows[c].iloc[0] for c in ("scan_id", *facts)}
        if (rows[["p", "i", "r"]] < 0).any(axis=None):
            raise IndexError(f"scan {first['scan_id']} has voxels at negative places")
        data = np.zeros([first[c] for c in facts[:3]])
        data[rows["p"], rows["i"], rows["r"]] = rows["_v"].fillna(0)
        file = io.BytesIO()
        np.savez(file, data=data, zoom=np.array([first[c] for c in facts[3:]], dtype=float))
        path = f"{root}/{first['scan_id']}.npz"
        put(path, file.getvalue())
        return pd.DataFrame({"scan_id": [first["scan_id"]], "path": [path]})

    own = vox.select("scan_id", "p", "i", "r", F.col(value_col).cast("double").alias("_v")).join(scans.select("scan_id", *facts), "scan_id")
    return own.groupBy("scan_id").applyInPandas(one, f"scan_id {dict(vox.dtypes)['scan_id']}, path string")


def _header(file) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """Type, whether in Fortran order, shape, and where the cells start, of a .npy stream."""
    start = file.tell()
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = magic[6] > 1
    length = struct.unpack("<I" if wide else "<H", file.read(4 if wide else 2))[0]
    facts = ast.literal_eval(file.read(length).decode("utf-8" if magic[6] > 2 else "latin1"))
    return np.dtype(facts["descr"]), facts["fortran_order"], tuple(facts["shape"]), start + 8 + (4 if wide else 2) + length


class Slab:
    """Part ``k`` of ``n`` of a file."""

    def __init__(self, path: str, k: int, n: int):
        self.path, self.k, self.n = path, k, n


class Slabs(InputPartition):
    """Slabs that one task reads, one after the other."""

    def __init__(self, slabs: list[Slab]):
        self.slabs = slabs


def _sizes(paths: list[str]) -> list[int]:
    """Sizes of files, asked of each file system at once."""
    located, out, systems = [_located(p) for p in paths], [0] * len(paths), []
    for k, (fs, _) in enumerate(located):
        mine = next((ks for known, ks in systems if known.equals(fs)), None)
        systems.append((fs, [k])) if mine is None else mine.append(k)
    for fs, ks in systems:
        for k, info in zip(ks, fs.get_file_info([located[k][1] for k in ks]), strict=True):
            out[k] = info.size
    return out


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.slab = int(options.get("slabBytes", SLAB))

    def partitions(self) -> list[Slabs]:
        """A slab for every ``slabBytes`` of each file, small slabs together in one partition: only sizes are looked up here."""
        slabs, cost = [], []
        for path, size in zip(self.paths, _sizes(self.paths), strict=True):
            n = max(1, -(-size // self.slab))
            slabs += [Slab(path, k, n) for k in range(n)]
            cost += [max(OPEN, size / n)] * n
        share = min(TASK, sum(cost) / min(len(slabs), LEAST_TASKS))
        out, held = [], share
        for slab, c in zip(slabs, cost, strict=True):
            if held + c > share * (1 + 1e-9):
                out.append(Slabs([]))
                held = 0
            out[-1].slabs.append(slab)
            held += c
        self.paths = []  # the reader goes to every task, which knows its own paths
        return out

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        for slab in partition.slabs:
            yield from self._read(slab)

    def _read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        """Voxels that aren't 0 of the planes whose turn it is; planes lie along the slowest axis of the file."""
        fs, at = _located(partition.path)
        with fs.open_input_file(at) as file:
            zoom, affine, base = [1.0, 1.0, 1.0], None, 0
            if at.endswith(".npz"):
                with zipfile.ZipFile(file) as z:
                    side = {n: np.load(io.BytesIO(z.read(f"{n}.npy"))) for n in ("zoom", "affine") if f"{n}.npy" in z.namelist()}
                    zoom = side["zoom"].tolist() if "zoom" in side else zoom
                    affine = side["affine"].reshape(-1).tolist() if "affine" in side else None
                    entry = z.getinfo("data.npy")
                    if entry.compress_type == zipfile.ZIP_STORED:  # the entry is a plain part of the file
                        file.seek(entry.header_offset + 26)
                        name, extra = struct.unpack("<HH", file.read(4))
                        base = entry.header_offset + 30 + name + extra
                    else:  # has to be unpacked whole, so the first task does it
                        if partition.k:
                            return
                        partition, file = Slab(partition.path, 0, 1), io.BytesIO(z.read("data.npy"))
                    yield from self._slab(partition, file, base, zoom, affine)
            else:
                yield from self._slab(partition, file, base, zoom, affine)

    def _slab(self, partition: Slab, file, base: int, zoom: list[float], affine: list[float] | None) -> Iterator[pa.RecordBatch]:
        file.seek(base)
        kind, fortran, shape, cells = _header(file)
        if len(shape) != 3:
            raise ValueError(f"{partition.path} has {len(shape)} axes, not 3")
        affine = affine or np.diag([*zoom, 1.0]).reshape(-1).tolist()
        axes = shape[::-1] if fortran else shape
        plane = axes[1] * axes[2]
        first, last = (axes[0] * k // partition.n for k in (partition.k, partition.k + 1))
        step = max(1, CELLS // max(1, plane))
        for start in range(first, last, step):
            stop = min(last, start + step)
            file.seek(cells + start * plane * kind.itemsize)
            data = np.frombuffer(file.read((stop - start) * plane * kind.itemsize), kind).reshape(stop - start, *axes[1:])
            where = list(np.nonzero(data))
            value = data[tuple(where)].astype(float)
            where[0] = where[0] + start
            p, i, r = (w.astype(np.int32) for w in (where[::-1] if fortran else where))
            n = len(value)
            if n:
                same = lambda x, t: pa.array([x], t).take(pa.array(np.zeros(n, np.int64)))
                doubles = pa.list_(pa.float64())
                arrays = [same(partition.path, pa.string()), same(list(map(int, shape)), pa.list_(pa.int32())), same(zoom, doubles), same(affine, doubles), *map(pa.array, (p, i, r, value))]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "shape", "zoom", "affine", "p", "i", "r", "value"])


class VolumeDataSource(DataSource):
    """``spark.read.format("volumes").option("slabBytes", n).load("a.npz,file:///b.npy")``: one row a voxel that isn't 0.

    Files are .npy arrays of three axes, or .npz with entries data and perhaps zoom and
    affine (4 x 4, by rows; else the zooms on the diagonal). Large ones are read by several
    tasks, each by its byte range, but for compressed entries.
    """

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return "path string, shape array<int>, zoom array<double>, affine array<double>, p int, i int, r int, value double"

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(self.options)
