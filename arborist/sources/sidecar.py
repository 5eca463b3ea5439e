"""Arrays beside populations as Spark data sources: ``sidecar`` and ``fitted``.

``spark.read.format("sidecar")`` reads a folder's (or one file's) ``.npy``, ``.npz`` and raw ``.bin`` arrays: a
row for each entry along the first axis, with the file's path below the folder. Headers alone are read to plan
partitions of a run of entries, or of the runs of up to a hundred small files; a task seeks to its runs. Members of a compressed ``.npz`` can't be entered in the middle, so each is
one partition, read in pieces. Filters on ``file`` and ``array`` choose what is planned.

``format("fitted")`` writes what fits return as the raw blobs ``status.bin``, ``c_final.bin``, ``loss_init.bin`` and
``loss_final.bin`` in a folder for each part, and reads them beside the population files they belong to, whose
tables say which constants are whose.
"""

from __future__ import annotations

import io
import math
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import popfile
from .popfile import HEADER, META, TREES_PER_PARTITION, Bundle, PopulationReader, Run

ARRAYS = "file string, array string, place long, values array<double>"
RESULTS = "part long, place int, status int, c_final array<double>, loss_init double, loss_final double"
ENTRIES_PER_PARTITION, FILES_PER_PARTITION, PIECE = 1_000_000, 100, 65_536
#: The blobs of a result and their kinds; the status of a tree that has none.
BLOBS, MISSING = {"status": "<i4", "c_final": "<f4", "loss_init": "<f4", "loss_final": "<f4"}, 2


@dataclass
class Piece(InputPartition):
    """Entries first to end of an array: in a file from byte `start`, or in a member of an archive, if named."""

    path: str
    file: str
    member: str
    array: str
    kind: str
    start: int
    width: int
    first: int
    end: int


def bundled(members: list, step: int) -> list[InputPartition]:
    return popfile.bundled(members, step, FILES_PER_PARTITION)


def _header(file, what: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """dtype, shape and where the data begin of a .npy stream that is at its start."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(file)
    if kind.kind not in "biuf":
        raise ValueError(f"{what}: arrays of numbers only, not {kind}")
    if by_columns and len(shape) > 1:
        raise ValueError(f"{what}: stored by columns")
    return kind, shape, file.tell()


def _doubles(raw: bytes, kind: str) -> np.ndarray:
    values = np.frombuffer(raw, kind)
    if values.dtype.kind in "iu" and values.dtype.itemsize == 8 and len(values) and max(abs(int(values.min())), abs(int(values.max()))) > 1 << 53:
        raise ValueError("an integer beyond 2^53 is no double")
    return values.astype(float)


class SidecarReader(DataSourceReader):
    def __init__(self, path: str, kind: str | None, entries: int):
        self.path, self.kind, self.entries = path, kind, entries
        self.only: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("file",), ("array",)) and self.only.setdefault(f.attribute[0], f.value) == f.value:
                continue
            yield f

    def _wanted(self, name: str, value: str) -> bool:
        return self.only.get(name, value) == value

    def _cut(self, path: str, name: str, member: str, array: str, kind: np.dtype, shape: tuple[int, ...], start: int, whole: bool) -> list[Piece]:
        rows, width = (shape[0], math.prod(shape[1:])) if shape else (1, 1)
        step = max(rows, 1) if whole else self.entries
        return [Piece(path, name, member, array, kind.str, start, width, at, min(rows, at + step)) for at in range(0, rows, step)]

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        top = store.get_file_info(root)
        infos = [top] if top.is_file else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out: list[Piece] = []
        for info in infos:
            stem, _, ending = info.base_name.rpartition(".")
            name = info.path.removeprefix(root).lstrip("/") or info.base_name
            if not info.is_file or ending not in ("npy", "npz", "bin") or not self._wanted("file", name):
                continue
            if ending == "npz":
                with store.open_input_file(info.path) as file, zipfile.ZipFile(file) as archive:
                    for entry in archive.infolist():
                        array = entry.filename.removesuffix(".npy")
                        if self._wanted("array", array):
                            with archive.open(entry) as inside:
                                kind, shape, start = _header(inside, f"{info.path}: {array}")
                            out += self._cut(info.path, name, entry.filename, array, kind, shape, start, entry.compress_type != zipfile.ZIP_STORED)
            elif self._wanted("array", stem):
                if ending == "npy":
                    with store.open_input_file(info.path) as file:
                        kind, shape, start = _header(file, info.path)
                    if info.size != start + kind.itemsize * math.prod(shape):
                        raise ValueError(f"{info.path}: size and header differ")
                else:
                    if self.kind is None:
                        raise ValueError(f"{info.path}: a raw array needs the option kind")
                    kind, start = np.dtype(self.kind), 0
                    if info.size % kind.itemsize:
                        raise ValueError(f"{info.path}: not a whole number of {kind}")
                    shape = (info.size // kind.itemsize,)
                out += self._cut(info.path, name, "", stem, kind, shape, start, False)
        return bundled(out, self.entries)

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0]
        for piece in partition.members:
            with store.open_input_file(piece.path) as file:
                if not piece.member:
                    yield from self._batches(file, piece)
                    continue
                with zipfile.ZipFile(file) as archive, archive.open(piece.member) as inside:
                    yield from self._batches(inside, piece)

    @staticmethod
    def _batches(file, part: Piece) -> Iterator[pa.RecordBatch]:
        size = np.dtype(part.kind).itemsize * part.width
        step = max(1, PIECE // max(part.width, 1))
        file.seek(part.start + part.first * size)
        for at in range(part.first, part.end, step):
            n = min(step, part.end - at)
            raw = file.read(n * size)
            if len(raw) != n * size:
                raise ValueError(f"{part.path}: short file")
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(_doubles(raw, part.kind)))
            names = [pa.array([v] * n, pa.string()) for v in (part.file, part.array)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.arange(at, at + n)), values], names=["file", "array", "place", "values"])


class SidecarSource(DataSource):
    """Options: path; kind, of raw files (as "<f4"); entries_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "sidecar"

    def schema(self) -> str:
        return ARRAYS

    def reader(self, schema: StructType) -> DataSourceReader:
        return SidecarReader(self.options["path"], self.options.get("kind"), int(self.options.get("entries_per_partition", ENTRIES_PER_PARTITION)))


class FittedReader(PopulationReader):
    """The blobs of path/part-N beside the population file of part N, in runs of its trees."""

    def __init__(self, path: str, populations: str, trees_per_partition: int):
        super().__init__(populations, trees_per_partition)
        self.results = path

    @staticmethod
    def _part(path: str) -> int:
        return int(path.rsplit("/", 1)[1].split("-")[1])

    def partitions(self) -> list[InputPartition]:
        runs = self._runs()
        files = {r.path for r in runs}
        if len({self._part(f) for f in files}) < len(files):
            raise ValueError("a part of several population files has no results of its own")
        return popfile.bundled(runs, self.step, popfile.FILES_PER_PARTITION)

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for run in partition.members:
            yield from self._results(run)

    def _results(self, partition: Run) -> Iterator[tuple]:
        part = self._part(partition.path)
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(partition.path) as file:
            _, _, m, nodes, total_c, *_ = self._header(file, partition.path)
            end = min(m, partition.end)
            m_own = end - partition.first
            file.seek(HEADER.size + 12 * nodes + META.size * partition.first)
            metas = np.frombuffer(file.read(META.size * m_own), "<i4").reshape(m_own, 4)
        store, root = fs.FileSystem.from_uri(self.results)
        if not m_own:
            return
        if store.get_file_info(f"{root}/part-{part}").type == fs.FileType.NotFound:
            return  # not fitted yet
        c0, c1 = int(metas[0, 2]), int(metas[-1, 2] + metas[-1, 3])

        def blob(name: str) -> np.ndarray:
            low, high, whole = (c0, c1, total_c) if name == "c_final" else (partition.first, end, m)
            path = f"{root}/part-{part}/{name}.bin"
            if store.get_file_info(path).size != 4 * whole:
                raise ValueError(f"{path}: not as long as its population")
            with store.open_input_file(path) as file:
                file.seek(4 * low)
                return np.frombuffer(file.read(4 * (high - low)), BLOBS[name])

        status, c, first, last = (blob(name) for name in BLOBS)
        for i, (_, _, co, k) in enumerate(metas.tolist()):
            yield part, partition.first + i, int(status[i]), c[co - c0 : co - c0 + k].astype(float).tolist(), float(first[i]), float(last[i])


@dataclass
class Folders(WriterCommitMessage):
    paths: list[tuple[str, str]]


class FittedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.temporary = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """A folder for each run of rows of one part, whose places are 0, 1, 2, ...: all of a part, in order."""
        store, root = fs.FileSystem.from_uri(self.path)
        paths: list[tuple[str, str]] = []
        part, due, blobs = None, 0, {}

        def flush() -> None:
            if part is None:
                return
            own = f"{root}/{self.temporary}/{uuid.uuid4().hex}"
            store.create_dir(own)
            for name in BLOBS:
                with store.open_output_stream(f"{own}/{name}.bin") as out:
                    out.write(blobs[name].getvalue())
            paths.append((own, f"{root}/part-{part}"))

        for row in rows:
            if row.part != part:
                flush()
                part, due, blobs = row.part, 0, {name: io.BytesIO() for name in BLOBS}
            if part is None or row.place != due:
                raise ValueError(f"part {row.part}: place {row.place} where {due} was due")
            due += 1
            values = {"status": MISSING if row.status is None else row.status, "c_final": [math.nan if v is None else v for v in row.c_final or []]}
            values |= {name: math.nan if getattr(row, name) is None else getattr(row, name) for name in ("loss_init", "loss_final")}
            with np.errstate(over="ignore"):
                for name, kind in BLOBS.items():
                    blobs[name].write(np.array(values[name], kind).tobytes())
        flush()
        return Folders(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        paths = [pair for m in messages if m for pair in m.paths]
        names = [new for _, new in paths]
        taken = [i.path for i in store.get_file_info(names) if i.type != fs.FileType.NotFound] if names else []
        if taken or len(set(names)) < len(names):
            self._clear(store, root)
            raise ValueError(f"a part's results came twice: {sorted(taken) or sorted(n for n in set(names) if names.count(n) > 1)}")
        for old, new in paths:
            store.move(old, new)
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        store.create_dir(f"{root}/{self.temporary}")
        store.delete_dir(f"{root}/{self.temporary}")


class FittedSource(DataSource):
    """Options: path; populations, the folder of the population files, to read; trees_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "fitted"

    def schema(self) -> str:
        return RESULTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return FittedReader(self.options["path"], self.options["populations"], int(self.options.get("trees_per_partition", TREES_PER_PARTITION)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("results are only added to")
        return FittedWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """The two sources, and that filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SidecarSource)
    spark.dataSource.register(FittedSource)
