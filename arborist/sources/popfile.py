"""Population files as a Spark data source, ``spark.read.format("population")``.

A folder holds files of the binary population format; each is a header, flat node arrays, a table
of trees, initial constants, shared inputs and a target for each tree, all little-endian 32-bit.
Reading plans partitions of a run of trees, or of the runs of up to a thousand small files, which
are planned by their sizes and not opened before; it checks magic, version, sizes and sums on the
header and table alone, and seeks to what the run needs. Writing makes a file of each run of rows
with one `part` value in a task, under a temporary name until the commit.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "part long, place int, nodes array<struct<nt:int,nv:float,ci:int>>, c array<double>, x array<double>, n_vars int, y array<double>"
#: The format's magic number, version, header and table row.
MAGIC, VERSION, HEADER, META = 0x4D4C344D, 1, struct.Struct("<16i"), struct.Struct("<4i")
TREES_PER_PARTITION, FILES_PER_PARTITION, PARTS_PER_TASK = 50_000, 1000, 500


@dataclass
class Run(InputPartition):
    """Trees first to end, or fewer, where the file has fewer."""

    path: str
    first: int
    end: int


@dataclass
class Bundle(InputPartition):
    """What one task reads, in turn."""

    members: list


def bundled(members: list, step: int, files: int) -> list[InputPartition]:
    """Runs (first to end) put together up to `step` entries; opening one counts as step / files of them."""
    out: list[InputPartition] = []
    held, full = [], 0
    for m in members:
        cost = max(m.end - m.first, step // files)
        if held and full + cost > step:
            out.append(Bundle(held))
            held, full = [], 0
        held.append(m)
        full += cost
    return [*out, Bundle(held)]


@dataclass
class Done(WriterCommitMessage):
    names: list[str]


def by_part(rows: DataFrame) -> DataFrame:
    """rows for a writer: a part's in one task, in order, and more tasks the more parts there are."""
    n = rows.select(F.approx_count_distinct("part").alias("n")).first().n
    return rows.repartition(n // PARTS_PER_TASK + 1, "part").sortWithinPartitions("part", "place")


def need_of(nodes: list) -> int:
    """The stack that a right-to-left evaluation needs."""
    now = top = 0
    for nt, _, _ in reversed(nodes):
        now += 1 - max(0, nt - 1)
        top = max(top, now)
    return top


def encode(rows: list[Row]) -> bytes:
    """One file of the rows' trees; they share x, and each has a target as long as x's points."""
    trees = [[(n.nt, n.nv, n.ci) for n in r.nodes] for r in rows]
    for nodes in trees:
        if [ci for nt, _, ci in nodes if nt == 1] != list(range(sum(nt == 1 for nt, _, _ in nodes))):
            raise ValueError("constants must be numbered in prefix order")
    x, n_vars = rows[0].x or [], rows[0].n_vars or 0
    n = len(x) // n_vars if n_vars else 0
    if any((r.x or []) != x or len(r.y or []) != n for r in rows):
        raise ValueError("trees of one file share their inputs")
    flat = [node for nodes in trees for node in nodes]
    c = [v for r in rows for v in r.c]
    k = [len(r.c) for r in rows]
    sizes = [len(t) for t in trees]
    head = HEADER.pack(MAGIC, VERSION, len(rows), len(flat), len(c), n, n_vars, max(k), max(map(need_of, trees)), *[0] * 7)
    columns = zip(*flat)
    arrays = [np.array(v, kind).tobytes() for v, kind in zip(columns, ("<i4", "<f4", "<i4"))]
    metas = np.stack([np.cumsum([0, *sizes[:-1]]), sizes, np.cumsum([0, *k[:-1]]), k], axis=1).astype("<i4")
    return b"".join([head, *arrays, metas.tobytes(), np.array(c, "<f4").tobytes(), np.array(x, "<f4").tobytes(), np.array([r.y or [] for r in rows], "<f4").tobytes()])


class PopulationReader(DataSourceReader):
    def __init__(self, path: str, trees_per_partition: int):
        self.path, self.step = path, trees_per_partition

    @staticmethod
    def _header(file, path: str) -> tuple[int, ...]:
        raw = file.read(HEADER.size)
        if len(raw) < HEADER.size:
            raise ValueError(f"{path}: short file")
        head = HEADER.unpack(raw)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError(f"{path}: not a population of this version")
        _, _, m, nodes, c, n, n_vars, *_ = head
        if file.size() != HEADER.size + 12 * nodes + META.size * m + 4 * (c + n * n_vars + m * n):
            raise ValueError(f"{path}: size and header differ")
        return head

    def _runs(self) -> list[Run]:
        store, root = fs.FileSystem.from_uri(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(".bin"):
                m = max(1, (info.size - HEADER.size) // META.size)  # more trees than can be in it
                if m > self.step:
                    with store.open_input_file(info.path) as file:
                        m = self._header(file, info.path)[2]
                out += [Run(info.path, at, min(m, at + self.step)) for at in range(0, m, self.step)]
        return out

    def partitions(self) -> list[InputPartition]:
        return bundled(self._runs(), self.step, FILES_PER_PARTITION)

    def read(self, partition: Bundle) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(self.path)[0]
        for run in partition.members:
            yield from self._trees(store, run)

    def _trees(self, store: fs.FileSystem, partition: Run) -> Iterator[tuple]:
        with store.open_input_file(partition.path) as file:
            _, _, m, nodes, total_c, n, n_vars, *_ = self._header(file, partition.path)

            def array(at: int, count: int, kind: str) -> np.ndarray:
                file.seek(at)
                return np.frombuffer(file.read(4 * count), kind)

            start = HEADER.size
            metas = array(start + 12 * nodes, 4 * m, "<i4").reshape(m, 4)
            if metas[:, 1].sum() != nodes or metas[:, 3].sum() != total_c:
                raise ValueError("the table's sums and the header differ")
            own = metas[partition.first : partition.end]
            if not len(own):
                return
            low, high = int(own[0, 0]), int(own[-1, 0] + own[-1, 1])
            nt, nv, ci = (array(start + 4 * (i * nodes + low), high - low, kind) for i, kind in enumerate(("<i4", "<f4", "<i4")))
            at_c = start + 12 * nodes + META.size * m
            c0 = int(own[0, 2])
            c = array(at_c + 4 * c0, int(own[-1, 2] + own[-1, 3]) - c0, "<f4")
            x = array(at_c + 4 * total_c, n * n_vars, "<f4").astype(float).tolist()
            at_y = at_c + 4 * (total_c + n * n_vars)
            part = int(partition.path.rsplit("/", 1)[1].split("-")[1])
            for place, (o, size, co, k) in enumerate(own.tolist(), partition.first):
                s = slice(o - low, o - low + size)
                y = array(at_y + 4 * place * n, n, "<f4").astype(float).tolist()
                tree = list(zip(nt[s].tolist(), nv[s].tolist(), ci[s].tolist()))
                yield part, place, tree, c[co - c0 : co - c0 + k].astype(float).tolist(), x, n_vars, y


class PopulationWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.temporary = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{self.temporary}")
        names, held = [], []

        def flush() -> None:
            if held:
                name = f"part-{held[0].part}-{uuid.uuid4().hex}.bin"
                with store.open_output_stream(f"{root}/{self.temporary}/{name}") as out:
                    out.write(encode(held))
                names.append(name)
                held.clear()

        for row in rows:
            if held and row.part != held[0].part:
                flush()
            held.append(row)
        flush()
        return Done(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.names if message else []:
                store.move(f"{root}/{self.temporary}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        store.create_dir(f"{root}/{self.temporary}")
        store.delete_dir(f"{root}/{self.temporary}")


class PopulationSource(DataSource):
    """Options: path; trees_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "population"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PopulationReader(self.options["path"], int(self.options.get("trees_per_partition", TREES_PER_PARTITION)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("populations are only added to")
        return PopulationWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PopulationSource)
