"""Embedding near-dedup by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is
the coordinate of largest magnitude with its sign. A table joins two such hashes. Each vector
enters, in each table, the buckets of its best two coordinates of either hash, so two close
vectors meet if they share one in any table. In a bucket all pairs are verified by their cosine in
double precision; a pair that meets more than once counts where it meets first. What leaves a
bucket is, for each vector with links, how many it has there and the smallest vector that they
reach: a row a vector, never a pair. A bucket of more than BLOCK vectors is cut into blocks that
are compared two by two in different tasks.

Equal vectors of one label are one node with a count. Hash tables, probes and signs are fixed; the
work grows with the number of vectors and of those that share buckets.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite
components, link with nothing, and neither do vectors of different lengths; labels may be of any
type; repeated rows are equal vectors and link; null vec_ids count as larger than any other; very
long vectors are hashed in memory of their own size times the hashes; an empty table gives no row;
columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .graph import components

TABLES, HASHES, PROBES = 3, 2, 2
THRESHOLD = 0.98
BLOCK = 1024
_SEED = 20


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the rows' length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def buckets(vectors: np.ndarray) -> np.ndarray:
    """Buckets of each vector: shape (vectors, TABLES, PROBES ** HASHES)."""
    n, width = vectors.shape
    d = max(2, 1 << (width - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :width] = vectors
    signs = np.random.default_rng([_SEED, d]).choice([-1.0, 1.0], size=(TABLES, HASHES, 3, d))
    out = np.zeros((n, TABLES, 1), dtype=np.int64)
    for h in range(HASHES):
        best = np.empty((n, TABLES, PROBES), dtype=np.int64)
        for t in range(TABLES):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t, h, r])
            top = np.argpartition(-np.abs(x), PROBES - 1, axis=1)[:, :PROBES]
            best[:, t] = 2 * top + (np.take_along_axis(x, top, axis=1) < 0)
        out = (out[:, :, :, None] * (2 * d) + best[:, :, None, :]).reshape(n, TABLES, -1)
    return np.sort(out % (2**31 - 1), axis=2).astype(np.int32)  # buckets that fall together only meet more


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors with their buckets, all tables in one array."""
    for batch in batches:
        lists = batch.column("embedding")
        lengths = np.diff(lists.offsets.to_numpy())
        for width in np.unique(lengths):
            at = np.flatnonzero(lengths == width)
            own = batch.take(pa.array(at))
            vectors = own.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
            norm = np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
            found = buckets(vectors / norm).reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays(
                [own.column("node"), own.column("label"), own.column("n"), own.column("embedding"), pa.array(list(found), pa.list_(pa.int32()))],
                names=["node", "label", "n", "embedding", "buckets"],
            )


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether pairs (rows of a and b: their buckets) meet in this bucket and in none before it."""
    a, b = (x.reshape(len(x), TABLES, -1) for x in (a, b))
    first = np.ones(len(a), dtype=bool)
    for t in range(table + 1):
        same = a[:, t, :, None] == b[:, t, None, :]
        if t == table:
            same &= a[:, t, :, None] < bucket
        first &= ~same.any(axis=(1, 2))
    return first


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n places the smallest that the pairs reach, by passing minima on."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
    """node, links, root of the vectors of one bucket, or two blocks of it, that have links there."""
    _, _, table, bucket, i, j = key
    width = len(rows.column("embedding")[0])
    vectors = np.asarray(rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    own = rows.column("buckets").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    part, node, n = (rows.column(c).to_numpy() for c in ("part", "node", "n"))
    close = vectors @ vectors.T >= THRESHOLD
    close = np.triu(close, 1) if i == j else close & (part[:, None] == i) & (part[None, :] == j)
    left, right = np.nonzero(close)
    if not len(left):
        return None
    keep = _first_meeting(own[left], own[right], table, bucket)
    left, right = left[keep], right[keep]
    if not len(left):
        return None
    links = np.bincount(left, weights=n[right], minlength=len(node)) + np.bincount(right, weights=n[left], minlength=len(node))
    root = _roots(len(node), left, right)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_pydict({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})


_KEY = ["label", "width", "table", "bucket", "i", "j"]


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, a bucket at a time, whatever the batches' bounds."""
    rest: pa.Table | None = None

    def runs(rows: pa.Table) -> Iterator[tuple[tuple, pa.Table]]:
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in _KEY], axis=1)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for s, e in zip(starts, starts[1:]):
            yield tuple(keys[s].tolist()), rows.slice(s, e - s)

    def out(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1 and (found := _verified(key, rows)) is not None:
            yield found

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not len(rows):
            continue
        found = list(runs(rows))
        for key, run in found[:-1]:
            yield from out(key, run)
        rest = found[-1][1]
    if rest is not None and len(rest):
        key, run = next(runs(rest))
        yield from out(key, run)


def linked(nodes: DataFrame) -> DataFrame:
    """node, links, root of each node (node, label, n, embedding) in each bucket where it has links."""
    bare = nodes.select("node", F.xxhash64("label").alias("label"), "n", "embedding")
    hashed = bare.mapInArrow(_hashed, T.StructType([*bare.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType()))]))
    a_table = PROBES**HASHES
    entries = saved(hashed).select("node", "n", "embedding", "label", "buckets", F.size("embedding").alias("width"), F.posexplode("buckets").alias("at", "bucket"))
    entries = entries.withColumn("table", F.floor(F.col("at") / a_table).cast("int")).drop("at")
    place = ["label", "width", "table", "bucket"]
    large = entries.groupBy(place).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    large = saved(large.select(*(F.col(c).alias(f"l_{c}") for c in place), F.ceil(F.col("size") / (BLOCK // 2)).cast("int").alias("parts")))
    same = [F.col(c) == F.col(f"l_{c}") for c in place]
    met = entries.join(large, same, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("node", "n", "embedding", "buckets", "part", *place, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return met.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_in_buckets, "node long, links long, root long")


def groups(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id of every row (vec_id, label, embedding)."""
    rows = saved(vectors.select("vec_id", "label", "embedding").withColumn("row", F.monotonically_increasing_id()))
    number = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731  false for NaN too
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable = usable & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    nodes = rows.where(usable).groupBy("label", "embedding")
    nodes = saved(nodes.agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    found = saved(linked(nodes))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "c_node")
    named = nodes.join(links, "node", "left").join(joined, F.col("node") == F.col("c_node"), "left")
    named = saved(named.select("node", "label", "embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(named.join(least, "root").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n", "links", "component_id"))
    out = rows.where(usable).join(named, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
    out = out.select("vec_id", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    return out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op6(vectors: DataFrame) -> DataFrame:
    """Links, component and verdict of every vector."""
    return groups(vectors).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
