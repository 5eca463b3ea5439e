"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Words are runs of letters, digits and non-ASCII bytes, or runs of other visible characters.
Their 1- and 2-grams are hashed into 2**bits buckets; a 2-gram of one word twice counts as the
feature "a word repeated", whatever the word. A text is the vector of its n-gram counts divided
by the root of their number; its score is the logistic function of a sparse dot product.

Training is data parallel: doc_ids hash to a few shares of a bounded sample of labelled rows, each
share runs FTRL in the order of a second hash, the per-coordinate states are averaged by bucket (a
grouped aggregation of 2**bits rows at most, in fixed point, so that no order of adding matters),
and the next round starts from the average. So the weights follow from the rows alone, however
the tables are laid out.

Defined cases: null and empty texts have no n-gram and score by the bias alone; label rows with a
null doc_id or quality are ignored, a doc_id labelled twice takes the majority (a tie is 1) and
one with several texts is learned by the text of the smallest hash; without a usable label every
score is 0.5; a very long text is taken in pieces that end where a word ends; repeated rows are
scored like any other; an empty table gives no row; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches, text_of

_PRIME = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20
#: Steps of the states' fixed point in 1.
_UNIT = 1 << 32


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that are learned from; the rest are fixed costs."""

    bits: int = 18
    max_rows: int = 12_000
    partitions: int = 8
    rounds: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01
    threshold: float = 0.7


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[:33] = 0
    kinds[127] = 0
    kinds[128:] = 1
    for low, high in ("09", "AZ", "az"):
        kinds[ord(low) : ord(high) + 1] = 1
    return kinds


_KINDS = _byte_kinds()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_PRIME**i and _PRIME**-i modulo 2**64, for i below n."""
    inverse = pow(_PRIME, -1, 1 << 64)
    out = []
    for base in (_PRIME, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _features(data: np.ndarray, ends: np.ndarray, bits: int, carried: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets of consecutive texts, and how many each text has.

    data: the texts' bytes; ends: where each text ends in them. carried: the first word is the
    last one of the piece before, there for its 2-gram alone.
    """
    up, down = _powers(len(data) + 1)
    kinds = _KINDS[data]
    before = np.concatenate([[np.uint8(0)], kinds[:-1]])
    starts_text = np.zeros(len(data) + 1, dtype=bool)
    starts_text[0] = True
    starts_text[ends] = True
    begin = np.flatnonzero((kinds != 0) & ((kinds != before) | starts_text[:-1]))
    after = np.concatenate([kinds[1:], [np.uint8(0)]])
    end = np.flatnonzero((kinds != 0) & ((kinds != after) | starts_text[1:])) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    words = (sums[end] - sums[begin]) * down[begin]
    text = np.searchsorted(ends, begin, side="right")
    pair = text[1:] == text[:-1]
    left, right = words[:-1][pair], words[1:][pair]
    pairs = np.where(left == right, np.uint64(12345), left * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9))
    grams = np.concatenate([words[int(carried) :], pairs])
    owner = np.concatenate([text[int(carried) :], text[:-1][pair]])
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(owner, kind="stable")
    buckets = (grams >> np.uint64(64 - bits)).astype(np.int64)[order]
    return buckets, np.bincount(owner, minlength=len(ends))


def _parts(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """One text in parts of about _CHUNK bytes that end where a word ends, each after the first
    begun by the last word before it; and whether it is so begun."""
    start, word = 0, data[:0]
    while start < len(data):
        end = min(start + _CHUNK, len(data))
        while end < len(data) and _KINDS[data[end]] and _KINDS[data[end]] == _KINDS[data[end - 1]]:
            end += 1
        yield np.concatenate([word, np.full(min(len(word), 1), 32, np.uint8), data[start:end]]), len(word) > 0
        kinds = _KINDS[data[start:end]]
        seen = np.flatnonzero(kinds)
        if len(seen):
            other = np.flatnonzero(kinds[: seen[-1]] != kinds[seen[-1]])
            word = data[start + (other[-1] + 1 if len(other) else 0) : start + seen[-1] + 1]
        start = end


def _pieces(texts: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, buckets and counts of runs of texts of about _CHUNK bytes; a longer text is cut into pieces."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1
        if to > at:
            yield at, *_features(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], bits)
        else:
            to = at + 1
            for part, carried in _parts(data[offsets[at] : offsets[to]]):
                yield at, *_features(part, np.array([len(part)]), bits, carried)
        at = to


def margins(texts: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    """bias + w·x for each text; weights[-1] is the bias."""
    sums, grams = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for at, buckets, counts in _pieces(texts, bits):
        owner = np.repeat(np.arange(len(counts)), counts)
        sums[at : at + len(counts)] += np.bincount(owner, weights=weights[buckets], minlength=len(counts))
        grams[at : at + len(counts)] += counts
    return weights[-1] + sums / np.sqrt(np.maximum(grams, 1))


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The FTRL-proximal closed form of the weights from its two accumulators."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def _learn(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, float]], s: Settings) -> None:
    """One pass of FTRL over (buckets, values, label) rows, in place."""
    for index, value, label in rows:
        w = _weights(z[index], n[index], s)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / s.alpha
        z[index] += g - sigma * w
        n[index] += g * g


def _rows(texts: pa.Array, labels: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    own: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for at, buckets, counts in _pieces(texts, bits):
        for i, part in enumerate(np.split(buckets, np.cumsum(counts)[:-1])):
            own[at + i].append(part)
    out = []
    for parts, label in zip(own, labels):
        grams = np.concatenate([*parts, np.zeros(0, np.int64)])
        index, times = np.unique(grams, return_counts=True)
        out.append((np.append(index, 1 << bits), np.append(times / np.sqrt(max(len(grams), 1)), 1.0), label))
    return out


def training_rows(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, label of at most settings.max_rows labelled rows that may be learned from.

    Rows whose crc32(doc_id as text) modulo 4 is 2 are held out. The rest are taken in the order
    of a hash of doc_id, so the sample is the same at every run.
    """
    may = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    one = may.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    met = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return met.groupBy("doc_id").agg(first["text"].alias("text"), F.first("label").alias("label"))


def _state(z: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The states of the buckets that a share has met, in fixed point."""
    used = np.flatnonzero(n)
    return pa.record_batch({"bucket": used, **{k: np.rint(x[used] * _UNIT).astype(np.int64) for k, x in (("z", z), ("n", n))}})


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """2**bits weights and the bias, as one array: of a size that settings fix."""
    s = settings
    spark = documents.sparkSession
    small_batches(spark)
    sample = training_rows(documents, labels, s).withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(s.partitions)))
    sample = saved(sample.repartition(s.partitions, "share").sortWithinPartitions("share", F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    shares = sample.select("share").distinct().count()
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(s.rounds):
        state = spark.sparkContext.broadcast((z, n))

        def learn(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            z, n, last = None, None, None
            for batch in batches:
                own = batch.column("share").to_numpy()
                at = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
                for start, end in zip(at, at[1:]):
                    if end > start and own[start] != last:
                        if last is not None:
                            yield _state(z, n)
                        (z, n), last = (x.copy() for x in state.value), own[start]
                    rows = batch.slice(start, end - start)
                    _learn(z, n, _rows(rows.column("text"), rows.column("label").to_numpy(zero_copy_only=False), s.bits), s)
            if last is not None:
                yield _state(z, n)

        # a share that never met a bucket counts as zeros in its average
        states = sample.mapInArrow(learn, "bucket long, z long, n long")
        mean = states.groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
        got = mean.toArrow()  # 2**bits rows at most
        at = got.column("bucket").to_numpy()
        z, n = np.zeros(size), np.zeros(size)
        z[at], n[at] = (got.column(c).to_numpy() / (_UNIT * max(shares, 1)) for c in ("z", "n"))
        state.unpersist()
    return _weights(z, n, s)


def score(weights: np.ndarray, text: Column, settings: Settings = Settings()) -> Column:
    """Probability (0 to 1) that a text is of quality 1."""
    bits, weights = settings.bits, weights.astype(np.float32)

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(margins(texts, weights, bits), -35, 35))))

    return of(text_of(text))


def classify(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents with their score; one row per row of documents."""
    weights = train(documents, labels, settings)
    return documents.select("doc_id", score(weights, F.col("text"), settings).alias("score"))


def op1(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return classify(documents, labels, settings).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, with all their columns."""
    weights = train(documents, labels, settings)
    return documents.where(score(weights, F.col("text"), settings) >= settings.threshold)
