"""SimHash near-dedup by anchor-point covering.

A fingerprint has a bit for each bit position that is set in over half of the XXH64 values of
the text's 3-word shingles. Pairs within two bits are found through anchors. A fingerprint is cut into
four runs of 16 bits; two bits touch two runs at most, so that such a pair agrees on the other two.
Each fingerprint goes to six anchors, the bits of any two of its runs, and those that meet are compared
there, on all 64 bits. Two fingerprints at random share one of 2**32, so what is compared grows slowly.

links can also take the anchors of perfect codes, which the tests hold against the runs: the codewords
of the binary Golay code of length 23 on each of two blocks of the fingerprint and those of the Hamming
code of length 15 on a third. Their covering radii are 3, 3 and 1, so each block has exactly one
codeword within its radius, and the codewords of all blocks are the fingerprint's home anchor.
Fingerprints are replicated to every anchor within radius plus threshold that the home of a fingerprint
two bits away can be: per block radius + t bits, with the t of all blocks adding up to 2 at most. Two
blocks give about 61 anchors a fingerprint out of 2**24, three about 250 out of 2**35. Equal
fingerprints are one node throughout.

Defined cases: null and empty texts and texts of blanks have fingerprint zero and link like any
other; texts of one or two words have one shingle, the whole sequence; a null doc_id counts as
larger than any other and is component_id only of rows without another; repeated rows link as
equal fingerprints do; a very long text is one row, its shingles are hashed in pieces; an empty
table gives no row. Columns of other names are not looked at by op9; keep_one carries them, and
__key is its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hex64, saved, small_batches, text_of
from .exact_dedup import document_key
from .graph import components

SHINGLE = 3
THRESHOLD = 2
#: Bytes of texts that are hashed together, about, and shingles whose bits are counted at once.
TOGETHER, PIECE = 1 << 18, 1 << 13


@dataclass(frozen=True)
class Block:
    """A perfect code on some bits of a fingerprint: its generator polynomial, length and radius,
    and where the runs of bits begin and how long they are."""

    generator: int
    length: int
    radius: int
    runs: tuple[tuple[int, int], ...]

    @property
    def parities(self) -> int:
        return self.generator.bit_length() - 1

    def syndrome_of(self, word: int) -> int:
        """The remainder of a word modulo the generator: zero for codewords alone."""
        for bit in range(self.length - 1, self.parities - 1, -1):
            if word >> bit & 1:
                word ^= self.generator << (bit - self.parities)
        return word

    def bits(self, fp: Column) -> Column:
        """The block's bits of a fingerprint."""
        out, at = F.lit(0).cast("long"), 0
        for first, length in self.runs:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1)), at))
            at += length
        return out

    def syndrome(self, block: Column) -> Column:
        """The syndrome of a block: bit i is the parity of the block's bits whose own syndrome has bit i."""
        own = [self.syndrome_of(1 << b) for b in range(self.length)]
        out = F.lit(0)
        for i in range(self.parities):
            mask = sum(1 << b for b in range(self.length) if own[b] >> i & 1)
            out = out.bitwiseOR(F.shiftleft(F.bit_count(block.bitwiseAND(F.lit(mask).cast("long"))).cast("int").bitwiseAND(F.lit(1)), i))
        return out

    def offsets(self, spark: SparkSession, within: int) -> DataFrame:
        """syndrome, flip, far: all ways to reach a codeword by flipping at most `within` bits of a block.

        A fixed table: the words of that weight, by their syndrome.
        """
        flips = ((far, sum(1 << b for b in bits)) for far in range(within + 1) for bits in combinations(range(self.length), far))
        return spark.createDataFrame([(self.syndrome_of(flip), flip, far) for far, flip in flips], "syndrome int, flip long, far int")


#: The generator polynomials of the perfect Golay and Hamming codes.
BLOCKS = (Block(0b110001110101, 23, 3, ((0, 23),)), Block(0b110001110101, 23, 3, ((32, 23),)), Block(0b10011, 15, 1, ((23, 9), (55, 6))))

_BITS = np.array([7 - i % 8 + i // 8 * 8 for i in range(64)])
_SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: What XXH64 reads by itself: from that length on, it takes four lanes at once.
_LONG = 32


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return values << np.uint64(by) | values >> np.uint64(64 - by)


def hashes(line: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of pieces of a line of bytes, which goes on for 8 bytes or more after the last of them."""
    h = sizes.astype(np.uint64) + (_P5 + np.uint64(_SEED))
    at = starts.copy()
    word = np.lib.stride_tricks.sliding_window_view(line, 8)
    for lane in range(1, _LONG // 8):
        has = np.flatnonzero(sizes >= 8 * lane)
        k = _turned(np.ascontiguousarray(word[at[has]]).view("<u8").ravel() * _P2, 31) * _P1
        h[has] = _turned(h[has] ^ k, 27) * _P1 + _P4
        at[has] += 8
    left = sizes % 8
    has = np.flatnonzero(left >= 4)
    h[has] = _turned(h[has] ^ np.ascontiguousarray(word[at[has], :4]).view("<u4").ravel().astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[has] += 4
    left = left % 4
    for byte in range(1, 4):
        has = np.flatnonzero(left >= byte)
        h[has] = _turned(h[has] ^ line[at[has]].astype(np.uint64) * _P5, 11) * _P1
        at[has] += 1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    h = h ^ h >> np.uint64(32)
    view = memoryview(line)
    for i in np.flatnonzero(sizes >= _LONG):
        h[i] = xxhash.xxh64_intdigest(view[starts[i] : starts[i] + sizes[i]], _SEED)
    return h


def _bits_set(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of a group's hashes have each bit; groups begin at the places in first. 255 rows of bytes add up in a byte at most."""
    rows = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    parts = -(-np.diff(first, append=len(values)) // 255)
    group = np.concatenate([[0], np.cumsum(parts)[:-1]])
    cuts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(group, parts))
    sums = np.add.reduceat(rows, cuts, axis=0).view(np.uint8)
    return np.add.reduceat(sums, group, axis=0, dtype=np.int64)


def _fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprints of some texts, as signed longs: words of all of them stand in one line, single blanks between them."""
    words = [text.lower().split() for text in texts]  # of bytes: A-Z alone, and the blanks that separate words
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out.view(np.int64)
    line = np.frombuffer(b" ".join([b" ".join(own) for own in words if own]) + b" " + bytes(8), dtype=np.uint8)
    del words
    ends = np.flatnonzero(line == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    own = counts[full]
    width = np.minimum(own, SHINGLE)
    n = own - width + 1
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    # the place of each shingle's first word: shingles of a text follow each other, its last words begin none
    word = np.arange(n.sum()) + np.repeat(np.cumsum(own) - own - first, n)
    last = word + np.repeat(width, n) - 1
    total = np.zeros((len(full), 64), dtype=np.int64)
    for low in range(0, len(word), PIECE):
        some = slice(low, low + PIECE)
        at = starts[word[some]]
        text = np.searchsorted(first, low, "right") - 1
        until = np.searchsorted(first, low + PIECE, "left")
        total[text:until] += _bits_set(hashes(line, at, ends[last[some]] - at), np.maximum(first[text:until] - low, 0))
    out[full] = np.packbits((2 * total > n[:, None])[:, _BITS][:, ::-1], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def _together(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in lists of TOGETHER bytes about; a longer one is a list by itself."""
    some, size = [], 0
    for text in texts:
        value = text.as_buffer().to_pybytes()
        if some and size + len(value) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(value)
        size += len(value)
    if some:
        yield some


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *map(_fingerprints_of, _together(texts.cast(pa.binary())))]))


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint of a text, as a signed long."""
    return _fingerprints(text_of(text))


def meeting(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fp, anchor, last: each fingerprint at the bits of any two of its threshold + 2 runs, and the second of the two."""
    cuts = _cuts(threshold)
    bits = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(cuts, cuts[1:])]
    wide = max(high - low for low, high in zip(cuts, cuts[1:]))
    at = (
        F.struct(F.shiftleft(F.shiftleft(F.lit(number).cast("long"), wide).bitwiseOR(bits[i]), wide).bitwiseOR(bits[j]).alias("anchor"), F.lit(j).alias("last"))
        for number, (i, j) in enumerate(combinations(range(len(bits)), 2))
    )
    return nodes.select("fp", F.explode(F.array(*at)).alias("__at")).select("fp", "__at.anchor", "__at.last")


def _cuts(threshold: int) -> list[int]:
    """Where the runs of a fingerprint begin, and 64."""
    if threshold < 1:
        raise ValueError("fingerprints within no bit are equal")
    return [64 * i // (threshold + 2) for i in range(threshold + 3)]


def anchored(nodes: DataFrame, threshold: int = THRESHOLD, blocks: int = 2) -> DataFrame:
    """fp, anchor, home: each fingerprint at all the anchors that it must be compared at."""
    codes = BLOCKS[:blocks]
    placed = nodes.select("fp", *(code.bits(F.col("fp")).alias(f"block{i}") for i, code in enumerate(codes)))
    placed = placed.withColumns({f"s{i}": code.syndrome(F.col(f"block{i}")) for i, code in enumerate(codes)})
    spare, anchor, home = F.lit(0), F.lit(0).cast("long"), F.lit(True)
    for i, code in enumerate(codes):
        table = code.offsets(nodes.sparkSession, code.radius + threshold)  # of a fixed size
        spare = spare + F.greatest(F.col(f"far{i}") - code.radius, F.lit(0))
        table = F.broadcast(table.select(*(F.col(c).alias(f"{c}{i}") for c in table.columns)))
        placed = placed.join(table, (F.col(f"s{i}") == F.col(f"syndrome{i}")) & (spare <= threshold))
        anchor = F.shiftleft(anchor, code.length).bitwiseOR(F.col(f"block{i}").bitwiseXOR(F.col(f"flip{i}")))
        home = home & (F.col(f"far{i}") <= code.radius)
    return placed.select("fp", anchor.alias("anchor"), home.alias("home"))


def links(nodes: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """u, v: the pairs of different fingerprints within threshold bits, once each; nodes holds each fp once.

    With blocks, through the anchors of so many codes: the same pairs by more work.
    """
    bits = F.col("u").bitwiseXOR(F.col("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(bits) <= threshold)
    if blocks is not None:
        placed = anchored(nodes, threshold, blocks)
        homes = placed.where("home").select(F.col("fp").alias("u"), "anchor")
        return homes.join(placed.select(F.col("fp").alias("v"), "anchor"), "anchor").where(near).select("u", "v")
    placed, cuts = meeting(nodes, threshold), _cuts(threshold)
    # at the anchor of the first two runs that agree, not at each
    agree = lambda run: (F.shiftrightunsigned(bits, cuts[run]).bitwiseAND(F.lit((1 << (cuts[run + 1] - cuts[run])) - 1)) == 0).cast("int")
    before = sum((F.when(F.col("last") > run, agree(run)).otherwise(0) for run in range(threshold + 1)), F.lit(0))
    met = placed.select(F.col("fp").alias("u"), "anchor", "last").join(placed.select(F.col("fp").alias("v"), "anchor"), "anchor")
    return met.where(near & (before == 1)).select("u", "v")


def grouped(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """rows (doc_id, fp) with root, a fingerprint that names the component, and component_id, the
    smallest doc_id that links reach."""
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, threshold))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    resolved = saved(named.select("fp", "root").join(roots, "root").select("fp", "root", "component_id"))
    return rows.join(resolved, "fp")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp of every row, computed once."""
    small_batches(documents.sparkSession)
    return saved(documents.select("doc_id", fingerprint(F.col("text")).alias("fp")))


def op9(documents: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = fingerprints(documents)
    return grouped(rows).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id (of
    any doc_id before null), and of several texts with that doc_id the one of the smallest digest."""
    small_batches(documents.sparkSession)
    rows = saved(documents.select("doc_id", fingerprint(F.col("text")).alias("fp"), document_key(documents).alias("__key")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key"))
    kept = grouped(rows).groupBy("root").agg(first.alias("first")).select("first.__key")
    return documents.withColumn("__key", document_key(documents)).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
