"""BPE encoding and decoding through a distinct-word table.

Encoding. Spark splits every whole text into words (the tokenizer's pre-tokens). Consecutive
documents form blocks of a bounded number of words; a block holds its distinct words once and its
text as codes into them. Each block sends its distinct words to the bucket of their hash, a bucket
encodes each of its distinct words once, and the ids come back to the places the words have in
their blocks, where the documents' ids are read off; the blocks, written once into a bucketed
table, don't move. So what is shuffled are distinct words of
blocks, never occurrences; a word in every text costs one entry a block. The number of buckets
follows the number of distinct words, and each bucket is split by runs of at most about MET_BLOCKS
blocks, so that the bucket of a word that all blocks have is bounded like any other: beyond so
many blocks a word is encoded once in each run.

Decoding. The ids join the table of id to piece (as many rows as the vocabulary, a fixed bound)
and the pieces' bytes are put together.

Words are split by a pattern in the JVM. Texts with characters that this JVM's Unicode tables
don't know yet are split by the tokenizer itself, so both sides always agree.

Defined cases: a null or empty text has no id and decodes to the empty text; special tokens in a
text become their ids, as the tokenizer makes them; repeated rows and null doc_ids are rows like
any other; a very long text is a block of its own; an empty table gives no row; columns of other names
are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, small_batches, text_of

BLOCK_WORDS = 1_500_000
SLICE = 256
BUCKET_WORDS = 150_000
BUCKETS = 256
MET_BLOCKS = 2048
#: White space as Unicode has it, and the words' pattern; both must equal the tokenizer's.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?(?:NOT_SPECIAL[^SPACE\p{L}\p{N}])+|BEFORE_SPECIAL[SPACE]+(?![^SPACE])|[SPACE]+"


def _alphabet() -> dict[str, int]:
    """The byte that each letter of byte-level pieces stands for: visible bytes for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE tokenizer file, as text that goes to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        self.special = [x["content"] for x in json.loads(self.text)["added_tokens"]]

    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.text)
        made.no_truncation()
        made.no_padding()
        return made

    def pattern(self) -> str:
        """The words of a text, for the JVM: special tokens first, then the pre-tokenizer's pattern."""
        special = "|".join(re.sub(r"(\W)", r"\\\1", x) for x in self.special)
        words = _WORDS.replace("NOT_SPECIAL", f"(?!{special})" if special else "")
        words = words.replace("BEFORE_SPECIAL", f"[SPACE]+(?={special})|" if special else "")
        return (f"{special}|" if special else "") + words.replace("SPACE", _SPACE)

    def split(self, tokenizer, text: str) -> list[str]:
        """The words of a text, by the tokenizer itself."""
        out = []
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for i, part in enumerate(parts):
            out += [part] if i % 2 else [part[s:e] for _, (s, e) in tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return [x for x in out if x]

    @cached_property
    def encoder(self):
        """A function from a word (bytes) to its ids: the tokenizer's model, after its byte alphabet.

        Made once in a Python worker, which keeps the broadcast vocabulary.
        """
        made = self.tokenizer()
        letters = {b: c for c, b in _alphabet().items()}
        special = {x.encode(): made.token_to_id(x) for x in self.special}
        tokenize = made.model.tokenize

        def encode(word: bytes) -> list[int]:
            if word in special:
                return [special[word]]
            return [x.id for x in tokenize(word.decode("latin-1").translate(letters))]

        return encode

    def pieces(self) -> pa.Array:
        """The bytes of each id, in the order of ids: the id-to-piece table."""
        made = self.tokenizer()
        byte_of = _alphabet()
        vocabulary = made.get_vocab(with_added_tokens=True)
        table: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            known = piece not in self.special and all(c in byte_of for c in piece)
            table[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
        return pa.array(table, pa.binary())


def _packed(**columns) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _column(data: bytes, name: str) -> pa.Array:
    column = _unpacked(data).column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _body(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each value starts and the last ends, and the bytes that hold them."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1], memoryview(values.buffers()[2] or b"")


def _squeezed(words: pa.Array) -> bytes:
    """Words in few bytes however few they are: lengths and bytes, compressed."""
    offsets, body = _body(words)
    return zlib.compress(np.diff(offsets).astype("<u4").tobytes() + bytes(body[offsets[0] : offsets[-1]]), 1)


def _words_of(data: bytes, n: int) -> list[bytes]:
    data = zlib.decompress(data)
    ends = np.cumsum(np.frombuffer(data, "<u4", n)).tolist()
    body = data[4 * n :]
    return [body[s:e] for s, e in zip([0, *ends], ends)]


def _dealt(words: pa.Array, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets of a block's words, and the places of the words in each."""
    bucket = pd.util.hash_array(words.to_numpy(zero_copy_only=False)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return [(int(bucket[own[0]]), own) for own in runs]


def blocks(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """block, docs, codes, words, n_words: bounded runs of documents, their texts as codes."""

    def build(held: list[tuple[pa.Array, np.ndarray, pa.Array]], name: str) -> pa.RecordBatch:
        coded = pa.chunked_array([x[2] for x in held], pa.string()).combine_chunks()
        coded = (coded if isinstance(coded, pa.Array) else coded.chunk(0)).dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # common words get small codes
        place = np.empty(len(words), dtype=np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        codes, words = place[codes], words.take(pa.array(order))
        return pa.RecordBatch.from_pydict(
            {
                "block": [name],
                "docs": [_packed(doc_id=pa.concat_arrays([x[0] for x in held]), n=np.concatenate([x[1] for x in held]))],
                "codes": [_packed(low=(codes & 0xFFFF).astype(np.uint16), high=(codes >> 16).astype(np.uint16))],
                "words": [_packed(word=words)],
                "n_words": pa.array([len(words)], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, held, total = None, [], 0
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            odd = pc.is_valid(batch.column("odd"))
            for rows, is_odd in ((batch.filter(pc.invert(odd)), False), (batch.filter(odd), True)):
                if not rows.num_rows:
                    continue
                words = rows.column("words")
                if is_odd:
                    tokenizer = tokenizer or vocabulary.tokenizer()
                    words = pa.array([vocabulary.split(tokenizer, x) for x in rows.column("odd").to_pylist()], pa.list_(pa.string()))
                counts = pc.list_value_length(words).to_numpy().astype(np.int32)
                held.append((rows.column("doc_id"), counts, words.flatten().cast(pa.string())))
                total += int(counts.sum())
            if total >= BLOCK_WORDS:
                yield build(held, uuid.uuid4().hex)
                held, total = [], 0
        if held:
            yield build(held, uuid.uuid4().hex)

    text = text_of()
    odd = F.when(text.rlike(r"\p{Cn}"), text)
    split = F.when(~text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(vocabulary.pattern()), F.lit(0)))
    return documents.select("doc_id", split.alias("words"), odd.alias("odd")).mapInArrow(run, "block string, docs binary, codes binary, words binary, n_words long")


def encoded_words(block_rows: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, int]:
    """bucket, run, block, n, ids: the ids of each block's distinct words; and the number of buckets.

    A bucket has all entries of its words from the blocks of one run and encodes each word once.
    """
    whole = block_rows.agg(F.sum("n_words").alias("words"), F.count("*").alias("blocks")).first()
    runs = max(1, -(-whole.blocks // MET_BLOCKS))
    buckets = max(64, -(-(whole.words or 0) // (BUCKET_WORDS * runs)))
    shared = block_rows.sparkSession.sparkContext.broadcast(vocabulary)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                words = _column(packed, "word")
                run = zlib.crc32(block.encode()) % runs
                for bucket, own in _dealt(words, buckets):
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": pa.array([bucket], pa.int32()), "run": pa.array([run], pa.int32()), "block": [block], "words": [_squeezed(words.take(pa.array(own)))], "n": pa.array([len(own)], pa.int32())}
                    )

    def encode(rows: pa.Table) -> pa.Table:
        lists = [_words_of(x, n) for x, n in zip(rows.column("words").to_pylist(), rows.column("n").to_pylist())]
        place = {word: i for i, word in enumerate(dict.fromkeys(w for words in lists for w in words))}
        made = list(map(shared.value.encoder, place))
        out = []
        for words in lists:
            own = [made[place[w]] for w in words]
            counts = np.fromiter(map(len, own), "<u4", len(own))
            out.append(zlib.compress(counts.tobytes() + np.concatenate([np.asarray(x, "<u4") for x in own]).tobytes(), 1))
        return pa.table({"bucket": rows.column("bucket"), "run": rows.column("run"), "block": rows.column("block"), "n": rows.column("n"), "ids": pa.array(out, pa.binary())})

    asked = block_rows.select("block", "words").mapInArrow(deal, "bucket int, run int, block string, words binary, n int")
    return asked.groupBy("bucket", "run").applyInArrow(encode, "bucket int, run int, block string, n int, ids binary"), buckets


def stored(block_rows: DataFrame) -> DataFrame:
    """The blocks, written once into a table bucketed by block, so that what comes back meets them unshuffled."""
    spark = block_rows.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    path = shared_path(spark, "bpe-blocks")
    block_rows.write.option("path", path).option("compression", "uncompressed").bucketBy(BUCKETS, "block").saveAsTable(name)
    return spark.table(name)


def derived(documents: DataFrame, vocabulary: Vocabulary, derive: Callable[[pa.ListArray], dict], columns: str) -> DataFrame:
    """doc_id of every document, and the columns that derive makes of an array of documents' ids."""
    small_batches(documents.sparkSession)
    block_rows = stored(blocks(documents, vocabulary))
    back = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *T.StructType.fromDDL(columns).fields])

    def read_off(texts: pa.Table, words: pa.Table) -> pa.Table:
        """Texts of one block and the ids of its words: the ids of its documents."""
        row = {k: texts.column(k)[0].as_py() for k in ("docs", "codes", "words")}
        place = dict(_dealt(_column(row["words"], "word"), buckets))
        counts, flat, places = [], [], []
        for bucket, n, packed in zip(*(words.column(c).to_pylist() for c in ("bucket", "n", "ids"))):
            raw = np.frombuffer(zlib.decompress(packed), "<u4")
            places.append(place[bucket])
            counts.append(raw[:n])
            flat.append(raw[n:])
        order = np.argsort(np.concatenate([*places, np.zeros(0, np.int64)]), kind="stable")
        ends = np.cumsum(np.concatenate([*counts, np.zeros(0, "<u4")]), dtype=np.int64)
        by_word = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate([*flat, np.zeros(0, "<u4")]).astype(np.int32))
        ).take(pa.array(order))
        codes = _unpacked(row["codes"])
        codes = codes.column("low").to_numpy().astype(np.int32) | codes.column("high").to_numpy().astype(np.int32) << 16
        docs = _unpacked(row["docs"])
        ends = np.concatenate([[0], np.cumsum(docs.column("n").to_numpy(), dtype=np.int64)])
        done = []
        for at in range(0, len(docs), SLICE):  # the ids of a few documents at a time
            to = min(at + SLICE, len(docs))
            ids = by_word.take(pa.array(codes[ends[at] : ends[to]]))
            id_ends = ids.offsets.to_numpy()[ends[at : to + 1] - ends[at]]
            done.append(pa.table({"doc_id": docs.column("doc_id").slice(at, to - at)} | derive(pa.ListArray.from_arrays(pa.array(id_ends), ids.values))))
        return pa.concat_tables(done)

    found, buckets = encoded_words(block_rows, vocabulary)
    return block_rows.select("block", "docs", "codes", "words").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(read_off, back)


def encode(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (array of int) of every document."""
    return derived(documents, vocabulary, lambda ids: {"ids": ids}, "ids array<int>")


def _slices(values: pa.Array, table: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
    """For each run of values, what the table has for them, put together."""
    offsets, body = _body(table.cast(pa.large_binary()).take(values))
    at = offsets[ends]
    return (body[s:e] for s, e in zip(at, at[1:]))


def _decoded(ids: pa.Array, pieces: pa.Array) -> list[bytes]:
    """The texts of arrays of ids, in UTF-8: ids joined to their pieces."""
    return [bytes(x).decode("utf-8", "replace").encode() for x in _slices(*_flat_with(ids, pieces))]


def _flat_with(ids: pa.Array, table: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    offsets = ids.offsets.to_numpy()
    return ids.flatten(), table, offsets - offsets[0]


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids, special tokens included."""
    pieces = vocabulary.pieces()

    @F.arrow_udf(T.StringType())
    def of(rows: pa.Array) -> pa.Array:
        return pa.array([x.decode() for x in _decoded(rows, pieces)], pa.string())

    return of(ids)


def op10(documents: DataFrame, path: str) -> DataFrame:
    """n_tokens and the digests of ids and of the decoded text of every document."""
    vocabulary = Vocabulary(path)
    pieces = vocabulary.pieces()

    def digests(ids: pa.ListArray) -> dict:
        decimal = pa.array([b"%d," % i for i in range(len(pieces))], pa.binary())
        return {
            "n_tokens": pc.list_value_length(ids).cast(pa.int64()),
            "ids_sha256": [sha256(x[:-1]).hexdigest() for x in _slices(*_flat_with(ids, decimal))],
            "decoded_sha256": [sha256(x).hexdigest() for x in _decoded(ids, pieces)],
        }

    return derived(documents, vocabulary, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
