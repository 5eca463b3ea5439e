"""Periodic runs of words, found through string synchronising sets, and texts without their repeats.

A run is a stretch of words with smallest period q, at least EXPONENT periods and MIN_WORDS words
long, that no neighbouring word extends. Texts are independent, so rows never leave their task:
each task takes texts in chunks, their words as numbers with a separator of its own after each
text, and works on a chunk at once. A text longer than a chunk is a chunk of its own.

* Small periods, SMALL at most, are detected by themselves: words are compared with those q further.
* For each dyadic scale t from SMALL on, a position belongs to the synchronising set if, of the hashes
  of the t-word fragments that begin at it or up to t later, the least is that of the first or of
  the last. Fragments of a period of t / EXPONENT or less have no hash: they lie in highly
  periodic regions, all found before, which supply those periods. The choice depends on the 2t words
  from the position alone, so equal contexts of 2t words are chosen alike.
* Two neighbouring occurrences of one context, d apart, propose the period d if t < d <= 2t.

Why none is lost: let a run have period q with t < q <= 2t. Among its first t places one is chosen,
else the first 3t - 1 words would have a period of t / EXPONENT, and so, being longer than both
together, the run one that divides q. That place lies q + 2t words before the run's end at least, as the run has
four periods; so its context recurs q later, there is chosen too, and is no nearer. Proposals are
verified on the words themselves and extended to both sides, so what is reported is exact. Hashes
have 64 bits and are mixed by fixed constants: a run could only be missed if two unequal
fragments of one chunk had the same hash.

Defined cases: a null, empty or blank text has no word and no run and collapses to the empty
text; repeated rows and null doc_ids are rows like any other; a word is bytes, compared as it
stands; an empty table gives no row; columns of other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, small_batches, text_of

EXPONENT = 4
MIN_WORDS = 6
#: Periods compared directly, and the first scale: a power of two.
SMALL = 4
#: Words that are worked on at once, about.
CHUNK_WORDS = 1 << 16

FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits from 64 bits, each depending on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _later(x: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    """x[i + by] at i, and fill beyond the end."""
    out = np.full(len(x), fill, x.dtype)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def _doubled(fragments: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the fragments of twice the size."""
    return _mixed(fragments * np.uint64(0x9E3779B97F4A7C15) + _mixed(_later(fragments, size) + np.uint64(0xD1B54A32D192ED03)))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of True begin and end."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _small_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of the stretches of EXPONENT periods or more whose smallest period is SMALL at most."""
    starts, ends, periods, unequal = [], [], [], {}
    for q in range(1, min(SMALL, len(codes) - 1) + 1):
        equal = codes[:-q] == codes[q:]
        s, e = _stretches(equal)
        long = e - s >= (EXPONENT - 1) * q
        s, e = s[long], e[long]
        for r in (r for r in unequal if q % r == 0):
            smallest = unequal[r][e + q - r] > unequal[r][s]
            s, e = s[smallest], e[smallest]
        unequal[q] = np.concatenate([[0], np.cumsum(~equal)])
        starts.append(s)
        ends.append(e + q)
        periods.append(np.full(len(s), q))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends, periods))


def _synchronising(fragments: np.ndarray, t: int, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """The chosen positions at scale t; starts, ends, periods: of the regions found so far."""
    ids = fragments.copy()
    dense = (periods * EXPONENT <= t) & (ends - starts >= t)
    if dense.any():
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, starts[dense], 1)
        np.add.at(change, ends[dense] - t + 1, -1)
        ids[np.cumsum(change[:-1]) > 0] = _NONE
    least, size = ids, 1
    while size < t:
        least = np.minimum(least, _later(least, size, _NONE))
        size *= 2
    last = _later(ids, t, _NONE)
    least = np.minimum(least, last)
    return np.flatnonzero((least != _NONE) & ((least == ids) | (least == last)))


def _verified(words: np.ndarray, at: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """start, end of the runs of period q of one text that hold one of the places."""
    s, e = _stretches(words[:-q] == words[q:])
    which = np.unique(np.searchsorted(s, at, "right") - 1)
    which = which[which >= 0]
    which = which[e[which] - s[which] >= (EXPONENT - 1) * q]
    inside = np.searchsorted(at, e[which]) > np.searchsorted(at, s[which])
    return s[which][inside], e[which][inside] + q


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length, period of every run, by text, start and period.

    codes: the words of all texts as numbers, after each text one that occurs nowhere else; sizes: the
    texts' numbers of words. Starts are counted within the text.
    """
    begins = np.cumsum(sizes + 1) - sizes - 1
    s, e, q = _small_runs(codes)
    text = np.searchsorted(begins, s, "right") - 1
    found = [np.stack([text, s - begins[text], e - begins[text], q])]
    texts = np.arange(len(sizes))  # those still long enough
    t, fragments = 1, _mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    while t < SMALL:
        fragments, t = _doubled(fragments, t), 2 * t
    while True:
        enough = sizes[texts] >= EXPONENT * (t + 1)
        if not enough.all():
            stay = np.repeat(enough, sizes[texts] + 1)
            codes, fragments, texts = codes[stay], fragments[stay], texts[enough]
        if not len(texts):
            break
        begins = np.cumsum(sizes[texts] + 1) - sizes[texts] - 1
        region = np.concatenate(found, axis=1)
        where = np.minimum(np.searchsorted(texts, region[0]), len(texts) - 1)
        here = texts[where] == region[0]
        shift = begins[where[here]]
        places = _synchronising(fragments, t, region[1, here] + shift, region[2, here] + shift, region[3, here])
        contexts = _doubled(fragments, t)
        own = contexts[places]
        order = np.argsort(own, kind="stable")
        first, second = places[order[:-1]], places[order[1:]]
        d = second - first
        pair = (own[order[:-1]] == own[order[1:]]) & (d > t) & (d <= 2 * t)
        first, d = first[pair], d[pair]
        text = np.searchsorted(begins, first, "right") - 1
        by = np.lexsort((first, d, text))
        first, d, text = first[by], d[by], text[by]
        cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(text) != 0)) + 1
        for at in np.split(np.arange(len(d)), cuts) if len(d) else []:
            k, period = text[at[0]], int(d[at[0]])
            s, e = _verified(codes[begins[k] : begins[k] + sizes[texts[k]]], first[at] - begins[k], period)
            found.append(np.stack([np.full(len(s), texts[k]), s, e, np.full(len(s), period)]))
        fragments, t = contexts, 2 * t
    text, s, e, q = np.concatenate(found, axis=1)
    whole = e - s >= np.maximum(MIN_WORDS, EXPONENT * q)
    by = np.lexsort((q[whole], s[whole], text[whole]))
    return text[whole][by], s[whole][by], (e - s)[whole][by], q[whole][by]


def _collapsed(words: list[bytes], starts: list[int], ends: list[int]) -> bytes:
    """The words without those from starts to ends, joined by one space."""
    if not starts:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, runs (start, length, period; by start, then period) and collapsed,
    the words that no run repeats, joined by one space."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id), text_of(text).cast("binary").alias("__text"))
    schema = T.StructType([rows.schema[doc_id], *T.StructType.fromDDL(FOUND)])
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def chunk(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        codes: list[int] = []
        for i, words in enumerate(texts):
            codes += [known.setdefault(word, len(known)) for word in words]
            codes.append(-1 - i)
        where, start, length, period = find_runs(np.array(codes, np.int64), np.array([len(x) for x in texts]))
        offsets = np.searchsorted(where, np.arange(len(texts) + 1))
        cut = lambda x, i: x[offsets[i] : offsets[i + 1]].tolist()
        repeats = start + period, start + length
        left = [_collapsed(words, cut(repeats[0], i), cut(repeats[1], i)) for i, words in enumerate(texts)]
        fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields).cast(run_type)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), listed, pa.array(left, pa.binary()).cast(pa.string())], [doc_id, "runs", "collapsed"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for batch in batches:
            for i, value in enumerate(batch.column("__text")):
                words = value.as_py().split()  # bytes are split at the six ASCII blanks and nowhere else
                if texts and total + len(words) > CHUNK_WORDS:
                    yield chunk(ids, texts)
                    ids, texts, total = [], [], 0
                ids.append(batch.column(doc_id).slice(i, 1))
                texts.append(words)
                total += len(words) + 1
        if texts:
            yield chunk(ids, texts)

    return rows.mapInArrow(task, schema)


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text of every document, those chosen by crc32(doc_id) made periodic from a word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", f"[{BLANKS}]+"), ""))
    rows = documents.select("doc_id", text_of().alias("text"), F.floor(h / 10).alias("g")).withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    periodic = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op13(documents: DataFrame) -> DataFrame:
    """The counts, the run of the greatest exponent and the digests, from the runs and texts."""
    found = runs(planted(documents))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs come by start and period, so ties keep the first
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda held, x: F.when(more(x, held), x).otherwise(held))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        _digest(F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), "")).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
