"""Ranked lexical search by scanning documents with an automaton of all item terms.

No index of the documents is made. The items' distinct terms, each between two guards that stand
for a term's boundary, make an Aho-Corasick automaton; a text, its separators turned into guards, is
scanned once from end to end, and what the automaton reports are whole terms. Outputs map to the
items that have the term, with its number there. Texts are scanned twice: first for document
frequencies, the number of documents and of all terms, then for the scores, of which a task
keeps the best of each item. Only these counts and bests are shuffled.

The automaton and the map are broadcast. Items are taken in groups of at most MAX_CHARS characters
plus one item, each with an automaton and scans of its own, so what is broadcast is
bounded however many items there are. The bests of all tasks meet by item and one of SALTS
salts, and those by item.

Defined cases: a null, empty or blank text has no term, counts for nothing and is never found; rows
of items that share an id are one item with all their terms; an item without terms or without
documents has no row; repeated documents are ranked one after another; of equal scores, a null
doc_id comes last; a very long text is scanned as it stands, its terms being counted, not
gathered; empty tables give no row; columns of other names are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running, saved, small_batches, text_of

#: What separates terms: these code points and no other.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TOP = 20
#: Characters of the items whose terms one automaton holds, about: some 60 MB.
MAX_CHARS = 1 << 20
SALTS = 32

_GUARD = b" "
#: A byte of UTF-8 to itself, to lower case or to the guard; those above 0x7F belong to terms.
_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else ord(_GUARD) for b in bytes(range(256)).lower())


def _line(text: bytes) -> bytes:
    """The terms in lower case between guards."""
    return b"%c%b%c" % (_GUARD, text.translate(_BYTES), _GUARD)


def _count(line: bytes) -> int:
    """The number of terms in a line."""
    inside = np.frombuffer(line, np.uint8) != ord(_GUARD)
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


@dataclass
class Terms:
    """An automaton of the terms of some items, and for term i the items and numbers at starts[i] to
    starts[i + 1]. n_items: the number of items; ids: theirs."""

    automaton: object
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    ids: list

    @classmethod
    def of(cls, rows: list[tuple[object, list[bytes]]]) -> Terms:
        import ahocorasick

        ids = list(dict.fromkeys(i for i, _ in rows))
        place = {x: i for i, x in enumerate(ids)}
        held: dict[bytes, Counter] = {}
        for item, texts in rows:
            for term in (x for text in texts for x in _line(text).split()):
                held.setdefault(term, Counter())[place[item]] += 1
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(held):
            automaton.add_word(_line(term).decode("latin-1"), i)  # a character for each byte
        automaton.make_automaton()
        pairs = [x for own in held.values() for x in own.items()]
        items, times = np.array(pairs, np.int64).reshape(-1, 2).T
        return cls(automaton, np.cumsum([0, *map(len, held.values())]), items, times, ids)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def counted(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms in a line and how often each occurs."""
        found = Counter(map(itemgetter(1), self.automaton.iter(line.decode("latin-1"))))
        return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


class Best:
    """The highest scores of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.held: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # what a document must reach

    def add(self, item: int, score: int, doc_id) -> None:
        own = self.held[item]
        own.append((-score, doc_id is None, doc_id))
        if len(own) >= 4 * self.top:
            self.cut(item)

    def cut(self, item: int) -> None:
        own = sorted(self.held[item], key=lambda x: x if x[2] is not None else x[:2])[: self.top]
        self.held[item] = own
        if len(own) == self.top:
            self.least[item] = -own[-1][0]


def _corpus(documents: DataFrame, terms, n_terms: int) -> tuple[int, int, np.ndarray]:
    """The number of documents with terms, of all terms, and of documents with each term of the automaton."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = terms.value, np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for value in batch.column("__text"):
                line = _line(value.as_py())
                if n := _count(line):
                    seen[known.counted(line)[0]] += 1
                    seen[-2:] += (1, n)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": some, "n": seen[some]})

    sums = documents.select("__text").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of a bounded automaton
    all_counts = np.zeros(n_terms + 2, np.int64)
    for r in sums:
        all_counts[r.term] = r.n
    return int(all_counts[-2]), int(all_counts[-1]), all_counts[:-2]


def _ranked(documents: DataFrame, group: list[tuple[object, list[bytes]]], fields: list[T.StructField], top: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items of one group; fields: those of the ids of items and documents."""
    spark = documents.sparkSession
    made = Terms.of(group)
    terms = spark.sparkContext.broadcast(made)
    n_docs, n_all, df = _corpus(documents, terms, len(made))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    weights = spark.sparkContext.broadcast(weight)
    names = ["item_id", "doc_id", "score"]
    types = [T.StructField(name, x.dataType) for name, x in zip(names, fields)] + [T.StructField("score", T.LongType())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = terms.value, weights.value
        best = Best(len(known.ids), top)
        scores = np.zeros(len(known.ids), np.int64)
        id_type = None
        for batch in batches:
            ids = batch.column("__doc_id")
            id_type = ids.type
            for k, value in enumerate(batch.column("__text")):
                line = _line(value.as_py())
                found, tf = known.counted(line)
                if not len(found):
                    continue
                m = 100 - 25 + 25 * _count(line) * n_docs // n_all
                worth = w[found] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                size = known.starts[found + 1] - known.starts[found]
                at = np.repeat(known.starts[found] - np.cumsum(size) + size, size) + np.arange(size.sum())
                items = known.items[at]
                np.add.at(scores, items, np.repeat(worth, size) * known.times[at])
                touched = np.unique(items)
                for item in touched[scores[touched] >= best.least[touched]].tolist():
                    best.add(item, int(scores[item]), ids[k].as_py())
                scores[touched] = 0
        for item in range(len(known.ids)):
            best.cut(item)
        rows = [(i, doc_id, -score) for i, own in enumerate(best.held) for score, _, doc_id in own]
        if rows:
            place, found_ids, found_scores = zip(*rows)
            yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int64()), "doc_id": pa.array(found_ids, id_type), "score": pa.array(found_scores, pa.int64())})

    bests = documents.mapInArrow(task, T.StructType([T.StructField("place", T.LongType()), *types[1:]]))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    met = bests.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("place", "salt").orderBy(*order))).where(F.col("rank") <= top)
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= top)
    ids = spark.createDataFrame(list(enumerate(made.ids)), T.StructType([T.StructField("place", T.LongType()), types[0]]))
    return met.join(F.broadcast(ids), "place").select("item_id", "rank", "doc_id", "score")  # as many rows as the group has items


def _groups(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items, id and texts, in groups of bounded size."""
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if chars <= MAX_CHARS:
        whole = items.withColumn("part", F.lit(0))
    else:
        sized = items.groupBy("item_id").agg(F.sum(F.octet_length("text")).alias("size"))
        placed = running(sized, [F.col("item_id")], {"before": F.col("size")})
        part = F.floor(F.col("before") / MAX_CHARS).alias("part")
        whole = items.join(placed.select(F.col("item_id").alias("__item"), part), F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")
    whole = saved(whole.select("item_id", "text", "part"))
    last = whole.agg(F.max("part")).first()[0]
    for part in range(0 if last is None else last + 1):
        rows = whole.where(F.col("part") == part).select("item_id", "text").collect()  # bounded: see the module's docstring
        if rows:
            yield [(r.item_id, [bytes(r.text)]) for r in rows]


def rank(documents: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the documents of the highest scores above zero for each item."""
    small_batches(documents.sparkSession)
    fields = [items.schema[item_id], documents.schema[doc_id]]
    rows = documents.select(F.col(doc_id).alias("__doc_id"), text_of(text).cast("binary").alias("__text"))
    asked = items.select(F.col(item_id).alias("item_id"), text_of(item_text).cast("binary").alias("text"))
    out = None
    for group in _groups(asked):
        ranked = _ranked(rows, group, fields, top)
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        empty = T.StructType([T.StructField(n, x.dataType) for n, x in zip(("item_id", "doc_id"), fields)] + [T.StructField("score", T.LongType())])
        return documents.sparkSession.createDataFrame([], empty).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    return out


def op11(documents: DataFrame, items: DataFrame) -> DataFrame:
    return rank(documents, items)


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_all FROM d WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN size),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(terms) * n_docs) // n_all) AS m FROM d CROSS JOIN size WHERE len(terms) > 0),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM tf JOIN asked USING (term) JOIN weight USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
