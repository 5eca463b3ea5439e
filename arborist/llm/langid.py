"""Language of web pages by Bayesian fusion of evidence.

Text: log-likelihoods of hashed byte trigrams under a model of each language, counted over a
bounded sample of the documents of each language. Markup and address: how often pages of a
language declare a language, and have an address suffix, from sums of the text posteriors over all
pages. Host: a prior for each host, smoothed towards its domain's, which is smoothed towards that
of all pages. A page's own share is taken out of all these sums. The posterior is the product.

The sums are grouped aggregations with partial sums before the shuffle; hosts, domains, suffixes
and declarations join back, and a host with a third of all pages is split at run time. Every
language of the documents is known, so long as a table of them fits a task: more than
MAX_LANGUAGES are refused, none is dropped.

Defined cases: a null or empty page, or one without letters, has no text evidence; a missing
declaration or address is no evidence either; without a usable document every language is null;
repeated rows and null page_ids are rows like any other; a very long text is taken in pieces; what
follows an unclosed script, style or comment is not text; an empty table gives no row; columns of
other names are not looked at.
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

BUCKETS = 1 << 14
MAX_LANGUAGES = 4096
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """max_rows bounds, about, the documents of each language that are learned from; weight tempers
    trigrams, which aren't independent."""

    max_rows: int = 5_000
    weight: float = 0.1
    smoothing: float = 0.5
    strength: float = 4.0


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logs: np.ndarray  # BUCKETS by languages


def _letters(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with blanks for what is no letter, and which to keep: one blank of a run."""
    letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    low = np.where(letter, np.where(data < 128, data | 32, data), 32).astype(np.uint64)
    return low, letter | np.concatenate([[after_letter], letter[:-1]])


def _hashed(low: np.ndarray) -> np.ndarray:
    code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def _trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the byte trigrams of lower-cased letters and single blanks, and each one's text,
    about _CHUNK bytes of texts at a time; a longer text is cut."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1
        if to > at:
            low, keep = _letters(data[offsets[at] : offsets[to]], True)
            low, owner = low[keep], np.repeat(np.arange(at, to), np.diff(offsets[at : to + 1]))[keep]
            if len(low) > 2:
                same = owner[:-2] == owner[2:]
                yield _hashed(low)[same], owner[:-2][same]
        else:
            to, last = at + 1, np.zeros(0, np.uint64)
            for start in range(offsets[at], offsets[to], _CHUNK):
                low, keep = _letters(data[start : min(start + _CHUNK, offsets[to])], not len(last) or last[-1] != 32)
                last = np.concatenate([last[-2:], low[keep]])
                if len(last) > 2:
                    yield _hashed(last), np.full(len(last) - 2, at)
        at = to


def train(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Trigram models of the languages of documents, from about max_rows of each by a hash of id and text."""
    small_batches(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & (F.length(text_of()) > 0)).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    totals = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not totals:
        return Model([], np.zeros((BUCKETS, 0)))
    languages = sorted(totals)
    parts = F.create_map(*(F.lit(x) for name in languages for x in (name, round(min(1.0, settings.max_rows / totals[name]) * (1 << 20)))))
    sample = known.where(F.pmod("h", F.lit(1 << 20)) < parts[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for buckets, owner in _trigrams(batch.column("text")):
                for i in np.unique(of[owner]):
                    own = np.bincount(buckets[of[owner] == i], minlength=BUCKETS)
                    sums[names[i]] = sums.get(names[i], 0) + own
        for name, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(some), "bucket": some, "n": own[some]})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages)), settings.smoothing)
    got = counts.toArrow()  # BUCKETS rows a language at most
    place = {name: i for i, name in enumerate(languages)}
    table[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)))


def text_evidence(text: Column, model: Model, settings: Settings = Settings()) -> Column:
    """Tempered log-likelihoods of a text by language, the largest 0."""
    logs = model.logs.astype(np.float32)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(texts: pa.Array) -> pa.Array:
        sums = np.zeros((len(texts), logs.shape[1]))
        for buckets, owner in _trigrams(texts):
            first, n = owner[0] if len(owner) else 0, owner[-1] + 1 if len(owner) else 0
            for k in range(logs.shape[1]):
                sums[first:n, k] += np.bincount(owner - first, weights=logs[buckets, k], minlength=n - first)
        sums = settings.weight * (sums - sums.max(axis=1, keepdims=True))
        return pa.array(list(sums), pa.list_(pa.float64()))

    return of(text)


def visible(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags; each pattern passes over it once."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?s)<[^<>]*>?", " "), r"&#?\w{1,10};", " ")


def clues(pages: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """page_id, declared, host, domain, suffix, logs (text evidence), row."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    rows = pages.select("page_id", declared.alias("declared"), host.alias("host"), text_evidence(visible(text_of("html")), model, settings).alias("logs"))
    rows = rows.withColumns({"domain": F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)\.?$", 1), F.lit("")), "suffix": F.nullif(F.regexp_extract("host", r"([^.]+)\.?$", 1), F.lit(""))})
    return rows


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def identify(pages: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """page_id, lang, confidence, declared, host of every page."""
    n = len(model.languages)
    if not n:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    rows = saved(clues(pages, model, settings).withColumn("p", _softmax(F.col("logs"))))
    sums = F.array(*(F.sum(F.col("p")[k]) for k in range(n)))
    whole = rows.agg(F.coalesce(sums, F.array_repeat(F.lit(0.0), n)).alias("sums"), F.count("*").alias("rows")).first()
    mass = np.asarray([x or 0.0 for x in whole.sums]) + settings.smoothing
    rest = F.zip_with(F.array(*map(F.lit, mass.tolist())), "p", lambda v, q: F.greatest(v - q, F.lit(settings.smoothing)))
    met_total = F.aggregate(F.col("rest"), F.lit(0.0), lambda a, v: a + v)
    prior = F.transform("rest", lambda v: v / met_total)
    k = settings.strength

    def grouped(by: str) -> DataFrame:
        return saved(rows.where(F.col(by).isNotNull()).groupBy(by).agg(sums.alias(f"{by}_sums"), F.count("*").alias(f"{by}_n")).withColumnRenamed(by, f"{by}_key"))

    def others(by: str) -> Column:
        """The group's sums without the page's own share."""
        return F.zip_with(f"{by}_sums", "p", lambda v, q: F.greatest(v - q, F.lit(0.0)))

    def likelihood(by: str) -> Column:
        """log P(value | language): the value's soft count among the language's, smoothed to its share of all pages."""
        share = F.col(f"{by}_n") / F.lit(float(max(whole.rows, 1)))
        logs = F.zip_with(others(by), "rest", lambda v, all_: F.ln((v + k * share) / (all_ + k)))
        return F.when(F.col(f"{by}_n").isNotNull(), logs).otherwise(F.array_repeat(F.lit(0.0), n))

    def smoothed(by: str, parent: Column) -> Column:
        mixed = F.zip_with(others(by), parent, lambda v, q: (v + k * q) / (F.col(f"{by}_n") - 1 + k))
        return F.when(F.col(f"{by}_n").isNotNull(), mixed).otherwise(parent)

    met = rows.withColumn("rest", rest)
    for by in ("declared", "suffix", "domain", "host"):
        met = met.join(grouped(by), F.col(by) == F.col(f"{by}_key"), "left")
    met = met.withColumn("host_prior", smoothed("host", smoothed("domain", prior)))
    parts = (F.col("logs"), likelihood("declared"), likelihood("suffix"), F.transform("host_prior", F.ln))
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    met = met.withColumn("posterior", _softmax(total))
    names = F.array(*map(F.lit, model.languages))
    at = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return met.select("page_id", F.element_at(names, at).alias("lang"), F.array_max("posterior").alias("confidence"), "declared", "host")


def op7(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The language of every page, with the model of the documents' languages."""
    return identify(pages, train(documents))
