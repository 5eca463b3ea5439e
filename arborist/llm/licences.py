"""Licence scans by a positional index of rare words.

Templates are a table: label, notice, mandatory key phrases. Each template's rarest words, by
inverse document frequency over all documents, are indexed with their positions. Texts are taken
apart once; of each, the words that any template has are kept with their places, as columns of a
written table. The index looks up the rare ones: each posting votes for (template, place in the
document where the template would begin), and the votes of one place are the template's positions
found there in the right order and distance. Where at least `coverage` of a template's indexed
positions agree, its mandatory key phrases are verified on the kept words of that document, and
only there. Plain phrases (the base) are found where their words stand consecutively.

The index has a few words for each template, whatever the corpus; the words of the templates are
read by the driver. No join is forced to broadcast: tables are written, so Spark knows their sizes.

Defined cases: null and empty texts have no word and no label, n_words 0 and score 0; repeated
rows are rows like any other; overlapping and repeated phrases all count; a very long text is one
row of arrays; an empty table gives no row; columns of other names are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_az, stored, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, notice, mandatory key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    ("mit", "released under the mit license", ("under the mit license",)),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("apache", "licensed under the apache license version 2 0", ("under the apache license",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("to deal in the software without restriction",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("unless required by applicable law or agreed to in writing",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license", "in the hope that it will be useful")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
)
COVERAGE = 0.6


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text), SEPARATORS), "")


def _phrase_places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, by their first word."""
    parts = phrase.split()
    last = len(parts) - 1

    def start(word: Column, i: Column) -> Column:
        found = word == parts[last]
        for k, part in enumerate(parts[:last]):
            found = found & F.coalesce(F.get(words, i - last + k) == part, F.lit(False))
        return F.when(found, i - last)

    return F.when(F.array_contains(words, parts[last]), F.filter(F.transform(words, start), F.isnotnull)).otherwise(F.array().cast("array<int>"))


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, notice, keys: one row for each template."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(label)}, {quote(notice)}, array({', '.join(map(quote, keys))}))" for i, (label, notice, keys) in enumerate(templates))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, notice, keys)")


def known_words(templates: DataFrame) -> list[str]:
    """The distinct words of all templates and their key phrases, for the driver: templates are few."""
    lines = templates.select(F.explode(F.array_append("keys", F.col("notice"))).alias("line"))
    return sorted(r.word for r in lines.select(F.explode(F.split("line", " ")).alias("word")).distinct().collect())


def taken_apart(documents: DataFrame, known: list[str], phrases: dict[str, str] = PHRASES) -> DataFrame:
    """row, doc_id, n_words, p0, p1, ... (places of phrases), hit_words and hit_at (the known words
    and where they stand) of every document: the one pass over the texts, written."""
    texts = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(text_of()).alias("words"))
    hit = F.transform("words", lambda word, i: F.when(word.isin(known), F.struct(word.alias("word"), i.alias("at"))))
    texts = texts.withColumn("hits", F.filter(hit, F.isnotnull))
    base = (_phrase_places(F.col("words"), phrase).alias(f"p{i}") for i, phrase in enumerate(phrases))
    return stored(texts.select("row", "doc_id", F.size("words").alias("n_words"), *base, F.col("hits.word").alias("hit_words"), F.col("hits.at").alias("hit_at")), "licence-words")


def rare_words(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """template, word, position, n_indexed of each template's rarest words, three fifths of its words, at most eight.

    Rarity is the number of documents with the word, over all documents; ties go by word. n_indexed:
    the positions of the template that the index has.
    """
    notices = templates.select("template", F.posexplode(F.split("notice", " ")).alias("position", "word"))
    frequency = texts.select(F.explode(F.array_distinct("hit_words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    distinct = notices.select("template", "word").distinct().join(frequency, "word", "left").na.fill(0, ["df"])
    own = Window.partitionBy("template")  # a template's words
    ranked = distinct.withColumns({"rank": F.row_number().over(own.orderBy("df", "word")), "n": F.count("*").over(own)})
    chosen = ranked.where(F.col("rank") <= F.least(F.ceil(F.col("n") * 3 / 5), F.lit(8))).select("template", "word")
    return notices.join(chosen, ["template", "word"]).withColumn("n_indexed", F.count("*").over(own))


def _stands(key: Column) -> Column:
    """Whether a key phrase (array of words) stands in the text: all its words are known, so they
    are neighbours among the hits, one place apart."""

    def begins(i: Column) -> Column:
        agrees = lambda k: (F.get("hit_words", i + k) == F.get(key, k)) & (F.get("hit_at", i + k) == F.get("hit_at", i) + k)
        return F.forall(F.sequence(F.lit(0), F.size(key) - 1), lambda k: F.coalesce(agrees(k), F.lit(False)))

    return F.exists(F.sequence(F.lit(0), F.size("hit_words") - 1), begins)


def scan(documents: DataFrame, templates: DataFrame | None = None, phrases: dict[str, str] = PHRASES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, p0, p1, ... (places of phrases), found and share (labels and greatest coverage
    of templates) of every document."""
    templates = templates if templates is not None else templates_table(documents.sparkSession)
    texts = taken_apart(documents, known_words(templates), phrases)
    postings = stored(rare_words(texts, templates), "licence-index")
    hits = texts.select("row", F.explode(F.arrays_zip("hit_words", "hit_at")).alias("hit")).select("row", F.col("hit.hit_words").alias("word"), F.col("hit.hit_at").alias("at"))
    votes = hits.join(postings, "word")
    # a place's votes come from different positions, as each position has one word
    places = votes.groupBy("row", "template", (F.col("at") - F.col("position")).alias("begins")).agg(F.count("*").alias("agree"), F.first("n_indexed").alias("n_indexed"))
    scored = places.withColumn("share", F.col("agree") / F.col("n_indexed")).where(F.col("share") >= coverage)
    candidates = stored(scored.groupBy("row", "template").agg(F.max("share").alias("share")), "licence-candidates")
    asked = candidates.join(templates.select("template", "label", "keys"), "template")
    met = texts.select("row", "hit_words", "hit_at").join(asked, "row")
    verified = met.where(F.forall("keys", lambda key: _stands(F.split(key, " "))))
    found = stored(verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share")), "licence-found")
    return texts.drop("hit_words", "hit_at").join(found, "row", "left").drop("row")


def op2(documents: DataFrame) -> DataFrame:
    """Words, phrase places, labels and score of every document."""
    places = F.flatten(F.array(*(F.col(f"p{i}") for i in range(len(PHRASES)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    scanned = scan(documents).withColumns({"places": places, "base": F.array_sort(F.array_distinct(base))})
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return scanned.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """The same rows in DuckDB: relational throughout, with every word as a row."""
    quote = lambda x: "'" + x + "'"
    notices = ", ".join(f"({t}, {quote(label)}, {quote(text)})" for t, (label, text, _) in enumerate(TEMPLATES))
    keys = ", ".join(f"({t}, {quote(key)})" for t, (_, _, keys) in enumerate(TEMPLATES) for key in keys)
    phrases = ", ".join(f"({quote(phrase)}, {quote(label)})" for phrase, label in PHRASES.items())
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
line AS (SELECT r, ' ' || array_to_string(words, ' ') || ' ' AS line FROM d),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
phrase AS (SELECT phrase, label, string_split(phrase, ' ') AS parts FROM (VALUES {phrases}) t(phrase, label)),
base AS (
  SELECT w.r, w.pos, p.label FROM w JOIN phrase p ON w.word = p.parts[1] JOIN d USING (r)
  WHERE d.words[w.pos + 1 : w.pos + len(p.parts)] = p.parts),
bases AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM base GROUP BY r),
notice AS (SELECT t, label, string_split(text, ' ') AS words FROM (VALUES {notices}) t(t, label, text)),
tw AS (SELECT t, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS position FROM notice),
df AS (SELECT word, count(DISTINCT r) AS df FROM w WHERE word IN (SELECT word FROM tw) GROUP BY word),
ranked AS (
  SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS rank, count(*) OVER (PARTITION BY t) AS n
  FROM (SELECT DISTINCT t, word FROM tw) LEFT JOIN df USING (word)),
idx AS (SELECT tw.t, tw.word, tw.position FROM tw JOIN ranked USING (t, word) WHERE rank <= least(ceil(n * 3 / 5), 8)),
need AS (SELECT t, key FROM (VALUES {keys}) k(t, key)),
verified AS (
  SELECT r, t FROM line CROSS JOIN need GROUP BY r, t HAVING bool_and(contains(line, ' ' || key || ' '))),
votes AS (
  SELECT r, t, pos - position AS begins, count(DISTINCT position) AS agree
  FROM w JOIN idx USING (word) JOIN verified USING (r, t) GROUP BY r, t, pos - position),
scored AS (SELECT r, t, agree / (SELECT count(*) FROM idx i WHERE i.t = votes.t) AS share FROM votes),
found AS (SELECT r, label, share FROM scored JOIN notice USING (t) WHERE share >= {COVERAGE}),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r),
based AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
shares AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN bases USING (r) LEFT JOIN labelled USING (r) LEFT JOIN based USING (r) LEFT JOIN shares USING (r)
"""


SQL = _sql()
