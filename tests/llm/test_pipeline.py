"""The pipeline against its parts and a brute-force version of each stage's decision."""

from collections import defaultdict

import corpus_pipeline
from arborist.llm import mixing, quality
from arborist.llm.common import saved, table
from tests.llm.test_operators import blank_words, brute_fingerprint, lower

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == columns
        kept.append(docs.collect())
    good, exact, near, mix = kept
    score = {r.doc_id: r.score for r in quality.op1(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in good} == {i for i, s in score.items() if s >= 0.7}
    largest = {}
    for r in good:
        largest[lower(r.text)] = max(largest.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(largest.values())
    prints = {r.doc_id: brute_fingerprint(r.text) for r in exact}
    ids = sorted(prints)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    assert sorted(r.doc_id for r in near) == sorted(set(group.values()))
    words = defaultdict(int)
    for r in mix:
        words[r.source] += len(blank_words(r.text))
    near_df = spark.createDataFrame(near, docs.schema)
    for r in mixing.op3(near_df).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= 1
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(mix)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens"} <= set(got.columns) and got.count() > 0


def test_awkward_rows_through_all_stages(spark, tmp_path):
    """Nulls, repeats, an id with two texts and columns with clashing names; then empty tables."""
    good = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    rows = [(i, text, "en", f"s{i % 2}", len(text), "k", 1) for i, text in enumerate(good)]
    rows += [(None, good[0] + " of no id", None, None, None, None, None), (None, good[1] + " of no id either", None, None, 3, None, None), (5, good[2] + " a second text of five", "en", "s0", 9, "k", 1)]
    rows += [rows[3], (None, None, None, None, None, None, None), (900, "", "en", "s1", 0, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, row long")
    labels = table(spark, SF, "labels")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, saved(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns
        kept.append(docs.select("doc_id", "text").collect())
    quality_kept, exact, near, _ = kept
    # of rows with one text the largest id stays; rows without an id are no repeats of each other
    largest = {}
    for r in quality_kept:
        key = lower(r.text)
        largest[key] = max(largest.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    want = {(None if i < 0 else i, key) for key, i in largest.items()}
    assert {(r.doc_id, lower(r.text)) for r in exact} == want and len(exact) == len(want)
    prints = [brute_fingerprint(r.text) for r in exact]
    groups = list(range(len(exact)))
    for a in range(len(exact)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and groups[a] != groups[b]:
                old, new = groups[a], groups[b]
                groups = [new if g == old else g for g in groups]
    assert len(near) == len(set(groups)) and {(r.doc_id, r.text) for r in near} <= {(r.doc_id, r.text) for r in exact}
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()

    nothing = f"{tmp_path}/nothing"
    table(spark, str(tmp_path), "documents").limit(0).write.parquet(f"{nothing}/documents.parquet")
    labels.limit(0).write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).count() == 0
