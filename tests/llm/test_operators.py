"""The operators against brute force on a small fixture with awkward rows, and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from arborist.llm import bpe, embeddings, exact_dedup, langid, licences, mixing, quality, sharding, simhash, warc
from arborist.llm.common import table
from arborist.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, words string, size long, fp long"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return [w for w in BLANK.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "é", "ß", "mit", "license", "x1", "public", "general", "apache", "--", "!!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "A", "a", "MIT License MIT license", "general public license", "Apache License, Version 2.0", "one two"]
    texts += [texts[0].upper(), texts[0], texts[1], "z " * 20000, "<|endoftext|> a<|endoftext|>", "it's  we'll\n\n x　 ࡰ"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "d", "w", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "en", "s1", 5, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_held_out(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    got = quality.op1(table(spark, d, "documents"), labels)
    seen = got.join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert seen >= 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_awkward_rows(docs, none):
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.op1(docs, labels)
    assert got.count() == docs.count()
    assert got.where("doc_id is null and held_out").count() == 0
    assert quality.op1(none, labels).count() == 0
    assert {r.score for r in quality.op1(docs, labels.limit(0)).collect()} == {0.5}


def test_hashed_grams_do_not_depend_on_the_batch():
    texts = [b"a b a", b"", b"x  y!! z", "é ü".encode()]
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    together, counts = quality._features(whole, ends, 12)
    assert counts.tolist() == [5, 0, 7, 3]
    alone = [quality._features(np.frombuffer(t, np.uint8), np.array([len(t)]), 12)[0].tolist() if t else [] for t in texts]
    assert [x.tolist() for x in np.split(together, np.cumsum(counts)[:-1])] == alone


def test_licences(docs, none):
    got = rows_of(licences.op2(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        hits = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want[(r.doc_id, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))] += 1
    assert got == want
    assert licences.op2(none).count() == 0


def test_licence_templates(spark):
    texts = ["x " * 500 + notice.upper() + " y" for _, notice, _ in licences.TEMPLATES] + ["under the license of free charge"]
    got = {r.doc_id: r for r in licences.op2(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score > 0.9
    assert got[len(texts) - 1].labels == "" and got[len(texts) - 1].score == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        open_ = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return share | stopped
        stopped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["docs", "table"])
def test_mixing(spark, docs, none, which):
    given = docs if which == "docs" else table(spark, SF, "documents")
    got = mixing.op3(given).collect()
    assert len(got) == given.count()
    sizes = defaultdict(int)
    for r in given.collect():
        sizes[r.source] += len(blank_words(r.text))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    mix = defaultdict(int)
    for r in mixing.mixed(given).collect():
        mix[r.source] += len(blank_words(r.text))
    assert {k: v for k, v in mix.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mixed(given).columns == given.columns
    assert mixing.op3(none).count() == 0 and mixing.mixed(none).count() == 0


def test_permutations_hold_every_index_once(spark):
    for n in (1, 2, 3, 7, 100, 101, 1023, 5000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(lower(r.text).encode()).hexdigest()].append(r.doc_id)
    want = Counter()
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, digest)] += 1
    assert rows_of(exact_dedup.op4(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.op4(none).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_digest_index_outlives_a_batch(spark, docs):
    first = exact_dedup.DigestIndex(spark)
    exact_dedup.deduplicate(docs.where("doc_id < 30"), first).count()
    again = exact_dedup.DigestIndex(spark, first.path)
    got = exact_dedup.deduplicate(docs.where("doc_id < 60").select((F.col("doc_id") + 1000).alias("doc_id"), "text"), again)
    assert got.where("keep_id < 30").count() >= 30 and got.where("kept and keep_id < 30").count() == 0
    assert again.rows().count() == again.rows().select("digest").distinct().count()
    plan = exact_dedup.new_groups(exact_dedup.signatures(docs), again)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_warc(spark):
    big, small = "é" * 600, "p" * 999
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", small), (4, "u", small), (5, "v", None), (6, "w", "WARC/1.1\r\n\r\n" * 200)]
    rows += [(2, None, big), (None, "n", big), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(raw) >= 1000 and i != max(same)
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None)] += 1
    assert rows_of(warc.op5(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.op5(pages.limit(0)).count() == 0


def test_warc_pushes_down_and_skips(spark):
    warc.register(spark)
    path = warc.shared_path(spark, "warc-test")
    warc.archived(table(spark, SF, "pages")).write.format("warc").mode("append").save(path)
    heads = spark.read.format("warc").schema("record_id string, record_type string, target_uri string").load(path)
    few = heads.where("record_type = 'response' and target_uri like 'https://%'")
    assert few.count() == table(spark, SF, "pages").where("url like 'https://%'").count()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "record_type#" in plan and "= response" not in plan


def brute_components(ids, linked):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 20))
    rows = [(i, int(i % 2), [float(x) for x in base[i // 3] + rng.normal(size=20) * 0.02 * (i % 3)]) for i in range(90)]
    rows += [(100, 0, None), (101, 0, [0.0] * 20), (102, None, rows[0][2]), (103, 0, [float("nan")] * 20), (104, 0, [None] + [1.0] * 19)]
    rows += [(105, 0, rows[0][2]), rows[0], (None, 0, rows[0][2]), (106, 0, rows[0][2][:10]), (107, 0, []), (108, 0, [float("inf")] * 20)]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    f32 = [np.asarray(v, dtype=np.float32).astype(float) if v and None not in v else None for _, _, v in rows]
    good = [v is not None and np.isfinite(v).all() and v.any() and rows[i][1] is not None for i, v in enumerate(f32)]
    linked = []
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][1] == rows[b][1] and len(f32[a]) == len(f32[b]):
                if f32[a] @ f32[b] / np.sqrt((f32[a] @ f32[a]) * (f32[b] @ f32[b])) >= 0.98:
                    linked.append((a, b))
    links = Counter(x for pair in linked for x in pair)
    component = brute_components([r[0] for r in rows], linked)
    want = Counter((rows[i][0], links[i], component[i], rows[i][0] == component[i]) for i in range(len(rows)))
    assert rows_of(embeddings.op6(given), "vec_id", "n_links", "component_id", "kept") == want
    assert embeddings.op6(given.limit(0)).count() == 0


def test_a_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, 1, [float(x) for x in base + rng.normal(size=16) * 0.005]) for i in range(60)]
    got = embeddings.op6(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


@pytest.mark.parametrize("which", ["docs", "table"])
def test_sharding(spark, docs, none, which):
    given = docs if which == "docs" else table(spark, SF, "documents")
    got = sharding.op8(given, 5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in given.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in range(5):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= max(r.size for r in got)
    assert sharding.op8(none).count() == 0


def test_rebalancing_edits_the_map(spark):
    slots = sharding.slot_bytes(sharding.records(table(spark, SF, "documents"), 256), 256)
    old = sharding.first_map(slots, 8)
    new = sharding.rebalanced(slots, old, 9)
    before, after = ({r.virtual_slot: r.shard for r in x.collect()} for x in (old, new))
    moved = {s for s in before if before[s] != after[s]}
    assert len(after) == 256 and moved and {after[s] for s in moved} == {8}
    assert len(moved) < 0.35 * 256


def brute_fingerprint(text):
    w = blank_words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["docs", "table"])
def test_simhash(spark, docs, none, which):
    given = docs if which == "docs" else table(spark, SF, "documents")
    rows = given.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    component = brute_components([r.doc_id for r in rows], linked)
    want = Counter((rows[i].doc_id, f"{prints[i]:016x}", component[i]) for i in range(len(rows)))
    assert rows_of(simhash.op9(given), "doc_id", "fingerprint", "component_id") == want
    assert simhash.op9(none).count() == 0
    assert simhash.keep_one(given).columns == given.columns


def test_every_pair_within_two_bits_meets(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ (1 << 63) for b in base] + [b ^ 0b111 for b in base]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    for blocks in (None, 2, 3):
        assert {(r.u, r.v) for r in simhash.links(nodes, blocks=blocks).collect()} == want
    assert simhash.anchored(nodes, blocks=3).count() < 300 * len(signed)


def test_fingerprints_go_to_few_anchors(spark, monkeypatch):
    """Six anchors a fingerprint, whatever the table's size: a third code's 250 of each were too many at 6 GB."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 4)} | {base[0] ^ 1 << i for i in range(64)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    monkeypatch.setattr(simhash, "anchored", None)  # no codes
    for threshold in (1, 2, 3):
        want = Counter((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= threshold)
        assert Counter((r.u, r.v) for r in simhash.links(nodes, threshold).collect()) == want
        assert simhash.meeting(nodes, threshold).count() == len(signed) * (threshold + 2) * (threshold + 1) // 2


def test_texts_are_hashed_together(monkeypatch):
    """Fingerprints don't depend on which texts are hashed together, nor in how many pieces."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcXYZé\u00a0") for _ in range(rng.randint(1, 30)))
    texts = ["", " ", "a", "A b", "a\x0bb\x0c\tc d", "w " * 700, "\u0085 \u2003", "x" * 90, *("  ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(60))]
    want = [brute_fingerprint(t) for t in texts]
    for together, piece in ((1 << 18, 1 << 13), (2000, 100), (1, 7)):
        monkeypatch.setattr(simhash, "TOGETHER", together)
        monkeypatch.setattr(simhash, "PIECE", piece)
        got = [v for some in simhash._together(pa.array([t.encode() for t in texts])) for v in simhash._fingerprints_of(some).tolist()]
        assert [v % (1 << 64) for v in got] == want


def test_the_code_is_perfect():
    for code in simhash.BLOCKS:
        words = [bits for k in range(code.radius + 1) for bits in simhash.combinations(range(code.length), k)]
        assert len(words) == len({code.syndrome_of(sum(1 << b for b in bits)) for bits in words}) == 2**code.parities


@pytest.mark.parametrize("which", ["docs", "table"])
def test_bpe(spark, docs, none, which):
    from tokenizers import Tokenizer

    given = docs if which == "docs" else table(spark, SF, "documents")
    path = tokenizer_path()
    made = Tokenizer.from_file(path)
    want = Counter()
    for r in given.collect():
        ids = made.encode(r.text or "", add_special_tokens=False).ids
        back = made.decode(ids, skip_special_tokens=False)
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert rows_of(bpe.op10(given, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.op10(none, path).count() == 0


def test_bpe_round_trip(docs):
    vocabulary = bpe.Vocabulary(tokenizer_path())
    back = bpe.encode(docs, vocabulary).select("doc_id", bpe.decode(F.col("ids"), vocabulary).alias("text"))
    assert rows_of(back, "doc_id", "text") == rows_of(docs.na.fill("", ["text"]), "doc_id", "text")


def test_language_id_held_out(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(d.where("doc_id % 2 = 0"))
    pages = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.com/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.col("lang").alias("truth"))
    got = langid.identify(pages.drop("truth"), model).join(pages.select("page_id", "truth"), "page_id")
    assert got.where("lang = truth").count() >= 0.95 * pages.count()


def test_language_id_fuses_evidence(spark):
    texts = [("le chat et la souris dans la maison " * 5, "fr"), ("the cat and the mouse in the house " * 5, "en")] * 10
    model = langid.train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string"))
    page = lambda text, lang: f'<html lang="{lang}"><script>the the the</script><body>{text}</body></html>'
    rows = [(i, f"http://h{i % 2}.example.{'fr' if i % 2 else 'com'}/", page(texts[1 - i % 2][0], "fr" if i % 2 else "en")) for i in range(20)]
    rows = [(i, u, h.replace(texts[0][0], "@").replace(texts[1][0], texts[0][0] if i % 2 else texts[1][0]).replace("@", texts[0][0] if i % 2 else texts[1][0])) for i, u, h in rows]
    rows += [(100, "http://h1.example.fr/x", page("", "fr")), (101, "http://h0.example.com/y", "<html></html>"), (102, None, None), (None, "not an address", ""), rows[0]]
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert [got[i].lang for i in range(4)] == ["en", "fr", "en", "fr"]
    assert got[100].lang == "fr" and got[101].lang == "en" and 0 < got[102].confidence <= 1 and got[None].host is None
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(empty, model).count() == 0
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), none).collect()} == {None}


def test_dedup_stages_tell_rows_of_one_id_apart(spark):
    """Rows without an id, and an id with two texts, stay or go each by its own text."""
    near = " ".join(f"word{i}" for i in range(2000))
    rows = [(None, "no id one"), (None, "no id two"), (None, "taken by an id"), (1, "taken by an id"), (5, "first text of five"), (5, "second text of five"), (5, "first text of five"), (9, "second text of five")]
    rows += [(3, near), (4, near + " more"), (4, "a text that only four has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = rows_of(exact_dedup.keep_first(docs), "doc_id", "text")
    assert exact == Counter({r: 1 for r in rows} | {(None, "taken by an id"): 0, (5, "second text of five"): 0}) - Counter()
    same = spark.createDataFrame([(None, "same"), (None, "same"), (None, "other")], "doc_id long, text string")
    assert rows_of(exact_dedup.keep_first(same), "text") == {("same",): 2, ("other",): 1}
    prints = {t: int(r.fingerprint, 16) for (_, t), r in zip(rows, simhash.op9(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).orderBy("doc_id").collect())}
    assert (prints[near] ^ prints[near + " more"]).bit_count() <= 2
    kept = rows_of(simhash.keep_one(docs), "doc_id", "text")
    assert kept == Counter({(None, "no id one"): 1, (None, "no id two"): 1, (1, "taken by an id"): 1, (5, "first text of five"): 1, (5, "second text of five"): 1, (3, near): 1, (4, "a text that only four has"): 1})
    assert rows_of(simhash.keep_one(same), "text") == {("same",): 1, ("other",): 1}


def brute_grams(text, bits):
    """Buckets of one text's words and pairs of words, word by word in whole numbers."""
    mask, prime = (1 << 64) - 1, quality._PRIME
    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", text)
    hashes = [sum((b + 1) * pow(prime, i, 1 << 64) for i, b in enumerate(run)) & mask for run in runs]
    pairs = [12345 if a == b else (a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9) & mask for a, b in zip(hashes, hashes[1:])]
    return [(((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & mask) >> (64 - bits) for h in hashes + pairs]


def brute_scores(rows, labels, s):
    """FTRL-proximal as its paper has it, a coordinate at a time; rows are (doc_id, text), one a doc_id."""
    grams = {i: brute_grams((t or "").encode(), s.bits) for i, t in rows}
    vectors = {i: {b: n / max(len(g), 1) ** 0.5 for b, n in Counter(g).items()} | {1 << s.bits: 1.0} for i, g in grams.items()}

    def weight(z, n, k):
        if abs(z[k]) <= s.l1:
            return 0.0
        return -(z[k] - (1 if z[k] > 0 else -1) * s.l1) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    def chance(z, n, x):
        return 1 / (1 + np.exp(-sum(v * weight(z, n, k) for k, v in x.items())))

    z, n = defaultdict(float), defaultdict(float)
    for _ in range(s.rounds):
        ends = []
        for share in labels:  # labels: shares of (doc_id, label) in their order
            own_z, own_n = z.copy(), n.copy()
            for i, label in share:
                p = chance(own_z, own_n, vectors[i])
                old = {k: weight(own_z, own_n, k) for k in vectors[i]}
                for k, v in vectors[i].items():
                    g = (p - label) * v
                    own_z[k] += g - ((own_n[k] + g * g) ** 0.5 - own_n[k] ** 0.5) / s.alpha * old[k]
                    own_n[k] += g * g
            ends.append((own_z, own_n))
        z, n = (defaultdict(float, {k: sum(e[j][k] for e in ends) / len(ends) for k in set().union(*(e[j] for e in ends))}) for j in (0, 1))
    return {i: chance(z, n, x) for i, x in vectors.items()}


def test_quality_against_a_plain_loop(spark, docs):
    settings = quality.Settings(bits=10, partitions=2, rounds=2)
    some = docs.where("doc_id is not null and doc_id < 40").dropDuplicates(["doc_id"]).select("doc_id", "text")
    labels = some.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    order = quality.training_rows(some, labels, settings).select("doc_id", "label", F.xxhash64("doc_id", F.lit(7)).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("share"))
    sample = sorted(order.collect(), key=lambda r: (r.h, r.doc_id))
    assert {r.doc_id for r in sample} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    shares = [own for k in range(2) if (own := [(r.doc_id, r.label) for r in sample if r.share == k])]
    want = brute_scores([(r.doc_id, r.text) for r in some.collect()], shares, settings)
    for r in quality.classify(some, labels, settings).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-5)


def test_quality_does_not_depend_on_the_layout(spark):
    d, labels = (table(spark, SF, name) for name in ("documents", "labels"))
    d = d.unionByName(d.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" again"))))
    scores = [rows_of(quality.classify(x, y), "doc_id", "score") for x, y in ((d, labels), (d.repartition(13), labels.repartition(5)))]
    assert scores[0] == scores[1]


def test_a_long_text_is_taken_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["", "ab  cd!!ef " * 30, "w" * 100, " " * 90 + "x y" + " " * 90, "short one", "é" * 70 + " é"]
    whole = quality._rows(pa.array(texts), [0.0] * len(texts), 12)
    monkeypatch.setattr(quality, "_CHUNK", 16)
    cut = quality._rows(pa.array(texts), [0.0] * len(texts), 12)
    for text, (a, b, _), (c, d, _) in zip(texts, whole, cut):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
        assert a.tolist()[:-1] == sorted(set(brute_grams(text.encode(), 12)))
    weights = np.random.default_rng(0).normal(size=(1 << 12) + 1)
    together = quality.margins(pa.array(texts), weights, 12)
    monkeypatch.undo()
    assert np.allclose(together, quality.margins(pa.array(texts), weights, 12))


def test_bpe_of_many_blocks(docs, monkeypatch):
    """Blocks of a few words, met in runs of two: the same ids."""
    vocabulary = bpe.Vocabulary(tokenizer_path())
    few = docs.where("length(text) < 1000")
    want = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(few, vocabulary).collect())
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 30)
    monkeypatch.setattr(bpe, "SLICE", 4)
    monkeypatch.setattr(bpe, "MET_BLOCKS", 2)
    assert Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(few, vocabulary).collect()) == want


def planted(rng, n, width, sparse=False):
    """n pairs of vectors of cosine 0.98 or a little more."""
    out = []
    for _ in range(n):
        a = rng.normal(size=width) * (rng.random(width) < 0.1 if sparse else 1)
        a[rng.integers(width)] += 1
        a /= np.linalg.norm(a)
        b = rng.normal(size=width)
        b -= (b @ a) * a
        c = rng.uniform(0.9801, 0.985)
        out += [a, c * a + (1 - c * c) ** 0.5 * b / np.linalg.norm(b)]
    return out


@pytest.mark.parametrize("width, sparse", [(8, False), (64, False), (64, True), (200, False)])
def test_recall_of_buckets(width, sparse):
    """Of pairs just above the threshold, how many share a bucket in some table."""
    vectors = np.asarray(planted(np.random.default_rng(width), 1000, width, sparse))
    found = embeddings.buckets(vectors)
    a, b = found[0::2], found[1::2]
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.97


def test_recall_of_planted_pairs(spark):
    vectors = planted(np.random.default_rng(0), 300, 48)
    rows = [(i, f"label {i // 2 % 3}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in embeddings.op6(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert sum(got[i].n_links for i in got) >= 0.97 * len(rows)
    assert all(got[i].component_id in (i, i - i % 2) for i in got)


def test_shards_decide_the_mix(spark):
    """Each shard is full; its counts are draws: they vary, and another seed gives others."""
    sources = spark.createDataFrame([("a", 300_000, 450_000.0), ("b", 200_000, 100_000.0), (None, 100_000, 50_000.0)], "source string, source_size long, target double")
    runs = [mixing.draws(sources, 100, 64, seed).collect() for seed in (1, 1, 2)]
    shards = []
    for run in runs:
        counts = Counter((r.shard, r.source) for r in run)
        sums = Counter(r.shard for r in run)
        assert {n for s, n in sums.items() if s != max(sums)} == {64}
        assert len({counts[(s, "a")] for s in sums}) > 5
        assert len({(r.shard, r.place) for r in run}) == len(run) and len({(r.source, r["pass"], r.block) for r in run}) == len(run)
        assert {s: sum(r.keep for r in run if r.source == s) for s in ("a", "b", None)} == {"a": 450_000, "b": 100_000, None: 50_000}
        shards.append(counts)
    assert shards[0] == shards[1] != shards[2]


def test_rows_that_repeat_in_full_are_spread(spark):
    rows = [(1, "the same text " * 10)] * 400 + [(i, "another text " * 10) for i in range(800)]
    got = sharding.op8(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(10)]
    assert max(sizes) - min(sizes) <= max(r.size for r in got)


def test_language_posterior_by_hand(spark):
    """identify against the fusion written out page by page."""
    s = langid.Settings()
    texts = [("le chat et la souris dans la maison " * 3, "fr"), ("the cat and the mouse in the house " * 3, "en"), ("die katze und die maus im haus " * 3, "de")] * 4
    model = langid.train(spark.createDataFrame([(None, t, lang) for t, lang in texts], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    urls = ["http://a.x.fr/", "https://a.x.fr/2", "http://b.x.fr", "http://c.y.com/", None, "http://c.y.com:80/q", "http://d.y.com/"]
    rows = [(i, urls[i % 7], f'<html lang="{texts[i % 3][1]}">{texts[(i * i) % 3][0][: 40 + i]}<script>the the') for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clues = {r.page_id: r for r in langid.clues(pages, model, s).collect()}
    soft = lambda x: np.exp(np.asarray(x) - max(x)) / np.exp(np.asarray(x) - max(x)).sum()
    p = {i: soft(r.logs) for i, r in clues.items()}
    mass = sum(p.values()) + s.smoothing
    for r in langid.identify(pages, model, s).collect():
        own, clue = p[r.page_id], clues[r.page_id]
        rest = mass - own
        post, mixed = np.asarray(clue.logs, float), rest / rest.sum()
        for by in ("declared", "suffix", "domain", "host"):
            if clue[by] is None:
                continue
            same = [i for i, c in clues.items() if c[by] == clue[by]]
            others = sum((p[i] for i in same if i != r.page_id), np.zeros(3))
            if by in ("declared", "suffix"):
                post = post + np.log((others + s.strength * len(same) / len(rows)) / (rest + s.strength))
            else:
                mixed = (others + s.strength * mixed) / (len(same) - 1 + s.strength)
        want = soft(post + np.log(mixed))
        assert r.lang == model.languages[int(want.argmax())] and r.confidence == pytest.approx(want.max(), rel=1e-6)


def test_trigrams_of_a_long_text(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["", "Un  chat!! et", "é" * 40 + " 12 " + "zz " * 30, "a", "1 2 3"])
    sums = lambda: Counter((int(b), int(o)) for bs, os in langid._trigrams(texts) for b, o in zip(bs, os))
    whole = sums()
    monkeypatch.setattr(langid, "_CHUNK", 7)
    assert sums() == whole


def test_unclosed_markup_hides_the_rest(spark):
    rows = [("a<script>b",), ("a<!-- b",), ("<p>a</p><b <i>c",), ("<script " * 20000,), ("x<style>y</style>z",)]
    got = [r.t.split() for r in spark.createDataFrame(rows, "html string").select(langid.visible(F.col("html")).alias("t")).collect()]
    assert got == [["a"], ["a"], ["a", "c"], [], ["x", "z"]]
