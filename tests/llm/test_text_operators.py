"""Ranked search, chat formatting and periodic runs against brute force, on awkward rows and the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from arborist.llm import chat, periodic, queries, search
from arborist.llm.common import table

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, place long, rank int, n int, words string, runs string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, blank, long and periodic texts, copies, repeated rows and clashing names."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "beta", "b", "é", "É", "ß", "x1", "a-b", "--", "\x00", "İ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [None, "", " \t\n", "a", "alpha beta", "x " * 20000, "a b c d e " * 9 + "f " * 6, "one\x0btwo\x0cthree\x1ffour"]
    texts += [texts[0], texts[0].upper(), texts[1]]
    rows = [(i, t, 1, 2, 3, "w", "r") for i, t in enumerate(texts)]
    rows += [rows[2], (None, "alpha beta", *rows[0][2:]), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, top=search.TOP):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_all = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item] += Counter(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_all
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


ITEMS = [(1, "alpha, ALPHA É é"), (2, "x1 b"), (2, "beta beta"), (None, "ß a"), (3, None), (4, ""), (5, "nowhere"), (6, "İ x two")]


@pytest.mark.parametrize("top, max_chars", [(20, None), (3, None), (7, 4)])
def test_search(spark, docs, monkeypatch, top, max_chars):
    """Also with so few characters an automaton that each item has its own."""
    if max_chars:
        monkeypatch.setattr(search, "MAX_CHARS", max_chars)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert tuples(search.rank(docs, items, top)) == brute_ranks(rows, ITEMS, top)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.rank(docs, items.limit(0)).count() == 0
    assert search.rank(docs.limit(0), items).count() == 0
    assert search.rank(docs, items.limit(0)).columns == search.rank(docs, items).columns


def test_many_equal_documents_are_ranked_by_id(spark):
    docs = spark.range(6000).selectExpr("5999 - id as doc_id", "if(id < 3000, 'other words', 'same text') as text").repartition(7)
    got = search.rank(docs, spark.createDataFrame([(0, "text")], "item_id long, text string")).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(i + 1, i) for i in range(20)]


def test_an_automaton_counts_whole_terms():
    known = search.Terms.of([(0, [b"a b ab aba \xc3\xa9"])])
    found, times = known.counted(search._line("A a,abé ABA aba b_b".encode()))
    named = dict(zip("a b ab aba é".split(), range(5)))
    assert dict(zip(found.tolist(), times.tolist())) == {named["a"]: 2, named["aba"]: 2, named["b"]: 2}


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_chat_format"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert tuples(got) == Counter(want.fetchall())


CHATS = [
    (1, 0, "system", "be </s> kind"), (1, 1, "user", "hi <<SYS>> \\ \\<"), (1, 2, "assistant", "[INST][/INST]<s><s></s>"), (1, 3, "user", None),
    (2, 0, "assistant", "first"), (2, 1, "assistant", ""), (2, 2, "user", "<|end|> [/INST] <</SYS>"), (2, 3, "tool</s>", "x\\"), (2, 4, None, None), (2, 5, "assistant", "after\n"),
    (3, None, "user", "no number"), (3, 5, "user", "a"), (3, 5, "user", "a"), (3, 5, "assistant", "tie"),
    (None, 1, "user", "null id"), (None, 2, "assistant", "é<"), (4, 0, "user", "<\\/s>"),
] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} \\") for i in range(50)]


def brute_chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = Counter()
    for conv, own in by.items():
        own = [(r, t) for _, _, r, t in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        out[(conv, len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))] += 1
    return out


@pytest.mark.parametrize("block", [1, 3, chat.BLOCK])
def test_chat(spark, block):
    df = spark.createDataFrame([(*r, "s", 1) for r in CHATS], "conv_id long, turn long, role string, text string, segments string, block long")
    output = chat.formatted(df, block=block)
    assert output.count() == len(CHATS)
    got = chat.read_back(output)
    assert tuples(got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == brute_chats(CHATS)
    fits = {r.conv_id: r.in_order for r in got.collect()}
    assert fits == {1: True, 2: False, 3: False, None: True, 4: True, 9: True}
    assert chat.read_back(chat.formatted(df.limit(0), block=block)).count() == 0


def test_blocks_don_t_change_the_output(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    whole = [tuple(r) for r in chat.formatted(df).orderBy("conv_id", "block", "place").select("conv_id", "in_order", "segments").collect()]
    parts = [tuple(r) for r in chat.formatted(df, block=2).orderBy("conv_id", "block", "place").select("conv_id", "in_order", "segments").collect()]
    assert whole == parts


def test_templates_mark_and_escape():
    template, rng = chat.INSTRUCTION, random.Random(1)
    assert template.segments(chat.START, "user", "hi </s>")[1] == [("<s>[INST] ", False), ("hi <\\/s>", False), (" [/INST]", False)]
    bits = [*template.own, "\\", "<", "/s>", "[", " ", "\n", "a", "[/", "INST]", "<|"]
    for _ in range(300):
        turns = [(rng.choice(["system", "user", "assistant", "", "tool", "<|text|>"]), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 7))]
        output, state = "", chat.START
        for role, text in turns:
            assert not template.control.search(template.escaped(text)) and chat.unescaped(template.escaped(text)) == text
            output, state = output + "".join(t for t, _ in template.segments(state, role, text)[1]), role
        assert list(template.read(chat.START, output)) == turns
    with pytest.raises(ValueError):
        chat.Template({chat.START: {"user": chat.Written("<a", "><b>")}}, ("<a><", "<b>"))
    with pytest.raises(ValueError):
        chat.Template({chat.START: {"user": chat.Written("", " no marker")}}, ("<b>",))


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // periodic.EXPONENT + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            size, own = e - s + q, w[s : e + q]
            if size >= max(periodic.MIN_WORDS, periodic.EXPONENT * q) and not any(all(own[i] == own[i + r] for i in range(size - r)) for r in range(1, q)):
                out.append((s, size, q))
            s = e + 1
    return sorted(out)


def brute_periodic(doc_id, text, plant=True):
    words = [w for w in BLANK.split(text or "") if w]
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, sha("".join("%d,%d,%d\n" % x for x in found)), sha(kept))


def test_find_runs():
    """Few and many different words, with planted periods, several texts at once."""
    rng = random.Random(1)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 150), rng.choice([1, 2, 3, 8, 50])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 4 else 0):
                a, p = rng.randrange(n), rng.randint(1, n // 4 + 1)
                for i in range(a, rng.randint(a, n)):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        codes = [c for i, w in enumerate(texts) for c in [*w, -1 - i]]
        got = periodic.find_runs(np.array(codes, np.int64), np.array([len(w) for w in texts]))
        want = [(i, *x) for i, w in enumerate(texts) for x in brute_runs(w)]
        assert list(zip(*(x.tolist() for x in got))) == want


def test_runs_of_repetitive_words():
    """Words that repeat at every scale: Fibonacci and Thue-Morse words, powers of powers."""
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    powers = ([0, 1] * 4 + [2]) * 4 + [3] + ([0] * 7 + [1]) * 9
    for w in (b, thue, powers, [0] * 300, list(range(40)) * 5):
        got = periodic.find_runs(np.array([*w, -1], np.int64), np.array([len(w)]))
        assert list(zip(*(x.tolist() for x in got[1:]))) == brute_runs(w)


@pytest.mark.parametrize("chunk", [50, periodic.CHUNK_WORDS])
def test_periodic(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", chunk)
    rows = [r for r in docs.collect() if not (r.text or "").startswith("x x x")]
    got = tuples(periodic.op13(spark.createDataFrame(rows, docs.schema)))
    assert got == Counter(brute_periodic(r.doc_id, r.text) for r in rows)
    assert periodic.op13(docs.limit(0)).count() == 0


def test_a_long_text_of_one_word(spark):
    got = periodic.runs(spark.createDataFrame([(1, "x " * 200_000)], "doc_id long, text string")).first()
    assert [tuple(x) for x in got.runs] == [(0, 200_000, 1)] and got.collapsed == "x"


def test_periodic_on_the_smallest_tables(spark):
    got = tuples(periodic.op13(table(spark, SF, "documents")))
    short = [r for r in table(spark, SF, "documents").collect() if len(r.text or "") < 3000]
    assert sum(got.values()) == table(spark, SF, "documents").count()
    assert not Counter(brute_periodic(r.doc_id, r.text) for r in short) - got
