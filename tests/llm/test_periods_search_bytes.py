"""Periodic runs, ranked search and byte pairs against brute force and the vocabulary's own library."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import ball_tree, byte_pairs, periods, queries

WORDS = [f"w{i}" for i in range(300)]


def prose(rnd, n, words=WORDS):
    return " ".join(rnd.choice(words) for _ in range(n))


def table(spark, rows, ddl="doc_id long, text string, runs string, ids string, score int"):
    return spark.createDataFrame([(*r, *[None] * 3) for r in rows], ddl)


# --------------------------------------------------------------------------- periodic runs


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and j > i:
                s = w[i:i + n]
                if not any(s[:n - p] == s[p:] for p in range(1, q)):
                    out.append((i, n, q))
            i = max(i + 1, j)
    return sorted(out)


def brute_collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (9, 3)])
def test_runs_of_random_words(least, times):
    rnd = random.Random(0)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            k, n = rnd.choice([1, 2, 2, 3, 30]), rnd.choice([0, 1, 5, 6, 20, 40, 70])
            w = [bytes([97 + rnd.randrange(k)]) for _ in range(n)]
            if rnd.random() < 0.6 and n:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert periods.runs_of(texts, least, times) == [brute_runs(w, least, times) for w in texts]


def test_runs_inside_each_other():
    inner = list("ab") * 5 + ["c"]
    w = inner * 5
    assert periods.runs_of([[x.encode() for x in w]])[0] == brute_runs(w) != []
    assert {p for _, _, p in brute_runs(w)} == {2, 11}


def test_long_repetition_takes_seconds():
    w = [b"a", b"b", b"c"] * 50_000
    assert periods.runs_of([w, [b"x"] * 100_000]) == [[(0, 150_000, 3)], [(0, 100_000, 1)]]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    out = [(i, prose(rnd, rnd.choice([3, 30, 200]))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \t\n"), (103, "x " * 50), (104, "a\tb\nc  " * 9 + "d"), (105, "é ü " * 30), (106, prose(rnd, 4_000)),
            (107, "a b " * 6 + "a c " * 6), (None, "k " * 20), (3, "again " * 9), (108, "x " * 50)]
    return out


def test_periodic_runs(spark, texts):
    got = periods.periodic_runs(table(spark, texts))
    assert got.columns == ["doc_id", "ids", "score", "text", "runs", "collapsed"]
    want = []
    for i, t in texts:
        w = split(t)
        runs = brute_runs(w)
        want.append((i, t, runs, brute_collapsed(w, runs)))
    rows = [(r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and any(w[2] for w in want)
    assert periods.periodic_runs(table(spark, [])).count() == 0


def test_query_of_periodic_runs(spark, texts, tmp_path):
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in texts:
        w = planted_words(i, split(t)) if i is not None else split(t)
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(planted_words(i, split(t)) != split(t) for i, t in texts if i is not None) > 2


# --------------------------------------------------------------------------- ranked search


def terms(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute_search(docs, items, k):
    words = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = collections.Counter(x for _, w in words for x in set(w))
    out = []
    for item, t in items:
        found = []
        for i, w in words:
            tf, score = collections.Counter(w), 0
            for x in set(terms(t)):
                if tf[x]:
                    m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def library():
    rnd = random.Random(8)
    docs = [(i, prose(rnd, rnd.choice([2, 20, 90]), WORDS[:40 + 4 * (i % 60)])) for i in range(260)]
    docs += [(300 + i, docs[5][1]) for i in range(70)]  # copies: ties beyond the limit
    docs += [(400, None), (401, ""), (402, "... !"), (403, "W1 w1 é É w1"), (None, "w1 w2"), (None, "w1 w2"), (7, "w3 w4 w5"), (404, prose(rnd, 20_000))]
    items = [(i, prose(rnd, 12)) for i in range(9)]
    items += [(20, None), (21, ""), (22, "nothing known here"), (23, docs[5][1]), (23, docs[5][1]), (24, "w1 W1 É"), (None, "w2 w3")]
    return docs, items


@pytest.mark.parametrize("block", [512, 4])
def test_ranked_search(spark, library, block, monkeypatch):
    monkeypatch.setattr(ball_tree, "BLOCK_ITEMS", block)
    docs, items = library
    rows = table(spark, docs).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = ball_tree.search(rows, bench, k=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_search(docs, items, 50)))


def test_search_of_nothing(spark, library):
    docs, items = library
    rows, bench = table(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for a, b in ((rows.where("false"), bench), (rows, bench.where("false")), (rows.where("text is null"), bench), (rows, bench.where("item_id = 22"))):
        out = ball_tree.search(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_by_text_ids(spark, library):
    docs, items = library
    docs = [(None if i is None else f"d{i:04d}", t) for i, t in docs]
    got = ball_tree.search(spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame(items, "item_id long, text string"), k=7, doc_id="name", text="body")
    assert {r[:4] for r in map(tuple, got.collect())} == set(brute_search(docs, items, 7))


@pytest.mark.parametrize("leaf", [2, 32])
def test_no_document_scores_above_its_nodes_bound(leaf, monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", leaf)
    rnd = np.random.default_rng(4)
    size = rnd.integers(1, 30, 400)
    first = np.concatenate([[0], np.cumsum(size)])
    term = np.concatenate([np.sort(rnd.choice(500, n, replace=False)) for n in size])
    x = rnd.integers(1, 1_000_000, first[-1]).astype(float)
    weights = rnd.integers(0, 12_000, 500)
    asked = [rnd.choice(500, n, replace=False).tolist() for n in (1, 5, 40, 200)] + [[]]
    q = ball_tree.Queries(asked, weights, 10, np.zeros(5, np.int64))
    vectors = ball_tree.Vectors(first, term, x)
    tree = ball_tree.Tree(vectors, q.group, 500)
    scores = np.add.reduceat(q.w[term] * x.astype(np.int64)[:, None], first[:-1], axis=0)
    bound = q.bounds(tree.centre, tree.radius, tree.below.astype(float))
    for node, (a, b) in enumerate(tree.span):
        assert (scores[tree.rows[a:b]] <= bound[node]).all()
    best = ball_tree.Best(q)
    best.search(vectors, list(range(400)))
    for k in range(5):
        order = [d for d in np.lexsort((np.arange(400), -scores[:, k]))[:10] if scores[d, k] > 0]
        assert [(-s, d) for s, _, d in best.lists[k]] == [(scores[d, k], d) for d in order]


def test_bounds_prune(monkeypatch):
    """Two far groups of documents: the search of one's terms opens few leaves of the other."""
    rnd = np.random.default_rng(1)
    n, first = 2048, np.arange(0, 2048 * 10 + 1, 10)
    term = np.concatenate([np.sort(rnd.choice(100, 10, replace=False)) + 100 * (d % 2) for d in range(n)])
    q = ball_tree.Queries([list(range(100))], np.full(200, 100), 5, np.zeros(1, np.int64))
    taken = []
    take = ball_tree.Vectors.take
    best = ball_tree.Best(q)
    vectors = ball_tree.Vectors(first, term, rnd.integers(1, 1000, first[-1]).astype(float))
    tree = ball_tree.Tree(vectors, q.group, 200)
    monkeypatch.setattr(ball_tree, "Tree", lambda *_: tree)
    monkeypatch.setattr(ball_tree.Vectors, "take", lambda self, docs: taken.extend(docs.tolist()) or take(self, docs))
    best.search(vectors, list(range(n)))
    assert 0 < len(taken) < 0.7 * n and all(d % 2 == 0 for _, _, d in best.lists[0])


# --------------------------------------------------------------------------- byte pairs


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    return byte_pairs.Merges.load(queries.byte_pair_file()), tokenizers.Tokenizer.from_file(queries.byte_pair_file())


def ids_of(merges, texts):
    return [np.frombuffer(x, np.int32).tolist() for x in merges.encode(texts)]


def test_byte_pairs_equal_the_library(both):
    own, library = both
    rnd = random.Random(1)
    signs = "abcdethe inongs-=*# .,/é\n\n  \t'sS'tll　\x85\x1c\x1f²½٣一二🙂́ǅʰ_<|endoftext|>12\x00\xad​‍"
    cases = ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    cases += ["a" * 3000, "ab" * 999, " " * 500, "x" * 49, "<|endoftext|>" * 3, "x <|endoftext|> y", "!!'s 's x's''s", "\n\n\nfoo  bar\n", "thwhtiontion" * 40]
    got = ids_of(own, cases)
    for text, ids in zip(cases, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == text
    odd = [rnd.randrange(50_257) for _ in range(500)]
    for k in range(0, 500, 7):
        assert own.decode(odd[k:k + 7]) == library.decode(odd[k:k + 7], skip_special_tokens=False)


def test_words_of_all_characters(both):
    own, library = both
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert ids_of(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forced_boundaries_are_certain(both):
    own, _ = both
    inside = np.zeros((256, 256), bool)
    for t in own.tokens.values():
        for a, b in zip(t, t[1:]):
            inside[a, b] = True
    assert (own.apart[~inside]).sum() >= 0.9 * own.apart.sum() > 20_000
    words = [" Straße|x", "||--||", "ciónñas", "q" * 20 + "|" + "z" * 20]
    apart, own.apart = own.apart, np.zeros((256, 256), bool)
    whole = own.encode_words(words)
    own.apart = apart
    assert own.encode_words(words) == whole and any(apart[a, b] for w in words for a, b in zip(w.encode(), w.encode()[1:]))


def test_memory_of_words_is_bounded(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(byte_pairs, "_MEMO", 50)
    rnd = random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([2, 5, 70]))) for _ in range(30)) for _ in range(2)]
        assert ids_of(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(own.memo) <= 50 and all(len(w) <= 48 for w in own.memo)
    own.memo = {}


def test_byte_pair_columns(spark, texts, both, tmp_path):
    _, library = both
    rows = table(spark, texts + [(200, "a <|endoftext|> b"), (201, "word " * 300_000)])
    out = byte_pairs.encode(rows, queries.byte_pair_file(), decoded="score")
    assert out.columns == ["doc_id", "runs", "text", "ids", "score"]
    back = byte_pairs.decode(out, queries.byte_pair_file())
    assert back.where("decoded <> coalesce(text, '') or score <> coalesce(text, '') or decoded is null").count() == 0
    for r in out.where("doc_id is null or doc_id <> 201").collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert byte_pairs.encode(rows.limit(0), queries.byte_pair_file()).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in byte_pairs.decode(nulls, queries.byte_pair_file()).collect()] == ["", ""]
    rows.where("doc_id <> 201").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_byte_pairs(spark, str(tmp_path)).where("doc_id > 10").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts + [(200, "a <|endoftext|> b")]:
        if i is not None and i > 10:
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))


def test_other_vocabularies_are_refused(tmp_path):
    import json
    with open(queries.byte_pair_file(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    file = tmp_path / "other.json"
    file.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        byte_pairs.Merges.load(str(file))
