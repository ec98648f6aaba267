"""Operators of emberwatch.llm against brute force, round trips and held-out accuracy on small fixtures."""

import collections
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from emberwatch.llm import columns, decontaminate, embedding_dedup, line_dedup, passages, pieces, quality, queries, sharding, simhash, suffix_dedup, toxicity
from emberwatch.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, row string, n_words string, lines string"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, shared passages and lines, near copies, null, empty, blank, very long and repeated texts."""
    rnd = random.Random(4)
    passage, line = prose(rnd, 80), "Shared LINE here"
    out = [prose(rnd, 120) for _ in range(12)]
    out += [out[0], out[0], prose(rnd, 40) + " " + passage + " " + prose(rnd, 30), passage + " " + prose(rnd, 25)]
    words = out[1].split()
    for k in (5, 60):
        near = list(words)
        near[k] = "changed"
        out.append(" ".join(near))
    out += [f"{prose(rnd, 9)}\n  {line if i % 2 else line.lower()}\t\n{prose(rnd, 4)}\n" for i in range(11)]
    out += [None, "", " \t\n", "one", "Ünï çödé ▁ " * 40, prose(rnd, 20_000), ("abc " * 200).strip()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", "y", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id", None, None, None), (3, texts[3], "x", "y", None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_line_dedup(docs, empty):
    def lines(t):
        return (t or "").split("\n")

    def key(x):
        return columns.ascii_lower and "".join(c.lower() if c in columns.UPPER else c for c in x.strip(" \t\n\x0b\x0c\r"))

    source = rows_of(docs)
    n = collections.Counter(k for _, t in source for k in {key(x) for x in lines(t)} if k)
    want = []
    for i, t in source:
        kept = [x for x in lines(t) if n[key(x)] < 10]
        want.append((i, len(lines(t)), len(lines(t)) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) < set(got.columns) and any(w[2] for w in want)
    same_rows([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()], want)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("length,anchor,block", [(60, 16, 4096), (60, 16, 2), (200, 48, 4096)])
def test_substrings(docs, empty, length, anchor, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    raw = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    n = collections.Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if n[b[k:k + length]] > 1:
                gone[k:k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.dedup_substrings(docs, length=length, anchor=anchor)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert any(w[2] for w in want)
    same_rows([tuple(r) for r in got], want)
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_columns_of_suffix_order():
    rnd = random.Random(1)
    text = [bytes(rnd.choice(b"ab") for _ in range(30)) for _ in range(40)]
    group = [(i // 10, b[:20], 8) for i, b in enumerate(text)]
    got = suffix_dedup.repeated_windows(group, 6)
    for i, (g, b, front) in enumerate(group):
        for w in range(len(b) - 5):
            other = any(j != i and h == g and c[w:w + 6] == b[w:w + 6] for j, (h, c, _) in enumerate(group))
            if w <= front:  # windows from the anchor on start at it or before
                assert got[i][w] == other


def test_passages(spark, docs, empty, texts):
    got = {r["doc_id"]: r for r in passages.near_passages(docs).collect()}
    assert got[14]["n_repeated"] >= 70 and got[15]["n_repeated"] >= 70 and got[14]["class_id"] == got[15]["class_id"] == 14
    assert got[12]["class_id"] == got[13]["class_id"] == 0 and got[16]["class_id"] == 1
    assert got[5]["n_repeated"] == 0 and got[5]["class_id"] == 5
    assert got[14]["n_words"] == len(texts[14].split())
    assert passages.near_passages(empty).count() == 0


def brute_passages(a, b, least=46, similarity=0.8):
    """Whether two token sequences hold similar intervals, by all interval pairs of near equal length."""
    for i in range(len(a) - least + 1):
        for j in range(len(b) - least + 1):
            for n in (least, least + 5, least + 10):
                for m in (n - 1, n, n + 1):
                    x, y = set(a[i:i + n].tolist()), set(b[j:j + m].tolist())
                    if i + n <= len(a) and j + m <= len(b) and m >= least and len(x & y) >= similarity * len(x | y):
                        return True
    return False


def test_passages_that_lead_no_key(spark):
    """A frequent line under whose key neither the smallest nor the largest document has the passage of two others."""
    rnd = random.Random(11)
    line, passage = prose(rnd, 30), prose(rnd, 60)
    rows = [(i, prose(rnd, 30) + " " + line + " " + (passage if i in (7, 8) else prose(rnd, 60))) for i in range(16)]
    got = {r["doc_id"]: r for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["n_repeated"]} == {7, 8} and got[8]["class_id"] == 7
    assert got[7]["n_repeated"] >= 90 and got[7]["passages"] == got[8]["passages"]


def test_passages_across_rounds(spark):
    """Groups that share a line but no passage with each other: each is found, and none is joined to another."""
    rnd = random.Random(12)
    line = prose(rnd, 30)
    shared = [line + " " + prose(rnd, 50) for _ in range(6)]
    rows = [(10 * g + k, prose(rnd, 30) + " " + x + " " + prose(rnd, 20)) for g, x in enumerate(shared) for k in range(3)]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == r["doc_id"] // 10 * 10 and r["n_repeated"] >= 80 for r in got)


@pytest.mark.parametrize("n", [60, 80, 100])
@pytest.mark.parametrize("kind", ["insert", "delete", "change"])
def test_passages_with_an_edit(spark, n, kind):
    rnd = random.Random(n)
    words = prose(rnd, n).split()
    near = words[:n // 2] + (["new"] if kind != "delete" else []) + words[n // 2 + (kind != "insert"):]
    rows = [(1, prose(rnd, 90) + " " + " ".join(words) + " " + prose(rnd, 70)), (2, prose(rnd, 40) + " " + " ".join(near) + " " + prose(rnd, 95))]
    got = {r["doc_id"]: r for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["class_id"] == got[2]["class_id"] == 1
    assert abs(got[1]["n_repeated"] - n) <= 2 and abs(got[2]["n_repeated"] - len(near)) <= 2


def test_passages_behind_a_repeated_line(spark):
    """The leader holds the frequent line twice, and only the second time before the passage."""
    rnd = random.Random(13)
    line, passage = prose(rnd, 25), prose(rnd, 60)
    rows = [(i, line + " " + prose(rnd, 60) + " " + line + " " + passage + " " + line + " " + prose(rnd, 60)) for i in range(4)]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == 0 and any(s["start"] <= 85 and s["end"] >= 195 for s in r["passages"]) for r in got)


def test_all_alignments_are_tried():
    rnd = np.random.default_rng(6)
    line, passage = rnd.integers(0, 1 << 60, 20), rnd.integers(0, 1 << 60, 60)
    mixed = lambda *x: np.concatenate([rnd.integers(0, 1 << 60, y) if isinstance(y, int) else y for y in x]).astype(np.uint64)
    a, b = mixed(line, 50, line, passage), mixed(line, 90, line, 30, line, passage)
    assert passages.matches(a, b, [([5, 75], [5, 115, 165])], 46, 0.8) == {(70, 150, 160, 240)}


def test_sets_of_all_intervals():
    rnd = np.random.default_rng(8)
    for _ in range(200):
        m = int(rnd.integers(1, 8))
        a, b = rnd.integers(0, 12, 90).astype(np.uint64), rnd.integers(0, 12, 90).astype(np.uint64)
        runs = np.stack([*(np.cumsum(rnd.integers(4, 9, m)) for _ in range(2)), rnd.integers(1, 5, m)], axis=1)
        both, either = passages._common(a, b, runs)
        for i in range(m):
            for j in range(i, m):
                x, y = (set(v[runs[i, k]:runs[j, k] + runs[j, 2]].tolist()) for k, v in enumerate((a, b)))
                assert (both[i, j], either[i, j]) == (len(x & y), len(x | y))


def test_alignments_of_periodic_texts_take_seconds():
    """3,600 alignments of two texts that repeat a line each, similar nowhere: minutes where every alignment walks all intervals."""
    rnd = np.random.default_rng(9)
    line, one, two = (rnd.integers(0, 1 << 60, n).astype(np.uint64) for n in (12, 19, 19))
    a, b = np.tile(np.concatenate([line, one]), 60), np.tile(np.concatenate([line, two]), 60)
    at, began = list(range(4, len(a), 31)), time.process_time()
    assert passages.matches(a, b, [(at, at)], 46, 0.8) == set()
    assert time.process_time() - began < 8


def test_hopeless_pairs_have_no_passages():
    """Pairs left out unread are similar nowhere, and bounds of interval pairs hold."""
    rnd, left_out = np.random.default_rng(21), 0
    for _ in range(120):
        words = rnd.integers(0, 1 << 60, int(rnd.integers(40, 90))).astype(np.uint64)
        a, b = np.tile(words, 3), np.tile(words, 3)
        b[rnd.integers(0, len(b), int(rnd.integers(0, 60)))] = rnd.integers(0, 1 << 60, 1).astype(np.uint64)
        few = [passages.fewest(x, 46) for x in (a, b)]
        assert few == [min(len(set(x[k:k + 46].tolist())) for k in range(len(x) - 45)) for x in (a, b)]
        out = passages.hopeless(np.unique(a), np.unique(b), *few, 0.8)
        left_out += out
        assert not (out and brute_passages(a, b))
        pair, ends = passages.Alignments(a, b), np.sort(rnd.integers(0, len(a) + 1, (6, 2)), axis=0)
        reach = pair.within_reach(ends[:3], ends[3:], 0.8)
        for i in range(3):
            for j in range(3):
                (s1, s2), (e1, e2) = ends[i], ends[3 + j]
                x, y = set(a[s1:e1].tolist()), set(b[s2:e2].tolist())
                assert reach[i, j] or len(x & y) < 0.8 * len(x | y)
    one, two = (rnd.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(2))
    two[20:40] = one[20:40]
    assert passages.hopeless(np.unique(one), np.unique(two), 46, 46, 0.8) and not passages.hopeless(np.unique(one), np.unique(one), 46, 46, 0.8)


def test_plans_of_loops_keep_their_size(spark):
    """The estimated size of a table that feeds itself is that of its rows: as a product of all rounds it has millions of digits and planning never ends."""
    from emberwatch.session import settled

    now = spark.range(20).selectExpr("id AS u", "id + 1 AS v")
    for _ in range(4):
        now = settled(now.alias("a").join(now.alias("b"), F.expr("a.u = b.u")).selectExpr("a.u", "b.v"))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
    assert sorted(map(tuple, now.collect())) == [(k, k + 1) for k in range(20)]


def test_windows_of_many_texts_at_once(texts):
    """Words and windows of texts side by side are those of each text alone."""
    import xxhash

    texts = [*[t or "" for t in texts], "", "A\x1fb \u0130 c" + "\x0b" * 3 + "D", *[" ".join("x" * (k + n) for k in range(40)) for n in range(30)], "é 漢 " * 30]
    texts = pa.array(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["rid", "t"])
    got = [(r["rid"], r["key"], r["at"]) for part in passages._windows([batch]) for r in part.to_pylist()]
    want = []
    for k, t in enumerate(texts.to_pylist()):
        raw = t.encode()
        words = raw.lower().split()
        start = np.array([m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)], np.int64)
        hashes = passages.word_hashes(np.frombuffer(raw.lower(), np.uint8), start, start + [len(w) for w in words])
        assert hashes.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
        h, _, centre, _ = passages.compact_windows(passages.grams_of(passages.shingles_of(t)), passages.RUN, 1)
        want += [(k, key, centre[h == key].tolist()) for key in np.unique(h).tolist()]
    assert got == want


def test_keys_meet_for_certain():
    """Every similar pair has a key in common, wherever its edits are."""
    rnd = random.Random(14)
    for _ in range(200):
        n = rnd.choice([50, 55, 70, 95, 140])
        a = prose(rnd, n).split()
        b = list(a)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            at = rnd.randrange(len(b))
            b[at:at + rnd.choice([0, 1])] = rnd.choice([[], ["new"]])
        x, y = (passages.shingles_of(" ".join(w)) for w in (a, b))
        keys = [set(passages.compact_windows(passages.grams_of(z), passages.RUN, 1)[0].tolist()) for z in (x, y)]
        assert keys[0] & keys[1] or not brute_passages(x, y)


def test_compact_windows_are_the_tree():
    tokens = np.random.default_rng(3).integers(0, 1 << 60, 300).astype(np.uint64)
    h, left, centre, right = passages.compact_windows(tokens, 20, 1)
    mixed = passages._mix(tokens, 1)
    want = set()
    for c in range(300):
        a, b = c, c
        while a > 0 and mixed[a - 1] > mixed[c]:
            a -= 1
        while b < 299 and mixed[b + 1] >= mixed[c]:
            b += 1
        if b - a + 1 >= 20:
            want.add((a, c, b))
    assert set(zip(left.tolist(), centre.tolist(), right.tolist())) == want


def fingerprint(t):
    words = "".join(c.lower() if c in columns.UPPER else c for c in t or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    source = rows_of(docs)
    prints = [fingerprint(t) for _, t in source]
    part = list(range(len(source)))
    for i in range(len(source)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {p: min((source[i][0] for i in range(len(source)) if part[i] == p and source[i][0] is not None), default=None) for p in part}
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    same_rows([tuple(r) for r in got], [(source[i][0], f"{prints[i]:016x}", least[part[i]]) for i in range(len(source))])
    assert simhash.near_duplicates(empty).count() == 0


def test_balls_link_all_close_fingerprints(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(6)] + [0, 1 << 63]
    prints = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(9)} | set(base)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(x,) for x in signed.values()], "f long")
    got = {r["node"]: r["root"] for r in components(simhash.ball_links(frame)).collect()}
    part = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if a != b and (a ^ b).bit_count() <= 2:
                old, new = part[a], part[b]
                part = {k: new if v == old else v for k, v in part.items()}
    least = {v: min(signed[k] for k in prints if part[k] == v) for v in part.values()}
    assert all(got.get(signed[p], signed[p]) == least[part[p]] for p in prints)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components(links.where("u < 0")).count() == 0


def test_a_piece_search_ends_where_nothing_merges(monkeypatch):
    """A word before different marks is searched once where no piece holds its last character and the mark; ids stay the model's."""
    import sentencepiece

    own, sp = pieces.Pieces.load(queries.model_file()), sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    marks = [c for c in "|;§¶^" if "e" + c not in own.pairs]
    searched, search = [], own._whole
    monkeypatch.setattr(own, "_whole", lambda part: searched.append(part) or search(part))
    text = " ".join("there" + c for c in marks)
    assert own.encode(text).tolist() == sp.encode(text)
    assert len(marks) > 1 and searched.count(pieces.SPACE + "there") == 1 and not any("e" + c in x for x in searched for c in marks)


def test_pieces_equal_the_model_and_come_back(docs, texts, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=queries.model_file()), pieces.Pieces.load(queries.model_file())
    rnd = random.Random(0)
    more = ["".join(rnd.choice("abcdethe inongs=-*# .,/é\n🙂") for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    for t in [t for t in texts if t and pieces.SPACE not in t] + more + [" " * 99, "representation" * 50, "x" * 5000]:
        assert own.encode(t).tolist() == sp.encode(t)
    out = pieces.decode(pieces.encode(docs, queries.model_file(), decoded="n_words"), queries.model_file())
    assert out.where(F.col("n_words") != F.col("decoded")).count() == 0
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0 and out.count() == docs.count()
    assert pieces.encode(empty, queries.model_file()).count() == 0


def test_streaming_viterbi_is_the_best_path():
    scores = {"a": -3.0, "b": -3.1, "ab": -4.2, "ba": -4.4, "aba": -6.9, "bab": -6.0, "bb": -7.0}
    own = pieces.Pieces({p: i + 256 for i, p in enumerate(scores)}, scores, list(range(256)), "unigram", prefix_space=False)
    names = list(scores)
    rnd = random.Random(5)
    for n in (1, 2, 7, 40, 200):
        text = "".join(rnd.choice("ab") for _ in range(n))
        best = [0.0] + [-1e9] * n
        for end in range(1, n + 1):
            best[end] = max(best[end - len(p)] + s for p, s in scores.items() if text[:end].endswith(p))
        got = [names[i - 256] for i in own.stream(text)]
        assert "".join(got) == text and abs(sum(scores[p] for p in got) - best[n]) < 1e-6


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(docs, empty, shards):
    got = sharding.shard_rows(docs, shards=shards).collect()
    at = collections.defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] if "text" in r else dict(rows_of(docs)).get(r["doc_id"]) or "").encode()) + 16 or r["doc_id"] is None
        at[r["shard"]].append(r["slot"])
    counts = [len(at.get(s, [])) for s in range(shards)]
    assert len(got) == docs.count() and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    assert {r["doc_id"]: r["text_crc32"] for r in got}[0] == zlib.crc32(dict(rows_of(docs))[0].encode())
    if shards == 3:
        assert len({r["shard"] for r in got if r["doc_id"] in (0, 12, 13)}) == 1
    assert sharding.shard_rows(empty).count() == 0


@pytest.mark.parametrize("copies", [[8] * 300, [55, 40, 30, 12] * 10 + [5] * 160 + [1] * 200])
def test_sharding_of_mostly_copies(spark, copies):
    """Groups up to a whole shard stay together where (nearly) all rows are linked."""
    rows = [(g, f"text {g}") for g, n in enumerate(copies) for _ in range(n)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=40).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    at = collections.defaultdict(collections.Counter)
    for r in got:
        at[r["doc_id"]][r["shard"]] += 1
    links = sum(sum(c.values()) - 1 for c in at.values())
    uncut = sum(max(c.values()) - 1 for c in at.values())
    print("uncut links", uncut, "of", links)
    assert uncut >= 0.85 * links


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination(spark, docs, empty, texts, block_bytes):
    items = [(1, " ".join(texts[2].split()[10:30]).upper()), (20, texts[14]), (3, "one"), (4, ""), (5, None), (None, texts[5]), (6, "never said words"), (20, texts[14])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = decontaminate.words_of
    want = []
    for i, t in rows_of(docs):
        w, hit, found = word(t), set(), set()
        for item, s in items:
            x = word(s)
            for k in range(max(1, len(x) - 9) if x else 0):
                win = x[k:k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), sorted(found)))
    got = decontaminate.decontaminate(docs.drop("lines"), bench, block_bytes=block_bytes)
    same_rows([tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items").collect()], want)
    assert decontaminate.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


@pytest.mark.parametrize("cell,tile", [(2048, 1024), (8, 4)])
def test_embeddings(spark, cell, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rnd = np.random.default_rng(2)
    base = rnd.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + rnd.standard_normal(16) * 0.1 * (i % 3)).astype(float).tolist(), i % 2) for i in range(90)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] + [1.0] * 15, 1), (104, rows[0][1], None), (105, rows[0][1], 0), (106, [], 0), (107, [1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: (y, len(v or [])) for i, v, y in rows}
    links = {i: {j for j in good if j != i and label[i] == label[j] and good[i] @ good[j] >= 0.98} for i in good}
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(frame).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in good)
    assert found >= 0.9 * sum(map(len, links.values())) and all(got[i]["n_links"] <= len(links.get(i, ())) for i in got)
    if cell == 2048:
        part = {i: i for i in good}
        for i in good:
            for j in links[i]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = {k: new if v == old else v for k, v in part.items()}
        assert all(got[i]["component_id"] == part.get(i, i) and got[i]["kept"] == (part.get(i, i) == i) for i in got)
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0


def test_embeddings_of_any_magnitude(spark):
    vectors = [[1e200, 1.0000001e200], [1e-200, 1e-200], [1.0, 1.0], [5e-324, 5e-324], [1.7e308, 1.7e308], [-1e200, -1e200], [1e200, -1e-200]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (0, 5), 6: (0, 6)}


def auc(scores):
    good, bad = [s for s, y in scores if y], [s for s, y in scores if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver's tables")
@pytest.mark.parametrize("name,label,least", [("op9_toxicity", "toxic", 0.85), ("op10_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).where("held_out").select("doc_id", "score")
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    scores = [(r["score"], labels[r["doc_id"]]) for r in got.collect() if r["doc_id"] in labels]
    assert all(0 <= s <= 1 for s, _ in scores) and auc(scores) >= least


def test_classifiers_on_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    tox = toxicity.score(docs, toxicity.fit(docs, none))
    assert tox.count() == docs.count() and tox.where("score is null or score < 0 or score > 1").count() == 0
    model = quality.fit(spark.createDataFrame([], "y int, x array<double>"))
    out = quality.classify(docs, model)
    assert out.where("score = 0.5").count() == docs.count() and quality.classify(empty, model).count() == 0
    found = toxicity.Model({f: 9.0 for f in toxicity.features_of(b"idiot")[:1]}, -5.0).score("Fine day. You idiot! Bye.", {})
    assert found[0] > 0.9 and [(a, b) for a, b, _ in found[1]] == [(9, 19)]


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    a, b = prose(rnd, 60), prose(rnd, 60)
    rows = [(1, a, "en"), (1, b, "en"), (2, a, "en"), (3, b, "en"), (4, None, "en"), (5, "", "en"), (1, a, "en"), (None, a, "en"), (None, a, "en"), (6, prose(rnd, 60), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h1 string")
    got = corpus_pipeline.near_duplicates(spark, docs.drop("__h1").withColumn("lang", F.lit("x")), "").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(1, a), (1, b), (4, None), (6, rows[-1][1]), (None, a), (None, a)]))
    assert corpus_pipeline.near_duplicates(spark, docs.drop("__h1").limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = queries.load(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        kept[name] = before, docs
    before, after = kept["simhash"]
    reps = simhash.near_duplicates(before.select("doc_id", "text")).select("component_id").distinct()
    assert after.count() == reps.count() and after.join(reps, after["doc_id"] == reps["component_id"], "left_anti").count() == 0
    assert queries.load(spark, SF, "documents").count() * 0.5 < docs.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count() and ids.where("not round_trip").count() == 0


def test_reachable_places_hold_every_passage():
    """No similar interval lies outside the marked places, and comparisons that leave the others out find the same."""
    rnd, left_out = np.random.default_rng(31), 0
    for _ in range(80):
        a, b = (rnd.integers(0, 1 << 60, int(rnd.integers(60, 260))).astype(np.uint64) for _ in range(2))
        n = int(rnd.integers(20, 60))
        a[:n] = b[:n]
        b[rnd.integers(0, n, int(rnd.integers(1, 4)))] = 7
        a[55:] = np.tile(a[:20], 13)[:len(a) - 55] if rnd.random() < 0.3 else a[55:]
        (all_a, first_a), (all_b, first_b) = passages.firsts(a), passages.firsts(b)
        assert all_a.tolist() == sorted(set(a.tolist())) and first_a[-1] == len(all_a)
        inside = passages.reachable(passages._shared(a, all_b), first_a, 46, 0.8), passages.reachable(passages._shared(b, all_a), first_b, 46, 0.8)
        met = [(np.flatnonzero(a == v).tolist(), np.flatnonzero(b == v).tolist()) for v in np.intersect1d(a, b)[::5]]
        found = passages.matches(a, b, met, 46, 0.8)
        left_out += any(x is None for x in inside)
        assert not found if any(x is None for x in inside) else passages.matches(a, b, met, 46, 0.8, *inside) == found
        for a1, a2, b1, b2 in found:
            assert inside[0][a1:a2].all() and inside[1][b1:b2].all()
    assert left_out


def test_periodic_texts_are_followed_once():
    """A chain of many runs without a similar interval is not weighed again for each of its runs."""
    rnd = np.random.default_rng(8)
    word = rnd.integers(0, 1 << 60, 51).astype(np.uint64)
    other = word.copy()
    other[[3, 9, 14, 20, 25, 31, 36, 42, 47]] = rnd.integers(0, 1 << 60, 9).astype(np.uint64)
    a, b = np.tile(word, 12), np.tile(other, 12)
    met, weighed, one = [(np.flatnonzero(a == word[5]).tolist(), np.flatnonzero(b == word[5]).tolist())], [], passages.best_match
    passages.best_match = lambda *x: weighed.append(1) or one(*x)
    try:
        assert passages.matches(a, b, met, 46, 0.8) == set()
    finally:
        passages.best_match = one
    assert len(weighed) < len(met[0][0]) * len(met[0][1]) / 3


def test_frequent_lines_make_no_pairs(spark, monkeypatch):
    """Windows of a key in many documents meet by what surrounds them: a line alone connects nothing, passages around it are found, and the work does not grow with the square."""
    rnd = np.random.default_rng(12)
    some = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 1 << 40, n))
    line = some(24)
    rows = [(i, f"{some(60)} {line} {some(60)}") for i in range(120)]
    block = f"{some(20)} {line} {some(20)}"
    rows += [(1000 + i, f"{some(70)} {block} {some(70)}") for i in range(3)]
    compared, one = [], passages._compared
    monkeypatch.setattr(passages, "_compared", lambda pairs, *x: compared.append(pairs.select("a", "b").distinct().count()) or one(pairs, *x))
    got = {r["doc_id"]: r for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_repeated"] == 0 and got[i]["class_id"] == i for i in range(120))
    assert all(got[1000 + i]["class_id"] == 1000 and got[1000 + i]["n_repeated"] >= 64 for i in range(3))
    assert sum(compared) < 1500
