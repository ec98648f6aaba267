"""Byte-level BPE encoding and decoding with forced boundaries.

Merging only ever joins neighbours into tokens of the vocabulary. Two bytes that stand
side by side in no token can therefore never end up in one token: between them is a
certain cut, whatever surrounds it. Every word of the text is cut at all such pairs, the
fragments are merged independently, and their ids are concatenated. Fragments are short
and repeat, so a bounded memo answers most of them.

Words come from the pattern of the vocabulary's own pre-tokenizer (contractions, letters,
numbers, signs, blanks), which decides the ids as much as the merges do.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked

#: Words kept per worker, and the longest one kept: some 80 MB at most.
_MEMO, _LONGEST_MEMO = 3 << 17, 48
#: Longer fragments are merged with a heap.
_SHORT = 48
#: Bytes of text per output batch of a worker.
_SLICE = 4 << 20
_NEVER = 1 << 30

# The blanks of the pattern (Unicode White_Space)
_BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The pattern with the character classes of the plane below U+0250, for the built-in engine
_FAR = re.compile("[^\x00-ɏ]").search


def _pattern(letter: str, number: str) -> str:
    return (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_BLANK}{letter}{number}]+"
            f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if test(chr(c)))


_near = re.compile(_pattern(_class(str.isalpha), _class(str.isnumeric))).findall


def words_of(text: str) -> list[str]:
    """The words of the pre-tokenizer; together they are the text."""
    if _FAR(text) is None:
        return _near(text)
    import regex  # has the classes of all planes, and is slower

    return regex.findall(_pattern(r"\p{L}", r"\p{N}"), text)


def byte_signs() -> list[str]:
    """The sign a vocabulary file writes for each byte: itself where it prints, else the next free sign from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Merges:
    """A vocabulary: token bytes, merge ranks by pairs of ids, added tokens, and the byte pairs that no token holds."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.tokens = {**tokens, **{i: s.encode() for s, i in added.items()}}
        self.first = np.zeros(256, np.int64)
        for i, t in tokens.items():
            if len(t) == 1:
                self.first[t[0]] = i
        keys = np.array([a << 24 | b for a, b, _ in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, _NEVER)
        self.made = np.array([c for _, _, c in merges], np.int64)
        self.apart = np.ones((256, 256), bool)
        for t in tokens.values():
            raw = np.frombuffer(t, np.uint8)
            self.apart[raw[:-1], raw[1:]] = False
        self.added = added
        # longest first: of two added tokens that begin at one place the longer one is taken
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")").split if added else None
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, file: str) -> Merges:
        """Vocabulary of a tokenizer file of the byte-level BPE kind; other kinds are refused."""
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        marks = any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or not plain or marks or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError(f"no plain byte-level BPE vocabulary: {file}")
        byte = {s: b for b, s in enumerate(byte_signs())}
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls({i: bytes(byte[s] for s in t) for t, i in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in pairs],
                   {t["content"]: t["id"] for t in spec["added_tokens"]})

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours; _NEVER where they do not merge."""
        key = left << 24 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], _NEVER)

    def merge(self, fragments: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short fragments at once, and where each one's ids begin.

        Every round merges in each fragment the pair of the lowest rank, the leftmost
        of equal ones; fragments without such a pair leave.
        """
        ids, done = self.first[fragments], []
        who, size = np.arange(len(starts)), np.diff(np.append(starts, len(ids)))
        rank = np.full(len(ids), _NEVER)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[starts + size - 1] = _NEVER
        while len(who):
            least = np.minimum.reduceat(rank, starts)
            ready = least == _NEVER
            if ready.any():
                out = np.repeat(ready, size)
                done.append((who[ready], size[ready], ids[out]))
                ids, rank = ids[~out], rank[~out]
                who, size, least = who[~ready], size[~ready], least[~ready]
                starts = np.cumsum(size) - size
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            first = np.searchsorted(at, starts)  # the leftmost of each fragment
            at = at[first]
            ids[at] = self.made[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            starts = np.cumsum(size) - size
            at = at - np.arange(len(at))  # one id before it has gone from each fragment in front
            last = at == starts + size - 1
            rank[at] = _NEVER
            rank[at[~last]] = self.ranks(ids[at[~last]], ids[at[~last] + 1])
            inner = at[at > starts]
            rank[inner - 1] = self.ranks(ids[inner - 1], ids[inner])
        who = np.concatenate([w for w, _, _ in done])
        size = np.concatenate([n for _, n, _ in done])
        sizes = np.empty(len(who), np.int64)
        sizes[who] = size
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[np.repeat(begin[who] - (np.cumsum(size) - size), size) + np.arange(len(out))] = np.concatenate([x for _, _, x in done])
        return out, begin

    def merge_long(self, fragment: np.ndarray) -> list[int]:
        """The same for one long fragment in n log n: a heap of (rank, place) over a linked list; entries whose pair has changed are passed over."""
        ids = self.first[fragment]
        known: dict[tuple[int, int], int] = {}

        def get(a: int, b: int) -> int:
            r = known.get((a, b))
            if r is None:
                r = known[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return r

        heap = [(r, k) for k, r in enumerate(self.ranks(ids[:-1], ids[1:]).tolist()) if r < _NEVER]
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or get(ids[k], ids[right]) != r:
                continue
            ids[k], ids[right] = int(self.made[r]), -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (s := get(ids[k], ids[right])) < _NEVER:
                    heapq.heappush(heap, (s, k))
            left = before[k]
            if left >= 0 and (s := get(ids[left], ids[k])) < _NEVER:
                heapq.heappush(heap, (s, left))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit numbers: cut at all pairs that no token holds, merge the fragments, concatenate."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        word = np.cumsum([0, *map(len, raw)])
        cut = np.ones(len(buffer), bool)
        cut[1:] = self.apart[buffer[:-1], buffer[1:]]
        cut[word[:-1]] = True
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(buffer)))
        long = size > _SHORT
        if long.any():
            short = ~np.repeat(long, size)
            ids, begin = self.merge(buffer[short], np.cumsum(size[~long]) - size[~long]) if short.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            parts = np.split(ids, begin[1:]) if len(begin) else []
            short_parts = iter(parts)
            parts = [np.array(self.merge_long(buffer[s:s + n]), np.int64) if far else next(short_parts) for s, n, far in zip(starts, size, long)]
            sizes = np.array([len(p) for p in parts])
            ids, begin = np.concatenate(parts), np.cumsum(sizes) - sizes
        else:
            ids, begin = self.merge(buffer, starts)
        # the first fragment of every word
        edge = (np.append(begin[np.searchsorted(starts, word[:-1])], len(ids)) * 4).tolist()
        flat = ids.astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip(edge, edge[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as 32-bit numbers; none for null and empty texts. Strings of added tokens become their ids."""
        split, cut, seen = self.split, [], set()
        for text in texts:
            parts = split(text) if split and text else [text or ""]
            parts = [[p] if k % 2 else words_of(p) for k, p in enumerate(parts)]
            for p in parts[::2]:
                seen.update(p)
            cut.append(parts)
        memo = self.memo
        new = [w for w in seen if w not in memo]
        if new:
            memo.update(zip(new, self.encode_words(new)))
        get = memo.__getitem__
        out = [b"".join([np.int32(self.added[p[0]]).tobytes() if k % 2 else b"".join(map(get, p)) for k, p in enumerate(parts)]) for parts in cut]
        if len(memo) > _MEMO:
            # the words of these texts are the likeliest to come again
            memo = {w: memo[w] for w in seen if len(w) <= _LONGEST_MEMO} if len(seen) <= _MEMO else {}
        else:
            for w in new:
                if len(w) > _LONGEST_MEMO:
                    del memo[w]
        self.memo = memo
        return out

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement sign, unknown ids nothing."""
        get = self.tokens.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about _SLICE bytes of text."""
    start, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= _SLICE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocabulary_file: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int), and where ``decoded`` names a column, the text decoded from those ids.

    Null and empty texts have no ids and decode to the empty text. Rows are
    independent: repeated rows stay repeated with equal ids, an empty table gives an
    empty table, and very long texts take time in proportion (n log n within one
    fragment). Result columns win over input columns of the same name. The file is
    read by the driver; what it broadcasts is the vocabulary, which no table grows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges.load(vocabulary_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        for batch in batches:
            texts = batch.column("t")
            for a, b in _slices(texts):
                part = texts.slice(a, b - a)
                raw = merges.encode(part.to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                values = np.frombuffer(b"".join(raw), np.int32)
                columns = [batch.column("row").slice(a, b - a), part, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if decoded:
                    columns.append(pa.array([merges.decode(values[s:e].tolist()) for s, e in zip(ends[:-1], ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "t", "ids", "decoded"][:len(columns)])

    src = docs.select(packed(docs, text), F.col(f"`{text}`").cast("string").alias("t"))
    schema = f"row {src.schema['row'].dataType.simpleString()}, t string, ids array<int>" + (", decoded string" if decoded else "")
    out = src.mapInArrow(run, schema).withColumnRenamed("t", text)
    names = [text, "ids"]
    if decoded:
        out, names = out.withColumnRenamed("decoded", decoded), [*names, decoded]
    return unpacked(out, names)


def decode(encoded: DataFrame, vocabulary_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null and empty lists give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Merges.load(vocabulary_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([shared.value.decode(x or ()) for x in batch.column("i").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "decoded"])

    src = encoded.select(packed(encoded), F.col(f"`{ids}`").cast("array<int>").alias("i"))
    out = src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, decoded string").withColumnRenamed("decoded", decoded)
    return unpacked(out, [decoded])
