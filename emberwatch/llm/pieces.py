"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search keeps one state per position of a window as long as the longest piece:
the last piece of the best segmentation that ends there, and where it starts. When
the backpointer paths of all positions of the window run through one boundary,
everything before it is final; its ids are committed and the window moves on.
Memory is bounded by the longest piece, not by the text.

Two kinds of vocabulary are served. ``unigram``: the path of the largest sum of
piece scores. ``bpe``: the segmentation by merges in score order, which no sum of
scores describes. A segmentation by merges is the only one whose neighbouring
pieces all stay apart when merged alone, and its prefixes are segmentations by
merges themselves; so the state of a position is its one last piece that fits
behind the state where it starts, and the search is the same.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked

SPACE = "▁"
#: Entries kept per worker: encoded chunks, pairs of pieces, beginnings.
_MEMO, _PAIRS, _LOOK = 3 << 18, 1 << 19, 1 << 18
#: Bytes of text per output batch of a worker.
_SLICE = 4 << 20
_LONGEST_MEMO = 48
#: pieces that begin at a position are remembered by so many characters
AHEAD = 5
#: space signs with the characters behind them, up to the next space sign
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


class Pieces:
    """A vocabulary: ``scores`` of the normal pieces in id order and the ids of the 256 byte pieces, which spell what no piece covers."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], byte_ids: list[int], kind: str, prefix_space: bool = True):
        self.ids, self.scores, self.byte_ids, self.kind, self.prefix_space = ids, scores, byte_ids, kind, prefix_space
        self.longest = max(map(len, ids), default=1)
        self.text_of = {i: p.replace(SPACE, " ").encode() for p, i in ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        #: score of each piece; False where only longer pieces begin like this
        self.table: dict[str, float | bool] = {p[:k]: False for p in ids for k in range(1, len(p))} | scores
        self.floor = min(scores.values(), default=0.0) - 10.0
        #: no piece holds a space behind another character: every path has a boundary before such a space
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in ids)
        #: neighbouring characters within some piece; others are never merged, so what stands on both sides is encoded on its own
        self.pairs = {p[k:k + 2] for p in ids for k in range(len(p) - 1)}
        self.memo: dict[str, bytes] = {}
        self.name_of = {i: p for p, i in ids.items()}
        self.first_odd = max([0, *ids.values(), *byte_ids]) + 1
        self.apart: dict[int, bool] = {}
        self.look: dict[str, tuple] = {}

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """Vocabulary of a SentencePiece model with byte pieces; the kind is BPE where scores are ranks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids, scores, byte_ids = {}, {}, [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece], scores[piece] = i, sp.get_score(i)
        whole = all(s == int(s) for s in scores.values())
        return cls(ids, scores, byte_ids, "bpe" if whole else "unigram")

    def merged(self, text: str) -> list[str]:
        """Merge neighbours in score order, leftmost first. Called for pairs of pieces only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbours stay as they are when merged alone; kept for the pairs seen."""
        if len(self.apart) >= _PAIRS:
            self.apart.clear()
        pair = [self.piece(left), self.piece(right)]
        known = self.apart[left << 22 | right] = self.merged("".join(pair)) == pair
        return known

    def piece(self, i: int) -> str:
        return self.name_of[i] if i < self.first_odd else chr(i - self.first_odd)

    def beginning(self, text: str) -> tuple[tuple[tuple[int, int, float], ...], bool]:
        """Length, id and score of the pieces that ``text`` (up to AHEAD characters) begins with, and whether longer ones may.

        A character that no piece covers is a piece of its own, numbered behind the vocabulary.
        """
        found = []
        for n in range(1, len(text) + 1):
            s = self.table.get(text[:n])
            if n == 1 and (s is None or s is False):
                found.append((1, self.first_odd + ord(text[0]), self.floor))
            elif s is not None and s is not False:
                found.append((n, self.ids[text[:n]], s))
            if s is None:
                return tuple(found), False
        return tuple(found), len(text) == AHEAD

    def spelled(self, pieces) -> bytes:
        """The ids as 32-bit numbers; characters without a piece in bytes."""
        pieces = array("i", pieces)
        if not pieces or max(pieces) < self.first_odd:
            return pieces.tobytes()
        out = array("i")
        for i in pieces:
            if i < self.first_odd:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in chr(i - self.first_odd).encode("utf-8", "surrogatepass"))
        return out.tobytes()

    def stream(self, text: str) -> Iterator[int]:
        """Piece numbers of ``text``, each committed as soon as no later character can change it."""
        base, size, longest, bpe = 0, len(text), self.longest, self.kind == "bpe"  # everything before base is committed
        if bpe and size <= 2 * longest:
            yield from self._whole(text)
            return
        width = min(size, 3 * longest + 1) + 1
        starts, lasts, best = [-1] * width, [-1] * width, [0.0] * width  # states of the positions from base on; -1: not reached
        starts[0] = 0
        table, look, apart = self.table, self.look, self.apart
        for start in range(size):
            k = start - base
            if starts[k] < 0:
                continue
            left, so_far = lasts[k], best[k]
            ahead = text[start:start + AHEAD]
            got = look.get(ahead)
            if got is None:
                if len(look) >= _LOOK:
                    look.clear()
                got = look[ahead] = self.beginning(ahead)
            options, more = got
            if more:
                for n in range(AHEAD + 1, min(longest, size - start) + 1):
                    piece = text[start:start + n]
                    s = table.get(piece)
                    if s is None:
                        break
                    if s is not False:
                        options += ((n, self.ids[piece], s),)
            for n, piece, s in options:
                j = k + n
                if bpe:
                    # exactly one last piece fits at each position
                    if starts[j] < 0:
                        if left >= 0:
                            ok = apart.get(left << 22 | piece)
                            if ok is None:
                                ok = self.fits(left, piece)
                            if not ok:
                                continue
                        starts[j], lasts[j] = start, piece
                elif starts[j] < 0 or so_far + s > best[j]:
                    starts[j], lasts[j], best[j] = start, piece, so_far + s
            if k >= 2 * longest:
                # the paths of all positions that a later piece can start at
                alive = {p for p in range(k + 1, min(k + longest, size - base) + 1) if starts[p] >= 0}
                while len(alive) > 1:
                    high = max(alive)
                    alive.remove(high)
                    alive.add(starts[high] - base)
                cut = alive.pop()
                if 0 < cut <= k:
                    yield from self._path(starts, lasts, base, base + cut)
                    # the state of the cut stays, so that the next piece must fit behind it
                    starts, lasts, best = starts[cut:], lasts[cut:], best[cut:]
                    base += cut
                    starts[0] = base
                    starts += [-1] * cut
                    lasts += [-1] * cut
                    best += [0.0] * cut
                elif k + longest + 1 >= len(starts):
                    starts += [-1] * longest  # no common boundary yet
                    lasts += [-1] * longest
                    best += [0.0] * longest
        yield from self._path(starts, lasts, base, size)

    def _whole(self, text: str) -> list[int]:
        """``stream`` for merges where the text fits the window, so that nothing is committed before its end."""
        size, table, look, apart = len(text), self.table, self.look, self.apart
        starts, lasts = [-1] * (size + 1), [0] * (size + 1)
        starts[0] = 0
        for k, start in enumerate(starts):
            if start < 0 or k == size:
                continue
            ahead = text[k:k + AHEAD]
            got = look.get(ahead)
            if got is None:
                if len(look) >= _LOOK:
                    look.clear()
                got = look[ahead] = self.beginning(ahead)
            options, more = got
            if more:
                for n in range(AHEAD + 1, size - k + 1):
                    piece = text[k:k + n]
                    s = table.get(piece)
                    if s is None:
                        break
                    if s is not False:
                        options += ((n, self.ids[piece], s),)
            if not k:
                for n, piece, _ in options:
                    starts[n], lasts[n] = 0, piece
                continue
            left = lasts[k]
            behind = left << 22
            for n, piece, _ in options:
                j = k + n
                if starts[j] < 0:
                    ok = apart.get(behind | piece)
                    if ok is None:
                        ok = self.fits(left, piece)
                    if ok:
                        starts[j] = k
                        lasts[j] = piece
        return self._path(starts, lasts, 0, size)

    @staticmethod
    def _path(starts: list[int], lasts: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(lasts[end - base])
            end = starts[end - base]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for null and empty texts. A space sign within the text is spelled in bytes, so that decoding gives it back."""
        parts = (text or "").split(SPACE)
        out = self._encode(parts[0], self.prefix_space) if text else []
        sign = self.spelled([self.first_odd + ord(SPACE)])
        for part in parts[1:]:
            # the sign stands for a space inside pieces; what is between literal signs is encoded on its own
            out.append(sign)
            out += self._encode(part, False)
        return np.frombuffer(b"".join(out), np.int32)

    def _encode(self, text: str, prefix: bool) -> list[bytes]:
        text = (SPACE if prefix else "") + text.replace(" ", SPACE)
        if not self.cuts_at_space:
            return [self.spelled(self.stream(text))]
        out, memo, fits = [], self.memo, 2 * self.longest if self.kind == "bpe" else 0
        for chunk in _CHUNK(text):
            got = memo.get(chunk)
            if got is None:
                if len(chunk) <= fits:
                    got = self._joined(chunk)
                else:
                    got = self.spelled(self.stream(chunk))
                if len(chunk) <= _LONGEST_MEMO:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[chunk] = got
            out.append(got)
        return out

    def _joined(self, chunk: str) -> bytes:
        """The ids of a chunk of merges that fits the window, cut where no piece holds both characters."""
        pairs, memo = self.pairs, self.memo
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1:k + 1] not in pairs]
        if not cuts:
            return self.spelled(self._whole(chunk))
        out, start = [], 0
        for end in [*cuts, len(chunk)]:
            part, start = chunk[start:end], end
            got = memo.get(part)
            if got is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                got = memo[part] = self.spelled(self._whole(part))
            out.append(got)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; exact for what ``encode`` returned."""
        text_of = self.text_of
        raw = b"".join([text_of[i] for i in ids])
        return (raw[1:] if self.prefix_space and raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def slices(texts: pa.Array, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        held += n or 0
        if held >= size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_file: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """Adds ``ids``, and where ``decoded`` names a column, the text decoded from those ids.

    The model file is read by the driver and its pieces are broadcast (a vocabulary is
    bounded). Null and empty texts have no ids and decode to the empty text. Rows are
    independent: repeated rows stay repeated, an empty table gives an empty table. Result
    columns win over input columns of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = batch.column("t")
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                ids = [pieces.encode(t) for t in part.to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                columns = [batch.column("row").slice(a, b - a), part, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))]
                if decoded:
                    columns.append(pa.array([pieces.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "t", "ids", "decoded"][:len(columns)])

    src = docs.select(packed(docs, text), F.col(f"`{text}`").cast("string").alias("t"))
    schema = f"row {src.schema['row'].dataType.simpleString()}, t string, ids array<int>" + (", decoded string" if decoded else "")
    out = src.mapInArrow(run, schema).withColumnRenamed("t", text)
    if not decoded:
        return unpacked(out, [text, "ids"])
    return unpacked(out.withColumnRenamed("decoded", decoded), [text, "ids", decoded])


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids; null and empty lists give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_file))

    @F.pandas_udf("string")
    def texts_of(lists: pd.Series) -> pd.Series:
        return pd.Series([shared.value.decode([] if x is None else x.tolist()) for x in lists], dtype=object)

    src = encoded.select(packed(encoded), texts_of(F.col(f"`{ids}`")).alias("decoded"))
    return unpacked(src, ["decoded"])
