"""Operator 1: SentencePiece encoding and decoding of whole texts in a window bounded by the longest piece."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.session import workers_see

#: Characters given to the stream at once.
STEP = 1 << 12
#: Units that a worker remembers before it lets the older half go, pairs of pieces, and the longest unit that it remembers.
REMEMBERED, PAIRS, SHORT = 800_000, 300_000, 48
#: The mark that stands for a space.
SPACE = "▁"
#: A space between two words: pieces of the model begin with the space's mark or hold nothing but marks, so none reaches across.
_gap = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
#: A run of Latin letters or of other marks, with the space before it; and a place where a piece mixes them.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_run = re.compile(f" ?(?:[{_LATIN}]+|[^ {_LATIN}]+)")
_mixed = re.compile(f"[{_LATIN}][^{_LATIN}]|[^▁{_LATIN}][{_LATIN}]")


class StreamingPaths:
    """Segmentation of a stream into pieces by backpointers, in a window.

    `back(window, base, at)` gives the start of the last piece of the best path to place `at`; the window is the text from `base` on.
    The window keeps one path per place within the longest piece. As soon as all of these paths pass one
    boundary, what is before it can no longer change: it is put out and forgotten.
    """

    def __init__(self, pieces: Iterable[str]):
        self.longest = max(map(len, pieces), default=1)

    def begin(self, base: int) -> None:
        """The window starts at `base`, a boundary of every path."""

    def segments(self, parts: Iterable[str]) -> Iterator[str]:
        text, base, at = "", 0, 0
        self.links: dict[int, int] = {}
        self.begin(0)
        for part in parts:
            text += part
            while at < base + len(text):
                at += 1
                self.links[at] = self.back(text, base, at)
                if at - base >= 2 * self.longest and at % self.longest == 0:
                    done = self._common(base, at)
                    if done > base:
                        yield from self._path(text, base, done)
                        text = text[done - base :]
                        for i in range(base, done):
                            self.links.pop(i, None)
                        base = done
                        self.begin(base)
        yield from self._path(text, base, at)

    def _common(self, base: int, at: int) -> int:
        """The last boundary that every path alive has in common."""
        alive = set(range(max(base, at - self.longest + 1), at + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.links[last] if last > base else base)
        return alive.pop()

    def _path(self, text: str, base: int, end: int) -> list[str]:
        out, at = [], end
        while at > base:
            out.append(text[self.links[at] - base : at - base])
            at = self.links[at]
        return out[::-1]


class StreamingViterbi(StreamingPaths):
    """The best path by the sum of piece scores (a unigram model); a character that no piece covers counts `unknown`."""

    def __init__(self, pieces: dict[str, float], unknown: float = -100.0):
        super().__init__(pieces)
        self.pieces, self.unknown = pieces, unknown

    def begin(self, base: int) -> None:
        self.best = {base: 0.0} if base == 0 else {i: x for i, x in self.best.items() if i >= base}

    def back(self, text: str, base: int, at: int) -> int:
        best = self.best
        top, frm = best[at - 1] + self.pieces.get(text[at - 1 - base : at - base], self.unknown), at - 1
        for start in range(max(base, at - self.longest), at - 1):
            score = self.pieces.get(text[start - base : at - base])
            if score is not None and best[start] + score > top:
                top, frm = best[start] + score, start
        best[at] = top
        return frm


class StreamingMerges(StreamingPaths):
    """The path of a pair-merging (BPE) model, which merges the best-scored pair of neighbours first.

    The encoding of a text's beginning ends in the one piece that can stand beside the last piece of what is before it: no pair
    across their border is merged before both are whole. So each place needs its last piece only, and the
    backpointers hold the encodings of all beginnings.
    """

    def __init__(self, pieces: dict[str, float]):
        super().__init__(pieces)
        self.pieces = pieces
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        #: lengths of the pieces that end in two characters, the longest first
        self.lengths = {end: sorted(n, reverse=True) for end, n in lengths.items()}
        self.borders: dict[str, tuple[list, list] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _grown(self, piece: str) -> tuple[list, list] | None:
        """How the parts at the piece's two ends grow while it is merged: [(part, score that the next growth waits for)], left and right; None if its merges end in something else."""
        parts = list(piece)
        left, right = [], []
        low_left = low_right = float("inf")
        while len(parts) > 1:
            joined = [self.pieces.get(a + b, -float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(joined)
            if best == -float("inf"):
                return None
            i = joined.index(best)
            low_left, low_right = min(low_left, best), min(low_right, best)
            if i == 0:
                left.append((parts[0], low_left))
                low_left = float("inf")
            if i == len(parts) - 2:
                right.append((parts[-1], low_right))
                low_right = float("inf")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        end = (piece, -float("inf"))
        return [*left, end], [*right, end]

    def _border(self, piece: str) -> tuple[list, list] | None:
        if piece not in self.borders:
            if len(self.borders) > PAIRS:
                self.borders.clear()
            self.borders[piece] = self._grown(piece)
        return self.borders[piece]

    def _beside(self, left: str, right: str) -> bool:
        """Do the merges of left + right end in just these two?"""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(self._border(left), self._border(right))
        return known

    def _apart(self, left: tuple[list, list] | None, right: tuple[list, list] | None) -> bool:
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (a, wait_a), (b, wait_b) = left[1][i], right[0][j]
            across = self.pieces.get(a + b)
            # of equal scores the leftmost pair goes first
            if across is not None and across > wait_a and across >= wait_b:
                return False
            if wait_a == wait_b == -float("inf"):
                return True
            if wait_a >= wait_b:
                i += 1
            else:
                j += 1

    def begin(self, base: int) -> None:
        if base == 0:
            self.last: dict[int, str] = {0: ""}
        else:
            self.last = {i: x for i, x in self.last.items() if i >= base}

    def back(self, text: str, base: int, at: int) -> int:
        end, last, pieces, pairs = at - base, self.last, self.pieces, self.pairs
        for n in self.lengths.get(text[max(0, end - 2) : end], ()):
            if n <= end and (piece := text[end - n : end]) in pieces:
                before = last[at - n]
                if before:
                    known = pairs.get((before, piece))
                    if known is None:
                        known = self._beside(before, piece)
                else:
                    known = self._border(piece) is not None
                if known:
                    last[at] = piece
                    return at - n
        last[at] = text[end - 1]
        return at - 1


class Codec:
    """Encoding by the pieces of a model file; one object per worker process and file.

    A text is taken in units that no piece reaches across: what lies between two single spaces, and, where no piece
    of the model mixes them, runs of Latin letters and of other marks. Short units are remembered with their ids, so the
    stream runs over each of them once.
    """

    _kept: dict[str, Codec] = {}

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        own = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.ids = {self.library.id_to_piece(i): i for i in own}
        scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        # a pair-merging model's scores are ranks
        ranks = all(x == int(x) for x in scores.values())
        self.paths = StreamingMerges(scores) if ranks else StreamingViterbi(scores, unknown=min(scores.values(), default=0.0) - 10)
        self.runs = not any(_mixed.search(p) for p in scores)
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.units: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _ids(self, parts: Iterable[str]) -> list[int]:
        out: list[int] = []
        for piece in self.paths.segments(parts):
            known = self.ids.get(piece)
            if known is None:
                out.extend([self.bytes[b] for b in piece.encode()])
            else:
                out.append(known)
        return out

    def _units(self, text: str) -> list[str]:
        """Units with the space before them."""
        if self.runs and "  " not in text and SPACE not in text and text[0] != " " != text[-1]:
            return _run.findall(" " + text)
        out: list[str] = []
        for part in _gap.split(text):
            if not self.runs or " " in part or SPACE in part:
                out.append(" " + part)
            else:
                out += _run.findall(" " + part)
        return out

    def _learned(self, unit: str) -> list[int]:
        marked = unit.replace(" ", SPACE)
        if len(unit) > SHORT:
            return self._ids(marked[i : i + STEP] for i in range(0, len(marked), STEP))
        if len(self.units) > REMEMBERED // 2:
            self.older, self.units = self.units, {}
        found = self.older.get(unit)
        self.units[unit] = found = self._ids([marked]) if found is None else found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.units
        for unit in self._units(text):
            ids = known.get(unit)
            if ids is None:
                ids = self._learned(unit)
                known = self.units
            out += ids
        return out


def encoded(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids): ids of each whole text, as the library gives them for the model file.

    Pieces come from backpointers in a window that goes on as soon as all paths alive meet (`StreamingPaths`): of a
    unigram model the best-scored path, of a pair-merging model the merges' own. A null text is empty; an empty one has no ids.
    Rows are encoded one by one, repeated or with null ids. Further columns are ignored. An empty table gives an empty table.
    """
    workers_see(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [codec.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(len, ids)), pa.int64()), _lists(ids)], ["doc_id", "n_bytes", "n_tokens", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, ids array<int>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def round_trip(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_crc32, text): texts encoded as by `encoded` and decoded again as by `decoded`, in one pass."""
    workers_see(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [codec.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(map(len, ids)), pa.int64()), *_decoded(codec, ids)], ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "text"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, ids_crc32 long, text string")


def _decoded(codec: Codec, ids: list[list[int]]) -> list[pa.Array]:
    """Checksums and texts of id lists."""
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    return [pa.array(crc, pa.int64()), pa.array(codec.library.decode(ids, num_threads=1) if ids else [], pa.string())]


def decoded(rows: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_crc32, text): the texts of id lists, the inverse of `encoded` where the text holds no mark of its own.

    A null list is an empty one. An id that the model lacks raises the library's error. Rows are decoded one by one,
    repeated or with null ids; an empty table gives an empty table.
    """
    workers_see(rows.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [x or [] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *_decoded(codec, ids)], ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "text"])

    return rows.select("doc_id", "n_bytes", "n_tokens", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, ids_crc32 long, text string")
