"""Encoding whole texts with a public tokenizer, remembering the short units they are made of.

A text is cut at safe boundaries, that is, between a character that is not white space and the
white space after it. No pre-token and no special token of the two tokenizer kinds here reaches
across such a place, so the ids of a text are those of its units one after another, and a unit is
handed to the library once per worker and remembered.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from slatewise.llm.arrays import prefix_hash, ranges, span_hash
from slatewise.llm.sentences import StreamingMerges

#: Unicode white space, as the tokenizer library's patterns read it.
WHITE = "\t-\r \x85\xa0  -     　"
#: Units that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of text given to the library in one batch.
BATCH_BYTES = 1 << 20

_spaced_units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_bare_units = re.compile(f"[^{WHITE}]+")
#: A space other than those of WHITE that str.split() would cut at.
_other_split = re.compile("[\x1c-\x1f]")
_latin = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level pre-tokenization writes each byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


_BYTES = _byte_alphabet()


def _merge_table(tokenizer: Tokenizer) -> tuple[tiktoken.Encoding, list[bytes], bytes]:
    """The vocabulary as byte ranks for the faster merge loop: the encoding, each rank's id, the word end.

    The mark of a word's end becomes the byte NUL, which no pre-token given to the merges holds,
    and joins its neighbour before any other merge, as the library attaches it before the first.
    """
    told = json.loads(tokenizer.to_str())["model"]
    vocab, suffix = told["vocab"], told.get("end_of_word_suffix") or ""
    kind = np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
    back = {c: b for b, c in _BYTES.items()}
    end = b"\x00" if suffix else b""

    def raw(token: str) -> bytes:
        if suffix and token.endswith(suffix):
            return bytes(map(back.__getitem__, token[: -len(suffix)])) + end
        return bytes(map(back.__getitem__, token))

    tokens = list(_BYTES.values()) + [c + suffix for c in _BYTES.values()] * bool(suffix)
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["merges"]]
    tokens += ["".join(m) for m in merges]
    ranks: dict[bytes, int] = {}
    ids: list[bytes] = []
    for t in tokens:
        if (key := raw(t)) not in ranks:
            ranks[key] = len(ids)
            ids.append(np.array([vocab[t]], kind).tobytes())
    return tiktoken.Encoding("units", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ids, end


class Units:
    """ids of unit strings; one object per worker process and tokenizer file.

    lower: the tokenizer lower-cases and drops white space; else a unit carries its own.
    """

    _kept: dict[tuple[str, bool], Units] = {}

    def __init__(self, path: str, lower: bool):
        self.lower = lower
        self.tokenizer = Tokenizer.from_file(path)
        self.encoding, self.rank_ids, self.end = _merge_table(self.tokenizer)
        self.merge = self.encoding._core_bpe.encode_single_piece
        self.kind = np.dtype(f"<u{len(self.rank_ids[-1])}")
        self.id_of_rank = np.frombuffer(b"".join(self.rank_ids), self.kind)
        self.ends = np.zeros(len(self.rank_ids), bool)
        self.ends[[r for t, r in self.encoding._mergeable_ranks.items() if self.end and t.endswith(self.end)]] = True
        self.ids: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, lower: bool) -> Units:
        key = (path, lower)
        if key not in cls._kept:
            cls._kept[key] = cls(path, lower)
        return cls._kept[key]

    def split(self, text: str) -> list[str]:
        if self.lower:
            return _bare_units.findall(text) if _other_split.search(text) else text.split()
        return _spaced_units.findall(text)

    def _word(self, piece: str) -> bytes:
        """One pre-token through the merges."""
        return b"".join([self.rank_ids[r] for r in self.merge(piece.encode() + self.end)])

    def learn(self, units: set[str]) -> None:
        """Encode units that aren't remembered yet."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        hard = []
        for u in units:
            m = _latin.fullmatch(u)
            if m:  # a plain word and the marks behind it: two pre-tokens
                space, word, marks = m.groups()
                word = self._word(word.lower() if self.lower else space + word)
                self.ids[u] = word + self._word(marks) if marks else word
            else:
                hard.append(u)
        batch, size = [], 0
        for n, u in enumerate(hard):
            batch.append(u)
            size += len(u)
            if size >= BATCH_BYTES or n == len(hard) - 1:
                for x, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                    self.ids[x] = np.array(e.ids, self.kind).tobytes()
                batch, size = [], 0

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a whole text, self.kind.itemsize bytes each."""
        units = self.split(text)
        missing = set(units).difference(self.ids)
        if missing:
            if len(self.ids) + len(missing) > REMEMBERED:
                missing = set(units)
            self.learn(missing)
        return b"".join(map(self.ids.__getitem__, units))

    def merged(self, words: str) -> np.ndarray:
        """Ranks of pre-tokens that each end in the mark's stand-in, NUL."""
        return np.array(self.encoding.encode_ordinary(words), np.int64)


#: Texts of these characters alone: every library reads their classes alike.
_familiar = re.compile("[^\x00-ɏ‐-‧€]")
#: Between a word and the white space after it; and, as a pre-token holds letters or numbers but never both, between an ASCII letter and a digit.
_cut = re.compile(f"[^{WHITE}](?=[{WHITE}])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def safe_pieces(text: str, limit: int) -> list[str]:
    """The text in pieces of about `limit` characters, cut only where no pre-token reaches across; one may be longer than that."""
    pieces, at = [], 0
    while len(text) - at > limit and (m := _cut.search(text, at + limit)):
        pieces.append(text[at : m.end()])
        at = m.end()
    pieces.append(text[at:])
    return pieces


class Counts:
    """Token counts of whole texts for a byte-level vocabulary without word ends.

    A run longer than `limit` without a safe boundary goes through the merges as a stream of bytes, whose
    window moves on wherever all ways to encode it meet.
    """

    _kept: dict[tuple[str, str], Counts] = {}

    def __init__(self, path: str, pattern: str, limit: int = 1 << 16):
        self.units, self.limit = Units.of(path, lower=False), limit
        special = {t.content: i for i, t in self.units.tokenizer.get_added_tokens_decoder().items()}
        ranks = self.units.encoding._mergeable_ranks
        top = max(ranks.values())
        self.fast = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t: top + 1 + n for n, t in enumerate(special)})
        self.special = re.compile("|".join(f"({re.escape(t)})" for t in special)) if special else None
        self.pattern = regex.compile(pattern)
        self.stream: StreamingMerges | None = None

    @classmethod
    def of(cls, path: str, pattern: str) -> Counts:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def _long(self, piece: str) -> int:
        """A piece that has no safe boundary within its limit, pre-token by pre-token."""
        n, at = 0, 0
        for m in [*(self.special.finditer(piece) if self.special else ()), None]:
            end = m.start() if m else len(piece)
            for token in self.pattern.finditer(piece, at, end):
                own = token[0].encode()
                if len(own) <= self.limit:
                    n += len(self.units.merge(own))
                else:
                    if self.stream is None:
                        self.stream = StreamingMerges({t.decode("latin-1"): -float(r) for t, r in self.units.encoding._mergeable_ranks.items()})
                    n += sum(1 for _ in self.stream.segments(own[i : i + self.limit].decode("latin-1") for i in range(0, len(own), self.limit)))
            if m:
                n, at = n + 1, m.end()
        return n

    def count_batch(self, held: list[tuple[int, str]]) -> list[tuple[int, int]]:
        """Counts of (row, piece) pairs, as (row, count): familiar texts in one batch of the merge library, others by their units learned in one batch."""
        out, plain, other = [], [], []
        for row, piece in held:
            if len(piece) > 2 * self.limit:
                out.append((row, self._long(piece)))
            else:
                (other if _familiar.search(piece) else plain).append((row, piece))
        out += [(row, len(x)) for (row, _), x in zip(plain, self.fast.encode_batch([p for _, p in plain], num_threads=1, allowed_special="all"), strict=True)]
        split = [(row, self.units.split(p)) for row, p in other]
        missing = {u for _, own in split for u in own}.difference(self.units.ids)
        if missing and len(self.units.ids) + len(missing) > REMEMBERED:
            self.units.ids.clear()
            missing = {u for _, own in split for u in own}
        self.units.learn(missing)
        size = self.units.kind.itemsize
        return out + [(row, sum(len(self.units.ids[u]) for u in own) // size) for row, own in split]


#: Classes of bytes in texts of ASCII and the letters of Latin-1: 0 other, 1 letter, 2 digit, 3 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[[*range(9, 14), 32]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold only ASCII without NUL, apostrophe and "<|", and Latin-1 letters (C3 80 to C3 BF but for the two signs)."""
    odd = (data == 0) | (data == 39)
    high = data >= 128
    if high.any():
        lead, before = data == 0xC3, np.zeros(len(data), bool)
        before[1:] = lead[:-1]
        odd |= high & ~lead & ~before | before & ((data == 0x97) | (data == 0xB7))
    bar = np.zeros(len(data), bool)
    bar[1:] = (data[1:] == 124) & (data[:-1] == 60)
    bad = np.zeros(len(data) + 1, np.int64)
    np.cumsum(odd | bar, out=bad[1:])
    return bad[offsets[1:]] == bad[offsets[:-1]]


def encode_lowered(units: Units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of every row for a lower-casing tokenizer with word ends, one after another, and the count of each row."""
    n = len(offsets) - 1
    plain = _plain(data, offsets) if n else np.zeros(0, bool)
    # a pre-token starts where the class changes, at each digit, and at each row
    kind = _CLASS[data]
    starts = np.ones(len(data), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inner = offsets[:-1][offsets[:-1] < len(data)]
    starts[inner] = True
    kept = (kind != 3) & np.repeat(plain, np.diff(offsets))
    heads = np.flatnonzero(starts & kept)
    low = _LOWER[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    low[upper] += 32
    words_in_row = np.bincount(np.searchsorted(offsets, heads, side="right") - 1, minlength=n)
    # each distinct pre-token once, with a NUL behind it
    body = low[kept]
    begin = (np.cumsum(kept) - 1)[heads]  # of each pre-token among the kept bytes
    size = np.diff(np.append(begin, len(body)))
    _, first, which = np.unique(span_hash(prefix_hash(body), begin, begin + size), return_index=True, return_inverse=True)
    marked = np.insert(body[ranges(begin[first], size[first])], np.cumsum(size[first]), 0)
    ranks = units.merged(marked.tobytes().decode())
    last = np.flatnonzero(units.ends[ranks])  # the last rank of each pre-token
    if len(last) != len(first):
        raise AssertionError("pre-tokens and word ends differ")
    begins = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    sizes = last + 1 - begins
    ids = units.id_of_rank[ranks][ranges(begins[which], sizes[which])]
    bounds = np.concatenate([[0], np.cumsum(sizes[which])])[np.concatenate([[0], np.cumsum(words_in_row)])]
    counts = np.diff(bounds)
    if plain.all():
        return ids, counts
    out = []
    for i in range(n):
        if plain[i]:
            out.append(ids[bounds[i] : bounds[i + 1]])
        else:
            out.append(np.frombuffer(units.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode()), units.kind))
            counts[i] = len(out[-1])
    return np.concatenate(out), counts
