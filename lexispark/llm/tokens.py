"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between white space.

Both public vocabularies cut a text at single spaces and line ends before any merge, so a piece's ids don't depend on its
neighbours. Arrow splits a step's texts and numbers its distinct pieces; numpy looks these up by 128-bit hashes in a table
of what the worker has met; the library encodes the rest, and numpy puts the ids together. The hash is the sum of random
numbers that stand for the bytes at their places, so two pieces share it with a chance of 2 ** -128. A text with anything
that could move a cut (runs of white space, control characters, characters beyond U+027F, the string of an added token)
goes to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import memo, ragged

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces, and ids of them, that a worker remembers at most; then it starts anew.
MEMO_PIECES, MEMO_IDS = 800_000, 6_000_000
#: Bytes of the pieces that are remembered.
_LONGEST = 64
#: Bytes of text in a step: the distinct pieces of a step are looked up once.
STEP_BYTES = 2_000_000
#: Pieces that the library gets in one text.
_JOINED = 500

#: Controls but line feed, U+007F to U+00A0, U+0130 (two characters in lower case), and what lies beyond U+027F.
_ODD = r"[\x00-\x09\x0b-\x1f\x{7f}-\x{a0}\x{130}\x{280}-\x{10ffff}]"
#: White space that a byte-level vocabulary doesn't cut one at a time.
_RUNS = r"  | \n|\n\n\n|\n\n | \z|\n\n\z"
#: Letters, then marks: to either vocabulary two pieces of their own.
_MARKED = re.compile(r"([^\W\d_]+)([.,;:!?$#*%&|<>()\]\[{}\"+=~^@/-]+)")


class _Grown:
    """An array of int32 that grows at its end."""

    def __init__(self):
        self.data, self.size = np.zeros(1024, np.int32), 0

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), np.int32)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = more
        self.size = need


_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, (2, _LONGEST * 256), np.uint64)
_SPACE = np.random.default_rng(21).integers(0, 1 << 64, 2, np.uint64)


def _hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each piece, 2 x pieces, and which of them are too long to be remembered."""
    _, offsets, data = pieces.buffers()
    n = len(pieces)
    out = np.zeros((2, n), np.uint64)
    offsets = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + n + 1].astype(np.int64)
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    if len(some):
        place = np.minimum(ragged(np.zeros(len(some), np.int64), sizes[some]), _LONGEST - 1)
        place *= 256
        place += np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        for k in (0, 1):
            out[k, some] = np.add.reduceat(_RANDOM[k][place], offsets[some] - offsets[0])
    return out, sizes > _LONGEST


class _Table:
    """Hashes to numbers: open addressing in numpy, all of a step's pieces at once."""

    def __init__(self, size: int = 1 << 16):
        self.mask, self.held = np.uint64(size - 1), 0
        self.keys, self.numbers = np.zeros((2, size), np.uint64), np.full(size, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers, or -1."""
        out = np.full(h.shape[1], -1, np.int64)
        open_, slot = np.arange(h.shape[1]), (h[0] & self.mask).astype(np.int64)
        while len(open_):
            found = self.numbers[slot]
            hit = (self.keys[0][slot] == h[0, open_]) & (self.keys[1][slot] == h[1, open_]) & (found >= 0)
            out[open_[hit]] = found[hit]
            on = ~hit & (found >= 0)
            open_, slot = open_[on], (slot[on] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Hashes that differ and aren't there yet."""
        self.held += h.shape[1]
        if 2 * self.held > len(self.numbers):
            keys, known, was = self.keys, self.numbers, self.numbers >= 0
            self.__init__(1 << (2 * self.held).bit_length())  # at most half full, a quarter at least
            self.add(keys[:, was], known[was])
            self.held += h.shape[1]
        open_, slot = np.arange(h.shape[1]), (h[0] & self.mask).astype(np.int64)
        while len(open_):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[open_[free]]  # of several that want a slot one gets it
            got = free & (self.numbers[slot] == numbers[open_])
            self.keys[:, slot[got]] = h[:, open_[got]]
            open_, slot = open_[~got], (slot[~got] + 1) & int(self.mask)


class Encoder:
    """path: a file of the tokenizers library, or the name of a public one. keep_spaces: pieces keep the space before them
    (byte-level vocabulary); otherwise white space is dropped and letters are lower case (word vocabulary)."""

    def __init__(self, path: str, keep_spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.keep_spaces = keep_spaces
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *added, *([_RUNS] if keep_spaces else [])])
        self._forget()

    def _forget(self) -> None:
        self.known, self.table = 0, _Table()
        self.starts, self.lengths, self.pool = _Grown(), _Grown(), _Grown()

    def _joined(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words of letters, each with the space before it if any, and the number of each one's ids."""
        ids, lengths = [], []
        for a in range(0, len(words), _JOINED):
            own = words[a : a + _JOINED]
            found = self.tokenizer.encode(("" if self.keep_spaces else " ").join(own), add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            lengths.append(np.bincount(np.array(found.word_ids, np.int64)))
            if len(lengths[-1]) != len(own):
                raise ValueError("the tokenizer cuts words that are letters alone")
        return ids, lengths

    def _keep(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.starts.data[numbers] = self.pool.size + np.cumsum(sizes) - sizes
        self.lengths.data[numbers] = sizes
        self.pool.add(ids)

    def _find(self, h: np.ndarray, long_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces, which are distinct; the unknown ones, whose places come second, get the next."""
        number = self.table.find(h)
        new = np.flatnonzero((number < 0) | long_)
        number[new] = self.known + np.arange(len(new))
        some = new[~long_[new]]
        self.table.add(h[:, some], number[some])
        self.known += len(new)
        more = np.zeros(len(new), np.int32)
        self.starts.add(more)
        self.lengths.add(more)
        return number, new

    def _learn(self, pieces: list[str], numbers: np.ndarray) -> None:
        """Remembers new pieces. Letters are one word to the library, letters and marks are two; the rest goes to it as it is."""
        words, others, marked, parts = [], [], [], {}
        joinable = " " if self.keep_spaces else ""  # what a word needs before it to be cut from the one before
        for n, piece in zip(numbers.tolist(), pieces):
            core = piece[1:] if piece[:1] == " " else piece
            if core.isalpha():
                (words if piece[:1] == joinable or not joinable else others).append((n, piece))
            elif (m := _MARKED.fullmatch(core)) and m[1].isalpha():
                letters = m[1] if core is piece else " " + m[1]
                marked.append((n, parts.setdefault(letters, len(parts)), parts.setdefault(m[2], len(parts))))
            else:
                others.append((n, piece))
        ids, lengths = self._joined([w for _, w in words])
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([w for _, w in others], add_special_tokens=False)]
        lengths.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        ids.append(np.fromiter(chain.from_iterable(alone), np.int32, int(lengths[-1].sum())))
        self._keep(np.array([n for n, _ in words + others], np.int64), np.concatenate(lengths), np.concatenate(ids))
        if marked:
            own = list(parts)
            spaced = np.array([p[0] == " " for p in own])
            h, long_ = _hashes(pa.array([p[1:] if p[0] == " " else p for p in own], pa.string()))
            h[:, spaced] += _SPACE[:, None]
            number, new = self._find(h, long_)
            if len(new):
                self._learn([own[k] for k in new.tolist()], number[new])
            place, *both = np.array(marked, np.int64).T
            both = number[np.stack(both, axis=1).ravel()]
            sizes = self.lengths.data[both]
            self._keep(place, sizes.reshape(-1, 2).sum(axis=1), self.pool.data[ragged(self.starts.data[both], sizes)])

    def _pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The pieces of all texts, which of them begin a text or line, and the number of each text's pieces."""
        if self.keep_spaces:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        else:
            split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        codes = flat.dictionary_encode()
        if not self.keep_spaces:
            return codes, np.zeros(len(flat), bool), np.diff(offsets)
        line = pc.index_in(pa.scalar("\n"), codes.dictionary).as_py() if len(flat) else None
        code = codes.indices.to_numpy()
        first = np.zeros(len(flat), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        if line is not None:
            first[1:] |= code[:-1] == line
            first |= code == line
        return codes, first, np.diff(offsets)

    def _numbers(self, distinct: pa.Array, form: np.ndarray) -> np.ndarray:
        """Numbers of the forms (2 * place in distinct, and 1 more at the beginning of a text or line)."""
        used = np.flatnonzero(np.bincount(form, minlength=2 * len(distinct)))
        place, spaced = used >> 1, (used & 1 == 0) & self.keep_spaces
        h, long_ = _hashes(distinct)
        h = h[:, place]
        h[:, spaced] += _SPACE[:, None]
        number, new = self._find(h, long_[place])
        if len(new):
            pieces = distinct.take(pa.array(place[new])).to_numpy(zero_copy_only=False).tolist()
            self._learn([" " + p if x else p for p, x in zip(pieces, spaced[new].tolist())], number[new])
        out = np.zeros(2 * len(distinct), np.int64)
        out[used] = number
        return out

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of each text's ids. A null is empty."""
        if self.known > MEMO_PIECES or self.pool.size > MEMO_IDS:
            self._forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd)
        codes, first, counts = self._pieces(texts.filter(pa.array(~odd)) if len(whole) else texts)
        form = codes.indices.to_numpy().astype(np.int64) * 2 + first
        at = self._numbers(codes.dictionary, form)[form]
        sizes = self.lengths.data[at]
        ids = self.pool.data[ragged(self.starts.data[at], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        if not len(whole):
            return ids, np.diff(ends, prepend=0)
        lengths = np.zeros(len(texts), np.int64)
        lengths[~odd] = np.diff(ends, prepend=0)
        by_library = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        lengths[whole] = list(map(len, by_library))
        out = np.empty(int(lengths.sum()), np.int32)
        begin = np.cumsum(lengths) - lengths
        out[ragged(begin[~odd], lengths[~odd])] = ids
        for a, x in zip(begin[whole].tolist(), by_library):
            out[a : a + len(x)] = x
        return out, lengths


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
memo("tokens", _ENCODERS.clear)


def encoder(path: str, keep_spaces: bool) -> Encoder:
    """The worker's encoder; it stays for the worker's next tasks."""
    if (path, keep_spaces) not in _ENCODERS:
        _ENCODERS[path, keep_spaces] = Encoder(path, keep_spaces)
    return _ENCODERS[path, keep_spaces]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    sizes = lengths + 1
    out = np.full(int(sizes.sum()), end_id, kind)
    out[ragged(np.cumsum(sizes) - sizes, lengths)] = ids
    return out, sizes
