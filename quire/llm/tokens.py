"""Token ids of whole texts by a ``tokenizers`` vocabulary, cached by white-space chunk.

A vocabulary whose pre-tokenizer drops white space treats a text as its ASCII white-space chunks
one after another, so each distinct chunk is encoded once per worker by the library and the texts
are assembled from the cached ids by a ragged gather. Closing punctuation after an ASCII letter is a
pre-token of its own and A-Z count as a-z, so words are encoded once whatever case or mark they
come with. A worker knows chunks by 64-bit hashes of their bytes: most lie in a table at a slot that
the hash names, the others among sorted hashes. New words of Latin letters go to the library many at
a time, past its splitting by pattern, and are told apart by the ids that close a word.
``tests/llm`` compares whole texts with the library's own whole-text encoding.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from quire.llm import common as C

#: Chunks, and words of Latin letters, joined into one library call.
CHUNKS_PER_CALL, WORDS_PER_CALL = 64, 512
#: Bits of a hash that name its slot (12 bytes each) in a worker's table.
SLOT_BITS = 20
#: Closing marks at the end of a chunk that are stepped over one by one.
MARKS = 4
#: Chunks a worker keeps (about 50 bytes each); beyond that the cache starts afresh (bounds memory, not results).
KEEP_CHUNKS = 2_000_000
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 21
#: ASCII marks that end a chunk as a pre-token of their own; no special token ends in one of them.
_CLOSING = np.isin(np.arange(256), [ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
#: Bytes of ASCII letters and of U+00C0 to U+023F, which are letters in NFC but for U+00D7 and U+00F7;
#: U+0130 alone of them is no letter when lower-cased.
_LATIN = _LETTER | np.isin(np.arange(256), [*range(0x80, 0xC0), *range(0xC3, 0xC9)])
_NOT_LATIN = (0xC397, 0xC3B7, 0xC4B0)


def _before_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each chunk's last byte that is no closing mark lies; before the chunk without one. Few
    chunks end in a mark, and few of those in more than ``MARKS``: only these are looked at in full."""
    last = ends - 1
    at = np.flatnonzero(_CLOSING[data[last]])
    for _ in range(MARKS):
        last[at] -= 1
        at = at[last[at] >= starts[at]]
        at = at[_CLOSING[data[last[at]]]]
    if len(at):
        last[at] = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))[ends[at] - 1]
    return last


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct hashes, a place of each, each hash's number among them)."""
    by = np.argsort(hashes)  # any place of a hash does, so the sort need not be stable
    ordered = hashes[by]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]] if len(by) else np.zeros(0, bool)
    inverse = np.empty(len(by), np.int64)
    inverse[by] = np.cumsum(fresh) - 1
    return ordered[fresh], by[fresh], inverse


def _not_latin(data: np.ndarray) -> np.ndarray:
    """Where a byte is none of a Latin letter that stays one letter in lower case."""
    out = ~_LATIN[data]
    at = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC4))
    out[at[np.isin(data[at].astype(np.int64) << 8 | data[at + 1], _NOT_LATIN)]] = True
    return out


def _put(store: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``store`` with ``new`` after its first n places, with room for as many again where it was full."""
    if n + len(new) > len(store):
        store = np.concatenate([store[:n], np.empty(n + 2 * len(new), store.dtype)])
    store[n : n + len(new)] = new
    return store


class ChunkEncoder:
    """Token ids of texts; ``path`` is the vocabulary file on every machine."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        plain = [(i, t) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.border, self.border_text = (plain[-1][0], plain[-1][1].content) if plain else (None, None)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        split, level = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The merge model alone, for words of a-z and of Latin letters between spaces.
        self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer, self.latin.pre_tokenizer = split, pre_tokenizers.Sequence([split, level])
        self.latin.normalizer = normalizers.Lowercase()
        #: Whether words of Latin letters may go straight to the merge model.
        probes = [(self.ascii, "Probe"), (self.ascii, "abcxyz"), (self.ascii, "Q"), (self.latin, "\u00c9t\u00e9\u00df"), (self.latin, "\u0141\u00f3d\u017aA"), (self.latin, "\u0132")]
        self.direct = bool(suffix) and all(self._whole(w) == kind.encode(w.lower() if kind is self.ascii else w).ids for kind, w in probes)
        self._reset()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, model, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words of Latin letters one after another, number of ids of each); a space ends each word."""
        edges = np.r_[0, np.cumsum(size)]
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(size), WORDS_PER_CALL):
            a, b = edges[k], edges[min(k + WORDS_PER_CALL, len(size))]
            part = text[a : b - 1].tobytes().decode()
            ids = np.array(model.encode_batch_fast([part], add_special_tokens=False)[0].ids, dtype=np.uint32)
            counts = np.diff(np.r_[0, np.flatnonzero(self.closes[ids]) + 1])
            if len(counts) != min(WORDS_PER_CALL, len(size) - k) or counts.sum() != len(ids):  # the vocabulary lacks a letter
                lists = [self._whole(w) for w in part.split(" ")]
                counts, ids = np.array([len(x) for x in lists]), np.array([*chain.from_iterable(lists)], dtype=np.uint32)
            flat.append(ids)
            lengths.append(counts)
        return np.concatenate(flat), np.concatenate(lengths)

    def _reset(self) -> None:
        self.n_chunks = self.n_ids = 0
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # chunks by slot, where they found it empty (an empty one has another's hash); the others by ascending hash
        self.slot_hash, self.slot_at = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        self.slot_hash[0] = np.uint64(2**64 - 1)
        self.known, self.known_at = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _is_word(self, chunk: str) -> bool:
        """Whether the chunk is one pre-token of letters."""
        return self.direct and chunk.isalpha() and unicodedata.is_normalized("NFC", chunk)

    def _of_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words of letters beyond ASCII, told apart by the ids that close a word."""
        out: list[list[int]] = []
        for at in range(0, len(words), CHUNKS_PER_CALL):
            part = words[at : at + CHUNKS_PER_CALL]
            ids = np.array(self._whole(" ".join(part)), dtype=np.uint32)
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) == len(part):
                out += [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
            else:  # some word is not one pre-token after all
                out += [self._whole(w) for w in part]
        return out

    def _of_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of any chunks by the library's whole pipeline; a special token marks the borders."""
        out: list[list[int]] = []
        for at in range(0, len(chunks), CHUNKS_PER_CALL):
            part = chunks[at : at + CHUNKS_PER_CALL]
            if self.border is not None and not any(self.border_text in c for c in part):
                ids = np.array(self._whole(self.border_text.join(part)), dtype=np.uint32)
                cuts = np.flatnonzero(ids == self.border).tolist()
                out += [ids[a:b].tolist() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]
            else:
                out += [self._whole(c) for c in part]
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Encodes the chunks at these spans, which have these ascending hashes; their numbers."""
        size = ends - starts + 1  # the chunks' bytes, each with a space
        edges = np.r_[0, np.cumsum(size)]
        at = C.ragged_at(starts, size)
        at[edges[1:] - 1] = 0
        text = data[at]
        text[edges[1:] - 1] = 0x20
        only = lambda flags: np.add.reduceat(flags, edges[:-1], dtype=np.int64) == 1  # the space alone
        plain, ascii_only = np.full(len(starts), self.direct) & only(_not_latin(text)), only(~_LETTER[text])
        ids, lengths, order = [], [], []
        for at, model in ((np.flatnonzero(plain & ascii_only), self.ascii), (np.flatnonzero(plain & ~ascii_only), self.latin)):
            flat, sizes = self._merged(model, C.ragged_take(text, edges[at], size[at]), size[at])
            ids.append(flat)
            lengths.append(sizes)
            order.append(at)
        rest = np.flatnonzero(~plain)
        raw = memoryview(np.ascontiguousarray(data))
        chunks = [str(raw[a:b], "utf-8") for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        word = np.fromiter(map(self._is_word, chunks), dtype=bool, count=len(chunks))
        for which, encoded in ((word, self._of_words), (~word, self._of_chunks)):
            at = np.flatnonzero(which)
            lists = encoded([chunks[i] for i in at.tolist()])
            lengths.append(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(lengths[-1].sum())))
            order.append(rest[at])
        lengths = np.concatenate(lengths)
        number = np.empty(len(lengths), np.int32)
        number[np.concatenate(order)] = np.arange(len(lengths)) + self.n_chunks
        flat = np.concatenate(ids)
        self.starts = _put(self.starts, self.n_chunks, self.n_ids + np.cumsum(lengths) - lengths)
        self.lengths = _put(self.lengths, self.n_chunks, lengths)
        self.flat = _put(self.flat, self.n_ids, flat)
        self.n_chunks, self.n_ids = self.n_chunks + len(lengths), self.n_ids + len(flat)
        slot = self._slots(hashes)
        own = (self.slot_at[slot] < 0) & np.r_[True, slot[1:] != slot[:-1]]
        self.slot_hash[slot[own]], self.slot_at[slot[own]] = hashes[own], number[own]
        place = np.searchsorted(self.known, hashes[~own])
        self.known, self.known_at = np.insert(self.known, place, hashes[~own]), np.insert(self.known_at, place, number[~own])
        return number

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray):
        """(bytes to encode, start, end of every chunk, number of chunks of each row)."""
        starts, ends, counts = C.word_spans(data, offsets)
        if not self.direct or not len(starts):
            return data, starts, ends, counts
        low = C.lowered(data)
        for at in np.flatnonzero(data == ord("<")):  # special tokens are matched before lower-casing
            w = np.searchsorted(starts, at, side="right") - 1
            low[starts[w] : ends[w]] = data[starts[w] : ends[w]]
        last = _before_marks(data, starts, ends)
        cut = (last + 1 < ends) & (last >= starts) & _LETTER[data[last]]
        at = np.flatnonzero(cut)
        new = at + 1
        head_ends = np.where(cut, last + 1, ends)
        rows = np.searchsorted(starts, offsets)
        extra = np.r_[0, np.cumsum(cut)][rows]
        return low, np.insert(starts, new, last[at] + 1), np.insert(head_ends, new, ends[at]), np.diff(rows + extra)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of an Arrow column one after another, number of ids of each)."""
        data, offsets = C.flat_bytes(column)
        parts = [self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in C.slices(offsets, SLICE_BYTES)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of the chunk at each span."""
        slot = self._slots(hashes)
        number, at = self.slot_at[slot], np.flatnonzero(self.slot_hash[slot] != hashes)
        if not len(at):
            return number
        missed, first, inverse = _distinct(hashes[at])
        place = np.searchsorted(self.known, missed)
        fresh = np.ones(len(missed), dtype=bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != missed[inside]
        found = np.empty(len(missed), np.int32)
        found[~fresh] = self.known_at[place[~fresh]]
        if fresh.any():
            new = at[first[fresh]]
            found[fresh] = self._learn(data, starts[new], ends[new], missed[fresh])
        number[at] = found[inverse]
        return number

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n_chunks > KEEP_CHUNKS:
            self._reset()
        data, starts, ends, counts = self._chunks(data, offsets)
        at = self._numbers(data, starts, ends, C.span_hashes(data, starts, ends))
        lengths = self.lengths[at]
        sums = np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]
        return C.ragged_take(self.flat, self.starts[at], lengths), np.diff(np.r_[0, sums])


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary; later tasks of the worker find it warm."""
    return ChunkEncoder(path)


C.held_by_worker(encoder.cache_clear)
