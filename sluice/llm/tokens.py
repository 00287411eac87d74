"""Token ids of whole texts, by the tokenizers library, with the ids of a word worked out once."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat
from .kernels import LOWER, span_hashes, words


#: Words and ids kept at most by one Python worker, about 100 MB; beyond that the cache starts anew.
CACHE_WORDS, CACHE_IDS = 500_000, 4_000_000
#: New words encoded as one text.
JOINED = 500


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes batches of texts with add_special_tokens=False.

    A tokenizer that splits words from white space and from punctuation lets no token cross either, so a text's ids are
    those of its words, one after the other. Words recur, so each is encoded once and kept, found again by a 64-bit hash
    and 32 bits of length, byte sum and end bytes. Text is cut at ASCII white space, a full stop or comma behind an ASCII
    letter at the end is a word of its own, and ASCII words are lower-cased, as the tokenizer does itself; those that may
    hold an added token, which has its case, aren't. For a tokenizer without these properties take `parts=False`: it
    gets whole texts.
    """

    def __init__(self, path: str, parts: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.parts = Tokenizer.from_file(path), parts
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.size = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.cased = np.arange(256) >= 128  # bytes whose words keep their case
        self.cased[[x.content.encode()[0] for x in self.tokenizer.get_added_tokens_decoder().values()]] = True
        self.forget()

    def forget(self) -> None:
        size = 1 << max(4, (2 * CACHE_WORDS).bit_length())
        self.keys, self.checks, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        self.n_ids, self.ids, self.starts, self.lengths = 0, np.empty(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._keep(np.zeros(1, np.uint64), np.zeros(1, np.uint32), np.empty(0, np.uint32), np.zeros(1, np.int64))  # slot 0: no ids

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Slots of the words, -1 for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & ((self.keys[at] != h) | (self.checks[at] != c)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & int(mask)
            out[todo] = slot = self.slots[at]
            on = (slot >= 0) & ((self.keys[at] != h[todo]) | (self.checks[at] != c[todo]))
            todo, at = todo[on], at[on]
        return out

    def _keep(self, h: np.ndarray, c: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        first, base = len(self.lengths), self.n_ids
        self.n_ids += len(ids)
        if self.n_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[base : self.n_ids] = ids
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        while 2 * len(self.lengths) > len(self.keys):
            used = self.slots >= 0
            old = self.keys[used], self.checks[used], self.slots[used]
            self.keys, self.checks, self.slots = (np.full(2 * len(x), v, x.dtype) for x, v in ((self.keys, 0), (self.checks, 0), (self.slots, -1)))
            self._insert(*old)
        self._insert(h, c, np.arange(first, first + len(h)))

    def _insert(self, h: np.ndarray, c: np.ndarray, slot: np.ndarray) -> None:
        mask, todo = len(self.keys) - 1, np.arange(len(h))
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.slots[at[todo]] < 0
            _, one = np.unique(np.where(free, at[todo], -1 - todo), return_index=True)
            now = todo[one[free[one]]]
            self.keys[at[now]], self.checks[at[now]], self.slots[at[now]] = h[now], c[now], slot[now]
            todo = np.setdiff1d(todo, now, assume_unique=True)
            at[todo] = (at[todo] + 1) & mask

    def _learn(self, names: list[str], h: np.ndarray, c: np.ndarray) -> None:
        """Plain words go in as one text: each one's last id has the word-end mark. What doesn't come out so goes alone."""
        plain = np.fromiter((x.isalpha() for x in names), bool, len(names)) & bool(self.ends.any())
        other, good = [np.flatnonzero(~plain)], np.flatnonzero(plain)
        rows = [good[i : i + JOINED] for i in range(0, len(good), JOINED)]
        ids, lengths = self._encode([" ".join(names[i] for i in row) for row in rows])
        at, known = 0, []
        for row, n in zip(rows, lengths.tolist(), strict=True):
            part = ids[at : at + n]
            at += n
            last = np.flatnonzero(self.ends[part]) + 1
            if len(last) == len(row) and last[-1] == n:
                known.append((row, part, np.diff(last, prepend=0)))
            else:
                other.append(row)
        if len(rest := np.concatenate(other)):
            known.append((rest, *self._encode([names[i] for i in rest])))
        row, ids, lengths = map(np.concatenate, zip(*known, strict=True))
        self._keep(h[row], c[row], ids, lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text; a null text has none."""
        if not self.parts:
            return self._encode(pc.fill_null(texts, "").to_pylist())
        data, offsets = flat(texts)
        s, e, counts = words(data, offsets)
        if not len(s):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.lengths) > CACHE_WORDS or self.n_ids > CACHE_IDS:
            self.forget()
        before, last = data[np.maximum(e - 2, s)], data[e - 1]
        stop = ((last == 46) | (last == 44)) & (e - s > 1) & ((before | 32) >= 97) & ((before | 32) <= 122)
        wide = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(self.cased[data], out=wide[1:])
        kept = wide[e] > wide[s]
        edges = np.zeros(len(data) + 1, np.int8)
        edges[s[kept]] += 1
        edges[e[kept]] -= 1
        data = np.where(np.cumsum(edges[:-1], dtype=np.int8) > 0, data, LOWER[data])
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data, out=sums[1:])
        e = e - stop
        h = span_hashes(data, s, e)
        c = ((sums[e] - sums[s]) * 31 + (e - s) * 65599 + data[s].astype(np.int64) * 16777 + (data[e - 1].astype(np.int64) << 24)).astype(np.uint32)
        slots = np.zeros((len(s), 2), np.int32)
        slots[:, 0] = self._find(h, c)
        while len(new := np.flatnonzero(slots[:, 0] < 0)):
            _, one = np.unique(h[new], return_index=True)
            one = new[one]
            raw = data.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)], h[one], c[one])
            slots[new, 0] = self._find(h[new], c[new])
        for mark in (46, 44):
            if (which := stop & (last == mark)).any():
                slots[which, 1] = self._mark(mark)
        slot = slots.ravel()
        n = self.lengths[slot]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[slot] - (ends - n), n) + np.arange(ends[-1])
        until = np.concatenate([[0], ends[1::2]])
        return self.ids[at], until[counts[1:]] - until[counts[:-1]]

    def _mark(self, mark: int) -> int:
        h, c = np.array([mark], np.uint64), np.array([0], np.uint32)
        if self._find(h, c)[0] < 0:
            self._keep(h, c, *self._encode([chr(mark)]))
        return int(self._find(h, c)[0])


@cache
def encoder(path: str, parts: bool = True) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, parts)


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text; offsets of the texts."""
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(offsets[-1], end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets



