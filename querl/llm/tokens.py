"""Whole-text tokenization by way of distinct chunks.

A text is split at places where no pre-token of the vocabulary can cross, each distinct chunk is
encoded once and the ids of texts are gathered from a table. The ids are those of the whole text.
Chunks are found by 64-bit hashes in an open-addressing table of numpy arrays, and every hit's bytes are
compared: a chunk whose hash belongs to another one is encoded by itself.

Strings of special tokens in a text give their ids, as the library does by default; they end the text
before them and begin a new one.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from querl.llm.vec import hash_words, ragged, run_words, word_bounds

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

STARTS_WORD = np.zeros(256, bool)
"""Bytes that, after a space, begin a pre-token with it. White space does not; nor do the lead bytes
C2 and E1-E3, which may begin white space beyond ASCII."""
STARTS_WORD[0x21:0x7F] = True
STARTS_WORD[0xC3:0xF5] = True
STARTS_WORD[0xE1:0xE4] = False

TOGETHER = 256
"""Chunks given to the library in one call, as words already split from each other."""
JOINED = 4096
"""Chunks given to the library as one text, where each begins with a space and a word."""


class HashTable:
    """64-bit hash -> number in order of insertion; at most half full."""

    def __init__(self, limit: int) -> None:
        self.bits = max(10, (2 * limit - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the hashes (none is 0), -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        at, todo = self._home(h), np.arange(len(h))
        while len(todo):
            have = self.keys[at]
            hit = have == h[todo]
            out[todo[hit]] = self.numbers[at[hit]]
            on = ~hit & (have != 0)
            todo, at = todo[on], at[on] + 1 & len(self.keys) - 1
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new, distinct hashes."""
        numbers = np.arange(self.size, self.size + len(h), dtype=np.int32)
        at, todo = self._home(h), np.arange(len(h))
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]
            won = free & (self.keys[at] == h[todo])
            self.numbers[at[won]] = numbers[todo[won]]
            todo, at = todo[~won], at[~won] + 1 & len(self.keys) - 1
        self.size += len(h)


class ChunkEncoder:
    """Encodes texts with ``encode_many`` (chunks -> their ids back to back, ids of each) over their distinct chunks.

    spaced: chunks keep the space before them (byte-level vocabularies); else chunks are the words
    between ASCII white space, which the vocabulary drops. The table restarts beyond ``limit`` chunks.
    special: the strings that have ids of their own.
    """

    def __init__(
        self, encode_many: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], spaced: bool, limit: int = 1_500_000, special: dict[bytes, int] | None = None
    ) -> None:
        self.encode_many, self.spaced, self.limit, self.special = encode_many, spaced, limit, special or {}
        self._restart()

    def _restart(self) -> None:
        self.table = HashTable(self.limit)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 12, np.int64)
        self.words = np.zeros(1 << 16, np.uint64)  # the chunks themselves, as run_words() has them
        self.words_at = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, and the index of each text's first (len+1 values)."""
        if not self.spaced:
            return word_bounds(data, offsets)
        begin = np.zeros(len(data), bool)
        begin[:-1] = (data[:-1] == 32) & STARTS_WORD[data[1:]]
        last = offsets[1:] - 1
        begin[last[last >= 0]] = False  # a text's last byte is followed by nothing
        first = offsets[:-1][np.diff(offsets) > 0]
        begin[first] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets)

    def _learn(self, chunks: list[bytes], hashes: np.ndarray, words: np.ndarray, n_words: np.ndarray) -> None:
        found, n_ids = self.encode_many(chunks)
        have = self.table.size
        to = have + len(chunks)
        self.offsets, self.words_at, self.lengths = (_grown(x, to + 1) for x in (self.offsets, self.words_at, self.lengths))
        at, words_at = int(self.offsets[have]), int(self.words_at[have])
        self.ids, self.words = _grown(self.ids, at + len(found)), _grown(self.words, words_at + len(words))
        self.offsets[have + 1 : to + 1] = at + np.cumsum(n_ids)
        self.words_at[have + 1 : to + 1] = words_at + np.cumsum(n_words)
        self.lengths[have:to] = [len(c) for c in chunks]
        self.ids[at : at + len(found)] = found
        self.words[words_at : words_at + len(words)] = words
        self.table.add(hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts back to back, and each text's number of ids."""
        at, end, special = self._find_special(data, offsets)
        if not len(at):
            return self._encode(data, offsets)
        segments = np.sort(np.concatenate([offsets, at, end]))
        ids, counts = self._encode(data, segments)
        own = np.zeros(len(segments) - 1, bool)
        which = np.searchsorted(segments, at, side="right") - 1  # the segment that is the string itself
        own[which] = True
        rest = ids[np.repeat(~own, counts)]
        counts[own] = 1
        out = np.empty(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        single = np.zeros(len(out), bool)
        single[begin[which]] = True
        out[begin[which]] = special
        out[~single] = rest
        total = np.append(0, np.cumsum(counts))
        return out, np.diff(total[np.searchsorted(segments, offsets)])

    def _find_special(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of the special strings that lie within a text, leftmost first and longest at a place."""
        found = []
        raw = data.tobytes() if self.special else b""
        for string, number in self.special.items():
            at = raw.find(string)
            while at >= 0:
                found.append((at, -len(string), number))
                at = raw.find(string, at + 1)
        kept, last = [], 0
        for at, less, number in sorted(found):
            if at >= last and at - less <= offsets[np.searchsorted(offsets, at, side="right")]:
                kept.append((at, at - less, number))
                last = at - less
        return tuple(np.array([k[i] for k in kept], np.int64) for i in range(3))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = self._chunks(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        words, place, words_first = run_words(data, starts, ends)
        n_words = np.diff(np.append(words_first, len(words)))
        h = hash_words(words, place, words_first, ends - starts)
        h[h == 0] = 1
        number = self.table.find(h)
        miss = np.flatnonzero(number < 0)
        raw = data.tobytes() if len(miss) else b""
        cut = lambda at: [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            if self.table.size + len(new) > self.limit:
                self._restart()
                self.table = HashTable(max(self.limit, len(starts)))
                miss = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            at = miss[at]
            self._learn(cut(at), new, words[ragged(words_first[at], n_words[at])], n_words[at])
            number[miss] = self.table.find(h[miss])
        other = self.lengths[number] != ends - starts  # the hash is another chunk's
        alike = np.flatnonzero(~other)
        here, there = ragged(words_first[alike], n_words[alike]), ragged(self.words_at[number[alike]], n_words[alike])
        differ = np.flatnonzero(words[here] != self.words[there])
        if len(differ):
            other[alike[np.searchsorted(np.cumsum(n_words[alike]), differ, side="right")]] = True
        begin = self.offsets[number]
        lengths = self.offsets[number + 1] - begin
        ids = self.ids
        if other.any():
            raw = raw or data.tobytes()
            at = np.flatnonzero(other)
            found, n_ids = self.encode_many(cut(at))
            used = int(self.offsets[self.table.size])
            ids = np.concatenate([ids[:used], found.astype(np.uint32)])
            begin[at], lengths[at] = used + np.cumsum(n_ids) - n_ids, n_ids
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return ids[ragged(begin, lengths)], np.diff(total[first])


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for at least ``n`` values."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 3 // 2) - len(x), x.dtype)])


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def library_encoder(path: str, spaced: bool) -> ChunkEncoder:
    """A ChunkEncoder over a tokenizers file; one for each worker process."""
    if (path, spaced) not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}

        def encode_apart(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [c.decode() for c in chunks]
            ids, lengths = [], []
            for i in range(0, len(texts), TOGETHER):
                some = texts[i : i + TOGETHER]
                found = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(found.ids, np.uint32))
                lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
            return np.concatenate(ids), np.concatenate(lengths)

        if not spaced:
            encode_many = encode_apart
        else:  # an id stands for bytes of the text, so ids of joined chunks tell which chunk they belong to
            n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
            for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
                n_bytes[i] = len(token)

            def encode_many(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                joins = np.array([len(c) > 1 and c[0] == 32 and STARTS_WORD[c[1]] for c in chunks], bool)
                groups, lengths = [], np.zeros(len(chunks), np.int64)
                if not joins.all():
                    apart = np.flatnonzero(~joins)
                    ids, lengths[apart] = encode_apart([chunks[i] for i in apart.tolist()])
                    groups.append((apart, ids))
                own = np.flatnonzero(joins)
                for at in range(0, len(own), JOINED):
                    some = own[at : at + JOINED]
                    raw = [chunks[i] for i in some.tolist()]
                    [found] = tokenizer.encode_batch_fast([b"".join(raw).decode()], add_special_tokens=False)
                    ids = np.array(found.ids, np.uint32)
                    ends = np.searchsorted(np.cumsum(n_bytes[ids]), np.cumsum([len(c) for c in raw]), side="left") + 1
                    lengths[some] = np.diff(ends, prepend=0)
                    groups.append((some, ids))
                begin = np.cumsum(lengths) - lengths
                out = np.empty(int(lengths.sum()), np.uint32)
                for some, ids in groups:
                    out[ragged(begin[some], lengths[some])] = ids
                return out, lengths

        _encoders[path, spaced] = ChunkEncoder(encode_many, spaced, special=special)
    return _encoders[path, spaced]
