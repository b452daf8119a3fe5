"""A hierarchical Pitman-Yor language model over words, sampled by Gibbs, that scores every text.

Every context word is a restaurant whose customers are the words that follow it in training texts;
the tables of all restaurants are the customers of one parent, the unigram restaurant, whose base is
uniform over the vocabulary and one unknown word. Sampling goes up, down and up the hierarchy:

1. Every dish begins with one table. The parent is seated on these, and its predictive probabilities
   go to the context restaurants as their base.
2. Each sweep there draws the tables of every dish from their conditional (generalized Stirling
   numbers) given the tables the restaurant had after the sweep before, all dishes at once. A dish of
   more than STIRLING customers is seated in growing batches instead, which is an approximation. After
   BURN_IN sweeps SAMPLES states are kept.
3. For each of them the parent is seated on its tables; predictive probabilities are averaged:

    P(w|u) = mean over s of (c(u,w) - D2 t_s(u,w) + (T2 + D2 t_s(u)) P_s(w)) / (T2 + c(u))
    P_s(w) = (t_s(.,w) - D1 k_s(w) + (T1 + D1 k_s(.)) / (V + 1)) / (T1 + t_s(.))

All counts and totals in them cover all training texts. While the parent is seated its number of
tables in all is taken from the part's own and the whole vocabulary.

Texts are packed into compressed blocks, shuffled once by block. Blocks and parts talk in sorted
arrays: parts of words (by hash) number the words and count them; blocks send the distinct word
pairs they hold to the parts of context words; those seat customers, tell the parts of words how many
tables each dish has, and answer the blocks. How many parts there are follows from the bytes of all
texts, and draws are seeded by part, so scores depend on the table alone, not on files or blocks.

Words: bytes other than 0x20 and 0x09-0x0D, A-Z folded, told apart by 64-bit hashes; every text ends
with an end token, which is also the context of its first word. Defined results: a null text is its
end token alone; a null doc_id belongs to the training texts; repeated rows count each; texts of any
length are scored whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.llm.common import flat, narrow, release, ship
from querl.llm.vec import word_hashes

BLOCK_BYTES = 5 << 20
PART_BYTES = 5 << 20
"""Bytes of text for each part: parts grow in number, not in size."""
STIRLING = 64
BURN_IN, SAMPLES = 2, 3
D2, T2 = 0.85, 1.0
D1, T1 = 0.6, 10.0
END = np.uint64(0x1F3D5B79A2C4E6F1)
LEVELS_PER_HALVING = 64
"""How finely a part of contexts is told a word's unigram probability."""


# Messages ----------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in their smallest width, byte planes apart (zero planes compress away)."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    small = np.ascontiguousarray(values, f"<u{width}")
    return b"".join([bytes([width]), *((small >> small.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(width))])


def unpack(raw: bytes) -> np.ndarray:
    """The values of pack() as 64-bit integers."""
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = planes[0].astype(np.int64)
    for k in range(1, width):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# Sorting -----------------------------------------------------------------------------------------


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) of non-negative integers.

    Each value's place is written in its lowest bits, shifted up where there is room, and these are sorted: numpy sorts
    integers many times faster than it sorts their places. Values that differ in those bits alone may come out of order;
    this is seen, and np.unique is asked.
    """
    bits = max(1, len(values).bit_length())
    keys = np.ascontiguousarray(values).view(np.uint64)
    low = np.uint64((1 << bits) - 1)
    room = len(values) > 0 and int(values.max()) < 1 << (64 - bits)
    keys = (keys << np.uint64(bits) if room else keys & ~low) | np.arange(len(values), dtype=np.uint64)
    keys.sort()
    order = (keys & low).view(np.int64)
    ordered = values[order]
    if not len(values) or (ordered[1:] < ordered[:-1]).any():
        return np.unique(values, return_inverse=True)
    new = np.append(True, ordered[1:] != ordered[:-1])
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], inverse


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays in order, as two arrays, and which of them each pair is."""
    wide = int(second.max()) + 1
    if (int(first.max()) + 1) * wide >= 1 << 63:
        (a, x), (b, y) = distinct(first), distinct(second)
        x, y, which = distinct_pairs(x, y)
        return a[x], b[y], which
    keys, which = distinct(first * wide + second)
    return keys // wide, keys % wide, which


# Blocks ------------------------------------------------------------------------------------------

PACKED = "block long, ids array<long>, sizes binary, texts binary"


def _pack_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    ids: list = []
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def row() -> pa.RecordBatch:
        texts = zstandard.ZstdCompressor(3).compress(np.concatenate(parts).tobytes())
        values = [[block], [ids], [pack(np.concatenate(sizes))], [texts]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["block", "ids", "sizes", "texts"])

    for batch in batches:
        data, offsets = flat(batch.column("text"))
        doc = batch.column("doc_id").to_pylist()
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes - held, side="right")) - 1)
            to = min(to, len(doc))
            ids += doc[at:to]
            parts.append(data[offsets[at] : offsets[to]])
            sizes.append(np.diff(offsets[at : to + 1]))
            held += int(offsets[to] - offsets[at])
            at = to
            if held >= block_bytes or at < len(doc):
                yield row()
                block, ids, parts, sizes, held = block + 1, [], [], [], 0
    if ids:
        yield row()


def held_out(doc_id: int | None) -> bool:
    """crc32 of doc_id as text, modulo 7, is 2."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Block:
    """A block's tokens: ``words`` sorted by (part, hash), ``token`` and ``before`` index them, ``train`` marks tokens that count."""

    def __init__(self, row: dict, parts: int) -> None:
        self.ids, self.number = row["ids"], row["block"]
        sizes = unpack(row["sizes"])
        offsets = np.append(0, np.cumsum(sizes))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        w, first = word_hashes(data, offsets)
        n = np.diff(first) + 1
        self.ends = np.cumsum(n)
        tokens = np.full(self.ends[-1], END)
        inside = np.ones(len(tokens), bool)
        inside[self.ends - 1] = False
        tokens[inside] = w
        self.out = np.array([held_out(d) for d in self.ids], bool)
        self.train = np.repeat(~self.out, n)
        words, token = distinct(tokens)
        order = np.argsort(words % np.uint64(parts), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.token = words[order], place[token]
        self.part = (self.words % np.uint64(parts)).astype(np.int64)
        self.home = ((self.words >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)  # of the word as a context
        self.end = int(np.flatnonzero(self.words == END)[0])

    def counts(self) -> np.ndarray:
        """Training count of each word."""
        return np.bincount(self.token[self.train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) by (home, context, word); which pair each token is; training counts."""
        before = np.append(self.end, self.token[:-1])
        rank = np.empty(len(self.words), np.int64)
        by_home = np.argsort(self.home, kind="stable")
        rank[by_home] = np.arange(len(self.words))
        context, word, which = distinct_pairs(rank[before], self.token)
        return by_home[context], word, which, np.bincount(which[self.train], minlength=len(word))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indices and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return first, np.append(first[1:], len(values))


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block(row, parts)
            release()


WORDS = "part long, block long, words binary, counts binary"


def _report_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for _, b in _blocks(batches, parts):
        counts = b.counts()
        rows = [(int(b.part[x]), b.number, pack(np.diff(b.words[x:y], prepend=np.uint64(0))), pack(counts[x:y])) for x, y in zip(*map(np.ndarray.tolist, _runs(b.part)), strict=True)]
        yield from _table(rows, WORDS).to_batches()


# Parts of words ----------------------------------------------------------------------------------


class Words:
    """A part's words: in the order of their hashes, with training counts over all blocks."""

    def __init__(self, table: pa.Table) -> None:
        rows = table.to_pylist()
        self.blocks = [r["block"] for r in rows]
        lists = [np.cumsum(unpack(r["words"])).view(np.uint64) for r in rows]
        self.sizes = [len(x) for x in lists]
        self.words, self.which = distinct(np.concatenate(lists))
        self.counts = np.bincount(self.which, weights=np.concatenate([unpack(r["counts"]) for r in rows]), minlength=len(self.words)).astype(np.int64)
        self.rank = np.empty(len(self.words), np.int64)  # by falling count
        self.rank[np.argsort(-self.counts, kind="stable")] = np.arange(len(self.words))

    def answers(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each block and the indices of the words it asked for."""
        at = 0
        for block, n in zip(self.blocks, self.sizes, strict=True):
            yield block, self.which[at : at + n]
            at += n


NUMBERED = "block long, part long, numbers binary"


def _number_words(key, table: pa.Table, parts: int) -> pa.Table:
    part, w = key[0].as_py(), Words(table)
    return _table([(block, part, pack(w.rank[own] * parts + part)) for block, own in w.answers()], NUMBERED)


# Seating -----------------------------------------------------------------------------------------


def log_stirling(discount: float, n: int = STIRLING) -> np.ndarray:
    """Logarithms of generalized Stirling numbers: entry (c, t) for c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    for c in range(n):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - discount * t, 1e-300)) + out[c, t]
        stay[c - discount * t <= 0] = -np.inf
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def seat(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, given the restaurant's ``others`` tables and the dish's ``base`` probability."""
    t = (c > 0).astype(np.int64)
    few = np.flatnonzero((c > 1) & (c <= STIRLING))
    few = few[np.argsort(-c[few], kind="stable")]
    size = c[few]
    value, best, pick = np.zeros(len(few)), np.full(len(few), -np.inf), np.ones(len(few), np.int64)
    log_base, taken = np.log(base[few]), others[few]
    for k in range(1, int(size[0]) + 1 if len(few) else 1):  # the largest of values with Gumbel noise is a draw
        n = int(np.searchsorted(-size, -k, side="right"))  # dishes with k customers or more
        value[:n] += np.log(strength + discount * (taken[:n] + k - 1)) + log_base[:n]
        noisy = value[:n] + stirling[size[:n], k] - np.log(-np.log(rng.random(n)))
        better = noisy > best[:n]
        best[:n][better] = noisy[better]
        pick[:n][better] = k
    t[few] = pick
    many = np.flatnonzero(c > STIRLING)
    if len(many):
        size, tables, done = c[many], np.ones(len(many), np.int64), np.ones(len(many), np.int64)
        while (done < size).any():
            new = (strength + discount * (others[many] + tables)) * base[many]
            batch = np.minimum(np.maximum(done // 8, 1), size - done)
            tables += rng.binomial(batch, np.clip(new / (done - discount * tables + new), 0, 1))
            tables = np.minimum(tables, size)
            done += batch
        t[many] = tables
    return t


# Parts of contexts ---------------------------------------------------------------------------------

PAIRS = "part long, block long, contexts binary, followers binary, words binary, counts binary"


def _send_pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row, b in _blocks(batches, parts):
        answers = sorted(row["answers"], key=lambda r: r["part"])
        number = np.concatenate([unpack(r["numbers"]) for r in answers])
        context, word, _, n = b.pairs()
        rows = []
        for x, y in zip(*map(np.ndarray.tolist, _runs(b.home[context])), strict=True):
            first, end = _runs(context[x:y])
            rows.append((int(b.home[context[x]]), b.number, pack(number[context[x:y][first]]), pack(end - first), pack(number[word[x:y]]), pack(n[x:y])))
        yield from _table(rows, PAIRS).to_batches()


class Pairs:
    """A part's distinct (context, word) pairs over all blocks, in the order of their numbers."""

    def __init__(self, table: pa.Table) -> None:
        self.blocks = table.column("block").to_pylist()
        columns = {n: [unpack(x) for x in table.column(n).to_pylist()] for n in ("contexts", "followers", "words", "counts")}
        self.contexts, self.followers = columns["contexts"], columns["followers"]
        self.names, context = distinct(np.concatenate(self.contexts))
        word, count = (np.concatenate(columns.pop(n)) for n in ("words", "counts"))
        self.u, self.word, self.which = distinct_pairs(np.repeat(context, np.concatenate(self.followers)), word)  # the latter of every pair that was sent
        self.c = np.bincount(self.which, weights=count, minlength=len(self.word)).astype(np.int64)

    def seated(self, part: int, base: np.ndarray) -> list[np.ndarray]:
        """Samples of the tables of every pair, given the ``base`` probability of each pair's word."""
        rng, stirling = np.random.default_rng([part, 5]), log_stirling(D2)
        t = (self.c > 0).astype(np.int64)
        samples: list[np.ndarray] = []
        busy = np.flatnonzero(self.c > 1)
        for sweep in range(BURN_IN + SAMPLES):
            tables = np.bincount(self.u, weights=t, minlength=len(self.names))
            own = t[busy]
            t = t.copy()
            t[busy] = seat(self.c[busy], tables[self.u[busy]] - own, base[busy], D2, T2, stirling, rng)
            if sweep >= BURN_IN:
                samples.append(t)
        return samples


FIRST = "part long, home long, numbers binary, tables binary, total long"


def _send_first(key, table: pa.Table, parts: int) -> pa.Table:
    """To each part of words: how many dishes a word is here, one table each."""
    home, p = key[0].as_py(), Pairs(table)
    words, n = np.unique(p.word[p.c > 0], return_counts=True)
    order = np.lexsort((words, words % parts))
    rows = []
    for x, y in zip(*map(np.ndarray.tolist, _runs(words[order] % parts)), strict=True):
        own = order[x:y]
        rows.append((int(words[own[0]] % parts), home, pack(words[own] // parts), pack(n[own]), int(n[own].sum())))
    return _table(rows, FIRST)


BASES = "part long, numbers binary, levels binary"


def _answer_bases(key, words: pa.Table, first: pa.Table, parts: int) -> pa.Table:
    """To each part of contexts: its words' probabilities under the parent seated on one table for each dish."""
    if not len(words) or not len(first):
        return _table([], BASES)
    part, w = key[0].as_py(), Words(words)
    rows = [(r["home"], unpack(r["numbers"]), unpack(r["tables"])) for r in first.to_pylist()]
    customers = np.zeros(len(w.words), np.int64)
    for _, own, n in rows:
        customers[own] += n
    vocabulary, total = words.column("vocabulary")[0].as_py(), words.column("dishes")[0].as_py()
    counted = customers[w.rank]
    tables = seat_parent(counted, vocabulary, np.random.default_rng([part, 3]))
    every = tables.sum() * vocabulary / max(1, np.count_nonzero(counted))
    p = np.empty(len(customers))
    p[w.rank] = (counted - D1 * tables + (T1 + D1 * every) / (vocabulary + 1)) / (T1 + total)
    level = np.round(-np.log2(p) * LEVELS_PER_HALVING).astype(np.int64)
    return _table([(home, pack(own * parts + part), pack(level[own])) for home, own, _ in rows], BASES)


SEATED = "part long, sample_of long, numbers binary, tables binary"


def _seat_contexts(key, table: pa.Table, bases: pa.Table, parts: int) -> pa.Table:
    """Tables of each word here in all samples, to the parts of words; tables of every pair, to this part itself.

    sample_of is -1 for the former, and the number of a sample for the latter.
    """
    if not len(table):
        return _table([], SEATED)
    part, p = key[0].as_py(), Pairs(table)
    words, which = distinct(p.word)
    base = np.zeros(len(words))
    for numbers, levels in zip(bases.column("numbers").to_pylist(), bases.column("levels").to_pylist(), strict=True):
        base[np.searchsorted(words, unpack(numbers))] = 2.0 ** (-unpack(levels) / LEVELS_PER_HALVING)
    samples = p.seated(part, base[which])
    sums = [np.bincount(which, weights=t, minlength=len(words)).astype(np.int64) for t in samples]
    order = np.lexsort((words, words % parts))
    some = order[sums[0][order] > 0]
    home = words[some] % parts
    rows = []
    for x, y in zip(*map(np.ndarray.tolist, _runs(home)), strict=True):
        own = some[x:y]
        rows.append((int(home[x]), -1, pack(words[own] // parts), pack(np.concatenate([s[own] for s in sums]))))
    pressed = zstandard.ZstdCompressor(3)
    rows += [(part, s, b"", pressed.compress(pack(t))) for s, t in enumerate(samples)]
    out = _table(rows, SEATED)
    del p
    release()
    return out


SHARES = "block long, part long, counts binary, seats binary, customers binary, tables binary"


def _send_shares(key, table: pa.Table, seated: pa.Table) -> pa.Table:
    """For each block: every pair's customers and tables (all samples together), every context's customers and tables (by sample)."""
    if not len(table):
        return _table([], SHARES)
    part, p = key[0].as_py(), Pairs(table)
    own = sorted((r["sample_of"], r["tables"]) for r in seated.to_pylist() if r["sample_of"] >= 0)
    samples = [unpack(zstandard.ZstdDecompressor().decompress(t)) for _, t in own]
    seats = np.sum(samples, axis=0)
    customers = np.bincount(p.u, weights=p.c, minlength=len(p.names)).astype(np.int64)
    tables = np.stack([np.bincount(p.u, weights=s, minlength=len(p.names)).astype(np.int64) for s in samples])
    rows, at = [], 0
    for block, contexts, followers in zip(p.blocks, p.contexts, p.followers, strict=True):
        own = p.which[at : at + int(followers.sum())]
        u = np.searchsorted(p.names, contexts)
        rows.append((block, part, pack(p.c[own]), pack(seats[own]), pack(customers[u]), pack(tables[:, u].ravel())))
        at += len(own)
    out = _table(rows, SHARES)
    del p
    release()
    return out


# The parent restaurant -------------------------------------------------------------------------------


def seat_parent(customers: np.ndarray, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of a part's words in the unigram restaurant, whose words are ``vocabulary`` in all."""
    stirling = log_stirling(D1)
    t = (customers > 0).astype(np.int64)
    scale = vocabulary / max(1, int(t.sum()))  # words fall to parts by hash, so parts are alike
    base = np.full(len(t), 1.0 / (vocabulary + 1))
    for _ in range(BURN_IN):
        t = seat(customers, np.maximum(t.sum() * scale - t, 0.0), base, D1, T1, stirling, rng)
    return t


class Parent:
    """A part of the unigram restaurant, seated: customers and tables of each word in each sample."""

    def __init__(self, part: int, words: Words, seated: pa.Table, vocabulary: int) -> None:
        n = len(words.words)
        self.customers = np.zeros((SAMPLES, n), np.int64)
        for r in seated.to_pylist():
            if r["sample_of"] < 0:
                own, t = unpack(r["numbers"]), unpack(r["tables"]).reshape(SAMPLES, -1)
                self.customers[:, own] += t
        self.customers = self.customers[:, words.rank]
        rng = np.random.default_rng([part, 7])
        self.tables = np.stack([seat_parent(c, vocabulary, rng) for c in self.customers])


UNIGRAMS = "block long, part long, counts binary, customers binary, tables binary"


def _answer_unigrams(key, words: pa.Table, seated: pa.Table) -> pa.Table:
    if not len(words):
        return _table([], UNIGRAMS)
    part, w = key[0].as_py(), Words(words)
    p = Parent(part, w, seated, words.column("vocabulary")[0].as_py())
    return _table([(block, part, pack(w.counts[own]), pack(p.customers[:, own].ravel()), pack(p.tables[:, own].ravel())) for block, own in w.answers()], UNIGRAMS)


SUMS = ", ".join(["total long", "vocabulary long", *(f"customers{s} long, tables{s} long" for s in range(SAMPLES))])


def _sum_unigrams(key, words: pa.Table, seated: pa.Table) -> pa.Table:
    if not len(words):
        return _table([], SUMS)
    w = Words(words)
    p = Parent(key[0].as_py(), w, seated, words.column("vocabulary")[0].as_py())
    row = [int(w.counts.sum()), int((w.counts > 0).sum())]
    for s in range(SAMPLES):
        row += [int(p.customers[s].sum()), int(p.tables[s].sum())]
    return _table([tuple(row)], SUMS)


# Scores ----------------------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row, b in _blocks(batches, parts):
        unigrams = sorted(row["unigrams"], key=lambda r: r["part"])
        count = np.concatenate([unpack(r["counts"]) for r in unigrams])
        customers = np.concatenate([unpack(r["customers"]).reshape(SAMPLES, -1) for r in unigrams], axis=1)
        tables = np.concatenate([unpack(r["tables"]).reshape(SAMPLES, -1) for r in unigrams], axis=1)
        total, vocabulary = row["total"], row["vocabulary"]
        context, word, which, _ = b.pairs()
        shares = sorted(row["shares"], key=lambda r: r["part"])
        c, seats, hosted = (np.concatenate([unpack(r[n]) for r in shares]) for n in ("counts", "seats", "customers"))
        hosting = np.concatenate([unpack(r["tables"]).reshape(SAMPLES, -1) for r in shares], axis=1)
        first, end = _runs(context)
        u = np.repeat(np.arange(len(first)), end - first)
        p = (c - D2 * seats / SAMPLES) / (T2 + hosted[u])
        for s in range(SAMPLES):
            spread = (T1 + D1 * row[f"tables{s}"]) / (vocabulary + 1)
            unigram = (customers[s] - D1 * tables[s] + spread) / (T1 + row[f"customers{s}"])
            parent = (T2 + D2 * hosting[s]) / (T2 + hosted)
            p += parent[u] * unigram[word] / SAMPLES
        log_p = np.append(0, np.cumsum(np.log10(p)[which]))
        base = np.append(0, np.cumsum(np.log10((count + 1) / (total + vocabulary + 1))[b.token]))
        known = np.append(0, np.cumsum((count > 0)[b.token]))
        begin = np.append(0, b.ends[:-1])
        columns = [
            pa.array(b.ids, pa.int64()), pa.array(b.out), pa.array(b.ends - begin), pa.array(known[b.ends] - known[begin]), pa.array(np.full(len(b.ids), total, np.int64)),
            pa.array(base[b.ends] - base[begin]), pa.array(log_p[b.ends] - log_p[begin]), pa.array(10 ** ((log_p[begin] - log_p[b.ends]) / (b.ends - begin))),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text."""
    ship(docs.sparkSession)
    own = narrow(docs)
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(size) // part_bytes))
    packed = own.mapInArrow(partial(_pack_blocks, block_bytes=block_bytes), PACKED)
    blocks = packed.where("block is not null").repartition(parts, "block")  # joins ask for this: said here, all read one exchange
    reports = blocks.mapInArrow(partial(_report_words, parts=parts), WORDS).repartition(parts, "part")
    numbered = reports.groupBy("part").applyInArrow(lambda key, t: _number_words(key, t, parts), NUMBERED)

    def gathered(messages: DataFrame, name: str) -> DataFrame:
        """All messages to a block in one row; together they are about as large as the block. Dealt as the blocks are, so that a join leaves those as they lie."""
        rest = [c for c in messages.columns if c != "block"]
        return messages.where("block is not null").repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct(*rest)).alias(name))

    with_numbers = blocks.join(gathered(numbered, "answers"), "block")
    pairs = with_numbers.mapInArrow(partial(_send_pairs, parts=parts), PAIRS).repartition(parts, "part")
    first = pairs.groupBy("part").applyInArrow(lambda key, t: _send_first(key, t, parts), FIRST).repartition(parts, "part")
    vocabulary = reports.groupBy("part").applyInArrow(lambda key, t: _count_words(key, t), "vocabulary long").agg(F.sum("vocabulary").alias("vocabulary"))  # one row
    dishes = first.agg(F.sum("total").alias("dishes"))  # one row
    words = reports.join(F.broadcast(vocabulary)).join(F.broadcast(dishes))
    bases = words.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(lambda key, w, t: _answer_bases(key, w, t, parts), BASES)
    seated = pairs.groupBy("part").cogroup(bases.groupBy("part")).applyInArrow(lambda key, p, b: _seat_contexts(key, p, b, parts), SEATED)
    seated = seated.where("part is not null").repartition(parts, "part")
    shares = pairs.groupBy("part").cogroup(seated.groupBy("part")).applyInArrow(lambda key, p, s: _send_shares(key, p, s), SHARES)
    both = words.groupBy("part").cogroup(seated.groupBy("part"))
    unigrams = both.applyInArrow(lambda key, w, s: _answer_unigrams(key, w, s), UNIGRAMS)
    sums = both.applyInArrow(lambda key, w, s: _sum_unigrams(key, w, s), SUMS)
    sums = sums.agg(*[F.sum(c).alias(c) for c in sums.columns])  # one row
    ready = blocks.join(gathered(unigrams, "unigrams"), "block").join(gathered(shares, "shares"), "block").join(F.broadcast(sums))
    return ready.mapInArrow(partial(_score, parts=parts), SCORES)


def _count_words(key, table: pa.Table) -> pa.Table:
    return _table([(int((Words(table).counts > 0).sum()),)], "vocabulary long")
