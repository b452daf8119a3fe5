"""Exact-substring dedup: bytes covered by a 50-byte string that a document of smaller id also has.

Suffixes are ordered by deep-shallow sorting. The suffix array is spread over parts so that equal
50-byte strings always meet: a string goes to the part of the smallest hash among its 20-byte
grams (its anchor), so neighbouring strings mostly travel together, as one run of overlapping bytes.

1. Each block of documents reports the anchors it has, 4 bytes each; a part answers with a bit for
   each: does another document have it?
2. Blocks send the distinct runs of shared anchors, with the smallest doc_id that has each.
3. A part sorts the suffixes of its distinct runs: a multikey sort over 8-byte characters to a shallow
   depth of 24 bytes, which splits all open groups by their next character at once (numpy's sort stands
   where a multikey quicksort would partition), then blind tries for the groups still equal. Suffixes equal over 50
   bytes form a class; a run is told at which offsets its class has a smaller doc_id elsewhere.
4. Blocks mark the covered bytes.

An anchor that many runs of some block share is hot; its strings are sent one by one to the part of
their own hash, so that no part gathers all that surrounds a very common gram.

The documents are shuffled once, by block; the three passes over them read that one exchange.

Defined results: a null text is empty; a null doc_id is smaller than all others; rows of one doc_id
are one document's, which never cover each other; texts under 50 bytes lose nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.llm.common import blocks_of, flat, narrow, ship, slices
from querl.llm.vec import BYTE_VALUES, gram_hashes, mix, prefix_sums, ragged, run_hashes

MATCH = 50
GRAM = 20
WINDOW = MATCH - GRAM + 1
LONGEST_RUN = 64
SHALLOW = 24
HOT_RUNS = 16
"""An anchor with more distinct runs than this in one block is hot."""
HOT_BLOCKS = 256
"""So is an anchor in more blocks than this times as many. Strings of hot anchors travel one by one, over ten times the bytes
of a run, while a run of each of 4096 blocks is a third of a MB: with fewer, common anchors would be hot in tables of a few GB."""
BLOCK_BYTES = 4 << 20
ALONE = 0x80
"""Set in the length of a string sent by itself: it stands for all equal strings of its block, and so does the answer to it."""
NULL_ID = np.iinfo(np.int64).min


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def block_runs(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's texts: each run's anchor hash, first string start, number of starts, text index."""
    found = []
    for a, b in slices(offsets, 1 << 20):
        at = offsets[a : b + 1] - offsets[a]
        if at[-1] < MATCH:
            continue
        v = window_min(gram_hashes(sums, GRAM, int(offsets[a]), int(at[-1]) - GRAM + 1), WINDOW)
        lengths = np.maximum(np.diff(at) - MATCH + 1, 0)
        text = np.repeat(np.arange(len(lengths)), lengths)
        start = ragged(at[:-1], lengths)
        if not len(start):
            continue
        v = v[start]
        new = np.empty(len(start), bool)
        new[0] = True
        new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(start)))
        if size.max() > LONGEST_RUN:
            pieces = -(-size // LONGEST_RUN)
            step = ragged(np.zeros(len(size), np.int64), pieces) * LONGEST_RUN
            size = np.minimum(np.repeat(size, pieces) - step, LONGEST_RUN)
            begin = np.repeat(begin, pieces) + step
        found.append((v[begin], start[begin] + offsets[a], size, text[begin] + a))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keys(v: np.ndarray, parts: int) -> np.ndarray:
    """part << 32 | fragment: all that a part sees of an anchor."""
    return (v % np.uint64(parts)) << np.uint64(32) | v >> np.uint64(32)


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("doc_id"), int(NULL_ID)).to_numpy().astype(np.int64)


def _by_part(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, end) of sorted keys."""
    part = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True))


REPORT = "part int, block long, anchors binary, twice binary, many binary"


def _report(key, table: pa.Table, parts: int, hot_runs: int) -> pa.Table:
    data, offsets = flat(table.column("text"))
    sums = prefix_sums(data, BYTE_VALUES)
    v, start, size, text = block_runs(data, offsets, sums)
    ids = _ids(table)[text]
    keys = _keys(v, parts)
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    uniq = keys[first]
    if len(keys):
        twice = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        many = np.diff(np.append(first, len(keys))) > hot_runs
        if many.any():  # only distinct runs count
            group = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
            at = np.flatnonzero(many[group])
            h = run_hashes(sums, start[order[at]], start[order[at]] + size[order[at]] + MATCH - 1)
            pairs = np.unique(np.stack([group[at].astype(np.uint64), h]), axis=1)[0].astype(np.int64)
            many = np.bincount(pairs, minlength=len(uniq)) > hot_runs
    rows = [
        (p, key[0].as_py(), (uniq[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), np.packbits(twice[a:b]).tobytes(), np.packbits(many[a:b]).tobytes())
        for p, a, b in _by_part(uniq)
    ]
    return _table(rows, REPORT)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


ANSWER = "block long, part int, shared binary, hot binary"


def _answer(key, table: pa.Table, hot_runs: int) -> pa.Table:
    rows = table.to_pylist()
    anchors = [np.frombuffer(r["anchors"], "<u4") for r in rows]
    sizes = [len(a) for a in anchors]
    bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])
    uniq, which, count = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(which, weights=bits("twice"), minlength=len(uniq)) > 0)
    hot = (np.bincount(which, weights=bits("many"), minlength=len(uniq)) > 0) | (count > HOT_BLOCKS * hot_runs)
    shared, hot = shared[which], hot[which]
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        own = shared[at : at + n]
        if own.any():
            out.append((r["block"], key[0].as_py(), np.packbits(own).tobytes(), np.packbits(hot[at : at + n] & own).tobytes()))
        at += n
    return _table(out, ANSWER)


SEND = "part int, block long, number binary, lengths binary, doc_ids binary, bytes binary"


def _spread(answers: pa.Table, uniq: np.ndarray, name: str) -> np.ndarray:
    out = np.zeros(len(uniq), bool)
    ranges = {p: (a, b) for p, a, b in _by_part(uniq)}
    for p, raw in zip(answers.column("part").to_pylist(), answers.column(name).to_pylist(), strict=True):
        a, b = ranges[p]
        out[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a)
    return out


def _block_strings(sums: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct runs by hash: the hashes, and which one each run is."""
    h = run_hashes(sums, start, start + size + MATCH - 1) if len(start) else np.zeros(0, np.uint64)
    return np.unique(h, return_inverse=True)


def _send(key, texts: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    if not len(texts) or not len(answers):
        return _table([], SEND)
    data, offsets = flat(texts.column("text"))
    sums = prefix_sums(data, BYTE_VALUES)
    v, start, size, text = block_runs(data, offsets, sums)
    ids = _ids(texts)[text]
    keys = _keys(v, parts)
    uniq, which = np.unique(keys, return_inverse=True)
    shared, hot = _spread(answers, uniq, "shared"), _spread(answers, uniq, "hot")
    strings, number = _block_strings(sums, start, size)
    at = np.flatnonzero(shared[which])
    at = at[np.lexsort((ids[at], number[at]))]
    at = at[np.append(True, number[at][1:] != number[at][:-1])] if len(at) else at  # each distinct run once, with its smallest doc_id
    part = (keys[at] >> np.uint64(32)).astype(np.int64)
    first, length, offset = start[at], size[at] + MATCH - 1, np.zeros(len(at), np.int64)
    number, ids = number[at], ids[at]
    burst = hot[which[at]]
    alone = np.zeros(len(at), np.uint8)
    if burst.any():  # strings of hot anchors go one by one, each distinct one once
        n = size[at][burst]
        inside = ragged(np.zeros(len(n), np.int64), n)
        again = np.repeat(np.flatnonzero(burst), n)
        s = first[again] + inside
        h = run_hashes(sums, s, s + MATCH)
        by = np.lexsort((ids[again], h))
        by = by[np.append(True, h[by][1:] != h[by][:-1])]
        s, again, inside, h = s[by], again[by], inside[by], h[by]
        keep = ~burst
        part = np.concatenate([part[keep], (mix(h) % np.uint64(parts)).astype(np.int64)])
        first = np.concatenate([first[keep], s])
        length = np.concatenate([length[keep], np.full(len(s), MATCH)])
        offset = np.concatenate([offset[keep], inside])
        number, ids = np.concatenate([number[keep], number[again]]), np.concatenate([ids[keep], ids[again]])
        alone = np.concatenate([alone[keep], np.full(len(s), ALONE, np.uint8)])
    order = np.argsort(part, kind="stable")
    part, first, length, offset, number, ids, alone = (x[order] for x in (part, first, length, offset, number, ids, alone))
    body = data[ragged(first, length)]
    ends = np.append(0, np.cumsum(length))
    label = (number * LONGEST_RUN + offset).astype("<u4")
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        rows.append((int(part[a]), key[0].as_py(), label[a:b].tobytes(), (length[a:b].astype(np.uint8) | alone[a:b]).tobytes(), ids[a:b].astype("<i8").tobytes(), body[ends[a] : ends[b]].tobytes()))
    return _table(rows, SEND)


class BlindTrie:
    """Orders keys of one length: inner nodes keep only a depth and branching bytes, leaves the keys' indices."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    def insert(self, key: bytes, index: int) -> None:
        node = self.root
        if node is None:
            self.root = (key, [index])
            return
        while len(node) == 3:  # blind: a missing branch is passed by any other
            children = node[1]
            node = children.get(key[node[0]]) or node[2]
        other = node[0]
        if other == key:
            node[1].append(index)
            return
        differ = int.from_bytes(key, "big") ^ int.from_bytes(other, "big")
        depth = len(key) - (differ.bit_length() + 7) // 8
        leaf, above, node = (key, [index]), None, self.root
        while len(node) == 3 and node[0] < depth:
            above, node = node, node[1][key[node[0]]]
        if len(node) == 3 and node[0] == depth:
            node[1][key[depth]] = leaf
            return
        inner = (depth, {other[depth]: node, key[depth]: leaf}, node)
        if above is None:
            self.root = inner
        else:
            above[1][key[above[0]]] = inner

    def ordered(self) -> list[list[int]]:
        """Indices in key order, equal keys together."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 3:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def sort_suffixes(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow order of the suffixes by their first 50 bytes: (order, class of each in that order).

    Classes count up; suffixes equal over 50 bytes share one. Every suffix has 50 bytes.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.append(buffer, np.zeros(8, np.uint8)).astype(np.uint64)
    word = padded[: len(buffer)] << np.uint64(56)
    for k in range(1, 8):
        word |= padded[k : len(buffer) + k] << np.uint64(56 - 8 * k)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by place in order; the first place of the group
    open_at = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for depth in range(0, SHALLOW, 8):  # the next character of all open groups at once
        if not len(open_at):
            break
        members = order[open_at]
        key = word[starts[members] + depth]
        by = np.lexsort((key, group[open_at])) if depth else np.argsort(key, kind="stable")
        members, key, was = members[by], key[by], group[open_at]
        order[open_at] = members
        new = np.empty(len(by), bool)
        new[0] = True
        new[1:] = (key[1:] != key[:-1]) | (was[1:] != was[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(by)))
        group[open_at] = np.repeat(open_at[heads], sizes)
        open_at = open_at[np.repeat(sizes > 1, sizes)]
    split = np.ones(n, bool)  # does a class begin at this place?
    if len(open_at):
        # groups that are equal to the end need no trie: their members are one class as they stand
        place, head = order[open_at], order[group[open_at]]
        differ = np.zeros(len(open_at), bool)
        for depth in (*range(SHALLOW, MATCH - 8, 8), MATCH - 8):
            differ |= word[starts[place] + depth] != word[starts[head] + depth]
        split[open_at[group[open_at] != open_at]] = False
        mixed = np.zeros(n, bool)
        mixed[group[open_at[differ]]] = True
        open_at = open_at[mixed[group[open_at]]]
    if len(open_at):
        raw = buffer.tobytes()
        heads = np.flatnonzero(np.append(True, group[open_at][1:] != group[open_at][:-1]))
        at_starts = starts[order[open_at]].tolist()
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(open_at)], strict=True):
            trie = BlindTrie()
            for i in range(a, b):
                s = at_starts[i]
                trie.insert(raw[s + SHALLOW : s + MATCH], i)
            found = trie.ordered()
            place = int(open_at[a])
            members = order[open_at[a:b]]
            for same in found:
                for k, i in enumerate(same):
                    order[place] = members[i - a]
                    split[place] = k == 0
                    place += 1
    return order, np.cumsum(split) - 1


REPLY = "block long, part int, number binary, count binary"


def _reply(key, table: pa.Table) -> pa.Table:
    rows = [r for r in table.to_pylist() if r["lengths"]]
    if not rows:
        return _table([], REPLY)
    lengths = [np.frombuffer(r["lengths"], np.uint8).astype(np.int64) for r in rows]
    length = np.concatenate(lengths)
    alone, length = length & ALONE, length & ~ALONE
    doc = np.concatenate([np.frombuffer(r["doc_ids"], "<i8") for r in rows])
    label = np.concatenate([np.frombuffer(r["number"], "<u4") for r in rows])
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    first = np.cumsum(length) - length
    h = run_hashes(prefix_sums(data, BYTE_VALUES), first, first + length)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    n = length[one] - MATCH + 1
    owner = np.repeat(np.arange(len(one)), n)
    own = data[ragged(first[one], length[one])]
    order, cls = sort_suffixes(own, ragged(np.cumsum(length[one]) - length[one], n))
    smallest = np.full(cls[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, cls, least[owner[order]])
    by_start = np.empty(len(owner), np.int64)
    by_start[order] = smallest[cls]
    base = np.cumsum(n) - n
    out, at = [], 0
    for r, ls in zip(rows, lengths, strict=True):
        m = len(ls)
        w = which[at : at + m]
        size = n[w]
        before = by_start[ragged(base[w], size)] < np.repeat(doc[at : at + m], size)
        single = np.repeat(alone[at : at + m], size)
        if before.any() or single.any():
            inside = ragged(np.zeros(m, np.int64), size)
            told = before | (single > 0)
            new = told & ((inside == 0) | ~np.append(False, told[:-1]))
            end = told & (np.append(inside[1:] == 0, True) | ~np.append(told[1:], False))
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            number = np.repeat(label[at : at + m], size)[a] + inside[a]
            out.append((r["block"], key[0].as_py(), number.astype("<u4").tobytes(), np.where(single[a] > 0, ALONE + before[a], b - a + 1).astype(np.uint8).tobytes()))
        at += m
    return _table(out, REPLY)


def _cover_equal(sums: np.ndarray, offsets: np.ndarray, ids: np.ndarray, at: np.ndarray, everywhere: np.ndarray, change: np.ndarray) -> None:
    """Covers each string of the block equal to one at ``at``: all of them, or those of documents after the first."""
    h = run_hashes(sums, at, at + MATCH)
    by = np.argsort(h, kind="stable")
    h, everywhere = h[by], everywhere[by]
    maybe = np.zeros(1 << 20, bool)  # spares most strings the search
    maybe[h & np.uint64(len(maybe) - 1)] = True
    starts, which = [], []
    for a, b in slices(offsets, 1 << 20):
        n = int(offsets[b] - offsets[a]) - MATCH + 1
        if n <= 0:
            continue
        found = gram_hashes(sums, MATCH, int(offsets[a]), n)
        s = np.flatnonzero(maybe[found & np.uint64(len(maybe) - 1)])
        found = found[s]
        s += offsets[a]
        k = np.minimum(np.searchsorted(h, found), len(h) - 1)
        hit = (h[k] == found) & (s + MATCH <= offsets[np.searchsorted(offsets, s, side="right")])  # within one text
        starts.append(s[hit])
        which.append(k[hit])
    s, k = np.concatenate(starts), np.concatenate(which)
    doc = ids[np.searchsorted(offsets, s, side="right") - 1]
    least = np.full(len(h), np.iinfo(np.int64).max)
    np.minimum.at(least, k, doc)
    s = s[everywhere[k] | (least[k] < doc)]
    np.add.at(change, s, 1)
    np.add.at(change, s + MATCH, -1)


FOUND = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered_bytes(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Which bytes of a block's texts go."""
    sums = prefix_sums(data, BYTE_VALUES)
    _, start, size, text = block_runs(data, offsets, sums)
    strings, number = _block_strings(sums, start, size)
    own = ids[text]
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, number, own)
    change = np.zeros(len(data) + MATCH + 1, np.int32)
    local = np.flatnonzero(least[number] < own)
    np.add.at(change, start[local], 1)
    np.add.at(change, start[local] + size[local] + MATCH - 1, -1)
    if len(replies):
        label = np.concatenate([np.frombuffer(x, "<u4") for x in replies.column("number").to_pylist()]).astype(np.int64)
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in replies.column("count").to_pylist()]).astype(np.int64)
        order = np.argsort(label, kind="stable")
        label, count = label[order], count[order]
        alone = count >= ALONE
        if alone.any():
            which, run = np.unique(number, return_index=True)
            at = start[run[np.searchsorted(which, label[alone] // LONGEST_RUN)]] + label[alone] % LONGEST_RUN
            _cover_equal(sums, offsets, ids, at, count[alone] > ALONE, change)
            label, count = label[~alone], count[~alone]
        told = label // LONGEST_RUN
        lo, hi = np.searchsorted(told, number, "left"), np.searchsorted(told, number, "right")
        entry = ragged(lo, hi - lo)
        at = np.repeat(start, hi - lo) + label[entry] % LONGEST_RUN
        np.add.at(change, at, 1)
        np.add.at(change, at + count[entry] + MATCH - 1, -1)
    return np.cumsum(change[: len(data)]) > 0


def _mark(key, texts: pa.Table, replies: pa.Table, with_text: bool) -> pa.Table:
    data, offsets = flat(texts.column("text"))
    gone = covered_bytes(data, offsets, _ids(texts), replies)
    rows, kept_texts = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, cut = data[a:b], gone[a:b]
        removed = int(cut.sum())
        spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if removed else 0
        rows.append((b - a, removed, spans, hashlib.sha256(own[~cut].tobytes() if removed else own.tobytes()).hexdigest()))
        if with_text:
            if removed:  # a character goes when any of its bytes goes
                lead = (own & 0xC0) != 0x80
                char = np.cumsum(lead) - 1
                lost = np.bincount(char, weights=cut) > 0
                own = own[~lost[char]]
            kept_texts.append(own.tobytes().decode())
    out = texts.drop_columns(["block", "text"])
    extra = _table(rows, FOUND)
    for name in extra.column_names:
        out = out.append_column(name, extra.column(name))
    return out.append_column("kept_text", pa.array(kept_texts, pa.string())) if with_text else out


def dedup(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256), with ``with_text`` also kept_text.

    kept_text drops a character when any of its bytes is covered; the digest is of the exact bytes.
    """
    ship(docs.sparkSession)
    own = narrow(docs, *carry)
    n = blocks_of(own, block_bytes)
    parts = n  # parts grow in number, not in size
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).alias("block")
    texts = own.select(block, "*").repartition(n, "block")
    by_block = texts.groupBy("block")
    reports = by_block.applyInArrow(lambda key, t: _report(key, t, parts, hot_runs), REPORT)
    answers = reports.groupBy("part").applyInArrow(lambda key, t: _answer(key, t, hot_runs), ANSWER)
    runs = by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda key, t, a: _send(key, t, a, parts), SEND)
    replies = runs.groupBy("part").applyInArrow(lambda key, t: _reply(key, t), REPLY)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.select(*carry).schema) if carry else ""
    schema = f"doc_id long{kinds}, {FOUND}" + ", kept_text string" * with_text
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(lambda key, t, r: _mark(key, t, r, with_text), schema)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM g),
m AS (SELECT x, min(doc_id) AS least FROM k GROUP BY x HAVING count(*) > 1),
c AS (SELECT doc_id, i FROM k JOIN m USING (x) WHERE least < doc_id),
f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS x FROM spans JOIN d USING (doc_id)),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(x, '' ORDER BY a) AS head, max(b) AS last FROM gaps GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
