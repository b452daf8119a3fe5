"""Linear-chain conditional random fields over many chains at once, in numpy.

Words of all chains lie back to back; a chain is a start and a length (at least 1). Every step of a
recursion handles that step of all chains still running, the longest first.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Chains by falling length: ``at(t)`` gives the words at step t of the chains that have one."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        self.steps = int(self.lengths[0]) if len(order) else 0
        self.running = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left") if self.steps else np.zeros(0, np.int64)

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.running[t]] + t


def cut_chains(firsts: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains that begin at ``firsts`` among ``n`` words, cut to ``limit`` words each (training texts only)."""
    return _pieces(*chains_at(firsts, n), limit)[:2]


def chains_at(firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the whole chains that begin at ``firsts`` among ``n`` words."""
    firsts = np.unique(firsts[firsts < n])
    return firsts, np.diff(np.append(firsts, n)) if n else firsts


def _pieces(starts: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the chains' pieces of at most ``limit`` words, and the number of pieces of each chain."""
    if not len(starts):
        return starts, lengths, lengths
    count = -(-lengths // limit)
    ends = np.cumsum(count)
    step = (np.arange(int(ends[-1])) - np.repeat(ends - count, count)) * limit
    return np.repeat(starts, count) + step, np.minimum(np.repeat(lengths, count) - step, limit), count


# Long chains. A recursion over a whole text would take as many steps as its longest text has words. So
# chains are walked in blocks: for every block at once, what each label before it makes of each label
# at its end; then from block to block; then within all blocks again, their borders known. This is the
# recursion over the whole chain, only in another order. It takes as many times the work as there are
# labels, so shorter chains are walked word by word.

BLOCK = 64
STATE = 1 << 22
"""Numbers in the state of the blocks walked at once."""


class _Blocks:
    """The blocks of chains, and the chains as chains of blocks."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        begin, size, count = _pieces(starts, lengths, BLOCK)
        self.first = np.zeros(len(begin), bool)
        at = np.cumsum(count) - count
        self.first[at] = True
        self.words = Chains(begin, size)
        order = np.argsort(-size, kind="stable")  # as Chains has them
        self.first = self.first[order]
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))  # a block's row among the blocks as Chains has them
        self.chains = Chains(at, count)

    def rows(self, t: int) -> np.ndarray:
        """Rows of the t-th blocks of the chains that have one."""
        return self.rank[self.chains.at(t)]


def _grouped(starts: np.ndarray, lengths: np.ndarray, each: int):
    """Ranges of chains, each of about STATE / ``each`` words or one chain."""
    total = np.append(0, np.cumsum(lengths))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STATE // each, side="right")) - 1)
        yield starts[at:to], lengths[at:to]
        at = to


def viterbi(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every word: ``scores`` (words, labels), ``moves`` (from, to)."""
    labels = np.zeros(len(scores), np.int64)
    long = lengths > BLOCK * len(moves)
    if not long.all():
        _viterbi_short(scores, moves, Chains(starts[~long], lengths[~long]), labels)
    for s, n in _grouped(starts[long], lengths[long], len(moves) ** 2):
        _viterbi_long(scores, moves, _Blocks(s, n), labels)
    return labels


def _best_before(best: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score before a word for each of its labels, and the label it comes from; labels are the last axis."""
    top = best[..., 0, None] + moves[0]
    come = np.zeros(top.shape, np.uint16)
    for k in range(1, len(moves)):
        other = best[..., k, None] + moves[k]
        better = other > top
        top = np.where(better, other, top)
        come[better] = k
    return top, come


def _viterbi_short(scores: np.ndarray, moves: np.ndarray, chains: Chains, labels: np.ndarray) -> None:
    best = scores[chains.at(0)].copy()
    back = np.zeros(scores.shape, np.uint16)
    for t in range(1, chains.steps):
        at = chains.at(t)
        top, come = _best_before(best[: len(at)], moves)
        best[: len(at)] = top + scores[at]
        back[at] = come
    labels[chains.starts + chains.lengths - 1] = best.argmax(axis=1)
    for t in range(chains.steps - 1, 0, -1):
        at = chains.at(t)
        labels[at - 1] = back[at, labels[at]]


def _viterbi_long(scores: np.ndarray, moves: np.ndarray, blocks: _Blocks, labels: np.ndarray) -> None:
    words = blocks.words
    at = words.at(0)
    best = moves[None] + scores[at][:, None, :]  # (block, label before it, label of the word)
    best[blocks.first] = scores[at[blocks.first]][:, None, :]  # nothing comes before: all rows alike
    back = []
    for t in range(1, words.steps):
        at = words.at(t)
        top, come = _best_before(best[: len(at)], moves)
        best[: len(at)] = top + scores[at][:, None, :]
        back.append(come)
    now, border = None, np.zeros((len(best), len(moves)), np.uint16)
    for t in range(blocks.chains.steps):
        rows = blocks.rows(t)
        if t == 0:
            now = best[rows, 0].astype(np.float64)
            continue
        through = now[: len(rows), :, None] + best[rows]
        border[rows] = through.argmax(axis=1)
        through = through.max(axis=1)
        now[: len(rows)] = through - through.max(axis=1, keepdims=True)
    ends = now.argmax(axis=1)  # of each chain, as blocks.chains has them
    before, last = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    want = ends.copy()
    for t in range(blocks.chains.steps - 1, -1, -1):
        rows = blocks.rows(t)
        last[rows] = want[: len(rows)]
        before[rows] = border[rows, last[rows]]
        want[: len(rows)] = before[rows]
    labels[words.starts + words.lengths - 1] = last
    for t in range(words.steps - 1, 0, -1):
        at = words.at(t)
        labels[at - 1] = back[t - 1][np.arange(len(at)), before[: len(at)], labels[at]]


def _messages(scores: np.ndarray, moves: np.ndarray, chains: Chains, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled local weights, forward and backward messages of the chains' words.

    before: what reaches each chain's first word from words before it; after: the message that its last word gets from those after it.
    """
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves).astype(scores.dtype)
    forward, backward = np.empty_like(local), np.ones_like(local)
    now = None
    for t in range(chains.steps):
        at = chains.at(t)
        now = (local[at] if before is None else before * local[at]) if t == 0 else (now[: len(at)] @ step) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    if after is not None:
        backward[chains.starts + chains.lengths - 1] = after
    for t in range(chains.steps - 1, 0, -1):
        at = chains.at(t)
        now = (local[at] * backward[at]) @ step.T
        now /= now.sum(axis=1, keepdims=True)
        backward[at - 1] = now
    return local, forward, backward


def posteriors(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward: every word's label probabilities."""
    out = np.zeros_like(scores)
    long = lengths > BLOCK * len(moves)
    if not long.all():
        _posteriors_into(out, scores, moves, Chains(starts[~long], lengths[~long]))
    for s, n in _grouped(starts[long], lengths[long], len(moves) ** 2):
        blocks = _Blocks(s, n)
        _posteriors_into(out, scores, moves, blocks.words, *_borders(scores, moves, blocks))
    return out


def _posteriors_into(out: np.ndarray, scores: np.ndarray, moves: np.ndarray, chains: Chains, *borders: np.ndarray) -> None:
    own = np.repeat(chains.starts - (np.cumsum(chains.lengths) - chains.lengths), chains.lengths) + np.arange(int(chains.lengths.sum()))
    local = Chains(np.cumsum(chains.lengths) - chains.lengths, chains.lengths)
    _, forward, backward = _messages(scores[own], moves, local, *borders)
    forward *= backward
    forward /= forward.sum(axis=1, keepdims=True)
    out[own] = forward


def _borders(scores: np.ndarray, moves: np.ndarray, blocks: _Blocks) -> tuple[np.ndarray, np.ndarray]:
    """For each block what _messages() takes as ``before`` and ``after``."""
    words, n = blocks.words, len(moves)
    step = np.exp(moves).astype(scores.dtype)
    local = lambda at: np.exp(scores[at] - scores[at].max(axis=1, keepdims=True))
    through = step[None] * local(words.at(0))[:, None, :]  # (block, label before it, label of its last word so far)
    for t in range(1, words.steps):
        at = words.at(t)
        now = (through[: len(at)] @ step) * local(at)[:, None, :]
        through[: len(at)] = now / now.sum(axis=(1, 2), keepdims=True)
    before, after = np.ones((len(through), n), scores.dtype), np.ones((len(through), n), scores.dtype)
    start = words.starts[blocks.rows(0)]
    now = local(start)  # a chain's first block has nothing before it, and BLOCK words
    for t in range(1, BLOCK):
        now = (now @ step) * local(start + t)
        now /= now.sum(axis=1, keepdims=True)
    for t in range(1, blocks.chains.steps):
        rows = blocks.rows(t)
        now = now[: len(rows)]
        before[rows] = now @ step
        now = (now[:, None, :] @ through[rows])[:, 0, :]
        now /= now.sum(axis=1, keepdims=True)
    for t in range(blocks.chains.steps - 1, 0, -1):
        rows = blocks.rows(t)
        message = (through[rows] @ after[rows][:, :, None])[:, :, 0]
        after[blocks.rows(t - 1)[: len(rows)]] = message / message.sum(axis=1, keepdims=True)
    return before, after


def word_scores(weights: np.ndarray, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of each word's features (every word has some)."""
    return np.add.reduceat(weights[features], offsets[:-1], axis=0)


def train(
    features: np.ndarray, offsets: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
    n_features: int, n_labels: int, epochs: int = 4, batch: int = 256, rate: float = 0.2, decay: float = 1e-6, seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, labels) and moves that raise the chains' conditional likelihood, by AdaGrad."""
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    seen, seen_moves = np.full((n_features, n_labels), 1e-6), np.full((n_labels, n_labels), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(starts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            s, n = starts[own], lengths[own]
            words = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            size = offsets[words + 1] - offsets[words]
            flat = features[np.repeat(offsets[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            local_offsets = np.append(0, np.cumsum(size))
            chains = Chains(np.cumsum(n) - n, n)
            scores = word_scores(weights, flat, local_offsets)
            local, forward, backward = _messages(scores, moves, chains)
            marginal = forward * backward
            marginal /= marginal.sum(axis=1, keepdims=True)
            y = labels[words]
            error = -marginal
            error[np.arange(len(y)), y] += 1
            later = np.ones(len(words), bool)
            later[np.cumsum(n) - n] = False
            later = np.flatnonzero(later)
            pair = forward[later - 1][:, :, None] * np.exp(moves)[None] * (local * backward)[later][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            move_error = -pair.sum(axis=0)
            np.add.at(move_error, (y[later - 1], y[later]), 1)
            used, where = np.unique(flat, return_inverse=True)
            spread = np.repeat(error, size, axis=0)
            gradient = np.stack([np.bincount(where, weights=spread[:, k], minlength=len(used)) for k in range(n_labels)], axis=1)
            gradient = gradient / len(own) - decay * weights[used]
            seen[used] += gradient * gradient
            weights[used] += rate * gradient / np.sqrt(seen[used])
            move_error = move_error / len(own) - decay * moves
            seen_moves += move_error * move_error
            moves += rate * move_error / np.sqrt(seen_moves)
    return weights, moves
