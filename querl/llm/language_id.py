"""Language identification: a linear-chain conditional random field labels words, forward-backward sums them up.

A word's features are hashed: its affixes (1-3 leading, 1-4 trailing bytes), the 3-byte strings in it
and the word itself (the lexicon), A-Z folded. Transitions are learned on chains that join stretches
of different documents, as in code-switched text. A document's language is the label with the largest
sum of its words' posterior probabilities, words without a letter left out; the score is its share.

Training uses a bounded sample of rows: about SAMPLE_DOCS documents of each language of the training
fold (all where there are fewer), chosen by a hash of doc_id and text, with their whole texts. Every
language of the fold is learned, in one task, and the driver gets the model only. A chain is a whole
text when it is predicted.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing can be learned (no labelled text in the training fold). Ties go to the smaller name. Texts of
any length are read whole; repeated rows and null doc_ids (of the training fold) are rows like others;
an empty table gives an empty result; only ``carry`` columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querl.llm.common import flat, narrow, ship, slices
from querl.llm.crf import chains_at, cut_chains, posteriors, train
from querl.llm.vec import gram_hashes, mix_own, prefix_sums, ragged, run_hashes, word_bounds

SAMPLE_DOCS = 300
BITS = 17
STRETCH = 12
"""Words from one document at a time in a training chain."""
FOLD_OUT = 2

LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == FOLD_OUT


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix_own(h + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS)).astype(np.int64)


def affix_slots(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 8 feature slots of each word besides its 3-byte strings."""
    out = np.empty((len(starts), 8), np.int64)
    out[:, 0] = _slot(run_hashes(sums, starts, ends), 0)
    for k in (1, 2, 3):
        out[:, k] = _slot(run_hashes(sums, starts, np.minimum(starts + k, ends)), k)
    for k in (1, 2, 3, 4):
        out[:, 3 + k] = _slot(run_hashes(sums, np.maximum(ends - k, starts), ends), 3 + k)
    return out


def gram_slots(data: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The feature slot of the 3-byte string at each byte."""
    return _slot(gram_hashes(sums, 3, 0, max(len(data) - 2, 0)), 8)


class Model:
    """Language names, feature weights and moves between labels."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights.astype(np.float32), moves.astype(np.float32)

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = prefix_sums(data)
        slots = affix_slots(sums, starts, ends)
        out = self.weights[slots[:, 0]]
        for k in range(1, slots.shape[1]):
            out = out + self.weights[slots[:, k]]
        grams = gram_slots(data, sums)
        n = np.maximum(ends - starts - 2, 0)
        for label in range(len(self.names)):
            total = np.zeros(len(grams) + 1)
            np.cumsum(self.weights[:, label][grams], out=total[1:])
            out[:, label] += np.where(n > 0, total[np.minimum(starts + n, len(grams))] - total[np.minimum(starts, len(grams))], 0)
        return out

    def word_posteriors(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return posteriors(self.scores(data, starts, ends), self.moves, *chains_at(firsts, len(starts)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Name and score for every text."""
        starts, ends, first = word_bounds(data, offsets)
        total = np.zeros((len(offsets) - 1, max(len(self.names), 1)))
        if self.names and len(starts):
            p = self.word_posteriors(data, starts, ends, first[:-1])
            letters = np.zeros(len(data) + 1, np.int32)
            folded = data | 0x20
            np.cumsum(((folded >= 97) & (folded <= 122)) | (data >= 0x80), out=letters[1:])
            p[letters[ends] == letters[starts]] = 0
            sums = np.zeros((len(p) + 1, p.shape[1]))
            np.cumsum(p, axis=0, out=sums[1:])
            total = sums[first[1:]] - sums[first[:-1]]
        raw, bounds = data.tobytes(), offsets.tolist()
        names, scores = [], np.zeros(len(total))
        for i in range(len(total)):
            weight = total[i].sum()
            if self.names and weight > 0 and LETTER.search(raw[bounds[i] : bounds[i + 1]].decode()):
                best = int(total[i].argmax())
                names.append(self.names[best])
                scores[i] = min(1.0, total[i][best] / weight)
            else:
                names.append("und")
        return names, scores


def fit_texts(texts: list[str], labels: list[str], seed: int = 9) -> Model:
    """A Model of the labelled ``texts``."""
    names = sorted(set(labels))
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = word_bounds(data, offsets)
    if not names or not len(starts):
        return Model([], np.zeros((1, 1)), np.zeros((1, 1)))
    sums = prefix_sums(data)
    own = affix_slots(sums, starts, ends).astype(np.int32)
    grams = gram_slots(data, sums).astype(np.int32)
    del sums
    n = np.maximum(ends - starts - 2, 0)
    size = own.shape[1] + n
    features_at = np.append(0, np.cumsum(size))
    features = np.empty(features_at[-1], np.int32)
    for k in range(own.shape[1]):
        features[features_at[:-1] + k] = own[:, k]
    features[ragged(features_at[:-1] + own.shape[1], n)] = grams[ragged(starts, n)]
    y = np.repeat([names.index(x) for x in labels], np.diff(first))
    rng = np.random.default_rng(seed)
    begin, length = cut_chains(first[:-1], len(starts), STRETCH)
    order = ragged(begin[perm := rng.permutation(len(begin))], length[perm])
    size = size[order]
    shuffled = features[ragged(features_at[order], size)]
    del features, own, grams
    chain_at, chain_n = cut_chains(np.zeros(1, np.int64), len(order), 5 * STRETCH)
    weights, moves = train(shuffled, np.append(0, np.cumsum(size)), y[order], chain_at, chain_n, 1 << BITS, len(names), epochs=3, batch=64)
    return Model(names, weights, moves)


MODEL = "names array<string>, slots int, weights binary, moves binary"


def _fit_sample(table: pa.Table) -> pa.Table:
    """The model of a sample (h, text, lang) as one row."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "lang", "text")), strict=True))
    model = fit_texts([r[2] for r in rows], [r[1] for r in rows])
    columns = pa.array([model.names], pa.list_(pa.string())), pa.array([len(model.weights)], pa.int32()), pa.array([model.weights.tobytes()]), pa.array([model.moves.tobytes()])
    return pa.Table.from_arrays(columns, ["names", "slots", "weights", "moves"])


def sample(docs: DataFrame) -> DataFrame | None:
    """(h, text, lang): the bounded sample of the training fold of ``docs`` (doc_id, text, lang); None where the fold is empty."""
    fold = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = fold.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    # a share of the hashes, none where there are few rows: numbers of languages, not of documents
    share = F.col("n").cast("double") / SAMPLE_DOCS
    counts = fold.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.when(share > 1, F.lit(float(1 << 63)) / share).alias("below")).collect()
    if not counts:
        return None
    counts = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, below double"))  # a row for each label that the model will have
    h = F.xxhash64("doc_id", "text", F.lit(9))
    drawn = fold.withColumn("h", h.bitwiseAND(F.lit((1 << 63) - 1))).join(counts, "lang")
    return drawn.where(F.col("below").isNull() | (F.col("h") < F.col("below"))).select("h", "text", "lang")


def fit(docs: DataFrame) -> Model:
    """A Model of the bounded sample of the training fold of ``docs``."""
    ship(docs.sparkSession)
    drawn = sample(docs)
    row = None if drawn is None else drawn.groupBy().applyInArrow(lambda t: _fit_sample(t), MODEL).first()  # bounded: one task
    if row is None or not row["names"]:
        return Model([], np.zeros((1, 1)), np.zeros((1, 1)))
    names, slots = list(row["names"]), row["slots"]
    weights = np.frombuffer(row["weights"], np.float32).reshape(slots, len(names))
    return Model(names, weights, np.frombuffer(row["moves"], np.float32).reshape(len(names), len(names)))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _predict(batches: Iterator[pa.RecordBatch], model: Model, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        ids = batch.column("doc_id")
        for a, b in slices(offsets, 2 << 20):
            names, scores = model.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            own = ids.slice(a, b - a)
            out = [d is not None and zlib.crc32(str(d).encode()) % 4 == FOLD_OUT for d in own.to_pylist()]
            columns, fields = [own, pa.array(out, pa.bool_()), pa.array(names, pa.string()), pa.array(scores)], [x.split()[0] for x in SCHEMA.split(", ")]
            columns += [batch.column(name).slice(a, b - a) for name in carry]
            fields += carry
            yield pa.RecordBatch.from_arrays(columns, fields)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, and the columns ``carry`` (text among them: null as empty)."""
    ship(docs.sparkSession)
    own = narrow(docs, *[c for c in carry if c != "text"])
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.select(*carry).schema) if carry else ""
    return own.mapInArrow(partial(_predict, model=model, carry=carry), SCHEMA + kinds)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the training fold and predicts every document."""
    return predict(docs, fit(docs))
