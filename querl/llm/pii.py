"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The field labels words by features of their shape and of their neighbours' shapes. It is trained
when asked for, from a small labelled table made by rule, and decoded by Viterbi over batches of
texts. A chain is a whole line. Neighbouring words of one label on a line are one span, unless
a kind is written as one word (all but card and phone) or a new number begins. What the patterns find
stays; of a span of the field, what lies outside of those is added. Kinds: email, ip, card, phone as
the patterns have them, and secret (keys, tokens and passwords), which only the field finds.

Defined results: a null text is empty; a text without findings has empty lists; positions are code
points, ends exclusive; texts of any length are searched whole; every row is a document of its own,
repeated or with a null doc_id; an empty table gives an empty result; only ``carry`` columns are kept.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querl.llm.common import flat, narrow, ship, slices
from querl.llm.crf import chains_at, train, viterbi
from querl.llm.vec import word_bounds

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
IN_WORDS = (LABELS.index("card"), LABELS.index("phone"))
"""Kinds that may be written as several words."""
SECRET = LABELS.index("secret")

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Does the check digit hold?"""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, leftmost and non-overlapping for each kind, by kind and start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:  # a match begins where the run of characters before the @ does
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = AFTER_AT.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# Word shapes -----------------------------------------------------------------------------------

_CLASSES = {
    "digit": string.digits, "upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "hex": "0123456789abcdef", "at": "@",
    "dot": ".", "dash": "-", "assign": "=:", "pipe": "|*#$%&<>!",
}
_IN_CLASS = np.zeros((len(_CLASSES), 256), np.int8)
for _row, _chars in enumerate(_CLASSES.values()):
    _IN_CLASS[_row, list(_chars.encode())] = 1
_ROW = {name: i for i, name in enumerate(_CLASSES)}
_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 32])
GROUPS = (8, 4, 2, 4, 3, 2, 2, 2, 2)
"""How many values each part of a shape has; see shapes()."""
N_SHAPES = int(np.prod(GROUPS))
_FIRST = np.cumsum((0, *GROUPS[:-1]))
PER_PLACE = sum(GROUPS) + 1
"""Weights for one place (the word itself, the word before, the word after); the last is for no word."""


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape number of each word, from counts of character classes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    count = {}
    for name, row in _ROW.items():
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_IN_CLASS[row][data], out=sums[1:])
        count[name] = (sums[ends] - sums[starts]).astype(np.int64)
    n = ends - starts
    digits = count["digit"]
    first = data[starts]
    alnum = digits + count["upper"] + count["lower"]
    parts = (
        np.searchsorted(_LENGTHS, n, side="right"),
        np.where(digits == 0, 0, np.where(digits == alnum, 3, np.where(2 * digits >= n, 2, 1))),
        count["at"] > 0,
        np.minimum(count["dot"], 3),
        np.where((count["upper"] > 0) & (digits > 0) & (count["lower"] == 0), 1, np.where((digits > 0) & (count["hex"] >= 12) & (count["hex"] * 10 >= n * 6), 2, 0)),
        (count["assign"] > 0) & (alnum > 0),
        (first == 43) | (first == 40),
        count["dash"] > 0,
        count["pipe"] > 0,
    )
    out = np.zeros(len(n), np.int64)
    for size, part in zip(GROUPS, parts, strict=True):
        out = out * size + part
    return out


def _shape_features() -> np.ndarray:
    """For every shape number the weight numbers of its parts."""
    out, rest = np.zeros((N_SHAPES, len(GROUPS)), np.int64), np.arange(N_SHAPES)
    for g in range(len(GROUPS) - 1, -1, -1):
        out[:, g] = _FIRST[g] + rest % GROUPS[g]
        rest = rest // GROUPS[g]
    return out


SHAPE_FEATURES = _shape_features()


# The labelled table ----------------------------------------------------------------------------


def labelled_table(seed: int = 8, lines: int = 1200) -> list[list[tuple[str, str]]]:
    """Lines of (word, label) made by rule: prose with personal data, and look-alikes that are none."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda n: "".join(rng.choices(string.digits, k=n))
    syllables = ("an", "the", "er", "ou", "ión", "sch", "é", "wh", "ti", "on", "la", "ß")
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 6)))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))

    def prose() -> str:
        w = word()
        return pick((w, w, w, w, w.capitalize(), w + ",", w + ".", w.upper(), w.upper() + "!!", w + "-" + word(), "(" + w + ")", w + pick(("***", "$$$", "%%%", "&&&", "###")), "|", "a", "I"))

    def plain_number() -> list[str]:
        return pick(
            (
                [digits(rng.randint(1, 4))], [digits(2) + "." + digits(1)], [digits(1) + "." + digits(1) + "."], [digits(4) + "-" + digits(2) + "-" + digits(2)],
                [digits(1) + ".0"], ["(" + digits(4) + ")"], [digits(1) + "," + digits(3)], ["v" + digits(1) + "." + digits(2)], ["$" + digits(3)], [digits(2) + ":" + digits(2)],
                ["https://" + word() + ".example/" + word()], [word() + "_" + word()], ["#" + digits(2)], [word() + digits(1)], ["A" + digits(1)], [digits(2) + "%"], ["=="], ["x=1"], [word() + ":"],
            )
        )

    def found() -> tuple[str, list[str]]:
        kind = pick(KINDS)
        end = pick(("", "", "", ",", "."))
        if kind == "email":
            return kind, [pick(("", "<", "("))[:0] + word().replace("é", "e").replace("ß", "s").replace("ó", "o") + pick((".", "_", "")) + digits(2) + "@" + pick(("mail", "post")) + digits(1) + "." + pick(("example.com", "example.org", "test")) + end]
        if kind == "ip":
            return kind, [".".join(str(rng.randint(1, 254)) for _ in range(4)) + end]
        if kind == "card":
            return kind, pick(([digits(16) + end], [digits(4), digits(4), digits(4), digits(4) + end], ["-".join(digits(4) for _ in range(4)) + end]))
        if kind == "phone":
            return kind, pick((["+" + digits(1), "(" + digits(3) + ")", digits(3) + "-" + digits(4) + end], ["(" + digits(3) + ")", digits(3) + "-" + digits(4) + end], ["+" + digits(2), digits(3), digits(3) + "-" + digits(4) + end]))
        return kind, pick(
            (
                ["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) + end],
                ["password=" + hexes(18) + end], ["token:" + hexes(24)], ['"' + hexes(40) + '"' + end], [hexes(40)], [hexes(32)],
                ["key=" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=20))],
            )
        )

    table = []
    for _ in range(lines):
        line: list[tuple[str, str]] = []
        for _ in range(rng.randint(1, 4)):
            line += [(prose(), "none") for _ in range(rng.randint(0, 10))]
            if rng.random() < 0.5:
                kind, words = found()
                line += [(w, kind) for w in words]
            else:
                line += [(w, "none") for w in plain_number()]
        line += [(prose(), "none") for _ in range(rng.randint(0, 6))]
        if line:
            table.append(line)
    return table


class Tagger:
    """The trained field as tables: the scores a shape gives to its word and to its neighbours."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        place = [weights[k * PER_PLACE : (k + 1) * PER_PLACE] for k in range(3)]
        self.own, self.before, self.after = (np.vstack([p[SHAPE_FEATURES].sum(axis=1), p[-1:]]).astype(np.float32) for p in place)
        self.moves = moves.astype(np.float32)

    def labels(self, shape: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        before, after = neighbours(shape, starts, lengths)
        return viterbi(self.own[shape] + self.before[before] + self.after[after], self.moves, starts, lengths)


def neighbours(shape: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shapes before and after each word in its chain; N_SHAPES where there is none."""
    before, after = np.append(N_SHAPES, shape[:-1])[: len(shape)], np.append(shape[1:], N_SHAPES)[: len(shape)]
    before[starts], after[starts + lengths - 1] = N_SHAPES, N_SHAPES
    return before, after


def train_tagger(table: list[list[tuple[str, str]]]) -> Tagger:
    """A Tagger fitted to lines of (word, label)."""
    words = [w.encode() for line in table for w, _ in line]
    labels = np.array([LABELS.index(k) for line in table for _, k in line])
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    shape = shapes(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    lengths = np.array([len(line) for line in table])
    starts = np.cumsum(lengths) - lengths
    lookup = np.vstack([SHAPE_FEATURES, np.full((1, len(GROUPS)), PER_PLACE - 1)])
    before, after = neighbours(shape, starts, lengths)
    features = np.hstack([lookup[shape], lookup[before] + PER_PLACE, lookup[after] + 2 * PER_PLACE])
    offsets = np.arange(len(shape) + 1) * features.shape[1]
    return Tagger(*train(features.ravel(), offsets, labels, starts, lengths, 3 * PER_PLACE, len(LABELS), epochs=20, batch=64))


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train_tagger(labelled_table())


# Spans of texts --------------------------------------------------------------------------------

EDGES = " \t\n\x0b\x0c\r,.;:!?\"'<>[]{}#*|`~"


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in EDGES:
        a += 1
    while a < b and text[b - 1] in EDGES:
        b -= 1
    return a, b


def _new_numbers(label: np.ndarray, new: np.ndarray, digits: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where runs of labelled words begin, with runs of cards and phones cut where one number is over.

    A card is over once it has 16 digits, a phone where a word opens with + or, after a whole number,
    with a bracket or a digit; both after a comma or full stop.
    """
    new = new.copy()
    held = 0
    for i in np.flatnonzero(np.isin(label, IN_WORDS)).tolist():
        if not new[i]:
            card = label[i] == IN_WORDS[0]
            new[i] = last[i - 1] in b",.;" or (held >= 16 if card else first[i] == 43 or held >= 10 or held >= 7 and first[i] == 40)
        held = int(digits[i]) if new[i] else held + int(digits[i])
    return new


def tagged_runs(data: np.ndarray, offsets: np.ndarray, tagger: Tagger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text index, label, first byte and end byte of each run of words with one label."""
    starts, ends, first = word_bounds(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none
    lines = np.searchsorted(starts, np.flatnonzero(data == 10))
    begin, length = chains_at(np.concatenate([first[:-1], lines]), len(starts))
    labels = tagger.labels(shapes(data, starts, ends), begin, length)
    some = np.flatnonzero(labels)
    digits = np.array([np.count_nonzero((data[a:b] >= 48) & (data[a:b] <= 57)) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], np.int64)
    part = (digits > 0) | ~np.isin(labels[some], IN_WORDS)  # a word without a digit is no part of a number
    some, digits = some[part], digits[part]
    if not len(some):
        return none, none, none, none
    line = np.searchsorted(begin, some, side="right")
    label = labels[some]
    new = np.append(True, (np.diff(some) != 1) | (np.diff(label) != 0) | (np.diff(line) != 0)) | ~np.isin(label, IN_WORDS)
    new = _new_numbers(label, new, digits, data[starts[some]], data[ends[some] - 1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(some)) - 1
    text = np.searchsorted(offsets, starts[some[head]], side="right") - 1
    return text, label[head], starts[some[head]], ends[some[tail]]


def _outside(a: int, b: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of [a, b) lies outside of the sorted spans ``base``."""
    out = []
    for p, q in base:
        if p < b and a < q:
            out.append((a, p))
            a = max(a, q)
    return [(x, y) for x, y in (*out, (a, b)) if x < y]


def find_all(data: np.ndarray, offsets: np.ndarray, tagger: Tagger) -> list[tuple[list, list]]:
    """For every text its pattern spans and the spans the field adds."""
    text, label, a, b = tagged_runs(data, offsets, tagger)
    per = np.searchsorted(text, np.arange(len(offsets)))
    raw = data.tobytes()
    bounds = offsets.tolist()
    out = []
    for i in range(len(bounds) - 1):
        own = raw[bounds[i] : bounds[i + 1]]
        lo, hi = int(per[i]), int(per[i + 1])
        s = own.decode()
        base = pattern_spans(s) if lo < hi or b"@" in own or DIGIT.search(s) else []
        taken = sorted((p, q) for _, p, q in base)
        more = []
        x = byte = 0  # positions in the text so far
        for k in range(lo, hi):
            first, end = int(a[k]) - bounds[i], int(b[k]) - bounds[i]
            x += len(own[byte:first].decode())
            y = x + len(own[first:end].decode())
            for p, q in _outside(x, y, taken):
                p, q = _trim(s, p, q)
                if q - p > 3 and (label[k] == SECRET or DIGIT.search(s, p, q)):  # what is left beside a pattern's span may be nothing
                    more.append((LABELS[label[k]], p, q))
            x, byte = y, end
        out.append((base, more))
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or union of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(batches: Iterator[pa.RecordBatch], tagger: Tagger, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found = find_all(own, at, tagger)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS[:4]]
            columns = [batch.column("doc_id").slice(a, b - a)] + [pa.array(c, pa.int64()) for c in counts]
            columns.append(pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([_join(base + more) for base, more in found], pa.string()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if texts:
                raw = own.tobytes()
                clean = [redact(raw[x:y].decode(), base + more) for x, y, (base, more) in zip(at[:-1].tolist(), at[1:].tolist(), found, strict=True)]
                columns, names = [*columns, pa.array(clean, pa.string())], [*names, "clean_text"]
                for name in batch.schema.names:
                    if name not in ("doc_id", "text"):
                        columns, names = [*columns, batch.column(name).slice(a, b - a)], [*names, name]
            yield pa.RecordBatch.from_arrays(columns, names)


def find(docs: DataFrame, texts: bool = False, carry: tuple[str, ...] = (), tagger: Tagger | None = None) -> DataFrame:
    """Counts and digests of findings in every whole text; with ``texts`` also clean_text (redacted) and ``carry`` columns."""
    ship(docs.sparkSession)
    own = narrow(docs, *carry)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own.select(*carry).schema) if carry else ""
    return own.mapInArrow(partial(_find, tagger=tagger or default_tagger(), texts=texts), SCHEMA + (", clean_text string" + kinds) * texts)
