"""Near-duplicates by MinHash with tensored banding.

A text's set holds its distinct 5-word shingles (words of bytes other than 0x20 and 0x09-0x0D, A-Z
folded); texts of fewer words have their sequence as one shingle. Texts of equal sets form a class,
which is handled through its smallest doc_id. Two small collections, each of ``side`` keys of ROWS
minhashes, are tensored: each pair of a key of the first and a key of the second names a bucket of a
table, so 2 * side * ROWS minhashes serve side * side tables of 2 * ROWS rows. Two texts of
similarity s meet in some table with probability (1 - (1 - s**ROWS)**side)**2; ``side`` is the least
that leaves at most MISS to a pair at the threshold: 12 at 0.85, 16 at 0.80. Only keys that occur
twice are tensored.

Buckets are resolved without all pairs. First every text is compared, on full sets, with one hub: of
the smallest texts of its buckets, the one it shares most buckets with. Texts of buckets that still
hold several components are resolved exactly, by prefixes: ordered by how rare they are among these
texts, two similar sets share one of the first n - ceil(t n) + 1 shingles of each at threshold t. The texts that
share such a shingle are compared with a few hubs of other components, unless bitmaps of the sets
show that they can't be similar; hubs retire, and this goes on
with more hubs until every two texts of a shingle are in one component or have been compared.

Defined results: a null or wordless text has an empty set and links with nothing; a null doc_id
links with nothing and keeps its row with a null component; rows of
one doc_id should be copies (where they differ, one of them has the links); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.llm.common import cut, cut_measured, flat, narrow, ship, slices
from querl.llm.components import components
from querl.llm.vec import mix, shingle_sets

WORDS = 5
ROWS = 3
MISS = 2.5e-5
"""The most a pair at the threshold may have as its probability to meet in no table."""
MAP_WORDS = 64
"""64-bit words of the bitmaps that bound the difference of two sets from below."""
HUBS = 8
"""A shingle's hubs in the first round, and how many times as many each next round has."""
SHARE = 1000
"""A bucket with more than one in SHARE of all rows is dealt over several tasks; there can't be more than SHARE of those."""


@cache
def side_of(numerator: int, denominator: int) -> int:
    """The keys a collection needs for pairs at the threshold to miss every table with probability MISS at most."""
    side, apart = 1, 1 - (numerator / denominator) ** ROWS
    while 1 - (1 - apart**side) ** 2 > MISS:
        side += 1
    return side


@cache
def hash_functions(side: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the 2 * side * ROWS hash functions."""
    rng = np.random.default_rng(85)
    factors = rng.integers(1, 1 << 63, 2 * side * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, 2 * side * ROWS, dtype=np.uint64)


def minhashes(values: np.ndarray, firsts: np.ndarray, side: int) -> np.ndarray:
    """For sets back to back (none empty), the minimum of every hash function over each."""
    factors, shifts = hash_functions(side)
    out = np.empty((len(firsts), len(factors)), np.uint64)
    work = np.empty_like(values)
    for k, (a, b) in enumerate(zip(factors, shifts, strict=True)):
        np.multiply(values, a, out=work)
        np.add(work, b, out=work)
        out[:, k] = np.minimum.reduceat(work, firsts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """The keys of ROWS minhashes each."""
    m = mins.reshape(len(mins), -1, ROWS)
    key = np.zeros(m.shape[:2], np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key


def _sketch(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), 2 * side), np.uint64)
            sums = np.zeros((len(sets), 2), np.uint64)
            if len(full):
                values = np.concatenate(sets)
                firsts = np.cumsum(sizes[full]) - sizes[full]
                keys[full] = band_keys(minhashes(values, firsts, side))
                sums[full, 0] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), firsts)
                sums[full, 1] = np.add.reduceat(mix(values ^ np.uint64(0x14057B7EF767814F)), firsts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * side), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), lists],
                ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
            ends = np.cumsum([0, *(len(s) for s in sets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            bits = np.zeros((len(sets), 64 * MAP_WORDS), bool)
            for row, own in zip(bits, sets, strict=True):
                row[own % np.uint64(64 * MAP_WORDS)] = True
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * MAP_WORDS), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, maps], ["id", "shingles", "map"])


def sketches(docs: DataFrame, side: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys): set size, 128-bit fingerprint of the set, band keys."""
    ship(docs.sparkSession)
    return narrow(docs).mapInArrow(partial(_sketch, side=side), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def shingles(docs: DataFrame) -> DataFrame:
    """(id, shingles, map): the full sets and a bitmap of each."""
    ship(docs.sparkSession)
    return narrow(docs).mapInArrow(_sets, "id long, shingles array<long>, map array<long>")


def split_join(rows: DataFrame, few: DataFrame, counts: DataFrame, total: int, each: int = 1) -> DataFrame:
    """``rows`` (bucket, id, ...) joined by bucket with ``few``, which has up to ``each`` rows for a bucket.

    counts: (bucket, c), rows of each bucket, which are ``total`` together. A bucket that holds a large
    share of them is split by id, and its few rows are repeated for each split. At most SHARE buckets
    come to the driver and become part of the plan; a bucket counts as large only where all that is repeated stays
    below a thirtieth of ``rows``.
    """
    share = min(SHARE, total // (128 * each))
    splits = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("c") * share / max(total, 1)))).cast("int")
    large = counts.where(F.col("c") * share > total).select(splits.alias("splits"), "bucket").collect()
    if not large:
        return rows.join(few, "bucket")
    of = F.lit(1)
    for n in sorted({r["splits"] for r in large}):  # powers of two, so a look into few hash sets; a join would pass all rows on
        among = ", ".join(f"{r['bucket']}L" for r in large if r["splits"] == n)
        of = F.when(F.expr(f"bucket IN ({among})"), n).otherwise(of)
    own = rows.withColumn("split", F.pmod(F.xxhash64("id"), of).cast("int"))
    repeated = few.withColumn("split", F.explode(F.sequence(F.lit(0), of - 1)))
    return own.join(repeated, ["bucket", "split"]).drop("split")


def bucket_members(reps: DataFrame, side: int) -> tuple[DataFrame, DataFrame, int]:
    """(bucket, id, n): for tables made of the keys that at least two of ``reps`` have, buckets of at least two.

    With them the rows of each bucket, (bucket, c), and of all.
    """
    one = reps.select("doc_id", "n_shingles", F.posexplode("keys").alias("place", "key"))
    twice = one.groupBy("place", "key").agg(F.count("*").alias("c")).where("c > 1").select("place", "key")
    mine = (
        one.join(twice, ["place", "key"])
        .groupBy("doc_id", "n_shingles")
        .agg(F.collect_list(F.struct("place", "key")).alias("k"))  # 2 * side at most
    )
    first = F.filter("k", lambda x: x["place"] < side)
    second = F.filter("k", lambda x: x["place"] >= side)
    pairs = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["place"], a["key"], b["place"], b["key"]))))
    rows = mine.select(F.explode(pairs).alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    rows = cut(rows, "members")  # read twice below
    counts, seen = cut_measured(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "bucket-sizes", n=F.coalesce(F.sum("c"), F.lit(0)))
    return split_join(rows, counts.select("bucket"), counts, seen["n"]), counts, seen["n"]


def _similar(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (u, v) whose full sets have denominator * intersection >= numerator * union."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("a", "b"))
    sized = both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return sized.select("u", "v", (F.expr(f"{denominator}L * common") >= F.expr(f"{numerator}L * (total - common)")).alias("linked"))


def _first_links(members: DataFrame, counts: DataFrame, total: int, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links of every text with the hub it shares most buckets with."""
    hubs = members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"))
    size_ok = (denominator * F.least("n", "hub.n")) >= (numerator * F.greatest("n", "hub.n"))
    shared = split_join(members, hubs, counts, total).where((F.col("id") != F.col("hub.id")) & size_ok).groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("c"))
    best = shared.groupBy("id").agg(F.max(F.struct("c", (-F.col("hub")).alias("less"))).alias("m"))
    pairs = best.select(F.col("id").alias("u"), (-F.col("m.less")).alias("v"))
    return cut(_similar(pairs, sets, numerator, denominator).where("linked").select("u", "v"), "first-links")


def _rare_shingles(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(bucket, id, n, map): of each set, those of its rarest n - ceil(t n) + 1 shingles that another set has."""
    one = sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("bucket"))
    often, seen = cut_measured(one.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "often", n=F.coalesce(F.sum("c"), F.lit(0)))
    mine = split_join(one, often, often, seen["n"]).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "bucket"))).alias("k"))  # a text's own shingles
    alone = F.col("n") - F.size("k")
    prefix = F.expr(f"n - (n * {numerator}L + {denominator - 1}) div {denominator}L + 1") - alone
    rare = mine.where(prefix > 0).select("id", "n", F.slice("k", F.lit(1), prefix.cast("int")).alias("k"))
    return rare.join(sets.select("id", "map"), "id").select(F.explode("k").alias("x"), "id", "n", "map").select(F.col("x.bucket").alias("bucket"), "id", "n", "map")


def _resolve(members: DataFrame, sets: DataFrame, comp: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(id, component) once all texts that share a bucket of ``members`` are in one component or compared."""
    compared = None
    hubs, turn = HUBS, 0
    while True:
        members = members.drop("comp").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        split = members.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c")).where("a <> b").select("bucket", "c")
        split, left = cut_measured(split, "open", n=F.coalesce(F.sum("c"), F.lit(0)))
        if not left["n"]:
            return comp
        members = cut(split_join(members, split.select("bucket"), split, left["n"]), "split")
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("rank"), "id", "n", "comp", "map")
        salt = F.pmod(F.xxhash64("id", F.lit(-1 - turn)), F.lit(hubs))
        chosen = members.groupBy("bucket", salt.alias("salt")).agg(F.min(order).alias("hub"))
        chosen = chosen.select("bucket", *[F.col(f"hub.{c}").alias("hub" if c == "id" else f"hub_{c}") for c in ("id", "n", "comp", "map")])
        # bits that only one map has are shingles that only one set has, and similar sets have few of those:
        # the join itself drops what differs too much, most of it by half of the bits
        most = (denominator - numerator) * (F.col("n") + F.col("hub_n"))
        differ = lambda words: sum((F.bit_count(F.col("map")[i].bitwiseXOR(F.col("hub_map")[i])) for i in words), F.lit(0))
        few = lambda words: (denominator + numerator) * differ(words) <= most
        possible = (F.col("comp") != F.col("hub_comp")) & few(range(MAP_WORDS // 2)) & few(range(MAP_WORDS))
        pairs = split_join(members, chosen, split, left["n"], hubs).where(possible).select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["u", "v"], "left_anti")
        judged, seen = cut_measured(_similar(pairs, sets, numerator, denominator), "judged", links=F.coalesce(F.sum(F.col("linked").cast("long")), F.lit(0)))
        if seen["links"]:
            comp = components(comp.select(F.col("id").alias("u"), F.col("component").alias("v")).union(judged.where("linked").select("u", "v")))
        compared = judged.select("u", "v") if compared is None else compared.union(judged.select("u", "v"))
        members = members.join(chosen.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti")
        hubs, turn = hubs * HUBS, turn + 1


def near_components(docs: DataFrame, reps: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(id, component) of the representatives that have links."""
    members, counts, total = bucket_members(reps, side_of(numerator, denominator))
    members = cut(members, "buckets")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    wanted = narrow(docs).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut(shingles(wanted), "sets")
    comp = components(_first_links(members, counts, total, sets, numerator, denominator))
    labelled = members.join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    split = labelled.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    open_ids = split_join(labelled, split, counts, total).select("id").distinct()
    rest = cut(_rare_shingles(sets.join(open_ids, "id", "left_semi"), numerator, denominator), "rare")
    return _resolve(rest, sets, comp, numerator, denominator)


def dedup(docs: DataFrame, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): linked where denominator * intersection >= numerator * union.

    component_id is the smallest doc_id reachable; kept is true for that document.
    """
    same = ["n_shingles", "set_a", "set_b"]
    all_docs = cut(sketches(docs, side_of(numerator, denominator)), "sketches")
    whole = all_docs.where("n_shingles > 0 and doc_id is not null")
    reps = whole.groupBy(*same).agg(F.min(F.struct("doc_id", "keys")).alias("r")).select(*same, "r.doc_id", "r.keys")
    reps = cut(reps.dropDuplicates(["doc_id"]), "reps")
    near = near_components(docs, reps, numerator, denominator)
    classes = reps.join(near.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(*same, F.coalesce("component", "doc_id").alias("component"))
    labelled = all_docs.select("doc_id", *same).join(classes, same, "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE
    WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
one AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, v FROM reach JOIN both_ways ON u = r),
least_id AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least_id USING (doc_id)
"""
