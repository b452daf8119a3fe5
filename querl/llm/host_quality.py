"""Host-level quality rules, with DataFrame functions only.

Document rules give counts and ``base_failed``. Failures are aggregated by host (``source``). Host
rates are shrunk by a beta prior fitted to all hosts by the method of moments: alpha + beta is
m(1-m)/b - 1, where m is the overall rate and b the variance between hosts (the weighted variance of
the rates less what sampling explains), held within [1, 1e6]. A host whose shrunk rate exceeds
``max_rate`` is rejected, and the verdict is joined back to its documents.

A word is a maximal run of characters other than 0x20 and 0x09-0x0D. Repeated three-word windows are
found by sorting (hash, position) pairs within the row, so no words leave it.

Defined results: a null text has no words and no characters; a null source is a host of its own;
every row is kept as a row, repeated or with a null doc_id or not, and counts for its host; texts of any
length are judged whole, within their row; hosts of equal rates get equal verdicts; an empty table gives
an empty result; columns other than doc_id, text and source are not read.

Hosts whose failures are as many as sampling explains are all shrunk to the overall rate, so where
failures are spread evenly over hosts no host is rejected and only the documents' own rules count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querl.llm.common import cut

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.6
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\u000b\f\r "
WORD = "[^\\x20\\x09-\\x0D]+"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""
    windows = F.when(F.size(words) < 3, F.expr("cast(array() as array<struct<h: bigint, p: int>>)")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("p"))))
    )

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        is_one = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(s, is_one), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    return _let(_let(windows, repeated), covered)


def document_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = own.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_rates(ruled: DataFrame) -> DataFrame:
    """(host, n, failed, rate): each host's failure rate, shrunk by the fitted prior."""
    hosts = ruled.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("failed"))
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum("failed").alias("fails"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"))
    r = sums.first()  # one row of totals
    if not r["docs"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = r["fails"] / r["docs"]
    spread = mean * (1 - mean)
    between = r["squares"] / r["docs"] - mean * mean - r["hosts"] * spread / r["docs"]
    strength = max(1.0, min(1e6, spread / between - 1)) if between > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The document rules with kept: neither the document nor its host fails."""
    ruled = cut(document_rules(docs), "rules")
    rejected = host_rates(ruled).where(F.col("rate") > max_rate).select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    joined = ruled.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    kept = ~F.col("base_failed") & F.col("bad").isNull()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
k AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, * FROM d),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM k),
win AS (SELECT k, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'p': i, 't': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) AS x FROM w WHERE len(ws) >= 3),
tri AS (SELECT k, x.p AS p, count(*) OVER (PARTITION BY k, x.t) AS c FROM win),
cov AS (SELECT DISTINCT k, p + o AS p FROM tri, (VALUES (0), (1), (2)) AS t(o) WHERE c > 1),
rep AS (SELECT k, count(*) AS n FROM cov GROUP BY k),
line AS (SELECT k, unnest(string_split(text, chr(10))) AS x FROM k),
dup AS (SELECT k, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k),
r AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM k JOIN w USING (k) LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS failed FROM f GROUP BY host),
s AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(failed) / sum(n) AS m, sum(failed * failed / n) AS squares FROM h),
b AS (SELECT m, m * (1 - m) AS spread, squares / docs - m * m - hosts * (m * (1 - m)) / docs AS between_hosts FROM s),
q AS (SELECT m, CASE WHEN between_hosts > 0 THEN greatest(1.0::DOUBLE, least(1e6::DOUBLE, spread / between_hosts - 1)) ELSE 1e6::DOUBLE END AS strength FROM b),
v AS (SELECT host, (failed + m * strength) / (n + strength) > 0.6 AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
