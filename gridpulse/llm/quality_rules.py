"""Host-level quality rules.

Rules judge documents; their failures are counted by host, each host's rate
is shrunk towards an empirical beta prior over all hosts, and hosts whose
shrunken rate is too high are rejected with all their documents. A
document's host is its ``source``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.llm._stage import stage
from gridpulse.llm._stats import free_name, with_counts

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words
#: A host goes when its shrunken failure rate is above this; most of its documents then fail.
HOST_RATE = 0.75


def base_failed(count: Column) -> Column:
    return (count["n_words"] < LEAST_WORDS) | (100 * count["n_repeat_words"] > MOST_REPEATED * count["n_words"])


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate) from rows (host, failed boolean); rows without host are in none.

    The prior is the beta distribution with the mean and variance of the
    hosts' rates, each host counted by its documents; where hosts do not
    differ more than chance would have it, the prior weighs as much as all
    documents and every rate becomes the mean.
    """
    hosts = stage(
        rows.where("host is not null").groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")),
        "hosts",
    )
    own = F.col("failed") / F.col("n")
    total = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"),
        F.sum(F.col("n") * own * own).alias("squares"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    alpha = beta = 0.0
    if total["n"]:
        mean = total["failed"] / total["n"]
        spread = total["squares"] - total["n"] * mean * mean
        within = total["hosts"] * mean * (1 - mean)
        # between-host variance by moments (a one-way random-effects estimate)
        scale = total["n"] - total["nn"] / total["n"]
        between = (spread - within + mean * (1 - mean)) / scale if scale > 0 else 0.0
        weight = mean * (1 - mean) / between - 1 if between > 0 else float(total["n"])
        weight = min(max(weight, 1.0), float(total["n"]))
        alpha, beta = mean * weight, (1 - mean) * weight
    return hosts.withColumn("rate", (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))


def judged(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept.

    A null or wordless text has counts of 0 and fails for want of words.
    Documents without source are in no host and judged by the base rules
    alone. Repeated rows count as often as they stand. Columns other than
    doc_id, text and source are not read. An empty table gives no rows.
    """
    counted = with_counts(documents, "count", ["doc_id", "source"])
    c = F.col("count")
    rows = stage(
        counted.select(
            "doc_id", F.col("source").alias("host"),
            *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            base_failed(c).alias("base_failed"),
        ),
        "rules",
    )
    rejected = stage(rejected_hosts(rows.select("host", F.col("base_failed").alias("failed"))), "hosts")
    return (
        rows.join(broadcast_if_small(rejected.withColumn("gone", F.lit(True))), "host", "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("gone").isNull())
        .drop("host", "gone")
    )


def rejected_hosts(rows: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """(host) of hosts above the rate, from rows (host, failed)."""
    return host_rates(rows).where(F.col("rate") > most).select("host")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that pass their own rules and whose host does; no text is shuffled
    unless the rejected hosts are too many to broadcast."""
    name = free_name(documents, "corpus_counts")
    counted = with_counts(documents, name, documents.columns)
    rows = with_counts(documents, name, ["source"]).select(F.col("source").alias("host"), base_failed(F.col(name)).alias("failed"))
    gone = stage(rejected_hosts(rows), "hosts")
    passed = counted.where(~base_failed(F.col(name))).drop(name)
    if gone.isEmpty():
        return passed
    held = broadcast_if_small(gone.select(F.col("host").alias(free_name(documents, "corpus_host"))))
    return passed.join(held, passed["source"] == held[held.columns[0]], "left_anti")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORD = r"[^\x20\x09-\x0D]+"

#: The counts and verdicts from the definitions: words and windows unnested, moments of host rates as in ``host_rates``.
ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
windows AS (
  SELECT k, i, words[i : i + 2] AS w FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY k),
lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY k),
counted AS (
  SELECT k, doc_id, host, len(words) AS n_words, length(regexp_replace(text, '[ 	-]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (k) LEFT JOIN covered USING (k)),
judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM judged WHERE host IS NOT NULL GROUP BY host),
moments AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS hosts, sum(n * (f / n) * (f / n)) AS squares, sum(n * n) AS nn FROM hosts),
between_hosts AS (
  SELECT n, m, CASE WHEN n - nn / n > 0 THEN (squares - n * m * m - hosts * m * (1 - m) + m * (1 - m)) / (n - nn / n) ELSE 0 END AS b
  FROM moments),
prior AS (
  SELECT m, least(greatest(CASE WHEN b > 0 THEN m * (1 - m) / b - 1 ELSE n END, 1.0), n) AS w FROM between_hosts),
gone AS (SELECT host FROM hosts, prior WHERE (f + m * w) / (hosts.n + w) > {HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM gone)) AS kept
FROM judged
"""
