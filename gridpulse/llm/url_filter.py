"""URL filter: rules by host and path, and a logistic regression for what no rule covers.

The regression works on hashed character n-grams of host and path. It is
trained on a small labelled table of urls, by default the urls that the
rules themselves judge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm._text import mix

#: (rule, verdict) of the registered query; fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled urls that the regression is fitted on, those with the smallest hash.
MOST_LABELLED = 4000
#: Rules are compiled into one expression; longer lists belong into a table that is joined by host.
MOST_RULES = 2000
GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
PENALTY = 1e-4
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _CAPITALS, _CAPITALS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule ``domain/prefix`` fits the domain and its subdomains when the
    path starts with ``/prefix``. Of equally long rules the first in order
    of code points wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = None
    for text, judged in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(judged)) if verdict is None else verdict.when(fits, F.lit(judged))
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of ``^host$`` and ``/path$``; host and path differ by a salt."""
    found = []
    for salt, text in ((1, f"^{host}$"), (2, f"{path}$")):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in GRAMS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, salt * 8 + n, np.uint64)
                for k in range(n):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C55) + codes[k : k + len(h)])
                found.append(h % np.uint64(BUCKETS))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def probability(self, features: list[np.ndarray]) -> np.ndarray:
        """Of the verdict block, for rows of buckets; each row has unit length."""
        sizes = np.array([len(f) for f in features])
        flat = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(features)), sizes)
        total = np.bincount(row, self.weights[flat], minlength=len(features)) / np.sqrt(np.maximum(sizes, 1))
        return 1 / (1 + np.exp(-(total + self.intercept)))


def fit(features: list[np.ndarray], blocked: np.ndarray, rounds: int = 150) -> Model:
    """Logistic regression by accelerated gradient steps; with one class or no rows its prior."""
    n = len(blocked)
    weights, intercept = np.zeros(BUCKETS), math.log((blocked.sum() + 1) / (n - blocked.sum() + 1))
    if n and 0 < blocked.sum() < n:
        sizes = np.array([max(len(f), 1) for f in features])
        flat = np.concatenate(features)
        row = np.repeat(np.arange(n), [len(f) for f in features])
        value = 1 / np.sqrt(sizes[row])
        ahead, w, t = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 1.0
        ahead[-1] = w[-1] = intercept
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(np.bincount(row, ahead[flat] * value, minlength=n) + ahead[-1])))
            slope = np.append(np.bincount(flat, ((p - blocked)[row]) * value, minlength=BUCKETS), (p - blocked).sum()) / n
            slope[:-1] += PENALTY * ahead[:-1]
            new, later = ahead - 2.0 * slope, (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / later * (new - w), new, later
        weights, intercept = w[:-1], float(w[-1])
    return Model(weights, intercept)


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` rows (host, path, verdict), those with the smallest hash of host and path."""
    rows = labelled.where("verdict is not null").orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(most).collect()
    return fit([grams(r["host"], r["path"]) for r in rows], np.array([r["verdict"] == "block" for r in rows], float))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
        p = model.probability([grams(h, x) for h, x in pairs])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "block_score"])


def judged(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    ``labelled`` has the columns url and verdict (block, allow or null);
    without it the urls that a rule covers are the labelled table. The
    verdict is the rule's, else block where the regression gives 0.5 or
    more. A null url, or one without ``://``, has an empty host and path,
    fits no rule and is judged by the regression. Repeated rows are judged
    each. Columns other than page_id and url are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if labelled is None:
        known = split.select("host", "path", verdict.alias("verdict")).distinct()
    else:
        known = labelled.select(host.alias("host"), path.alias("path"), "verdict").distinct()
    model = train(known)
    kind = dict(pages.dtypes)["page_id"]
    scored = split.mapInArrow(lambda it: _predict(it, model), f"page_id {kind}, host string, path string, block_score double")
    guess = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "block_score"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
