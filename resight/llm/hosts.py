"""Quality rules judged by document and by host.

Every document is measured by rules; the failures of a host are summed, its failure rate is shrunk towards the rate of
all hosts by a beta prior fitted to the hosts themselves, and the verdict on the host goes back to its documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import WORD_PATTERN, small_batches
from resight.session import cut

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is refused if its shrunk failure rate is above this: most of what it serves fails.
    max_host_rate: float = 0.5


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    kinds = len(number)
    if kinds == n:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:  # three ids no longer fit one integer
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * kinds + ids[2:]
    order = np.sort(window)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not twice.size:
        return 0
    at = twice[np.minimum(np.searchsorted(twice, window), twice.size - 1)] == window
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= at
    covered[1:-1] |= at
    covered[2:] |= at
    return int(covered.sum())


def repeated_lines(text: str, space: "re.Pattern") -> int:
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    full = [line for line in lines if not space.fullmatch(line)]
    return len(full) - len(set(full))


def measure(batch: pa.RecordBatch) -> list[pa.Array]:
    find, space = re.compile(WORD_PATTERN).findall, re.compile(r"[\x20\x09-\x0D]*")
    column = batch.column("text")
    symbols = pa.compute.count_substring_regex(column, pattern=f"[{re.escape(SYMBOLS)}]")
    rows = []
    for text in column.to_pylist():
        words = find(text)
        rows.append((len(words), sum(map(len, words)), repeated_lines(text, space), repeated_words(words)))
    n_words, chars, lines, repeats = zip(*rows)
    return [pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()), symbols.cast(pa.int64()),
            pa.array(lines, pa.int64()), pa.array(repeats, pa.int64())]


def document_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`id_col`, host and the five measures of every whole text; a null text has no words, lines or symbols."""
    slim = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *measure(batch)],
                                             names=["id", "host", *MEASURES])

    return slim.mapInArrow(work, f"id {kinds['id']}, host {kinds['host']}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def base_failed(rules: HostRules):
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def host_verdicts(spark: SparkSession, judged: DataFrame, rules: HostRules) -> DataFrame:
    """host, docs, failures, rate (shrunk), refused: one row per host, from `judged` (host, base_failed).

    The prior is fitted by moments over hosts weighted by their documents. With mean rate m, the variance of the rates
    less what chance alone gives hosts of one rate, m(1-m) * hosts / documents, is v; the prior's strength is
    m(1-m)/v - 1, at least 1 and at most 1e6 (hosts that differ no more than by chance).
    """
    hosts = cut(judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures")), "hosts")
    count, docs, failures, squares = hosts.agg(
        F.count(F.lit(1)), F.sum("docs"), F.sum("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("docs"))).first()
    mean = failures / docs if docs else 0.0
    spread = squares / docs - mean * mean - mean * (1 - mean) * count / docs if docs else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 1e-12 else 1e6
    rate = (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("refused", F.col("rate") > rules.max_host_rate)


def judge_documents(
    df: DataFrame, rules: HostRules = HostRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """One row per input row: `id_col`, host, host_rate, the measures, base_failed, kept.

    A document is kept if it passes the rules and its host is not refused. A null text counts as empty and fails. A
    document without a host is judged by the rules alone (host_rate null). Repeated rows are judged and counted as
    often as they stand; an empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    judged = cut(document_measures(df, id_col, text_col, host_col).withColumn("base_failed", base_failed(rules)), "measures")
    hosts = host_verdicts(spark, judged, rules).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "refused")
    out = judged.join(hosts, judged["host"] == hosts["_host"], "left")
    return out.select(F.col("id").alias(id_col), "host", "host_rate", *MEASURES, "base_failed",
                      (~F.col("base_failed") & ~F.coalesce(F.col("refused"), F.lit(False))).alias("kept"))


def keep_documents(df: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """The rows of `df` that are kept, as they came: for a filtering stage. The host is the column `source`.

    Nulls, empty texts and repeated rows are judged as by `judge_documents`: a null or empty text fails, a document
    without a source is judged by the rules alone, and ties and repeated rows stay or go together. An empty table gives
    an empty one. Other columns pass through.

    Measures every document twice in place of carrying texts through a shuffle: once to judge the hosts, once to filter.
    """
    judged = cut(document_measures(df).withColumn("base_failed", base_failed(rules)), "measures")
    hosts = host_verdicts(df.sparkSession, judged, rules).where("refused").select(F.col("host").alias("_host"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            text = pa.compute.fill_null(batch.column("text"), "")
            n_words, _, _, _, repeats = (a.to_numpy() for a in measure(pa.RecordBatch.from_arrays([text], names=["text"])))
            bad = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
            yield batch.filter(pa.array(~bad))

    return df.mapInArrow(work, df.schema).join(hosts, F.col("source") == hosts["_host"], "left_anti")
