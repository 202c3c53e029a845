"""Token totals kept up to date by signed changes, in batches that can be committed again without effect."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import small_batches
from resight.llm.tokens import load_encoder

GROUP = ("source", "lang", "tokenizer")
AMOUNTS = ("docs", "tokens", "bytes")


def count_tokens(df: DataFrame, versions: dict[str, str], pattern: str, text_col: str = "text") -> DataFrame:
    """`df` without its text, with `bytes`, `text_key` and one count `tokens_<version>` per vocabulary, over whole texts.

    A null text counts as empty: no tokens and no bytes. Repeated rows and equal texts are each counted; nulls in other
    columns pass through. An empty table gives an empty one. Columns of `df` with one of the new names are replaced.
    """
    made = ["bytes", "text_key", *(f"tokens_{v}" for v in versions)]
    raw = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in df.columns if c != text_col and c not in made]
    slim = df.select(*kept, raw.alias("_text"), F.octet_length(raw).cast("long").alias("bytes"),
                     F.unhex(F.sha2(raw, 256)).alias("text_key"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            rest = [n for n in batch.schema.names if n != "_text"]
            counts = [pa.array([len(load_encoder(path, pattern).encode_ordinary(t)) for t in texts], pa.int64())
                      for path in versions.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *counts],
                                             names=[*rest, *(f"tokens_{v}" for v in versions)])

    return slim.mapInArrow(work, ", ".join(fields + [f"tokens_{v} bigint" for v in versions]))


def inserted(rows: DataFrame) -> DataFrame:
    """Changes that add rows (GROUP columns, tokens, bytes)."""
    return rows.select(*GROUP, F.lit(1).cast("long").alias("docs"), "tokens", "bytes")


def deleted(rows: DataFrame) -> DataFrame:
    """Changes that take rows back, as they were counted."""
    return rows.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"),
                       (-F.col("bytes")).alias("bytes"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace earlier counts of rows by later ones, under the same or another tokenizer version."""
    return deleted(before).unionAll(inserted(after))


class Rollup:
    """Totals under a shared folder.

    A batch is summed by group (partial sums first, so one source may hold any share of the rows) and written as a table
    of its own; a one-row ledger entry then names it. Totals read the tables that the ledger names, so a batch that was
    broken off counts for nothing and a batch committed again for nothing more. One writer at a time.

    After every `compact_after` batches the totals are written as one table, under a new generation of the ledger: one
    entry for that table, and the names of all batches so far, which stay so that they have no effect when sent again.
    The newest generation that was written to its end counts. Only entries with a table, at most `compact_after` and
    one, come to the driver; names are looked up by a filter. Null batch names are refused; null groups are groups.
    """

    def __init__(self, spark: SparkSession, folder: str, compact_after: int = 64):
        self.spark, self.folder, self.compact_after = spark, folder.rstrip("/"), compact_after

    def generation(self) -> int:
        """The newest complete generation of the ledger; 0 before the first compaction."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger/*/start/_SUCCESS")
        found = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        return max((int(f.getPath().getParent().getParent().getName()) for f in found or ()), default=0)

    def ledger(self) -> DataFrame:
        """batch, place: committed batches; the place is null once a batch is part of a compacted table."""
        schema, place = "batch string, place string", f"{self.folder}/ledger/{self.generation()}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(place)

    def places(self) -> list[str]:
        """The tables that make up the totals."""
        return sorted(r["place"] for r in self.ledger().where("place IS NOT NULL").collect())

    def compact(self) -> None:
        """Write the totals as one table and begin a new generation of the ledger; broken off, it changes nothing."""
        ledger, place = self.ledger(), f"{self.folder}/batches/{uuid.uuid4().hex}"
        self.totals().write.parquet(place)
        entry = self.spark.createDataFrame([(None, place)], "batch string, place string")
        names = ledger.where("batch IS NOT NULL").select("batch", F.lit(None).cast("string").alias("place"))
        names.unionAll(entry).write.mode("overwrite").parquet(f"{self.folder}/ledger/{self.generation() + 1}/start")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and no effect, if this batch was committed before."""
        if batch is None:
            raise ValueError("a batch needs a name")
        if not self.ledger().where(F.col("batch") == batch).isEmpty():
            return False
        if len(self.places()) >= self.compact_after:
            self.compact()
        place = f"{self.folder}/batches/{uuid.uuid4().hex}"
        sums = changes.groupBy(*GROUP).agg(*(F.coalesce(F.sum(a), F.lit(0)).cast("long").alias(a) for a in AMOUNTS))
        sums.write.parquet(place)
        entry = self.spark.createDataFrame([(batch, place)], "batch string, place string")
        entry.coalesce(1).write.parquet(f"{self.folder}/ledger/{self.generation()}/{uuid.uuid4().hex}")
        return True

    def totals(self) -> DataFrame:
        """GROUP columns and AMOUNTS over all committed batches; groups that fell back to nothing are left out."""
        places = self.places()
        schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint, bytes bigint"
        if not places:
            return self.spark.createDataFrame([], schema)
        sums = self.spark.read.schema(schema).parquet(*places).groupBy(*GROUP).agg(
            *(F.sum(a).cast("long").alias(a) for a in AMOUNTS))
        return sums.where(" OR ".join(f"{a} != 0" for a in AMOUNTS))


def repeated_texts(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `counted` whose text another row of a smaller id has."""
    first = counted.groupBy("text_key").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = first.select(F.col("text_key").alias("_key"), F.col("_first").alias("_first"))
    same = (counted["text_key"] == first["_key"]) & (counted[id_col] > first["_first"])
    return counted.join(first, same).drop(first["_key"], first["_first"])
