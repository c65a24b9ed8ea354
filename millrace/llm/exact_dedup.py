"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

``DigestIndex`` is a folder of tables of (digest, keep_id, group_size, batch), each clustered
into buckets by digest and sorted in each. New rows are reduced to digests (texts are never
shuffled), pre-aggregated per digest, so a group that holds a third of all rows shuffles
as one row a task, and matched by a sort-merge anti-join with each table, whose side needs
no exchange. Digests not found are appended as one more table; a batch that is written
again under its name replaces itself, so a retried job leaves the index the same. An index
opened at a path that holds one goes on with what is recorded there. ``compact`` rewrites
all tables as one; until its table is complete, the old ones count.

Defined results: null text counts as empty; all empty texts are equal. Within a batch the
row with the largest id stays (null ids come last, and stay only among themselves); a text
that the index already holds keeps the id recorded there. Rows that repeat an id and a text
are copies of each other like any others. An empty batch changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import all_of, fresh_path, lower_az, materialise, unlike

#: Buckets of a table at least, and digests of a bucket at most (up to the next power of two).
BUCKETS = 32
BUCKET = 4_000_000
_ENTRY = "digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING"


def digest_of(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with A-Z lower-cased, in UTF-8."""
    return F.sha2(lower_az(text).cast("binary"), 256)


class DigestIndex:
    """A digest index below ``path`` in a shared store; what earlier sessions recorded there is read.

    Folders are named generation.batch.buckets. A complete table of a later generation replaces those before."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = (path or fresh_path(spark, "digest-index")).rstrip("/")
        self._folders = self._stored()

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _stored(self) -> list[str]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory())
        whole = [x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        last = max((int(x.split(".")[0]) for x in whole if x.split(".")[1] == ""), default=0)
        return [x for x in whole if int(x.split(".")[0]) >= last]

    @property
    def _generation(self) -> int:
        return max((int(x.split(".")[0]) for x in self._folders), default=0)

    def _table(self, folder: str) -> str:
        """The table over a folder, registered in this session's catalog if it isn't yet."""
        name = f"digest_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{folder}').hex}"
        if not self.spark.catalog.tableExists(name):
            n = folder.rsplit(".", 1)[1]
            self.spark.sql(f"CREATE TABLE {name} ({_ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{self.path}/{folder}'")
        return name

    def _write(self, entries: DataFrame, folder: str) -> None:
        n = int(folder.rsplit(".", 1)[1])
        name = f"digest_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{folder}').hex}"
        rows = entries.select("digest", "keep_id", "group_size", "batch").repartition(n, "digest")
        rows.write.bucketBy(n, "digest").sortBy("digest").option("path", f"{self.path}/{folder}").mode("overwrite").saveAsTable(name)

    def _sized(self, rows: int) -> int:
        n = self.buckets
        while n * BUCKET < rows:
            n *= 2
        return n

    def tables(self) -> list[DataFrame]:
        """One bucketed, sorted table a batch, or for all batches up to the last ``compact``."""
        return [self.spark.table(self._table(x)) for x in self._folders]

    def entries(self) -> DataFrame:
        """(digest, keep_id, group_size, batch) of every digest; group_size counts the rows of that batch."""
        out = self.spark.createDataFrame([], _ENTRY)
        for t in self.tables():
            out = out.unionByName(t)
        return out

    def append(self, groups: DataFrame, batch: str) -> None:
        """Record those of the groups (digest, keep_id, group_size; one row a digest) that the index lacks."""
        if not batch or "." in batch or "/" in batch:
            raise ValueError("a batch needs a name without dots and slashes")
        own = next((x for x in self._folders if x.split(".")[1] == batch), None)
        for folder in self._folders:
            if folder != own:
                known = self.spark.table(self._table(folder))
                groups = groups.join(known.select("digest").hint("merge"), "digest", "left_anti")
        own = own or f"{self._generation}.{batch}.{self._sized(groups.count())}"
        self._write(groups.withColumn("batch", F.lit(batch)), own)
        if own not in self._folders:
            self._folders.append(own)

    def compact(self) -> None:
        """Rewrite the index as one table, and remove the others."""
        old, entries = self._folders, self.entries()
        new = f"{self._generation + 1}..{self._sized(entries.count())}"
        self._write(entries, new)
        self._folders = [new]
        path, fs = self._fs()
        for folder in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(folder)}")
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"), True)


def grouped(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, digest) to one row a digest."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _result(rows: DataFrame, found: DataFrame) -> DataFrame:
    # The rows' side may be skewed (copies); the other side has one row a digest, so AQE can split the former.
    out = rows.join(found.hint("merge"), "digest")
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "b0", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a batch to the index. One row a document: id, keep_id, group_size, kept, text_sha256.

    group_size counts the batch's rows, and those of the batch that recorded the digest."""
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "digests")
    groups = materialise(grouped(rows), "digest-groups")
    index.append(groups, batch)
    sizes = groups.select("digest", F.col("group_size").alias("more"))
    found = index.entries().join(sizes, "digest")
    is_new = F.col("batch") == batch
    size = F.when(is_new, F.col("more")).otherwise(F.col("group_size") + F.col("more"))
    return _result(rows, found.select("digest", "keep_id", size.alias("group_size"), is_new.alias("is_new")))


def _indexed(rows: DataFrame, index: DigestIndex, batches: int) -> None:
    """Rows (doc_id, digest) to an empty index, in batches of descending ids, so that the first row recorded of a text
    is that of its largest id. Null ids come with the least. Each batch meets the index through the anti-join."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = 0 if low is None else (high - low) // batches + 1
    place = F.lit(batches - 1) if low is None else F.coalesce(((F.lit(high) - F.col("doc_id")) / F.lit(width)).cast("int"), F.lit(batches - 1))
    for i in range(batches):
        index.append(grouped(rows.where(F.least(place, F.lit(batches - 1)) == i)), f"part{i}")


def deduplicate_table(docs: DataFrame, index: DigestIndex, *, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of a table through an empty index, in batches. One row a document, as of ``deduplicate``: the row with
    the largest id of the whole table stays, and group_size counts the whole table."""
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "digests")
    _indexed(rows, index, batches)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n"))
    found = index.entries().join(sizes, "digest").select("digest", "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("is_new"))
    return _result(rows, found)


def kept_documents(docs: DataFrame, *, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one for each distinct text, that of the largest id."""
    index = DigestIndex(docs.sparkSession)
    digest, keep = unlike(docs, "__digest", "__keep_id")
    _indexed(materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), "digests"), index, batches)
    stored = index.entries().select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    tagged = docs.withColumns({digest: digest_of(F.col(text_col)), keep: F.col(id_col).cast("long")})
    same = (tagged[digest] == stored[digest]) & tagged[keep].eqNullSafe(stored[keep])
    return tagged.join(stored, same, "left_semi").dropDuplicates([digest, keep]).select(*all_of(docs))
