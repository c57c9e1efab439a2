"""Line-level deduplication with levelled sorted runs of line hashes. DataFrame functions only.

A line's key is the line without the white space [\\x20\\x09-\\x0D] at its ends, A-Z in lower case; keys below `least` code points never
count. Documents (rows) come in batches, those with the largest ids first. The index holds runs: tables of (hash, documents, keeper),
bucketed and sorted by hash, so that joins between them are merges without a shuffle.

* A batch's lines are summed to one row a hash. A merge anti-join with every run finds the hashes that no earlier batch had: their
  keeper is the batch's largest id, and as ids only fall from batch to batch it stays the largest. They and the counts of the hashes
  that are known already become the batch's own run, at level 0.
* When a level has `fan` runs they are merged into one of the next level, so there are few runs to join with and a hash is rewritten
  once a level. The last merge gives every hash its documents and its keeper.
* Lines whose hash has at least `documents` documents go, except in documents with the keeper's id.

Hashes are 128 bits of SHA-256. Counting needs one row a document and hash, summed before the shuffle, so a line that every document
has costs a row a task; the join of lines with the hashes to drop is a plain one whose large keys adaptive plans split.

Odd rows: a null or empty text is one empty line. Rows count as documents even if they share an id, and all rows with the keeper's id
keep the line. A null id is smaller than any other: it keeps a line only where all holders have null ids. Texts and lines of any
length are read whole. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, shared_dir, table

LEAST, DOCUMENTS, BATCHES, FAN = 20, 3, 4, 2
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(32))


def line_hashes(text: Column, least: int = LEAST) -> Column:
    """For each line its hash as 32 hexadecimal digits, or null where the key is too short."""
    key = F.transform(_lines(text), line_key)
    return F.transform(key, lambda k: F.when(F.char_length(k) >= least, _digest(k)))


class Runs:
    """The index. add() takes a batch's (h, n, top); merged() gives (h, n, keeper) of all."""

    def __init__(self, spark, fan: int = FAN):
        self.spark, self.fan, self.levels, self.names = spark, fan, {}, {}
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _run(self, df: DataFrame) -> DataFrame:
        name, path = f"tidebar_run_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        self.names[name] = path
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name).select("h", "n", "keeper")

    def add(self, batch: DataFrame) -> None:
        own = self._run(batch.withColumnRenamed("top", "keeper"))
        if self.runs():
            fresh = own.select("h", "keeper")
            for run in self.runs():
                fresh = fresh.join(run.select("h").hint("merge"), "h", "left_anti")
            own = self._run(own.drop("keeper").join(fresh.hint("merge"), "h", "left").select("h", "n", "keeper"))
        self.levels.setdefault(0, []).append(own)
        level = 0
        while len(self.levels[level]) >= self.fan:
            self.levels.setdefault(level + 1, []).append(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, two at a time. Outer merge joins and no union: over bucketed tables Spark 4.1 takes a union for
        partitioned by their key and sums some keys in two places (spark.sql.unionOutputPartitioning)."""
        one, *rest = runs
        for other in rest:
            b = other.select(F.col("h").alias("_h"), F.col("n").alias("_n"), F.col("keeper").alias("_keeper")).hint("merge")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            one = self._run(one.join(b, F.col("h") == F.col("_h"), "full_outer").select(F.coalesce("h", "_h").alias("h"), n.alias("n"), F.greatest("keeper", "_keeper").alias("keeper")))
        return one

    def runs(self) -> list[DataFrame]:
        return [r for _, level in sorted(self.levels.items()) for r in level]

    def merged(self) -> DataFrame | None:
        return self._merged(self.runs()) if self.runs() else None

    def close(self) -> None:
        for name, path in self.names.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)


def repeated_lines(hashes: DataFrame, batches: int = BATCHES, documents: int = DOCUMENTS, fan: int = FAN) -> DataFrame:
    """(h, keeper) of the hashes in at least so many documents, from rows (doc_id, hs): an array of the lines' hashes a document."""
    spark = hashes.sparkSession
    cuts = hashes.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    # number of the cuts above the id: 0 has the largest ids, null ids come last
    batch = F.coalesce(sum((F.when(F.col("doc_id") < int(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)), F.lit(len(set(cuts))))
    each = hashes.select("doc_id", batch.cast("int").alias("batch"), F.explode(F.array_distinct(F.filter("hs", lambda h: h.isNotNull()))).alias("h"))
    sums = cut(each.groupBy("batch", F.unhex("h").alias("h")).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")), "batch")
    runs = Runs(spark, fan)
    try:
        for b in range(len(set(cuts)) + 1):
            runs.add(sums.where(F.col("batch") == b).select("h", "n", "top"))
        return cut(runs.merged().where(F.col("n") >= documents).select("h", "keeper"))
    finally:
        runs.close()


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, documents: int = DOCUMENTS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """docs with the columns _lines (before), _dropped and _kept (the text that stays)."""
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    # a document is found again by its id and 128 bits of its text's digest; rows that share both have the same result
    hashes = cut(docs.select(ident.alias("doc_id"), _digest(F.coalesce(text, F.lit(""))).alias("d"), line_hashes(text, least).alias("hs")))
    gone = repeated_lines(hashes.select("doc_id", "hs"), batches, documents, fan).withColumnRenamed("h", "_h")
    lines = hashes.select("doc_id", "d", F.posexplode("hs").alias("at", "h")).where("h IS NOT NULL").withColumn("h", F.unhex("h"))
    other = F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    drop = lines.join(gone, F.col("h") == F.col("_h")).where(other).groupBy("doc_id", "d").agg(F.collect_set("at").alias("_at"))
    drop = drop.select(F.col("doc_id").alias("_id"), F.col("d").alias("_d"), "_at")
    rows = docs.withColumns({"_own_id": ident, "_own_d": _digest(F.coalesce(text, F.lit("")))})
    rows = rows.join(drop, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_d") == F.col("_d")), "left")
    every, none = _lines(F.col(text_col)), F.array().cast("array<int>")
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.coalesce("_at", none))
    # an array of one binds the lines to a name: inside the inner function they would be split anew for each of them
    joined = F.get(F.transform(F.array(every), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), 0)
    kept = F.when(F.col("_at").isNull(), F.coalesce(text, F.lit(""))).otherwise(joined)
    return rows.select(*docs.columns, F.size(every).cast("long").alias("_lines"), F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("_dropped"), kept.alias("_kept"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT rid) >= {DOCUMENTS}),
s AS (SELECT rid, pos, line, top IS NOT NULL AND (doc_id IS NULL OR doc_id < top) AS gone FROM k LEFT JOIN g USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s JOIN d USING (rid) GROUP BY rid
"""
