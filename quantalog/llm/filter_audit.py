"""How filters of documents interact in every order, from a stream that takes back what later files show to be wrong.

Four filters judge a text by itself; the fifth fails a document whose text stands under a smaller id anywhere in the table. The
table's files are read as a stream of available-now micro-batches. State holds for each text (by its SHA-256) the smallest id so far
and the documents that have it; texts are kept by small buckets, so that a call of Python serves many of them, and the number of
buckets grows with the table. A document that meets a smaller id is counted as a copy at once; where a smaller id arrives later,
the counts of the documents that were first until then are taken back and they are counted as copies. What each batch adds to
and takes from the counters of (part, failed filters) is written under the batch's number, so a batch that runs again replaces
its own rows; the sum of all of them is the table's. All orders of the filters follow from the counters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantalog.llm.shared import shared_path, slices, written

NAMES = "ABCDE"
COPY = 1 << NAMES.index("E")
GOOD, TOXIC = 1, 2
#: What the combined rows of a text are: the smallest id of some rows, copies for certain, rows without an id.
FIRST, COPIES, NO_ID = 0, 1, 2
NO_CAPITALS, ODD = bytes(set(range(256)) - set(range(65, 91))), b"#$%&*|"
JUDGED = "id long, part string, digest binary, mask int"
COMBINED = "bucket long, digest binary, mask int, kind int, id long, part string, tag int, n long"
STATE = "digest array<binary>, mask array<int>, id array<long>, part array<string>, tag array<int>, n array<long>"
DELTAS = "part string, mask int, tag int, n long"
#: The table is read in about BATCHES batches, of LEAST_BATCH bytes at least.
BATCHES, LEAST_BATCH = 8, 32 << 20
#: A bucket of texts for so many bytes of the table, and LEAST_BUCKETS at least.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 200


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, part, text -> id, part, SHA-256 of the text, and a bit for each of the filters that judge a text by itself."""
    for batch in batches:
        for rows in slices(batch, 2):
            text = rows.column(2)
            points = pc.utf8_length(text).to_pylist()
            digests, masks = [], []
            for data, n in zip(text.cast(pa.binary()).to_pylist(), points, strict=True):
                words = data.split()  # at ASCII white space, as the filters' words are
                tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(data.translate(None, NO_CAPITALS)) > 10 * n, len(data.translate(None, ODD)) < len(data))
                masks.append(sum(1 << i for i, t in enumerate(tests) if t))
                digests.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])


def _flags(labels: DataFrame) -> DataFrame:
    """label_id, tag: one row for each id that has labels; of several rows any counts."""
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("tag"))


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for most texts of each slice of a task: so a text in very many documents doesn't reach its state row by row."""
    by = ["bucket", "digest", "mask", "kind", "id", "part", "tag"]
    for rows in batches:
        none = rows["id"].isna()
        later = rows["id"] > rows.groupby("digest")["id"].transform("min")
        kind = later.astype("int32").mask(none, NO_ID)
        rows = rows.assign(kind=kind, id=rows["id"].where(kind == FIRST))
        yield rows.groupby(by, dropna=False, sort=False).size().rename("n").reset_index()


def counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the rows of a bucket change: rows are added, and earlier first ones are taken back when a smaller id arrives."""
    rows = pd.concat(list(batches), ignore_index=True)  # a row for each text, slice and batch; hot texts were combined
    new = rows[rows["kind"] == FIRST].astype({"id": "int64"})
    columns = ["digest", "mask", "id", "part", "tag", "n"]
    known = pd.DataFrame(dict(zip(columns, state.getOption or [[]] * len(columns), strict=True))).astype({"id": "int64", "mask": "int32", "tag": "int32", "n": "int64"})
    both = pd.concat([known[columns], new[columns]], ignore_index=True)
    later = both["id"] > both.groupby("digest")["id"].transform("min")
    old = both.index < len(known)
    changed = lambda part, bits, sign: part.assign(mask=part["mask"] | bits, n=sign * part["n"])
    out = [
        changed(rows[rows["kind"] == NO_ID], 0, 1), changed(rows[rows["kind"] == COPIES], COPY, 1),
        changed(both[~old & ~later], 0, 1), changed(both[later], COPY, 1), changed(both[old & later], 0, -1),
    ]
    if len(new):
        first = both[~later].groupby(columns[:-1], as_index=False, sort=False)["n"].sum()
        state.update(tuple(first[c].tolist() for c in columns))
    yield pd.concat([x[["part", "mask", "tag", "n"]] for x in out]).groupby(["part", "mask", "tag"], as_index=False, sort=False)["n"].sum()


def counters(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents of the Parquet table at path by the filters that they fail."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    total = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    table = path.rstrip("/")
    exactly = f"{table[:-1]}[{table[-1]}]"  # a pattern: a table may be one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).options(maxBytesPerTrigger=batch_bytes or max(LEAST_BATCH, -(-total // BATCHES)), maxFileAge="100000d").parquet(exactly)
    empty = F.lit("")
    docs = stream.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", empty).alias("part"), F.coalesce("text", empty).alias("text")).mapInArrow(judged, JUDGED)
    flags = written(_flags(labels), "flags")
    key = F.coalesce("id", F.xxhash64("digest"))  # rows without an id don't meet in one task
    bucket = F.pmod(F.xxhash64("digest"), F.lit(max(LEAST_BUCKETS, total // BUCKET_BYTES)))
    labelled = docs.join(flags, (key == flags.label_id) & docs.id.isNotNull(), "left").select(bucket.alias("bucket"), "digest", "mask", "id", "part", F.coalesce("tag", F.lit(0)).alias("tag"))
    changes = labelled.mapInPandas(combined, COMBINED).groupBy("bucket").applyInPandasWithState(counted, DELTAS, STATE, "update", GroupStateTimeout.NoTimeout)
    at = shared_path(spark, "changes")

    def keep(batch: DataFrame, number: int) -> None:
        has = lambda bit: F.sum(F.when(F.col("tag").bitwiseAND(F.lit(bit)) > 0, F.col("n")).otherwise(0))
        batch.groupBy("part", "mask").agg(F.sum("n").alias("n"), has(GOOD).alias("good"), has(TOXIC).alias("toxic")).write.mode("overwrite").parquet(f"{at}/batch={number}")

    query = changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    fields = "part string, mask int, n bigint, good bigint, toxic bigint"
    parts = spark.read.schema(fields).parquet(f"{at}/batch=*") if any(p.numInputRows for p in query.recentProgress) else spark.createDataFrame([], fields)
    return parts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def in_all_orders(found: DataFrame) -> DataFrame:
    """found: part, mask, n, good, toxic. A row for each part, order of the filters and step, with what that step does."""
    steps = []
    for order in permutations(NAMES):
        bits = [1 << NAMES.index(c) for c in order]
        steps += [("".join(order), k + 1, bit, sum(bits[:k])) for k, bit in enumerate(bits)]
    literal = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, k, b, e in steps])
    rows = found.select("part", "mask", "n", "good", "toxic", F.explode(literal).alias("s")).select("*", "s.*")
    fails, gone, alone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0, F.col("mask") == F.col("bit")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(alone).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).drop("bit")


def interactions(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the Parquet table at path.

    The table has doc_id, text and lang; labels has doc_id, quality and toxic. Null text and lang count as empty. Rows that repeat an
    id are all counted and aren't each other's copies; a row without an id is no copy and makes none. Labels of several rows
    count if one of them says so. An empty table gives no rows; other columns are ignored.
    """
    return in_all_orders(written(counters(spark, path, labels, batch_bytes), "counters"))
