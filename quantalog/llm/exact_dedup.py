"""Exact deduplication with a log-structured merge index of text digests, in DataFrame operations only.

Flush: every task's rows are a memtable, written as one run file sorted by digest, with a Bloom filter and least and
greatest digest for each row group (Parquet's), so that a lookup of a few digests opens few row groups. Compaction:
runs are merged into one sorted run that has for each digest the row that stays and the number of rows. The merged run's
hits (digests of several rows) have a filter of their own, a bitmap that is sent to every task: a lookup probes it first, and
only rows that may be hits travel to meet the merged run; all others are alone for certain. Hits are verified byte by byte
against the text of the row that stays; should a digest ever stand for different texts, its rows are grouped again by the
texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.llm.shared import ascii_lower, removed, shared_path, written

#: A digest with at least total / HOT rows is joined by broadcast; there are at most HOT of them.
HOT = 1000
#: Rows of a group that are compared with one copy of its text.
GROUP_SLICE = 1000
#: Bits of the filter for each hit; a filter of MOST_BITS (32 MB) at most, and none where that is under 4 bits for each.
BITS_EACH, MOST_BITS, CELL_BITS = 16, 1 << 28, 1 << 15
FILTERED = {"parquet.bloom.filter.enabled#digest": "true"}


class MergeIndex:
    """Runs in the shared folder. keep: 'smallest' or 'largest' id of equal texts; digest_bytes: of SHA-256."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", digest_bytes: int = 32):
        if keep not in ("smallest", "largest"):
            raise ValueError(keep)
        self.spark, self.keep, self.digest_bytes = spark, keep, digest_bytes
        self.fresh: list[DataFrame] = []
        self.merged: DataFrame | None = None

    def order(self, id_col: Column, row: Column) -> Column:
        """Least for the row that stays among rows of the same text; null ids stay only among themselves."""
        return F.struct(id_col.isNull().alias("none"), (F.bitwise_not(id_col) if self.keep == "largest" else id_col).alias("rank"), row.alias("row"), id_col.alias("id"))

    def flush(self, rows: DataFrame) -> DataFrame:
        """rows: id, text (normalised). Writes a run for each memtable; the run's rows are digest, sha, id, row."""
        sha = rows.select("id", F.unhex(F.sha2("text", 256)).alias("sha"))
        run = sha.select(F.substring("sha", 1, self.digest_bytes).alias("digest"), "sha", "id", F.monotonically_increasing_id().alias("row"))
        run = written(run.sortWithinPartitions("digest"), "run", **FILTERED)
        self.fresh.append(run)
        return run

    def compact(self) -> DataFrame:
        """Merges all runs into one: digest, stays (struct), n."""
        parts = [r.groupBy("digest").agg(F.min(self.order(F.col("id"), F.col("row"))).alias("stays"), F.count("*").alias("n")) for r in self.fresh]
        if self.merged is not None:
            parts.append(self.merged)
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        if len(parts) > 1:
            every = every.groupBy("digest").agg(F.min("stays").alias("stays"), F.sum("n").alias("n"))
        self.merged, self.fresh = written(every.sortWithinPartitions("digest"), "run", **FILTERED), []
        return self.merged

    def hits(self) -> DataFrame:
        """digest, stays, n of the merged run's digests of several rows."""
        return self.merged.where("n > 1")

    def filter(self) -> tuple[DataFrame, int] | None:
        """(cell, bitmap) of the hits' filter and its number of bits; None where hits are too many for one."""
        number = self.hits().count()
        bits = min(MOST_BITS, max(CELL_BITS, 1 << (BITS_EACH * max(1, number) - 1).bit_length()))
        if number * 4 > bits:
            return None
        place = _place(F.col("digest"), bits)
        cells = self.hits().select(F.floor(place / CELL_BITS).alias("cell"), (place % CELL_BITS).alias("bit"))
        return cells.groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bitmap")), bits

    def probed(self, rows: DataFrame) -> DataFrame:
        """rows (with a digest) and the column maybe: false for those whose digest is no hit for certain."""
        if (found := self.filter()) is None:
            return rows.withColumn("maybe", F.lit(True))
        cells, bits = found
        place = _place(F.col("digest"), bits)
        marked = rows.withColumn("cell", F.floor(place / CELL_BITS)).join(F.broadcast(cells), "cell", "left")  # MOST_BITS at most
        bit = place % CELL_BITS
        byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return marked.withColumn("maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("cell", "bitmap")

    def lookup(self, run: DataFrame) -> DataFrame:
        """Every row of a run of the index with stays and n of its digest. Digests of very many rows don't travel to one task."""
        probed = self.probed(run)
        alone = probed.where(~F.col("maybe")).drop("maybe").withColumns({"stays": self.order(F.col("id"), F.col("row")), "n": F.lit(1).cast("bigint")})
        rows = probed.where("maybe").drop("maybe")
        total = run.count()
        hot = self.hits().where(F.col("n") >= max(2, total // HOT))
        if not total or hot.count() > HOT:
            return alone.unionByName(rows.join(self.merged, "digest").select(alone.columns))
        marked = rows.join(F.broadcast(hot.select("digest", F.col("stays").alias("hot_stays"), F.col("n").alias("hot_n"))), "digest", "left")
        cold = marked.where("hot_n is null").drop("hot_stays", "hot_n").join(self.merged, "digest").select(alone.columns)
        warm = marked.where("hot_n is not null").withColumnRenamed("hot_stays", "stays").withColumnRenamed("hot_n", "n").select(alone.columns)
        return alone.unionByName(cold).unionByName(warm)


def _place(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def _normal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _verified(members: DataFrame, rows: DataFrame, index: MergeIndex) -> DataFrame:
    """Digests of which some row's text differs from the text of the row that stays."""
    hits = members.where("n > 1").select("digest", "id", F.col("stays.id").alias("stays_id"), F.col("stays.row").alias("stays_row"), "row", "n")
    slices = F.ceil(F.col("n") / GROUP_SLICE).cast("int")
    # Rows that repeat an id and a text are compared once; the row that stays is known by its number.
    hits = hits.withColumn("stays_here", F.col("row") == F.col("stays_row")).groupBy("digest", "id", "n").agg(F.max("stays_here").alias("stays_here"))
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, index.digest_bytes)
    texts = index.probed(rows.select("id", "text", digest.alias("digest"))).where("maybe").drop("maybe")
    found = texts.join(hits, (texts.digest == hits.digest) & texts.id.eqNullSafe(hits.id)).select(texts.digest, "text", "stays_here", "n", texts.id)
    copies = found.where("stays_here").groupBy("digest", "n").agg(F.min("text").alias("kept_text"))
    copies = copies.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    others = found.select("digest", "text", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"))
    return others.join(copies, ["digest", "slice"]).where("text != kept_text").select("digest").distinct()


def exact_duplicates(df: DataFrame, keep: str = "smallest", digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: id, keep_id, group_size long, kept boolean, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the smallest
    (largest) id stays; one row of several that repeat that id; a row with a null id only where no row has an id. text_sha256
    is of the lower-cased text. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = _normal(df, id_col, text_col)
    index = MergeIndex(spark, keep, digest_bytes)
    run = index.flush(rows)
    index.compact()
    members = written(index.lookup(run), "members")
    bad = written(_verified(members, rows, index), "collisions", at := shared_path(spark, "collisions"))
    if bad.isEmpty():
        removed(spark, at)
    else:  # group the rows of these digests by whole text
        ids = members.join(bad, "digest", "left_semi").select("digest", "id", "row", "sha")
        texts = rows.select("id", "text", F.unhex(F.sha2("text", 256)).alias("sha"))
        texts = texts.join(ids, (texts.sha == ids.sha) & texts.id.eqNullSafe(ids.id), "left_semi").distinct()
        named = ids.join(texts, (texts.sha == ids.sha) & texts.id.eqNullSafe(ids.id)).select("digest", ids.id, "row", ids.sha, "text")
        groups = named.groupBy("text").agg(F.min(index.order(F.col("id"), F.col("row"))).alias("stays"), F.count("*").alias("n"))
        again = named.join(groups, "text").select(members.columns)
        members = members.join(bad, "digest", "left_anti").select(members.columns).unionByName(again)
    return members.select(
        F.col("id").alias(id_col),
        F.col("stays.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("stays.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
