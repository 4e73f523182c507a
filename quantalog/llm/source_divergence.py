"""How the sources of a language differ in their words, in exact whole numbers.

A CountVectorizer with a least document frequency and no bound on its vocabulary makes a sparse vector of every document. Its
terms are qualified by their language, so that one fit is a fit for each language: a term is counted in the documents of its
language only. The vectors' entries are summed up by source (a sparse sum, in whole numbers), and pairs of sources are compared
at the terms that both have, all other terms by what each source has of them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.llm.shared import binary_array, shared_path, slices, written
from quantalog.operators.numbering import BROADCAST_ROWS, placed

#: Terms are runs of ASCII letters, lower-cased, and of bytes beyond ASCII; all other bytes are spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Between a term, which never holds it, and its language.
MARK = "\x00"
VOCABULARY = (1 << 31) - 1
#: How a sparse vector lies in a Parquet file.
STORED = "grp bigint, vector struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
SCALE, SMOOTH = 1_000_000_000, 5


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def qualified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, lang, text -> group, and the text's terms, each with MARK and the language behind it."""
    kinds = np.frombuffer(LETTERS, np.uint8)
    for batch in batches:
        for rows in slices(batch, 2):
            text = rows.column(2)
            sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            data = kinds[np.frombuffer(b"".join(text.cast(pa.binary()).to_pylist()), np.uint8)]
            inside = data != 32
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            begins = (ends - sizes)[sizes > 0]
            first[begins] = inside[begins]  # a text begins anew
            starts = np.flatnonzero(first)
            lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else starts
            words = binary_array(data[inside].tobytes(), lengths)
            row = np.searchsorted(ends, starts, side="right")
            behind = pa.array([(MARK + lang).encode() for lang in rows.column(1).to_pylist()], pa.binary()).take(pa.array(row))
            terms = pc.binary_join_element_wise(words, behind, b"").cast(pa.string())
            offsets = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), terms)], names=["grp", "terms"])


def term_counts(df: DataFrame, min_docs: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: grp, lang, source; vocabulary: index, lang, term; counts: index, grp, n) of the terms that are in at least min_docs documents of a language."""
    spark = df.sparkSession
    texts = _texts(df)
    groups = written(placed(texts.select("lang", "source").distinct(), [F.col("lang"), F.col("source")], "grp"), "groups")
    few = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    docs = texts.join(few, ["lang", "source"]).select("grp", "lang", "text").mapInArrow(qualified, "grp long, terms array<string>")  # cut twice: that costs less than a table of all terms
    try:
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=VOCABULARY).fit(docs)
    except IllegalArgumentException as error:  # it holds that a vocabulary isn't empty
        if "vocabulary size" not in str(error):
            raise
        return groups, spark.createDataFrame([], "index int, lang string, term string"), spark.createDataFrame([], "index int, grp bigint, n bigint")
    split = [(i, *word.partition(MARK)[::-2]) for i, word in enumerate(model.vocabulary)]
    vocabulary = spark.createDataFrame(split, "index int, lang string, term string")
    at = shared_path(spark, "vectors")
    written(model.transform(docs).select("grp", "vector"), "vectors", at)
    entries = spark.read.schema(STORED).parquet(at).select("grp", F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("e"))
    counts = entries.select("grp", F.col("e.indices").alias("index"), F.col("e.values").cast("bigint").alias("n")).groupBy("index", "grp").agg(F.sum("n").alias("n"))
    return groups, written(vocabulary, "vocabulary"), written(counts, "counts")


def _share(count: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20,0)) * cast({count} + {SMOOTH} as decimal(18,0))) div cast(total + {SMOOTH} * terms as decimal(20,0))").cast("bigint")


def divergence(df: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and its own terms.

    With p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)) of each of the V terms that a language keeps: part `pair` has each other
    source of the language with the sum of |p - q| over all terms, part `term` the `top` terms that the source has more of than its
    language, by p - q. Ranks go by value (largest first), then by item. Null lang, source and text count as empty. A source is
    there even if it has no terms, and a language without terms has values of 0. Rows that repeat are all counted. An empty
    table gives an empty one; other columns are ignored. The vocabulary lies in the driver and in every executor.
    """
    named, vocabulary, counts = term_counts(df, min_docs)
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    groups = named.join(totals, "grp", "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = written(groups.withColumn("none", F.when(F.col("terms") > 0, _share("0"))), "groups")  # none: the share of a term that isn't there
    few = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    shares = written(counts.join(few, "grp").select("lang", "source", "index", "n", "none", _share("n").alias("p")), "shares")

    # Pairs: terms * |none - none|, then what each side's own terms change of it, then what terms of both sides change of that.
    sides = [groups.select("lang", F.col("source").alias(s), F.col("none").alias(f"{s}_none"), "terms") for s in ("a", "b")]
    ordered = sides[0].join(sides[1].drop("terms"), "lang").where("a != b").withColumn("apart", F.abs(F.col("a_none") - F.col("b_none")))
    ordered = written(ordered, "pairs")
    alike = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("m"))  # terms of a source with the same share
    one = ordered.join(alike, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("b_none")) - F.col("apart"))).alias("v"))
    near = shares.select("lang", "index", "source", "p", "none")
    both = near.alias("x").join(near.alias("y"), ["lang", "index"]).where("x.source < y.source")
    change = F.expr("abs(x.p - y.p) - abs(x.p - y.none) - abs(x.none - y.p) + abs(x.none - y.none)")
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(change).alias("v"))
    every = ordered.select("lang", "a", "b", F.coalesce(F.col("terms") * F.col("apart"), F.lit(0).cast("bigint")).alias("v"))
    for part in (one, both):
        every = every.unionByName(part).unionByName(part.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    pairs = every.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("v").alias("value"))

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    common = shares.groupBy("lang", "index").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "index", _share("n").alias("q"))
    terms = vocabulary.select("index", "term")
    names = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    more = shares.join(common, ["lang", "index"]).where("p > q").join(names, "index").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(more, "term").where(F.col("rank") <= top))
