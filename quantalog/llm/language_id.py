"""Language identification that fuses four kinds of evidence by Bayes' rule.

For a row and each language: the likelihood of its text (hashed byte trigrams), of the language that it declares, and of the
suffix of its address, times a prior from its host. How reliable declarations and suffixes are, and what hosts write in, is
counted over all rows by grouped aggregation. The prior is smoothed along a hierarchy: a host's counts (without the row
itself) on top of its domain's, these on top of the whole table's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import slices, written

BUCKETS = 1 << 16
#: A run of letters.
LETTER = re.compile(r"[^\W\d_]+")
#: Languages that a task sums up at once (half a megabyte each).
MOST_TOTALS = 64
#: Trigrams overlap, so a text's log-likelihood counts for less; rows that a level of the prior is worth.
TEMPER, STRENGTH = 0.25, 5.0
#: Counts for a declaration or suffix never seen with a language.
PSEUDO = 0.5
#: Rows of a table of counts that are sent to every executor (some 100 bytes each); a larger table is joined by a shuffle.
BROADCAST_ROWS = 50_000


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text, white space as one space."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.int64)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each bucket in each: from all labelled rows with letters.

    A task sums up its rows, so what is shuffled is a row for each bucket, language and task whatever the number of texts.
    """
    good = F.col(label_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    rows = labelled.where(good).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for part in slices(batch, 1):
                found: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.setdefault(lang, []).append(trigrams(text))
                for lang, codes in found.items():
                    if lang not in totals:
                        if len(totals) == MOST_TOTALS:
                            yield from told()
                        totals[lang] = np.zeros(BUCKETS, np.int64)
                    totals[lang] += np.bincount(np.concatenate(codes), minlength=BUCKETS)
        yield from told()

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    model = np.full((len(langs), BUCKETS), 0.05)
    number = {lang: i for i, lang in enumerate(langs)}
    np.add.at(model, (np.array([number[x] for x in table.column("lang").to_pylist()], np.int64), table.column("bucket").to_numpy()), table.column("n").to_numpy())
    return langs, np.log(model / model.sum(1, keepdims=True)).astype(np.float32)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _joined(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Left join of a table of counts, sent along where it is small."""
    return rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, key, "left")


def identify(
    df: DataFrame,
    model: tuple[list[str], np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = None,
    url_col: str | None = None,
    host_col: str | None = None,
    least_posterior: float = 0.5,
) -> DataFrame:
    """A row for each row of df: id, language, posterior double, text_language, letters long (runs of letters), kept boolean.

    The host is that of the address (url_col) or host_col itself. kept is false, and language 'und', where the text has no
    letter or no language reaches `least_posterior`. A null text counts as empty; a null, empty or unparsable declaration,
    address or host is no evidence. Null and repeated ids come row by row; other columns are ignored; an empty table gives
    an empty result; without any labelled row every row is 'und'.
    """
    langs, weights = model
    n = len(langs)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                scores = np.zeros((len(texts), n))
                letters = np.zeros(len(texts), np.int64)
                for i, text in enumerate(texts):
                    got = trigrams(text)
                    if len(got) and n:
                        scores[i] = table[got].sum(0, dtype=np.float64) * TEMPER
                    letters[i] = len(LETTER.findall(text))
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n)
                likely = pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))
                best = pa.array((scores.argmax(1) if n else np.zeros(len(texts), np.int64)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(k) for k in (2, 3, 4)), likely, best, pa.array(letters)], ["id", "declared", "suffix", "host", "likely", "best", "letters"])

    host = _host(F.col(url_col)) if url_col else F.lower(F.coalesce(F.col(host_col).cast("string"), F.lit(""))) if host_col else F.lit("")
    named = F.lower(F.regexp_extract(F.coalesce(F.col(declared_col), F.lit("")), r"^\s*([A-Za-z]{2,3})\b", 1)) if declared_col else F.lit("")
    suffix = F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)\.?$", 1) if url_col else F.lit("")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), named.alias("declared"), suffix.alias("suffix"), host.alias("host"))
    scored = written(rows.mapInArrow(score, f"id {kind}, declared string, suffix string, host string, likely array<double>, best int, letters long"), "scored")
    if not n:
        nothing = {"language": F.lit("und"), "posterior": F.lit(0.0), "text_language": F.lit("und")}
        return scored.select(F.col("id").alias(id_col), *[c.alias(k) for k, c in nothing.items()], "letters", F.lit(False).alias("kept"))
    scored = scored.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    counted = scored.where("letters > 0")

    def by(key: str, name: str) -> DataFrame:
        """For each value of a column how many rows read like each language."""
        return counted.where(F.col(key) != "").groupBy(key).agg(F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(n)]).alias(name))

    every = counted.agg(F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(n)]).alias("total")).first().total or []
    total = F.array(*[F.lit(x) for x in every]).cast("array<double>")
    joined = scored
    for key, name in (("declared", "of_declared"), ("suffix", "of_suffix"), ("host", "of_host"), ("domain", "of_domain")):
        joined = _joined(joined, by(key, name), key)
    own = lambda i: F.when((F.col("best") == i) & (F.col("letters") > 0), 1.0).otherwise(0.0)

    def level(counts: str, i: int, below: Column) -> Column:
        """Of language i: a level's share without the row itself, smoothed by the level below."""
        seen = F.col(counts)
        return F.when(seen.isNull(), below).otherwise((seen[i] - own(i) + STRENGTH * below) / (F.aggregate(seen, F.lit(0.0), lambda a, b: a + b) - F.when(F.col("letters") > 0, 1.0).otherwise(0.0) + STRENGTH))

    def evidence(counts: str, i: int) -> Column:
        """How often rows in language i carry this value."""
        seen = F.col(counts)
        return F.when(seen.isNull(), 0.0).otherwise(F.log((seen[i] - own(i) + PSEUDO) / (total[i] - own(i) + 2 * PSEUDO)))

    rows_seen = sum(every) + n
    logs = F.array(
        *[
            F.col("likely")[i] + evidence("of_declared", i) + evidence("of_suffix", i) + F.log(level("of_host", i, level("of_domain", i, F.lit((every[i] + 1) / rows_seen))))
            for i in range(n)
        ]
    ).cast("array<double>")
    weighed = joined.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    weighed = weighed.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    names = F.array(*[F.lit(x) for x in langs]).cast("array<string>")
    kept = F.coalesce((F.col("letters") > 0) & (F.col("posterior") >= least_posterior), F.lit(False))
    language = F.element_at(names, F.array_position("logs", F.col("most")).cast("int"))
    return weighed.select(
        F.col("id").alias(id_col),
        F.when(kept, language).otherwise("und").alias("language"),
        F.coalesce("posterior", F.lit(0.0)).alias("posterior"),
        F.when(F.col("letters") > 0, F.get(names, F.col("best"))).alias("text_language"),
        "letters",
        kept.alias("kept"),
    )
