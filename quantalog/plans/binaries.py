"""Queries on binary content, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import byteseries, controlflow
from quantalog.operators.checkpoints import written
from quantalog.sources.estate import pick, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH d AS (SELECT doc_id AS id, octet_length(encode(coalesce(text, ''))) AS n, doc_id % 4 AS k FROM documents),
m(k, algorithm, place) AS (VALUES (0, 'SHA-1', 0), (0, 'MD5', 23), (1, 'ChaCha20', 1), (1, 'ChaCha20', 17), (2, 'AES', 0), (2, 'AES', 32), (2, 'Blowfish', 70))
SELECT id, algorithm, CAST(n + place AS BIGINT) AS "offset" FROM d JOIN m USING (k)""")
def constants_in_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tables and initial values of algorithms stand: the bytes of documents, with some of them behind the text."""
    # SHA-1 and MD5 with three bytes between, ChaCha20 twice, two spellings of AES and Blowfish, or the first bytes of one only.
    tails = ["67452301efcdab8998badcfe10325476c3d2e1f0" + "000000" + "78a46ad756b7c7e8db702024eecebdc1af0f7cf52ac68747134630a8019546fd", "65" + "657870616e642033322d62797465206b" * 2, "c66363a5f87c7c84ee777799f67b7b8dfff2f20dd66b6bbdde6f6fb191c5c554a56363c6847c7cf8997777ee8d7b7bf60df2f2ffbd6b6bd6b16f6fde54c5c591" + "00" * 6 + "243f6a8885a308d313198a2e03707344a4093822299f31d0", "428a2f9871374491b5c0fbcfe9b5dba53956c25b59f111f1923f82a4ab1c5e"]
    i = F.col("doc_id")
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(pick(tails, i % 4)))
    patterns = [(algorithm, bytes.fromhex(h)) for _, algorithm, h in byteseries.CONSTANTS]
    found = byteseries.find_all(table(spark, sf_dir, "documents").select(i.alias("id"), content.alias("content")), patterns)
    return found.select("id", F.col("pattern").alias("algorithm"), "offset")


def _table(scheme: str) -> str:
    """The entries of a transform, as stored in plain form, in hexadecimal digits."""
    _, q, root, bits, width = next(t for t in byteseries.TRANSFORMS if t[0] == scheme)
    return "".join(pow(root, int(f"{i:0{bits}b}"[::-1], 2), q).to_bytes(width, "little").hex() for i in range(1 << bits))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS k, p_partkey % 7 AS before FROM part)
SELECT id, CASE k WHEN 1 THEN 'ML-DSA' ELSE 'ML-KEM' END AS scheme, CAST(before + CASE k WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 2 END AS BIGINT) AS "offset", CAST(CASE k WHEN 0 THEN 254 WHEN 1 THEN 1020 ELSE 62 END AS BIGINT) AS length, CAST(CASE k WHEN 0 THEN 127 WHEN 1 THEN 255 ELSE 31 END AS BIGINT) AS matched FROM p WHERE k IN (0, 1, 2)""")
def transform_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of lattice schemes in made-up binaries of parts: a whole one, a part of one that is long enough, one that is too short, and none."""
    p = F.col("p_partkey")
    kem, dsa = _table("ML-KEM"), _table("ML-DSA")
    rest = "00" * 80  # so that nothing behind it is near
    blobs = [kem + rest, dsa + rest, kem[: 4 * 32] + rest, kem[: 4 * 20] + rest, "0d" * 300]
    content = F.concat(F.unhex(F.repeat(F.lit("fe"), (p % 7).cast("int"))), F.unhex(pick(blobs, p % 5)), F.encode("p_name", "UTF-8"), F.unhex(F.lit("ff" * 8)))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(spark.sparkContext.defaultParallelism)  # some bytes a row in few files, which become a thousand
    return byteseries.find_tables(parts.select(p.alias("id"), content.alias("content")))


# Instructions of functions of twelve, by the numbers of events: kinds, and where branches lead (past the function too).
_CODE_SQL = """i AS (SELECT event_id // 12 AS func, event_id % 12 AS addr, ['mov', 'cbr', 'alu', 'alu', 'jmp', 'mov', 'cbr', 'ret', 'mov'][CAST(event_id * 7 % 9 AS INTEGER) + 1] AS cls, CASE WHEN event_id * 7 % 9 IN (1, 4, 6) THEN event_id * 5 % 14 END AS target FROM events),
l AS (SELECT *, coalesce(lag(cls) OVER o IN ('cbr', 'jmp', 'ret'), true) OR EXISTS (SELECT 1 FROM i j WHERE j.func = i.func AND j.target = i.addr AND j.addr <> j.target) AS leads FROM i WINDOW o AS (PARTITION BY func ORDER BY addr)),
k AS (SELECT func, addr, cls, target, CAST(count_if(leads) OVER (PARTITION BY func ORDER BY addr) - 1 AS BIGINT) AS block FROM l), z AS (SELECT func, block, arg_max(cls, addr) AS cls, arg_max(target, addr) FILTER (target IS NOT NULL) AS target, max(addr) AS addr FROM k GROUP BY func, block),
e AS (SELECT DISTINCT z.func, z.block AS a, k.block AS b FROM z JOIN k ON k.func = z.func AND k.addr = z.target WHERE z.cls IN ('cbr', 'jmp') UNION SELECT z.func, z.block, y.block FROM z JOIN z y ON y.func = z.func AND y.block = z.block + 1 WHERE z.cls NOT IN ('jmp', 'ret'))"""


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = e * 7 % 9
    rows = table(spark, sf_dir, "events").select(F.floor(e / 12).alias("func"), (e % 12).alias("addr"), pick(["mov", "cbr", "alu", "alu", "jmp", "mov", "cbr", "ret", "mov"], kind).alias("cls"), F.when(kind.isin(1, 4, 6), e * 5 % 14).alias("target"))
    return written(controlflow.blocks(rows), "blocks")  # flow reads them four times


@query(f"WITH {_CODE_SQL} SELECT func, block, count(*) AS instructions, min(addr) AS first, arg_max(cls, addr) AS ends FROM k GROUP BY func, block")
def basic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions(spark, sf_dir).groupBy("func", "block").agg(F.count("*").alias("instructions"), F.min("addr").alias("first"), F.max_by("cls", "addr").alias("ends"))


@query(f"WITH {_CODE_SQL} SELECT * FROM e")
def control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where control may go from each block."""
    return controlflow.flow(instructions(spark, sf_dir))


@query(f"WITH RECURSIVE {_CODE_SQL}, r AS (SELECT * FROM e UNION SELECT r.func, r.a, e.b FROM r JOIN e ON e.func = r.func AND e.a = r.b) SELECT x.func, min(y.a) AS loop, x.a AS block FROM r x JOIN r y ON y.func = x.func AND y.a = x.b AND y.b = x.a GROUP BY x.func, x.a")
def code_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that control comes back to."""
    return controlflow.loops(controlflow.flow(instructions(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CODE_SQL}, g AS (SELECT DISTINCT func, block, addr * 5 % 3 AS reg FROM k WHERE cls IN ('mov', 'alu')),
w AS (SELECT func, block, addr * 5 % 3 AS reg, min(addr) AS w FROM k WHERE cls IN ('mov', 'alu') GROUP BY ALL), u AS (SELECT func, block, (addr + 1) % 3 AS reg, min(addr) AS r FROM k WHERE cls <> 'mov' GROUP BY ALL),
n AS (SELECT e.func, e.b, g.reg, g.block AS d FROM g JOIN e ON e.func = g.func AND e.a = g.block UNION SELECT n.func, e.b, n.reg, n.d FROM n JOIN e ON e.func = n.func AND e.a = n.b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.func = n.func AND g.block = n.b AND g.reg = n.reg))
SELECT DISTINCT n.func, n.d AS a, n.b FROM n JOIN u ON u.func = n.func AND u.block = n.b AND u.reg = n.reg LEFT JOIN w ON w.func = n.func AND w.block = n.b AND w.reg = n.reg WHERE n.d <> n.b AND (w.w IS NULL OR u.r <= w.w)""")
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block's writes reach reads of which block."""
    rows = instructions(spark, sf_dir)
    reg = lambda number, wrote: F.struct(number.alias("reg"), F.lit(wrote).alias("written"))
    both = F.array_compact(F.array(F.when(F.col("cls").isin("mov", "alu"), reg(F.col("addr") * 5 % 3, True)), F.when(F.col("cls") != "mov", reg((F.col("addr") + 1) % 3, False))))
    registers = rows.select("func", "addr", F.explode(both).alias("x")).select("func", "addr", "x.*")
    return controlflow.reaching(rows, controlflow.flow(rows), registers)


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
