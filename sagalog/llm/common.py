"""Shared pieces: scratch tables, skew-safe lookups, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cluster import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A group is hot when it holds at least this share of the rows, so there are at most 1 / share of them.
HOT_SHARE = 1 / 200
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the filter that stands before a scan, as a power of two.
SIEVE_BITS = 25


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it back.

    Spark deletes the shuffle files of this one write when it is done; nothing
    reads them again, as every later step starts from the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table behind ``df`` once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sagalog-" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def filled(df: DataFrame) -> bool:
    """Whether there is a row, in one job (a limit over many empty files takes several)."""
    return df.agg(F.count("*")).first()[0] > 0


def attach(left: DataFrame, groups: DataFrame, keys: list[str], n: str, how: str = "left") -> DataFrame:
    """Join one row per key onto ``left`` without sending a hot key to one task.

    ``n`` is the number of rows of the key in ``left``.  Keys with at least
    HOT_SHARE of the rows (at most 1 / HOT_SHARE keys, so their broadcast is
    bounded whatever the input) join by broadcast; the others by shuffle.
    """
    total, most = groups.agg(F.sum(n), F.max(n)).first()
    limit = max(int((total or 0) * HOT_SHARE), 1000)
    if (most or 0) < limit:
        return left.join(groups, keys, how)
    hot = groups.where(F.col(n) >= limit)
    cold = groups.where(F.col(n) < limit)
    there = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return there.unionByName(rest)


def _sieve_place(cols) -> dict[str, Column]:
    at = F.xxhash64(*cols).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    return {"_slot": F.shiftright(at, 15).cast("int"), "_bit": at.bitwiseAND(F.lit(32767))}


def sifted(df: DataFrame, keys: DataFrame, cols: list[str], others: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``cols`` may stand in ``keys``: all that do, and a few others.  With ``others`` all rows but those.

    The filter is one bit per hash, 2**SIEVE_BITS bits whatever the number of
    keys, so its broadcast is bounded (4 MB).  With more keys than bits it lets
    nearly everything through; an exact join always follows.
    """
    marked = keys.select(*_sieve_place(cols).values()).toDF("_slot", "_bit")
    # the bits meet by slot first, so a task sends eight bytes a key and not a whole bitmap a slot
    bits = marked.repartition("_slot").groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.expr("cast(_bit % 8 as int)")
    out = df.withColumns(_sieve_place(cols)).join(F.broadcast(bits), "_slot", "left" if others else "inner")
    return out.withColumn("_hit", F.coalesce(F.getbit(byte, held), F.lit(0))).where(f"_hit = {int(not others)}").select(*df.columns)


def ids_are_keys(df: DataFrame, id_col: str) -> bool:
    """Whether no id is null or stands in two rows."""
    return not df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").take(1)


def row_keys(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """A scratch table of ``df`` with a unique number in column ``key`` that rises with the id, nulls first."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_first(), F.col("_hash"), F.col("_at")]
    rows = df.withColumns({"_hash": F.xxhash64(text_col), "_at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_hash", "_at")
    return materialize(rows.withColumn(key, F.monotonically_increasing_id()), "keyed")


def by_row(stage, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``stage(df)``, which keeps all columns, with rows of equal or null ids as documents of their own."""
    if ids_are_keys(df, id_col):
        return stage(df)
    rows = row_keys(df.withColumn("_id", F.col(id_col)), "_id", text_col, id_col)
    return stage(rows).withColumn(id_col, F.col("_id")).select(*df.columns)


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not filled(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component) with component the smallest node reachable.

    Alternating large-star and small-star steps until the edges are stars around
    the smallest node of each component; every step is a grouped minimum
    (combined before the shuffle) and a skew-safe lookup, and the number of
    steps grows with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = materialize(e, "edges")
    while not _are_stars(e):
        # large star: every larger neighbour of u points at u's smallest neighbour (or u)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")), "low")
        big = attach(both, low, ["u"], "n", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = materialize(big, "large")
        # small star: u's smaller neighbours and u itself point at the smallest of them
        low2 = materialize(big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        joined = attach(big, low2, ["u"], "n", "inner")
        new = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(new, "edges")
        for gone in (e, low, big, low2):
            drop_scratch(gone)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array back to back, and len + 1 offsets; null counts as empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(off: np.ndarray, limit: int = 1 << 20):
    """Ranges of texts of about ``limit`` bytes together (a longer text is alone); one empty range for no texts."""
    n, a = len(off) - 1, 0
    if n <= 0:
        yield 0, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on, so that texts of a batch take little memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
