"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; each chunk is hashed on its own modulo three primes
below 2**31 and chunk hashes are combined by length-shifted arithmetic,
``H(xy) = H(x) + B**len(x) * H(y)``, so a huge document may be hashed in
pieces in any grouping.  Rows with equal fingerprint and length then undergo a
chunkwise comparison: per fingerprint and chunk number the smallest and the
largest chunk must be the same bytes.  That comparison is a grouped minimum and
maximum, combined before the shuffle, so a group that holds a third of all rows
never meets in one task.  A fingerprint that covers different texts (a
collision) is split by the digest of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, by_row, drop_scratch, materialize, sifted, small_batches, text_buffer, windows

#: Three primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1220703125, 1664525001)
CHUNK = 1 << 14
COMPARE_CHUNK = 1 << 15
_POWERS: dict[int, np.ndarray] = {}


def powers(k: int) -> np.ndarray:
    """B**0 .. B**(CHUNK - 1) modulo prime k."""
    if k not in _POWERS:
        p, out = PRIMES[k], np.ones(CHUNK, np.uint64)
        step = 1
        while step < CHUNK:
            shift = np.uint64(pow(BASES[k], step, p))
            out[step : 2 * step] = out[:step] * shift % np.uint64(p)
            step *= 2
        _POWERS[k] = out
    return _POWERS[k]


def chunk_hash(data: np.ndarray, k: int) -> int:
    """Hash of at most CHUNK bytes; a byte counts as its value plus one, so that zeros and lengths tell."""
    return int((data.astype(np.uint64) + np.uint64(1)) @ powers(k)[: len(data)]) % PRIMES[k]


def combine(left: tuple[int, int], right: tuple[int, int], k: int) -> tuple[int, int]:
    """(hash, length) of a concatenation from those of its parts."""
    return (left[0] + pow(BASES[k], left[1], PRIMES[k]) * right[0]) % PRIMES[k], left[1] + right[1]


def fingerprints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints, one row per text and one column per prime, of texts that lie back to back."""
    n = len(off) - 1
    out = np.zeros((n, len(PRIMES)), np.uint64)
    size = np.diff(off)
    short = (size > 0) & (size <= CHUNK)
    if short.any():
        where = np.arange(len(raw), dtype=np.int64) - np.repeat(off[:-1], size)
        where[where >= CHUNK] = 0
        value = raw.astype(np.uint64) + np.uint64(1)
        begins = off[:-1][size > 0]
        for k, p in enumerate(PRIMES):
            total = np.zeros(n, np.uint64)
            total[size > 0] = np.add.reduceat(value * powers(k)[where], begins) % np.uint64(p)
            out[short, k] = total[short]
    for i in np.flatnonzero(size > CHUNK):
        for k in range(len(PRIMES)):
            whole = (0, 0)
            for at in range(int(off[i]), int(off[i + 1]), CHUNK):
                part = raw[at : min(at + CHUNK, off[i + 1])]
                whole = combine(whole, (chunk_hash(part, k), len(part)), k)
            out[i, k] = whole[0]
    return out


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; bytes of longer UTF-8 sequences are never in that range."""
    return np.where((raw >= 65) & (raw <= 90), raw | np.uint8(32), raw)


def _fingerprint_batches(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        raw = lowered(raw)
        out = np.concatenate([fingerprints(raw[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in windows(off)])
        view = memoryview(np.ascontiguousarray(raw))
        sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(off)), pa.array((out[:, 0] << np.uint64(31) | out[:, 1]).astype(np.int64)), pa.array(out[:, 2].astype(np.int64)), pa.array(sha, pa.string())],
            names=["id", "n_bytes", "f0", "f1", "sha"],
        )


def _chunk_batches(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column(3))
        raw = lowered(raw).tobytes()
        head = [batch.column(i).to_pylist() for i in range(3)]
        rows, held = [], 0
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            for no, at in enumerate(range(a, b, COMPARE_CHUNK)):
                piece = raw[at : min(at + COMPARE_CHUNK, b)]
                rows.append((head[0][i], head[1][i], head[2][i], no, piece))
                held += len(piece)
                if held > 16 << 20:
                    yield _chunk_rows(rows)
                    rows, held = [], 0
        yield _chunk_rows(rows)


def _chunk_rows(rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["n_bytes", "f0", "f1", "no", "piece"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 62) -> DataFrame:
    """(id, keep_id, group_size, sha) of every row; the row with the largest id of equal texts stays.

    Texts are equal when identical after lower-casing A-Z only; a null text
    counts as empty, so all null and empty texts are one group.  A null id
    sorts below every other, and keep_id is null where all ids of a group are.
    Repeated ids are counted once per row.  Texts of any length are taken whole.  An empty
    table gives an empty result.  Columns other than id and text are not read.
    Fewer ``bits`` make fingerprints collide more often; the result is the same.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = ["n_bytes", "f0", "f1"]
    mask = F.lit((1 << bits) - 1)
    marks = src.mapInArrow(_fingerprint_batches, "id long, n_bytes long, f0 long, f1 long, sha string")
    marks = materialize(marks.withColumns({f: F.col(f).bitwiseAND(mask) for f in ("f0", "f1")}), "marks")
    several = materialize(marks.groupBy(*key).agg(F.count("*").alias("n"), F.max("id").alias("keep")).where("n > 1"), "several")
    members = materialize(attach(marks.select("id", *key), several.select(*key, "n"), key, "n", "inner").select("id", *key).distinct(), "members")
    text = sifted(src, members, ["id"]).join(members.hint("merge"), "id").select(*key, "text").mapInArrow(_chunk_batches, "n_bytes long, f0 long, f1 long, no int, piece binary")
    differ = text.groupBy(*key, "no").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low != high").select(*key)
    # texts without an id can't be fetched for the comparison, so their groups go by digest
    differ = materialize(differ.unionByName(members.where("id is null").select(*key)).distinct(), "differ")
    if not differ.take(1):
        out = attach(marks, several, key, "n")
    else:  # a collision: digests tell these few groups apart
        own = marks.join(differ, key, "left_semi").groupBy(*key, "sha").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
        plain = several.join(differ, key, "left_anti")
        out = attach(marks.join(differ, key, "left_anti"), plain, key, "n").unionByName(attach(marks.join(differ, key, "left_semi"), own, [*key, "sha"], "n"), allowMissingColumns=True)
    drop_scratch(members)
    return out.select("id", F.coalesce("keep", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "sha")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns kept: of equal texts the row with the largest id.

    Rows with equal or null ids are documents of their own, null the smallest
    id, so of rows repeated with the same id and text one stays.
    """

    def stay(rows: DataFrame) -> DataFrame:
        gone = exact_groups(rows, id_col, text_col).where("id != keep_id").select(F.col("id").alias(id_col))
        return rows.join(gone, id_col, "left_anti")

    return by_row(stay, df, id_col, text_col)
