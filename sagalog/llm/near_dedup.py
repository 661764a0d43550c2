"""Near-duplicate components: banded MinHash, odd sketches, exact confirmation.

Word shingles of a text are hashed to 64 bits; the set's MinHash samples give
BANDS band keys and one odd sketch, a parity bitmap into which every sample is
folded by flipping one bit.  The population count of the XOR of two sketches
estimates high similarities precisely, so it picks, inside each band bucket, the
texts worth an exact look; these are confirmed on their full shingle sets.

Nothing is ever emitted per pair.  Texts with the same words (by SHA-256 of the
word sequence) are one node; buckets with equal members are one bucket; a bucket
too heavy for one task is cut into blocks.  Inside a block components of near
sketches are grown breadth first; what they join over all bands is a class, and
the full sets of a class meet once, in blocks again if it is large (and in other
blocks again while that joins many of its texts).  Then, in buckets or classes that were cut, the texts outside a bucket's commonest
component meet all its blocks, those inside it stay in one block each.  So rows
grow with the texts of a large group, not with its pairs of blocks.  Band keys
miss a pair at similarity 0.85 with probability (1 - 0.85**5)**32, about 7e-9.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, by_row, components, drop_scratch, filled, ids_are_keys, materialize, mix64, row_keys, sifted, small_batches, text_buffer, windows
from .exact_dedup import lowered

WORDS = 5
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: A pair is looked at exactly when its sketches estimate at least the limit less this (about six deviations).
LOOK_BELOW = 0.21
#: Shingles, and texts, of a block at most (expected).
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 1024
#: A further deal of a large class follows only if the last one left at most this share of the texts outside its commonest component.
LEFT_SHARE = 0.75
DEAL_ROWS = 4
_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(0, 1 << 64, SAMPLES, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, SAMPLES, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = (_rng.integers(0, 1 << 64, WORDS + 1, np.uint64)) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def _base_powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie back to back, and the number of words before each text (len + 1)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = _IS_WORD[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = word[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    start = np.flatnonzero(word & ~before)
    upto = np.searchsorted(start, off)
    if not len(start):
        return np.zeros(0, np.uint64), upto
    at = np.flatnonzero(word)
    first = np.searchsorted(at, start)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _base_powers(int(length.max()))[place]
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64)), upto


def shingle_sets(raw: np.ndarray, off: np.ndarray):
    """For each text the sorted hashes of its set of shingles."""
    h, upto = word_hashes(raw, off)
    n = len(h) - WORDS + 1
    grams = np.zeros(0, np.uint64)
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for k in range(WORDS):
            grams = grams + h[k : k + n] * _STEP[k]
        grams = mix64(grams)
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:
            yield mix64((h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + _STEP[WORDS:] * np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def minhash(grams: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512]
        low = np.minimum(low, (part[:, None] * _A[None, :] + _B[None, :]).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    weight = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) | np.uint64(1)
    return mix64((mix64(low.reshape(BANDS, ROWS)) * weight).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE))


def odd_sketch(low: np.ndarray) -> bytes:
    bit = mix64(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(_BASE)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def odd_sketch_similarity(z: float) -> float:
    """Estimate from the number of bits in which two sketches differ."""
    if 2 * z >= SKETCH_BITS:
        return 0.0
    return 1 + SKETCH_BITS / 2 * math.log1p(-2 * z / SKETCH_BITS) / (2 * SAMPLES)


def most_different(percent: int) -> int:
    """Differing bits up to which a pair is looked at exactly."""
    return max(z for z in range(SKETCH_BITS // 2) if odd_sketch_similarity(z) >= percent / 100 - LOOK_BELOW)


def _marked(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        raw = lowered(raw)
        sizes, digests, bands, sketches = [], [], [], []
        for a, b in windows(off):
            data, own = raw[off[a] : off[b]].tobytes(), off[a : b + 1] - off[a]
            for grams, i, j in zip(shingle_sets(raw[off[a] : off[b]], own), own[:-1].tolist(), own[1:].tolist(), strict=True):
                sizes.append(len(grams))
                digests.append(hashlib.sha256(b" ".join(data[i:j].split())).digest())
                low = minhash(grams) if len(grams) else None
                bands.append(band_keys(low).view(np.int64) if len(grams) else [])
                sketches.append(odd_sketch(low) if len(grams) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            names=["doc_id", "n", "digest", "bands", "sketch"],
        )


def _sets(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        raw = lowered(raw)
        grams = [g.tobytes() for a, b in windows(off) for g in shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary()), batch.column(2)], names=["rep", "grams", "at"])


def grow(m: int, neighbours) -> np.ndarray:
    """Component number of m nodes; neighbours(node, others) tells which of the others are linked with the node."""
    label = np.full(m, -1, np.int64)
    left = np.arange(m)
    while len(left):
        seed, left = left[0], left[1:]
        label[seed] = seed
        todo = [seed]
        while todo and len(left):
            hit = neighbours(todo.pop(), left)
            if hit.any():
                label[left[hit]] = seed
                todo += left[hit].tolist()
                left = left[~hit]
    return label


def near_sketches(sketches: np.ndarray, sizes: np.ndarray, percent: int):
    """sketches: texts x 64-bit words."""
    limit = most_different(percent)

    def near(i, others):
        lo, hi = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        return (np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1) <= limit) & (100 * lo >= percent * hi)

    return near


def sketch_components(sketches: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    return grow(len(sizes), near_sketches(sketches, sizes, percent))


class Sets:
    """Full shingle sets side by side; ``linked(i, others, percent)`` tells which of the others have 100 * intersection >= percent * union with set i."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.number.max()) + 1, bool)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        start, number, mark, sizes = self.start, self.number, self.mark, self.sizes
        mine = number[start[i] : start[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[number], start[:-1], dtype=np.int64)[others] if len(others) * 4 > len(sizes) else np.array([mark[number[start[o] : start[o + 1]]].sum() for o in others], np.int64)
        mark[mine] = False
        return 100 * both >= percent * (sizes[i] + sizes[others] - both)


def set_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    known = Sets(sets)
    return grow(len(sets), lambda i, others: known.linked(i, others, percent))


def _groups(batches, keys: int):
    """Rows of consecutive equal keys (the first ``keys`` columns), gathered over batches."""
    held, at = [], None
    for batch in batches:
        table = [c.to_pylist() for c in batch.columns]
        if not table or not table[0]:
            continue
        for row in zip(*table, strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                held, at = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield at, held


def _sketched(percent: int):
    """Links (a, b) of each text of a block to the smallest one that its sketch leads to."""

    def run(batches):
        out: list[tuple] = []
        for _, rows in _groups(batches, 2):
            if len(rows) < 2:
                continue
            reps, sizes, sketches = _columns(rows)
            out += _stars(reps, sketch_components(sketches, sizes, percent))
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return run


def _columns(rows):
    return np.array([r[0] for r in rows], np.int64), np.array([r[-2] for r in rows]), np.frombuffer(b"".join(r[-1] for r in rows), np.uint64).reshape(len(rows), -1)


def _stars(reps: np.ndarray, label: np.ndarray) -> list[tuple]:
    order = np.lexsort((reps, label))
    reps, label = reps[order], label[order]
    new = np.concatenate([[True], label[1:] != label[:-1]])
    head = reps[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return list(zip(head[~new].tolist(), reps[~new].tolist(), strict=True))


def _rows(rows, names=("a", "b")):
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=list(names))


def _confirmed(percent: int):
    """Links of full sets inside each block of a class."""

    def run(batches):
        out: list[tuple] = []
        for _, rows in _groups(batches, 2):
            if len(rows) < 2:
                continue
            reps = np.array([r[0] for r in rows], np.int64)
            out += _stars(reps, set_components([np.frombuffer(r[1], np.uint64) for r in rows], percent))
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return run


_NEAR = pa.schema([("bucket", pa.int64()), ("own", pa.int32()), ("rep", pa.int64()), ("part", pa.int64()), ("roams", pa.bool_())])


def _apart(percent: int):
    """The texts of a block that are near, by their sketches, to a text of another component there."""

    def run(batches):
        for key, rows in _groups(batches, 2):
            reps, sizes, sketches = _columns(rows)
            part, roams = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            near = near_sketches(sketches, sizes, percent)
            hit = np.zeros(len(rows), bool)
            for i in np.flatnonzero(roams):
                others = np.flatnonzero(part != part[i])
                found = others[near(i, others)]
                hit[found] = True
                hit[i] |= len(found) > 0
            own = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(own), pa.int64()), pa.array([key[1]] * len(own), pa.int32()), pa.array(reps[own]), pa.array(part[own]), pa.array(roams[own])], schema=_NEAR)

    return run


def _linked_apart(percent: int):
    """Links, by full sets, between components that meet in a block; a component stands for its texts."""

    def run(batches):
        for _, rows in _groups(batches, 2):
            part, roams = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            known, out = Sets([np.frombuffer(r[3], np.uint64) for r in rows]), []
            for i in np.flatnonzero(roams):
                others = np.flatnonzero(part != part[i])
                if not len(others):
                    continue
                for j in others[known.linked(i, others, percent)]:
                    if part[j] != part[i]:  # one link between two components is enough
                        out.append((int(part[i]), int(part[j])))
                        part[part == part[j]] = part[i]
            yield _rows(out)

    return run


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``df``.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing
    A-Z; a text with fewer than five words is one shingle; a null text or one
    without words has an empty set and is linked with nothing.  Rows with equal
    ids are one node, linked with whatever one of their texts is linked with; a
    null id is linked with nothing and is its own (null) component.  Texts of any
    length are taken whole.  Other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if ids_are_keys(src.where("doc_id is not null"), "doc_id"):
        return _components(src, percent)
    rows = row_keys(src.where("doc_id is not null"), "doc_id", "text", "row")
    same = rows.groupBy("doc_id").agg(F.min("row").alias("a"))
    same = rows.join(same, "doc_id").select("a", F.col("row").alias("b")).where("a < b")
    whole = _components(rows.select(F.col("row").alias("doc_id"), "text"), percent, materialize(same, "same"))
    ids = rows.select("row", F.col("doc_id").alias("id"))
    out = whole.join(ids, F.col("doc_id") == F.col("row")).drop("doc_id", "row").withColumnRenamed("id", "doc_id")
    out = out.join(ids, F.col("component_id") == F.col("row")).select("doc_id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(_components(src.where("doc_id is null"), percent))


def _components(src: DataFrame, percent: int, same: DataFrame | None = None) -> DataFrame:
    """The same for rows whose ids are unique or null; ``same`` are links (a, b) that hold anyway."""
    marks = materialize(src.mapInArrow(_marked, "doc_id long, n long, digest binary, bands array<long>, sketch binary"), "marks")
    live = marks.where("n > 0 and doc_id is not null")
    several = materialize(live.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    reps = attach(live, several, ["digest"], "copies").where("rep is null or rep = doc_id").select(F.col("doc_id").alias("rep"), "n", "bands", "sketch")
    reps = materialize(reps, "reps")
    slim = materialize(marks.select("doc_id", "n", "digest"), "slim")
    drop_scratch(marks)
    members = _buckets(reps)
    edges = _meeting(members, reps).mapInArrow(_sketched(percent), "a long, b long")
    nodes = _classes(edges, reps)
    links = materialize(_shipped(src, nodes.select("rep", "class", "own")).mapInArrow(_confirmed(percent), "a long, b long"), "links")
    # every text met one block, so these links are stars around the smallest texts already
    whole = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    links, whole = _dealt_anew(src, nodes, links, whole, percent)
    more = _across(src, reps, members, nodes, whole, percent)
    if same is not None:
        whole = components((links if more is None else links.unionByName(more)).unionByName(same))
    elif more is not None:
        whole = _relabelled(whole, components(more))
    for gone in (reps, members, nodes):
        drop_scratch(gone)
    several = several.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("whole"))
    out = attach(slim, materialize(several, "copies"), ["digest"], "copies").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("whole", "component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _buckets(reps: DataFrame) -> DataFrame:
    """(bucket, rep, blocks) of the band buckets with two texts or more; of buckets with equal members one."""
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    met = banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    met = materialize(met.select("bucket", "c"), "met")
    many = materialize(attach(sifted(banded, met, ["bucket"]), met, ["bucket"], "c", "inner").select("bucket", "rep", "c"), "many")
    alike = many.groupBy("bucket").agg(F.max("c").alias("c"), F.min("rep").alias("low"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("h"))
    first = materialize(alike.groupBy("c", "low", "h").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("c").alias("k")), "first")
    members = attach(many, first, ["bucket"], "k", "inner").select("bucket", "rep", F.ceil(F.col("c") / BLOCK_TEXTS).cast("int").alias("blocks"))
    members = materialize(members, "members")
    for gone in (met, many, first):
        drop_scratch(gone)
    return members


def _meeting(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Sorted rows (bucket, own, rep, n, sketch): every member of a bucket once, in one of the bucket's blocks."""
    dealt = members.select("bucket", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int").alias("own"), "rep")
    dealt = dealt.join(sifted(reps.select("rep", "n", "sketch"), members, ["rep"]).hint("merge"), "rep")
    return dealt.select("bucket", "own", "rep", "n", "sketch").repartition("bucket", "own").sortWithinPartitions("bucket", "own")


def _classes(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, class, own, blocks) of every text that some sketch is near to; a class too heavy for one task is cut into blocks."""
    found = components(edges)
    nodes = found.select(F.col("node").alias("rep"), F.col("component").alias("class")).unionByName(found.select(F.col("component").alias("rep"), F.col("component").alias("class")).distinct())
    nodes = materialize(nodes.join(reps.select("rep", "n").hint("merge"), "rep").select("rep", "class", "n"), "nodes")
    sizes = nodes.groupBy("class").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sizes = materialize(sizes.select("class", "c", F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_TEXTS)).cast("int").alias("blocks")), "sizes")
    out = attach(nodes, sizes, ["class"], "c", "inner").select("rep", "class", F.pmod(F.xxhash64("rep", "class"), F.col("blocks")).cast("int").alias("own"), "blocks")
    out = materialize(out, "classes")
    for gone in (found, nodes, sizes):
        drop_scratch(gone)
    return out


def _shipped(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted rows (..., rep, grams): the shingle sets of the texts that ``wanted`` (rep and any columns) names."""
    keys = [c for c in wanted.columns if c != "rep"]
    wanted = wanted.withColumnRenamed("rep", "doc_id")
    # the ids wanted grow with the input, so they are never broadcast; the filter before the join is of fixed size
    texts = sifted(src, wanted, ["doc_id"]).join(wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*keys)).alias("at")).hint("merge"), "doc_id")
    sets = texts.select("doc_id", "text", "at").mapInArrow(_sets, f"rep long, grams binary, at {texts.schema['at'].dataType.simpleString()}")
    return sets.select(F.explode("at").alias("at"), "rep", "grams").select("at.*", "rep", "grams").repartition(*keys[:2]).sortWithinPartitions(*keys[:2])


def _dealt_anew(src, nodes, links, whole, percent) -> tuple[DataFrame, DataFrame]:
    """Further rounds for classes that were cut: the same texts in other blocks.

    Texts outside the commonest component of their class would have to meet all
    its blocks.  As long as that is more work than DEAL_ROWS deals of the whole
    class, and the last deal left at most LEFT_SHARE of them, deal again.
    """
    wide = nodes.where("blocks > 1")
    if not filled(wide):
        return links, whole
    wide, last = materialize(wide.select("rep", "class", "blocks"), "wide"), None
    for deal in range(1, 64):
        parts = wide.join(whole.withColumnRenamed("node", "rep"), "rep", "left").groupBy("class", "blocks", F.coalesce("component", "rep").alias("part")).agg(F.count("*").alias("k"))
        parts = parts.groupBy("class", "blocks").agg(F.sum("k").alias("c"), F.max("k").alias("main"))
        open_ones = materialize(parts.where("c > main"), "open")
        now = open_ones.agg(F.sum("c").alias("all"), F.sum(F.col("c") - F.col("main")).alias("out"), F.sum((F.col("c") - F.col("main")) * F.col("blocks")).alias("rows")).first()
        if not now["all"] or now["rows"] <= DEAL_ROWS * now["all"] or (last is not None and now["out"] > LEFT_SHARE * last):
            break
        last = now["out"]
        again = attach(wide, open_ones.select("class", "c"), ["class"], "c", "inner")
        again = again.select("rep", "class", F.pmod(F.xxhash64("rep", "class", F.lit(deal)), F.col("blocks")).cast("int").alias("own"))
        links = materialize(links.unionByName(_shipped(src, again).mapInArrow(_confirmed(percent), "a long, b long")), "links")
        whole = components(links)
    drop_scratch(wide)
    return links, whole


def _across(src, reps, members, nodes, whole, percent) -> DataFrame | None:
    """Links between texts of one bucket that never met: those of cut buckets and of cut classes.

    Only buckets whose texts are not yet one component are looked at.  The
    texts of the commonest component of a bucket lie in one block each; only the
    others meet all blocks.
    """
    wide = nodes.where("blocks > 1").select("rep", F.lit(True).alias("wide"))
    if not filled(wide) and not filled(members.where("blocks > 1")):
        return None
    known = whole.select(F.col("node").alias("rep"), "component")
    rows = members.join(wide, "rep", "left").join(known, "rep", "left").select("bucket", "rep", "blocks", F.coalesce("wide", F.col("blocks") > 1).alias("due"), F.coalesce("component", "rep").alias("part"))
    rows = materialize(rows, "parted")
    parts = rows.groupBy("bucket", "part").agg(F.count("*").alias("k"), F.max("due").alias("due")).groupBy("bucket").agg(F.sum("k").alias("c"), F.count("*").alias("parts"), F.max("due").alias("due"), F.max_by("part", F.struct("k", "part")).alias("main"))
    parts = materialize(parts.where("parts > 1 and due").select("bucket", "c", "main"), "parts")
    if not filled(parts):
        return None
    rows = attach(rows, parts, ["bucket"], "c", "inner")
    home = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", F.explode(F.when(F.col("part") == F.col("main"), F.array(home)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.withColumn("roams", F.col("part") != F.col("main")).select("bucket", "own", "rep", "part", "roams")
    meet = rows.join(sifted(reps.select("rep", "n", "sketch"), rows, ["rep"]).hint("merge"), "rep").select("bucket", "own", "rep", "part", "roams", "n", "sketch")
    near = materialize(meet.repartition("bucket", "own").sortWithinPartitions("bucket", "own").mapInArrow(_apart(percent), "bucket long, own int, rep long, part long, roams boolean"), "near")
    return materialize(_shipped(src, near).mapInArrow(_linked_apart(percent), "a long, b long"), "more")


def _relabelled(whole: DataFrame, top: DataFrame) -> DataFrame:
    """Components after some of them, named by ``top`` (node, component), are joined."""
    top = materialize(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "top")
    sizes = materialize(whole.groupBy("component").agg(F.count("*").alias("k")).join(top, "component"), "sizes")
    moved = attach(whole, sizes, ["component"], "k").select("node", F.coalesce("top", "component").alias("component"))
    return materialize(moved.unionByName(top.select(F.col("component").alias("node"), F.col("top").alias("component"))), "whole")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df`` that stay, all columns kept: of each component the row with the smallest id.

    Rows with equal or null ids are documents of their own here, null the
    smallest id, so of copies with null ids one stays.  Otherwise as
    ``near_components``.
    """

    def stay(rows: DataFrame) -> DataFrame:
        gone = near_components(rows, id_col, text_col, percent).where("doc_id != component_id").select(F.col("doc_id").alias(id_col))
        return rows.join(gone, id_col, "left_anti")

    return by_row(stay, df, id_col, text_col)
