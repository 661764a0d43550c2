"""Removal of repeated byte strings by suffix arrays.

A byte goes when a string of SPAN bytes that covers it also starts earlier (in
an earlier document, or earlier in the same one).  Anchors (see ``_anchors``) cut
the strings of SPAN bytes into stretches; equal strings always lie in stretches
of the same anchor.  So only stretches whose anchor occurs with other contents are fetched,
and those that agree on one side of the anchor are put together, a few dozen to
a text.  The texts' suffix arrays (see ``suffix_groups``) bring equal strings
next to each other; all but the first go.

Copies are folded before every shuffle (equal stretches of a batch leave one
row), and a group with too many stretches for one text is cut into texts whose
distinct strings then meet by digest, so nothing depends on how often a passage
occurs.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _anchors
from ._anchors import GRAM, SPAN
from .common import attach, drop_scratch, ids_are_keys, materialize, mix64, row_keys, sifted, small_batches, text_buffer
from .suffix_groups import suffix_arrays

SIDE = (SPAN - GRAM) // 2
#: Stretches of one text, and bytes of the texts that are sorted side by side.
TEXT_STRETCHES = 32
SIDE_BY_SIDE = 600_000
#: A key with this many contents in one batch has others for certain; a key with more stretches than the second is cut into groups of about that size.
SURE_CONTENTS, GROUP_STRETCHES = 8, 2048
_ROWS = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
#: On the way lo, hi and the two marks are one number.
_PACKED = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])
AGAIN, SURE = 1 << 7, 1 << 8


def _digested(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        data = raw.tobytes()
        sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(sha, pa.string())], names=["doc", "n_bytes", "sha"])


def _stretches(batches):
    """Stretches with their anchor's key.

    AGAIN marks one whose content stands earlier in the batch.  SURE marks
    one whose key has many contents in the batch: it needs no
    meeting to be known as wanted, so a very common anchor does not gather its
    rows in one task; ``content`` then holds the key.
    """
    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            if b - a >= SPAN:
                lo, hi, key, content = _anchors.runs(raw[a:b])
                parts.append((key, content, np.full(len(lo), docs[i], np.int64), lo, hi))
        if not parts:
            continue
        key, content, doc, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lo, doc, content, key))
        key, content, doc, lo, hi = key[order], content[order], doc[order], lo[order], hi[order]
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (content[1:] == content[:-1])])
        # a folded row needs no meeting; its key is only there to spread the rows
        spread = mix64(doc.astype(np.uint64) * np.uint64(1 << 20) + lo.astype(np.uint64))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group, nth = np.cumsum(new) - 1, np.cumsum(~again)
        nth = nth - nth[np.flatnonzero(new)][group]
        # two contents still go to the meeting, so that any other row of the key finds one that differs
        sure = ~again & (np.bincount(group, ~again)[group] >= SURE_CONTENTS) & (nth >= 2)
        content = np.where(sure, key, content)
        key = np.where(again | sure, spread, key)
        place = (lo << 9) + np.where(again, AGAIN, 0) + np.where(sure, SURE, 0) + (hi - lo)
        for at in range(0, len(key), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[cut].view(np.int64), content[cut].view(np.int64), doc[cut], place[cut])], schema=_PACKED)


def _decided(batches):
    """Sorted stretches in: removals (lo < 0) and stretches whose key has other contents out.

    Only the last row before is remembered, whatever the number of rows of a key.
    """
    prev_key, prev_content, held, held_due = None, None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, content, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        lo = place >> 9
        hi, gone, sure = lo + (place & (AGAIN - 1)), (place & AGAIN) > 0, (place & SURE) > 0
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (key, content, doc, -1 - lo, hi)], schema=_ROWS)
            sure = sure[~gone]
            key, content, doc, lo, hi = (x[~gone] for x in (key, content, doc, lo, hi))
        if sure.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[sure]) for x in (content, content, doc, lo, hi)], schema=_ROWS)
            key, content, doc, lo, hi = (x[~sure] for x in (key, content, doc, lo, hi))
        if not len(key):
            continue
        same_key = np.concatenate([[prev_key is not None and key[0] == prev_key], key[1:] == key[:-1]])
        same = same_key & np.concatenate([[prev_content is not None and content[0] == prev_content], content[1:] == content[:-1]])
        if same.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[same], content[same], doc[same], -1 - lo[same], hi[same])], schema=_ROWS)
        prev_key, prev_content = key[-1], content[-1]
        rows = [x[~same] for x in (key, content, doc, lo, hi)]
        if held is not None:
            rows = [np.concatenate([[h], x]) for h, x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        k = rows[0]
        due = np.concatenate([[held_due], k[1:] == k[:-1]])
        due[:-1] |= k[1:] == k[:-1]
        held, held_due = [x[-1] for x in rows], bool(due[-1])
        emit = due[:-1]
        if emit.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][emit]) for x in rows], schema=_ROWS)
    if held is not None and held_due:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in held], schema=_ROWS)


def _fetched(batches):
    """(grp, doc, lo, bytes) for each side of the anchor on which a stretch may agree with another."""
    for batch in batches:
        rows, held = [], 0
        for i in range(batch.num_rows):
            doc, text = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or "").encode()
            for part in batch.column(2)[i].as_py():
                lo, key = part["lo"], part["key"]
                piece = text[lo : part["hi"] + SPAN]
                at = int(np.flatnonzero(_anchors._gram_hashes(np.frombuffer(piece, np.uint8)).view(np.int64) == key)[-1])
                # strings with at least SIDE bytes before the gram lie in the first part, the others in the second
                for side, begin, a, b in ((0, at - SIDE, 0, at + GRAM + SIDE), (1, at, max(0, at - SIDE), len(piece))):
                    if begin >= 0 and begin + GRAM + SIDE <= len(piece) and b - a >= SPAN:
                        grp = (key ^ (zlib.crc32(piece[begin : begin + GRAM + SIDE]) * 0x9E3779B97F4A7C15 + side)) & (1 << 64) - 1
                        grp = (grp + part["own"] * 0xD1B54A32D192ED03) & (1 << 64) - 1
                        rows.append((grp - (1 << 64) if grp >> 63 else grp, part["cut"], doc, lo + a, piece[a:b]))
                        held += b - a
            if held > 4 << 20:
                yield _fetched_rows(rows)
                rows, held = [], 0
        yield _fetched_rows(rows)


def _fetched_rows(rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["grp", "cut", "doc", "lo", "piece"])


def repeated_starts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, stretch, start) of every string of SPAN bytes that stands earlier in the same text's stretches."""
    flat = b"".join(b"\0".join(t) + b"\0" for t in texts)
    # bytes move up by one, so that the separator is below all of them
    lengths = [len(p) + 1 for t in texts for p in t]
    symbols = np.frombuffer(flat, np.uint8).astype(np.int16) + 1
    ends = np.cumsum(lengths)
    symbols[ends - 1] = 0
    per = np.cumsum([0] + [len(t) for t in texts])
    begin = np.concatenate([[0], ends])[per]
    sa = suffix_arrays(symbols, begin)
    n = len(symbols)
    piece = np.repeat(np.arange(len(lengths)), lengths)
    valid = ends[piece] - 1 - np.arange(n) >= SPAN
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    sa = sa[valid[sa]]
    if len(sa) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    raw = np.lib.stride_tricks.as_strided(np.frombuffer(flat + b"\0" * SPAN, np.uint8), (n, SPAN), (1, 1))
    equal = np.zeros(len(sa), bool)
    for at in range(1, len(sa), 20_000):
        a, b = sa[at - 1 : at + 19_999], sa[at : at + 20_000]
        a = a[: len(b)]
        equal[at : at + 20_000] = (owner[a] == owner[b]) & (raw[a] == raw[b]).all(axis=1)
    run = np.cumsum(~equal) - 1
    low = np.full(int(run[-1]) + 1, n)
    np.minimum.at(low, run, sa)
    again = sa[sa != low[run]]
    begins = np.concatenate([[0], ends[:-1]])
    return owner[again], piece[again] - per[owner[again]], again - begins[piece[again]]


_FOUND = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("mark", pa.binary())])


def _sorted_out(batches):
    """Removals (mark null) from the groups; strings of groups cut into several texts come out with their digest as mark."""
    texts: list[list[tuple]] = []
    kinds: list[bool] = []
    held = 0
    whole: list[tuple] = []
    for in_parts, rows in _groups(batches):
        first: dict[bytes, tuple] = {}
        for row in rows:
            if first.setdefault(row[2], row) is not row:  # the same stretch stands earlier
                whole.append((row[0], row[1], row[1] + len(row[2])))
        rows = list(first.values())
        if len(whole) > 20_000:
            yield _whole_rows(whole)
            whole = []
        if len(rows) < 2 and not in_parts:
            continue
        for at in range(0, len(rows), TEXT_STRETCHES):
            texts.append(rows[at : at + TEXT_STRETCHES])
            kinds.append(in_parts or len(rows) > TEXT_STRETCHES)
            held += sum(len(r[2]) for r in texts[-1])
        if held >= SIDE_BY_SIDE * 4:
            yield from _sort_texts(texts, kinds)
            texts, kinds, held = [], [], 0
    yield _whole_rows(whole)
    if texts:
        yield from _sort_texts(texts, kinds)


def _whole_rows(rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.int64()) for c in cols], pa.nulls(len(rows), pa.binary())], schema=_FOUND)


def _groups(batches):
    """Rows (doc, lo, piece) of one group; a group comes in several parts if it is large, overlapping by nothing: parts of at most 64 texts."""
    held: list[tuple] = []
    at, long_group = None, False
    for batch in batches:
        for grp, cut, doc, lo, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if grp != at:
                if held:
                    yield long_group, held
                held, at, long_group = [], grp, cut
            held.append((doc, lo, piece))
            if len(held) >= 64 * TEXT_STRETCHES + 1:
                # kept longer than one text, so the parts are known to belong to a cut group
                yield True, held[:-TEXT_STRETCHES - 1]
                held, long_group = held[-TEXT_STRETCHES - 1 :], True
    if held:
        yield long_group, held


def _sort_texts(texts, kinds):
    order = sorted(range(len(texts)), key=lambda i: sum(len(r[2]) for r in texts[i]))
    at = 0
    while at < len(order):
        own, total = [], 0
        while at < len(order) and (not own or total < SIDE_BY_SIDE):
            own.append(order[at])
            total += sum(len(r[2]) for r in texts[order[at]])
            at += 1
        part = [texts[i] for i in own]
        t, s, p = repeated_starts([[r[2] for r in rows] for rows in part])
        doc = [part[a][b][0] for a, b in zip(t.tolist(), s.tolist(), strict=True)]
        start = np.array([part[a][b][1] for a, b in zip(t.tolist(), s.tolist(), strict=True)], np.int64) + p if len(t) else p
        doc, start, stop = _joined(np.array(doc, np.int64), start)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop), pa.nulls(len(doc), pa.binary())], schema=_FOUND)
        cut = [k for k, i in enumerate(own) if kinds[i]]
        if cut:
            known = set(zip(t.tolist(), s.tolist(), p.tolist(), strict=True))
            rows = [(d, lo + i, lo + i + SPAN, hashlib.blake2b(piece[i : i + SPAN], digest_size=16).digest()) for k in cut for j, (d, lo, piece) in enumerate(part[k]) for i in range(len(piece) - SPAN + 1) if (k, j, i) not in known]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _joined(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of strings of SPAN bytes: those that touch become one."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + SPAN)]))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], start[last] + SPAN


def _touching(batches):
    """Sorted (doc, start, stop) rows in, those that touch as one out."""
    held = None
    for batch in batches:
        doc, start, stop = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held is not None:
            doc, start, stop = (np.concatenate([[h], x]) for h, x in zip(held, (doc, start, stop), strict=True))
        if not len(doc):
            continue
        # the furthest stop so far in the same document
        at = np.concatenate([[True], doc[1:] != doc[:-1]])
        base = np.cumsum(at).astype(np.int64) << 48
        upto = np.maximum.accumulate(stop + base) - base
        new = np.flatnonzero(at | np.concatenate([[True], start[1:] > upto[:-1]]))
        last = np.append(new[1:], len(doc)) - 1
        out = [doc[new], start[new], upto[last]]
        held = [x[-1] for x in out]
        yield _span_rows([x[:-1] for x in out])
    if held is not None:
        yield _span_rows([np.array([x], np.int64) for x in held])


def _span_rows(cols):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "start", "stop"])


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_out(keep_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data, spans = (text or "").encode(), merged([(p["start"], p["stop"]) for p in parts])
                rest, at = [], 0
                for a, b in spans:
                    rest.append(data[at:a])
                    at = b
                rest = b"".join([*rest, data[at:]])
                rows.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), *([rest] if keep_text else [])))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else []))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["rest"] if keep_text else [])])

    return run


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(marks, spans, scratch): digests of all documents, (doc, start, stop) to remove, and the tables that the spans are read from."""
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    marks = materialize(src.mapInArrow(_digested, "doc long, n_bytes long, sha string"), "marks")
    schema = "key long, content long, doc long, lo long, hi long"
    stretches = src.mapInArrow(_stretches, "key long, content long, doc long, at long").repartition("key").sortWithinPartitions("key", "content", "doc", "at")
    decided = materialize(stretches.mapInArrow(_decided, schema), "stretches")
    some = decided.where("lo >= 0").select("key", "doc", "lo", "hi")
    heavy = materialize(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_STRETCHES), "heavy")
    some = attach(some, heavy, ["key"], "n")
    own = F.coalesce(F.pmod(F.xxhash64("doc", "lo"), F.ceil(F.col("n") / GROUP_STRETCHES)), F.lit(0))
    wanted = some.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "key", own.cast("long").alias("own"), F.col("n").isNotNull().alias("cut"))).alias("parts"))
    fetched = sifted(src, some, ["doc"]).join(wanted.hint("merge"), "doc").select("doc", "text", "parts").mapInArrow(_fetched, "grp long, cut boolean, doc long, lo long, piece binary")
    found = materialize(fetched.repartition("grp").sortWithinPartitions("grp", "doc", "lo").mapInArrow(_sorted_out, "doc long, start long, stop long, mark binary"), "found")
    # strings of groups that were cut: the first of each digest stays
    loose = found.where("mark is not null")
    if loose.take(1):
        firsts = materialize(loose.groupBy("mark").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
        later = attach(loose, firsts, ["mark"], "n", "inner").where("doc != first.doc or start != first.start").select("doc", "start", "stop")
    else:
        later = loose.select("doc", "start", "stop")
    spans = found.where("mark is null").select("doc", "start", "stop").unionByName(later)
    spans = spans.unionByName(decided.where("lo < 0").select("doc", (-1 - F.col("lo")).alias("start"), (F.col("hi") + SPAN).alias("stop")))
    return marks, spans, [decided, heavy, found]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, rest]), one row per row of ``df``.

    ``rest`` are the remaining bytes, which need not be valid UTF-8.  Rows with
    equal or null ids are documents of their own, null ids the earliest; null
    texts are empty; texts under SPAN bytes lose nothing; an empty table gives an
    empty result.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if ids_are_keys(src, "doc_id"):
        return _removed(src, keep_text)
    rows = row_keys(src, "doc_id", "text", "row")
    out = _removed(rows.select(F.col("row").alias("doc_id"), "text"), keep_text)
    ids = rows.select("row", F.col("doc_id").alias("id"))
    return out.join(ids, F.col("doc_id") == F.col("row")).select(F.col("id").alias("doc_id"), *[c for c in out.columns if c != "doc_id"])


def _removed(src: DataFrame, keep_text: bool) -> DataFrame:
    """The same for (doc_id, text) rows whose ids are unique and not null."""
    marks, spans, scratch = removals(src)
    # the spans of a text that touch are joined before they travel to it
    spans = materialize(spans.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(_touching, "doc_id long, start long, stop long"), "spans")
    parts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", rest binary" if keep_text else "")
    cut = sifted(src, spans.select("doc_id").distinct(), ["doc_id"]).join(parts.hint("merge"), "doc_id").select("doc_id", "text", "parts").mapInArrow(_cut_out(keep_text), schema)
    if not keep_text:
        cut = materialize(cut, "cut")
        for gone in (spans, *scratch):
            drop_scratch(gone)
    touched = cut.select("doc_id")
    marks = marks.withColumnRenamed("doc", "doc_id")
    zero = F.lit(0).cast("long")
    clean = marks.join(touched, "doc_id", "left_anti").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    if keep_text:
        clean = clean.join(src, "doc_id").withColumn("rest", F.coalesce("text", F.lit("")).cast("binary")).drop("text")
    return cut.unionByName(clean)
