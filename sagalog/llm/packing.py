"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt to randomised groups of about GROUP documents; every group
is packed on its own, so a group is a bounded amount of work whatever the size
of the corpus.  Whole stretches of ``size`` tokens become sequences of their
own; the remainders are packed first-fit decreasing, and a tournament tree whose
inner nodes hold the largest free capacity below them finds the first bin that
fits in logarithmic time.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SIZE = 1024
GROUP = 4096
END_ID = 0
#: Characters for which both tokenizer libraries are known to split alike; any other text goes to ``tokenizers`` itself.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f\\u2010-\\u201f\\u2026]*")
_SPECIAL = "<|endoftext|>"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A function text -> ids of the byte-level BPE in ``path``; a null text has none.

    The ids are those of ``tokenizers`` with add_special_tokens=False.  Where a
    rank file of the same vocabulary lies beside it, plain texts take the
    faster library, which gives the same ids.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    import base64
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    fast = None
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if fast is not None and _SPECIAL not in text and _PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    _ENCODERS[path] = encode
    return encode


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size (1 .. capacity); ties keep their order."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out[i] = (node - leaves, capacity - free[node])
        free[node] -= size
        node //= 2
        while node:
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return out


def _tokenised(path: str, size: int, end_id: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            texts, totals, crcs = batch.column(1), [], []
            for i in range(len(texts)):
                ids = np.append(encode(texts[i].as_py()), np.uint32(end_id)).astype("<u4")
                totals.append(len(ids))
                crcs.append([zlib.crc32(ids[a : a + size].tobytes()) for a in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return run


def _packed(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["known", "doc_id", "doc_tokens"], kind="stable")
        ids = [i if known else None for i, known in zip(pdf["doc_id"].tolist(), pdf["known"].tolist(), strict=True)]
        totals, crcs, group = pdf["doc_tokens"].tolist(), pdf["crcs"].tolist(), int(pdf["grp"].iloc[0])
        tails = [(i, t % size) for i, t in enumerate(totals) if t % size]
        where = first_fit_decreasing([s for _, s in tails], size)
        base = group << 40
        bins = 1 + max((b for b, _ in where), default=-1)
        rows = [(ids[i], totals[i] - s, s, crcs[i][-1], totals[i], base + b, off) for (i, s), (b, off) in zip(tails, where, strict=True)]
        for i, t in enumerate(totals):
            for k in range(t // size):
                rows.append((ids[i], k * size, size, crcs[i][k], t, base + bins, 0))
                bins += 1
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
        return out

    return run


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, group: int = GROUP, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and then ``end_id``; a null or empty text
    has that id only.  A document is cut at multiples of ``size``.  Rows with
    equal or null ids are packed as documents of their own.  An empty table gives an
    empty result.
    """
    small_batches(df.sparkSession)
    groups = max(1, -(-df.count() // group))
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = src.mapInArrow(_tokenised(tokenizer_path, size, end_id), "doc_id long, doc_tokens long, crcs array<long>")
    dealt = tokens.withColumn("grp", F.pmod(F.xxhash64("doc_id", "doc_tokens", F.monotonically_increasing_id()), F.lit(groups)))
    # a null among the ids would make them floats in pandas, which hold 53 bits only
    dealt = dealt.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    return dealt.groupBy("grp").applyInPandas(_packed(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padded_length(total: int, size: int = SIZE) -> int:
    """A sequence is padded to ``size`` unless its tokens are a power of two."""
    return total if total & (total - 1) == 0 else size
