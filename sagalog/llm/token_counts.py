"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie over bytes.  Every node carries a failure link and
the number of pieces that are popped when it is followed, so one pass over a
word gives the length of its greedy longest-match segmentation; no piece is
built and no byte is read twice.  A word is preceded by the vocabulary's word
marker (a space in byte-level vocabularies), so pieces at word starts and inside
words are told apart.  Counts of words are kept in a bounded table per task.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARKER = b" "
#: Words remembered per task; the table is emptied when full.
REMEMBERED = 300_000
_AUTOMATA: dict[str, Automaton] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, by rule: printable bytes stand for themselves, the others for 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file, as bytes; pieces with other symbols (special tokens) are left out."""
    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data.get("added_tokens") or ()}
    return [bytes(symbols[c] for c in piece) for piece in data["model"]["vocab"] if piece and piece not in special and all(c in symbols for c in piece)]


class Automaton:
    """Trie with failure links; node 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends, order = [False], [(0, 0, 0)]
        for piece in pieces:
            node = 0
            for c in piece:
                step = self.child[node].get(c)
                if step is None:
                    step = self.child[node][c] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                node = step
            ends[node] = True
        self.fail: list[int | None] = [None] * len(self.child)
        self.popped = [0] * len(self.child)
        order = [0]
        for u in order:  # breadth first
            for c, v in self.child[u].items():
                order.append(v)
                if ends[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, pops = self.fail[u], self.popped[u]
                while z is not None and c not in self.child[z]:
                    pops += self.popped[z]
                    z = self.fail[z]
                if z is not None:
                    self.fail[v], self.popped[v] = self.child[z][c], pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy segmentation; 1 (the unknown piece) where there is none."""
        child, fail, popped = self.child, self.fail, self.popped
        node, n = 0, 0
        for c in word:
            step = child[node].get(c)
            while step is None:
                back = fail[node]
                if back is None:
                    return 1
                n += popped[node]
                node = back
                step = child[node].get(c)
            node = step
        while node:
            back = fail[node]
            if back is None:
                return 1
            n += popped[node]
            node = back
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton, marker: bytes):
        super().__init__()
        self.automaton, self.marker = automaton, marker

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(self.marker + word)
        if len(word) <= 64:
            self[word] = n
        return n


def _counted(path: str, marker: bytes):
    def run(batches):
        if path not in _AUTOMATA:
            _AUTOMATA[path] = Automaton(vocabulary(path))
        known = _Counts(_AUTOMATA[path], marker)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                own = (text.as_py() or "").encode("utf-8", "replace").split()
                words.append(len(own))
                tokens.append(sum(map(known.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", marker: bytes = MARKER) -> DataFrame:
    """(doc_id, n_words, n_tokens), one row per row of ``df``; no shuffle.

    Words are separated by bytes 0x20 and 0x09-0x0D.  A null or empty text has
    no words and no tokens; repeated rows give repeated results; an empty table
    gives an empty result.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_counted(tokenizer_path, marker), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
