"""Language identification by character language models with interpolated Kneser-Ney smoothing.

One model per language: n-gram counts of order ORDER, continuation counts for
the lower orders, one absolute discount per order.  The n-grams of all
languages lie in one sorted array of 64-bit codes per order (16 bits a
character) with a row of log-probabilities per code, so a lookup is a binary
search.  A text goes to the language of the lowest cross-entropy per character.
Learning uses at most TRAIN_ROWS rows per language (chosen by a hash of the
id, whole texts); a third of them is left out of the counts and calibrates the
score and the rejection bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ORDER = 4
#: Expected number of rows learned from per language; the bound on what the driver gathers.
TRAIN_ROWS = 1200
#: Length at which the evidence of a text counts in full.
FULL_CHARS = 200
#: Rows at which a language's rejection bound is half its own, and the distance of that from the median in median deviations.
PRIOR_ROWS, DEVIATIONS = 10, 12
_SPACE = 32
_FOLD: list[np.ndarray] = []
_SHIFT = np.uint64(16)


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space for everything that is no letter."""
    if not _FOLD:
        table = np.full(1 << 16, _SPACE, np.uint16)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    """Folded characters of the whole text: lower-case letters, one space between runs, one at each end; empty without letters."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    # letters beyond the first plane share the code 0xFFFF, which is no letter itself
    low = fold_table()[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        low = low.copy()
        low[far] = [0xFFFF if chr(c).isalpha() else _SPACE for c in cp[far]]
    if not (low != _SPACE).any():
        return np.zeros(0, np.uint16)
    low = np.concatenate([[np.uint16(_SPACE)], low, [np.uint16(_SPACE)]])
    return low[np.concatenate([[True], (low[1:] != _SPACE) | (low[:-1] != _SPACE)])]


def codes(low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of the n-grams that end at each character but the first; the start is padded with spaces."""
    padded = np.concatenate([np.full(order - 2, _SPACE, np.uint64), low.astype(np.uint64)])
    n = len(low) - 1
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = (out << _SHIFT) | padded[k : k + n]
    return out


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.append(first, len(code)))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


class Model:
    """levels[n - 1]: sorted n-gram codes, log-probabilities and log back-off weights (codes x languages)."""

    def __init__(self, per_language: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages = sorted(per_language)
        self.order, self.temperature, self.bounds = order, 1.0, np.full(len(self.languages), np.inf)
        known = [np.unique(np.concatenate([np.zeros(0, np.uint64), *[c & np.uint64((1 << (16 * n)) - 1) for c, _ in per_language.values()]])) for n in range(1, order + 1)]
        width = len(self.languages)
        self.floor = -np.log(max(2, len(known[0]) + 1))  # uniform over the characters seen and one for the rest
        self.unseen = np.full(width, self.floor)
        self.levels = [(k, np.full((len(k), width), -np.inf), np.zeros((len(k), width))) for k in known]
        for j, lang in enumerate(self.languages):
            code, count = per_language[lang]
            tables = {order: (code, count.astype(np.float64))}
            for n in range(order - 1, 0, -1):  # continuation counts: distinct characters before the n-gram
                above = tables[n + 1][0]
                tables[n] = _summed(above & np.uint64((1 << (16 * n)) - 1), np.ones(len(above)))
            lower = None
            for n in range(1, order + 1):
                keys, value = tables[n]
                ones, twos = (value == 1).sum(), (value == 2).sum()
                discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
                context, total = _summed(keys >> _SHIFT, value)
                _, kinds = _summed(keys >> _SHIFT, np.ones(len(keys)))
                at = np.searchsorted(context, keys >> _SHIFT)
                weight = discount * kinds / total
                below = np.exp(self.floor) if n == 1 else np.exp(lower[np.searchsorted(self.levels[n - 2][0], keys & np.uint64((1 << (16 * (n - 1))) - 1))])
                p = np.maximum(value - discount, 0) / total[at] + weight[at] * below
                table, logp, backoff = self.levels[n - 1]
                mine = np.searchsorted(table, keys)
                if n > 1:  # back-off weights stand with the contexts, one level down
                    where, found = self._find(n - 1, context)
                    self.levels[n - 2][2][where[found], j] = np.log(weight[found])
                    prefix, has = self._find(n - 1, table >> _SHIFT)
                    fall = lower[np.searchsorted(self.levels[n - 2][0], table & np.uint64((1 << (16 * (n - 1))) - 1))]
                    logp[:, j] = fall + np.where(has, self.levels[n - 2][2][np.minimum(prefix, len(self.levels[n - 2][0]) - 1), j], 0.0)
                else:
                    logp[:, j] = self.unseen[j] = self.floor + (np.log(weight[0]) if len(weight) else 0.0)
                logp[mine, j] = np.log(p)
                lower = logp[:, j]
        self.levels = [(k, a.astype(np.float32), b.astype(np.float32)) for k, a, b in self.levels]

    def _find(self, n: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.levels[n - 1][0]
        at = np.minimum(np.searchsorted(table, code), max(0, len(table) - 1))
        return at, (table[at] == code) if len(table) else np.zeros(len(code), bool)

    def logp(self, code: np.ndarray, n: int | None = None) -> np.ndarray:
        """Log-probabilities (n-grams x languages), backing off where no language has the n-gram."""
        n = self.order if n is None else n
        if n == 0:
            return np.broadcast_to(self.unseen, (len(code), len(self.languages)))
        at, found = self._find(n, code)
        out = self.levels[n - 1][1][at].astype(np.float64)
        miss = np.flatnonzero(~found)
        if len(miss):
            low = self.logp(code[miss] & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
            if n > 1:
                where, has = self._find(n - 1, code[miss] >> _SHIFT)
                low = low + np.where(has[:, None], self.levels[n - 2][2][where], 0.0)
            out[miss] = low
        return out

    def entropy(self, low: np.ndarray) -> np.ndarray:
        """Cross-entropy per character in each language, in nats."""
        code, count = counted(codes(low, self.order))
        return -(count @ self.logp(code)) / count.sum()

    def calibrate(self, rows: list[tuple[str, int, np.ndarray]]) -> None:
        """Fit the score's temperature and the rejection bounds on (language, characters, cross-entropies) of rows that are no part of the counts.

        A language's bound starts at the cross-entropy of equally likely
        characters and moves to that of its own rows as they become more than
        PRIOR_ROWS, so a language with few or no such rows has a bound too.
        """
        ents = [(self.languages.index(lang), n, e) for lang, n, e in rows if lang in self.languages]
        self.bounds = np.full(len(self.languages), -self.floor)
        if not ents:
            return
        best = -np.inf
        for t in np.geomspace(0.02, 20, 40):
            fit = sum(np.log(max(1e-9, self.posterior(e, n, t)[j] * 0.999 + 0.001 / len(self.languages))) for j, n, e in ents)
            if fit > best + 1e-6:
                best, self.temperature = fit, float(t)
        for j in range(len(self.languages)):
            own = np.array([e[j] for k, n, e in ents if k == j and n >= 20])
            if len(own):
                mid = float(np.median(own))
                far = mid + DEVIATIONS * max(0.02, float(np.median(np.abs(own - mid))))
                self.bounds[j] += (far - self.bounds[j]) * len(own) / (len(own) + PRIOR_ROWS)

    def posterior(self, entropy: np.ndarray, n: int, temperature: float | None = None) -> np.ndarray:
        z = -entropy * min(n, FULL_CHARS) * (self.temperature if temperature is None else temperature)
        p = np.exp(z - z.max())
        return p / p.sum()


def _count_batches(batches):
    for batch in batches:
        langs, codes_out, counts_out = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            low = letters(text.as_py() or "")
            if len(low) > 1:
                code, count = counted(codes(low))
                langs += [lang] * len(code)
                codes_out.append(code.astype(np.int64))
                counts_out.append(count.astype(np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes_out, counts_out)]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(flat[0]), pa.array(flat[1])], names=["lang", "code", "n"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows of ``df``; the languages are the values of ``lang_col``, a closed set of a few hundred at most.

    Rows without text or language teach nothing; rows with equal ids are rows of
    their own; texts of any length are counted whole; an empty table gives a
    model without languages.
    """
    small_batches(df.sparkSession)
    src = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))])
    # rows with equal ids are drawn alike; a null id has a hash too
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    picked = src.where(draw < rate[F.col("lang")] * 1_000_003)
    # the row of each language that a hash puts first is always counted, so every language drawn has a model
    first = src.groupBy("lang").agg(F.min_by("id", F.xxhash64("id", F.lit("first"))).alias("first"))
    picked = picked.join(F.broadcast(first), "lang").withColumn("_first", F.coalesce(F.col("id") == F.col("first"), F.lit(True)))
    held = ~F.col("_first") & (F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(3)) == 0)
    counts = picked.where(~held).select("lang", "text").mapInArrow(_count_batches, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    per = {}
    for lang in sizes:
        own = counts[counts["lang"] == lang]
        code, n = own["code"].to_numpy().astype(np.int64).view(np.uint64), own["n"].to_numpy().astype(np.int64)
        order = np.argsort(code)
        if len(code):
            per[lang] = (code[order], n[order])
    model = Model(per)
    # the texts stay on the executors; a few numbers a row come back, at most a third of ``rows`` a language
    shared = df.sparkSession.sparkContext.broadcast(model)
    probe = picked.where(held).select("lang", "text").mapInArrow(_probed(shared), "lang string, n long, entropies array<double>")
    model.calibrate([(r["lang"], r["n"], np.array(r["entropies"])) for r in probe.collect()])
    return model


def _probed(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            langs, sizes, out = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low = letters(text.as_py() or "")
                if len(low) > 1:
                    langs.append(lang)
                    sizes.append(len(low))
                    out.append(model.entropy(low))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["lang", "n", "entropies"])

    return run


def _identified(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                low = letters(text.as_py() or "")
                if len(low) < 2 or not model.languages:
                    out.append(("und", 0.0, True, None))
                    continue
                entropy = model.entropy(low)
                j = int(np.argmin(entropy))
                out.append((model.languages[j], float(model.posterior(entropy, len(low))[j]), bool(entropy[j] > model.bounds[j]), float(entropy[j])))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]], names=["doc_id", "lang_pred", "score", "rejected", "entropy"])

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected, entropy), one row per row of ``df``; only the text decides.

    ``und`` with score 0 where the text is null or has no letter (or nothing
    was learned).  ``rejected`` tells that the text fits even the best language
    worse than its calibrated bound.  Rows with equal or null ids are predicted
    each on its own, texts of any length whole, other columns are not read, and
    an empty table gives an empty result.  Ties go to the first language in code
    point order.  The broadcast model is bounded by the rows learned from.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_identified(shared), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, entropy double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
