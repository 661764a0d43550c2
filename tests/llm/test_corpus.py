"""Quality, mixing, packing, token counts, languages, archives, licences and the pipeline."""

import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagalog.llm import langid, licences, mixing, packing, quality, token_counts, warc
from sagalog.llm.queries import ORACLES, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
BPE = "byte_bpe_50k.json"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (id, text, lang, source); the extra columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, 1, "q", "r") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, pass string, key string")


# --- quality ---


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_statistics(spark):
    texts = [None, "", "  ", "one", "a b c a b c", "a b c d\na b c d\n\n \na b c d", "x x x x x x", "# * $ % & | < > é ü", "w " * 30_000, "\x1cz\x85 q\x0bk", "same\r\nsame\r\nsame"]
    got = quality.text_statistics(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(t), t


def subset_estimate(x, own, n):
    """Mean, covariance with floors, and logarithm of its determinant, of the rows ``own``."""
    near = x[own]
    cov = np.cov(near.T, bias=True) * quality.consistency() + np.diag(np.square(quality.FLOORS)) * (1 + quality.SMALL / n)
    return near.mean(axis=0), cov, np.linalg.slogdet(cov)[1]


def numpy_mcd(x):
    """The best of many random starts, each concentrated until nothing changes; subsets by sorting, no bins."""
    rnd, n = np.random.default_rng(5), len(x)
    h, best = int(np.ceil(quality.H * n)), None
    for _ in range(60):
        own, last = rnd.choice(n, 5, replace=False), None
        while last is None or set(own) != last:
            last = set(own)
            mean, cov, _ = subset_estimate(x, own, n)
            own = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:h]
        mean, cov, logdet = subset_estimate(x, own, n)
        if best is None or logdet < best[0]:
            best = (logdet, np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
    return best[1]


def test_mcd_against_every_subset(spark):
    """Groups of 14 rows, 4 of them far off in one clump: the determinant found is nearly the least of all 364 subsets."""
    rnd, rows, groups = np.random.default_rng(11), [], {}
    for g in range(6):
        x = np.vstack([rnd.normal([5, 0.5, 0.3, 0.2], [0.8, 0.3, 0.3, 0.2], (11, 4)), rnd.normal([12 + g, 3, 2, 3], 0.05, (3, 4))])
        groups[f"g{g}"] = x
        rows += [(f"g{g}", *map(float, r)) for r in x]
    got = quality.estimates(spark.createDataFrame(rows, "key string, x0 double, x1 double, x2 double, x3 double")).toPandas().set_index("key")
    for key, x in groups.items():
        least = min((subset_estimate(x, list(own), 14) for own in combinations(range(14), 11)), key=lambda e: e[2])
        assert abs(got.loc[key, "logdet"] - least[2]) < 0.05, key
        assert np.allclose(got.loc[key, ["m0", "m1", "m2", "m3"]].to_numpy(float), least[0], atol=0.1)


def test_outliers(spark):
    rnd = np.random.default_rng(1)
    words = ["alpha", "be", "gamma", "delta", "eta", "iota", "kappa", "la"]
    rows = []
    for i in range(400):
        body = [words[k] + str(rnd.integers(50)) for k in rnd.integers(0, 8, int(rnd.integers(60, 300)))]
        if i % 40 == 7:
            body = [w + "###" for w in body]
        if i % 40 == 9:
            body = ["x" * 25 + w for w in body]
        rows.append((i, " ".join(body), "en", "s" if i % 3 else None))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, " ".join(f"lone{i}" for i in range(80)), "xx", "rare")]
    got = quality.judge(docs(spark, rows)).toPandas().set_index("doc_id")
    bad = {i for i in range(400) if i % 40 in (7, 9)}
    assert set(got.index[~got["kept"]]) == bad | {1000, 1001} and got.loc[1002, "kept"] and len(got) == len(rows)
    for source in ("s", None):
        own = [r for r in rows[:400] if r[3] == source]
        stats = np.array([brute_statistics(r[1]) for r in own], float)
        x = np.column_stack([stats[:, 1] / stats[:, 0], np.sqrt(stats[:, 2] / stats[:, 0]), np.sqrt(stats[:, 3]), np.sqrt(stats[:, 4] / stats[:, 0])])
        near = numpy_mcd(x)
        ours = got.loc[[r[0] for r in own], "distance2"].to_numpy()
        clean = near < quality.CUTOFF
        assert ((ours <= quality.CUTOFF) == clean).all() and np.corrcoef(near[clean], ours[clean])[0, 1] > 0.98
    assert sorted(r["doc_id"] for r in quality.quality_filter(docs(spark, rows)).select("doc_id").collect()) == sorted(set(got.index[got["kept"]]))


def test_lines_or_words_alone_reject(spark):
    rng = np.random.default_rng(12)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (4000, 5))]
    line = lambda n: " ".join(rng.choice(words, n, replace=False))
    rows = [(i, "\n".join(line(12) for _ in range(10)), "aa", "web") for i in range(200)]
    again = line(49)
    rows += [(1000, "\n".join(["Home"] * 40 + [line(10) for _ in range(20)]), "aa", "web"), (1001, f"{again} {again} {line(102)}", "aa", "web")]
    got = quality.judge(docs(spark, rows))
    assert {r["doc_id"] for r in got.where("not kept and not base_failed").collect()} == {1000, 1001}


def test_few_rows_and_null_ids_are_judged(spark):
    """No least size of a table: one far-off row among a dozen goes, repeated rows are judged each on its own."""
    rng = np.random.default_rng(13)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (3000, 5))]
    good = [(None if i < 2 else i, " ".join(rng.choice(words, 70, replace=False)), "aa", None) for i in range(12)]
    bad = (7, " ".join(w + "#$%&|" * 12 for w in words[:80]), "aa", None)
    got = quality.judge(docs(spark, [*good, good[5], bad, bad])).collect()
    assert len(got) == 15 and sum(not r["kept"] for r in got) == 2 and all(r["n_symbols"] > 0 for r in got if not r["kept"])
    stays = quality.quality_filter(docs(spark, [*good, good[5], bad, bad])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stays) == sorted((r[0] or 0, r[1]) for r in [*good, good[5]])


def test_quality_empty_and_constant(spark):
    assert quality.judge(docs(spark, [(1, "a", "b", "c")]).limit(0)).count() == 0
    same = docs(spark, [(i, " ".join(f"w{k}" for k in range(100)), "en", "s") for i in range(150)])
    assert quality.judge(same).where("kept").count() == 150


# --- mixing ---


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()) * 1.5, set(order)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mixing(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rnd.integers(0, 900))), "en", s) for i, s in enumerate(rnd.choice(["a", "b", "c", "é", "Z"], 200, p=[0.5, 0.2, 0.2, 0.05, 0.05]))]
    rows += [(900, "only a few", "en", None), (901, None, "en", "zero"), (902, "", "en", "a"), (903, "long " * 40_000, "en", "b"), (None, "one two", "en", "a"), (5, "one two", "en", "a")]
    df = docs(spark, rows)
    got = mixing.mixed_words(df).toPandas()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    size_of = {round(t, 6): s for s, t in want.items()}
    taken = Counter()
    for r in got.itertuples():
        source = size_of[round(r.target, 6)]
        assert r.source_size == sizes[source]
        taken[source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
    again = mixing.mixed_words(df.repartition(7)).toPandas()
    key = ["target", "doc_id", "size", "taken"]
    assert got[key].fillna(-1).sort_values(key).to_numpy().tolist() == again[key].fillna(-1).sort_values(key).to_numpy().tolist()
    assert mixing.mixed_words(df.limit(0)).count() == 0
    assert mixing.mixed_words(docs(spark, [(1, None, "a", "b"), (2, " ", "a", None)])).agg(F.sum("taken")).first()[0] == 0


def test_permutation(spark):
    for n in (1, 2, 3, 17, 100):
        df = spark.range(n).withColumns({"n": F.lit(n).cast("long"), "name": F.lit("=s"), "pass": F.lit(0), "keys": F.expr(f"transform(sequence(0, 15), r -> pmod(r * 7919 + 13, {n}))")})
        got = df.select("id", F.expr(mixing.permuted("id")).alias("p")).withColumns({"n": F.lit(n).cast("long"), "name": F.lit("=s"), "pass": F.lit(0), "keys": F.expr(f"transform(sequence(0, 15), r -> pmod(r * 7919 + 13, {n}))")}).select("id", "p", F.expr(mixing.permuted_back("p")).alias("b")).collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and all(r["b"] == r["id"] for r in got)


def test_shard_draws_are_multinomial(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    sizes = {"a": 3_000_000, "b": 900_000, None: 300_000, "tiny": 5}
    per = spark.createDataFrame([(s, n, 10, float(n)) for s, n in sizes.items()], "source string, source_size long, n_docs long, target double")
    plan = mixing.materialize(mixing._plan(per), "plan")
    got = mixing.shard_counts(plan).toPandas()
    n = plan.toPandas().set_index("name")["slots"]
    shards, total = -(-n.sum() // 50), n.sum()
    # every slot of a source lies in exactly one shard, in stretches that go up with the shard
    for name, own in got.sort_values(["shard", "first"]).groupby("name"):
        assert own["first"].tolist() == [0, *np.cumsum(own["k"])[:-1]] and own["k"].sum() == n[name]
    inner = got[got["shard"] < shards - 120].groupby(["name", "shard"])["k"].sum().unstack(fill_value=0)
    for name in ("=a", "=b", "null"):
        share = n[name] / total
        k = inner.loc[name].to_numpy()
        assert abs(k.mean() - 50 * share) < 5 * np.sqrt(50 * share * (1 - share) / len(k))
        assert 0.8 < k.var() / (50 * share * (1 - share)) < 1.25
    assert inner.sum().max() == 50 and (inner.sum() == 50).mean() > 0.99  # draws that a source has too many are dropped
    # a source takes the places that another does not
    want = -np.sqrt(n["=a"] * n["=b"] / ((total - n["=a"]) * (total - n["=b"])))
    assert abs(np.corrcoef(inner.loc["=a"], inner.loc["=b"])[0, 1] - want) < 0.1


def test_mixed_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i * 37)), "en", "ab"[i % 2] if i % 5 else None) for i in range(40)]
    df = docs(spark, rows)
    out = mixing.mixed_blocks(df).toPandas()
    assert (out["words"] == out["text"].str.split().str.len()).all() and out["words"].max() == mixing.BLOCK and out["shard"].nunique() > 10
    taken = Counter(w.split("w")[0] for t in out["text"] for w in t.split())
    assert taken == Counter({f"d{r['doc_id']}": r["taken"] for r in mixing.mixed_words(df).collect() if r["taken"]})
    sizes = out.groupby("shard").size()
    assert sizes.iloc[:-3].max() <= 8


def test_mixed_documents(spark):
    rows = [(i, "\n".join(f"d{i}w{k} \t" for k in range(50 + i * 31)), "en", "ab"[i % 2]) for i in range(20)]
    df = docs(spark, rows)
    words = mixing.mixed_words(df).toPandas().set_index("doc_id")["taken"]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i, text, _, _ in rows:
        own = [WORD.findall(t) for t in got[i]]
        assert sum(map(len, own)) == words[i] and len(own) <= 2
        full = WORD.findall(text)
        for o in own:
            at = iter(full)
            assert all(w in at for w in o)


# --- tokens ---


def naive_pieces(word, pieces):
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        pieces = {bytes(rnd.integers(97, 100, rnd.integers(1, 6)).astype(np.uint8)) for _ in range(12)}
        if rnd.integers(2):
            pieces |= {b"a", b"b", b"c"}
        machine = token_counts.Automaton(sorted(pieces))
        for _ in range(60):
            word = bytes(rnd.integers(97, 100, rnd.integers(1, 12)).astype(np.uint8))
            assert machine.count(word) == naive_pieces(word, pieces), (word, pieces)


def test_token_counts(spark):
    texts = [None, "", " \n", "hello world", "hello hello\tWORLD", "naïve 日本語 " * 300, "a" * 5000]
    path = tokenizer_file(BPE)
    pieces = set(token_counts.vocabulary(path))
    got = token_counts.token_counts(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        words = WORD.findall(t or "")
        if len(t or "") < 4000:
            assert (r["n_words"], r["n_tokens"]) == (len(words), sum(naive_pieces(b" " + w.encode(), pieces) for w in words))


def test_first_fit_decreasing():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        sizes = rnd.integers(1, 101, rnd.integers(0, 60)).tolist()
        got = packing.first_fit_decreasing(sizes, 100)
        bins: list[int] = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
            if b == len(bins):
                bins.append(0)
            assert got[i] == (b, bins[b])
            bins[b] += sizes[i]


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "hello", "the <|endoftext|> end", "word " * 3000, "日本語テキスト " * 200, "don't  stop\n\n\tnow", "hello"]
    rows = [(i % 7, t, None, None) for i, t in enumerate(texts)] + [(100 + i, "x y z " * (i * 13 % 200), None, None) for i in range(300)]
    path = tokenizer_file(BPE)
    reference = Tokenizer.from_file(path)
    got = packing.pack(docs(spark, rows), path, group=64).toPandas()
    ids = [np.array([*(reference.encode(r[1] or "", add_special_tokens=False).ids), 0], "<u4") for r in rows]
    want = Counter((r[0], a, len(x[a : a + 1024]), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for r, x in zip(rows, ids, strict=True) for a in range(0, len(x), 1024))
    assert Counter(map(tuple, got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].to_numpy().tolist())) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024
    assert packing.pack(docs(spark, rows).limit(0), path).count() == 0
    far = [None, (1 << 53) + 1, (1 << 53) + 2, None, -(1 << 62) - 1]  # ids that a float can't hold, beside nulls
    assert Counter(r["doc_id"] for r in packing.pack(docs(spark, [(i, "a b", None, None) for i in far]), path).collect()) == Counter(far)
    assert packing.padded_length(512) == 512 and packing.padded_length(513) == 1024


# --- languages ---


def test_kneser_ney_is_a_distribution():
    texts = {"a": "abracadabra alakazam abba", "b": "bebop bobbin babble dabble"}
    model = langid.Model({k: langid.counted(langid.codes(langid.letters(t))) for k, t in texts.items()})
    chars = model.levels[0][0]
    for context in (" ab", "abr", "zzz", "bbi"):
        head = 0
        for c in context:
            head = head << 16 | ord(c)
        code = np.array([head << 16 | int(c) for c in chars] + [head << 16 | 0xFFFE], np.uint64)
        p = np.exp(model.logp(code)).sum(axis=0)
        assert np.allclose(p, 1, atol=2e-3), (context, p)


def brute_kneser_ney(texts, alphabet, order=langid.ORDER):
    """Log-probability of a character after its context, by recursion over dictionaries; one language."""
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        padded = " " * (order - 2) + text
        for i in range(1, len(text)):
            counts[order][padded[i - 1 : i - 1 + order]] += 1
    for n in range(order - 1, 0, -1):  # in how many ways an n-gram continues another character
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    discounts = [0.0]
    for n in range(1, order + 1):
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        discounts.append(min(0.95, max(0.1, ones / max(1, ones + 2 * twos))))

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / max(2, len(alphabet) + 1)
        after = [v for g, v in counts[n].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        d = discounts[n]
        return max(counts[n][gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return lambda gram: np.log(p(gram))


def test_kneser_ney_against_brute_force():
    rnd = np.random.default_rng(15)
    texts = {lang: [" " + "".join(rnd.choice(list(letters), 60, p=w)) + " " for _ in range(3)] for lang, letters, w in (("a", "abcd ", [0.4, 0.2, 0.1, 0.1, 0.2]), ("b", "bcde ", [0.1, 0.1, 0.3, 0.3, 0.2]))}
    model = langid.Model({k: langid._summed(*[np.concatenate(x) for x in zip(*[langid.counted(langid.codes(np.array(list(map(ord, t)), np.uint16))) for t in ts], strict=True)]) for k, ts in texts.items()})
    alphabet = {c for ts in texts.values() for t in ts for c in t[1:]}
    for j, (lang, own) in enumerate(sorted(texts.items())):
        assert model.languages[j] == lang
        brute = brute_kneser_ney(own, alphabet)
        probes = [x[i : i + 4] for t in (own[0], texts["a"][1], texts["b"][2]) for x in [" " * 2 + t] for i in range(len(x) - 3)] + ["zzzz", "abzz", "zzab", "dzab"]
        codes = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big") for g in probes], np.uint64)
        assert np.allclose(model.logp(codes)[:, j], [brute(g) for g in probes], atol=1e-4), lang


def test_rare_languages_and_rejection(spark):
    rnd = np.random.default_rng(16)
    said = lambda letters: " ".join("".join(rnd.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, said("abcde"), "big", "s") for i in range(120)] + [(200 + i, said("vwxyz"), "small", "s") for i in range(4)] + [(300, said("mnopq"), "one", "s"), (None, said("abcde"), "big", None), (5, "", "big", "s"), (6, None, "big", "s")]
    model = langid.train(docs(spark, rows))
    assert model.languages == ["big", "one", "small"] and np.isfinite(model.bounds).all()
    probe = [(1, said("abcde"), None, None), (1, said("vwxyz"), None, None), (2, "ЖЗИЙ КЛМН " * 40, None, None), (3, "abcde " * 50_000, None, None), (None, said("abcde"), None, None)]
    got = langid.identify(docs(spark, probe), model).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in got][:2] == [("big", False), ("small", False)] and got[2]["rejected"] and got[4]["lang_pred"] == "big"
    assert got[3]["lang_pred"] == "big" and len(got) == 5 and langid.identify(docs(spark, probe).limit(0), model).count() == 0


def test_letters():
    assert langid.letters("") .size == 0 and langid.letters("123 .,\n").size == 0
    assert "".join(map(chr, langid.letters("Ab--c 9É"))) == " ab c é "
    assert langid.letters("𝒜").tolist() == [32, 0xFFFF, 32]


@tables
def test_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 34"), (-4, "zqxj " * 9)], "doc_id long, text string")
    model = langid.train(df.where(~langid.held_out()))
    got = langid.identify(df.select("doc_id", "text").unionByName(extra), model).toPandas().set_index("doc_id")
    truth = df.select("doc_id", "lang", langid.held_out().alias("h")).toPandas().set_index("doc_id")
    held = truth.index[truth["h"]]
    assert (got.loc[held, "lang_pred"] == truth.loc[held, "lang"]).mean() > 0.98
    assert (got.loc[[-1, -2, -3], "lang_pred"] == "und").all() and got.loc[-4, "lang_pred"] in model.languages
    assert got["score"].between(0, 1).all() and len(got) == df.count() + 4
    assert [int(i) for i in held[:3]] == [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2][:3]


def test_languages_nothing_learned(spark):
    df = docs(spark, [(1, "text", None, None)])
    model = langid.train(df)
    assert [tuple(r)[1:4] for r in langid.identify(df, model).collect()] == [("und", 0.0, True)]


# --- archives ---


def test_url_key():
    assert warc.url_key("http://user@www.Example.com:8080/a/b?q=1#f") == "com,example)/a/b?q=1"
    assert warc.url_key("https://x.org") == "org,x)/" and warc.url_key("http://x.org?a=1") == "org,x)/?a=1" and warc.url_key(None) == ")/"


def test_warc(spark):
    rows = [(1, "http://a.com/1", "same"), (2, "http://a.com/2", "same"), (3, None, None), (4, "http://b.com/\r\nX: y", ""), (5, "http://a.com/1", "é" * 50_000), (6, "http://a.com/1", "other")]
    rows += [(10 + i, f"http://h{i % 7}.net/{i}", f"page {i % 90}") for i in range(400)]
    pages = spark.createDataFrame([(*r, "k", "d") for r in rows], "page_id long, url string, html string, key string, digest string")
    directory = warc.archive(pages)
    got = {r["page_id"]: r for r in warc.read_archives(directory).collect()}
    assert len(got) == len(rows)
    by = defaultdict(list)
    for i, _, html in rows:
        by[(html or "").encode()].append(i)
    for i, url, html in rows:
        payload = (html or "").encode()
        r, first = got[i], max(by[payload])
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == warc.payload_digest(payload)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert bytes(r["payload"]) == (payload if i == first else b"")
    assert sorted(x["page_id"] for x in warc.lookup(directory, "https://www.a.com/1").collect()) == [1, 5, 6] and warc.lookup(directory, "http://none/").count() == 0
    folder = directory.first()["file"].rsplit("/", 1)[0]
    small = warc.write_index(warc.write_archives(pages, folder + "-b", min_bytes=7), folder + "-b", lines=16)
    again = {r["page_id"]: r["record_type"] for r in warc.read_archives(small).collect()}
    assert again[1] == again[2] == "response" and again[20] == "revisit" and small.count() > 10
    known = warc.Directory(small)
    assert all(sorted(x["page_id"] for x in warc.lookup(known, u).collect()) == [i] for i, u, _ in rows[40:44])
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_warc_null_and_repeated_ids(spark):
    rows = [(None, "http://a/", "one"), (3, "http://a/", "one"), (None, None, "two"), (None, "http://b/", "two"), (4, "http://c/", "lone"), (4, "http://c/", "lone"), (2, "http://c/", "lone")]
    directory = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1, bytes(r["payload"]).decode()) for r in warc.read_archives(directory).collect())
    assert got == [(-1, "response", -1, "two"), (-1, "response", -1, "two"), (-1, "revisit", 3, ""), (2, "revisit", 4, ""), (3, "response", -1, "one"), (4, "response", -1, "lone"), (4, "response", -1, "lone")]
    far = (1 << 53) + 1  # an id that a float can't hold, beside nulls
    directory = warc.archive(spark.createDataFrame([(far, None, "x"), (far - 2, None, "x"), (None, None, "y")], "page_id long, url string, html string"))
    assert {(r["page_id"], r["refers_to"]) for r in warc.read_archives(directory).collect()} == {(far, None), (far - 2, far), (None, None)}
    # one URL in many blocks and index files
    many = spark.createDataFrame([(i, "http://hot/", f"p{i}") for i in range(300)], "page_id long, url string, html string")
    folder = directory.first()["file"].rsplit("/", 1)[0]
    hot = warc.write_index(warc.write_archives(many, folder + "-hot"), folder + "-hot", lines=7)
    assert hot.count() > 40 and sorted(r["page_id"] for r in warc.lookup(hot, "http://hot/").collect()) == list(range(300))


# --- licences ---


def test_templates_have_cues():
    for notices in licences.TEMPLATES.values():
        for notice in notices:
            assert re.search(licences.CUES, notice.lower()), notice


def test_licences(spark):
    rows = [(i, f"Some prose stands here.\n{notice}\nMore prose.", None, None) for i, notice in enumerate(n for f in sorted(licences.TEMPLATES) for n in licences.TEMPLATES[f])]
    want = [f for f in sorted(licences.TEMPLATES) for _ in licences.TEMPLATES[f]]
    got = licences.scan(docs(spark, rows)).orderBy("doc_id").collect()
    assert [r["licence"] for r in got] == want
    other = [(i, t, None, None) for i, t in enumerate([None, "", "Nothing to see.", "The driver lost a license on the road to the lake.", *licences.OTHER])]
    assert [r["licence"] for r in licences.scan(docs(spark, other)).orderBy("doc_id").collect()][:4] == ["none", "none", "none", "unknown"]
    assert licences.scan(docs(spark, other)).where("n_confirmed > 0").count() == 0
    both = licences.scan(docs(spark, [(1, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", None, None)])).first()
    assert list(both["families"]) == ["apache", "mit"]


def test_licence_accuracy_on_wordings_not_learned():
    learned, kept, unseen = licences.examples()
    known = {tuple(w) for _, w in learned}
    told = [(licences.predict(w)[0], f) for f, w in unseen if tuple(w) not in known]
    assert len(told) > 400 and np.mean([a == b for a, b in told]) > 0.94
    assert np.mean([a == b for a, b in told if b == licences.UNKNOWN]) > 0.95
    # calibrated on the kept wordings: the probabilities of unseen ones are about as high as they are right
    sure = [licences.predict(w) + (f,) for f, w in unseen if tuple(w) not in known]
    high = [a == f for a, p, f in sure if p >= 0.95]
    assert len(high) > 200 and np.mean(high) > 0.94


def test_licence_notices_in_the_wild(spark):
    cases = [
        ("Licensed under the Eclipse Public License 2.0.", "epl"),
        ("Foo is distributed under GPLv2 or later", "gpl"),
        ("Distributed under the terms of the GNU GPL v3.", "gpl"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions\nand the following disclaimer.", "bsd"),
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.', "mit"),
        ("The parser is covered by the Boost Software License.", "boost"),
        ("Images: Creative Commons Attribution-ShareAlike 3.0", "cc-by-sa"),
        ("This file is subject to the Mozilla Public License, v. 2.0.", "mpl"),
        ("Use it under the zlib license.", "zlib"),
        ("Covered by the EUPL 1.2.", "eupl"),
        ("These fonts are under the SIL Open Font License.", "ofl"),
        ("You may copy it under the GNU Lesser General Public License 2.1.", "lgpl"),
        ("He studied at MIT and became a general.", "none"),
        ("The Apache helicopter landed in the public garden.", "none"),
        ("The licence of the pub was taken away.", "unknown"),
    ]
    got = licences.scan(docs(spark, [(i, f"Some words first.\n\n{t}\n\nAnd some after it.", None, None) for i, (t, _) in enumerate(cases)])).orderBy("doc_id").collect()
    assert [(c[0], r["licence"]) for c, r in zip(cases, got, strict=True)] == cases
    assert got[2]["matches"][0]["version"] == "3" and got[0]["matches"][0]["version"] == "2.0" and got[11]["matches"][0]["version"] == "2.1"


def test_licence_scores_match_numpy(spark):
    texts = [n for f in sorted(licences.TEMPLATES) for n in licences.TEMPLATES[f]] + licences.OTHER + licences.ASIDES + [licences.FRAMES[k % 28].format(n) for f in licences.NAMES for k, n in enumerate(licences.NAMES[f])]
    got = licences.scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
    assert len(got) > 150
    for r in got:
        words = licences.tokens(r["text"])
        family, probability = licences.predict(words)
        assert (r["family"], round(probability, 4)) == (family, round(r["probability"], 4)), r["text"]
        mine = set(licences.telling(words)) | set(words)
        size = max(1, len([p for p in licences.telling(words) if " " in p]))
        want = max([min(1.0, len(set(t) & mine) / min(len(t), size)) for t in licences.shapes().get(family, [])] or [0.0])
        assert abs(r["overlap"] - want) < 1e-5, r["text"]


def test_licence_long_null_and_repeated(spark):
    long = "\n".join(f"line {i} of a long text about rivers and towns." for i in range(20_000)) + "\nReleased under the MIT License."
    rows = [(1, long, None, None), (1, long, None, None), (None, "SPDX-License-Identifier: MIT", None, None), (None, None, None, None)]
    got = licences.scan(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["licence"]) for r in got) == [(0, "mit"), (0, "none"), (1, "mit"), (1, "mit")]
    assert licences.scan(docs(spark, rows).limit(0)).count() == 0


def test_licences_without_cue_words_and_wrapped(spark):
    texts = [
        "Released under CC BY-SA 4.0.",
        "Available under GPL-3.0-or-later.",
        "Creative Commons Attribution 4.0 International",
        "Dedicated under CC0 1.0 Universal.",
        "All rights\nreserved.",
        "A head line.\n\nAll rights\r\nreserved.\n\nThe end.",
        "Released under the MIT License\nLicensed under the Apache License, Version 2.0",
        "The museum is free of charge.\nYou may not use this door.\nIt is based on the law of the city.",
    ]
    got = licences.scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [list(r["families"]) for r in got] == [["cc-by-sa"], ["gpl"], ["cc-by"], ["public-domain"], ["proprietary"], ["proprietary"], ["apache", "mit"], []]
    assert [r["n_confirmed"] for r in got] == [1, 1, 1, 1, 1, 1, 2, 0] and got[-1]["licence"] == "none"


# --- queries and pipeline ---


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.sql(ORACLES[name])
    columns = [c for c in sorted(df.columns)]
    assert columns == sorted(found.columns)
    want = sorted(tuple(str(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want


@tables
def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(77)
    words = ["".join(w) for w in rng.choice(list("abcdefgh"), (4000, 6))]
    text = lambda n=80: " ".join(rng.choice(words, n, replace=False))
    same, bad = text(), "too short"
    rows = [(None, bad, "aa", "web"), (None, text(), "aa", "web"), (5, bad, "aa", "web"), (5, text(), "aa", "web"), (None, same, "aa", "web"), (9, same, "aa", "web"), (9, text(), "aa", "books"), (None, text(), "aa", None), (1, text(), "aa", "web")]
    df = docs(spark, rows)
    shown = lambda d: sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["source"] or "") for r in d.collect()))
    want = lambda keep: sorted((r[0] is not None, r[0] or 0, r[1], r[3] or "") for r in keep)
    good = [r for r in rows if r[1] != bad]
    assert shown(corpus_pipeline.quality_rules(spark, df, "")) == want(good)
    once = [r for r in good if r[:2] != (None, same)]
    assert shown(corpus_pipeline.exact_duplicates(spark, docs(spark, good), "")) == want(once)
    # here the smallest stays
    assert shown(corpus_pipeline.near_duplicates(spark, docs(spark, good), "")) == want([r for r in good if r[:2] != (9, same)])
    # every row has words of its own, so each mixed text tells whose it is
    given = mixing.mixed_words(docs(spark, once)).agg({"taken": "sum"}).first()[0]
    mixed = corpus_pipeline.source_mix(spark, docs(spark, once), "").collect()
    assert given == sum(len(r["text"].split()) for r in mixed) and any(r["doc_id"] is None for r in mixed)
    for r in mixed:
        assert any(r["doc_id"] == i and r["source"] == src and Counter(r["text"].split()) <= Counter(t.split()) for i, t, _, src in once)


def test_pipeline(spark):
    from test_dedup import FOLD, brute_near
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    start = spark.read.parquet(f"{SF}/documents.parquet")
    stage, df = {}, start
    for name, f in cp.STAGES[:-1]:
        out = f(spark, df, SF)
        assert out.columns == start.columns
        stage[name] = df = spark.createDataFrame(out.collect(), start.schema)
    kept = {r["doc_id"] for r in quality.judge(start).where("kept").collect()}
    first = {r["doc_id"]: r["text"] for r in stage["quality rules"].collect()}
    assert set(first) == kept
    best = {}
    for i, t in first.items():
        best[t.translate(FOLD)] = max(i, best.get(t.translate(FOLD), -1))
    second = {r["doc_id"]: r["text"] for r in stage["exact dedup"].collect()}
    assert set(second) == set(best.values())
    third = {r["doc_id"] for r in stage["MinHash near-dedup"].collect()}
    assert third == {i for i, (_, c) in brute_near(second.items(), cp.NEAR_PERCENT).items() if i == c}
    mixed = stage["mixing sources to target weights"].collect()
    words = mixing.mixed_words(stage["MinHash near-dedup"]).agg(F.sum("taken")).first()[0]
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == words
    pieces = cp.run(spark, SF).collect()
    reference = Tokenizer.from_file(tokenizer_file(BPE))
    totals = Counter((r["doc_id"], len(reference.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == totals
    assert sum(p["length"] for p in pieces) == sum(n * k for (_, n), k in totals.items())
