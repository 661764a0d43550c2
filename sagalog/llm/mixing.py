"""Mixing sources to target weights.

DataFrame and SQL functions only.  Every source's words, in an order that mixes
its documents, are packed into blocks of BLOCK words.  An output shard holds
SHARD_BLOCKS blocks; how many of them each source gives is a multinomial draw by
the sources' shares of all slots.  Prefix sums of the draws over the shards give
each shard its stretch of every source's slots; what the draws of a source lack
or have too many is settled in its last shards, so that its target is filled to
the word.  Slot q of a pass maps to a block by a pseudorandom permutation of the
source's block indices, and slots join the documents' shares of blocks by
(source, index).

The permutation is a swap-or-not shuffle: ROUNDS rounds, each of which either
keeps x or swaps it with K_r - x modulo n, by one bit of a hash of the larger of
the two.  It works for any n, needs no table and is undone by the rounds in
reverse.  A source is passed over twice at most, so no document gives more than
two times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, by_row, materialize

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MOST_PASSES = 2
BLOCK = 128
ROUNDS = 16
#: Blocks of an output shard, on average.
SHARD_BLOCKS = 1024
#: Ranges that the tickets of all slots are cut into, so that a draw finds its source by an equality join.
TICKET_BINS = 4096
#: Documents of a run of the numbering, on average; runs, or shards, whose sums are added up in one task.
RUN_DOCS, SPAN = 512, 1024
#: Slots that one row makes.
SLOT_CHUNK = 10_000


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Add source_size and target to (source, size) sums: weights by code point order of the sources, nulls last.

    The excess over MOST_PASSES times a source's size is shared again by
    weight until none is above.  That ends at one level L: a source gets the
    lesser of its limit and L times its weight, so L follows from prefix sums
    over the sources in the order of limit per weight.
    """
    # one row per source: small beside the documents, and the only rows that meet in one task
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(order - 1, F.lit(len(WEIGHTS))) + 1)
    per = per.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * MOST_PASSES).cast("double"))
    per = per.withColumn("ratio", F.col("most") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns({"total": F.sum("source_size").over(every) * TOTAL_PERCENT / 100.0, "all_weight": F.sum("weight").over(every)})
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source in this order that its level leaves below its limit sets the level of all
    per = per.withColumn("at", F.row_number().over(W.orderBy("ratio", F.col("source").asc_nulls_last())))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(every)["level"])
    return per.select("source", "source_size", "n_docs", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _round(x: str, r: str) -> str:
    other = f"pmod(keys[{r}] - {x}, n)"
    return f"if(ascii(md5(concat_ws('|', name, pass, {r}, greatest({x}, {other})))) % 2 = 1, {other}, {x})"


def permuted(x: str) -> str:
    """SQL for the image of x; columns keys, n, name and pass stand beside it."""
    return f"aggregate(sequence(0, {ROUNDS - 1}), cast({x} as bigint), (x, r) -> {_round('x', 'r')})"


def permuted_back(x: str) -> str:
    return f"aggregate(sequence({ROUNDS - 1}, 0, -1), cast({x} as bigint), (x, r) -> {_round('x', 'r')})"


def _plan(per: DataFrame) -> DataFrame:
    """One row per source and pass: blocks n, words to take, slots, round keys, and the slot of the last (short) block."""
    per = per.withColumns({"name": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "n": F.ceil(F.col("source_size") / BLOCK).cast("long"), "goal": F.floor(F.col("target")).cast("long")})
    out = per.where("goal > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
    out = out.withColumn("take", F.greatest(F.lit(0), F.least(F.col("source_size"), F.col("goal") - F.col("pass") * F.col("source_size")))).where("take > 0")
    out = out.withColumn("keys", F.expr(f"transform(sequence(0, {ROUNDS - 1}), r -> pmod(cast(conv(substr(md5(concat_ws('|', name, pass, 'key', r)), 1, 15), 16, 10) as bigint), n))"))
    out = out.withColumn("short", F.expr(permuted_back("n - 1")))
    # a slot may be a word short of a block only where the short block lies, so one more slot than take / BLOCK is enough
    return out.withColumn("slots", F.least(F.col("n"), F.floor(F.col("take") / BLOCK) + 2).cast("long"))


def _before(rows: DataFrame, keys: list[str], place: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same keys with a smaller ``place`` (unique in them).

    In two levels: inside ranges of SPAN places, and over the ranges.
    """
    rows = rows.withColumn("_span", F.floor(F.col(place) / SPAN))
    spans = rows.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    spans = spans.withColumn("_base", F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum(value).over(W.partitionBy(*keys, "_span").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return rows.join(spans.drop("_sum"), [*keys, "_span"]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_span", "_base", "_inside")


def shard_counts(plan: DataFrame) -> DataFrame:
    """(shard, name, pass, first, k): the multinomial draw of every shard, settled to the slots of each source and pass.

    Each of a shard's SHARD_BLOCKS places draws a ticket of all slots; who owns
    the ticket gives the place.  The last shard has the places that are left.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000)
    width = max(1, -(-total // TICKET_BINS))
    owned = plan.select("name", "pass", "slots", F.coalesce(F.sum("slots").over(W.orderBy("name", "pass").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("low"))
    owned = owned.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("slots") - 1) / width))))
    drawn = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / SHARD_BLOCKS).alias("shard"), F.pmod(F.xxhash64("id", F.lit("ticket")), F.lit(max(1, total))).alias("ticket"))
    drawn = drawn.withColumn("bin", F.floor(F.col("ticket") / width)).join(owned, "bin").where("ticket >= low and ticket < low + slots")
    counts = materialize(drawn.groupBy("shard", "name", "pass").agg(F.count("*").alias("k")), "draws")
    counts = _before(counts, ["name", "pass"], "shard", "k", "first")
    sums = counts.groupBy("name", "pass").agg(F.sum("k").alias("got"), F.count("*").alias("rows"))
    sums = materialize(plan.select("name", "pass", "slots").join(sums, ["name", "pass"], "left").fillna(0, ["got", "rows"]), "sums")
    last = F.lit(max(0, -(-total // SHARD_BLOCKS) - 1)).cast("long")
    lacking = sums.where("got < slots").select(last.alias("shard"), "name", "pass", F.col("got").alias("first"), (F.col("slots") - F.col("got")).alias("k"))
    held = attach(counts, sums, ["name", "pass"], "rows", "inner").where("first < slots")
    held = held.select("shard", "name", "pass", "first", F.least("k", F.col("slots") - F.col("first")).alias("k"))
    return held.unionByName(lacking)


def slots(plan: DataFrame) -> DataFrame:
    """One row per slot that takes words: name, pass, slot, block, shard and the words taken from the block's start."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialize(shard_counts(plan), "counts")
    rows = materialize(plan.join(counts.groupBy("name", "pass").agg(F.count("*").alias("rows")), ["name", "pass"]), "plan")
    chunks = attach(counts, rows, ["name", "pass"], "rows", "inner")
    chunks = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / SLOT_CHUNK)))).repartition(parts, "name", "pass", "first", "chunk")
    begin = F.col("first") + F.col("chunk") * SLOT_CHUNK
    out = chunks.withColumn("slot", F.explode(F.sequence(begin, F.least(F.col("first") + F.col("k"), begin + SLOT_CHUNK) - 1)))
    out = out.withColumn("block", F.expr(permuted("slot")))
    missing = F.col("n") * BLOCK - F.col("source_size")
    begin = F.col("slot") * BLOCK - F.when(F.col("short") < F.col("slot"), missing).otherwise(F.lit(0))
    length = BLOCK - F.when(F.col("short") == F.col("slot"), missing).otherwise(F.lit(0))
    out = out.withColumn("words", F.least(length, F.col("take") - begin)).where("words > 0")
    return out.select("name", "pass", "slot", "block", "shard", "words")


def numbered(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Add start, the words of the same source before a document: runs by a hash of the id, then a sum within each run.

    A run is about RUN_DOCS documents, so no source's documents meet in one task.
    """
    n = per.agg(F.sum("n_docs")).first()[0] or 0
    runs = max(1, -(-n // RUN_DOCS))
    rows = rows.withColumns({"name": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), "mixed": F.md5(F.concat_ws("|", F.lit("order"), F.col("doc_id")))})
    rows = rows.withColumn("run", F.expr(f"cast(conv(substr(mixed, 1, 8), 16, 10) as bigint) * {runs} div 4294967296"))
    sums = _before(rows.groupBy("name", "run").agg(F.sum("size").alias("run_size")), ["name"], "run", "run_size", "run_start")
    inside = W.partitionBy("name", "run").orderBy("mixed", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("in_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums.select("name", "run", "run_start"), ["name", "run"]).withColumn("start", F.col("run_start") + F.col("in_run")).drop("run", "run_start", "in_run", "mixed")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, targets) of the mix.

    documents: doc_id, source, size, name, start; one row per row of ``df``.
    pieces: doc_id, name, start, size, pass, shard, slot, from_word, words: a
    stretch of a document's words in a slot.  targets: one row per source.
    Null texts have no words; a null source is a source of its own (the last);
    rows with equal ids are documents of their own; where there are no words at
    all nothing is taken.  The same rows give the same mix.
    """
    rows = materialize(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    per = materialize(targets(rows), "targets")
    docs = materialize(numbered(rows, per), "numbered")
    drawn = slots(materialize(_plan(per), "plan"))
    share = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    # slots grow with the input although the plan they come from is tiny, so they are never broadcast
    pieces = share.join(drawn.hint("merge"), ["name", "block"])
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("words"))
    pieces = pieces.where(high > low).select("doc_id", "name", "start", "size", "pass", "shard", "slot", (low - F.col("start")).alias("from_word"), (high - low).alias("words"))
    return docs, pieces, per


def mixed_words(df: DataFrame, **cols: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``df``."""
    docs, pieces, per = mix(df, **cols)
    taken = pieces.groupBy("doc_id", "name", "start").agg(F.sum("words").alias("taken"))
    # documents without words share their start with the next one, which alone has words to take; a null id joins by the other columns
    out = docs.join(taken.withColumnsRenamed({"doc_id": "_id", "name": "_name", "start": "_start"}), F.expr("doc_id <=> _id and name = _name and start = _start"), "left")
    out = out.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    per = per.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).select("name", "source_size", "target")
    return out.join(per, "name").select("doc_id", "size", "source_size", "target", "taken")


def _in_parts(df: DataFrame, pieces: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``df`` once per document and ``keys``, with _parts (pieces in the order of the text), _words and the _tokens to cut from."""
    part = F.struct("from_word", "words", *[c for c in ("start", "shard", "name", "pass", "slot") if c not in keys])
    own = pieces.groupBy("doc_id", *[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("words").alias("_words"), F.max("size").alias("_size"), F.sort_array(F.collect_list(part)).alias("_parts"))
    both = df.join(own, "doc_id").withColumnRenamed(text_col, "_text")
    return both.withColumn("_tokens", F.regexp_extract_all("_text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1))


_CUT = "slice(_tokens, cast(p.from_word + 1 as int), cast(p.words as int))"


def mixed_documents(df: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: one row per document and pass, its text cut down to the words taken; columns as in ``df``.

    A document that a pass takes whole keeps its text as it is.  n_chars, if
    there, is counted anew.  Rows with equal or null ids are documents of their
    own; null and empty texts give no row, nor does an empty table.
    """

    def mixed(rows: DataFrame) -> DataFrame:
        _, pieces, _ = mix(rows, text_col=text_col, source_col=source_col)
        both = _in_parts(rows, pieces, ["pass"], text_col)
        cut = both.withColumn(text_col, F.expr(f"if(_words = _size, _text, array_join(flatten(transform(_parts, p -> {_CUT})), ''))"))
        if "n_chars" in df.columns:
            cut = cut.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType))
        return cut.select(*rows.columns)

    return by_row(mixed, df, "doc_id", text_col)


def mixed_blocks(df: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as output shards: shard, place (random order in the shard), source, pass, slot, words and text of every block.

    Ids must be unique and not null (``common.by_row``); write it partitioned or sorted by shard.
    """
    _, pieces, _ = mix(df, text_col=text_col, source_col=source_col)
    both = _in_parts(df.select("doc_id", F.col(text_col)), pieces, [], text_col)
    cut = both.select(F.explode(F.expr(f"transform(_parts, p -> struct(p.shard, p.name, p.pass, p.slot, p.start + p.from_word as at, p.words, array_join({_CUT}, '') as text))")).alias("p")).select("p.*")
    out = cut.groupBy("shard", "name", "pass", "slot").agg(F.sum("words").alias("words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    source = F.when(F.col("name") != "null", F.expr("substr(name, 2)"))
    return out.select("shard", F.xxhash64("name", "pass", "slot").alias("place"), source.alias("source"), "pass", "slot", "words", "text")
