"""Mixing sources to target weights.

Each source's words form one stream: its documents in a pseudorandom but fixed order, packed into
blocks of a fixed number of words, the last one shorter. The mix is a line of slots, cut into
output shards. Every slot of a shard draws its source by the sources' weights in the mix, so a
shard's counts of sources are one multinomial draw. The slots of a source are numbered from shard
to shard; a number goes through a pseudorandom permutation, one for each source and pass over it,
to a block index, by which the blocks are joined. Free draws miss the targets by their noise:
numbers beyond a source's quota, which the last shards hold, go to the sources that were drawn too
seldom, so every source meets its target to one word. Passes over a source differ by at most one
for any two full blocks; the short block comes at the end of a pass, and the last slot of a source
is cut to meet the target.

Targets share the total size by weight; one that exceeds `limit` times its source's size stops
there and the rest is shared again by weight: the level that fills all targets up to the total.

Running sums over documents, sources and shards are cut by ranges (common.running), so a source
with any share of the documents, and any number of sources, are many tasks.

Defined cases: null texts have size 0; documents of size 0 and of a null source or id are rows
like any other (a null source comes last in the order of sources); rows repeated in full are
ordered by an arbitrary but stable choice; a very long text is as many runs of words as blocks it
spans; if all sizes are 0 every target is 0; an empty table gives no row. Columns of other names
are not looked at by op3; mixed carries them, and names that begin with two underscores are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, running, saved, text_of

BLOCK = 512
SHARD_SLOTS = 1024
LIMIT = 3
WEIGHTS = (5, 2, 1)
#: Rounds of the permutation of indices.
ROUNDS = 24
#: Numbers in a stretch of the line of slots, by which draws find their source.
STRETCH = 1024


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the text that tells rows of one id apart."""
    words = F.regexp_count(text_of(), F.lit(f"[^{BLANKS}]+"))
    return documents.select("doc_id", "source", words.cast("long").alias("size"), F.xxhash64(text_of()).alias("mark"))


def _by_name() -> list[Column]:
    """The order of sources: by code point, null last."""
    return [F.col("source").isNull(), F.encode("source", "UTF-8")]


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target: one row for each source.

    A source stops at limit · size while its share by weight exceeds that. In the order of
    limit · size / weight, those that stop come first; the level that the others share follows
    from the sums before them.
    """
    sources = running(rows.groupBy("source").agg(F.sum("size").alias("source_size")), _by_name(), {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "top": F.col("source_size") * float(limit)}).drop("rank")
    ordered = saved(running(sources, [F.col("top") / F.col("weight"), *_by_name()], {"filled": F.col("top"), "heavier": F.col("weight")}))
    whole = ordered.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_size") - F.col("filled")) / (F.col("all_weight") - F.col("heavier"))
    shared = ordered.crossJoin(F.broadcast(whole)).withColumn("level", level)  # whole is one row
    # the first source whose share fits its limit sets the level for it and all after it
    fits = F.col("level") * F.col("weight") <= F.col("top")
    first = shared.where(fits).agg(F.min(F.struct(F.col("top") / F.col("weight"), "level"))["level"].alias("fitting"))
    out = ordered.crossJoin(F.broadcast(first))
    return out.select("source", "source_size", F.least(F.col("fitting") * F.col("weight"), "top").alias("target"))


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0 to size - 1, chosen by keys: a swap-or-not shuffle.

    Each round pairs x with (k - x) modulo size for a key k of the round, and a hash of the pair's
    larger number says whether the two change places. So every round is a permutation of any size.
    """
    size = F.greatest(size, F.lit(1).cast("long"))

    def once(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *keys), size) - x, size)
        return F.when(F.xxhash64(F.greatest(x, other), r, *keys) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, once)


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """sources with their full blocks, slots in a pass, words to take and slots, in one line of slots."""
    words = F.round("target").cast("long")
    full = F.floor(F.col("source_size") / block).cast("long")
    a_pass = F.ceil(F.col("source_size") / block).cast("long")
    some = sources.where("source_size > 0").withColumns({"words": words, "full": full, "a_pass": a_pass})
    rest = F.col("words") % F.col("source_size")
    n = F.floor(F.col("words") / F.col("source_size")).cast("long") * F.col("a_pass") + F.ceil(rest / block).cast("long")
    return running(some.withColumn("slots", n).where("slots > 0"), _by_name(), {"first_slot": F.col("slots")})


def _owners(numbers: DataFrame, at: Column, sources: DataFrame, first: Column, length: Column) -> DataFrame:
    """numbers, each with the row of sources whose stretch of the line, from first on, holds it."""
    spans = sources.withColumns({"__first": first, "__end": first + length}).where(length > 0)
    spans = spans.withColumn("__stretch", F.explode(F.sequence(F.floor(F.col("__first") / STRETCH), F.floor((F.col("__end") - 1) / STRETCH))))
    met = numbers.withColumns({"__at": at, "__stretch": F.floor(at / STRETCH)}).join(spans, "__stretch")
    return met.where((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__end"))).drop("__stretch", "__first", "__end")


def slots_drawn(quota: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """slot, shard, source, number: the multinomial draws of all shards, each source's slots numbered.

    What exceeds a source's quota goes on to the sources that have too few, so numbers run from 0
    to a source's slots - 1.
    """
    total = quota.agg(F.sum("slots")).first()[0] or 0
    line = quota.sparkSession.range(total).withColumnRenamed("id", "slot").withColumn("shard", F.floor(F.col("slot") / shard_slots))
    draw = F.pmod(F.xxhash64("slot", F.lit(seed)), F.lit(max(total, 1)))
    drawn = saved(_owners(line, draw, quota.select("source", "first_slot", "slots"), F.col("first_slot"), F.col("slots")).select("slot", "shard", "source"))
    counts = drawn.groupBy("shard", "source").agg(F.count("*").alias("n"))
    starts = running(counts, [F.col("shard")], {"before": F.col("n")}, within="source").withColumnsRenamed({"shard": "c_shard", "source": "c_source"})
    within = F.row_number().over(Window.partitionBy("shard", "source").orderBy("slot")) - 1  # a shard's slots at most
    met = drawn.withColumn("within", within).join(starts, (F.col("shard") == F.col("c_shard")) & F.col("source").eqNullSafe(F.col("c_source")))
    numbered = met.select("slot", "shard", "source", (F.col("before") + F.col("within")).alias("number"))
    sums = counts.groupBy(F.col("source").alias("d_source")).agg(F.sum("n").alias("n"))
    gaps = quota.join(sums, F.col("source").eqNullSafe(F.col("d_source")), "left").select("source", "slots", F.coalesce("n", F.lit(0)).alias("n"))
    over, under = (F.greatest(x, F.lit(0)) for x in (F.col("n") - F.col("slots"), F.col("slots") - F.col("n")))
    gaps = saved(running(gaps, _by_name(), {"over_before": over, "under_before": under}))
    own = gaps.select(F.col("source").alias("o_source"), "slots", "over_before")
    placed = saved(numbered.join(own, F.col("source").eqNullSafe(F.col("o_source"))).drop("o_source"))
    kept = placed.where("number < slots").select("slot", "shard", "source", "number")
    extra = placed.where("number >= slots").select("slot", "shard", (F.col("over_before") + F.col("number") - F.col("slots")).alias("extra"))
    moved = _owners(extra, F.col("extra"), gaps.select("source", "n", "under_before", under.alias("under")), F.col("under_before"), F.col("under"))
    return kept.unionByName(moved.select("slot", "shard", "source", (F.col("n") + F.col("extra") - F.col("under_before")).alias("number")))


def draws(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """shard, place, source, pass, block, keep: what fills each slot of each output shard.

    keep: how many of the block's words the slot takes.
    """
    quota = saved(quotas(sources, block))
    terms = quota.withColumnRenamed("source", "q_source")
    drawn = slots_drawn(quota, shard_slots, seed).join(terms, F.col("source").eqNullSafe(F.col("q_source")))
    drawn = drawn.withColumns({"pass": F.floor(F.col("number") / F.col("a_pass")), "at": F.col("number") % F.col("a_pass")})
    key = F.xxhash64("source", F.lit(seed))
    index = F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.col("full"), key, F.col("pass"))).otherwise(F.col("full"))
    length = F.least(F.lit(block), F.col("source_size") - index * block)
    last = F.col("words") - F.col("pass") * F.col("source_size") - F.col("at") * block
    return drawn.select(
        "shard",
        (F.col("slot") % shard_slots).alias("place"),
        "source",
        "pass",
        index.alias("block"),
        F.when(F.col("number") == F.col("slots") - 1, F.least(length, last)).otherwise(length).alias("keep"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """rows with start, the place of their first word in their source's stream."""
    order = [F.xxhash64("doc_id", "mark"), F.col("doc_id"), F.col("mark"), F.col("row")]
    return running(rows, order, {"start": F.col("size")}, within="source")


def takes(rows: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, doc_id, mark, size, shard, pass, from, words: the runs of words that the mix takes of each row."""
    spans = rows.where("size > 0").withColumn(
        "own_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    drawn = drawn.select("shard", F.col("source").alias("s"), "pass", "block", "keep")
    met = spans.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("own_block") == F.col("block")))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    words = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("keep")) - begin
    return met.select("row", "doc_id", "mark", "size", "shard", "pass", (begin - F.col("start")).alias("from"), words.alias("words")).where("words > 0")


def planned(documents: DataFrame, block: int = BLOCK, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized rows, their sources' targets and the runs of words to take."""
    rows = saved(sized(documents).withColumn("row", F.monotonically_increasing_id()))
    sources = saved(targets(rows))
    return rows, sources, takes(placed(rows), draws(sources, block, seed=seed), block)


def op3(documents: DataFrame) -> DataFrame:
    """Size, source size, target and words taken of every document, and the first and the number of
    the output shards that hold some of them."""
    rows, sources, taken = planned(documents)
    sums = taken.groupBy("row", "shard").agg(F.sum("words").alias("words"))
    sums = sums.groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.count("*").alias("n_shards"))
    named = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (
        rows.join(named, F.col("source").eqNullSafe(F.col("s")))
        .join(sums, "row", "left")
        .select("doc_id", "source", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")), "first_shard")
    )


def mixed(documents: DataFrame, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each pass over a document.

    A pass that takes all words has the text as it is, another the words taken, each with the
    blanks after it; n_chars, where there is one, follows. Rows equal in doc_id and text meet:
    what is taken of them comes from one of them.
    """
    _, _, taken = planned(documents, block, seed)
    runs = F.sort_array(F.collect_list(F.struct("row", "from", "words"))).alias("__runs")
    copies = taken.groupBy("doc_id", "mark", "row", "size", "pass").agg(runs, F.sum("words").alias("__words"))
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__of"), F.col("size").alias("__size"), "__runs", "__words")
    marked = documents.withColumn("__mark", F.xxhash64(text_of())).dropDuplicates(["doc_id", "__mark"])
    met = marked.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__of")))
    words = F.regexp_extract_all(text_of(), F.lit(f"[^{BLANKS}]+[{BLANKS}]*"), F.lit(0))
    parts = F.flatten(F.transform("__runs", lambda run: F.slice(F.col("__all"), (run["from"] + 1).cast("int"), run["words"].cast("int"))))
    met = met.withColumn("__all", F.when(F.col("__words") < F.col("__size"), words))
    out = met.withColumn("text", F.when(F.col("__words") < F.col("__size"), F.array_join(parts, "")).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
