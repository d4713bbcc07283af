"""Mixing sources to target weights, in DataFrame operations only.

Every source's words form one stream, cut into blocks of a fixed length.  Output
slots are filled shard by shard from multinomial source counts, the j-th slot of
a source is mapped to a block by that source's pseudorandom permutation of block
indexes, and blocks meet documents by an equi-join on (source, block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, count_words, only, read, spread, sum_before, with_keys

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20251
#: Facts of at most so many sources (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 4096
#: Rounds of the index permutations, and how often one may step outside before it is an error.
ROUNDS, WALKS = 6, 64
#: Copies of one row beyond this number are dealt to several tasks.
CHUNK = 4096


def _unit(*of: Column) -> Column:
    """Uniform in [0, 1) from hashed columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") * F.lit(2.0**-53)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share
    the sum of all sizes; no target passes MAX_REPEATS times its source's size.
    The excess, reshared by weight until none is above, equals one cut: ordered
    by cap/weight, the first k sources sit at their caps and the others get one
    common level times their weights.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("n", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((F.col("n") - 1) % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(MAX_REPEATS))).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    before = Window.orderBy("ratio", "n").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({
        "total": F.sum("source_size").over(all_rows).cast("double"),
        "weights": F.sum("weight").over(all_rows),
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    w = w.withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
    w = w.withColumn("cut", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(all_rows))
    free = (F.col("ratio") > F.col("cut.ratio")) | ((F.col("ratio") == F.col("cut.ratio")) & (F.col("n") >= F.col("cut.n")))
    return w.select("source", F.col("n").alias("source_no"), "source_size", "weight", F.when(free, F.col("cut.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"), "total")


def _spread(counts: DataFrame, count: str, chunk: int = CHUNK) -> DataFrame:
    """One row per unit of ``count``, numbered ``k`` from 0; first by chunks, dealt out, so one large count feeds many tasks."""
    chunks = counts.where(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk))))
    dealt = chunks.repartition(F.xxhash64("source_no", "chunk"))
    return dealt.withColumn("k", F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("chunk") * chunk + (chunk - 1), F.col(count) - 1)))).drop("chunk")


def _rectangle(n: Column) -> tuple[Column, Column]:
    """(rows, columns) of a rectangle of at least n cells, too many by less than its rows, about the root of n."""
    side = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    rows = F.when(side * side < n, side + 1).otherwise(side)
    return rows, F.call_function("div", n + rows - 1, rows)


def _permuted(k: Column, n: Column, rows: Column, cols: Column, key: Column) -> Column:
    """k-th value of a keyed permutation of 0..n-1: a Feistel network over the rectangle of n, walked until inside.

    A walk ends after a step or two, and within WALKS steps for any n below WALKS
    squared.  Numbers stay below twice n.
    """
    long = lambda x: F.lit(x).cast("long")

    def turn(s: Column, i: Column) -> Column:
        left = (s["l"] + F.pmod(F.xxhash64(s["r"], key, i), rows)) % rows
        return F.struct(left.alias("l"), ((s["r"] + F.pmod(F.xxhash64(left, key, -i), cols)) % cols).alias("r"))

    def step(x: Column) -> Column:
        halves = F.struct(F.call_function("div", x, cols).alias("l"), (x % cols).alias("r"))
        return F.aggregate(F.sequence(F.lit(SEED), F.lit(SEED + ROUNDS // 2 - 1)), halves, turn, lambda s: s["l"] * cols + s["r"])

    outside = F.raise_error(F.lit("the index permutation stays outside")).cast("long")
    walk = lambda x, i: F.when((i > 0) & (x < n), x).otherwise(step(x))
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), k + long(0), walk, lambda x: F.when(x < n, x).otherwise(outside))


def streams(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the source's word stream (doc_id, source, size, start), and (source, source_size).

    The order is pseudorandom by a hash of id, source and text, so it depends on
    the rows alone, not on files or tasks; rows equal in all are counted first
    and then stand one behind the other.  Offsets take two steps: running sums
    inside pieces of about sqrt(rows) rows, and over the piece totals of each
    source; so no task holds a whole source.
    """
    key = ["doc_id", "source", "size", "text_hash"]
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    items = scratch.keep(rows.groupBy(*key).agg(F.count("*").alias("copies")), "sizes")
    n, most = items.agg(F.count("*"), F.max("copies")).first()
    pieces = max(1, math.isqrt(n))
    salted = lambda salt: F.xxhash64(F.lit(salt), F.coalesce("doc_id", F.lit(NULL_ID)), F.coalesce("source", F.lit("")), F.col("source").isNull(), "text_hash")
    items = items.withColumns({"order": salted(SEED), "piece": F.pmod(salted(SEED + 2), F.lit(pieces)), "words": F.col("size") * F.col("copies")})
    names = items.groupBy("source").agg(F.sum("words").alias("source_size"))
    totals = items.groupBy("source", "piece").agg(F.sum("words").alias("piece_size"))
    over = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("piece_start", F.coalesce(F.sum("piece_size").over(over), F.lit(0)))
    inside = Window.partitionBy("source", "piece").orderBy("order", *key).rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    same = (F.col("r.piece") == F.col("t.piece")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    placed = items.alias("r").join(totals.hint("merge").alias("t"), same).select("doc_id", "r.source", "size", "copies", (F.col("piece_start") + F.col("inside")).alias("first"))
    if most and most > CHUNK:
        placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK)))).repartition(F.xxhash64("source", "first", "chunk"))
        copy = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("chunk") * CHUNK + (CHUNK - 1), F.col("copies") - 1)))
    else:
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    placed = placed.select("doc_id", "source", "size", "first", copy.alias("copy")).select("doc_id", "source", "size", (F.col("first") + F.col("copy") * F.col("size")).alias("start"))
    return scratch.keep(placed, "placed"), names


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Mix whole sources to their targets; returns (slots, documents).

    ``slots``: one row per block of the mix: shard, slot, source, source_no,
    epoch, block, words; the mix in reading order is (shard, slot).
    ``documents``: one row per input row: doc_id, size, source_size, target,
    taken (words the mix takes from it, repeats counted).

    A document's size is its number of words; null or wordless texts have 0 and
    are never taken.  A null source is a source of its own, an empty name
    another.  Ids need not be unique.  Each source gives exactly round(target)
    words: whole passes over its stream, then blocks in permuted order, the last
    one cut.  So no word is taken more than MAX_REPEATS times.  Reruns agree, and
    so do other layouts of the same rows in files and tasks.  Texts of any length
    are counted whole; a row that comes many times is that many rows.  An empty
    table gives two empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    B = block_words
    placed, names = streams(spread(only(docs, doc_id=id_col, text=text_col, source=source_col)), scratch)
    sources = source_targets(names).withColumns({
        "goal": F.round("target").cast("long"),
        "full": F.floor(F.col("source_size") / B),
        "blocks": F.ceil(F.col("source_size") / B),
    })
    rows, cols = _rectangle(F.col("full"))
    sources = sources.withColumns({"rows": rows, "cols": cols})
    # An epoch is a pass over all blocks: the full ones permuted, the short one at its end.
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide("goal", "source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    sources = sources.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / B))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = scratch.keep(sources.withColumn("base", F.coalesce(F.sum("slots").over(before), F.lit(0))), "sources")
    known = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources

    slots = scratch.keep(_blocks(_draw(sources, shard_slots, scratch), known, B), "blocks")
    uses = slots.groupBy("source_no", "block").agg(F.sum(F.col("whole").cast("long")).alias("passes"), F.max(F.when(~F.col("whole"), F.col("words")).otherwise(F.lit(0))).alias("part"))
    facts = known.select(F.col("source").alias("name"), "source_no", "source_size", "target")
    rows = placed.join(facts, placed["source"].eqNullSafe(facts["name"])).drop("source", "name")
    some, end = rows.where("size > 0"), F.col("start") + F.col("size")
    # Within a source, a row with words is told by its start.
    pieces = some.select("source_no", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / B), F.floor((end - 1) / B))).alias("block"))
    got = pieces.join(uses.hint("merge"), ["source_no", "block"])
    low, high = F.greatest(F.col("start") - F.col("block") * B, F.lit(0)), F.least(F.col("end") - F.col("block") * B, F.lit(B))
    taken = got.groupBy("source_no", "start").agg(F.sum((high - low) * F.col("passes") + F.greatest(F.least(high, F.col("part")) - low, F.lit(0))).alias("taken"))
    shown = ["doc_id", "size", "source_size", "target"]
    documents = some.join(taken.hint("merge"), ["source_no", "start"], "left").select(*shown, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    documents = documents.unionByName(rows.where("size = 0").select(*shown, F.lit(0).cast("long").alias("taken")))
    return slots.select("shard", "slot", "source", "source_no", "epoch", "block", "words"), documents


def _draw(sources: DataFrame, shard_slots: int, scratch: Scratch) -> DataFrame:
    """Output slots and what fills them: shard, slot, source_no, k (the source's k-th block use).

    Every slot draws an entry of the table of all block uses, with replacement,
    so a shard's source counts are multinomial with the targets as weights.  The
    j-th slot that draws a source gets its j-th block use.  Where a source is
    drawn more often than it has uses, the surplus slots go, one by one, to the
    uses of sources that were drawn too seldom; so every source's total is exact.
    """
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    uses = _spread(sources, "slots").select("source_no", (F.col("base") + F.col("k")).alias("entry"))
    draws = spark.range(n).select((F.floor(F.col("id") / shard_slots)).alias("shard"), (F.col("id") % shard_slots).alias("slot"), F.pmod(F.xxhash64("id", F.lit(SEED + 3)), F.lit(max(n, 1))).alias("entry"))
    drawn = scratch.keep(draws.join(uses.hint("merge"), "entry").select("shard", "slot", "source_no"), "draws")

    counts = drawn.groupBy("shard", "source_no").agg(F.count("*").alias("count"))
    counts = sum_before(counts, ["source_no"], "shard", "count", "before", span=1024)
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "source_no").orderBy("slot")) - 1)
    ranked = ranked.join(counts.hint("merge"), ["shard", "source_no"]).select("shard", "slot", "source_no", (F.col("before") + F.col("rank")).alias("j"))

    totals = drawn.groupBy("source_no").agg(F.count("*").alias("drawn"))
    by_no = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    balance = sources.select("source_no", "slots").join(totals, "source_no", "left").select("source_no", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    balance = balance.withColumns({"over": F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), "under": F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))})
    balance = scratch.keep(balance.withColumns({"over_base": F.coalesce(F.sum("over").over(by_no), F.lit(0)), "under_base": F.coalesce(F.sum("under").over(by_no), F.lit(0))}), "balance")
    facts = balance.select("source_no", "slots", "over_base")
    ranked = ranked.join(F.broadcast(facts) if facts.count() <= BROADCAST_SOURCES else facts, "source_no")
    fits = ranked.where("j < slots").select("shard", "slot", "source_no", F.col("j").alias("k"))
    surplus = ranked.where("j >= slots").select("shard", "slot", (F.col("over_base") + F.col("j") - F.col("slots")).alias("index"))
    wanted = _spread(balance, "under").select((F.col("under_base") + F.col("k")).alias("index"), "source_no", (F.col("drawn") + F.col("k")).alias("k"))
    return scratch.keep(fits.unionByName(surplus.join(wanted.hint("merge"), "index").drop("index")), "slots")


def _blocks(filled: DataFrame, known: DataFrame, B: int) -> DataFrame:
    """Adds epoch, block, words and whole (no word of the block is cut) to slots."""
    s = filled.join(known.select("source", "source_no", "source_size", "full", "blocks", "epochs", "rest", "rows", "cols"), "source_no")
    at = F.col("k") % F.col("blocks")
    s = s.withColumn("epoch", F.floor(F.col("k") / F.col("blocks")))
    s = s.withColumn("block", F.when(at < F.col("full"), _permuted(at, F.col("full"), F.col("rows"), F.col("cols"), F.col("source_no"))).otherwise(F.col("full")))
    length = F.least(F.lit(B), F.col("source_size") - F.col("block") * B)
    s = s.withColumn("words", F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - at * B)))
    return s.withColumn("whole", F.col("words") == length)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))[1]


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` repeated as the mix takes them, whole documents each time.

    A document of which the mix takes ``taken`` of ``size`` words appears
    taken/size times on average, rounded up or down by a hash of its id, so each
    source's words stay near its target and nothing appears more than three
    times.  Rows that share a doc_id, or have none, share this number.  Texts
    without words, null ones too, have nothing to take and do not appear.  Texts
    of any length stay whole.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "mix-stage")
    share = mix(docs)[1].groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("mixed_id")).agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("share"))
    times = F.floor(F.coalesce("share", F.lit(0.0)) + _unit(F.col("mixed_id"), F.lit(SEED + 4))).cast("int")
    share = scratch.keep(share.select("mixed_id", times.alias("times")), "times")
    keyed = with_keys(docs, id=F.coalesce(docs["doc_id"], F.lit(NULL_ID)), words=count_words(docs["text"]))
    # A row a document: never a table to broadcast, so texts move once, by id, at every size.
    joined = keyed.where("words > 0").join(share.hint("merge"), F.col("id") == F.col("mixed_id")).where("times > 0")
    return joined.select("record", F.explode(F.sequence(F.lit(1), F.col("times")))).select("record.*")
