"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, which it may go
through twice.  A document's virtual finish time is the number of its
source's words up to and with it, divided by the source's target.  Documents
are taken in the order of their finish times until the budget is spent, so at
any point each source has given words in proportion to its target.

All running sums are made in levels: within slices of the shuffled order,
whose number follows the number of documents, over the slices of a block, and
over the blocks.  No task holds more than a few thousand rows of a source, its
totals of ``SLICE_ROWS`` times ``BLOCK_SLICES`` documents apart, where doc_ids
differ: rows of one doc_id, or without one, have one place in the order and so
are in one slice, which a task sorts.

The documents are not sorted by finish time as a whole: the order decides only
where the budget ends, and that place is found by ranging the finish times into
bins, which moves counts and not rows.  What is taken is the same.

Defined results: a null text has size 0; sources without words have target 0;
a null source comes last; a document of size 0 takes its place in the queue
and adds no word, and after the last word that is taken it is not taken; rows
that repeat are separate documents, but ``mixed`` has the least of rows of one
doc_id, source and text for all of them; where all texts are empty all targets
are 0 and the mix is empty; an empty table has no row.  A text is counted by
the engine's own expressions, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, col, free, least_rows, table, written

WEIGHTS = (5, 2, 1)
BUDGET = (3, 2)  # the share of all words that is mixed, as a fraction
REPEATS = 2
SLICE_ROWS = 400
BLOCK_SLICES = 4096
#: Copies of a row that are made at once.
COPIES = 1000


def _targets(sources: DataFrame, weights: tuple[int, ...], budget: tuple[int, int]) -> DataFrame:
    """(queue, source_size, target): the budget by weight, none above ``REPEATS`` times its size.

    Sources are filled in the order of size by weight.  The first of them
    that stays below its bound sets the level, and all after it have that
    level times their weight.  One row a source: this table is small.
    """
    turn = (F.row_number().over(Window.orderBy("queue")) - 1) % len(weights) + 1
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "queue")
    whole = F.sum("source_size").over(Window.partitionBy()) * budget[0]  # the budget times budget[1]
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (whole - before * (REPEATS * budget[1])).cast("double")
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # At its bound, unless the level that it and those after it would share is below it.
    bound = left * F.col("weight") >= (F.col("source_size") * (REPEATS * budget[1])).cast("double") * rest
    rows = rows.select("queue", "source_size", "weight", left.alias("left"), rest.alias("rest"), bound.alias("bound"))
    # Of the unbound, the first in the order has the largest rest.
    level = F.max(F.when(~F.col("bound"), F.struct("rest", "left"))).over(Window.partitionBy())
    shared = F.col("weight") * level["left"] / (level["rest"] * budget[1])
    target = F.when(F.col("bound"), (F.col("source_size") * REPEATS).cast("double")).otherwise(shared)
    return rows.select("queue", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    seed: int = 0,
    slice_rows: int = SLICE_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, finish, times and taken of every document.

    ``finish`` is the first virtual finish time; the second is later by
    source_size / target.  ``times`` says how often the mix has the document.
    ``keep`` names columns that go along, none of them named like a result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    doc_id = F.col("doc_id").cast("long")
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    sized = written(
        docs.select(
            doc_id.alias("doc_id"),
            named.alias("queue"),  # null comes last
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            turn.alias("turn"),
            *keep,
        ),
        "sizes",
    )
    slices = max(1, -(-sized.count() // slice_rows))
    part = F.conv(F.substring("turn", 1, 12), 16, 10).cast("double") / float(16**12)
    sized = sized.withColumn("slice", (part * slices).cast("long"))
    sums = written(sized.groupBy("queue", "slice").agg(F.sum("size").alias("words")), "slices")
    targets = written(_targets(sums.groupBy("queue").agg(F.sum("words").alias("source_size")), weights, budget), "targets")

    # The words of a source before each slice, and in the slice up to each document.
    blocks = sums.groupBy("queue", F.floor(F.col("slice") / BLOCK_SLICES).alias("block")).agg(F.sum("words").alias("words"))
    by_block = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("queue", "block", F.coalesce(F.sum("words").over(by_block), F.lit(0)).alias("ahead"))
    by_slice = Window.partitionBy("queue", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    within = sums.withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES)).withColumn("inside", F.coalesce(F.sum("words").over(by_slice), F.lit(0)))
    offsets = within.join(ahead, ["queue", "block"]).select("queue", "slice", (F.col("inside") + F.col("ahead")).alias("before"))
    inside = Window.partitionBy("queue", "slice").orderBy("turn", F.col("doc_id").asc_nulls_last(), "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    queued = sized.withColumn("words", upto).join(written(offsets, "offsets"), ["queue", "slice"])
    queued = queued.join(targets, "queue").withColumn("words", F.col("words") + F.col("before"))
    finish = F.when(F.col("target") > 0, F.col("words") / F.col("target"))
    second = F.when(F.col("target") > 0, (F.col("words") + F.col("source_size")) / F.col("target"))
    timed = written(queued.select("doc_id", "size", "turn", "source_size", "target", finish.alias("finish"), second.alias("second"), *keep), "queue")

    cut, times = _cut(timed, budget), F.lit(0)
    if cut:
        last = F.struct(F.lit(cut[0]), F.lit(cut[1]), F.lit(cut[2]).cast("long"))
        for c in ("finish", "second"):
            here = F.struct(F.col(c), F.col("turn"), F.coalesce("doc_id", F.lit(-1)))
            times = times + F.when(F.col(c).isNotNull() & (here <= last), 1).otherwise(0)
    return timed.withColumn("times", times).select(
        "doc_id", "size", "source_size", "target", "finish", "times", (F.col("size") * F.col("times")).alias("taken"), *keep
    )


def _cut(timed: DataFrame, budget: tuple[int, int], bins: int = 1000, rows: int = 50_000) -> tuple | None:
    """(finish, turn, doc_id) of the last document within the budget, in the order of finish times.

    The finish times are ranged into ``bins`` of equal width and their words
    summed; the bin in which the budget ends is ranged again until it holds
    few rows.  Only these are sorted.  Documents without words don't move the
    budget's end and are left aside; of the others a source has one at a time
    at most, so a bin can always be ranged further.
    """
    times = F.explode(F.array("finish", "second"))
    each = timed.select("size", "turn", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), times.alias("at")).where("at is not null")
    each, every = each.where("size > 0"), each
    words, low, high, n = each.agg(F.sum("size"), F.min("at"), F.max("at"), F.count(F.lit(1))).first()
    rest = (timed.agg(F.sum("size")).first()[0] or 0) * budget[0] // budget[1]
    if not n or rest >= words:
        found = every.agg(F.max(F.struct("at", "turn", "doc_id"))).first()[0]
        return tuple(found) if found else None
    here = each  # the rows among which the budget ends; ``rest`` is what is left of it there
    while n > rows and high > low:
        width = (high - low) / bins
        ranged = here.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("at") - low) / width).cast("int")))
        found = ranged.groupBy("bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        for b in sorted(found.collect()):  # ``bins`` rows at most
            if b["words"] > rest:
                break
            rest -= b["words"]
        if b["n"] == n:
            break
        n, low, high = b["n"], b["low"], b["high"]
        here = each.where((F.col("at") >= low) & (F.col("at") <= high))
    order = Window.orderBy("at", "turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = here.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= rest)
    found = within.agg(F.max(F.struct("at", "turn", "doc_id"))).first()[0]
    if found is None:  # the budget ends just before these rows
        found = each.where(F.col("at") < low).agg(F.max(F.struct("at", "turn", "doc_id"))).first()[0]
    return tuple(found) if found else None


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix has them, with the columns they came with.

    Rows that are equal in doc_id, source and text are one row with a count
    here, so nothing is joined with each of its copies.
    """
    keys = free([*docs.columns, "doc_id", "size", "source_size", "target", "finish", "times", "taken"], "__id", "__source", "__digest")
    keyed = docs.withColumns(
        {
            keys[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
            keys[1]: F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")),
            keys[2]: F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")),
        }
    )
    (often,) = free(keyed.columns, "__times")
    times = mix(keyed, keep=tuple(keys), **options).groupBy(*keys).agg(F.sum("times").alias(often)).where(F.col(often) > 0)
    joined = keyed.join(written(times, "times"), keys)
    one = least_rows(joined, docs.columns, *keys, more=(F.first(often).alias(often),))
    (turn,) = free(one.columns, "__turn")
    n = F.col(often).cast("long")
    many = one.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES))))
    here = F.least(F.lit(COPIES).cast("long"), n - F.col(turn) * COPIES)
    return many.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), here))).select(*[col(c) for c in docs.columns])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; columns of the operator follow."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")
