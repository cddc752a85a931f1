"""Mixing sources to target weights by weighted fair queueing (operator 7).

Each source is a queue of its documents in shuffled order (by a hash), passed through again up to `most` times, and
served in packets of up to QUANTUM words. A packet's virtual finish time is the cumulative size of its source up to
and with it, divided by the source's target. All packets are range-sorted by finish time and served until the budget,
the sum of all sizes, is spent; the last packet is cut where it ends. So a source's words differ from its target by
about a packet.

Sums are in two levels: rows of a source by buckets of the shuffling hash, packets by partitions of the range. A source
with most of the rows spreads over many tasks; of the sorted packets only the partition where the budget ends is summed
row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Words of a packet.
QUANTUM = 64
#: Rows that a bucket of a source holds on average.
BUCKET_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """number, source, source_size, target, rows of sizes (source, source_size, rows): shares of the total by weight,
    capped at most times the size, the excess reshared by weight.

    Sources come in code-point order, null last, and take the weights in turn. They fill up to their caps in order of
    size by weight; the first that does not fill gives the unit of all others. One row for each source is windowed."""
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    own = sizes.withColumn("number", number).withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights)))
    order = W.orderBy(F.col("source_size") / F.col("weight"), "number")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own = own.withColumn("unit", left.cast("double") / heavy).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("weight") * F.col("unit") <= most * F.col("source_size"), F.col("place"))
    own = own.withColumn("level", F.min_by("unit", fits).over(W.partitionBy()))
    goal = F.least(F.col("weight") * F.col("level"), (most * F.col("source_size")).cast("double"))
    return own.select("number", "source", "source_size", goal.alias("target"), "rows")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (number of words, null text: 0), order (a hash of id and text that shuffles)."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), shuffling(docs).alias("order"))


def shuffling(docs: DataFrame) -> Column:
    """The place of a row in its source's shuffled order: the first 60 bits of an MD5 of id and text."""
    key = F.md5(F.concat_ws(" ", docs["doc_id"].cast("long").cast("string"), F.md5(docs["text"].cast("binary"))))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def queued(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, order) with number, source_size and target of their source, and end: the words of
    the source's queue up to and with the row."""
    key = F.floor((F.shiftright("order", 28).cast("double") / F.lit(float(1 << 32))) * F.ceil(F.col("rows") / F.lit(float(BUCKET_ROWS)))).cast("long")
    rows = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("doc_id", "size", "order", "number", "source_size", "target", key.alias("bucket"))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("number").orderBy("bucket")) - F.col("n")
    inside = F.sum("size").over(W.partitionBy("number", "bucket").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside).join(sums.select("number", "bucket", before.alias("before")), ["number", "bucket"])
    return rows.select("doc_id", "size", "order", "number", "source_size", "target", (F.col("inside") + F.col("before")).alias("end"))


_ORDER = ["time", "number", "at"]


def _packets(queue: DataFrame, latest: float | None, most: int, quantum: int) -> DataFrame:
    """Stored packets (number, end, turn, words, time, at, part) of all passes up to a virtual time, sorted by it over range
    partitions."""
    passes = F.least(F.lit(most), F.floor(F.col("target") * latest / F.col("source_size")).cast("int") + 1) if latest else F.lit(most)
    packets = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), passes - 1)))
    packets = packets.withColumn("packet", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.lit(float(quantum))).cast("int") - 1)))
    done = F.least((F.col("packet") + 1) * F.lit(quantum), F.col("size"))
    at = F.col("turn") * F.col("source_size") + F.col("end") - F.col("size") + done
    packets = packets.select("number", "end", "turn", (done - F.col("packet") * F.lit(quantum)).alias("words"), (at.cast("double") / F.col("target")).alias("time"), at.alias("at"))
    if latest:
        packets = packets.where(F.col("time") <= latest)
    ranged = packets.repartitionByRange(int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_ORDER)
    return common.stored(ranged.withColumn("part", F.spark_partition_id()), "packets")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, quantum: int = QUANTUM) -> DataFrame:
    """doc_id, order, size, source_size, target, copies, finish, taken of every row of docs (doc_id, text, source).

    taken: words of all packets served in all passes. copies: passes of which at least half of the words are served:
    times that a mix of whole documents has it. finish: of the first pass. Null sources form one source, the last;
    null texts have size 0 and are never taken; rows of equal id and text count apart; other columns are ignored. An
    empty table gives an empty result."""
    spark = docs.sparkSession
    rows = common.stored(measured(docs), "sizes")
    sources = common.stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most), "sources")
    queue = common.stored(queued(rows, sources), "queue")
    free = F.sum(F.when(F.col("target") < most * F.col("source_size"), F.col("target")))
    n, budget, open_ = sources.agg(F.count("*"), F.sum("source_size"), free).first()
    some = queue.where("size > 0")
    # Sources at their cap have no packets after time 1, so all that packets of n sources lack there, n * quantum words at
    # most, comes from the others, which together are served `open_` words in a unit of time.
    bounds = [1 + (n * quantum + 1) / open_, None] if open_ else [None]
    for latest in bounds:  # the second one only if a source that is not capped ends before the first
        served = _packets(some, latest, most, quantum)
        found = sorted((r["part"], r["n"]) for r in served.groupBy("part").agg(F.sum("words").alias("n")).collect())  # one row for each partition
        if latest is None or sum(words for _, words in found) >= budget:
            break
        common.discard(served)
    border, left = -1, budget or 0  # the partition where the budget ends, and what is left of it there
    for part, words in found:
        border = part
        if left <= words:
            break
        left -= words
    order = _ORDER
    spent = F.sum("words").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    cut = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(left) + F.col("words") - spent))
    last = served.where(F.col("part") == border).withColumn("words", cut)
    taken = served.where(F.col("part") < border).unionByName(last).where("words > 0")
    turns = [F.sum(F.when(F.col("turn") == e, F.col("words"))).alias(f"_{e}") for e in range(most)]
    # the words of a queue up to a row tell rows of one source with a size apart
    sums = taken.groupBy("number", "end").agg(*turns)
    found = some.join(sums, ["number", "end"], "left").unionByName(queue.where("size = 0"), True)
    words = [F.coalesce(F.col(f"_{e}"), F.lit(0)) for e in range(most)]
    copies = sum((F.when((w * 2 >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0) for w in words), F.lit(0)).cast("int")
    finish = F.try_divide(F.col("end").cast("double"), F.col("target"))
    return found.select("doc_id", "order", "size", "source_size", "target", copies.alias("copies"), finish.alias("finish"), sum(words, F.lit(0)).cast("long").alias("taken"))
