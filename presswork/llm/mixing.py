"""Mixing sources to target weights by weighted fair queueing.

Every document, in an order shuffled by a hash, gets a virtual finish time: the
words of its source up to and including it, divided by the source's target. A
document longer than ``PACKET`` words is served in packets of that many, each
with a finish time of its own, so that no source waits for one long document; a
source may be gone through ``EPOCHS`` times, the second pass follows the first.
All packets are then sorted by finish time over the whole corpus, and the mix is
the front of that order: it is cut where the words served reach the total
budget. What a document gives is what its packets before the cut hold.

Both running sums are two-level. Within a source, documents fall into ranges of
the shuffled order; in the global order, packets fall into slices of virtual
time, which hold about the same number of words each, since the sources are
served in proportion. Only the sums of ranges and slices are carried on, so a
source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import SPACE_WORD, materialize

#: Weights that the sources take in turn, by name.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
BUDGET = 1.5
#: How often a source can be used up.
EPOCHS = 2
#: Words of a packet.
PACKET = 256
#: Leading hex digits of the shuffled order that make a range: 4096 ranges of each source.
RANGE_DIGITS = 3
#: Slices of virtual time at least, and documents for which there is one more.
SLICES, SLICE_ROWS = 4096, 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Of each source (null is one, the last): source_size and target.

    Targets share ``budget`` times all words by weight; none exceeds ``epochs``
    times its source, what is over goes to the others by weight. In the order of
    size over weight the sources that hit their cap come first, so one pass with
    running sums settles all of them. The sums run over one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    # Beyond the last full source all share one level.
    last = F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(every)["level"]
    by = by.withColumn("rank", F.row_number().over(fill)).withColumn("last", last)
    target = F.when(F.col("full") | F.col("last").isNull(), F.col("cap").cast("double")).otherwise(F.col("last") * F.col("w"))
    return by.select("source", "source_size", target.alias("target"))


def sized(documents: DataFrame) -> DataFrame:
    """nth (a number of the row), doc_id, source, size, turn (the shuffled order) of all rows, written once.

    Texts are read here and nowhere else; all the rest works on this narrow table.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    turn = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = documents.select("doc_id", "source", size.alias("size"), turn.alias("turn"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("nth"), "*"), "sizes")


def with_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``rows`` (see :func:`sized`) with source_size, target and ``start``: the words of the source before each."""
    targets = source_targets(rows, weights, budget, epochs)
    rows = rows.withColumn("range", F.substring("turn", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).drop("words")
    ranges = ranges.join(targets, ranges["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inside = Window.partitionBy("source", "range").orderBy("turn", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")))
    return both.select("d.nth", "d.doc_id", "d.source", "d.size", "d.turn", "source_size", "target", (F.col("inside") + F.col("before")).alias("start"))


def stream(rows: DataFrame, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """The mix in its order, of ``rows`` (see :func:`with_targets`; stored, not a plan to run twice).

    nth, doc_id, source, epoch, packet, words, finish, and ``at``: the words of
    the mix before the packet. The order is that of ``at``; sorting by it sorts
    what is already in ranges of it. The last packet may be cut.
    """
    slices = max(SLICES, rows.count() // SLICE_ROWS)
    served = rows.where(F.col("size") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    served = served.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet))))
    served = served.withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("packet") * packet))
    done = F.col("start") + F.col("epoch") * F.col("source_size") + F.col("packet") * packet + F.col("words")
    served = served.withColumn("finish", F.try_divide(done, F.col("target")))
    # Up to twice the end of the mix slices are even; what comes later hardly counts.
    late = F.floor(F.log2(F.greatest("finish", F.lit(2.0))) * 64) + 2 * slices
    served = served.withColumn("slice", F.when(F.col("finish") < 2, F.floor(F.col("finish") * slices)).otherwise(late).cast("long"))
    served = served.select("slice", "finish", "turn", "nth", "doc_id", "source", "epoch", "packet", "words")
    # The budget is the sum of the targets, in whole words.
    total = rows.select("source", "target").distinct().agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    sums = served.groupBy("slice").agg(F.sum("words").alias("in_slice"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # Slices that begin after the cut drop out before anything is sorted.
    sums = sums.withColumn("before", F.coalesce(F.sum("in_slice").over(upto), F.lit(0))).where(F.col("before") < total).drop("in_slice")
    order = Window.partitionBy("slice").orderBy("finish", F.col("source").isNull(), "source", "turn", "epoch", "packet", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = served.join(sums, "slice").withColumn("at", F.coalesce(F.sum("words").over(order), F.lit(0)) + F.col("before")).where(F.col("at") < total)
    words = F.least(F.col("words"), F.lit(total) - F.col("at"))
    return placed.select("nth", "doc_id", "source", "epoch", "packet", words.alias("words"), "finish", "at")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken.

    ``taken`` is the words the mix takes from the document, repeats counted. A
    null or empty text has size 0 and gives nothing; a null source is a source of
    its own; a null id is ordered as ''. Rows that repeat are documents of their
    own. An empty table gives an empty result.
    """
    rows = materialize(with_targets(sized(documents), weights, budget, epochs), "targets")
    taken = stream(rows, epochs).groupBy("nth").agg(F.sum("words").alias("taken"))
    out = rows.join(taken, "nth", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixing_report(documents: DataFrame) -> DataFrame:
    """Sizes, targets and words taken of all documents (query ``op3``)."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
MIXING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w, source_size * 2 AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS rank,
        ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source IS NULL, source)),
f AS (SELECT *, level * w >= cap AS full_ FROM l),
t AS (SELECT source, source_size, CASE WHEN full_ OR (SELECT count(*) FROM f WHERE NOT full_) = 0 THEN cap::DOUBLE
        ELSE (SELECT arg_min(level, rank) FROM f WHERE NOT full_) * w END AS target FROM f),
c AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, unnest([0, 1]) AS epoch FROM c WHERE size > 0),
p AS (SELECT *, unnest(generate_series(0, (size - 1) // 256)) AS packet FROM e),
q AS (SELECT *, least(256, size - packet * 256)::BIGINT AS words FROM p),
g AS (SELECT nth, words, coalesce(sum(words) OVER (ORDER BY (start + epoch * source_size + packet * 256 + words)::DOUBLE / target, source IS NULL, source, turn, epoch, packet, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM q),
b AS (SELECT sum(floor(target))::BIGINT AS budget FROM t),
k AS (SELECT nth, sum(greatest(0, least(words, budget - pos)))::BIGINT AS taken FROM g, b GROUP BY nth)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (nth)
"""
