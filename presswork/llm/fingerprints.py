"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut at line ends and sentence ends; a sentence of more than ``LONG``
characters is cut at words that a hash chooses. Every piece, however many a text
has, gets a 40-bit digest (with the number of its occurrence, so that repeats
count) and a 24-bit check, together one word.

A table has cells in three parts; a word goes into one cell of each part, by
exclusive or. Tables of two versions subtract the same way; what both hold
cancels out. A cell whose check fits holds a single word: peeling takes it out
of its other cells until none is left, and gives back the digests that only one
version has.

The fingerprint of a text is its number of pieces and its table of ``CELLS``
cells, the same for all texts, so any two can be subtracted. If the difference
is too much for that many cells, larger tables are built: the words of both
versions fall into parts by their value, each with a table for as many words as
it holds, and a part that still does not peel is tried again with twice the
cells, ``TRIES`` times; after that its words are compared one by one.

All of it runs on built-in functions; a table is an array of 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import LAST, materialize, numbered

#: Cells of a fingerprint (a multiple of 3).
CELLS = 24
#: Characters from which a sentence is cut into runs of about 2**``RUN_LEVEL`` words.
LONG = 400
RUN_LEVEL = 4
#: Words of both versions in a part, about.
PART_WORDS = 4
#: Tables tried for a part, each with twice the cells.
TRIES = 6
#: Rounds of peeling; a table that peels takes few.
ROUNDS = 30
#: Text that one range of ids holds, about.
RANGE_BYTES = 2 << 20
#: Ranges of ids by quantile, at most; more ranges divide these evenly.
QUANTILES = 256
#: Ranges that are looked through in one task for the range that follows.
RING = 1024

_SENTENCE = r"[\n\r]+|(?<=[.!?])\x20+"
_WORDS = "array<bigint>"
_CHECK = (1 << 24) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _word(digest: Column) -> Column:
    key = F.shiftrightunsigned(digest, 24)
    return F.shiftleft(key, 24).bitwiseOR(F.xxhash64(key).bitwiseAND(F.lit(_CHECK)))


def _runs(hashes: Column) -> Column:
    """Digests of runs of hashes that end where a hash is 0 modulo 2**``RUN_LEVEL``."""

    def cut(s: Column, h: Column) -> Column:
        def put(now: Column) -> Column:
            ends = F.shiftright(h, 7).bitwiseAND(F.lit((1 << RUN_LEVEL) - 1)) == 0
            return F.struct(F.when(ends, _zero()).otherwise(now).alias("now"), F.when(ends, F.concat(s["out"], F.array(now))).otherwise(s["out"]).alias("out"))

        return _let(F.xxhash64(s["now"], h), put)

    begin = F.struct(_zero().alias("now"), F.array().cast(_WORDS).alias("out"))
    return F.aggregate(hashes, begin, cut, lambda s: F.when(s["now"] == 0, s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))


def pieces(text: Column) -> Column:
    """Words of all pieces of a text: a set, repeats are numbered; in time linear in them but for sorting."""

    def cut(p: Column) -> Column:
        runs = _runs(F.transform(F.split(p, r"\x20+"), lambda w: F.xxhash64(w)))
        return F.when(F.length(p) > LONG, runs).otherwise(F.array(F.xxhash64(_zero(), F.xxhash64(p))))

    def number(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def run(b: Column) -> Callable[[Column, Column], Column]:
            return lambda i, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), F.size(s)) - i - 1), lambda k: _word(F.xxhash64(F.get(s, i), k)))

        alone = F.transform(s, lambda p: _word(F.xxhash64(p, F.lit(0))))
        repeats = _let(begins, lambda b: F.flatten(F.transform(b, run(b))))
        return F.when(F.size(F.array_distinct(s)) == F.size(s), alone).otherwise(repeats)

    every = F.filter(F.split(text, _SENTENCE), lambda p: p != "")
    return _let(F.sort_array(F.flatten(F.transform(every, cut))), number)


def table(words: Column, cells: Column, attempt: Column) -> Column:
    """The table of a set of words: three parts of ``cells`` / 3 cells, end to end."""
    width = (cells / 3).cast("int")

    def part(j: int) -> Column:
        placed = F.transform(words, lambda w: F.struct(w.alias("w"), F.pmod(F.xxhash64(w, attempt, F.lit(j)), width.cast("bigint")).cast("int").alias("c")))
        return _let(placed, lambda p: F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.aggregate(p, _zero(), lambda x, e: F.when(e["c"] == c, x.bitwiseXOR(e["w"])).otherwise(x))))

    return F.concat(part(0), part(1), part(2))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell; both tables have as many cells and come from the same attempt."""
    return F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))


def peel(difference: Column, cells: Column, attempt: Column) -> Column:
    """done, words: what only one side has, if all came out."""

    def pure(v: Column) -> Column:
        return (v != 0) & (v.bitwiseAND(F.lit(_CHECK)) == F.xxhash64(F.shiftrightunsigned(v, 24)).bitwiseAND(F.lit(_CHECK)))

    def round_(s: Column, _: Column) -> Column:
        def take(p: Column) -> Column:
            left = F.when(F.size(p) == 0, s["cells"]).otherwise(subtract(s["cells"], table(p, cells, attempt)))
            return F.struct(left.alias("cells"), F.concat(s["out"], p).alias("out"), (F.size(p) > 0).alias("more"))

        return F.when(s["more"], _let(F.array_distinct(F.filter(s["cells"], pure)), take)).otherwise(s)

    begin = F.struct(difference.alias("cells"), F.array().cast(_WORDS).alias("out"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, round_, lambda s: F.struct(F.forall(s["cells"], lambda v: v == 0).alias("done"), s["out"].alias("words")))


def differing(words: Column) -> Column:
    """Those of ``words`` (of two sets, end to end) that only one set has, by a table for as many words.

    The subtracted table of two sets is that of both together: what both hold
    cancels out. It is built larger until it peels; the last resort is to count.
    """

    def attempt(s: Column, r: Column) -> Column:
        # More than half as many cells again as words: enough even if nothing is shared.
        need = (F.ceil(F.size(words) * 0.55).cast("int") + 1) * 3 * F.pow(F.lit(2), r - 1).cast("int")
        return F.when(s["done"], s).otherwise(_let(need, lambda cells: peel(table(words, cells, r), cells, r)))

    begin = F.struct((F.size(words) == 0).alias("done"), F.array().cast(_WORDS).alias("words"))
    once = F.filter(words, lambda w: F.size(F.filter(words, lambda x: x == w)) == 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), begin, attempt, lambda s: F.when(s["done"], s["words"]).otherwise(once))


def compare_parts(a: Column, b: Column) -> Column:
    """The words that only one of two sets (columns) has: :func:`differing` part by part.

    Parts are ranges of the words' values, so each takes a slice of all words in order.
    """

    def split(words: Column) -> Column:
        shift = F.lit(64) - F.greatest(F.ceil(F.log2(F.size(words) / F.lit(PART_WORDS))).cast("int"), F.lit(1))

        def cut(n: Column) -> Column:
            # A shift by a column is not a function of Spark's API for columns; by a power it is the same.
            part = lambda i: F.floor(F.get(words, i) / F.pow(F.lit(2.0), n))
            begins = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (part(i) != part(i - 1)))
            return _let(begins, lambda at: F.flatten(F.transform(at, lambda i, j: _let(F.slice(words, i + 1, F.coalesce(F.get(at, j + 1), F.size(words)) - i), differing))))

        return _let(shift, cut)

    return F.when(F.size(a) + F.size(b) == 0, F.array().cast(_WORDS)).otherwise(_let(F.sort_array(F.concat(a, b)), split))


def difference(a: Column, b: Column, table_a: Column, table_b: Column) -> Column:
    """The words that only one of two sets has: by their fingerprints' tables, by larger ones if those do not peel."""
    small = peel(subtract(table_a, table_b), F.lit(CELLS), F.lit(0))
    return _let(small, lambda s: F.when(s["done"], s["words"]).otherwise(compare_parts(a, b)))


def likeness(differing: Column, a: Column, b: Column) -> Column:
    """Share of words that both have; 1 for two texts without any."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.size(differing) / total)


def render(words: Column, cells: Column) -> Column:
    """A fingerprint as text: number of pieces, cells."""
    return F.concat_ws(":", F.size(words).cast("string"), F.array_join(F.transform(cells, lambda v: F.hex(v)), "."))


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text and others) with ``next_text``, the text after it by id; the first follows the last.

    Rows go to ranges of ids, once, with their text; the last row of a range
    takes the first text of the next range that has any. Equal ids are ordered
    by a hash of the text, then by text; those without an id (``LAST``) have
    ranges of that hash.
    """
    known = F.col("id") != LAST
    total, low = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.min("id"), F.lit(0))).first()
    wanted = max(1, -(-total // RANGE_BYTES))
    n = min(wanted, QUANTILES)
    cuts = rows.where(known).agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts if n > 1 else []))
    bounds = [low, *[c for c in cuts if c > low]]
    inner = -(-wanted // n)
    lows = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    k = F.greatest(F.size(F.filter(lows, lambda b: b <= F.col("id"))), F.lit(1))
    if inner > 1:
        high = F.coalesce(F.get(lows, k), F.lit(LAST))
        here = F.element_at(lows, k)
        sub = F.least(F.floor((F.col("id").cast("double") - here) / (high.cast("double") - here) * inner), F.lit(inner - 1)).cast("bigint")
    else:
        sub = F.lit(0).cast("bigint")
    rows = rows.withColumn("turn", F.xxhash64("text"))
    # Of a hash, the 20 high bits say the range.
    beyond = F.lit((len(bounds) + 2) * inner) + F.floor((F.shiftright("turn", 44) + F.lit(1 << 19)) * wanted / F.lit(1 << 20)).cast("bigint")
    rows = rows.withColumn("range", F.when(known, k.cast("bigint") * inner + sub).otherwise(beyond))
    within = Window.partitionBy("range").orderBy("id", "turn", "text")
    rows = rows.withColumn("after", F.lead(F.struct("text")).over(within))
    firsts = rows.withColumn("nth", F.row_number().over(within)).where("nth = 1").select("range", F.col("text").alias("first_text"))
    firsts = materialize(firsts, "firsts")
    # The range that follows: inside a block of ranges, then the first of the next block.
    ranges = firsts.select("range", F.floor(F.col("range") / RING).alias("block"))
    order = Window.orderBy("block")
    blocks = ranges.groupBy("block").agg(F.min("range").alias("head"))
    blocks = blocks.select("block", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("next_head"))
    inside = ranges.withColumn("follows", F.lead("range").over(Window.partitionBy("block").orderBy("range")))
    ring = inside.join(blocks, "block").select("range", F.coalesce("follows", "next_head").alias("next_range"))
    heads = ring.join(firsts.withColumnRenamed("range", "next_range"), "next_range").select("range", "first_text")
    return rows.join(heads, "range").withColumn("next_text", F.when(F.col("after").isNull(), F.col("first_text")).otherwise(F.col("after.text"))).drop("after", "first_text", "range", "turn")


def _table(words: Column) -> Column:
    return table(words, F.lit(CELLS), F.lit(0))


def fingerprint(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all), ``digests`` and ``fingerprint``.

    A null text counts as empty; an empty text has no digests and a table of
    empty cells. Equal texts have equal fingerprints. Columns that bear the new
    names are replaced; an empty table stays empty.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("digests", "fingerprint")]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), pieces(F.coalesce("text", F.lit(""))).alias("digests"))
    rows = rows.select("row", "digests", render(F.col("digests"), _table(F.col("digests"))).alias("fingerprint"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], "digests", "fingerprint")


def fingerprint_report(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited versions, and how alike they are (query ``op4``).

    ``near_*`` is the share of pieces that two texts have in common, from what
    their tables give back. Ids may be of any type that sorts; a null id follows
    all others, equal ids are in the order of a hash of their texts.
    """
    rows = numbered(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = with_next(rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[pieces(F.col(c)).alias(x) for x, c in (("a", "text"), ("b", "edited"), ("c", "next_text"))])
    rows = rows.select("*", *[_table(F.col(x)).alias(f"table_{x}") for x in "abc"])
    rows = rows.select("*", *[difference(F.col("a"), F.col(x), F.col("table_a"), F.col(f"table_{x}")).alias(f"differ_{x}") for x in "bc"])
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        *[render(F.col(x), F.col(f"table_{x}")).alias(f) for x, f in (("a", "fingerprint"), ("b", "edited_fingerprint"))],
        likeness(F.col("differ_b"), F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("differ_c"), F.col("a"), F.col("c")).alias("near_next"),
    )
