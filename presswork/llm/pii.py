"""Personal data: patterns, and terms that give a protected value away.

Direct identifiers (mail and network addresses, card and telephone numbers) are
found by pattern. Each value found is a protected entity. Over the whole corpus
the documents that hold the entity, the term, and both are counted; the
pointwise mutual information of term and entity against the information of the
entity itself tells how much of it the term discloses. In documents that hold
the entity, terms that disclose ``GENERALISE`` of it or more are generalised,
from ``REMOVE`` on they are removed. An entity may be rare: a pair counts if it
would hardly (``CHANCE``) come together that often by chance. Spellings of one
value are one entity.

Everything runs on built-in functions. Only documents with direct identifiers
(written once to the shared folder) take part in the co-occurrence counts; the
counts of their candidate terms run over all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import materialize, text_key
from presswork.llm.spans import SPAN, count_kind, find_all, gated, labelled, listing

#: A pair found together in so many texts counts if chance alone makes that less likely than this.
CHANCE = 0.01
#: Share of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.8, 0.95

KINDS = ("email", "ip", "card", "phone")
_TERM = r"\p{L}[\p{L}\p{N}'_-]{2,63}"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The contract's patterns. A match can only begin where the run it begins with begins, or where
# the last match ended (\G): the same matches, in time linear in the text.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    d = F.reverse(_digits(match))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, x * 2).otherwise(x)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    n = F.length(d)
    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Direct identifiers of a text (not null): structs start, rank, end, kind, match, in order."""
    return labelled(
        [
            ("email", gated(text, F.contains(text, F.lit("@")), _EMAIL)),
            ("ip", gated(text, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _IP, lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))),
            ("card", gated(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _CARD, _luhn)),
            ("phone", gated(text, F.contains(text, F.lit("+")), _PHONE, lambda m: F.length(_digits(m)).between(9, 15))),
        ]
    )


def _replace(text: Column, spans: Column) -> Column:
    """A text with spans (start, end, by; in order) replaced; of overlapping ones the first counts."""

    def put(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), s["by"])
        fits = s["start"] >= state["at"]
        return F.struct(F.when(fits, s["end"]).otherwise(state["at"]).alias("at"), F.when(fits, piece).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def normal(kind: Column, match: Column) -> Column:
    """One form for all spellings of an identifier: lower case, no leading zeros, digits only."""
    form = F.when(kind == "email", F.lower(match)).when(kind == "ip", F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(_digits(match))
    return F.concat_ws(":", kind, form)


def disclosing_terms(documents: DataFrame, holders: DataFrame) -> DataFrame:
    """entity, term, disclosed: terms that give away ``GENERALISE`` of an entity or more.

    ``holders`` has text_key, entities and terms (arrays of strings) of the
    documents with identifiers. A term is at least as frequent in all documents
    as in those, which bounds what it can disclose: pairs that stay below are out
    before the terms are counted everywhere.
    """
    total = float(documents.count())

    def disclosed(n_t: Column) -> Column:
        mutual = F.log2(F.col("n_et") * F.lit(total) / (F.col("n_e") * n_t.cast("double")))
        return mutual / F.log2(F.lit(total) / F.col("n_e"))

    def significant(n_t: Column) -> Column:
        # Chernoff's bound of a Poisson tail; copies of a text are one observation.
        mean = F.col("texts_e") * n_t.cast("double") / F.lit(total)
        return (F.col("texts") > mean) & (F.col("texts") - mean - F.col("texts") * F.log(F.col("texts") / mean) <= math.log(CHANCE))

    each = holders.select("text_key", F.explode("entities").alias("entity"), "terms")
    counts = each.groupBy("entity").agg(F.count_distinct("text_key").alias("texts_e"), F.count("*").alias("n_e")).where(F.col("n_e") < total)
    pairs = each.select("entity", "text_key", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term", "text_key").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_et")).join(counts, "entity")
    here = holders.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_here"))
    pairs = pairs.join(here, "term").where((disclosed(F.col("n_here")) >= GENERALISE) & significant(F.col("n_here")))
    pairs = materialize(pairs.select("entity", "term", "n_e", "n_et", "texts_e", "texts"), "pairs")
    terms = materialize(pairs.select("term").distinct(), "terms")
    if terms.isEmpty():
        words = documents.select(F.lit("").alias("term")).limit(0)
    else:
        words = documents.select(F.explode(_words(F.col("text"))).alias("term"))
    # Counted first, joined then: what is joined are terms, not their occurrences.
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term")
    scored = pairs.join(n_t, "term").withColumn("disclosed", disclosed(F.col("n_t")))
    return scored.where((F.col("disclosed") >= GENERALISE) & significant(F.col("n_t"))).select("entity", "term", "disclosed")


def find_personal_data(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all), ``base`` and ``terms``.

    ``base`` lists the direct identifiers (start, rank, end, kind, match),
    ``terms`` the disclosing terms (start, end, match, disclosed); places are in
    characters. A null text counts as empty and holds nothing; a null id is an
    id like others; rows that repeat get the same spans; an empty table stays
    empty. Columns named base and terms are replaced.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("base", "terms")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), text.alias("text")).withColumn("key", text_key("id", "text"))
    found = rows.withColumn("base", base_spans(F.col("text")))
    holders = found.where(F.size("base") > 0).select("id", "key", text_key("text").alias("text_key"), "text", "base")
    blank = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("by")))
    entities = F.array_distinct(F.transform("base", lambda s: normal(s["kind"], s["match"])))
    holders = materialize(holders.select("*", entities.alias("entities"), _words(_replace(F.col("text"), blank)).alias("terms")), "holders")
    telling = disclosing_terms(rows, holders)
    once = holders.dropDuplicates(["id", "key"])
    # Joined on both: an entity in many documents has many terms, most of them in one document.
    mine = once.select("id", "key", "terms", F.explode("entities").alias("entity")).select("id", "key", "entity", F.explode("terms").alias("term")).join(telling, ["entity", "term"])
    mine = mine.groupBy("id", "key", "term").agg(F.max("disclosed").alias("disclosed")).groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosed"))).alias("telling"))
    mine = once.alias("h").join(mine.alias("m"), F.col("h.id").eqNullSafe(F.col("m.id")) & (F.col("h.key") == F.col("m.key"))).select("h.id", "h.key", "text", "base", "telling")
    at = find_all(F.col("text"), _TERM, lambda m: F.map_contains_key("telling", F.lower(m)))
    outside = F.filter(at, lambda w: ~F.exists("base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    spans = F.transform(outside, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["match"].alias("match"), F.col("telling")[F.lower(w["match"])].alias("disclosed")))
    mine = materialize(mine.select("id", "key", spans.alias("terms")), "disclosing")
    on = found["id"].eqNullSafe(mine["id"]) & (found["key"] == mine["key"])
    none = F.array().cast("array<struct<start:int,end:int,match:string,disclosed:double>>")
    joined = found.join(mine, on, "left").select("row", "base", F.coalesce(mine["terms"], none).alias("terms"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], "base", "terms")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with identifiers and disclosing terms replaced in the text.

    An identifier becomes its kind in brackets, a term ``[TERM]`` or, from
    ``REMOVE`` on, nothing. Of overlapping spans the first counts. A null text
    stays null.
    """
    found = find_personal_data(documents)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosed"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("by")))
    text = F.col("text")
    new = _replace(text, F.array_sort(F.concat(base, terms)))
    clean = F.when((F.size("base") + F.size("terms") > 0) & text.isNotNull(), new).otherwise(text)
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def pii_report(documents: DataFrame) -> DataFrame:
    """Counts and places of personal data in all documents (query ``op10``)."""
    found = find_personal_data(documents, keep=["doc_id"])
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit("term").alias("kind"), s["match"].alias("match")))
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.array_sort(F.concat("base", terms))).alias("spans"),
    )
