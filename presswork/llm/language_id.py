"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranked list of its most frequent n-grams (one to
three characters, words padded with a blank). A text gets such a list too; its
distance to a profile is the sum, over the n-grams of the text, of how far each
is out of place, and a fixed penalty for those the profile lacks. The language
with the least distance wins.

Profiles are fitted on at most ``FIT_ROWS`` texts of each language, picked by a
hash of the id, and are the only thing sent to the executors: ``TOP`` entries
for each language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import kernels as K
from presswork.llm.common import ship

#: Entries of a profile.
TOP = 400
#: Texts of each language that a profile is fitted on, at most.
FIT_ROWS = 600
#: Languages that are learned, the most frequent ones, at most (bounds what is broadcast).
MAX_LANGUAGES = 5000
#: Bytes of text whose n-grams are counted at once.
PIECE_BYTES = 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters: Unicode category L."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 1-, 2- and 3-grams of the lower-cased words of texts, and the text of each.

    Words are runs of letters, padded with one blank on either side; n-grams of
    blanks alone are left out. A code holds up to three code points of 21 bits.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = np.asarray(pc.utf8_length(low)).astype(np.int64)
    n = len(size)
    raw, _ = K.views(low)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    # One place before and one after each text.
    doc = np.repeat(np.arange(n), size + 2)
    c = np.full(len(doc), 32, np.int64)
    c[np.arange(len(points)) + 2 * np.repeat(np.arange(n), size) + 1] = points
    letter = _letters()[c]
    c[~letter] = 32
    heads = np.cumsum(size + 2) - (size + 2)
    some = np.zeros(n, bool)
    some[doc[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[heads[some]] = True
    c, doc = c[keep], doc[keep]
    two, own = c[:-1] << 21 | c[1:], doc[:-1] == doc[1:]
    three, all_own = two[:-1] << 21 | c[2:], own[:-1] & own[1:]
    return np.concatenate([c[c != 32], two[own], three[all_own]]), np.concatenate([doc[c != 32], doc[:-1][own], doc[:-2][all_own]])


def counted(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each text in order, the text of each, and how often it occurs there."""
    if not len(codes):
        return codes, doc, codes
    parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
    # The code points that occur, numbered in order: mostly few, so text and code fit one number.
    seen = np.zeros(1 + max(int(p.max()) for p in parts), bool)
    for p in parts:
        seen[p] = True
    number = np.cumsum(seen) - 1
    bits = max(1, int(number[-1]).bit_length())
    if 3 * bits + int(doc.max()).bit_length() > 63:
        order = np.lexsort((codes, doc))
        codes, doc = codes[order], doc[order]
    else:
        key = doc.astype(np.int64)
        for p in parts:
            key = key << bits | number[p]
        key.sort()
        point = np.flatnonzero(seen)
        mask = (1 << bits) - 1
        doc = key >> 3 * bits
        codes = point[key >> 2 * bits & mask] << 42 | point[key >> bits & mask] << 21 | point[key & mask]
    edge = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])))
    return codes[edge], doc[edge], np.diff(np.append(edge, len(codes)))


def ranked(codes: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` most frequent codes of each text, by text and rank; ties in the order of the codes."""
    codes, doc, times = counted(codes, doc)
    if not len(doc):
        return codes, doc, doc
    order = np.argsort((doc << 32) - times, kind="stable")
    # Texts are in order already, so theirs are the same places.
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    best = rank < top
    return codes[order[best]], doc[best], rank[best]


class Profiles:
    """Ranked n-grams of each language, ready for many comparisons."""

    def __init__(self, by_language: dict[str, np.ndarray], top: int = TOP):
        self.top = top
        self.languages = sorted(by_language)
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *by_language.values()]))
        #: Rank of each code in each language; ``2 * top`` marks an absent one.
        self.rank = np.full((len(self.languages), len(self.codes) + 1), 2 * top, np.int32)
        for k, name in enumerate(self.languages):
            self.rank[k, np.searchsorted(self.codes, by_language[name])] = np.arange(len(by_language[name]))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language of each text (-1 for none) and its score."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        own, doc, place = ranked(*ngrams(texts), self.top)
        if not len(own) or not self.languages:
            return best, score
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        who, many = doc[begin], np.diff(np.append(begin, len(doc)))
        least = np.full(len(who), np.iinfo(np.int64).max)
        for k in range(len(self.languages)):
            rank = self.rank[k, at]
            away = np.where(rank == 2 * self.top, self.top, np.minimum(np.abs(rank - place), self.top))
            distance = np.add.reduceat(away, begin)
            nearer = distance < least
            least[nearer] = distance[nearer]
            best[who[nearer]] = k
        score[who] = 1.0 - least / (self.top * many)
        return best, score


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that no profile may learn from; a null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(documents: DataFrame, fit_rows: int = FIT_ROWS, top: int = TOP) -> Profiles:
    """Profiles from the texts with a language that are not held out.

    Each language is fitted on the ``fit_rows`` texts whose ids hash lowest
    (all, if it has fewer); of more than ``MAX_LANGUAGES`` the most frequent are
    learned. Empty input gives profiles that know no language.
    """
    ship(documents.sparkSession)
    learn = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return Profiles({}, top)
    # A share of each language by hash, with ample margin, before anything moves; then the exact number.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (1.5 * fit_rows + 50) / n)))])
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40))
    some = learn.withColumn("h", spread).where(F.col("h") < F.lit(float(1 << 40)) * share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    some = some.withColumn("r", rank).where(F.col("r") <= fit_rows).select("lang", "text")

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in frames:
            for batch in K.pieces(whole, "text", PIECE_BYTES):
                names = batch.column("lang").dictionary_encode()
                codes, doc = ngrams(batch.column("text"))
                code, lang, n = counted(codes, np.asarray(names.indices).astype(np.int64)[doc])
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang)), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    total = some.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = total.withColumn("r", first).where(F.col("r") <= top).orderBy("lang", "r").select("lang", "code").collect()
    by: dict[str, list[int]] = {}
    for row in rows:
        by.setdefault(row["lang"], []).append(row["code"])
    return Profiles({k: np.array(v, np.int64) for k, v in by.items()}, top)


def identify(documents: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all) plus ``lang_pred`` and ``score``.

    The prediction uses the whole text and nothing else. A text that is null or
    has no letter (Unicode category L) gets ``und`` and 0. Of languages at the same distance the
    first by name wins. Columns that bear the new names are replaced.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(profiles)
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    schema = rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = pa.array([*known.languages, UNKNOWN], pa.string())
        for whole in batches:
            for batch in K.pieces(whole, "text", PIECE_BYTES):
                best, score = known.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), names.take(pa.array(np.where(best < 0, len(known.languages), best))), pa.array(score)], ["row", "lang_pred", "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "lang_pred", "score")


def keep_identified(documents: DataFrame, min_score: float) -> DataFrame:
    """``documents`` without those whose language stays unknown or scores below ``min_score``."""
    found = identify(documents, fit(documents))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*documents.columns)


def language_report(documents: DataFrame) -> DataFrame:
    """Predictions for all documents from profiles of the learnable ones (query ``op8``)."""
    found = identify(documents, fit(documents), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
