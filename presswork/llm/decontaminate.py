"""Benchmark decontamination with suffix arrays of the training text.

Every shard (a few megabytes of whole training texts) gets a suffix array over
its words; every suffix of every benchmark text is binary-searched in it, one
word deeper at a time, which yields the longest verbatim match and all places
of the matches that are long enough. Only benchmark words have numbers: a
suffix that starts with any other word can match nothing and is left out, and
any other word ends a match.

The benchmark travels to the executors in blocks of bounded size; a worker
holds one block at a time and runs a larger piece of its texts through each, so
its memory does not grow with the number of blocks. Equal items are one item
with several names. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm import kernels as K
from presswork.llm.common import ship

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast block (a block holds an item at least).
BLOCK_BYTES = 16 << 20
#: Bytes of training text in a shard, and in what runs through all blocks if there are several.
SHARD_BYTES, PASS_BYTES = 4 << 20, 64 << 20


class TestIndex:
    """The suffixes of one block of benchmark items, as numbers of known words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        by_text: dict[str, list[str]] = {}
        for name, text in items:
            by_text.setdefault(text, []).append(name)
        data, offsets = K.views(pa.array(list(by_text), pa.large_string()))
        low = K.LOWER[data]
        starts, ends, counts = K.word_spans(data, offsets, K.ALNUM)
        #: Of each text, the ids of the items that have it.
        self.names = list(by_text.values())
        #: Known words in the order of their hashes; number 1 is the first.
        self.hashes, first, number = np.unique(K.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        self.width = (ends - starts)[first]
        self.tokens = number.astype(np.int32) + 1
        item = np.repeat(np.arange(len(by_text)), counts)
        end = np.cumsum(counts)[item] if len(item) else np.empty(0, np.int64)
        #: Of each suffix: its item, its place in it and the words it has left.
        self.item = item
        self.place = K.gather(counts)
        self.left = end - np.arange(len(item))
        #: Length at which a match counts; 0 where a suffix is too short for a window.
        whole = counts[item] if len(item) else end
        self.need = np.where(self.left >= window, window, np.where((whole < window) & (self.place == 0), whole, 0))

    def number(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words given as spans of ``low``; 0 for unknown ones."""
        if not len(self.hashes):
            return np.zeros(len(starts), np.int32)
        h = K.span_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = (self.hashes[at] == h) & (self.width[at] == ends - starts)
        return np.where(known, at + 1, 0).astype(np.int32)


def suffix_array(tokens: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at ``begins`` in the order of their first ``depth`` words.

    Prefix doubling: each round sorts on the ranks of two halves and only
    touches suffixes that still tie. A 0 ends a suffix.
    """
    n = len(tokens)
    rank = np.zeros(n + depth + 1, np.int64)
    rank[:n] = tokens
    order = begins[np.argsort(rank[begins], kind="stable")]
    length = 1
    if not len(order):
        return order
    new = np.empty(len(order), bool)
    new[0] = True
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    names = np.zeros_like(rank)
    names[order] = group + 1
    while length < depth:
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        at = order[tied]
        second = names[np.minimum(at + length, n + depth)]
        sub = np.lexsort((second, names[at]))
        order[tied] = at[sub]
        key, second = names[at][sub], second[sub]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
        new[tied] = fresh
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        names[order] = group + 1
        length *= 2
    return order


def search(index: TestIndex, tokens: np.ndarray, order: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of every test suffix, a word deeper at a time.

    Returns the longest match of each test suffix and the range of ``order``
    that matches it at the length it needs (empty where that length fails).
    """
    n_suffixes = len(index.tokens)
    longest = np.zeros(n_suffixes, np.int64)
    found = np.zeros((2, n_suffixes), np.int64)
    alive = np.arange(n_suffixes)
    low, high = np.zeros(n_suffixes, np.int64), np.full(n_suffixes, len(order), np.int64)
    padded = np.append(tokens, np.zeros(deepest + 1, tokens.dtype))
    for depth in range(deepest):
        alive = alive[index.left[alive] > depth]
        if not len(alive):
            break
        word = index.tokens[alive + depth]
        bounds = []
        for right in (False, True):
            a, b = low[alive].copy(), high[alive].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                here = padded[order[mid] + depth]
                go = here <= word[open_] if right else here < word[open_]
                a[open_] = np.where(go, mid + 1, a[open_])
                b[open_] = np.where(go, b[open_], mid)
            bounds.append(a)
        keep = bounds[0] < bounds[1]
        alive = alive[keep]
        low[alive], high[alive] = bounds[0][keep], bounds[1][keep]
        longest[alive] = depth + 1
        done = alive[index.need[alive] == depth + 1]
        found[0, done], found[1, done] = low[done], high[done]
    return longest, found[0], found[1]


def _numbers(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of each range, end to end."""
    return np.repeat(begin, many) + K.gather(many)


def scan(texts: pa.Array, index: TestIndex, matches: bool) -> tuple[np.ndarray, list[np.ndarray], list[list[int]], list[list[tuple[int, int, int, int]]]]:
    """Of each text: its words, the places hit, items, and (if wanted) the longest match of each item."""
    data, offsets = K.views(texts)
    low = K.LOWER[data]
    starts, ends, counts = K.word_spans(data, offsets, K.ALNUM)
    tokens = index.number(low, starts, ends)
    n_texts = len(counts)
    # A 0 after each text: no match runs from one text into the next.
    shift = np.repeat(np.arange(n_texts), counts)
    stream = np.zeros(len(tokens) + n_texts, np.int32)
    stream[np.arange(len(tokens)) + shift] = tokens
    head = np.cumsum(counts + 1) - (counts + 1)
    hits: list[np.ndarray] = [np.empty(0, np.int64)] * n_texts
    items: list[list[int]] = [[] for _ in range(n_texts)]
    best: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n_texts)]
    deepest = int(index.left.max(initial=0)) if matches else int(index.need.max(initial=0))
    order = suffix_array(stream, np.flatnonzero(stream), deepest)
    _, a, b = search(index, stream, order, deepest)
    suffix = np.flatnonzero(b > a)
    if not len(suffix):
        return counts, hits, items, best
    # Equal windows, of one item or several, share a range of the suffix array: occurrences are listed once for each range.
    ranges, once, which = np.unique(np.stack([a[suffix], index.need[suffix]]), axis=1, return_index=True, return_inverse=True)
    which = which.ravel()
    first, length = ranges
    many = b[suffix][once] - first
    where = order[_numbers(first, many)]
    step = np.zeros(len(stream) + 1, np.int64)
    np.add.at(step, where, 1)
    np.add.at(step, where + np.repeat(length, many), -1)
    hit = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    owner = np.searchsorted(head, hit, "right") - 1
    edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for x, part in zip(owner[edge].tolist(), np.split(hit, edge[1:]), strict=True):
        hits[x] = part - head[x]
    # Texts of each range and items of each range, each once; then the items of each text.
    text = np.searchsorted(head, where, "right") - 1
    seen = np.unique(np.repeat(np.arange(len(many)), many) * n_texts + text)
    has = np.unique(which.astype(np.int64) * len(index.names) + index.item[suffix])
    bound = np.searchsorted(has, np.arange(len(many) + 1) * len(index.names))
    found: list[set[int]] = [set() for _ in range(n_texts)]
    for r, x in zip((seen // n_texts).tolist(), (seen % n_texts).tolist(), strict=True):
        found[x].update((has[bound[r] : bound[r + 1]] % len(index.names)).tolist())
    for x, own in enumerate(found):
        items[x] = sorted(own)
    if matches:
        _longest(index, stream, head, order, a, b, suffix, deepest, best)
    return counts, hits, items, best


def _longest(index: TestIndex, stream: np.ndarray, head: np.ndarray, order: np.ndarray, a: np.ndarray, b: np.ndarray, suffix: np.ndarray, deepest: int, best: list[list[tuple[int, int, int, int]]]) -> None:
    """The longest match of each text and item, test suffix by test suffix; of ties the first in the text."""
    padded = np.append(stream, np.zeros(deepest + 1, np.int32))
    kept: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in suffix.tolist():
        place = order[a[s] : b[s]]
        length = np.full(len(place), index.need[s])
        live = np.flatnonzero(length < index.left[s])
        while len(live):
            live = live[padded[place[live] + length[live]] == index.tokens[s + length[live]]]
            length[live] += 1
            live = live[length[live] < index.left[s]]
        text = np.searchsorted(head, place, "right") - 1
        rank = np.lexsort((place, -length, text))
        lead = np.append(True, text[rank][1:] != text[rank][:-1])
        for r in rank[lead].tolist():
            key, new = (int(text[r]), int(index.item[s])), (-int(length[r]), int(place[r]), int(index.place[s]))
            kept[key] = min(kept.get(key, new), new)
    for (x, i), (length, place, at) in sorted(kept.items()):
        best[x].append((i, at, place - int(head[x]), -length))


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of bounded size; the driver holds one block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("text") != "").distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + 4 * len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append(("" if row.item_id is None else row.item_id, row.text))
        size += 4 * len(row.text)
    if block:
        yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, matches: bool = True) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all) plus ``_found``, what the benchmark shares with the text.

    ``_found`` has n_words, n_hit (words inside any occurrence of a window),
    items (ids, as strings, in string order), longest (words of the longest
    match) and matches (the longest match of each item: where it begins in the
    item and in the text, and its words); the last two only if ``matches``, else
    they are 0 and empty. A column named ``_found`` is replaced.

    A null or empty text has no words and no hits. An item without words never
    occurs; an item id that is null counts as ''; rows of the benchmark that
    repeat count once. Rows of ``documents`` that repeat are judged each for
    itself. With an empty benchmark nothing is hit. A word of a text is taken
    for a benchmark word if their 64-bit hashes and lengths agree; two benchmark
    words of one hash count as one.
    """
    ship(documents.sparkSession)
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(TestIndex(block, window)) for block in blocks(benchmark, block_bytes)]
    names = [c for c in (documents.columns if keep is None else keep) if c != "_found"]
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    place = T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(x, T.LongType()) for x in ("item_word", "doc_word", "n_words")]])
    found_type = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("matches", T.ArrayType(place))])
    schema = T.StructType([out.schema["row"], T.StructField("found", found_type)])
    arrow_place = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
    arrow_found = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("matches", pa.list_(arrow_place))])

    def judge(texts: pa.Array, size: np.ndarray) -> pa.Array:
        n = len(texts)
        hits: list[np.ndarray] = [np.empty(0, np.int64)] * n
        items: list[list[str]] = [[] for _ in range(n)]
        best: list[list[dict]] = [[] for _ in range(n)]
        counts = np.zeros(n, np.int64)
        shards = list(K.cuts(size, SHARD_BYTES))
        if not shared:
            counts = K.word_spans(*K.views(texts), K.ALNUM)[2]
        for one in shared:
            index = one.value
            for low, high in shards:
                counts[low:high], hit, item, far = scan(texts[low:high], index, matches)
                for x in range(high - low):
                    if item[x]:
                        hits[low + x] = np.union1d(hits[low + x], hit[x])
                        items[low + x] += [name for i in item[x] for name in index.names[i]]
                        best[low + x] += [{"item_id": name, "item_word": p, "doc_word": d, "n_words": k} for i, p, d, k in far[x] for name in index.names[i]]
            if len(shared) > 1:
                # The worker keeps what it has read of a broadcast; one block at a time is enough.
                index = None
                vars(one).pop("_value", None)
        rows = [{"n_words": int(counts[x]), "n_hit": len(hits[x]), "items": sorted(set(items[x])), "longest": max((m["n_words"] for m in best[x]), default=0), "matches": best[x]} for x in range(n)]
        return pa.array(rows, arrow_found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole, "text", PASS_BYTES if len(shared) > 1 else SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("row"), judge(batch.column("text"), K.sizes(batch.column("text")))], ["row", "found"])

    out = out.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("found").alias("_found"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without the rows that share a window with the benchmark."""
    return find_contamination(documents, benchmark, window, block_bytes, matches=False).where(F.col("_found.n_hit") == 0).drop("_found")


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of counts and digests for each document (query ``op7``)."""
    found = find_contamination(documents, benchmark, keep=["doc_id"], matches=False)
    f = F.col("_found")
    return found.select(
        "doc_id",
        f.n_words.alias("n_words"),
        f.n_hit.alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        (f.n_hit > 0).alias("contaminated"),
    )


#: The same rows in DuckDB.
CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, x)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
