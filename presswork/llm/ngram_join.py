"""Near-duplicate join: Jaccard similarity of word shingles, by a MinHash LSH forest.

A document's shingles are its runs of five words; documents with the same set of
shingles form a class, of which one stands for all. Every class has a signature
of ``DEEPEST`` values in each of ``TREES`` prefix tries. Sorted, the signatures
of a trie lie in the order of its leaves: those that agree on a prefix are
neighbours. Classes that agree on a prefix of the present length in some tree
are candidates; they are chained to the least of the prefix (never paired up),
and the chains give components.

The prefix begins at its full length. The similarities of the links found tell
what share of all links a length finds: a link at similarity s is found with
chance p(s) = 1 - (1 - s**length)**trees, so each one found stands for 1 / p(s).
While that recall is below ``RECALL``, prefixes are shortened to the longest
length whose estimate reaches it. At the full length the signatures of
neighbours in the tries say how similar they are; from then on candidates are
compared exactly and their links say it, and components that a shorter prefix
changes are compared again.

A component of up to ``BLOCK`` classes is compared in one task, on bit sets. A
larger one is dealt out in pairs of blocks, or trie node by trie node, whichever
moves less text: a chain of many classes that have little to do with each other
costs what its trie nodes cost, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from presswork.llm import kernels as K
from presswork.llm.common import SPACE_WORD, materialize, ship
from presswork.llm.components import components

#: Words in a shingle.
SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Prefix tries, values of 16 bits in a full signature (two 64-bit words), and in the shortest prefix.
TREES = 30
DEEPEST = 8
SHORTEST = 3
#: Share of the links that is to be found, as estimated from those found.
RECALL = 0.9999
#: Classes that are compared in one task, and their shingles, at most (twice as many for two blocks).
BLOCK = 1000
BLOCK_SHINGLES = 2_000_000
#: Classes of small components in one task, about.
BIN = 2000
#: Bins of similarity between that of a link and 1.
BINS = 20


def found_share(s: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Chance that two classes at similarity ``s`` agree on ``depth`` values in some tree."""
    return 1 - (1 - s**depth) ** trees


def shorten(links: np.ndarray, depth: int, trees: int = TREES, recall: float = RECALL, similar: tuple[int, int] = SIMILAR) -> int:
    """The longest prefix up to ``depth`` whose estimated recall reaches ``recall``.

    ``links`` has the links found at ``depth`` in bins of similarity. Every link
    counts as at the lower end of its bin, and one more at the least similarity
    is added, so that few links do not stop the search early.
    """
    low = similar[0] / similar[1]
    s = low + (1 - low) * np.arange(BINS) / BINS
    many = links.astype(float)
    many[0] += 1
    real = many / found_share(s, depth, trees)
    for length in range(depth, SHORTEST, -1):
        if (real * found_share(s, length, trees)).sum() >= recall * real.sum():
            return length
    return SHORTEST


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: 64-bit hashes, the text of each, their number by text.

    A text of fewer words than a shingle, but some, has one shingle: all of them.
    """
    data, offsets = K.views(texts)
    starts, ends, counts = K.word_spans(data, offsets, K.SPACED)
    words = K.span_hashes(data, starts, ends)
    begin = np.cumsum(counts) - counts
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) < 1 << 16 else np.int64), n)
    at = np.repeat(begin, n) + K.gather(n)
    stop = np.minimum(at + SHINGLE, np.repeat(begin + counts, n))
    h = K.range_hashes(words, at, stop) if len(at) else np.empty(0, K.U64)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    order = np.argsort(owner, kind="stable")  # small numbers: a radix sort
    h, owner = h[order], owner[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
        h, owner = h[new], owner[new]
    return h, owner, np.bincount(owner, minlength=len(counts))


def _factors(n: int) -> np.ndarray:
    return K.mix(np.arange(1, n + 1, dtype=K.U64) * K.U64(K.BASES[1])) | K.U64(1)


def signatures(h: np.ndarray, sizes: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class hashes (two words) of the sets, and of each text and tree a full signature (two words)."""
    full = np.flatnonzero(sizes)
    edge = (np.cumsum(sizes) - sizes)[full]
    one, two = np.zeros(len(sizes), K.U64), np.zeros(len(sizes), K.U64)
    keys = np.zeros((len(sizes), trees, 2), K.U64)
    if not len(full):
        return one, two, keys
    spread = K.mix(h + K.U64(1))
    one[full] = np.add.reduceat(spread, edge)
    two[full] = np.add.reduceat(K.mix(spread ^ K.U64(K.BASES[0])), edge)
    factor = _factors(trees * DEEPEST)
    for t in range(trees):
        for d in range(DEEPEST):
            value = K.mix(np.minimum.reduceat(spread * factor[t * DEEPEST + d], edge)) >> K.U64(48)
            keys[full, t, d // 4] |= value << K.U64(48 - 16 * (d % 4))
    return one, two, keys


def prefixes(words: np.ndarray, depth: int) -> np.ndarray:
    """One key for the first ``depth`` values of each signature (.., trees, 2), its own for each tree."""
    drop = [K.U64(64 - 16 * min(4, max(0, depth - 4 * w))) for w in (0, 1)]
    tree = np.arange(1, words.shape[-2] + 1, dtype=K.U64)
    first = words[..., 0] >> drop[0]
    second = words[..., 1] >> drop[1] if depth > 4 else K.U64(0)
    return K.mix(K.mix(first * K.U64(K.BASES[0]) + tree) + second * K.U64(K.BASES[1]))


def _sign(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole, "text"):
                h, _, sizes = shingles(batch.column("text"))
                one, two, keys = signatures(h, sizes, trees)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("row"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sizes.astype(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["id", "row", "one", "two", "n", "keys"],
                )

    return run


def _signatures_of(column: pa.Array, trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), K.U64).reshape(len(column), trees, 2)


def _leaves(buckets: int, trees: int, depth: int):
    """Sorted tries of many classes: the least class of each prefix, and chains inside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = np.asarray(batch.column("node")).astype(np.int64)
            if not len(reps):
                continue
            key = prefixes(_signatures_of(batch.column("keys"), trees), depth).T.ravel()
            rep = np.tile(reps, trees)
            order = np.lexsort((rep, key))
            key, rep = key[order], rep[order]
            new = np.append(True, key[1:] != key[:-1])
            first = rep[new][np.cumsum(new) - 1]
            chain = np.unique(np.stack([rep[~new], first[~new]]), axis=1)
            key, rep = key[new], rep[new]
            bucket = (key % K.U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, key[order[edges[b] : edges[b + 1]]].tobytes(), rep[order[edges[b] : edges[b + 1]]].tobytes(), b"", b"") for b in range(buckets) if edges[b] < edges[b + 1]]
            rows.append((int(reps[0] % buckets), b"", b"", chain[0].tobytes(), chain[1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "key", "rep", "u", "v"])

    return run


def _nodes_of(trees: int, depth: int):
    """One row for each class and tree: the trie node the class is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = prefixes(_signatures_of(batch.column("keys"), trees), depth)
            node = np.asarray(batch.column("node")).astype(np.int64)
            root = np.asarray(batch.column("root")).astype(np.int64)
            tree = np.tile(np.arange(trees, dtype=np.int32), len(node))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, trees)), pa.array(np.repeat(root, trees)), pa.array(tree), pa.array(key.ravel().view(np.int64))], ["node", "root", "tree", "unit"])

    return run


def _chain(table: pa.Table) -> pa.Table:
    """One bucket of prefixes: every class with a prefix, chained to the least with the same."""
    key, rep, u, v = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("key", K.U64), ("rep", np.int64), ("u", np.int64), ("v", np.int64)))
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = rep[new][np.cumsum(new) - 1] if len(rep) else rep
    pair = np.unique(np.stack([np.append(rep[~new], u), np.append(first[~new], v)]), axis=1)
    return pa.table({"u": pair[0], "v": pair[1]})


def _stars(table: pa.Table) -> pa.Table:
    """One bucket of prefixes: the chains of :func:`_chain`, each class hung on the least it hangs together with."""
    chain = _chain(table)
    node, place = np.unique(np.concatenate([np.asarray(chain["u"]), np.asarray(chain["v"])]), return_inverse=True)
    a, b = place[: len(chain)], place[len(chain) :]
    label = np.arange(len(node))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    hung = label != np.arange(len(node))
    return pa.table({"u": node[hung], "v": node[label[hung]]})


def _alike(trees: int):
    """Neighbours in a trie by the share of values that their signatures have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_signatures_of(batch.column(c), trees).reshape(len(batch), -1).view(np.uint16) for c in ("a", "b"))
            low = SIMILAR[0] / SIMILAR[1]
            s = (a == b).mean(axis=1)
            # An estimate is off by 0.026 or so at the least similarity: those a little below it count as well.
            s = s[s >= low - 0.06]
            many = np.bincount(np.clip(((s - low) / (1 - low) * BINS).astype(np.int64), 0, BINS - 1), minlength=BINS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(many.astype(np.int64))], ["bin", "many"])

    return run


def _neighbours(chains: DataFrame, leaves: DataFrame, trees: int) -> np.ndarray:
    """Pairs that the tries chain (u, v), by similarity as their signatures tell."""
    chains = chains.where("u <> v").distinct()
    pairs = chains.join(leaves.select(F.col("node").alias("u"), F.col("keys").alias("a")), "u").join(leaves.select(F.col("node").alias("v"), F.col("keys").alias("b")), "v")
    rows = pairs.select("a", "b").mapInArrow(_alike(trees), "bin int, many long").groupBy("bin").agg(F.sum("many").alias("many")).collect()
    total = np.zeros(BINS, np.int64)
    for r in rows:
        total[r.bin] = r.many
    return total


def _roots(links: np.ndarray) -> np.ndarray:
    """Least linked node of each node, over any number of steps (a dense matrix of links)."""
    n = len(links)
    label = np.arange(n)
    reach = links | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _common(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Members that each two of ``n`` sets share, counted on bits, some columns at a time."""
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(h)))
    use = np.repeat(count > 1, count)  # members of one set alone are in no intersection
    column = (np.cumsum(new & use) - 1)[use]
    owner = owner[use]
    out = np.zeros((n, n), np.int64)
    words = max(1, (4 << 20) // (8 * max(1, n)))
    step = max(1, (8 << 20) // (8 * n * words))
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, 64 * words):
        a, b = np.searchsorted(column, (low, low + 64 * words))
        col = column[a:b] - low
        bits = np.zeros((n, int(col[-1]) // 64 + 1), K.U64)
        np.bitwise_or.at(bits, (owner[a:b], col // 64), K.U64(1) << (col % 64).astype(K.U64))
        for at in range(0, n, step):
            out[at : at + step] += np.bitwise_count(bits[at : at + step, None, :] & bits[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def _links(common: np.ndarray, sizes: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets reach the similarity; set sizes up to 2**40."""
    a, b = similar
    # common / (x + y - common) >= a / b, in whole numbers
    out = common * (a + b) >= a * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(out, False)
    return out


def _binned(common: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Links (each once) by similarity."""
    x, y = np.nonzero(np.triu(links))
    low = SIMILAR[0] / SIMILAR[1]
    s = common[x, y] / (sizes[x] + sizes[y] - common[x, y])
    return np.bincount(np.clip(((s - low) / (1 - low) * BINS).astype(np.int64), 0, BINS - 1), minlength=BINS)


def _verify(trees: int, depth: int):
    """One task: all pairs inside each small component, or between two blocks of a large one or of a trie node."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("node", "ascending")])
        unit, node = (np.asarray(table[c]).astype(np.int64) for c in ("unit", "node"))
        table = table.filter(pa.array(np.append(True, (node[1:] != node[:-1]) | (unit[1:] != unit[:-1])))).combine_chunks()  # rows that repeat
        unit, node, block, docs = (np.asarray(table[c]).astype(np.int64) for c in ("unit", "node", "block", "docs"))
        two_blocks = table["i"][0].as_py() != table["j"][0].as_py()
        tree = table["tree"][0].as_py()
        text = table["text"]
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        size = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)))
        edges = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
        out: list[np.ndarray] = []
        binned: list[bytes | None] = []
        at = 0
        while at < len(edges) - 1:
            # As many whole components as make a few megabytes of text.
            to = at + 1
            while to < len(edges) - 1 and size[edges[to + 1]] - size[edges[at]] < 4 << 20 and edges[to + 1] - edges[at] < 1 << 16:
                to += 1
            base = edges[at]
            h, owner, sizes = shingles(text[base : edges[to]])
            owner = owner.astype(np.int64)
            bound = np.append(0, np.cumsum(sizes))
            for c in range(at, to):
                a, b = edges[c] - base, edges[c + 1] - base
                s = slice(bound[a], bound[b])
                common = _common(h[s], owner[s] - a, b - a)
                links = _links(common, sizes[a:b], SIMILAR)
                here = slice(edges[c], edges[c + 1])
                if two_blocks:
                    links &= block[here, None] != block[None, here]
                if tree > 0:
                    # A pair counts in the first tree only in which it shares a prefix.
                    key = prefixes(_signatures_of(table["keys"][edges[c] : edges[c + 1]], trees), depth)
                    x, y = np.nonzero(links)
                    for low in range(0, len(x), 1 << 16):
                        p, q = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
                        links[p, q] = ~(key[p, :tree] == key[q, :tree]).any(axis=1)
                bins = _binned(common, sizes[a:b], links)
                binned += [bins.tobytes() if bins.any() else None] + [None] * (int(b - a) - 1)
                out.append(np.stack([node[here], links.sum(axis=1), links @ docs[here], node[here][_roots(links)]]))
            at = to
        done = pa.table(dict(zip(("node", "n_links", "n_near", "top"), np.concatenate(out, axis=1), strict=True)))
        return done.append_column("bins", pa.array(binned, pa.binary()))

    return run


def _units(near: DataFrame, classes: DataFrame, trees: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """What is compared: node, root, unit, tree, blocks for every class of ``near`` (node, root).

    A unit is a component (tree -1) or, where that moves less text, each trie
    node of a component with two classes or more; the roots of components that
    go by trie nodes come second.
    """
    members = near.join(classes.select("node", "n", "keys"), "node")
    whole = members.groupBy("root").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    whole = materialize(whole, "blocks")
    large = whole.where(F.col("blocks") > 1)
    if large.isEmpty():
        return near.join(whole, "root").select("node", "root", F.col("root").alias("unit"), F.lit(-1).alias("tree"), "blocks"), large.select("root")
    leaves = members.join(large.select("root"), "root").select("node", "root", "keys").mapInArrow(_nodes_of(trees, depth), "node long, root long, tree int, unit long")
    leaves = materialize(leaves.join(classes.select("node", "n"), "node"), "leaves")
    nodes = leaves.groupBy("root", "tree", "unit").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")).where(F.col("m") > 1)
    nodes = materialize(nodes, "nodes")
    cost = nodes.groupBy("root").agg(F.sum(F.col("m") * F.col("blocks")).alias("by_node"))
    by_node = large.join(cost, "root").where(F.col("by_node") < F.col("m") * F.col("blocks")).select("root")
    by_node = materialize(by_node, "by-node")
    one = near.join(whole, "root").join(by_node, "root", "left_anti").select("node", "root", F.col("root").alias("unit"), F.lit(-1).alias("tree"), "blocks")
    split = leaves.join(by_node, "root").join(nodes.select("root", "tree", "unit", "blocks"), ["root", "tree", "unit"]).select("node", "root", "unit", "tree", "blocks")
    return one.unionByName(split), by_node


def _compare(rows: DataFrame, classes: DataFrame, near: DataFrame, n_classes: int, trees: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """node, n_links, n_near, top, bins, stored: links inside the components ``near`` (node, root).

    Besides, the roots of components of which not all pairs were compared.
    """
    units, by_node = _units(near, classes, trees, depth)
    units = units.join(classes.select("node", "id", "row", "docs", "keys"), "node")
    split = F.col("blocks") > 1
    units = units.withColumn("block", F.when(split, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(-1).cast("int"))
    other = F.explode(F.when(split, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1))))
    units = units.withColumn("other", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    bins = max(1, n_classes // BIN)
    task = F.when(split | (F.col("tree") >= 0), F.col("unit")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(bins)))
    keys = F.when(F.col("tree") > 0, F.col("keys"))
    units = units.select("id", "row", "node", "unit", "tree", "docs", "block", "i", "j", task.alias("task"), keys.alias("keys"))
    work = rows.join(units, rows["id"].eqNullSafe(units["id"]) & (rows["row"] == units["row"])).select("node", "unit", "tree", "docs", "block", "i", "j", "task", "keys", "text")
    found = work.groupBy("task", "tree", "i", "j").applyInArrow(_verify(trees, depth), "node long, n_links long, n_near long, top long, bins binary")
    return materialize(found, "links"), by_node


def _binned_links(found: DataFrame) -> np.ndarray:
    """All links by similarity: one row for each unit is added up."""
    total = np.zeros(BINS, np.int64)
    hexed = F.hex("bins")
    sums = [F.sum(F.conv(F.concat(*[F.substring(hexed, 16 * k + 2 * (8 - b) - 1, 2) for b in range(8)]), 16, 10).cast("long")).alias(f"b{k}") for k in range(BINS)]
    got = found.where(F.col("bins").isNotNull()).agg(*sums).first()
    for k in range(BINS):
        total[k] = got[k] or 0
    return total


def join_near(documents: DataFrame, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``documents``: doc_id, class_id, class_size, n_links, n_near, group_id.

    Besides, ``row`` is a hash of id and text, and ``group_node`` a number of the
    group that is its own even where ids repeat.

    Words are separated by ASCII white space and taken as they are; shingles are
    compared as 64-bit hashes. ``class_id`` is the least doc_id (of any type
    that sorts) with the same set of shingles and ``class_size`` the rows of that
    class; ``n_links`` counts the other classes at a similarity of 0.8 or more,
    ``n_near`` the rows of those; ``group_id`` is the least class of all that
    hang together by links. A text of one to four words has one shingle. A null
    or empty text has none: such rows are one class without links. A null id
    counts as the largest. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(_sign(trees), f"id {kind}, row long, one long, two long, n long, keys binary"), "signed")
    classes = signed.groupBy("one", "two", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"), F.count("*").alias("docs"), F.first("keys").alias("keys"))
    # Nodes are numbered as they are written; ids of documents need not be unique.
    classes = materialize(classes.select("one", "two", "n", F.col("least.id").alias("id"), F.col("least.row").alias("row"), "docs", "keys", F.monotonically_increasing_id().alias("node")), "classes")
    n_classes = classes.count()
    buckets = max(1, n_classes * trees // 200_000)
    leaves = classes.where(F.col("n") > 0).select("node", "keys")

    def tries(depth: int) -> GroupedData:
        return leaves.mapInArrow(_leaves(buckets, trees, depth), "bucket int, key binary, rep binary, u binary, v binary").groupBy("bucket")

    depth = shorten(_neighbours(tries(DEEPEST).applyInArrow(_chain, "u long, v long"), leaves, trees), DEEPEST, trees, recall)
    found, known = None, None
    while True:
        near = components(tries(depth).applyInArrow(_stars, "u long, v long"))
        shape = near.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
        shape = materialize(shape, "shape")
        if found is None:
            found, by_node = _compare(rows, classes, near, n_classes, trees, depth)
        else:
            # Only components that this length made larger, or that go by trie nodes, are compared again.
            fresh = near.join(materialize(shape.join(known, ["root", "m", "sum"], "left_anti").select("root"), "fresh"), "root").select("node", "root")
            more, by_node = _compare(rows, classes, fresh, n_classes, trees, depth)
            found = materialize(found.join(fresh.select("node"), "node", "left_anti").unionByName(more), "links")
        known = shape.join(by_node, "root", "left_anti")
        shorter = shorten(_binned_links(found), depth, trees, recall)
        if shorter == depth:
            break
        depth = shorter
    groups = components(found.select(F.col("node").alias("u"), F.col("top").alias("v")))
    named = groups.join(classes.select("node", "id"), "node")
    named = groups.join(materialize(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("group")), "groups"), "root").select("node", "root", F.col("group.id").alias("group"), F.lit(True).alias("linked"))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_near").alias("n_near"))
    per_class = classes.select("one", "two", "n", "node", F.col("id").alias("class"), "docs").join(links, "node", "left").join(named, "node", "left")
    zero = F.lit(0).cast("long")
    out = signed.drop("keys").join(per_class, ["one", "two", "n"])
    return out.select(
        F.col("id").alias("doc_id"),
        "row",
        F.col("class").alias("class_id"),
        F.col("docs").alias("class_size"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_near", zero).alias("n_near"),
        F.when(F.col("linked"), F.col("group")).otherwise(F.col("class")).alias("group_id"),
        F.coalesce("root", "node").alias("group_node"),
    )


def drop_near(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group, that of the least doc_id; texts without words all stay.

    Of equal rows one stays; of different rows with that id the one whose hash
    is least. A row with a null id is the last choice.
    """
    found = join_near(documents)
    first = found.groupBy("group_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    first = materialize(first.select(F.col("first.doc_id").alias("id"), F.col("first.row").alias("row")), "first")
    every = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = documents.select(every.alias("all"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce(~F.col("text").rlike(SPACE_WORD), F.lit(True)).alias("blank"))
    once = F.row_number().over(Window.partitionBy("id", "row").orderBy("id"))
    full = keyed.where("not blank").alias("k").join(first.alias("f"), F.col("k.id").eqNullSafe(F.col("f.id")) & (F.col("k.row") == F.col("f.row"))).select("k.*")
    full = full.withColumn("nth", once).where("nth = 1").select("all")
    return full.unionByName(keyed.where("blank").select("all")).select(*[F.col("all").getField(c).alias(c) for c in documents.columns])


def ngram_report(documents: DataFrame) -> DataFrame:
    """Classes, links and groups of all documents (query ``op5``)."""
    return join_near(documents).drop("row", "group_node")


#: The same rows in DuckDB.
NGRAM_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
k AS (SELECT d.doc_id, coalesce(z.xs, []) AS xs FROM d LEFT JOIN (SELECT doc_id, list(x ORDER BY x) AS xs FROM s GROUP BY doc_id) z USING (doc_id)),
c AS (SELECT doc_id, len(xs) AS n, min(doc_id) OVER (PARTITION BY xs) AS class_id, count(*) OVER (PARTITION BY xs) AS class_size FROM k),
r AS (SELECT DISTINCT class_id, class_size, n FROM c),
rs AS (SELECT s.doc_id AS class_id, s.x FROM s JOIN r ON r.class_id = s.doc_id),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS both_ FROM rs a JOIN rs b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b, rb.class_size AS size_b FROM p JOIN r ra ON ra.class_id = p.a JOIN r rb ON rb.class_id = p.b WHERE 9 * both_ >= 4 * (ra.n + rb.n)),
g AS (SELECT class_id AS a, class_id AS b FROM r UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b),
t AS (SELECT a, min(b) AS group_id FROM g GROUP BY a),
m AS (SELECT a, count(*)::BIGINT AS n_links, sum(size_b)::BIGINT AS n_near FROM l GROUP BY a)
SELECT c.doc_id, c.class_id, c.class_size, coalesce(m.n_links, 0)::BIGINT AS n_links, coalesce(m.n_near, 0)::BIGINT AS n_near, t.group_id
FROM c JOIN t ON t.a = c.class_id LEFT JOIN m ON m.a = c.class_id
"""
