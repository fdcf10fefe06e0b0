"""Repeated windows of tokens, found through a difference cover.

A difference cover modulo v holds, for every difference, two members that far
apart. So if the same ``window`` tokens begin at i in one text and at j in
another, there is an offset k < v at which i + k and j + k are both cover
places, and the ``window - v + 1`` tokens from there are the same: both texts
hold the same *anchor*. Only cover places are hashed and exchanged at first; the
windows that hold an anchor which occurs more than once are then compared
themselves.

Work is dealt out in chunks (a few megabytes of whole texts, by a hash of the
row) and buckets (ranges of hash values). A chunk sends a bucket each hash it
has once, in order, whatever the number of its occurrences; the bucket is sorted
by itself and answers with one bit for each hash it got. So a passage that a
third of all texts share costs a bucket one entry for each chunk, and no task
ever holds more than a chunk or a bucket. The answers are small and are written
to the shared folder; texts are dealt out anew for each step rather than kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm import kernels as K
from presswork.llm.common import materialize, numbered, ship

@cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """Modulus q*q + q + 1 and q + 1 members, every difference once (q prime).

    The powers of a root of a cubic over the field of q elements that lie in the
    plane without a square term (Singer's construction); cubics are tried until
    the differences are complete.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, members = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        members.append(i)
                    x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                if len(members) == q + 1 and len({(m - n) % v for m in members for n in members}) == v:
                    return v, tuple(members)
    raise ValueError(f"no difference cover for {q}")


@dataclass(frozen=True)
class Plan:
    """What counts as a token and as a repeat, and how the work is dealt out."""

    #: Texts to token values, all texts end to end, and the number of each text.
    tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    window: int
    q: int
    #: Only a window that also begins in a text with a smaller id is a repeat.
    later_only: bool
    chunk_bytes: int = 4 << 20
    #: Hashes in a bucket, about.
    bucket_rows: int = 400_000
    #: Windows are compared in so many rounds; each holds on disk its share only.
    rounds: int = 1

    @property
    def anchor(self) -> int:
        return self.window - difference_cover(self.q)[0] + 1


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _hashes(values: np.ndarray, at: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of ``length`` values from each of the ascending places ``at``, block by block."""
    out = np.empty(len(at), K.U64)
    block = 1 << 19
    low = 0
    while low < len(at):
        high = int(np.searchsorted(at, at[low] + block))
        first = at[low]
        out[low:high] = K.range_hashes(values[first : at[high - 1] + length], at[low:high] - first, at[low:high] - first + length, base)
        low = high
    return out


def _anchors(plan: Plan, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover places with room for an anchor, in texts with room for a window; their hashes."""
    v, members = difference_cover(plan.q)
    room = np.where(counts >= plan.window, counts - plan.anchor + 1, 0)
    begin = _starts(counts)
    parts = []
    for m in members:
        n = np.maximum(0, (room - m + v - 1) // v)
        parts.append(np.repeat(begin + m, n) + v * K.gather(n))
    at = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    return at, _hashes(values, at, plan.anchor, K.BASES[0])


def _windows(plan: Plan, values: np.ndarray, counts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Places of the windows that hold one of ``anchors``."""
    v, _ = difference_cover(plan.q)
    begin = _starts(counts)
    text = np.searchsorted(begin + counts, anchors, "right")
    first = np.maximum(anchors - v + 1, begin[text])
    last = np.minimum(anchors, (begin + counts - plan.window)[text])
    step = np.zeros(len(values) + 1, np.int32)
    ok = first <= last
    np.add.at(step, first[ok], 1)
    np.add.at(step, last[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def _distinct(major: np.ndarray, minor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where in it a new one begins."""
    order = np.argsort(major)
    s = major[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if minor is not None:
        t = minor[order]
        if len(s) and bool(((t[1:] != t[:-1]) & ~new[1:]).any()):
            order = np.lexsort((minor, major))
            s, t = major[order], minor[order]
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return order, new


def _planes(ids: np.ndarray) -> bytes:
    """Eight-byte numbers, high bytes together: small numbers compress away."""
    return ids.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _bucket_edges(major: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (leading bits) present in sorted hashes, and where each begins."""
    bucket = (major >> K.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(major), np.int64)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return bucket[at], np.append(at, len(bucket))


def _messages(chunk: int, major: np.ndarray, minor: np.ndarray | None, ids: np.ndarray | None, bits: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    buckets, edges = _bucket_edges(major, bits)
    for k, b in enumerate(buckets.tolist()):
        s = slice(edges[k], edges[k + 1])
        yield b, chunk, major[s].tobytes(), b"" if minor is None else minor[s].tobytes(), b"" if ids is None else _planes(ids[s])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_MESSAGE = "bucket int, chunk int, major binary, minor binary, ids binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("major", pa.binary()), ("minor", pa.binary()), ("ids", pa.binary())])
_ANSWER = "chunk int, bucket int, step int, bits binary"
_ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("step", pa.int32()), ("bits", pa.binary())])


def _answer(table: pa.Table, step: int, later_only: bool) -> pa.Table:
    """One bucket, sorted: which hashes of each chunk another chunk has too."""
    major = [np.frombuffer(x, K.U64) for x in table["major"].to_pylist()]
    size = np.array([len(x) for x in major], np.int64)
    minor = None
    if step:
        minor = np.concatenate([np.frombuffer(x, np.uint32) for x in table["minor"].to_pylist()])
    order, new = _distinct(np.concatenate(major), minor)
    begin = np.flatnonzero(new)
    if step and later_only:
        ids = np.concatenate([_unplanes(x) for x in table["ids"].to_pylist()])[order]
        least = np.minimum.reduceat(ids, begin)
        hit = np.repeat(least, np.diff(np.append(begin, len(ids)))) < ids
    else:
        many = np.diff(np.append(begin, len(order))) > 1
        hit = np.repeat(many, np.diff(np.append(begin, len(order))))
    flag = np.empty(len(order), bool)
    flag[order] = hit
    edge = np.append(0, np.cumsum(size))
    chunks, buckets = table["chunk"].to_pylist(), table["bucket"].to_pylist()
    return _table(_ANSWER_ARROW, [(c, b, step, np.packbits(flag[edge[k] : edge[k + 1]]).tobytes()) for k, (c, b) in enumerate(zip(chunks, buckets, strict=True))])


class _Chunk:
    """The texts of one chunk in a fixed order, and what the answers say of them."""

    def __init__(self, plan: Plan, table: pa.Table):
        self.table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = self.table["text"]
        self.text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        if isinstance(self.text, pa.ChunkedArray):
            self.text = pa.concat_arrays(self.text.chunks) if self.text.num_chunks else pa.array([], pa.string())
        self.ids = np.asarray(self.table["id"]).astype(np.int64)
        self.plan = plan
        self.values, self.counts = plan.tokens(self.text)

    def anchors(self, answers: pa.Table | None, bits: int):
        """Anchors as messages, or (with answers) the places of those that repeat."""
        at, h = _anchors(self.plan, self.values, self.counts)
        order, new = _distinct(h, None)
        unique = h[order][new]
        if answers is None:
            return unique
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=len(unique)) > 1
        many |= _bits(answers, 0, unique, bits)
        return np.sort(at[order][many[group]])

    def candidates(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows that hold one of ``anchors``, and their hashes."""
        at = _windows(self.plan, self.values, self.counts, anchors)
        return at, _hashes(self.values, at, self.plan.window, K.BASES[0] ^ 0x5DEECE66C)

    def windows(self, at: np.ndarray, major: np.ndarray, round_: int, answers: pa.Table | None, bits: int):
        """Candidates of one round as messages, or (with answers) the places of those that repeat."""
        plan = self.plan
        if plan.rounds > 1:
            # Rounds go by low bits, buckets by high ones.
            mine = major % K.U64(plan.rounds) == K.U64(round_)
            at, major = at[mine], major[mine]
        minor = (_hashes(self.values, at, plan.window, K.BASES[1]) >> K.U64(32)).astype(np.uint32)
        order, new = _distinct(major, minor)
        begin = np.flatnonzero(new)
        at, unique = at[order], major[order][new]
        least = own = None
        if plan.later_only:
            own = np.repeat(self.ids, self.counts)[at]
            least = np.minimum.reduceat(own, begin) if len(begin) else own
        if answers is None:
            return unique, minor[order][new], least
        times = np.diff(np.append(begin, len(at)))
        hit = np.repeat(_bits(answers, round_ + 1, unique, bits), times)
        hit |= own > np.repeat(least, times) if plan.later_only else np.repeat(times > 1, times)
        return at[hit]


def _bits(answers: pa.Table, step: int, unique: np.ndarray, bits: int) -> np.ndarray:
    """The answers of one step, in the order of the hashes that were asked."""
    steps, buckets, raw = (answers[c].to_pylist() for c in ("step", "bucket", "bits"))
    by = {b: x for s, b, x in zip(steps, buckets, raw, strict=True) if s == step}
    have, edges = _bucket_edges(unique, bits)
    out = np.zeros(len(unique), bool)
    for k, b in enumerate(have.tolist()):
        n = edges[k + 1] - edges[k]
        out[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(by[b], np.uint8), count=n).astype(bool)
    return out


def repeats(documents: DataFrame, plan: Plan, finish: Callable[[pa.Array, list[np.ndarray], np.ndarray], list[pa.Array]], result: T.StructType, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and those of ``result``, one row for each row of ``documents``.

    ``finish`` gets the texts of a chunk, of each the tokens covered by repeated
    windows (true where covered) and the numbers of tokens, and returns the
    columns of ``result``. A null text has no tokens; a null id counts as larger
    than any other, and ids may be of any type that sorts; rows that repeat are
    rows of their own.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = numbered(documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "doc_id", F.col("text").alias("text"))).select("row", "id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // plan.chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    light = dealt.drop("row")
    v, members = difference_cover(plan.q)
    bits = max(0, int(np.ceil(np.log2(max(1, total * len(members) / v / plan.bucket_rows)))))

    def ask_anchors(table: pa.Table) -> pa.Table:
        unique = _Chunk(plan, table).anchors(None, bits)
        return _table(_MESSAGE_ARROW, list(_messages(table["chunk"][0].as_py(), unique, None, None, bits)))

    def answer(step: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: _answer(table, step, plan.later_only)

    def ask_windows(round_: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            chunk = _Chunk(plan, table)
            got = chunk.windows(*chunk.candidates(chunk.anchors(answers, bits)), round_, None, bits)
            return _table(_MESSAGE_ARROW, list(_messages(table["chunk"][0].as_py(), *got, bits)))

        return ask

    schema = T.StructType([rows.schema["row"], *result.fields])

    def settle(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(plan, table)
        at, major = chunk.candidates(chunk.anchors(answers, bits))
        upto = np.zeros(len(chunk.values) + 1, np.int32)
        for r in range(plan.rounds):
            upto[chunk.windows(at, major, r, answers, bits) + 1] = 1
        # A token goes if a repeated window begins at it or up to window - 1 before it.
        np.cumsum(upto, out=upto)
        gone = upto[1:].copy()
        if len(gone) > plan.window:
            gone[plan.window :] -= upto[1 : -plan.window]
        gone = gone > 0
        begin = _starts(chunk.counts)
        each = [gone[b : b + n] for b, n in zip(begin.tolist(), chunk.counts.tolist(), strict=True)]
        row = chunk.table["row"]
        return pa.Table.from_arrays([row, *finish(chunk.text, each, chunk.counts)], names=[f.name for f in schema])

    asked = light.groupBy("chunk").applyInArrow(ask_anchors, _MESSAGE)
    answers = materialize(asked.groupBy("bucket").applyInArrow(answer(0), _ANSWER), "anchors")
    known = answers
    for r in range(plan.rounds):
        asked = light.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask_windows(r), _MESSAGE)
        known = known.unionByName(materialize(asked.groupBy("bucket").applyInArrow(answer(r + 1), _ANSWER), f"windows-{r}"))
    out = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(settle, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *[f.name for f in result.fields])
