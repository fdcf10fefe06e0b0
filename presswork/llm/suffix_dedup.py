"""Removal of byte strings that occur more than once.

Suffixes of all texts, blockwise. A difference cover modulo 133 (12 places)
picks the sample: the 68 bytes at sample places are ranked first, one bucket at
a time, into those that occur once and those that occur again. Two suffixes
that agree on 200 bytes agree on an aligned sample place, so only suffixes with
a repeated sample in reach can tie that long; the others drop out before the
main sort. That runs by rounds and, in a round, bucket after bucket, so memory
holds one bucket and disk one round. Inside a bucket the suffixes are ordered
by a 96-bit digest of their first 200 bytes, which brings equal ones together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm import kernels as K
from presswork.llm.cover import Plan, repeats

#: Bytes in a string that must not repeat.
WINDOW = 200


def byte_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.views(texts)
    return data, np.diff(offsets)


PLAN = Plan(tokens=byte_tokens, window=WINDOW, q=11, later_only=False, rounds=3)
_RESULT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _keep_bytes(texts: pa.Array, gone: list[np.ndarray], counts: np.ndarray) -> list[pa.Array]:
    data, offsets = K.views(texts)
    kept, spans = [], []
    for k, g in enumerate(gone):
        own = data[offsets[k] : offsets[k + 1]]
        if g.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            own = own[~g]
        else:
            spans.append([])
        kept.append(own.tobytes())
    return [pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(spans, _SPANS)]


def dedup_suffixes(documents: DataFrame, keep: list[str] | None = None, plan: Plan = PLAN) -> DataFrame:
    """Columns ``keep`` of ``documents`` (all but text), ``kept``, ``n_bytes``, ``removed``.

    Texts are UTF-8 bytes. Every byte covered by a string of 200 bytes that also
    begins anywhere else, in the same text or another, goes: all occurrences,
    the first too, and overlapping ones. ``kept`` is what is left (it may split
    a character), ``removed`` the maximal runs taken out. Strings are judged on
    the input and never cross texts. Null and empty texts have no bytes; rows
    that repeat are occurrences of their own. An empty table stays empty.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("text", *_RESULT.names)]
    return repeats(documents, plan, _keep_bytes, _RESULT, names)


def suffix_report(documents: DataFrame) -> DataFrame:
    """Bytes and runs removed and a digest of the rest, for all documents (query ``op9``)."""
    found = dedup_suffixes(documents, keep=["doc_id"])
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB; bytes are pairs of hexadecimal digits.
SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS nth, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT nth, h, unnest(generate_series(0, length(h) // 2 - 200)) AS i FROM d WHERE length(h) >= 400),
w AS (SELECT nth, i, md5(substr(h, 2 * i + 1, 400)) AS x FROM s),
m AS (SELECT nth, i FROM (SELECT nth, i, count(*) OVER (PARTITION BY x) AS many FROM w) WHERE many > 1),
b AS (SELECT nth, i, coalesce(i - lag(i) OVER (PARTITION BY nth ORDER BY i) > 200, true) AS new FROM m),
g AS (SELECT nth, i, sum(new::INT) OVER (PARTITION BY nth ORDER BY i) AS run FROM b),
r AS (SELECT nth, run, min(i) AS low, max(i) + 200 AS high FROM g GROUP BY nth, run),
k AS (SELECT nth, coalesce(lag(high) OVER (PARTITION BY nth ORDER BY low), 0) AS low, low AS high FROM r
      UNION ALL SELECT nth, max(high), NULL FROM r GROUP BY nth),
p AS (SELECT d.nth, string_agg(substr(h, 2 * k.low + 1, 2 * (coalesce(k.high, length(h) // 2) - k.low)), '' ORDER BY k.low) AS kept FROM d JOIN k USING (nth) GROUP BY d.nth),
n AS (SELECT nth, sum(high - low) AS gone, count(*) AS runs FROM r GROUP BY nth)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN p USING (nth) LEFT JOIN n USING (nth)
"""
