"""Removal of word passages that also begin in an earlier document.

Difference-cover anchors (see ``cover``): windows of 50 words; the hashes of 20
words at the 6 of 31 places of a cover are exchanged first, since any two equal
windows share an aligned one; the windows around shared anchors follow.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.llm import kernels as K
from presswork.llm.cover import Plan, repeats

#: Words in a window.
WINDOW = 50


def word_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.views(texts)
    starts, ends, counts = K.word_spans(data, offsets, K.SPACED)
    return K.span_hashes(data, starts, ends), counts


PLAN = Plan(tokens=word_tokens, window=WINDOW, q=5, later_only=True)
_RESULT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])


def _keep_words(texts: pa.Array, gone: list[np.ndarray], counts: np.ndarray) -> list[pa.Array]:
    data, offsets = K.views(texts)
    raw, removed, kept = data.tobytes(), [], []
    for k, g in enumerate(gone):
        words = raw[offsets[k] : offsets[k + 1]].split()
        n = int(g.sum())
        removed.append(n)
        kept.append(b" ".join(compress(words, (~g).tolist()) if n else words))
    return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]


def dedup_passages(documents: DataFrame, keep: list[str] | None = None, plan: Plan = PLAN) -> DataFrame:
    """Columns ``keep`` of ``documents`` (all but text), ``kept``, ``n_words``, ``n_removed``.

    A window is 50 consecutive words of one text; words are separated by ASCII
    white space. Every word covered by a window that also begins in a document
    with a smaller doc_id goes; ``kept`` has the others, joined by single blanks.
    Windows are judged on the input. Null and empty texts have no words; shorter
    texts than a window stay whole; documents with one id never remove words of
    each other; a null id counts as the largest. An empty table stays empty.
    """
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("text", *_RESULT.names)]
    return repeats(documents, plan, _keep_words, _RESULT, names)


def substring_report(documents: DataFrame) -> DataFrame:
    """Words removed and a digest of the rest, for all documents (query ``op2``)."""
    found = dedup_passages(documents, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS x FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM h),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM m WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, coalesce(r.gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, w, gone FROM k),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM f),
o AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT f.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM f LEFT JOIN o USING (doc_id)
"""
