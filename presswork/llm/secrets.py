"""Secrets in every version of every text, scanned once for each content.

A text is content-addressed by its SHA-256 (its blob). A ledger records which
rules, in which version, have been run on which blob, and what they found. A
scan runs only the unseen pairs of blob and rule version and joins the findings
of the ledger to all documents (paths) that hold the blob. Copies, and texts
that were scanned in an earlier run, cost no matching; a changed rule is run on
all blobs again, the others are not.

Everything runs on built-in functions. The text itself is shuffled only where a
keyword test, made while it is read to be hashed, lets it through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import free_shuffles, materialize, shared_dir
from presswork.llm.spans import SPAN, count_kind, find_all, labelled, listing


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    #: A cheap test that holds for every text with a match.
    gate: Callable[[Column], Column]
    pattern: str
    keep: Callable[[Column], Column] | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _has(*words: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        out = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(text, F.lit(w))
        return out

    return test


_NAMES = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = _NAMES + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""^.*?[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)$"""

_KEY = r"(?:(?!PRIVATE KEY-----)[A-Z0-9\x20])*+PRIVATE KEY-----"
#: A key up to its END line, or the BEGIN line alone if none follows before other five dashes.
_PRIVATE = rf"-----BEGIN {_KEY}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END {_KEY})?"

#: The base kinds first, in their order.
RULES = (
    Rule("assign", 1, lambda t: t.rlike(_NAMES + r"""["']?\x20*+[:=]"""), _ASSIGN, lambda m: F.length(F.regexp_extract(m, _VALUE, 1)) >= 12),
    Rule("access", 1, _has("AKIA"), r"AKIA[A-Z0-9]++", lambda m: F.length(m) >= 18),
    Rule("hex", 1, lambda t: t.rlike("[0-9a-f]{16}"), r"[0-9a-f]++", lambda m: F.length(m) >= 16),
    Rule("private_key", 2, _has("PRIVATE KEY-----"), _PRIVATE),
    Rule("forge_token", 1, _has("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-"), r"(?:gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat_token", 1, _has("xox"), r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", 2, _has("eyJ"), r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++"),
    Rule("cloud_key", 1, _has("AIza"), r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", 1, _has("_live_"), r"(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", 2, _has("://"), r"(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x00-\x20/:@]*+:[^\x00-\x20/@]++@"),
)
BASE = ("assign", "access", "hex")
_FINDINGS = "array<struct<kind:string,rule:string,start:int,end:int>>"
LEDGER_SCHEMA = f"blob string, rules array<string>, findings {_FINDINGS}"


def new_ledger(spark) -> str:
    """A place in the shared folder for an empty ledger."""
    path = f"{shared_dir(spark)}/presswork/ledger-{uuid.uuid4().hex}"
    empty = spark.range(0).select(F.from_json(F.lit("{}"), LEDGER_SCHEMA).alias("entry")).select("entry.*")
    empty.write.mode("append").parquet(path)
    return path


def update_ledger(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen pairs of ``texts`` (blob, text), append them to ``ledger`` and return it.

    The ledger is appended to in one job, after the scan: a run that fails adds
    nothing, and a repeated run finds nothing unseen.
    """
    spark = texts.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).select("blob", F.explode("rules").alias("rule"))
    seen = seen.where(F.col("rule").isin(*[r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))

    def unseen(blobs: DataFrame) -> DataFrame:
        left = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").withColumn("rules", left).where(F.size("rules") > 0).drop("seen")

    any_gate = rules[0].gate(F.col("text"))
    for r in rules[1:]:
        any_gate = any_gate | r.gate(F.col("text"))
    through = texts.where(any_gate).groupBy("blob").agg(F.first("text").alias("text"))
    text = F.col("text")
    rule = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.name))])
    found = [(r.kind, F.when(F.array_contains("rules", r.name) & r.gate(text), find_all(text, r.pattern, r.keep)).otherwise(F.array().cast(SPAN))) for r in rules]
    found = unseen(through).select("blob", F.transform(labelled(found), lambda s: F.struct(s["kind"].alias("kind"), rule[s["kind"]].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))
    every = unseen(texts.select("blob").distinct())
    entries = every.join(found.where(F.size("findings") > 0), "blob", "left").select("blob", "rules", F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings"))
    with free_shuffles(spark):
        entries.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def scan_history(documents: DataFrame, ledger: str | None = None, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep`` of ``documents`` (all), ``blob`` and ``findings``.

    ``findings`` lists kind, start and end (characters, end exclusive) of all
    matches of the current rules, by start, then in the order of the rules. A
    null text is scanned as an empty one; equal texts share a blob; rows that
    repeat are paths of their own; an empty table stays empty. Columns named
    blob and findings are replaced. Without ``ledger`` a new one is begun.
    """
    spark = documents.sparkSession
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("blob", "findings")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    known = update_ledger(rows.select("blob", "text"), ledger or new_ledger(spark), rules)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    current = known.where((F.size("findings") > 0) & F.arrays_overlap("rules", F.array(*[F.lit(r.name) for r in rules])))
    # A blob has an entry for each set of rules that was new to it; what an older version found no longer counts.
    valid = F.filter(F.flatten(F.collect_list("findings")), lambda s: s["rule"].isin(*[r.name for r in rules]))
    one = current.groupBy("blob").agg(valid.alias("all"))
    ranked = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    one = one.select("blob", F.transform(F.array_distinct(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("findings"))
    # Written first: the join below is then between two plain exchanges, and a blob that very many paths hold can be split.
    joined = rows.drop("text").join(materialize(one, "findings"), "blob", "left")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], "blob", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("findings"))


def secrets_report(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts and places of secrets in all documents (query ``op1``)."""
    found = scan_history(documents, ledger, keep=["doc_id"])
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count_kind(F.col("findings"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listing(base), 256).alias("base_sha256"),
        listing(F.col("findings")).alias("spans"),
        "blob",
    )
