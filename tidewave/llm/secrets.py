"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

A version is a path with a text. Each text is content-addressed (SHA-256), so any number of paths and historical versions
share one blob. The ledger has one row per blob and rule version: what that rule found there. A rule's version is a hash
of all that defines it, so a rule that is added or changed is scanned for, and only it, in every blob. Only pairs that the
ledger doesn't have are scanned, and findings are joined back to all paths. Spans are in code points, end exclusive.

Positions come from splitting a text at a rule's matches: pieces and matches alternate, so running sums of their
lengths are the spans. That is linear in the text; matches become rows, and a window over the matches of one blob and
rule adds them up.

Scale: texts are shuffled once, to keep one per blob (copies collapse on the map side first); nothing else carries
text. A hot blob's many paths meet its one finding in a join that adaptive execution can split. Of a blob the ledger
holds one row with the rules that were scanned and their spans, not a row per rule.

Defined results: null text counts as empty and has no spans. Rows that repeat a path are versions of their own. A null
path keeps its findings. Ledger rows that repeat a blob, be they equal or of several runs, count together and once. Spans
of rules that are not asked for are left in the ledger and out of the result. Other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm.common import cut, skew_join, text_of


@dataclass(frozen=True)
class Rule:
    """A match counts if its group (0: all of it) has at least ``least`` characters; one that doesn't is still passed over."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """Changes whenever the rule does."""
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: The base rules, in their order, then more of the same sort.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rules array<string>, spans array<struct<start:long,rule:string,end:long>>"


def versions_of(rows: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob, text)"""
    text = text_of(text_col)
    return rows.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def _may_match(rule: Rule) -> str:
    """A cheaper pattern that every counted match contains: runs too short to count don't start a costly pass."""
    return rule.pattern[:-1] + "{%d,}" % rule.least if rule.kind == "hex" else rule.pattern


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, start, rule, end) for each match in (blob, text, todo) rows, of the rules whose versions are in the array ``todo``."""
    parts = []
    for rule in rules:
        # Short hex runs are everywhere; that pattern takes maximal runs, so asking for the least length finds the same ones.
        pattern = _may_match(rule)
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        judged = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else whole
        pieces = F.split("text", pattern, -1)
        size = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
        wanted = F.array_contains("todo", rule.version) & F.col("text").rlike(pattern)
        parts.append(F.struct(F.lit(rule.version).alias("rule"), F.lit(rule.least).cast("long").alias("least"), F.when(wanted, F.arrays_zip(size(pieces).alias("piece"), size(whole).alias("match"), size(judged).alias("judged"))).alias("m")))
    found = blobs.select("blob", F.explode(F.array(*parts)).alias("r")).where("r.m is not null").select("blob", "r.rule", "r.least", F.posexplode("r.m").alias("k", "m"))
    before = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.piece") + F.coalesce("m.match", F.lit(0))).over(before)
    return found.withColumn("end", end).where("m.match is not null and m.judged >= least").select("blob", (F.col("end") - F.col("m.match")).alias("start"), "rule", "end")


def _versions(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.lit(r.version) for r in rules))


def known(ledger: DataFrame) -> DataFrame:
    """The ledger with one row per blob: all rules that were scanned there, and all their spans, each once."""
    merged = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    return merged.where("blob is not null")


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One (blob, text, todo) for each blob that some of the rules haven't been scanned for; ``todo`` has their versions."""
    one = versions.groupBy("blob").agg(F.first("text").alias("text"))
    seen = known(ledger).select("blob", F.col("rules").alias("seen"))
    todo = F.array_except(_versions(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return one.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).select("blob", "text", "todo")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: each blob with the rules scanned for now and their spans in order (empty if there are none)."""
    spans = scan(unseen(versions, ledger, rules), rules).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rule", "end"))).alias("spans"))
    seen = known(ledger).select("blob", F.col("rules").alias("seen"))
    todo = F.array_except(_versions(rules), F.coalesce("seen", F.array().cast("array<string>")))
    blobs = versions.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("rules")).where(F.size("rules") > 0)
    none = F.array().cast("array<struct<start:bigint,rule:string,end:bigint>>")
    return blobs.join(spans, "blob", "left").select("blob", "rules", F.coalesce("spans", none).alias("spans"))


def findings(rows: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) for every row, spans (start, rank, kind, end) of ``rules`` in order; and the ledger's new rows.

    Append the second to a stored ledger (``ledger_append``) and pass that again with the next versions.
    """
    spark = rows.sparkSession
    if len({r.version for r in rules}) < len(rules):
        raise ValueError("a rule is given twice")
    versions = versions_of(rows, path_col, text_col)
    new = cut(scan_new(versions, ledger if ledger is not None else empty_ledger(spark), rules))
    every = new if ledger is None else known(ledger.select("blob", "rules", "spans").unionByName(new))
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.version), F.lit(i))))
    kind = F.create_map(*(x for r in rules for x in (F.lit(r.version), F.lit(r.kind))))
    asked = F.filter("spans", lambda s: F.array_contains(_versions(rules), s["rule"]))
    named = F.array_sort(F.transform(asked, lambda s: F.struct(s["start"].alias("start"), rank[s["rule"]].alias("rank"), kind[s["rule"]].alias("kind"), s["end"].alias("end"))))
    return skew_join(versions.select("path", "blob"), every.select("blob", named.alias("spans")), ["blob"]), new


def ledger_append(new: DataFrame, folder: str) -> None:
    """Adds the new rows of a run to a ledger stored as Parquet; a run that is repeated adds rows that count once."""
    new.write.mode("append").parquet(folder)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """Counts and digests of spans: path, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias(path_col), n("assign"), n("access"), n("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
