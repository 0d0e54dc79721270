"""Exact deduplication by distributed most-significant-digit radix partitioning.

Every document is one string of bytes (its text without white space). Documents are split by successive runs of bytes:
the first round groups by the first ``first_digit`` bytes, the next by the following, wider run within each group, and
so on. A group that holds one document is finished, and so is one whose documents have all ended; both leave the
recursion. Texts are equal exactly when they end in the same group, so no digest takes part in the decision
(``text_sha256`` is only an output).

Scale: a round is one aggregate with map-side combining on (group, digit), so a third of all rows being copies of one
text reaches the shuffle as one row per task, and one join that adaptive execution can split. The whole text is
shuffled once, in the first round; later rounds carry the unread rest of the documents that still share a prefix with
another. The width of a digit grows fourfold, so even texts of hundreds of megabytes need about a dozen rounds, and
only the longest *shared* prefix counts.

``drop_exact_copies`` numbers the rows in a written table and drops by those numbers, so there too equality alone decides.

Defined results: null text counts as empty; empty texts equal one another. Null ids sort last and are never equal to
another id. Of rows that repeat both id and text exactly one is kept. Other columns are ignored and may have any name;
``drop_exact_copies`` returns them as they were. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import WHITE, cut, skew_join, stored, text_of

FIRST_DIGIT = 48
GROWTH = 4


def _normal(text: str):
    return F.regexp_replace(text_of(text), WHITE + "+", "")


def _digit(width: int):
    """The next run of bytes and whether the document ends within it."""
    return [F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended")]


def _decided(docs: DataFrame, id_col: str, text_col: str, first_digit: int, growth: int, given: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: rid (a number of the row, unless ``given``), id, n_chars, sha, and of groups of several rows c (rows), keep (id) and keep_rid."""
    base = docs.select(*given, F.col(id_col).alias("id"), F.length(text_of(text_col)).cast("long").alias("n_chars"), _normal(text_col).alias("norm"))
    first = base.select(*given, "id", "n_chars", F.sha2("norm", 256).alias("sha"), F.encode("norm", "UTF-8").alias("rest"))
    heads = base.select(F.encode("norm", "UTF-8").alias("rest")).select(*_digit(first_digit)).groupBy("digit", "ended").agg(F.count("*").alias("c")).where("c > 1")
    shared = F.col("c").isNotNull()
    rows = skew_join(first.select("*", *_digit(first_digit)), heads, ["digit", "ended"], "left").select(
        *given, "id", "n_chars", "sha", F.when(shared, F.col("digit")).alias("gid"), F.when(shared, F.expr(f"substring(rest, {first_digit + 1})")).alias("rest")
    )
    rows = cut(rows)
    if not given:
        rows = rows.withColumn("rid", F.monotonically_increasing_id())  # the files fix the rows' order, so ids are the same at every read

    active, done, width = rows.where("gid is not null").drop("sha"), [], first_digit * growth
    while True:
        split = active.select("*", *_digit(width))
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("rid").alias("rid")))
        groups = split.groupBy("gid", "digit", "ended").agg(F.count("*").alias("c"), F.min("rid").alias("next"), best.alias("best")).where("c > 1")
        split = cut(
            skew_join(split, groups, ["gid", "digit", "ended"]).select(
                "rid", "id", "n_chars", F.col("next").alias("gid"), "ended", "c", "best", F.when(~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest")
            )
        )
        done.append(split.where("ended").select("rid", "c", F.col("best.id").alias("keep"), F.col("best.rid").alias("keep_rid")))
        active = split.where("not ended").select("rid", "id", "n_chars", "gid", "rest")
        if active.isEmpty():
            break
        width *= growth
    classes = done[0]
    for d in done[1:]:
        classes = classes.unionByName(d)
    return rows.select("rid", "id", "n_chars", "sha").join(classes, "rid", "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the one with the most code points in its original form stays, then the one with the smallest id.
    """
    out = _decided(docs.select(id_col, text_col), id_col, text_col, first_digit, growth)
    alone = F.col("c").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "n_chars",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were; the same one as ``exact_dedup`` keeps."""
    own = stored(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid")))
    found = _decided(own.select("rid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text")), "id", "text", FIRST_DIGIT, GROWTH, ("rid",))
    gone = cut(found.where("rid <> keep_rid").select("rid"))
    return own.join(gone, "rid", "left_anti").select("row.*")
