"""Quality rules: base counts of the text and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs fall into hash buckets, a power of two of them that leaves about ``PER_BUCKET`` distinct n-grams to
each (``n_buckets``, from an approximate distinct count of all n-grams), so the table grows with the corpus. Two
multinomials over the buckets are counted, one from trusted documents and one from the whole raw corpus, both smoothed by
one; a document's verdict is the mean over all its n-grams of log(p_trusted / p_raw), held against a fixed threshold.
Nothing is sampled: every trusted id counts, every document counts and gets its verdict from every one of its n-grams, and
the ratios are whole micro-nats, so sums don't depend on their order.

Scale: the texts are split into words twice. The first pass writes, for each document, the base counts and one in ``SAMPLE``
of its n-grams by hash, from which the distinct ones are estimated. The table is cut into slices of consecutive buckets
(``n_slices``), and a slice's documents into shares of about ``SHARE`` places (``n_shares``), so a slice is as many tasks as it
has work for. A document sends each slice its places there, packed into two or three bytes each, in one shuffle; shares
count their places, the counts of a slice's shares are added up, its ratios go to each of its shares, and one light row
per document and slice goes back. A table of up to 2^25 buckets (some 8 GB of text) has 8 slices, a larger one slices
of 2^22, which a task holds in memory; as slices grow in number, a document sends more and smaller rows. Trusted ids are
broadcast up to ``BROADCAST_IDS`` of them; beyond that, texts meet them in a shuffled join. The row of a document is known
by a 63-bit hash of its id and text (a billion documents have 0.05 clashes to be expected). All work on a text is linear in
its length or sorts its words. ``fit_ratio`` and ``judge`` do the same with a table of a given, small size as a constant
of the plan.

Defined results: null text has no words, fails the base rules and is dropped. A text without n-grams has ratio 0. Without
trusted documents the verdict is the base rules'. Rows that repeat an id are judged each; the trusted mark belongs to
the id. A null id is never trusted. Other columns are ignored and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import WHITE, cut, let, skew_join, text_of

PER_BUCKET, THRESHOLD = 20, -0.1
SAMPLE, SHARE = 64, 1 << 26
BROADCAST_IDS = 1 << 21
FEW = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+", -1), "")


def _upto(low: int, high: Column) -> Column:
    """low, ..., high, or nothing if high is lower."""
    return F.when(high >= low, F.sequence(F.lit(low), high)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that occurs at least twice."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")))["n"]

    def count(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.array_distinct(F.transform(F.filter(_upto(1, F.size(s) - 1), lambda i: s[i - 1] == s[i]), lambda i: s[i]))

            def of_twice(d: Column) -> Column:
                few = covered(F.filter(_upto(0, F.size(hashes) - 1), lambda i: F.array_contains(d, hashes[i])))
                pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
                last = F.size(hashes) - 1
                same = lambda p: F.filter(_upto(0, last), lambda k: ((k > 0) & (F.get(p, k - 1)["h"] == p[k]["h"])) | ((k < last) & (F.get(p, k + 1)["h"] == p[k]["h"])))
                many = let(pairs, lambda p: covered(F.sort_array(F.transform(same(p), lambda k: p[k]["i"]))))
                return F.when(F.size(d) == 0, 0).when(F.size(d) <= FEW, few).otherwise(many)

            return let(twice, of_twice)

        return let(F.sort_array(hashes), of_sorted)

    windows = F.transform(_upto(0, F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, count))


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the array ``words`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    solid = WHITE.replace("[", "[^")
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(solid))
    out = docs.withColumn("words", words_of(F.col(text)))
    found = let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    out = out.withColumn("found", found).select(
        *docs.columns,
        "words",
        F.col("found.n_words").alias("n_words"),
        F.length(F.regexp_replace(F.col(text), WHITE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(text), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("found.n_repeat_words").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ngrams(words: Column) -> Column:
    """64-bit hashes of every word and then of every word pair."""
    pairs = lambda h: F.transform(_upto(0, F.size(h) - 2), lambda i: F.xxhash64(h[i], h[i + 1]))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(h, pairs(h)))


def ngram_buckets(words: Column, buckets: int) -> Column:
    return F.transform(_ngrams(words), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def n_buckets(distinct: int) -> int:
    """The power of two that leaves about ``PER_BUCKET`` of so many n-grams to a bucket."""
    return 1 << max(0, round(math.log2(max(1, distinct / PER_BUCKET))))


def n_slices(buckets: int) -> int:
    """8 slices of up to 2^22 buckets each, more of 2^22."""
    return min(buckets, max(8, buckets >> 22))


def n_shares(places: int, slices: int) -> int:
    return max(1, -(-places // (slices * SHARE)))


def _marks(trusted_ids: DataFrame) -> DataFrame:
    return trusted_ids.select("id").where("id is not null").distinct().withColumn("trusted", F.lit(1))


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 15) -> list[int]:
    """log(p_trusted / p_raw) of every bucket in micro-nats, for small corpora; ``trusted_ids`` has the column ``id``."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = skew_join(rows, _marks(trusted_ids), ["id"], "left")
    grams = rows.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(ngram_buckets(words_of(F.col("text")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.sum("trusted").alias("t"), F.count("*").alias("r")).toArrow()
    t, r = [0] * buckets, [0] * buckets
    for b, x, y in zip(*(counts.column(i).to_pylist() for i in range(3)), strict=True):
        t[b], r[b] = x, y
    n_t, n_r = sum(t) + buckets, sum(r) + buckets
    if n_t == buckets:
        return [0] * buckets
    return [round(1e6 * math.log((x + 1) / n_t * n_r / (y + 1))) for x, y in zip(t, r, strict=True)]


def _verdict(out: DataFrame, id_col: str, threshold: float) -> DataFrame:
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def judge(docs: DataFrame, ratio: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, kept, llr (mean ratio in nats)."""
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<int>")  # folded to one constant
    rows = base_counts(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), "text")
    grams = ngram_buckets(F.col("words"), len(ratio))
    mean = let(grams, lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + table[b]) / F.greatest(F.size(g), F.lit(1)) / 1e6)
    return _verdict(rows.withColumn("llr", mean), id_col, threshold)


def _ratio(t: str, r: str, n_t: int, n_r: int) -> Column:
    return F.round(1e6 * F.log((F.col(t) + 1) / F.lit(n_t) * F.lit(n_r) / (F.col(r) + 1))).cast("int")


def _ranks(g: Column, bits: int, slices: int) -> Column:
    """How many numbers of a sorted array lie below k * 2^bits, for k = 0, ..., ``slices``: by steps of halving size."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(F.size(g), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    below = lambda v, s: F.aggregate(s, F.lit(0), lambda at, n: F.when((at + n <= F.size(g)) & (F.get(g, at + n - 1) < v), at + n).otherwise(at))
    return let(steps, lambda s: F.transform(F.sequence(F.lit(0), F.lit(slices)), lambda k: below(F.call_function("shiftleft", k.cast("long"), F.lit(bits)), s)))


def rule(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int | None = None, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """As ``judge``, by the ratios of ``docs`` and ``trusted_ids`` themselves, with a table as large as the data ask for."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    marks = _marks(trusted_ids)
    few = marks.limit(broadcast_ids + 1).count() <= broadcast_ids
    marked = rows.join(F.broadcast(marks), "id", "left") if few else cut(skew_join(rows, marks, ["id"], "left"))
    marked = marked.select("id", "text", "uid", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    seen = let(_ngrams(F.col("words")), lambda g: F.struct(F.size(g).alias("grams"), F.filter(g, lambda h: h.bitwiseAND(F.lit(SAMPLE - 1)) == 0).alias("sample")))
    base = cut(base_counts(marked, "text").withColumn("seen", seen).drop("text", "words"))
    total, of_trusted = base.agg(F.sum("seen.grams"), F.sum(F.col("trusted") * F.col("seen.grams"))).first()
    if not of_trusted:
        return _verdict(base.withColumn("llr", F.lit(0.0)), id_col, threshold)
    distinct = SAMPLE * base.select(F.explode("seen.sample").alias("h")).agg(F.approx_count_distinct("h")).first()[0]
    buckets = buckets or n_buckets(distinct)
    n_t, n_r = of_trusted + buckets, total + buckets

    slices = n_slices(buckets)
    bits, low = (buckets // slices).bit_length() - 1, 1 << 15  # places in a slice go as 16 bits and, where there are more, the bits above them
    short = lambda x: (x.bitwiseAND(F.lit((1 << min(16, bits)) - 1)) - low).cast("short")
    upper_bits = lambda x: F.shiftright(x, 16).bitwiseAND(F.lit((1 << max(0, bits - 16)) - 1)).cast("byte")
    above = lambda a: F.transform(a, upper_bits) if bits > 16 else F.lit(None).cast("array<byte>")

    def pieces(g: Column) -> Column:
        def cut_at(ends: Column) -> Column:
            own = lambda k: F.slice(g, F.get(ends, k) + 1, F.get(ends, k + 1) - F.get(ends, k))
            piece = lambda k: let(own(k), lambda x: F.struct(k.alias("slice"), F.transform(x, short).alias("at"), above(x).alias("up")))
            return F.transform(F.filter(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: F.get(ends, k) < F.get(ends, k + 1)), piece)

        return let(_ranks(g, bits, slices), cut_at)

    # A document goes by its uid's upper bits, the lowest says whether it is trusted.
    shares = n_shares(total, slices)
    tag = F.col("uid").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("trusted").cast("long")).alias("tag")
    every_place = F.sort_array(F.transform(_ngrams(words_of(F.col("text"))), lambda h: h.bitwiseAND(F.lit(buckets - 1))))  # buckets is a power of two
    places = marked.select(tag, let(every_place, pieces).alias("pieces")).select("tag", F.inline_outer("pieces")).where("slice is not null")  # inline would test the pieces' number first, making them twice
    share = F.coalesce(F.pmod(F.shiftright("tag", 1), F.lit(shares)).cast("int"), F.lit(0))  # never null, as the planner can see: see below
    sliced = places.withColumn("share", share).repartition("slice", "share")

    upper = F.shiftleft(F.get("up", "i").cast("int"), 16) if bits > 16 else F.lit(0)
    at = F.col("p").cast("int") + low + upper

    # Both readers share the shuffle, as long as neither has a filter to push under it: explode would (for empty arrays), and
    # a join would by keys that may be null. Every place counts once more, as nothing: so a slice's table is its ratios in
    # order, without gaps.
    opened = sliced.select("slice", "tag", "up", F.posexplode_outer("at").alias("i", "p")).select("slice", at.alias("p"), F.col("tag").bitwiseAND(F.lit(1)).alias("t"), F.lit(1).cast("long").alias("r"))
    nothing = F.lit(0).cast("long")
    every = docs.sparkSession.range(buckets).select(F.shiftright("id", bits).cast("int").alias("slice"), F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("p"), nothing.alias("t"), nothing.alias("r"))
    counted = opened.unionAll(every).groupBy("slice", "p").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    ratios = counted.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("p", _ratio("t", "r", n_t, n_r).alias("x"))))["x"].alias("table"))
    tables = ratios.select("slice", "table", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    read = sliced.join(tables.hint("shuffle_hash"), ["slice", "share"]).select("tag", "table", "up", F.posexplode_outer("at").alias("i", "p"))
    sums = read.groupBy(F.shiftright("tag", 1).alias("key")).agg((F.sum(F.get("table", at)) / F.count("p") / 1e6).alias("llr"))
    found = skew_join(base.withColumn("key", F.shiftright("uid", 1)), sums, ["key"], "left")
    return _verdict(found.withColumn("llr", F.coalesce("llr", F.lit(0.0))), id_col, threshold)
