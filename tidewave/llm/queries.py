"""The corpus queries: ``queries()`` and ``oracle_sql()`` for ``__spark_entry__.py``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import byte_bpe, hard_negatives, licenses, mixing, packing, periodic_runs, quality_model, quality_rules, secrets, toxicity, warc
from tidewave.llm.common import WHITE, let, shared_dir, text_of
from tidewave.llm.exact_dedup import exact_dedup
from tidewave.llm.near_dedup import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("n_chars")


def op3_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality_rules.rule(docs, trusted)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per showing of a document; sort by place, source, block, in_block for the order of the whole."""
    shown = mixing.ordered(_table(spark, sf_dir, "documents"), max_repeats=2.0)
    return shown.select("doc_id", "source", "mix_epoch", "mix_tokens", "mix_block", "mix_place", "mix_order.of_block", "mix_order.in_block")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.findings(_table(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), best.alias("containment"))


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(spark, "file://" + public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), label)


def planted(doc_id: Column, text: Column) -> Column:
    """One document in ten with words that repeat from some place on: where crc32(doc_id) ends in 0, as its other digits say."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        def at(x: Column) -> Column:
            return F.transform(w, lambda v, i: F.when(i < x["a"], v).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))

        a = g % F.size(w)
        return F.array_join(let(F.struct(a.alias("a"), (1 + F.floor((F.size(w) - a) / (3 + g % 8))).alias("p")), at), " ")

    words = F.array_remove(F.split(text, WHITE + "+", -1), "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs.find_runs(docs.select("doc_id", planted(F.col("doc_id"), text_of("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("m", longest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.s")).alias("start"), F.col("m.n").alias("length"), (-F.col("m.p")).alias("period"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))


OP2_SQL = r"""
with n as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), k as (
  select doc_id, norm, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size
  from n window w as (partition by norm order by length(t) desc, doc_id)
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k
"""


OP8_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
), k as (select *, min(page_id) over (partition by d) as first_id, row_number() over (partition by d order by page_id nulls last) as place from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 100 and place > 1 and first_id is not null then 'revisit' else 'response' end as record_type,
  case when n >= 100 and place > 1 then first_id end as refers_to
from k
"""


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_dot_product(a.e, r.e)::bigint as score
  from v a join v r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over w)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, id) qualify row_number() over w <= 3
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op6_sql() -> str:
    """Pieces and matches of each rule alternate: a match ends where the lengths so far add up to."""
    parts = [
        f"""select doc_id, {rank} as rank, {_quoted(r.kind)} as kind, {r.least} as least, string_split_regex(t, {_quoted(r.pattern)}) as p,
  regexp_extract_all(t, {_quoted(r.pattern)}, 0) as m, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) as g from d where regexp_matches(t, {_quoted(r.pattern)})"""
        for rank, r in enumerate(secrets.RULES)
    ]
    joined = lambda base: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where kind is not null{base}), '')"
    n = lambda kind: f"count(*) filter (where kind = '{kind}') as n_{kind}"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), r as ({' union all '.join(parts)}),
u as (select doc_id, rank, kind, least, generate_subscripts(m, 1) as k, unnest(p[:len(m)]) as p, unnest(m) as m, unnest(g) as g from r),
f as (select doc_id, rank, kind, least, length(m) as n, length(g) as j, sum(length(p) + length(m)) over (partition by doc_id, rank order by k) as e from u),
h as (select doc_id, rank, kind, (e - n)::bigint as s, e::bigint as e from f where j >= least)
select d.doc_id, {n('assign')}, {n('access')}, {n('hex')}, sha256({joined(" and kind in ('assign', 'access', 'hex')")}) as base_sha256, {joined('')} as spans
from d left join h on d.doc_id = h.doc_id group by d.doc_id"""


#: The notices that the license query must find, written out apart from the operator's own.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def op9_sql() -> str:
    """The same windows, with every notice's shingles (of five words, or of all words of a shorter one) counted exactly in each."""
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(NOTICES))
    words = lambda text: f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""with t0(tid, name, text) as (values {rows}), t1 as (select tid, name, {words('text')} as w from t0), t2 as (select tid, name, w, least(5, len(w)) as width from t1),
t as (select distinct tid, width, array_to_string(w[i:i + width - 1], ' ') as shingle from (select tid, w, width, unnest(range(1, len(w) - width + 2)) as i from t2)),
n as (select tid, name, size, pow(2, ceil(log2(size)))::bigint as step from (select tid, count(*) as size from t group by tid) join t2 using (tid)),
d as (select doc_id, {words("coalesce(text, '')")} as w from documents),
s as (select doc_id, width, i - 1 as pos, array_to_string(w[i:i + width - 1], ' ') as shingle from (select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as i from d, (select distinct width from t))),
h as (select doc_id, tid, shingle, pos // step - back as win from s join t using (width, shingle) join n using (tid), (values (0), (1)) b(back) where pos // step >= back),
m as (select doc_id, tid, win, count(distinct shingle) as c from h group by all), f as (select doc_id, name, c / size::double as share from m join n using (tid) where 100 * c >= 80 * size)
select d.doc_id, coalesce(string_agg(distinct name, ',' order by name), '') as licenses, count(distinct name) as n_licenses, coalesce(max(share), 0.0) as containment
from d left join f on d.doc_id = f.doc_id group by d.doc_id"""


def queries() -> dict:
    found = (
        op1_best_fit_packing, op2_exact_dedup, op3_ngram_ratio_rules, op4_temperature_mixing, op5_minhash_near_dedup,
        op6_secret_ledger, op7_ordinal_toxicity, op8_warc_round_trip, op9_license_scan, op10_fourier_quality,
        op11_byte_bpe, op12_hard_negatives, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_secret_ledger": op6_sql(), "op8_warc_round_trip": OP8_SQL, "op9_license_scan": op9_sql(), "op12_hard_negatives": OP12_SQL}
