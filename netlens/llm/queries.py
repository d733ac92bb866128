"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import (
    decontaminate,
    divergence,
    fingerprint,
    html_text,
    langid,
    line_runs,
    middle,
    near_dedup,
    packing,
    pii,
    quality,
    substring,
    toxicity,
)
from netlens.llm.common import id_remainder, prepare, table

#: The tokenizer file; a parameter of the operators, never part of the library.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _held_out(modulus: int, fold: int):
    return F.coalesce(id_remainder(modulus) == fold, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(decontaminate.item_list(F.col("items")), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.find(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels.where(id_remainder(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_remainder(5) != 0))
    return langid.predict(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels.where(id_remainder(4) != 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = middle.transform(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_fingerprint, op3_pii, op4_toxicity, op5_substring_dedup,
        op6_language_id, op7_near_dedup, op8_quality, op9_packing, op10_html_text, op11_fill_in_middle,
        op12_line_dedup, op13_divergence,
    )
}
#: For DuckDB on the same tables, where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
p as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
      from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
s as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from p) where len(w) >= n)),
h as (select doc_id, i, s.n, item_id from s join p using (g, n)),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as items from (select distinct doc_id, item_id::varchar as k from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)""",
    "op5_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
m as (select g, min(doc_id) as least from s group by g),
r as (select distinct doc_id, unnest(range(i, i + 13)) as j from s join m using (g) where least < doc_id),
k as (select doc_id, count(*) as n_removed, list(j) as js from r group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(case when js is null then array_to_string(w, ' ')
              else array_to_string([w[x] for x in range(1, len(w) + 1) if not list_contains(js, x)], ' ') end) as kept_sha256
from d left join k using (doc_id)""",
    "op7_near_dedup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as n_both from s a join s b using (g) where a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * n_both >= 75 * (a.n + b.n - n_both)),
e as (select x, y from l union all select y, x from l),
c as (select doc_id as node, doc_id as root from d union select y, root from c join e on node = x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from (select node as doc_id, min(root) as component_id from c group by node) left join n using (doc_id)""",
    "op11_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as x,
             case when coalesce(text, '') = '' then []::varchar[] else regexp_extract_all(text, '[^\n]*\n|[^\n]+') end as u from documents),
h as (select doc_id, t, u, len(u) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2,
             ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
p as (select doc_id, t, n, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from p""",
    "op12_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as u from documents),
l as (select doc_id, i, u[i] as line, translate(trim(u[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from (select doc_id, u, unnest(range(1, len(u) + 1)) as i from d)),
r as (select k, max(doc_id) as keeper from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select l.doc_id, i, line, keeper is not null and keeper <> doc_id as gone from l left join r using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id""",
    "op13_divergence": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as c from o group by lang, term having count(distinct r) >= 10),
l as (select lang, count(*) as v, sum(c)::hugeint as n from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from o semi join k using (lang, term) group by all),
n as (select lang, source, coalesce(sum(c), 0)::hugeint as n from g left join c using (lang, source) group by all),
f as (select n.lang, n.source, k.term, coalesce(c.c, 0) as c, 1 + 1000000000::hugeint * (coalesce(c.c, 0) + 2) // (n.n + 2 * v) as p,
             1 + 1000000000::hugeint * (k.c + 2) // (l.n + 2 * v) as q
      from n join l using (lang) join k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
      from f a join f b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
a as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
      union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from f where c > 0 and p > q)
select lang, source, part, item, value, rank from (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from a)
where part = 'pair' or rank <= 10""",
}
