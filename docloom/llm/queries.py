"""Queries of the operators for training data, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language, leakage, linking, mixture, personal, repetition, residue, residue_sql, shared_spans, split
from docloom.session import table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_documents(table(spark, sf_dir, "concepts"), "concept_id", "body")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "concepts").select("concept_id", F.size(split.pieces(F.col("body"))).alias("n"))
    return concepts.where("n > 1").select("concept_id").distinct()


def p2_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "concepts"), "concept_id", ["body", "description"], "bundle")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_bad(spark, sf_dir).select("concept_id", "field").distinct()


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each way of classifying a message gives."""
    return p2_bad(spark, sf_dir).groupBy("kind", "path").agg(F.count_distinct("concept_id", "field").alias("n_values"), F.count_distinct("message").alias("n_messages"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "concepts")
    return residue.without_residue(concepts, "concept_id", ["body", "description"], p2_found(spark, sf_dir))


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_items(table(spark, sf_dir, "concepts"), "concept_id", "body", "identifiers", table(spark, sf_dir, "given_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_items(spark, sf_dir).select("concept_id", "field", "kind", "map_key", "start_at").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.without_personal_items(table(spark, sf_dir, "concepts"), "concept_id", "body", "identifiers", table(spark, sf_dir, "given_names"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.concept_groups(table(spark, sf_dir, "concepts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_groups(spark, sf_dir).where("group_size > 1").select("path", "group_path")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segment_languages(table(spark, sf_dir, "concepts"), "concept_id", "lang", "body")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.text_languages(p6_segments(spark, sf_dir), "concept_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(p6_languages(spark, sf_dir), "concept_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.repetition_shares(table(spark, sf_dir, "concepts"), "concept_id", "body")
    return rows.withColumn("share", F.round("share", 9))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "concepts"), "concept_id", "body").select("concept_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return rows.withColumn("cosine", F.round("cosine", 4))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("run_words >= 12").select("doc_id", "item_id").distinct()


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.regexp_extract("rel_path", r"([^/\d]+?)_?\d*\.[^./]+$", 1)  # what kind of paper it is, by its file's name
    return mixture.mixture(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang", topic, table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixture.mixture_shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return shares.withColumn("actual_share", F.round("actual_share", 9))


def p9_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.mixture_marginals(p9_mixture(spark, sf_dir))
    return rows.select("dimension", "value", *(F.round(c, 9).alias(c) for c in ("corpus_share", "weighted_share", "actual_share")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.document_pairs(*shared_spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, windows = shared_spans.window_classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = shared_spans.shared_stretches(windows).drop("class_id")
    return rows.withColumnRenamed("key", "doc_id").withColumnRenamed("first_key", "first_doc")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    shares = shared_spans.shared_shares(documents, "doc_id", "text", *shared_spans.window_classes(documents, "doc_id", "text"))
    return shares.withColumn("share", F.round("share", 9))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_bad": p2_bad,
    "p2_clean": p2_clean,
    "p2_paths": p2_paths,
    "p3_found": p3_found,
    "p3_items": p3_items,
    "p3_masked": p3_masked,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p6_segments": p6_segments,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_marginals": p9_marginals,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
    "p10_shares": p10_shares,
}

_P4 = r"""
with recursive vals as (
  select path, unnest(map_keys(identifiers)) as k, unnest(map_values(identifiers)) as vs from concepts where path is not null),
bare as (
  select path, lower(regexp_replace(v, '[\s./\-]', '', 'g')) as x from (select path, unnest(vs) as v from vals where k not in ('kontakt', 'telefon', 'anschrift', 'sonstiges'))),
ids as (
  select path, 'i:' || x as node from bare
  where length(x) >= 6 and length(regexp_replace(x, '[^0-9]', '', 'g')) >= 5
    and replace(regexp_replace(x, '[^0-9]', '', 'g'), regexp_extract(x, '[0-9]'), '') <> ''),
srcs as (select path, 's:' || regexp_replace(replace(s, '\', '/'), '^\./', '') as node from (select path, unnest(sources) as s from concepts where path is not null) where s is not null),
links as (select distinct * from (select * from ids union all select * from srcs)),
edges as (select distinct l.path as a, r.path as b from links l join links r using (node) where l.path <> r.path),
reach as (select distinct a, a as b from edges union select reach.a, edges.b from reach join edges on edges.a = reach.b),
grp as (select a as path, min(b) as group_path, count(*) as group_size from reach group by 1)
"""

_P7 = r"""
with w as (select concept_id, regexp_extract_all(regexp_replace(lower(body), '\p{Nd}', '0', 'g'), '[\p{L}\p{N}]+') as ws from concepts where body is not null),
g as (select concept_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select concept_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
later as (select concept_id, i from (select concept_id, i, row_number() over (partition by concept_id, g order by i) as n from g) where n > 1),
hit as (select concept_id, count(distinct i + k) as n from later, range(8) t(k) group by 1),
r as (select w.concept_id, len(ws)::bigint as n_words, coalesce(hit.n, 0)::bigint as repeated_words from w left join hit using (concept_id))
"""

_P8 = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from eval_items where text is not null),
dg as (select doc_id, array_to_string(ws[p:p + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as p from d where len(ws) >= 12)),
ig as (select item_id, array_to_string(ws[p:p + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as p from i where len(ws) >= 12))
select distinct doc_id, item_id from dg join ig using (g)
"""

_P10 = """
with d as (select doc_id, text from documents where length(text) >= 300),
r as (select text, min(doc_id) as rep, count(*) as copies from d group by 1),
m as (select doc_id, rep, copies from d join r using (text)),
w as (select rep, p, hash(text[p:p + 299]) as h from (select rep, text, unnest(range(1, length(text) - 298)) as p from r)),
x as (select * from w where h in (select h from w group by 1 having count(distinct rep) > 1)),
l as (select distinct a.rep as a, b.rep as b from x a join x b using (h) where a.rep <> b.rep)
"""
_P10_FOUND = _P10 + """
select distinct x.doc_id as doc_id_a, y.doc_id as doc_id_b from m x join m y on x.rep = y.rep where x.doc_id < y.doc_id
union select x.doc_id, y.doc_id from l join m x on x.rep = l.a join m y on y.rep = l.b where x.doc_id < y.doc_id
"""
_P10_WINDOWS = _P10 + """,
k as (select h, count(distinct rep) as n_texts, min(rep) as first_doc, string_agg(distinct rep, ',' order by rep) as texts from w group by 1 having count(distinct rep) > 1),
v as (select rep, p, n_texts, first_doc, texts from w join k using (h))
"""
_P10_SPANS = _P10_WINDOWS + """
select rep as doc_id, min(p)::int as start_at, (max(p) - min(p) + 300)::int as length, n_texts, first_doc
from (select *, p - row_number() over (partition by rep, texts order by p) as run from v) group by rep, texts, n_texts, first_doc, run
"""
_P10_SHARES = _P10_WINDOWS + """,
c as (select rep, sum(step)::int as covered, max(n_texts) as n_texts from (select rep, n_texts, least(300, coalesce(p - lag(p) over (partition by rep order by p), 300)) as step from v) group by 1),
t as (select doc_id, length(text)::int as n_chars, case when copies > 1 then length(text) else coalesce(covered, 0) end::int as shared_chars, coalesce(copies - 1, 0) as n_copies, coalesce(n_texts, 1) as n_texts
  from documents left join (select doc_id, rep, copies from m) using (doc_id) left join c using (rep) where text is not null)
select doc_id, n_chars, shared_chars, round(case when n_chars > 0 then shared_chars / n_chars else 0 end, 9) as share, n_copies, n_texts from t
"""

_P1 = r"""
with recursive t as (select concept_id as id, body as t, length(body) as n from concepts where length(body) > 8000),
c(id, s, no) as (
  select id, 0::bigint, 1 from t
  union all
  select id, s + e, no + 1 from (
    select id, s, no, n, case
      when pe >= 1875 then pe when le >= 1875 then le when we >= 1875 then we
      when pe >= 1 then pe when le >= 1 then le when we >= 1 then we else 7500 end as e
    from (
      select id, s, no, n, length(regexp_extract(w, '(?s)^.*\n[ \t\r]{0,8}\n')) - before as pe, length(regexp_extract(w, '(?s)^.*\n')) - before as le, length(regexp_extract(w, '(?s)^.*[\s\x0B]')) - before as we
      from (select c.id, c.s, c.no, t.n, least(c.s, 10) as before, t.t[c.s + 1 - least(c.s, 10):c.s + 7500] as w from c join t using (id) where t.n - c.s > 7500))) where s + e < n),
cores as (select id, no, s, coalesce(lead(s) over (partition by id order by no), n) as e, t.t from c join t using (id)),
p as (
  select id as concept_id, no as piece_no, (count(*) over (partition by id))::int as n_pieces, (greatest(s - 500, 0) + 1)::int as start_at, (s + 1)::int as core_at, t[greatest(s - 500, 0) + 1:e] as piece from cores
  union all select concept_id, 1, 1, 1, 1, body from concepts where length(body) between 1 and 8000)
select * from p
"""

ORACLE = {
    **residue_sql.ORACLE,
    "p1_pieces": _P1,
    "p10_found": _P10_FOUND,
    "p10_spans": _P10_SPANS,
    "p10_shares": _P10_SHARES,
    "p8_found": _P8,
    "p1_found": "select concept_id from concepts where length(body) > 8000",
    "p4_found": _P4 + "select path, group_path from grp",
    "p4_groups": _P4 + "select p.path, coalesce(group_path, p.path) as group_path, coalesce(group_size, 1) as group_size from (select distinct path from concepts where path is not null) p left join grp using (path)",
    "p7_found": _P7 + "select concept_id from r where n_words >= 16 and repeated_words >= 0.35 * n_words",
    "p7_shares": _P7 + "select concept_id, n_words, repeated_words, round(case when n_words > 0 then repeated_words / n_words else 0 end, 9) as share from r",
}
