"""Named queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import gating, text
from docloom.operators import calls, chunking, digests, folders, merging, search, tokens, validation
from docloom.plans import document_queries, incremental_queries
from docloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

GATES = gating.Gates(exclude=("*.csv", "archiv/*"), low_priority=("*mahnung*", "reisen/*"), priority=("*_1.pdf",))
TRIVIAL_SQL = "(" + " or ".join(f"contains(lower(rel_path), '{w}')" for w in gating.TRIVIAL_WORDS) + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("select folder, count(*) as n_documents, sum(length(body))::bigint as n_chars, round(sum(length(body)) / count(*), 6) as density from concepts where folder is not null and body is not null group by 1")
def folder_totals(spark, d):
    rows = table(spark, d, "concepts").where("folder is not null and body is not null")
    return folders.folder_totals(rows, "folder", "body").withColumn("density", F.round("density", 6))


@query(
    f"""select distinct rel_path, regexp_matches(rel_path, '(^|/)\\.') as hidden, (rel_path like '%.csv' or rel_path like 'archiv/%') as excluded,
    case when regexp_extract(rel_path, '[^/]*$') like '%\\_1.pdf' escape '\\' then false
         when rel_path like '%mahnung%' or rel_path like 'reisen/%' then true else {TRIVIAL_SQL} end as deprioritized,
    regexp_matches(lower(regexp_extract(rel_path, '[^/]*$')), '\\.(pdf|txt|docx|eml|csv|xlsx|png|jpg|jpeg)$') as supported,
    regexp_extract(rel_path, '[^/]*$') in ('index.md', 'log.md') as reserved
    from files where rel_path is not null"""
)
def gate_paths(spark, d):
    p = F.col("rel_path")
    return (
        table(spark, d, "files").where(p.isNotNull()).select(p).distinct()
        .select(p, gating.is_hidden(p).alias("hidden"), gating.matches_any(p, GATES.exclude).alias("excluded"), gating.is_deprioritized(p, GATES).alias("deprioritized"), gating.is_supported(p).alias("supported"), gating.is_reserved(p).alias("reserved"))
    )


@query("select sha256(text) as hash, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def content_hash_dupes(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_CHUNKS = """
with recursive c(id, t, s, e, no) as (
  select concept_id, body, 0::bigint, least(8000, length(body))::bigint, 1 from concepts where body is not null
  union all
  select id, t, b - 500, least(b - 500 + 8000, length(t))::bigint, no + 1 from (
    select id, t, no, s, case when e < length(t) then (case when k >= 2000 then s + k + 1 else e end) else e end as b from (
      select id, t, no, s, e, 8000 - least(nullif(instr(reverse(t[s + 1:e]), ' '), 0), nullif(instr(reverse(t[s + 1:e]), chr(10)), 0)) as k from c)) where b < length(t)),
cut as (
  select id, no, t[s + 1:case when e < length(t) and 8000 - least(nullif(instr(reverse(t[s + 1:e]), ' '), 0), nullif(instr(reverse(t[s + 1:e]), chr(10)), 0)) >= 2000
    then s + 8000 - least(nullif(instr(reverse(t[s + 1:e]), ' '), 0), nullif(instr(reverse(t[s + 1:e]), chr(10)), 0)) + 1 else e end] as chunk from c)
"""


@query(_CHUNKS + "select id as concept_id, no as chunk_no, (count(*) over (partition by id))::int as n_chunks, length(chunk)::int as n_chars, sha256(chunk) as hash from cut")
def chunk_text(spark, d):
    rows = chunking.chunks(table(spark, d, "concepts"), "concept_id", "body")
    return rows.select("concept_id", "chunk_no", "n_chunks", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("hash"))


@query(
    """select path, string_agg(body, chr(10) || chr(10) order by concept_id) filter (trim(body) <> '') as body,
    arg_min(title, concept_id) filter (title <> '') as title, arg_min(description, concept_id) filter (description <> '') as description, arg_min(okf_type, concept_id) as okf_type
    from concepts where path is not null group by 1"""
)
def merge_versions(spark, d):
    how = {"body": "body", "title": "first", "description": "first", "okf_type": "head"}
    rows = merging.merge_parts(table(spark, d, "concepts").where("path is not null"), "path", "concept_id", how)
    return rows.withColumn("body", F.nullif("body", F.lit("")))


@query(
    """with t as (select folder, concept_id, unnest(tags) as tag, generate_subscripts(tags, 1) as i from concepts where folder is not null),
    f as (select folder, tag, min(struct_pack(c := concept_id, i := i)) as spot from t where tag is not null group by all)
    select folder, string_agg(tag, ',' order by spot) as tags from f group by 1"""
)
def tags_ordered_union(spark, d):
    rows = merging.ordered_values(table(spark, d, "concepts").where("folder is not null"), "folder", "concept_id", "tags")
    return rows.select("folder", F.array_join("tags", ",").alias("tags")).where("tags <> ''")


@query(
    """with l as (select folder, unnest(map_keys(identifiers)) as k, unnest(map_values(identifiers)) as vs from concepts where folder is not null),
    v as (select distinct folder, k, unnest(vs) as v from l), s as (select folder, k, string_agg(v, ', ' order by v) as vs from v where v <> '' group by all)
    select folder, string_agg(k || ': ' || vs, '; ' order by k) as identifiers from s group by 1"""
)
def identifier_union(spark, d):
    rows = merging.identifier_union(table(spark, d, "concepts").where("folder is not null"), "folder", "identifiers")
    joined = F.transform(F.map_entries("identifiers"), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    return rows.select("folder", F.array_join(joined, "; ").alias("identifiers"))


_NEWEST = "newest as (select * from concepts where path is not null qualify row_number() over (partition by path order by loaded_at desc, concept_id desc) = 1)"
_TREE = f"""with recursive {_NEWEST}, above(folder) as (
  select distinct folder from newest where folder <> '' union select regexp_replace(folder, '/?[^/]*$', '') from above where folder <> ''),
tree as (select folder, regexp_replace(folder, '/?[^/]*$', '') as parent, len(string_split(folder, '/'))::int as depth from above where folder <> '' and not regexp_matches(folder, '(^|/)\\.'))"""


@query(_TREE + " select * from tree")
def rollup_tree(spark, d):
    return folders.folder_tree(folders.newest_versions(table(spark, d, "concepts").select("path", "folder", "loaded_at", "concept_id")), "folder")


@query(
    _TREE
    + """, d as (select folder, arg_min(description, path) as description from newest where okf_type = 'FolderSummary' group by 1),
    k as (select t.parent as folder, t.folder as child, regexp_extract(t.folder, '[^/]*$') as n, coalesce(nullif(d.description, ''), regexp_extract(t.folder, '[^/]*$')) as x from tree t left join d on d.folder = t.folder)
    select folder, count(*) as n_children, string_agg('- [' || n || '](' || n || '/' || n || '.md) — ' || x, chr(10) order by child) as links from k where folder <> '' group by 1"""
)
def rollup_links(spark, d):
    newest = folders.newest_versions(table(spark, d, "concepts").select("path", "folder", "okf_type", "description", "loaded_at", "concept_id"))
    described = newest.where("okf_type = 'FolderSummary'").groupBy("folder").agg(F.min_by("description", "path").alias("description"))
    return folders.rollup_links(folders.folder_tree(newest, "folder"), described)


@query(
    """select count(*) filter (okf_type = 'FolderSummary') as folders, coalesce(sum(len(sources)) filter (okf_type = 'FolderSummary'), 0)::bigint as documents,
    coalesce(sum((length(body) - length(replace(body, '_Verification: FLAGGED', ''))) / 22) filter (okf_type = 'FolderSummary'), 0)::bigint as flagged,
    count(*) filter (okf_type = 'Matter') as matters, coalesce(bool_or(okf_type = 'Synthesis'), false) as has_synthesis from concepts where not regexp_matches(path, '(^|/)\\.')"""
)
def nav_stats(spark, d):
    return folders.navigation_stats(table(spark, d, "concepts"))


_TOKENS = """select doc_id, unnest(list_distinct(list_concat(
    list_filter(regexp_extract_all(text, '\\d{%d,}'), lambda t: not regexp_matches(t, '^(19|20)\\d{2}$')),
    list_filter(regexp_extract_all(text, '[A-Za-z0-9]{6,}'), lambda t: length(regexp_replace(t, '[^0-9]', '', 'g')) >= 2 and regexp_matches(t, '[A-Za-z]'))))) as token from documents"""


@query(_TOKENS % 5)
def tokens_provenance(spark, d):
    return tokens.token_rows(table(spark, d, "documents"), "doc_id", "text")


@query(_TOKENS % 4)
def tokens_pertinence(spark, d):
    return tokens.token_rows(table(spark, d, "documents"), "doc_id", "text", tokens.PRINCIPLE_DIGITS["pertinence"])


@query(f"with t as ({_TOKENS % 5}) select token, count(distinct doc_id) as n_keys from t group by 1 having count(distinct doc_id) > 1")
def token_shared(spark, d):
    return tokens.shared_tokens(tokens_provenance(spark, d), "doc_id")


@query(f"with t as ({_TOKENS % 5}), f as (select token, min(doc_id) as a from t group by 1) select distinct a, doc_id as b from t join f using (token) where doc_id > a")
def token_edges(spark, d):
    return tokens.token_edges(tokens_provenance(spark, d), "doc_id")


_MATTERS = f"""with recursive t as ({_TOKENS % 5}), f as (select token, min(doc_id) as a from t group by 1),
e as (select distinct a, doc_id as b from t join f using (token) where doc_id > a), s as (select a, b from e union select b, a from e),
r as (select a, b from s union select r.a, s.b from r join s on s.a = r.b), l as (select a as doc_id, least(a, min(b)) as label from r group by 1)"""


@query(
    _MATTERS
    + """, m as (select label, token from (select label, token, doc_id from t join l using (doc_id)) group by all having count(distinct doc_id) > 1)
    select g.label as group_key, g.n as n_members, m2.n as n_tokens, 'matter-' || m2.s as slug from (select label, count(*) as n from l group by 1) g
    join (select label, count(*) as n, array_to_string(list_sort(list(token))[1:3], '-') as s from m group by 1) m2 using (label)"""
)
def matter_slugs(spark, d):
    return tokens.matters(tokens_provenance(spark, d), "doc_id")


@query(_MATTERS + "select doc_id, label from l")
def matter_components(spark, d):
    return tokens.components(tokens.token_edges(tokens_provenance(spark, d), "doc_id")).withColumnRenamed("key", "doc_id")


@query(_MATTERS + "select doc_id, length(text)::int as n_chars from documents semi join l using (doc_id)")
def matter_members(spark, d):
    """Only members of matters are read in full: a semi-join reduction."""
    return table(spark, d, "documents").join(matter_components(spark, d), "doc_id", "left_semi").select("doc_id", F.length("text").alias("n_chars"))


_DIGEST = r"""
with p as (
  select concept_id, path, title, tags, sources, identifiers, body, list_filter(string_split(body, chr(10)), lambda s: starts_with(s, '## ') or starts_with(s, '_Source: ')) as ls from concepts where okf_type = 'FolderSummary'),
dg as (
  select concept_id, path, concat_ws(chr(10), '### Aggregate: ' || path, case when title <> '' then 'Title: ' || title end,
    case when len(tags) > 0 then 'Tags: ' || array_to_string(tags, ', ') end, case when len(sources) > 0 then 'Sources: ' || array_to_string(sources, ', ') end,
    case when cardinality(identifiers) > 0 then 'Identifiers: ' || array_to_string(list_transform(list_sort(map_keys(identifiers)), lambda k: k || ': ' || array_to_string(identifiers[k], ', ')), '; ') end,
    case when instr(body, '## ') > 1 and regexp_replace(body[1:instr(body, '## ') - 1], '^\s+|\s+$', '', 'g') <> '' then 'Summary: ' || regexp_replace(body[1:instr(body, '## ') - 1], '^\s+|\s+$', '', 'g') end,
    case when len(ls) > 0 then 'Sections:' || chr(10) || array_to_string(list_transform(ls, lambda s: '  ' || s), chr(10)) end) as digest from p)
"""


@query(_DIGEST + "select concept_id, digest from dg where path is not null")
def digest(spark, d):
    rows = table(spark, d, "concepts").where("okf_type = 'FolderSummary' and path is not null")
    return rows.select("concept_id", digests.digest(*(F.col(c) for c in ("path", "title", "tags", "sources", "identifiers", "body"))).alias("digest"))


@query(
    "with recursive" + _DIGEST.strip().removeprefix("with")
    + """, l as (select c.folder, dg.concept_id, length(digest) as n, row_number() over (partition by c.folder order by dg.concept_id) as i from dg join concepts c using (concept_id) where dg.path is not null),
r(folder, concept_id, i, size, batch_no) as (
  select folder, concept_id, i, n + 2, 1 from l where i = 1
  union all
  select l.folder, l.concept_id, l.i, case when r.size + l.n + 2 > 1000 then l.n + 2 else r.size + l.n + 2 end, case when r.size + l.n + 2 > 1000 then r.batch_no + 1 else r.batch_no end
  from r join l on l.folder is not distinct from r.folder and l.i = r.i + 1)
select folder, concept_id, batch_no from r"""
)
def digest_batches(spark, d):
    rows = digest(spark, d).join(table(spark, d, "concepts").select("concept_id", "folder"), "concept_id").select("folder", "concept_id", F.length("digest").alias("n_chars"))
    return digests.batches(rows, "folder", "concept_id", "n_chars", 1000)


_FINDINGS = r"""
with a as (select concept_id, path, okf_type, coalesce(sources, []) as sources, coalesce(body, '') as body from concepts where okf_type in ('FolderSummary', 'Matter') and not coalesce(regexp_matches(path, '(^|/)\.'), false)),
b as (
  select *, case when okf_type = 'FolderSummary'
    then list_filter(sources, lambda s: not list_contains(list_transform(list_filter(string_split(body, chr(10)), lambda x: regexp_full_match(x, '_Source: .+_')), lambda x: x[10:-2]), regexp_extract(s, '[^/]*$')))
    else list_filter(sources, lambda s: not contains(body, s)) end as missing,
  length(regexp_replace(body, '^\s+|\s+$', '', 'g')) as n, len(regexp_extract_all(body, '(?m)^type:\s*\S+\s*$')) as leaks,
  list_sort(list_distinct(list_transform(regexp_extract_all(body, '(?mi)^\s*(title|description|tags|source|timestamp):\s*(\.\.\.|\[\.\.\.\]|path/to/)', 1), lambda x: lower(x)))) as open_keys,
  list_filter(['here is the output', 'here''s the output', 'in valid okf', 'as an ai', 'focus on quality over quantity'], lambda p: contains(lower(body), p)) as meta,
  list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '\d', '#', 'g')), lambda x: length(x) >= 40) as bl from a),
c as (select *, list_filter(bl, lambda x: len(list_filter(bl, lambda y: y = x)) > 2) as again from b),
found as (
  select concept_id, 'sources' as check_id, len(sources) > 0 as passed, 'no sources' as why from c
  union all select concept_id, 'density', n / len(sources) >= 80, floor(n / len(sources))::bigint || ' characters a source' from c where len(sources) > 0
  union all select concept_id, 'citations', len(missing) = 0, array_to_string(missing[1:8], ', ') || case when len(missing) > 8 then ' (+' || (len(missing) - 8) || ' more)' else '' end from c
  union all select concept_id, 'leak', leaks = 0, leaks || ' type lines' from c
  union all select concept_id, 'placeholder', len(open_keys) = 0, array_to_string(open_keys, ', ') from c
  union all select concept_id, 'repeats', len(again) = 0, again[1][1:80] from c
  union all select concept_id, 'meta', len(meta) = 0, array_to_string(meta, ', ') from c),
findings as (select concept_id, check_id, passed, case when passed then '' else why end as evidence from found)
"""


@query(_FINDINGS + "select * from findings")
def validate_findings(spark, d):
    return validation.findings(table(spark, d, "concepts")).select("concept_id", "check_id", "passed", "evidence")


_REPORT = "_Verification: FLAGGED — "


@query(
    _FINDINGS
    + f"""select concept_id, count(*) as n_checks, count(*) filter (not passed) as n_failed, bool_and(passed) as passed,
    coalesce(string_agg('{_REPORT}' || check_id || ': ' || evidence || '_', chr(10) || chr(10) order by '{_REPORT}' || check_id || ': ' || evidence || '_') filter (not passed), '') as banner from findings group by 1"""
)
def validate_report(spark, d):
    return validation.report(validation.findings(table(spark, d, "concepts")))


@query(_FINDINGS + "select count(*) as n_aggregates, count(*) filter (not p) as n_flagged, case when count(*) filter (not p) > 0 then 1 else 0 end as exit_code from (select concept_id, bool_and(passed) as p from findings group by 1)")
def validate_summary(spark, d):
    return validate_report(spark, d).agg(F.count("*").alias("n_aggregates"), F.count_if(~F.col("passed")).alias("n_flagged")).withColumn("exit_code", (F.col("n_flagged") > 0).cast("int"))


_LABELS = "|".join(sorted(tokens.IDENTIFIER_LABELS, key=len, reverse=True))
_LABELLED = rf"(?i)({_LABELS})[\s:]*({tokens.VALUE_FIRST}(?: {tokens.VALUE_MORE}){{0,{tokens.VALUE_MORE_MOST}}})"


def _identifiers_sql(rows: str, key: str) -> str:
    """Identifiers of the texts of a relation with columns `key` and text. RE2 looks neither ahead nor behind: for the lone eleven digits other characters are doubled, so that one stays for each side."""
    return rf"""
raw as (
  select {key}, list_concat(
    list_transform(list_zip(regexp_extract_all(text, '{_LABELLED}', 1), regexp_extract_all(text, '{_LABELLED}', 2)), lambda x: struct_pack(label := x[1], v := x[2])),
    list_transform(regexp_extract_all(text, '\b[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}\b'), lambda v: struct_pack(label := 'IBAN', v := v)),
    list_transform(regexp_extract_all(regexp_replace(text, '(\D)', '\1\1', 'g'), '(?:^|\D)(\d{{11}})(?:$|\D)', 1), lambda v: struct_pack(label := 'Steuer-ID', v := v)),
    list_transform(regexp_extract_all(text, '(?i)\b\d{{8}}[A-Z]\d{{3}}\b'), lambda v: struct_pack(label := 'Rentenversicherungsnummer', v := v)),
    list_transform(regexp_extract_all(text, '(?i)\b[A-Z]{{2}}[A-Z0-9]{{9}}\d\b'), lambda v: struct_pack(label := 'ISIN', v := v))) as xs from {rows}),
one as (select {key}, unnest(xs) as x, generate_subscripts(xs, 1) as pos from raw),
clean as (select {key}, pos, x.label as label, regexp_replace(x.v, '[.,:;]+$', '') as value from one),
ids as (select {key}, id_key, arg_min(struct_pack(l := label, v := value), pos) as x from (select *, upper(regexp_replace(value, '[\s.]', '', 'g')) as id_key from clean) group by all)"""


_NEWEST_TEXT = "newest as (select rel_path, arg_max(text, doc_id) as text from documents where rel_path is not null and text is not null group by 1)"


@query(
    f"with {_NEWEST_TEXT}, {_identifiers_sql('newest', 'rel_path')},"
    + r"""
bare as (select rel_path, upper(regexp_replace(regexp_replace(text, '(?m)^.*(?:IBAN|nummer).*$', '', 'g'), '[\s.]', '', 'g')) as b from newest)
select rel_path as path, id_key, x.l as label, x.v as value from ids join bare using (rel_path) where not contains(b, id_key)"""
)
def validate_identifiers(spark, d):
    """Each document is the transcript of an aggregate that lost its lines about bank accounts."""
    return validation.lost_identifiers(*_thinned(spark, d))


def _thinned(spark, d) -> tuple[DataFrame, DataFrame]:
    """(aggregates of one source without the lines about bank accounts and numbers, transcripts)."""
    documents = table(spark, d, "documents").where("rel_path is not null and text is not null")
    newest = documents.groupBy("rel_path").agg(F.max_by("text", "doc_id").alias("text"))
    aggregates = newest.select(F.col("rel_path").alias("path"), F.array("rel_path").alias("sources"), F.regexp_replace("text", r"(?m)^.*(?:IBAN|nummer).*$", "").alias("body"))
    return aggregates, newest


@query(
    f"with {_NEWEST_TEXT}, {_identifiers_sql('newest', 'rel_path')},"
    + r"""
bare as (select rel_path, upper(regexp_replace(regexp_replace(text, '(?m)^.*(?:IBAN|nummer).*$', '', 'g'), '[\s.]', '', 'g')) as b from newest),
lost as (select rel_path, x.l || '=' || x.v as said from ids join bare using (rel_path) where not contains(b, id_key)),
per as (select rel_path, list_sort(list(said))[1:8] as eight, count(*) as n from lost group by 1)
select rel_path as path, n is null as passed, case when n is null then '' else 'missing: ' || array_to_string(eight, ', ') || case when n > 8 then ' (+' || (n - 8) || ' more)' else '' end end as evidence from newest left join per using (rel_path)"""
)
def validate_lost_identifiers(spark, d):
    """The same as findings of a report (V8)."""
    aggregates, transcripts = _thinned(spark, d)
    return validation.identifier_findings(aggregates.withColumn("concept_id", F.col("path")), transcripts).select("path", "passed", "evidence")


@query(f"with d as (select doc_id, text from documents where text is not null), {_identifiers_sql('d', 'doc_id')} select doc_id, x.l as label, x.v as value, id_key from ids")
def identifier_extract(spark, d):
    return tokens.labelled_identifiers(table(spark, d, "documents"), "doc_id", "text")


@query("select concept_id, regexp_replace(body, '(^|\\n)(#{1,5}) ', '\\1#\\2 ', 'g') as body from concepts")
def heading_demote(spark, d):
    return table(spark, d, "concepts").select("concept_id", text.demote_headings(F.col("body")).alias("body"))


@query(
    """select doc_id, '## ' || coalesce(nullif(regexp_extract(text, '^[^\\n]*'), ''), regexp_extract(rel_path, '[^/]*$')) || chr(10) || chr(10) || '_Source: ' || regexp_extract(rel_path, '[^/]*$') || '_' || chr(10) || chr(10)
    || case when n_chars < 200 then '_Verification: FLAGGED — thin_' || chr(10) || chr(10) else '' end || regexp_replace(text, '(^|\\n)(#{1,5}) ', '\\1#\\2 ', 'g') as section from documents where rel_path is not null and text is not null"""
)
def section_render(spark, d):
    rows = table(spark, d, "documents").where("rel_path is not null and text is not null")
    issue = F.when(F.col("n_chars") < 200, "thin")
    return rows.select("doc_id", text.section(F.regexp_extract("text", r"^[^\n]*", 0), text.base_name(F.col("rel_path")), issue, F.col("text")).alias("section"))


@query(
    """with s as (select concept_id, unnest(string_split(chr(10) || body, chr(10) || '## ')) as block, generate_subscripts(string_split(chr(10) || body, chr(10) || '## '), 1) as i from concepts),
    m as (select concept_id, i, block, regexp_extract(block, '(?m)^_Source: (.+)_$', 1) as source from s where i > 1)
    select concept_id, source, regexp_extract(block, '^[^\\n]*') as heading from m where source <> '' qualify row_number() over (partition by concept_id, source order by i desc) = 1"""
)
def section_parse(spark, d):
    """Sections of a body by the source they cite; of several the last."""
    cut = table(spark, d, "concepts").select("concept_id", F.posexplode(F.split("body", r"(?md)(?=^## )")).alias("i", "block"))
    rows = cut.where(F.col("block").startswith("## ")).select("concept_id", "i", F.regexp_extract("block", text.SOURCE_MARKER, 1).alias("source"), F.regexp_extract("block", r"^## ([^\n]*)", 1).alias("heading"))
    return rows.where("source <> ''").groupBy("concept_id", "source").agg(F.max_by("heading", "i").alias("heading"))


@query(
    """select call_id, upper(trim(coalesce(error, 'OK'))) not like 'FLAGGED%' as passed, 'matter-' || coalesce(error, '') as name, case when host in ('localhost', '::1') or host like '10.%' or host like '127.%' or host like '192.168.%' then true else false end as local
    from (select distinct call_id, error, host from llm_calls)"""
)
def verdict_and_host(spark, d):
    rows = table(spark, d, "llm_calls").select("call_id", "error", "host").distinct()
    return rows.select(
        "call_id", text.verdict_passed(F.coalesce("error", F.lit("OK"))).alias("passed"), F.concat(F.lit("matter-"), F.coalesce("error", F.lit(""))).alias("name"), F.coalesce(text.is_local_host(F.col("host")), F.lit(False)).alias("local")
    )


@query(
    """with c as (select * from llm_calls qualify row_number() over (partition by call_id order by logged_at desc nulls last, duration_ms desc nulls last) = 1)
    select model, count(*) as n_calls, count(*) filter (not coalesce(success, false)) as n_failed, sum(coalesce(attempts, 1) - 1)::bigint as retries, round(avg(duration_ms), 6) as mean_ms, max(duration_ms) as most_ms, sum(prompt_chars)::bigint as chars from c group by 1"""
)
def llm_log_summary(spark, d):
    return calls.call_summary(table(spark, d, "llm_calls"))


@query(
    """select user_id, round(avg(value) filter (event_type = 'purchase'), 6) as purchase, round(avg(value) filter (event_type = 'click'), 6) as click,
    round(avg(value) filter (event_type = 'purchase') - avg(value) filter (event_type = 'click'), 6) as delta from events where event_type in ('purchase', 'click') group by 1"""
)
def eval_pivot(spark, d):
    rows = calls.mean_by_configuration(table(spark, d, "events"), "user_id", "event_type", "value", ["purchase", "click"])
    return rows.select("user_id", *(F.round(c, 6).alias(c) for c in ("purchase", "click", "delta")))


_GREP = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as line_no from documents)"


@query(f"with {_GREP} select * from lines where regexp_matches(line, '(?i)versicherung|insurance')")
def grep_hits(spark, d):
    return search.hits(table(spark, d, "documents"), "doc_id", "text", "versicherung|insurance")


@query(
    f"""with {_GREP}, h as (select *, regexp_matches(line, '(?i)mahnung|reminder') as is_hit from lines),
    w as (select *, bool_or(is_hit) over (partition by doc_id order by line_no rows between 3 preceding and 3 following) as near from h) select doc_id, line_no, line, is_hit from w where near"""
)
def grep_context(spark, d):
    return search.hits_in_context(table(spark, d, "documents"), "doc_id", "text", "mahnung|reminder")


@query("with f as (select distinct folder from files where sha256 is not null) select distinct folder from concepts where okf_type = 'FolderSummary' and folder not in (select folder from f where folder is not null)")
def orphans(spark, d):
    return folders.orphans(table(spark, d, "concepts").where("okf_type = 'FolderSummary'"), table(spark, d, "files").where("sha256 is not null"))


@query(
    """with r as (select r_regionkey, r_name, n_nationkey from region join nation on n_regionkey = r_regionkey)
    select r_name, count(distinct n_nationkey) as n_nations, count(c_custkey) as n_customers, round(sum(c_acctbal), 2) as balance from r left join customer on c_nationkey = n_nationkey group by 1"""
)
def rollup_levels(spark, d):
    """A roll-up over three levels of a hierarchy: leaves are aggregated before they meet the upper levels."""
    leaves = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    upper = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = upper.join(leaves, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("r_name")
    return rows.agg(F.count_distinct("n_nationkey").alias("n_nations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_customers"), F.round(F.sum("b"), 2).alias("balance"))


for _more in (incremental_queries, document_queries):
    QUERIES.update(_more.QUERIES)
    ORACLE.update(_more.ORACLE)
ORACLE["chunk_labels"] = _CHUNKS + "select id as concept_id, no as chunk_no, path || case when count(*) over (partition by id) > 1 then ' (part ' || no || '/' || count(*) over (partition by id) || ')' else '' end as context from cut join concepts on concept_id = id where path is not null"
