"""Named queries of the document format, the model surface and the event streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import chunking, digests, extraction, folders, merging
from docloom.session import table
from docloom.sources import okf, sinks
from docloom.streaming import incremental as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by all")
def event_windows(spark, d):
    return streams.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(
    """with e as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute, true) as fresh from events where ts is not null),
    s as (select user_id, ts, count(*) filter (fresh) over (partition by user_id order by ts rows unbounded preceding) as no from e)
    select user_id, min(ts) as start, count(*) as n from s group by user_id, no"""
)
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


def _q(x: str) -> str:
    return f"chr(39) || replace(regexp_replace({x}, '\\s*\\n\\s*', ' ', 'g'), chr(39), chr(39) || chr(39)) || chr(39)"


_RENDERED = f"""select concept_id, '---' || chr(10)
  || coalesce('type: ' || {_q('okf_type')} || chr(10), '') || coalesce('title: ' || {_q('title')} || chr(10), '')
  || case when tags is null then '' when len(tags) = 0 then 'tags: []' || chr(10) else 'tags:' || chr(10) || coalesce(array_to_string(list_transform(tags, lambda x: '- ' || {_q('x')} || chr(10)), ''), '') end
  || case when sources is null then '' when len(sources) = 0 then 'sources: []' || chr(10) else 'sources:' || chr(10) || coalesce(array_to_string(list_transform(sources, lambda x: '- ' || {_q('x')} || chr(10)), ''), '') end
  || case when source_hashes is null then '' when cardinality(source_hashes) = 0 then 'source_hashes: {{}}' || chr(10)
     else 'source_hashes:' || chr(10) || array_to_string(list_transform(list_sort(map_keys(source_hashes)), lambda k: '  ' || {_q('k')} || ': ' || {_q('source_hashes[k]')} || chr(10)), '') end
  || case when identifiers is null then '' when cardinality(identifiers) = 0 then 'identifiers: {{}}' || chr(10)
     else 'identifiers:' || chr(10) || array_to_string(list_transform(list_sort(map_keys(identifiers)), lambda k: '  ' || {_q('k')} || ':' || chr(10) || coalesce(array_to_string(list_transform(identifiers[k], lambda x: '  - ' || {_q('x')} || chr(10)), ''), '')), '') end
  || '---' || chr(10) || chr(10) || coalesce(body, '') as document from concepts"""


def _rendered(concepts: DataFrame) -> DataFrame:
    names = {"type": "okf_type", "title": "title", "list:tags": "tags", "list:sources": "sources", "map:source_hashes": "source_hashes", "lists:identifiers": "identifiers"}
    return concepts.select("concept_id", okf.render_document({k: F.col(v) for k, v in names.items()}, F.col("body")).alias("document"))


@query(_RENDERED)
def okf_render(spark, d):
    """Concepts as text with front matter."""
    return _rendered(table(spark, d, "concepts"))


@query("select okf_type, count(*) as n, count(*) as n_type, count(*) as n_tags, count(*) as n_sources, count(*) as n_identifiers, count(*) as n_body from concepts where okf_type is not null group by 1")
def okf_round_trip(spark, d):
    """Concepts rendered and parsed again (P1): of each type how many come back with each field as it was."""
    concepts = table(spark, d, "concepts").where("okf_type is not null")
    back = okf.parse_documents(_rendered(concepts), "concept_id", "document").alias("b")
    rows = concepts.alias("a").join(back, "concept_id")
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    entries = lambda c: F.array_sort(F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(e["key"], filled(e["value"]))))
    same = {
        "n_type": F.col("a.okf_type") == F.col("b.type"), "n_tags": filled(F.col("a.tags")) == filled(F.col("b.tags")), "n_sources": filled(F.col("a.sources")) == filled(F.col("b.sources")),
        "n_identifiers": entries(F.col("a.identifiers")) == entries(F.col("b.identifiers")), "n_body": bare(F.col("a.body")) == bare(F.col("b.body")),
    }
    return rows.groupBy("okf_type").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in same.items()))


_STEM = "replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1'), '_', ' ')"


@query(f"select concept_id, coalesce(nullif(title, ''), array_to_string(list_transform(regexp_extract_all({_STEM}, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '')) as title, folder || '/' || regexp_extract(folder, '[^/]*$') || '.md' as summary_path from concepts")
def default_titles(spark, d):
    """Titles with a default from the path, and where a folder's aggregate lies."""
    return table(spark, d, "concepts").select("concept_id", text.default_title(F.col("title"), F.col("path")).alias("title"), text.folder_summary_path(F.col("folder")).alias("summary_path"))


@query(
    """with x as (select concept_id, body, trim('- [' || coalesce(nullif(title, ''), 'Related') || '](' || path || ') ' || coalesce(description, ''), ' ') as line from concepts where body is not null and path is not null),
    h as (select *, case when contains(body, '## Related') then body else body || chr(10) || chr(10) || '## Related' || chr(10) end as headed from x)
    select concept_id, case when contains(body, line) then headed else headed || chr(10) || line end as body from h"""
)
def related_links(spark, d):
    """Each body with a link to its own path under Related."""
    rows = table(spark, d, "concepts").where("body is not null and path is not null")
    return rows.select("concept_id", okf.with_link(F.col("body"), F.col("title"), F.col("path"), F.col("description")).alias("body"))


@query(
    """with r as (select model, host, avg(case when success then 1.0 else 0.0 end) as rate from (select distinct * from llm_calls) group by all)
    select model, host, case when rate is null then 'none' when rate >= 0.8 then 'pass' when rate >= 0.5 then 'neutral' else 'fail' end as class from r"""
)
def pass_classes(spark, d):
    """Share of calls that succeeded, as a class."""
    rows = table(spark, d, "llm_calls").distinct().groupBy("model", "host").agg(F.avg(F.when(F.coalesce("success", F.lit(False)), 1.0).otherwise(0.0)).alias("rate"))
    return rows.select("model", "host", text.pass_rate_class(F.col("rate")).alias("class"))


_WS = "'^\\s+|\\s+$', '', 'g'"


@query(
    f"""with f as (select folder, concept_id, coalesce(title, '') as title, coalesce(description, '') as note from concepts where folder is not null),
    g as (select folder, list(title order by concept_id) as ms, list(note order by concept_id) as cs, count(*) as n from f group by 1),
    x as (select folder, array_to_string(list_filter(ms, lambda t: trim(t, ' ') <> ''), chr(10) || chr(10)) as m,
      array_to_string(list_filter(cs, lambda t: t <> '' and lower(trim(t, ' ')) not in ('no conflicts detected', 'none', 'keine konflikte') and trim(t, ' ') <> ''), chr(10) || chr(10)) as c from g)
    select folder, concat_ws(chr(10) || chr(10), '## Matters' || chr(10) || chr(10) || coalesce(nullif(m, ''), 'old'), case when c <> '' then '## Conflicts' || chr(10) || chr(10) || c end, '## Patterns' || chr(10) || chr(10) || folder, '## Open actions' || chr(10) || chr(10) || 'pay') as report from x"""
)
def synthesis_splice(spark, d):
    """A report whose matters and conflicts are replaced by those of a folder, actions kept."""
    rows = table(spark, d, "concepts").where("folder is not null").select("folder", "concept_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("note"))
    lists = rows.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("concept_id", "title", "note"))).alias("rows"))
    baseline = F.concat(F.lit("Report\n\n## Matters\n\nold\n\n## Patterns\n\n"), F.col("folder"), F.lit("\n\n## Open actions\n\npay"))
    of = lambda name: F.transform("rows", lambda r: r[name])
    return lists.select("folder", digests.splice(baseline, of("title"), of("note"), F.array(F.lit(""))).alias("report"))


@query()
def chunk_labels(spark, d):
    """The context that each chunk is derived in (P9). Its SQL is built by core_queries from that of chunk_text."""
    rows = chunking.chunks(table(spark, d, "concepts").where("path is not null"), "concept_id", "body").join(table(spark, d, "concepts").select("concept_id", "path"), "concept_id")
    return rows.select("concept_id", "chunk_no", chunking.chunk_context(F.col("path"), F.col("chunk_no"), F.col("n_chunks")).alias("context"))


@query(
    """with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_replace(s, '[\\s\\p{Z}]', '', 'g') <> '') as ls from documents where text is not null)
    select doc_id, 'Fact' as type, coalesce(nullif(trim(ls[1], '# ' || chr(9))[1:80], ''), '') as title from l where len(ls) > 0"""
)
def derived_titles(spark, d):
    """Type and title that the default extractor derives from each text, the first of its chunks."""
    rows = table(spark, d, "documents").where(r"text is not null and regexp_replace(text, '(?U)\\s', '') <> ''")
    parts = extraction.derive(rows.select("doc_id", "text"), "doc_id", "text")
    merged = merging.merge_parts(parts.where("error is null"), "doc_id", "chunk_no", {"title": "first", "type": "head"})
    return merged.select("doc_id", "type", F.coalesce("title", F.lit("")).alias("title"))


@query(
    """with x as (select concept_id, list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(description, ''), '\\d{5,}'), lambda t: not contains(regexp_replace(coalesce(body, ''), '[\\s.]', '', 'g'), t)))) as lost from concepts)
    select concept_id, len(lost) = 0 as passed, case when len(lost) = 0 then '' else array_to_string(lost[1:3], ', ') || ' not in the source' end as reason from x"""
)
def verified_descriptions(spark, d):
    """Descriptions checked against their bodies by the default verifier."""
    return extraction.verify(table(spark, d, "concepts"), "concept_id", "body", "description")


@query(
    """with v as (select *, row_number() over (partition by path order by loaded_at desc, concept_id desc) as no from concepts where path is not null)
    select n.path, n.concept_id from v n left join v o on o.path = n.path and o.no = 2 where n.no = 1 and (o.path is null or o.body is distinct from n.body)"""
)
def changed_versions(spark, d):
    """Newest versions of paths whose body differs from the version before, or that have none: what must be written (K6)."""
    concepts = table(spark, d, "concepts").select("path", "concept_id", "loaded_at", "body")
    new = folders.newest_versions(concepts)
    older = concepts.join(new.select("path", F.col("concept_id").alias("newest")), "path").where("concept_id <> newest").drop("newest")
    return folders.changed_rows(new, folders.newest_versions(older), "path", "body").select("path", "concept_id")


@query("select distinct f.rel_path from files f where f.rel_path is not null and f.rel_path not in (select s from (select unnest(sources) as s from concepts) where s is not null)")
def untold_files(spark, d):
    """Files that no concept lists (K2, J14, as of the anti-join of missing transcripts)."""
    listed = table(spark, d, "concepts").select(F.explode("sources").alias("rel_path")).where("rel_path is not null")
    return sinks.missing_transcripts(table(spark, d, "files").where("rel_path is not null").select("rel_path").distinct(), listed)


@query(
    """select regexp_extract(folder, '^[^/]*') as top, count(distinct folder) as n_folders, count(*) filter (okf_type = 'FolderSummary') as n_aggregates, bool_or(contains(body, '_Verification: FLAGGED')) as flagged
    from concepts where folder <> '' and not regexp_matches(folder, '(^|/)\\.') group by 1"""
)
def top_folders(spark, d):
    """What a README lists of each top folder."""
    rows = table(spark, d, "concepts").where("folder <> ''").where(~F.col("folder").rlike(r"(?:^|/)\."))
    return rows.groupBy(F.split("folder", "/")[0].alias("top")).agg(
        F.count_distinct("folder").alias("n_folders"), F.count_if(F.col("okf_type") == "FolderSummary").alias("n_aggregates"), F.bool_or(F.contains("body", F.lit(text.FLAG_MARKER))).alias("flagged")
    )


@query("select call_id, 'data:' || case when lower(right(host, 4)) = '.png' then 'image/png' else 'image/png' end || ';base64,' || to_base64(encode(coalesce(model, ''))) as url from llm_calls")
def image_payloads(spark, d):
    """Bytes as a data URL (P28, P29); here of short texts."""
    return table(spark, d, "llm_calls").select("call_id", extraction.image_payload(F.encode(F.coalesce("model", F.lit("")), "UTF-8"), F.coalesce("host", F.lit(""))).alias("url"))
