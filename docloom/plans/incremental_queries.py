"""Problem 5: processing only new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.incremental import pending_files
from docloom.session import table

_RESULT = """
with ok as (select distinct run_id from ingest_runs where status = 'success'),
cur as (
  select regexp_replace(replace(rel_path, '\\', '/'), '^\\./', '') as rel_path,
         max(struct_pack(s := coalesce(scanned_at, timestamp '0001-01-01'), h := regexp_replace(lower(sha256), '^sha256:', ''), f := folder, n := name, l := loaded_at)) as x
  from files where sha256 is not null and rel_path is not null group by 1),
base as (
  select folder, arg_max(struct_pack(s := sources, h := source_hashes), struct_pack(a := stamped_at, b := loaded_at, c := concept_id)) as b
  from concepts join ok using (run_id)
  where okf_type = 'FolderSummary' and stamped_at is not null and folder is not null group by 1),
listed as (select folder, b.h as hashes, unnest(b.s) as src from base),
done as (
  select folder, regexp_replace(replace(src, '\\', '/'), '^\\./', '') as rel_path,
         max(regexp_replace(lower(hashes[regexp_extract(replace(src, '\\', '/'), '[^/]*$')]), '^sha256:', '')) as version
  from listed where src is not null group by 1, 2),
bound as (
  select min(r.started_at) as t from ingest_runs r, (select max(started_at) as m from ingest_runs where status = 'success') s
  where r.started_at <= s.m and (r.finished_at is null or r.finished_at >= s.m))
select cur.rel_path, cur.x.f as folder, cur.x.h as version,
       case when done.rel_path is null then 'new' else 'changed' end as change,
       case when bound.t is null or cur.x.l >= bound.t then 'reread' else 'backlog' end as part
from cur left join done on done.folder = cur.x.f and done.rel_path = cur.rel_path cross join bound
where done.rel_path is null or done.version is null or done.version <> cur.x.h
"""


def p5_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "concepts"), table(spark, sf_dir, "ingest_runs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pending(spark, sf_dir).select("rel_path", "change")


QUERIES = {"p5_found": p5_found, "p5_pending": p5_pending}
ORACLE = {"p5_found": f"select rel_path, change from ({_RESULT})", "p5_pending": _RESULT}
