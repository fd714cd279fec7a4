"""Queries over snapshots of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlode.operators.snapshots import artifact_changes
from siftlode.plans.runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return artifact_changes(load(spark, d, "artifact_candidates"), load(spark, d, "source_snapshots"))


QUERIES = {"p1_found": p1_found}

ORACLE = {
    "p1_found": r"""
with raw as (
  select snapshot_id, received_at,
    nullif(regexp_replace(lower(regexp_replace(checksum, '\s+', '', 'g')), '^[a-z0-9]{2,12}[:=-]', ''), '') as sum, logical_locator as loc
  from artifact_candidates where logical_locator is not null and snapshot_id is not null),
spelled as (select loc, string_split(replace(url_decode(regexp_replace(trim(loc, E' \t\r\n'), '%([^0-9A-Fa-f]|$)', '%25\1', 'g')), '\', '/'), '/') as parts
  from (select distinct loc from raw)),
named as (select loc, nfc_normalize(list_reduce(parts, lambda a, x: case when x in ('', '.') then a when x = '..' then regexp_replace(a, '/?[^/]*$', '')
    when a = '' then x else a || '/' || x end, '')) as k from spelled),
rec as (select snapshot_id, received_at, sum, k from raw join named using (loc)),
n as (select snapshot_id, count(distinct k) as n from rec group by 1),
h as (select root_identifier, snapshot_seq, min(s.snapshot_id) as snapshot_id
      from source_snapshots s join n using (snapshot_id) where n.n >= s.artifact_count group by 1, 2),
sq as (select *, lead(snapshot_seq) over (partition by root_identifier order by snapshot_seq) as nxt,
       lag(snapshot_seq) over (partition by root_identifier order by snapshot_seq) as prv from h),
one as (select root_identifier, snapshot_seq, nxt, prv, k, sum from (
   select q.*, r.k, r.sum, row_number() over (partition by r.snapshot_id, r.k order by r.received_at desc) as rn
   from rec r join sq q using (snapshot_id)) where rn = 1),
b as (select root_identifier, snapshot_seq, k, sum from one where prv is not null),
a as (select root_identifier, nxt as snapshot_seq, k, sum from one where nxt is not null)
select root_identifier, snapshot_seq, k as logical_locator,
  case when a.had is null then 'added' when b.had is null then 'removed' else 'changed' end as change_kind
from (select *, 1 as had from b) b full join (select *, 1 as had from a) a using (root_identifier, snapshot_seq, k)
where a.had is null or b.had is null or a.sum <> b.sum
"""
}
