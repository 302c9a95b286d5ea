"""Queries of the general data problems p1, p5 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timestamps
from ..operators.dewey import frame_table, shred, stack_table
from ..operators.hierarchy import current_links, descendants, hierarchy
from ..operators.timestamps import dictionary_path, normalize_timestamps
from ..tables import table


def delivery_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Instants by the dictionary that the shared folder keeps, which each run extends by the texts it has not met."""
    rows, trackers = table(spark, folder, "bug_report"), table(spark, folder, "tracker")
    return normalize_timestamps(rows, trackers, "delivery_id", "creation_ts", "tracker_id", dictionary_path(spark))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery_instants(spark, folder).select("delivery_id", F.col("instant_us").alias("creation_us"))


def report_tree(spark: SparkSession, folder: str) -> DataFrame:
    links = current_links(table(spark, folder, "bug_report"), "bug_id", "dup_id", ["ingest_ts", "delivery_id"])
    return hierarchy(links)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return report_tree(spark, folder).select(
        F.col("id").alias("bug_id"), "root_id", F.col("depth").alias("node_depth"), F.array_join("path", "/").alias("node_path")
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every report with each ancestor of its tree."""
    return descendants(report_tree(spark, folder)).select("ancestor_id", F.col("id").alias("bug_id"), "distance")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = shred(table(spark, folder, "bug_report"), "delivery_id", "stacktrace", frames=False, attributes=False)
    return nodes.select(F.col("row_id").alias("delivery_id"), F.col("path").alias("stack_path"), "n_frames").distinct()


def p7_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """The table of stacks with their own fields and their parent."""
    nodes = shred(table(spark, folder, "bug_report"), "delivery_id", "stacktrace", frames=False)
    return stack_table(nodes).withColumnRenamed("row_id", "delivery_id")


def p7_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The table of frames with the stack they belong to."""
    return frame_table(shred(table(spark, folder, "bug_report"), "delivery_id", "stacktrace")).withColumnRenamed("row_id", "delivery_id")


QUERIES = {f.__name__: f for f in (p1_found, p5_found, p5_descendants, p7_found, p7_stacks, p7_frames)}
_CURRENT = """
cur as (select bug_id, dup_id from (
  select *, row_number() over (partition by bug_id order by ingest_ts desc, delivery_id desc) r from bug_report) where r = 1),
edge as (select bug_id, dup_id from cur where dup_id in (select bug_id from cur))"""
_TREE = f"""with recursive {_CURRENT},
walk as (
  select bug_id, dup_id as top, [bug_id] as path, dup_id = bug_id as ring from edge
  union all
  select w.bug_id, e.dup_id, list_prepend(w.top, w.path), e.dup_id = w.top or list_contains(w.path, e.dup_id)
  from walk w join edge e on e.bug_id = w.top where not w.ring)"""
SQL = {
    "p5_found": f"""{_TREE}
select bug_id, case when ring then list_min(path[1 : list_position(path, top)]) else top end as root_id,
  (case when ring then -1 else len(path) end)::int as node_depth,
  case when ring then '' else array_to_string(list_prepend(top, path), '/') end as node_path
from walk w where ring or top not in (select bug_id from edge)""",
    "p5_descendants": f"""{_TREE},
tree as (select bug_id, list_prepend(top, path) as path from walk where not ring and top not in (select bug_id from edge))
select path[i] as ancestor_id, bug_id, (len(path) - i)::int as distance
from tree, unnest(range(1, len(path))) as t(i)""",
}
_NODES = """with recursive texts as (select distinct delivery_id, stacktrace::json as j from bug_report where delivery_id is not null and json_valid(stacktrace)),
walk as (
  select delivery_id, '' as path, false as is_node, j from texts
  union all
  select delivery_id, n.path, n.is_node, n.j from (
    select delivery_id, unnest(case
      when json_type(j) = 'VARCHAR' and json_valid(j ->> '$') then [{'path': path, 'is_node': is_node, 'j': (j ->> '$')::json}]
      when not is_node and json_type(j) = 'ARRAY' then list_transform(range(0, json_array_length(j)::bigint), lambda i: {'path': path || '.' || i, 'is_node': true, 'j': json_extract(j, '$[' || i || ']')})
      when not is_node and json_type(j) = 'OBJECT' then [{'path': path || '.0', 'is_node': true, 'j': j}]
      when is_node and json_type(j) = 'OBJECT' and json_exists(j, '$.nested') then [{'path': path, 'is_node': false, 'j': json_extract(j, '$.nested')}]
      else [] end) as n from walk)),
listed as (select delivery_id, path[2:] as stack_path, j, json_extract(j, '$.frames') as f from walk where is_node and json_type(j) = 'OBJECT'),
unwrapped as (select delivery_id, stack_path, j, case when json_type(f) = 'VARCHAR' and json_valid(f ->> '$') then (f ->> '$')::json else f end as f from listed),
stacks as (select distinct delivery_id, stack_path, j, coalesce(case json_type(f) when 'ARRAY' then len(list_filter(json_extract(f, '$[*]'), lambda x: json_type(x) <> 'NULL')) when 'OBJECT' then 1 end, 0)::int as n_frames
  from unwrapped)"""
SQL["p7_found"] = f"{_NODES} select distinct delivery_id, stack_path, n_frames from stacks"
SQL["p7_stacks"] = f"""{_NODES} select distinct delivery_id, stack_path, nullif(regexp_replace(stack_path, '\\.?[0-9]+$', ''), '') as parent_stack, n_frames,
  j ->> '$.exception' as exception, j ->> '$.message' as message from stacks"""
SQL["p7_frames"] = f"""{_NODES}, held as (select distinct delivery_id, stack_path, case json_type(f) when 'ARRAY' then json_extract(f, '$[*]') when 'OBJECT' then [f] else [] end as fs from unwrapped),
frames as (select delivery_id, stack_path, unnest(range(0, len(fs))) as position, unnest(fs) as f from held)
select distinct delivery_id, stack_path, position::int as position, f ->> '$.depth' as depth, f ->> '$.function' as "function", f ->> '$.file' as file, f ->> '$.fileline' as fileline
from frames where json_type(f) <> 'NULL'"""


def _instants_sql() -> str:
    """``delivery_id, us`` of each delivery, by the same fixed forms; RE2 has no back-references, so a form whose marks must agree is one for each mark."""
    time = timestamps._TIME.replace(r"m\.?(?![a-z])", r"m(?:\.|\b)")
    forms: list[tuple[str, list[int], str]] = []
    for pattern, order in timestamps._FORMS:
        groups = [int(g[1:]) if g else 0 for g in order.split("|")]
        forms.append((pattern.replace(timestamps._TIME, time), groups, "true"))
    for date_order, groups in (("dmy", [4, 3, 1, 5, 6, 7, 8, 9, 10]), ("mdy", [4, 1, 3, 5, 6, 7, 8, 9, 10])):
        forms.append((timestamps._YEAR_LAST.replace(timestamps._TIME, time), groups, f"date_order = '{date_order}'"))
    tried = []
    for pattern, groups, only in forms:
        marked = r"\2" in pattern
        for mark in "-/." if marked else " ":
            one = pattern.replace("([-/.])", f"[{mark}]").replace(r"\2", f"[{mark}]")
            parts = ", ".join(f"regexp_extract(t, '{one}', {g - 1 if marked and g > 2 else g})" if g else "''" for g in groups)
            tried.append(f"when {only} and regexp_matches(t, '{one}') then [{parts}]")
    names = ", ".join(f"'{z}|{a}': {m}" for z, known in timestamps.ABBREVIATIONS.items() for a, m in known.items())
    months = ", ".join(f"'{m}'" for m in timestamps.MONTHS)
    low, high = timestamps.FIRST_S, timestamps.LAST_S
    white = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return rf"""
raw_ts as (select distinct delivery_id, creation_ts, home_zone, date_order from bug_report join tracker using (tracker_id) where creation_ts is not null and delivery_id is not null),
clean_ts as (select *, lower(regexp_replace(creation_ts, '^{white}|{white}$', '', 'g')) as t from raw_ts),
part_ts as (select *, case {' '.join(tried)} end as p, case when regexp_matches(t, '^\d{{1,20}}(?:\.\d+)?$') then try_cast(regexp_extract(t, '^\d+', 0) as bigint) end as whole,
  rpad(regexp_extract(t, '\.(\d+)$', 1), 6, '0') as frac from clean_ts),
field_ts as (select *, try_cast(p[1] as int) as y, coalesce(try_cast(p[2] as int), list_position([{months}], p[2][1:3])) as mo, try_cast(p[3] as int) as d,
  try_cast(coalesce(nullif(p[4], ''), '0') as int) as h0, try_cast(coalesce(nullif(p[5], ''), '0') as int) as mi, try_cast(coalesce(nullif(p[6], ''), '0') as int) as se,
  rpad(p[7], 6, '0')[1:6]::bigint as us, p[8] as half, upper(regexp_replace(p[9], '[\[\]]', '', 'g')) as zone from part_ts),
clock_ts as (select *, case when half = '' then h0 when h0 between 1 and 12 then h0 % 12 + case half when 'p' then 12 else 0 end end as h from field_ts),
local_ts as (select *, case when h < 24 and mi < 60 and se < 60 then try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, se) as timestamp) end as local,
  case when zone in ('Z', 'UTC', 'GMT', 'UT') then 0 when regexp_matches(zone, '^[+-]\d\d(:?\d\d)?$') then
    (case zone[1] when '-' then -1 else 1 end) * (zone[2:3]::int * 60 + coalesce(try_cast(regexp_extract(zone, '^...:?(\d\d)$', 1) as int), 0)) else map {{{names}}}[home_zone || '|' || zone] end as shift,
  case when zone = '' then home_zone when contains(zone, '/') then (select any_value(name) from pg_timezone_names() where upper(name) = zone) end as region from clock_ts),
moved_ts as (select *, timezone(region, local) as at_ from local_ts),
instant_ts as (select delivery_id, coalesce(case
  when whole >= {low} and whole < {high} then whole * 1000000 + coalesce(try_cast(frac as bigint), 0)
  when whole >= {low}000 and whole < {high}000 then whole * 1000 + coalesce(try_cast(frac[1:3] as bigint), 0)
  when whole >= {low}000000 and whole < {high}000000 then whole
  when whole >= {low}000000000 and whole < {high}000000000 then whole // 1000 end,
  case when shift is not null then epoch_us(local) - shift::bigint * 60000000
    when timezone(region, at_ - interval 1 hour) = local then epoch_us(at_) - 3600000000 else epoch_us(at_) end + us) as us from moved_ts)"""


INSTANTS_SQL = _instants_sql()
SQL["p1_found"] = f"with {INSTANTS_SQL} select distinct delivery_id, us::bigint as creation_us from instant_ts where us is not null"
TREE_SQL = _TREE
