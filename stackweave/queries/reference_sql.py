"""DuckDB SQL of the crash-report queries. Dynamic programmes are recursive over the query's frames, one row of the programme a step."""

from __future__ import annotations

_CANON = r"regexp_replace(regexp_replace(regexp_replace({x}, '\(.*\)', '', 'g'), '^_*GI_+', ''), '^_+', '')"
_DAY = 86_400_000_000
DAY_2015, DAY_2017, WINDOW = 16436, 17167, 730

_REPORTS = """
cur as (select bug_id, dup_id as dup, label from (
  select *, row_number() over (partition by bug_id order by ingest_ts desc, delivery_id desc) r from bug_report) where r = 1),
first_ as (select bug_id, epoch_us(min(ingest_ts)) as ts from bug_report group by bug_id),
linked as (select bug_id, case when dup in (select bug_id from cur) and dup <> bug_id then dup end as dup_id, label from cur),
reports as (select bug_id, dup_id, coalesce(dup_id, bug_id) as bucket, ts, label from linked join first_ using (bug_id))"""


def _stacks(depth: int = 300) -> str:
    return f"""
frame1 as (select bug_id, stack_no, depth, min("function") as name from stack_frame where depth >= 0 and depth < {depth} group by all),
deep as (select bug_id, stack_no, max(depth) as deepest from frame1 group by all),
filled as (select d.bug_id, d.stack_no, t.d::int as depth, f.name from deep d, unnest(range(0, d.deepest + 1)) as t(d)
  left join frame1 f on f.bug_id = d.bug_id and f.stack_no = d.stack_no and f.depth = t.d),
tok as (select bug_id, stack_no, depth, coalesce({_CANON.format(x="name")}, '??' || bug_id) as token from filled),
stacks as (select bug_id, stack_no, list(token order by depth) as tokens from tok group by all)"""


_DF = """
df as (select token, count(distinct bug_id) as df, count(distinct bug_id)::double / (select count(distinct bug_id) from tok)::double * 100 as percent from tok group by token),
weighed as (select bug_id, stack_no, list(token order by depth) as tokens, list(percent order by depth) as d from tok join df using (token) group by all)"""
_LISTED = "listed as (select distinct query_id, cand_id from recommendation where query_id is not null and cand_id is not null)"
_CELLS = """
cells as (select row_number() over () as id, query_id, cand_id, a.stack_no as q_stack, b.stack_no as c_stack, a.tokens as q, b.tokens as c
  from listed join stacks a on a.bug_id = query_id join stacks b on b.bug_id = cand_id)"""
_WEIGHED_CELLS = """
cells as (select row_number() over () as id, query_id, cand_id, a.stack_no as q_stack, b.stack_no as c_stack, a.tokens as q, b.tokens as c, a.d as dq, b.d as dc
  from listed join weighed a on a.bug_id = query_id join weighed b on b.bug_id = cand_id)"""
_PREFIX = """(coalesce(list_position(list_transform(range(1, least(len(q), len(c)) + 1), lambda i: q[i] <> c[i]), true), least(len(q), len(c)) + 1) - 1)::double / greatest(len(q), len(c))"""
_OUT = "query_id, cand_id, q_stack, c_stack"


def _programme(name: str, source: str, first_row: str, first_column: str, cell: str) -> str:
    """CTEs ``name`` (id, v): the last cell. In ``cell``, ``up``, ``lf``, ``dg`` and ``cross`` are its neighbours, i and j count from 0."""
    body = cell.replace("$up", "p.row[j + 1]").replace("$lf", "acc[j]").replace("$dg", "p.row[j]").replace("$cross", "p.prev[j - 1]")
    body = body.replace("$eq", "t.q[p.i + 1] = t.c[j]").replace("$i", "p.i").replace("$j", "(j - 1)")
    return f"""
{name}_dp as (
  select t.id, 0 as i, {first_row} as row, null::double[] as prev from {source} t
  union all
  select p.id, p.i + 1, list_reduce(range(1, len(t.c) + 1), lambda acc, j: list_append(acc, ({body})::double), [({first_column.replace("$i", "p.i")})::double]), p.row
  from {name}_dp p join {source} t on t.id = p.id where p.i < len(t.q)),
{name} as (select p.id, p.row[len(p.row)] as v from {name}_dp p join {source} t on t.id = p.id where p.i = len(t.q))"""


def _linear_row(step: str) -> str:
    return f"list_transform(range(0, len(t.c) + 1), lambda k: (k * ({step}))::double)"


def _unweighted(programmes: list[str], score: str, joins: str) -> str:
    return f"with recursive {_stacks()}, {_LISTED}, {_CELLS}, {', '.join(programmes)} select {_OUT}, round({score}, 6) as score from cells t {joins}"


def _edit(transpose: bool) -> str:
    swap = "case when $i > 0 and j > 1 and t.q[p.i + 1] = t.c[j - 1] and t.q[p.i] = t.c[j] and t.q[p.i + 1] <> t.c[j] then $cross + 1 else 1e300 end"
    cell = "least($up + 1, $lf + 1, $dg + case when $eq then 0 else 1 end" + (f", {swap})" if transpose else ")")
    real = _programme("real", "cells", _linear_row("1"), "$i + 1", cell)
    worst = _programme("worst", "cells", _linear_row("1"), "$i + 1", "least($up + 1, $lf + 1, $dg + 1)")
    return _unweighted([real, worst], "case when worst.v = 0 then 0 else 1 - real.v / worst.v end", "join real using (id) join worst using (id)")


def _weighted_sql(reciprocal: bool = True, total: bool = True, no_norm: bool = False, const: bool = False, sigmoid: bool = False, idf: bool = False, linear: bool = False) -> str:
    local = "1 / (k + 1) ** 0.5" if reciprocal else "exp(-0.5 * k)"
    x = "ln(100 / case when {d}[k + 1] = 0 then 100 else {d}[k + 1] end)" if idf else "{d}[k + 1]"
    shared = f"exp(-0.1 * {x})"
    if sigmoid:
        shared = f"1 / (1 + exp(-0.1 * {x} + 1))"
        shared = shared if idf else f"1 - {shared}"
    if linear:
        local, shared = "1 - k::double / len({d})", "1 - {d}[k + 1] / 100"
    weights = lambda d: f"list_transform(range(0, len({d})), lambda k: (({local}) * ({shared}))::double)".replace("{d}", d)
    hit = "1" if const else "greatest(t.qw[p.i + 1], t.cw[j]) * exp(-0.3 * abs($i - $j))"
    miss = "1" if const else ("t.qw[p.i + 1] + t.cw[j]" if total else "greatest(t.qw[p.i + 1], t.cw[j])")
    gap_up, gap_left = ("1", "1") if const else ("t.qw[p.i + 1]", "t.cw[j]")
    cell = f"greatest($up - {gap_up}, $lf - {gap_left}, $dg + case when $eq then {hit} else -({miss}) end)"
    first_row = "list_reduce(t.cw, lambda acc, w: list_append(acc, acc[len(acc)] - w), [0.0]::double[])"
    real = _programme("real", "weights", first_row, "p.row[1] - t.qw[p.i + 1]", cell)
    norm = """
flat as (select id, unnest(q) as token, unnest(qw) as a, 0.0::double as b from weights union all select id, unnest(c), 0.0, unnest(cw) from weights),
mass as (select id, sum(m) as mass from (select id, token, greatest(sum(a), sum(b)) as m from flat group by id, token) group by id)"""
    score = "real.v" if no_norm else "case when mass = 0 then 0 else real.v / mass end"
    return f"""with recursive {_stacks()}, {_DF}, {_LISTED}, {_WEIGHED_CELLS},
weights as (select *, {weights("dq")} as qw, {weights("dc")} as cw from cells), {real}, {norm}
select {_OUT}, round({score}, 6) as score from weights join real using (id) join mass using (id)"""


_SCORED = f"""{_stacks()}, {_LISTED}, {_CELLS}, cell as (select *, {_PREFIX} as s from cells),
rowbest as (select query_id, cand_id, q_stack, max(s) as b from cell group by all),
colbest as (select query_id, cand_id, c_stack, max(s) as b from cell group by all),
r as (select query_id, cand_id, avg(b) as m, count(*) as n from rowbest group by all),
c_ as (select query_id, cand_id, avg(b) as m, count(*) as n from colbest group by all),
best as (select query_id, cand_id, max(s) as m from cell group by all),
all_ as (select query_id, cand_id, best.m as mx, r.m as rm, c_.m as cm, r.n as rn, c_.n as cn from best join r using (query_id, cand_id) join c_ using (query_id, cand_id))"""


def _agg(pick: str) -> str:
    return f"with {_SCORED} select query_id, cand_id, round(coalesce({pick}, -9999999.99), 6) as score from listed left join all_ using (query_id, cand_id)"


_ASKED = "asked as (select distinct bug_id from query_report where bug_id is not null)"


def _window(queries: str, days: int = WINDOW) -> str:
    return f"""
q as (select bug_id as query_id, ts as query_ts from {queries} join reports using (bug_id)),
act as (select distinct query_id, query_ts, bucket from q join reports m on (m.ts, m.bug_id) < (query_ts, query_id) and query_ts // {_DAY} - m.ts // {_DAY} <= {days}),
cands as (select query_id, m.bug_id as cand_id from act join reports m using (bucket) where (m.ts, m.bug_id) < (query_ts, query_id))"""


_EVALUATED = "evaluated as (select bug_id from asked join reports using (bug_id) where coalesce(label, true))"
_RANKED = f"""{_REPORTS}, {_ASKED}, {_EVALUATED}, {_window("evaluated")}, {_stacks()},
cells as (select query_id, cand_id, a.tokens as q, b.tokens as c from cands join stacks a on a.bug_id = query_id join stacks b on b.bug_id = cand_id),
best as (select query_id, cand_id, max({_PREFIX}) as s from cells group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, cand_id desc)::int as rec_rank from (
  select query_id, cand_id, round(coalesce(s, -9999999.99), 6) as score from cands left join best using (query_id, cand_id)))"""
_POSITIONS = f"""{_RANKED},
known as (select query_id, cand_id, rec_rank, q.bucket as qb, c.bucket as cb from ranked join reports q on q.bug_id = query_id join reports c on c.bug_id = cand_id where q.bucket <> query_id),
hit as (select query_id, min(rec_rank) as hit_rank from known where qb = cb group by query_id),
buckets as (select query_id, cb, min(rec_rank) as r from known group by all),
place as (select query_id, count(*)::int as position from buckets join hit using (query_id) where r <= hit_rank group by query_id),
positions as (select query_id, position from (select distinct query_id from known) left join place using (query_id))"""
_STORED = """
stored as (select query_id, cand_id, max(score) as score from recommendation where score is not null and query_id is not null group by all),
listed_ as (select *, row_number() over (partition by query_id order by score desc, cand_id desc) as rec_rank from stored where query_id <> cand_id)"""
_BEST = f"{_REPORTS}, {_STORED}, top1 as (select score, dup_id is not null as pos from listed_ join reports on bug_id = query_id where rec_rank = 1)"
_ROC = f"""{_BEST}, counted as (select score, sum(pos::int) as p, sum((not pos)::int) as n from top1 group by score)"""
_SEEN = f"{_REPORTS}, heads as (select bucket, min((ts, bug_id)) as h from reports group by bucket), seen as (select bug_id, ts, (ts, bug_id) > h as seen_before from reports join heads using (bucket))"
_WALK = """
edge as (select bug_id, dup_id from reports where dup_id is not null),
walk as (
  select bug_id, dup_id as top, [bug_id] as path, dup_id = bug_id as ring from edge
  union all
  select w.bug_id, e.dup_id, list_prepend(w.top, w.path), e.dup_id = w.top or list_contains(w.path, e.dup_id) from walk w join edge e on e.bug_id = w.top where not w.ring),
ends as (select bug_id, ring, top, case when ring then list_min(path[1 : list_position(path, top)]) else top end as root from walk where ring or top not in (select bug_id from edge))"""
_ACYCLIC = f"""{_WALK},
kept as (select bug_id, case when exists (select 1 from ends e where e.ring and e.bug_id = reports.bug_id and e.root = reports.bug_id) then null else dup_id end as parent from reports)"""
_DOCS = "docs as (select doc_id, text from documents where text is not null)"
_LINES = rf"{_DOCS}, lines as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1)::int - 1 as line_no from docs)"
_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TOKENS = rf"list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')"
_PUNCT = r"!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def _tokens(f: str) -> str:
    return f"with {_DOCS} select doc_id, coalesce(array_to_string(list_transform({_TOKENS}, lambda x: {f}), ' '), '') as out from docs"


def _text(f: str) -> str:
    return f"with {_DOCS} select doc_id, {f} as out from docs"


def _frame_columns(line: str) -> str:
    """The fields of a debugger's frame, ``fn`` for the function, by the first form that fits."""
    from ..functions.parsing import FRAME_FORMS

    whens: dict[str, list[str]] = {k: [] for k in ("depth", "address", "function", "args", "file0", "dylib")}
    for pattern, groups in FRAME_FORMS:
        test = f"when regexp_matches({line}, '{pattern}') then "
        whens["depth"].append(f"{test}try_cast(regexp_extract({line}, '{pattern}', 1) as int)")
        for field in ("address", "function", "args", "file", "dylib"):
            key = "file0" if field == "file" else field
            whens[key].append(test + (f"regexp_extract({line}, '{pattern}', {groups[field]})" if field in groups else "null"))
    return ", ".join(f"case {' '.join(w)} end as {k if k != 'function' else 'fn'}" for k, w in whens.items())


def _file_columns() -> str:
    from ..functions.parsing import FILE_LINE

    return f"""case when regexp_matches(file0, '{FILE_LINE}') then regexp_extract(file0, '{FILE_LINE}', 1) else file0 end as file,
  case when regexp_matches(file0, '{FILE_LINE}') then regexp_extract(file0, '{FILE_LINE}', 2) end as fileline"""


def _frame_sql() -> str:
    return f"""with {_LINES}, f as (select doc_id, line_no, {_frame_columns('line')} from lines where starts_with(line, '#'))
select doc_id, line_no, depth, address, fn as "function", args, {_file_columns()}, dylib from f where fn is not null"""


def _odd(x: str) -> str:
    return rf"(length({x}) - length(regexp_replace({x}, '[\p{{N}}{_PUNCT}]', '', 'g')))"


def _repeat(x: str) -> str:
    """A token of one repeated mark is one; RE2 has no back-references, so mark by mark."""
    out = x
    for mark in ",:;><!?=_\\/":
        # Every mark of the set but the backslash stands for itself in brackets.
        inside = "\\\\" if mark == "\\" else mark
        out = f"regexp_replace({out}, '^[{inside}]{{2,}}$', '{inside}')"
    out = f"regexp_replace({out}, '^[.]{{4,}}$', '...')"
    out = f"regexp_replace({out}, '^[.]{{2}}$', '.')"
    return f"regexp_replace({out}, '^-{{3,}}$', '--')"


_STOP = "('i','me','my','myself','we','our','ours','ourselves','you','your','yours','yourself','yourselves','he','him','his','himself','she','her','hers','herself','it','its','itself','they','them','their','theirs','themselves','what','which','who','whom','this','that','these','those','am','is','are','was','were','be','been','being','have','has','had','having','do','does','did','doing','a','an','the','and','but','if','or','because','as','until','while','of','at','by','for','with','about','against','between','into','through','during','before','after','above','below','to','from','up','down','in','out','on','off','over','under','again','further','then','once','here','there','when','where','why','how','all','any','both','each','few','more','most','other','some','such','no','nor','not','only','own','same','so','than','too','very','s','t','can','will','just','don','should','now')"
_URL = r"regexp_replace(regexp_replace({x}, '^(?:https?://|www\.)\S+$', '#URL'), '^\S+(?:\.com|\.net|\.org)(?:[/?][-a-zA-Z0-9@;:%_+.~#?&/=]*)?$', '#URL')"
_STRIP = rf"regexp_replace({{x}}, '^[\d{_PUNCT}]+|[\d{_PUNCT}]+$', '', 'g')"

SQL: dict[str, str] = {
    "reports_canonical": f"with {_REPORTS} select * from reports",
    "frames_encode": f"with {_stacks()} select * from stacks",
    "frames_maxdepth": f"with {_stacks(5)} select * from stacks",
    "frames_distinct_stacks": f"with {_stacks()} select bug_id, tokens, min(stack_no) as stack_no from stacks group by all",
    "fn_canonical": f'select distinct "function", {_CANON.format(x=chr(34) + "function" + chr(34))} as canonical from stack_frame where "function" is not null',
    "fn_module_pairs": f"""with d as (select distinct "function" as f, file, dylib, string_split("function", '::') as p from stack_frame where "function" is not null)
select f as "function", file, dylib, {_CANON.format(x="p[len(p)]")} as inner_function, case when len(p) > 1 then array_to_string(p[1 : len(p) - 1], '::') end as namespace,
  coalesce(string_split(file, '/')[-1], string_split(dylib, '/')[-1]) as file_module from d""",
    "fn_package": rf"""with n as (select doc_id, regexp_extract_all(text, '\tat ([\w.$]+)\(', 1) as names from documents),
p as (select doc_id, list_transform(list_filter(names, lambda n: len(string_split(n, '.')) >= 3), lambda n: {_CANON.format(x="array_to_string(string_split(n, '.')[1 : len(string_split(n, '.')) - 2], '.')")}) as packages from n where len(names) > 0)
select doc_id, case when len(packages) > 0 then packages else ['@@@' || doc_id || '@@@'] end as packages from p""",
    "depth_segments": """with o as (select distinct bug_id, stack_no::bigint * 100000 + depth as place, depth from stack_frame),
m as (select *, case when depth > lag(depth) over w or lag(depth) over w is null then 0 else 1 end as fresh from o window w as (partition by bug_id order by place))
select bug_id, place, depth, (sum(fresh) over (partition by bug_id order by place))::int as segment from m""",
    "recursion_repeats": f"""with {_stacks()} select bug_id, stack_no, list_transform(list_filter(range(1, len(tokens) + 1), lambda i: i = 1 or tokens[i] = '??' || bug_id or tokens[i] <> tokens[i - 1]), lambda i: tokens[i]) as tokens from stacks""",
    "recursion_jumps": f"""with recursive {_stacks()}, w as (
  select bug_id, stack_no, tokens, 1 as pos, []::varchar[] as done from stacks
  union all
  select bug_id, stack_no, tokens, case when tokens[pos] = '??' || bug_id then pos + 1 else len(tokens) - list_position(list_reverse(tokens), tokens[pos]) + 2 end, list_append(done, tokens[pos]) from w where pos <= len(tokens))
select bug_id, stack_no, done as tokens from w where pos > len(tokens)""",
    "df_reports": f"with {_stacks()}, {_DF} select token, df, round(percent, 6) as percent from df",
    "df_stacks": f"""with {_stacks()} select token, count(distinct (bug_id, stack_no)) as df, round(count(distinct (bug_id, stack_no))::double / (select count(*) from stacks)::double * 100, 6) as percent from tok group by token""",
    "df_asof": f"""with {_REPORTS}, {_stacks()}, asked as (select distinct chunk_id, query_ord, bug_id from query_report where bug_id is not null),
num as (select row_number() over (order by chunk_id, query_ord, bug_id) - 1 as query_ord, bug_id from asked),
newest as (select max((ts, bug_id)) as k from reports where bug_id in (select bug_id from num)),
base as (select bug_id from reports where (ts, bug_id) <= (select k from newest) and bug_id not in (select bug_id from num)),
held as (select distinct bug_id, token from tok),
bdf as (select token, count(*) as n from held where bug_id in (select bug_id from base) group by token),
hit as (select query_ord, bug_id, token, count(*) over (partition by token order by query_ord) as added from num join held using (bug_id))
select query_ord, bug_id, token, coalesce(n, 0) + added as df, (select count(*) from base) + query_ord + 1 as total from hit left join bdf using (token)""",
    "bow_idf": f"with {_stacks()} select token, round((select count(distinct bug_id) from tok)::double / (count(distinct bug_id) + 1e-11), 6) as idf from tok group by token",
    "trim_stopwords": f"""with {_stacks()}, {_DF}, s as (select *, list_transform(d, lambda x: x > 5.0) as stop from weighed),
e as (select *, list_position(stop, false) as a, len(stop) - list_position(list_reverse(stop), false) + 1 as b from s)
select bug_id, stack_no, tokens[a : b] as tokens from e where list_contains(stop, false)""",
    "drop_stopwords": f"""with {_stacks()}, {_DF}, s as (select bug_id, stack_no, list_transform(list_filter(range(1, len(tokens) + 1), lambda i: d[i] <= 5.0), lambda i: tokens[i]) as tokens from weighed)
select * from s where len(tokens) > 0""",
    "tf_bag": f"with {_stacks()} select bug_id, token as term, count(*) as freq from tok group by all",
    "ngram_bag": f"""with {_stacks()}, g as (
  select bug_id, token as term from tok
  union all select a.bug_id, a.token || chr(10) || b.token from tok a join tok b on a.bug_id = b.bug_id and a.stack_no = b.stack_no and b.depth = a.depth + 1
  union all select a.bug_id, a.token || chr(10) || b.token || chr(10) || c.token from tok a join tok b on a.bug_id = b.bug_id and a.stack_no = b.stack_no and b.depth = a.depth + 1
    join tok c on a.bug_id = c.bug_id and a.stack_no = c.stack_no and c.depth = a.depth + 2)
select bug_id, term, count(*) as freq from g group by all""",
    "tfidf_unit": r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as terms from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
w as (select doc_id, term, tf * ln((select count(*) from d)::double / df) as w from tf join df using (term)),
n as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id)
select doc_id, term, round(w / norm, 6) as weight from w join n using (doc_id) where norm > 0""",
    "cands_all": f"with {_REPORTS}, {_ASKED}, q as (select bug_id as query_id, ts as query_ts from asked join reports using (bug_id)) select query_id, bug_id as cand_id from q join reports on (ts, bug_id) < (query_ts, query_id)",
    "cands_window": f"with {_REPORTS}, {_ASKED}, {_window('asked')} select * from cands",
    "bucket_activity": f"with {_REPORTS}, {_ASKED}, {_window('asked')} select query_id, bucket from act",
    "cands_universe": f"with {_REPORTS}, {_ASKED} select bug_id, ts from reports where (ts, bug_id) <= (select max((ts, bug_id)) from reports where bug_id in (select bug_id from asked))",
    "queries_evaluated": f"with {_REPORTS}, {_ASKED}, {_EVALUATED} select * from evaluated",
    "sim_prefix": f"with {_stacks()}, {_LISTED}, {_CELLS} select {_OUT}, round({_PREFIX}, 6) as score from cells",
    "sim_overlap": f"""with {_stacks()}, {_LISTED}, {_CELLS} select {_OUT}, round(list_sum(list_transform(list_distinct(q), lambda t: least(len(list_filter(q, lambda x: x = t)), len(list_filter(c, lambda x: x = t)))))::double / least(len(q), len(c)), 6) as score from cells""",
    "sim_nw": _unweighted(
        [
            _programme("real", "cells", _linear_row("-0.5"), "-0.5 * ($i + 1)", "greatest($up - 0.5, $lf - 0.5, $dg + case when $eq then 2 else -1 end)"),
            _programme("low", "cells", _linear_row("-0.5"), "-0.5 * ($i + 1)", "greatest($up - 0.5, $lf - 0.5, $dg - 1)"),
        ],
        "case when least(len(t.q), len(t.c)) * 2 = low.v then 0 else (real.v - low.v) / (least(len(t.q), len(t.c)) * 2 - low.v) end",
        "join real using (id) join low using (id)",
    ),
    "sim_positional": _unweighted(
        [_programme("real", "cells", _linear_row("0"), "0", "greatest($up, $lf, $dg + case when $eq then exp(-0.1 * least($i, $j)) * exp(-0.2 * abs($i - $j)) else 0 end)")],
        "real.v / list_sum(list_transform(range(0, least(len(t.q), len(t.c))), lambda k: exp(-0.1 * k)))",
        "join real using (id)",
    ),
    "sim_dl": _edit(True),
    "sim_levenshtein": _edit(False),
    "sim_linear": f"""with recursive {_stacks()}, {_DF}, {_LISTED}, {_WEIGHED_CELLS}, {_programme(
        "real", "cells", _linear_row("-0.5"), "-0.5 * ($i + 1)", "greatest($up - 0.5, $lf - 0.5, $dg + case when $eq then (1 - t.dq[p.i + 1] / 100) * (1 - p.i::double / len(t.q)) * exp(-abs($i - $j) / 2.0) else 0 end)"
    )} select {_OUT}, round(real.v, 6) as score from cells join real using (id)""",
    "sim_weighted_default": _weighted_sql(),
    "sim_weighted_exponential": _weighted_sql(reciprocal=False),
    "sim_weighted_no_sum": _weighted_sql(total=False),
    "sim_weighted_no_norm": _weighted_sql(no_norm=True),
    "sim_weighted_const": _weighted_sql(const=True),
    "sim_weighted_sigmoid": _weighted_sql(sigmoid=True),
    "sim_weighted_sigmoid_idf": _weighted_sql(sigmoid=True, idf=True),
    "sim_weighted_linear": _weighted_sql(linear=True),
    "sim_bow": f"""with {_stacks()}, {_LISTED}, g as (
  select bug_id, token as term from tok
  union all select a.bug_id, a.token || chr(10) || b.token from tok a join tok b on a.bug_id = b.bug_id and a.stack_no = b.stack_no and b.depth = a.depth + 1),
bag as (select bug_id, term, count(*) as freq from g group by all),
idf as (select term, (select count(distinct bug_id) from tok)::double / (count(*) + 1e-11) as idf from bag group by term),
size as (select bug_id, sum(freq) as size from bag group by bug_id),
w as (select bug_id, term, freq / size * idf as w from bag join size using (bug_id) join idf using (term)),
norm as (select bug_id, sqrt(sum(w * w)) as n from w group by bug_id),
dot as (select query_id, cand_id, sum(a.w * b.w) as dot from listed join w a on a.bug_id = query_id join w b on b.bug_id = cand_id and a.term = b.term group by all)
select query_id, cand_id, round(case when a.n is null or b.n is null then -9999999.99 else coalesce(dot / (a.n * b.n), 0) end, 6) as score
from listed left join dot using (query_id, cand_id) left join norm a on a.bug_id = query_id left join norm b on b.bug_id = cand_id""",
    "agg_max": _agg("mx"),
    "agg_avg_query": _agg("rm"),
    "agg_avg_cand": _agg("cm"),
    "agg_avg_short": _agg("case when rn <= cn then rm else cm end"),
    "agg_avg_long": _agg("case when cn <= rn then rm else cm end"),
    "agg_avg_query_cand": _agg("(rm + cm) / 2"),
    "agg_weighted": f"""with {_SCORED}, {_DF}, wt as (select bug_id as query_id, stack_no as q_stack, list_avg(list_transform(d, lambda x: 100 - x)) as w from weighed)
select query_id, cand_id, round(sum(w * b) / sum(w), 6) as score from rowbest join wt using (query_id, q_stack) group by all""",
    "filter_select_one": f"""with {_stacks()}, {_DF}, s as (select bug_id, stack_no, list_max(list_transform(d, lambda x: 100 - x)) as m, round(list_avg(list_transform(d, lambda x: 100 - x)), 9) as a from weighed)
select bug_id, stack_no from (select *, row_number() over (partition by bug_id order by m desc, a desc, stack_no) as r from s) where r = 1""",
    "filter_top_k": f"""with {_stacks()}, {_DF}, o as (select 100 - percent as rare, row_number() over (order by 100 - percent) - 1 as place, count(*) over () as v from df),
thr as (select rare from o where place = least(floor((1 - 0.5) * v), v - 1))
select bug_id, stack_no from weighed where list_max(list_transform(d, lambda x: 100 - x)) >= (select rare from thr)""",
    "rank_top5": f"with {_RANKED} select * from ranked where rec_rank <= 5",
    "rank_topn_first_hit": f"""with {_RANKED}, known as (select query_id, rec_rank, q.bucket as qb, c.bucket as cb from ranked join reports q on q.bug_id = query_id join reports c on c.bug_id = cand_id),
lim as (select query_id, case when any_value(qb) = query_id then 5 when min(case when qb = cb then rec_rank end) is null then 2147483647 else greatest(min(case when qb = cb then rec_rank end), 5) end as l from known group by query_id)
select ranked.* from ranked join lim using (query_id) where rec_rank <= l""",
    "rank_repair": f"""with {_RANKED}, five as (select * from ranked where rec_rank <= 5),
both_ as (select query_id, cand_id, score, rec_rank as o from five union all select query_id, cand_id, -999999999.99, null from cands anti join five using (query_id, cand_id))
select query_id, cand_id, score, row_number() over (partition by query_id order by o nulls last, cand_id desc)::int as rec_rank from both_""",
    "rank_violations": f"""with {_REPORTS}, {_ASKED}, {_window("asked")}, l as (select distinct query_id, cand_id from recommendation where query_id is not null)
select query_id, 'foreign candidate' as problem from l anti join cands using (query_id, cand_id)
union select query_id, 'not a query' from l where query_id not in (select bug_id from asked)
union select bug_id, 'no list' from asked where bug_id not in (select query_id from l)""",
    "metric_positions": f"with {_POSITIONS} select * from positions",
    "metric_positions_plain": f"with {_POSITIONS} select query_id, hit_rank::int as position from (select distinct query_id from known) left join hit using (query_id)",
    "metric_rr_mrr": f"""with {_POSITIONS} select count(*) as queries, round(avg(coalesce(1.0 / position, 0)), 6) as mrr, list_transform(range(1, 21), lambda k: round(len(list_filter(list(position), lambda p: p <= k))::double / count(*), 6)) as recall from positions""",
    "metric_roc": f"with {_ROC} select score as threshold, round(sum(p) over w / (select sum(p) from counted)::double, 6) as tpr, round(sum(n) over w / (select sum(n) from counted)::double, 6) as fpr from counted window w as (order by score desc)",
    "metric_auc": f"with {_ROC}, b as (select *, sum(n) over (order by score) - n as low from counted) select round(sum(p * (low + n / 2.0)) / (sum(p)::double * sum(n)), 6) as auc from b",
    "chain_resolve": f"""with recursive {_REPORTS}, {_STORED}, pred as (select query_id, cand_id as predicted from listed_ where rec_rank = 1),
edge as (select query_id, predicted from pred where predicted in (select query_id from pred)),
walk as (
  select query_id, predicted as top, [query_id] as path, predicted = query_id as ring from edge
  union all
  select w.query_id, e.predicted, list_prepend(w.top, w.path), e.predicted = w.top or list_contains(w.path, e.predicted) from walk w join edge e on e.query_id = w.top where not w.ring),
ends as (select query_id, case when ring then list_min(path[1 : list_position(path, top)]) else top end as root from walk where ring or top not in (select query_id from edge)),
last_ as (select query_id, coalesce(root, predicted, query_id) as bug_id from pred left join ends using (query_id))
select query_id, coalesce(bucket, bug_id) as bucket from last_ left join reports using (bug_id)""",
    "master_by_report": f"with {_REPORTS} select bug_id, bucket as master_id from reports",
    "master_sets": f"with {_REPORTS} select bucket as master_id, count(*) as members, min(bug_id) as first_member, max(bug_id) as last_member from reports group by bucket having count(*) > 1",
    "master_violations": f"with {_REPORTS} select bug_id, dup_id from reports where dup_id > bug_id",
    "first_deliveries": f"""with r as (select bug_id, delivery_id, epoch_us(ingest_ts) as ts, short_desc from bug_report where ingest_ts <= make_timestamp({DAY_2017 * _DAY}) and trim(short_desc) <> '')
select bug_id, delivery_id, ts, short_desc from (select *, row_number() over (partition by bug_id order by ts, delivery_id) as n from r) where n = 1""",
    "adopt_orphans": f"""with {_REPORTS}, raw as (select bug_id, dup as dup_id, ts from cur join first_ using (bug_id)),
heads as (select dup_id, arg_min(bug_id, (ts, bug_id)) as head from raw where dup_id is not null and dup_id not in (select bug_id from raw) group by dup_id)
select bug_id, case when head is null then dup_id when head <> bug_id then head end as dup_id, ts from raw left join heads using (dup_id)""",
    "break_cycles": f"with recursive {_REPORTS}, {_ACYCLIC} select bug_id as id, parent from kept",
    "break_two_cycles": f"with {_REPORTS} select a.bug_id as id, case when b.bug_id is null or a.bug_id > a.dup_id then a.dup_id end as parent from reports a left join reports b on b.bug_id = a.dup_id and b.dup_id = a.bug_id",
    "flatten_tree": f"""with recursive {_REPORTS}, {_ACYCLIC}, up as (
  select bug_id, parent, 1 as n from kept where parent is not null union all select u.bug_id, k.parent, n + 1 from up u join kept k on k.bug_id = u.parent where k.parent is not null)
select kept.bug_id as id, arg_max(up.parent, n) as parent from kept left join up on up.bug_id = kept.bug_id group by kept.bug_id""",
    "nested_masters": f"with {_REPORTS} select bug_id as id, dup_id as parent from reports where dup_id in (select bug_id from reports where dup_id is not null)",
    "remaster_oldest": f"""with {_REPORTS}, h as (select bucket, arg_min(bug_id, (ts, bug_id)) as o, min(bug_id) as l from reports group by bucket),
n as (select bug_id, l, case when bug_id = o then l when bug_id = l then o else bug_id end as new from reports join h using (bucket))
select new as bug_id, case when new <> bug_id then bug_id end as original_bug_id, case when new <> l then l end as dup_id from n""",
    "masters_of_labels": f"""with {_REPORTS}, k as (select * from (select *, count(*) over (partition by bucket) as size from reports) where size = 1 or label is not null),
h as (select bucket, arg_min(bug_id, (ts, bug_id)) as head from k group by bucket)
select bug_id, case when head <> bug_id then head end as dup_id from k join h using (bucket)""",
    "flag_duplicates": f"with {_SEEN} select bug_id, seen_before from seen",
    "split_fraction": f"""with {_SEEN}, d as (select (ts, bug_id) as k, row_number() over (order by ts, bug_id) - 1 as place, count(*) over () as n from seen where seen_before)
select bug_id, case when (ts, bug_id) > (select k from d where place = floor((1 - 0.3) * n)) then 'test' else 'training' end as part from seen""",
    "split_after_n": f"""with {_SEEN}, d as (select (ts, bug_id) as k, row_number() over (order by ts, bug_id) as place from seen where seen_before and ts >= {DAY_2015 * _DAY})
select bug_id, case when ts >= {DAY_2015 * _DAY} and (ts, bug_id) > (select k from d where place = 50) then 'test' else 'training' end as part from seen""",
    "split_date": f"with {_SEEN} select bug_id, case when ts < {DAY_2015 * _DAY} then 'training' else 'test' end as part from seen",
    "split_validation": f"""with {_SEEN}, d as (select (ts, bug_id) as k, row_number() over (order by ts, bug_id) - 1 as place, count(*) over () as n from seen where seen_before and ts < {DAY_2017 * _DAY})
select bug_id, case when ts >= {DAY_2017 * _DAY} then 'test' when (ts, bug_id) > (select k from d where place = floor((1 - 0.2) * n)) then 'validation' else 'training' end as part from seen""",
    "split_chunk": f"""with {_REPORTS}, d as (select (ts, bug_id) as k, row_number() over (order by ts desc, bug_id desc) as place from reports where dup_id is not null and ts < {DAY_2017 * _DAY})
select bug_id, case when ts >= {DAY_2017 * _DAY} then 'test' when (ts, bug_id) < (select k from d where place = 100) then 'training' else 'validation' end as part, dup_id is not null as duplicate
from reports where ts < {(DAY_2017 + 365) * _DAY}""",
    "reports_by_day": f"with {_REPORTS} select ts // {_DAY} as day, count(*) as reports from reports group by 1",
    "parse_gdb": _frame_sql(),
    "parse_groups": rf"""with {_LINES}, n as (select *, sum(starts_with(line, '#')::int) over (partition by doc_id order by line_no) as g from lines),
bad as (select distinct doc_id from lines where starts_with(line, 'rax'))
select doc_id, (g - 1)::int as group_no, rtrim(arg_min(line, line_no)) as line, count(*)::int as lines, regexp_extract(arg_max(line, line_no) filter (regexp_matches(line, '^\s*at\s+([^\s:]+):(\d+)\s*$')), '^\s*at\s+([^\s:]+):(\d+)\s*$', 1) as file
from n where g > 0 and doc_id not in (select doc_id from bad) group by doc_id, g""",
    "parse_threads": rf"""with {_DOCS}, p as (select doc_id, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?im)^Thread +[0-9]+') as parts from docs)
select doc_id, (i - 2)::int as thread_no, parts[i] as body from p, unnest(range(2, len(parts) + 1)) as t(i)""",
    "null_unknown": """select distinct "function", case when "function" = '??' or regexp_matches("function", '^0x[0-9a-zA-Z]+ in') then null else "function" end as known from stack_frame""",
    "first_attachments": f"""with {_REPORTS}, f as (select bug_id, min((epoch_us(posted_ts), doc_id)) as a from documents where doc_kind = 'attachment' and bug_id is not null and posted_ts is not null group by bug_id)
select bug_id, a[2] as doc_id from f join reports using (bug_id) where a[1] - ts <= 600000000""",
    "text_lower": _tokens("lower(x)"),
    "text_digits": _tokens("regexp_replace(x, '[0-9]', '0', 'g')"),
    "text_number": _tokens("regexp_replace(x, '[0-9]+', '0', 'g')"),
    "text_html": _tokens("regexp_replace(x, '(?:&quot|&gt|&lt|&amp|&nbsp|&copy|&reg)+', '', 'g')"),
    "text_stop": _tokens(f"case when x in {_STOP} then '' else x end"),
    "text_module": _tokens(r"regexp_replace(x, '^[a-zA-Z][a-zA-Z0-9]+(?:\.[a-zA-Z][a-zA-Z0-9]+)+(?:\(\))?$', '#MODULE_FUNCTION')"),
    "text_symbols": _tokens(r"regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g')"),
    "text_url": _tokens(_URL.format(x="x")),
    "text_repeat": _tokens(_repeat("x")),
    "text_no_punct": _tokens(f"regexp_replace(x, '[{_PUNCT}]', '', 'g')"),
    "text_strip": _tokens(_STRIP.replace("{x}", "x")),
    "text_unusual": _tokens(f"case when length(x) > 0 and {_odd('x')}::double / greatest(length(x), 1) > 0.2 then '' else x end"),
    "text_filters": _tokens(_STRIP.replace("{x}", _URL.format(x="regexp_replace(lower(x), '[0-9]+', '0', 'g')"))),
    "text_whitespace": _text(_TOKENS),
    "text_alnum": _text(r"list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '')"),
    "text_stripped": _text(f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"),
    "text_quotes": _text(f"""(select list_transform(range(1, len(tk) + 1), lambda i: case when tk[i] not in ('"', '`', '''') then tk[i]
  when len(list_filter(tk[1 : i - 1], lambda y: y in ('"', '`', ''''))) % 2 = 0 then '``' else '''''' end) from (select {_TOKENS} as tk))"""),
    "text_field": "select doc_id, coalesce(text, 'NNNOOONNNEEE') as out from documents",
    "recommendation_lists": "select distinct query_id, rec_rank, cand_id, score from recommendation where query_id is not null",
    "dataset_lines": """with r as (select distinct * from query_report)
select chunk_id as chunk, array_to_string(list(bug_id::varchar order by query_ord, bug_id), ' ') as ids,
  coalesce(array_to_string(list(bug_id::varchar order by query_ord, bug_id) filter (is_duplicate), ' '), '') as duplicates from r group by chunk_id""",
}
SQL["sim_overlap_merge"] = SQL["sim_overlap"]
SQL["eval_prefix"] = (
    f"with {_POSITIONS} select count(*) as queries, round(avg(coalesce(1.0 / position, 0)), 6) as mrr, "
    "round(avg(coalesce((position <= 1)::int::double, 0)), 6) as recall_1, round(avg(coalesce((position <= 10)::int::double, 0)), 6) as recall_10 from positions"
)
_TOP_LINE = r"(?m)(.+?) *[(].*?(?: +(?:at|from) +(\S+)|$)"
SQL["parse_top"] = rf"""with {_DOCS}, p as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from docs),
g as (select doc_id, regexp_extract_all(t, '{_TOP_LINE}', 1) as a, regexp_extract_all(t, '{_TOP_LINE}', 2) as b from p)
select doc_id, (i - 1)::int as frame_no, trim(a[i]) as "function", nullif(b[i], '') as file from g, unnest(range(1, len(a) + 1)) as t(i)"""
_PDM_PAIRS = f"""{_stacks()}, {_STORED}, ten as (select query_id, cand_id, score from listed_ where rec_rank <= 10),
cells as (select row_number() over () as id, query_id, cand_id, a.tokens as q, b.tokens as c from ten join stacks a on a.bug_id = query_id join stacks b on b.bug_id = cand_id)"""
_PDM = _programme("real", "cells", _linear_row("0"), "0", "greatest($up, $lf, $dg + case when $eq then exp(-0.1 * least($i, $j)) * exp(-0.2 * abs($i - $j)) else 0 end)")
SQL["sim_blend"] = f"""with recursive {_PDM_PAIRS}, {_PDM},
one as (select query_id, cand_id, max(real.v / list_sum(list_transform(range(0, least(len(q), len(c))), lambda k: exp(-0.1 * k)))) as s from cells join real using (id) group by all),
p as (select query_id, cand_id, score as t, coalesce(s, -9999999.99) as s from ten left join one using (query_id, cand_id))
select query_id, cand_id, round(case when s is null then -999999999.99 when 0.4 * s + 0.6 * t = 0 then 0 else t * s / (0.4 * s + 0.6 * t) end, 6) as score
from listed_ left join p using (query_id, cand_id)"""
_SAME = "(case when {a} = '' and {b} = '' then false else {a} = {b} end)"
_M = lambda i, j: _SAME.format(a=f"t.q[{i}]", b=f"t.c[{j}]")
_DELETE = f"case when {_M('p.i + 1', 'j')} or (j < len(t.c) and {_M('p.i + 1', 'j + 1')}) then 0.5 else 1 end"
_INSERT = f"case when {_M('p.i + 1', 'j')} or (p.i + 1 < len(t.q) and {_M('p.i + 2', 'j')}) then 0.5 else 1 end"
_SUBSTITUTE = f"case when not {_M('p.i + 1', 'j')} then 1 when t.qf[p.i + 1] <> '' and t.qf[p.i + 1] = t.cf[j] then 0 else 0.6 end"
_SPLIT = lambda x: f"string_split({x}, '::')"
_MODULE = f"case when starts_with(x, '??') then '' else coalesce(case when len({_SPLIT('x')}) > 1 then array_to_string({_SPLIT('x')}[1 : len({_SPLIT('x')}) - 1], '::') end, '') end"
_INNER = f"case when starts_with(x, '??') then '' else {_CANON.format(x=_SPLIT('x') + '[-1]')} end"
SQL["sim_modules"] = f"""with recursive {_stacks()}, {_LISTED},
both_ as (select bug_id, stack_no, list_transform(tokens, lambda x: {_MODULE}) as m, list_transform(tokens, lambda x: {_INNER}) as f from stacks),
cells as (select row_number() over () as id, query_id, cand_id, a.stack_no as q_stack, b.stack_no as c_stack, a.m as q, b.m as c, a.f as qf, b.f as cf
  from listed join both_ a on a.bug_id = query_id join both_ b on b.bug_id = cand_id),
{_programme("real", "cells", _linear_row("1"), "$i + 1", f"least($up + {_DELETE}, $lf + {_INSERT}, $dg + {_SUBSTITUTE})")},
{_programme("worst", "cells", _linear_row("1"), "$i + 1", "least($up + 1, $lf + 1, $dg + 1)")}
select {_OUT}, round(case when worst.v = 0 then 0 else real.v / worst.v end, 6) as score from cells join real using (id) join worst using (id)"""
SQL["parse_locations"] = rf"""with {_LINES}, n as (select *, sum(starts_with(line, '#')::int) over (partition by doc_id order by line_no) as g from lines),
bad as (select distinct doc_id from lines where starts_with(line, 'rax')),
t as (select doc_id, (g - 1)::int as group_no, string_agg(line, chr(10) order by line_no) as t from n where g > 0 and doc_id not in (select doc_id from bad) group by all),
l as (select *, list_filter(list_transform(regexp_extract_all(t, 'from +(\S+)', 1), lambda x: regexp_replace(x, '\?$', '')), lambda x: regexp_matches(x, '\.(?:so|hr)(?:\.[0-9]+d?)*$'))[1] as dylib,
  list_filter(regexp_extract_all(t, 'at +(\S+)', 1), lambda x: regexp_matches(regexp_replace(x, ':.*$', ''), '\.(?:c|tcc|cpp|h|hpp|m|moc|xs|xsi|S|cc)$|(?:ostream|iostream)$'))[1] as f from t),
r as (select doc_id, group_no, dylib, case when dylib is null then f end as f from l)
select doc_id, group_no, dylib, regexp_replace(f, ':.*$', '') as file, try_cast(regexp_extract(f, ':([0-9]+)', 1) as int) as fileline from r where dylib is not null or f is not null"""


def _marks_once(x: str, marks: str) -> str:
    for mark in marks:
        inside = {"\\": "\\\\", "]": "\\]", "[": "\\[", "^": "\\^", "'": "''"}.get(mark, mark)
        put = {"\\": "\\\\", "'": "''"}.get(mark, mark)
        x = f"regexp_replace({x}, '[{inside}]{{2,}}', '{put}', 'g')"
    return x


def _without_times(x: str) -> str:
    x = f"regexp_replace({x}, '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}', '', 'g')"
    return f"regexp_replace({x}, '[0-9]{{1,4}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{2,4}}', '', 'g')"


_ALL_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SQL["text_soft"] = _text(f"regexp_replace({_without_times(_marks_once('text', _ALL_MARKS))}, '([{_PUNCT}])', ' \\1 ', 'g')")
_clean = "text"
for _code in (
    r"(?:(?:public|private)\s*)?class\s+\w+(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?\s+\{(?:\s*\})?",
    r"if\s*\(.*\{",
    r"\w+\s*\([^)]*\)\s*\{",
    r"\w\s*=\snew[^;]+;",
):
    _clean = f"regexp_replace({_clean}, '{_code}', '', 'g')"
_clean = _marks_once(_without_times(_clean), ",:;><!?=_\\/*-.")
_KEPT = f"length(l) >= 10 and len(list_filter(regexp_split_to_array(l, '[\\s\\x0B]'), lambda w: w <> '')) >= 5 and {_odd('l')}::double / greatest(length(l), 1) <= 0.2"
SQL["text_clean"] = f"""with {_DOCS}, c as (select doc_id, string_split({_clean}, chr(10)) as ls from docs)
select doc_id, coalesce(array_to_string(list_transform(list_filter(ls, lambda l: {_KEPT}), lambda l: l || chr(10)), ''), '') as out from c"""

_FRAME_LINE = """translate('#' || depth || ' ' || coalesce(address, '0x0') || ' in ' || coalesce("function", '??') || ' (' || coalesce(args, '') || ')' ||
  case when file is not null then ' at ' || file || coalesce(':' || fileline, '') when dylib is not null then ' from ' || dylib else '' end, chr(13) || chr(10), '  ')"""
_THREADS = f"""
one as (select bug_id, stack_no, depth, min({_FRAME_LINE}) as line from stack_frame where depth >= 0 and depth < 300 group by all),
threads as (select bug_id, stack_no, (row_number() over (partition by bug_id order by stack_no) - 1)::int as thread_no, string_agg(line, chr(10) order by depth) as body from one group by bug_id, stack_no)"""
SQL["parse_threads"] = f"""with {_THREADS}
select bug_id, thread_no, ':' || chr(10) || body || case when thread_no < max(thread_no) over (partition by bug_id) then chr(10) else '' end as body from threads"""
SQL["parse_stacks"] = f"""with {_THREADS}, l as (select bug_id, thread_no, rtrim(line) as line, depth as ord from one join threads using (bug_id, stack_no)),
f as (select bug_id, thread_no, ord, {_frame_columns('line')} from l), g as (select * from f where fn is not null)
select bug_id, (dense_rank() over (partition by bug_id order by thread_no) - 1)::int as stack_no, (row_number() over (partition by bug_id, thread_no order by ord) - 1)::int as place,
  depth, address, case when fn = '??' or regexp_matches(fn, '^0x[0-9a-zA-Z]+ in') then null else fn end as "function", args, {_file_columns()}, dylib from g"""
_PYTHON = r'^\s*File "([^"]*)", line (\d+)(?:, in (.+?))?\s*$'
SQL["parse_python"] = f"""with {_LINES}, f as (select *, (row_number() over (partition by doc_id order by line_no desc) - 1)::int as depth from lines where regexp_matches(line, '{_PYTHON}'))
select doc_id, depth, nullif(regexp_extract(line, '{_PYTHON}', 3), '') as "function", regexp_extract(line, '{_PYTHON}', 1) as file, regexp_extract(line, '{_PYTHON}', 2) as fileline from f"""
SQL["field_names"] = "select distinct delivery_id, bug_id, short_desc from bug_report"


def _traced() -> str:
    from ..functions.parsing import FRAME_FORMS

    framed = " or ".join(f"regexp_matches(rtrim(line), '{p}')" for p, _ in FRAME_FORMS)
    return f"""with {_REPORTS}, {_LINES}, held as (select distinct doc_id from lines where (starts_with(line, '#') and ({framed})) or regexp_matches(line, '{_PYTHON}')),
f as (select bug_id, min((epoch_us(posted_ts), doc_id)) as a from documents where doc_id in (select doc_id from held) and bug_id is not null and posted_ts is not null group by bug_id)
select bug_id, a[2] as doc_id from f join reports using (bug_id) where a[1] - ts <= 600000000"""


SQL["first_traced_attachments"] = _traced()
SQL["split_random_chunks"] = f"""with {_REPORTS}, dups as (select (ts, bug_id) as k, ts, row_number() over (order by ts, bug_id) as place from reports where dup_id is not null),
days as (select (select ts // {_DAY} from dups where place = 20) as lo, max(ts) // {_DAY} - 365 as hi from reports),
every_ as (select unnest(range(lo, hi + 1)) as start_day from days where lo is not null and lo <= hi),
starts as (select (row_number() over (order by md5('7:' || start_day), start_day) - 1)::int as chunk, start_day from every_ qualify row_number() over (order by md5('7:' || start_day), start_day) <= 3),
back as (select chunk, (ts, bug_id) as k, row_number() over (partition by chunk order by ts desc, bug_id desc) as place from starts join reports on dup_id is not null and ts < start_day * {_DAY})
select s.chunk, r.bug_id, case when r.ts >= start_day * {_DAY} then 'test' when (r.ts, r.bug_id) < b.k then 'training' else 'validation' end as part, dup_id is not null as duplicate
from starts s join reports r on r.ts < (start_day + 365) * {_DAY} left join back b on b.chunk = s.chunk and b.place = 20"""
SQL["rank_reuse"] = f"""with {_RANKED}, {_STORED},
ord as (select bug_id as query_id, row_number() over (order by min((chunk_id, query_ord)), bug_id) - 1 as number, count(*) over () as n from query_report where bug_id is not null group by bug_id),
early as (select query_id from ord where number < n // 2)
select query_id, cand_id, score, rec_rank::int as rec_rank from listed_ where rec_rank <= 5 and query_id in (select query_id from early)
union all select query_id, cand_id, score, rec_rank from ranked where rec_rank <= 5 and query_id not in (select query_id from early)"""
_LONG = r"(?m)^#([0-9]+) +(?:([a-zA-Z0-9]+) +in +)?(?:(.+?) *[(].*?|(<sig\w+? handler [\w ]+?>)|([\w:<*,> \[\]-]+))(?: +(?:at|from) +(\S+)|$)"
SQL["parse_long"] = rf"""with {_DOCS}, j as (select doc_id, regexp_replace(regexp_replace(translate(text, chr(9), ' '), '\r\n?', chr(10), 'g'), '\n +', ' ', 'g') as t from docs),
g as (select doc_id, regexp_extract_all(t, '{_LONG}', 1) as n, regexp_extract_all(t, '{_LONG}', 3) as a, regexp_extract_all(t, '{_LONG}', 4) as b, regexp_extract_all(t, '{_LONG}', 5) as c, regexp_extract_all(t, '{_LONG}', 6) as f from j),
r as (select doc_id, i, try_cast(n[i] as bigint) as number, trim(case when a[i] <> '' then a[i] when b[i] <> '' then b[i] else c[i] end) as fn, nullif(f[i], '') as file from g, unnest(range(1, len(n) + 1)) as u(i)),
k as (select *, coalesce(bool_or(number = 0 and i > 1) over (partition by doc_id order by i), false) as again from r),
named as (select doc_id, number, fn, file from k where not again),
top as (select doc_id, max(number) as m from named group by doc_id)
select doc_id, number, fn as "function", file from named
union all select doc_id, t.x, null, null from top, unnest(range(0, case when m <= 10000000 then m else 0 end)) as t(x) where m <= 10000000 and not exists (select 1 from named where named.doc_id = top.doc_id and named.number = t.x)
union all select doc_id, null, null, null from top where m > 10000000"""
_FIELD = r"^([A-Z][\w.]*): "
SQL["parse_fields"] = rf"""with {_LINES}, n as (select *, sum(regexp_matches(line, '{_FIELD}')::int) over (partition by doc_id order by line_no) as g from lines),
v as (select doc_id, g, lower(regexp_extract(arg_min(line, line_no), '{_FIELD}', 1)) as field_name, regexp_replace(string_agg(line, chr(10) order by line_no), '{_FIELD}', '') as raw from n where g > 0 group by doc_id, g)
select doc_id, field_name, arg_max(regexp_replace(raw, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), g) as value from v group by doc_id, field_name"""


# Whole evaluations: frequencies as they stood at each query, trimmed stacks, the best cell of each pair.

_EVAL_STACKS = f"""{_stacks()},
plain as (select bug_id, stack_no, list_transform(list_filter(range(1, len(tokens) + 1), lambda i: i = 1 or tokens[i] = '??' || bug_id or tokens[i] <> tokens[i - 1]), lambda i: tokens[i]) as tokens from stacks),
placed as (select bug_id, stack_no, generate_subscripts(tokens, 1) as place, unnest(tokens) as token from plain)"""
_EVAL_CANDS = f"{_REPORTS}, {_ASKED}, {_EVALUATED}, {_window('evaluated')}"
_AT_QUERIES = f"""{_EVAL_CANDS}, {_EVAL_STACKS},
num as (select bug_id, row_number() over (order by p, ts, bug_id) - 1 as number from (select bug_id, min((chunk_id, query_ord)) as p from query_report where bug_id is not null group by bug_id) join reports using (bug_id)),
base as (select bug_id from reports where (ts, bug_id) <= (select max((ts, bug_id)) from reports where bug_id in (select bug_id from num)) and bug_id not in (select bug_id from num)),
held as (select distinct bug_id, token from placed),
bdf as (select token, count(*) as n from held where bug_id in (select bug_id from base) group by token),
events as (select token, list(number order by number) as nums from held join num using (bug_id) group by token),
asked_pairs as (select number, query_id, cand_id from cands join num on num.bug_id = query_id),
wanted as (select number, query_id as bug_id from asked_pairs union select number, cand_id from asked_pairs),
freq as (select number, bug_id, stack_no, place, token, (coalesce(n, 0) + coalesce(len(list_filter(nums, lambda k: k <= number)), 0))::double / ((select count(*) from base) + number + 1) * 100 as pct
  from wanted join placed using (bug_id) left join bdf using (token) left join events using (token)),
sides as (select number, bug_id, stack_no, list(token order by place) as tk, list(pct order by place) as d, list(pct <= 20.0 order by place) as ok from freq group by all),
cut as (select number, bug_id, stack_no, tk[list_position(ok, true) : len(ok) - list_position(list_reverse(ok), true) + 1] as tk, d[list_position(ok, true) : len(ok) - list_position(list_reverse(ok), true) + 1] as d
  from sides where list_contains(ok, true)),
cells as (select row_number() over () as id, query_id, cand_id, a.tk as q, b.tk as c, a.d as dq, b.d as dc from asked_pairs join cut a on a.number = asked_pairs.number and a.bug_id = query_id
  join cut b on b.number = asked_pairs.number and b.bug_id = cand_id)"""
_FIGURES = """
known as (select query_id, cand_id, score, q.bucket as qb, c.bucket as cb from scored join reports q on q.bug_id = query_id join reports c on c.bug_id = cand_id where q.bucket <> query_id),
buckets as (select query_id, qb, cb, max((score, cand_id)) as k from known group by all),
hit as (select query_id, k from buckets where qb = cb),
positions as (select query_id, case when any_value(hit.k) is not null then count(*) filter (buckets.k >= hit.k) end as position from buckets left join hit using (query_id) group by query_id)
select count(*) as queries, round(avg(coalesce(1.0 / position, 0)), 6) as mrr, round(avg(coalesce((position <= 1)::int::double, 0)), 6) as recall_1, round(avg(coalesce((position <= 10)::int::double, 0)), 6) as recall_10 from positions"""


def _eval(programmes: list[str], score: str, joins: str, source: str = "cells") -> str:
    return f"""with recursive {_AT_QUERIES}, {', '.join(programmes)},
best as (select query_id, cand_id, max({score}) as s from {source} t {joins} group by all),
scored as (select query_id, cand_id, coalesce(s, -9999999.99) as score from cands left join best using (query_id, cand_id)), {_FIGURES}"""


def _weights(d: str) -> str:
    return f"list_transform(range(0, len({d})), lambda k: ((1 / (k + 1) ** 0.5) * exp(-0.1 * {d}[k + 1]))::double)"


SQL["eval_weighted"] = _eval(
    [
        f"weights as (select *, {_weights('dq')} as qw, {_weights('dc')} as cw from cells)",
        _programme("real", "weights", "list_reduce(t.cw, lambda acc, w: list_append(acc, acc[len(acc)] - w), [0.0]::double[])", "p.row[1] - t.qw[p.i + 1]",
                   "greatest($up - t.qw[p.i + 1], $lf - t.cw[j], $dg + case when $eq then greatest(t.qw[p.i + 1], t.cw[j]) * exp(-0.3 * abs($i - $j)) else -(t.qw[p.i + 1] + t.cw[j]) end)"),
        """flat as (select id, unnest(q) as token, unnest(qw) as a, 0.0::double as b from weights union all select id, unnest(c), 0.0, unnest(cw) from weights),
mass as (select id, sum(m) as mass from (select id, token, greatest(sum(a), sum(b)) as m from flat group by id, token) group by id)""",
    ],
    "case when mass = 0 then 0 else real.v / mass end", "join real using (id) join mass using (id)", "weights",
)
SQL["eval_linear"] = _eval(
    [_programme("real", "cells", _linear_row("-0.5"), "-0.5 * ($i + 1)", "greatest($up - 0.5, $lf - 0.5, $dg + case when $eq then (1 - t.dq[p.i + 1] / 100) * (1 - p.i::double / len(t.q)) * exp(-abs($i - $j) / 2.0) else 0 end)")],
    "real.v", "join real using (id)",
)
SQL["eval_alignment"] = _eval(
    [
        _programme("real", "cells", _linear_row("-1.0"), "-1.0 * ($i + 1)", "greatest($up - 1, $lf - 1, $dg + case when $eq then 1 else -1 end)"),
        _programme("low", "cells", _linear_row("-1.0"), "-1.0 * ($i + 1)", "greatest($up - 1, $lf - 1, $dg - 1)"),
    ],
    "case when least(len(t.q), len(t.c)) = low.v then 0 else (real.v - low.v) / (least(len(t.q), len(t.c)) - low.v) end", "join real using (id) join low using (id)",
)
_SWAP = "case when $i > 0 and j > 1 and t.q[p.i + 1] = t.c[j - 1] and t.q[p.i] = t.c[j] and t.q[p.i + 1] <> t.c[j] then $cross + 1 else 1e300 end"
SQL["eval_edit"] = _eval(
    [
        _programme("real", "cells", _linear_row("1"), "$i + 1", f"least($up + 1, $lf + 1, $dg + case when $eq then 0 else 1 end, {_SWAP})"),
        _programme("worst", "cells", _linear_row("1"), "$i + 1", "least($up + 1, $lf + 1, $dg + 1)"),
    ],
    "case when worst.v = 0 then 0 else 1 - real.v / worst.v end", "join real using (id) join worst using (id)",
)
_POSITIONAL = "real.v / list_sum(list_transform(range(0, least(len(t.q), len(t.c))), lambda k: exp(-0.1 * k)))"
SQL["eval_positional"] = _eval([_PDM], _POSITIONAL, "join real using (id)")
SQL["eval_bag"] = f"""with {_EVAL_CANDS}, {_stacks()}, g as (
  select bug_id, token as term from tok
  union all select a.bug_id, a.token || chr(10) || b.token from tok a join tok b on a.bug_id = b.bug_id and a.stack_no = b.stack_no and b.depth = a.depth + 1),
bag as (select bug_id, term, count(*) as freq from g group by all),
idf as (select term, (select count(distinct bug_id) from tok)::double / (count(*) + 1e-11) as idf from bag group by term),
size as (select bug_id, sum(freq) as size from bag group by bug_id),
w as (select bug_id, term, freq / size * idf as w from bag join size using (bug_id) join idf using (term)),
norm as (select bug_id, sqrt(sum(w * w)) as n from w group by bug_id),
dot as (select query_id, cand_id, sum(a.w * b.w) as dot from cands join w a on a.bug_id = query_id join w b on b.bug_id = cand_id and a.term = b.term group by all),
scored as (select query_id, cand_id, case when a.n is null or b.n is null then -9999999.99 else coalesce(dot / (a.n * b.n), 0) end as score
  from cands left join dot using (query_id, cand_id) left join norm a on a.bug_id = query_id left join norm b on b.bug_id = cand_id), {_FIGURES}"""
SQL["eval_two_stage"] = f"""with recursive {_EVAL_CANDS}, {_stacks()},
stored as (select query_id, cand_id, max(score) as text from recommendation where score is not null and query_id is not null group by all),
first_stage as (select * from (select *, row_number() over (partition by query_id order by text desc, cand_id desc) as r from stored join cands using (query_id, cand_id)) where r <= 500),
cells as (select row_number() over () as id, query_id, cand_id, a.tokens as q, b.tokens as c from first_stage join stacks a on a.bug_id = query_id join stacks b on b.bug_id = cand_id), {_PDM},
exact as (select query_id, cand_id, max({_POSITIONAL}) as s from cells t join real using (id) group by all),
blended as (select query_id, cand_id, text as t, coalesce(s, -9999999.99) as s from first_stage left join exact using (query_id, cand_id)),
scored as (select query_id, cand_id, case when s is null then -999999999.99 when 0.4 * s + 0.6 * t = 0 then 0 else t * s / (0.4 * s + 0.6 * t) end as score from cands left join blended using (query_id, cand_id)), {_FIGURES}"""

# RE2 has no look-ahead, so a line feed parts capitals from the word that the last of them begins; and no back-references, so each mark's run is its own alternative.
_RUNS = "|".join(f"[{chr(92) if m in '[]^' + chr(92) else ''}{m}]+".replace("'", "''") for m in _ALL_MARKS)
_LOW = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
SQL["text_camel"] = _text(rf"regexp_extract_all(regexp_replace(text, '(\p{{Lu}})(\p{{Lu}}{_LOW})', '\1' || chr(10) || '\2', 'g'), '\p{{N}}+|\p{{Lu}}?{_LOW}+|\p{{Lu}}+|{_RUNS}|[^\p{{L}}\p{{N}}\s\x0B]')")
_W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
_SP = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PARTED = r"regexp_replace(regexp_replace(text, '(?i)\b(\w+)(n''t)\b', '\1 \2', 'g'), '(?i)(\w)(''(?:s|m|d|ll|re|ve))\b', '\1 \2', 'g')"
SQL["text_words"] = _text(rf"regexp_extract_all({_PARTED}, 'n''t|''(?:s|m|d|ll|re|ve)\b|\p{{Nd}}+(?:[.,:]\p{{Nd}}+)*|[{_W}]+(?:-[{_W}]+)*|\.\.\.|--|[^{_W}{_SP}]')")
