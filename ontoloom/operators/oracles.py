"""DuckDB SQL that gives the rows of the pN_ queries of the general operators."""

_NAME = r"""case when trim({c}, E' \t\n\r') = '' then null
 when starts_with(trim({c}, E' \t\n\r'), '#') then substr(trim({c}, E' \t\n\r'), 2)
 when starts_with(trim({c}, E' \t\n\r'), 'mon:') then substr(trim({c}, E' \t\n\r'), 5)
 when starts_with(trim({c}, E' \t\n\r'), 'http://monitor.example.org/#') then substr(trim({c}, E' \t\n\r'), 29)
 else trim({c}, E' \t\n\r') end"""


def _name(c: str) -> str:
    return _NAME.format(c=c)


_USABLE = "time_stamp >= 1546300800 and time_stamp < 1577836800 and volt is not null and not isnan(volt) and volt <> -1 and meter is not null"

_LINKS = f"""eq as (select distinct {_name('equipment_id')} as node, {_name('part_of')} as parent from equipment e
  where coalesce(time_stamp, -9223372036854775808) = (select max(coalesce(time_stamp, -9223372036854775808)) from equipment f where f.equipment_id = e.equipment_id)),
 up as (select 'part_of' as tree, node, parent from eq where node is not null and parent is not null
  union select distinct 'sub_class_of', {_name('class_id')}, {_name('sub_class_of')} from rdf_class where {_name('class_id')} is not null and {_name('sub_class_of')} is not null),
 closure as (select tree, node, parent as above from up union select c.tree, c.node, u.parent from closure c join up u on u.tree = c.tree and u.node = c.above)"""

_ORPHANS = f"""missing as (select l.*, 'resources' as parent_table from (select *, {_name('resource_ref')} as k from links) l
  where k is not null and load_closed_at is not null and not exists (select 1 from (select {_name('resource_id')} as k, declared_at, deleted_at from resources) r
   where r.k = l.k and r.declared_at <= l.load_closed_at and (r.deleted_at is null or r.deleted_at > l.load_closed_at)))"""

_STRIPPED = r"regexp_replace(v, '^\s+|\s+$', '', 'g')"
_CELLS = rf"""st as (select {_name('subject')} as subject, {_name('p')} as p, {_STRIPPED} as v from statements),
 ps as (select distinct p, range_type, multi_valued from prop_schema),
 rd as (select st.subject, st.p, multi_valued, case range_type
   when 'int' then case when regexp_full_match(v, '[+-]?[0-9]+') then cast(try_cast(v as integer) as varchar) end
   when 'long' then case when regexp_full_match(v, '[+-]?[0-9]+') then cast(try_cast(v as bigint) as varchar) end
   when 'double' then case when regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then cast(try_cast(v as double) + 0.0 as varchar) end
   when 'boolean' then case when v in ('true', '1') then 'true' when v in ('false', '0') then 'false' end
   when 'dateTime' then case when regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') then cast(epoch_us(try_cast(v || case when regexp_matches(v, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then '' else 'Z' end as timestamptz)) as varchar) end
   else v end as c
  from st join ps on ps.p = st.p where st.subject is not null and v <> '')"""

_READINGS = """r as (select distinct meter, time_stamp as t, case when volt is null or isnan(volt) or volt = -1 then null else volt::double end as v, uptime as u
   from logger where meter is not null and time_stamp >= 1546300800 and time_stamp < 1577836800),
 fv as (select meter, t, v, u, count(*) over (partition by meter, g) as n from (select *, sum(c) over (partition by meter order by t, v, u) as g from
   (select *, case when v is distinct from lag(v) over (partition by meter order by t, v, u) then 1 else 0 end as c from r where v is not null))),
 fu as (select meter, t, v, u, count(*) over (partition by meter, g) as n from (select *, sum(c) over (partition by meter order by t, v, u) as g from
   (select *, case when u is distinct from lag(u) over (partition by meter order by t, v, u) then 1 else 0 end as c from r where u is not null))),
 ok as (select *, row_number() over (partition by meter order by t, v, u) as i from r where v >= 0 and v <= 60),
 lim as (select meter, greatest(0.5, 8 * median(d)) as l from (select meter, abs(v - lag(v) over (partition by meter order by i)) as d from ok) group by meter),
 lv as (select *, median(v) over (partition by meter order by t range between 3600 preceding and 1 preceding) as lo,
   median(v) over (partition by meter order by t range between 1 following and 3600 following) as hi from ok),
 runs as (select a.meter, a.i, b.i as j from lv a join lv b on b.meter = a.meter and b.i between a.i and a.i + 2 join ok m on m.meter = a.meter and m.i between a.i and b.i join lim on lim.meter = a.meter
   where a.lo is not null and b.hi is not null group by a.meter, a.i, b.i, a.lo, b.hi, l having min(m.v) > greatest(a.lo, b.hi) + l or max(m.v) < least(a.lo, b.hi) - l),
 z as (select meter, t, v, u, u - t as z, row_number() over (partition by meter order by t, v, u) as i from fu where n < 12 and u >= 0 and u <= 315360000),
 st as (select meter, i, z as sound, false as flag from z where i = 1
   union all select z.meter, z.i, case when z.z > st.sound + 3600 then st.sound else z.z end, z.z > st.sound + 3600 from st join z on z.meter = st.meter and z.i = st.i + 1),
 bad as (select meter, t, v, u, 'frozen' as why from fv where n >= 12 union select meter, t, v, u, 'frozen' from fu where n >= 12
   union select meter, t, v, u, 'impossible' from r where v < 0 or v > 60 or u < 0 or u > 315360000
   union select ok.meter, ok.t, ok.v, ok.u, 'spike' from ok join runs on runs.meter = ok.meter and ok.i between runs.i and runs.j
   union select z.meter, z.t, z.v, z.u, 'uptime' from z join st on st.meter = z.meter and st.i = z.i where st.flag)"""

_SAME = """b.meter = g.meter and b.t = g.time_stamp and b.v is not distinct from case when volt is null or isnan(volt) or volt = -1 then null else volt::double end
  and b.u is not distinct from g.uptime"""

#: The properties of the schema by range; those with many values are named in ``_MANY``.
_RANGES = {
    "double": ("alt", "gain", "lat", "long", "temperature"),
    "string": ("email", "first_name", "ip_add", "last_name", "mac", "report", "site_name"),
    "timestamp": ("installed", "time_stamp_v"),
    "bigint": ("number", "phone", "reserved_data", "uptime", "used_data"),
    "boolean": ("on", "retired", "unlocked"),
    "integer": ("power", "status", "voltage"),
}
_MANY = ("phone", "report")


def _column(p: str, kind: str) -> str:
    if p in _MANY:
        return f"array_to_string(any_value(vs) filter (p = '{p}'), '|') as \"{p}\""
    one = f"max(v) filter (p = '{p}')"
    return (f"make_timestamp({one}::bigint)" if kind == "timestamp" else f"{one}::{kind}") + f' as "{p}"'


_EDGE = """case when {d1} is null then {d0} when sign(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})) <> sign({d0}) then 0.0
  when sign({d0}) <> sign({d1}) and abs(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})) > 3 * abs({d0}) then 3 * {d0} else ((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}) end"""
_INNER = "case when {d0} * {d1} <= 0 then 0.0 else ((2 * {h1} + {h0}) + ({h1} + 2 * {h0})) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) end"


def _edge(h0: str, h1: str, d0: str, d1: str) -> str:
    return _EDGE.format(h0=h0, h1=h1, d0=d0, d1=d1)


def _inner(h0: str, h1: str, d0: str, d1: str) -> str:
    return _INNER.format(h0=h0, h1=h1, d0=d0, d1=d1)


_GRID = f"""with u as (select meter, time_stamp as t, avg(volt::double) as v, count(*) as n from logger where {_USABLE} group by 1, 2),
 w as (select *, t - lag(t) over p as g0, v - lag(v) over p as e0, lead(t) over p - t as h1, lead(v) over p as v2, lead(t, 2) over p - lead(t) over p as g2, lead(v, 2) over p - lead(v) over p as e2
   from u window p as (partition by meter order by t)),
 d as (select *, t // 600 + 1 as a, (t + h1) // 600 - 1 as b, case when g0 <= 7200 then g0 end as h0, case when g2 <= 7200 then g2 end as h2, case when g0 <= 7200 then e0 / g0 end as d0, (v2 - v) / h1 as d1, case when g2 <= 7200 then e2 / g2 end as d2 from w where h1 is not null),
 m as (select *, case when h0 is null then {_edge('h1', 'h2', 'd1', 'd2')} else {_inner('h0', 'h1', 'd0', 'd1')} end as m1,
   case when h2 is null then {_edge('h1', 'h0', 'd1', 'd0')} else {_inner('h1', 'h2', 'd1', 'd2')} end as m2 from d where a <= b),
 k as (select *, unnest(range(a, b + 1)) as k from m),
 x as (select *, (k * 600 + 300 - t) / h1 as x from k)
 select meter, k * 600 as period_start, case when h1 <= 7200 then round(v * (1 + 2 * x) * (1 - x) * (1 - x) + h1 * m1 * x * (1 - x) * (1 - x) + v2 * x * x * (3 - 2 * x) + h1 * m2 * x * x * (x - 1), 4) end as value,
  0::bigint as n_readings, case when h1 <= 7200 then 'interpolated' else 'gap' end as status from x
 union all select meter, t // 600 * 600, round(avg(v), 4), sum(n)::bigint, 'observed' from u group by 1, 2"""

ORACLES = {
    "p1_grid": _GRID,
    "p4_found": f"with recursive {_READINGS} select logger_id from logger g where exists (select 1 from bad b where {_SAME})",
    "p4_reasons": f"""with recursive {_READINGS} select logger_id, g.meter, time_stamp, volt, uptime,
  concat_ws(' ', max(why) filter (why = 'impossible'), max(why) filter (why = 'frozen'), max(why) filter (why = 'spike'), max(why) filter (why = 'uptime')) as reasons
  from logger g join bad b on {_SAME} group by all""",
    "p2_nodes": f"""with recursive {_LINKS}, nodes as (select tree, node from up union select tree, parent from up union select 'part_of', node from eq where node is not null
   union select 'sub_class_of', {_name('class_id')} from rdf_class where {_name('class_id')} is not null),
 first as (select tree, node, min(parent) as parent from up group by all),
 walk as (select tree, node, node as top, [node] as path from nodes
   union all select w.tree, w.node, f.parent, list_prepend(f.parent, w.path) from walk w join first f on f.tree = w.tree and f.node = w.top where not list_contains(w.path, f.parent)),
 longest as (select tree, node, max_by(top, len(path)) as top, max_by(path, len(path)) as path from walk group by all),
 n as (select tree, node, count(distinct above) as n from closure group by all)
 select l.tree, l.node as node_id, array_to_string(l.path, '/') as path, len(l.path) - 1 as depth, case when f.node is null then l.top end as root, coalesce(n.n, 0) as n_ancestors
 from longest l left join first f on f.tree = l.tree and f.node = l.top left join n on n.tree = l.tree and n.node = l.node""",
    "p1_found": f"""with k as (select distinct meter, time_stamp // 600 as k from logger where {_USABLE}),
 span as (select meter, min(k) as a, max(k) as b from k group by meter),
 every as (select meter, unnest(range(a, b + 1)) as k from span)
 select e.meter, e.k * 600 as period_start from every e anti join k on k.meter = e.meter and k.k = e.k""",
    "p2_found": f"with recursive {_LINKS} select distinct tree, node as node_id from closure where node = above",
    "p2_descendants": f"with recursive {_LINKS} select distinct tree, above as node_id, node as descendant from closure",
    "p3_found": f"with {_ORPHANS} select link_id from missing",
    "p3_report": f"""with {_ORPHANS} select parent_table, subject_type, strftime(load_closed_at, '%Y-%m') as month, count(*) as missing, count(distinct k) as missing_keys
 from missing group by all""",
    "p5_found": f"with {_CELLS} select subject, p from rd where not multi_valued group by subject, p having count(distinct c) <> 1",
    "p5_wide": f"""with {_CELLS},
 one as (select subject, p, multi_valued, case when count(distinct c) = 1 then min(c) end as v, list_sort(coalesce(list(distinct c) filter (c is not null), [])) as vs from rd group by all)
 select subject, {", ".join(_column(p, kind) for kind, ps in _RANGES.items() for p in ps)}, coalesce(string_agg(p, ' ' order by p) filter (not multi_valued and v is null), '') as conflicts
 from one group by subject""",
}
