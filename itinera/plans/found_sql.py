"""The same results as ``found`` in SQL where SQL can state them."""

_CODES = """
with codes as (
  select distinct upper(regexp_replace(iata_code, '[^\\p{L}\\p{N}]', '', 'g')) as code from airports where regexp_matches(iata_code, '[^\\s\\p{Z}]')),
refs as (
  select id, 'departure_airport' as field, departure_airport as raw, date from flights
  union all select id, 'arrival_airport', arrival_airport, date from flights),
orphans as (
  select id, field, date from refs
  where regexp_matches(raw, '[^\\s\\p{Z}]') and upper(regexp_replace(raw, '[^\\p{L}\\p{N}]', '', 'g')) not in (select code from codes where code <> ''))
"""
_POINTS = """
with pts as (
  select cast(id as bigint) as id, latitude_deg as la, radians(latitude_deg) as p, radians(longitude_deg) as l from airports
  where latitude_deg between -90 and 90 and longitude_deg between -180 and 180 and not (latitude_deg = 0 and longitude_deg = 0))
select a.id as id_a, b.id as id_b from pts a join pts b
  on a.id < b.id and floor(a.la * 10) - floor(b.la * 10) between -1 and 1
  and 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((b.p - a.p) / 2), 2) + cos(a.p) * cos(b.p) * pow(sin((b.l - a.l) / 2), 2)))) <= 5.0
"""
_STOPS = """
with src as (
  select id, 'legs_with_countries' as list_name, legs_with_countries as t from train_routes union all select id, 'legs_filtered', legs_filtered from train_routes),
v as (select id, list_name, case when json_valid(t) then cast(t as json) end as j from src),
u as (select id, list_name, case when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then cast(j ->> '$' as json) end else j end as j from v),
l as (select id, list_name, case json_type(j) when 'ARRAY' then j when 'OBJECT' then json_extract(j, '$.legs') end as j from u),
e as (select id, list_name, j, unnest(range(1, cast(json_array_length(j) as bigint) + 1)) as stop_no from l where json_type(j) = 'ARRAY'),
s as (select id, list_name, stop_no, json_extract(j, '$[' || (stop_no - 1) || ']') as s from e),
h as (select id, list_name, stop_no, case when json_type(s) = 'ARRAY' then json_extract(s, '$[0]') else s end as h from s),
n as (select id, list_name, stop_no, case json_type(h) when 'OBJECT' then case when json_type(h, '$.station') = 'VARCHAR' then h ->> '$.station' when json_type(h, '$.name') = 'VARCHAR' then h ->> '$.name' end
    when 'ARRAY' then case when json_type(h, '$[0]') = 'VARCHAR' then h ->> '$[0]' end when 'VARCHAR' then h ->> '$' end as station from h)
"""
_CASCADE = """
with stated as (select id, iso_country, upper(regexp_replace(iata_code, '[^\\p{L}\\p{N}]', '', 'g')) as code from airports),
far as (select id, iso_country as ref from airports where regexp_matches(iso_country, '[^\\s\\p{Z}]') and upper(regexp_replace(iso_country, '[^\\p{L}\\p{N}]', '', 'g')) not in (select iso_country from country_zones)),
codes as (select code, bool_and(id in (select id from far)) as gone from stated where code <> '' group by code),
refs as (select id, date, unnest(['departure_airport', 'arrival_airport']) as field, unnest([departure_airport, arrival_airport]) as raw from flights),
keyed as (select id, date, field, upper(regexp_replace(raw, '[^\\p{L}\\p{N}]', '', 'g')) as ref from refs where regexp_matches(raw, '[^\\s\\p{Z}]')),
orphans as (
  select 'flights' as table_name, id, date, field, ref, case when code is null then 'direct' else 'inherited' end as kind from keyed left join codes on code = ref where code is null or gone
  union all select 'airports', id, null, 'iso_country', upper(regexp_replace(ref, '[^\\p{L}\\p{N}]', '', 'g')), 'direct' from far)
"""
_PARTS = """
, o as (select id, list_name, stop_no, s, json_type(s) as kind, json_type(s, '$[0]') as k0, json_type(s, '$[1]') as k1 from s),
parts as (
  select o.id, o.list_name, o.stop_no, n.station,
    case when kind = 'OBJECT' then s ->> '$.country' when k0 = 'ARRAY' then s ->> '$[0][1]' when k0 = 'OBJECT' then s ->> '$[0].country' end as country,
    case when kind = 'OBJECT' then s ->> '$.arr' when k1 = 'ARRAY' then s ->> '$[1][0]' when k1 = 'OBJECT' then s ->> '$[1].arr' when k0 = 'OBJECT' then s ->> '$[0].arr' end as arr,
    case when kind = 'OBJECT' then s ->> '$.dep' when k1 = 'ARRAY' then s ->> '$[1][1]' when k1 = 'OBJECT' then s ->> '$[1].dep' when k0 = 'OBJECT' then s ->> '$[0].dep' end as dep
  from o join n using (id, list_name, stop_no))
"""
_TREE = """
with recursive src as (
  select id, 'legs_with_countries' as list_name, legs_with_countries as t from train_routes union all select id, 'legs_filtered', legs_filtered from train_routes),
v as (select id, list_name, case when json_valid(t) then cast(t as json) end as j from src),
u as (select id, list_name, case when json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then cast(j ->> '$' as json) end else j end as j from v),
tree as (
  select list_name, j, json_type(j) as t, 0 as depth from u where j is not null
  union all select list_name, j, json_type(j), depth from (
    select list_name, unnest(case t when 'ARRAY' then json_extract(j, '$[*]') when 'OBJECT' then json_extract(j, '$.*') else [] end) as j, depth + 1 as depth from tree) x),
kinds as (select list_name, depth, case t when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind from tree)
"""
SQL = {
    "p1_stops": _STOPS + _PARTS + "select id as route_id, list_name, cast(stop_no as int) as stop_no, station, country, arr, dep from parts",
    "p1_adjacency": _TREE + "select list_name, kind, depth, count(*) as nodes, count(*) filter (kind in ('string', 'number', 'boolean')) as scalars from kinds group by all",
    "p1_found": _STOPS + "select id as route_id, list_name, stop_no, station from n where regexp_matches(station, '[^\\s\\p{Z}]')",
    "p3_cascade": _CASCADE + "select table_name, field, kind, count(*) as orphans, count(distinct ref) as refs from orphans group by all",
    "p3_report": _CASCADE + "select table_name, field, kind, date as period, count(*) as orphans from orphans where table_name = 'flights' group by all",
    "p3_found": _CODES + "select id, field from orphans",
    "p5_found": _POINTS,
}
