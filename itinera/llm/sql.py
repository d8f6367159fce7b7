"""The same results in SQL, for the driver's comparison."""

_ROUTES = """
with scored as (
  select start_node, route_id, rqi_score from master_elite_routes_full
  where regexp_matches(start_node, '[^\\s\\p{Z}]') and rqi_score is not null and not isnan(rqi_score) and rqi_score <> -999.0),
ranked as (select *, row_number() over (partition by start_node order by rqi_score desc, route_id) as place from scored)
"""
_FORMS = """
with forms as (
  select id, upper(regexp_replace(flight_number, '[^\\p{L}]', '', 'g')) || '|' || regexp_replace(flight_number, '[^\\p{N}]', '', 'g') as a,
    upper(regexp_replace(departure_airport, '[^\\p{L}\\p{N}]', '', 'g')) as b, upper(regexp_replace(departure_scheduled, '[^\\p{L}\\p{N}]', '', 'g')) as c,
    upper(regexp_replace(arrival_airport, '[^\\p{L}\\p{N}]', '', 'g')) as d
  from flights)
"""
SQL = {
    "p2_found": _ROUTES + "select start_node, cast(place as int) as place, route_id from ranked where place <= 5",
    "p7_found": _FORMS + ", firsts as (select id, min(id) over (partition by a, b, c, d) as id_a from forms) select id_a, id as id_b from firsts where id <> id_a",
    "p7_copies": _FORMS + "select min(id) as first_id, count(*) as copies from forms group by a, b, c, d",
}
