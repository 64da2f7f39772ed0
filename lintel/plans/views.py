"""The domain views of ``lintel.sources.binding`` as SQL, for the twins of the queries."""

from __future__ import annotations

#: In order: a view may read the ones before it.
VIEWS = {
    "sale": """
SELECT o_orderkey AS sale_id, o_custkey AS property_id, CAST(o_orderdate AS DATE) AS sale_date,
  CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, o_orderstatus = 'P' AS not_full_market, o_orderpriority = '1-URGENT' AS is_new,
  o_orderpriority = '5-LOW' AS vat_exclusive, CASE WHEN o_orderkey % 53 = 11 THEN o_orderkey // 53 END AS bulk_group_id,
  o_orderkey % 101 = 13 AS possible_duplicate, o_orderkey % 89 = 7 AS withdrawn FROM orders""",
    "property": """
SELECT c_custkey AS property_id, CAST(1 + n_regionkey AS BIGINT) AS county_id, CAST(100 + n_nationkey AS BIGINT) AS settlement_id, lower(r_name) AS county,
  CASE WHEN (c_custkey * 7) % 6 <= 1 THEN CAST(1000 + n_nationkey * 8 + c_custkey * 5 % 8 AS BIGINT) END AS ed_id,
  CASE WHEN (c_custkey * 7) % 6 <= 1 THEN CAST(10000 + (n_nationkey * 8 + c_custkey * 5 % 8) * 4 + c_custkey % 4 AS BIGINT) END AS small_area_id,
  CASE WHEN (c_custkey * 7) % 6 <= 1 AND c_custkey % 5 <> 0 THEN CAST(100000 + n_nationkey * 16 + c_custkey * 3 % 16 AS BIGINT) END AS townland_id,
  CAST((c_custkey * 7) % 6 AS INTEGER) AS precision,
  CAST((c_custkey * 7919) % 40000 AS DOUBLE) / 10000 - 10 AS lon, CAST((c_custkey * 104729) % 38000 AS DOUBLE) / 10000 + 51.5 AS lat,
  c_custkey % 83 = 5 AS suppressed,
  substr('ACDEFHKNPR', CAST(c_custkey % 10 + 1 AS INTEGER), 1) || lpad(CAST(c_custkey % 23 + 1 AS VARCHAR), 2, '0') AS routing_key,
  CASE WHEN c_custkey % 9 = 4 THEN 'Apt ' || CAST(c_custkey % 7 + 1 AS VARCHAR) || ', ' ELSE '' END || CAST(c_custkey % 60 + 1 AS VARCHAR) || ' '
    || CASE (c_custkey * 13) % 7 WHEN 0 THEN 'Main St' WHEN 1 THEN 'Church Rd.' WHEN 2 THEN 'Mill  Ave' WHEN 3 THEN 'Abbey Tce' WHEN 4 THEN 'St. Brígid''s Pk' WHEN 5 THEN 'Bridge St Lower' ELSE 'Tullow Rd' END
    || ', ' || n_name || ', Co. ' || r_name AS address
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "area": """
SELECT CAST(0 AS BIGINT) AS area_id, 'country' AS kind, 'country' AS name, CAST(NULL AS BIGINT) AS parent_id
UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), 'county', lower(r_name), 0 FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 'settlement', lower(n_name), 1 + n_regionkey FROM nation""",
    "all_area": """
SELECT * FROM area
UNION ALL SELECT CAST(1000 + n_nationkey * 8 + i AS BIGINT), 'electoral_division', 'division ' || CAST(n_nationkey * 8 + i AS VARCHAR), CAST(1 + n_regionkey AS BIGINT) FROM nation, range(8) r(i)
UNION ALL SELECT CAST(10000 + n_nationkey * 32 + i AS BIGINT), 'small_area', 'small area ' || CAST(n_nationkey * 32 + i AS VARCHAR), CAST(1000 + (n_nationkey * 32 + i) // 4 AS BIGINT) FROM nation, range(32) r(i)
UNION ALL SELECT CAST(100000 + n_nationkey * 16 + i AS BIGINT), 'townland', 'townland ' || CAST(n_nationkey * 16 + i AS VARCHAR), CAST(1 + n_regionkey AS BIGINT) FROM nation, range(16) r(i)""",
    "market": "SELECT * FROM sale WHERE NOT withdrawn AND NOT not_full_market AND bulk_group_id IS NULL AND NOT possible_duplicate",
    "plain": "SELECT * FROM market WHERE NOT vat_exclusive",
    "poi": """
SELECT s_suppkey AS poi_id, CASE s_suppkey % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'rail' WHEN 2 THEN 'primary' ELSE 'post_primary' END AS kind,
  CAST((s_suppkey * 3571) % 40000 AS DOUBLE) / 10000 - 10 AS lon, CAST((s_suppkey * 7121) % 38000 AS DOUBLE) / 10000 + 51.5 AS lat FROM supplier""",
    "sale_area": """
SELECT m.*, a.area_id, a.detail, g.segment FROM market m JOIN property p USING (property_id)
CROSS JOIN LATERAL (VALUES (CAST(0 AS BIGINT), true), (p.county_id, true), (p.settlement_id, true), (p.ed_id, true), (p.small_area_id, false), (p.townland_id, false)) a(area_id, detail)
CROSS JOIN LATERAL (VALUES ('all'), (CASE WHEN m.is_new THEN 'new' ELSE 'second_hand' END)) g(segment)
WHERE a.area_id IS NOT NULL""",
    "register": """
SELECT sale_id + 2 + more AS line_no, CASE WHEN sale_id % 211 = 0 THEN '31/02/2020' ELSE strftime(sale_date, '%d/%m/%Y') END AS raw_date, address AS raw_address,
  CASE WHEN sale_id % 223 = 0 THEN 'Antrim' ELSE upper(county) END AS raw_county,
  CASE WHEN sale_id % 5 = 0 THEN '' ELSE routing_key || ' ' || lpad(CAST(sale_id % 9999 AS VARCHAR), 4, '0') END AS raw_eircode,
  CASE WHEN sale_id % 227 = 0 THEN '100000' ELSE '€' || format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS raw_price,
  CASE WHEN not_full_market THEN 'Yes' ELSE 'No' END AS raw_nfmp, CASE WHEN sale_id % 229 = 0 THEN 'Perhaps' WHEN vat_exclusive THEN 'Yes' ELSE 'No' END AS raw_vat,
  CASE WHEN sale_id % 233 = 0 THEN 'Castle' WHEN is_new THEN CASE WHEN sale_id % 2 = 0 THEN 'New Dwelling house /Apartment' ELSE 'Teach/Árasán Cónaithe Nua' END ELSE 'Second-Hand Dwelling house /Apartment' END AS raw_description,
  CASE WHEN sale_id % 239 = 0 THEN 'huge' WHEN sale_id % 4 = 0 THEN 'less than 38 sq metres' WHEN sale_id % 4 = 1 THEN 'greater than or equal to 38 sq metres and less than 125 sq metres' WHEN sale_id % 4 = 2 THEN 'greater than 125 sq metres' ELSE '' END AS raw_size
FROM sale JOIN property USING (property_id) JOIN (VALUES (0), (10000000)) v(more) ON more = 0 OR sale_id % 50 = 0""",
    "parsed": """
SELECT *, CASE WHEN regexp_full_match(trim(raw_date), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}') THEN CAST(try_strptime(trim(raw_date), '%d/%m/%Y') AS DATE) END AS sale_date,
  CASE WHEN lower(trim(raw_county)) IN ('africa', 'america', 'asia', 'europe', 'middle east') THEN lower(trim(raw_county)) END AS county,
  CASE WHEN regexp_full_match(trim(raw_price), '€[0-9,]+\\.[0-9]{2}') THEN TRY_CAST(regexp_replace(trim(raw_price), '[€,.]', '', 'g') AS BIGINT) END AS cents,
  CASE WHEN contains(lower(raw_description), 'second-hand') THEN false WHEN starts_with(lower(raw_description), 'new ') OR ends_with(lower(raw_description), ' nua') THEN true END AS is_new,
  CASE WHEN raw_size = '' THEN '' WHEN contains(raw_size, '38') AND contains(raw_size, '125') THEN '38_to_125' WHEN contains(raw_size, '125') THEN 'gte_125' WHEN contains(raw_size, '38') THEN 'lt_38' END AS band,
  CASE WHEN sale_date IS NULL THEN 'bad date' WHEN county IS NULL THEN 'unknown county' WHEN cents IS NULL THEN 'bad price' WHEN raw_nfmp NOT IN ('Yes', 'No') OR raw_vat NOT IN ('Yes', 'No') THEN 'bad flag'
    WHEN is_new IS NULL THEN 'unknown description' WHEN band IS NULL THEN 'unknown size' END AS error FROM register""",
    "filed": r"""
SELECT *, row_number() OVER (PARTITION BY raw_date, lower(address), raw_price ORDER BY line_no) > 1 AS possible_duplicate,
  row_number() OVER (PARTITION BY raw_date, raw_address, raw_county, raw_eircode, raw_price, raw_nfmp, raw_vat, raw_description, raw_size ORDER BY line_no) - 1 AS occurrence,
  sha256(concat_ws(chr(31), raw_date, address, raw_county, raw_eircode, raw_price, raw_nfmp, raw_vat, raw_description, raw_size, CAST(occurrence AS VARCHAR))) AS row_hash
FROM (SELECT *, trim(regexp_replace(raw_address, '\s+', ' ', 'g')) AS address FROM parsed WHERE error IS NULL)""",
    "price_index": """
SELECT n_regionkey AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
  CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) // count(*) AS BIGINT) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
}


def with_views(uses: str, sql: str) -> str:
    """``sql`` after a WITH of the views it uses and of those that they read."""
    wanted, names = set(uses.split()), list(VIEWS)
    for name in reversed(names):
        if name in wanted:
            wanted |= {x for x in names[: names.index(name)] if f" {x} " in f"{VIEWS[name]} "}
    found = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names if n in wanted)
    body = sql.strip()
    if not found:
        return body
    return f"WITH RECURSIVE {found}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH RECURSIVE {found} {body}"
