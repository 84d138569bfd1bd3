"""SQL that gives the same rows as the core's queries, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

_DIST = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_SIDES = """
  s AS (SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  a AS (SELECT * FROM s WHERE pos % 2 = 0), b AS (SELECT * FROM s WHERE pos % 2 = 1)"""


def _one_to_one(ctes: str, on: str, group: str = "", shown: str = "") -> str:
    """Nearest b of every a under ``on``, then the nearest a of every b."""
    part = f"{group}, " if group else ""
    own = f"a.{group} AS {group}, " if group else ""
    return f"""WITH {ctes},
  d AS (SELECT a.pos AS a_pos, b.pos AS b_pos, {own}{_DIST} AS distance FROM a JOIN b ON {on}),
  n AS (SELECT *, row_number() OVER (PARTITION BY {part}a_pos ORDER BY distance, b_pos) AS r FROM d),
  o AS (SELECT *, row_number() OVER (PARTITION BY {part}b_pos ORDER BY distance, a_pos) AS w FROM n WHERE r = 1)
SELECT {shown}a_pos, b_pos, round(distance, 5) AS distance FROM o WHERE w = 1"""


_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _norm(c: str) -> str:
    bare = rf"regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}_{_WS}]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[^{_WS}]*\p{{Nd}}[^{_WS}]*', '', 'g'), '[{_WS}]+', ' ', 'g'))"


def _slug(c: str) -> str:
    return rf"trim(trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower({c})), ' > ', '/'), '[{_WS}_]+', '-', 'g'), '[^a-z0-9/-]', '', 'g'), '-+', '-', 'g'), '-'), '/')"


def _key(c: str) -> str:
    return f"replace({_norm(c)}, ' ', '')"


_MAP = f"""
  m AS (SELECT source_supermarket, unnest(mapping_results) AS e FROM category_map),
  pairs AS (SELECT DISTINCT source_supermarket, {_key('e.source_category')} AS source_key, {_key('e.matched_target_category')} AS target_key
            FROM m WHERE e.source_category <> '' AND e.matched_target_category <> '')"""
_USABLE = "source_key <> '' AND target_key <> ''"
_BUCKETS = f"""{_MAP},
  p AS (SELECT DISTINCT source_key, target_key FROM pairs WHERE {_USABLE} AND source_supermarket = 'EROSKI'),
  rows_ AS (SELECT *, CAST(product_embedding AS DOUBLE[]) AS v FROM processed_products
            WHERE len(product_embedding) = 64 AND len(list_filter(product_embedding, lambda x: x IS NOT NULL AND x BETWEEN -1e30 AND 1e30)) = 64),
  a AS (SELECT vec_id AS pos, category_key AS bucket, upper(brand) AS brand_key, brand_type, v FROM rows_
        WHERE contains(supermarket, 'EROSKI') AND category_key IN (SELECT source_key FROM p)),
  b AS (SELECT vec_id AS pos, source_key AS bucket, upper(brand) AS brand_key, brand_type, v FROM rows_ JOIN p ON starts_with(category_key, target_key)
        WHERE contains(supermarket, 'Makro'))"""
_LABELS = "labels AS (SELECT DISTINCT lower(unnest(general)) AS p FROM white_label_brands)"
_FINAL = """f AS (SELECT *, CASE WHEN coalesce(brand, 'None') = '' OR EXISTS (SELECT 1 FROM labels WHERE contains(p, lower(coalesce(brand, 'None')))) THEN 'NO BRAND' ELSE coalesce(brand, 'NO BRAND') END AS fb FROM products)"""
_TYPE = "CASE WHEN {} = 'NO BRAND' THEN 'no_brand' ELSE 'brand' END AS brand_type"
_PAIRS = """
  j AS (SELECT CAST(o_custkey AS VARCHAR) AS a_id, CAST(l_suppkey AS VARCHAR) AS b_id, l_quantity, l_discount FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  g AS (SELECT a_id, b_id, CAST(min(l_quantity) AS DOUBLE) AS distance FROM j WHERE l_quantity < 20 GROUP BY 1, 2),
  t AS (SELECT DISTINCT a_id, b_id FROM j WHERE l_discount >= 0.05),
  u AS (SELECT coalesce(g.a_id, t.a_id) AS a_id, coalesce(g.b_id, t.b_id) AS b_id, g.distance AS distance,
               CASE WHEN g.a_id IS NOT NULL AND t.a_id IS NOT NULL THEN 'TP' WHEN g.a_id IS NOT NULL THEN 'FP' ELSE 'FN' END AS outcome
        FROM g FULL OUTER JOIN t ON g.a_id = t.a_id AND g.b_id = t.b_id),
  c AS (SELECT count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn FROM u),
  x AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c),
  y AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM x)"""
_REPEATS = """w AS (SELECT l_partkey AS item, l_orderkey * 10 + l_linenumber AS r FROM lineitem),
  z AS (SELECT item, min(r) OVER (PARTITION BY item) AS first_row, r AS repeated_row FROM w)"""



def _level(source: str, rows: str, prefix: str, value: str) -> str:
    """Objects of an array (or of an object in its place) with their zero-based places."""
    return f"""{source}_l AS (SELECT rep_id, {prefix} AS prefix, CASE json_type({value}) WHEN 'ARRAY' THEN json_extract({value}, '$[*]') WHEN 'OBJECT' THEN [{value}] END AS xs FROM {rows}),
  {source}_u AS (SELECT rep_id, prefix, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM {source}_l WHERE xs IS NOT NULL),
  {source} AS (SELECT rep_id, prefix || CAST(i AS VARCHAR) AS path, x FROM {source}_u WHERE json_type(x) = 'OBJECT')"""


_NODES = f"""WITH {_level('a1', "(SELECT rep_id, CAST(similar_products AS JSON) AS v FROM rawreport WHERE json_valid(similar_products)) r", "'similar_products.'", 'v')},
  {_level('a2', 'a1', "path || '.offers.'", "json_extract(x, '$.offers')")},
  {_level('a3', 'a2', "path || '.promos.'", "json_extract(x, '$.promos')")},
  {_level('a4', 'a3', "path || '.tiers.'", "json_extract(x, '$.tiers')")},
  nodes AS (SELECT rep_id, path FROM a1 UNION ALL SELECT rep_id, path FROM a2 UNION ALL SELECT rep_id, path FROM a3 UNION ALL SELECT rep_id, path FROM a4)
"""


def _node_columns(level: str) -> str:
    return f"SELECT {level}.rep_id, {level}.path, regexp_replace({level}.path, '\\.[^.]+\\.\\d+$', '') AS parent_path, CAST(regexp_extract({level}.path, '(\\d+)$', 1) AS INTEGER) AS ordinal, "


#: First similar product of every EROSKI listing, an object in the list's place standing for it, and its repeats.
_REPORT_REPEATS = """v AS (SELECT rep_id, CAST(similar_products AS JSON) AS v FROM rawreport WHERE json_valid(similar_products) AND contains(supermarket, 'EROSKI')),
  x AS (SELECT rep_id AS r, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[0]') WHEN 'OBJECT' THEN v END AS x FROM v),
  i AS (SELECT r, coalesce(json_extract_string(x, '$.id'), json_extract_string(x, '$.productIdInSupermarket')) AS item FROM x),
  z AS (SELECT item, min(r) OVER (PARTITION BY item) AS first_row, r AS repeated_row FROM i WHERE item <> '')"""
_MESSAGE = """SELECT n_repeats, CASE WHEN n_repeats = 0 THEN 'Success: No repeated similar product IDs were found.' ELSE 'Action Required: One or more similar product IDs are repeated in the report.' END AS message FROM n"""


#: Leaves of the report documents: id and brand where they aren't null, and every scalar of similar_products.
_LEAVES = r"""WITH v AS (SELECT rep_id, similar_products FROM rawreport WHERE json_valid(similar_products)),
  t AS (SELECT v.rep_id, j.fullkey, j.type, json_extract_string(j.value, '$') AS x FROM v, json_tree(v.similar_products) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')),
  leaves AS (SELECT rep_id, 'similar_products' || regexp_replace(substr(fullkey, 2), '\[(\d+)\]', '.\1', 'g') AS path, CASE WHEN type = 'NULL' THEN NULL ELSE x END AS value, type = 'NULL' AS is_null FROM t
    UNION ALL SELECT rep_id, 'id', id, false FROM rawreport WHERE id IS NOT NULL UNION ALL SELECT rep_id, 'brand', brand, false FROM rawreport WHERE brand IS NOT NULL)"""


ORACLES: dict[str, str] = {
    "match_brand": _one_to_one(_SIDES, "a.label = b.label", "label"),
    "match_no_brand": _one_to_one(_SIDES, "true"),
    "knn_topk": f"""WITH {_SIDES},
  d AS (SELECT a.pos AS a_pos, b.pos AS b_pos, {_DIST} AS distance FROM a CROSS JOIN b),
  n AS (SELECT *, row_number() OVER (PARTITION BY a_pos ORDER BY distance, b_pos) AS r FROM d)
SELECT a_pos, b_pos, CAST(r AS INTEGER) AS rank, round(distance, 5) AS distance FROM n WHERE r <= 5""",
    "match_own_brand_flag": f"""WITH {_SIDES},
  d AS (SELECT a.pos AS a_pos, b.pos AS b_pos, {_DIST} AS distance FROM a JOIN b ON (a.label < 3) = (b.label < 3)),
  n AS (SELECT *, row_number() OVER (PARTITION BY a_pos ORDER BY distance, b_pos) AS r FROM d)
SELECT a_pos, b_pos, round(distance, 5) AS distance FROM n WHERE r = 1""",
    "match_catalog_brand": _one_to_one(f"{_BUCKETS}", "a.bucket = b.bucket AND a.brand_key = b.brand_key AND a.brand_type = 'brand' AND b.brand_type = 'brand'", "bucket", "bucket, "),
    "match_catalog_no_brand": _one_to_one(f"{_BUCKETS}", "a.bucket = b.bucket AND a.brand_type = 'no_brand' AND b.brand_type = 'no_brand'", "bucket", "bucket, "),
    "match_overlapping_buckets": _one_to_one(f"""{_SIDES.replace(" a AS", " a0 AS").replace(" b AS", " b0 AS")},
  a AS (SELECT DISTINCT pos, v, unnest([label % 4, (label + 1) % 4]) AS bucket FROM a0),
  b AS (SELECT DISTINCT pos, v, unnest([label % 4, CASE WHEN pos % 3 = 0 THEN (label + 2) % 4 ELSE label % 4 END]) AS bucket FROM b0)""", "a.bucket = b.bucket", "bucket", "bucket, "),
    "category_map": f"""WITH {_SIDES},
  e AS (SELECT 'a' AS side, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a UNION ALL SELECT 'b', label, unnest(v), unnest(range(1, len(v) + 1)) FROM b),
  q AS (SELECT side, label, i, avg(x) AS x FROM e GROUP BY 1, 2, 3),
  l AS (SELECT side, label, sqrt(sum(x * x)) AS n FROM q GROUP BY 1, 2),
  k AS (SELECT q1.label AS s, q2.label AS t, sum(q1.x * q2.x) AS dot FROM q q1 JOIN q q2 ON q1.i = q2.i AND q1.side = 'a' AND q2.side = 'b' GROUP BY 1, 2),
  c AS (SELECT 'c' || CAST(s AS VARCHAR) AS s, 'c' || CAST(t AS VARCHAR) AS t, dot / (l1.n * l2.n) AS score FROM k JOIN l l1 ON l1.side = 'a' AND l1.label = s JOIN l l2 ON l2.side = 'b' AND l2.label = t),
  r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS n FROM c)
SELECT s AS source_category, CASE WHEN score >= 0.5 THEN t END AS matched_target_category, round(score, 4) AS similarity_score FROM r WHERE n = 1""",
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS text_norm FROM documents",
    "slug_categories": f"SELECT pos, {_slug('category')} AS slug, {_key('category')} AS category_key FROM products",
    "accent_removal": "SELECT rep_id, strip_accents(description) AS description, strip_accents(category) AS category FROM rawreport",
    "category_filter": f"""WITH {_MAP}, s AS (SELECT DISTINCT source_key FROM pairs WHERE {_USABLE}),
  k AS (SELECT pos, {_key('category')} AS ck FROM products)
SELECT pos, source_key AS bucket FROM k JOIN s ON starts_with(ck, source_key)""",
    "category_counter": f"""WITH {_MAP}, p AS (SELECT DISTINCT source_key, target_key FROM pairs WHERE {_USABLE} AND source_supermarket = 'EROSKI'),
  k AS (SELECT {_key('category')} AS category_key, supermarket FROM products),
  h AS (SELECT category_key FROM k JOIN p ON starts_with(category_key, source_key) WHERE contains(supermarket, 'EROSKI')
        UNION ALL SELECT category_key FROM k JOIN p ON starts_with(category_key, target_key) WHERE contains(supermarket, 'Makro'))
SELECT category_key, count(*) AS n_products FROM h GROUP BY 1""",
    "white_label": f"WITH {_LABELS}, {_FINAL} SELECT pos, fb AS brand, {_TYPE.format('fb')} FROM f",
    "brand_min_count": f"""WITH {_LABELS}, {_FINAL}, n AS (SELECT *, count(*) OVER (PARTITION BY fb, supermarket) AS c FROM f),
  g AS (SELECT pos, CASE WHEN c < 2 THEN 'NO BRAND' ELSE fb END AS brand FROM n)
SELECT pos, brand, {_TYPE.format('brand')} FROM g""",
    "product_text": f"""WITH {_LABELS}, {_FINAL},
  t AS (SELECT pos, concat_ws(' ', nullif(CASE WHEN contains(supermarket, 'Makro') THEN denomination WHEN contains(supermarket, 'EROSKI') THEN description END, ''),
    CASE WHEN fb <> 'NO BRAND' THEN fb END, nullif(raw_ingredients, ''), CASE WHEN nutrition_information IS NOT NULL THEN concat_ws(' ',
    'calories ' || coalesce(nutrition_information.calories.value, 'None'), 'fat ' || coalesce(nutrition_information.fat.value, 'None'),
    'protein ' || coalesce(nutrition_information.protein.value, 'None'), 'carbs ' || coalesce(nutrition_information.carbohydrates.value, 'None')) END) AS x FROM f),
  n AS (SELECT pos, {_norm('x')} AS product_concatenation FROM t)
SELECT pos, product_concatenation FROM n WHERE product_concatenation <> ''""",
    "legacy_product_text": """WITH s AS (SELECT *, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS z FROM part)
SELECT p_partkey, p_name || ', BRAND: ' || p_brand || ', UNIT PRICE: ' || CAST(CASE WHEN z = '' THEN CAST(p_retailprice AS DOUBLE) ELSE p_retailprice / nullif(TRY_CAST(z AS DOUBLE), 0) END AS VARCHAR)
  || ', FORMAT: ' || p_type || ', AMOUNT: ' || z || ' kg' AS legacy_text FROM s""",
    "dedup_last_wins": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS r, min(pos) OVER (PARTITION BY id) AS first_pos FROM products)
SELECT id, pos, price, category, first_pos FROM n WHERE r = 1""",
    "dedup_pairs": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r,
  coalesce(CAST(user_id AS VARCHAR) IN ('', '0'), true) OR coalesce(event_type IN ('', '0'), true) AS missing FROM events)
SELECT event_id, user_id, event_type FROM n WHERE r = 1 OR missing""",
    "eval_matches": f"WITH {_PAIRS} SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM y",
    "eval_general": f"WITH {_PAIRS} SELECT tp, fp, fn, printf('%.2f%%', p * 100) AS precision, printf('%.2f%%', r * 100) AS recall, printf('%.2f%%', f * 100) AS f1 FROM y",
    "eval_report": f"""WITH {_PAIRS} SELECT CASE outcome WHEN 'TP' THEN 1 WHEN 'FP' THEN 2 ELSE 3 END AS section, outcome,
  CASE WHEN outcome = 'TP' THEN 'TP' END AS match_type, CASE WHEN outcome <> 'TP' THEN outcome END AS error_type, a_id, b_id, distance FROM u""",
    "truth_pairs": """SELECT DISTINCT er_referencia_eroski AS a_id, ref_competidor AS b_id FROM known_matches
WHERE trim(er_referencia_eroski) NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')
  AND trim(ref_competidor) NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')""",
    "eval_categories_macro": """WITH s AS (SELECT p_type AS t, CASE p_size % 3 WHEN 0 THEN 'None' WHEN 1 THEN p_type ELSE 'STANDARD' END AS q FROM part),
  l AS (SELECT t AS label FROM s UNION SELECT q FROM s),
  c AS (SELECT label, (SELECT count(*) FROM s WHERE t = label AND q = label) AS tp, (SELECT count(*) FROM s WHERE t = label) AS nt, (SELECT count(*) FROM s WHERE q = label) AS nq FROM l),
  m AS (SELECT coalesce(tp / nullif(nq, 0), 0) AS p, coalesce(tp / nullif(nt, 0), 0) AS r FROM c)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1 FROM m""",
    "eval_categories": """WITH t AS (SELECT DISTINCT p_name AS source_category, p_brand AS target_category FROM part),
  l AS (SELECT p_name AS source_category, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS target_category, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r FROM part),
  g AS (SELECT source_category, target_category FROM l WHERE r = 1)
SELECT source_category, target_category, 'TP' AS outcome FROM (SELECT * FROM g INTERSECT SELECT * FROM t)
UNION ALL SELECT source_category, target_category, 'FP' FROM (SELECT * FROM g EXCEPT SELECT * FROM t) WHERE target_category IS NOT NULL
UNION ALL SELECT source_category, target_category, 'FN' FROM (SELECT * FROM t EXCEPT SELECT * FROM g)""",
    "norepeat": f"WITH {_REPEATS} SELECT item, first_row, repeated_row FROM z WHERE repeated_row > first_row",
    "norepeat_message": f"""WITH {_REPEATS}, n AS (SELECT count(*) AS n_repeats FROM z WHERE repeated_row > first_row)
SELECT n_repeats, CASE WHEN n_repeats = 0 THEN 'Success: No repeated similar product IDs were found.' ELSE 'Action Required: One or more similar product IDs are repeated in the report.' END AS message FROM n""",
    "flatten_json": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "csv_columns": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'Not found') AS k FROM events WHERE props IS NOT NULL",
    "flatten_report": f"{_LEAVES} SELECT rep_id, path, value, is_null FROM leaves",
    "csv_columns_report": f"""WITH p AS (PIVOT ({_LEAVES} SELECT rep_id, path, coalesce(value, '') AS value FROM leaves UNION ALL SELECT rep_id, 'id', NULL FROM rawreport) ON path USING max(value) GROUP BY rep_id)
SELECT rep_id, coalesce(COLUMNS(* EXCLUDE (rep_id)), 'Not found') FROM p""",
    "match_global": f"""WITH RECURSIVE {_SIDES},
  d AS (SELECT a.pos AS a_pos, b.pos AS b_pos, a.label = b.label AS own, {_DIST} AS distance FROM a CROSS JOIN b),
  r AS (SELECT *, row_number() OVER (PARTITION BY a_pos ORDER BY distance, b_pos) AS k, row_number() OVER (PARTITION BY a_pos, own ORDER BY distance, b_pos) AS j FROM d),
  c AS (SELECT a_pos, b_pos, distance, row_number() OVER (ORDER BY distance, a_pos, b_pos) AS n FROM r WHERE k = 1 OR (own AND j <= 3)),
  w AS (SELECT 0 AS n, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS took
        UNION ALL SELECT m, CASE WHEN t THEN list_append(ua, a_pos) ELSE ua END, CASE WHEN t THEN list_append(ub, b_pos) ELSE ub END, t
        FROM (SELECT w.ua, w.ub, c.a_pos, c.b_pos, c.n AS m, NOT list_contains(ua, c.a_pos) AND NOT list_contains(ub, c.b_pos) AS t FROM w JOIN c ON c.n = w.n + 1) s)
SELECT c.a_pos, c.b_pos, round(distance, 5) AS distance FROM w JOIN c ON c.n = w.n WHERE took""",
    "io_products": "SELECT id, supermarket, description, denomination, brand, category, price, unit_price, nutrition_information.fat.value AS fat FROM products",
    "io_report_csv": "SELECT CAST(rep_id AS VARCHAR) AS rep_id, nullif(id, '') AS id, nullif(description, '') AS description, nullif(brand, '') AS brand, nullif(category, '') AS category, nullif(similar_products, '') AS similar_products FROM rawreport",
    "io_buckets": "SELECT vec_id, id, category_key, brand FROM processed_products WHERE brand_type = 'brand'",
    "io_category_map": f"WITH {_MAP} SELECT source_key, target_key FROM pairs WHERE source_supermarket = 'EROSKI' AND {_USABLE}",
    "io_white_labels": "SELECT DISTINCT p AS pattern FROM (SELECT unnest(general) AS p FROM white_label_brands) WHERE p IS NOT NULL",
    "io_translations": "SELECT n_name AS original, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE reverse(n_name) END AS translated FROM nation",
    "translate_lookup": "SELECT n_name AS word, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS translated FROM nation",
    "golden_set_expand": """SELECT trim(p_name) AS source_category, NULL AS target_category FROM part WHERE p_size % 5 = 1
UNION ALL SELECT p_name, unnest([p_brand, p_type]) FROM part WHERE p_size % 5 > 1""",
    "bucket_pairing": """WITH l AS (SELECT category_key, brand_type, count(*) AS n_source FROM processed_products WHERE category_key IS NOT NULL AND contains(supermarket, 'EROSKI') GROUP BY 1, 2),
  r AS (SELECT category_key, brand_type, count(*) AS n_target FROM processed_products WHERE category_key IS NOT NULL AND contains(supermarket, 'Makro') GROUP BY 1, 2)
SELECT l.category_key, l.brand_type, n_source, coalesce(n_target, 0) AS n_target, n_target IS NOT NULL AS paired FROM l LEFT JOIN r ON l.category_key = r.category_key AND l.brand_type = r.brand_type""",
    "map_entries": f"""WITH m AS (SELECT source_supermarket, target_supermarket, unnest(mapping_results) AS e FROM category_map)
SELECT DISTINCT source_supermarket, target_supermarket, {_slug('e.source_category')} AS source_slug, {_slug('e.matched_target_category')} AS target_slug, e.similarity_score AS similarity_score FROM m""",
    "slug_originals": f"""WITH n AS (SELECT {_slug('category')} AS slug, min(category) AS original FROM products WHERE category IS NOT NULL GROUP BY 1),
  s AS (SELECT DISTINCT {_slug('category')} AS slug FROM products WHERE contains(supermarket, 'Makro') AND category IS NOT NULL)
SELECT s.slug, coalesce(original, s.slug) AS original FROM s LEFT JOIN n ON s.slug = n.slug""",
    "p3_found": _NODES + "SELECT rep_id, path AS child_path FROM nodes",
    "p3_products": _NODES + """SELECT rep_id, path, NULL AS parent_path, CAST(regexp_extract(path, '(\\d+)$', 1) AS INTEGER) AS ordinal,
  coalesce(json_extract_string(x, '$.id'), json_extract_string(x, '$.productIdInSupermarket')) AS id, coalesce(json_extract_string(x, '$.description'), json_extract_string(x, '$.denomination')) AS description,
  json_extract_string(x, '$.brand') AS brand, TRY_CAST(json_extract_string(x, '$.price') AS DOUBLE) AS price, json_extract_string(x, '$.unit_price') AS unit_price,
  TRY_CAST(json_extract_string(x, '$.distance') AS DOUBLE) AS distance, json_extract_string(x, '$.nutrition_information.calories.value') AS calories FROM a1""",
    "p3_offers": _NODES + _node_columns("a2") + """json_extract_string(x, '$.seller') AS seller, TRY_CAST(json_extract_string(x, '$.price') AS DOUBLE) AS price,
  TRY_CAST(json_extract_string(x, '$.stock.units') AS INTEGER) AS stock_units, json_extract_string(x, '$.stock.store.zone') AS zone FROM a2""",
    "p3_promos": _NODES + _node_columns("a3") + "json_extract_string(x, '$.code') AS code, json_extract_string(x, '$.label') AS label FROM a3",
    "p3_tiers": _NODES + _node_columns("a4") + "TRY_CAST(json_extract_string(x, '$.min_units') AS INTEGER) AS min_units, TRY_CAST(json_extract_string(x, '$.off') AS DOUBLE) AS off FROM a4",
    "p2_found": """WITH n AS (SELECT category, pos, row_number() OVER (PARTITION BY category ORDER BY scraped_at DESC, pos DESC) AS r FROM products WHERE category IS NOT NULL AND scraped_at IS NOT NULL)
SELECT category, pos FROM n WHERE r = 1""",
    "p2_since_latest": """WITH n AS (SELECT category, pos, row_number() OVER (PARTITION BY category ORDER BY scraped_at DESC, pos DESC) AS r FROM products WHERE category IS NOT NULL AND scraped_at IS NOT NULL)
SELECT p.pos, p.category, n.pos AS latest_pos FROM products p JOIN n ON p.category = n.category AND n.r = 1""",
}
ORACLES["io_truth"] = ORACLES["truth_pairs"]
ORACLES["report_norepeat"] = f"WITH {_REPORT_REPEATS} SELECT item, first_row, repeated_row FROM z WHERE repeated_row > first_row"
ORACLES["report_norepeat_message"] = f"WITH {_REPORT_REPEATS}, n AS (SELECT count(*) AS n_repeats FROM z WHERE repeated_row > first_row) {_MESSAGE}"
