"""SQL twins of the bill engine's queries, for another engine to run on the same tables."""

from __future__ import annotations

from ..functions import locale
from ..operators.intake import STOPWORDS
from ..operators.learn import MEANING
from ..sources import dims

#: The last attachment of each order, as text.
ATTACHMENTS = """
WITH r AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'CrossIndustryInvoice' ELSE 'FatturaElettronica' END AS root FROM orders),
attachments AS (
  SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Factur-X.xml' WHEN 1 THEN 'IT0001_fattura.xml' ELSE 'data.xml' END AS filename,
    '<r:' || root || ' xmlns:r="urn:x"><r:ID></r:ID><r:ID>' || o_orderkey || '</r:ID><r:ID>other</r:ID><IssueDateTime>' || strftime(o_orderdate, '%Y-%m-%d') || '</IssueDateTime>'
    || CASE WHEN o_orderkey % 5 = 0 THEN '<r:DueDateDateTime/>' ELSE '<r:DueDateDateTime>' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') || '</r:DueDateDateTime>' END
    || '<r:GrandTotalAmount>1.00</r:GrandTotalAmount><GrandTotalAmount currencyID="EUR">' || o_totalprice::DECIMAL(18,2) || '</GrandTotalAmount>'
    || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '<r:TaxTotalAmount>' || (o_orderkey % 90) || '</r:TaxTotalAmount>' END || '</r:' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE root || '>' END AS data
  FROM r)
"""
#: The bill model's tables.
MODEL = """
WITH extractions AS (
  SELECT o_orderkey AS extraction_id, sha256(o_custkey || '-' || (o_orderkey % 7)) AS file_hash,
    CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending_review' ELSE 'processing' END AS status,
    ['electricity','natural_gas','water','electricity'][o_orderkey % 4 + 1] AS commodity_type, n_name AS utility_provider,
    ((o_orderkey % 101) / 100)::DOUBLE AS confidence_score, ['simple','standard','complex','pathological','standard'][o_orderkey % 5 + 1] AS complexity_tier,
    o_orderdate AS created_at, ['US','DE','GB','FR','MX','ES'][c_nationkey % 6 + 1] AS country_code, o_orderkey % 130 AS billing_days,
    o_orderkey % 3 = 0 AS has_demand_charges, o_orderkey % 4 = 1 AS has_supplier_split, o_totalprice::DECIMAL(18,2) AS stated_total, o_orderkey % 8 = 0 AS minimum_bill_applied
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
lines AS (SELECT *, l_extendedprice::DECIMAL(18,2) AS price, (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 11 AS case_no FROM lineitem),
charges AS (
  SELECT l_orderkey AS extraction_id, l_linenumber AS line_number, case_no,
    CASE WHEN l_returnflag = 'A' THEN 'energy' WHEN l_returnflag = 'R' THEN 'fixed' WHEN l_suppkey % 5 = 0 THEN 'credit' WHEN l_suppkey % 5 = 1 THEN 'demand' ELSE 'tax' END AS category,
    ['supply','distribution','taxes','other'][l_linenumber % 4 + 1] AS charge_section, ['supplier','utility','government'][l_suppkey % 3 + 1] AS charge_owner,
    round(l_quantity::BIGINT * (((price * 100)::BIGINT * 100) // l_quantity::BIGINT) / 1.0, 0)::BIGINT AS expected_e4,
    round((price * CASE case_no WHEN 1 THEN 1.015 WHEN 2 THEN 1.500 WHEN 3 THEN -1.000 ELSE 1.000 END::DECIMAL(5,3))::DECIMAL(28,5) + CASE case_no WHEN 0 THEN 0.03 ELSE 0 END::DECIMAL(4,2), 2)::DECIMAL(18,2) AS amount,
    round((price * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(28,4), 2)::DECIMAL(18,2) AS amount_net, l_tax::DECIMAL(4,2) AS vat_rate, case_no = 4 AS reverse_charge
  FROM lines),
vat AS (
  SELECT *, (round((amount_net * vat_rate)::DECIMAL(28,4), 2) + CASE case_no WHEN 5 THEN 0.06 WHEN 6 THEN 1.00 ELSE 0 END)::DECIMAL(18,2) AS vat_amount FROM charges),
tol AS (SELECT * FROM (VALUES %(tolerances)s) t(country, base, tax)),
bills AS (SELECT e.*, coalesce(base, 0.05)::DECIMAL(4,2) AS base, coalesce(tax, 0.10)::DECIMAL(4,2) AS tax FROM extractions e LEFT JOIN tol ON coalesce(country_code, 'US') = country),
k AS (SELECT *, (props::JSON->>'k')::INT AS k FROM events),
corrections AS (
  SELECT event_id AS correction_id, event_id * 4 %% 15000 + 1 AS extraction_id,
    'charges.' || event_type || '.' || ['amount','rate','billing_date','category','account_number'][user_id %% 5 + 1] AS field_path,
    CASE WHEN k %% 10 <> 0 THEN v::VARCHAR END AS extracted_value,
    CASE k %% 10 WHEN 1 THEN v || 'X' WHEN 2 THEN '' WHEN 3 THEN '0' || v ELSE (v + k %% 7)::DECIMAL(18,2)::VARCHAR END AS corrected_value,
    CASE k %% 4 WHEN 0 THEN 'ocr_confusion' WHEN 1 THEN 'missing_context' WHEN 2 THEN '' END AS correction_category,
    ['North Power','City Gas','Blue Water'][user_id %% 3 + 1] AS utility, ['electricity','natural_gas'][user_id %% 2 + 1] AS commodity, ts AS created_at
  FROM (SELECT *, round(value, 2)::DECIMAL(18,2) AS v FROM k)),
calls AS (
  SELECT event_id AS call_id, CASE WHEN event_id %% 9 <> 0 THEN event_id * 4 %% 15000 + 1 END AS extraction_id, event_type AS stage, ['small','large','vision','unlisted'][user_id %% 4 + 1] AS model,
    k * 37 AS input_tokens, k * 11 %% 50 AS output_tokens, CASE WHEN k * 37 <> 0 AND k * 11 %% 50 <> 0 THEN k * 37 + k * 11 %% 50 END AS total_tokens,
    CASE WHEN event_id %% 17 <> 0 THEN round(value * 10)::BIGINT END AS duration_ms, repeat(event_type, k) AS response, ts AS created_at FROM k),
inferred AS (
  SELECT *, CASE WHEN extracted_value IS NULL THEN 'missing_context' WHEN trim(corrected_value) = '' THEN 'other'
    WHEN length(corrected_value) < length(extracted_value) AND (starts_with(extracted_value, corrected_value) OR suffix(extracted_value, corrected_value)) THEN 'format_normalize'
    WHEN extracted_value = corrected_value THEN 'format_normalize'
    WHEN regexp_matches(field_path, 'amount|total|charge|cost|price|quantity|consumption|reading') AND NOT contains(corrected_value, 'X') THEN 'calculation_error' ELSE 'other' END AS inferred FROM corrections),
categorized AS (SELECT *, coalesce(nullif(correction_category, ''), inferred) AS category FROM inferred),
meters AS (
  SELECT extraction_id, extraction_id %% 90000 AS previous_read, (extraction_id %% 90000 + extraction_id %% 750) AS current_read, CASE extraction_id %% 6 WHEN 0 THEN 10 ELSE 1 END AS mult,
    ((extraction_id %% 750) * CASE extraction_id %% 6 WHEN 0 THEN 10 ELSE 1 END + CASE extraction_id %% 13 WHEN 0 THEN 5 ELSE 0 END)::DOUBLE AS raw_value, ['kWh','therms','m3','ccf'][extraction_id %% 4 + 1] AS raw_unit,
    CASE WHEN extraction_id %% 10 <> 0 THEN (extraction_id %% 40) / 4 + 6 END::DOUBLE AS cv, ((extraction_id %% 30) / 100)::DOUBLE + 0.85::DOUBLE AS vcf,
    (extraction_id %% 1300)::DOUBLE AS volume, CASE WHEN extraction_id %% 7 <> 0 THEN (extraction_id %% 1300) * 11 ELSE 0 END::DOUBLE AS energy, commodity_type, country_code FROM extractions),
line_issues AS (
  SELECT c.extraction_id, 'V01' AS rule_id, 'charges.' || line_number || '.amount' AS field, round((expected_e4::DECIMAL(28,0) * 0.0001::DECIMAL(5,4))::DECIMAL(38,4), 2)::DECIMAL(18,2) AS expected, amount AS actual, category, base
  FROM charges c JOIN bills USING (extraction_id)),
v01 AS (SELECT extraction_id, rule_id, field, CASE WHEN abs(expected - actual) <= base THEN NULL WHEN actual > expected AND category = 'fixed' THEN 'info' WHEN abs(expected - actual) <= 0.02 * actual THEN 'info' ELSE 'warning' END AS severity, expected::VARCHAR AS expected, actual::VARCHAR AS actual FROM line_issues),
v03 AS (SELECT extraction_id, 'V03' AS rule_id, 'totals.current_charges' AS field, CASE WHEN abs(s - stated_total) > 4 * base THEN CASE WHEN minimum_bill_applied THEN 'info' ELSE 'warning' END END AS severity, s::VARCHAR AS expected, stated_total::VARCHAR AS actual
  FROM bills JOIN (SELECT extraction_id, sum(amount)::DECIMAL(18,2) AS s FROM charges GROUP BY 1) USING (extraction_id)),
v08 AS (SELECT extraction_id, 'V08' AS rule_id, 'invoice.billing_days' AS field, 'warning' AS severity, '15-95' AS expected, billing_days::VARCHAR AS actual FROM bills WHERE billing_days NOT BETWEEN 15 AND 95),
v09 AS (SELECT extraction_id, 'V09' AS rule_id, 'charges.' || line_number || '.amount' AS field, 'warning' AS severity, '>=0' AS expected, amount::VARCHAR AS actual FROM charges WHERE amount < 0 AND category NOT IN ('credit', 'adjustment')),
v10 AS (SELECT extraction_id, 'V10' AS rule_id, 'charges' AS field, 'warning' AS severity, 'demand charge' AS expected, 'none' AS actual FROM bills b WHERE has_demand_charges AND NOT EXISTS (SELECT 1 FROM charges c WHERE c.extraction_id = b.extraction_id AND category = 'demand')),
v12 AS (SELECT extraction_id, 'V12' AS rule_id, 'charges.charge_owner' AS field, 'warning' AS severity, '2' AS expected, coalesce(n, 0)::VARCHAR AS actual FROM bills LEFT JOIN (SELECT extraction_id, count(DISTINCT charge_owner) AS n FROM charges GROUP BY 1) USING (extraction_id) WHERE has_supplier_split AND coalesce(n, 0) <= 1),
issues AS (SELECT * FROM v01 WHERE severity IS NOT NULL UNION ALL SELECT * FROM v03 WHERE severity IS NOT NULL UNION ALL SELECT * FROM v08 UNION ALL SELECT * FROM v09 UNION ALL SELECT * FROM v10 UNION ALL SELECT * FROM v12),
disposed AS (SELECT extraction_id, CASE WHEN max(CASE WHEN severity = 'warning' THEN 1 END) = 1 THEN 'rounding_variance' ELSE 'clean' END AS disposition, count(severity) AS n_issues FROM bills LEFT JOIN issues USING (extraction_id) GROUP BY 1),
runs AS (SELECT file_hash, extraction_id, lag(extraction_id) OVER w AS previous_id, confidence_score, lag(confidence_score) OVER w AS previous_score, status, lag(status) OVER w AS previous_status, stated_total, lag(stated_total) OVER w AS previous_total FROM extractions WINDOW w AS (PARTITION BY file_hash ORDER BY created_at, extraction_id)),
pairs AS (SELECT * FROM runs WHERE previous_id IS NOT NULL),
drift AS (
  SELECT extraction_id, previous_id, 'totals.total_amount_due' AS field_path, previous_total::VARCHAR AS old_value, stated_total::VARCHAR AS new_value, 'fatal' AS severity, 3 AS r FROM pairs
  UNION ALL SELECT extraction_id, previous_id, 'extraction.confidence_score', previous_score::VARCHAR, confidence_score::VARCHAR, 'low', 0 FROM pairs
  UNION ALL SELECT extraction_id, previous_id, 'extraction.status', previous_status, status, 'low', 0 FROM pairs),
changed AS (SELECT * FROM drift WHERE old_value IS DISTINCT FROM new_value),
latest AS (SELECT * FROM extractions QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY created_at DESC, extraction_id DESC) = 1)
""".replace("%(tolerances)s", ", ".join(f"('{c}', {b}, {t})" for c, b, t in dims.TOLERANCES)).replace("%%", "%")

_ORDERS = "SELECT *, o_orderkey % 6 AS k6, o_orderkey % 4 AS k4, strftime(o_orderdate, '%d')::INT AS dd, strftime(o_orderdate, '%m')::INT AS mm FROM orders"
_STOP = " UNION ALL ".join(f"SELECT doc_id, '{lang}' AS language, {sorted(STOPWORDS).index(lang)} AS o, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\n]+'), lambda w: w IN ({', '.join(repr(w) for w in stop)}))) AS n FROM documents" for lang, stop in STOPWORDS.items())

_PLAIN = {
    "a04_content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "a09_response_json": "SELECT o_orderkey AS call_id, ['whole','fenced','braces','none'][o_orderkey % 4 + 1] AS strategy, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 4 < 3 THEN o_orderstatus END AS status FROM orders",
    "a10_structured_invoice": f"{ATTACHMENTS} SELECT doc_id, CASE WHEN contains(lower(filename), 'factur-x') OR NOT contains(lower(filename), 'fattura') AND contains(data, 'CrossIndustryInvoice') THEN 'factur-x/zugferd' ELSE 'fatturapa' END AS kind, "
    + ", ".join(f"CASE WHEN suffix(data, 'Invoice>') OR suffix(data, 'Elettronica>') THEN {cast.format(f"regexp_extract_all(data, '<(?:r:)?{tag}(?: [^>]*)?>([^<]+)<', 1)[{at}]")} END AS {name}" for tag, at, name, cast in (("ID", 1, "invoice_id", "{}"), ("GrandTotalAmount", -1, "grand_total", "{}::DOUBLE"), ("IssueDateTime", -1, "issue_date", "{}"), ("DueDateDateTime", -1, "due_date", "{}"), ("TaxTotalAmount", -1, "tax_total", "{}::DOUBLE")))
    + " FROM attachments",
    "a11_document_text": "SELECT doc_id, sha256(t) AS text_hash, length(t)::INT AS n_chars FROM (SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, text) AS t FROM conversations GROUP BY 1)",
    "a12_document_quality": "SELECT l_orderkey AS doc_id, round(sum(l_discount::DECIMAL(4,2))::DECIMAL(18,2) / count(*), 3)::DOUBLE AS quality, count(*) AS n_pages FROM lineitem GROUP BY 1",
    "a13_page_sample": "SELECT conv_id, turn, n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE k = 1 OR (n > 2 AND k = n // 2 + 1)",
    "a14_language_vote": f"SELECT doc_id, CASE WHEN max(n) = 0 THEN 'en' ELSE arg_max(language, (n, -o)) END AS language FROM ({_STOP}) GROUP BY doc_id",
    "b20_latest_job_status": "SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "c05_taxonomy_lookup": f"WITH t AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}, {b!r}, {c!r})' for i, (a, b, c) in enumerate(dims.TAXONOMY))}) x(o, keyword, tax_category, tax_section)) SELECT p_partkey, keyword, tax_category, tax_section FROM part LEFT JOIN t ON contains(lower(p_name), keyword) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY o) = 1",
    "g01_number_format": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 2) THEN 'US' ELSE 'EU' END AS number_format FROM orders",
    "g02_normalize_amounts": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 3) THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS amount FROM orders",
    "g04_detect_currency": "SELECT o_orderkey, ['USD','EUR',NULL,NULL,'EUR','BRL'][o_orderkey % 6 + 1] AS currency FROM orders",
    "g07_date_format": f"SELECT o_orderkey, CASE WHEN k4 = 0 THEN 'YYYY-MM-DD' WHEN k4 = 1 THEN 'DD.MM.YYYY' WHEN k4 = 2 AND dd > 12 THEN 'DD/MM/YYYY' ELSE 'MM/DD/YYYY' END AS date_format FROM ({_ORDERS})",
    "g08_normalize_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "g09_ambiguous_dates": f"SELECT o_orderkey, k4 <> 0 AND dd <= 12 AND dd <> mm AS ambiguous FROM ({_ORDERS})",
    "g10_billing_period": "SELECT o_orderkey, CASE WHEN days < 0 THEN 'invalid: ends before it starts' WHEN days = 0 THEN 'invalid: no days' WHEN days > 400 THEN 'invalid: too long' WHEN days < 15 OR days > 95 THEN 'unusual' ELSE 'ok' END AS verdict FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, max(l_shipdate)::DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate)",
    "g18_first_number": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 2) THEN round(o_totalprice, 2) END AS value FROM orders",
    "x18_demand_ratchet": """WITH o AS (SELECT o_custkey % 40 AS meter, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS month, o_totalprice::DECIMAL(18,2) AS v FROM orders),
known AS (SELECT meter, month, max(v) AS demand FROM o GROUP BY ALL), spine AS (SELECT meter, unnest(range(min(month), max(month) + 1))::INT AS month FROM o GROUP BY meter)
SELECT s.meter, s.month, greatest(coalesce(k.demand, 0), coalesce((SELECT round((max(p.demand) * 0.80)::DECIMAL(28,4), 2) FROM known p WHERE p.meter = s.meter AND p.month BETWEEN s.month - 11 AND s.month - 1), 0))::DOUBLE AS billed FROM spine s LEFT JOIN known k ON k.meter = s.meter AND k.month = s.month""",
    "x21_budget_balance": "SELECT o_orderkey, o_custkey, sum(o_totalprice::DECIMAL(18,2) - 150000.00) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS balance FROM orders",
}

_TIER = "CASE WHEN {fatal} THEN 'full_review' WHEN {s} >= CASE WHEN complexity_tier IN ('complex', 'pathological') THEN 0.90 ELSE 0.95 END::DOUBLE THEN 'auto_accept' WHEN {s} >= CASE WHEN complexity_tier IN ('complex', 'pathological') THEN 0.75 ELSE 0.82 END::DOUBLE THEN 'targeted_review' ELSE 'full_review' END"

_ON_MODEL = {
    "flagship_route": f"""SELECT extraction_id, disposition, n_issues, score, labels, {_TIER.format(fatal="false", s="score")} AS tier, CASE WHEN {_TIER.format(fatal="false", s="score")} = 'auto_accept' THEN 'accepted' ELSE 'pending_review' END AS routed_status
FROM (SELECT extraction_id, complexity_tier, greatest(0, 1 - 0.03 * count(*) FILTER (WHERE severity = 'warning'))::DOUBLE AS score, coalesce(string_agg(DISTINCT CASE WHEN severity = 'warning' THEN rule_id END, ',' ORDER BY CASE WHEN severity = 'warning' THEN rule_id END), '') AS labels FROM bills LEFT JOIN issues USING (extraction_id) GROUP BY ALL) JOIN disposed USING (extraction_id)""",
    "a05_dedup_against_store": "SELECT file_hash, extraction_id, status FROM latest WHERE status IN ('accepted', 'pending_review')",
    "a06_import_upsert": """SELECT extraction_id, CASE WHEN extraction_id % 3 = 0 THEN 'reviewed' ELSE status END AS status, CASE WHEN extraction_id % 3 = 0 THEN 0.5 ELSE confidence_score END AS confidence_score, CASE WHEN extraction_id % 2 <> 0 THEN 'new' ELSE utility_provider END AS utility_provider FROM extractions WHERE extraction_id % 2 = 0 OR extraction_id % 3 = 0""",
    "b01_list_extractions": "SELECT extraction_id, created_at, utility_provider FROM extractions WHERE commodity_type = 'natural_gas' AND status = 'accepted' ORDER BY created_at DESC, extraction_id LIMIT 100 OFFSET 10",
    "b02_review_queue": "SELECT extraction_id, confidence_score FROM extractions WHERE status = 'pending_review' ORDER BY confidence_score, extraction_id LIMIT 80",
    "b04_list_corrections": "SELECT correction_id, field_path, category FROM categorized",
    "b05_list_calls": "SELECT call_id, model, CASE WHEN length(response) > 200 THEN left(response, 200) || '...' ELSE response END AS preview FROM calls WHERE stage = 'click' ORDER BY created_at DESC, call_id LIMIT 120",
    "b06_calls_by_extraction": "SELECT extraction_id, call_id, stage, created_at, row_number() OVER (PARTITION BY extraction_id ORDER BY created_at, call_id)::INT AS place FROM calls WHERE extraction_id IS NOT NULL",
    "b07_corrections_by_context": "SELECT correction_id, field_path FROM corrections WHERE utility = 'City Gas' AND commodity = 'natural_gas' QUALIFY count(*) OVER (PARTITION BY field_path) >= 20",
    "b09_confidence_band": "SELECT CASE WHEN confidence_score >= 0.9::DOUBLE THEN 'green' WHEN confidence_score >= 0.7::DOUBLE THEN 'yellow' ELSE 'red' END AS band, count(*) AS n FROM extractions GROUP BY 1",
    "b12_approve_green": "SELECT CASE WHEN confidence_score >= 0.9::DOUBLE THEN 'accepted' ELSE 'partial' END AS status, count(*) AS n FROM extractions GROUP BY 1",
    "b15_last_corrections": "SELECT extraction_id, field_path, correction_id, corrected_value FROM corrections QUALIFY row_number() OVER (PARTITION BY extraction_id, field_path ORDER BY created_at DESC, correction_id DESC) = 1",
    "c01_corrections_with_context": "SELECT utility_provider AS utility, commodity_type AS commodity, count(*) AS n FROM corrections JOIN extractions USING (extraction_id) GROUP BY 1, 2",
    "c02_calls_with_extractions": "SELECT stage, status, count(*) AS n FROM calls LEFT JOIN extractions USING (extraction_id) GROUP BY 1, 2",
    "c06_tolerance": "SELECT extraction_id, base::DOUBLE AS base, tax::DOUBLE AS tax FROM bills",
    "c11_not_seen": "SELECT DISTINCT file_hash FROM extractions WHERE file_hash NOT IN (SELECT file_hash FROM latest WHERE status IN ('accepted', 'pending_review'))",
    "c14_field_weight": "SELECT DISTINCT field_path, CASE WHEN contains(field_path, 'account_number') THEN 'fatal' ELSE 'low' END AS weight, CASE WHEN contains(field_path, 'account_number') THEN 1.0 ELSE 0.03 END::DOUBLE AS penalty FROM corrections",
    "c16_previous_run": "SELECT extraction_id, previous_id, previous_score, previous_status FROM pairs",
    "d01_count_by_status": "SELECT status, count(*) AS n FROM extractions GROUP BY 1",
    "d03_field_path_groups": "SELECT field_path, any_value(total) AS n, string_agg(coalesce(extracted_value, '∅') || '>' || corrected_value, '|' ORDER BY rn) AS examples FROM (SELECT *, count(*) OVER (PARTITION BY field_path) AS total, row_number() OVER (PARTITION BY field_path ORDER BY created_at DESC, correction_id DESC) AS rn FROM corrections) WHERE rn <= 5 GROUP BY 1",
    "d05_correction_rules": """SELECT f.field_path, total, total >= 2 AS active, category, patterns, last_at FROM (SELECT field_path, count(*) AS total, max(created_at) AS last_at FROM corrections GROUP BY 1) f
JOIN (SELECT field_path, category FROM (SELECT field_path, coalesce(nullif(correction_category, ''), 'other') AS category, count(*) AS n FROM corrections GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY field_path ORDER BY n DESC, category) = 1) m USING (field_path)
JOIN (SELECT field_path, string_agg(e || '>' || c || ' x' || n, '|' ORDER BY rn) AS patterns FROM (SELECT *, row_number() OVER (PARTITION BY field_path ORDER BY n DESC, e, c) AS rn FROM (SELECT field_path, coalesce(extracted_value, '∅') AS e, corrected_value AS c, count(*) AS n FROM corrections GROUP BY 1, 2, 3)) WHERE rn <= 5 GROUP BY 1) p USING (field_path)""",
    "d06_rules_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE n >= 2) AS active, count(*) FILTER (WHERE n < 2) AS pending FROM (SELECT field_path, count(*) AS n FROM corrections GROUP BY 1)",
    "d07_correction_stats": "SELECT category, field_path, count(*) AS n FROM (SELECT coalesce(nullif(correction_category, ''), 'uncategorized') AS category, field_path FROM corrections) GROUP BY GROUPING SETS ((category), (field_path), ())",
    "d08_calls_by_stage": "SELECT stage, count(*) AS n_calls, nullif(round(avg(duration_ms))::BIGINT, 0) AS avg_duration_ms, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens FROM calls GROUP BY 1",
    "d09_calls_by_model": "SELECT model, count(*) AS n_calls, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM calls GROUP BY 1",
    "d10_call_cost": f"""SELECT model, CASE WHEN model IS NULL THEN round(c, 4)::DOUBLE ELSE round(c, 6)::DOUBLE END AS cost FROM (SELECT model, (sum(input_tokens * coalesce(a, {dims.DEFAULT_PRICE[0]}) + output_tokens * coalesce(b, {dims.DEFAULT_PRICE[1]}))::DECIMAL(28,6) * 0.001)::DECIMAL(38,9) AS c FROM calls LEFT JOIN (VALUES {", ".join(f"('{m}', {a}, {b})" for m, a, b in dims.PRICES)}) p(m, a, b) ON model = m GROUP BY ROLLUP (model))""",
    "d11_section_sums": "SELECT extraction_id, charge_section, sum(amount)::DOUBLE AS computed, count(*) AS n_lines FROM charges GROUP BY GROUPING SETS ((extraction_id, charge_section), (extraction_id))",
    "d13_vat_by_rate": "SELECT extraction_id, vat_rate::DOUBLE AS vat_rate, sum(amount_net)::DOUBLE AS base_sum, sum(vat_amount)::DOUBLE AS vat_sum FROM vat GROUP BY 1, 2",
    "d14_distinct_owners": "SELECT extraction_id, count(DISTINCT charge_owner) AS owners FROM charges GROUP BY 1",
    "d18_fingerprint_accuracy": "SELECT utility_provider, commodity_type, count(*) AS processed, round(avg((status = 'accepted')::INT), 6) AS accuracy FROM extractions GROUP BY 1, 2",
    "d19_rule_candidates": """SELECT field_path, n, s AS suggestion, CASE WHEN s LIKE '%extracted' THEN mean END AS mean_off FROM (SELECT field_path, n, CASE WHEN k = a AND lo > 0 THEN 'under_extracted' WHEN k = a AND hi < 0 THEN 'over_extracted' WHEN regexp_matches(field_path, 'category|section') THEN 'classification' ELSE 'generic' END AS s, round(total / k, 2) AS mean
FROM (SELECT field_path, n, count(off) AS k, count(*) AS a, min(off) AS lo, max(off) AS hi, sum(off) AS total FROM (SELECT *, TRY_CAST(nullif(corrected_value, '') AS DECIMAL(18,2)) - TRY_CAST(extracted_value AS DECIMAL(18,2)) AS off, count(*) OVER (PARTITION BY field_path) AS n, row_number() OVER (PARTITION BY field_path ORDER BY created_at DESC, correction_id DESC) AS rn FROM corrections) WHERE n >= 5 AND rn <= 3 GROUP BY 1, 2))""",
    "d20_unique_categories": "SELECT DISTINCT correction_category FROM corrections",
    "d16_disposition": "SELECT disposition, count(*) AS n FROM disposed GROUP BY 1",
    "g14_complexity": """SELECT extraction_id, score, CASE WHEN score <= 2 THEN 'simple' WHEN score <= 6 THEN 'standard' WHEN score <= 10 THEN 'complex' ELSE 'pathological' END AS tier FROM (SELECT extraction_id, (CASE WHEN extraction_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN extraction_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN extraction_id % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN extraction_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN extraction_id % 40 > 30 THEN 3 WHEN extraction_id % 40 > 15 THEN 1 ELSE 0 END + CASE WHEN extraction_id % 8 > 5 THEN 2 ELSE 0 END)::INT AS score FROM extractions)""",
    "g12_convert_units": """SELECT extraction_id, round(v, 4) AS converted, CASE WHEN v IS NULL THEN CASE WHEN f IN ('m³', 'kWh') AND t IN ('m³', 'kWh') THEN 'no calorific value' ELSE 'no factor' END END AS unit_error FROM (SELECT *, CASE WHEN f = t THEN raw_value WHEN f = 'm³' AND t = 'kWh' THEN raw_value * c WHEN f = 'therms' AND t = 'kWh' THEN raw_value * 29.3071::DOUBLE WHEN f = 'CCF' AND t = 'therms' THEN raw_value * 1.037::DOUBLE WHEN f = 'MWh' AND t = 'kWh' THEN raw_value * 1000 WHEN f = 'gallons' AND t = 'm³' THEN raw_value * 0.00378541::DOUBLE END AS v
FROM (SELECT extraction_id, raw_value, ['therms','CCF','MWh','m³','gallons'][extraction_id % 5 + 1] AS f, ['kWh','therms','m³'][extraction_id % 3 + 1] AS t, CASE WHEN extraction_id % 10 <> 0 THEN 11.5::DOUBLE END AS c FROM meters))""",
    "g16_correction_category": "SELECT inferred, count(*) AS n FROM categorized GROUP BY 1",
    "k02_tier": f"SELECT extraction_id, {_TIER.format(fatal='extraction_id % 11 = 0', s='confidence_score')} AS tier FROM extractions",
    "k05_audit_compare": "SELECT extraction_id, 'total_amount_due' AS field, 'fatal' AS severity FROM extractions WHERE extraction_id % 5 = 0 UNION ALL SELECT extraction_id, 'account_number', 'fatal' FROM extractions WHERE extraction_id % 5 = 2",
    "l02_top_fields": "SELECT field_path, count(*) AS n FROM corrections GROUP BY 1 ORDER BY n DESC, field_path LIMIT 10",
    "m02_few_shot_context": f""", g AS (SELECT utility, commodity, field_path, count(*) AS n FROM categorized GROUP BY 1, 2, 3 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY utility, commodity ORDER BY n DESC, field_path) <= 5),
c AS (SELECT utility, commodity, field_path, category FROM (SELECT utility, commodity, field_path, category, count(*) AS k FROM categorized GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY utility, commodity, field_path ORDER BY k DESC, category) = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY utility, commodity, field_path ORDER BY created_at, correction_id) AS rn FROM categorized QUALIFY rn <= 3),
l AS (SELECT utility, commodity, field_path, string_agg('- `' || coalesce(extracted_value, 'none') || '` -> `' || coalesce(corrected_value, 'none') || '`' || CASE WHEN correction_category = 'ocr_confusion' THEN ' (seen on the scan)' ELSE '' END, chr(10) ORDER BY rn) AS lines FROM e GROUP BY 1, 2, 3),
m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in MEANING.items())}) t(category, meaning)),
b AS (SELECT g.*, '### ' || field_path || ' (' || n || ' corrections)' || coalesce(': ' || meaning, '') || chr(10) || 'Why: ' || split_part(field_path, '.', -1) || ': '
    || CASE WHEN c.category = 'format_normalize' AND starts_with(f.a, f.b) AND length(f.b) < length(f.a) THEN 'trailing ''' || substr(f.a, length(f.b)::INT + 1) || ''' removed' ELSE coalesce(meaning, 'another correction') END || chr(10) || lines AS block
  FROM g JOIN c USING (utility, commodity, field_path) JOIN l USING (utility, commodity, field_path) JOIN (SELECT utility, commodity, field_path, extracted_value AS a, corrected_value AS b FROM e WHERE rn = 1) f USING (utility, commodity, field_path) LEFT JOIN m ON m.category = c.category)
SELECT utility, commodity, context, sha256(context) AS context_hash FROM (SELECT utility, commodity, '## Known corrections' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY n DESC, field_path) AS context FROM b GROUP BY 1, 2)""",
    "m03_fingerprint_candidates": "SELECT lower(utility_provider) AS utility, lower(commodity_type) AS commodity, count(*) AS n FROM extractions WHERE (lower(utility_provider), lower(commodity_type)) NOT IN (('nation_1', 'water'), ('nation_3', 'electricity')) GROUP BY 1, 2 HAVING count(*) >= 3",
    "r01_drift": "SELECT extraction_id, previous_id, field_path, old_value, new_value, severity FROM changed",
    "r02_drift_severity": "SELECT extraction_id, previous_id, count(*) AS n_changes, ['low','medium','high','fatal'][max(r) + 1] AS severity, max(r) = 0 AS all_low, string_agg(field_path, ',' ORDER BY field_path) AS fields FROM changed GROUP BY 1, 2",
    "u01_issue_counts": "SELECT rule_id, severity, count(*) AS n FROM issues GROUP BY 1, 2",
    "u02_audit_questions": "SELECT extraction_id, unnest(['total_amount_due','account_number','billing_period','meter_count','utility']) AS field_to_check FROM extractions UNION ALL SELECT extraction_id, 'demand_value' FROM extractions WHERE has_demand_charges UNION ALL SELECT extraction_id, 'supplier_name' FROM extractions WHERE has_supplier_split UNION ALL SELECT extraction_id, 'calorific_value' FROM extractions WHERE commodity_type = 'natural_gas'",
    "v01_line_math": "SELECT * FROM v01 WHERE severity IS NOT NULL",
    "v02_section_totals": "SELECT extraction_id, 'V02' AS rule_id, 'totals.' || charge_section AS field, 'warning' AS severity, s::VARCHAR AS expected, (s + 0.30)::DECIMAL(18,2)::VARCHAR AS actual FROM (SELECT extraction_id, charge_section, sum(amount)::DECIMAL(18,2) AS s FROM charges WHERE charge_section <> 'other' GROUP BY 1, 2) JOIN bills USING (extraction_id) WHERE extraction_id % 4 = 0 AND 0.30 > 2 * base",
    "v03_current_charges": "SELECT * FROM v03 WHERE severity IS NOT NULL",
    "v04_meter_reads": "SELECT extraction_id, 'V04' AS rule_id, 'warning' AS severity FROM meters WHERE abs((current_read - previous_read) * mult - raw_value) > 1",
    "v06_unit_mismatch": "SELECT extraction_id, CASE commodity_type WHEN 'electricity' THEN 'V06' ELSE 'V07' END AS rule_id, 'meters.unit' AS field, 'fatal' AS severity, commodity_type AS expected, raw_unit AS actual FROM meters WHERE (commodity_type = 'electricity' AND raw_unit IN ('therms', 'ccf')) OR (commodity_type = 'natural_gas' AND raw_unit = 'kWh' AND country_code = 'US')",
    "v08_billing_days": "SELECT * FROM v08",
    "v09_negative_amounts": "SELECT * FROM v09",
    "v10_demand_missing": "SELECT * FROM v10",
    "v12_single_owner": "SELECT * FROM v12",
    "v13_vat_lines": """SELECT extraction_id, 'V13' AS rule_id, 'charges.' || line_number AS field, CASE WHEN reverse_charge THEN CASE WHEN vat_amount <> 0 THEN 'warning' END WHEN case_no IN (5, 6) THEN 'error' END AS severity, round((amount_net * vat_rate)::DECIMAL(28,4), 2)::DECIMAL(18,2)::VARCHAR AS expected, vat_amount::VARCHAR AS actual FROM vat WHERE (reverse_charge AND vat_amount <> 0) OR case_no IN (5, 6)
UNION ALL SELECT extraction_id, 'V14', 'charges.' || line_number, 'error', (amount_net + vat_amount)::DECIMAL(18,2)::VARCHAR, (amount_net + vat_amount + 0.10)::DECIMAL(18,2)::VARCHAR FROM vat WHERE case_no = 7""",
    "v15_vat_summary": "SELECT extraction_id, 'V15' AS rule_id, 'vat_summary.' || vat_rate AS field, 'warning' AS severity, sum(amount_net)::DECIMAL(18,2)::VARCHAR AS expected, (sum(amount_net) + 0.20)::DECIMAL(18,2)::VARCHAR AS actual FROM vat WHERE vat_rate > 0.02 AND extraction_id % 5 = 0 GROUP BY extraction_id, vat_rate",
    "v18_gas_factors": """SELECT extraction_id, 'V18' AS rule_id, 'meters.calorific_value' AS field, 'warning' AS severity FROM meters WHERE cv NOT BETWEEN 8 AND 14
UNION ALL SELECT extraction_id, 'V18', 'meters.volume_correction_factor', 'warning' FROM meters WHERE vcf <> 1 AND (vcf < 0.9::DOUBLE OR vcf > 1.1::DOUBLE)
UNION ALL SELECT extraction_id, 'V19', 'meters.energy', 'error' FROM meters WHERE cv IS NOT NULL AND (energy = 0 OR abs((volume * vcf * cv - energy) / energy) > 0.02::DOUBLE)""",
    "v20_domain_check": """SELECT extraction_id, 'commodity_type' AS field, 'warning' AS severity FROM extractions WHERE extraction_id % 9 = 0 UNION ALL SELECT extraction_id, 'confidence_score', 'warning' FROM extractions WHERE extraction_id % 10 = 3 OR extraction_id % 10 = 7 UNION ALL SELECT extraction_id, 'complexity_tier', 'warning' FROM extractions WHERE extraction_id % 25 = 1""",
    "w01_latest_per_hash": "SELECT file_hash, extraction_id, created_at FROM latest",
    "x03_amount_sanity": """SELECT extraction_id, 'totals.total_amount_due' AS field, 'fatal' AS severity FROM extractions WHERE extraction_id % 51 = 0 OR (extraction_id % 50 = 0 AND stated_total * 10 > 1000000)
UNION ALL SELECT extraction_id, 'original_string', 'warning' FROM extractions WHERE extraction_id % 6 IN (1, 5)""",
    "x14_kpi": "SELECT strftime(created_at, '%Y-%m') AS month, commodity_type, count(*) AS n, round(avg((status = 'accepted')::INT), 6) AS accept_rate, round(avg((confidence_score < 0.7::DOUBLE)::INT), 6) AS low_rate FROM extractions GROUP BY 1, 2",
    "x20_block_allocation": "SELECT extraction_id, block, least(raw_value, hi) - lo AS part, round((least(raw_value, hi) - lo) * price, 2) AS cost FROM meters JOIN (VALUES (1, 0::DOUBLE, 100::DOUBLE, 0.10::DOUBLE), (2, 100, 500, 0.15), (3, 500, 'inf', 0.20)) b(block, lo, hi, price) ON raw_value > lo",
}

_ON_MODEL |= {
    "b11_status_update": "SELECT extraction_id, CASE WHEN status = 'pending_review' AND extraction_id % 10 = 0 THEN 'accepted' ELSE status END AS status, confidence_score FROM extractions",
    "b14_correction_patch": "SELECT correction_id, CASE WHEN correction_id % 14 = 0 THEN 'new' ELSE corrected_value END AS corrected_value, CASE WHEN correction_id % 7 = 0 THEN 'fixed' ELSE correction_category END AS correction_category FROM corrections WHERE correction_id % 11 <> 0",
    "b16_document_to_rows": "SELECT extraction_id, count(*) AS n, sum(amount)::DOUBLE AS amount, round(sum(CASE WHEN line_number % 5 = 2 THEN 0.9 ELSE 0.7 END)::DOUBLE, 3) AS confidence, count(*) FILTER (WHERE line_number % 5 = 1) AS n_other, 0::BIGINT AS n_corrupt, count(*) AS n_dates, count(*) FILTER (WHERE line_number % 5 = 0) AS n_numbered FROM charges GROUP BY 1",
    "b18_validation_flags": """SELECT extraction_id, count(*) FILTER (WHERE rule_id = 'V01') = 0 AS lines_ok, count(*) FILTER (WHERE rule_id IN ('V02', 'V03')) = 0 AS totals_ok, count(*) FILTER (WHERE rule_id IN ('V06', 'V07')) = 0 AS units_ok, count(*) FILTER (WHERE rule_id IN ('V08', 'V09', 'V10', 'V12')) = 0 AS logic_ok, coalesce(string_agg(DISTINCT CASE WHEN severity = 'fatal' THEN 'fatal:' || field END, ','), '') AS fatal_flags
FROM extractions LEFT JOIN (SELECT extraction_id, rule_id, severity, field FROM issues UNION ALL SELECT extraction_id, CASE commodity_type WHEN 'electricity' THEN 'V06' ELSE 'V07' END, 'fatal', 'meters.unit' FROM meters WHERE (commodity_type = 'electricity' AND raw_unit IN ('therms', 'ccf')) OR (commodity_type = 'natural_gas' AND raw_unit = 'kWh' AND country_code = 'US')) USING (extraction_id) GROUP BY 1""",
    "d23_mismatch_counts": "SELECT extraction_id, c AS checked, c - m AS matched, m AS mismatched FROM (SELECT extraction_id, CASE WHEN extraction_id % 5 = 4 THEN 1 ELSE 2 END::BIGINT AS c, CASE WHEN extraction_id % 5 IN (0, 2) THEN 1 ELSE 0 END::BIGINT AS m FROM extractions)",
    "g13_within_tolerance": "SELECT country_code, count(*) FILTER (WHERE abs(expected - actual) <= i.base) AS within_base, count(*) FILTER (WHERE abs(expected - actual) <= tax) AS within_tax, count(*) AS n FROM line_issues i JOIN bills USING (extraction_id) GROUP BY 1",
    "k03_international_score": f"""SELECT extraction_id, score, labels, {_TIER.format(fatal="false", s="score")} AS tier FROM (SELECT extraction_id, complexity_tier, greatest(0, 1 - a - b - c - d - e)::DOUBLE AS score,
array_to_string(list_filter([CASE WHEN b > 0 THEN 'ambiguous_dates' END, CASE WHEN d > 0 THEN 'conversion' END, CASE WHEN e > 0 THEN 'language' END, CASE WHEN a > 0 THEN 'number_format' END, CASE WHEN c > 0 THEN 'vat' END], lambda x: x IS NOT NULL), ',') AS labels
FROM (SELECT *, CASE WHEN extraction_id % 10 < 7 THEN 0.10 ELSE 0 END AS a, (extraction_id % 3) * 0.05 AS b, CASE WHEN extraction_id % 7 = 0 THEN 0.12 ELSE 0 END AS c, CASE WHEN extraction_id % 11 = 0 THEN 0.30 ELSE 0 END AS d, CASE WHEN extraction_id % 4 = 2 THEN 0.05 ELSE 0 END AS e FROM extractions))""",
    "k06_audit_fill": """SELECT field_to_check, sum(n)::BIGINT AS asked, sum(a)::BIGINT AS answered FROM (SELECT unnest(['total_amount_due','account_number','billing_period','meter_count','utility']) AS field_to_check, 1 AS n, unnest([CASE WHEN extraction_id % 5 = 4 THEN 0 ELSE 1 END, 1, 0, 0, 0]) AS a FROM extractions
UNION ALL SELECT 'demand_value', 1, 0 FROM extractions WHERE has_demand_charges UNION ALL SELECT 'supplier_name', 1, 0 FROM extractions WHERE has_supplier_split UNION ALL SELECT 'calorific_value', 1, 0 FROM extractions WHERE commodity_type = 'natural_gas') GROUP BY 1""",
    "m01_load_corrections": "SELECT correction_id, category, utility, commodity FROM categorized ORDER BY created_at DESC, correction_id DESC LIMIT 1000",
    "r03_drift_cause": """SELECT extraction_id, previous_id, CASE WHEN (extraction_id % 5 = 4) <> (previous_id % 5 = 4) THEN 'model_changed' WHEN extraction_id % 3 <> previous_id % 3 THEN 'prompt_changed' WHEN extraction_id % 2 <> previous_id % 2 THEN 'few_shot_changed' WHEN max(r) = 0 THEN 'sampling' ELSE 'unknown' END AS cause FROM changed GROUP BY 1, 2""",
    "x02_contracted_capacity": "SELECT extraction_id, extraction_id % 100 AS demand_value, extraction_id % 70 AS contracted_value FROM extractions WHERE extraction_id % 100 > extraction_id % 70 AND extraction_id NOT IN (SELECT extraction_id FROM charges WHERE category = 'demand')",
    "x10_single_meter_linkage": "SELECT CASE WHEN line_number = 1 THEN 'own' WHEN extraction_id % 3 <> 0 THEN 'M' || extraction_id % 500 END AS meter_number, count(*) AS n FROM charges GROUP BY 1",
    "x11_merged_extractions": "SELECT extraction_id, CASE WHEN extraction_id % 2 = 0 AND extraction_id % 5 > extraction_id % 7 THEN 'b' ELSE 'a' END AS value, (CASE WHEN extraction_id % 2 = 0 THEN greatest(extraction_id % 7, extraction_id % 5) ELSE extraction_id % 7 END / 10)::DOUBLE AS confidence FROM extractions",
    "x13_candidate_confidence": "SELECT e.utility_provider AS utility, field_path, category, count(DISTINCT extraction_id) AS n, round(count(DISTINCT extraction_id) / any_value(total), 6) AS confidence FROM categorized c JOIN extractions e USING (extraction_id) JOIN (SELECT utility_provider, count(*) AS total FROM extractions GROUP BY 1) t ON t.utility_provider = e.utility_provider GROUP BY 1, 2, 3",
    "x23_net_metering": "SELECT extraction_id FROM extractions WHERE extraction_id % 9 = 0",
}

_CODES = list(locale.KEYWORDS)
_PLAIN |= {
    "g05_detect_country": f"SELECT o_orderkey, {_CODES}[o_orderkey % {len(_CODES)} + 1] AS country_code FROM orders",
    "g06_detect_locale": "SELECT o_orderkey, 'DE' AS country_code, 'EUR' AS currency, 'US' AS number_format, 'DD.MM.YYYY' AS date_format, 'eu_vat' AS tax_regime FROM orders",
    "g24_template_version": "SELECT item_id, 'v1.0-' || left(sha256(text), 8) AS version FROM benchmark",
    "x01_account_balance": "SELECT * FROM (SELECT o_orderkey AS extraction_id, (o_totalprice::DECIMAL(18,2) + CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END)::DOUBLE AS expected, (o_totalprice::DECIMAL(18,2) + CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END)::DOUBLE AS amount_due FROM orders) WHERE abs(expected - amount_due) > 0.5",
    "x19_sewer_cap": "WITH m AS (SELECT o_custkey % 30 AS account, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*)::DOUBLE AS usage FROM orders GROUP BY ALL), w AS (SELECT account, CASE WHEN month = 12 THEN year + 1 ELSE year END AS year, round(avg(usage), 2) AS cap FROM m WHERE month IN (12, 1, 2, 3) GROUP BY ALL) SELECT m.account, m.year, m.month, least(usage, coalesce(cap, usage)) AS billed FROM m LEFT JOIN w USING (account, year)",
    "x22_tou_periods": "SELECT 'M' || l_suppkey % 20 AS meter_number, ['peak','off_peak','peak','shoulder','off_peak','odd'][l_linenumber % 6 + 1] AS std_period, sum(l_quantity) AS consumption FROM lineitem GROUP BY 1, 2",
}

_ON_MODEL |= {
    "a18_reprocess_select": "SELECT extraction_id, file_hash FROM extractions WHERE extraction_id % 6 = 0 AND file_hash IN (SELECT file_hash FROM extractions WHERE extraction_id % 5 = 0)",
    "b13_result_update": "SELECT extraction_id, CASE WHEN extraction_id % 4 = 0 THEN 0.99::DOUBLE ELSE confidence_score END AS confidence_score, CASE WHEN extraction_id % 8 = 0 THEN 'simple' ELSE complexity_tier END AS complexity_tier FROM extractions",
    "d15_any_demand": "SELECT extraction_id, extraction_id IN (SELECT extraction_id FROM charges WHERE category = 'demand') AS any_demand FROM extractions",
    "d21_token_total": "SELECT sum(total_tokens)::BIGINT AS total_tokens FROM calls",
    "g15_signal_flags": "SELECT extraction_id, extraction_id % 2 = 0 AS has_demand_charges, extraction_id % 3 = 0 AS has_tou_present, false AS has_supplier_split, extraction_id % 5 = 0 AS has_net_metering, false AS has_prior_period_adjustments FROM extractions",
    "g17_category_reasoning": "SELECT correction_id, string_split(field_path, '.')[-1] || ': ' || CASE inferred WHEN 'format_normalize' THEN 'format evened out' WHEN 'missing_context' THEN 'context was missed' WHEN 'calculation_error' THEN 'wrong arithmetic' ELSE 'another correction' END AS reasoning FROM inferred",
    "x09_charge_period": "SELECT extraction_id, min(a)::DATE::VARCHAR AS first_day, max(b)::DATE::VARCHAR AS last_day FROM (SELECT l_orderkey AS extraction_id, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate ELSE o_orderdate END::DATE AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE + 7 ELSE o_orderdate::DATE + 30 END AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1",
    "x16_mx_iva": "SELECT extraction_id, round((net * 1.16)::DECIMAL(28,4), 2)::DOUBLE AS expected FROM (SELECT o_orderkey AS extraction_id, (o_orderkey % 5000 + 10)::DECIMAL(18,2) AS net FROM orders) JOIN extractions USING (extraction_id) WHERE country_code = 'MX' AND extraction_id % 3 = 0",
}
_PLAIN |= {
    "a15_unsupported_rows": "SELECT coalesce(l_linenumber, 1) AS page_number, count(*) AS n, count(l_linestatus) AS n_text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "l01_newest_page": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 40",
    "x04_date_verdict": f"SELECT o_orderkey, CASE WHEN days < 0 OR days > 400 THEN 'fatal' ELSE 'warning' END AS severity FROM (SELECT o_orderkey, any_value(dd) AS dd, any_value(mm) AS mm, date_diff('day', any_value(o_orderdate)::DATE, max(l_shipdate)::DATE) AS days FROM ({_ORDERS}) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) WHERE days < 0 OR days > 400 OR (days > 95 AND dd <= 12 AND dd <> mm)",
    "x12_weighted_confidence": "SELECT extraction_id, c AS confidence, c < 0.7::DOUBLE AS low FROM (SELECT l_orderkey AS extraction_id, round(sum(w * (1 - l_discount)) FILTER (WHERE l_linenumber <> 5) / sum(w) FILTER (WHERE l_linenumber <> 5), 6) AS c FROM (SELECT *, [1.0, 1.5, 2.0, 3.0][l_linenumber % 4 + 1]::DOUBLE AS w FROM lineitem) GROUP BY 1)",
    "x17_swiss_amounts": "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders",
}

SQL = _PLAIN | {name: f"{MODEL}{sql}" for name, sql in _ON_MODEL.items()}
