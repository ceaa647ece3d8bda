"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations

from .licenses import LICENSES, SPELLINGS


def _folded(line: str) -> str:
    return f"regexp_replace(lower(regexp_replace({line}, '\\([cC]\\)', '©', 'g')), '[\\x00-\\x1F !-/:-@\\[-`{{-~]+', ' ', 'g')"


def _usual(x: str) -> str:
    for other, usual in SPELLINGS:
        x = f"regexp_replace({x}, '(^| ){other}( |$)', '\\1{usual}\\2', 'g')"
    return f"trim({x}, ' ')"


#: Keeps the lines that say more than whose copyright it is.
_SAYS = "NOT regexp_matches(f, '^ ?(copyright|©|all rights reserved)( ©)?( [0-9]| by | ©|$)')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = {
    "op8_license_scan": f"""
WITH known AS (
  SELECT sha256(string_agg(c, ' ' ORDER BY line_no)) AS digest, any_value(license) AS license FROM (
    SELECT n, license, line_no, {_usual("f")} AS c FROM (SELECT n, license, line_no, {_folded("l")} AS f FROM (
      SELECT n, license, unnest(string_split(wording, chr(10))) AS l, generate_subscripts(string_split(wording, chr(10)), 1) AS line_no
      FROM (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(w)})" for i, (n, w) in enumerate(LICENSES))}) v(n, license, wording))) WHERE {_SAYS}) WHERE c <> '' GROUP BY n),
lines AS (
  SELECT doc_id, line_no, {_usual("f")} AS c FROM (SELECT doc_id, line_no, {_folded("l")} AS f FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)) WHERE {_SAYS}),
whole AS (SELECT doc_id, sha256(string_agg(c, ' ' ORDER BY line_no)) AS text_digest FROM lines WHERE c <> '' GROUP BY doc_id),
found AS (SELECT doc_id, license, count(*) AS n FROM lines JOIN known ON sha256(c) = digest WHERE c <> '' GROUP BY doc_id, license),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices, sum(n)::BIGINT AS n_notices FROM found GROUP BY doc_id)
SELECT d.doc_id, text_digest, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM documents d LEFT JOIN whole USING (doc_id) LEFT JOIN known ON text_digest = digest LEFT JOIN notices n ON n.doc_id = d.doc_id"""
}
