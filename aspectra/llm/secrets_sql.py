"""DuckDB twin of the secret scan: its own patterns, without look-around, and plain comparisons of every two spans of a text."""

from __future__ import annotations


def either(pattern: str) -> str:
    """The pattern with its ASCII letters in either case, and no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


_IS = r"""["']?\x20*[:=]\x20*["']?"""
_OPEN = r"""[^\t\n\x0B\f\r\x20"'<>]"""
_NAMED = f"(?:{either('password|passwd|secret|token|api_?key')})"
_SCHEMES = f"(?:{either('https?|ftp')}|{either('jdbc')}:[A-Za-z0-9]+|{either('amqps?|redis|mongodb')})"
#: name, order, pattern, class of part; of runs that may be weak secrets, those without a digit are dropped later.
_KINDS = (
    ("assign", 0, f"{_NAMED}{_IS}[A-Za-z0-9+/_.=-]+", "secret"),
    ("access", 1, "AKIA[A-Z0-9]{16,}", "id"),
    ("hex", 2, "[0-9a-f]{24,}", "secret"),
    ("weak_id", 3, f"(?:{either('access|client|account|user|login')})[_-]?(?:{either('key')}[_-]?)?(?:{either('id|name')})?{_IS}[A-Za-z0-9_@.-]{{4,}}", "id"),
    ("weak_secret", 4, "[A-Za-z0-9+/_-]{20,}={0,2}", "secret"),
    ("endpoint", 5, f"{_SCHEMES}://{_OPEN}+|(?:{either('host|endpoint|server|url')}){_IS}{_OPEN}{{4,}}", "endpoint"),
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def twin(scope: int = 200) -> str:
    """Rows of ``op10_secrets``."""
    found = " UNION ALL ".join(
        f"SELECT id, '{kind}' AS kind, {order} AS ord, '{part}' AS part, regexp_extract_all(text, {_text(f'(?s)(.*?)({pattern})')}, 1) AS gaps, regexp_extract_all(text, {_text(f'(?s)(.*?)({pattern})')}, 2) AS hits FROM t WHERE regexp_matches(text, {_text(pattern)})"
        for kind, order, pattern, part in _KINDS
    )
    near = f"p.id = w.id AND p.first - w.last <= {scope} AND w.first - p.last <= {scope}"
    listed = "string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, ord, last)"
    sql = f"""WITH t AS (SELECT row_number() OVER () AS id, text FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
f AS ({found}),
e AS (SELECT id, kind, ord, part, unnest(gaps) AS gap, unnest(hits) AS value, unnest(range(len(hits))) AS place FROM f),
m AS (SELECT id, kind, ord, part, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY id, ord ORDER BY place) AS BIGINT) AS last FROM e),
s AS (SELECT id, kind, ord, part, value, last - length(value) AS first, last FROM m),
base AS (SELECT * FROM s WHERE ord IN (1, 2) OR (ord = 0 AND length(regexp_extract(value, {_text(f"^{_NAMED}{_IS}([A-Za-z0-9+/_.=-]+)$")}, 1)) >= 6)),
weak AS (SELECT * FROM s w WHERE ord > 2 AND (ord <> 4 OR (regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '^[0-9./_-]+$'))) AND NOT EXISTS (SELECT 1 FROM base p WHERE p.id = w.id AND w.first < p.last AND p.first < w.last)),
parts AS (SELECT id, part, first, last FROM base UNION ALL SELECT id, part, first, last FROM weak WHERE ord < 5),
pairs AS (SELECT * FROM weak w WHERE ord < 5 AND EXISTS (SELECT 1 FROM parts p WHERE {near} AND p.part <> w.part)),
told AS (SELECT id, first, last FROM base WHERE part = 'secret' UNION ALL SELECT id, first, last FROM pairs WHERE part = 'secret'),
ends AS (SELECT * FROM weak w WHERE ord = 5 AND EXISTS (SELECT 1 FROM told p WHERE {near})),
every AS (SELECT id, kind, ord, first, last FROM base UNION ALL SELECT id, kind, ord, first, last FROM pairs UNION ALL SELECT id, kind, ord, first, last FROM ends),
b AS (SELECT id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex, {listed} FILTER (WHERE ord <= 2) AS base, {listed} AS spans FROM every GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d JOIN t ON t.text = coalesce(d.text, '') LEFT JOIN b ON b.id = t.id"""
    return sql.replace("\n", " ")
