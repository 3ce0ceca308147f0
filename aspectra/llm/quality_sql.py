"""The twin of the quality rules in DuckDB's SQL, from the same table of thresholds."""

from __future__ import annotations

from aspectra.llm.quality import BULLETS, LEAST_WORDS, MOST_REPEATED, RULES, SPACE, STOP_WORDS, SYMBOLS, WINDOW


def twin() -> str:
    stop = ",".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    times = lambda pattern: f"len(regexp_extract_all(text,'{pattern}'))"
    lines = f"list_filter(string_split(text,chr(10)), lambda x: regexp_matches(x,'[^{SPACE}]'))"
    rows = f"d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text,'') AS text FROM documents), l AS (SELECT *, regexp_extract_all(text,'[^{SPACE}]+') AS w, {lines} AS ls FROM d)"
    window = "||chr(32)||".join(["word", *(f"lead(word,{i}) OVER o" for i in range(1, WINDOW))])
    places = f"p AS (SELECT k, unnest(w) AS word, generate_subscripts(w,1) AS i FROM l), v AS (SELECT k, i, {window} AS win FROM p WINDOW o AS (PARTITION BY k ORDER BY i)), t AS (SELECT k, i, win IS NOT NULL AND count(*) OVER (PARTITION BY k, win)>1 AS twice FROM v), c AS (SELECT k, bool_or(twice) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS inside FROM t), r AS (SELECT k, count(*) FILTER (inside) AS n_repeat_words FROM c GROUP BY 1)"
    counts = {
        "n_words": "len(w)", "word_chars": "length(array_to_string(w,''))", "n_symbols": times(f"[{SYMBOLS}]"), "n_dup_lines": "len(ls)-len(list_distinct(ls))", "n_repeat_words": "coalesce(n_repeat_words,0)",
        "n_stop_words": f"len(list_filter(w, lambda x: lower(x) IN ({stop})))", "n_letter_words": times(rf"[^{SPACE}\p{{L}}]*\p{{L}}[^{SPACE}]*"), "n_letters": times(r"\p{L}"), "n_capitals": times(r"\p{Lu}"), "n_lines": "len(ls)",
        "n_bullet_lines": f"len(list_filter(ls, lambda x: regexp_matches(x,'^[{SPACE}]*[{BULLETS}]')))", "n_ellipsis_lines": rf"len(list_filter(ls, lambda x: regexp_matches(x,'(\.\.\.|…)[{SPACE}]*$')))",
    }
    fails = []
    for rule in RULES:
        bounds = [f"100*{rule.part}<{rule.least}*{rule.whole}"] * (rule.least is not None) + [f"100*{rule.part}>{rule.most}*{rule.whole}"] * (rule.most is not None)
        fails.append(f"({rule.whole}>0 AND ({' OR '.join(bounds)}))")
    listed = f"array_to_string(list_filter([{','.join(f'CASE WHEN {f} THEN {chr(39)}{r.name}{chr(39)} END' for f, r in zip(fails, RULES))}], lambda x: x IS NOT NULL),',')"
    base = f"(n_words<{LEAST_WORDS} OR 100*n_repeat_words>{MOST_REPEATED}*n_words)"
    made = f"m AS (SELECT doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {n}' for n, c in counts.items())} FROM l LEFT JOIN r ON r.k=l.k)"
    return f"WITH {rows}, {places}, {made} SELECT *, {base} AS base_failed, NOT {base} AND NOT ({' OR '.join(fails)}) AS kept, {listed} AS failed_rules FROM m"
