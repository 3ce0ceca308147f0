"""Queries on text cleaning, the dataset build, and the scorer."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.constants import ASPECTS, AXES, UNIT_MAX_WORDS, UNIT_MIN_WORDS
from aspectra.functions import text as X
from aspectra.functions.scores import r6, rounded
from aspectra.operators import analysis as A
from aspectra.operators import dataset as D
from aspectra.operators import ml as ML
from aspectra.operators.quantiles import quantiles
from aspectra.operators.scoring import fitted_once
from aspectra.plans.bindings import U, Tables, sql, uniform
from aspectra.plans.registry import query
from aspectra.sources.shared import written


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chain(column: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in pairs:
        column = f"replace({column},{_literal(a)},{_literal(b)})"
    return column


_UNESCAPE = _chain("html", X.ENTITIES)
_TAGS = "regexp_replace({},'<[^>]{{1,80}}>',' ','g')"
_MASK = "regexp_replace(regexp_replace({},'https?://\\S+|www\\.\\S+',' [URL] ','gi'),'\\b[\\w.+-]+@[\\w-]+\\.[\\w.]+\\b',' [EMAIL] ','g')"


def _punct_sql(c: str) -> str:
    for mark, pattern in (("!!", "!{3,}"), ("??", "\\?{3,}"), ("..", "\\.{3,}"), (",,", ",{3,}")):
        c = f"regexp_replace({c},'{pattern}','{mark}','g')"
    return c


_FOLD = "replace(replace(translate({}," + _literal(X.FOLD_FROM) + "," + _literal(X.FOLD_TO) + "),'…','...'),'�','')"
_WS = "trim(regexp_replace({},'[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+',' ','g'))"


def _clean_sql(column: str) -> str:
    c = _MASK.format(_TAGS.format(_FOLD.format(_chain(f"coalesce({column},'')", X.ENTITIES))))
    for p in X.BOILERPLATE:
        c = f"regexp_replace({c},{_literal(p[4:])},' ','gi')"
    return _WS.format(_punct_sql(c))


@query(f"SELECT page_id, md5({_UNESCAPE}) AS digest FROM pages")
def html_unescape_basic(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.md5(X.unescape_basic(F.col("html")).cast("binary")).alias("digest"))


_CURLY = "replace(replace(text,'. ','… '),'e ','e’ –')"


@query(f"SELECT doc_id, md5({_FOLD.format(_CURLY)}) AS digest FROM documents")
def fold_typography(t: Tables) -> DataFrame:
    curly = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("… ")), F.lit("e "), F.lit("e’ –"))
    return t.raw("documents").select("doc_id", F.md5(X.fold_typography(curly).cast("binary")).alias("digest"))


@query(f"SELECT page_id, md5({_TAGS.format('html')}) AS digest FROM pages")
def strip_tags(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.md5(X.strip_tags(F.col("html")).cast("binary")).alias("digest"))


@query(f"SELECT page_id, md5({_MASK.format(chr(39) + 'see ' + chr(39) + '||url||' + chr(39) + ' or write to a.b@c.org now' + chr(39))}) AS digest FROM pages")
def mask_pii(t: Tables) -> DataFrame:
    said = F.concat(F.lit("see "), "url", F.lit(" or write to a.b@c.org now"))
    return t.raw("pages").select("page_id", F.md5(X.mask_contacts(said).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({_punct_sql('text')}) AS digest FROM documents")
def collapse_punct(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(X.collapse_punctuation(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT page_id, length(c) AS chars, md5(c) AS digest FROM (SELECT page_id, {_clean_sql('html')} AS c FROM pages)")
def clean_text(t: Tables) -> DataFrame:
    c = X.clean_text(F.col("html"))
    return t.raw("pages").select("page_id", c.alias("c")).select("page_id", F.length("c").cast("long").alias("chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("SELECT doc_id, length(text)>=3 AND length(regexp_replace(text,'[^\\p{L}]','','g'))>=2 AS usable FROM documents")
def text_is_usable(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.usable_text(F.col("text")).alias("usable"))


_KEY = "trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'))"


@query(f"SELECT doc_id, md5({_KEY}) AS digest FROM documents")
def dedup_key(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(X.dedup_key(F.col("text")).cast("binary")).alias("digest"))


@query(sql("texts", f"SELECT doc_id, canonical_id, split FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS canonical_id, row_number() OVER (PARTITION BY k ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END, doc_id) AS rn FROM (SELECT *, {_KEY} AS k FROM texts)) WHERE rn=1"))
def dedupe_across_splits(t: Tables) -> DataFrame:
    """One row of each text key, from the split of highest priority."""
    keyed = t.texts.select("doc_id", "split", F.md5(X.dedup_key(F.col("text")).cast("binary")).alias("k"))
    return D.dedupe_across_splits(keyed, "k", "doc_id").select("doc_id", "canonical_id", "split")


@query(sql("texts", f"SELECT count(*) AS rows_in, count(*)-count(DISTINCT {_KEY}) AS dropped, count(DISTINCT {_KEY}) AS kept FROM texts"))
def split_report(t: Tables) -> DataFrame:
    keys = t.texts.groupBy(F.md5(X.dedup_key(F.col("text")).cast("binary")).alias("k")).agg(F.count("*").alias("n"))
    return keys.agg(F.sum("n").alias("rows_in"), F.sum(F.col("n") - 1).alias("dropped"), F.count("*").alias("kept"))


@query(sql("texts", f"SELECT md5(k) AS k, count(DISTINCT split) AS splits, count(*) AS n FROM (SELECT {_KEY} AS k, split FROM texts) GROUP BY 1 HAVING count(DISTINCT split)>1"))
def leakage_violations(t: Tables) -> DataFrame:
    return D.leakage(t.texts.select("split", F.md5(X.dedup_key(F.col("text")).cast("binary")).alias("k")), "k")


@query(f"SELECT round(count(DISTINCT text)/CAST(count(*) AS DOUBLE),6) AS share, count(*) AS n, count(DISTINCT text)/CAST(count(*) AS DOUBLE)>=0.9e0 AS enough FROM documents")
def uniqueness(t: Tables) -> DataFrame:
    keys = t.raw("documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.count("*").alias("c"))
    out = keys.agg((F.count("*") / F.sum("c")).alias("s"), F.sum("c").alias("n"))
    return out.select(r6("s").alias("share"), "n", (F.col("s") >= 0.9).alias("enough"))


_CATS = "Screen#Clarity#Detail|Overall|BATTERY#OPERATION_PERFORMANCE|LAPTOP#QUALITY|KEYBOARD#PRICE|Product Accessories|LAPTOP#GENERAL|Camera#Zoom|OPTICAL_DRIVES#X|Nonsense#Y".split("|")
_CATS_SQL = "CASE CAST(part.p_partkey%10 AS INTEGER) " + " ".join(f"WHEN {i} THEN {_literal(c)}" for i, c in enumerate(_CATS)) + " END"
_ENTITY = "trim(CASE WHEN contains(category,'#') THEN left(category,strpos(category,'#')-1) ELSE category END)"
_ATTR = "trim(CASE WHEN contains(category,'#') THEN substr(category,strpos(category,'#')+1) ELSE '' END)"
_MAPPED = f"SELECT p_partkey, category, domain, {_ENTITY} AS entity, {_ATTR} AS attribute FROM (SELECT p_partkey, {_CATS_SQL} AS category, CASE WHEN p_partkey%2=0 THEN 'phone' ELSE 'laptop' END AS domain FROM part)"


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in table.items()) + " END"


def _categories(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(c) for c in _CATS))
    return t.raw("part").select("p_partkey", F.get(names, (F.col("p_partkey") % 10).cast("int")).alias("category"), F.when(F.col("p_partkey") % 2 == 0, "phone").otherwise("laptop").alias("domain"))


@query(f"SELECT p_partkey, entity, attribute FROM ({_MAPPED})")
def split_category(t: Tables) -> DataFrame:
    entity, attribute = D.split_category(F.col("category"))
    return _categories(t).select("p_partkey", entity.alias("entity"), attribute.alias("attribute"))


_STATE = f"SELECT *, entity IN ({','.join(map(_literal, D.DROP))}) AS dropped, coalesce({_case('attribute', D.OVERRIDES)}, CASE WHEN entity IN ('LAPTOP') THEN {_case('attribute', D.WHOLE_ATTRIBUTES)} WHEN domain='phone' THEN {_case('entity', D.PHONE)} ELSE {_case('entity', D.LAPTOP)} END) AS a FROM ({_MAPPED})"


@query(f"SELECT p_partkey, CASE WHEN NOT dropped THEN a END AS aspect, CASE WHEN dropped THEN 'dropped' WHEN a IS NULL THEN 'unknown' ELSE 'mapped' END AS state FROM ({_STATE})")
def taxonomy_map(t: Tables) -> DataFrame:
    aspect, state = D.map_category(F.col("category"), F.col("domain"))
    return _categories(t).select("p_partkey", aspect.alias("aspect"), state.alias("state"))


@query(f"SELECT category, domain, count(*) AS n FROM ({_STATE}) WHERE NOT dropped AND a IS NULL GROUP BY 1,2")
def unmapped_labels(t: Tables) -> DataFrame:
    _, state = D.map_category(F.col("category"), F.col("domain"))
    return _categories(t).where(state == "unknown").groupBy("category", "domain").agg(F.count("*").alias("n"))


_ITEM = r"'(\\.|[^'\\])*'"
_LIST = rf"\[\s*{_ITEM}(\s*,\s*{_ITEM})*\s*\]"
_TRIPLE = rf"\[\s*{_ITEM}\s*,\s*{_ITEM}\s*,\s*{_ITEM}\s*\]"
_PAYLOADS = ("####[['screen', 'Screen#X', 'positive'], ['battery', 'Battery/Longevity', 'negative']]", " no separator", "####[['a', 'b']]", "####not a list", "####[['it\\'s', 'Overall', 'neutral']]", "####[oops")
_LINES = "SELECT regexp_replace(text,'\\s+',' ','g')||CASE CAST(item_id%6 AS INTEGER) " + " ".join(f"WHEN {i} THEN {_literal(p)}" for i, p in enumerate(_PAYLOADS)) + " END AS value FROM benchmark"
_CAUSES = f"SELECT CASE WHEN NOT contains(value,'####') THEN 'no separator' WHEN trim(split_part(value,'####',1))='' THEN 'empty text' WHEN NOT regexp_full_match(p,'(?s)\\[.*\\]') THEN 'not a list' WHEN NOT regexp_full_match(p,{_literal(rf'\[\s*{_LIST}(\s*,\s*{_LIST})*\s*\]')}) THEN 'unreadable' WHEN NOT regexp_full_match(p,{_literal(rf'\[\s*{_TRIPLE}(\s*,\s*{_TRIPLE})*\s*\]')}) THEN 'wrong shape' ELSE 'kept' END AS cause, len(regexp_extract_all(p,{_literal(_LIST)})) AS lists FROM (SELECT value, trim(substr(value,strpos(value,'####')+4)) AS p FROM ({_LINES}))"


@query(f"SELECT cause, count(*) AS n, CAST(CASE WHEN cause='kept' THEN sum(lists) END AS BIGINT) AS triplets FROM ({_CAUSES}) GROUP BY 1")
def parse_annotated_lines(t: Tables) -> DataFrame:
    """Lines with embedded lists, some of them malformed: counts by cause."""
    n = F.col("item_id") % 6
    payload = F.when(n == 0, "####[['screen', 'Screen#X', 'positive'], ['battery', 'Battery/Longevity', 'negative']]").when(n == 1, " no separator").when(n == 2, "####[['a', 'b']]").when(n == 3, "####not a list").when(n == 4, "####[['it\\'s', 'Overall', 'neutral']]").otherwise("####[oops")
    lines = t.raw("benchmark").select(F.concat(F.regexp_replace("text", r"\s+", " "), payload).alias("value"))
    return D.parse_lines(lines).groupBy(F.coalesce("reject", F.lit("kept")).alias("cause")).agg(F.count("*").alias("n"), F.sum(F.size("triplets").cast("long")).alias("triplets"))


_VOTE = "v AS (SELECT review_id, aspect, polarity, count(*) AS n FROM pairs GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY review_id,aspect ORDER BY n DESC, CASE polarity WHEN 'neutral' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END) AS rn, count(*) OVER (PARTITION BY review_id,aspect) AS labels, min(n) OVER (PARTITION BY review_id,aspect) AS lo, max(n) OVER (PARTITION BY review_id,aspect) AS hi, sum(n) OVER (PARTITION BY review_id,aspect) AS votes FROM v)"


@query(sql("pairs", f"WITH {_VOTE} SELECT review_id, aspect, polarity, labels, CAST(votes AS BIGINT) AS votes, labels>1 AND lo=hi AS all_tied FROM r WHERE rn=1"))
def majority_vote(t: Tables) -> DataFrame:
    return D.majority_vote(t.pairs, ["review_id", "aspect"]).select("review_id", "aspect", "polarity", "labels", "votes", "all_tied")


@query(sql("pairs", "SELECT review_id, string_agg(aspect||':'||CAST(position AS VARCHAR), '|' ORDER BY position) AS terms FROM pairs GROUP BY 1"))
def collect_terms(t: Tables) -> DataFrame:
    said = t.pairs.withColumn("term", F.concat_ws(":", "aspect", F.col("position").cast("string")))
    return D.collect_terms(said, ["review_id"], "position", "term").select("review_id", F.array_join("terms", "|").alias("terms"))


@query(sql("pairs", "SELECT DISTINCT review_id, aspect, polarity FROM pairs"))
def distinct_triplets(t: Tables) -> DataFrame:
    return t.pairs.select("review_id", "aspect", "polarity").distinct()


@query(sql("pairs", "SELECT aspects, count(*) AS reviews FROM (SELECT review_id, count(DISTINCT aspect) AS aspects FROM pairs GROUP BY 1) GROUP BY 1"))
def aspects_per_review_hist(t: Tables) -> DataFrame:
    return t.pairs.groupBy("review_id").agg(F.count_distinct("aspect").alias("aspects")).groupBy("aspects").agg(F.count("*").alias("reviews"))


_COUNTS = "n_negative AS (SELECT aspect, sum(CASE WHEN polarity='negative' THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE) AS negative, sum(CASE WHEN polarity='neutral' THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE) AS neutral, sum(CASE WHEN polarity='positive' THEN 1 ELSE 0 END)/CAST(count(*) AS DOUBLE) AS positive FROM pairs GROUP BY 1)"


def _shares(t: Tables) -> DataFrame:
    wide = t.pairs.groupBy("aspect").pivot("polarity", ["negative", "neutral", "positive"]).count().na.fill(0)
    total = F.col("negative") + F.col("neutral") + F.col("positive")
    return wide.select("aspect", *((F.col(c) / total).alias(c) for c in ("negative", "neutral", "positive")))


@query(sql("pairs", f"WITH {_COUNTS} SELECT aspect, round(negative,6) AS negative, round(neutral,6) AS neutral, round(positive,6) AS positive, row_number() OVER (ORDER BY round(negative,6) DESC, aspect) AS place FROM n_negative"))
def polarity_crosstab(t: Tables) -> DataFrame:
    s = _shares(t).select("aspect", *(r6(c).alias(c) for c in ("negative", "neutral", "positive")))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("negative"), "aspect")).cast("long"))  # one row for each aspect


@query(sql("pairs", f"WITH {_COUNTS} SELECT aspect, polarity, round(share,6) AS share, round(coalesce(sum(share) OVER (PARTITION BY aspect ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0),6) AS lft FROM (SELECT aspect, 'negative' AS polarity, negative AS share, 0 AS o FROM n_negative UNION ALL SELECT aspect, 'neutral', neutral, 1 FROM n_negative UNION ALL SELECT aspect, 'positive', positive, 2 FROM n_negative)"))
def stacked_offsets(t: Tables) -> DataFrame:
    """Where each part of a stacked bar begins."""
    tall = _shares(t).unpivot("aspect", ["negative", "neutral", "positive"], "polarity", "share")
    before = Window.partitionBy("aspect").orderBy("polarity").rowsBetween(Window.unboundedPreceding, -1)  # alphabetical is the order
    return tall.select("aspect", "polarity", r6("share").alias("share"), r6(F.coalesce(F.sum("share").over(before), F.lit(0.0))).alias("lft"))


@query(sql("pairs", "SELECT polarity, count(*) AS n, round(count(*)/CAST((SELECT count(*) FROM pairs) AS DOUBLE),6) AS share FROM pairs GROUP BY 1"))
def polarity_share(t: Tables) -> DataFrame:
    by = t.pairs.groupBy("polarity").agg(F.count("*").alias("n"))
    return by.select("polarity", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # three rows


@query(sql("pairs", " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM pairs GROUP BY 2" for c in ("aspect", "polarity"))))
def dataset_value_counts(t: Tables) -> DataFrame:
    """Counts of several columns in one pass."""
    tall = t.pairs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("aspect", "polarity")))).alias("s")).select("s.*")
    return tall.groupBy("field", "value").agg(F.count("*").alias("n"))


_WORDS = "len(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>''))"


@query(f"SELECT round(avg(w),6) AS mean, CAST(floor(median(w)) AS INTEGER) AS middle, CAST(floor(quantile_cont(w,0.9)) AS INTEGER) AS p90, CAST(floor(quantile_cont(w,0.99)) AS INTEGER) AS p99, CAST(max(w) AS INTEGER) AS longest FROM (SELECT {_WORDS} AS w FROM documents)")
def dataset_stats(t: Tables) -> DataFrame:
    """Words of a document: their mean, quantiles by distributed selection, and the most."""
    words = t.raw("documents").select(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"))
    words = written(words, "word-counts")
    at = quantiles(words, "w", [0.5, 0.9, 0.99])
    out = words.agg(F.avg("w").alias("mean"), F.max("w").alias("longest"))
    return out.select(r6("mean").alias("mean"), *(F.floor(F.lit(q)).cast("int").alias(n) for q, n in zip(at, ("middle", "p90", "p99"))), "longest")


_SETS = "s AS (SELECT review_id, array_to_string(list_sort(list(DISTINCT aspect)),'|') AS aspects FROM pairs GROUP BY 1)"


@query(sql("pairs", f"WITH {_SETS} SELECT review_id, aspects FROM s"))
def aspect_sets(t: Tables) -> DataFrame:
    """Every review's aspect set, from all its rows: the members of the sets of :func:`disjoint_sets`."""
    return D.aspect_sets(t.pairs).select("review_id", F.array_join("aspects", "|").alias("aspects"))


@query(sql("pairs", f"WITH {_SETS}, g AS (SELECT aspects, count(*) AS n FROM s GROUP BY 1) SELECT a.aspects AS a, b.aspects AS b, a.n AS n_a, b.n AS n_b, a.n*b.n AS pairs FROM g a JOIN g b ON a.aspects<b.aspects AND NOT list_has_any(string_split(a.aspects,'|'),string_split(b.aspects,'|'))"))
def disjoint_sets(t: Tables) -> DataFrame:
    """All pairs of reviews without a common aspect, by their aspect sets."""
    out = D.disjoint_sets(D.aspect_sets(t.pairs))
    return out.select(F.array_join("a", "|").alias("a"), F.array_join("b", "|").alias("b"), "n_a", "n_b", "pairs")


@query("SELECT item_id, CASE WHEN right(x,1) IN ('.','!','?') THEN x ELSE x||'.' END||' Next.' AS composed, rtrim(x,'.!? ')||' next' AS stripped FROM (SELECT item_id, rtrim(text) AS x FROM benchmark)")
def compose_text(t: Tables) -> DataFrame:
    """Terminators added, or stripped, to compose texts."""
    x = F.rtrim("text")
    ended = F.when(F.substring(x, -1, 1).isin(".", "!", "?"), x).otherwise(F.concat(x, F.lit(".")))
    return t.raw("benchmark").select("item_id", F.concat(ended, F.lit(" Next.")).alias("composed"), F.concat(F.regexp_replace(x, "[.!? ]+$", ""), F.lit(" next")).alias("stripped"))


@query(sql("facts", "SELECT model_key, substr(string_agg('mention '||CAST(review_id AS VARCHAR), ' || ' ORDER BY review_id),1,400) AS evidence FROM facts GROUP BY 1"))
def evidence_join(t: Tables) -> DataFrame:
    """Joined with the separator, then cut."""
    ids = F.array_sort(F.collect_list("review_id"))
    said = F.transform(ids, lambda i: F.concat(F.lit("mention "), i.cast("string")))
    return t.facts.groupBy("model_key").agg(F.substring(F.array_join(said, " || "), 1, 400).alias("evidence"))


@query("SELECT conv_id, turn, split_part(replace(text, '. ', ' || '),' || ',1) AS piece FROM conversations")
def evidence_first(t: Tables) -> DataFrame:
    return t.raw("conversations").select("conv_id", "turn", F.substring_index(F.replace("text", F.lit(". "), F.lit(" || ")), " || ", 1).alias("piece"))


@query(sql("pairs", "SELECT review_id, position, CASE aspect WHEN 'performance' THEN 'Processor' ELSE upper(left(aspect,1))||substr(aspect,2) END||' | '||polarity AS rendered FROM pairs"))
def aspect_prefix(t: Tables) -> DataFrame:
    name = F.when(F.col("aspect") == "performance", "Processor").otherwise(F.initcap(F.replace("aspect", F.lit("_"), F.lit(" "))))
    return t.pairs.select("review_id", "position", F.concat_ws(" | ", name, "polarity").alias("rendered"))


_NAME = "regexp_replace(regexp_replace(split_part(title,',',1),'(?:\\b(?:red|blue|green|new)\\b)',' ','gi'),'\\s+',' ','g')"


@query(sql("listings", f"SELECT asin, array_to_string(list_slice(list_filter(string_split(trim(regexp_replace({_NAME},'[^\\w\\s.]',' ','g')),' '), lambda x: x<>''),1,4),' ') AS canonical FROM (SELECT asin, brand||' '||title AS title FROM (SELECT asin, replace(brand,'#','') AS brand, replace(replace(title,brand||' ',''),'#','') AS title FROM listings))"))
def canonical_name(t: Tables) -> DataFrame:
    """Names from titles; the twin knows those rules that these titles meet."""
    brand = F.replace("brand", F.lit("#"), F.lit(""))
    title = F.replace(F.replace("title", F.concat("brand", F.lit(" ")), F.lit("")), F.lit("#"), F.lit(""))
    return t.listings.select("asin", X.canonical_name(title, brand).alias("canonical"))


def sentences_sql(column: str, least: int = UNIT_MIN_WORDS, most: int = UNIT_MAX_WORDS) -> str:
    """The twin of :func:`aspectra.functions.text.split_sentences`: a list of units. Its patterns can't look around, so lists do that."""
    ws = X.SPACE.replace(r"\x85", r"\x{85}")
    text, mark = f"coalesce({column},'')", X.CUT_MARK
    end = X.TERMINATOR.replace("'", "''")
    trim = lambda c: f"regexp_replace({c},'^[{ws}]+|[{ws}]+$','','g')"
    words = lambda c: f"list_filter(string_split_regex({c},'[{ws}]+'), lambda w: w<>'')"
    marked = f"regexp_replace(l,'({end}[{ws}]+)','\\1{mark}','g')"
    for _ in range(2):  # two of them in a row
        marked = f"regexp_replace({marked},'(^|[^A-Za-z.])(\\.*(?i:{X._ABBREVIATED}){end}[{ws}]+){mark}','\\1\\2','g')"
    marked = f"regexp_replace({marked},'[{ws}]+{mark}','{mark}','g')"
    parts = f"list_filter(string_split({marked},'{mark}'), lambda p: p<>'')"
    joined = f"list_filter(string_split(array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i>1 AND len({words('p')})<{least} THEN ' ' ELSE '{mark}' END || p),''),'{mark}'), lambda p: p<>'')"
    first = f"list_transform([{joined}], lambda u: CASE WHEN len(u)>1 AND len({words('u[1]')})<{least} THEN list_concat([u[1]||' '||u[2]],u[3:]) ELSE u END)[1]"
    lines = f"list_filter(list_transform(string_split_regex({text},'[\\r\\n]+'), lambda l: regexp_replace({trim('l')},'^[{X.BULLETS}]+[{ws}]*','')), lambda l: l<>'')"
    units = f"flatten(list_transform({lines}, lambda l: {first}))"
    full = f"(len(s.o)>0 AND len(s.o)+len(c)>{most})"
    held = f"(CASE WHEN {full} THEN c ELSE list_concat(s.o,c) END)"
    over = f"((len({held})-1)//{most})"
    step = f"{{'d': list_concat(CASE WHEN {full} THEN list_append(s.d,array_to_string(s.o,' ')) ELSE s.d END, list_transform(range({over}), lambda i: array_to_string({held}[i*{most}+1:(i+1)*{most}],' '))), 'o': {held}[{over}*{most}+1:]}}"
    clauses = f"list_transform(string_split(regexp_replace(u,',[{ws}]+',',{mark}','g'),'{mark}'), lambda k: {words('k')})"
    done = f"list_transform([list_reduce({clauses}, lambda s, c: {step}, {{'d': CAST([] AS VARCHAR[]), 'o': CAST([] AS VARCHAR[])}})], lambda s: CASE WHEN len(s.o)>0 THEN list_append(s.d,array_to_string(s.o,' ')) ELSE s.d END)[1]"
    short = f"flatten(list_transform({units}, lambda u: CASE WHEN len({words('u')})<={most} THEN [u] ELSE {done} END))"
    return f"CASE WHEN {trim(text)}='' THEN CAST([] AS VARCHAR[]) WHEN len({units})=0 THEN [{trim(text)}] ELSE {short} END"


@query(f"SELECT doc_id, unnest(range(len(units))) AS position, unnest(units) AS unit FROM (SELECT doc_id, {sentences_sql('text')} AS units FROM documents)")
def split_sentences(t: Tables) -> DataFrame:
    """Sentence units of whole documents."""
    units = t.spread("documents").select("doc_id", F.posexplode(X.split_sentences("text")).alias("position", "unit"))
    return units.select("doc_id", F.col("position").cast("long").alias("position"), "unit")


@query(f"SELECT doc_id, unnest(range(len(units))) AS position, unnest(units) AS unit FROM (SELECT doc_id, {sentences_sql('text')} AS units FROM documents)")
def units_lateral(t: Tables) -> DataFrame:
    """The same units by a table function, from SQL."""
    from aspectra.functions.units import register as register_units

    register_units(t.spark)
    return t.spark.sql("SELECT doc_id, u.position, u.unit FROM {docs}, LATERAL sentence_units(text) u", docs=t.spread("documents"))


@query(f"SELECT doc_id, unnest(range(len(units))) AS position, unnest(units) AS unit FROM (SELECT doc_id, {sentences_sql('text')} AS units FROM documents)")
def units_partitioned(t: Tables) -> DataFrame:
    """And by one over a partitioned table."""
    from aspectra.functions.units import register as register_units

    register_units(t.spark)
    return t.spark.sql("SELECT key AS doc_id, position, unit FROM units_of_table(TABLE(SELECT doc_id, text FROM {docs}) PARTITION BY doc_id)", docs=t.raw("documents"))


_STATES = f"SELECT conv_id, turn, text, {_clean_sql('text')} AS cleaned FROM conversations"


@query(f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(text,''))='' THEN 'blank' WHEN length(text)>5000 THEN 'too_long' WHEN NOT (length(cleaned)>=3 AND length(regexp_replace(cleaned,'[^\\p{{L}}]','','g'))>=2) THEN 'unusable' ELSE 'ok' END AS state FROM ({_STATES})) GROUP BY 1".replace("{{", "{").replace("}}", "}"))
def batch_skip_counts(t: Tables) -> DataFrame:
    return A.statuses(t.raw("conversations")).groupBy("state").agg(F.count("*").alias("n"))


_KEYWORDS = {"battery": "the", "camera": "eau", "price": "schein", "display": "ción", "performance": "whor"}
_UNITS = f"u AS (SELECT review_id, cleaned, unnest(units) AS unit, unnest(range(len(units))) AS position FROM (SELECT review_id, cleaned, {sentences_sql('cleaned')} AS units FROM (SELECT doc_id AS review_id, {_clean_sql('text')} AS cleaned FROM documents))), asp AS (SELECT unnest(['battery','camera','price','display','performance']) AS aspect)"
_DETECT = "CASE " + " ".join(f"WHEN aspect='{a}' AND contains(lower({{x}}),'{w}') THEN 0.9e0" for a, w in _KEYWORDS.items()) + " ELSE 0e0 END"
_FOUND = f"{_UNITS}, f AS (SELECT review_id, position, aspect, unit, {_DETECT.format(x='unit')} AS p FROM u, asp), g AS (SELECT * FROM f WHERE p>=0.5e0), w AS (SELECT review_id, position, aspect, cleaned AS unit, {_DETECT.format(x='cleaned')} AS p FROM u, asp WHERE position=0 AND review_id NOT IN (SELECT review_id FROM g)), wb AS (SELECT review_id, position, aspect, unit, p FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY p DESC, aspect) AS rn, max(p) OVER (PARTITION BY review_id) AS mp FROM w) WHERE p>=0.5e0 OR (mp<0.5e0 AND rn=1)), ev AS (SELECT *, contains(lower(unit),'trash') AS bad, contains(lower(unit),'and') AS good FROM (SELECT * FROM g UNION ALL SELECT * FROM wb)), pr AS (SELECT *, CASE WHEN bad THEN 0.90e0 WHEN good THEN 0.05e0 ELSE 0.10e0 END AS pn, CASE WHEN bad THEN 0.05e0 WHEN good THEN 0.05e0 ELSE 0.80e0 END AS pu, CASE WHEN bad THEN 0.05e0 WHEN good THEN 0.90e0 ELSE 0.10e0 END AS pp FROM ev), cb AS (SELECT review_id, aspect, max(p) AS detection, count(*) AS mentions, min(position) AS first_position, sum(pn*greatest(p,1e-6))/sum(greatest(p,1e-6)) AS p_negative, sum(pu*greatest(p,1e-6))/sum(greatest(p,1e-6)) AS p_neutral, sum(pp*greatest(p,1e-6))/sum(greatest(p,1e-6)) AS p_positive FROM pr GROUP BY 1,2), sc AS (SELECT *, 1+9*(0.5e0*p_neutral/(p_negative+p_neutral+p_positive)+p_positive/(p_negative+p_neutral+p_positive)) AS score, CASE WHEN round(p_negative,9)>=round(p_neutral,9) AND round(p_negative,9)>=round(p_positive,9) THEN 'negative' WHEN round(p_neutral,9)>=round(p_positive,9) THEN 'neutral' ELSE 'positive' END AS polarity FROM cb)"


def _units(t: Tables) -> DataFrame:
    """Sentence units of cleaned documents, dealt over all cores."""
    cleaned = t.spread("documents").select(F.col("doc_id").alias("review_id"), X.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select("review_id", "cleaned", F.posexplode(X.split_sentences("cleaned")).alias("position", "unit"))


def _analyzed(t: Tables) -> DataFrame:
    out = A.analyze(_units(t), list(AXES), A.keyword_detector(_KEYWORDS), A.keyword_classifier("trash", "and"))
    p = [F.round(c, 9) for c in A.P3]
    return out.withColumn("polarity", F.when((p[0] >= p[1]) & (p[0] >= p[2]), "negative").when(p[1] >= p[2], "neutral").otherwise("positive"))


@query(f"WITH {_FOUND} SELECT review_id, aspect, mentions, round(detection,6) AS detection, round(score,9) AS score, polarity FROM sc")
def analyze_reviews(t: Tables) -> DataFrame:
    """The two-stage scorer with the keyword engine, over whole documents."""
    return _analyzed(t).select("review_id", "aspect", "mentions", r6("detection").alias("detection"), rounded("score", 9).alias("score"), "polarity")


@query(f"WITH {_FOUND} SELECT review_id, aspect, place FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY round(detection,4) DESC, first_position, aspect) AS place FROM sc) WHERE place<=2")
def topk_aspects(t: Tables) -> DataFrame:
    return A.top_aspects(_analyzed(t), 2).select("review_id", "aspect", F.col("place").cast("long").alias("place"))


_SUMMARY = "s AS (SELECT aspect, count(*) AS mentions, avg(score) AS average_score, count(*) FILTER (polarity='negative') AS negative, count(*) FILTER (polarity='neutral') AS neutral, count(*) FILTER (polarity='positive') AS positive, count(*)/CAST((SELECT count(DISTINCT review_id) FROM sc) AS DOUBLE) AS mention_share FROM sc GROUP BY 1)"


@query(f"WITH {_FOUND}, {_SUMMARY} SELECT aspect, mentions, round(average_score,6) AS average_score, negative, neutral, positive, round(mention_share,6) AS mention_share FROM s")
def product_summary(t: Tables) -> DataFrame:
    out = A.product_summary(_analyzed(t))
    return out.select("aspect", "mentions", r6("average_score").alias("average_score"), "negative", "neutral", "positive", r6("mention_share").alias("mention_share"))


@query(f"WITH {_FOUND}, {_SUMMARY} SELECT (SELECT aspect FROM s ORDER BY round(average_score,6) DESC, mentions DESC, aspect DESC LIMIT 1) AS highest, (SELECT aspect FROM s ORDER BY round(average_score,6), mentions DESC, aspect LIMIT 1) AS lowest, (SELECT round(sum(average_score*mentions)/sum(mentions),6) FROM s) AS overall_score")
def product_extremes(t: Tables) -> DataFrame:
    out = A.extremes(A.product_summary(_analyzed(t)))
    return out.select("highest", "lowest", r6("overall_score").alias("overall_score"))


@query(sql("facts", "SELECT model_key, review_id, aspect FROM (SELECT *, row_number() OVER (PARTITION BY model_key, rating ORDER BY confidence DESC, aspect) AS rn, max(confidence) OVER (PARTITION BY model_key, rating) AS top, min(review_id) OVER (PARTITION BY model_key, rating, aspect, confidence) AS lo FROM (SELECT DISTINCT model_key, rating, aspect, max(confidence) AS confidence, min(review_id) AS review_id FROM facts GROUP BY 1,2,3)) WHERE confidence>=0.95e0 OR (top<0.95e0 AND rn=1)"))
def threshold_gate_top1(t: Tables) -> DataFrame:
    """Rows over the threshold, or the best one of a group without any."""
    best = t.facts.groupBy("model_key", "rating", "aspect").agg(F.max("confidence").alias("p"), F.min("review_id").alias("review_id"))
    return A.gate(best, ["model_key", "rating"], 0.95).select("model_key", "review_id", "aspect")


@query(sql("probs", "SELECT y AS grp, round(max(w),6) AS detection, " + ", ".join(f"round(sum({c}*greatest(w,1e-6))/sum(greatest(w,1e-6)),6) AS {c}" for c in A.P3) + " FROM (SELECT *, (vec_id%7)/7e0 AS w FROM probs) GROUP BY 1").replace("SELECT y AS grp", "SELECT CAST(y AS INTEGER) AS grp"))
def weighted_prob_combine(t: Tables) -> DataFrame:
    rows = t.probs.select(F.col("y").alias("grp"), ((F.col("vec_id") % 7) / 7.0).alias("p"), F.col("vec_id").alias("position"), *A.P3)
    out = A.combine(rows, ["grp"])
    return out.select(F.col("grp").cast("int").alias("grp"), r6("detection").alias("detection"), *(r6(c).alias(c) for c in A.P3))


_JSON = "'{\"aspect\":\"'||aspect||'\",\"mentions\":'||CAST(mentions AS VARCHAR)||',\"score\":'||CAST(round(score,6) AS VARCHAR)||',\"polarity\":\"'||polarity||'\"}'"


@query(f"WITH {_FOUND} SELECT review_id, '['||string_agg({_JSON}, ',' ORDER BY aspect)||']' AS analysis FROM sc GROUP BY 1")
def result_to_json(t: Tables) -> DataFrame:
    """A review's analysis as one JSON text."""
    one = F.struct("aspect", "mentions", rounded("score", 6).alias("score"), "polarity")
    return _analyzed(t).groupBy("review_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("analysis"))


@query("SELECT count(*) AS records FROM conversations")
def count_csv_records(t: Tables) -> DataFrame:
    """Records of CSV files made of whole texts with their line breaks, counted by byte ranges."""
    from aspectra.sources.readers import count_rows
    from aspectra.sources.shared import shared_dir

    path = f"{shared_dir(t.spark)}/conversations-{uuid.uuid4().hex}.csv"
    t.raw("conversations").write.options(header=True, escape='"', quoteAll=True, emptyValue="").csv(path)
    return t.spark.createDataFrame([(count_rows(t.spark, path),)], "records long")


@query()
def composed_benchmark(t: Tables) -> DataFrame:
    """Pseudo reviews of two aspects that no two of their sources share, from reviews of one aspect."""
    said = F.concat_ws(" ", F.lit("mention"), F.col("position").cast("string"), F.lit("of"), "aspect")
    single = t.pairs.join(t.pairs.groupBy("review_id").agg(F.count_distinct("aspect").alias("n")).where("n = 1").select("review_id"), "review_id", "left_semi")
    made = D.compose_benchmark(single.select("review_id", said.alias("text"), "aspect", "polarity"), 2, 3)
    return made.select("text", F.array_join("source_ids", "|").alias("sources"))


def _synthetic_sql(each: int) -> str:
    """The twin of the synthetic reviews, from the same templates: every draw is the same hash."""
    from aspectra.operators import synthetic as Y

    u = lambda name: uniform("review_id", name)
    pick = lambda options, draw: f"[{','.join(map(_literal, options))}][1+CAST(floor({draw}*{len(options)}) AS INTEGER)]"
    most, low = Y.MOST_ASPECTS, f"{Y.NEUTRAL!r}e0"
    axes = ",".join(f"{{'u': {u('axis-' + a)}, 'axis': '{a}'}}" for a in AXES)
    rows = f"SELECT *, list_transform(list_sort([{axes}])[1:1+CAST(floor({u('aspects')}*{most}) AS INTEGER)], lambda x: x.axis) AS axes FROM (SELECT 'syn-'||model_key||'-'||CAST(number AS VARCHAR) AS review_id, model_key, name FROM products, (SELECT unnest(range(1,{each + 1})) AS number))"
    for k in range(most):
        quality = f"({Y.QUALITY[0]!r}e0+{Y.QUALITY[1] - Y.QUALITY[0]!r}e0*{U.format(key=f'name||{chr(39)}|{chr(39)}||axes[{k + 1}]', seed='quality')})"
        rows = f"SELECT *, axes[{k + 1}] AS a{k}, CASE WHEN axes[{k + 1}] IS NULL THEN NULL WHEN {u(f'polarity-{k}')}<{low} THEN 'neutral' WHEN {u(f'polarity-{k}')}<{low}+({quality}-1)/9*(1-{low}) THEN 'positive' ELSE 'negative' END AS p{k} FROM ({rows})"
    for k in range(most):
        clause = "CASE " + " ".join(f"WHEN a{k}='{a}' AND p{k}='{p}' THEN {pick(options, u(f'clause-{k}'))}" for a, by in Y.CLAUSES.items() for p, options in by.items()) + " END"
        for slot, words in Y.SLOTS.items():
            clause = f"replace({clause},'{{{slot}}}',{pick(words, u(f'{slot}-{k}'))})"
        join = f"CASE WHEN p{k}<>p{k - 1} THEN {pick(Y.JOINS[True], u(f'join-{k}'))} ELSE {pick(Y.JOINS[False], u(f'join-{k}'))} END||" if k else ""
        rows = f"SELECT *, {clause} AS c{k}, {join}{clause} AS part{k} FROM ({rows})"
    body = f"replace({pick(Y.OPENINGS, u('opening'))},'{{p}}',name)||{'||'.join(f'coalesce(part{k},{chr(39) * 2})' for k in range(most))}||'.'||{pick(Y.CLOSINGS, u('closing'))}"
    cased = f"SELECT *, CASE WHEN {u('case')}<{Y.NOISE[0]!r}e0 THEN upper(b) WHEN {u('case')}<{Y.NOISE[0]!r}e0+{Y.NOISE[1]!r}e0 THEN lower(b) ELSE b END AS o FROM (SELECT *, upper(left(body,1))||substr(body,2) AS b FROM (SELECT *, {body} AS body FROM ({rows})))"
    marked = f"SELECT *, CASE WHEN {u('mark')}<{Y.NOISE[2]!r}e0 AND contains(o,'.') THEN substr(o,1,strpos(o,'.')-1)||'!'||substr(o,strpos(o,'.')+1) ELSE o END AS m FROM ({cased})"
    listed = lambda c: "'{'||array_to_string(list_filter([" + ",".join(f"'\"'||a{k}||'\":\"'||{c}{k}||'\"'" for k in range(most)) + "], lambda x: x IS NOT NULL),',')||'}'"
    return f"SELECT review_id, model_key, CASE WHEN {u('dots')}<{Y.NOISE[3]!r}e0 THEN rtrim(m,'.')||'...' ELSE m END AS text, {listed('p')} AS labels, {listed('c')} AS clauses FROM ({marked})"


@query(sql("products", _synthetic_sql(3)))
def synthetic_reviews(t: Tables) -> DataFrame:
    """Review texts from templates, drawn by hashes of product and number."""
    from aspectra.operators.synthetic import reviews

    return reviews(t.named_products, 3)


_WORD_TERMS = f"SELECT {{id}} AS id, unnest(list_concat(w, list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1]))) AS t FROM (SELECT {{id}}, regexp_extract_all(lower(text),'{ML.WORD}') AS w FROM {{table}})".replace("{2,}", "{{2,}}").replace("\\p{L}", "\\p{{L}}").replace("\\p{N}", "\\p{{N}}")
_CHAR_TERMS = "SELECT id, unnest(flatten(list_transform(range(3,least(5,length(w))+1), lambda n: list_transform(range(1,length(w)-n+2), lambda i: substr(w,i,n))))) AS t FROM (SELECT {id} AS id, ' '||unnest(list_filter(string_split_regex(lower(text),'[" + X.SPACE.replace(r"\x85", r"\x{85}").replace("{", "{{").replace("}", "}}") + "]+'), lambda x: x<>''))||' ' AS w FROM {table})"


def _weights_sql(name: str, terms: str, table: str, min_df: int) -> str:
    """CTEs of TF-IDF weights: ``name`` (id, t, weight)."""
    return f"{name}_tf AS (SELECT id, t, count(*) AS tf FROM ({terms}) GROUP BY 1,2), {name}_df AS (SELECT t, count(*) AS df FROM {name}_tf GROUP BY 1 HAVING count(*)>={min_df}), {name}_w AS (SELECT id, f.t AS t, (1+ln(tf))*(ln((1+(SELECT count(*) FROM {table}))/CAST(1+df AS DOUBLE))+1) AS w FROM {name}_tf f JOIN {name}_df d ON d.t=f.t), {name} AS (SELECT id, t, w/sqrt(sum(w*w) OVER (PARTITION BY id)) AS weight FROM {name}_w)"


_WORD_W = _weights_sql("words", _WORD_TERMS.format(id="doc_id", table="documents"), "documents", 2)
_CHAR_W = _weights_sql("chars", _CHAR_TERMS.format(id="item_id", table="benchmark"), "benchmark", 3)
_BOTH_W = _weights_sql("words", _WORD_TERMS.format(id="item_id", table="benchmark"), "benchmark", 2)


@query(f"WITH {_WORD_W} SELECT t, count(*) AS docs, round(sum(weight),4) AS weight FROM words GROUP BY 1")
def tfidf_terms(t: Tables) -> DataFrame:
    """Sublinear TF-IDF of words and pairs of words, with smooth idf and unit length, summed by term."""
    out = ML.term_totals(t.spread("documents").select("doc_id", "text"), "doc_id", "text", "word", 2)
    return out.select(F.col("term").alias("t"), "docs", F.round("weight", 4).alias("weight"))


@query(f"WITH {_CHAR_W} SELECT t AS gram, count(*) AS docs, round(sum(weight),4) AS weight FROM chars GROUP BY 1")
def char_ngrams(t: Tables) -> DataFrame:
    """The same of 3 to 5 characters within words that three items have, summed by n-gram."""
    out = ML.term_totals(t.raw("benchmark"), "item_id", "text", "char", 3)
    return out.select(F.col("term").alias("gram"), "docs", F.round("weight", 4).alias("weight"))


@query(f"WITH {_BOTH_W}, {_CHAR_W} SELECT id AS item_id, kind, count(*) AS features, round(sum(weight),4) AS weight FROM (SELECT id, 'word' AS kind, weight FROM words UNION ALL SELECT id, 'char', weight FROM chars) GROUP BY 1,2")
def feature_union(t: Tables) -> DataFrame:
    """Both kinds of features of each item: their number and total weight."""
    out = ML.feature_union(t.raw("benchmark"), "item_id", "text")
    return out.groupBy("item_id", "kind").agg(F.count("*").alias("features"), F.round(F.sum("weight"), 4).alias("weight"))


#: A word for each aspect; a text that has it is about the aspect.
_ASPECT_WORDS = dict(zip(ASPECTS, ("that", "was", "this", "are", "from", "tion", "ing", "ble", "ther", "thon", "than", "anea")))


def _has_word(low: Column, word: str) -> Column:
    """Whether a text has a word of its own, plain letters: its letters are searched for, bounds are looked at only where they stand."""
    return F.contains(low, F.lit(word)) & low.rlike(rf"(?U){word}(?<=\b{word})\b")


def _labelled(t: Tables) -> DataFrame:
    """Texts with a label of 0 and 1 for each aspect, and a class: by words that they have."""
    has = lambda words: reduce(Column.__or__, (_has_word(F.col("_low"), w) for w in words.split("|")))
    y = F.when(has("idiot|scum|trash"), 0).when(has("with|von|por|dans"), 2).otherwise(1)
    return t.texts.withColumn("_low", F.lower("text")).select("doc_id", "split", "text", y.alias("y"), *(has(w).cast("int").alias(a) for a, w in _ASPECT_WORDS.items()))


def _named(t: Tables, kind: str) -> str:
    """The name of a model of these tables in this application."""
    return f"{kind}|{t.spark.sparkContext.applicationId}|{t.sf_dir}"


def _polarity(t: Tables) -> ML.LinearModel:
    return fitted_once(_named(t, "polarity"), lambda: ML.fit_sentiment(_labelled(t).where("split = 'train'").select("text", "y")))


@query()
def sentiment_logreg(t: Tables) -> DataFrame:
    """Three balanced classes by multinomial logistic regression: predictions of the held-out splits."""
    held_out = _labelled(t).where("split <> 'train'").select("doc_id", "y", "text")
    return _polarity(t).predict(held_out, "text", "prediction").select("doc_id", "prediction", "y")


@query()
def sentiment_with_aspect(t: Tables) -> DataFrame:
    """The same with a category beside the text: the language as a one-hot column."""
    rows = _labelled(t).join(t.texts.select("doc_id", F.col("lang").alias("aspect")), "doc_id")
    model = ML.fit_with_aspect(rows.where("split = 'train'").select("text", "aspect", "y"))
    return model.predict(rows.where("split <> 'train'").select("doc_id", "y", "aspect", "text"), "text", "prediction").select("doc_id", "prediction", "y")


@query()
def calibrated_svm(t: Tables) -> DataFrame:
    """Support-vector machines with sigmoids: probabilities of the held-out splits."""
    rows = _labelled(t)
    model = ML.fit_calibrated_svm(rows.where("split = 'train'").select("text", "y"))
    out = model.score(rows.where("split <> 'train'").select("doc_id", "y", "text"), "text", "p")
    return out.select("doc_id", "y", *(r6(F.col("p")[i]).alias(c) for i, c in enumerate(A.P3)))


def _detector(t: Tables) -> ML.LinearModel:
    return fitted_once(_named(t, "aspects"), lambda: ML.fit_detector(_labelled(t).where("split = 'train'").select("text", *ASPECTS), list(ASPECTS)))


@query()
def detector_logreg(t: Tables) -> DataFrame:
    """A balanced logistic regression for each of twelve aspects: probabilities of the held-out splits."""
    return ML.predict_detector(_labelled(t).where("split <> 'train'").select("doc_id", "text"), _detector(t), 0.46)


@query()
def detector_tuned(t: Tables) -> DataFrame:
    """Micro F1 of the detector on the dev split at each threshold, and that of the best one on the test split."""
    from aspectra.operators import evaluation as E

    rows, model = _labelled(t), _detector(t)
    said = model.score(rows.where("split <> 'train'"), "text", "p").select("split", F.posexplode(F.array(*(F.struct(F.col(a).alias("y"), F.col("p")[i].alias("p")) for i, a in enumerate(ASPECTS))))).select("split", "col.*")
    said = written(said, "detections")
    swept = E.threshold_sweep(said.where("split = 'dev'"), E.grid(t.spark, 0.1, 0.02, 41))
    best = swept.agg(F.max_by("threshold", F.struct(F.round("f1", 9), -F.col("threshold"))).alias("threshold"))
    test = E.threshold_sweep(said.where("split = 'test'"), best).select(F.lit("test").alias("split"), "threshold", r6("f1").alias("f1"))
    return swept.select(F.lit("dev").alias("split"), "threshold", r6("f1").alias("f1")).unionByName(test)


@query()
def analyze_with_models(t: Tables) -> DataFrame:
    """The two-stage scorer with fitted models for both stages, by their names, over whole documents."""
    _detector(t), _polarity(t)
    out = A.analyze(_units(t), list(ASPECTS), A.ModelDetector(_named(t, "aspects")), A.ModelClassifier(_named(t, "polarity")))
    return out.select("review_id", "aspect", "mentions", r6("detection").alias("detection"), r6("score").alias("score"), "polarity")
