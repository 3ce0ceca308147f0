"""Secret scans by linking the parts of credentials; DataFrame functions only.

Base spans come from three patterns. Weak candidates (identifiers, secrets and
endpoints that alone would be noise) come from further patterns and are kept
only where a complementary part lies in scope, no more than ``SCOPE`` code
points away: an identifier next to a secret, a secret next to an identifier, an
endpoint next to a secret that is reported itself. The link is an interval join: parts are entered in
buckets of positions, reduced to one row for each text, class and bucket, and
candidates look at all buckets in their scope. No pairs are emitted.

Texts with a match are keyed by their digest and searched once each, so copies
cost nothing and ids need be neither unique nor there. Positions count code
points: a text is split at the matches and lengths are summed.

Defined results: null text is empty; text without a match has zero counts, the
digest of an empty string and no spans; repeated rows get equal answers; null
ids stay; ties of start are ordered by kind, then end; an empty table gives no
rows; other columns are not read by ``scan`` and kept by ``masked``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import fresh, written

SCOPE = 200
# Fixed values of the contract: base kinds in order, with runs of the lengths that count.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as the first AKIA of a run with 16 more; shorter runs have no later one
HEX = r"[0-9a-f]{24,}"
# Weak kinds.
WEAK_ID = r"""(?i:(?:access|client|account|user|login)[_-]?(?:key[_-]?)?(?:id|name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_@.-]{4,}"""
WEAK_SECRET = r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z0-9]+|amqps?|redis|mongodb)://[^\s"'<>]+|(?i:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[^\s"'<>]{4,}"""
#: name, order, pattern, class of part.
KINDS = (("assign", 0, ASSIGN, "secret"), ("access", 1, ACCESS, "id"), ("hex", 2, HEX, "secret"), ("weak_id", 3, WEAK_ID, "id"), ("weak_secret", 4, WEAK_SECRET, "secret"), ("endpoint", 5, ENDPOINT, "endpoint"))
#: Class of a weak candidate: class that must be near.
NEEDS = {"id": "secret", "secret": "id", "endpoint": "secret"}
MARKED = "|".join(f"(?:{p})" for p in (ASSIGN, WEAK_ID, ENDPOINT))
SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def _matches(texts: DataFrame, kind: str, order: int, pattern: str, part: str) -> DataFrame:
    """(digest, kind, ord, part, start, end, value) of one kind's leftmost non-overlapping matches."""
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = texts.where(F.col("text").rlike(pattern)).select("digest", F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))).alias("place", "m"))
    upto = Window.partitionBy("digest").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(upto)
    return rows.select("digest", F.lit(kind).alias("kind"), F.lit(order).alias("ord"), F.lit(part).alias("part"), (end - F.length("m.value")).cast("int").alias("start"), end.cast("int").alias("end"), F.col("m.value").alias("value"))


def _buckets(rows: DataFrame, reach: int = 0) -> DataFrame:
    """A row for each bucket that a span, or a place up to ``reach`` from its first or last one, touches."""
    first, last = F.col("start") - reach, F.greatest(F.col("end") - 1, "start") + reach
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(first / SCOPE), F.floor(last / SCOPE))))


def spans_of(texts: DataFrame) -> DataFrame:
    """Spans of each text (digest, text): base ones, and weak ones that are linked."""
    every = written(reduce(DataFrame.unionByName, (_matches(texts, *k) for k in KINDS)), "secret-matches")
    long_enough = (F.col("kind") != "assign") | (F.length(F.regexp_extract("value", ASSIGN_VALUE, 1)) >= 6)
    base = every.where((F.col("ord") <= 2) & long_enough)
    weak = every.where((F.col("ord") > 2) & ~((F.col("kind") == "weak_secret") & F.col("value").rlike("^[0-9./_-]+$")))
    taken = _buckets(base.select("digest", "start", "end")).select("digest", "bucket", F.col("start").alias("s"), F.col("end").alias("e"))
    touching = _buckets(weak).join(taken, ["digest", "bucket"]).where("start < e and s < end").select("digest", "ord", "start").distinct()
    weak = weak.join(touching, ["digest", "ord", "start"], "left_anti")
    ends = weak.where(F.col("part") == "endpoint")
    weak = weak.where(F.col("part") != "endpoint")
    pairs = _linked(weak, base.unionByName(weak))
    # an endpoint counts only beside a secret that is itself reported
    placed = _linked(ends, base.unionByName(pairs))
    return reduce(DataFrame.unionByName, (x.select("digest", "kind", "ord", "start", "end") for x in (base, pairs, placed)))


def _linked(weak: DataFrame, parts: DataFrame) -> DataFrame:
    """Weak candidates with a part of the class that they need in scope."""
    near = _buckets(parts.select("digest", "part", "start", "end")).groupBy("digest", F.col("part").alias("needed"), "bucket").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    needed = reduce(lambda c, k: F.when(F.col("part") == k, NEEDS[k]).otherwise(c), NEEDS, F.lit(None).cast("string"))
    met = _buckets(weak.withColumn("needed", needed), SCOPE + 1).join(near, ["digest", "needed", "bucket"])
    met = met.where((F.col("first") - F.col("end") <= SCOPE) & (F.col("start") - F.col("last") <= SCOPE))
    return met.select(*weak.columns).distinct()


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _keyed(docs: DataFrame, name: str = "_digest") -> DataFrame:
    """Rows with the digest, as ``name``, of those texts that can have a span.

    All kinds but two need ``=`` or ``:``, and a weak secret without any such
    part is never linked, so most texts are told by two short searches.
    """
    text = F.coalesce("text", F.lit(""))
    marked = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(MARKED)
    found = F.contains(text, F.lit("AKIA")) | marked | text.rlike(HEX)
    return docs.withColumn(name, F.when(found, F.sha2(text.cast("binary"), 256)))


def _apart(id_: Column) -> Column:
    """A join key for rows without a digest, spread evenly and equal to no digest."""
    return F.concat(F.lit("-"), F.xxhash64(id_, F.monotonically_increasing_id()).cast("string"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, the digest of base spans, and all spans, of every text."""
    keyed = _keyed(docs.select("doc_id", "text")).select("doc_id", "_digest", F.when(F.col("_digest").isNotNull(), F.col("text")).alias("text"))
    keyed = written(keyed, "secret-texts")
    texts = keyed.where("_digest is not null").groupBy(F.col("_digest").alias("digest")).agg(F.first("text").alias("text"))
    found = spans_of(written(texts, "secret-distinct"))
    spans = F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind")))
    by_text = found.groupBy("digest").agg(spans.alias("spans"))
    base = F.filter("spans", lambda s: s["ord"] <= 2)
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    by_text = by_text.select("digest", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
    by_text = written(by_text, "secret-spans")
    out = keyed.select("doc_id", F.coalesce("_digest", _apart(F.col("doc_id"))).alias("digest")).join(by_text, "digest", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *(F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")), F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All rows, with every span of their texts replaced by ``mark`` and ``n_chars`` counted anew."""
    columns, key = docs.columns, fresh("_digest", docs)
    keyed = written(_keyed(docs, key), "secret-keyed")  # texts are searched once
    hits = keyed.select("text", F.col(key).alias("digest")).where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
    texts = written(hits, "secret-distinct")
    found = spans_of(texts)
    order = Window.partitionBy("digest").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("_before", before).withColumn("_new", (F.col("_before").isNull() | (F.col("start") > F.col("_before"))).cast("int"))
    islands = opened.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("digest", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = islands.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cut = texts.join(lists, "digest")
    edges = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"])), F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length("text"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = F.transform(edges, lambda e: F.col("text").substr(e["a"] + 1, e["b"] - e["a"]))
    other, made = fresh("_of", keyed), fresh("_clean", keyed)
    clean = written(cut.select(F.col("digest").alias(other), F.array_join(pieces, mark).alias(made)), "secret-clean")
    # only rows with a match meet the cleaned texts
    rest = keyed.where(F.col(key).isNull()).select(*columns)
    hit = keyed.where(F.col(key).isNotNull()).join(clean, F.col(key) == F.col(other), "left")
    text = F.coalesce(made, "text")
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rest.unionByName(hit.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in columns)))
