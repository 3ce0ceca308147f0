"""URL verdicts: explicit rules first, then trust and distrust spread over host links.

Hosts are the nodes. Edges are the absolute links of a page's markup, from its
host to the target's, weighted by the logarithm of their number, and the steps
between a host and the domain above it. Trust starts at hosts with pages that a
rule allows and follows the links (personalised PageRank); distrust starts at
hosts with blocked pages and follows them backwards, for a host that links to
bad ones is suspect. A host whose share of trust in both lies under the
threshold is blocked.

All is DataFrame operations; the iterations are written to the shared folder.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is allowed, as is every host that neither trust nor distrust
reaches; null markup has no links; repeated rows are judged alike and count as
pages each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import drop_written, written, written_with

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: (host, path, verdict) of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    bare = F.regexp_extract(rest, "(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(bare, "(?s)^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(bare, "(?s)^[^/]*(.*)$", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer one overrides
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    host = host_and_path(F.col("url"))[0]
    target = F.translate(F.regexp_replace("raw", "^[^@]*@", ""), UPPER, LOWER)
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("raw")).select("src", target.alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.log1p(F.count("*")).alias("weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Both ways between each host and the domain above it, down to two labels."""
    labels = F.split("host", "\\.")
    chain = F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda i: F.concat_ws(".", F.slice(labels, i + 1, F.size(labels))))
    steps = hosts.where(F.size(labels) > 2).select(chain.alias("c")).select(F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("e"))
    one = steps.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).where("src is not null and dst is not null").distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float = 5e-4, most: int = 4000, together: int = 3) -> DataFrame:
    """(kind, node, value): mass that stays with the seeds or follows shares of edges, until ``together`` rounds change no node's value by more than that share of it.

    A node reached for the first time is a change of its whole value, so chains
    of any length are followed. Mass at a node without links would go back to
    the seeds, which scales all values of a kind alike; ``judge`` divides by
    their sum, so it can be left out. seeds: (kind, node, value), edges: (kind,
    src, dst, share).
    """
    kept = seeds.select("kind", "node", (F.col("value") * (1 - damping)).alias("value"))
    sent = edges.select(F.col("kind").alias("of"), "src", "dst", "share")

    def moved(value: DataFrame) -> DataFrame:
        out = value.join(sent, (F.col("kind") == F.col("of")) & (F.col("node") == F.col("src")))
        return out.select("kind", F.col("dst").alias("node"), (F.lit(damping) * F.col("value") * F.col("share")).alias("value"))

    value = seeds.withColumn("before", F.lit(0.0))
    for done in range(0, most, together):
        last, now = value.select("kind", "node", F.lit(0.0).alias("value"), F.col("value").alias("before")), value.drop("before")
        for i in range(together):
            parts = moved(now).unionByName(kept)
            if i < together - 1:
                now = parts.groupBy("kind", "node").agg(F.sum("value").alias("value"))
        both = parts.withColumn("before", F.lit(0.0)).unionByName(last)
        open_ = (F.col("value") > 0) & (F.abs(F.col("value") - F.col("before")) > tolerance * F.col("value"))
        then, seen = written_with(both.groupBy("kind", "node").agg(F.sum("value").alias("value"), F.sum("before").alias("before")), "ranks", F.count_if(open_).alias("open"))
        settled = not seen["open"]
        if done:
            drop_written(value)
        value = then
        if settled:
            return value.drop("before")
    raise RuntimeError(f"trust did not settle in {most} rounds")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's share of trust (null: unknown)."""
    host, path = host_and_path(F.col("url"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    placed = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    hosts = written(placed.where("host <> ''").groupBy("host").agg(F.count_if(F.col("says") == "allow").alias("good"), F.count_if(F.col("says") == "block").alias("bad")), "hosts")
    edges = host_edges(pages).unionByName(domain_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = written(edges, "host-edges")
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    totals = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = written(both.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "host-shares")
    raw = hosts.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("host").alias("node"), F.log1p("good").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("host").alias("node"), F.log1p("bad").alias("value")))).alias("s")).select("s.*").where("value > 0")
    sums = raw.groupBy("kind").agg(F.sum("value").alias("sum"))  # two rows
    seeds = written(raw.join(F.broadcast(sums), "kind").select("kind", "node", (F.col("value") / F.col("sum")).alias("value")), "seeds")
    ranks = spread(seeds, shares, damping)
    sums = ranks.groupBy("kind").agg(F.sum("value").alias("sum"))
    ranks = ranks.join(F.broadcast(sums), "kind").groupBy("node").agg(F.sum(F.when(F.col("kind") == 0, F.col("value") / F.col("sum")).otherwise(0.0)).alias("trust"), F.sum(F.col("value") / F.col("sum")).alias("mass"))
    scored = hosts.select("host").join(ranks, F.col("host") == F.col("node")).select("host", (F.col("trust") / F.col("mass")).alias("trust_share"))
    by_host = written(scored, "host-scores")
    out = placed.join(by_host, "host", "left")
    spread_says = F.when(F.coalesce("trust_share", F.lit(1.0)) < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", spread_says).alias("verdict"), F.round("trust_share", 6).alias("trust_share"))
