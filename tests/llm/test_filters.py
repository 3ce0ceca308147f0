from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from tests.llm.helpers import ODD, docs_of

from aspectra.llm import secrets, secrets_sql, url_filter

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    "AKIA" + "A" * 16 + " and client_id=abcd1234 key Ab3" + "x9" * 12 + " url=https://a.b/c", "token='abc' password=12345 passwd=123456", "é😀 secret = token=abcdefgh 0123456789abcdef01234567 AKIAAKIA" + "B" * 14,
    "x" * 50 + ' api_key:"zz.zz-zz" user=bob1 ' + "y" * 500 + " user=alice", "PASSWORD=abcdefK ſecret=abcdef", "token=aaaaaa" * 3, "login=me99 " + "z" * 150 + " deadbeefdeadbeefdeadbeef", "secret = token: abcdef", "AKIA" + "C" * 15, "a1" * 11, "token=abcdef", "token=abcdef",
    "0" * 23 + "g" + "f" * 24 + "AKIA" + "9" * 40,
]


def base_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_and_links(spark):
    texts = TEXTS + ODD
    df = docs_of(spark, texts).unionByName(docs_of(spark, ["token=abcdef"]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "cls"))
    rows = secrets.scan(df).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert "weak_id:25:43" in got[0].spans and "weak_secret" in got[0].spans and "endpoint" in got[0].spans
    assert got[3].spans.count("weak_id") == 1  # the second name is out of scope
    assert got[9].spans == ""  # a weak secret alone
    assert "weak_id" in got[6].spans
    assert secrets.scan(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = secrets.scan(docs_of(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def random_texts(n, seed=5):
    """Texts of parts, near and far, some at exactly the scope, wherever they start."""
    rng = random.Random(seed)
    weak = "Ab3" + "x9" * 12
    parts = ["AKIA" + "Q" * 17, "AKIA12", "token=abcdefgh", "Api_Key: 'zz99zz99'", "passwd=abc", "deadbeef" * 4, weak, f"{weak}==", "n" * 24, "2024-01-02/" * 3, "client_id=abcd1234", "USER: bob9", "url=https://a.b/c", "redis://h:1/x", "Host: abcd", "jdbc:pg://q", "ſecret=abcdef", "toKen=abcdef", "é😀", "\x0b", "\n"]
    for _ in range(n):
        text = "." * rng.randrange(0, 420)
        for _ in range(rng.randrange(1, 6)):
            text += rng.choice(parts) + rng.choice([" ", "", "." * rng.choice([150, 198, 199, 200, 201, 202, 300])])
        yield text
    for lead in range(0, 400, 20):
        for gap in (199, 200, 201):
            yield "." * (lead + 2) + "client_id=abcd1234" + " " * gap + weak
            yield "." * lead + " " + weak + " " * gap + "client_id=abcd1234"


def test_scan_is_that_of_the_twin(spark):
    texts = [*TEXTS, *ODD, *random_texts(400)]
    df = docs_of(spark, texts).unionByName(docs_of(spark, texts[:5], 10**6))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(secrets_sql.twin()).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in secrets.scan(df).collect()}
    assert len(want) == len(texts) + 5
    assert {i: (texts[i % 10**6], got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_masking(spark):
    texts = TEXTS + ODD
    df = docs_of(spark, texts)
    out = secrets.masked(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None or not base_spans(t):
            assert got[i].text == t or "[secret]" in got[i].text
        else:
            assert not base_spans(got[i].text) and "[secret]" in got[i].text
            assert got[i].n_chars == len(got[i].text)
    assert got[10].text == "[secret]"


def test_endpoints_need_a_reported_secret(spark):
    weak = "Ab3" + "x9" * 12
    texts = [f"url=https://a.b/c {weak}", f"url=https://a.b/c {weak} client_id=abcd1234", "url=https://a.b/c token=abcdefgh", "url=https://a.b/c", f"url=https://a.b/c {'.' * 150} {weak} {'.' * 150} client_id=abcd1234"]
    got = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",") if s} for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert got == {0: set(), 1: {"endpoint", "weak_secret", "weak_id"}, 2: {"endpoint", "assign"}, 3: set(), 4: {"endpoint", "weak_secret", "weak_id"}}


def test_masking_with_clashing_names(spark):
    df = docs_of(spark, ["token=abcdefgh", "plain", None]).selectExpr("*", "1 as digest", "2 as _digest", "3 as _Clean", "4 as _of", "5 as start")
    out = secrets.masked(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.digest, r._digest, r.start) for r in out.collect()) == [(0, "[secret]", 1, 2, 5), (1, "plain", 1, 2, 5), (2, None, 1, 2, 5)]


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.ORG/es/1?x=/y", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1"), ("http://example.org", "example.org", "", None),
        ("http://x.org/en/2", "x.org", "/en/2", "org/"), ("http://org/a", "org", "/a", "org/"), ("http://myexample.org/es/", "myexample.org", "/es/", "org/"), ("http://a.com/fr/1", "a.com", "/fr/1", "com/fr/"),
        ("http://a.com?q=/fr/", "a.com", "", None), ("no scheme", "", "", None), (None, "", "", None), ("x://y://z/p", "y:", "//z/p", None), ("http://ÀB.com/de/", "Àb.com", "/de/", "com/de/"),
    ],
)
def test_urls_and_rules(spark, url, host, path, rule):
    r = url_filter.judge(pages_of(spark, [(url, None)])).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    if rule:
        assert r.verdict == ("block" if rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")


def test_trust_and_distrust_follow_links(spark):
    rows = [
        ("http://good.org/a", '<a href="http://friend.net/x">f</a>'), ("http://friend.net/", "<a href='//friend2.net/'>"), ("http://friend2.net/", ""),
        ("http://bad.com/de/1", ""), ("http://farm.net/", '<a href="http://bad.com/de/1">b</a>'), ("http://farm2.net/", '<A HREF="https://FARM.net/z">'), ("http://alone.net/", None), (None, None),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages_of(spark, rows)).collect()}
    assert got == {0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    assert url_filter.judge(pages_of(spark, rows).limit(0)).count() == 0


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [("http://bad.com/de/1", ""), ("http://h0.net/", '<a href="http://bad.com/de/1">b</a>')]
    rows += [(f"http://h{i}.net/", f'<a href="http://h{i - 1}.net/">b</a>') for i in range(1, 31)]
    assert {r.verdict for r in url_filter.judge(pages_of(spark, rows)).collect()} == {"block"}


def brute_shares(pages, rules=url_filter.RULES, damping=0.85):
    """Trust shares by a dense solve of the same equations, with the mass of hosts without links sent back to the seeds."""
    import numpy as np

    hosts, seeds, weights = set(), [{}, {}], {}
    for host, says, targets in pages:
        hosts.add(host)
        for kind, word in enumerate(("allow", "block")):
            seeds[kind][host] = seeds[kind].get(host, 0) + (says == word)
        for t in targets:
            if t != host:
                weights[host, t] = weights.get((host, t), 0) + 1
    names = sorted(hosts | {n for e in weights for n in e})
    at = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (a, b), n in weights.items():
        w[at[a], at[b]] = np.log1p(n)
    ranks = []
    for kind in range(2):
        links = w if kind == 0 else w.T
        seed = np.zeros(len(names))
        for n, c in seeds[kind].items():
            seed[at[n]] = np.log1p(c)
        seed /= seed.sum()
        total = links.sum(1, keepdims=True)
        step = np.divide(links, total, out=np.tile(seed, (len(names), 1)), where=total > 0)
        x = seed
        for _ in range(2000):
            x = damping * x @ step + (1 - damping) * seed
        ranks.append(x)
    return {n: ranks[0][at[n]] / (ranks[0][at[n]] + ranks[1][at[n]]) for n in hosts if ranks[0][at[n]] + ranks[1][at[n]] > 0}


def test_shares_are_those_of_a_dense_solve(spark):
    """Two-label hosts only, so that there are no steps to a domain above."""
    import random

    rng = random.Random(4)
    hosts = [f"g{i}.org" for i in range(4)] + [f"n{i}.net" for i in range(30)] + [f"b{i}.com" for i in range(4)]
    rows, pages = [], []
    for h in hosts:
        path, says = ("/de/1", "block") if h.endswith(".com") else ("/a", "allow" if h.endswith(".org") else None)
        targets = [rng.choice(hosts) for _ in range(rng.randint(0, 3))]
        rows.append((f"http://{h}{path}", " ".join(f'<a href="http://{t}/">' for t in targets)))
        pages.append((h, says, targets))
    want = brute_shares(pages)
    got = {r.host: r.trust_share for r in url_filter.judge(pages_of(spark, [*rows, rows[0][:1] + ("",)][:-1])).collect()}
    assert {h for h, s in got.items() if s is not None} == set(want)
    for h, share in want.items():
        assert got[h] == pytest.approx(share, abs=2e-3)


def test_repeated_pages_are_judged_alike(spark):
    """Repeated rows and ids, null ids and more columns: a row each, and equal answers for equal pages."""
    rows = [(1, "http://a.example.org/es/x", "<a href='http://b.net/'>"), (2, "http://b.net/", None), (None, "http://b.net/", ""), (3, None, "<a href='http://b.net/'>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows * 3], "page_id long, url string, html string, host string, trust_share int")
    got = [tuple(r) for r in url_filter.judge(df).collect()]
    assert len(got) == 12
    assert {x: got.count(x) for x in set(got)} == dict.fromkeys(set(got), 3)
    assert {r[0]: r[4] for r in got}[1] == "block"
