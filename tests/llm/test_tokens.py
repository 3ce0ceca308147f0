from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, PATHS, docs_of

from aspectra.llm import binary_output, bpe, packing, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {k: Tokenizer.from_file(p) for k, p in PATHS.items()}


def random_texts(n=3000):
    rng = random.Random(5)
    alphabet = " '\n\tsretvmldxyzAÉé1²½’.,!😀 ßſΣ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_are_the_librarys(library, kind):
    texts = ODD + random_texts()
    got = {i: x.tolist() for i, x in tokens.WordCodec(PATHS[kind]).encode(texts)}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in library[kind].encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_forgetting_and_cutting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 40)
    texts = [t for t in random_texts(300)] + ["word " * 500 + "end", "x" * 5000]
    small = tokens.WordCodec(PATHS["byte"], most=20)
    got = {i: x.tolist() for i, x in small.encode(texts)}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in library["byte"].encode_batch(texts, add_special_tokens=False)]


def test_table_finds_what_was_added():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    table = tokens.WordTable(4)
    table.add(keys[:100])
    table.add(keys[100:])
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_bpe_by_distinct_words(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 60)
    texts = ODD + random_texts(60)
    df = docs_of(spark, texts).repartition(3)
    got = {r.doc_id: r for r in bpe.digest_documents(df, PATHS["byte"]).collect()}
    tk = library["byte"]
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATHS["byte"]).count() == 0


def test_bpe_of_any_plan(spark, library, tmp_path):
    """Files read twice, by filters, after Python and after a shuffle; none loses or doubles a word."""
    texts = ["alpha beta gamma", "delta alpha", None, "epsilon zeta eta theta", "beta beta"]
    docs_of(spark, texts).selectExpr("*", "'x' as _file").coalesce(1).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    assert bpe._steady(df) and bpe._steady(df.union(df)) and not bpe._steady(df.where("rand() < 2")) and not bpe._steady(df.repartition(2)) and not bpe._steady(df.mapInArrow(lambda b: b, df.schema))
    plans = [df.union(df), df.where("doc_id < 3").union(df.where("doc_id >= 1")), df.mapInArrow(lambda b: b, df.schema), df.repartition(2), df.where("rand() < 2"), df.union(df).orderBy("text")]
    for plan in plans:
        want = sorted(hashlib.sha256(",".join(map(str, library["byte"].encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest() for r in plan.select("text").collect())
        assert sorted(r.ids_sha256 for r in bpe.digest_documents(plan, PATHS["byte"]).collect()) == want


def test_ids_join_to_pieces():
    import pyarrow as pa

    table = np.array([0, 2, 5]), pa.array([b"a", b"", b"ccc"], pa.large_binary()), pa.array([b"0,", b"2,", b"5,"], pa.large_binary())
    text, ids = bpe.join_pieces(np.array([5, 0, 2, 0]), np.array([2, 0, 2]), table)
    assert (text.to_pylist(), ids.to_pylist()) == ([b"ccca", b"", b"a"], [b"5,0,", b"", b"2,0,"])
    assert [x.to_pylist() for x in bpe.join_pieces(np.zeros(0, np.int64), np.zeros(0, np.int64), table)] == [[], []]
    with pytest.raises(ValueError):
        bpe.join_pieces(np.array([1]), np.array([1]), table)


def test_coded_files_give_the_ids_back(spark, library, monkeypatch):
    monkeypatch.setattr(binary_output, "BLOCK_IDS", 50)
    df = docs_of(spark, ODD).unionByName(docs_of(spark, ["null id"]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "cls"))
    got = sorted(binary_output.write_and_read(df.repartition(3), PATHS["byte"]).collect(), key=lambda r: r.start)
    assert got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == list(range(len(ODD)))
    start = 0
    for r, t in zip(got, ["null id", *ODD]):
        ids = np.array([*library["byte"].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert binary_output.write_and_read(df.limit(0), PATHS["byte"]).count() == 0


def test_files_alone_are_enough(spark, library, tmp_path):
    """Another process reads them; a document runs over several blocks; rows of one id are many."""
    import subprocess
    import sys

    texts = ["word " * 700, "a", None, *ODD[:8]]
    df = docs_of(spark, texts).unionByName(docs_of(spark, ["same"]).where("doc_id = 0").selectExpr("cast(5 as long) doc_id", "text", "lang", "source", "n_chars", "cls").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("k"))
    path = binary_output.write_files(binary_output.stage_ids(df, PATHS["byte"]), 64)
    code = f"""
from aspectra.llm.binary_output import read_files
from aspectra.session import session
spark = session(2, 2)
for r in read_files(spark, {path!r}).orderBy("start").collect():
    print("ROW", r.doc_id, r.start, r.n_tokens, r.ids_crc32)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    got = [tuple(int(x) for x in line.split()[1:]) for line in out.splitlines() if line.startswith("ROW")]
    assert len(got) == len(texts) + 300
    assert [g[1] for g in got] == [sum(g[2] for g in got[:i]) for i in range(len(got))] and [g[0] for g in got] == sorted(g[0] for g in got)
    same = zlib.crc32(np.array([*library["byte"].encode("same").ids, 0], "<u4").tobytes())
    for i, t in enumerate(texts):
        crc = zlib.crc32(np.array([*library["byte"].encode(t or "").ids, 0], "<u4").tobytes())
        assert [g[3] for g in got if g[0] == i and (i != 5 or g[3] != same)] == [crc]
    assert sum(g[3] == same for g in got) == 300


@pytest.mark.parametrize(("a", "b"), [(b"", b"x"), (b"abc", b""), (b"abc", b"defgh" * 1000), (b"\0" * 5, b"\xff")])
def test_checksums_of_parts_add_up(a, b):
    assert binary_output.crc_moved(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 300000])
def test_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.int64)
    seen, counts = np.unique(np.append(ids, 7), return_counts=True)
    table = binary_output.Table(seen, counts)
    payload = table.encode(ids)
    assert (table.decode(payload) == ids).all()
    if n > 1000:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(payload) < 1.1 * entropy + 9000


def test_damage_is_seen():
    table = binary_output.Table(np.arange(5), np.ones(5, int))
    payload = bytearray(table.encode(np.arange(5).repeat(200)))
    payload[-1] ^= 1
    with pytest.raises(ValueError):
        table.decode(bytes(payload))


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 4096])
    counts: dict[int, int] = {}
    for _ in range(rng.choice([1, 30, 2000])):
        n = rng.randint(1, capacity) if seed % 2 else min(capacity, 1 + int(rng.expovariate(8 / capacity)))
        counts[n] = counts.get(n, 0) + 1
    made = packing.plan(counts, capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, list[int]] = {}
    for length, first, last, per_bin, first_bin, offset in made.steps:
        for r in range(first, last):
            ranks.setdefault(length, []).append(r)
            bins.setdefault(first_bin + (r - first) // per_bin, []).append((offset + (r - first) % per_bin * length, length))
    assert {k: sorted(v) == list(range(counts[k])) for k, v in ranks.items()} == dict.fromkeys(counts, True)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    lower = -(-sum(k * v for k, v in counts.items()) // capacity)
    assert lower <= made.bins == len(bins) <= max(lower + 1, 1.25 * lower)


def test_dominating_pairs_are_fixed():
    made = packing.plan({6: 2, 4: 2, 9: 1, 5: 1}, 10)
    assert made.bins == 4
    assert made.fixed_bins == 4
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_packing_documents(spark, library):
    texts = [*ODD, "word and more " * 4000]
    df = docs_of(spark, texts).unionByName(docs_of(spark, ["twice"])).unionByName(docs_of(spark, ["twice"]))
    rows = packing.pack_documents(df, PATHS["word"], 512).collect()
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    ids = np.array([*library["word"].encode(texts[-1], add_special_tokens=False).ids, 1], "<u4")
    mine = sorted(by_doc[len(texts) - 1], key=lambda r: r.piece)
    assert [r.start for r in mine] == list(range(0, len(ids), 512))
    assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[s : s + 512].tobytes()) for s in range(0, len(ids), 512)]
    fill: dict[int, list] = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in fill.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]]
        assert ends[-1] <= 512
    assert sum(len(v) for v in by_doc.values()) == len(rows)
    assert packing.pack_documents(df.limit(0), PATHS["word"]).count() == 0
