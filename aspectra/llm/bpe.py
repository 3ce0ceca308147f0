"""BPE over a distinct-word table: each distinct word is encoded once, ids return by position.

Documents are taken in blocks, stretches of an input split of bounded size. One
pass sends each block's distinct words, dealt by hash over buckets, to the
tasks that encode them; a word meets its equals of all blocks there. A second
pass keeps of each block the numbers of its words in order. The two meet by
block: a document's ids are those of its words by position. Decoding joins ids
to the vocabulary's pieces, again once for each distinct word of a block.

A word is sent at most once for each block, so common words make no hot key;
what moves is the distinct words of blocks and the word numbers, both packed.
Blocks are named by partition and number, and both passes read the same files in
the same splits, so they name them alike, however often a task runs and however
often the plan reads a file; a checksum of documents and words guards that.
Rows that do not come straight from files are written first. Blocks are dealt
over twice as many partitions as the input has, so none grows with the input.

Defined results: null or empty text has no ids and decodes to an empty text;
texts with the strings of special tokens, or with characters unknown to
Python's Unicode tables, are encoded whole by the library; repeated rows and
null ids give a row each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from aspectra.llm.common import arrow_map, small_batches, written
from aspectra.llm.tokens import CHUNK_CHARS, WordCodec, WordTable, byte_letters, codec, pieces_of, split_words

BLOCK_CHARS = 12_000_000
MOST_BUCKETS = 2048
MOST_PARTITIONS = 65536
#: Physical operators that give each partition the same rows in the same order whenever they run.
STEADY = ("Scan parquet", "Scan orc", "Scan json", "Scan csv", "Scan text", "Project", "Filter", "Union", "ColumnarToRow", "WholeStageCodegen", "InputAdapter")
PACK = "zstd"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODED = "doc_id long, ids array<long>, decoded string"


def _pack(values: np.ndarray) -> bytes:
    """Bytes of an array by significance, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, PACK, asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, PACK, asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


class Block:
    """Documents with their words numbered by bucket, then hash."""

    def __init__(self, own: WordCodec, buckets: int, with_words: bool):
        self.own, self.buckets, self.with_words = own, buckets, with_words
        self.doc_ids: list[int | None] = []
        self.doc_words: list[int] = []
        self.whole: list[tuple[int, bytes]] = []  # documents that the library encodes whole
        self.table = WordTable(18)
        self.hashes: list[np.ndarray] = []
        self.words: list[str] = []
        self.numbers: list[np.ndarray] = []
        self.chars = 0
        self._parts: list[str] = []
        self._owners: list[int] = []
        self._held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number = len(self.doc_ids)
        self.doc_ids.append(doc_id)
        self.doc_words.append(0)
        self.chars += len(text or "")
        ready = self.own.prepared(text or "")
        if ready is None:
            if not self.with_words:
                self.whole.append((number, np.array(self.own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()))
            return
        for part in pieces_of(ready):
            self._parts.append(part)
            self._owners.append(number)
            self._held += len(part)
            if self._held >= CHUNK_CHARS:
                self._split()

    def _split(self) -> None:
        found = split_words(self._parts, self.own.spaces)
        for owner, n in zip(self._owners, found.doc_words.tolist()):
            self.doc_words[owner] += n
        self._parts, self._owners, self._held = [], [], 0
        numbers = self.table.find(found.hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first = np.unique(found.hashes[missing], return_index=True)
            at = missing[first]
            self.table.add(new)
            self.hashes.append(new)
            if self.with_words:
                self.words += [found.text[s:e] for s, e in zip(found.starts[at].tolist(), found.ends[at].tolist())]
            else:
                numbers = self.table.find(found.hashes)
        if not self.with_words:
            self.numbers.append(numbers)

    def close(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Order of the words by (bucket, hash), first word of each bucket, and a checksum of all."""
        if self._parts:
            self._split()
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        of = hashes % np.uint64(self.buckets)
        order = np.lexsort((hashes, of))
        edges = np.searchsorted(of[order], np.arange(self.buckets + 1))
        names = np.array([[i is None, i or 0] for i in self.doc_ids], np.int64).tobytes()
        return order, edges, zlib.crc32(hashes[order].tobytes(), zlib.crc32(names))


def _blocks(batches: Iterator[pa.RecordBatch], own: WordCodec, buckets: int, with_words: bool) -> Iterator[tuple[str, Block]]:
    """Blocks of a task's rows (doc_id, text)."""
    partition, number = TaskContext.get().partitionId(), 0
    block = Block(own, buckets, with_words)
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if block.chars >= BLOCK_CHARS:
                yield f"{partition}:{number}", block
                number, block = number + 1, Block(own, buckets, with_words)
            block.add(doc_id, text)
    if block.doc_ids:
        yield f"{partition}:{number}", block


def bucket_words(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """(block, bucket, first, checksum, words): distinct words of blocks by bucket, packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches, codec(path), buckets, True):
            order, edges, check = block.close()
            words = [block.words[i].encode() for i in order.tolist()]
            out: list[tuple] = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = words[edges[b] : edges[b + 1]]
                sizes = _pack(np.fromiter(map(len, own), np.uint32, len(own)))
                raw = b"".join(own)
                out.append((name, b, int(edges[b]), check, sizes, len(raw).to_bytes(8, "little") + pa.compress(raw, PACK, asbytes=True)))
            columns = list(zip(*out)) if out else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "bucket", "first", "checksum", "sizes", "words"])

    return arrow_map(rows, send, "block string, bucket long, first long, checksum long, sizes binary, words binary")


def encode_words(sent: DataFrame, path: str) -> DataFrame:
    """(block, first, checksum, counts, ids): ids of each row's words; a task encodes a word once for all blocks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, ids = [], []
            for sizes, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ends = np.cumsum(_unpack(sizes, "<u4")).tolist()
                data = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), PACK, asbytes=True)
                words = split_words([data[a:b].decode() for a, b in zip([0, *ends], ends)], own.spaces)
                got, many = own.gather(own.numbers(words))
                counts.append(_pack(many.astype("<u4")))
                ids.append(_pack(got.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["block", "first", "checksum", "counts", "ids"])

    return arrow_map(sent.select("block", "first", "checksum", "sizes", "words"), encode, "block string, first long, checksum long, counts binary, ids binary")


def word_positions(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """A row for each block: its documents, and the numbers of their words in order, packed."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches, codec(path), buckets, False):
            order, _, check = block.close()
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            numbers = rank[np.concatenate(block.numbers)] if block.numbers else np.zeros(0, np.uint32)
            values = [[name], [block.doc_ids], [block.doc_words], [check], [_pack(numbers)], [[i for i, _ in block.whole]], [[x for _, x in block.whole]]]
            types = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["block", "doc_ids", "doc_words", "checksum", "numbers", "whole", "whole_ids"])

    return arrow_map(rows, keep, "block string, doc_ids array<long>, doc_words array<long>, checksum long, numbers binary, whole array<long>, whole_ids array<binary>")


_pieces: dict[str, tuple[np.ndarray, pa.Array, pa.Array]] = {}


def pieces(path: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The table of ids, ascending, their bytes, and their decimal digits with a comma, of a byte-level vocabulary."""
    if path not in _pieces:
        own = codec(path)
        byte_of = {c: b for b, c in byte_letters().items()}
        found = {i: bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode() for piece, i in own.tokenizer.get_vocab(with_added_tokens=True).items()}
        found |= {i: token.content.encode() for i, token in own.tokenizer.get_added_tokens_decoder().items()}
        ids = sorted(found)
        _pieces[path] = np.array(ids, np.int64), pa.array([found[i] for i in ids], pa.large_binary()), pa.array([b"%d," % i for i in ids], pa.large_binary())
    return _pieces[path]


def piece_places(ids: np.ndarray, table: tuple[np.ndarray, pa.Array, pa.Array]) -> pa.Array:
    """Join ids to their rows of the table."""
    at = np.searchsorted(table[0], ids)
    if len(ids) and (at.max() >= len(table[0]) or (table[0][at] != ids).any()):
        raise ValueError("an id has no piece")
    return pa.array(at)


def runs_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Each run of ``counts`` values as one value. Offsets are 64 bits wide, so that no text is too long."""
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
    offsets = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), values.buffers()[2] or pa.py_buffer(b"")])


def join_pieces(ids: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, pa.Array, pa.Array]) -> tuple[pa.Array, pa.Array]:
    """Join ids to their pieces, in order: bytes and decimal ids of each of the runs of ``counts`` ids."""
    at = piece_places(ids, table)
    return runs_of(table[1].take(at), counts), runs_of(table[2].take(at), counts)


def _documents(encoded: pa.Table, position: dict, table: tuple[np.ndarray, pa.Array, pa.Array]) -> Iterator[tuple[int | None, int, bytes, bytes]]:
    """(doc_id, number of ids, decimal ids, decoded bytes) of a block's documents."""
    parts = sorted(zip(*(encoded.column(c).to_pylist() for c in ("first", "checksum", "counts", "ids"))), key=lambda p: p[0])
    if any(p[1] != position["checksum"] for p in parts):
        raise RuntimeError("the two passes saw different words in one block")
    counts = np.concatenate([_unpack(p[2], "<u4") for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    ids = np.concatenate([_unpack(p[3], "<u4") for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    numbers = _unpack(position["numbers"], "<u4")
    words, of_doc = pa.array(numbers.astype(np.int64)), np.array(position["doc_words"], np.int64)
    text, decimal = (runs_of(word.take(words), of_doc) for word in join_pieces(ids, counts, table))
    total = np.concatenate(([0], np.cumsum(counts[numbers])))
    ends = np.cumsum(of_doc)
    many = (total[ends] - total[ends - of_doc]).tolist()
    whole = dict(zip(position["whole"], position["whole_ids"]))
    for k, doc_id in enumerate(position["doc_ids"]):
        if k in whole:
            own = np.frombuffer(whole[k], "<u4").astype(np.int64)
            decoded, digits = (x[0].as_py() for x in join_pieces(own, np.array([len(own)]), table))
            yield doc_id, len(own), digits[:-1], decoded
        else:
            yield doc_id, many[k], decimal[k].as_py()[:-1], text[k].as_py()


def joined(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    """Bring words' ids back to their positions. digest: hashes of ids and decoded text instead of these."""
    spark = docs.sparkSession
    small_batches(spark)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # splits must not depend on how many executors there are just now
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    rows = docs.select("doc_id", "text")
    least, inputs = int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()
    buckets, dealt = min(MOST_BUCKETS, max(least, inputs)), min(MOST_PARTITIONS, max(least, 2 * inputs))
    encoded = encode_words(bucket_words(rows, path, buckets).repartition("bucket"), path)
    positions = word_positions(rows, path, buckets)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        table = pieces(path)
        out: list[tuple] = []
        for row in right.to_pylist():
            for doc_id, n, raw, decoded in _documents(left, row, table):
                if digest:
                    out.append((doc_id, n, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    out.append((doc_id, [int(x) for x in raw.split(b",")] if raw else [], decoded.decode("utf-8", "replace")))
        columns = list(zip(*out)) if out else [[]] * (4 if digest else 3)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string()) if digest else (pa.int64(), pa.list_(pa.int64()), pa.string())
        names = [f.split()[0] for f in (DIGEST if digest else CODED).split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    both = (part.repartition(dealt, "block").groupBy("block") for part in (encoded, positions))
    return next(both).cogroup(next(both)).applyInArrow(meet, DIGEST if digest else CODED)


def _steady(docs: DataFrame) -> bool:
    """Whether both passes see the same rows in each partition: files, and operators within a partition that give equal results."""
    query = docs._jdf.queryExecution()
    if not query.analyzed().deterministic():
        return False
    open_ = [query.executedPlan()]
    while open_:
        node = open_.pop()
        children = node.children()
        if not node.nodeName().startswith(STEADY) or (children.size() == 0 and not node.nodeName().startswith("Scan")):
            return False
        open_ += [children.apply(i) for i in range(children.size())]
    return True


def _stored(docs: DataFrame) -> DataFrame:
    """Rows that come straight from files; others are written first, so that both passes see the same."""
    return docs if _steady(docs) else written(docs.select("doc_id", "text"), "documents")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them."""
    return joined(_stored(docs), path, False)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the decimal ids and of the decoded text."""
    return joined(_stored(docs), path, True)
