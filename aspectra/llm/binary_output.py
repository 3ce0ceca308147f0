"""Token ids in files coded by a static range asymmetric numeral system.

Two passes. The first tokenises in document order and stages the ids; the ids'
counts, one for each entry of the vocabulary, become the frequency table that
all blocks share. The second codes independent blocks: within one, ``lanes``
interleaved coders take the ids in turn, so that array operations code and
decode all lanes at once. A block is a checkpoint: it states its first position
in the corpus, its coder states, its documents and the checksums of its stream
and of its ids, and decodes without any other block. A long document runs over
several blocks; its checksum is put together from its parts' (a crc32 is linear
in the bits, so parts are moved to their places and added).

File format: a folder with ``table``, the shared frequency table, and
``blocks``; both can be read in any later session. Parquet files are the
containers, so that Spark's own writers and readers make them work on any
store. ``table`` has a row for each id: version, id, slots (they sum to a power
of two; ids in ascending order take the slots). ``blocks`` has a row for each
block: start, ids, and ``payload``, which holds, little-endian: 8 bytes magic
``RANSBLK2``, u32 lanes, u32 ids, u32 words, u32 documents, u32 bytes of the
packed document list, u32 crc32 of that list and the words, u32 crc32 of the
ids, then the list (zlib; columns of i64 id, i64 whether there is one, i64 first
position, i64 ids in all, i64 ids before this block, i64 ids in it), u64 states
of the lanes and u32 words.

Defined results: null text is empty; every document ends with the end id, so
none is without ids; equal document ids are ordered by a hash of the text, then
by text; null ids come first; an empty table gives empty files; other columns
are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map, drop_written, shared_dir, written
from aspectra.llm.tokens import codec

MAGIC, VERSION = b"RANSBLK2", 2
HEAD = struct.Struct("<8s7I")
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BLOCK_IDS = 1 << 18
MOST_LANES = 1024
STAGED = "pid int, doc_id long, local_start long, n_tokens long, ids binary"
BLOCKS = "start long, ids long, payload binary"
PARTS = "doc_id long, start long, in_all long, n long, crc long"
CRC = 0xEDB88320


class Table:
    """Frequencies of ids scaled to a power of two; every id that occurs keeps at least one slot."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        self.bits = max(20, int(len(ids)).bit_length() + 3)
        slots = 1 << self.bits
        freq = np.maximum(1, np.floor(counts * ((slots - len(ids)) / max(1.0, counts.sum())))).astype(np.int64)
        if len(freq):
            freq[np.argmax(freq)] += slots - freq.sum()
        self._index(freq)

    @classmethod
    def stored(cls, ids: np.ndarray, slots: np.ndarray) -> Table:
        """The table of a file."""
        own = cls.__new__(cls)
        order = np.argsort(ids)
        own.ids, own.bits = ids[order].astype(np.int64), max(20, int(slots.sum()).bit_length() - 1)
        if len(ids) and 1 << own.bits != slots.sum():
            raise ValueError("a frequency table is damaged")
        own._index(slots[order].astype(np.int64))
        return own

    def _index(self, freq: np.ndarray) -> None:
        ids = self.ids
        self.freq = freq.astype(np.uint64)
        self.low = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
        self.symbol_at = np.repeat(np.arange(len(ids), dtype=np.int32), freq)
        self.rank = np.zeros(int(self.ids.max()) + 1 if len(ids) else 1, np.int32)
        self.rank[self.ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray, documents: np.ndarray | None = None) -> bytes:
        """A block's payload; documents: six numbers for each."""
        lanes = int(min(MOST_LANES, max(1, len(ids) // 256)))
        symbols = self.rank[ids]
        freq, low = self.freq[symbols], self.low[symbols]
        states = np.full(lanes, LOW, np.uint64)
        scale, room = np.uint64(self.bits), np.uint64(63 - self.bits)
        emitted: list[np.ndarray] = []
        for first in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, c = freq[first : first + lanes], low[first : first + lanes]
            x = states[: len(f)]
            full = x >= (f << room)
            emitted.append(x[full].astype("<u4"))
            x = np.where(full, x >> WORD, x)
            over = x // f
            states[: len(f)] = (over << scale) + (x - over * f) + c
        words = np.concatenate(emitted[::-1]) if emitted else np.zeros(0, "<u4")
        documents = np.zeros((0, 6), np.int64) if documents is None else documents
        listed, raw = zlib.compress(documents.astype("<i8").T.tobytes()), words.tobytes()
        head = HEAD.pack(MAGIC, lanes, len(ids), len(words), len(documents), len(listed), zlib.crc32(raw, zlib.crc32(listed)), zlib.crc32(ids.astype("<u4").tobytes()))
        return head + listed + states.astype("<u8").tobytes() + raw

    def decode(self, payload: bytes) -> np.ndarray:
        return self.decode_block(payload)[0]

    def decode_block(self, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the documents' numbers."""
        magic, lanes, n, n_words, n_docs, n_listed, words_crc, ids_crc = HEAD.unpack_from(payload)
        first = HEAD.size + n_listed
        at = first + 8 * lanes
        listed = payload[HEAD.size : first]
        if magic != MAGIC or len(payload) != at + 4 * n_words or zlib.crc32(memoryview(payload)[at:], zlib.crc32(listed)) != words_crc:
            raise ValueError("a block of token ids is damaged")
        documents = np.frombuffer(zlib.decompress(listed), "<i8").reshape(6, n_docs).T
        states = np.frombuffer(payload, "<u8", lanes, first).astype(np.uint64)
        words = np.frombuffer(payload, "<u4", n_words, at).astype(np.uint64)
        symbols = np.empty(n, np.int32)
        scale, mask, read = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), 0
        for first in range(0, n, lanes):
            x = states[: min(lanes, n - first)]
            slot = x & mask
            s = self.symbol_at[slot]
            symbols[first : first + len(x)] = s
            x = self.freq[s] * (x >> scale) + slot - self.low[s]
            empty = np.flatnonzero(x < LOW)
            x[empty] = (x[empty] << WORD) | words[read : read + len(empty)]
            read += len(empty)
            states[: len(x)] = x
        ids = self.ids[symbols].astype("<u4")
        if read != n_words or zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("a block of token ids doesn't decode to its checksum")
        return ids, documents


def crc_product(a: int, b: int) -> int:
    """Product of two bit-reversed polynomials modulo the crc's."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ CRC if b & 1 else b >> 1
        bit >>= 1
    return out


def crc_moved(crc: int, n: int) -> int:
    """What a part's crc32 adds to that of a text in which n bytes follow the part."""
    power, square = 1 << 31, 1 << 23  # of x: 0, and 8 for a byte
    while n:
        if n & 1:
            power = crc_product(power, square)
        square = crc_product(square, square)
        n >>= 1
    return crc_product(power, crc)


_tables: dict[str, Table] = {}


def _table(key: str, ids: np.ndarray, slots: np.ndarray) -> Table:
    if key not in _tables:
        _tables.clear()
        _tables[key] = Table.stored(ids, slots)
    return _tables[key]


def stage_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Ids of every document, ordered by document id over the partitions; ``local_start`` counts within one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pid, at = codec(tokenizer_path), TaskContext.get().partitionId(), 0
        narrow = own.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            starts, sizes, raw = [], [], []
            for _, ids in own.encode(batch.column(1).to_pylist()):
                ids = np.append(ids, end_id).astype("<u2" if narrow else "<u4")
                starts.append(at)
                sizes.append(len(ids))
                raw.append(ids.tobytes())
                at += len(ids)
            n = len(sizes)
            columns = [pa.array([pid] * n, pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["pid", "doc_id", "local_start", "n_tokens", "ids"])

    # rows of one id, null or not, are spread by their texts, and equal rows by their places
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "key", "place").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    return written(arrow_map(ordered, encode, STAGED), "ids")


def _ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(staged: DataFrame) -> DataFrame:
    """(id, n) over all documents, summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(_ids_of(raw, n), minlength=len(total))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "n"])

    return arrow_map(staged.select("ids", "n_tokens"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(staged: DataFrame, block_ids: int | None = None) -> str:
    """Code the staged ids; the folder with the frequency table and the blocks.

    The driver gets one count for each id of the vocabulary, nothing that grows
    with the documents, and one total for each partition goes to all tasks.
    """
    spark, block_ids = staged.sparkSession, block_ids or BLOCK_IDS
    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    found = id_counts(staged).toArrow().to_pandas()
    coder = Table(found["id"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    rows = pa.table({"version": pa.array([VERSION] * len(coder.ids), pa.int32()), "id": coder.ids, "slots": coder.freq.astype(np.int64)})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/table")
    sent = spark.sparkContext.broadcast((path, coder.ids, coder.freq.astype(np.int64)))
    totals = staged.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = staged.join(F.broadcast(bases), "pid").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _table(*sent.value)
        documents: list[tuple[int, ...]] = []
        parts: list[np.ndarray] = []
        size, then = 0, -1

        def block() -> pa.RecordBatch:
            payload = own.encode(np.concatenate(parts).astype(np.int64), np.array(documents, np.int64))
            first = documents[0][2] + documents[0][4]
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([size]), pa.array([payload], pa.binary())], ["start", "ids", "payload"])

        for batch in batches:
            for doc_id, start, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if documents and start != then:  # not the next document of the corpus
                    yield block()
                    documents, parts, size = [], [], 0
                ids, at, then = _ids_of(raw, n), 0, start + n
                while at < n:
                    take = min(n - at, block_ids - size)
                    documents.append((doc_id or 0, doc_id is not None, start, n, at, take))
                    parts.append(ids[at : at + take])
                    at, size = at + take, size + take
                    if size >= block_ids:
                        yield block()
                        documents, parts, size = [], [], 0
        if documents:
            yield block()

    arrow_map(placed, code, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files of a folder: doc_id, where each document starts, its ids' number and their crc32."""
    found = spark.read.schema("version int, id long, slots long").parquet(f"{path}/table").toArrow().to_pandas()
    if (found["version"] != VERSION).any():
        raise ValueError("files of another version")
    sent = spark.sparkContext.broadcast((path, found["id"].to_numpy(np.int64), found["slots"].to_numpy(np.int64)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _table(*sent.value)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                ids, documents = own.decode_block(payload)
                ends = np.cumsum(documents[:, 5])
                crcs = []
                for (_, _, _, n, before, here), end in zip(documents.tolist(), ends.tolist()):
                    crc, rest = zlib.crc32(ids[end - here : end].tobytes()), n - before - here
                    crcs.append(crc_moved(crc, 4 * rest) if rest else crc)
                names = pa.array(np.ascontiguousarray(documents[:, 0]), mask=documents[:, 1] == 0)
                columns = [names, *(pa.array(np.ascontiguousarray(documents[:, k])) for k in (2, 3, 5)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "in_all", "n", "crc"])

    parts = arrow_map(spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("payload"), decode, PARTS)
    whole = parts.groupBy("doc_id", "start", "in_all").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    checked = F.when(F.col("n") == F.col("in_all"), F.col("n")).otherwise(F.raise_error(F.lit("parts of a document are missing")).cast("long"))
    return whole.select("doc_id", "start", checked.alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Tokenise all documents, write them in coded files, and report what the files say."""
    staged = stage_ids(docs, tokenizer_path, end_id)
    path = write_files(staged)
    drop_written(staged)
    return read_files(docs.sparkSession, path)
