"""Near-duplicate documents by bottom-k sketches of their shingles, verified exactly.

One hash function orders shingles; a document's sketch is its ``k`` smallest
values, the whole set if that is smaller. Equal sets become one class first, so
exact copies cost one row. Runs of consecutive sketch values are the entries of
an inverted index: where two sets are similar, some run of the union's smallest
values is common to both, and then stands as a run in both sketches. Runs are
of four values (three in small sets, two in the smallest), which keeps apart
documents that share only a passage. For sets that lie whole in their sketches
two common runs are certain at a similarity of 0.8; for larger ones they are
missed with a probability of about 3e-7 at exactly 0.8 and less above.

Within a list every member is paired with one pivot, the sketches of each pair
estimate its similarity over the union's smallest values, and what may reach
the threshold is verified on full sets. Lists whose members then lie in several
components are open: stragglers outside the list's largest component are
compared with all its members, in blocks that get each set once and return
links to components, not pairs. A long open list of unrelated documents is
first divided by a second run, which similar sets share as well. So a group of
copies costs one comparison a member, and no link between members of a list is
lost. Components are found in
Spark.

Defined results: null or empty text, or text of white space, has no shingle, is
linked with nothing and stays; fewer words than a shingle needs make one
shingle; repeated rows fall in one class; null ids take part and never name a
component with others; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map, drop_written, fresh, whole_groups, written
from aspectra.llm.components import components

SKETCH = 80
SURE = 0.25
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)
_rng = np.random.default_rng(90210)
PLACES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Sets on either side of a block; members from which a list of unrelated documents is divided by a second run.
BLOCK = 256
LONG_LIST = 2048
#: Class ids that may be broadcast to find the texts of candidates; beyond, a shuffled join does it.
BROADCAST_IDS = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, most: int = 1 << 20) -> np.ndarray:
    """Hashes of the words of A-Z lower-cased text; long texts in slices that end at white space."""
    raw = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw):  # up to a space
            step = SPACES[raw[end : end + 4096]]
            if step.any():
                end += int(step.argmax())
                break
            end += len(step)
        part = raw[at:end]
        at = end
        inside = ~SPACES[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        chars = np.flatnonzero(inside)
        first = np.searchsorted(chars, starts)
        place = np.arange(len(chars)) - np.repeat(first, np.diff(np.append(first, len(chars))))
        # beyond 256 bytes of a word the place enters by a power of its round
        values = LOWER[part[chars]] * PLACES[place & 255]
        far = place >> 8
        if far.any():
            values = mixed(values + far.astype(np.uint64) * PLACES[1])
        out.append(mixed(np.add.reduceat(values, first)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, as signed numbers."""
    hashes = word_hashes(text or b"")
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    width = min(words, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * STEPS[j]
    return np.unique(mixed(total).view(np.int64))


def sketches(docs: DataFrame, words: int, k: int = SKETCH) -> DataFrame:
    """doc_id, hash of the text, set size, class (a digest of the set) and the k smallest values of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, lists = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, words)
                sizes.append(len(own))
                classes.append(class_of(own))
                lists.append(own[:k])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), values], ["doc_id", "text_key", "n_shingles", "cls", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, make, "doc_id long, text_key long, n_shingles long, cls long, sketch array<long>")


def class_of(own: np.ndarray) -> int:
    """Digest of a set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """Class and full set of each text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [shingle_set(x, words) for x in batch.column(0).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in lists], pa.int64()), values], ["cls", "shingles"])

    return arrow_map(texts.select(F.col("text").cast("binary").alias("text")), make, "cls long, shingles array<long>")


def run_keys(sketch: Column, n: Column) -> Column:
    """Keys of the runs of a sketch: of four values, of three in small sets, of two in the smallest."""

    def runs(width: int) -> Column:
        last = F.size(sketch) - (width - 1)
        keys = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.lit(width), *(F.get(sketch, i + (j - 1)) for j in range(width))))
        return F.when(last >= 1, keys).otherwise(F.array().cast("array<bigint>"))

    none = F.array().cast("array<bigint>")
    # with d of n values apart, n - d common ones lie in d + 1 runs: three in one from a union of 6 on, four from 16 on.
    # Long lists are divided by a second key, so each two similar sets share two: sets of 5 and 6 by their runs of two
    return F.array_distinct(F.concat(F.when(n >= 13, runs(4)).otherwise(none), F.when((n >= 5) & (n <= 20), runs(3)).otherwise(none), F.when((n >= 4) & (n <= 6), runs(2)).otherwise(none)))


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return F.col(a) * 100 >= F.col(b) * percent if a == b else (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def block_links(own: list[np.ndarray], root_x: np.ndarray, others: list[np.ndarray], root_y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``own``, row of ``others``) in different components that reach the threshold."""
    sizes = [np.array([len(x) for x in part], np.int64) for part in (own, others)]
    values = np.concatenate([*own, *others])
    owner = np.repeat(np.arange(len(own) + len(others)), np.concatenate(sizes))
    distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
    several = times[column] > 1  # a value of one set alone is in no intersection
    number = np.cumsum(times > 1) - 1
    owner, column = owner[several], number[column[several]]
    common = np.zeros((len(own), len(others)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(own) + len(others), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        common += part[: len(own)] @ part[len(own) :].T
    union = sizes[0][:, None] + sizes[1][None] - common
    return np.nonzero((common * 100 >= union * percent) & (root_x[:, None] != root_y[None]))


class Search:
    """Links between classes at a similarity of ``percent`` or more."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, k: int, long_list: int | None):
        self.docs, self.classes, self.words, self.percent, self.k, self.long_list = docs, classes, words, percent, k, long_list
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(cls, shingles) of the classes in ``ids``, from one text of each."""
        wanted = written(ids.join(self.classes.select("cls", "first_id"), "cls"), "wanted")
        firsts = wanted.select("first_id").distinct()
        chosen = F.broadcast(firsts) if wanted.count() <= BROADCAST_IDS else firsts
        texts = self.docs.select(F.col("doc_id").alias("_doc_id"), "text").join(chosen, F.col("_doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        # an id may stand for several texts: each set names its own class
        sets = full_sets(texts, self.words).join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        return written(sets, "sets", "none")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of those pairs that reach the threshold on full sets."""
        side = lambda c: self.classes.select(F.col("cls").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, self.k)
        shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
        whole = (F.col("n_a") <= self.k) & (F.col("n_b") <= self.k)
        common = F.size(F.array_intersect("s_a", "s_b"))
        exact = common * 100 >= (F.col("n_a") + F.col("n_b") - common) * self.percent
        judged = both.select("a", "b", whole.alias("whole"), F.when(whole, exact).otherwise(shared >= (self.percent / 100 - SURE) * F.size(union)).alias("likely"))
        judged = written(judged.where("likely").select("a", "b", "whole"), "likely")
        open_ = judged.where("not whole")
        sets = self.sets_of(open_.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        left = open_.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("t")), "b")
        pair = left.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s")), "a")
        common = F.size(F.array_intersect("s", "t"))
        full = pair.where(common * 100 >= (F.size("s") + F.size("t") - common) * self.percent).select("a", "b")
        out = written(full.unionByName(judged.where("whole").select("a", "b")), "links")
        drop_written(sets)
        return out

    def merge(self, found: DataFrame) -> None:
        self.links = found if self.links is None else self.links.unionByName(found)
        self.roots = components(self.links)

    def run(self) -> DataFrame:
        """(a, root) of classes linked with others."""
        keyed = self.classes.where("n_shingles >= 4").select("cls", "n_shingles", F.explode(run_keys(F.col("sketch"), F.col("n_shingles"))).alias("key"))
        lists = self.shared(keyed)
        self.merge(self.verified(written(self.starred(lists), "pairs")))
        open_ = self.open_lists(lists)
        unrelated = F.lit(False) if self.long_list is None else (F.col("m") > self.long_list) & (F.col("top") * 2 < F.col("m"))
        near = self.compared(open_.where(~unrelated))
        long = open_.where(unrelated)
        if long.isEmpty():
            self.merge(near)
            return self.roots
        # two runs tell most apart; a further one would leave the lists as they are, as one of the two is in each
        lists = self.divided(long)
        self.merge(near.unionByName(self.verified(written(self.starred(lists), "pairs"))))
        self.merge(self.compared(self.open_lists(lists)))
        return self.roots

    def shared(self, keyed: DataFrame) -> DataFrame:
        """Lists of two members or more."""
        keyed = written(keyed, "runs")
        first = F.min(F.struct("cls", "n_shingles"))
        several = keyed.groupBy("key").agg(F.count("*").alias("m"), first.alias("first")).where("m > 1")
        out = written(keyed.join(several.select("key", "m", F.col("first.cls").alias("pivot"), F.col("first.n_shingles").alias("n_pivot")), "key"), "lists")
        drop_written(keyed)
        return out

    def starred(self, lists: DataFrame) -> DataFrame:
        """Each member with its list's pivot. Sizes that rule a link out do not end the list: it stays open."""
        pairs = lists.where((F.col("cls") != F.col("pivot")) & similar_sizes("n_shingles", "n_pivot", self.percent))
        return pairs.select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()

    def open_lists(self, lists: DataFrame) -> DataFrame:
        """(key, cls, n_shingles, root, main, m, top) of lists with untried pairs in several components; main: the largest, of ``top`` members."""
        placed = lists.where("m > 2").select("key", "cls", "n_shingles").join(self.roots.withColumnRenamed("a", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        state = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("_top")).where("m > _top.n")
        return written(placed.join(state.select("key", "m", F.col("_top.n").alias("top"), F.col("_top.root").alias("main")), "key"), "open")

    def compared(self, open_: DataFrame) -> DataFrame:
        """(a, b): links of stragglers to components. Lists with one main component are treated together."""
        members = written(open_.select("main", "cls", "root").distinct(), "members")
        parts = members.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all"), F.ceil(F.count_if(F.col("root") != F.col("main")) / BLOCK).cast("int").alias("rest"))
        placed = members.join(parts, "main")
        at = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = placed.where("root <> main").select("main", "cls", "root", F.lit(0).alias("side"), at("rest").alias("i"), each("all").alias("j"))
        others = placed.select("main", "cls", "root", F.lit(1).alias("side"), at("all").alias("j"), each("rest").alias("i"))
        sets = self.sets_of(members.select("cls").distinct())
        rows = own.unionByName(others).join(sets, "cls").repartition("main", "i", "j").sortWithinPartitions("main", "i", "j", "side")
        percent = self.percent

        def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
            codes = np.column_stack([table.column(c).to_numpy() for c in ("main", "i", "j")])
            edges = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]).any(1), [True])))
            cls, root, side = (table.column(c).to_numpy() for c in ("cls", "root", "side"))
            column = table.column("shingles").combine_chunks()
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                cut = a + int((side[a:b] == 0).sum())
                if cut in (a, b):
                    continue
                sets = [values[ends[r] : ends[r + 1]] for r in range(a, b)]
                x, y = block_links(sets[: cut - a], root[a:cut], sets[cut - a :], root[cut:b], percent)
                found = np.unique(np.column_stack([cls[a:cut][x], root[cut:b][y]]), axis=0)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, ("main", "i", "j")):
                yield from judged(table)

        return written(arrow_map(rows.select("main", "i", "j", "side", "cls", "root", "shingles"), run, "a long, b long"), "links")

    def divided(self, large: DataFrame) -> DataFrame:
        """Members of long lists again, in lists of two runs each."""
        runs = self.classes.select("cls", F.explode(run_keys(F.col("sketch"), F.col("n_shingles"))).alias("other"))
        both = large.select("key", "cls", "n_shingles").join(runs, "cls").where("key <> other")
        return self.shared(both.select("cls", "n_shingles", F.xxhash64("key", "other").alias("key")))


def placed(docs: DataFrame, words: int, percent: int, k: int, long_list: int | None = LONG_LIST) -> DataFrame:
    """doc_id, text_key, n_shingles, cls, root and component_id of every row; the last three are null without shingles, component_id also without any id."""
    made = written(sketches(docs, words, k), "sketches")
    classes = written(made.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    roots = Search(docs, classes, words, percent, k, long_list).run()
    named = classes.select("cls", "first_id").join(roots.withColumnRenamed("a", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = written(named.join(least, "root").select("cls", "root", "component_id"), "named")
    rows = made.select("doc_id", "text_key", "n_shingles", "cls")
    none = F.lit(None).cast("long")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", none.alias("cls"), none.alias("root"), none.alias("component_id"))
    return rows.where("n_shingles > 0").join(of_class, "cls").select(*alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH, long_list: int | None = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles, cls, component_id and kept of every document; kept: no other comes before it in its component.

    Lists of more than ``long_list`` members, most of them unrelated, are divided by
    a second run; None compares every list as it is, block by block.
    """
    component = F.coalesce("component_id", "doc_id")
    return placed(docs, words, percent, k, long_list).select("doc_id", "n_shingles", "cls", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, long_list: int | None = LONG_LIST) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id, then of the smallest hash of its text; of equal ids and texts, one."""
    found = placed(docs, words, percent, SKETCH, long_list).where("root is not null")
    rows = written(found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), "component-rows")
    first = rows.groupBy("root").agg(F.sum("n").alias("all"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")).where("all > 1")
    first = written(first, "component-firsts")  # a component with very many rows can then be split in the join
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    judged = rows.join(first, "root").select("doc_id", "text_key", kept.alias("stays"), "n").where("not stays or n > 1")
    key = fresh("_text_key", docs)
    marked = docs.withColumn(key, F.xxhash64("text"))
    names = {c: fresh(f"_{c}", marked) for c in ("doc_id", "text_key", "stays")}
    copies = written(judged.select(*(F.col(c).alias(n) for c, n in names.items())), "copies")
    marked = marked.join(copies, F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & (F.col(key) == F.col(names["text_key"])), "left")
    once = marked.where(F.col(names["stays"]).isNull()).select(*docs.columns)
    repeated = marked.where(F.col(names["stays"])).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)
