"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

Every token (run of letters, without case) has a score: the log-odds that a
document with it is toxic, less a drift, so that clean text sinks. The odds have
nested Dirichlet priors: the corpus's for a token's first letters, theirs for
its first few more, and so on to the token itself. One linear scan over a text finds all maximal scoring segments
(Ruzzo and Tompa); a token's repeats within a segment add nothing to the
segment's score. Best segments of clean text follow an extreme-value law; its
two parameters, fitted on clean training texts, give each segment a p-value
for the text's length. A document's passages are those that are significant;
the p-value of its best one and the sum over all of them enter a logistic
curve, which gives the score.

The training rows are a bounded sample: the labelled rows, at most ``per_class``
of each label, first by hash of the id. Their texts are counted in the
executors; the driver gets the scores of at most ``most_units`` tokens and one
short row for each training document. Scoring covers whole texts of all rows.

Defined results: null or empty text scores like text without any toxic token;
null ids are scored and never trained on; a label that is null or not 0 or 1 is
no label; of repeated labels the largest counts; of an id's texts the least is
learnt from, once; with one class only, every
score is its share; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map, crc_fold, written
from aspectra.llm.tokens import _multipliers as MULTIPLIERS
from aspectra.llm.tokens import CHUNK_CHARS, WordTable, char_classes, pieces_of, split_words

#: Numbers of first letters with odds of their own; the token follows as the last kind.
HEADS = (4, 5, 6, 8)
#: Tokens whose scores a worker remembers at once.
REMEMBERED = 1_000_000
DRIFT = 0.8
STRENGTH = 4.0
SIGNIFICANT = 0.01
SPANS = "array<struct<first_char: long, end_char: long, p: double>>"
SCORED = f"doc_id long, score double, n_passages int, first_char long, end_char long, best_p double, passages {SPANS}"


class Runs:
    """Tokens of some texts: hashes, text numbers, and where each starts and ends in its text."""

    def __init__(self, texts: list[str]):
        words = split_words(texts, spaces=False)
        docs = np.repeat(np.arange(len(texts)), words.doc_words)
        self.points = np.frombuffer(words.text.encode("utf-32-le", "surrogatepass"), "<u4")
        letters = char_classes()[self.points[words.starts]] == 1
        self.at, stop = words.starts[letters], words.ends[letters]
        self.size = stop - self.at
        self.hashes, self.docs = words.hashes[letters], docs[letters]
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1][self.docs]
        self.begin, self.end = self.at - first, stop - first

    def units(self, which: np.ndarray) -> list[np.ndarray]:
        """Hashes of the first letters of the chosen tokens, shortest first, then of the tokens."""
        at, size = self.at[which], self.size[which]
        out, total, done = [], np.zeros(len(at), np.uint64), 0
        for k in HEADS:
            for j in range(done, k):
                letters = self.points[np.minimum(at + j, len(self.points) - 1)].astype(np.uint64) + np.uint64(1)
                total = total + np.where(j < size, letters * MULTIPLIERS[j], np.uint64(0))
            done = k
            out.append(np.maximum(total, np.uint64(1)))
        return [*out, self.hashes[which]]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time.

    Only positive scores open or extend one, so runs of others cost nothing.
    """
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    rights = total[at].tolist()
    lefts = (total[at] - scores[at]).tolist()
    found: list[list] = []  # start, end, sum before, sum after, nearest earlier one with a lower sum before
    for place, low, high in zip(at.tolist(), lefts, rights):
        start, j = place, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append([start, place + 1, low, high, j])
    return [(s, e, high - low) for s, e, low, high, _ in found]


def damped(scores: np.ndarray, hashes: np.ndarray) -> tuple[list[tuple[int, int, float]], int]:
    """All maximal segments of the whole text, scored without repeats within each, and the text's length without these.

    A segment's score is the best sum in it once repeats of a token with a
    positive score count nothing; segments don't take from each other.
    """
    found = segments(scores)
    at = np.flatnonzero(scores > 0)
    if len(at) < 2:
        return found, len(scores)
    starts = np.array([a for a, _, _ in found])
    owner = np.searchsorted(starts, at, "right")  # every positive score stands in a segment
    order = np.lexsort((at, hashes[at], owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[at][order][1:] == hashes[at][order][:-1])
    again = at[order[1:][same]]
    if not len(again):
        return found, len(scores)
    once = scores.copy()
    once[again] = 0.0
    for k in np.unique(np.searchsorted(starts, again, "right") - 1).tolist():
        a, b, _ = found[k]
        total = np.concatenate(([0.0], np.cumsum(once[a:b])))
        found[k] = (a, b, float((total - np.minimum.accumulate(total)).max()))
    return found, len(scores) - len(again)


@dataclass
class Model:
    """Log-odds of units by hash for each kind, the extreme-value law of clean text, and the logistic curve."""

    kinds: list[tuple[np.ndarray, np.ndarray]]
    scale: float = 1.0
    shift: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def _tables(self) -> list[WordTable]:
        if "_made" not in self.__dict__:
            self._made = []
            for keys, _ in self.kinds:
                self._made.append(WordTable())
                if len(keys):
                    self._made[-1].add(keys)
            self._forget()
        return self._made

    def _forget(self) -> None:
        self._seen, self._values = WordTable(), np.zeros(1 << 14)

    def odds(self, units: list[np.ndarray]) -> np.ndarray:
        """Of the longest kind that is known."""
        out = np.zeros(len(units[0]))
        for table, (_, values), hashes in zip(self._tables(), self.kinds, units):
            found = table.find(hashes)
            if len(values):
                out = np.where(found >= 0, values[found], out)
        return out

    def token_scores(self, runs: Runs) -> np.ndarray:
        self._tables()
        found = self._seen.find(runs.hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self._seen.size > REMEMBERED:
                self._forget()
                missing = np.arange(len(found))
            new, first = np.unique(runs.hashes[missing], return_index=True)
            base = self._seen.size
            self._seen.add(new)
            if self._seen.size > len(self._values):
                self._values = np.resize(self._values, 2 * self._seen.size)
            self._values[base : self._seen.size] = self.odds(runs.units(missing[first])) - DRIFT
            found = self._seen.find(runs.hashes)
        return self._values[found]

    def p_value(self, best: float, n: int) -> float:
        """Chance that clean text of n tokens has a segment as good."""
        return float(-np.expm1(-np.exp(np.clip(self.shift + np.log(max(n, 1)) - self.scale * best, -700, 50))))

    def document(self, scores: np.ndarray, hashes: np.ndarray) -> tuple[list[float], list[tuple[float, int, int]], float]:
        """Features, the significant passages (p-value, first and last token plus one) in the text's order, and the best p-value."""
        found, n = damped(scores, hashes)
        if not found:
            return [0.0, 0.0, np.log1p(n)], [], 1.0
        values = [(self.p_value(s, n), a, b) for a, b, s in found]
        best = min(values)[0]
        strong = [v for v in values if v[0] <= SIGNIFICANT]
        mass = sum(min(50.0, -np.log(max(p, 1e-300))) for p, _, _ in strong)
        return [min(50.0, -np.log(max(best, 1e-300))), np.log1p(mass), np.log1p(n)], strong, best

    def score(self, features: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def without_case(text: str) -> str:
    """Lower case, in as many characters: one whose lower case is longer stays."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Text numbers and pieces of about a chunk; a very long text comes in pieces."""
    numbers: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        for part in pieces_of(without_case(text or "")):
            numbers.append(i)
            parts.append(part)
            held += len(part)
            if held >= CHUNK_CHARS:
                yield numbers, parts
                numbers, parts, held = [], [], 0
    if parts:
        yield numbers, parts


def document_scores(model: Model, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, token scores, starts, ends, hashes) of each text; places are those in the text itself."""
    waiting: list[tuple] = []
    offset, last = 0, -1
    for numbers, parts in _batches(texts):
        runs = Runs(parts)
        scores = model.token_scores(runs)
        edges = np.searchsorted(runs.docs, np.arange(len(parts) + 1))
        for k, number in enumerate(numbers):
            if number != last:
                if waiting:
                    yield last, *(np.concatenate(x) for x in zip(*waiting))
                waiting, offset, last = [], 0, number
            own = slice(edges[k], edges[k + 1])
            waiting.append((scores[own], runs.begin[own] + offset, runs.end[own] + offset, runs.hashes[own]))
            offset += len(parts[k])
    if waiting:
        yield last, *(np.concatenate(x) for x in zip(*waiting))


def _counted(sample: DataFrame) -> DataFrame:
    """Documents of each class with each unit, and the unit it extends; sums within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for numbers, parts in _batches(batch.column(0).to_pylist()):
                runs = Runs(parts)
                owner = np.array(numbers, np.int64)[runs.docs]
                parents = np.zeros(len(owner), np.uint64)
                for kind, units in enumerate(runs.units(np.arange(len(owner)))):
                    order = np.lexsort((owner, units))
                    u, o, p = units[order], owner[order], parents[order]
                    parents = units
                    new = np.ones(len(u), bool)
                    new[1:] = (u[1:] != u[:-1]) | (o[1:] != o[:-1])
                    u, o, p = u[new], toxic[o[new]], p[new]
                    if not len(u):
                        continue
                    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                    bad = np.add.reduceat(o, first)
                    good = np.diff(np.append(first, len(u))) - bad
                    columns = [pa.array(np.full(len(first), kind, np.int32)), pa.array(u[first].view(np.int64)), pa.array(p[first].view(np.int64)), pa.array(bad), pa.array(good)]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "unit", "parent", "bad", "good"])

    counted = arrow_map(sample.select("text", "toxic"), count, "kind int, unit long, parent long, bad long, good long")
    return counted.groupBy("kind", "unit").agg(F.min("parent").alias("parent"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 12_000, most_units: int = 50_000) -> Model:
    """Learn from labelled rows for which ``usable`` (over doc_id) holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = (np.zeros(0, np.uint64), np.zeros(0))
    if len(sizes) < 2:
        return Model([none] * (len(HEADS) + 1), constant=float(1 in sizes))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]

    def first(label: int) -> DataFrame:
        share = min(1.0, (1.2 * per_class + 1000) / sizes[label])  # the rest can't be among them, and need not be merged
        return known.where((F.col("toxic") == label) & (by_hash[0] <= int(-(2**63) + share * (2**64 - 2048)))).orderBy(*by_hash).limit(per_class)

    chosen = first(0).unionByName(first(1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).toArrow()
    chosen = docs.sparkSession.createDataFrame(chosen)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # repeats of an id are reduced to one row within tasks
    sample = written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")
    bad, good = (min(per_class, sizes[k]) for k in (1, 0))
    prior = float(np.log(bad / good))
    gain = F.abs(F.col("bad") / bad - F.col("good") / good) * F.sqrt(F.col("bad") + F.col("good"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("_gain"), "unit"))
    top = _counted(sample).where("bad + good >= 2").withColumn("_gain", gain).withColumn("_rank", rank).where(F.col("_rank") <= most_units)
    found = top.select("kind", "unit", "parent", "bad", "good").toArrow().to_pandas()
    kinds, odds = [], {}
    for kind in range(len(HEADS) + 1):
        own = found[found.kind == kind]
        above = np.array([odds.get(u, 0.0) for u in own.parent.tolist()])
        share = 1 / (1 + np.exp(-(above + prior)))
        rate = (own.bad.to_numpy() + STRENGTH * share) / (own.bad.to_numpy() + own.good.to_numpy() + STRENGTH)
        values = np.log(rate) - np.log1p(-rate) - prior
        odds = dict(zip(own.unit.tolist(), values.tolist()))
        kinds.append((own.unit.to_numpy(np.int64).view(np.uint64), values))
    model = Model(kinds)
    _calibrate(model, sample, sizes)
    return model


def _features(model: Model, sample: DataFrame, columns: str) -> DataFrame:
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for _, scores, _, _, hashes in document_scores(own, batch.column(0).to_pylist()):
                found, n = damped(scores, hashes)
                rows.append((max((s for *_, s in found), default=0.0), n, *own.document(scores, hashes)[0]))
            values = [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([*values, batch.column(1)], ["best", "n", "x1", "x2", "x3", "toxic"])

    return arrow_map(sample.select("text", "toxic"), measure, columns)


def _calibrate(model: Model, sample: DataFrame, sizes: dict[int, int]) -> None:
    """Fit the extreme-value law on clean texts, then the logistic curve on all, weighted to the true shares."""
    columns = "best double, n double, x1 double, x2 double, x3 double, toxic long"
    found = _features(model, sample, columns).toArrow().to_pandas()
    clean = found[(found.toxic == 0) & (found.best > 0) & (found.n >= 5)]
    if len(clean) >= 20:
        # best - ln(n)/scale is Gumbel with that scale: a fixed point of its spread
        scale = 1.0
        for _ in range(50):
            rest = clean.best - np.log(clean.n) / scale
            scale = min(20.0, max(0.05, float(np.pi / (np.sqrt(6) * max(1e-6, rest.std())))))
        rest = clean.best - np.log(clean.n) / scale
        model.scale, model.shift = scale, float(rest.mean() * scale - 0.5772156649)
    found = _features(model, sample, columns).toArrow().to_pandas()
    x = np.column_stack([np.ones(len(found)), found.x1, found.x2, found.x3])
    y = found.toxic.to_numpy(float)
    shares = {k: sizes[k] / max(1, (y == k).sum()) for k in (0, 1)}
    w = np.where(y == 1, shares[1], shares[0])
    w *= len(w) / max(1e-9, w.sum())
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - 0.01 * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
        beta += np.linalg.solve(hessian, gradient)
    model.weights = tuple(beta.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score, number of significant passages, the best one's place, and the places of all, for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        span = pa.struct([("first_char", pa.int64()), ("end_char", pa.int64()), ("p", pa.float64())])
        types = (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(span))
        for batch in batches:
            rows = []
            for _, scores, begin, end, hashes in document_scores(own, batch.column(1).to_pylist()):
                features, strong, p = own.document(scores, hashes)
                spans = [{"first_char": int(begin[a]), "end_char": int(end[b - 1]), "p": q} for q, a, b in strong]
                best = min(spans, key=lambda x: (x["p"], x["first_char"]), default={"first_char": -1, "end_char": -1})
                rows.append((own.score(features), len(spans), best["first_char"], best["end_char"], p, spans))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "score", "n_passages", "first_char", "end_char", "best_p", "passages"])

    return arrow_map(docs.select("doc_id", "text"), judge, SCORED)


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from all folds but the first and score every document."""
    model = fit(docs, labels, crc_fold("doc_id", folds) != 0)
    out = score(docs, model)
    held = F.coalesce(crc_fold("doc_id", folds) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "first_char", "end_char", "best_p", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """Documents whose score lies under the threshold, with all their columns."""
    model = fit(docs, labels, crc_fold("doc_id", folds) != 0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            clean = [own.score(own.document(scores, hashes)[0]) < threshold for _, scores, _, _, hashes in document_scores(own, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return arrow_map(docs, keep, docs.schema)
