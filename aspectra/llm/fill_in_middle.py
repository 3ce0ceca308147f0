"""Fill-in-the-middle rewriting, by run-length encoded character classes.

A text is held as its maximal runs of one class: where each starts, how many
units it has, how many lie before it, and how many bytes one unit takes. The run
that holds a cut is found by binary search over the cumulative counts, and the
cut's place in it is arithmetic: ``start + (cut - before) * step``. All texts of an
Arrow batch share one set of runs.

Units are tokens (white space, if any, with the word after it; white space at the
end of a text is one of its own) or code points. For tokens the classes are white
space and the rest: a run of a word is one unit, a run of white space none, or one
at the end. For code points they are the lengths of UTF-8 sequences, so that all
units of a run take the same number of bytes.

Cuts and forms follow a hash of the seed and the document's id, so every run draws
the same, in any partitioning.

Defined results: null text is empty, and plain; a null id is hashed as an empty
one; documents of one id get the same draws, repeated rows equal answers; text
with a sentinel in it stays plain; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map

# Fixed values of the contract: white space, sentinels, seed and percentages.
SPACE = bytes((32, *range(9, 14)))
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, REWRITTEN, SUFFIX_FIRST = "42", 50, 80
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"

_IS_SPACE = np.isin(np.arange(256), list(SPACE))
#: Class of a byte for code points: its sequence's length; bytes that go on with a sequence have none of their own.
_LENGTH = np.select([np.arange(256) < 0x80, np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 0, 2, 3], 4).astype(np.uint8)


@dataclass
class Runs:
    """The runs of some texts, one after the other in ``data``; ``first`` has the number of each text's first run, and one more."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    units: np.ndarray
    step: np.ndarray
    upto: np.ndarray
    first: np.ndarray

    @property
    def totals(self) -> np.ndarray:
        """Units of each text."""
        return self._upto(self.first[1:]) - self._upto(self.first[:-1])

    def _upto(self, run: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], self.upto))[run]

    def place(self, cut: np.ndarray) -> np.ndarray:
        """Byte place in ``data`` after so many units of each text."""
        goal = self._upto(self.first[:-1]) + cut
        run = np.minimum(np.searchsorted(self.upto, goal), max(0, len(self.upto) - 1))
        if not len(self.upto):
            return self.bounds[:-1].copy()
        inside = self.start[run] + (goal - (self.upto[run] - self.units[run])) * self.step[run]
        return np.where(cut == 0, self.bounds[:-1], inside)


def runs_of(texts: pa.StringArray, unit: str = "token") -> Runs:
    """The runs of texts without nulls."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low, high = int(bounds[0]), int(bounds[-1])
    own = data[low:high]
    if unit == "token":
        kind = _IS_SPACE[own]
    else:
        lead = _LENGTH[own]
        at = np.maximum.accumulate(np.where(lead > 0, np.arange(len(own)), 0))
        kind = lead[at]  # every byte of a sequence has its class
    opens = np.ones(len(own), bool)
    opens[1:] = kind[1:] != kind[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]] - low
    opens[begins] = True
    start = np.flatnonzero(opens)
    size = np.diff(np.append(start, len(own)))
    start, kind = start + low, kind[start]
    first = np.searchsorted(start, bounds)
    if unit == "token":
        units = (~kind).astype(np.int64)
        last = first[1:][first[1:] > first[:-1]] - 1
        units[last] = 1
        step = size
    else:
        step = kind.astype(np.int64)
        units = size // np.maximum(step, 1)
    return Runs(data, bounds, start, units, step, np.cumsum(units), first)


def rewritten(texts: pa.StringArray, draws: np.ndarray, unit: str, rate: int, suffix_first: int) -> list[pa.Array]:
    """The columns of MADE for texts without nulls and four draws each."""
    runs = runs_of(texts, unit)
    n, bounds = runs.totals, runs.bounds
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    left, right = runs.place(np.minimum(one, two)), runs.place(np.maximum(one, two))
    leads = np.concatenate(([0], np.cumsum((runs.data & 0xC0) != 0x80)))  # code points before each byte
    raw = memoryview(runs.data)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    forms, outputs, plain = [], [], np.ones(len(texts), bool)
    for i in range(len(texts)):
        a, d = int(bounds[i]), int(bounds[i + 1])
        text = bytes(raw[a:d])
        if not text or draws[i, 2] % 100 >= rate or p in text or s in text or m in text:
            forms.append("plain")
            outputs.append(text)
            continue
        plain[i] = False
        b, c = int(left[i]) - a, int(right[i]) - a
        if draws[i, 3] % 100 < suffix_first:
            forms.append("spm")
            outputs.append(b"".join((s, text[c:], p, text[:b], m, text[b:c])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, text[:b], s, text[c:], m, text[b:c])))
    return [pa.array(n), pa.array(forms, pa.string()), pa.array(leads[left] - leads[bounds[:-1]], mask=plain), pa.array(leads[right] - leads[left], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]


def draws_of(id_: Column, seed: str = SEED) -> Column:
    """Four numbers below 2**32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def transform(docs: DataFrame, unit: str = "token", rate: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """doc_id, number of units, form (plain, spm, psm), code points of prefix and middle, and the output text.

    ``rate`` and ``suffix_first`` are percents: of texts that are rewritten, and of
    these that start with the suffix.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"no such unit: {unit}")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, draws, texts = batch.columns
            drawn = draws.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            made = rewritten(texts, drawn, unit, rate, suffix_first)
            yield pa.RecordBatch.from_arrays([ids, *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", draws_of(F.col("doc_id"), seed).alias("draws"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, rewrite, f"doc_id {kind}, {MADE}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; sentinels of other forms are not looked for."""
    after = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    body = F.substring(output, len(PREFIX) + 1, F.length(output))
    middle = after(body, MIDDLE)
    psm = F.concat(upto(body, SUFFIX), middle, upto(after(body, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(body, PREFIX), MIDDLE), middle, upto(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The rewriting with digests in place of the texts: of the output, and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def twin() -> str:
    """The same in DuckDB's SQL, by lists of tokens."""
    space = r"\x20\x09-\x0D"
    hashed = "sha256('42:'||coalesce(CAST(doc_id AS VARCHAR),''))"
    draw = lambda i: f"CAST('0x'||substr(h,{1 + 8 * i},8) AS BIGINT)"
    cut = f"SELECT doc_id, text, t, len(t) AS n, least({draw(0)}%(len(t)+1),{draw(1)}%(len(t)+1)) AS a, greatest({draw(0)}%(len(t)+1),{draw(1)}%(len(t)+1)) AS b, CASE WHEN text='' OR contains(text,'<P>') OR contains(text,'<S>') OR contains(text,'<M>') OR {draw(2)}%100>=50 THEN 'plain' WHEN {draw(3)}%100<80 THEN 'spm' ELSE 'psm' END AS form FROM (SELECT doc_id, coalesce(text,'') AS text, {hashed} AS h, regexp_extract_all(coalesce(text,''),'[{space}]*[^{space}]+|[{space}]+') AS t FROM documents)"
    parts = f"SELECT *, coalesce(array_to_string(t[1:a],''),'') AS p, coalesce(array_to_string(t[a+1:b],''),'') AS m, coalesce(array_to_string(t[b+1:],''),'') AS s FROM ({cut})"
    out = f"SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>'||s||'<P>'||p||'<M>'||m ELSE '<P>'||p||'<S>'||s||'<M>'||m END AS o FROM ({parts})"
    between = lambda a, b: f"substr(o,strpos(o,'{a}')+3,strpos(o,'{b}')-strpos(o,'{a}')-3)"
    rest = "substr(o,strpos(o,'<M>')+3)"
    again = f"CASE form WHEN 'plain' THEN o WHEN 'spm' THEN {between('<P>', '<M>')}||{rest}||{between('<S>', '<P>')} ELSE {between('<P>', '<S>')}||{rest}||{between('<S>', '<M>')} END"
    return f"SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form<>'plain' THEN length(p) END AS prefix_chars, CASE WHEN form<>'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256, sha256({again}) AS restored_sha256 FROM ({out})"
