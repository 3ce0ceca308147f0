"""Exact BPE ids at the cost of one encoding per distinct word.

A byte-level BPE vocabulary merges inside pre-tokens only, so the ids of a text
are the ids of its pre-tokens in order. Texts are cut into pre-tokens with array
operations, every pre-token is looked up by a 64-bit hash in a table, and only
those not seen before go to the tokenizers library's model. Texts with
characters on which Unicode versions or context-dependent case rules may
disagree, or with the strings of special tokens, go to the library whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE, HARD = range(5)
CHUNK_CHARS = 1 << 20
LONGEST = 4096
_classes: np.ndarray | None = None
_multipliers = np.random.default_rng(20240607).integers(1, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_codecs: dict[str, "WordCodec"] = {}


def char_classes() -> np.ndarray:
    """Class of every code point; HARD where Python's Unicode tables have no character."""
    global _classes
    if _classes is None:
        of = {"L": LETTER, "N": NUMBER}
        classes = np.fromiter((HARD if (c := unicodedata.category(chr(i))) == "Cn" else of.get(c[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        classes[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _classes = classes
    return _classes


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTable:
    """Open-addressing table from 64-bit hashes to consecutive numbers, with array lookups."""

    def __init__(self, bits: int = 16):
        self.size = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int32)
        slots = hashes & self.mask
        keys = self.keys[slots]
        hit = keys == hashes
        found[hit] = self.numbers[slots[hit]]
        open_ = np.flatnonzero(~hit & (keys != 0))
        while len(open_):
            at = (slots[open_] + np.uint64(1)) & self.mask
            slots[open_] = at
            keys = self.keys[at]
            hit = keys == hashes[open_]
            found[open_[hit]] = self.numbers[at[hit]]
            open_ = open_[~hit & (keys != 0)]
        return found

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slots = hashes & self.mask
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            self.keys[slots[free]] = hashes[free]
            won = free[self.keys[slots[free]] == hashes[free]]
            self.numbers[slots[won]] = numbers[won]
            placed = np.zeros(len(hashes), bool)
            placed[won] = True
            left = left[~placed[left]]
            slots[left] = (slots[left] + np.uint64(1)) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        """Number distinct new hashes from the present size on."""
        need = self.size + len(hashes)
        if need * 2 > len(self.keys):
            used = self.keys != 0
            keys, numbers = self.keys[used], self.numbers[used]
            self._room(max(self.bits + 1, int(need * 2).bit_length()))
            self._place(keys, numbers)
        self._place(hashes, np.arange(self.size, need, dtype=np.int32))
        self.size = need


class Words:
    """Pre-tokens of some texts: hashes and places in ``text``; ``doc_words[i]`` counts those of text i."""

    __slots__ = ("text", "starts", "ends", "hashes", "doc_words")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, doc_words: np.ndarray):
        self.text, self.starts, self.ends, self.hashes, self.doc_words = text, starts, ends, hashes, doc_words


def split_words(texts: list[str], spaces: bool) -> Words:
    """Pre-tokens of all texts at once.

    spaces: the byte-level pattern (a space belongs to the word after it, white
    space is kept, numbers are runs); else the word-end pattern (white space
    goes, each number character stands alone). No pre-token crosses texts.
    """
    text = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(text)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(text, none, none, none.astype(np.uint64), np.zeros(len(texts), np.int64))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = char_classes()[points]
    doc_starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    doc_starts = doc_starts[doc_starts < n]
    edge = np.ones(n, bool)
    np.not_equal(classes[1:], classes[:-1], out=edge[1:])
    edge[doc_starts] = True
    starts = edge.copy()
    is_space = classes == SPACE
    ends_run = np.ones(n, bool)
    ends_run[:-1] = edge[1:]
    last_of_doc = np.ones(n, bool)
    last_of_doc[:-1] = False
    last_of_doc[doc_starts[1:] - 1] = True
    if spaces:
        before = np.zeros(n, bool)
        before[1:] = points[:-1] == 0x20
        before[doc_starts] = False
        starts &= ~(before & ~is_space)
        starts |= is_space & ends_run & ~last_of_doc
    else:
        starts |= classes == NUMBER
    quotes = np.flatnonzero((points == 0x27) & edge & ends_run & ~last_of_doc & starts)
    if len(quotes):
        one = points[np.minimum(quotes + 1, n - 1)]
        inside = np.zeros(n + 2, bool)
        inside[1:n] = ~edge[1:]  # whether the character belongs to the run before it
        two = points[np.minimum(quotes + 2, n - 1)]
        pair = inside[np.minimum(quotes + 2, n)] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        single = np.isin(one, [ord(c) for c in "stmd"])
        for which, width in ((single, 2), (pair & ~single, 3)):
            at = quotes[which]
            starts[at + 1] = False
            after = at + width
            ok = after < n
            starts[after[ok]] |= inside[after[ok]]
    begin = np.flatnonzero(starts)
    stop = np.append(begin[1:], n)
    if not spaces:
        # a run of white space starts its own stretch, which is dropped
        kept = ~is_space[begin]
        begin, stop = begin[kept], stop[kept]
        space_edges = np.flatnonzero(is_space & edge)
        if len(space_edges) and len(begin):
            nxt = np.searchsorted(space_edges, begin, "right")
            limit = np.append(space_edges, n)[nxt]
            stop = np.minimum(stop, limit)
    if not len(begin):
        return Words(text, begin, stop, begin.astype(np.uint64), np.zeros(len(texts), np.int64))
    size = stop - begin
    if spaces:
        place = np.arange(n, dtype=np.int64)
        place -= np.repeat(begin, size)
        products = points.astype(np.uint64)
        products += np.uint64(1)
        products *= _multipliers[np.minimum(place, LONGEST - 1)]
        hashes = np.add.reduceat(products, begin)
    else:
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        place = at - np.repeat(begin, size)
        products = (points[at].astype(np.uint64) + np.uint64(1)) * _multipliers[np.minimum(place, LONGEST - 1)]
        hashes = np.add.reduceat(products, np.concatenate(([0], np.cumsum(size)[:-1])))
    long = np.flatnonzero(size >= LONGEST)
    if len(long):
        import xxhash

        for i in long:
            hashes[i] = xxhash.xxh64_intdigest(text[begin[i] : stop[i]].encode())
    hashes[hashes == 0] = 1
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    doc_words = np.diff(np.searchsorted(begin, bounds))
    return Words(text, begin, stop, hashes, doc_words)


def pieces_of(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    """Cut a very long text before spaces between ASCII letters, where a pre-token starts in any case."""
    if len(text) <= limit:
        return [text]
    import re

    out, at = [], 0
    seam = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
    while len(text) - at > limit:
        found = seam.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class WordCodec:
    """Ids of texts under one vocabulary file of the tokenizers library. ``most`` words are remembered at once."""

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spaces = self.tokenizer.normalizer is None
        self.letters = byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.table = WordTable()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.counts = np.zeros(1 << 14, np.int32)
        self.offsets = np.zeros(1 << 14, np.int64)
        self.filled = 0

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token (already normalised)."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def prepared(self, text: str) -> str | None:
        """The text as the pre-tokenizer sees it; None if only the library can tell."""
        if any(s in text for s in self.specials):
            return None
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            if (char_classes()[points] == HARD).any():
                return None
            if not self.spaces:
                if "İ" in text or "Σ" in text:
                    return None
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                    if "İ" in text or "Σ" in text:
                        return None
        return text if self.spaces else text.lower()

    def numbers(self, words: Words) -> np.ndarray:
        """The table's number of each pre-token; new ones are encoded and entered."""
        found = self.table.find(words.hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.table.size > self.most:
                self._forget()
                missing = np.arange(len(words.hashes))
            new, first = np.unique(words.hashes[missing], return_index=True)
            at = missing[first]
            ids: list[int] = []
            counts = []
            text, encode = words.text, self.word_ids
            for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist()):
                got = encode(text[s:e])
                counts.append(len(got))
                ids += got
            self._enter(new, counts, ids)
            found = self.table.find(words.hashes)
        return found

    def _enter(self, hashes: np.ndarray, counts: list[int], ids: list[int]) -> None:
        base = self.table.size
        self.table.add(hashes)
        if self.table.size > len(self.counts):
            self.counts = np.resize(self.counts, 2 * self.table.size)
            self.offsets = np.resize(self.offsets, 2 * self.table.size)
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.filled + len(ids)))
        sizes = np.array(counts, np.int64)
        self.counts[base : self.table.size] = sizes
        self.offsets[base : self.table.size] = self.filled + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words in order, and how many each has."""
        return gather(self.ids, self.offsets, self.counts, numbers)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of every text, in order; None counts as empty."""
        batch: list[tuple[int, int, str]] = []  # index, 1 if the text ends here, piece
        held, waiting = 0, []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            words = split_words([p for _, _, p in batch], self.spaces)
            ids, counts = self.gather(self.numbers(words))
            per_word = np.concatenate(([0], np.cumsum(counts)))
            ends = per_word[np.cumsum(words.doc_words)]
            start = 0
            for (index, last, _), end in zip(batch, ends.tolist()):
                waiting.append(ids[start:end])
                start = end
                if last:
                    yield index, waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
                    waiting.clear()
            batch.clear()

        for index, text in enumerate(texts):
            ready = self.prepared(text or "")
            if ready is None:
                if batch:
                    yield from flush()
                    held = 0
                yield index, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            parts = pieces_of(ready)
            for i, part in enumerate(parts):
                batch.append((index, i == len(parts) - 1, part))
                held += len(part)
                if held >= CHUNK_CHARS:
                    yield from flush()
                    held = 0
        if batch:
            yield from flush()


def gather(ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the id lists that ``numbers`` name."""
    many = counts[numbers]
    total = int(many.sum())
    if not total:
        return np.zeros(0, ids.dtype), many
    ends = np.cumsum(many, dtype=np.int64)
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(offsets[numbers] - (ends - many), many)
    return ids[at], many


def codec(path: str) -> WordCodec:
    """This process's codec of a vocabulary file; it stays for the next task of the same worker."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]
