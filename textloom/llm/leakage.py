"""Problem 7: held-out items, whole or in part, inside corpus documents, by q-gram lemma filtering.

A document leaks an item if it has at least ten consecutive words of it, or at least half of its distinct four-word
runs. Words are maximal runs of letters and digits in lower case; texts are compared as their words joined by single
spaces, each run with the space before and after it.

A passage of c characters that stands in a document with e edits puts at least c - q + 1 - q * e of its q-grams on
neighbouring diagonals (place in the document minus place in the item); an edit shifts the diagonal. Shared q-grams are
therefore counted in bands of 2 * REACH diagonals that overlap by half, so that every REACH neighbouring diagonals lie in
one band whole. A region (a band of one document and item) is retained if it meets the bound of the shortest ten-word
passage of the item, whose budget is no edit (e = 0); all regions of a pair are if together they meet the bound of half
the item's runs, whose budget is the q-grams that begin in the other half: what is left are the q-grams that begin in the
first words of the kept runs, at least those of the shortest such words. q is the length of the shortest four-word run of
the items, within Q_LEAST and Q_MOST.

Retained regions are verified by banded alignment, word by word: the unbroken matches on their diagonals, chained to the
best alignment. A pair leaks by the longest unbroken match of its regions and by the item's runs that these cover.
Pairs without enough four-word runs in common can't meet either rule; their q-grams are not counted.

The items are a stated query set: they are taken in blocks of ITEM_BLOCK texts, which bounds what is sent to tasks, and
every document is read whole against each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import shingles
from textloom.session import spread

PASSAGE = 10
RUN = 4
SHARE = 0.5
#: Diagonals of half a band.
REACH = 8
Q_LEAST, Q_MOST = 4, 16
ITEM_BLOCK = 2_000
#: Characters of documents whose q-grams a task looks up at a time.
SLAB_CHARS = 4_000_000


def _spaced(words: list[str]) -> str:
    return f" {' '.join(words)} "


def _rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q neighbouring characters, by doubling."""
    mul = np.uint64(0x9E3779B97F4A7C15)
    out, done, power, bits = None, 0, codes.astype(np.uint64) + np.uint64(1), q
    width = 1
    while bits:
        if bits & 1:
            out = power[: len(power)] if out is None else shingles.mix(out[: len(power) - done] * mul + power[done:])
            done += width
        bits >>= 1
        if bits:
            power = shingles.mix(power[:-width] * mul + power[width:]) if len(power) > width else power[:0]
            width *= 2
    return out[: max(0, len(codes) - q + 1)]


def _run_hashes(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every four neighbouring words of one text."""
    n = len(word) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = word[:n]
    for step in range(1, RUN):
        run = shingles.mix(run * np.uint64(0x9E3779B97F4A7C15) + word[step : step + n])
    whole = doc[:n] == doc[RUN - 1 :]
    return run[whole], doc[:n][whole]


def _held(sorted_values: np.ndarray, bits: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, spot): places of x whose value is one of sorted_values, and its place there; 2**20 bits come first."""
    at = np.flatnonzero(bits[(x >> np.uint64(44)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(sorted_values, x[at]), len(sorted_values) - 1)
    real = sorted_values[spot] == x[at]
    return at[real], spot[real]


def _bits(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(values >> np.uint64(44)).astype(np.int64)] = True
    return bits


class Items:
    """A block of items, prepared for search."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in rows]
        self.words = [shingles.words(t or "") for _, t in rows]
        self.number: dict[str, int] = {}
        self.coded = [np.array([self.number.setdefault(w, len(self.number)) for w in own], np.int64) for own in self.words]
        self.runs = [[tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)] for w in self.words]
        known: dict[tuple, int] = {}
        #: a number for the run that begins at each word, and how many distinct runs the item has.
        self.run_ids = [np.array([known.setdefault(r, len(known)) for r in runs], np.int64) for runs in self.runs]
        self.distinct = np.array([len(set(runs)) for runs in self.runs], np.int64)
        self.half = np.where(self.distinct > 0, np.ceil(SHARE * self.distinct), 1 << 30).astype(np.int64)
        spaced = [_spaced(w) for w in self.words]
        self.q = max(Q_LEAST, min(Q_MOST, min((len(_spaced(list(r))) for runs in self.runs for r in runs), default=Q_MOST)))
        grams, item, place = [], [], []
        for i, text in enumerate(spaced):
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            if len(codes) >= self.q:
                h = _rolling(codes, self.q)
                grams.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.item = np.concatenate(item)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.bits = _bits(self.gram)
        self.one = np.array([self._passage(w) for w in self.words], np.int64)
        self.all = np.array([self._runs(i) for i in range(len(rows))], np.int64)
        word, counts = shingles.word_hashes([t for _, t in rows])
        run, owner = _run_hashes(word, np.repeat(np.arange(len(rows)), counts))
        order = np.lexsort((owner, run))
        run, owner = run[order], owner[order]
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])]) if len(run) else np.zeros(0, bool)
        self.four_item = owner[fresh]
        self.four, self.four_first = np.unique(run[fresh], return_index=True)
        self.four_first = np.append(self.four_first, len(self.four_item))
        self.four_bits = _bits(self.four)
        #: places at which a document has four-word runs of the item at least, if it leaks it.
        self.need = np.minimum(PASSAGE - RUN + 1, self.half)

    def _bound(self, chars: int, edits: int) -> int:
        return max(1, chars - self.q + 1 - self.q * edits)

    def _passage(self, words: list[str]) -> int:
        """The q-grams that a ten-word passage of these words shares at least."""
        sizes = [len(w) + 1 for w in words]
        return min((self._bound(sum(sizes[i : i + PASSAGE]) + 1, 0) for i in range(len(words) - PASSAGE + 1)), default=1 << 30)

    def _runs(self, i: int) -> int:
        """The q-grams that half of the item's runs share at least: runs that begin at different words have those to
        themselves that begin in these, of all q-grams of a run its first ones."""
        own: dict[tuple, int] = {}
        for k, run in enumerate(self.runs[i]):
            least = max(1, min(len(self.words[i][k]) + 1, len(_spaced(list(run))) - self.q + 1))
            own[run] = min(own.get(run, least), least)
        return max(1, sum(sorted(own.values())[: int(self.half[i])])) if own else 1 << 30


def _aligned(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(item place, length, diagonal, matched) of a region: its unbroken word matches, and the words of the best alignment
    that chains these (of two words or more) in the order of both sides."""
    i, j = np.nonzero(doc[:, None] == item[None, :])
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    if not len(i):
        return i, i, i, 0
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)]))
    size = np.diff(np.append(new, len(i)))
    begin, at = i[new], j[new]
    chain: list[tuple[int, int, int]] = []  # ends in both texts, words so far
    best = 0
    for k in sorted(np.flatnonzero(size > 1), key=lambda k: (begin[k], at[k])):
        before = max((m for x, y, m in chain if x <= begin[k] and y <= at[k]), default=0)
        chain.append((int(begin[k] + size[k]), int(at[k] + size[k]), before + int(size[k])))
        best = max(best, chain[-1][2])
    return at, size, begin - at, best


def _search(texts: list[str | None], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, matched words, longest unbroken match) of each text that leaks an item."""
    if not len(items.gram) or not len(items.four):
        return
    word, counts = shingles.word_hashes(texts)
    run, doc = _run_hashes(word, np.repeat(np.arange(len(texts)), counts))
    at, spot = _held(items.four, items.four_bits, run)
    width = items.four_first[spot + 1] - items.four_first[spot]
    likely, many = np.unique(np.repeat(doc[at], width) * len(items.ids) + items.four_item[shingles.spans(items.four_first[spot], width)], return_counts=True)
    likely = likely[many >= items.need[likely % len(items.ids)]]
    kept = np.unique(likely // len(items.ids))
    if not len(kept):
        return
    likely = np.searchsorted(kept, likely // len(items.ids)) * len(items.ids) + likely % len(items.ids)
    words = [shingles.words(texts[t]) for t in kept]
    spaced = [_spaced(w) for w in words]
    codes = np.frombuffer("".join(spaced).encode("utf-32-le"), "<u4")
    starts = np.cumsum([0, *map(len, spaced)])
    if len(codes) < items.q:
        return
    at, spot = _held(items.gram, items.bits, _rolling(codes, items.q))
    doc = np.searchsorted(starts, at, side="right") - 1
    inside = at + items.q <= starts[doc + 1]
    at, spot, doc = at[inside], spot[inside], doc[inside]
    width = items.first[spot + 1] - items.first[spot]
    rows = shingles.spans(items.first[spot], width)
    item, place = items.item[rows], items.place[rows]
    pair, where = np.repeat(doc, width) * len(items.ids) + item, np.repeat(at - starts[doc], width)
    of_likely = likely[np.minimum(np.searchsorted(likely, pair), len(likely) - 1)] == pair
    pair, where, place = pair[of_likely], where[of_likely], place[of_likely]
    half = (where - place) // REACH  # a band is two neighbouring halves
    order = np.lexsort((place, half, pair))
    pair, half, place, where = pair[order], half[order], place[order], where[order]
    if not len(pair):
        return
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(half) != 0)]))
    # distinct places of the item per half band
    fresh = np.ones(len(pair), np.int64)
    fresh[1:] = (np.diff(pair) != 0) | (np.diff(half) != 0) | (np.diff(place) != 0)
    count = np.add.reduceat(fresh, first)
    low, high = np.minimum.reduceat(where, first), np.maximum.reduceat(where, first)
    cell_pair, cell_half = pair[first], half[first]
    beside = np.zeros(len(first), bool)  # the half before belongs to the same pair and band
    beside[1:] = (cell_pair[1:] == cell_pair[:-1]) & (cell_half[1:] == cell_half[:-1] + 1)
    band = count.copy()
    band[1:][beside[1:]] += count[:-1][beside[1:]]
    begin = np.flatnonzero(np.concatenate([[True], cell_pair[1:] != cell_pair[:-1]]))
    end = np.append(begin[1:], len(first))
    kind = cell_pair[begin] % len(items.ids)
    # distinct places of the item per pair
    spread = np.lexsort((place, pair))
    fresh = np.ones(len(pair), np.int64)
    fresh[1:] = (np.diff(pair[spread]) != 0) | (np.diff(place[spread]) != 0)
    own_pairs = np.flatnonzero(np.concatenate([[True], np.diff(pair[spread]) != 0]))
    half_of_runs = np.add.reduceat(fresh, own_pairs) >= items.all[kind]
    passage = np.maximum.reduceat(band, begin) >= items.one[kind]
    coded: tuple[int, np.ndarray, np.ndarray] = (-1, at, at)  # the words of the document at hand, and where each begins
    for k in np.flatnonzero(half_of_runs | passage):
        t, i = int(cell_pair[begin[k]] // len(items.ids)), int(kind[k])
        cells = np.arange(begin[k], end[k])
        if not half_of_runs[k]:  # only bands that may hold a passage
            full = band[cells] >= items.one[i]
            full[:-1] |= full[1:] & beside[cells[1:]]
            cells = cells[full]
        if coded[0] != t:
            coded = (t, np.array([items.number.get(w, -1) for w in words[t]], np.int64), np.cumsum([0, *(len(w) + 1 for w in words[t])]))
        _, own, gap = coded
        covered: set[int] = set()
        longest = matched = 0
        for region in np.split(cells, np.flatnonzero(~beside[cells[1:]] | (np.diff(cells) != 1)) + 1):
            lo = max(0, int(np.searchsorted(gap, low[region].min(), side="right")) - 1)
            hi = int(np.searchsorted(gap, high[region].max() + items.q))
            at, size, _, most = _aligned(own[lo:hi], items.coded[i])
            longest, matched = max(longest, int(size.max(initial=0))), max(matched, most)
            long = size >= RUN
            if long.any():
                covered.update(items.run_ids[i][shingles.spans(at[long], size[long] - RUN + 1)].tolist())
        if longest >= PASSAGE or len(covered) >= items.half[i]:
            yield int(kept[t]), i, matched, longest


def leaked_items(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, matched_words, longest_match) of every document that leaks an item.

    matched_words and longest_match are those of the best alignment and the longest unbroken match of a region. Null and empty texts leak nothing
    and nothing leaks from them; rows repeated under one id count once; an empty side gives no rows.
    """
    schema = f"{item_id} long, {doc_id} long, matched_words int, longest_match int"
    docs = spread(corpus.select(F.col(doc_id).cast("long"), F.col(text)).where(F.col(doc_id).isNotNull() & (F.length(text) > 0)))
    ready = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and length(text) > 0")
    blocks = -(-ready.count() // ITEM_BLOCK)
    found = None
    for block in range(blocks):
        part = [(r["id"], r["text"]) for r in ready.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()]

        def search(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            own = Items(sorted(set(part)))
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                lo = 0
                while lo < len(ids):
                    hi, chars = lo, 0
                    while hi < len(ids) and (hi == lo or chars + len(texts[hi]) <= SLAB_CHARS):
                        chars += len(texts[hi])
                        hi += 1
                    rows = [(own.ids[i], ids[lo + t], m, u) for t, i, m, u in _search(texts[lo:hi], own)]
                    if rows:
                        a, b, c, d = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], [item_id, doc_id, "matched_words", "longest_match"])
                    lo = hi

        rows = docs.mapInArrow(search, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy(item_id, doc_id).agg(F.max("matched_words").alias("matched_words"), F.max("longest_match").alias("longest_match"))
