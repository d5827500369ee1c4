"""Benchmark decontamination by a BM25 index of test items and block-max WAND.

The items are the indexed side: few, counted before they are sent to tasks, split into shards of
bounded size, and sent in parts of bounded size.  Every passage of every training text is a query.  Impacts are divided by the item's score
for its own text, so one threshold holds for all items.  A passage's bounds for blocks of items decide
whether it is searched at all; block-max WAND then returns every item above the threshold, and each is
verified by the overlap of its question and of its answer with the passage.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordCodes, discard, stored, with_arrow_columns, words_of

_MARKS = "\"'()[]{}<>.,;:!?*_-–—…«»“”‘’¿¡|#$%&"
_BLOCKS = 64


def normal(word: str) -> str:
    """The word as it is compared: without marks around it, lower-cased."""
    return word.strip(_MARKS).lower()


@dataclass
class Item:
    item_id: int
    question: list[str]
    answer: list[str]


def halves(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item that doesn't part them: the halves of its words."""
    middle = (len(words) + 1) // 2
    return words[:middle], words[middle:]


class ItemShard:
    """Postings of up to some thousands of items of similar length, in at most 64 blocks of items."""

    def __init__(self, items: list[Item], vocabulary: dict[str, int], idf: np.ndarray, gram: int, k1: float = 1.2, b: float = 0.75, common: float = 0.04) -> None:
        self.ids = [x.item_id for x in items]
        self.longest = max(len(x.question) + len(x.answer) for x in items)
        self.block = -(-len(items) // _BLOCKS)
        self.gram, self.base = gram, len(vocabulary) + 1
        sizes = [len(x.question) + len(x.answer) for x in items]
        mean = sum(sizes) / len(sizes)
        postings: dict[int, list[tuple[int, float]]] = {}
        #: Run length and runs of each item's halves.
        self.question: list[tuple[int, np.ndarray]] = []
        self.answer: list[tuple[int, np.ndarray]] = []
        for i, item in enumerate(items):
            tf = Counter(vocabulary[w] for w in item.question + item.answer)
            weight = {t: idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * sizes[i] / mean)) for t, n in tf.items()}
            own = sum(weight.values())
            for t, x in weight.items():
                postings.setdefault(t, []).append((i, x / own))
            for own, half in ((self.question, item.question), (self.answer, item.answer)):
                n = self.run(half)
                own.append((n, self.grams(np.array([vocabulary[w] for w in half], np.int64), n)))
        self.items = {t: array("i", [i for i, _ in p]) for t, p in postings.items()}
        self.impacts = {t: array("d", [x for _, x in p]) for t, p in postings.items()}
        #: The blocks that hold each term, in order, and its greatest impact in each.
        self.bounds: dict[int, tuple[array, array]] = {}
        for t, p in postings.items():
            most: dict[int, float] = {}
            for i, x in p:
                at = i // self.block
                most[at] = max(most.get(at, 0.0), float(np.nextafter(np.float32(x), np.float32(2))))
            self.bounds[t] = array("i", most), array("f", most.values())
        self.highest = {t: max(x) for t, (_, x) in self.bounds.items()}
        #: Words of many items recur within a passage: the passage's bound takes for them what any item of
        #: a block can get from all of them at most, and sums the bounds of the other words.
        many = {t for t, p in postings.items() if len(p) > max(1, common * len(items))}
        all_common = np.zeros(len(items))
        for t in many:
            for i, x in postings[t]:
                all_common[i] += x
        self.common = np.maximum.reduceat(all_common, np.arange(0, len(items), self.block)).astype(np.float32)
        self._place_bounds([t for t in postings if t not in many], len(vocabulary))

    def _place_bounds(self, terms: list[int], n_words: int) -> None:
        """Bounds as passages sum them: a row for each term of at least an eighth of the blocks (the last row, of
        zeros, is that of all other words), lists for the rest, so that all together grow with the postings."""
        n_blocks = len(self.common)
        wide = [t for t in terms if 8 * len(self.bounds[t][0]) >= n_blocks]
        few = [t for t in terms if 8 * len(self.bounds[t][0]) < n_blocks]
        #: Word -> its row, or the number of rows and its list's number; the last is that of unknown words.
        self.place = np.full(n_words + 1, -1, np.int32)
        self.place[wide + few] = np.arange(len(terms))
        self.rows = np.zeros((len(wide) + 1, n_blocks), np.float32)
        for k, t in enumerate(wide):
            self.rows[k, self.bounds[t][0]] = self.bounds[t][1]
        self.starts = np.cumsum([0] + [len(self.bounds[t][0]) for t in few])
        self.listed = np.array([x for t in few for x in self.bounds[t][0]], np.int32)
        self.heights = np.array([x for t in few for x in self.bounds[t][1]], np.float32)

    def bound(self, term: int, block: int) -> float:
        blocks, heights = self.bounds[term]
        k = bisect_left(blocks, block)
        return heights[k] if k < len(blocks) and blocks[k] == block else 0.0

    def _sums(self, terms: np.ndarray, step: int) -> np.ndarray:
        """By every ``step`` terms and block: the sum of the terms' bounds."""
        place, n_wide = self.place[terms], len(self.rows) - 1
        out = self.rows[np.where(place < n_wide, place, n_wide)].reshape(-1, step, self.rows.shape[1]).sum(axis=1)
        words = np.flatnonzero(place >= n_wide)
        if len(words):
            of = place[words] - n_wide
            n = self.starts[of + 1] - self.starts[of]
            spots = np.repeat(self.starts[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cells = np.repeat(words // step, n) * out.shape[1] + self.listed[spots]
            out += np.bincount(cells, self.heights[spots], out.size).reshape(out.shape).astype(np.float32)
        return out

    def run(self, half: list[str]) -> int:
        """The run length an item's half is compared by: ``gram``, or all its words if fewer."""
        return min(self.gram, len(half))

    def grams(self, terms: np.ndarray, n: int) -> np.ndarray:
        """Distinct runs of ``n`` words, as numbers; runs with unknown words have none."""
        if not n or len(terms) < n:
            return np.empty(0, np.int64)
        out = np.zeros(len(terms) - n + 1, np.int64)
        known = np.ones(len(out), bool)
        for i in range(n):
            part = terms[i : i + len(out)]
            out = out * self.base + part + 1
            known &= part >= 0
        return np.unique(out[known])

    def passages(self, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(first, end) of the windows, two item lengths long at every item length, of which a block's bound reaches the threshold."""
        step = self.longest
        n = -(-len(terms) // step)
        padded = np.full(n * step, -1, np.int64)
        padded[: len(terms)] = terms
        sums = np.empty((n + 1, len(self.common)), np.float32)
        sums[n] = 0
        for at in range(0, n, 256):  # whatever a text's length, a few thousand words at a time
            sums[at : min(at + 256, n)] = self._sums(padded[at * step : (at + 256) * step], step)
        window = (sums[:-1] + sums[1:] + self.common).max(axis=1)
        for k in np.flatnonzero(window >= threshold - 1e-4):
            if k and k == n - 1:
                continue  # the last window but one holds it
            yield int(k) * step, min((int(k) + 2) * step, len(terms))

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items with a score of at least ``threshold`` for the distinct terms."""
        cursors = [[self.items[t][0], 0, t] for t in np.unique(terms).tolist() if t in self.items]
        found: list[tuple[int, float]] = []
        slack = threshold - 1e-6

        def forward(cursor: list, item: int) -> None:
            posted = self.items[cursor[2]]
            cursor[1] = bisect_left(posted, item, cursor[1])
            cursor[0] = posted[cursor[1]] if cursor[1] < len(posted) else -1

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                bound += self.highest[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(self.bound(c[2], block) for c in cursors[: pivot + 1]) < slack:
                target = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    forward(c, target)
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    forward(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        forward(c, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def _runs(items: list[Item], most_items: int, most_words: int) -> Iterator[list[Item]]:
    """The items one after the other, in lists of at most so many items and words; a longer item is a list of its own."""
    part: list[Item] = []
    words = 0
    for x in items:
        size = len(x.question) + len(x.answer)
        if part and (len(part) == most_items or words + size > most_words):
            yield part
            part, words = [], 0
        part.append(x)
        words += size
    if part:
        yield part


@dataclass
class ItemIndex:
    vocabulary: dict[str, int]
    shards: list[ItemShard]

    @classmethod
    def build(cls, items: list[Item], gram: int = 3, shard_items: int = 4096) -> ItemIndex:
        """One index of all items."""
        return next(cls.parts(items, gram, shard_items, part_words=None), cls({}, []))

    @classmethod
    def parts(cls, items: list[Item], gram: int = 3, shard_items: int = 4096, shard_words: int = 1 << 18, part_words: int | None = 1 << 20) -> Iterator[ItemIndex]:
        """Indexes of at most ``part_words`` words (None: one index).

        Shards hold items of one length class (a power of two), at most ``shard_items`` items and ``shard_words`` words
        each, and a part holds whole shards; document frequencies are those of all items.  So an item has the same
        scores however the shards are parted.
        """
        items = sorted((x for x in items if x.question or x.answer), key=lambda x: (len(x.question) + len(x.answer), x.item_id))
        df = Counter(w for x in items for w in {*x.question, *x.answer})
        classes: dict[int, list[Item]] = {}
        for x in items:
            classes.setdefault((len(x.question) + len(x.answer) - 1).bit_length(), []).append(x)
        groups = [run for _, group in sorted(classes.items()) for run in _runs(group, shard_items, shard_words)]

        def part(some: list[list[Item]]) -> ItemIndex:
            words = sorted({w for group in some for x in group for w in (*x.question, *x.answer)})
            vocabulary = {w: i for i, w in enumerate(words)}
            n = np.array([df[w] for w in words], float)
            idf = np.log1p((len(items) - n + 0.5) / (n + 0.5))
            return cls(vocabulary, [ItemShard(group, vocabulary, idf, gram) for group in some])

        held: list[list[Item]] = []
        size = 0
        for group in groups:
            words = sum(len(x.question) + len(x.answer) for x in group)
            if held and part_words is not None and size + words > part_words:
                yield part(held)
                held, size = [], 0
            held.append(group)
            size += words
        if held:
            yield part(held)

    def leaks(self, terms: np.ndarray, threshold: float, overlap: float) -> dict[int, tuple[float, float, float, int]]:
        """By item: the verified passage with the highest score, as (score, question's overlap, answer's, first word)."""
        best: dict[int, tuple[float, float, float, int]] = {}
        for shard in self.shards:
            for first, end in shard.passages(terms, threshold):
                window = terms[first:end]
                grams: dict[int, np.ndarray] = {}  # by run length
                for i, score in shard.search(window, threshold):
                    halves_of = (shard.question[i], shard.answer[i])
                    for n, _ in halves_of:
                        if n not in grams:
                            grams[n] = shard.grams(window, n)
                    shares = [float(np.isin(own, grams[n]).mean()) if n else 1.0 for n, own in halves_of]
                    if min(shares) >= overlap:
                        best[shard.ids[i]] = max(best.get(shard.ids[i], (-1.0, 0.0, 0.0, 0)), (float(score), *shares, first))
        return best


def read_items(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, max_bytes: int = 256 << 20) -> list[Item]:
    """The items on the driver.  Their bytes are summed first, and more than ``max_bytes`` is an error: the driver
    holds all items once, tasks the index of one part (:func:`find_leaks`).  Rows with a null id are no items."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "q"), *([(answer_col, "a")] if answer_col else []))]
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), *texts)
    size = rows.agg(F.sum(sum((F.octet_length(c) for c in rows.columns[1:]), F.lit(0)))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the items have {size} bytes; pass them in parts of at most {max_bytes}")
    out = []
    for r in rows.collect():
        words = [w for w in map(normal, words_of(r["q"])) if w]
        question, answer = (words, [w for w in map(normal, words_of(r["a"])) if w]) if answer_col else halves(words)
        out.append(Item(r["id"], question, answer))
    return out


LEAKS = "leaks array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,first_word:bigint>>"


def find_leaks(
    documents: DataFrame, items: list[Item], *, text_col: str = "text", threshold: float = 0.5, overlap: float = 0.6, gram: int = 3, part_words: int = 1 << 20
) -> DataFrame:
    """``documents`` with ``leaks``: the items found in the text, by id.

    An item is reported if a passage's BM25 score is at least ``threshold`` of the item's own, and the passage
    has ``overlap`` of the word runs of its question and of its answer.  Null and empty texts leak nothing, items
    without words are never found, without items there are no leaks; repeated items are reported once an id;
    rows are kept as they are; an input column named ``leaks`` is replaced.

    Items of over ``part_words`` words go in parts, one pass over the documents each, so that a worker holds the
    index of one part; what is found doesn't depend on the parts.  Between passes the documents are written.
    """
    parts = ItemIndex.parts(items, gram, part_words=part_words)
    out = _with_leaks(documents, next(parts, ItemIndex({}, [])), text_col, threshold, overlap)
    before: DataFrame | None = None
    for index in parts:
        written = stored(out, "leaks")
        discard(before)
        before = written
        out = _with_leaks(written, index, text_col, threshold, overlap, more=True)
    return out


def _with_leaks(documents: DataFrame, built: ItemIndex, text_col: str, threshold: float, overlap: float, more: bool = False) -> DataFrame:
    """Leaks of one index's items, with ``more`` besides those in ``leaks``."""
    sent = documents.sparkSession.sparkContext.broadcast(built)
    names = ("item_id", "score", "question_overlap", "answer_overlap", "first_word")

    def make():
        index = sent.value
        known = index.vocabulary
        codes = WordCodes(lambda word: -2 if not (w := normal(word)) else known.get(w, -1))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))

        def one(text: str | None) -> list[dict]:
            if not text or not index.shards:
                return []
            words = text.replace("\n", " ").split(" ") if not any(c in text for c in "\t\r\x0b\x0c") else words_of(text)
            terms = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            terms = terms[terms > -2]  # no word
            if not len(terms):
                return []
            found = index.leaks(terms, threshold, overlap)
            return [dict(zip(names, (i, *x), strict=True)) for i, x in sorted(found.items())]

        def joined(now: list[dict], known: list[dict]) -> list[dict]:
            """By item the passage with the highest score, as :meth:`ItemIndex.leaks` has it."""
            best: dict[int, tuple] = {}
            for x in (*now, *known):
                said = tuple(x[c] for c in names[1:])
                best[x["item_id"]] = max(best.get(x["item_id"], said), said)
            return [dict(zip(names, (i, *x), strict=True)) for i, x in sorted(best.items())]

        def compute(texts: pa.Array, earlier: pa.Array | None = None) -> tuple[pa.Array]:
            found = [one(x.as_py()) for x in texts]
            if earlier is not None:
                found = [joined(a, b.as_py()) for a, b in zip(found, earlier, strict=True)]
            return (pa.array(found, kind),)

        return compute

    return with_arrow_columns(documents, [text_col, "leaks"] if more else [text_col], make, LEAKS)
