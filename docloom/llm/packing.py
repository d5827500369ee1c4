"""Lexical retrieval packing.

Documents are tokenised where they lie.  Every run of ``shard_docs`` documents of an input
partition forms a shard with a BM25 inverted index over token ids.  A seed document asks the
index of its shard, with all its terms, for unused neighbours; they fill the seed's window in order of score, and
the first that doesn't fit is cut at the window's end.  Nothing is shuffled, and a task holds
one shard at a time.  What a shard leaves over goes to the next one; what a partition leaves
over is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.common import map_arrow

#: Pieces of text that the word BPE takes one by one (fixed: its file says so).
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
#: Characters that lower-casing and composition treat alike in Python and in the tokenizer.
_PLAIN = regex.compile(r"[!-~¡-ſ]+")
_GAP = regex.compile(r"(?<=[A-Za-zÀ-ſ])([.,!?;:]) ")


def _byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character which byte-level vocabularies write for it."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenIds(dict):
    """Word -> little-endian 32-bit ids as bytes.

    The tokenizer never joins characters across a blank, so a text's ids are its words' ids.
    The dictionary remembers words of up to ``longest`` characters and is emptied when they take up ``limit`` bytes.
    """

    def __init__(self, definition: str, limit: int = 128 << 20, longest: int = 40) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.limit, self.longest, self.held = limit, longest, 0
        self.alphabet = _byte_alphabet()
        self.by_piece = (
            '"end_of_word_suffix":"</w>"' in definition.replace(" ", "").replace("\n", "")
            and "[^\\\\s\\\\p{L}\\\\p{N}]+" in definition
            and '"Lowercase"' in definition
        )

    def __missing__(self, word: str) -> bytes:
        if not self.by_piece or "<|" in word:
            out = self._whole(word)
        elif word.isascii() and word.isalpha():  # one piece, spelled as it is
            out = array("I", [t.id for t in self.tokenizer.model.tokenize(word.lower())]).tobytes()
        elif _PLAIN.fullmatch(word):
            out = b"".join(map(self._piece, PIECE.findall(word.lower())))
        else:
            out = self._whole(word)
        if len(word) <= self.longest:
            self.held += 200 + len(out)  # the entry and its two objects
            self[word] = out
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        if self.held > self.limit:
            self.clear()
            self.held = 0
        if not self.by_piece:
            return self._whole(text)
        try:
            text.encode("latin-1")
            text = text.lower()  # one by one, as the tokenizer has it: sentence starts recur as other words
        except UnicodeEncodeError:
            pass
        # A mark between a letter and a blank is a piece of its own: parting it makes words recur.
        text = _GAP.sub(r" \1 ", text.replace("\n", " "))
        return b"".join(map(self.__getitem__, text.split(" ")))


_ids: dict[int, TokenIds] = {}  # by definition, in each Python worker


def token_ids(definition: str) -> TokenIds:
    key = hash(definition)
    if key not in _ids:
        _ids[key] = TokenIds(definition)
    return _ids[key]


class Shard:
    """BM25 over the token ids of some documents.

    Terms of over a quarter of the documents have a row of weights, the others posting lists.
    """

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75) -> None:
        self.n = len(docs)
        sizes = np.array([len(x) for x in docs], np.int64)
        # one sort of (document, id) finds each document's distinct terms and their counts
        keys = np.sort(np.repeat(np.arange(self.n, dtype=np.int64) << 32, sizes) | np.concatenate(docs).astype(np.int64))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        tf = np.diff(np.append(first, len(keys))).astype(float)
        doc, term = keys[first] >> 32, keys[first] & 0xFFFFFFFF
        vocabulary, self.place = np.unique(term, return_inverse=True)
        df = np.bincount(self.place, minlength=len(vocabulary))
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * sizes / max(sizes.mean(), 1))
        weight = (idf[self.place] * tf * (k1 + 1) / (tf + norm[doc])).astype(np.float32)
        #: A document's terms are ``place[of[i] : of[i + 1]]``.
        self.of = np.searchsorted(doc, np.arange(self.n + 1))
        by_term = np.argsort(self.place, kind="stable")
        self.bounds = np.append(0, np.cumsum(df))
        self.posted, self.weights = doc[by_term], weight[by_term]
        common = np.flatnonzero(4 * df > self.n)
        self.row = np.full(len(vocabulary), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        dense = self.row[self.place] >= 0
        self.rows[self.row[self.place[dense]], doc[dense]] = weight[dense]

    def scores(self, doc: int) -> np.ndarray:
        """Every document's score for all terms of ``doc``."""
        terms = self.place[self.of[doc] : self.of[doc + 1]]
        rows = self.row[terms]
        out = self.rows[rows[rows >= 0]].sum(axis=0)
        rare = terms[rows < 0]
        n = self.bounds[rare + 1] - self.bounds[rare]
        if n.sum():
            spots = np.repeat(self.bounds[rare] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            out += np.bincount(self.posted[spots], self.weights[spots], self.n).astype(np.float32)
        return out


class Packer:
    """Packs the documents of one partition; ``add`` and ``finish`` yield pieces
    (doc_id, start, ids, doc_tokens, sequence number, offset, seed's doc_id)."""

    def __init__(self, window: int, shard_docs: int) -> None:
        self.window, self.shard_docs = window, shard_docs
        self.waiting: list[tuple] = []  # (doc_id, start, bytes, doc_tokens)
        self.sequence = 0

    def _emit(self, items: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in items:
            yield doc_id, start, ids, total, self.sequence, offset, items[0][0]
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, step = len(ids) // 4, self.window * 4
        at = 0
        while len(ids) - at >= step:
            yield from self._emit([(doc_id, at // 4, ids[at : at + step], total)])
            at += step
        if at < len(ids):
            self.waiting.append((doc_id, at // 4, ids[at:], total))
        if len(self.waiting) >= self.shard_docs:
            yield from self.pack()

    def pack(self) -> Iterator[tuple]:
        """Fills windows as long as the waiting documents fill them."""
        items = self.waiting
        if not items:
            return
        shard = Shard([np.frombuffer(x[2], "<u4") for x in items])
        left = [len(x[2]) // 4 for x in items]
        unused = np.ones(len(items), bool)
        tokens = sum(left)
        seeds = iter(sorted(range(len(items)), key=lambda i: -left[i]))
        rest: int | None = None  # the document that was cut last leads the next window
        while tokens >= self.window:
            seed = rest if rest is not None else next(i for i in seeds if unused[i])
            rest, room, chosen = None, self.window - left[seed], [items[seed]]
            unused[seed] = False
            if room:
                score = np.where(unused, shard.scores(seed), -1.0)
                take = np.argsort(-score, kind="stable")
                for i in take[: int(unused.sum())]:
                    if left[i] > room:
                        doc_id, start, ids, total = items[i]
                        chosen.append((doc_id, start, ids[: room * 4], total))
                        items[i] = (doc_id, start + room, ids[room * 4 :], total)
                        left[i] -= room
                        rest, room = int(i), 0
                    else:
                        chosen.append(items[i])
                        unused[i] = False
                        room -= left[i]
                    if not room:
                        break
            yield from self._emit(chosen)
            tokens -= self.window
        self.waiting = [x for x, u in zip(items, unused, strict=True) if u]

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are powers of two."""
        yield from self.pack()
        tokens = sum(len(x[2]) // 4 for x in self.waiting)
        items = self.waiting[::-1]
        while tokens:
            room = 1 << (tokens.bit_length() - 1)
            tokens -= room
            chosen = []
            while room:
                doc_id, start, ids, total = items.pop()
                n = min(room, len(ids) // 4)
                chosen.append((doc_id, start, ids[: n * 4], total))
                if n * 4 < len(ids):
                    items.append((doc_id, start + n, ids[n * 4 :], total))
                room -= n
            yield from self._emit(chosen)
        self.waiting = []


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    shard_docs: int = 1024,
) -> DataFrame:
    """Pieces of token sequences: ``doc_id, start, ids (binary, 32-bit little-endian), doc_tokens,
    sequence_id, offset, seed_doc_id``.

    Every document's ids, ``end_id`` appended, lie in exactly one piece each.  A null or empty text
    is ``end_id`` alone; null ids are carried; repeated rows are packed as often as they occur; a
    document longer than the window is cut into windows first; equal scores go by input order; an
    empty table gives no rows; further columns are ignored.  ``sequence_id`` is the partition's
    number times 2**32 plus a count, the same whenever a task runs again.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = documents.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("seed_doc_id", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(definition.value)
        packer = Packer(window, shard_docs)
        base = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            columns[4] = [base + x for x in columns[4]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in packer.add(doc_id, (encode.text(text.as_py()) if text.is_valid else b"") + end):
                    out.append(piece)
                    held += len(piece[2])
                if held > 8 << 20:
                    yield flush()
                    out, held = [], 0
        out += packer.finish()
        yield flush()

    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, seed_doc_id long")
