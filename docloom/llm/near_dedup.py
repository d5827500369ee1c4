"""MinHash near-duplicate detection by a signature-coordinate inverted join.

1. Each text's set of word shingles gives a digest and a signature of ``coordinates`` minima.  Texts
   with equal sets are one class; only classes go on, under short numbers.
2. A class is posted under each coordinate-value pair.  A pair of classes is a candidate if at least
   ``matches`` coordinates collide.  Values that only one class has can't collide, so a class with s
   shared values needs to be posted under its s - matches + 1 rarest alone (prefix filter); a class
   with fewer than ``matches`` is skipped.
3. Posting lists are merged in rounds.  In each, a list links its members to one of them (a star, as
   many pairs as members); a class keeps the star it meets in most lists, and confirmed links make
   components.  Lists within one component are skipped from then on, and only members outside of a
   list's largest component still ask.
4. When rounds link little more, the members that still ask meet the others of their lists in blocks:
   collisions of whole signatures are counted, pairs below ``matches`` and pairs whose first common
   value is another list's are passed over.  No pair becomes a row: a block hands on the classes that
   some of its askers may be linked with, each once.
5. Every link is confirmed on the full shingle sets.  A longer sketch tells pairs far below the
   threshold before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WordCodes, discard, fits_broadcast, map_arrow, stored

_MIX = np.random.default_rng(20_240_601).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_WIDE = np.random.default_rng(20_240_602).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Members of a star or list that one group of a task reads, askers of a block, shingles of a block's askers.
_GROUP, _ASKERS, _BLOCK_SHINGLES = 8192, 1024, 1 << 20
#: Ids that are broadcast instead of shuffling texts.
_BROADCAST_BYTES = 64 << 20


class Shingles:
    """Text (UTF-8) -> sorted distinct 64-bit hashes of its word shingles."""

    def __init__(self, words: int) -> None:
        self.words, self.codes = words, WordCodes(xxhash.xxh3_64_intdigest)

    def of(self, text: bytes | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces alone
        words = text.lower().split() if text else []
        h = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = self.words
        rows = [h[i : len(h) - n + 1 + i] for i in range(n)] if len(h) >= n else [h[i : i + 1] for i in range(len(h))]
        mixed = np.full(len(rows[0]), len(rows), np.uint64)
        for i, part in enumerate(rows):
            mixed = (mixed ^ part) * _MIX[i]
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * _C1
        mixed = (mixed ^ (mixed >> np.uint64(27))) * _C2
        return np.unique(mixed ^ (mixed >> np.uint64(31)))


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value under each permutation, some of them at a time: memory is bounded by the text."""
    step = max(1, (1 << 19) // len(shingles))
    low = np.concatenate([((shingles[None, :] ^ b[i : i + step, None]) * a[i : i + step, None]).min(axis=1) for i in range(0, len(a), step)])
    return (low ^ (low >> np.uint64(32))) * _C1


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima under ``coordinates`` permutations, the coordinate's number in the lowest bits."""
    low = _minima(shingles, _MIX[:coordinates], _MIX[::-1][:coordinates])
    return ((low & ~np.uint64(63)) | np.arange(coordinates, dtype=np.uint64)).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One byte of each of 256 further minima."""
    return (_minima(shingles, _WIDE, _WIDE[::-1]) >> np.uint64(56)).astype(np.uint8).view(np.int8)


def sketch_matches(percent: int) -> int:
    """Equal bytes that a pair at the threshold has but for a chance of about 1e-7."""
    p = percent / 100
    return int(len(_WIDE) * p - 5.3 * (len(_WIDE) * p * (1 - p)) ** 0.5)


def features(documents: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest`` (null: empty set) and ``signature`` of each row."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            sizes, digests, found = [], [], []
            for text in batch.column(2):
                s = shingles.of(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                found.append(signature(s, coordinates) if len(s) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "text_key", "n_shingles", "digest", "signature"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_arrow(rows, run, "doc_id long, text_key binary, n_shingles long, digest binary, signature array<long>")


def text_key(text: Column) -> Column:
    """Tells texts apart; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``node``, its ``shingles`` and their ``sketch``, from (text as binary, node, digest)."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            nodes, sets, sketches = [], [], []
            for text, node, digest in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = shingles.of(text.as_py())
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # an id may have several texts
                    nodes.append(node)
                    sketches.append(sketch(s))
                    sets.append(s.tobytes())
            columns = [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sketches, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "sketch"])

    return map_arrow(texts, run, "node long, shingles binary, sketch array<tinyint>")


def _grouped(batches, keys: int):
    """(key, batch) of the runs of rows with equal first ``keys`` columns (integers), batch by batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for first, end in zip(cut, cut[1:], strict=False):
            yield tuple(int(c[first]) for c in columns), batch.slice(first, end - first)


def linked(percent: int, n: int, m: np.ndarray | int, both: np.ndarray | int) -> np.ndarray | bool:
    return 100 * both >= percent * (n + m - both)


def confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the labels of those ``stars`` (node, center, a, b) with 100 * intersection >= percent * union.

    A center's set is sent once for every ``_GROUP`` of its members.
    """
    parts = stars.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / _GROUP).cast("int").alias("parts"))
    members = stars.join(parts, "center").select("center", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "node", "a", "b")
    centers = parts.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("center").alias("node"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = members.unionByName(centers).join(sets, "node").select("center", "part", "role", "node", "a", "b", "shingles")
    rows = rows.repartition("center", "part").sortWithinPartitions("center", "part", "role")

    def run(batches):
        key, center = None, None
        for now, group in _grouped(batches, 2):
            if now != key:
                key, center = now, np.frombuffer(group.column(6)[0].as_py(), np.uint64)  # role 0 comes first
            roles, good = group.column(2).to_numpy(), np.zeros(group.num_rows, bool)
            for i in np.flatnonzero(roles == 1):
                own = np.frombuffer(group.column(6)[int(i)].as_py(), np.uint64)
                if 100 * min(len(own), len(center)) >= percent * max(len(own), len(center)):
                    good[i] = linked(percent, len(center), len(own), len(np.intersect1d(own, center, assume_unique=True)))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([group.column(4).filter(keep), group.column(5).filter(keep)], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long")


def merged(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """``node, label`` of all nodes but those that are their own label: ``labels`` carried on by ``new``, whose nodes
    are labels."""
    if labels is None:
        return stored(new.where("node <> label"), "labels")
    on = labels.join(new.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return stored(on.unionByName(new.where("node <> label")), "labels")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the undirected edges (a, b): the least node it reaches.

    Labels go along edges and then to the label's own label, until none changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "seen"), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "seen").alias("new"))
        jump = step.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")), "new", "left")
        after = stored(jump.select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        discard(labels)
        if after.where("label <> new").isEmpty():
            discard(both)
            return after.select("node", "label")
        labels = stored(after.select("node", F.col("new").alias("label")), "labels")
        discard(after)


def _collisions(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def posting_lists(classes: DataFrame, matches: int) -> DataFrame:
    """``value, node, n`` (the list's length), ``weight`` (of the class: its lists' lengths) and ``prefix``
    (bits of the coordinates it is posted under) for the classes that can be candidates."""
    postings = classes.select("node", F.explode("signature").alias("value"))
    shared = postings.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefixes = (
        postings.join(shared, "value")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("lists"), F.sum("n").alias("weight"))  # one entry a coordinate
        .where(F.size("lists") >= matches)
        .select("node", "weight", F.expr(f"slice(lists, 1, size(lists) - {matches - 1})").alias("lists"))
    )
    bits = F.expr("aggregate(lists, 0L, (s, x) -> s | shiftleft(1L, int(x.value & 63)))")
    return prefixes.select("node", "weight", bits.alias("prefix"), F.inline("lists")).select("value", "node", "n", "weight", "prefix")


def mixed_lists(lists: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """``value, largest, center, others, size, n`` of the posting lists that hold several components: the largest
    one's label and a member of it, how many are outside of it, and all that are posted or share the value."""
    if labels is None:
        # the text that the others were copied from has the most frequent values
        return lists.groupBy("value").agg(F.min_by("node", F.struct(-F.col("weight"), F.col("node"))).alias("center"), (F.count(F.lit(1)) - 1).alias("others"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n")).where("others > 0").withColumn("largest", F.col("center"))
    return (
        _labelled(lists.select("value", "node", "n"), labels)
        .groupBy("value", "label")
        .agg(F.count(F.lit(1)).alias("here"), F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))).alias("pick"), F.max("n").alias("n"))
        .groupBy("value")
        .agg(F.max_by(F.struct("label", "pick"), F.struct("here", "label")).alias("top"), F.max("here").alias("most"), F.sum("here").alias("size"), F.max("n").alias("n"))
        .where("most < size")
        .select("value", F.col("top.label").alias("largest"), F.col("top.pick").alias("center"), (F.col("size") - F.col("most")).alias("others"), "size", "n")
    )


def stars(lists: DataFrame, labels: DataFrame | None, mixed: DataFrame) -> DataFrame:
    """``node, center, a, b`` (their labels): each class outside of its lists' largest components with the
    center that it meets in most lists.  Long lists are split by class."""
    parts = F.ceil(F.col("n") / _GROUP).cast("int")
    centers = mixed.select("value", "largest", "center", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    posted = _labelled(lists.select("value", "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")), labels)
    return (
        posted.join(centers, ["value", "part"])
        .where("label <> largest")
        .groupBy("node", "label", "center", F.col("largest").alias("up"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .groupBy("node")
        .agg(F.max_by(F.struct("center", "label", "up"), F.struct("hits", "center")).alias("s"))
        .select("node", "s.center", F.col("s.label").alias("a"), F.col("s.up").alias("b"))
    )


def likely(pairs: DataFrame, wide: DataFrame, percent: int, matches: int) -> DataFrame:
    """Those of ``pairs`` (node, center, ...) with ``matches`` collisions, fitting sizes and like sketches."""
    columns = ("node", "size", "signature", "sketch")
    both = pairs.join(wide.select(*columns), "node").join(wide.select(*[F.col(c).alias(f"c_{c}") for c in columns]), F.col("center") == F.col("c_node"))
    sizes = 100 * F.least("size", "c_size") >= percent * F.greatest("size", "c_size")
    collide = _collisions(F.col("signature"), F.col("c_signature")) >= matches
    return both.where(sizes & collide & (_collisions(F.col("sketch"), F.col("c_sketch")) >= sketch_matches(percent))).select(*pairs.columns)


def asked(lists: DataFrame, labels: DataFrame | None, mixed: DataFrame, wide: DataFrame, percent: int, matches: int) -> DataFrame:
    """``block, role, node, label``: blocks of classes that still ask (role 0) and the classes (role 1) that some
    of the block's may be linked with.

    In each mixed list, those outside of its largest component ask all others.  A long list is cut into
    ``_ASKERS`` askers times ``_GROUP`` members.
    """
    entries = _labelled(lists.select("value", "node"), labels).join(mixed, "value")
    askers, parts = F.ceil(F.col("others") / _ASKERS).cast("int"), F.ceil(F.col("size") / _GROUP).cast("int")
    chunk, part = F.pmod(F.xxhash64("node"), askers).cast("int"), F.pmod(F.xxhash64("node", F.lit("part")), parts).cast("int")
    outside = F.col("label") != F.col("largest")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = entries.where(outside).select("value", chunk.alias("chunk"), every(parts).alias("part"), F.lit(0).alias("role"), "node", "label", F.lit(True).alias("outside"))
    answering = entries.select("value", every(askers).alias("chunk"), part.alias("part"), F.lit(1).alias("role"), "node", "label", outside.alias("outside"))
    rows = asking.unionByName(answering).join(wide, "node")
    rows = rows.select("value", "chunk", "part", "role", "node", "label", "outside", "size", "prefix", "signature", "sketch")
    rows = rows.repartition("value", "chunk", "part").sortWithinPartitions("value", "chunk", "part", "role", "node")
    least, names = sketch_matches(percent), ["block", "role", "node", "label"]

    def read(group: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: group.column(c).to_numpy(zero_copy_only=False) for c in ("role", "node", "label", "outside", "size", "prefix")}
        out["signature"] = group.column("signature").flatten().to_numpy().reshape(group.num_rows, -1)
        out["sketch"] = group.column("sketch").flatten().to_numpy().reshape(group.num_rows, -1)
        return out

    def matching(x: dict, y: dict, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in x, in y) of the pairs that may be links and belong to the list of coordinate ``at``."""
        fits = (x["label"][:, None] != y["label"][None]) & (~y["outside"][None] | (x["node"][:, None] < y["node"][None]))
        fits &= 100 * np.minimum(x["size"][:, None], y["size"][None]) >= percent * np.maximum(x["size"][:, None], y["size"][None])
        if not fits.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hits = np.zeros(fits.shape, np.uint8)
        for i in range(x["signature"].shape[1]):
            equal = x["signature"][:, i, None] == y["signature"][None, :, i]
            hits += equal
            if i < at:
                posted = ((x["prefix"] >> i & 1) == 1)[:, None] & ((y["prefix"] >> i & 1) == 1)[None]
                fits &= ~(equal & posted)
        p, q = np.nonzero(fits & (hits >= matches))
        near = np.zeros(len(p), bool)
        for i in range(0, len(p), 1 << 14):
            near[i : i + (1 << 14)] = (x["sketch"][p[i : i + (1 << 14)]] == y["sketch"][q[i : i + (1 << 14)]]).sum(axis=1) >= least
        return p[near], q[near]

    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        key, gathered, asks, told = None, [], None, None

        def rows_of(blocks, role, nodes, labels):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(blocks, np.int64)), pa.array(np.full(len(nodes), role, np.int32)), pa.array(nodes), pa.array(labels)], names=names)

        for now, group in _grouped(batches, 3):
            if now != key:
                key, gathered, asks = now, [], None
            x = read(group)
            first = int((x["role"] == 0).sum())
            if first:
                gathered.append({c: v[:first] for c, v in x.items()})
            if first == group.num_rows:
                continue
            if asks is None:  # all askers of the group are here: cut them into blocks
                asks = {c: np.concatenate([g[c] for g in gathered]) for c in x}
                asks["block"] = base + count + (np.cumsum(asks["size"]) - asks["size"]) // _BLOCK_SHINGLES
                count += int(asks["block"][-1] - base - count) + 1
                told = np.zeros(len(asks["node"]), bool)
            y = {c: v[first:] for c, v in x.items()}
            p, q = matching(asks, y, now[0] & 63)
            if not len(p):
                continue
            new = np.unique(p[~told[p]])
            told[new] = True
            yield rows_of(asks["block"][new], 0, asks["node"][new], asks["label"][new])
            pairs = np.unique(np.stack((asks["block"][p], q)), axis=1)
            yield rows_of(pairs[0], 1, y["node"][pairs[1]], y["label"][pairs[1]])

    return map_arrow(rows, run, "block long, role int, node long, label long")


def answered(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: labels of confirmed links between the askers and the other classes of each block, a forest a block."""
    rows = blocks.join(sets, "node").select("block", "role", "node", "label", "shingles").repartition("block").sortWithinPartitions("block", "role", "node")

    def run(batches):
        key, gathered, asks, root = None, [], None, {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for now, group in _grouped(batches, 1):
            if now != key:
                key, gathered, asks, root = now, [], None, {}
            edges = []
            for role, label, packed in zip(group.column(1).to_pylist(), group.column(3).to_pylist(), group.column(4), strict=True):
                own = np.frombuffer(packed.as_py(), np.uint64)
                if role == 0:
                    gathered.append((label, own))
                    continue
                if asks is None:  # an inverted index of the askers' shingles
                    sizes = np.array([len(s) for _, s in gathered])
                    values = np.concatenate([s for _, s in gathered])
                    owners = np.repeat(np.arange(len(gathered)), sizes)
                    order = np.argsort(values, kind="stable")
                    known, at = np.unique(values[order], return_index=True)
                    asks = sizes, known, np.r_[at, len(values)], owners[order]
                sizes, known, bounds, owners = asks
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                place = place[known[place] == own]
                n = bounds[place + 1] - bounds[place]
                spots = np.repeat(bounds[place] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
                both = np.bincount(owners[spots], minlength=len(sizes))
                for i in np.flatnonzero(linked(percent, len(own), sizes, both)):
                    x, y = top(gathered[i][0]), top(label)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        edges.append((gathered[i][0], label))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long")


def _only(documents: DataFrame, keys: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """A join that broadcasts ``keys`` where they are few, so that texts stay where they are."""
    return documents.join(F.broadcast(keys) if fits_broadcast(keys, row_bytes, _BROADCAST_BYTES) else keys, on, how)


def judged(documents: DataFrame, *, id_col: str, text_col: str, words: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, component`` (a number of the row's component; null: it stands alone),
    ``component_id`` and ``kept`` of each row."""
    feats = stored(features(documents, id_col, text_col, words, coordinates), "features")
    classes = stored(
        feats.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
        .select(F.monotonically_increasing_id().alias("node"), "*"),
        "classes",
    )
    lists = stored(posting_lists(classes, matches), "postings")
    candidates = stored(lists.groupBy("node").agg(F.first("prefix").alias("prefix")).join(classes, "node").select("node", "digest", "rep", "size", "signature", "prefix"), "candidates")

    texts = documents.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").cast("binary").alias("text"))
    read = shingle_sets(_only(texts, candidates.select("rep", "node", "digest"), ["rep"], "inner", 96).select("text", "node", "digest"), words)
    repeated = feats.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    sketched = stored(read if repeated.isEmpty() else read.dropDuplicates(["node"]), "sets")
    sets = sketched.select("node", "shingles")
    wide = stored(candidates.select("node", "size", "prefix", "signature").join(sketched.select("node", "sketch"), "node"), "wide")
    discard(candidates)

    def grown(found: DataFrame) -> DataFrame | None:
        """The labels with confirmed links, which are deleted."""
        if found.isEmpty():
            discard(found)
            return labels
        new = components(found)
        out = merged(labels, new)
        discard(found, new, labels)
        return out

    labels, turn = None, 0
    mixed = stored(mixed_lists(lists, labels, turn), "mixed")
    while not mixed.isEmpty():
        drawn = stored(likely(stars(lists, labels, mixed), wide, percent, matches), "stars")
        found = stored(confirmed(drawn, sets, percent), "links")
        links = found.count()
        labels, turn = grown(found), turn + 1
        discard(drawn, mixed)
        mixed = stored(mixed_lists(lists, labels, turn), "mixed")
        entries = mixed.agg(F.sum("others")).first()[0] or 0
        if entries and 20 * links < entries:  # a class has several entries
            blocks = stored(asked(lists, labels, mixed, wide, percent, matches), "blocks")
            labels = grown(stored(answered(blocks, sets, percent), "links"))
            discard(blocks)
            break
    discard(mixed, lists, wide, sketched)

    nodes = _labelled(classes.select("node", "digest", "rep", "copies"), labels)
    joint = None if labels is None else nodes.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("rep").alias("least"))
    grouped = nodes.withColumn("least", F.lit(None).cast("long")) if joint is None else nodes.join(joint, "label", "left")
    grouped = grouped.where("copies > 1 OR least IS NOT NULL").select("digest", F.col("label").alias("component"), F.coalesce("least", "rep").alias("component_id"))
    # rows without a digest are spread by keys that no class has
    digest = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("digest")), F.unhex(F.hex(F.xxhash64("doc_id", "text_key"))))
    out = feats.select("doc_id", "text_key", "n_shingles", digest.alias("digest")).join(grouped, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "text_key", "n_shingles", "component", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out = stored(out, "judged")
    discard(feats, classes, labels)
    return out


def near_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 13
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    ``component_id`` is the least id in the row's component of linked texts, ``kept`` marks it.  Ids are integers,
    or strings of such; other strings fail the job.  A pair of texts at the threshold has under ``matches``
    collisions with a probability of about 2e-7.  Texts without words (null, empty) have an empty set and stand
    alone.  A null id takes part in no component: its ``component_id`` is null and it is kept.  Repeated rows are
    copies of one another; of repeated ids all rows with the least id are marked.  An empty table gives no rows;
    further columns are ignored.
    """
    rows = judged(documents, id_col=id_col, text_col=text_col, words=words, percent=percent, coordinates=coordinates, matches=matches)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 13, texts_apart: bool = False
) -> DataFrame:
    """``documents`` with one row for each component of near duplicates, one of the least id.

    Rows with a null id all stay.  Where an id has several texts, an id goes or stays as a whole and one row of a
    kept id stays; with ``texts_apart`` the texts are told apart, and only rows of one component go for each other.
    """
    rows = judged(documents, id_col=id_col, text_col=text_col, words=words, percent=percent, coordinates=coordinates, matches=matches)
    known = rows.where("doc_id IS NOT NULL")
    if texts_apart:
        # of a component's rows with the least id, those of its least text stay
        marked = known.where("kept AND component IS NOT NULL")
        least = marked.groupBy("component").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first <> last")
        more = marked.join(least, "component").where("text_key <> first")
        gone = known.where("NOT kept").select("doc_id", "text_key").unionByName(more.select("doc_id", "text_key")).distinct()
        same = lambda df, keys: (df[id_col].cast("long") == keys["__id"]) & text_key(df[text_col]).eqNullSafe(keys["__key"])
    else:
        gone = known.where("NOT kept").select("doc_id", F.lit(None).cast("binary").alias("text_key")).distinct()
        same = lambda df, keys: df[id_col].cast("long") == keys["__id"]
    gone = stored(gone.toDF("__id", "__key"), "gone")
    kept = _only(documents, gone, same(documents, gone), "left_anti", 96)
    group = ["doc_id", "text_key"] if texts_apart else ["doc_id"]
    repeated = rows.where("kept AND doc_id IS NOT NULL").groupBy(*group).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    keys = stored(repeated.select(F.col("doc_id").alias("__id"), (F.col("text_key") if texts_apart else F.lit(None).cast("binary")).alias("__key")), "repeated")
    once = kept.join(keys, same(kept, keys), "left_semi").dropDuplicates([id_col, text_col] if texts_apart else [id_col])
    return kept.join(keys, same(kept, keys), "left_anti").unionByName(once)
