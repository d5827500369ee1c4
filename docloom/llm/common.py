"""What the corpus operators share: shared storage, worker imports, row readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.storage import discard, shared_dir, stored
from docloom.workers import on_workers as importable

__all__ = ["discard", "shared_dir", "stored"]

#: The six ASCII characters that separate words.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACE_TO_BLANK = str.maketrans({c: " " for c in ASCII_SPACE[1:]})


#: Most bytes of an Arrow batch, unless the session has a smaller bound: a worker holds a few batches at a time.
BATCH_BYTES = 8 << 20


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, in batches of bounded size."""
    importable(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound, "67108864b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow after :func:`on_workers`."""
    on_workers(df.sparkSession)
    return df.mapInArrow(function, schema)


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than ASCII white space."""
    return [w for w in text.translate(_SPACE_TO_BLANK).split(" ") if w]


def in_fold(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text, mod ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def with_arrow_columns(df: DataFrame, inputs: list[str], make, fields: str) -> DataFrame:
    """``df`` with columns computed in Arrow batches.

    ``make()`` runs once in each task and returns a function from the arrays of ``inputs`` to the
    arrays of ``fields`` (DDL).  A column of ``df`` that has a new column's name is replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in new.names]
    sent = kept + [c for c in inputs if c not in kept]
    rows = df.select(*[F.col(f"`{c}`") for c in sent])
    schema = T.StructType([*(rows.schema[c] for c in kept), *new])
    places, n_kept = [sent.index(c) for c in inputs], len(kept)

    def run(batches):
        compute = make()
        for batch in batches:
            made = compute(*[batch.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names=schema.names)

    on_workers(df.sparkSession)
    return rows.mapInArrow(run, schema)


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int) -> bool:
    """Whether ``df`` has at most ``limit_bytes``, counted at ``row_bytes`` a row (one pass, nothing gathered)."""
    most = limit_bytes // row_bytes
    return df.limit(most + 1).count() <= most


class WordCodes(dict):
    """Word -> code, remembered; emptied when its words take up ``limit`` bytes."""

    def __init__(self, code, limit: int = 32 << 20) -> None:
        super().__init__()
        self.code, self.limit, self.held = code, limit, 0

    def __missing__(self, word):
        self.held += len(word) + 150  # the entry and its two objects
        if self.held > self.limit:
            self.clear()
            self.held = len(word) + 150
        self[word] = out = self.code(word)
        return out
