"""Secret scans with multipart credential linking.

Strong candidates (assignments, access key ids, long hexadecimal strings) are reported as such.
Weak ones (random-looking strings, account names, endpoints) are reported only where complementary
parts lie within a scope of characters: a secret near an identifier or endpoint, and these near a
secret.  Positions come from the lengths between matches; parts are linked by an interval join
with the nearest part of each class before and after, found in one ordered pass over a document's
parts, so no pairs are formed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored


@dataclass(frozen=True)
class Kind:
    """A match of ``pattern`` counts if its ``group`` has ``least`` characters; ``part`` is its role."""

    name: str
    pattern: str
    group: int
    least: int
    part: str
    strong: bool
    guard: str | None = None  # a substring that every match has


#: Repeated groups are possessive: others take a stack frame a turn.  In the order in which spans at one place are listed.  The first three are fixed by the task.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "identifier", True, "AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "secret", True),
    Kind("weak_secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}", 0, 20, "secret", False),
    Kind("identifier", r"""(?i)(?<![a-z])(user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3, "identifier", False),
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0, 6, "identifier", False, "@"),
    Kind("endpoint", r"""https?://[^\s"'<>]+""", 0, 10, "endpoint", False, "://"),
    Kind("address", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])", 0, 7, "endpoint", False, "."),
)
_PARTS = "array<struct<kind:int,place:int,gap:int,length:int,counts:boolean>>"


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """The matches of one kind: what lies before each since the last one, its length, whether it counts."""
    pattern = F.lit(kind.pattern)
    found = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("part")
    )
    rows = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("length"), (F.length(x["part"]) >= kind.least).alias("counts")
        ),
    )
    rows = F.filter(rows, lambda x: x["length"].isNotNull()).cast(_PARTS)
    here = text.rlike(kind.pattern)
    if kind.guard:
        here = F.contains(text, F.lit(kind.guard)) & here
    return F.when(here, rows).otherwise(F.array().cast(_PARTS))


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """``doc_id, text_hash, spans`` of each row; ``spans`` is array<struct<kind,start,end,strong>>, by start
    and then kind, positions in code points, end exclusive.

    Strong spans are all kept; weak ones that overlap a strong one are dropped.  Null and empty texts have
    no spans; null ids are carried; repeated rows are scanned one by one; an empty table gives no rows;
    further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.concat(*[_matches(text, i, k) for i, k in enumerate(KINDS)]).alias("parts")
    )
    rows = stored(rows, "matches")  # the row numbers hold from here on
    parts = rows.where(F.size("parts") > 0).select("row", F.inline("parts"))
    along = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.sum(F.col("gap") + F.col("length")).over(along)
    spans = parts.withColumn("end", reach).where("counts").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")

    strong = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.strong])
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clash = (F.max(F.when(strong, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"))
    spans = spans.withColumn("clash", F.coalesce(clash, F.lit(False))).where(strong | ~F.col("clash")).drop("clash")

    def near(part: str) -> Column:
        is_part = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.part == part])
        left = F.col("start") - F.max(F.when(is_part, F.col("end"))).over(before)
        right = F.min(F.when(is_part, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(left <= scope, F.lit(False)) | F.coalesce(right <= scope, F.lit(False))

    part = F.element_at(F.array(*[F.lit(k.part) for k in KINDS]), F.col("kind") + 1)
    linked = spans.select("*", near("identifier").alias("id_near"), near("secret").alias("secret_near"), near("endpoint").alias("end_near"))
    reported = linked.where(strong | F.when(part == "secret", F.col("id_near") | F.col("end_near")).otherwise(F.col("secret_near")))
    lists = reported.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    strongs = F.array(*[F.lit(k.strong) for k in KINDS])
    shown = F.transform(
        "spans", lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), F.element_at(strongs, x["kind"] + 1).alias("strong"))
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,strong:boolean>>")
    return rows.select("row", "doc_id", "text_hash").join(lists.select("row", shown.alias("spans")), "row", "left").select("doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>", scope: int = 200) -> DataFrame:
    """``documents`` with each reported secret or access key id replaced by ``mark``; touching spans give one mark.

    Identifiers and endpoints stay.  Texts without secrets, null ones too, are as before.
    """
    secret = [k.name for k in KINDS if k.strong or k.part == "secret"]
    found = scan(documents, id_col=id_col, text_col=text_col, scope=scope)
    wanted = F.filter("spans", lambda x: x["kind"].isin(secret))
    own_id, own_hash, own_spans = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "hash", "spans"))
    found = found.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), wanted.alias(own_spans))
    found = stored(found.where(F.size(own_spans) > 0).dropDuplicates([own_id, own_hash]), "secrets")
    hashed = F.xxhash64(F.coalesce(documents[text_col].cast("string"), F.lit("")))
    with_spans = documents.join(found, documents[id_col].eqNullSafe(found[own_id]) & (hashed == found[own_hash]), "left")
    # what lies between the marks: (characters before it, its length); touching spans have nothing between them
    text, spans = F.col(f"`{text_col}`"), F.col(own_spans)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<before:bigint,length:bigint>>").alias("gaps"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.struct(acc["at"].alias("before"), (x["start"] - acc["at"]).alias("length"))
        return F.struct(F.greatest(x["end"], acc["at"]).alias("at"), F.when(x["start"] < acc["at"], acc["gaps"]).otherwise(F.array_append(acc["gaps"], gap)).alias("gaps"))

    last = lambda acc: F.array_append(acc["gaps"], F.struct(acc["at"].alias("before"), F.length(text).cast("long").alias("length")))
    gaps = F.aggregate(spans, start, step, last)
    cleaned = F.array_join(F.transform(gaps, lambda x: F.substring(text, (x["before"] + 1).cast("int"), x["length"].cast("int"))), mark)
    return with_spans.withColumn(text_col, F.when(spans.isNotNull(), cleaned).otherwise(text)).select(*[F.col(f"`{c}`") for c in documents.columns])
