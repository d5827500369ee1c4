"""Bibliographic XML to references, and the stage that asks a citation service."""

from __future__ import annotations

import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schema import REFERENCE
from docloom.workers import on_workers

_NAMES = [f.name for f in REFERENCE]
#: A reference with none of these is empty.
_TELLING = ("title", "authors", "year", "doi", "url", "pmid", "arxiv", "venue")


class CitationError(RuntimeError):
    """The citation service could not be reached or gave something else than XML."""


class CitationClient(Protocol):
    """Gives a reference or None for each citation."""

    def parse(self, citations: list[str]) -> list[dict[str, Any] | None]: ...


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _below(node: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    """The direct children of that name, in any namespace."""
    return [] if node is None else [x for x in node if _tag(x) == name]


def _one(node: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return next(iter(_below(node, name)), None)


def _said(node: ElementTree.Element | None) -> str | None:
    """All text in the node, stripped; None if there is none."""
    return None if node is None else "".join(node.itertext()).strip() or None


def _titled(part: ElementTree.Element | None, *levels: str) -> str | None:
    """The first title with one of the levels that isn't empty."""
    return next((said for t in _below(part, "title") if t.get("level") in levels and (said := _said(t))), None)


def _authors(part: ElementTree.Element | None) -> list[dict[str, str | None]]:
    out = []
    for name in (_one(a, "persName") for a in _below(part, "author")):
        surname = _said(_one(name, "surname"))
        forename = " ".join(x for x in map(_said, _below(name, "forename")) if x) or None
        if surname or forename:
            out.append({"name": " ".join(x for x in (forename, surname) if x), "surname": surname, "forename": forename})
    return out


def _imprint(part: ElementTree.Element | None) -> dict[str, str | None]:
    node = _one(part, "imprint")
    found: dict[str, str | None] = dict.fromkeys(("volume", "issue", "pages", "year", "publisher"))
    for scope in _below(node, "biblScope"):  # of several with one unit the last counts
        field = {"volume": "volume", "issue": "issue", "page": "pages"}.get(scope.get("unit", ""))
        if field:
            first, last = scope.get("from"), scope.get("to")
            ends = [x for x in (first, last) if x] if field == "pages" and first else []
            found[field] = "-".join(ends) or _said(scope)
    date = _one(node, "date")
    when = None if date is None else date.get("when") or _said(date)
    if when:
        found["year"] = next((x for x in when.split("-") if re.fullmatch(r"\d{4}", x, re.ASCII)), when)
    found["publisher"] = _said(_one(node, "publisher"))
    return found


def _identifiers(bibl: ElementTree.Element, analytic: ElementTree.Element | None) -> dict[str, str | None]:
    found: dict[str, str | None] = dict.fromkeys(("doi", "url", "pmid", "arxiv"))
    for part in (bibl, analytic):
        told = [((n.get("type") or "").lower(), _said(n)) for n in _below(part, "idno")]
        told += [("url", p.get("target")) for p in _below(part, "ptr")]
        for kind, value in told:
            if kind in found:
                found[kind] = found[kind] or value or None
    return found


def reference_of(bibl: ElementTree.Element) -> dict[str, Any] | None:
    """The reference in a biblStruct; None if nothing in it tells what it is."""
    analytic, monograph = _one(bibl, "analytic"), _one(bibl, "monogr")
    own = _titled(analytic, "a")
    # without a title of its own the work is the monograph, which then is no venue besides its journal
    journal = _titled(monograph, "j")
    book = _titled(monograph, "m", "s")
    out = dict.fromkeys(_NAMES) | _imprint(monograph) | _identifiers(bibl, analytic)
    out["title"] = own or book
    out["venue"] = journal or book
    out["authors"] = _authors(analytic) + _authors(monograph)
    return out if any(out[x] for x in _TELLING) else None


def fitted(values: list, length: int | None) -> list:
    """Cut or filled up with None to ``length``."""
    return values if length is None else (values + [None] * length)[:length]


def parse_references(xml: str | None, expected: int | None = None) -> list[dict[str, Any] | None]:
    """The references of a bare biblStruct or of all in a TEI document, in order; blank: none; malformed: error."""
    if not (xml or "").strip():
        return fitted([], expected)
    try:
        root = ElementTree.fromstring(xml.strip())
    except ElementTree.ParseError as e:
        raise CitationError(f"not XML: {e}") from e
    found = [root] if _tag(root) == "biblStruct" else [x for x in root.iter() if _tag(x) == "biblStruct"]
    return fitted([reference_of(x) for x in found], expected)


def parsed_references(xml: Column) -> Column:
    """array<reference> from XML; malformed XML fails the job."""

    @F.pandas_udf(T.ArrayType(REFERENCE))
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: parse_references(x if isinstance(x, str) else None))

    return parse(xml)


class HttpCitationClient:
    """Posts all citations of a document in one form to a service that answers with TEI."""

    def __init__(self, url: str, timeout_s: float = 60.0) -> None:
        self.url, self.timeout_s = url.rstrip("/"), timeout_s

    def parse(self, citations: list[str]) -> list[dict[str, Any] | None]:
        if not citations:
            return []
        form = urllib.parse.urlencode([("citations", x) for x in citations]).encode()
        request = urllib.request.Request(f"{self.url}/api/processCitationList", form, {"Accept": "application/xml"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
                return parse_references(reply.read().decode("utf-8"), len(citations))
        except (urllib.error.URLError, TimeoutError, UnicodeDecodeError) as e:
            raise CitationError(str(e)) from e


def is_alive(url: str, timeout_s: float = 5.0) -> bool:
    """Whether the citation service answers its probe; never raises."""
    try:
        with urllib.request.urlopen(f"{url.rstrip('/')}/api/isalive", timeout=timeout_s) as reply:
            return reply.status == 200
    except Exception:
        return False


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page_idx", T.IntegerType()), T.StructField("block_idx", T.IntegerType()), T.StructField("reference", REFERENCE)])


def references(targets: DataFrame, make_client: Callable[[], CitationClient]) -> DataFrame:
    """``reference`` of each target (``doc_id, page_idx, block_idx, citation``), one request a document.

    If the client raises, the document's references are null.
    """

    on_workers(targets.sparkSession)

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_idx", "block_idx"])
        try:
            found = fitted(list(make_client().parse(rows["citation"].tolist())), len(rows))
        except Exception:
            found = [None] * len(rows)
        return rows[["doc_id", "page_idx", "block_idx"]].assign(reference=pd.Series(found, index=rows.index, dtype=object))

    return targets.select("doc_id", "page_idx", "block_idx", "citation").groupBy("doc_id").applyInPandas(ask, _OUT)
