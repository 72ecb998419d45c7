"""Remote access by htsget and refget: requests, tickets, and fetching in parallel."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote_to_bytes, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from ..functions.coords import Region

#: Tries for a request that fails on the way, and seconds to wait for an answer.
TRIES = 3
WAIT = 60


def htsget_url(base: str, kind: str, identifier: str, regions: list[Region] = (), format_: str | None = None) -> str:
    """A ticket request; positions go out 0-based, half-open. ``kind`` is reads or variants."""
    if kind not in ("reads", "variants"):
        raise ValueError(f"unknown kind: {kind}")
    query = [("format", format_)] if format_ else []
    if len(regions) > 1:
        raise ValueError("a URL holds one region; more of them go into a body")
    for r in regions:
        query.append(("referenceName", r.name))
        if r.start is not None:
            query.append(("start", str(r.start - 1)))
        if r.end is not None:
            query.append(("end", str(r.end)))
    return f"{base.rstrip('/')}/{kind}/{quote(identifier)}" + (f"?{urlencode(query)}" if query else "")


def htsget_body(regions: list[Region], format_: str | None = None) -> str:
    """A request's body for several regions."""
    listed = []
    for r in regions:
        one: dict = {"referenceName": r.name}
        if r.start is not None:
            one["start"] = r.start - 1
        if r.end is not None:
            one["end"] = r.end
        listed.append(one)
    return json.dumps(({"format": format_} if format_ else {}) | {"regions": listed})


def parse_ticket(text: str) -> tuple[str, list[dict]]:
    """(format, blocks in order); an error response raises."""
    body = json.loads(text).get("htsget")
    if body is None:
        raise ValueError("no ticket")
    if "error" in body:
        raise ValueError(f"{body['error']}: {body.get('message', '')}")
    return body.get("format", "BAM"), body["urls"]


def blocks(urls: list[dict], fetch: Callable[[str, dict], bytes]) -> Iterator[bytes]:
    """The blocks' contents in order; ``data:`` ones hold theirs."""
    for u in urls:
        url = u["url"]
        if url.startswith("data:"):
            head, _, body = url[5:].partition(",")
            yield base64.b64decode(body) if head.endswith(";base64") else unquote_to_bytes(body)
        else:
            yield fetch(url, u.get("headers", {}))


def get(url: str, headers: dict | None = None) -> bytes:
    """What a URL answers; tried again where the way there fails, not where the server says no."""
    from http.client import HTTPException
    from urllib.error import HTTPError, URLError

    for left in range(TRIES - 1, -1, -1):
        try:
            with urlopen(Request(url, headers=headers or {}), timeout=WAIT) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code < 500 or not left:
                raise
        except (URLError, HTTPException, TimeoutError):
            if not left:
                raise
    raise AssertionError


def htsget(spark: SparkSession, requests: list[str], folder: str, suffix: str, fetch: Callable[[str, dict], bytes] = get) -> list[str]:
    """A file in ``folder`` for each ticket request, of its blocks in order; a task a request. Returns the paths.

    The files are read by the format's source. Regions that are asked for one
    by one may answer with the same records more than once.
    """
    from .sinks import write_parts

    def body(batches):
        for b in batches:
            for url in b.column(0).to_pylist():
                yield from blocks(parse_ticket(fetch(url, {}).decode())[1], fetch)

    given = spark.createDataFrame([(u,) for u in requests], "url string").repartitionByRange(max(1, len(requests)), "url")
    return write_parts(given, folder, suffix, body)


def refget(sequences: DataFrame, base: str, fetch: Callable[[str, dict], bytes] = get) -> DataFrame:
    """``sequences`` (id, start, end; 1-based, null for open) with ``sequence``, fetched where the rows are."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sequences.schema) + ", sequence string"
    names = sequences.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            found = [fetch(refget_url(base, r["id"], r["start"], r["end"]), {"Accept": "text/plain"}).decode() for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*names, "sequence"])

    return sequences.mapInArrow(run, schema)


def refget_url(base: str, identifier: str, start: int | None = None, end: int | None = None, what: str = "sequence") -> str:
    """A slice of a sequence (positions go out 0-based, half-open), its metadata, or the service's description."""
    base = base.rstrip("/")
    if what == "service-info":
        return f"{base}/sequence/service-info"
    if what == "metadata":
        return f"{base}/sequence/{quote(identifier)}/metadata"
    query = ([("start", str(start - 1))] if start is not None else []) + ([("end", str(end))] if end is not None else [])
    return f"{base}/sequence/{quote(identifier)}" + (f"?{urlencode(query)}" if query else "")


def parse_metadata(text: str) -> dict:
    m = json.loads(text)["metadata"]
    return {"md5": m.get("md5"), "trunc512": m.get("trunc512"), "length": int(m["length"]), "aliases": [a["alias"] for a in m.get("aliases", [])]}
