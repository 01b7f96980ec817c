"""WARC archives: a writer with digests and revisits, and a reader that salvages damaged archives.

An archive is a row (archive, content): gzip members of one record each, at most about ARCHIVE_BYTES, kept in Parquet so
that any store Spark can write to serves. The reader checks every member (gzip CRC, version line, length, digest). After
a failed check it searches for the next valid member or version line, recovers the later records, and logs the bytes in
between as a quarantined gap. Plain (not compressed) archives are read the same way. In a damaged member that holds several
records, those whose digest is right are recovered from the bytes that can be inflated, before and behind the damage.

Edge cases: null html counts as empty. A null page id is written without an id and read back as null. Of equal payloads
the one with the largest id is the response (all rows of that id; all rows if every id is null), the others revisit it.
Repeated rows are records of their own. An empty table gives no archive. Other columns of pages, whatever their names, are
not read. Heads and payloads may have any length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm.common import materialise, quoted

ARCHIVE_BYTES = 4 << 20
LEVEL = 1
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
LINE = b"WARC/1."
#: Bytes that are inflated at once.
CHUNK = 1 << 16


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return VERSION + b"\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    clean = "".join(c for c in url or "" if c >= " ")
    h = {"WARC-Type": "revisit" if is_revisit else "response"}
    if page_id is not None:
        h["WARC-Record-ID"] = f"<urn:page:{page_id}>"
    h |= {"WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{digest32(payload)}", "X-Payload-Length": str(len(payload))}
    if is_revisit:
        h |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        return record(h, b"")
    return record(h, payload)


class Damaged(ValueError):
    pass


def parse(raw: bytes, at: int, checked: bool = False) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at a version line; Damaged if a check fails (checked: or if there is no digest)."""
    if not raw.startswith(LINE, at):
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("the head has no end")
    headers = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line has no colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    if size < 0 or len(raw) < end + 4 + size or not raw.startswith(b"\r\n\r\n", end + 4 + size):
        raise Damaged("the block has a wrong length")
    block = raw[end + 4 : end + 4 + size]
    said = headers.get("warc-payload-digest", "")
    full = headers.get("warc-type") == "response" and said.startswith("sha1:")
    if full and said[5:] != digest32(block):
        raise Damaged("the payload has another digest")
    if checked and not full:
        raise Damaged("no digest to trust a record of a damaged member by")
    return headers, block, end + 8 + size


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at a place holds, its end (0 if it is damaged) and why it ends early; fed in chunks."""
    z, parts = zlib.decompressobj(31), []
    view = memoryview(data)
    for k in range(at, len(data), CHUNK):
        try:
            parts.append(z.decompress(view[k : k + CHUNK]))
        except zlib.error as e:
            return _until_error(view[at : k + CHUNK]), 0, str(e)
        if z.eof:
            return b"".join(parts), min(len(data), k + CHUNK) - len(z.unused_data), ""
    return b"".join(parts), 0, "the member ends early"


def _until_error(view: memoryview) -> bytes:
    """What comes out of a damaged member before zlib gives up, fed in small steps."""
    z, got = zlib.decompressobj(31), bytearray()
    try:
        for k in range(0, len(view), 256):
            got += z.decompress(view[k : k + 256])
    except zlib.error:
        pass
    return bytes(got)


def _inside(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the inflated part of a damaged member that prove themselves by their digest."""
    place = raw.find(LINE)
    while place >= 0:
        try:
            headers, block, end = parse(raw, place, checked=True)
        except Damaged:
            end = place + 1
        else:
            yield headers, block
        place = raw.find(LINE, end)


def _member(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int, str]:
    """Records of the gzip member at a place, its end (0: damaged as a whole) and what was wrong with it."""
    raw, end, why = inflate(data, at)
    if why:
        return list(_inside(raw)), 0, why
    found, place = [], 0
    try:
        while place < len(raw):
            headers, block, place = parse(raw, place)
            found.append((headers, block))
    except Damaged as e:
        later = list(_inside(raw[place + 1 :]))
        return found + later, end, f"{e} at byte {place} of the member's {len(raw)}"
    return (found, end, "") if found else ([], end, "an empty member")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict[str, str], bytes]]:
    """("record", start, end, "", headers, block) and ("gap", start, end, reason, {}, b""), in order.

    Records and gaps cover every byte. Records that were recovered from a damaged member come with the member's place, which
    is in a gap as well.
    """
    at, bad, reason = 0, -1, ""
    sought = {MAGIC: -1, LINE: -1}  # the next place of each mark at or behind `at`
    while at < len(data):
        found, end, why = [], 0, ""
        if data.startswith(MAGIC, at):
            found, end, why = _member(data, at)
        elif data.startswith(LINE, at):
            try:
                headers, block, end = parse(data, at)
                found = [(headers, block)]
            except Damaged as e:
                why = str(e)
        else:
            why = "no version line"
        if not why:
            if bad >= 0:
                yield "gap", bad, at, reason, {}, b""
                bad = -1
            for headers, block in found:
                yield "record", at, end, "", headers, block
            at = end
            continue
        if bad < 0:
            bad, reason = at, why
        for headers, block in found:
            yield "record", at, end or at, "recovered", headers, block
        if end:  # the member's own checks hold, so what follows it is known
            yield "gap", bad, end, reason, {}, b""
            at, bad = end, -1
            continue
        for mark, place in sought.items():
            if place <= at and place != len(data):
                place = data.find(mark, at + 1)
                sought[mark] = len(data) if place < 0 else place
        at = min(sought.values())
    if bad >= 0:
        yield "gap", bad, len(data), reason, {}, b""


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) of all pages, written to the shared folder.

    Digests and ids alone are shuffled to find payloads that stand on more than one page; that table is written, so Spark
    knows its size when it joins: small, it is broadcast and the payloads stay where they are; else they are shuffled once,
    and the adaptive join splits a hot digest's pages over tasks.
    """
    html = F.coalesce(quoted(payload_col).cast("string"), F.lit(""))
    url = quoted(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(quoted(id_col).cast("long").alias("id"), url.alias("url"), html.alias("payload"))
    keyed = rows.withColumn("key", F.unhex(F.sha1("payload")))
    best = keyed.groupBy("key").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    best = materialise(best.where((F.col("n") > 1) & F.col("best").isNotNull()).select("key", "best"), "warc-shared")
    joined = keyed.join(best, "key", "left").select("id", "url", "payload", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, name = [], 0, ""

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i, u, p, best_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = best_ is not None and i != best_
                raw = member(page_record(i, u, p.encode(), best_, revisit))
                name = name or f"pages-{hashlib.sha1(raw).hexdigest()[:16]}.warc.gz"
                parts.append(raw)
                held += len(raw)
                if held >= archive_bytes:
                    yield flush()
                    parts, held, name = [], 0, ""
        if parts:
            yield flush()

    return materialise(joined.mapInArrow(run, "archive string, content binary"), "warc")


RECORD = "kind string, archive string, start long, end long, reason string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def _number(urn: str | None) -> int | None:
    try:
        return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None
    except ValueError:
        return None


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Records and gaps of archives (archive, content), as RECORD and with payload = True the block."""
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * payload

    def rows(name: str, content: bytes):
        for kind, start, end, reason, h, block in salvage(content):
            if kind == "gap":
                yield (kind, name, start, end, reason, None, None, None, None, None, None, None)
                continue
            said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            full = h.get("warc-type") != "revisit"
            size = len(block) if full else int(h.get("x-payload-length", 0))
            digest = digest32(block) if full and said is None else said  # a response's digest was checked by parse
            yield (kind, name, start, end, reason or None, h.get("warc-type"), _number(h.get("warc-record-id")), h.get("warc-target-uri"), size, digest, _number(h.get("warc-refers-to")), block)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found, held = [], 0
                for row in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    found.append(row[: len(names)])
                    held += len(row[11]) if payload and row[11] else 0
                    if len(found) >= 5000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive", "content").mapInArrow(run, RECORD + ", payload binary" * payload)


class Incomplete(RuntimeError):
    pass


def complete(records: DataFrame, expected: int) -> DataFrame:
    """The records out of what read gave; Incomplete, with the place of the gap log, if fewer than expected came back."""
    found = materialise(records, "warc-records")
    gaps = found.where(F.col("kind") == "gap")
    n, lost = found.agg(F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "gap")).first()
    if lost:
        gaps = materialise(gaps.select("archive", "start", "end", "reason"), "warc-gaps")
    if n != expected:
        where = gaps.inputFiles()[:1] if lost else "nowhere"
        raise Incomplete(f"{n} of {expected} records were read; {lost} quarantined gaps are logged in {where}")
    return found.where(F.col("kind") == "record")


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
  CASE WHEN max(page_id) OVER w IS NULL OR page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, i * 5 + 1, 5))::INT + 1, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest
FROM (SELECT *, (SELECT string_agg(lpad(bin(('0x' || substr(sha1(coalesce(html, '')), k + 1, 1))::INT), 4, '0'), '' ORDER BY k) FROM range(40) s(k)) AS bits FROM pages)
WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
