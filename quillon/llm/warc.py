"""WARC archives with revisit resolution.

Records are strings of a header block, a blank line and a content block, two line ends apart; Spark's
text writer lays them into gzip files, in any store that Spark reaches. A file holds a bounded number of
records, and no more than one partition of the exchange before it, whose bytes the session bounds.
Readers inflate files piece by piece, cut them by Content-Length, and recompute every payload's digest.

Resolution works on headers alone: (page, digest, bytes) are grouped by payload digest, each group names
the one original response, and the other records of the group become revisits that refer to it. Payloads
are not moved by digest; they meet their verdict under (page, digest), so no payload is a hot key.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import cut, fresh_path

#: Payloads of fewer bytes are stored each for itself.
MIN_BYTES = 1000
#: Records in an archive file at most.
RECORDS_PER_FILE = 1000
#: Bytes inflated at once, and bytes of records that a reader passes on at once.
_PIECE, _BATCH = 1 << 20, 8 << 20
#: The date that fresh records bear; a parameter, so that reruns agree.
WRITTEN = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def record_id(page_id: Column, digest: Column) -> Column:
    """A record's URN, from the page's id and the payload's digest; rows alike in both share it."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(" "), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _http_head(length: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), length.cast("string"), F.lit(_END + _END))


def record_text(page_id: Column, url: Column, payload: Column, length: Column, digest: Column, refers_to: Column, written: str = WRITTEN) -> Column:
    """A record as text: a response with its payload, or a revisit (refers_to not null) without.

    Line ends in a url would break the header and are taken out. X-Page-Id carries the page's id.
    """
    head = _http_head(length)
    revisit = refers_to.isNotNull()
    lines = [
        F.concat(F.lit(f"{VERSION}{_END}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page_id, digest)),
        F.lit(f"WARC-Date: {written}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Page-Id: "), F.coalesce(page_id.cast("string"), F.lit(""))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to, digest), F.lit(f"{_END}WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.octet_length(head)).otherwise(F.octet_length(head) + length).cast("string")),
    ]
    block = F.when(revisit, head).otherwise(F.concat(head, payload))
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END), block)


def write_records(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one column of record texts as gzip archives. Every task writes files of its own."""
    records.write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflate(raw: bytes) -> Iterator[bytes]:
    """The contents of all members of a gzip file, piece by piece."""
    while raw:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(raw, _PIECE)
            raw = member.unconsumed_tail
            if not piece and not raw and not member.eof:
                raise ValueError("an archive is cut short")
            yield piece
        raw = member.unused_data


class _Reader:
    """Bytes that arrive in pieces, taken by length or up to a mark."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at = iter(pieces), bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def empty(self) -> bool:
        while not self.held:
            if not self._more():
                return True
        return False

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is taken as well; None if there is no mark."""
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        return self.take(end + len(mark))[:end]


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and content block of each record; damage raises ValueError."""
    reader = _Reader(pieces)
    while not reader.empty():
        begin = reader.at
        head = reader.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/1."):
            raise ValueError(f"no record begins at byte {begin}")
        headers = {}
        for line in head.decode("utf-8", "replace").split(_END)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        block = reader.take(int(headers["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {begin} has a wrong length")
        yield headers, block


_FIELDS = "page_id string, url string, record_type string, record string, refers_record string, stated_digest string, stated_bytes long, digest string, bytes long"


def _stated(headers: dict[str, str]) -> str:
    """The stated payload digest as lower-case hex; archives state SHA-1 in base 32 or in hex."""
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    return base64.b32decode(told.upper()).hex() if len(told) == 32 else told.lower()


def _read(with_payload: bool):  # noqa: ANN202
    names = ["page_id", "url", "record_type", "record", "refers_record", "stated_digest", "stated_bytes", "digest", "bytes", *(["payload"] if with_payload else [])]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64()] + ([pa.binary()] if with_payload else [])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for headers, block in parse_records(_inflate(batch.column(0)[i].as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = headers.get("warc-type", "")
                    stated = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else None
                    told = _stated(headers)
                    if digest is not None and told and told != digest:
                        raise ValueError("a payload differs from its digest")
                    rows.append((headers.get("x-page-id") or None, headers.get("warc-target-uri"), kind, headers.get("warc-record-id"), headers.get("warc-refers-to"), told, stated, digest, len(payload), *([payload] if with_payload else [])))
                    held += 500 + (len(payload) if with_payload else 0)
                    if held >= _BATCH:
                        yield packed(rows)
                        rows, held = [], 0
        yield packed(rows)

    return run


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:  # noqa: ANN001
    """A row per record: headers, the digest and bytes recomputed from the payload, and the payload if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read(with_payload), _FIELDS + (", payload binary" if with_payload else ""))


def originals(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, original) for every payload that several records of (page_id, digest, bytes) share and that is large enough.

    The record of the largest page id is the original. Counts are summed in each task before the
    exchange, so a payload shared by very many records costs a row per task.
    """
    large = headers.where(F.col("bytes") >= min_bytes)
    return large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "original")


def revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of those of the records (page_id, digest, bytes) that become revisits, each once."""
    large = headers.where(F.col("bytes") >= min_bytes).select("page_id", "digest").distinct()
    both = large.join(originals(headers, min_bytes), "digest")
    return both.where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", F.col("original").alias("refers_to"))


def _judged(rows: DataFrame, heads: DataFrame, min_bytes: int) -> DataFrame:
    """`rows` (with page_id and digest) and refers_to: null for responses."""
    told = revisits(heads, min_bytes).select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    return rows.join(told, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_page", "r_digest")


def _texts(judged: DataFrame, written: str) -> DataFrame:
    """One column of record texts from (page_id, url, payload, bytes, digest, refers_to)."""
    return judged.select(record_text(F.col("page_id"), F.col("url"), F.col("payload"), F.col("bytes"), F.col("digest"), F.col("refers_to"), written).alias("value"))


def write_deduplicated(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, written: str = WRITTEN) -> None:
    """Write a record per row of `pages` (page_id long, url, payload string): one response for each large payload.

    Other rows with that payload become revisits. Rows that share the original's page id as well are
    responses too. A null payload counts as empty; a null page id never is an original. No rows give no
    records. Other columns are not read.
    """
    full = pages.select("page_id", "url", F.coalesce(F.col("payload"), F.lit("")).alias("payload"))
    full = full.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    write_records(_texts(_judged(full, full.select("page_id", "digest", "bytes"), min_bytes), written), path)


def _resolved(records: DataFrame) -> DataFrame:
    """`resolve`, and `found`: false for a revisit whose original is not among the records."""
    responses = records.where("record_type = 'response'").groupBy("record", "digest").agg(F.max(F.struct("bytes", "page_id")).alias("o"))
    known = responses.select(F.col("record").alias("key"), F.col("digest").alias("key_digest"), F.col("o.bytes").alias("o_bytes"), F.col("o.page_id").alias("o_page"), F.lit(True).alias("known"))
    # Responses refer to nothing; keys of their own spread them over tasks.
    revisit = F.col("record_type") == "revisit"
    own = F.concat(F.lit("-"), F.coalesce("record", "page_id", F.lit("")))
    keyed = records.withColumns({"key": F.coalesce(F.when(revisit, F.col("refers_record")), own), "key_digest": F.coalesce("digest", "stated_digest")})
    found = revisit & F.coalesce("known", F.lit(False))
    return keyed.join(known, ["key", "key_digest"], "left").select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.when(revisit, F.when(found, F.col("o_bytes")).otherwise(F.col("stated_bytes"))).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(found, F.col("o_page")).cast("long").alias("refers_to"),
        (found | ~revisit).alias("found"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """Records read from archives, with revisits resolved: payload_digest, payload_bytes and refers_to of each.

    Revisit headers are joined with the responses of their record id and digest. A revisit whose
    original is not among the records keeps the digest and length it states and a null refers_to.
    Records that repeat are all kept; no records give no rows.
    """
    return _resolved(records).drop("found")


def rewrite_archives(spark, source: str, target: str, min_bytes: int = MIN_BYTES, written: str = WRITTEN) -> DataFrame:  # noqa: ANN001
    """Read archives, resolve their revisits, and write deduplicated ones with fresh headers.

    New originals are chosen from all resolved headers, so chains of revisits end in one response; the
    responses then get their payloads from one body of each digest. Revisits without an original in
    `source` are left out and returned as (page_id, url, payload_digest).
    """
    heads = cut(_resolved(read_archives(spark, source)).withColumnsRenamed({"payload_digest": "digest", "payload_bytes": "bytes"}), "warc-heads")
    known = heads.where("found").select("page_id", "url", "digest", "bytes")
    judged = _judged(known, known, min_bytes)
    bodies = read_archives(spark, source, with_payload=True).where("record_type = 'response'").select("digest", F.col("payload").cast("string").alias("payload")).dropDuplicates(["digest"])
    whole = judged.where("refers_to is null").join(bodies, "digest").unionByName(judged.where("refers_to is not null").withColumn("payload", F.lit(None).cast("string")))
    write_records(_texts(whole, written), target)
    return heads.where("not found").select("page_id", "url", F.col("digest").alias("payload_digest"))


def archive_digest(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page: written to archives, read back and resolved.

    Nulls and repeated rows are as in `write_deduplicated`; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_deduplicated(pages.select("page_id", "url", F.col("html").alias("payload")), path)
    return resolve(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
