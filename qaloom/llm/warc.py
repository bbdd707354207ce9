"""WARC archives written and read through Spark, and one globally ordered index over all of them.

Records are rows of text whose separator is the record's end, so Spark's writer makes the files and commits them. A
reader follows the stream of a file by the lengths in the headers. The captures of a file are one run, sorted where it
was read; ranges of url key, time and id collect their parts of all runs, and a loser tree merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.session import broadcast_if_small, stage

CRLF = "\r\n"
BLANK = CRLF + CRLF
# Equal payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
# Captures that one task merges.
RANGE_ROWS = 200_000
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + BLANK
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Pages have no time of capture: page n counts as taken n seconds after this.
EPOCH = 1_700_000_000


def payload_digests(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest`` of every page; a null html is empty."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def shared_payloads(digests: DataFrame) -> DataFrame:
    """``payload_digest, payload_bytes, refers_to``: payloads of several records and the largest id of a page that has them.

    Only digests are compared, and shuffled after partial aggregation. Pages without id alone share nothing.
    """
    groups = digests.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest", "payload_bytes")
    kept = groups.agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return kept.drop("n")


def _urn(page: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, digests: DataFrame) -> DataFrame:
    """``value``: the record of every page without its end. Revisits have no payload.

    Whether a row is a revisit follows from its own payload and id: pages that share an id are records of their own.
    A page without id is stored by itself.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("payload"))
    pages = pages.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    rows = pages.join(broadcast_if_small(stage(shared_payloads(digests), "shared")), ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("page_id") != F.col("refers_to"), F.lit(False))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    rows = rows.withColumn("block", block)
    taken = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0)))
    stamp = F.date_format(F.to_utc_timestamp(taken, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # A line end or other control character in a url would end its header.
    target = F.regexp_replace("url", r"[\x00-\x1F\x7F]", "%20")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn("page_id")),
        F.concat(F.lit("WARC-Date: "), stamp),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _urn("refers_to"))),
        F.when(again, F.lit("WARC-Profile: " + REVISIT_PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws(CRLF, *fields), F.lit(BLANK), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One gzipped archive per partition of ``pages (page_id, url, html)`` under ``path``, which must not exist.

    The payload is the html in UTF-8; a null one is empty and a null url has no target. Repeated rows are repeated
    records, and rows that share only an id are records with payloads of their own. Other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    digests = stage(payload_digests(pages), "digests")
    records(pages, digests).write.option("lineSep", BLANK).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort key of a url: host names in reverse order, then path and query, without scheme, user and fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def _captures(stream: bytearray, base: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Complete records at the head of ``stream``, which they leave: offset, length, headers and block.

    Line ends before a record are no header: a file whose last payload ends in one comes back with a blank too many.
    """
    begin = 0
    while True:
        while stream.startswith(CRLF.encode(), begin):
            begin += len(CRLF)
        head = stream.find(BLANK.encode(), begin)
        if head < 0:
            break
        lines = stream[begin:head].decode("utf-8", "surrogateescape").split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines[1:])
        end = head + len(BLANK) + int(fields["Content-Length"])
        if len(stream) < end + len(BLANK):
            break
        yield base + begin, end + len(BLANK) - begin, fields, bytes(stream[head + len(BLANK) : end])
        begin = end + len(BLANK)
    del stream[:begin]


INDEX = (
    "url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, url string, file string, offset long, length long, run long, place long"
)
_NAMES = [field.split()[0] for field in INDEX.split(", ")]


def _page(urn: str | None) -> int | None:
    name = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def _entry(file: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    from hashlib import sha1

    kind = fields["WARC-Type"]
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[len(HTTP) :]
    if kind == "response" and (len(payload), sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"the payload at {offset} of {file} does not match its record")
    url = fields.get("WARC-Target-URI")
    page, refers = _page(fields["WARC-Record-ID"]), _page(fields.get("WARC-Refers-To"))
    return url_key(url or ""), fields["WARC-Date"], page, kind, size, digest, refers, url, file, offset, length


def _order(entry: tuple) -> tuple:
    """Url key by bytes, time, id with none first, then file and offset."""
    key, captured, page = entry[:3]
    return key.encode("utf-8", "surrogateescape"), captured, page is not None, page or 0, entry[8], entry[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if field.split()[1] == "long" else pa.string() for field in INDEX.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``: one sorted run per file, numbered by the hash of its name.

    A task holds one record and the index rows of one file at a time.
    """
    scan = spark.read.option("lineSep", BLANK).text(path).select("value", "_metadata.file_path")
    scan = scan.withColumn("run", F.xxhash64("file_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, base, file, number, entries = bytearray(), 0, None, 0, []

        def done() -> pa.RecordBatch:
            entries.sort(key=_order)
            return _batch([(*e, number, i) for i, e in enumerate(entries)])

        for batch in batches:
            lines, files = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            for line, name, hashed in zip(lines, files, batch.column(2).to_pylist(), strict=True):
                if name != file:
                    if entries:
                        yield done()
                    stream, base, file, number, entries = bytearray(), 0, name, hashed, []
                stream += line
                stream += BLANK.encode()
                before = len(stream)
                if before < _wanted(stream):
                    continue
                for offset, length, fields, block in _captures(stream, base):
                    entries.append(_entry(file, offset, length, fields, block))
                base += before - len(stream)
        if entries:
            yield done()

    return scan.mapInArrow(run, INDEX)


def _wanted(stream: bytearray) -> int:
    """Bytes that the first record of the stream needs, so that long payloads are not parsed again at each line."""
    head = stream.find(BLANK.encode())
    field = stream.rfind(b"Content-Length: ", 0, head) if head >= 0 else -1
    if field < 0:
        return 0
    return head + 2 * len(BLANK) + int(stream[field + 16 : stream.find(CRLF.encode(), field)])


class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of their match, so each step replays one path."""

    def __init__(self, runs: list[list[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, len(runs))
        for run in range(len(runs)):
            self._replay(run)

    def _beats(self, one: int, two: int) -> bool:
        """Whether the head of run ``one`` goes first; an empty run never does."""
        a, b = self.heads[one], self.heads[two]
        return b is None or (a is not None and (a, one) < (b, two))

    def _replay(self, run: int) -> None:
        node = (run + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                # Still being filled: wait here for the opponent.
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[winner := self.losers[0]] is not None:
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            left = self.at[winner] < len(self.runs[winner])
            self.heads[winner] = self.key(self.runs[winner][self.at[winner]]) if left else None
            self._replay(winner)


def capture_index(runs: DataFrame) -> DataFrame:
    """All captures in the order of url key, time and id: by partition, and by ``place`` in it.

    Ranges are cut by key, time and id, so that a url with very many captures is spread over many.
    """
    runs = stage(runs, "runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts.setdefault(row[-2], []).append(row)
        for part in parts.values():
            # A part of a run is a part of its order; blocks of the shuffle may have come in another one.
            if any(a[-1] > b[-1] for a, b in zip(part, part[1:], strict=False)):
                part.sort(key=lambda r: r[-1])
        out: list[tuple] = []
        for place, row in enumerate(LoserTree([parts[k] for k in sorted(parts)], _order)):
            out.append((*row[:-1], place))
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "file", "offset").mapInArrow(run, INDEX)
