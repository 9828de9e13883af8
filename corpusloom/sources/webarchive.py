"""Web archives: WARC records, HTTP responses, main text of HTML pages."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_DOCUMENT

_NAME = re.compile(r"^(.+)[.]warc(?:[.]gz)?$")
_STATUS = re.compile(rb"^HTTP\S+ (\d+)(?: .*)?$")
BLOCKS = frozenset("address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style noscript head iframe object template svg select button textarea".split())

Extractor = Callable[[str], str | None]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(name: str) -> Callable[[Extractor], Extractor]:
    """[E8] Registers a function from HTML to main text."""

    def put(f: Extractor) -> Extractor:
        EXTRACTORS[name] = f
        return f

    return put


# --- WARC and HTTP ------------------------------------------------------------------------------------------------------


def archive_stem(path: str) -> str:
    """[S20] the name in front of .warc or .warc.gz; other names are an error."""
    m = _NAME.match(path)
    if not m:
        raise ValueError(f"not a WARC file's name: {path!r}")
    return m[1]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """[S17] header fields (lower-case names) and block of each record; ends at what is not a record."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            return
        head: dict[str, str] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if colon:
                head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        try:
            length = int(head.get("content-length", ""))
        except ValueError:
            return
        yield head, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def canonical_charset(name: str) -> str:
    """[S19] "cp-1250" and the like without the hyphen, blanks as underscores."""
    return re.sub(r"^(cp|windows)-(?=\d)", lambda m: "cp" if m[1].lower() == "cp" else "windows-", name.strip().strip("\"'"), flags=re.I).replace(" ", "_")


def http_body(block: bytes) -> str | None:
    """[S18 S19 Q26] the decoded body of a response with status 200; None for others, malformed ones and unknown charsets."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    status = _STATUS.match(lines[0])
    if not gap or not status or status[1] != b"200":
        return None
    charset, chunked, encoding = "utf-8", False, ""
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        text = value.decode("latin-1")
        if name == b"Content-Type" and (m := re.search(r"charset\s*=\s*([^;]+)", text, re.I)):
            charset = canonical_charset(m[1])
        elif name.lower() == b"transfer-encoding":
            chunked = "chunked" in text.lower()
        elif name.lower() == b"content-encoding":
            encoding = text.strip().lower()
    try:
        codec = codecs.lookup(charset)
    except LookupError:
        return None
    if chunked and (plain := _unchunked(body)) is not None:
        body = plain
    if encoding in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(zlib.MAX_WBITS | 32 if encoding != "deflate" else zlib.MAX_WBITS).decompress(body)
        except zlib.error:
            pass
    return codec.decode(body, "replace")[0]


def _unchunked(body: bytes) -> bytes | None:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size <= 0:
            return b"".join(out) if size == 0 else None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


_BETWEEN = b"\r\n\r\nWARC/"


def _record_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of each record: a piece that is shorter than its header says goes on in the file's next one."""
    path, held = None, b""
    for batch in batches:
        for own, piece in zip(batch["path"], batch["piece"], strict=True):
            whole = bytes(piece) if bytes(piece[:5]) == b"WARC/" else b"WARC/" + bytes(piece)
            if held and own == path and _missing(held):
                held += _BETWEEN + whole[5:]
                continue
            if held:
                yield path, held
            path, held = own, whole
    if held:
        yield path, held


def _missing(record: bytes) -> bool:
    end = record.find(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", record[: max(end, 0)])
    return bool(stated) and len(record) - end - 4 < int(stated[1])


def warc_documents(spark: SparkSession, paths: str | list[str], extract: str = "boilerpipe", on_error: str = "drop") -> DataFrame:
    """[S17-S20 X27 X28] url, date, content of the responses with status 200 in .warc and .warc.gz files.

    Only records with a target URI and a date are taken.  content is null where the extractor fails.  A file that can't be
    read gives no rows, or with on_error "fail" ends the job.  Files of any size are read record by record, plain ones in
    parts: the text source cuts them where a record begins.
    """
    if extract not in EXTRACTORS:
        raise ValueError(f"no such extractor: {extract!r}")
    source = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc*").option("lineSep", _BETWEEN.decode()).option("ignoreCorruptFiles", on_error != "fail")
    pieces = source.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, str, str | None]] = []
        for path, record in _record_pieces(batches):
            try:
                archive_stem(path)
                head, block = next(records(record), ({}, b""))
                if not head and on_error == "fail":
                    raise ValueError(f"not a WARC record in {path}")
            except ValueError:
                if on_error == "fail":
                    raise
                continue
            if head.get("warc-type", "").lower() == "response" and head.get("warc-target-uri") and head.get("warc-date"):
                page = http_body(block)
                if page is not None:
                    rows.append((head["warc-target-uri"], head["warc-date"], _extract(extract, page)))
            if len(rows) >= 200:
                yield pd.DataFrame(rows, columns=["url", "date", "content"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["url", "date", "content"])

    return pieces.mapInPandas(run, RAW_DOCUMENT)


# --- main text ----------------------------------------------------------------------------------------------------------


class _Blocks(HTMLParser):
    """Text blocks of a page: words, words inside links, whether under a heading tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.linked, self.in_link, self.skipping, self.heading = 0, 0, 0, False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
            self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in SKIPPED and tag != "head":
            self.skipping += 1
        if tag == "a":
            self.in_link += 1
        if tag == "body":
            self.skipping = 0

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.heading = False
        if tag in SKIPPED and tag != "head":
            self.skipping = max(0, self.skipping - 1)
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.split())

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            n = len(words.split())
            self.blocks.append((words, n, min(n, self.linked), self.heading))
        self.text, self.linked = [], 0


def text_blocks(page: str) -> list[tuple[str, int, int, bool]]:
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


@extractor("boilerpipe")
def article(page: str) -> str:
    """Blocks that link density and the lengths of the block and its neighbours mark as main text (shallow text features,
    Kohlschütter et al., 2010)."""
    blocks = text_blocks(page)
    out = []
    for k, (text, n, linked, _) in enumerate(blocks):
        before, after = (blocks[j][1] if 0 <= j < len(blocks) else 0 for j in (k - 1, k + 1))
        density = linked / n
        dense_before = blocks[k - 1][2] / blocks[k - 1][1] if k else 0.0
        good = density <= 1 / 3 and (n > 16 or (n > 4 and after > 15) or (before > 4 and n > 4) if dense_before <= 0.56 else n > 40 or after > 17)
        if good:
            out.append(text)
    return "\n".join(out)


@extractor("justext")
def paragraphs(page: str, least: int = 30, much: int = 70, density: float = 0.2) -> str:
    """Paragraphs that are long and not of links, with short ones between them (context-sensitive classes after Pomikálek,
    2011, without stop-word lists; lengths in characters)."""
    kinds = []
    blocks = text_blocks(page)
    for text, n, linked, _ in blocks:
        if linked / n > density:
            kinds.append("bad")
        elif len(text) < least:
            kinds.append("short")
        else:
            kinds.append("good" if len(text) >= much else "near")
    firm = [k if k in ("good", "bad") else None for k in kinds]
    left, right = firm[:], firm[:]
    for k in range(1, len(firm)):
        left[k] = firm[k] or left[k - 1]
    for k in range(len(firm) - 2, -1, -1):
        right[k] = firm[k] or right[k + 1]
    keep = [k == "good" or (k == "near" and "good" in (a, b)) or (k == "short" and a == b == "good") for k, a, b in zip(kinds, left, right, strict=True)]
    return "\n".join(b[0] for b, ok in zip(blocks, keep, strict=True) if ok)


@extractor("html")
def whole_page(page: str) -> str:
    """The page as it is."""
    return page


def _extract(name: str, page: str) -> str | None:
    try:
        return EXTRACTORS[name](page)
    except Exception:  # noqa: BLE001  any failure of an extractor means a null content
        return None


def main_text(page: Column, extract: str = "boilerpipe") -> Column:
    """[X27 X28] a page's main text; null for null and where the extractor fails."""
    if extract not in EXTRACTORS:
        raise ValueError(f"no such extractor: {extract!r}")

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else _extract(extract, p)).astype(object)

    return run(page)
