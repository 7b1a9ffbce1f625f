"""Quality rules by compression bands.

zstandard shrinks prose by a factor that depends on its length and little else.  Text
that shrinks far more repeats itself; text that hardly shrinks is noise (hex dumps,
random identifiers).  Each document is measured as a whole and in fixed chunks, so that a
repetitive or random stretch shows even where the whole looks normal.  Shorter documents
have smaller chunks with a band of their own; what is left after the full chunks is
measured by a last chunk that ends where the text ends, so every byte is in one.  A text
below two of the smallest chunks is one chunk itself: its whole is the only measure.

Edge cases: a null text has no words and fails the base rules; so does an empty one.
Repeated rows are judged alike, each on its own.  Only ``doc_id`` and ``text`` are read,
so further columns never clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship, tidied

#: (UTF-8 bytes from, least ratio, greatest ratio) of a whole document.  A short text has
#: a frame to pay for and little to refer back to, so the limits widen with the length.
DOCUMENT_BANDS = (
    (0, 0.0, 4.0),
    (64, 0.70, 3.0),
    (256, 1.05, 3.4),
    (1024, 1.20, 3.8),
    (4096, 1.30, 4.4),
    (16384, 1.30, 5.5),
)
#: (UTF-8 bytes of a document from, bytes of a chunk, least and greatest ratio of a chunk).
CHUNKS = (
    (512, 256, 1.10, 3.4),
    (2048, 1024, 1.35, 3.8),
    (8192, 4096, 1.25, 4.4),
)
#: A document goes if more than this share of its bytes lies in chunks outside the band.
BAD_CHUNKS = 0.34
LEVEL = 3


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool


def measure(text: str | None) -> Measures:
    """The base measures of one text."""
    if text is None:
        return Measures(0, 0, 0, 0, 0, True)
    data = text.encode()
    words = data.split()
    n = len(words)
    white = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(once := set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        twice = set()
        for w in windows:
            if w in first:
                twice.add(w)
            else:
                first[w] = 1
        covered = -1  # last word counted
        for i, w in enumerate(windows):
            if w in twice:
                repeat += i + 2 - max(covered, i - 1)
                covered = i + 2
    del once
    return Measures(n, len(text) - white, symbols, dup_lines, repeat, n < 50 or 100 * repeat > 50 * n)


def band_of(n_bytes: int) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for start, a, b in DOCUMENT_BANDS:
        if n_bytes >= start:
            low, high = a, b
    return low, high


def ratios(data: bytes, compress) -> tuple[float, list[tuple[float, int, bool]]]:
    """Ratio of the whole; and of each chunk its ratio, the bytes that no chunk before holds, and if it is in the band."""
    n = len(data)
    whole = n / len(compress(data)) if data else 0.0
    size, low, high = next(((c, a, b) for start, c, a, b in reversed(CHUNKS) if n >= start), (0, 0.0, 0.0))
    chunks = []
    for at in range(0, n, size) if size else ():
        end = min(at + size, n)
        r = size / len(compress(data[end - size : end]))
        chunks.append((r, end - at, low <= r <= high))
    return whole, chunks


def verdict(data: bytes, compress) -> tuple[float, float, str]:
    """Ratio of the whole, share of bytes in chunks outside the band, and the reason to reject or ''."""
    whole, chunks = ratios(data, compress)
    low, high = band_of(len(data))
    bad = sum(n for _, n, fine in chunks if not fine) / len(data) if chunks else 0.0
    if whole > high:
        return whole, bad, "repetitive"
    if data and whole < low:
        return whole, bad, "incompressible"
    return whole, bad, "chunks" if bad > BAD_CHUNKS else ""


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, ratio double, bad_chunks double, reason string"
)


def _make():
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def step(columns: list[list]) -> list[list]:
        rows = []
        for doc_id, text in zip(*columns, strict=True):
            m = measure(text)
            ratio, bad, reason = verdict((text or "").encode(), compress)
            rows.append(
                (doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed)
                + (not (m.base_failed or reason), ratio, bad, reason)
            )
        return [list(c) for c in zip(*rows, strict=True)]

    return step


def compression_bands(docs: DataFrame) -> DataFrame:
    """One row for each document with its measures and the verdict; no shuffle."""
    return arrow_map(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], SCHEMA, _make)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, in the columns of ``docs``; whole rows travel through one scan."""
    from pyspark.sql.types import StructType

    names = docs.columns
    at = names.index("text")
    schema: StructType = docs.schema

    def keep(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            texts = batch.column(at)
            mask = []
            for t in texts:
                text = t.as_py()
                mask.append(not (measure(text).base_failed or verdict((text or "").encode(), compress)[2]))
            yield batch.filter(pa.array(mask, type=pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(tidied(keep), schema)
