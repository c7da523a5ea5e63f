"""Quality rules: word statistics, and bands of zstandard ratios over whole documents and fixed chunks.

One Arrow pass, nothing is shuffled. Words are runs without ASCII white space. A ratio is compressed
bytes over bytes. A short text compresses badly whatever it says, so each band belongs to a range of
lengths; a chunk band judges 4096-byte chunks, the rest joining the last chunk when it is shorter than half a chunk.

Defined results: a null or empty text has no words, no ratio, and fails the base rule; ids may be null or repeat; an
empty table gives an empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import by_batch

#: (bytes from, lowest ratio, highest ratio) for whole documents. Measured prose stays at least a fifth inside.
BANDS = ((0, 0.0, 9.0), (200, 0.36, 0.95), (400, 0.36, 0.86), (800, 0.33, 0.80), (1600, 0.30, 0.74), (4000, 0.28, 0.70), (10_000, 0.25, 0.68), (30_000, 0.20, 0.66))
#: Bytes in a chunk, its band, and the share of chunks that must be outside for a document to go.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (0.22, 0.74), 0.5
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of 8 whose content occurs at least twice; windows are compared exactly."""
    if len(ids) <= window:
        return 0
    a, width = ids, 1
    while width < window:
        key = a[:-width] * np.int64(len(ids) + 1) + a[width:] if width > 1 else a[:-1] * np.int64(int(ids.max()) + 1) + a[1:]
        distinct, a = np.unique(key, return_inverse=True)
        if len(distinct) == len(a):
            return 0
        width *= 2
    twice = np.bincount(a)[a] >= 2
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:-window][twice] += 1
    np.subtract.at(edge, np.flatnonzero(twice) + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on ASCII white space alone
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    known = _Ids()
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def band(n: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if n >= least)


def ratios(data: bytes, compress) -> tuple[float | None, float | None]:
    """The whole document's ratio, and the share of its chunks outside the chunk band (null below one chunk)."""
    if not data:
        return None, None
    whole = len(compress(data)) / len(data)
    if len(data) < CHUNK:
        return whole, None
    starts = list(range(0, len(data), CHUNK))
    if len(data) - starts[-1] < CHUNK // 2:
        starts.pop()
    ends = [*starts[1:], len(data)]
    off = sum(not CHUNK_BAND[0] <= len(compress(data[a:b])) / (b - a) <= CHUNK_BAND[1] for a, b in zip(starts, ends, strict=True))
    return whole, off / len(starts)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the statistics, base_failed, kept, and the ratios behind the verdict."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out: dict[str, list] = {k: [] for k in (*names, "base_failed", "kept", "zstd_ratio", "chunks_off")}
        for text in map(lambda t: t or "", batch.column(1).to_pylist()):
            stats = statistics(text)
            data = text.encode("utf-8", "surrogatepass")
            whole, off = ratios(data, compress)
            failed = stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]
            low, high = band(len(data))
            fine = whole is None or (low <= whole <= high and (off is None or off <= CHUNK_SHARE))
            for name, value in zip(out, (*stats, failed, fine and not failed, whole, off), strict=True):
                out[name].append(value)
        return {id_col: batch.column(0)} | out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunks_off double"
    return by_batch(docs.select(F.col(id_col), F.col(text_col).cast("string")), schema, run)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, every column as it was."""
    from collections.abc import Iterator

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keep = []
            for text in map(lambda t: t or "", batch.column(at).to_pylist()):
                stats, data = statistics(text), text.encode("utf-8", "surrogatepass")
                whole, off = ratios(data, compress)
                low, high = band(len(data))
                failed = stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]
                keep.append(not failed and (whole is None or (low <= whole <= high and (off is None or off <= CHUNK_SHARE))))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
