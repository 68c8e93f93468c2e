"""Quality rules: word statistics and compression bands.

A text compresses far better than prose if it repeats itself or its marks, and far worse if it is no prose
(keys, encoded data). What prose reaches depends on the length, so the limits do too: LIMITS
holds the least and largest ratio of compressed to plain bytes by length, between which they follow the
logarithm of the length. They lie just outside of what labelled good texts reach. Bad stretches in long documents show in their chunks of CHUNK
bytes; the rest of a document is a chunk of its own length, or the document's last CHUNK bytes if it is below the first length of LIMITS. A
document fails if its whole ratio leaves its limits, or more than CHUNK_SHARE of its chunks leave theirs, which are wider by SLACK.

Defined cases: a null or empty text has no words and fails the base rules; texts below the
first length of LIMITS have no ratio limits (compressed headers rule there; the base rules want 50 words); repeated rows give repeated results; an empty table
gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.arrow import split

#: (bytes, least ratio, largest ratio)
LIMITS = (
    (256, 0.520, 0.80), (512, 0.495, 0.76), (724, 0.480, 0.69), (1024, 0.475, 0.65), (1448, 0.465, 0.61), (2048, 0.450, 0.58), (2896, 0.440, 0.55),
    (4096, 0.430, 0.53), (5793, 0.418, 0.51), (8192, 0.408, 0.49), (16384, 0.395, 0.47), (32768, 0.385, 0.46), (131072, 0.375, 0.45),
)
CHUNK, SLACK, CHUNK_SHARE, LEVEL = 1024, 0.02, 0.25, 3
#: Fixed symbols of the contract.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

COLUMNS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("n_chunks", "long"), ("n_chunks_out", "long"),
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window whose words stand in the text twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pair = a[:-1] * len(number) + a[1:]
    if len(number) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + a[2:]
    order = np.argsort(window, kind="stable")
    s = window[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    mask = np.zeros(n, bool)
    for k in range(3):
        mask[at + k] = True
    return int(mask.sum())


def dup_lines(body: bytes) -> int:
    seen, n = set(), 0
    for line in body.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


_AT, _LOW, _HIGH = (np.array(c, float) for c in zip(*LIMITS, strict=True))
_AT = np.log2(_AT)


def in_band(size: int, ratio: float, slack: float = 0.0) -> bool:
    """Whether prose of so many bytes may have this ratio."""
    if size < LIMITS[0][0]:
        return True
    at = np.log2(size)
    return bool(np.interp(at, _AT, _LOW) - slack <= ratio <= np.interp(at, _AT, _HIGH) + slack)


_CHUNK_BAND = float(np.interp(np.log2(CHUNK), _AT, _LOW)) - SLACK, float(np.interp(np.log2(CHUNK), _AT, _HIGH)) + SLACK


def chunks_out(body: bytes, pack: zstandard.ZstdCompressor) -> tuple[int, int]:
    """(chunks, chunks out of their limits) of a text of more than one chunk."""
    if len(body) <= CHUNK:
        return 0, 0
    low, high = _CHUNK_BAND
    n = len(body) // CHUNK
    out = sum(not low <= len(pack.compress(body[i : i + CHUNK])) / CHUNK <= high for i in range(0, n * CHUNK, CHUNK))
    if left := len(body) - n * CHUNK:
        tail = body[-left:] if left >= LIMITS[0][0] else body[-CHUNK:]
        n, out = n + 1, out + (not in_band(len(tail), len(pack.compress(tail)) / len(tail), SLACK))
    return n, out


def measure(text: str, pack: zstandard.ZstdCompressor) -> tuple:
    """One row of COLUMNS."""
    body = text.encode()
    words = body.split()  # bytes split at the six ASCII white-space characters
    n, repeated = len(words), repeat_words(words)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    failed = n < 50 or 100 * repeated > 50 * n
    ratio = len(pack.compress(body)) / len(body) if body else 0.0
    n_chunks, out = chunks_out(body, pack)
    kept = not failed and in_band(len(body), ratio) and out <= CHUNK_SHARE * n_chunks
    return n, chars, sum(map(text.count, SYMBOLS)), dup_lines(body), repeated, failed, kept, ratio, n_chunks, out


def judge(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key and COLUMNS."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k] for _, k in COLUMNS]
        for batch in split(batches):
            rows = [measure(t, pack) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", *(n for n, _ in COLUMNS)])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {k}" for n, k in COLUMNS)).withColumnRenamed("key", key)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every whole text of documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
