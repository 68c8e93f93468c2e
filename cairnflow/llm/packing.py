"""Best-fit packing by patterns: non-negative least squares over the histogram of lengths.

Only the histogram (one count per length up to the sequence length) reaches the driver. There,
patterns of up to three lengths that fill a sequence are fitted to it by non-negative least
squares, the repeat counts are rounded down to what the histogram holds, and what is left
over is packed longest first into the fullest sequence that has room, many equal lengths at
a time. The rows never meet: each piece gets its rank among the pieces of its length (counts
per bucket, then a running sum), and ranks map to places by a search in the plan, whose size
depends on the sequence length alone.

Defined cases: a null text is an empty one, which is one piece holding the closing id;
equal rows are packed each; rows without an id are left out; a longer document is cut into full pieces from its end, so its
first piece may be shorter; an empty table gives an empty result; columns other than the
named ones are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.llm.arrow import split
from cairnflow.llm.bpe import Memo, emptied

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rounds of the least-squares fit, and what leftovers shorter than SHORT weigh in it: they
#: fill gaps easily, so the fit may leave more of them.
ROUNDS, SHORT, SHORT_WEIGHT = 400, 8, 0.3
#: Rows are ranked within this many buckets, whatever the lengths are.
BUCKETS = 512


class ByteCodec:
    """Ids of a byte-level vocabulary, with a bounded table of what stands between single spaces."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from cairnflow.llm.bpe import byte_chars

        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a vocabulary of this kind")
        back = {c: b for b, c in enumerate(byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        # Fixed pattern of the byte-level pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # ids rise with the rank of the merge, so they serve as ranks
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.of_part = Memo(self._part, 300_000)

    def _part(self, part: str) -> bytes:
        return array("I", self.core.encode_ordinary(part)).tobytes()

    def encode(self, text: str) -> bytes:
        if "<" in text and self.marks.search(text):
            out = []
            for k, part in enumerate(self.marks.split(text)):
                out.append(array("I", [self.special[part]]).tobytes() if k % 2 else self._plain(part))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        out, at = [], 0
        while at < len(text):
            end = cut(text, at)
            out.append(self._step(text[at:end] if at or end < len(text) else text))
            at = end
        return b"".join(out)

    def _step(self, text: str) -> bytes:
        # A space before a visible character opens a word, so single spaces part the text into
        # stretches that are encoded alike wherever they stand; other runs are left whole.
        if _RUN.search(text) or text[-1] == " ":
            return array("I", self.core.encode_ordinary(text)).tobytes()
        parts = text.split(" ")
        first = parts[0]
        of = self.of_part
        out = [of[first]] if first else []
        out += [of[" " + p] for p in parts[1:]]
        return b"".join(out)


_RUN = re.compile(r" [\s\x1c-\x1f]")
_STEP = 1 << 20


def cut(text: str, at: int) -> int:
    """Where a stretch of about _STEP code points ends: before a single space between visible characters."""
    if len(text) - at <= _STEP:
        return len(text)
    m = _SEAM.search(text, at + _STEP)
    return m.start() + 1 if m else len(text)


_SEAM = re.compile(r"\S \S")


@cache
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def pieces(docs: DataFrame, key: str, text: str, path: str, size: int, close: int) -> DataFrame:
    """PIECE rows of every document: ids and the closing id, cut into pieces of at most size."""

    def run(batches):
        c, end = codec(path), array("I", [close]).tobytes()
        for batch in emptied(split(batches), c.of_part):
            out = [array("q") for _ in range(5)]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = c.encode(body) + end
                n = len(ids) // 4
                start, length, k = 0, n - (n - 1) // size * size, 0
                while start < n:
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for a, x in zip(out, (doc, k, start, length, crc), strict=True):
                        a.append(x)
                    start, length, k = start + length, size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64), pa.int32() if i == 1 else pa.int64()) for i, a in enumerate(out)] if out[0] else [pa.array([], pa.int32() if i == 1 else pa.int64()) for i in range(5)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, PIECE)


def patterns(size: int) -> np.ndarray:
    """All multisets of one to three lengths that fill a sequence, as rows padded with 0."""
    a = np.arange(1, size + 1)
    two = np.array([(x, size - x) for x in range(1, size // 2 + 1)], np.int64).reshape(-1, 2)
    three = [np.stack([np.full(len(y), x), y, size - x - y], 1) for x in a[: size // 3] if len(y := np.arange(x, (size - x) // 2 + 1))]
    rows = [np.array([[size, 0, 0]], np.int64), np.pad(two, ((0, 0), (0, 1)))] + three
    return np.concatenate(rows)


def fit(counts: np.ndarray, pats: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with small weighted ||A x - counts||, by accelerated projected gradient steps."""
    size = len(counts) - 1
    weight = np.ones(size + 1)
    weight[: SHORT + 1] = SHORT_WEIGHT
    weight[0] = 0
    scale = max(1.0, counts.sum())
    target = counts / scale
    flat = pats.ravel()
    forth = lambda x: np.bincount(flat, np.repeat(x, 3), size + 1)
    back = lambda r: r[pats].sum(1)
    v = np.ones(len(pats))
    for _ in range(20):  # the largest curvature, by power iteration
        v = back(weight * forth(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - back(weight * (forth(y) - target)) / (1.05 * top))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x * scale


#: From which fraction on a repeat count is rounded up, tried in turn; the plan with fewest sequences is taken.
ROUND_UP = (1.0, 0.5, 0.0)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) that hold every piece once. counts[n]: pieces of length n."""
    size = len(counts) - 1
    open_ = counts.astype(np.int64).copy()
    full = [((size,), int(open_[size]))] if open_[size] else []
    open_[size] = 0
    if not open_.sum():
        return full
    pats = patterns(size)
    pats = pats[((open_[pats] > 0) | (pats == 0)).all(1)]
    x = fit(open_.astype(float), pats) if len(pats) else np.zeros(0)
    tried = [rounded(open_, pats, x, up) for up in ROUND_UP]
    return full + min(tried, key=lambda p: sum(times for _, times in p))


def rounded(counts: np.ndarray, pats: np.ndarray, x: np.ndarray, up: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that the histogram can serve, and the rest packed by best fit."""
    left, out, order = counts.copy(), [], np.argsort(-x, kind="stable")

    def take(i: int, times: int) -> None:
        lengths = tuple(int(n) for n in pats[i] if n)
        times = min(times, *(int(left[n]) // lengths.count(n) for n in lengths))
        if times > 0:
            out.append((lengths, times))
            for n in lengths:
                left[n] -= times

    for i in order[: np.count_nonzero(x >= 1)]:
        take(i, int(x[i]))
    for i in order[: np.count_nonzero(x > 0)]:
        if x[i] % 1 > up:
            take(i, 1)
    take_rest(left, len(counts) - 1, out)
    return out


def take_rest(left: np.ndarray, size: int, out: list) -> None:
    """Longest first into the fullest open sequence with room; equal lengths go in together."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            r = min((r for r in room if r >= n), default=None)
            if r is None:
                lengths, times = (n,) * min(size // n, todo), todo // min(size // n, todo)
                times_n = times * len(lengths)
                rest = size - n * len(lengths)
            else:
                lengths, have = next(iter(room[r].items()))
                times = times_n = min(have, todo)
                room[r][lengths] -= times
                if not room[r][lengths]:
                    del room[r][lengths]
                    if not room[r]:
                        del room[r]
                lengths, rest = (*lengths, n), r - n
            todo -= times_n
            if rest:
                to = room.setdefault(rest, {})
                to[lengths] = to.get(lengths, 0) + times
            else:
                out.append((lengths, times))
        left[n] = 0
    out += [(lengths, times) for held in room.values() for lengths, times in held.items()]


def places(packed: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """Runs of ranks per length: from which rank, in which sequences and where there."""
    rows, first = [], 0
    for lengths, times in packed:
        at, seen = 0, {}
        for n in lengths:
            seen.setdefault(n, []).append(at)
            at += n
        rows += [(n, times * len(ats), first, len(ats), a, k) for n, ats in seen.items() for k, a in enumerate(ats)]
        first += times
    rows.sort(key=lambda r: r[0])
    arr = np.array(rows, np.int64).reshape(-1, 6)
    return {"length": arr[:, 0], "times": arr[:, 1] // np.maximum(arr[:, 3], 1), "first": arr[:, 2], "at": arr[:, 4]}


def pack(rows: DataFrame, size: int) -> DataFrame:
    """PIECE rows with sequence_id and offset. rows is read three times: hand over stored ones."""
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    counted = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most size * BUCKETS rows
    total = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most size rows
    counts = np.zeros(size + 1, np.int64)
    for r in total:
        counts[r["length"]] = r["n"]
    runs = places(plan(counts), size)
    # start rank of each run among the pieces of its length
    cum = np.cumsum(runs["times"]) - runs["times"]
    lead = np.concatenate([[0], np.flatnonzero(np.diff(runs["length"])) + 1]) if len(cum) else np.zeros(0, np.int64)
    base = np.repeat(cum[lead], np.diff([*lead, len(cum)])) if len(cum) else cum
    span = int(counts.max()) + 1
    keys = runs["length"] * span + (cum - base)

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = (
        spread.withColumn("nth", F.row_number().over(within) - 1)
        .join(ahead, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ahead")).alias("rank"))
    )

    def run(batches):
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(keys, n * span + rank, "right") - 1
            seq = runs["first"][i] + rank - (keys[i] - runs["length"][i] * span)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(runs["at"][i])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECE + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, size: int = 1024, close: int = 2) -> DataFrame:
    """All documents, in as few sequences of size tokens as the pattern plan needs."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, size, close)


def packed_documents(docs: DataFrame, vocabulary: str, size: int, close: int) -> DataFrame:
    from cairnflow.llm.store import stored

    return pack(stored(pieces(docs, "doc_id", "text", vocabulary, size, close)), size)
