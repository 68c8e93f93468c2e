"""Removing repeated byte strings: every byte covered by a LENGTH-byte string that starts earlier too.

Sorting all suffixes needs several bytes of disk per byte of text, so only sampled suffixes are
carried between machines, and the verdict on the others is induced from them. Every
string of LENGTH bytes selects one of its SEED-byte substrings by content alone (the least in a
fixed random order), so equal strings select equal seeds at equal distance. Neighbouring strings
mostly select the same seed; such a run of strings is a block, and a shard of documents is some
thirty times fewer blocks than bytes.

1. Blocks meet by seed. Blocks that are equal as a whole are settled: all but the first
   are repeats from end to end. Where one seed has unequal blocks (the rims of repeated passages),
   the first of each kind is open.
2. The strings of open blocks meet one by one; all but the first of each are repeats.
3. Each shard marks what is covered.

Shards, packed and compressed, are written once in buckets by their id; verdicts go to them, so
texts are shuffled once. Before every shuffle a shard sends only its first of equal blocks or
strings, so a passage in a third of all documents costs one entry per shard. Inside tasks all is
done on arrays. Between shards, blocks are equal if 64 bits of the block's hash and 32 of its seed's are, strings if 96 bits of
two hashes are: of 10**13 open strings, one pair in a thousand such runs would be taken for equal that isn't.

Defined cases: null and empty texts have no bytes and nothing to remove; equal rows are repeats
of the first; documents of equal id go by shard; rows without an id are left out; an empty table gives an empty result; columns other
than the named ones are ignored. A document must fit in a task's memory once.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.shingles import mixed
from cairnflow.llm.store import Scratch, stored

LENGTH, SEED = 100, 32
#: Bytes of text of a shard, and string starts that are looked at at once.
SHARD, STEP = 1_000_000, 1 << 19

SHARDS = "shard long, ids binary, sizes binary, body binary"
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 2**64)
_INDEX_BITS = 24


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _UNBASE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Text:
    """Hashes of any stretch of some bytes."""

    def __init__(self, body: np.ndarray):
        self.size, self.body, self._more = len(body), body, None
        up, self.down = _powers(1 << max(20, len(body).bit_length()))
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTE[body] * up[: len(body)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def marks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """32 more bits of the hash, from sums with other numbers for the bytes."""
        if self._more is None:
            up = _powers(1 << max(20, self.size.bit_length()))[0]
            self._more = np.zeros(self.size + 1, np.uint64)
            np.cumsum(_BYTE2[self.body] * up[: self.size], out=self._more[1:])
        return (mixed((self._more[ends] - self._more[starts]) * self.down[starts]) >> np.uint64(32)).astype(np.uint32)

    def all(self, length: int) -> np.ndarray:
        n = self.size - length + 1
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def blocks(body: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, seed hash, block hash) of every block, in order; bounds: where documents begin and end."""
    out = []
    window = length - seed + 1
    for a in range(0, max(0, len(body) - length + 1), STEP):
        part = body[a : a + STEP + length - 1]
        t = Text(part)
        n = len(part) - length + 1
        own = t.all(seed)
        key = own >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS) | np.arange(len(own), dtype=np.uint64)
        span = 1
        while 2 * span <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < window:
            key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
        at = (key & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        first, last = np.clip(bounds[:-1] - a, 0, n), np.clip(bounds[1:] - length + 1 - a, 0, n)
        some = last > first
        np.add.at(inside, first[some], 1)
        np.add.at(inside, last[some], -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(starts):
            continue
        p = at[starts]
        new = np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]
        begins = np.flatnonzero(new)
        ends = np.r_[begins[1:], len(starts)] - 1
        s, e, p = starts[begins], starts[ends], p[begins]
        shape = ((e - s) * length + (p - s)).astype(np.uint64)
        out.append((s + a, e + a, own[p], mixed(t.hashes(s, e + length) ^ mixed(shape))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Shard:
    """Documents of a shard, in order of their ids, and their blocks."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes, length: int, seed: int):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(body) if len(body) else b""
        self.body = np.frombuffer(self.raw, np.uint8)
        self.bounds = np.r_[0, np.cumsum(self.sizes)]
        self.length = length
        self.first, self.last, self.seed, self.block = blocks(self.body, self.bounds, length, seed)

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The id of the document at a place."""
        return self.ids[np.searchsorted(self.bounds, at, "right") - 1]

    def own_first(self) -> np.ndarray:
        """Blocks with no equal one before them in this shard."""
        return first_of(self.block ^ mixed(self.seed))

    def strings(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and marks of all strings of the given blocks, in order."""
        n = self.last[open_] - self.first[open_] + 1
        starts = np.repeat(self.first[open_] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out, marks = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint32)
        for a in range(0, len(self.body), STEP):
            i, j = np.searchsorted(starts, [a, a + STEP])
            if j > i:
                t = Text(self.body[a : a + STEP + self.length - 1])
                own = starts[i:j] - a
                out[i:j] = t.hashes(own, own + self.length)
                marks[i:j] = t.marks(own, own + self.length)
        return starts, out, marks


def first_of(x: np.ndarray) -> np.ndarray:
    """Whether no equal value stands before this one."""
    out = np.zeros(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = True
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one compressed blob; ascending ones as differences."""
    out = []
    for c in columns:
        out.append(np.diff(c, prepend=c.dtype.type(0)).tobytes() if c.dtype == np.int64 else c.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _read(blob: bytes, wide: int, narrow: int) -> list[np.ndarray]:
    """`narrow` columns of uint32, `wide` ones of uint64, then the differences of one of int64 documents and one of int64 places."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // (4 * narrow + 8 * wide + 16)
    out, at = [], 0
    for kind, how_many in ((np.uint32, narrow), (np.uint64, wide), (np.int64, 2)):
        for _ in range(how_many):
            c = np.frombuffer(raw, kind, n, at)
            at += c.nbytes
            out.append(np.cumsum(c) if kind is np.int64 else c)
    return out


def packed_shards(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """SHARDS rows; with carry also `extra`, these columns of the documents as an Arrow stream."""
    names = ["shard", "ids", "sizes", "body", *["extra"] * bool(carry)]

    def run(batches):
        pack, n = zstandard.ZstdCompressor(level=3), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            held, size = [], 0
            for i, row in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                body = row[1].encode()
                if held and size + len(body) > SHARD:
                    yield one(held, part << 32 | n, pack, b)
                    held, size, n = [], 0, n + 1
                held.append((row[0], body, i))
                size += len(body)
            if held:
                yield one(held, part << 32 | n, pack, b)
                n += 1

    def one(held, shard, pack, b):
        held.sort(key=lambda r: r[0])
        ids, sizes = np.array([r[0] for r in held], np.int64), np.array([len(r[1]) for r in held], np.int64)
        blobs = [ids.tobytes(), sizes.tobytes(), pack.compress(b"".join(r[1] for r in held))]
        if carry:
            sink, extra = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(b.columns[2:], list(carry)).take(pa.array([r[2] for r in held]))
            with pa.ipc.new_stream(sink, extra.schema) as stream:
                stream.write_batch(extra)
            blobs.append(pack.compress(sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([x], pa.binary()) for x in blobs)], names)

    kept = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)
    return kept.mapInArrow(run, SHARDS + ", extra binary" * bool(carry))


def _extra(blob: bytes) -> list[pa.Array]:
    """The columns of a shard's `extra`, in the order of its documents."""
    return [c.combine_chunks() for c in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().columns]


SENT = "bucket int, shard long, entries binary"
_SENT = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("entries", pa.binary())])


def _deal(shard: int, buckets: int, by: np.ndarray, columns: list[np.ndarray]):
    """Entries packed for each bucket, in their order; buckets go by the high half of `by`."""
    to = ((by >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[k] : cuts[k + 1]]
        rows.append((int(k), shard, _pack(*(c[at] for c in columns))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _per_bucket(batches):
    """(bucket, its rows) of rows sorted by bucket."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != now and held:
                yield held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield held


TOLD = "shard long, kind int, places binary"
_TOLD = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("places", pa.binary())])
EQUAL, OPEN, STRING = 1, 2, 3


def _tell(names: np.ndarray, shard: np.ndarray, place: np.ndarray, kind: int):
    """TOLD rows, one per shard; names: ids by number."""
    order = np.lexsort((place, shard))
    cuts = np.searchsorted(shard[order], np.arange(len(names) + 1))
    rows = [(int(names[k]), kind, _pack(place[order[cuts[k] : cuts[k + 1]]])) for k in np.flatnonzero(np.diff(cuts))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOLD, strict=True)], schema=_TOLD)


def _places(blobs: list[bytes]) -> np.ndarray:
    raw = [np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)) for x in blobs]
    return np.sort(np.concatenate(raw)) if raw else np.zeros(0, np.int64)


def _gathered(rows: list[tuple], wide: int, narrow: int) -> tuple:
    names, number = np.unique([r[1] for r in rows], return_inverse=True)
    parts = [_read(r[2], wide, narrow) for r in rows]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return names, np.repeat(number, [len(p[0]) for p in parts]), columns


def settle_blocks(shards: DataFrame, buckets: int, length: int, seed: int) -> DataFrame:
    """TOLD: blocks (by number in their shard) that have an equal one before them, and open ones."""

    def send(batches):
        for b in batches:
            for name, *cols in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shard(*cols, length, seed)
                at = np.flatnonzero(s.own_first())
                yield from _deal(name, buckets, s.seed[at], [s.seed[at].astype(np.uint32), s.block[at], s.doc(s.first[at]), at])

    def judge(batches):
        for rows in _per_bucket(batches):
            names, shard, (seeds, block, doc, at) = _gathered(rows, 1, 1)
            order = np.lexsort((at, shard, doc, block, seeds))
            seeds, block, shard, at = seeds[order], block[order], shard[order], at[order]
            head = np.r_[True, seeds[1:] != seeds[:-1]]
            kind = head | np.r_[True, block[1:] != block[:-1]]
            group = np.cumsum(head) - 1
            several = np.bincount(group, kind)[group] > 1
            yield from _tell(names, shard[~kind], at[~kind], EQUAL)
            yield from _tell(names, shard[kind & several], at[kind & several], OPEN)

    sent = shards.select("shard", "ids", "sizes", "body").mapInArrow(send, SENT)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(judge, TOLD)


def settle_strings(shards: DataFrame, told: DataFrame, buckets: int, length: int, seed: int) -> DataFrame:
    """TOLD: starts in their shard of strings of open blocks that have an equal one before them."""
    opened = told.where(F.col("kind") == OPEN).groupBy("shard").agg(F.collect_list("places").alias("places"))

    def send(batches):
        for b in batches:
            for name, *cols, open_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shard(*cols, length, seed)
                starts, h, marks = s.strings(_places(open_))
                at = np.flatnonzero(first_of(h ^ mixed(marks.astype(np.uint64))))
                yield from _deal(name, buckets, h[at], [marks[at], h[at], s.doc(starts[at]), starts[at]])

    def judge(batches):
        for rows in _per_bucket(batches):
            names, shard, (marks, h, doc, at) = _gathered(rows, 1, 1)
            order = np.lexsort((at, shard, doc, marks, h))
            h, marks, shard, at = h[order], marks[order], shard[order], at[order]
            again = np.r_[False, (h[1:] == h[:-1]) & (marks[1:] == marks[:-1])]
            yield from _tell(names, shard[again], at[again], STRING)

    sent = shards.join(opened, "shard").select("shard", "ids", "sizes", "body", "places").mapInArrow(send, SENT)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(judge, TOLD)


def covered(s: Shard, equal: np.ndarray, open_: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Mask of the bytes to remove."""
    dup = ~s.own_first()
    dup[equal] = True
    delta = np.zeros(len(s.body) + 1, np.int32)
    np.add.at(delta, s.first[dup], 1)
    np.add.at(delta, s.last[dup] + s.length, -1)
    starts, h, marks = s.strings(open_)
    again = np.concatenate([starts[~first_of(h ^ mixed(marks.astype(np.uint64)))], strings])
    np.add.at(delta, again, 1)
    np.add.at(delta, again + s.length, -1)
    return np.cumsum(delta[:-1]) > 0


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept "
#: What kept holds: the remaining bytes, their hexadecimal SHA-256, or what is left of the text without characters that lost a byte.
FORMS = {
    "bytes": ("binary", lambda rest: rest),
    "sha256": ("string", lambda rest: hashlib.sha256(rest).hexdigest()),
    "text": ("string", lambda rest: rest.decode("utf-8", "ignore")),
}


def removed(docs: DataFrame, key: str, text: str, length: int = LENGTH, seed: int = SEED, kept: str = "bytes", carry: tuple[str, ...] = ()) -> DataFrame:
    """KEPT rows, one per row of docs, and these rows' columns named in carry; kept names one of FORMS."""
    form_type, form = FORMS[kept]
    spark = docs.sparkSession
    scratch = Scratch(spark)
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"shards_{uuid.uuid4().hex}"
    path = scratch.new_path(name)
    scratch.tables.append(name)
    packed_shards(docs, key, text, carry).repartition(p, "shard").write.bucketBy(p, "shard").option("path", path).saveAsTable(name)
    shards, buckets = spark.table(name), 4 * p
    blocks_told = scratch.stored(settle_blocks(shards, buckets, length, seed))
    strings_told = scratch.stored(settle_strings(shards, blocks_told, buckets, length, seed))
    told = blocks_told.union(strings_told).groupBy("shard").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("places"))).alias(f"k{k}") for k in (EQUAL, OPEN, STRING)])

    def run(batches):
        for b in batches:
            for _, ids, sizes, body, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shard(ids, sizes, body, length, seed)
                mask = covered(s, *(_places(k or []) for k in more[:3]))
                out = []
                for i, (a, z) in enumerate(zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)):
                    m = mask[a:z]
                    n = int(m.sum())
                    spans = int((m[1:] & ~m[:-1]).sum() + m[:1].sum()) if n else 0
                    rest = s.body[a:z][~m].tobytes() if n else s.raw[a:z]
                    out.append((int(s.ids[i]), z - a, n, spans, form(rest)))
                own = [pa.array(c, (pa.binary() if form_type == "binary" else pa.string()) if k == 4 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*own, *(_extra(more[3]) if carry else ())], [*(x.split()[0] for x in KEPT.split(", ")), *carry])

    schema = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    rest = shards.join(told, "shard", "left").select("shard", "ids", "sizes", "body", "k1", "k2", "k3", *["extra"] * bool(carry))
    out = stored(rest.mapInArrow(run, KEPT + form_type + schema))
    scratch.drop()
    return out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text of documents that repeat 100 earlier ones, removed."""
    rows = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", kept="sha256")
    return rows.withColumnRenamed("kept", "kept_sha256")
