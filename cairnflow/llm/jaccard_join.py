"""N-gram Jaccard self-join by PartEnum signatures, and the classes its links form.

A pair with Jaccard similarity of at least SHARE percent differs in a bounded number of elements, k: at most a
ninth of its two sizes together at 80. Two levels of partitions of the domain of shingles, by their hashes, turn that into
signatures. For all sets of a band of sizes alike, the domain is cut into groups and each group into
PARTS parts. As each group but k/2 of them holds at most one differing element, and this lies in one part, the other parts
of such a group are the same in both sets: so a set's signatures are, per group, its elements in each
subset of all parts but one. A set needs no more than the first k/2 + 1 groups of which no subset is
empty, and similar sets then share a signature, whichever of them has its first groups closer together. Sets just
below a band's sizes are cut for that band as well. Sets of fewer than SMALL elements have as signatures the subsets of TOGETHER of their
first elements in hash order, of which similar sets share that many.

Sets that share a signature form a bucket. Its first member is compared with all others: pairs whose
sizes and sketches (the parities of the counts of elements in two to four times as many parts as there are
elements) leave a link possible are verified on the hashes of all shingles, and links are joined to classes. Buckets whose
members are still in different classes are looked at again: the nearest pairs that would connect these are verified, and at
last all pairs of different classes that may link. A large set of members is cut into blocks for that, which meet in rows
of their own, and members of its largest class meet only the others. So a group of n copies costs about
n comparisons, and no link is lost. Texts of sets in buckets are fetched once and kept compressed between these steps.

Defined cases: null and empty texts have no set and link with nothing; equal sets are one
member; a document with fewer words than a shingle has one shingle; rows that share an id are each a document, and
their classes take the smallest id of any of them; an empty table gives an
empty result; columns other than the named ones are ignored; rows without
an integer id are left out.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.arrow import parts
from cairnflow.llm.components import components
from cairnflow.llm.shingles import many_shingles, mixed
from cairnflow.llm.store import Scratch

WIDTH, SHARE = 5, 80
#: Bands of sizes: SMALL * GROWTH**i on. Parts of a group, and groups per group that is needed, which makes up for empty ones.
SMALL, GROWTH, PARTS, SLACK = 64, 1.4, 3, 1.25
#: Elements that a signature of a small set holds.
TOGETHER = 3
#: Members of a class that are verified against one first member in one task.
GROUP = 256
#: Nearest classes to which a member offers a connecting pair; the last round offers all.
NEAREST = 8
#: Members of a set that are compared with as many others in one task, and members in one row of FOUND.
BLOCK, CHUNK = 2048, 4096
#: Bits of an address: rows of a batch, and batches of a partition.
SLOT_BITS, BATCH_BITS = 13, 24
#: Bits of the sketches of sets beyond 100,000 elements, so that a block of them fits in memory.
MOST_BITS = 1 << 18
#: Bytes of sketches that are compared with one at a time.
COMPARED = 1 << 22

ROWS = "address long, doc_id long, n long, d1 long, d2 long, sketch binary, rest boolean, mark long, bucket int, signatures binary"
_ROWS = pa.schema([("address", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary()), ("rest", pa.bool_()), ("mark", pa.int64()), ("bucket", pa.int32()), ("signatures", pa.binary())])
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Tells the parts of a group apart, and its subsets.
_ODD = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7], np.uint64)
_TAG = np.array([0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


@cache
def edge_of(band: int) -> int:
    """The smallest size of a band."""
    return 1 if band == 0 else int(np.ceil(SMALL * GROWTH ** (band - 1)))


_STARTS = np.array([edge_of(b) for b in range(100)])


def differ(a: int, b: int, share: int = SHARE) -> int:
    """Most elements in which linked sets of these sizes differ."""
    return (100 - share) * (a + b) // (100 + share)


def _needed(n: int, share: int) -> int:
    """Groups of which one holds at most one element that a set of n and one linked with it don't share."""
    return differ(n, n * 100 // share, share) // 2 + 1


@cache
def _groups(band: int, share: int) -> int:
    return int(np.ceil(SLACK * _needed(edge_of(band + 1) - 1, share))) + 2


@cache
def _subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k).T


def _least(n: int, share: int) -> int:
    """The smallest size of what links with a set of n, and the least they have in common."""
    return -(-share * n // 100)


def signatures(h: np.ndarray, share: int = SHARE) -> np.ndarray | None:
    """Signatures of a set of sorted hashes, or None if some cut of it has too many empty parts."""
    n = len(h)
    out = []
    band = int(np.searchsorted(_STARTS, n, "right")) - 1
    if band == 0:
        both = _least(n, share)  # elements in common with any linked set, and the smallest size of one
        if both >= TOGETHER:
            first = mixed(h[: n - both + TOGETHER])
            s = _subsets(len(first), TOGETHER)
            out.append(mixed((first[s] * _ODD[:, None]).sum(0, dtype=np.uint64)))
        if _least(both, share) < TOGETHER:  # such a set, or one that links with it, hasn't as many
            out.append(mixed(h[: n - both + 1] + _GOLDEN))
        band = 1
    while 100 * n >= share * int(_STARTS[band]):
        if (found := _cut(h, band, share)) is None:
            return None
        out.append(found)
        band += 1
    return np.concatenate(out)


def _cut(h: np.ndarray, band: int, share: int) -> np.ndarray | None:
    groups, needed = _groups(band, share), _needed(len(h), share)
    cell = ((h >> np.uint64(32)) * np.uint64(groups * PARTS) >> np.uint64(32)).astype(np.int64)  # ascends, as h does
    count = np.bincount(cell, minlength=groups * PARTS)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(band)), dtype=np.uint64)])
    ends = np.cumsum(count)
    sums = (sums[ends] - sums[ends - count]).reshape(groups, PARTS)
    held = count.reshape(groups, PARTS) > 0
    good = np.cumsum(held.sum(1) > 1)
    if good[-1] < needed:
        return None
    end = int(np.searchsorted(good, needed)) + 1
    sums, held = sums[:end], held[:end]
    place = np.arange(end, dtype=np.uint64) * _GOLDEN + np.uint64(band)
    out = []
    for left_out in range(PARTS):
        own = [k for k in range(PARTS) if k != left_out]
        some = held[:, own].any(1)
        out.append(mixed((sums[:, own] * _ODD[own]).sum(1, dtype=np.uint64) + place + _TAG[left_out])[some])
    return np.concatenate(out)


def _digest(h: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def parities(n: int) -> int:
    """Bits of the sketch of a set of n elements: a power of two, from two to four times n up to MOST_BITS."""
    return min(MOST_BITS, max(64, 1 << (2 * n - 1).bit_length()))


def _sketch(h: np.ndarray) -> bytes:
    """Parities of the counts of elements by the low bits of their hashes."""
    m = parities(len(h))
    odd = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of as many bits or more, as rows of `bits`: the parities of parts that are joined are added."""
    out = np.empty((len(sketches), bits // 64), np.uint64)
    sizes = np.array([8 * len(s) for s in sketches])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), -1)
        while rows.shape[1] > bits // 64:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least numbers of elements in which sets of these sketches differ: each changes one parity."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def described(docs: DataFrame, key: str, text: str, buckets: int, width: int, share: int, mark: Column) -> DataFrame:
    """ROWS: one row per document, and rows of signatures dealt to buckets. Equal sets of a batch
    give their signatures once."""

    def run(batches):
        batch = TaskContext.get().partitionId() << BATCH_BITS
        for b in batches:
            for some in parts(b, rows=1 << SLOT_BITS):
                yield one(some, batch << SLOT_BITS)
                batch += 1

    def one(b, base):
        ids, marks = b.column(0).to_pylist(), b.column(2).to_pylist()
        rows, seen, found, owners = [], set(), [], []
        for slot, h in enumerate(many_shingles(b.column(1).to_pylist(), width)):
            if not len(h):
                rows.append((base + slot, ids[slot], 0, None, None, None, False, marks[slot], None, None))
                continue
            digest = _digest(h)
            s = None if digest in seen else signatures(h, share)
            rows.append((base + slot, ids[slot], len(h), *digest, _sketch(h), s is None and digest not in seen, marks[slot], None, None))
            seen.add(digest)
            if s is not None:
                found.append(s)
                owners.append(np.full(len(s), slot, np.uint16))
        if found:
            s, owner = np.concatenate(found), np.concatenate(owners)
            order = np.argsort(s)
            s, owner = s[order], owner[order]
            # the bucket and 32 more bits of s, as a fraction of all buckets
            at = (s >> np.uint64(32)) * np.uint64(buckets) + ((s & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32))
            cuts = np.searchsorted(at >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            short, pack = at.astype(np.uint32), zstandard.ZstdCompressor(level=1)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[k], cuts[k + 1]
                rows.append((base, None, None, None, None, None, None, None, k, pack.compress(_packed(short[i:j], owner[i:j]))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

    kept = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), mark.cast("long").alias("mark"))
    return kept.mapInArrow(run, ROWS)


def _packed(ascending: np.ndarray, owner: np.ndarray) -> bytes:
    """Numbers as differences, and their owners, byte by byte, which compresses well."""
    planes = np.diff(ascending, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
    return planes + owner.view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    return np.cumsum(raw[:4].T.copy().view(np.uint32).ravel(), dtype=np.uint32), raw[4:].T.copy().view(np.uint16).ravel()


def first_elements(docs: DataFrame, key: str, text: str, low: int, high: int, width: int, share: int) -> DataFrame:
    """(h, d1, d2): the first elements of sets of low to high elements, of which linked sets have one in common."""
    schema = pa.schema([(c, pa.int64()) for c in ("h", "d1", "d2")])

    def run(batches):
        for batch in batches:
            for b in parts(batch, 0):
                out = [np.zeros((0, 3), np.int64)]
                for h in many_shingles(b.column(0).to_pylist(), width):
                    if low <= len(h) <= high and len(h):
                        first = h[: len(h) - _least(len(h), share) + 1].view(np.int64)
                        out.append(np.column_stack([first, np.broadcast_to(_digest(h), (len(first), 2))]))
                rows = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], schema=schema)

    return docs.where(F.col(key).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "h long, d1 long, d2 long")


FOUND = "a long, b long, set long, part int, members array<long>"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("set", pa.int64()), ("part", pa.int32()), ("members", pa.list_(pa.int64()))])


def buckets_to_pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """FOUND: the pairs (a, b) of a signature's first member with the others, and the members of each signature that has three or more, in parts of CHUNK."""
    dealt = rows.where("bucket IS NOT NULL").select("bucket", "address", "signatures").repartition(buckets, "bucket").sortWithinPartitions("bucket", "address")

    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != now:
                    yield from one(held)
                    now, held = row[0], []
                held.append(row)
        yield from one(held)

    def one(held):
        if not held:
            return
        read = [_unpacked(r[2]) for r in held]
        address = np.concatenate([r[1] + slots.astype(np.int64) for r, (_, slots) in zip(held, read, strict=True)])
        s = np.concatenate([x for x, _ in read])
        order = np.argsort(s, kind="stable")
        s, address = s[order], address[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            return
        # a set of members once, however many signatures it has
        scrambled = mixed(address.view(np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled, dtype=np.uint64)])
        name = mixed(sums[first + size] - sums[first] + size.astype(np.uint64))
        once = np.sort(np.unique(name, return_index=True)[1])
        first, size, name = first[once], size[once], name[once].view(np.int64)
        other = np.repeat(first + 1 - np.cumsum(size - 1) + size - 1, size - 1) + np.arange((size - 1).sum())
        pairs = np.unique(np.stack([address[np.repeat(first, size - 1)], address[other]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for a in range(0, len(pairs), 1 << 16):
            p = pairs[a : a + (1 << 16)]
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), none, none.cast(pa.int32()), pa.nulls(len(p), pa.list_(pa.int64()))], schema=_FOUND)
        many = [(int(name[i]), k // CHUNK, first[i] + k, min(CHUNK, size[i] - k)) for i in np.flatnonzero(size > 2).tolist() for k in range(0, int(size[i]), CHUNK)]
        for a in range(0, len(many), 1000):
            some = many[a : a + 1000]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int32()), pa.array([address[x[2] : x[2] + x[3]] for x in some], pa.list_(pa.int64()))], schema=_FOUND)

    return dealt.mapInArrow(run, FOUND)


TEXTS = "node long, body binary"


def fetched(docs: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """TEXTS: a compressed text for each of the wanted sets (node, doc_id, d1, d2). Texts are shuffled once, by id."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("node", pa.int64()), ("body", pa.binary())])

    def run(batches):
        pack, last = zstandard.ZstdCompressor(level=1), None
        for b in batches:
            for some in parts(b, 3):
                nodes, body = some.column(0).to_pylist(), some.column(3).to_pylist()
                out = []
                for node, d1, d2, t, h in zip(nodes, some.column(1).to_pylist(), some.column(2).to_pylist(), body, many_shingles(body, width), strict=True):
                    if node != last and len(h) and _digest(h) == (d1, d2):  # rows of one id lie together, and may have other texts
                        out.append((node, pack.compress(t.encode())))
                        last = node
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return wanted.join(texts, "doc_id").select("node", "d1", "d2", "text").mapInArrow(run, TEXTS)


def verified(texts: DataFrame, pairs: DataFrame, scratch: Scratch, width: int, share: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by all their shingles. Members of a large group go to several tasks, each with the text of a."""
    pairs = pairs.select("a", "b")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("k"))
    asked = (
        pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), "b")
        .union(sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.col("a").alias("b")))
    )
    rows = scratch.stored(asked).join(texts.withColumnRenamed("node", "b"), "b")
    dealt = rows.repartition("a", "salt").withColumn("other", F.col("a") != F.col("b")).sortWithinPartitions("a", "salt", "other").select("a", "b", "body")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        now, own = None, None
        for batch in batches:
            for some in parts(batch, 2, most=1 << 20):
                bodies = [unpack.decompress(x).decode() for x in some.column(2).to_pylist()]
                out = []
                for i, j, h in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), many_shingles(bodies, width), strict=True):
                    if i == j:
                        now, own = i, h
                        continue
                    assert i == now
                    both = np.concatenate([own, h])
                    both.sort(kind="stable")  # two ascending runs
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= share * (len(both) - same):
                        out.append((i, j))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, share: int) -> DataFrame:
    """(a, b) of the pairs (a, b, n_a, n_b, sketch_a, sketch_b) that may link."""

    def run(batches):
        for batch in batches:
            for b in parts(batch, 4, most=COMPARED):
                n_a, n_b = b.column(2).to_numpy(), b.column(3).to_numpy()
                left, right = b.column(4).to_pylist(), b.column(5).to_pylist()
                bits = np.array([8 * min(len(x), len(y)) for x, y in zip(left, right, strict=True)])
                ok = share * np.maximum(n_a, n_b) <= 100 * np.minimum(n_a, n_b)
                most = (100 - share) * (n_a + n_b) // (100 + share)
                for m in np.unique(bits[ok]).tolist():
                    at = np.flatnonzero(ok & (bits == m))
                    apart = _apart(*(folded([s[i] for i in at.tolist()], m) for s in (left, right)))
                    ok[at] = apart <= most[at]
                kept = pa.array(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


WORK = ("set", "low", "high", "block", "node", "class", "n", "sketch")


def work_rows(placed: DataFrame, described_: DataFrame, forest: bool) -> DataFrame:
    """WORK: the members (set, node, class) of sets of several classes, once for each pair of blocks (low, high) they are compared in.

    A set of up to BLOCK members is one block. A larger one is cut into blocks of about BLOCK: first those of members outside
    its largest class, then those of that class, and two blocks of the largest class never meet. forest: each
    block outside meets itself and one block of the largest class only.
    """
    sizes = placed.groupBy("set", "class").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("set").agg(F.sum("k").alias("m"), F.count("*").alias("labels"), F.max(F.struct("k", "class")).alias("top")).where("labels > 1")
    outside = f"CAST(ceil((m - top.k) / {BLOCK}) AS INT)"
    inside = f"CAST(ceil(top.k / {BLOCK}) AS INT)"
    cut = largest.select("set", "labels", F.col("top.class").alias("largest"), F.expr(f"IF(m <= {BLOCK}, 0, {outside})").alias("outside"), F.expr(f"IF(m <= {BLOCK}, 1, {inside})").alias("inside"))
    out = F.col("class") != F.col("largest")
    dealt = (
        placed.join(cut, "set")
        .withColumn("block", F.when(F.col("outside") == 0, 0).when(out, F.pmod(F.xxhash64("node"), F.col("outside"))).otherwise(F.col("outside") + F.pmod(F.xxhash64("node"), F.col("inside"))).cast("int"))
    )
    o, i, own = F.col("outside"), F.col("inside"), F.col("block")
    if forest:
        # outside block x meets x and o + x % i; so a block of the largest class meets every i-th block outside
        others = F.when(out, F.array(own, o + F.pmod(own, i))).when(own - o < o, F.sequence(own - o, o - 1, i))
    else:
        # blocks outside meet one another only where these hold several classes
        others = F.when(~out, F.sequence(F.lit(0), o - 1)).when(F.col("labels") > 2, F.sequence(F.lit(0), o + i - 1)).otherwise(F.sequence(o, o + i - 1))
    met = dealt.withColumn("other", F.explode(F.when(o == 0, F.array(F.lit(0))).otherwise(others)))
    return met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).join(described_, "node").select(*WORK)


def _mixed_pairs(work: DataFrame, share: int, forest: bool) -> DataFrame:
    """(a, b): pairs of work_rows() of different classes that may link. forest: of these only the nearest ones by
    their sketches that connect the classes of a pair of blocks, fewer than it has members."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            columns = [batch.column(c).to_numpy() for c in range(3, 7)]
            sketches = batch.column(7).to_pylist()
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if now != (key := tuple(keys[a].tolist())):
                    yield from told(now, held)
                    now, held = key, []
                held.append(([c[a:z] for c in columns], sketches[a:z]))
        yield from told(now, held)

    def told(now, held):
        if held:
            columns = [np.concatenate(c) for c in zip(*(c for c, _ in held), strict=True)]
            for i, j in pairs(now[1] != now[2], *columns, [x for _, some in held for x in some]):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    def pairs(across, block, rep, label, n, sketches):
        order = np.argsort(n, kind="stable")
        block, rep, label, n = block[order], rep[order], label[order], n[order]
        sketches = [sketches[x] for x in order.tolist()]
        bits = np.array([8 * len(s) for s in sketches])
        left, right, apart = [], [], []
        for m in np.unique(bits).tolist():  # sizes ascend, and so do bits: partners of i lie in one stretch after it
            at = np.flatnonzero(bits == m).tolist()
            upto = int(np.searchsorted(n, n[at[-1]] * 100 // share, "right"))
            some = folded(sketches[at[0] : upto], m)
            step = max(256, COMPARED // (m // 8))
            for i in at:
                end = int(np.searchsorted(n, n[i] * 100 // share, "right"))
                j = np.arange(i + 1, end)
                j = j[label[j] != label[i]]
                if across:  # each block meets itself elsewhere
                    j = j[block[j] != block[i]]
                for a in range(0, len(j), step):
                    k = j[a : a + step]
                    d = _apart(some[k - at[0]], some[i - at[0]])
                    good = d <= (100 - share) * (n[k] + n[i]) // (100 + share)
                    k, d = k[good], d[good] / (n[k[good]] + n[i])
                    if forest and len(k):
                        # the nearest member of each other class will do
                        near = np.argsort(d, kind="stable")
                        k, d = k[near], d[near]
                        first = np.sort(np.unique(label[k], return_index=True)[1])[:NEAREST]
                        left.append(np.full(len(first), i))
                        right.append(k[first])
                        apart.append(d[first])
                    elif len(k):
                        yield np.full(len(k), rep[i]), rep[k]
        if left:
            i, j, d = map(np.concatenate, (left, right, apart))
            top = {x: x for x in label.tolist()}

            def find(x):
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            kept = []
            for e in np.argsort(d, kind="stable").tolist():
                x, y = find(int(label[i[e]])), find(int(label[j[e]]))
                if x != y:
                    top[x] = y
                    kept.append(e)
            yield rep[i[kept]], rep[j[kept]]

    keys = WORK[:3]
    return work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, key: str, text: str, width: int = WIDTH, share: int = SHARE, mark: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, mark) of every document; mark is a number of the caller's that tells rows of one id apart."""
    if not 80 <= share <= 100:
        raise ValueError("below 80 percent, sets of fewer than some hundred elements have too few full groups")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.stored(described(docs, key, text, buckets, width, share, F.lit(None) if mark is None else mark))
    each = rows.where("doc_id IS NOT NULL").select("address", "doc_id", "n", "d1", "d2", "sketch", "rest", "mark")
    # equal sets are one node, named by the smallest address
    equal = each.where("n > 0").groupBy("d1", "d2").agg(F.min("address").alias("node"), F.min("doc_id").alias("least"))
    known = scratch.stored(each.join(equal, ["d1", "d2"], "left").select("address", "doc_id", "n", "node", "least", "rest", "mark"))
    own = scratch.stored(each.join(equal.select(F.col("node").alias("address")), "address", "left_semi").select(F.col("address").alias("node"), "doc_id", "n", "d1", "d2", "sketch"))
    named = known.where("n > 0").select("address", "node")
    sketched = own.select("node", "n", "sketch")

    found = scratch.stored(buckets_to_pairs(rows, buckets))
    sets = found.where("set IS NOT NULL").dropDuplicates(["set", "part"]).select("set", F.explode("members").alias("address"))
    named_sets = scratch.stored(sets.join(named, "address").select("set", "node").distinct())
    ends = (
        found.where("set IS NULL").select("a", "b")
        .join(named.select(F.col("address").alias("a"), F.col("node").alias("x")), "a")
        .join(named.select(F.col("address").alias("b"), F.col("node").alias("y")), "b")
        .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    # sets whose parts are too empty in some cut meet all others by single elements
    rest = known.where("rest").select("node").distinct().join(own, "node")
    low, high = rest.agg(F.min("n"), F.max("n")).first()
    if low is not None:
        first = first_elements(docs, key, text, low * share // 100, high * 100 // share, width, share)
        named_first = scratch.stored(first.join(own.select("d1", "d2", "node"), ["d1", "d2"]).select("h", "node").distinct())
        uncut = named_first.join(rest.select("node"), "node", "left_semi").select("h", F.col("node").alias("x"))
        met = uncut.join(named_first.withColumnRenamed("node", "y"), "h").where("x <> y")
        ends = ends.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    side = lambda k: sketched.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    pairs = scratch.stored(possible(ends.join(side("a"), "a").join(side("b"), "b"), share))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(named_sets.select("node")).distinct()
    texts = scratch.stored(fetched(docs, key, text, own.select("node", "doc_id", "d1", "d2").join(wanted, "node", "left_semi"), width))
    label = components(verified(texts, pairs, scratch, width, share), "a", "b")

    # signatures whose members are in different classes yet
    for forest in (True, False):  # connecting pairs first; the last round leaves out none
        placed = named_sets.join(label, "node", "left").select("set", "node", F.coalesce("component", "node").alias("class"))
        more = scratch.stored(_mixed_pairs(work_rows(placed, sketched, forest), share, forest))
        if more.isEmpty():
            break  # no pair of different classes may link, in any round
        new = scratch.stored(verified(texts, more, scratch, width, share))
        if not new.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new), "a", "b")
    in_class = known.where("n > 0").join(label, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = in_class.groupBy("class").agg(F.min("least").alias("component_id"))
    linked = in_class.join(smallest, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "mark")
    out = Scratch(spark).stored(linked.union(known.where("n = 0").select("doc_id", "n", "doc_id", "mark")))
    scratch.drop()
    return out


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").drop("mark")
