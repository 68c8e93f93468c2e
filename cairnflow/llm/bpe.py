"""Exact BPE by backtracking over longest token matches, and decoding by an offset table.

One Aho-Corasick pass over a word gives the longest token that starts at each place. The
encoder takes it if it is compatible with the token before it: two tokens may stand side by
side if no merge crossing their seam would have come before the merges that made them. If
not, it tries the next shorter prefix that is a token, and steps back if none fits. The
result is the one that applying merges by rank gives, in time linear in the word.

Decoding concatenates table slices: all token strings lie in one buffer with an offset per
token, and the bytes of a run of ids are gathered at once.

Words repeat, so each task keeps a bounded table from white-space-free chunks to
their ids; no merge and no normalisation crosses white space.

Defined cases: a null text is an empty one and has no tokens; repeated rows give repeated
results; texts of any length are read in pieces cut at white space; columns other than the
named ones are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.arrow import split

#: Entries that a task's tables hold before they start anew, and characters of the longest key they hold.
TABLE_SIZE, KEY_SIZE = 200_000, 48
#: Code points of a text that are in hand at once, and tokens that are decoded at once.
TEXT_STEP, DECODE_STEP = 1 << 20, 1 << 18

# What \s means to the tokenizers library: Unicode white space, without the separators
# U+001C to U+001F that Python's str.split() also splits at.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{_SPACES}]+")
_SPACE = re.compile(f"[{_SPACES}]")
_ODD = "\x1c\x1d\x1e\x1f"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [of[b] for b in range(256)]


class Merges:
    """The merge rules as tokens over symbols, one character each; a word's last may differ from others."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        chars = byte_chars()
        self.inner = [chr(0x100 + b) for b in range(256)]
        self.last = [chr(0x200 + b) for b in range(256)] if suffix else self.inner
        self.text, number = [], {}  # token number in rank order -> symbols; token string -> number
        for ends, symbols in (("", self.inner), (suffix, self.last)):
            for b in range(256):
                if (name := chars[b] + ends) in vocab and name not in number:
                    number[name] = len(self.text)
                    self.text.append(symbols[b])
        self.base = len(self.text)
        self.parts = [(i, i) for i in range(self.base)]
        self.pair: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = number[left], number[right]
            if left + right in number:
                raise ValueError(f"two merges give {left + right!r}")
            self.pair[a, b] = number[left + right] = len(self.text)
            self.text.append(self.text[a] + self.text[b])
            self.parts.append((a, b))
        names = {n: name for name, n in number.items()}
        self.ids = array("I", [vocab[names[n]] for n in range(len(self.text))])
        self.number = {t: n for n, t in enumerate(self.text)}
        self.longest = ahocorasick.Automaton()
        for t, n in self.number.items():
            self.longest.add_word(t, (n, len(t)))
        self.longest.make_automaton()
        self._shorter: dict[int, int] = {}
        self._fit: dict[tuple[int, int], bool] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self._shorter.get(token)
        if found is None:
            t, found = self.text[token], -1
            for k in range(len(t) - 1, 0, -1):
                if (found := self.number.get(t[:k], -1)) >= 0:
                    break
            self._shorter[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their texts are encoded together."""
        key = left, right
        found = self._fit.get(key)
        if found is None:
            if len(self._fit) >= TABLE_SIZE:
                self._fit.clear()
            found = self._fit[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges on both sides, the later one first; below: only crossing merges of a
        # lower number can have come before what has been undone so far.
        below = len(self.text)
        while True:
            if self.pair.get((left, right), below) < below:
                return False
            if left > right:
                if left < self.base:
                    return True
                below, left = left, self.parts[left][1]
            else:
                if right < self.base:
                    if left < self.base:
                        return True
                    below, left = left, self.parts[left][1]
                    continue
                below, right = right + 1, self.parts[right][0]

    def encode(self, word: str) -> list[int]:
        """Token numbers of a word given as symbols."""
        n = len(word)
        whole = self.number.get(word)
        if whole is not None:
            return [whole]
        best = [-1] * n
        for end, (token, size) in self.longest.iter(word):
            best[end - size + 1] = token  # ends only grow, so the last one is the longest
        text, fits, out = self.text, self.fits, []
        dead = bytearray(n + 1)  # places from which no encoding goes on
        at, token = 0, best[0]
        while at < n:
            before = out[-1] if out else -1
            while True:
                end = at + len(text[token])
                if not dead[end] and (before < 0 or fits(before, token)):
                    out.append(token)
                    at = end
                    token = best[at] if at < n else -1
                    break
                token = self.shorter(token)
                if token < 0:
                    if not out:
                        raise ValueError("the vocabulary can't spell this word")
                    dead[at] = 1
                    token = out.pop()
                    at -= len(text[token])
                    break
        return out


class Memo(dict):
    """A table of bounded bytes that computes what it lacks: it holds short keys only, and starts anew when it is full."""

    def __init__(self, f, size: int = TABLE_SIZE):
        super().__init__()
        self.f, self.size = f, size

    def __missing__(self, key):
        value = self.f(key)
        if len(key) > KEY_SIZE:
            return value
        if len(self) >= self.size:
            self.clear()
        self[key] = value
        return value


class WordCodec:
    """A BPE vocabulary file whose words end in a suffix and whose white space is dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"]:
            raise ValueError("not a vocabulary of this kind")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        held = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.offsets = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(x) for x in held], out=self.offsets[1:])
        self.table = np.frombuffer(b"".join(held), np.uint8)
        self.of_word = Memo(self._word)
        self.of_chunk = Memo(self._chunk)

    def _word(self, word: str) -> bytes:
        m, raw = self.merges, word.encode()
        inner = m.inner
        ids = m.ids
        return array("I", [ids[t] for t in m.encode("".join([inner[b] for b in raw[:-1]]) + m.last[raw[-1]])]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for k, part in enumerate(self.marks.split(chunk) if self.marks and "<" in chunk else (chunk,)):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                # case is mapped character by character: a final sigma is as any other
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [self.of_word[w] for w in self.words.findall(plain)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for piece in pieces(text):
            odd = any(c in piece for c in _ODD)
            chunks = [c for c in _SPLIT.split(piece) if c] if odd else piece.split()
            out.append(b"".join(map(self.of_chunk.__getitem__, chunks)))
        return b"".join(out)

    def decode(self, ids: bytes) -> list[bytes]:
        """The token strings joined by spaces, in parts."""
        out, all_ids = [], np.frombuffer(ids, "<u4")
        for k in range(0, len(all_ids), DECODE_STEP):
            out.append(self._gather(all_ids[k : k + DECODE_STEP]))
        if out:
            out[-1] = out[-1][:-1]
        return out

    def _gather(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.table[at].tobytes()

    def decode_many(self, docs: list[bytes]):
        """Each document's decoded text in parts; short documents are gathered together."""
        held, n = [], 0
        for d in [*docs, None]:
            if held and (d is None or n + len(d) > 4 * DECODE_STEP):
                yield from self._together(held)
                held, n = [], 0
            if d is not None and len(d) > 4 * DECODE_STEP:
                yield self.decode(d)
            elif d is not None:
                held.append(d)
                n += len(d)

    def _together(self, docs: list[bytes]):
        ids = np.frombuffer(b"".join(docs), "<u4")
        if not len(ids):
            yield from ([] for _ in docs)
            return
        text = self._gather(ids)
        ends = np.concatenate([[0], np.cumsum(self.offsets[ids + 1] - self.offsets[ids])])
        bounds = ends[np.cumsum([0] + [len(d) // 4 for d in docs])]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield [text[a : b - 1]] if b > a else []


def pieces(text: str, step: int = TEXT_STEP):
    """The text in parts of about step code points, cut before white space."""
    at = 0
    while len(text) - at > step:
        cut = _SPACE.search(text, at + step)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def emptied(batches, *tables: dict):
    """The batches; when they end, so do the tables: a worker serves other tasks afterwards."""
    try:
        yield from batches
    finally:
        for t in tables:
            t.clear()


@cache
def codec(path: str) -> WordCodec:
    """One per worker and file."""
    return WordCodec(path)


def digests(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: its key, the number of tokens, and SHA-256 of its ids and of what they decode to."""

    def run(batches):
        c = codec(path)
        for batch in emptied(split(batches), c.of_word, c.of_chunk):
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            decoded = []
            for parts in c.decode_many(ids):
                h = hashlib.sha256()
                for p in parts:
                    h.update(p)
                decoded.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def encode(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: its key and its ids."""

    def run(batches):
        c = codec(path)
        for batch in emptied(split(batches), c.of_word, c.of_chunk):
            ids = [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Per row of encode(): its key and the decoded text."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows = [np.asarray(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(p).decode() for p in c.decode_many(rows)], pa.string())], ["key", "text"])

    rows = tokens.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op3_bpe_codec(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", vocabulary)
