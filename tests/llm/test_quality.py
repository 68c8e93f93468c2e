import os
import random
import re
import string
from collections import Counter

import pytest
import zstandard

from cairnflow.llm import quality as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_equals_brute_force():
    rng = random.Random(4)
    pack = zstandard.ZstdCompressor(level=q.LEVEL)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "\x1f", "\xa0", "#", "%", "ab ", "ab ab ab "]) for _ in range(rng.randrange(120)))
        assert q.measure(text, pack)[:6] == brute(text)


def lines(n, seed):
    """Prose of about n bytes: the words of a small grammar with endings and stops."""
    rng = random.Random(seed)
    text = TEXTS[seed % len(TEXTS)]
    while len(text.encode()) < n:
        text += " " + rng.choice(TEXTS)
    return text.encode()[:n].decode("utf-8", "ignore")


DOCS = "/root/testdata/sf0.1"
needs = pytest.mark.skipif(not os.path.isdir(DOCS), reason="no test tables")
if os.path.isdir(DOCS):
    import duckdb

    GOOD = duckdb.sql(f"SELECT DISTINCT text FROM '{DOCS}/documents.parquet' JOIN '{DOCS}/labels.parquet' USING (doc_id) WHERE quality = 1 AND lang = 'en' ORDER BY text").fetchall()
    TEXTS = [r[0] for r in GOOD if 2000 < len(r[0]) < 6000]


@needs
def test_bands():
    pack = zstandard.ZstdCompressor(level=q.LEVEL)
    rng = random.Random(6)
    noise = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(9000))
    for size in (700, 1500, 4096, 9000):
        prose = TEXTS[3] if size < 5000 else lines(size, 3)
        assert q.measure(prose[:size], pack)[6]
        assert not q.in_band(size, len(pack.compress(noise[:size].encode())) / size)
    broken = " ".join(noise[i : i + 60] for i in range(0, 4095, 61))
    for tail in (4095, 4096, 4097):  # encoded data behind prose
        assert not q.measure(lines(4096, 3) + broken[:tail], pack)[6]
    marked = " ".join(w + rng.choice(["***", "$$$", "%%%", "&&&"]) for w in lines(6000, 2).split())
    assert not q.measure(marked, pack)[5] and not q.measure(marked, pack)[6]  # only the bands see this


@needs
def test_labelled_texts():
    """Good texts stay; of the bad ones that the base rules keep, the bands reject a third of all and most of the long ones."""
    pack = zstandard.ZstdCompressor(level=q.LEVEL)
    rows = duckdb.sql(f"SELECT text, quality FROM '{DOCS}/documents.parquet' JOIN '{DOCS}/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL").fetchall()
    found = [(quality, len(text.encode()), m[6]) for text, quality in rows if not (m := q.measure(text, pack))[5]]
    good = [kept for quality, _, kept in found if quality == 1]
    assert sum(good) >= 0.995 * len(good)
    for least, share in ((0, 0.33), (2048, 0.8)):
        bad = [kept for quality, size, kept in found if quality == 0 and size >= least]
        assert sum(bad) <= (1 - share) * len(bad)


def test_edge_cases(edge, empty, texts):
    got = {r["doc_id"]: r for r in q.judge(edge, "doc_id", "text").collect()}
    for k, t in texts.items():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t)
        assert not (r["base_failed"] and r["kept"])
    assert q.judge(empty, "doc_id", "text").count() == 0
