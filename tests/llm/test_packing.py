import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnflow.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("lengths", [[1024] * 5, [1] * 3000, [600] * 10, [512] * 7 + [1], [], list(range(1, 1025))])
def test_plans_hold_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=1025)
    p = packing.plan(counts)
    held = np.zeros(1025, int)
    for row, times in p:
        assert sum(row) <= 1024
        for n in row:
            held[n] += times
    assert (held == counts).all()


def test_plans_are_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(5.8, 1, 20000).astype(int) + 1)
    p = packing.plan(np.bincount(lengths, minlength=1025))
    assert sum(t for _, t in p) <= 1.003 * lengths.sum() / 1024 + 1


def test_pieces_and_places(edge, texts):
    t = Tokenizer.from_file(BYTE)
    rows = packing.packed_documents(edge, BYTE, 64, 2).collect()
    size = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for k, n in size.items():
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == n
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert all(r["length"] == 64 for r in own[1:])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64


def test_empty(empty):
    assert packing.packed_documents(empty, BYTE, 64, 2).count() == 0
