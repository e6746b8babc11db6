import zlib

import numpy as np
import pytest

from dealloom.llm import packing

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(12))
def test_search_keeps_pieces_and_does_not_lose_bins(seed):
    rng = np.random.default_rng(seed)
    size = 100
    length = np.minimum(size, rng.integers(1, [30, 60, 101, 101][seed % 4], rng.integers(1, 500)))
    first = packing.in_order(length.tolist(), size)
    bin_of, offset = packing.pack(length, size)
    fill = np.bincount(bin_of, length)
    assert fill.max() <= size and np.bincount(first, length).max() <= size
    assert np.count_nonzero(fill) <= len(np.unique(first))
    assert np.count_nonzero(fill) >= -(-length.sum() // size)
    for b in np.unique(bin_of):
        own = np.flatnonzero(bin_of == b)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(length[own])[:-1].tolist()]


def test_swaps_empty_a_bin():
    # In order they need four bins; moves and exchanges make room for all in three.
    length = np.array([60, 50, 50, 45, 40, 30, 25])
    assert len(np.unique(packing.pack(length, 100)[0])) == 3


def test_job(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    texts = [None, "", "x", "x", *(" ".join(rng.choice(["alpha", "beta", "Gamma,", "zq"], rng.integers(1, 900))) for _ in range(60)), "long word " * 3000]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate([*texts, "twin", "twin"])] + [(None, "no id", 3)], "doc_id long, text string, length int")
    rows = packing.packed(docs, WORDS, ["doc_id"], 512, group=20).collect()
    library = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())) for k in range(0, len(ids), 512)]
    assert sorted(((r.row.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.packed(docs.limit(0), WORDS, ["doc_id"]).count() == 0


def test_repeated_rows_and_long_documents_are_dealt_out(spark):
    copies = spark.createDataFrame([(1, "same words here")] * 300 + [(None, "same words here")] * 300, "doc_id long, text string")
    long = spark.createDataFrame([(2, "some words " * 5000)], "doc_id long, text string")
    for docs, least in ((copies, 600), (long, 300)):
        rows = packing.packed(docs, WORDS, ["doc_id"], 32, group=20).collect()
        groups = np.unique([r.sequence_id >> 32 for r in rows], return_counts=True)[1]
        assert len(rows) >= least and groups.max() <= 60
