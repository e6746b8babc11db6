import hashlib
import random

import pytest

from dealloom.llm import token_counts, word_bpe

P = pytest.importorskip("public_tokenizers")
WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", " \n ", "a", "a ", " a", "a  b", "▁", "a▁ b", "a\nb\n\nc", "\t\tx", "<s>", "</s> <unk>", "aaaaaaaaaaaaaaaaaaaaaaa", "The QUICK's it'LL 'RE don't", "x" * 5000, "ab " * 3000,
    "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext|", "ΑΣ ΣΑΣ", "İstanbul", "ﬁ ½ ²³", "é ́x", "日本語テキスト", "😀👍🏽 ok", "\x00\x01\x1c a\x85b\xa0c d", "ǅ ẞ", "١٢٣ 12 3a4", "naïve façade Ünï", "0̸≠",
]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    pools = ["abcdefgh ", "the and of ing er  ,.!?\n", "äöüßéèñç ÄÉÑ", "<|>endoftxsar ", "012 ٣½", "".join(chr(c) for c in range(1, 300)), "日本語한국어🎉👩‍👩‍👧 "]
    for _ in range(n):
        pool = rng.choice(pools)
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(0, 80)))
    for _ in range(n):
        yield "".join(c for c in (chr(rng.randrange(1, 0x2FFFF)) for _ in range(30)) if not 0xD800 <= ord(c) <= 0xDFFF and c.isprintable())


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    want, bpe = Tokenizer.from_file(WORDS), word_bpe.WordBpe(WORDS)
    for t in [*ODD, *texts()]:
        ids = want.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids, t
        assert bpe.decode(ids) == want.decode(ids, skip_special_tokens=False)


def test_word_bpe_equals_the_library_on_all_of_unicode():
    """Every code point alone, within a word and twice, and pairs of Latin characters and of marks."""
    from tokenizers import Tokenizer

    want, bpe = Tokenizer.from_file(WORDS), word_bpe.WordBpe(WORDS)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c <= 0xDFFF] + [*range(0xE0000, 0xE0200), 0x10FFFF]
    rng = random.Random(8)
    texts = [" ".join(f"{chr(c)} a{chr(c)}b {chr(c)}{chr(c)}, 1{chr(c)}." for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    latin, marks = [chr(c) for c in range(1, 0x250)], [chr(c) for c in [*range(0x300, 0x370), 0x7FD, *range(0x898, 0x8A0), *range(0x8CA, 0x8D4), 0xC3C, *range(0x1ABF, 0x1ACE), *range(0x1DC0, 0x1E00), *range(0x3099, 0x309B)]]
    texts += [" ".join(a + b for b in latin) for a in latin]
    texts += ["".join(rng.choice(latin + marks) for _ in range(60)) for _ in range(1500)]
    texts += [" ".join(rng.choice("aeoκ가か") + "".join(rng.choice(marks) for _ in range(3)) for _ in range(20)) for _ in range(500)]
    texts += ["".join(chr(rng.choice(points)) for _ in range(30)) for _ in range(1500)]
    for t, e in zip(texts, want.encode_batch(texts, add_special_tokens=False), strict=True):
        assert bpe.encode(t) == e.ids, ascii(t)


def test_piece_counts_equal_the_library():
    model = token_counts.load(PIECES)
    lengths = token_counts.Lengths(model, {})
    for t in [*ODD, *texts()]:
        assert token_counts.count(lengths, t) == len(model.encode(t)), t


def test_jobs(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, "x", 7) for i, t in enumerate([None, *ODD, *texts(30), "y" * 70000, "a b"])] + [(None, "a b", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `row` int")
    model, library = token_counts.load(PIECES), Tokenizer.from_file(WORDS)
    got = token_counts.token_counts(docs, PIECES, ["doc_id", "n_tokens"]).collect()
    assert sorted(((r.row.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r.row.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.round_trip_digests(docs, WORDS, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = docs.limit(0)
    assert token_counts.token_counts(none, PIECES, ["doc_id"]).count() == word_bpe.round_trip_digests(none, WORDS, ["doc_id"]).count() == 0
