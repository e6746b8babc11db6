import random
import re

import numpy as np
import pyarrow as pa

from dealloom.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def found(texts, lower=False):
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    out = []
    for _, at, start, end, value in W.words(data, offsets, lower):
        out += [value[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    return out


def test_words_and_hashes_against_strings():
    rng = random.Random(1)
    texts = [None, "", " \n", "ab", "AB ab", "é x y", *("".join(rng.choice("aB é\n\t\x1c日") for _ in range(rng.randrange(90))) for _ in range(300)), "x" * 511, "x" * 512, "x" * 513, "y " * 9 + "x" * 2000]
    names = {}
    for lower in (False, True):
        for text, values in zip(texts, found(texts, lower), strict=True):
            words = WORD.findall("".join(c.lower() if lower and "A" <= c <= "Z" else c for c in text or ""))
            assert len(words) == len(values)
            for w, v in zip(words, values, strict=True):
                assert names.setdefault(w, v) == v
    assert len(set(names.values())) == len(names)


def test_words_that_a_polynomial_hash_confuses():
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    one, two = found([a, b])
    assert one != two
    # All words over two letters up to 14 letters, and all places of one letter in a long word.
    short = [format(i, f"0{n}b") for n in range(1, 15) for i in range(1 << n)]
    long = ["a" * i + "b" + "a" * (400 - i) for i in range(401)]
    values = found([" ".join(short + long)])[0]
    assert len(set(values)) == len(values)


def test_long_texts_are_scanned_in_cuts(monkeypatch):
    text = " ".join("word" + str(i % 977) for i in range(4000)) + " " + "z" * 9000 + "\n end "
    whole = found([text])[0]
    monkeypatch.setattr(W, "CUT", 1000)
    assert found([text])[0] == whole == found(["a", text, "b"])[1]
    data, offsets = W.utf8(pa.array([text]))
    _, _, start, end, _ = next(W.words(data, offsets))
    assert [text[a:b] for a, b in zip(start, end, strict=True)] == WORD.findall(text)
    assert len(found(["q" * 50_000_000])[0]) == 1
