"""Operator 7: encoding and decoding with a byte-pair vocabulary with word ends, by batched merge rounds in numpy.

Symbols of many words lie in one flat array. In each round the keys of all neighbouring pairs are
looked up by binary search among the sorted keys of the merges; each word merges all places of its
lowest-ranked pair, from left to right; words without a known pair are finished and leave the array.
Words of Latin letters are normalised and split here; words with other characters, whose Unicode
tables differ between versions, are normalised and split by the vocabulary's own library. Each merge of this vocabulary makes a symbol of its own, so a symbol takes part in later merges
only, and this gives what merging one place after another gives (load() checks it).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from dealloom.llm.annotate import annotate
from dealloom.llm.words import LOWER, SPACE, blocks

CACHE = 200_000  # words that a worker keeps; it starts anew when they are full
LONGEST = 64  # bytes of the longest word that is kept
PLAIN = re.compile("[\0-\u024f]*")  # characters that are handled here just as the library does (tests compare all of them)


_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTE_OF = {c: b for b, c in enumerate(byte_symbols())}


def normal(text: str) -> str:
    """Composed and in lower case; white space makes no tokens, so its kind makes no difference."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the end of a word makes no difference here
    return text.lower()


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, end = whole["model"], whole["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special = {s.encode(): i for s, i in special.items()}
        self.names = {i: s for s, i in (vocab | special).items()}
        self.path = path
        self.pretoken = regex.compile(whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")")
        self.size = len(vocab)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        made = [m for _, _, m in merges]
        if len(set(made)) < len(made) or model["dropout"] or model["unk_token"]:
            raise ValueError("merge rounds need merges that each make a symbol of their own")
        self.none = len(made)
        key = np.array([a * self.size + b for a, b, _ in merges], np.int64)
        order = np.argsort(key)
        self.keys, self.rank, self.made = key[order], order.astype(np.int32), np.array(made, np.int32)
        # Bytes within a word, then bytes at its end; ranks of all pairs of them.
        symbols = byte_symbols()
        self.symbol = np.array([vocab[s] for s in symbols] + [vocab[s + end] for s in symbols], np.int32)
        self.byte_rank = self.ranks(self.symbol[:256].repeat(512), np.tile(self.symbol, 256)).reshape(256, 512)
        self.caches: dict[object, dict] = {}

    def ranks(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, by binary search; none where they do not merge."""
        key = one.astype(np.int64) * self.size + two
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], np.int32(self.none))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        byte = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(sizes) - 1
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        last = byte.copy()
        last[ends] += 256
        ids = self.symbol[last]
        rank = np.full(len(ids), self.none, np.int32)  # of each symbol with the next one
        rank[:-1] = self.byte_rank[byte[:-1], last[1:]]
        rank[ends] = self.none
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            live = best < self.none
            if not live.all():
                done_ids.append(ids[~live])
                done_owner.append(owner[~live])
                ids, owner, rank, best = ids[live], owner[live], rank[live], best[live]
                if not len(ids):
                    break
            hit = rank == best
            if (hit[1:] & hit[:-1]).any():
                # Of neighbouring hits, which share a symbol, every second one counts.
                place = np.arange(len(hit))
                begins = hit & ~np.concatenate([[False], hit[:-1]])
                hit &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            stay = ~np.concatenate([[False], hit[:-1]])
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            # Only pairs with a new symbol have new ranks.
            new = np.flatnonzero(hit[stay])
            near = np.zeros(len(ids) + 1, bool)
            near[new], near[new - 1] = True, True
            new = np.flatnonzero(near[:-1])
            pair = new[new < len(ids) - 1]
            pair = pair[owner[pair] == owner[pair + 1]]
            rank[new] = self.none
            rank[pair] = self.ranks(ids[pair], ids[pair + 1])
        owner = np.concatenate(done_owner)
        raw = np.concatenate(done_ids)[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)) * 4)]).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split_by_library(self, word: str) -> list[bytes]:
        """Pre-tokens of a word, normalised and split by the library; it gives bytes as symbols."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        return [bytes(map(BYTE_OF.__getitem__, piece)) for piece, _ in pieces]

    def encode_raw(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word in UTF-8 without white space, as little-endian 32-bit numbers; strings of special tokens are ordinary text."""
        letters = [w.lower() for w in words if w.isalpha()]  # of A to Z: one pre-token each
        alone = iter(self.encode_words(letters))
        if len(letters) == len(words):
            return list(alone)
        rest = [w.decode() for w in words if not w.isalpha()]
        plain = [PLAIN.fullmatch(t) is not None for t in rest]
        parts: list[list[str | bytes]] = [[]]
        for w in self.pretoken.findall("\n".join([normal(t) if p else "" for t, p in zip(rest, plain, strict=True)])):
            if w == "\n":
                parts.append([])
            else:
                parts[-1].append(w)
        parts = [x if p else self.split_by_library(t) for x, t, p in zip(parts, rest, plain, strict=True)]
        distinct = list(dict.fromkeys(chain.from_iterable(parts)))
        ids = dict(zip(distinct, self.encode_words([w.encode() if isinstance(w, str) else w for w in distinct]), strict=True))
        several = iter([b"".join(map(ids.__getitem__, x)) for x in parts])
        return [next(alone) if w.isalpha() else next(several) for w in words]

    def units(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, and full stops and commas after a letter or digit, which are tokens of their own; the string of a special token is one of them.

        Case of A to Z makes no difference to ids, but it may to composition with a mark that follows.
        """
        raw = np.frombuffer(b"".join(texts), np.uint8)
        data = LOWER[raw]
        before = np.flatnonzero(raw[1:] >= 0x80)
        data[before] = raw[before]
        at = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
        at = at[_ALNUM[data[at - 1]] & SPACE[data[at + 1]]]
        data = np.insert(data, at, 32).tobytes()
        ends = np.cumsum([0, *map(len, texts)])
        ends = (ends + np.searchsorted(at, ends)).tolist()
        out = [data[a:b].split() for a, b in zip(ends, ends[1:], strict=False)]
        for i, text in enumerate(texts):
            if b"<|" in text:
                out[i] = [u for k, part in enumerate(self.cut.split(text)) for u in ([part] if k % 2 else part.split())]
        return out

    def encode(self, text: str) -> list[int]:
        return memoryview(b"".join(self.encode_texts([text.encode()])[0])).cast("I").tolist()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary's file, the symbols are joined by spaces."""
        return " ".join([self.names[i] for i in ids])

    def digestible(self, ids: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal, and their decoded form."""
        numbers = memoryview(ids).cast("I").tolist()
        return len(numbers), " ".join(map(str, numbers)).encode(), self.decode(numbers).encode()

    def encode_texts(self, texts: list[bytes], form=bytes) -> list[list]:
        """For each text in UTF-8, form(ids as bytes) of its words in order. Forms are kept for later calls."""
        fixed = {s: form(i.to_bytes(4, "little")) for s, i in self.special.items()}
        cache = self.caches.setdefault(form, dict(fixed))
        if len(cache) > CACHE:
            cache.clear()
            cache.update(fixed)
        parts = self.units(texts)
        wanted = list(set().union(*parts).difference(cache))
        extra = {}
        for c, ids in zip(wanted, self.encode_raw(wanted), strict=True):
            (cache if len(c) <= LONGEST else extra)[c] = form(ids)
        get = (lambda c: cache[c] if c in cache else extra[c]) if extra else cache.__getitem__
        return [list(map(get, p)) for p in parts]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The vocabulary in path, once for each worker."""
    return WordBpe(path)


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about a megabyte together, in UTF-8; nulls become empty texts."""
    texts = texts.fill_null("").cast(pa.binary())
    at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    for lo, hi in blocks(None, at):
        yield lo, texts.slice(lo, hi - lo).to_pylist()


def _round_trip(path: str):
    def compute():
        bpe = load(path)

        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            for lo, part in text_blocks(texts):
                n, one, two = [], [], []
                for forms in bpe.encode_texts(part, bpe.digestible):
                    forms = [f for f in forms if f[0]]
                    n.append(sum(f[0] for f in forms))
                    one.append(hashlib.sha256(b" ".join([f[1] for f in forms])).hexdigest())
                    two.append(hashlib.sha256(b" ".join([f[2] for f in forms])).hexdigest())
                yield lo, len(n), [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

        return of

    return compute


def round_trip_digests(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """row, n_tokens, ids_sha256 and decoded_sha256 of each whole text; null and empty texts have no tokens.

    Rows are independent: repeated rows get equal results. Texts of any length are encoded whole.
    """
    return annotate(docs, keep, _round_trip(path), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """row and the ids of each whole text."""

    def compute():
        bpe = load(path)

        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            for lo, part in text_blocks(texts):
                yield lo, len(part), [pa.array([np.frombuffer(b"".join(f), "<i4") for f in bpe.encode_texts(part)], pa.list_(pa.int32()))]

        return of

    return annotate(docs, keep, compute, "ids array<int>")
