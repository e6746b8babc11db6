"""Operator 6: log probabilities of texts under a small causal self-attention model, trained in numpy.

Words of all training texts are counted in one distributed aggregation; the counts give the add-half
baseline and, each distinct word encoded once, the counts of subword ids. The network reads the two
ids before each place, attends to the earlier places of its window and predicts the next id in two
steps: one of CLASSES classes, then one of the class's MEMBERS ids. Ids beyond the CLASSES * MEMBERS - 1
most frequent ones share a last place, and have their share of its counts there.

Weights are learned in one pass over all windows of every training text; each id is a target once. Equal
windows count once, with a weight that grows with their number. Windows are dealt by hash to rounds and to shards of about SHARD windows; in each round all shards learn from the
same weights, and their results are averaged. So the weights depend, but for rounding, on the texts only,
not on how rows are spread over tasks. Texts are scored in windows of WINDOW ids that overlap by CONTEXT, many
windows at a time; each id counts once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealloom.llm.annotate import annotate, small_batches
from dealloom.llm.scratch import discard, written
from dealloom.llm.word_bpe import load, text_blocks

CLASSES, MEMBERS, WIDTH, HIDDEN = 40, 40, 16, 32
ACTIVE = CLASSES * MEMBERS - 1  # ids with an embedding of their own; then come the rare ones, and a text's start
RARE, START = ACTIVE, ACTIVE + 1
WINDOW, CONTEXT = 40, 10
STRETCH = 4096  # bytes of a text whose words are cut into training windows together
ROUNDS, SHARD, BATCH, LEAST, RATE = 12, 4096, 128, 32, 0.03
SUMS = 8  # tasks that add up the weights of shards
TOP_WORDS = 200_000  # words that are broadcast with counts and ids; the rest are joined
CACHE = 200_000  # other words that a worker keeps
PIECE = 1 << 20  # bytes of a text that are split into words at a time
TOGETHER = 512  # windows whose ids are scored by class together
NEAR = 32  # windows whose numbers stay in a core's own cache
_DISTANCE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_LATER = _DISTANCE < 0
_DISTANCE = np.maximum(_DISTANCE, 0)
LN10 = np.log(10)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; rows are shifted only where the exponentials could overflow or vanish. Changes x."""
    if x.size and (x.max() > 60 or x.min() < -60):
        most = x.max(axis=1)
        x -= most[:, None]
        return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype)) + most
    return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def cross_entropy(x: np.ndarray, own: np.ndarray, part: np.ndarray) -> float:
    """Weighted loss of rows of logits, without gaps, for each row's own place. Changes x to the loss's gradient."""
    flat, at = x.reshape(-1), np.arange(0, x.size, x.shape[1]) + own
    if x.size and (x.max() > 60 or x.min() < -60):
        x -= x.max(axis=1, keepdims=True)
    loss = -float(flat.take(at) @ part)
    total = np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype)
    x *= (part / total)[:, None]
    flat[at] -= part
    return loss + float(np.log(total) @ part)


class Rooms(dict):
    """Arrays to write to, by name; their memory is kept for the next batch, so it stays in the CPU's caches."""

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        held = self.get((name, kind))
        if held is None or held.size < size:
            held = self[name, kind] = np.empty(size, kind)
        return held[:size].reshape(shape)


class Vocabulary:
    """The network's number of each id, and the log10 share of a rare id among the rare ones. The last id is the end of a text."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.number = np.full(len(counts) + 1, RARE, np.int32)
        self.number[order[:ACTIVE]] = np.arange(ACTIVE)
        self.number[-1] = START  # stands before a text
        rest = order[ACTIVE:]
        mass = counts[rest] + 0.5
        self.share = np.zeros(len(counts))
        self.share[rest] = np.log10(mass / mass.sum())
        self.mass = np.append(counts[order[:ACTIVE]] + 0.5, mass.sum()).reshape(CLASSES, MEMBERS)

    def rare(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each text's sum of the shares of its rare ids."""
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.share[ids], len(sizes))


class Attention:
    """One causal attention layer with a bias for distance, and one hidden layer, over embeddings of the two ids before."""

    def __init__(self, mass: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(size=shape) * scale
        d = WIDTH**-0.5
        w = {
            "one": draw(0.3, ACTIVE + 2, WIDTH), "two": draw(0.1, ACTIVE + 2, WIDTH), "q": draw(d, WIDTH, WIDTH), "k": draw(d, WIDTH, WIDTH), "v": draw(d, WIDTH, WIDTH), "o": draw(0.3 * d, WIDTH, WIDTH), "far": np.linspace(0, -1, WINDOW),
            "in": draw(d, WIDTH, HIDDEN), "in0": np.zeros(HIDDEN), "out": draw(0.3 * HIDDEN**-0.5, HIDDEN, WIDTH), "top": draw(0.1, WIDTH, CLASSES), "top0": np.log(mass.sum(axis=1) / mass.sum()),
            "sub": draw(0.1, CLASSES, WIDTH, MEMBERS), "sub0": np.log(mass / mass.sum(axis=1, keepdims=True)),
        }
        flat = np.concatenate([x.reshape(-1) for x in w.values()])
        # Weights, then their first and second moments in Adam, and the number of steps.
        self.state = np.concatenate([flat, np.zeros(2 * len(flat) + 1)]).astype(np.float32)
        self.flat = self.state[: len(flat)]
        self.rooms = Rooms()
        cut = np.cumsum([0, *(x.size for x in w.values())])
        self.w = {n: self.flat[a:b].reshape(x.shape) for (n, x), a, b in zip(w.items(), cut, cut[1:], strict=False)}

    def gradients(self, windows: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted loss over the targets, and its gradients. Rows of windows: two numbers before, then the targets; -1 is none.

        Attention and the hidden layer go over NEAR windows at a time, the output layers over rows of about as many.
        A last column of ones in place of a bias gives sums, and gradients of biases, within the products.
        """
        w, n = self.w, len(windows)
        room = lambda name, *shape: self.rooms(name, w["one"].dtype, *shape)
        inside = np.maximum(windows, 0)
        one, two = inside[:, 1:-1], inside[:, :-2]
        scale = np.float32(WIDTH**-0.5)
        into = np.hstack([w["q"] * scale, w["k"], w["v"]])
        near = np.where(_LATER, 0, np.exp(np.minimum(w["far"], 60))[_DISTANCE]).astype(into.dtype)
        e, h, m, g = (room(x, n, WINDOW, WIDTH) for x in ("e", "h", "m", "g"))
        qkv, a, total, f = room("qkv", n, WINDOW, 3 * WIDTH + 1), room("a", n, WINDOW, WINDOW), room("total", n, WINDOW, 1), room("f", n, WINDOW, HIDDEN)
        qkv[..., 3 * WIDTH] = 1
        q, k, v = (qkv[..., i * WIDTH : (i + 1) * WIDTH + (i == 2)] for i in range(3))
        flat = lambda x: x.reshape(-1, x.shape[-1])
        parts = [slice(c, min(c + NEAR, n)) for c in range(0, n, NEAR)]
        for c in parts:
            x, b, y = flat(e[c]), a[c], flat(h[c])
            np.take(w["one"], one[c].reshape(-1), 0, out=x, mode="clip")
            x += w["two"].take(two[c].reshape(-1), 0)
            np.matmul(x, into, out=flat(qkv[c])[:, : 3 * WIDTH])
            np.matmul(q[c], k[c].transpose(0, 2, 1), out=b)
            if b.max() > 30 or b.diagonal(axis1=1, axis2=2).min() < -30:
                b += np.where(_LATER, -np.inf, w["far"][_DISTANCE]).astype(b.dtype)
                b -= b.max(axis=-1, keepdims=True)
                np.exp(b, out=b)
            else:
                np.exp(b, out=b)
                b *= near
            mixed = np.matmul(b, v[c], out=room("mixed", len(b), WINDOW, WIDTH + 1))
            np.divide(1, mixed[..., WIDTH:], out=total[c])
            np.multiply(mixed[..., :WIDTH], total[c], out=m[c])
            np.matmul(flat(m[c]), w["o"], out=y)
            y += x
            z = np.matmul(y, w["in"], out=flat(f[c]))
            z += w["in0"]
            np.maximum(z, 0, out=z)
            z = np.matmul(z, w["out"], out=flat(g[c]))
            z += y
        # Targets by class, so that each class's own layer takes its rows at once.
        target = windows[:, 2:].reshape(-1)
        at = np.flatnonzero(target >= 0)
        kind, member = np.divmod(target[at].astype(np.int16), np.int16(MEMBERS))
        order = np.argsort(kind, kind="stable")
        at, kind, member = at[order], kind[order], member[order]
        cut = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        part = np.repeat(weight, WINDOW)[at].astype(g.dtype)
        part /= part.sum()
        x, dx, loss = room("x", len(at), WIDTH + 1), room("dx", len(at), WIDTH), 0.0
        x[:, :WIDTH] = flat(g).take(at, 0)
        x[:, WIDTH] = 1
        both, own, dboth = self.layers(), np.stack([kind, member], axis=1), np.zeros((CLASSES, WIDTH + 1, CLASSES + MEMBERS), g.dtype)
        lo = 0
        while lo < CLASSES:
            hi = lo + 1
            while hi < CLASSES and cut[hi + 1] - cut[lo] <= NEAR * WINDOW // 2:
                hi += 1
            r = slice(cut[lo], cut[hi])
            p = room("p", cut[hi] - cut[lo], CLASSES + MEMBERS)
            classes = [(c, slice(cut[c], cut[c + 1]), p[cut[c] - cut[lo] : cut[c + 1] - cut[lo]]) for c in range(lo, hi) if cut[c + 1] > cut[c]]
            for c, rows, y in classes:
                np.matmul(x[rows], both[c], out=y)
            loss += cross_entropy(p.reshape(-1, MEMBERS), own[r].reshape(-1), np.repeat(part[r], 2))
            for c, rows, y in classes:
                np.matmul(x[rows].T, y, out=dboth[c])
                np.matmul(y, both[c, :WIDTH].T, out=dx[rows])
            lo = hi
        dtop, dsub = dboth[..., :CLASSES].sum(0), dboth[..., CLASSES:]
        out = {"top": dtop[:WIDTH], "top0": dtop[WIDTH], "sub": dsub[:, :WIDTH], "sub0": dsub[:, WIDTH]}
        out |= {x: np.zeros_like(w[x]) for x in ("out", "in", "in0", "o")}
        dg, back, far = room("dg", n, WINDOW, WIDTH), np.zeros_like(into), np.zeros(WINDOW * WINDOW, g.dtype)
        if len(at) < n * WINDOW:
            dg.fill(0)
        flat(dg)[at] = dx
        # For each id of the windows but the last: the gradients of its place as the nearer and as the farther one.
        both = room("both", n, WINDOW + 1, 2 * WIDTH)
        both[:, 0, :WIDTH] = 0
        both[:, WINDOW, WIDTH:] = 0
        for c in parts:
            size = c.stop - c.start
            y, z = flat(dg[c]), flat(f[c])
            df = np.matmul(y, w["out"].T, out=room("df", size * WINDOW, HIDDEN))
            df *= z > 0
            out["out"] += z.T @ y
            out["in"] += flat(h[c]).T @ df
            out["in0"] += np.ones(len(df), df.dtype) @ df
            dh = np.matmul(df, w["in"].T, out=room("dh", size * WINDOW, WIDTH))
            dh += y
            out["o"] += flat(m[c]).T @ dh
            dm = room("dm", size, WINDOW, WIDTH + 1)
            np.multiply((dh @ w["o"].T).reshape(size, WINDOW, WIDTH), total[c], out=dm[..., :WIDTH])
            np.negative(np.einsum("ntd,ntd->nt", dm[..., :WIDTH], m[c]), out=dm[..., WIDTH])
            ds = np.matmul(dm, v[c].transpose(0, 2, 1), out=room("ds", size, WINDOW, WINDOW))
            ds *= a[c]
            far += np.ones(size, ds.dtype) @ ds.reshape(size, -1)
            d = room("d", size, WINDOW, 3 * WIDTH)
            np.matmul(ds, k[c], out=d[..., :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), q[c], out=d[..., WIDTH : 2 * WIDTH])
            np.matmul(a[c].transpose(0, 2, 1), dm[..., :WIDTH], out=d[..., 2 * WIDTH :])
            d = flat(d)
            back += flat(e[c]).T @ d
            de = np.matmul(d, into.T, out=room("de", size * WINDOW, WIDTH))
            de += dh
            both[c, 1:, :WIDTH] = both[c, :WINDOW, WIDTH:] = de.reshape(size, WINDOW, WIDTH)
        out["far"] = np.bincount(_DISTANCE.reshape(-1), far, WINDOW).astype(g.dtype)
        out |= {"q": back[:, :WIDTH] * scale, "k": back[:, WIDTH : 2 * WIDTH], "v": back[:, 2 * WIDTH :]}
        index = inside[:, :-1].reshape(-1).astype(np.int16)
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.diff(index, prepend=-1))
        # Pairs of numbers are added as complex ones, in half as many steps.
        both = flat(both).take(order, 0)
        sums = np.add.reduceat(both.view(np.result_type(both, np.complex64)), first).view(both.dtype)
        for name, part in (("one", sums[:, :WIDTH]), ("two", sums[:, WIDTH:])):
            out[name] = np.zeros_like(w[name])
            out[name][index[first]] = part
        return loss, out

    def layers(self) -> np.ndarray:
        """For each class, the weights of the classes and of its own members side by side, biases last; as both layers are as wide, rows of logits split in halves."""
        w = self.w
        out = np.empty((CLASSES, WIDTH + 1, CLASSES + MEMBERS), w["top"].dtype)
        out[:, :WIDTH, :CLASSES], out[:, WIDTH, :CLASSES], out[:, :WIDTH, CLASSES:], out[:, WIDTH, CLASSES:] = w["top"], w["top0"], w["sub"], w["sub0"]
        return out

    def learn(self, windows: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One pass of Adam over windows in batches, smaller ones where there are few windows."""
        n = len(self.flat)
        one, two = self.state[n : 2 * n], self.state[2 * n : 3 * n]
        batch = min(BATCH, max(LEAST, len(windows) * BATCH // SHARD))
        for b in range(0, len(windows), batch):
            self.state[-1] += 1
            step = float(self.state[-1])
            _, g = self.gradients(windows[b : b + batch], weight[b : b + batch])
            g = np.concatenate([g[n].reshape(-1) for n in self.w])
            one *= np.float32(0.9)
            one += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            two *= np.float32(0.99)
            two += g
            np.sqrt(two, out=g)
            g += np.float32(1e-8)
            np.divide(one, g, out=g)
            g *= np.float32(rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step))
            self.flat -= g

    def packed(self) -> bytes:
        return self.state.astype("<f4").tobytes()

    def unpack(self, state: bytes | np.ndarray) -> Attention:
        self.state[:] = np.frombuffer(state, "<f4") if isinstance(state, bytes) else state
        return self


def in_a_row(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts with two places before each text and a window's length after the last one, and where each text begins, these places included."""
    texts = np.arange(len(sizes))
    out = np.full(len(numbers) + 2 * len(sizes) + WINDOW, START, np.int32)
    out[np.arange(len(numbers)) + 2 * np.repeat(texts, sizes) + 2] = numbers
    return out, np.cumsum(sizes) - sizes + 2 * texts


class Scorer:
    """A trained model for scoring only: few passes over each small batch of windows, in single precision."""

    def __init__(self, model: Attention, vocabulary: Vocabulary | None = None):
        w = self.w = model.w
        self.vocabulary = vocabulary
        self.qkv = np.hstack([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"]]).astype(np.float32)
        self.far = w["far"][_DISTANCE]
        self.near = np.where(_LATER, np.float32(0), np.exp(np.clip(self.far, -60, 60))).astype(np.float32)
        self.both = model.layers()
        self.own = (np.repeat(self.both[0, :, :CLASSES].T, MEMBERS, axis=0) + self.both[..., CLASSES:].transpose(0, 2, 1).reshape(-1, WIDTH + 1)).astype(np.float32)

    def states(self, before: np.ndarray, earlier: np.ndarray, skip: int) -> np.ndarray:
        """The network's output for each place of the windows from skip on, given the numbers one and two places before."""
        w = self.w
        e = w["one"].take(before, 0)
        e += w["two"].take(earlier, 0)
        x = (e.reshape(-1, WIDTH) @ self.qkv).reshape(*e.shape[:2], 3 * WIDTH)
        a = np.matmul(x[:, skip:, :WIDTH], x[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1))
        if a.max() > 30 or a.min() < -30:
            a = np.where(_LATER[skip:], -np.inf, a + self.far[skip:])
            a = np.exp(a - a.max(axis=-1, keepdims=True)).astype(np.float32)
        else:
            np.exp(a, out=a)
            a *= self.near[skip:]
        m = np.matmul(a, x[..., 2 * WIDTH :])
        m /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*m.shape[:2], 1)
        h = m.reshape(-1, WIDTH) @ w["o"]
        h += e[:, skip:].reshape(-1, WIDTH)
        f = h @ w["in"]
        f += w["in0"]
        np.maximum(f, 0, out=f)
        h += f @ w["out"]
        return h

    def values(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target number."""
        kind = (target // MEMBERS).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        cut = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        x, target = np.ones((len(target), WIDTH + 1), np.float32), target[order]
        x[:, :WIDTH] = states.take(order, 0)
        sums = np.empty((len(target), 2), np.float32)
        for c in range(CLASSES):
            for b in range(cut[c], cut[c + 1], 1024):
                d = min(b + 1024, cut[c + 1])
                sums[b:d] = log_sum((x[b:d] @ self.both[c]).reshape(-1, MEMBERS)).reshape(-1, 2)
        out = np.empty(len(target), np.float32)
        out[order] = np.einsum("td,td->t", x, self.own.take(target, 0)) - sums.sum(1)
        return out

    def log_probabilities(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text: ids holds the ids of all texts in a row, sizes the number of each text (one at least)."""
        return self.of_numbers(self.vocabulary.number[ids], sizes) + self.vocabulary.rare(ids, sizes)

    def of_numbers(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of the network's numbers of each text."""
        step, texts = WINDOW - CONTEXT, np.arange(len(sizes))
        if not len(sizes):
            return np.zeros(0)
        # What a window reads beyond its text's end comes later, so it has no effect.
        numbers, begin = in_a_row(numbers, sizes)
        n = 1 + np.maximum(0, -(-(sizes - WINDOW) // step))
        owner = np.repeat(texts, n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, end = begin[owner] + part * step, begin[owner] + sizes[owner]
        total = np.zeros(len(sizes))
        for skip, some in ((0, np.flatnonzero(part == 0)), (CONTEXT, np.flatnonzero(part))):
            for b in range(0, len(some), TOGETHER):
                k = some[b : b + TOGETHER]
                place = at[k][:, None] + np.arange(WINDOW)
                before, earlier = numbers[place + 1], numbers[place]
                counts = (place < end[k][:, None])[:, skip:].reshape(-1)
                states = np.concatenate([self.states(before[c : c + 32], earlier[c : c + 32], skip) for c in range(0, len(k), 32)])
                target = numbers[place[:, skip:] + 2].reshape(-1)
                if not counts.all():
                    states, target = states[counts], target[counts]
                total += np.bincount(np.repeat(owner[k], WINDOW - skip)[counts], self.values(states, target), len(sizes))
        return total / LN10


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a text in UTF-8, in lower case where they are A to Z; a long text is cut at white space."""
    at = 0
    while len(text) - at > 2 * PIECE:
        cut = at + PIECE
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut].lower().split()
        at = cut
    yield text[at:].lower().split()


class Lexicon(dict):
    """Number of each word. By number: its ids, and log10 of its smoothed share, or nan where that is not known here.

    The frequent words stay; others are kept until there are more than CACHE of them.
    """

    def __init__(self, bpe, words: list[bytes], share: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.bpe, self.frequent, self.words, self.known = bpe, len(words), words, len(words)
        self.share, self.ids, self.sizes = share, ids, sizes
        self.first = np.cumsum(sizes) - sizes
        self.fixed = (share, ids, sizes, self.first)

    @classmethod
    def of(cls, path: str, top) -> Lexicon:
        """From broadcast frequent words; without any, all words are found here."""
        words, share, ids, sizes = top.value if top else (b"", np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))
        return cls(load(path), words.split(b" ") if words else [], share, ids, sizes)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.words.append(word)
        return n

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, and how many each text has."""
        if len(self) > self.frequent + CACHE:
            for word in self.words[self.frequent :]:
                del self[word]
            del self.words[self.frequent :]
            self.known = self.frequent
            self.share, self.ids, self.sizes, self.first = self.fixed
        out, sizes = [np.zeros(0, np.int32)], []
        for text in texts:
            n = 0
            for words in words_of(text):
                out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
                n += len(words)
            sizes.append(n)
        if self.known < len(self.words):
            ids = self.bpe.encode_raw(self.words[self.known :])
            n = np.array([len(x) // 4 for x in ids])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<i4")])
            self.sizes = np.concatenate([self.sizes, n])
            self.share = np.concatenate([self.share, np.full(len(n), np.nan)])
            self.known = len(self.words)
        return np.concatenate(out), np.array(sizes, np.int64)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each word has."""
        sizes = self.sizes[numbers]
        shift = np.repeat(self.first[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[shift + np.arange(len(shift))], sizes


def ids_with_ends(lexicon: Lexicon, numbers: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, the end of each included, and how many each text has; numbers and n as from the lexicon."""
    row, size = lexicon.ids_of(numbers)
    each = np.bincount(np.repeat(np.arange(len(n)), n), size, len(n)).astype(np.int64) + 1
    flat = np.full(each.sum(), end, np.int64)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(each) - 1] = False
    flat[inside] = row
    return flat, each


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n of the lower-cased words of all texts, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for _, part in text_blocks(batch.column("text")):
                for words in chain.from_iterable(map(words_of, part)):
                    found.update(words)
                if len(found) > CACHE:
                    yield batch_of()
        yield batch_of()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, path: str, most: int) -> pa.Table:
    """Words, counts and ids of the frequent words: all above a count that at most that many words reach."""
    step = F.floor(F.log2("n") * 8)
    rows, cut, total = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect(), None, 0
    for r in rows:
        total += r["words"]
        if total > most:
            break
        cut = r["step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = bpe.encode_raw(batch.column("word").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["word", "n", "ids"])

    some = counted.filter(F.lit(False) if cut is None else step >= cut).select("word", "n")
    return some.mapInArrow(run, "word string, n long, ids binary").toArrow().sort_by("word").combine_chunks()


def id_counts(counted: DataFrame, path: str, texts: int) -> np.ndarray:
    """How often each subword id is found in the counted words; the end of a text comes last."""
    size = len(load(path).names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, total = load(path), np.zeros(size, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids = bpe.encode_raw(batch.column("word").cast(pa.binary()).to_pylist())
            total += np.bincount(np.frombuffer(b"".join(ids), "<u4"), np.repeat(n, [len(i) // 4 for i in ids]), size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in counted.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    out[-1] = texts
    return out


def training_windows(texts: list[bytes]) -> Iterator[tuple[bool, list[bytes], bool]]:
    """The plain form of what windows_in cuts, with cut_windows (tests compare both). For each started stretch of each text: the words that begin in it, whether it begins the text, and whether it ends it."""
    for text in texts:
        done = 0
        for k in range(0, max(1, len(text)), STRETCH):
            end = min(k + STRETCH, len(text))
            # A word that crosses the end belongs to the stretch in which it begins.
            stop = end if end == len(text) else next((i for i in range(max(end - 1, done), len(text)) if text[i] in b" \t\n\r\x0b\x0c"), len(text)) if done < end else done
            yield k == 0, text[done:stop].lower().split(), end == len(text)
            done = stop


def cut_windows(rows: Iterable[tuple[bool, np.ndarray, bool]], end: int) -> Iterator[np.ndarray]:
    """Windows of two ids and the WINDOW ids after them, so that each id of a text, its end included, comes after others once; a text's last window may be shorter."""
    for first, row, last in rows:
        held = np.concatenate([[end + 1] * 2 if first else held, row, [end] * last]).astype(np.int64)
        whole = len(held) if last else len(held) - (len(held) - 2) % WINDOW
        for at in range(0, whole - 2, WINDOW):
            yield held[at : at + WINDOW + 2]
        held = held[whole - 2 :]


def windows_in(numbers: np.ndarray, sizes: np.ndarray, some: int = 4096) -> Iterator[np.ndarray]:
    """The windows of cut_windows for many texts at once, ends filled with -1, in matrices of some rows; numbers holds the network's numbers of all texts, ends included."""
    row, begin = in_a_row(numbers, sizes)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n)
    at = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    end = (begin + sizes + 2)[owner]
    for b in range(0, len(at), some):
        place = at[b : b + some, None] + np.arange(WINDOW + 2)
        yield np.where(place < end[b : b + some, None], row[place], -1)


def learned(drawn: DataFrame, shards: int, weights, rate: float) -> DataFrame:
    """Mean weights after learning from each shard of drawn windows, starting with the broadcast weights, with the number of windows: a few rows.

    A task reads its shards one after the other, sorted, and adds their weights up as it goes, so it
    has one Python worker that holds one shard.
    """
    mean = lambda total, n: pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()] if n else [], pa.binary()), pa.array([n] if n else [], pa.int64())], ["weights", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, n = Attention(np.ones((CLASSES, MEMBERS))), 0.0, 0
        for rows in runs(batches):
            windows = np.frombuffer(b"".join(rows.column("window").to_pylist()), "<i2").reshape(-1, WINDOW + 2).astype(np.int64)
            own.unpack(weights.value).learn(windows, 1 + np.log(rows.column("n").to_numpy()), rate)
            total, n = total + own.state.astype("<f8") * len(windows), n + len(windows)
        yield mean(total, n)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            for state, m in zip(batch.column("weights"), batch.column("n").to_pylist(), strict=True):
                total, n = total + np.frombuffer(state.as_py(), "<f4").astype("<f8") * m, n + m
        yield mean(total, n)

    tasks = min(shards, 4 * drawn.sparkSession.sparkContext.defaultParallelism)
    rows = drawn.withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(shards))).select("shard", "h", "window", "n")
    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "h", "window").mapInArrow(run, "weights binary, n long")
    return rows.repartition(SUMS).mapInArrow(summed, "weights binary, n long")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, from batches sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a < b:
                if held and held[0].column("shard")[0].as_py() != shard[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def binaries(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """16-bit numbers in a row as one binary value for each size."""
    at = np.concatenate([[0], np.cumsum(2 * sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(rows.astype("<i2").tobytes())])


def numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values in a row, and how many each has: what binaries took."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i2"), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2


def window_batches(numbers: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows of texts, of two bytes a number."""
    for out in windows_in(numbers, sizes):
        yield pa.RecordBatch.from_arrays([binaries(out, np.full(len(out), WINDOW + 2))], ["window"])


def train(texts: DataFrame, path: str, vocabulary: Vocabulary, top=None) -> Attention:
    """Weights from all windows of all texts. top: broadcast frequent words in a row, their shares, ids and numbers of ids, as the lexicon takes them."""
    known = texts.sparkSession.sparkContext.broadcast(vocabulary.number)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        lexicon = Lexicon.of(path, top)
        for batch in batches:
            for _, part in text_blocks(batch.column("text")):
                ids, sizes = ids_with_ends(lexicon, *lexicon.numbers(part), len(number) - 2)
                yield from window_batches(number[ids], sizes)

    return train_on(texts.select("text").mapInArrow(cut, "window binary"), vocabulary)


def train_on(windows: DataFrame, vocabulary: Vocabulary) -> Attention:
    """Weights from all windows, in one pass."""
    spark = windows.sparkSession
    model = Attention(vocabulary.mass)
    drawn = windows.groupBy("window").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("window"))
    drawn = written(drawn.withColumn("round", F.pmod("h", F.lit(ROUNDS)).cast("int")), "round")
    shards = max(1, round(drawn.count() / ROUNDS / SHARD))
    for k in range(ROUNDS):
        weights = spark.sparkContext.broadcast(model.packed())
        rows = learned(drawn.filter(F.col("round") == k), shards, weights, RATE * (1 - 0.9 * k / ROUNDS)).collect()
        weights.destroy()
        if rows:
            model.unpack((sum(np.frombuffer(r["weights"], "<f4").astype("<f8") * r["n"] for r in rows) / sum(r["n"] for r in rows)).astype("<f4"))
    discard(drawn)
    return model


def scores(docs: DataFrame, path: str, keep: list[str], learn: Column) -> DataFrame:
    """row, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    learn says which rows are learned from. A null or empty text is its end alone. Scores depend on
    the text only, so repeated rows get equal ones; strings of special tokens are ordinary text.
    Where there is nothing to learn from, all counts are zero and the weights are as drawn.
    """
    spark = docs.sparkSession
    seen = small_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), learn.alias("learn")).filter("learn").drop("learn")
    texts = seen.count()
    counted = written(word_counts(seen))
    whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = int(whole[0]) + texts, int(whole[1]) + (texts > 0)
    floor = total + 0.5 * (distinct + 1)
    top = frequent(counted, path, TOP_WORDS)
    vocabulary = Vocabulary(id_counts(counted, path, texts))
    log = lambda c: np.log10((c + 0.5) / floor)
    words, ids = b" ".join(top.column("word").cast(pa.binary()).to_pylist()), top.column("ids").to_pylist()
    top = spark.sparkContext.broadcast((words, log(top.column("n").to_numpy()), np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], np.int64)))
    shared = spark.sparkContext.broadcast(vocabulary)
    end_known, end_score = int(texts > 0), float(log(texts))

    def compute():
        vocab, lexicon = shared.value, Lexicon.of(path, top)
        end = len(vocab.number) - 2

        def of(column: pa.Array) -> Iterator[tuple[int, int, list]]:
            for lo, part in text_blocks(column):
                numbers, n = lexicon.numbers(part)
                owner = np.repeat(np.arange(len(part)), n)
                gain = lexicon.share[numbers]
                hit = ~np.isnan(gain)
                known, base = np.bincount(owner[hit], minlength=len(part)), np.bincount(owner[hit], gain[hit], len(part))
                ids, sizes = ids_with_ends(lexicon, numbers, n, end)
                # Rarer words of each text, with their number.
                rest = np.flatnonzero(~hit)
                pair, often = np.unique(owner[rest] << 32 | numbers[rest], return_counts=True)
                names = pa.array([lexicon.words[i] for i in (pair & 0xFFFFFFFF).tolist()], pa.binary()).cast(pa.string())
                tail = pa.StructArray.from_arrays([names, pa.array(often)], ["word", "n"])
                cut = np.searchsorted(pair >> 32, np.arange(len(part) + 1))
                key = [int.from_bytes(blake2b(x, digest_size=8).digest(), "little", signed=True) for x in part]
                yield lo, len(part), [pa.array(n + 1), pa.array(known + end_known, pa.int64()), pa.array(base + end_score), pa.array(key, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), tail), pa.array(vocab.rare(ids, sizes)), binaries(vocab.number[ids], sizes)]

        return of

    # Each text is split into ids once, for learning and for scoring.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), learn.alias("learn"), "text")
    coded = annotate(rows, ["row", "learn"], compute, "n_tokens long, top_known long, top_score double, key long, tail array<struct<word:string,n:bigint>>, rare double, numbers binary")
    coded = written(coded.select("row.*", *coded.columns[1:]), codec="zstd")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from window_batches(*numbers_of(batch.column("numbers")))

    model = train_on(coded.filter("learn").select("numbers").mapInArrow(cut, "window binary"), vocabulary)
    weights = spark.sparkContext.broadcast((vocabulary.mass, model.packed()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, state = weights.value
        scorer = Scorer(Attention(mass).unpack(state))
        for batch in batches:
            found = scorer.of_numbers(*numbers_of(batch.column("numbers"))) + batch.column("rare").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found)], [*batch.schema.names[:-2], "score"])

    out = coded.select("row", "n_tokens", "top_known", "top_score", "key", "rare", "numbers")
    out = written(out.mapInArrow(score, T.StructType([*out.schema.fields[:-2], T.StructField("score", T.DoubleType())])))
    # Rarer words: each text's own, once for equal texts, joined to their counts.
    rare = coded.groupBy("key", "n_tokens").agg(F.first("tail").alias("tail")).select("key", "n_tokens", F.explode("tail").alias("t")).select("key", "n_tokens", "t.word", F.col("t.n").alias("tf"))
    joined = rare.join(counted.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy("key", "n_tokens").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(floor))).alias("rare_score"))
    sums = written(sums)
    discard(coded, counted)
    out = out.join(sums, ["key", "n_tokens"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("row", "n_tokens", (F.col("top_known") + zero("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("top_score") + zero("rare_score")).alias("base_score"), "score")
