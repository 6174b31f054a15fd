"""Hashed character n-gram embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the vectors of its character n-grams (of UTF-8 bytes, within a word and its two borders); the
classes are a softmax of that mean times a matrix.  Vectors and matrix are trained together.  For scoring, both are
multiplied out: each n-gram bucket has one logit a class, so a text's logits are a mean of table rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .common import IS_SPACE, LOWER, U64

SIZES = (3, 4, 5)
LEAST_STEPS = 250  # and at least CLASS_STEPS for each class
CLASS_STEPS = 20
_CODE = ((np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(20)).astype(np.uint32)


def grams(buf: np.ndarray, buckets: int, sizes: Sequence[int] = SIZES, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every n-gram of a text; a position is the byte before which the n-gram starts, and
    the text has one border byte in front and one behind.  buckets is a power of two."""
    text = np.empty(len(buf) + 2, dtype=np.uint8)
    text[0] = text[-1] = 32
    text[1:-1] = LOWER[buf] if fold else buf
    space = IS_SPACE[text]
    text[space] = 32
    code, gaps = _CODE[text], np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    at, ids = [], []
    for n in sizes:
        m = len(text) - n + 1
        if m <= 0:
            continue
        # Nothing but borders may be a space: the n-gram's inside has none.
        inside = np.flatnonzero(gaps[n - 1 : n - 1 + m] == gaps[1 : 1 + m])
        at.append(inside)
        ids.append(_buckets(_hashes(code, n, m)[inside], buckets))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(ids).astype(np.int64)


def _hashes(code: np.ndarray, n: int, m: int) -> np.ndarray:
    """Hashes of the first m n-grams of a text by the codes of its bytes."""
    h, high = np.full(m, n * 0x1B873593 & 0xFFFFFFFF, dtype=np.uint32), np.empty(m, dtype=np.uint32)
    for i in range(n):
        h ^= code[i : i + m]
        h *= np.uint32(0x01000193 + 2 * i)
        h ^= np.right_shift(h, np.uint32(15), out=high)
    return h


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(8)) & np.uint32(buckets - 1)


WINDOW = 1 << 15  # bytes whose n-grams are hashed at once: they stay in the processor's cache


def side_by_side(texts: Sequence[np.ndarray], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer with their case, any space as 32: one border before each, at the places returned, and behind the last as
    many as n-grams of these sizes read."""
    border, end = np.full(1, 32, np.uint8), np.full(max(sizes) - 1, 32, np.uint8)
    text = np.concatenate([x for t in texts for x in (border, t)] + [end])
    text[IS_SPACE[text]] = 32
    return text, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])


def gram_sums(text: np.ndarray, first: np.ndarray, table: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """What the n-grams (see ``grams``, without folding) of each of the texts side by side add up to in a table of one number a
    bucket, and how many they are.  The sums of a text do not depend on those beside it."""
    end = len(text) - max(sizes) + 1
    value, number, more = np.zeros(end), np.zeros(end, np.uint8), np.append(table, 0.0)  # behind the buckets: what is no n-gram
    for begin in range(0, end, WINDOW):
        part = text[begin : min(begin + WINDOW, end) + max(sizes) - 1]
        m = len(part) - max(sizes) + 1
        code, space = _CODE[part], part == 32
        for n in sizes:
            ids = _buckets(_hashes(code, n, m), len(table))
            for i in range(1, n - 1):
                ids[space[i : i + m]] = len(table)
            value[begin : begin + m] += more.take(ids)
            number[begin : begin + m] += ids < len(table)
    return np.add.reduceat(value, first), np.add.reduceat(number, first, dtype=np.int64)


Bag = tuple[np.ndarray, np.ndarray]  # different buckets of a text, and the share of its n-grams in each
NO_BAG: Bag = (np.zeros(1, np.uint16), np.zeros(1, np.float32))


def bag(ids: np.ndarray, buckets: int) -> Bag:
    """Of the buckets (at most 2 ** 16) of all n-grams of a text: its size is bounded, however long the text."""
    count = np.bincount(ids, minlength=buckets) if len(ids) else np.zeros(0, np.int64)
    different = np.flatnonzero(count)
    return different.astype(np.uint16), (count[different] / max(1, len(ids))).astype(np.float32)


def pack(b: Bag) -> bytes:
    return b[0].tobytes() + b[1].tobytes()


def unpack(data: bytes) -> Bag:
    n = len(data) // 6
    return np.frombuffer(data, np.uint16, n), np.frombuffer(data, np.float32, n, 2 * n)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    def __init__(self, buckets: int, dim: int, classes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        self.matrix = rng.normal(0, 0.1, (dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, dtype=np.float32)

    def table(self) -> np.ndarray:
        """Each bucket's logits."""
        return (self.vectors @ self.matrix).astype(np.float32)

    def step(self, bags: list[Bag], y: np.ndarray, rate: float, weight: np.ndarray) -> None:
        """One SGD step on a batch of bags."""
        bags = [b if len(b[0]) else NO_BAG for b in bags]
        sizes = np.array([len(ids) for ids, _ in bags])
        ids, part = (np.concatenate(x) for x in zip(*bags, strict=True))
        row = np.repeat(np.arange(len(bags)), sizes)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mean = np.add.reduceat(self.vectors[ids] * part[:, None], first, axis=0)
        p = softmax(mean @ self.matrix + self.bias)
        p[np.arange(len(bags)), y] -= 1
        p *= weight[:, None] / len(bags)
        change = (p @ self.matrix.T)[row] * part[:, None]
        self.matrix -= rate * mean.T @ p
        self.bias -= rate * p.sum(axis=0)
        for d in range(self.vectors.shape[1]):
            self.vectors[:, d] -= rate * np.bincount(ids, weights=change[:, d], minlength=len(self.vectors)).astype(np.float32)


def train(bags: Callable[[int], Bag], y: np.ndarray, classes: int, buckets: int, dim: int, epochs: int, rate: float, seed: int, batch: int = 32, weight: np.ndarray | None = None) -> Model:
    """bags(i) gives row i's bag; the rate falls to zero along the epochs.  Few rows get more epochs, for
    LEAST_STEPS steps at least, or more with many classes."""
    epochs = max(epochs, -(-max(LEAST_STEPS, CLASS_STEPS * classes) * batch // max(1, len(y))))
    model, rng = Model(buckets, dim, classes, seed), np.random.default_rng(seed)
    weight = np.ones(len(y)) if weight is None else weight
    total, done = max(1, epochs * ((len(y) + batch - 1) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            model.step([bags(int(i)) for i in rows], y[rows], rate * (1 - done / total), weight[rows])
            done += 1
    return model


def bag_logits(ids: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean of the buckets' logits: by counts for long texts, by rows for short ones."""
    if not len(ids):
        return bias.astype(np.float64)
    if len(ids) > len(table) // 8:
        return np.bincount(ids, minlength=len(table)) @ table / len(ids) + bias
    return table[ids].sum(axis=0) / len(ids) + bias


def logits_of(b: Bag, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return b[1] @ table[b[0]] + bias
