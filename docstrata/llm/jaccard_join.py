"""N-gram Jaccard join with signature trees.

Three steps, each a Spark job over all rows.

1. **Deal.**  Every set is cut into parts by shingle hash.  Two sets of similarity t differ in at most
   K = (1 - t) / (1 + t) * (|A| + |B|) shingles, and each difference touches one part, so with more than K
   non-empty parts at least one part is the same in both (pigeonhole).  Sets of one size band use the same
   number of parts, and sets near the band's upper end also deal themselves into the next band.  A set with
   too few non-empty parts adds its prefix (its least hashes) as keys.  The rule loses no pair; equal keys put
   sets into one forest (components over a star for each key, so no key's pairs are listed).
   A forest over ``block`` members, which a passage in many texts can chain together, is refined: each pivot's star
   is walked as trees of small bitmaps (step 2 without counting), and only what the bitmaps cannot part stays in one
   forest.  Two similar sets share a key, so also a star, so they stay together.
2. **Traverse.**  Each forest member becomes a leaf of a signature tree: a bitmap of its shingles and its size.
   Inner nodes hold the OR of their children's bitmaps and the range of their sizes.  Two trees (or a tree with
   itself) are walked together; a node pair goes when its largest possible overlap,
   ``popcount(bitmap & bitmap) + collisions``, is below what its smallest sizes need, or when its size ranges are too
   far apart.  What remains is counted exactly.  Where only components are asked for, a leaf pair also goes when both
   lie in one component; where links are counted, every pair is, and a task returns the number of rows that each set
   links with, not the pairs.  Groups over ``block`` members are cut into blocks; each pair of blocks is a task.
3. **Join.**  Components over the links; numbers of links are summed over the tasks.

Equal sets are one node, so a group of copies costs one leaf.  Nodes are 64-bit hashes of sets: among 10^9
different sets, the chance that any two share a hash is below 3 %.

Cases: null or wordless text has no shingles and links with nothing; fewer words than ``size`` make one shingle;
rows that share a doc_id count as one document, which goes if any of them does; a row with a null doc_id links like any
other (its set is told by its hash) and has the least doc_id that its links reach, or null; other columns are ignored;
an empty table gives an empty result; a text is read whole, however long.  A row's links are the other rows with a
doc_id whose sets are similar, its own set's copies among them; the row of a null doc_id has null.  Of a group of
which no row has a doc_id, ``keep_one`` keeps any one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, components, documents, map_batches, mix, shingles, utf8_rows, written

BAND = 1.5
FAN = 8
BLOCK = 1024
BROADCAST_ROWS = 500_000  # of 16 bytes each
VOCABULARY = 1 << 18  # shingles that two trees may share for exact counting by bits
FILTER_WORDS = 1 << 19  # 64-bit words of the key filter: 4 MB at any input size


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)))], dtype=U64) + U64(len(s))).view(np.int64)[0])


def _band_top(c: int) -> int:
    return math.ceil(BAND ** (c + 1)) - 1


def _band(n: int) -> int:
    c = max(0, int(math.log(n) / math.log(BAND)) - 1)
    while _band_top(c) < n:
        c += 1
    return c


def deal_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys under which a set meets every set of similarity num/den or more; see the module's step 1."""
    n = len(s)
    if n == 0:
        return np.zeros(0, dtype=U64)
    t = num / den
    loss = (1 - t) / (1 + t)
    spread, content, keys, fallback = mix(s ^ U64(0x51ED270B)), mix(s + U64(0x2545F491)), [], False
    c, most = _band(n), n * den // num
    while c == _band(n) or _band_top(c - 1) < most:
        top = _band_top(c)
        bound = int(loss * 2 * top + 1e-9)
        parts = bound + 1 + (bound * 3 + 99) // 100
        where = ((spread >> U64(32)) * U64(parts)) >> U64(32)
        where = where.astype(np.int64)
        filled = np.bincount(where, minlength=parts) > 0
        sums = np.zeros(parts, dtype=U64)
        np.add.at(sums, where, content)
        index = np.flatnonzero(filled)
        keys.append(mix(sums[index] + mix(index.astype(U64) + U64((c + 1) << 32))))
        fallback |= len(index) <= int(loss * (n + min(most, top)) + 1e-9)
        c += 1
    if fallback:
        need = (n * num + den - 1) // den
        order = np.sort(spread)[: n - need + 1]
        keys.append(mix(order ^ U64(0x0F0F0F0F12345678)))
    return np.concatenate(keys)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=bool)
    out[(mix(s) & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out)


class SignatureTree:
    """Leaves are bitmaps of sets with the sets' sizes, and the sets where links are to be counted exactly; every node
    holds an OR-combined bitmap, a size range and the most collisions of a leaf."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None = None):
        self.order = np.lexsort((maps[:, 0], sizes))
        self.sets = None if sets is None else [sets[i] for i in self.order]
        maps, low = np.ascontiguousarray(maps[self.order]).view(U64), sizes[self.order]
        self.levels = [(maps, low, low, low - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))

    def raise_to(self, depth: int) -> None:
        """Adds single roots above, so that two trees have the same depth."""
        while len(self.levels) < depth:
            self.levels.append(self.levels[-1])


def _fitting(x: SignatureTree, y: SignatureTree, level: int, left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The node pairs of a level that may hold a link."""
    (bx, lx, hx, sx), (by, ly, hy, sy) = x.levels[level], y.levels[level]
    keep_l, keep_r, step = [left[:0]], [right[:0]], max(1, (1 << 21) // bx.shape[1])
    for k in range(0, len(left), step):
        a, b = left[k : k + step], right[k : k + step]
        fits = (hx[a] * den >= ly[b] * num) & (hy[b] * den >= lx[a] * num)
        a, b = a[fits], b[fits]
        most = np.bitwise_count(bx[a] & by[b]).sum(axis=1, dtype=np.int64) + np.minimum(sx[a], sy[b])
        # |A & B| >= num / (num + den) * (|A| + |B|)
        fits = most * (num + den) >= num * (lx[a] + ly[b])
        keep_l.append(a[fits])
        keep_r.append(b[fits])
    return np.concatenate(keep_l), np.concatenate(keep_r)


def _children(x: SignatureTree, y: SignatureTree, level: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    below_x, below_y = len(x.levels[level - 1][0]), len(y.levels[level - 1][0])
    fan_x = np.arange(FAN) if below_x > len(x.levels[level][0]) else np.zeros(1, dtype=np.int64)
    fan_y = np.arange(FAN) if below_y > len(y.levels[level][0]) else np.zeros(1, dtype=np.int64)
    a = (left[:, None, None] * len(fan_x) + fan_x[None, :, None] + 0 * fan_y[None, None, :]).ravel()
    b = (right[:, None, None] * len(fan_y) + fan_y[None, None, :] + 0 * fan_x[None, :, None]).ravel()
    there = (a < below_x) & (b < below_y)
    if x is y:
        there &= a <= b
    return a[there], b[there]


def dual_traversal(x: SignatureTree, y: SignatureTree, num: int, den: int) -> list[tuple[int, int]]:
    """Links between leaves of x and y (of x with itself if y is x), enough to join what they join.  Without sets, a
    pair that its bitmaps cannot part counts as a link."""
    same = x is y
    depth = max(len(x.levels), len(y.levels))
    x.raise_to(depth)
    y.raise_to(depth)
    nx, ny = len(x.order), len(y.order)
    left, right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for level in range(depth - 1, 0, -1):
        left, right = _fitting(x, y, level, left, right, num, den)
        if level > 1:
            left, right = _children(x, y, level, left, right)
    group, shift = np.arange(nx + (0 if same else ny)), 0 if same else nx
    links = []
    for k in range(0, len(left), 512):
        a, b = left[k : k + 512], right[k : k + 512]
        if depth > 1:
            a, b = _children(x, y, 1, a, b)
        apart = group[a] != group[shift + b]
        for i, j in zip(*(v.tolist() for v in _fitting(x, y, 0, a[apart], b[apart], num, den)), strict=True):
            gi, gj = group[i], group[shift + j]
            if gi == gj:
                continue
            if x.sets is not None:
                p, q = x.sets[i], y.sets[j]
                at = np.searchsorted(q, p)
                at[at == len(q)] = len(q) - 1
                both = int((q[at] == p).sum())
                if both * den < num * (len(p) + len(q) - both):
                    continue
            group[group == gj] = gi
            links.append((int(x.order[i]), int(y.order[j])))
    return links


def shared_bits(sides: list[SignatureTree]) -> list[np.ndarray] | None:
    """Exact bitmaps of the trees' sets (in their order) over the shingles that more than one set has; None if too many."""
    sets = [s for t in sides for s in t.sets]
    words, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    width = int(place[-1]) + 1
    if width > VOCABULARY:
        return None
    bits = np.zeros((len(sets), -(-max(1, width) // 64) * 8), dtype=np.uint8)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = count[which] > 1
    row, at = row[many], place[which[many]]
    np.bitwise_or.at(bits, (row, at >> 3), np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    cut = len(sides[0].sets)
    return [bits[:cut].view(U64), bits[cut:].view(U64)][: len(sides)]


def all_links(x: SignatureTree, y: SignatureTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every link between leaves of x and y (of x with itself if y is x), in parts."""
    same = x is y
    bits = shared_bits([x] if same else [x, y])
    depth = max(len(x.levels), len(y.levels))
    x.raise_to(depth)
    y.raise_to(depth)
    left, right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for level in range(depth - 1, 0, -1):
        left, right = _fitting(x, y, level, left, right, num, den)
        if level > 1:
            left, right = _children(x, y, level, left, right)
    for k in range(0, len(left), 512):
        a, b = left[k : k + 512], right[k : k + 512]
        if depth > 1:
            a, b = _children(x, y, 1, a, b)
        if same:
            a, b = a[a < b], b[a < b]
        a, b = _fitting(x, y, 0, a, b, num, den)
        if not len(a):
            continue
        if bits is None:
            both = np.array([len(np.intersect1d(x.sets[i], y.sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        else:
            step = max(1, (1 << 21) // bits[0].shape[1])
            both = np.concatenate([np.bitwise_count(bits[0][a[i : i + step]] & bits[-1][b[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), step)])
        links = both * (num + den) >= num * (x.levels[0][1][a] + y.levels[0][1][b])
        yield x.order[a[links]], y.order[b[links]]


def _bits(n: int) -> int:
    """Bits of the bitmap of a set of n: two to four for each shingle."""
    return min(1 << 16, 1 << max(8, (2 * n).bit_length()))


def _classes(n: int, num: int, den: int) -> list[int]:
    """Bitmap sizes of a set of n and of the larger sets that may be similar to it."""
    first, last = (_bits(m).bit_length() - 1 for m in (n, n * den // num))
    return [1 << c for c in range(first, last + 1)]


def _walk(sides: list[tuple[list[int], SignatureTree]], num: int, den: int) -> list[tuple[int, int]]:
    if not sides:
        return []
    (nodes, x), (others, y) = sides[0], sides[-1]
    return [(nodes[i], others[j]) for i, j in dual_traversal(x, y, num, den)]


def _degrees(sides: list[tuple[list[int], SignatureTree]], copies: dict[int, int], num: int, den: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links enough to join what all links join, and (node, number of rows that it links with)."""
    (nodes, x), (others, y) = sides[0], sides[-1]
    same = x is y
    left, right = np.array([copies[n] for n in nodes]), np.array([copies[n] for n in others])
    group, shift = np.arange(len(nodes) + (0 if same else len(others))), 0 if same else len(nodes)
    of_x, of_y, links = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(others), dtype=np.int64), []
    for a, b in all_links(x, y, num, den):
        np.add.at(of_x, a, right[b])
        np.add.at(of_x if same else of_y, b, left[a])
        while len(apart := np.flatnonzero(group[a] != group[shift + b])):
            i, j = int(a[apart[0]]), int(b[apart[0]])
            links.append((nodes[i], others[j]))
            group[group == group[shift + j]] = group[i]
    found = [(n, k) for part, of in ((nodes, of_x), (others, of_y)) for n, k in zip(part, of.tolist(), strict=True) if k]
    return links, found


def forest_links(size: int, num: int, den: int, every: bool = False):
    """The function of one task: rows (forest, i, j, side, node, copies, text) to links (a, b, null) and, if every link
    is to be counted, also to rows (a, null, n_links)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        degrees: list[tuple[int, int]] = []
        for _, rows in pdf.groupby("forest", sort=False):
            sides: list[dict[int, np.ndarray]] = [{}, {}]
            copies: dict[int, int] = dict(zip(rows["node"].tolist(), rows["copies"].tolist(), strict=True))
            for side, node, text in zip(rows["side"].tolist(), rows["node"].tolist(), rows["text"], strict=True):
                s = shingles(np.frombuffer((text or "").encode(), dtype=np.uint8), size)
                if len(s) and set_hash(s) == node:  # another row may share the doc_id
                    sides[side][node] = s
            bits = _bits(max((len(s) for sets in sides for s in sets.values()), default=1))
            trees = [
                (list(sets), SignatureTree(np.stack([bitmap(s, bits) for s in sets.values()]), np.array([len(s) for s in sets.values()]), list(sets.values())))
                for sets in sides if sets
            ]
            if not every:
                found += _walk(trees, num, den)
            elif len(trees) == 2 or (trees and rows["i"].iloc[0] == rows["j"].iloc[0]):  # a block meets itself in one task only
                links, more = _degrees(trees, copies, num, den)
                found += links
                degrees += more
        a, b, n = [*(x for x, _ in found), *(x for x, _ in degrees)], [*(y for _, y in found), *[None] * len(degrees)], [*[None] * len(found), *(k for _, k in degrees)]
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n_links": pd.array(n, "Int64")})

    return run


def star_links(num: int, den: int):
    """The function of one task: rows (forest, bits, side, node, n, map) to pairs (a, b) that bitmaps cannot part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        pdf = pdf.sort_values(["forest", "bits", "side"], kind="stable")
        forest, bits, side, node, n, maps = (pdf[c].to_numpy() for c in ("forest", "bits", "side", "node", "n", "map"))
        cut = np.flatnonzero(np.concatenate(([True], (forest[1:] != forest[:-1]) | (bits[1:] != bits[:-1]), [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo == 1:
                continue
            mid = lo + int((side[lo:hi] == 0).sum())
            trees = [(node[i:j].tolist(), SignatureTree(np.frombuffer(b"".join(maps[i:j]), dtype=np.uint8).reshape(j - i, -1), n[i:j])) for i, j in ((lo, mid), (mid, hi)) if j > i]
            found += _walk(trees, num, den)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def signature_table(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, n, bits, map) from (node, text): a bitmap for the set's own size class and for each larger one of which
    a set may be similar.  Of two similar sets, both have one for the larger set's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for node, buf in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), strict=True):
                s = shingles(buf, size)
                if len(s) and set_hash(s) == node:  # another row may share the doc_id
                    out += [(node, len(s), bits, bitmap(s, bits).tobytes()) for bits in _classes(len(s), num, den)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["node", "n", "bits", "map"])

    return map_batches(rows.select("node", "text"), run, "node long, n long, bits int, map binary")


def set_table(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, node, n_shingles, keys): the set hash of every row, null for an empty set, and the keys of step 1.  A
    task deals a set once: further copies that it reads have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, n, keys = [], [], []
            for buf in utf8_rows(batch.column(1)):
                s = shingles(buf, size)
                node.append(set_hash(s) if len(s) else None)
                n.append(len(s))
                keys.append(s[:0] if node[-1] in seen else deal_keys(s, num, den))
                if len(seen) < 1 << 20:
                    seen.add(node[-1])
            at = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            dealt = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*keys, np.zeros(0, U64)]).view(np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), dealt], ["doc_id", "node", "n_shingles", "keys"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, node long, n_shingles long, keys array<long>")


def nodes_of(docs: DataFrame, size: int) -> DataFrame:
    """docs with the set hash ``__node`` of each row."""
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["__node long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(buf, size) for buf in utf8_rows(batch.column(at)))
            yield pa.record_batch([*batch.columns, pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], [*names, "__node"])

    return map_batches(docs, run, schema)


def key_filter(shared: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bit of each shared key set.  It lets every shared key through, and the fewer
    others the fewer bits are set; it only saves shuffling, the join on keys decides."""
    bits = shared.groupBy(F.expr(f"cast(key & {FILTER_WORDS - 1} as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 58) as int))")).alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, dtype=U64)
    out[bits["w"].to_numpy()] = bits["b"].to_numpy().view(U64)
    return out


def passed_keys(sets: DataFrame, only: np.ndarray) -> DataFrame:
    """(key, node) of the keys that a key filter lets through."""
    passed = sets.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passed.value
        for batch in batches:
            node, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            k = keys.flatten().to_numpy(zero_copy_only=False).view(U64)
            h = np.repeat(node, keys.value_lengths().to_numpy(zero_copy_only=False))
            fits = (bits[(k & U64(FILTER_WORDS - 1)).astype(np.int64)] >> (k >> U64(58))) & U64(1) == U64(1)
            yield pa.record_batch([pa.array(k[fits].view(np.int64)), pa.array(h[fits])], ["key", "node"])

    return map_batches(sets.filter("size(keys) > 0").select("node", "keys"), run, "key long, node long")


def _texts(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """Members (doc_id, node, ...) with their texts, which are smaller to shuffle than their sets.  Sets that only rows
    without a doc_id have are found by their hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = members.filter("doc_id is not null").withColumnRenamed("doc_id", "rep")
    small = members.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(named) if small else named, F.col("doc_id") == F.col("rep")).drop("doc_id", "rep")
    lone = nodes_of(rows.filter("doc_id is null").select("text"), size).dropDuplicates(["__node"])
    return found.unionByName(lone.join(members.filter("doc_id is null"), F.col("__node") == F.col("node")).drop("doc_id", "__node"))


def _tasks(rows: DataFrame, n: int, block: int, *forest: str) -> DataFrame:
    """Rows (node, blocks, ...) dealt to tasks (task, i, j), each with its side of a pair of blocks.  A forest of one
    block meets itself, in a task with other small forests."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*forest), F.lit(max(1, math.ceil(n / block))))).otherwise(F.xxhash64(*forest, "i", "j"))
    return rows.withColumn("task", task).drop("blocks", "own", "other")


def _members(forest: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    sizes = forest.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return written(forest.join(sizes, "component").join(reps, "node").select("doc_id", "node", "copies", F.col("component").alias("forest"), "blocks"), "members")


def refined(docs: DataFrame, large: DataFrame, star: DataFrame, size: int, num: int, den: int, block: int) -> DataFrame:
    """(node, component) of the members (doc_id, node) of large forests, from the stars (a, b) of their pivots."""
    signs = signature_table(_texts(docs, large.select("doc_id", "node"), size), size, num, den)
    most = star.groupBy("a").agg(F.ceil((F.count("*") + 1) / block).cast("int").alias("blocks"))
    hot = most.filter("blocks > 1").withColumnRenamed("a", "forest")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    own = star.select(F.col("a").alias("forest"), F.col("b").alias("node")).union(star.select(F.col("a").alias("forest"), F.col("a").alias("node")).distinct())
    rows = own.join(hot, "forest", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(signs, "node")
    dealt = _tasks(rows, star.count(), block * 4, "forest", "bits")
    return components(dealt.groupBy("task", "i", "j").applyInPandas(star_links(num, den), "a long, b long"))


def jaccard_links(docs: DataFrame, sets: DataFrame, size: int, num: int, den: int, block: int = BLOCK, every: bool = False) -> DataFrame:
    """Links (a, b, null) between set hashes that join just the sets which a chain of similarities num/den joins; with
    every, also (a, null, n_links) of each task, to be summed by a: the rows of the other sets similar to set a."""
    keys = sets.select(F.explode("keys").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    shared = written(shared, "keys")
    star = passed_keys(sets, key_filter(shared)).join(shared, "key").filter("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    star = written(star.distinct(), "stars")
    reps = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("copies"))
    members = _members(components(star), reps, block)
    large = members.filter("blocks > 1")
    finer = _members(refined(docs, large, star, size, num, den, block), reps, block)
    members = members.filter("blocks = 1").unionByName(finer)
    dealt = _tasks(_texts(docs, members, size), members.count(), block, "forest")
    return dealt.groupBy("task", "i", "j").applyInPandas(forest_links(size, num, den, every), "a long, b long, n_links long")


def _groups(docs: DataFrame, size: int, num: int, den: int, block: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The sets (doc_id, node, n_shingles) of all rows, and (node, component, component_id[, n_links]) of the sets that
    more than one row has or that link with others."""
    sets = written(set_table(docs, size, num, den), "sets")
    links = jaccard_links(docs, sets, size, num, den, block, every)
    if every:
        links = written(links, "links")
    label = components(links.filter("b is not null").select("a", "b"))
    reps = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.count("doc_id").alias("copies"))
    joined = reps.join(label, "node", "left").filter("component is not null or rows > 1")
    if every:
        joined = joined.join(links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links")), "node", "left")
        joined = joined.withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    joined = joined.select("node", "least", F.coalesce("component", "node").alias("component"), *(["n_links"] if every else []))
    joined = written(joined, "groups")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return sets.drop("keys"), joined.join(least, "component").drop("least")


def near_duplicate_components(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, block: int = BLOCK, every: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the least doc_id that links of similarity num/den reach; with
    every, also n_links, the number of other rows that the row links with."""
    sets, found = _groups(docs, size, num, den, block, every)
    out = sets.join(found.drop("component"), "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if not every:
        return out.select("doc_id", "n_shingles", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group of near copies, and one row of each group without a
    doc_id; all their columns (the names __node, __n, __least, __component and __gone are reserved).  An empty table gives
    an empty result."""
    sets, found = _groups(docs, size, num, den, block, False)
    found = written(found, "found")
    gone = sets.join(found, "node").filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = written(gone, "gone")
    named = docs.filter("doc_id is not null").join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    group = found.select(F.col("node").alias("__n"), F.col("component").alias("__component"), F.col("component_id").alias("__least"))
    lone = nodes_of(docs.filter("doc_id is null"), size).join(group, F.col("__node") == F.col("__n"), "left")
    kept = lone.filter("__n is null").unionByName(lone.filter("__n is not null and __least is null").dropDuplicates(["__component"]))
    return named.unionByName(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, with the number of links."""
    return near_duplicate_components(documents(spark, sf_dir), size=3, num=9, den=10, every=True)


QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLE: dict[str, str] = {}
