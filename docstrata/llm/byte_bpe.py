"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of at most ``chunk`` code points is one chunk.  A longer one is cut into chunks that overlap; the chunks are
dealt to all tasks, and pre-tokenised and merged by rank there.  A chunk's boundary is sure if the match before it ended
short of the chunk's end.  What the pattern matches from a boundary on depends only on the text from there on, so two
neighbours agree after the first boundary that both have in their overlap, if it is sure in the first: that is where
their ids are stitched.  Where two neighbours never resynchronise (a run of letters longer than the overlap), that text
is encoded as one chunk.  Batches are bounded by bytes, and a text's chunks and ids are put together in one row.

Decoding looks up each id's bytes and concatenates them; the result need not be valid UTF-8 for a part of a text.

Cases: null text is empty and has no ids; repeated rows give repeated results; null doc_id and other columns are
carried along (a column ``ids`` or ``decoded`` of the caller's is replaced); an id outside the vocabulary, or null in
``ids``, raises; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, map_batches, written

CHUNK = 32_768
OVERLAP = 2_048
CACHED = 100_000
ROWS = 256
KEY, OF = "__bpe_key", "__bpe_of"

_coders: dict[str, Coder] = {}


class Coder:
    """Pre-tokenises, merges by rank and decodes.  Merges of pieces met before are kept, up to a bound."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known: dict[str, bytes] = {}

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, pieces: list[str]) -> bytes:
        """The ids of the pieces, as the bytes of 32-bit integers."""
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            out = []
            for piece in pieces:
                found = known.get(piece)
                if found is None:
                    found = np.array(self.merge(piece), dtype=np.int32).tobytes()
                    if len(piece) <= 64:
                        if len(known) >= CACHED:
                            known.clear()
                        known[piece] = found
                out.append(found)
            return b"".join(out)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        if ids.min() < 0 or ids.max() >= len(self.size):
            raise ValueError("an id is outside the vocabulary")
        size = self.size[ids]
        shift = self.at[ids] - np.concatenate(([0], np.cumsum(size)[:-1]))
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


def id_arrays(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def coder(vocabulary: bytes, pattern: str) -> Coder:
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders[key] = Coder(vocabulary, pattern)
    return _coders[key]


def read_vocabulary(path: str) -> bytes:
    """The rank file, read where the job is started; tasks get its bytes, not its path."""
    with open(path, "rb") as f:
        return f.read()


def _chunks(size: int, overlap: int):
    """Rows (key, text) to overlapping chunks (key, no, start, last, part), one batch a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), size)
                parts = [text[i:] if i == starts[-1] else text[i : i + size + overlap] for i in starts]
                n = len(parts)
                yield pa.record_batch([pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(starts, pa.int32()), pa.array([i == n - 1 for i in range(n)]), pa.array(parts, pa.string())], ["key", "no", "start", "last", "part"])

    return run


def _encode_chunks(vocabulary: bytes, pattern: str, overlap: int):
    """Chunks to (key, no, last, ids, heads, tails).  heads and tails are the boundaries (at, n) in the first and last
    ``overlap`` code points, with n ids of the chunk before each; of the tails only the sure ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        for batch in batches:
            for key, no, start, last, part in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                part = part.as_py()
                ends = [0, *own.boundaries(part)]
                pieces = [own.encode([part[i:j]]) for i, j in zip(ends, ends[1:], strict=False)]
                before = np.concatenate(([0], np.cumsum([len(p) // 4 for p in pieces]))).tolist()
                heads = [{"at": start + e, "n": n} for e, n in zip(ends, before, strict=True) if e <= overlap] if no else [{"at": 0, "n": 0}]
                tails = [] if last else [{"at": start + e, "n": n} for e, n in zip(ends, before, strict=True) if len(part) - overlap <= e < len(part) - 1]
                where = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
                yield pa.record_batch([pa.array([key]), pa.array([no], pa.int32()), pa.array([last]), id_arrays([b"".join(pieces)]), pa.array([heads], where), pa.array([tails], where)], ["key", "no", "last", "ids", "heads", "tails"])

    return run


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_text: bool = True) -> DataFrame:
    """docs with a column ``ids`` (array of int) in place of any there, and without the text unless it is kept."""
    docs = docs.drop("ids")
    names = [n for n in docs.columns if keep_text or n != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names) + ", ids array<int>"
    text_at = docs.columns.index("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [own.encode(own.pattern.findall(t)) if (t := x.as_py()) else b"" for x in part.column(text_at)]
                yield pa.record_batch([*(c for n, c in zip(docs_names, part.columns, strict=True) if n in names), id_arrays(ids)], [*names, "ids"])

    docs_names = docs.columns
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = map_batches(docs.filter(size <= chunk), whole, schema)
    # Written once with its key, so that every later read attaches the same key to the same text.
    long = written(docs.filter(size > chunk).withColumn(KEY, F.monotonically_increasing_id()), "long")
    parts = map_batches(long.select(F.col(KEY).alias("key"), "text"), _chunks(chunk, overlap), "key long, no int, start int, last boolean, part string")
    where = "array<struct<at:int,n:int>>"
    coded = map_batches(parts.repartition("key", "no"), _encode_chunks(vocabulary, pattern, overlap), f"key long, no int, last boolean, ids array<int>, heads {where}, tails {where}")
    # Neighbours are stitched at the first boundary that both have; n of the left chunk's ids lie before it.
    order = W.partitionBy("key").orderBy("no")
    stitched = coded.withColumn("to", F.array_min(F.array_intersect("tails.at", F.lead("heads.at").over(order))))
    stitched = stitched.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0))).withColumn("loose", F.max(F.col("to").isNull() & ~F.col("last")).over(W.partitionBy("key")))
    at = lambda side, c: F.get(F.filter(side, lambda x: x["at"] == F.col(c)), F.lit(0))["n"]
    first, end = F.coalesce(at("heads", "from"), F.lit(0)), F.coalesce(at("tails", "to"), F.size("ids"))
    spans = stitched.select("key", "no", "loose", F.slice("ids", first + 1, F.greatest(end - first, F.lit(0))).alias("ids"))
    texts = spans.groupBy("key").agg(F.max("loose").alias("loose"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("spans"))
    texts = written(texts.select("key", "loose", F.when(~F.col("loose"), F.flatten("spans.ids")).alias("ids")), "stitched")
    tight = long.join(texts.filter("not loose").select(F.col("key").alias(OF), "ids"), F.col(KEY) == F.col(OF)).select(*[F.col(f"`{n}`") for n in names], "ids")
    loose = long.join(texts.filter("loose").select(F.col("key").alias(OF)), F.col(KEY) == F.col(OF)).select(*[F.col(f"`{n}`") for n in docs_names])
    return short.unionByName(tight).unionByName(map_batches(loose, whole, schema))


def decode(rows: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """rows (any columns and ``ids``) with a binary column ``decoded``."""
    rows = rows.drop("decoded")
    names = rows.columns
    at = names.index("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = part.column(at)
                if ids.flatten().null_count:
                    raise ValueError("an id is null")
                values = ids.values.to_numpy(zero_copy_only=False)
                ends = ids.offsets.to_numpy()
                out = [own.decode(values[a:b] if there else values[:0]).tobytes() for a, b, there in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return map_batches(rows, run, schema)


def digests(docs: DataFrame, vocabulary: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, through encode and decode."""
    ids = encode(docs.select("doc_id", "text"), vocabulary, pattern, chunk, overlap, keep_text=False)
    return decode(ids, vocabulary, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *public_vocabulary())


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE: dict[str, str] = {}
