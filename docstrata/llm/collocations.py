"""Phrase collocation mining by dynamic itemset counting.

1. Texts are lower-cased (A-Z), cut into pieces and words, and written once as 64-bit word hashes, a block of texts of one
   lang a row, dealt to ``shards``.
2. The shards are scanned one a step, in a cycle.  A step counts phrases of all lengths at once: words from the first
   step on, a longer phrase from the step after both its subphrases (without its last, without its first word) have been
   counted ``threshold`` times, in a full cycle of steps.  Then its count is exact, and it is frequent or let go.  The
   scans end when no phrase's cycle is open.
   A task knows subphrases by a table of ``2 ** SLOTS`` bytes, which says in which step a phrase of that slot reached the
   threshold.  Its size is fixed and it is all that is broadcast.  Phrases that share a slot with a frequent one may be
   counted too early, or a shard twice: a phrase's counted shards are kept with it, each counts once, and each is counted
   before its cycle ends, so the table changes work and no result.
   Counts are pre-aggregated in each task and grouped by phrase, so a frequent phrase is a row a task, not one an occurrence.
3. One pass over the texts names the frequent phrases.  Should two phrases share a 64-bit hash, their exact counts of
   this pass tell them apart.
4. Each phrase joins the counts of both parts of each cut (salted), takes the lowest score in exact decimals, and goes if
   a phrase one word longer around it is as frequent; by then no still longer one can be more frequent.

Cases: null text is empty; null lang is ``und``; texts without words have no phrases; repeated rows count again; a piece of
any length is read whole; ties go to the shorter first part, and the ranks to more occurrences, then to the phrase in the
order of its bytes; doc_id and other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, U64, documents, emptied, map_batches, mix, shared_path, utf8_rows, word_hashes, written

SHARDS = 3
SLOTS = 24
SEGMENT = 16  # bits of a slot's number within its segment of the table
KEYS = 1 << 21  # phrases that a task gathers before it counts them
TEXT_BYTES = 1 << 20  # of texts that are hashed at once
SALTS, PARTS = 8, 64
WORD, GAP, BREAK = 0, 1, 2
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK


def words_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes to their lower-cased bytes, starts, ends and hashes of all words, and whether a word begins a piece."""
    sizes = np.array([len(r) + 1 for r in rows], dtype=np.int64)
    buf = np.full(int(sizes.sum()) + 1, 10, dtype=np.uint8)
    at = np.concatenate(([1], 1 + np.cumsum(sizes)))
    for i, r in enumerate(rows):
        buf[at[i] : at[i] + len(r)] = r
    buf = LOWER[buf]
    kind = KIND[buf]
    step = np.diff((kind == WORD).astype(np.int8))
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    breaks = np.cumsum(kind == BREAK)
    return buf, starts, ends, np.maximum(word_hashes(buf, starts, ends), U64(1)), np.diff(breaks[starts], prepend=-1) != 0


def groups(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, list[np.ndarray]]]:
    """Rows of (lang, text) in runs of some bytes: the langs, the lang's number of each row, the texts."""
    langs = batch.column(0).dictionary_encode()
    names, codes, held, size, first = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False), [], 0, 0
    for i, text in enumerate(utf8_rows(batch.column(1))):
        held.append(text if text is not None else np.zeros(0, np.uint8))
        size += len(held[-1])
        if size >= TEXT_BYTES or i + 1 == batch.num_rows:
            yield names, codes[first : i + 1], held
            held, size, first = [], 0, i + 1


def _row_of(rows: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """The row of each word of ``words_of``."""
    at = np.cumsum([1, *(len(r) + 1 for r in rows)])
    return np.searchsorted(at, starts, side="right") - 1


def _encode(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for names, codes, rows in groups(batch):
                _, starts, _, hashes, begins = words_of(rows)
                of = codes[_row_of(rows, starts)]
                for code in np.unique(of).tolist():
                    mine = np.flatnonzero(of == code)
                    own = np.insert(hashes[mine], np.flatnonzero(begins[mine]), U64(0))  # a zero in front of each piece
                    yield pa.record_batch([pa.array([names[code]], pa.string()), pa.array([len(mine)], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([turn % shards], pa.int32())], ["lang", "n", "words", "shard"])
                    turn += 1

    return run


def encoded(docs: DataFrame, shards: int, path: str | None = None) -> DataFrame:
    """docs (lang, text) as written blocks (lang, n words, words, shard): a hash a word, and 0 in front of a piece."""
    path = path or shared_path(docs.sparkSession, "phrases")
    schema = "lang string, n long, words binary, shard int"
    rows = map_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), _encode(shards), schema)
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def lang_seed(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]))[0]


class Slots:
    """The table of steps: 0, or one more than the latest step in which a phrase of the slot reached the threshold."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(1 << bits, dtype=np.uint8)

    def packed(self) -> bytes:
        return zlib.compress(self.table.tobytes(), 1)

    @staticmethod
    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def levels(words: np.ndarray, lang: str, table: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (length, the phrases' hashes, where they begin, the step from which they are to be counted), of
    all words and of the longer phrases whose subphrases are in the table."""
    mask = U64(len(table) - 1)
    at = np.flatnonzero(words)
    key = mix(words[at] + lang_seed(lang))
    begin = np.zeros(len(at), dtype=np.uint8)
    for length in range(1, longest + 1):
        yield length, key, at, begin
        if length == longest or not len(at):
            return
        step = table[key & mask]
        known = np.flatnonzero(step)
        at, key, step = at[known], key[known], step[known]
        pair = np.flatnonzero(at[1:] == at[:-1] + 1)
        begin = np.maximum(step[pair], step[pair + 1])
        at = at[pair]
        key = mix(key[pair] * U64(0x9E3779B97F4A7C15) + words[at + length])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _scan(data: bytes, step: int, shards: int, longest: int):
    """Blocks to (key, n, tag) of the phrases that are counted in a step; tag is 8 times the last step of a phrase's cycle
    and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = Slots.unpacked(data), {}, 0

        def told() -> Iterator[pa.RecordBatch]:
            for tag, parts in held.items():
                key, n = counted(np.concatenate(parts))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.full(len(key), tag, np.int32))], ["key", "n", "tag"])
            held.clear()

        for batch in batches:
            for lang, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(words.as_py(), dtype=U64)
                for length, key, _, begin in levels(found, lang, table, longest):
                    if length == 1 and step >= shards:
                        continue
                    last = begin.astype(np.int32) + shards - 1
                    for end in np.unique(last[last >= step]).tolist():
                        part = key[last == end]
                        held.setdefault(8 * end + length, []).append(part)
                        size += len(part)
                if size >= KEYS:
                    yield from told()
                    size = 0
        yield from told()

    return run


COUNTS = "key long, n long, tag int, seen int, found int"


def _step(old: DataFrame | None, fresh: DataFrame, step: int, shard: int, threshold: int) -> DataFrame:
    """The counts after a step.  A shard that a phrase has been counted in is not counted again."""
    none = F.lit(0).cast("long")
    rows = fresh.select("key", none.alias("n"), F.col("n").alias("new"), "tag", F.lit(0).alias("seen"), F.lit(0).alias("found"))
    if old is not None:
        rows = rows.unionByName(old.select("key", "n", none.alias("new"), "tag", "seen", "found"))
    rows = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum("new").alias("new"), F.max("tag").alias("tag"), F.max("seen").alias("seen"), F.max("found").alias("found"))
    bit = F.lit(1 << shard)
    rows = rows.withColumn("n", F.col("n") + F.when(F.col("seen").bitwiseAND(bit) == 0, F.col("new")).otherwise(0))
    rows = rows.withColumn("seen", F.when(F.col("new") > 0, F.col("seen").bitwiseOR(bit)).otherwise(F.col("seen")))
    rows = rows.withColumn("found", F.when((F.col("found") == 0) & (F.col("n") >= threshold), step + 1).otherwise(F.col("found")))
    return rows.filter((F.col("found") > 0) | (F.shiftright("tag", 3) > step)).select("key", "n", "tag", "seen", "found")


def _segment(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, lengths, slots in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                there = np.zeros(1 << bits, dtype=bool)
                there[slots] = True
                yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([lengths], pa.int32()), pa.array([np.packbits(there).tobytes()], pa.binary())], ["segment", "lengths", "there"])

    return run


def _mark(slots: Slots, counts: DataFrame, step: int) -> int:
    """Enters the phrases that reached the threshold in a step; returns their lengths as bits.  The driver gets one bit a
    slot, however many they are."""
    low = min(SEGMENT, slots.bits)
    slot = F.col("key").bitwiseAND(F.lit((1 << slots.bits) - 1))
    rows = counts.filter(F.col("found") == step + 1).select(F.shiftright(slot, low).cast("int").alias("segment"), slot.bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1), F.col("tag") % 8).alias("length"))
    rows = rows.groupBy("segment").agg(F.bit_or("length").alias("lengths"), F.collect_set("slot").alias("slots"))  # at most 2 ** SEGMENT slots
    lengths = 0
    for r in rows.mapInArrow(_segment(low), "segment int, lengths int, there binary").collect():
        there = np.flatnonzero(np.unpackbits(np.frombuffer(r["there"], np.uint8), count=1 << low))
        slots.table[(r["segment"] << low) + there] = step + 1
        lengths |= r["lengths"]
    return lengths


def frequent(blocks: DataFrame, threshold: int, longest: int, shards: int, slots: int) -> tuple[DataFrame, Slots]:
    """The exact counts (key, n) of all phrases that are there threshold times, and the table of steps."""
    spark, table, counts, step = blocks.sparkSession, Slots(slots), None, 0
    spent: list[str] = []
    begun = dict.fromkeys(range(1, longest), -shards)  # the latest step from which phrases with such a subphrase are counted
    while step < shards or any(step < begin + shards for begin in begun.values()):
        shard = step % shards
        rows = blocks.filter(F.col("shard") == shard).select("lang", "words")
        fresh = map_batches(rows, _scan(table.packed(), step, shards, longest), "key long, n long, tag int")
        path = shared_path(spark, "phrase-counts")
        _step(counts, fresh, step, shard, threshold).write.parquet(path)
        emptied(spark, spent)
        spent.append(path)
        counts = spark.read.schema(COUNTS).parquet(path)
        lengths = _mark(table, counts, step)
        for length in begun:
            if lengths >> length & 1:
                begun[length] = step + 1
        step += 1
    return counts.filter("found > 0").select("key", "n"), table


def _names(data: bytes, longest: int):
    """Texts to (lang, length, key, phrase, n) of the phrases that are in the table, a row for each in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Slots.unpacked(data)
        mask = U64(len(table) - 1)
        for batch in batches:
            for names, codes, rows in groups(batch):
                buf, starts, ends, hashes, begins = words_of(rows)
                of = codes[_row_of(rows, starts)]
                text = buf.tobytes()
                for code in np.unique(of).tolist():
                    mine = np.flatnonzero(of == code)
                    gaps = np.flatnonzero(begins[mine])
                    own, index = np.insert(hashes[mine], gaps, U64(0)), np.insert(mine, gaps, 0)
                    for length, key, at, _ in levels(own, names[code], table, longest):
                        there = np.flatnonzero(table[key & mask])
                        key, first, n = np.unique(key[there], return_index=True, return_counts=True)
                        if not len(key):
                            continue
                        from_ = index[at[there[first]]]
                        parts = [[text[a:b] for a, b in zip(starts[from_ + j].tolist(), ends[from_ + j].tolist(), strict=True)] for j in range(length)]
                        phrases = [b" ".join(p).decode() for p in zip(*parts, strict=True)]
                        same = [pa.array([names[code]] * len(key), pa.string()), pa.array(np.full(len(key), length, np.int32))]
                        yield pa.record_batch([*same, pa.array(key.view(np.int64)), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["lang", "length", "key", "phrase", "n"])

    return run


def named(docs: DataFrame, counts: DataFrame, table: Slots, threshold: int, longest: int) -> DataFrame:
    """(lang, length, phrase, a) of the frequent phrases."""
    rows = map_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), _names(table.packed(), longest), "lang string, length int, key long, phrase string, n long")
    names = rows.groupBy("key", "lang", "length", "phrase").agg(F.sum("n").alias("exact"))
    alone = F.count("*").over(W.partitionBy("key")) == 1
    both = names.join(counts.select("key", "n"), "key").withColumn("a", F.when(alone, F.col("n")).otherwise(F.col("exact")))
    return both.filter(F.col("a") >= threshold).select("lang", "length", "phrase", "a")


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)); the products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(17,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (lang, length, phrase, a) of two or more words with n, l, r and score of their lowest-scoring cut."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    words = F.split("phrase", " ")
    cuts = phrases.filter("length > 1").withColumn("salt", salt).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "length", "phrase", "a", "salt", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("length")), " ").alias("rest"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count)).withColumn("salt", salts)
    rows = cuts.join(part("first", "l"), ["lang", "first", "salt"]).join(part("rest", "r"), ["lang", "rest", "salt"])
    rows = rows.join(totals.withColumn("salt", salts), ["lang", "salt"])
    rows = rows.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = rows.groupBy("lang", "phrase", "length", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "length", "a", "best.l", "best.r", "n", "best.score")


def uncovered(candidates: DataFrame, cover: int) -> DataFrame:
    """candidates without those that a longer one around them is ``cover`` percent as frequent as.  The one that is one
    word longer is at least as frequent as any longer still, so it decides."""
    words = F.split("phrase", " ")
    n = F.col("length")
    inner = F.array(F.array_join(F.slice(words, F.lit(1), n - 1), " "), F.array_join(F.slice(words, F.lit(2), n - 1), " "))
    around = candidates.filter("length > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("__around"))
    most = around.groupBy("lang", "phrase").agg(F.max("__around").alias("__around"))
    kept = F.coalesce(100 * F.col("__around") < cover * F.col("a"), F.lit(True))
    return candidates.join(most, ["lang", "phrase"], "left").filter(kept).drop("__around")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each lang, with rank.  A lang's rows are first cut down in parts, so none is sorted whole."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000, cover: int = 100, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The first ``top`` collocations of each lang: lang, rank, phrase, a, l, r, n, score."""
    if not (1 <= shards <= 30 and 2 <= longest <= 7 and shards * longest < 255):
        raise ValueError("1 to 30 shards, and phrases of 2 to 7 words")
    path = shared_path(docs.sparkSession, "phrases")
    blocks = encoded(docs, shards, path)
    counts, table = frequent(blocks, threshold, longest, shards, slots)
    phrases = written(named(docs, counts, table, threshold, longest), "phrases-named")
    totals = written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    emptied(docs.sparkSession, [path])
    rows = ranked(uncovered(scored(phrases, totals), cover), top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir).select("lang", "text"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE = {
    "op11_collocations": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(ws) >= k)),
total as (select lang, sum(len(ws))::bigint as n from w group by 1),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 100),
cut as (select f.*, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') as x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') as y from (select *, unnest(range(1, k)) as c from f where k > 1) f),
s as (select cut.lang, cut.k, cut.phrase, cut.a, c, fx.a as l, fy.a as r, n, ((1000::hugeint * cut.a * n) // (fx.a::hugeint * fy.a))::bigint as score
  from cut join f fx on fx.lang = cut.lang and fx.phrase = x join f fy on fy.lang = cut.lang and fy.phrase = y join total on total.lang = cut.lang),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, c) as q from s) where q = 1),
kept as (select * from best b where not exists (select 1 from best o where o.lang = b.lang and o.k > b.k and contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') and 100 * o.a >= 100 * b.a))
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept) where rank <= 2000"""
}
