"""Problem 8: passages of evaluation items inside training text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, join_checked

#: Consecutive words that make a leak; a window has the size of the item's passage, but this at most, for a part of a passage leaks too.
WINDOW = 12
#: Items of fewer words have no window in the search for near leaks: they say too little.
LEAST_WORDS = 6
#: Steps of the random walk for each word of a window (3 in the embedding as published).
STEPS = 3
#: Independent walks, and symbols of the embedding that are sampled for the key of each, in the search for equal windows.
REPEATS, BITS = 3, 8
#: Symbols sampled in the search for near windows, and the steps for each word that they are sampled from: later steps often
#: stand behind the window, where all windows share the fixed symbol. The walks follow from the wanted recall.
NEAR_BITS, NEAR_STEPS = 4, 2
#: Share of the windows within MAX_EDITS edits of words that the walks of near leaks have to find.
RECALL, MAX_EDITS = 0.95, 3
#: Bits of the filter through which the keys of documents go before they are joined (8 MB, whatever the number of items).
FILTER_BITS = 1 << 26
#: Keys of items, two numbers each, up to which they are broadcast (the bytes are measured, too).
MAX_KEYS = 500_000
#: Windows walked at once, so that a step's columns stay in the cache of a core.
BLOCK_WINDOWS = 8192
SEED = 20240229


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _walk_keys(words: np.ndarray, starts: np.ndarray, repeats: int, bits: int, steps: int = STEPS, size: int = WINDOW) -> np.ndarray:
    """Keys (repeats x windows) of the windows of size words that begin at starts.

    The walk reads one symbol a step and goes on to the next word or stays, by a random bit of step and word; behind the
    window it reads a fixed symbol. Two windows within a small edit distance give outputs that differ in few symbols, so
    they share the symbols at randomly drawn places with high probability; equal windows always do.
    """
    keys = np.empty((repeats, len(starts)), dtype=np.int64)
    padded = np.append(words.astype(np.int64), 0).view(np.uint64)
    for k in range(repeats):
        rng = np.random.default_rng([SEED, size, k])
        sampled = set(rng.choice(steps * size, size=min(bits, steps * size), replace=False).tolist())
        multipliers = rng.integers(1, 1 << 62, size=steps * size, dtype=np.uint64) | np.uint64(1)
        for block in range(0, len(starts), BLOCK_WINDOWS):
            at = starts[block : block + BLOCK_WINDOWS].astype(np.int64)
            behind = at + size
            key = np.full(len(at), (SEED + k) * 97 + size, dtype=np.uint64)
            for j in range(max(sampled) + 1):
                symbol = padded.take(at)
                if j >= size:  # no walk is behind its window before
                    symbol *= at < behind
                if j in sampled:
                    key = (key ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                symbol *= multipliers[j]
                symbol >>= np.uint64(63)
                at += symbol.view(np.int64)
            keys[k, block : block + BLOCK_WINDOWS] = key.view(np.int64)
    return keys


@lru_cache(maxsize=64)
def walks_for(recall: float, max_edits: int, size: int, bits: int = NEAR_BITS, steps: int = NEAR_STEPS, trials: int = 2000) -> int:
    """Walks after which each kind of edits up to max_edits words is found with the wanted recall (below 1).

    Pairs of windows are drawn (trials of each kind and number of edits: replaced, replaced inside, left out with a word behind
    the window moving in) and walked until the wanted share has met. The share is counted by pairs, for pairs differ: where the
    first words are replaced, every walk is likely to part, so the mean chance of one walk would promise too much.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    rng = np.random.default_rng([SEED, size, max_edits])
    needed = 1
    for edits in range(1, max_edits + 1):
        for kind in ("replaced", "inside", "left out") if edits > 1 else ("replaced", "inside"):
            a = rng.integers(1, 1 << 62, size=(trials, 2 * size))
            b = a.copy()
            for row in b:
                if kind == "left out":
                    gone = rng.choice(size, edits // 2, replace=False)
                    row[: 2 * size - len(gone)] = np.delete(row, gone)
                else:
                    places = np.arange(1, size - 1) if kind == "inside" else size
                    row[rng.choice(places, edits, replace=False)] = rng.integers(1, 1 << 62, size=edits)
            flat, starts = np.concatenate([a.ravel(), b.ravel()]), np.arange(2 * trials) * 2 * size
            walks, found = 16, np.zeros(1)
            while found[-1] < recall:
                walks *= 2
                keys = _walk_keys(flat, starts, walks, bits, steps, size)
                found = np.maximum.accumulate(keys[:, :trials] == keys[:, trials:], axis=0).mean(axis=1)
            needed = max(needed, int(np.argmax(found >= recall)) + 1)
    return needed


def _windows(offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For word arrays laid end to end: the start of each whole window, and the row it belongs to."""
    sizes = np.maximum(np.diff(offsets) - size + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return offsets[:-1][row] + (np.arange(sizes.sum()) - first), row


def windows_with_keys(rows: DataFrame, key: str, plan: dict[int, int], bits: int, steps: int, wanted=None) -> DataFrame:
    """key, size, pos, win (word hashes) and lsh (the keys of the walks) of each window of the array column words.

    plan has the walks for each size of windows. With wanted, a broadcast filter, only keys that pass it, and only windows that have one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if wanted is None else wanted.value
        for batch in batches:
            column = batch.column("words")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for size, repeats in plan.items():
                starts, row = _windows(offsets, size)
                if not len(starts):
                    continue
                keys = _walk_keys(flat, starts, repeats, bits, steps, size)
                hit = np.ones(keys.shape, dtype=bool) if passes is None else _passing(keys, passes)
                some = np.flatnonzero(hit.any(axis=0))
                if not len(some):
                    continue
                hit, keys = hit[:, some].T, keys[:, some].T
                lsh = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hit.sum(axis=1))]), pa.int32()), pa.array(keys[hit]))
                win = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), pa.array(flat[starts[some][:, None] + np.arange(size)].ravel()))
                pos = pa.array((starts - offsets[:-1][row])[some].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row[some])), pa.array(np.full(len(some), size, dtype=np.int32)), pos, win, lsh], names=[key, "size", "pos", "win", "lsh"])

    return rows.select(key, "words").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, size int, pos int, win array<bigint>, lsh array<bigint>")


def _passing(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame):
    """A broadcast bitmap of the column lsh, FILTER_BITS long however many keys there are; Spark builds its pieces."""
    at = F.col("lsh").bitwiseAND(FILTER_BITS - 1)
    pieces = keys.select(F.shiftright(at, 15).alias("piece"), (at % 32768).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():
        bitmap[r.piece * 4096 : (r.piece + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def word_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The edit distance in words of each row of a (n x size) to the row of b."""
    n, size = a.shape
    before = np.broadcast_to(np.arange(size + 1, dtype=np.int16), (n, size + 1)).copy()
    for i in range(size):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        change = before[:, :-1] + (a[:, i : i + 1] != b)
        for j in range(1, size + 1):
            np.minimum(np.minimum(before[:, j], now[:, j - 1]) + 1, change[:, j - 1], out=now[:, j])
        before = now
    return before[:, -1]


def leaked_windows(documents: DataFrame, items: DataFrame, plan: dict[int, int], bits: int, steps: int, max_edits: int) -> DataFrame:
    """doc_id, doc_pos, item_id, item_pos, edits of the windows of documents and items that share a key and differ in up to max_edits words.

    plan has the walks for each size of windows. A window of a document is embedded in its task; only those whose keys pass the bounded filter leave
    it, to be joined with the items' windows (broadcast as far as their checked size allows). The edits of each candidate are
    verified in the batches that the join gives, where the hits of one window by several walks come together.
    """
    tokens = items.where("item_id is not null").select("item_id", word_hashes(F.col("passage")).alias("words"))
    sized = tokens.where(F.size("words") >= min(plan)).select("item_id", "words", F.least(F.size("words"), F.lit(max(plan))).alias("own"))
    of_items = windows_with_keys(sized, "item_id", plan, bits, steps).join(sized.select("item_id", "own").distinct(), "item_id").where("size = own")
    of_items = of_items.select("item_id", "size", F.col("pos").alias("item_pos"), F.col("win").alias("item_win"), "lsh", F.xxhash64("item_id", "size", "pos").alias("wid"))
    of_items = checkpointed(of_items.dropDuplicates(["wid"]))
    keys = checkpointed(of_items.select("wid", F.explode("lsh").alias("lsh")))
    doc_words = documents.select("doc_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= min(plan))
    hits = windows_with_keys(doc_words, "doc_id", plan, bits, steps, key_filter(keys)).withColumnsRenamed({"pos": "doc_pos", "win": "doc_win"})
    pairs = join_checked(hits.withColumn("lsh", F.explode("lsh")), keys, ["lsh"], "inner", MAX_KEYS, salt_by="doc_id")  # the size is part of a key
    pairs = join_checked(pairs, of_items.drop("lsh").withColumnRenamed("size", "item_size"), ["wid"], "inner", salt_by="doc_id").where("size = item_size")
    ids = {k: dict(pairs.dtypes)[k] for k in ("doc_id", "item_id")}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.stack([np.unique(batch.column(k).to_numpy(zero_copy_only=False), return_inverse=True)[1] for k in ("doc_id", "doc_pos", "item_id", "item_pos")])
            for size in plan:
                own = np.flatnonzero(batch.column("size").to_numpy() == size)
                if not len(own):
                    continue
                own = own[np.unique(where[:, own], axis=1, return_index=True)[1]]
                a, b = (batch.column(c).take(pa.array(own)).flatten().to_numpy().reshape(-1, size) for c in ("doc_win", "item_win"))
                edits = word_edits(a, b)
                kept = edits <= max_edits
                at = pa.array(own[kept])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("doc_id", "doc_pos", "item_id", "item_pos")] + [pa.array(edits[kept].astype(np.int32))], names=["doc_id", "doc_pos", "item_id", "item_pos", "edits"])

    return pairs.select("doc_id", "doc_pos", "doc_win", "item_id", "item_pos", "item_win", "size").mapInArrow(verify, f"doc_id {ids['doc_id']}, doc_pos int, item_id {ids['item_id']}, item_pos int, edits int")


def leaked_items(documents: DataFrame, items: DataFrame, repeats: int = REPEATS, bits: int = BITS) -> DataFrame:
    """doc_id, item_id where the document shares at least 12 consecutive words with the item's passage.

    Candidates share a key of the embedding; those whose verified edit distance is 0 stay. Null, empty and short texts give no
    rows, repeated documents and items each pair once, an empty table an empty result; other columns are ignored.
    """
    return leaked_windows(documents, items, {WINDOW: repeats}, bits, STEPS, 0).select("doc_id", "item_id").distinct()


def near_leaks(documents: DataFrame, items: DataFrame, max_edits: int = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edits: the least edit distance in words, up to max_edits, of a window of the document to one of the item.

    A window has the size of the item's passage, 12 words at most; passages of fewer than 6 words have none. A third of a window's
    words at most may differ. Of the windows within the bound the walks find the wanted share (README has the measured figures).
    """
    sizes = range(LEAST_WORDS, WINDOW + 1)
    asked = items.select(F.least(F.size(words_of(F.col("passage"))), F.lit(WINDOW)).alias("n")).where(F.col("n").between(LEAST_WORDS, WINDOW)).distinct()
    plan = {n: walks_for(recall, min(max_edits, n // 3), n) for n in sorted(r.n for r in asked.toLocalIterator())} or {sizes[-1]: 1}
    found = leaked_windows(documents, items, plan, NEAR_BITS, NEAR_STEPS, max_edits)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
