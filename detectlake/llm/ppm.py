"""Language-model scores by prediction by partial matching (PPM) over bytes.

A trie of byte contexts up to ``order`` is counted over all training documents, shorter contexts by update
exclusion: a byte counts once for each longer context in which it was seen. A byte unseen in a context
escapes to the next shorter one (method D: a distinct byte gives half a count to the escape), where bytes of
the longer context are excluded. A longer context's bytes are a subset of its suffix's, so that one number
for each context, the count its bytes have in its suffix, is all that exclusion needs: probabilities are
joins and aggregates of count tables.

Documents are dealt into chunks of bounded size. A chunk lists its distinct grams (context and byte) and
words; the tables answer these, and only the answers go back to the chunk. So nothing is broadcast and no
task holds the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, materialise, table, text_slices, word_hashes

ORDER = 5
#: Symbols are bytes and one end of text, in nine bits below the context's bytes.
END, SYMBOL_BITS, SYMBOLS = 256, 9, 257
CHUNK_BYTES = 40 << 20
#: Word keys have the sign bit of a long, gram keys haven't.
WORD_BIT = np.uint64(1 << 63)


def gram_runs(data: np.ndarray, starts: np.ndarray, order: int, run: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the grams of joined texts, and the text each is in, in runs of bounded length.

    Every byte and every end of text gives one gram; a text's first contexts are filled up with zero bytes.
    """
    texts, lengths = len(starts) - 1, np.diff(starts)
    stride = order + 1
    symbols = np.zeros(len(data) + texts * stride, np.uint16)
    of = np.full(len(symbols), -1, np.int32)
    place = np.arange(len(data)) + np.repeat(np.arange(texts) * stride + order, lengths)
    symbols[place], of[place] = data, np.repeat(np.arange(texts, dtype=np.int32), lengths)
    ends = starts[1:] + np.arange(texts) * stride + order
    symbols[ends], of[ends] = END, np.arange(texts)
    for low in range(order, len(symbols), run):
        high = min(low + run, len(symbols))
        keys = np.zeros(high - low, np.uint64)
        for back in range(order, 0, -1):
            keys = (keys << np.uint64(8)) | (symbols[low - back : high - back] & 255)
        keys = (keys << np.uint64(SYMBOL_BITS)) | symbols[low:high]
        real = of[low:high] >= 0
        yield keys[real], of[low:high][real]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of several lists of both."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


class Counter:
    """Distinct keys with counts, merged whenever the unmerged lists outgrow the merged one."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]

    def add(self, keys: np.ndarray, learn: np.ndarray) -> None:
        """Keys with whether each of them counts; one that doesn't is listed with 0."""
        for part, counts in ((keys[learn], True), (keys[~learn], False)):
            found, n = np.unique(part, return_counts=True)
            self.parts.append((found, n if counts else np.zeros(len(found), np.int64)))
        if sum(len(p[0]) for p in self.parts[1:]) > max(1 << 19, len(self.parts[0][0])):
            self.parts = [merged(self.parts)]


class Lookup:
    """Values by key in an open-addressed table over arrays; every key asked for must be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        slot, at, wait = np.full(1 << bits, -1, np.int32), self._first(keys), np.arange(len(keys), dtype=np.int32)
        while len(wait):
            free = wait[slot[at[wait]] < 0]
            slot[at[free]] = free
            wait = wait[slot[at[wait]] != wait]
            at[wait] = (at[wait] + 1) & self.mask
        self.slot = slot

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        found = self.slot[at]
        wrong = np.flatnonzero((found < 0) | (self.keys[found] != keys)) if len(self.keys) else np.arange(len(keys))
        while len(wrong):
            if (found[wrong] < 0).any():
                raise KeyError("a gram or word that its chunk didn't list")
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slot[at[wrong]]
            wrong = wrong[(found[wrong] < 0) | (self.keys[found[wrong]] != keys[wrong])]
        return self.values[found]


def runs_of(texts: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``text_slices`` over small parts of a column, so that only these are copied; number of the first text in the column."""
    base = 0
    for part in texts.chunks:
        for low in range(0, len(part), 512):
            for first, data, starts in text_slices(part.slice(low, 512)):
                yield base + low + first, data, starts
        base += len(part)


def chunk_counts(docs: DataFrame, order: int) -> DataFrame:
    """(chunk, key, n): each chunk's distinct grams and words, n counting those of training documents."""

    def count(group: pa.Table) -> pa.Table:
        listed, learn = Counter(), group["learn"].to_numpy()
        for first, data, starts in runs_of(group["text"]):
            own = learn[first : first + len(starts) - 1]
            for keys, of in gram_runs(data, starts, order):
                listed.add(keys, own[of])
            hashes, of = word_hashes(data, starts[:-1])
            listed.add(hashes | WORD_BIT, own[of])
        keys, counts = merged(listed.parts)
        chunk = group["chunk"][0].as_py() if len(group) else 0
        return pa.table({"chunk": pa.array(np.full(len(keys), chunk, np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    return docs.select("chunk", "learn", "text").groupBy("chunk").applyInArrow(count, "chunk int, key long, n long")


def context(key: Column, order: int) -> Column:
    """The key of the context of a gram in its last ``order`` bytes."""
    return F.shiftright(gram(key, order), SYMBOL_BITS)


def gram(key: Column, order: int) -> Column:
    """The key of a gram cut to the last ``order`` bytes of its context."""
    return key.bitwiseAND(F.lit((1 << (8 * order + SYMBOL_BITS)) - 1))


def gram_scores(asked: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(key, value): log10 probability of each gram asked for.

    ``counts`` has (key, n) of the training grams of full order; shorter orders are counted from it.
    """
    scored, level = asked, counts
    for k in range(order, -1, -1):
        shorter = level.groupBy(gram(F.col("key"), k - 1).alias("key")).agg(F.count(F.lit(1)).alias("n")) if k else None
        if k:
            shorter = materialise(shorter, f"order{k - 1}")
            inner = level.withColumn("short", gram(F.col("key"), k - 1)).join(shorter.select(F.col("key").alias("short"), F.col("n").alias("under")), "short")
        else:
            inner = level.withColumn("under", F.lit(0).cast("long"))
        # of each context: occurrences, distinct symbols, and what these symbols count in the next shorter one
        nodes = inner.groupBy(context(F.col("key"), k).alias("node")).agg(F.sum("n").alias(f"t{k}"), F.count(F.lit(1)).alias(f"q{k}"), F.sum("under").alias(f"x{k}"))
        scored = scored.withColumns({"cut": gram(F.col("key"), k), "node": context(F.col("key"), k)})
        scored = scored.join(level.select(F.col("key").alias("cut"), F.col("n").alias(f"n{k}")), "cut", "left").drop("cut")
        scored = scored.join(nodes, "node", "left").drop("node")
        level = shorter
    of = lambda c, k: F.coalesce(F.col(f"{c}{k}"), F.lit(0)) if k <= order else F.lit(0)
    value = -F.log10(F.greatest(F.lit(SYMBOLS) - of("q", 0), F.lit(1)).cast("double"))
    for k in range(order + 1):
        total = (of("t", k) - of("x", k + 1)).cast("double")
        kinds = (of("q", k) - of("q", k + 1)).cast("double")
        escape = F.when(kinds > 0, F.log10(kinds / (2 * total))).otherwise(F.lit(0.0))
        value = F.when(of("n", k) > 0, F.log10((of("n", k) - 0.5) / total)).otherwise(escape + value)
    return scored.select("key", value.alias("value"))


def score_documents(docs: DataFrame, learn: Column, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every document with a PPM model of the documents for which ``learn`` holds.

    Reads doc_id and text; A-Z is lower-cased. Returns doc_id, learn, n_tokens, n_known, train_tokens,
    base_score (words and one end a text, add-half smoothed) and score (log10 probability of the lower-cased
    bytes and the end). Null text counts as empty: it has the end alone. Rows are dealt to chunks by a hash
    of id and text, so no source or id gathers in one task. Without training documents every gram is equally
    likely. An empty table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(size / chunk_bytes))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        learn.alias("learn"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    listed = materialise(chunk_counts(rows, order), "grams")
    counts = materialise(listed.where(F.col("n") > 0).groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where(F.col("key") < 0)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # one end a training document: the gram counts that end in it
    ends = counts.where((F.col("key") >= 0) & (F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1)) == END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, below = tokens + ends, tokens + ends + 0.5 * (distinct + (ends > 0) + 1)
    asked = listed.where(F.col("key") >= 0).select("key").distinct()
    values = gram_scores(asked, counts.where(F.col("key") >= 0), order).unionByName(words.select("key", F.col("n").cast("double").alias("value")))
    values = materialise(values, "values")
    answers = listed.select("chunk", "key").join(values, "key", "left").select("chunk", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    end_score = math.log10((ends + 0.5) / below)

    def score(group: pa.Table, answer: pa.Table) -> pa.Table:
        look = Lookup(answer["key"].to_numpy().view(np.uint64), answer["value"].to_numpy())
        sums, known, length, base = [], [], [], []
        for _, data, starts in runs_of(group["text"]):
            n = len(starts) - 1
            total_log = np.zeros(n)
            for keys, of in gram_runs(data, starts, order):
                total_log += np.bincount(of, look(keys), n)
            hashes, of = word_hashes(data, starts[:-1])
            count = look(hashes | WORD_BIT) if len(hashes) else np.empty(0)
            sums.append(total_log)
            length.append(np.bincount(of, minlength=n) + 1)
            known.append(np.bincount(of, count > 0, n).astype(np.int64) + (ends > 0))
            base.append(np.bincount(of, np.log10((count + 0.5) / below), n) + end_score)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        return pa.table({"doc_id": group["doc_id"], "learn": group["learn"], "n_tokens": join(length, np.int64), "n_known": join(known, np.int64), "train_tokens": np.full(len(group), total, np.int64), "base_score": join(base, float), "score": join(sums, float)})

    schema = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) != 1)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
