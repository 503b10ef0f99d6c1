"""Quality classifier: an interpolated modified Kneser-Ney model over characters, trained on trusted text.

N-grams of `ORDER` characters of all trusted documents are counted; lower orders count in how many longer n-grams they end.
Discounts come from the counts of counts, and joins of the sharded count tables, one order upon the other, give every n-gram its
interpolated probability and every context its weight for unseen characters. To score, documents are put into blocks of
bounded size; each block asks the sharded model once for its distinct n-grams, whatever the model's size, and the answer meets the block's texts
in one group. A document is rejected when its perplexity is above its language's limit, which lies `MARGIN` of the way (in logarithms) from the
trusted documents' high quantile to the untrusted documents' low quantile, and never below the former.

Cases: a null or empty text has no perplexity and is rejected; a null language is a language of its own; a language with fewer
than `LEAST` trusted documents (the model hardly knows its characters, so another language's limit says nothing about it) has no limit and loses only empty texts; repeated rows are scored
again; other columns are ignored; long texts are coded in one block of their own.

Block numbers come from the partition, so `docs` must give the same partitions when read twice, as a table in files does. A
block that does not get an answer for each of its n-grams fails the job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import keep, release_memory, small_batches

ORDER, WIDTH, CLASSES = 4, 15, (1 << 15) - 2
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 32_768
#: n-grams held before they are folded into distinct ones, and distinct ones before they are handed on
FOLD, HELD = 500_000, 1_500_000
TRUSTED_QUANTILE, UNTRUSTED_QUANTILE, MARGIN, LEAST = 0.999, 0.1, 0.5, 30
BROADCAST_IDS = 2_000_000
_BOS = (1 << WIDTH) - 1


def codes(text: str) -> np.ndarray:
    """One class (1 ... CLASSES) per character: its code point below 2**14, a hash above; ORDER - 1 beginning marks in front."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    rare = (1 << 14) + (points * 2_654_435_761 >> 7) % ((1 << 14) - 2)
    return np.concatenate([np.full(ORDER - 1, _BOS, np.int64), np.where(points < (1 << 14), np.maximum(points, 1), rare)])


def grams(text: str) -> np.ndarray:
    """The highest-order n-gram that ends at each character, packed."""
    c = codes(text)
    key = np.zeros(len(c) - ORDER + 1, np.int64)
    for k in range(ORDER):
        key = key << WIDTH | c[k : len(c) - ORDER + 1 + k]
    return key


def _suffix(key, order: int):
    return key & ((1 << WIDTH * order) - 1)


class _Counter:
    """Distinct n-grams and their counts, folded whenever much has been added."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.size += len(keys)
        if self.size >= FOLD:
            self.fold()

    def fold(self) -> None:
        k, n = np.unique(np.concatenate([*self.new, np.zeros(0, np.int64)]), return_counts=True)
        both, at = np.unique(np.concatenate([self.keys, k]), return_inverse=True)
        counts = np.zeros(len(both), np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, n]))
        self.keys, self.counts, self.new, self.size = both, counts, [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Counter()
    for b in batches:
        for t in b.column(0):
            if text := t.as_py():
                seen.add(grams(text))
        if len(seen.keys) > HELD:
            seen.fold()
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys), pa.array(seen.counts)], names=["key", "n"])
            seen = _Counter()
    seen.fold()
    yield pa.RecordBatch.from_arrays([pa.array(seen.keys), pa.array(seen.counts)], names=["key", "n"])
    release_memory()


def train(texts: DataFrame) -> DataFrame:
    """The model over the column `text`: key, logp (null where only a context), log_gamma (null where never a context)."""
    counts = keep(small_batches(texts.select("text")).mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = keep(orders[k + 1].groupBy(F.col("key").bitwiseAND((1 << WIDTH * k) - 1).alias("key"))
                         .agg(F.count("*").alias("n")), "counts")
    parts, below = [], None
    for k in range(1, ORDER + 1):
        ones = orders[k].agg(*[F.coalesce(F.sum((F.col("n") == c).cast("long")), F.lit(0)) for c in (1, 2, 3, 4)]).first()
        d = discounts(*ones)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = orders[k].select("key", F.shiftright("key", WIDTH).alias("ctx"), "n", cut.alias("cut"))
        ctx = rows.groupBy("ctx").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        rows = rows.join(ctx, "ctx")
        if below is None:
            lower = F.lit(1.0 / CLASSES)
        else:
            rows = rows.withColumn("low", F.col("key").bitwiseAND((1 << WIDTH * (k - 1)) - 1)).join(below.toDF("low", "p_low"), "low")
            lower = F.col("p_low")
        below = keep(rows.select("key", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * lower).alias("p")), "probabilities")
        parts.append(below.select("key", F.log("p").alias("logp"), F.lit(None).cast("double").alias("log_gamma")))
        parts.append(ctx.select(F.col("ctx").alias("key"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("log_gamma")))
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return keep(model.groupBy("key").agg(F.max("logp").alias("logp"), F.max("log_gamma").alias("log_gamma")), "model")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; 0.5, 1 and 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def needed(keys: np.ndarray) -> np.ndarray:
    """Distinct n-grams of every order and their contexts, ascending."""
    out = [np.zeros(1, np.int64)]
    for k in range(ORDER, 0, -1):
        keys = np.unique(_suffix(keys, k))
        out += [keys, keys >> WIDTH]
    return np.unique(np.concatenate(out))


def _blocks(want: str):
    """Rows of `want`: "keys" (block, key) or "texts" (block, payload, ids, langs, sizes, n_keys)."""

    def out(block, docs, keys):
        if want == "keys":
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["block", "key"])
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(d[2] for d in docs))
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.array([packed], pa.binary()), pa.array([[d[0] for d in docs]], pa.list_(pa.int64())),
            pa.array([[d[1] for d in docs]], pa.list_(pa.string())), pa.array([[len(d[2]) for d in docs]], pa.list_(pa.int64())),
            pa.array([len(keys)], pa.int64())], names=["block", "payload", "ids", "langs", "sizes", "n_keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, size, seen, new, waiting = TaskContext.get().partitionId() << 24, [], 0, np.zeros(1, np.int64), [], 0
        for b in batches:
            for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py() or ""
                docs.append((doc_id, lang, text.encode()))
                new.append(grams(text))
                size, waiting = size + len(text), waiting + len(text)
                if waiting >= FOLD:
                    seen, new, waiting = np.union1d(seen, np.concatenate(new)), [], 0
                if size >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                    yield out(block, docs, needed(np.union1d(seen, np.concatenate([*new, np.zeros(0, np.int64)]))[1:]))
                    block, docs, size, seen, new, waiting = block + 1, [], 0, np.zeros(1, np.int64), [], 0
        if docs:
            yield out(block, docs, needed(np.union1d(seen, np.concatenate([*new, np.zeros(0, np.int64)]))[1:]))
        release_memory()

    return run


def log_probability(text: str, keys: np.ndarray, logp: np.ndarray, log_gamma: np.ndarray) -> float:
    """Sum over the characters; `keys` ascending, NaN where the model has nothing."""
    full = grams(text)
    total, left = np.zeros(len(full)), np.arange(len(full))
    for k in range(ORDER, 0, -1):
        key = _suffix(full[left], k)
        p = logp[np.searchsorted(keys, key)]
        hit = ~np.isnan(p)
        total[left[hit]] += p[hit]
        left, key = left[~hit], key[~hit]
        total[left] += np.nan_to_num(log_gamma[np.searchsorted(keys, key >> WIDTH)])
    total[left] -= np.log(CLASSES)
    return float(total.sum())


_SCORE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("logp", pa.float64())])


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    rows = []
    if texts.num_rows:
        (row,) = texts.to_pylist()
        if row["n_keys"] != answers.num_rows:
            raise ValueError("a block's n-grams and its texts come from different partitions: write the documents to a table first")
        order = np.argsort(keys := answers.column("key").to_numpy())
        keys = keys[order]
        logp, log_gamma = (answers.column(c).to_numpy()[order].astype(float) for c in ("logp", "log_gamma"))
        raw, at = zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=sum(row["sizes"]) or 1), 0
        for doc_id, lang, size in zip(row["ids"], row["langs"], row["sizes"]):
            text = raw[at : at + size].decode()
            at += size
            rows.append((doc_id, lang, len(text), log_probability(text, keys, logp, log_gamma) if text else None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, _SCORE)], schema=_SCORE)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, logp (null for empty texts) of every row."""
    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"))
    asked = rows.mapInArrow(_blocks("keys"), "block long, key long").join(model, "key", "left")
    texts = rows.mapInArrow(_blocks("texts"), "block long, payload binary, ids array<long>, langs array<string>, sizes array<long>, n_keys long")
    return texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_score, "doc_id long, lang string, n_chars long, logp double")


def limits(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, limit of every language with enough trusted documents."""
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = scored.where("logp IS NOT NULL").select("doc_id", "lang", (-F.col("logp") / F.col("n_chars")).alias("rate")).join(one, "doc_id")
    high = F.percentile_approx(F.when(F.col("quality") == 1, F.col("rate")), TRUSTED_QUANTILE, 100_000)
    low = F.percentile_approx(F.when(F.col("quality") == 0, F.col("rate")), UNTRUSTED_QUANTILE, 100_000)
    limit = F.greatest(F.col("high"), F.coalesce(F.col("high") + MARGIN * (F.col("low") - F.col("high")), F.col("high")))
    by = known.groupBy("lang").agg(high.alias("high"), low.alias("low"), F.sum((F.col("quality") == 1).cast("long")).alias("trusted")).where(F.col("trusted") >= LEAST)
    return by.select("lang", limit.alias("limit"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, limit, kept of every row; perplexity and limit are per character."""
    good = keep(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    small = good.count() <= BROADCAST_IDS
    model = train(docs.join(F.broadcast(good) if small else good, "doc_id", "left_semi"))
    scored = keep(score(docs, model), "scores")
    found = keep(limits(scored, labels), "limits")
    by = found.select(F.col("lang").alias("l"), F.col("limit").alias("bound"))
    rows = scored.join(by, F.col("lang").eqNullSafe(F.col("l")), "left")
    rate = -F.col("logp") / F.col("n_chars")
    return rows.select("doc_id", "lang", "n_chars", F.exp(rate).alias("perplexity"), F.exp("bound").alias("limit"),
                       F.coalesce(F.when(rate.isNotNull(), F.coalesce(rate <= F.col("bound"), F.lit(True))), F.lit(False)).alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all columns of `docs`. Of rows that repeat an id all stay unless each is rejected."""
    rejected = classify(docs, labels).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    rejected = keep(rejected, "rejected")
    few = rejected.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rejected) if few else rejected, "doc_id", "left_anti").select(*docs.columns)
