"""Document fingerprints by a randomised edit embedding.

One random walk, shared by all texts, reads a text character by character: at step j a fixed random bit of (character,
j) says whether to stay on the character or go on. Texts that differ by few edits fall into step again after each, so edit
distance becomes Hamming distance between the embeddings (the character under the walk at each step). A fingerprint
samples the embedding at 512 places and keeps one random bit of each character found. The places for a text of n
characters lie below 2 n steps and are chosen by minimum over shared random numbers, so texts of similar length share
nearly all of them. `near_links` bands sampled bits of the distinct texts and verifies all pairs that meet by exact bounded edit distance; no registered query runs it.

Likeness is 2 * (share of equal bits) - 1, at least 0: unequal characters agree in half of the bits.

Cases: a null text is the empty text, whose walk is empty: all its fingerprints are equal; ties of the id are ordered by text; an empty
table gives an empty result; other columns are ignored; any length is walked in slices of bounded memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import keep, parallelism

SLOTS, PERIOD, SEED, SLICE = 512, 4096, 20_011, 1 << 16
PAD = 256
BLOCK = 2000


def _tables():
    rng = np.random.default_rng(SEED)
    go = rng.integers(0, 2, (256, PERIOD)).astype(bool)
    go[:, -1] = True
    ahead = np.empty((256, PERIOD), np.int64)
    ahead[:, -1] = 1
    for j in range(PERIOD - 2, -1, -1):
        ahead[:, j] = np.where(go[:, j], 1, ahead[:, j + 1] + 1)
    bits = rng.integers(0, 2, (SLOTS, PAD + 1)).astype(np.uint8)
    records = np.zeros((SLOTS, 96), np.int64)  # places where a slot's running minimum changes: 0, then each about e times further
    for k in range(1, 96):
        u = 1 - rng.random(SLOTS)
        records[:, k] = np.minimum((records[:, k - 1] + 1) / u, 2.0**61).astype(np.int64)
        records[:, k] = np.maximum(records[:, k], records[:, k - 1] + 1)
    return ahead.astype(np.uint8).tobytes(), bits, records


_AHEAD, _BITS, _RECORDS = _tables()


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points ^ (points >> 8) ^ (points >> 16)) & 255).astype(np.uint8)


def _places(n: int) -> np.ndarray:
    last = (_RECORDS < max(1, 2 * n)).sum(axis=1) - 1
    return _RECORDS[np.arange(SLOTS), last]


def _steps(codes: bytes, j: int) -> list[int]:
    ahead, out = _AHEAD, []
    put = out.append
    for c in codes:
        j += ahead[c << 12 | j & 4095]
        put(j)
    return out


def _walk(classes: np.ndarray, places: np.ndarray, order: np.ndarray, found: np.ndarray, j: int, done: int) -> tuple[int, int]:
    """Go on from step j with `done` places (in `order`) already found; write the class at each place passed."""
    for at in range(0, len(classes), SLICE):
        part = classes[at : at + SLICE]
        ends = _steps(part.tobytes(), j)
        j = ends[-1]
        upto = int(np.searchsorted(places[order], j, "left"))
        if upto > done:
            slots = order[done:upto]
            found[slots] = part[np.searchsorted(ends, places[slots], "right")]
            done = upto
    return j, done


def _print(found: np.ndarray) -> str:
    return np.packbits(_BITS[np.arange(SLOTS), found]).tobytes().hex()


def fingerprint(text: str) -> str:
    places = _places(len(text))
    order, found = np.argsort(places, kind="stable"), np.full(SLOTS, PAD)
    _walk(_classes(text), places, order, found, 0, 0)
    return _print(found)


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - 2.0 * (int(a, 16) ^ int(b, 16)).bit_count() / SLOTS)


class _Walked:
    """A text walked once: its fingerprint, and the state at its middle, where an edited text goes another way."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, n = doc_id, text, len(text)
        self.head = n - n // 2
        self.places = _places(n)
        self.order = np.argsort(self.places, kind="stable")
        classes, found = _classes(text), np.full(SLOTS, PAD)
        self.state = _walk(classes[: self.head], self.places, self.order, found, 0, 0)
        self.half = found.copy()
        _walk(classes[self.head :], self.places, self.order, found, *self.state)
        self.print = _print(found)

    def row(self, next_text: str, next_print: str) -> tuple:
        tail = next_text[: len(self.text) - self.head]
        edited = self.text[: self.head] + tail
        if len(edited) == len(self.text):
            found = self.half.copy()
            _walk(_classes(tail), self.places, self.order, found, *self.state)
            other = _print(found)
        else:
            other = fingerprint(edited)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), self.print, other,
                likeness(self.print, other), likeness(self.print, next_print))


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_EDGE = "edge int, part long, text string"


def _batch(rows: list[tuple], extra: bool) -> pa.RecordBatch:
    names = _NAMES + (["edge", "part", "text"] if extra else [])
    types = _TYPES + ([pa.int32(), pa.int64(), pa.string()] if extra else [])
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each is finished by the next. The first and the last of the partition go out with their texts."""
    part, last, rows = TaskContext.get().partitionId(), None, []
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            now = _Walked(doc_id, text.as_py() or "")
            if last is None:
                rows.append((doc_id, None, None, now.print, None, None, None, 1, part, now.text))
            else:
                rows.append(last.row(now.text, now.print) + (0, part, None))
            last = now
            if len(rows) >= 512:
                yield _batch(rows, True)
                rows = []
    if last is not None:
        rows.append((last.doc_id, None, None, last.print, None, None, None, 2, part, last.text))
    yield _batch(rows, True)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, text, next_text, next_print in zip(*(c.to_pylist() for c in b.columns)):
            yield _batch([_Walked(doc_id, text).row(next_text, next_print)], False)


def chained(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, which ends like the beginning of the next document."""
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = keep(ranged.mapInArrow(_chain, f"{RESULT}, {_EDGE}"), "fingerprints")
    heads = rows.where("edge = 1").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    every = Window.orderBy("part")  # a number per partition
    order = heads.select("part").select(
        "part", F.coalesce(F.lead("part").over(every), F.min("part").over(every)).alias("next_part"))
    ends = rows.where("edge = 2").select("doc_id", "text", "part").join(order, "part")
    ends = ends.join(heads.withColumnRenamed("part", "next_part"), "next_part")
    ends = ends.select("doc_id", "text", "next_text", "next_print").mapInArrow(_finish, RESULT)
    return rows.where("edge = 0").select(*_NAMES).unionByName(ends)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() or "" for t in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string()), b.column(1)],
            names=["doc_id", "n_chars", "fingerprint", "text"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, text of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _alone, "doc_id long, n_chars long, fingerprint string, text string")


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: furthest-reaching points by number of edits, matching runs by halving."""

    def run(i: int, j: int) -> int:
        end, size, got = min(len(a) - i, len(b) - j), 64, 0
        while got < end:
            size = min(size, end - got)
            if a[i + got : i + got + size] == b[j + got : j + got + size]:
                got, size = got + size, size * 2
            elif size == 1:
                break
            else:
                size = max(1, size // 8)
        return got

    goal = len(b) - len(a)
    if abs(goal) > most:
        return False
    reach = {0: run(0, 0)}
    for _ in range(most):
        if reach.get(goal, -1) >= len(a):
            return True
        grown = {}
        for d in range(min(reach) - 1, max(reach) + 2):  # d = place in b - place in a
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                grown[d] = i + run(i, i + d)
        reach = grown
    return reach.get(goal, -1) >= len(a)


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [within(x.as_py() or "", y.as_py() or "", most) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["doc_id", "hub_id"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_links(docs: DataFrame, most: int = 64, bands: int = 24, width: int = 20) -> DataFrame:
    """Links (doc_id, hub_id) of texts within `most` edits, hub_id the smaller. Equal texts are linked to the smallest id that has the text, which stands for
    them all; each band takes `width` sampled bits of the fingerprint, and all pairs that share them are compared. The width is at least the number of binary digits of the number of
    texts, so that unrelated texts do not fill the buckets, with four bands more for each bit more. Buckets are paired in cells of two blocks of about `BLOCK`; pairs within a
    family of near copies stay as many as they are."""
    rows = keep(fingerprints(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.sha2("text", 256)), "near-fingerprints")
    classes = keep(rows.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("fingerprint").alias("fingerprint")), "near-classes")
    ids = classes.select("digest", "class_id")
    equal = rows.select("digest", "doc_id").join(ids, "digest").where("doc_id > class_id").select("doc_id", F.col("class_id").alias("hub_id")).distinct()
    wide = min(max(width, classes.count().bit_length()), SLOTS)
    bands += 4 * (wide - width)
    rng = np.random.default_rng(SEED + 1)
    binary = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(SLOTS // 32)])
    picks = [F.concat(F.lit(f"{k}:"), *[F.substring("binary", int(p) + 1, 1) for p in rng.choice(SLOTS, wide, False)]) for k in range(bands)]
    banded = keep(classes.select("digest", binary.alias("binary")).select("digest", F.explode(F.array(*picks)).alias("band")), "near-bands")
    full = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    cells = banded.join(full, "band").withColumn("own", F.pmod(F.xxhash64("digest"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", "digest", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    # texts of one block meet in the block's own cell, of two blocks in the cell of both
    a, b = cells.toDF("band", "digest", "own", "low", "high"), cells.toDF("band", "digest_b", "own_b", "low", "high")
    pairs = a.join(b, ["band", "low", "high"]).where("digest < digest_b AND (own <> own_b OR low = high)").select("digest", "digest_b").distinct()
    texts = rows.join(ids, "digest").where("doc_id <=> class_id").select("digest", "class_id", "text").dropDuplicates(["digest"])
    both = pairs.join(texts, "digest").join(texts.toDF("digest_b", "id_b", "text_b"), "digest_b").where("class_id <> id_b")
    near = both.select(F.greatest("class_id", "id_b").alias("doc_id"), F.least("class_id", "id_b").alias("hub_id"), "text", "text_b").mapInArrow(
        _verify(most), "doc_id long, hub_id long")
    return equal.unionByName(near).distinct()
