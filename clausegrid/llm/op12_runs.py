"""Periodic runs of words, found in a grammar of each text.

Re-Pair: the words of a text become numbers, and the most frequent pair of neighbours is replaced by a new symbol until no pair occurs
twice. Every replacement is a place where the symbol derives a stretch of the text. A run lies inside one symbol or crosses a boundary,
so runs are looked for at boundaries only: once for the boundary inside each symbol, carried over to all places that derive
it, and at the boundaries of the symbols left over, which a balanced tree joins. Of a run at least 24 words and three periods long, the longer side
of any boundary it crosses repeats four words at the boundary one period away; the places of these four words give the candidate
periods, and direct comparison gives the extent inside the symbol. Stretches of one period that meet are merged, those inside a run of a
dividing period go, and what is left are the maximal runs.

Cases: null and empty texts have no words and no runs; a null id is kept; repeated rows are answered again; a long text is held whole by
the one task that has its row, in memory proportional to its words; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import WORD

LEAST, PERIODS, SEED = 24, 3, 4


def grammar(ids: Sequence[int]) -> tuple[list[tuple[int, int, list[int]]], list[int]]:
    """Re-Pair: the symbols as (length of the left part, length, places in the text, ascending) and the places of the symbols left over.

    A pair's count on the heap is the number of its places when they were listed; places lost since are noticed when it comes up."""
    n = len(ids)
    counts = Counter(zip(ids, ids[1:]))
    many = {p for p, c in counts.items() if c > 1}
    if not many:
        return [], list(range(n))
    sym, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n))
    places = defaultdict(list)
    for i, pair in enumerate(zip(ids, ids[1:])):
        if pair in many:
            places[pair].append(i)
    heap = [(-len(at), pair) for pair, at in places.items()]
    heapq.heapify(heap)
    size, symbols, fresh = {}, [], max(ids) + 1
    while heap:
        count, pair = heapq.heappop(heap)
        a, b = pair
        valid, last = [], -1
        for i in places[pair]:
            if sym[i] == a and i != last and after[i] < n and sym[after[i]] == b:
                valid.append(i)
                last = after[i] if a == b else -1
        if len(valid) < -count:
            if len(valid) > 1:
                places[pair] = valid
                heapq.heappush(heap, (-len(valid), pair))
            else:
                del places[pair]
            continue
        del places[pair]
        left, new = size.get(a, 1), fresh
        size[new] = left + size.get(b, 1)
        symbols.append((left, size[new], valid))
        fresh += 1
        for i in valid:
            j = after[i]
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
        made = defaultdict(list)
        for i in valid:
            if before[i] >= 0:
                made[sym[before[i]], new].append(before[i])
            k = after[i]
            if k < n and sym[k] != new:
                made[new, sym[k]].append(i)
        for p, at in made.items():
            if len(at) > 1:
                places[p] = at
                heapq.heappush(heap, (-len(at), p))
    return symbols, [i for i in range(n) if sym[i] >= 0]


def _same(words: np.ndarray, i: int, j: int, most: int) -> int:
    """How many words from i on equal those from j on, at most `most`; compared in growing steps."""
    done, step = 0, 32
    while done < most:
        k = min(step, most - done)
        differ = words[i + done : i + done + k] != words[j + done : j + done + k]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + k, step * 4
    return most


class _Text:
    """A text's words, its repeated groups of four and their places."""

    def __init__(self, ids: Sequence[int]):
        self.ids, self.words = ids, np.asarray(ids, np.int64)
        self.back = self.words[::-1]
        four = list(zip(ids, ids[1:], ids[2:], ids[3:]))
        many = {g for g, c in Counter(four).items() if c > 1}
        self.at, self.gram = defaultdict(list), four
        if many:
            for i, g in enumerate(four):
                if g in many:
                    self.at[g].append(i)

    def crossing(self, low: int, cut: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, period) of what crosses `cut` and is long enough, as far as it reaches inside low ... high."""
        n, most = len(self.ids), (high - low) // PERIODS
        found: list[tuple[int, int, int]] = []
        if high - low < LEAST:
            return found
        ids = self.ids
        if cut + SEED <= n and (at := self.at.get(self.gram[cut])):  # the right side is the longer one
            for p in at[bisect_right(at, cut) : bisect_right(at, min(cut + most, high - SEED))]:
                q = p - cut
                need = max(LEAST // 2 - q, (q + 1) // 2)
                if p + need <= high and ids[cut + need - 1] == ids[p + need - 1] and not any(
                        q % r == 0 and e - cut >= q for _, e, r in found):
                    self._add(found, low, cut, q, high)
        if cut >= SEED and (at := self.at.get(self.gram[cut - SEED])):  # the left side
            start = cut - SEED
            for p in reversed(at[bisect_left(at, max(low, start - most)) : bisect_left(at, start)]):
                q = start - p
                need = max(LEAST // 2 - q, (q + 1) // 2)
                if cut - q - need >= low and ids[cut - need] == ids[cut - q - need] and not any(
                        q % r == 0 and cut - s >= q for s, _, r in found):
                    self._add(found, low, cut - 1 - q, q, high)
        return found

    def _add(self, found, low: int, i: int, q: int, high: int) -> None:
        """Extend the period q both ways from i, where the words i and i + q are equal."""
        n = len(self.ids)
        end = i + q + _same(self.words, i, i + q, high - q - i)
        start = i - _same(self.back, n - i, n - i - q, i - low)
        if end - start >= max(LEAST, PERIODS * q):
            found.append((start, end, q))


def periodic_runs(ids: Sequence[int]) -> list[tuple[int, int, int]]:
    """All maximal runs of the sequence as (start, length, period), ascending by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    symbols, left_over = grammar(ids)
    if not symbols:
        return []  # a run repeats pairs
    text = _Text(ids)
    if not text.at:
        return []  # a run repeats four words
    found: set[tuple[int, int, int]] = set()
    for left, size, at in symbols:
        for s, e, q in text.crossing(at[0], at[0] + left, at[0] + size):
            found.update((s - at[0] + p, e - at[0] + p, q) for p in at)
    bounds = [*left_over, n]
    m, gram, places = len(left_over), text.gram, text.at
    for j in range(1, m):
        cut = bounds[j]
        if (cut + SEED <= n and gram[cut] in places) or (cut >= SEED and gram[cut - SEED] in places):
            span = j & -j
            found.update(text.crossing(bounds[j - span], cut, bounds[min(m, j + span)]))
    return maximal(found)


def maximal(found) -> list[tuple[int, int, int]]:
    """Merge stretches (start, end, period) of one period that share a period's length, drop those inside a run of a dividing period."""
    by_period = defaultdict(list)
    for s, e, q in found:
        by_period[q].append((s, e))
    merged: dict[int, list[tuple[int, int]]] = {}
    for q in sorted(by_period):
        rows: list[list[int]] = []
        for s, e in sorted(by_period[q]):
            if rows and s <= rows[-1][1] - q:
                rows[-1][1] = max(rows[-1][1], e)
            else:
                rows.append([s, e])
        smaller = [merged[r] for r in merged if q % r == 0]
        kept = []
        for s, e in rows:
            for other in smaller:
                k = bisect_right(other, (s, 1 << 62)) - 1
                if k >= 0 and other[k][1] >= e:
                    break
            else:
                kept.append((s, e))
        merged[q] = kept
    return sorted((s, e - s, q) for q, rows in merged.items() for s, e in rows)


def without_repeats(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by one space; of every run only the first period stays."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for s, length, q in runs:
        kept[s + q : s + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
BATCH_BYTES = 8_000_000


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows):
        ids, n, runs, texts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    for b in batches:
        rows, size = [], 0
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            number: dict[bytes, int] = {}
            runs = periodic_runs([number.setdefault(w, len(number)) for w in words])
            collapsed = without_repeats(words, runs)
            rows.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed))
            size += len(collapsed)
            if size >= BATCH_BYTES:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed (the text without repeats) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h the checksum of the id, every tenth text (h % 10 = 0) repeats from word a = g % n on, g = h // 10, its next
    1 + (n - a) // (3 + g % 8) words. A null id counts as the empty string."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = (g % n).cast("int")
    rows = rows.withColumn("planted", (F.size("words") > 0)).withColumn("a", F.when(F.col("planted"), a))
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    rows = rows.withColumn("p", F.when(F.col("planted"), p))
    tail = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("planted"), changed).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_runs, the run with the greatest exponent (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256."""
    found = find(with_planted_runs(docs))

    def better(x, y):  # exact: lengths and periods are far below 2**31
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when((left > right) | ((left == right) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))), x).otherwise(y)

    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda x, y: better(x, y)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
