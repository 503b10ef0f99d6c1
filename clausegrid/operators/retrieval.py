"""Hybrid retrieval and answers for batches of questions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from clausegrid import constants as K
from clausegrid.functions import dates as D
from clausegrid.functions import ordered
from clausegrid.functions import text as T

CHUNKS_PER_BLOCK = 2048
QUESTIONS_PER_BLOCK = 256
BM25_K1, BM25_B = 1.2, 0.75


# ------------------------------------------------------------------ embeddings

_VECTOR = "array<struct<dim:int,weight:double>>"
_WORD_BYTE = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])


def _hashed_tokens(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit FNV-1a hash of every token of some lower-cased texts; the tokens' bytes are hashed side by side."""
    texts = [(x or "").encode("utf-8", "surrogatepass") for x in lowered.to_pylist()]
    codes = np.frombuffer(b" ".join(texts), np.uint8)
    word = np.concatenate([[False], _WORD_BYTE[codes], [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    rows = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, "right")
    order = np.argsort(starts - ends, kind="stable")  # the longest first, so that those still read stand in front
    starts, length = starts[order], (ends - starts)[order]
    hashes = np.full(len(starts), 2166136261, np.uint32)
    at, live = 0, len(starts)
    while live := int(np.searchsorted(-length[:live], -at, "left")):
        hashes[:live] = (hashes[:live] ^ codes[starts[:live] + at]) * np.uint32(16777619)
        at += 1
    return rows[order], hashes


def _embedder(dim: int) -> Callable[[pa.Array], pa.Array]:
    def embed(lowered: pa.Array) -> pa.Array:
        rows, hashes = _hashed_tokens(lowered)
        dims = np.abs(hashes.view(np.int32).astype(np.int64)) % dim
        keys, n = np.unique(rows.astype(np.int64) * dim + dims, return_counts=True)
        row = keys // dim
        norm = np.sqrt(np.bincount(row, n.astype(np.float64) ** 2, len(lowered)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lowered)))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array((keys % dim).astype(np.int32)), pa.array(n / norm[row])], names=["dim", "weight"])
        empty = np.append(ends[1:] == ends[:-1], False)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=empty), pairs)

    return embed


def vector_of(text: Column | str, dim: int = 1536) -> Column:
    """Sparse unit vector of a text from hashed token counts, as array<struct<dim, weight>> by dimension; null without tokens."""
    return F.arrow_udf(_embedder(dim), _VECTOR)(F.lower(T.col(text)))


def hash_embed(df: DataFrame, key: str = "chunk_id", text: str = "text", dim: int = 1536) -> DataFrame:
    """Sparse unit vectors (key, dim, weight) from hashed token counts, made within each text's row."""
    return df.select(key, F.explode(vector_of(text, dim)).alias("x")).select(key, "x.dim", "x.weight")


def pack(sparse: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per key with its vector as array<struct<dim, weight>> (bounded by the dimension)."""
    return sparse.groupBy(key).agg(F.collect_list(F.struct("dim", "weight")).alias("vector"))


def reembed(chunks: DataFrame, dim: int, embed: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Vectors of every chunk's text, by hashed token counts or by `embed`; chunks without tokens get none."""
    if embed is None:
        return chunks.withColumn("vector", vector_of("text", dim))
    return chunks.join(pack(embed(chunks, dim=dim)), "chunk_id", "left")


def invalidate_vectors(chunks: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Vectors of another dimension count as missing."""
    return chunks.withColumn(column, F.when(F.size(column) == dim, F.col(column)))


# ------------------------------------------------------------------ scope and vector search

def authorized_chunks(chunks: DataFrame, grants: DataFrame) -> DataFrame:
    """Only chunks of granted (workspace, version) pairs; applied before any ranking."""
    return chunks.join(grants.select("workspace_id", "dv_id").distinct(), ["workspace_id", "dv_id"], "left_semi")


def _unit_rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors, dense or as (dim, weight) pairs, as rows of length one (or zero)."""
    lists = column.combine_chunks()
    values, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    out = np.zeros((len(lists), dim))
    if pa.types.is_struct(values.type):
        out[row, values.field("dim").to_numpy(zero_copy_only=False)] = values.field("weight").to_numpy(zero_copy_only=False)
    else:
        out[:] = values.to_numpy(zero_copy_only=False).reshape(len(lists), dim)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def vector_topk(questions: DataFrame, chunks: DataFrame, dim: int, k: int = K.CANDIDATES, skip_same: bool = False,
                within: Sequence[str] = ("workspace_id",)) -> DataFrame:
    """Exact top k chunks by cosine similarity among the chunks that share the columns `within`.

    Chunks and questions of a group are cut into blocks of bounded size; every task
    multiplies one block pair and returns at most k rows per question, so a workspace of
    any size is spread over many tasks and no pair list is materialised.
    `questions`: question_id, vector and `within`; `chunks`: chunk_id, vector and `within`.
    """
    group = list(within)
    # fresh columns, so that a table can be searched with its own rows
    live_q = questions.filter(F.col("vector").isNotNull()).select(*[F.col(c).alias(c) for c in ("question_id", *group, "vector")])
    live_c = chunks.filter(F.col("vector").isNotNull()).select(*[F.col(c).alias(c) for c in ("chunk_id", *group, "vector")])
    nq = live_q.groupBy(*group).agg(F.ceil(F.count("*") / QUESTIONS_PER_BLOCK).cast("int").alias("nqb"))
    nc = live_c.groupBy(*group).agg(F.ceil(F.count("*") / CHUNKS_PER_BLOCK).cast("int").alias("ncb"))
    sizes = nq.join(nc, group)

    def blocks(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return (df.join(sizes, group)
                .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("nqb", "ncb"))

    q = blocks(live_q, "question_id", "qb", "nqb", "cb", "ncb")
    c = blocks(live_c, "chunk_id", "cb", "ncb", "qb", "nqb")

    def best(qs: pa.Table, cs: pa.Table) -> pa.Table:
        types = qs.schema.field("question_id").type, cs.schema.field("chunk_id").type
        rows: list = [[], [], []]
        if qs.num_rows and cs.num_rows:
            cs = cs.sort_by("chunk_id")
            scores = np.round(_unit_rows(qs.column("vector"), dim) @ _unit_rows(cs.column("vector"), dim).T, 9) + 0.0
            ids, asked = cs.column("chunk_id").to_numpy(), qs.column("question_id").to_numpy()
            if skip_same:
                scores[asked[:, None] == ids[None, :]] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(scores, order, axis=1)
            keep = np.isfinite(found)
            rows = [np.repeat(asked, keep.sum(axis=1)), ids[order[keep]], found[keep]]
        return pa.Table.from_arrays([pa.array(r, t) for r, t in zip(rows, (*types, pa.float64()))], names=["question_id", "chunk_id", "score"])

    schema = f"question_id {q.schema['question_id'].dataType.simpleString()}, chunk_id {c.schema['chunk_id'].dataType.simpleString()}, score double"
    keys = [*group, "qb", "cb"]
    local = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(best, schema)
    return ordered.top_n(local, ["question_id"], [F.col("score").desc(), F.col("chunk_id")], k)


class VectorIndex:
    """A written index of vectors in cells around pivots: `rows` (chunk_id, workspace_id, vector, cell) holds every vector once, in a folder per
    cell. A question looks at the `probes` cells whose pivots are nearest to it; what it finds there is ranked exactly."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, probes: int, recall: float):
        self.rows, self.pivots, self.probes, self.recall = rows, pivots, probes, recall

    def search(self, questions: DataFrame, k: int = K.CANDIDATES, skip_same: bool = False) -> DataFrame:
        near = _with_cells(questions.select("question_id", "workspace_id", "vector"), self.pivots, self.probes)
        return vector_topk(near.withColumn("cell", F.explode("cells")).drop("cells"), self.rows, self.pivots.shape[1], k, skip_same, ["workspace_id", "cell"])


def _with_cells(rows: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """`rows` with the n cells nearest to their vector, the nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                scores = _unit_rows(pa.chunked_array([b.column(b.schema.get_field_index("vector"))]), pivots.shape[1]) @ pivots.T
                cells = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "cells"])

    return rows.mapInArrow(run, t.StructType([*rows.schema.fields, t.StructField("cells", t.ArrayType(t.IntegerType()))]))


#: Pivots and calibration questions of a vector index, at most.
PIVOTS, CALIBRATION = 256, 64


def build_vector_index(chunks: DataFrame, dim: int, path: str, target: float = 0.95, k: int = K.CANDIDATES) -> VectorIndex:
    """Write an index of `chunks` (chunk_id, workspace_id, vector) under `path`.

    Pivots are a sample of the vectors, the square root of their number up to PIVOTS, chosen by hash; every vector goes to its nearest pivot's cell. The
    number of cells to probe is measured: CALIBRATION vectors of another sample ask for their k nearest by the exact search, and as many cells are
    probed as hold the `target` share of those neighbours."""
    spark = chunks.sparkSession
    live = chunks.filter(F.col("vector").isNotNull()).select("chunk_id", "workspace_id", "vector")
    order = F.xxhash64("chunk_id", F.lit(1))
    n = live.count()
    cells = max(1, min(PIVOTS, int(n**0.5)))
    sample = live.orderBy(order).limit(cells).toArrow()  # at most PIVOTS vectors
    pivots = _unit_rows(sample.column("vector"), dim) if sample.num_rows else np.zeros((1, dim))
    dealt = _with_cells(live, pivots, 1).select("chunk_id", "workspace_id", "vector", F.col("cells")[0].alias("cell"))
    dealt.repartition("cell", "workspace_id").write.partitionBy("cell").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    asked = live.orderBy(F.xxhash64("chunk_id", F.lit(2))).limit(CALIBRATION).withColumnRenamed("chunk_id", "question_id")
    ranked = _with_cells(asked, pivots, len(pivots)).select("question_id", "cells")
    hits = vector_topk(asked, live, dim, k, skip_same=True).join(rows.select("chunk_id", "cell"), "chunk_id").join(ranked, "question_id")
    places = [r[0] for r in hits.select(F.array_position("cells", F.col("cell"))).collect()]  # at most CALIBRATION * k numbers
    if not places:
        return VectorIndex(rows, pivots, 1, 1.0)
    share = np.cumsum(np.bincount(places, minlength=len(pivots) + 1)) / len(places)
    probes = int(np.argmax(share >= target))
    return VectorIndex(rows, pivots, max(probes, 1), float(share[max(probes, 1)]))


# ------------------------------------------------------------------ full text

def text_index(chunks: DataFrame) -> DataFrame:
    """Inverted index (workspace_id, term, chunk_id, tf, dl) over lower-cased content terms; `write_text_index` keeps it for many batches of questions."""
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    toks = chunks.select("workspace_id", "chunk_id", F.filter(T.tokens("text"), lambda w: ~F.array_contains(stop, w)).alias("t"))
    rows = toks.select("workspace_id", "chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("workspace_id", "term", "chunk_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


#: Words of a segment of a written index, about.
SEGMENT_WORDS = 2_000_000


def _segment_type(chunks: DataFrame) -> t.StructType:
    places = t.ArrayType(t.IntegerType())
    return t.StructType([
        t.StructField("segment", t.LongType()), t.StructField("workspace_id", chunks.schema["workspace_id"].dataType), t.StructField("term", t.StringType()),
        t.StructField("places", places), t.StructField("counts", places), t.StructField("chunk_ids", t.ArrayType(chunks.schema["chunk_id"].dataType))])


def _segment(number: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: first the chunks of every workspace (term null, counts are their lengths), then the places and counts of every term.
    `parts`: workspaces, ids and sizes of some chunks, and their words."""
    spaces, ids, sizes, words = zip(*parts)
    firsts, coded, sizes = pa.concat_arrays(spaces).dictionary_encode(), pa.concat_arrays(words).dictionary_encode(), np.concatenate(sizes)
    n, space = len(sizes), firsts.indices.to_numpy().astype(np.int64)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place_of = np.empty(len(order), np.int64)
    place_of[order] = np.arange(len(order))
    row = np.repeat(np.arange(n), sizes)
    keys, counts = np.unique((space[row] * len(order) + place_of[coded.indices.to_numpy()]) * n + row, return_counts=True)
    groups = keys // n
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    by_space = np.argsort(space, kind="stable")
    held = np.flatnonzero(np.diff(space[by_space], prepend=-1))

    def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(at, len(values)).astype(np.int32)), values)

    def ints(values: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int32))

    ids = lists(pa.concat_arrays(ids).take(pa.array(by_space)), held)
    terms = coded.dictionary.take(pa.array(order)).cast(pa.string())
    columns = [
        pa.array(np.full(len(held) + len(starts), number, np.int64)),
        firsts.dictionary.take(pa.array(np.concatenate([space[by_space][held], groups[starts] // len(order)]))),
        pa.concat_arrays([pa.nulls(len(held), pa.string()), terms.take(pa.array(groups[starts] % len(order)))]),
        pa.concat_arrays([lists(ints(by_space), held), lists(ints(keys % n), starts)]),
        pa.concat_arrays([lists(ints(sizes[by_space]), held), lists(ints(counts), starts)]),
        pa.concat_arrays([ids, pa.nulls(len(starts), ids.type)])]
    whole = pa.RecordBatch.from_arrays(columns, names=["segment", "workspace_id", "term", "places", "counts", "chunk_ids"])
    for at in range(0, whole.num_rows, 65_536):
        yield whole.slice(at, 65_536)


def text_segments(chunks: DataFrame, words: int = SEGMENT_WORDS) -> DataFrame:
    """Rows of an inverted index, made from the chunks as they come: a task holds one segment at a time, of about so many words."""
    content, stop, step = re.compile(b"[a-z0-9]+"), {w.encode() for w in K.STOP_WORDS}, min(256, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                spaces, ids, texts = whole.slice(at, step).columns
                found = [[w for w in content.findall(x) if w not in stop] for x in texts.cast(pa.binary()).fill_null(b"").to_pylist()]
                sizes = np.array([len(x) for x in found])
                live = pa.array(sizes > 0)
                parts.append((spaces.filter(live), ids.filter(live), sizes[sizes > 0], pa.array([w for x in found for w in x], pa.binary())))
                held += int(sizes.sum())
                if held >= words:
                    yield from _segment(number, parts)
                    number, held, parts = number + 1, 0, []
        if held:
            yield from _segment(number, parts)

    rows = chunks.filter(F.col("workspace_id").isNotNull()).select("workspace_id", "chunk_id", F.lower("text").alias("text"))
    return rows.mapInArrow(run, _segment_type(chunks))


class TextIndex:
    """A written inverted index, in segments of chunks: `lists` (segment, workspace_id, term, places, counts) says at which places of its segment a
    term occurs, in ascending order, and how often; `chunks` (segment, place, chunk_id, dl) which chunk a place holds and its length; `corpus` each
    workspace's number of chunks and mean length. A term's document count is the number of its places."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(path)
        self.lists = rows.filter("term IS NOT NULL").drop("chunk_ids")
        held = rows.filter("term IS NULL")
        self.chunks = held.select("segment", F.explode(F.arrays_zip("places", "chunk_ids", "counts")).alias("c")).select(
            "segment", F.col("c.places").alias("place"), F.col("c.chunk_ids").alias("chunk_id"), F.col("c.counts").alias("dl"))
        words = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        self.corpus = held.groupBy("workspace_id").agg(F.sum(F.size("places")).alias("n"), F.sum(words).alias("words")).select(
            "workspace_id", "n", (F.col("words") / F.col("n")).alias("avgdl"))


def write_text_index(chunks: DataFrame, path: str, words: int = SEGMENT_WORDS) -> TextIndex:
    """Write the index of `chunks` under `path`: every task writes the segments of the chunks it reads, nothing is shuffled."""
    text_segments(chunks, words).write.parquet(path)
    return TextIndex(chunks.sparkSession, path)


def question_terms(questions: DataFrame) -> DataFrame:
    """Search terms of each question: (question_id, workspace_id, alt, negated, words, phrase).

    Words joined by spaces must all occur; quoted words form a phrase; OR separates
    alternatives; a leading minus excludes.
    """
    parts = F.regexp_extract_all(F.lower("question"), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    rows = questions.select("question_id", "workspace_id", parts.alias("parts")).select(
        "question_id", "workspace_id", "parts", F.posexplode("parts").alias("pos", "part"))
    alt = F.size(F.filter(F.slice("parts", F.lit(1), F.col("pos") + 1), lambda p: p == "or"))
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    return rows.filter("part <> 'or'").select(
        "question_id", "workspace_id", alt.alias("alt"), F.col("part").startswith("-").alias("negated"),
        F.filter(T.tokens("part"), lambda w: ~F.array_contains(stop, w)).alias("words"),
        F.when(F.col("part").rlike('^-|"'), F.array_join(T.tokens("part"), " ")).alias("phrase"),
    ).filter((F.size("words") > 0) | (F.col("phrase") != ""))


def fts_topk(questions: DataFrame, chunks: DataFrame, k: int = K.CANDIDATES, index: TextIndex | None = None) -> DataFrame:
    """Top k chunks that satisfy the question, ranked by BM25 within the question's workspace.

    The rarest term of every alternative selects the candidates; only those are looked up for the other terms, by an equi-join on (chunk, term),
    or on (segment, term) with the term's places in a written index, so frequent terms never fan out.
    """
    asked = question_terms(questions)
    key = ["question_id", "workspace_id", "alt"]
    terms = asked.filter(~F.col("negated")).select(*key, F.explode("words").alias("term")).distinct()
    wanted = terms.select("workspace_id", "term").distinct()
    if index is None:
        postings = text_index(chunks)
        corpus = postings.groupBy("workspace_id", "chunk_id").agg(F.max("dl").alias("dl")).groupBy("workspace_id").agg(
            F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        postings = postings.join(wanted, ["workspace_id", "term"], "left_semi")
        df = postings.groupBy("workspace_id", "term").agg(F.count("*").alias("df"))
    else:
        lists, corpus = index.lists.join(wanted, ["workspace_id", "term"], "left_semi"), index.corpus
        df = lists.groupBy("workspace_id", "term").agg(F.sum(F.size("places")).alias("df"))
    rated = terms.join(df, ["workspace_id", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = rated.groupBy(*key).agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("n_terms"))
    if index is None:
        picked = rare.join(postings.select("workspace_id", "term", "chunk_id"), ["workspace_id", "term"]).drop("term")
        hits = picked.join(rated, key).join(postings.drop("workspace_id"), ["term", "chunk_id"])
    else:
        picked = rare.join(lists.select("workspace_id", "term", "segment", "places"), ["workspace_id", "term"]).select(
            *key, "n_terms", "segment", F.explode("places").alias("place")).join(index.chunks, ["segment", "place"])
        found = picked.join(rated, key).join(lists, ["segment", "workspace_id", "term"]).withColumn("at", F.array_position("places", F.col("place")))
        hits = found.filter("at > 0").withColumn("tf", F.get("counts", (F.col("at") - 1).cast("int")))
    hits = hits.join(corpus, "workspace_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(*key, "chunk_id").agg(
        F.count("*").alias("found"), F.max("n_terms").alias("n_terms"), F.round(F.sum(part), 9).alias("score")).filter("found = n_terms")
    strict = asked.filter(F.col("phrase").isNotNull()).groupBy(*key).agg(F.collect_set(F.struct("negated", "phrase")).alias("rules"))
    ruled = scored.join(strict, key, "left")
    flat = F.concat(F.lit(" "), F.array_join(T.tokens("text"), " "), F.lit(" "))
    free = ruled.filter(F.col("rules").isNull()).drop("rules")
    checked = ruled.filter(F.col("rules").isNotNull()).join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("flat", flat).filter(F.forall(
        "rules", lambda r: F.contains(F.col("flat"), F.concat(F.lit(" "), r["phrase"], F.lit(" "))) != r["negated"])).drop("rules", "text", "flat")
    best = ordered.stack(free, checked).groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))
    return ordered.top_n(best, ["question_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def rrf(lists: list[DataFrame], k: int = K.EVIDENCE_K, c: int = K.RANK_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (question_id, chunk_id, rank)."""
    rows = lists[0].select("question_id", "chunk_id", "rank")
    for other in lists[1:]:
        rows = ordered.stack(rows, other.select("question_id", "chunk_id", "rank"))
    fused = rows.groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (c + F.col("rank"))), 9).alias("score"))
    return ordered.top_n(fused, ["question_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def attach_evidence(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk columns for the fused ids; the rank keeps the order."""
    return fused.join(chunks, "chunk_id").withColumn("evidence_id", F.concat(F.lit("chk_"), (F.col("rank") - 1).cast("string")))


# ------------------------------------------------------------------ routing and answers

def route_intent(questions: DataFrame) -> DataFrame:
    """Date questions over the portfolio, with their window in days, or questions about text."""
    q = F.col("question")
    intent, days = None, None
    for i, pattern in enumerate(K.PORTFOLIO_PATTERNS):
        hit = q.rlike(pattern)
        number = F.regexp_extract(q, pattern, 2).try_cast("int") if i == 0 else F.lit(None).cast("int")
        value = F.coalesce(number, F.lit(K.DEFAULT_WINDOW_DAYS))
        intent = F.when(hit, "portfolio_dates") if intent is None else intent.when(hit, "portfolio_dates")
        days = F.when(hit, value) if days is None else days.when(hit, value)
    return questions.withColumns({"intent": intent.otherwise("document_text"), "window_days": days})


def out_of_scope(questions: DataFrame) -> DataFrame:
    """Mark questions that ask for legal conclusions or authority."""
    q = F.col("question")
    hit = q.rlike(K.OUT_OF_SCOPE_PATTERNS[0]) | q.rlike(T.jvm(K.OUT_OF_SCOPE_PATTERNS[1]))
    return questions.withColumn("out_of_scope", hit)


#: Days that a bin of due dates spans.
DUE_BIN = 32


def due_totals(questions: DataFrame, due: DataFrame, as_of: str) -> DataFrame:
    """question_id, n: how many of `due` (workspace_id, due_date) lie from today to the end of the question's window.

    Due dates are counted per day and bin of days; a question reads the running total before its last bin and the days of that bin, so its cost
    doesn't grow with the number of obligations."""
    today = D.as_date(as_of)
    days = due.groupBy("workspace_id", "due_date").agg(F.count("*").alias("c")).withColumn("day", F.datediff("due_date", today))
    days = days.withColumn("bin", F.floor(F.col("day") / DUE_BIN).cast("int")).select("workspace_id", "bin", "day", "c")
    asked = questions.select("question_id", "workspace_id", F.col("window_days").alias("upto"), F.floor(F.col("window_days") / DUE_BIN).cast("int").alias("bin"))
    full = days.groupBy("workspace_id", "bin").agg(F.sum("c").alias("c"))
    ends = ordered.stack(full.withColumn("ask", F.lit(False)), asked.select("workspace_id", "bin").distinct().withColumns({"c": F.lit(0).cast("long"), "ask": F.lit(True)}))
    # bins of a workspace in order, those asked for among them: one row per bin of days, however many obligations it holds
    before = F.coalesce(F.sum("c").over(W.partitionBy("workspace_id").orderBy("bin").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = ends.withColumn("before", before).filter("ask").select("workspace_id", "bin", "before")
    inside = asked.join(days, ["workspace_id", "bin"], "left").groupBy("question_id").agg(
        F.coalesce(F.sum(F.when(F.col("day") <= F.col("upto"), F.col("c"))), F.lit(0)).alias("inside"))
    return asked.join(totals, ["workspace_id", "bin"]).join(inside, "question_id").select("question_id", (F.col("before") + F.col("inside")).cast("long").alias("n"))


def _due(obligations: DataFrame, as_of: str) -> DataFrame:
    rows = obligations.filter(F.col("status").isin("active", "overdue") & (F.col("due_date") >= D.as_date(as_of)))
    return rows.select("workspace_id", "obligation_id", "contract_id", "title", "due_date")


def portfolio_due(questions: DataFrame, obligations: DataFrame, contracts: DataFrame, as_of: str) -> DataFrame:
    """Everything due in each question's window, as rows: question_id, obligation_id, due_date, line."""
    named = _due(obligations, as_of).join(contracts.select("contract_id", F.col("title").alias("contract_title")), "contract_id")
    ends = questions.select("question_id", "workspace_id", F.date_add(D.as_date(as_of), F.col("window_days")).alias("until"))
    return ends.join(named, "workspace_id").filter(F.col("due_date") <= F.col("until")).select("question_id", "obligation_id", "due_date", _due_line().alias("line"))


def _due_line() -> Column:
    return F.concat(F.lit("- "), F.col("title"), F.lit(" — "), F.col("contract_title"), F.lit(" — due "), F.col("due_date").cast("string"),
                    F.lit(" (/contracts/"), F.col("contract_id").cast("string"), F.lit("/obligations)"))


def portfolio_answer(questions: DataFrame, obligations: DataFrame, contracts: DataFrame, as_of: str, shown: int = 20) -> DataFrame:
    """The answer to each question about due dates: how many obligations its window holds, the first `shown` of them as lines, and how many
    more there are (`portfolio_due` has them all).

    The first due dates from today on are the same for every window of a workspace,
    so they are found once and the windows only filter them.
    """
    due = _due(obligations, as_of).join(contracts.select("contract_id", F.col("title").alias("contract_title")), "contract_id")
    soon = ordered.top_n(due, ["workspace_id"], [F.col("due_date"), F.col("obligation_id")], shown)
    lines = soon.select(F.col("workspace_id").alias("w"), "rank", "due_date", _due_line().alias("line"))
    until = F.date_add(D.as_date(as_of), F.col("window_days"))
    hit = questions.join(lines, (F.col("workspace_id") == F.col("w")) & (F.col("due_date") <= until), "left")
    agg = hit.groupBy("question_id", "window_days").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line")))).alias("x"))
    agg = agg.join(due_totals(questions, due, as_of), "question_id")
    head = F.concat(F.col("n").cast("string"), F.lit(" obligation(s) due in the next "), F.col("window_days").cast("string"), F.lit(" days:\n"))
    none = F.concat(F.lit("No obligations are due in the next "), F.col("window_days").cast("string"), F.lit(" days."))
    more = F.when(F.col("n") > F.size("x"), F.concat(F.lit("\n… and "), (F.col("n") - F.size("x")).cast("string"), F.lit(" more"))).otherwise("")
    return agg.select("question_id", "n", F.when(F.col("n") == 0, none).otherwise(
        F.concat(head, F.array_join(F.transform("x", lambda r: r["line"]), "\n"), more)).alias("content"))


def validate_claims(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims backed by retrieved evidence and free of unwanted phrases; and each cited
    chunk once per answer, at the first claim that uses it."""
    clean = claims.filter(T.lint_clean("text"))
    refs = clean.select("question_id", "pos", F.posexplode("evidence_ids").alias("ref", "evidence_id"))
    backed = refs.join(evidence.select("question_id", "evidence_id", "chunk_id"), ["question_id", "evidence_id"])
    valid = clean.join(backed.select("question_id", "pos").distinct(), ["question_id", "pos"], "left_semi")
    cited = backed.groupBy("question_id", "chunk_id").agg(F.min(F.struct("pos", "ref")).alias("f")).select("question_id", "chunk_id", "f.pos")
    return valid, cited


def answer_kind(questions: DataFrame, evidence: DataFrame, valid_claims: DataFrame, drafts: DataFrame,
                floor: float = K.RELEVANCE_FLOOR) -> DataFrame:
    """Kind of the answer to each question: the first rule that applies.

    `questions` carry permitted, out_of_scope and intent; `drafts` the drafted kind.
    """
    best = evidence.groupBy("question_id").agg(F.max("score").alias("best"))
    texts = valid_claims.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    joined = (questions.join(best, "question_id", "left").join(texts, "question_id", "left")
              .join(drafts.select("question_id", "draft_kind"), "question_id", "left")
              .withColumn("content", F.array_join(F.transform("x", lambda r: r["text"]), " ")))
    kind = (
        F.when(~F.col("permitted"), "refusal_permission")
        .when(F.col("out_of_scope"), "refusal_out_of_scope")
        .when(F.col("intent") == "portfolio_dates", "grounded")
        .when(F.col("best").isNull() | (F.col("best") < floor), "refusal_silent")
        .when(F.col("x").isNull(), F.when(F.col("draft_kind") == "refusal_conflict", "refusal_conflict").otherwise("refusal_silent"))
        .when(~T.lint_clean("content"), "refusal_out_of_scope")
        .otherwise("grounded"))
    return joined.withColumn("answer_kind", kind).withColumn(
        "content", F.when((F.col("answer_kind") == "grounded") & (F.col("intent") != "portfolio_dates"), F.col("content"))).drop("x", "best", "draft_kind")


# ------------------------------------------------------------------ chat log

def latest_session(sessions: DataFrame) -> DataFrame:
    """Newest session of every (contract, user)."""
    return ordered.latest(sessions, ["contract_id", "user_id"], ["created_at", "session_id"])


def append_turns(sessions: DataFrame, messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add question and answer rows to the newest session, opening one where there is none.

    `turns`: turn_id, contract_id, user_id, asked_at, question, answer, answer_kind.
    """
    current = latest_session(sessions).select("contract_id", "user_id", F.col("session_id").alias("open_session"))
    joined = turns.join(current, ["contract_id", "user_id"], "left")
    opened = F.concat_ws(":", F.lit("session"), "contract_id", "user_id")
    placed = joined.withColumn("session_id", F.coalesce(F.col("open_session").cast("string"), opened))
    new_sessions = placed.filter(F.col("open_session").isNull()).groupBy("contract_id", "user_id", "session_id").agg(
        F.min("asked_at").alias("created_at"))
    rows = placed.select("session_id", "turn_id", F.explode(F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("answer_kind")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("answer_kind").alias("answer_kind")))).alias("m"))
    added = rows.select(F.concat_ws("/", "turn_id", "m.role").alias("message_id"), "session_id", "m.*")
    return (ordered.stack(sessions, new_sessions.select(*sessions.columns)),
            ordered.stack(messages, added.select(*messages.columns)))


def record_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Latest feedback per assistant message."""
    last = ordered.latest(feedback, ["message_id"], ["given_at", "feedback"]).select("message_id", F.col("feedback").alias("__f"))
    return messages.join(last, "message_id", "left").withColumn(
        "feedback", F.when(F.col("role") == "assistant", F.coalesce("__f", "feedback")).otherwise(F.col("feedback"))).drop("__f")
