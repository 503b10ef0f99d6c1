"""MinHash near-duplicates with odd sketches.

A document's set: its distinct shingles of `words` words (ASCII lower case), as 64-bit hashes. 128 MinHash samples of the set
make 32 bands of 4 and an odd sketch: a bitmap of 1024 bits in which every sample flips one bit, so the population
count of two sketches' XOR estimates how many samples differ, most precisely for high similarity. Documents with equal
sets are one class, its smallest id stands for it. Representatives that share a band are candidates; candidates whose
sketches put them clearly below the threshold (more than five standard errors) are dropped, the rest are confirmed on full sets.

Not all pairs of a bucket are looked at, yet no link that could join two components is left out. In three rounds every bucket of the first bands
compares its members with one hub, which merges most of a large group. The documents that still share a bucket with another component go
through an exact prefix join: shingles are ordered from rare to frequent, and two sets that are similar enough must share one among the first
few of both, so what is unlike its group by its own rare shingles meets nobody. Three more rounds of hubs, a few of them for each document, come first and
merge most of what belongs together; the join itself then takes every pair of documents that are still apart. Within a shingle, rows of its most frequent
component meet only rows of others. Two documents at the threshold share no band with a probability below 1e-7.

Cases: null and empty texts have an empty set and are linked with nothing; texts of fewer than `words` words have one element, their whole
sequence; rows that repeat an id count as one document when their texts are equal; an empty table gives an empty result; other columns are
ignored; any length is hashed whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import keep, parallelism, release, release_memory, small_batches

SAMPLES, ROWS, BITS, SEED = 128, 4, 1024, 7
BANDS = SAMPLES // ROWS
SLACK = 0.2
BROADCAST_IDS = 2_000_000
#: Bytes of sets that a task hands on at once.
HANDED_BYTES = 4_000_000
#: Shuffle partitions that one task writes, where a table of a round is kept.
TOGETHER = 16
#: Bands that the rounds of hubs look at.
FIRST_BANDS = (2, 8, BANDS)
#: Partners of a document in each round of hubs over prefix shingles; the exact prefix join after them looks at all that are still apart.
PARTNERS = (8, 16, 32)
_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    tokens = text.encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size if size < words else 0, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def min_samples(values: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(values), 512):
        low = np.minimum(low, (values[at : at + 512, None] * _A + _B).min(axis=0))
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each sample flips one bit; 64-bit words as signed integers."""
    at = (_mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + samples[k::ROWS])
    return out.view(np.int64)


def _keep_few(df: DataFrame, label: str) -> DataFrame:
    """`keep` by fewer tasks: the rounds keep dozens of tables that are small for their partitions, and each file that is written costs the executors
    processes of their own (a local file system sets permissions by one) and the driver a listing. Two tasks a core stay, or one for `TOGETHER`
    shuffle partitions if that is more."""
    return keep(df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-parallelism(df.sparkSession) // TOGETHER))), label)


def _sketch(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, rows = whole.slice(at, 512), []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    s = shingle_set(text.as_py() or "", words)
                    if len(s):
                        m = min_samples(s)
                        rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(m), odd_sketch(m)))
                    else:
                        rows.append((doc_id, 0, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        release_memory()

    return run


def sketches(docs: DataFrame, words: int) -> DataFrame:
    rows = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return keep(rows.mapInArrow(_sketch(words), "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>"), "sketches")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over the links (a, b), for every id that has one. Alternates large and small stars; each round is written."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    last, table = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _keep_few(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if table is not None:
            release(table)
        table = edges
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        last = now


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, sets = 0, 0, []
            for k, t in enumerate(b.column(1)):
                sets.append(shingle_set(t.as_py() or "", words).tobytes())
                held += len(sets[-1])
                if held >= HANDED_BYTES or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], names=["id", "set"])
                    first, held, sets = k + 1, 0, []
        release_memory()

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = int((np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left")).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _fewer(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents named in `ids` (a written table of distinct ids), without moving texts when the ids are few enough to send to all."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def sketch_similarity(a: str, b: str):
    """Estimated similarity of two sketch columns."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(differ * 2 >= BITS, 0.0).otherwise(1 + F.lit(BITS / (4 * SAMPLES)) * F.log(1 - 2 * differ / F.lit(BITS)))


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = sketches(docs, words)
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = _keep_few(classes, "classes")
    posted = classes.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    crowded = posted.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = _keep_few(posted.join(crowded, "bucket"), "members")
    ids = _keep_few(members.select(F.col("id").alias("doc_id")).distinct(), "met")
    root = ids.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("root"))
    for bands in FIRST_BANDS:
        active = _open(members.where(F.col("band") < bands), root)
        if active.isEmpty():
            continue
        hubs = active.groupBy("bucket").agg(F.min_by(F.struct("id", "root", "n"), F.xxhash64("id", F.lit(SEED))).alias("hub"))
        hubs = hubs.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.root").alias("hub_root"), F.col("hub.n").alias("hub_n"))
        near_in_size = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
        pairs = active.join(hubs, "bucket").where((F.col("root") != F.col("hub_root")) & near_in_size)
        pairs = _keep_few(_sketched(pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), classes, percent), "pairs")
        chosen = _keep_few(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "confirm")
        root = _joined(root, _confirmed(pairs, _kept_sets(docs, chosen, words), percent))
        release(active)
        release(pairs)
    active = _open(members, root)
    chosen = _keep_few(active.select(F.col("id").alias("doc_id")).distinct(), "confirm")
    if not chosen.isEmpty():
        sets = _kept_sets(docs, chosen, words)
        early = prefixes(sets, percent)
        for seed, partners in enumerate(PARTNERS):
            pairs = _keep_few(_sketched(hub_pairs(early, root, percent, partners, seed), classes, percent), "pairs")
            root = _joined(root, _confirmed(pairs, sets, percent))
            release(pairs)
        pairs = _keep_few(_sketched(prefix_pairs(early, root, percent), classes, percent), "pairs")
        root = _joined(root, _confirmed(pairs, sets, percent))
    named = classes.select("set_id", "id").join(root, "id", "left").select("set_id", F.coalesce("root", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _open(members: DataFrame, root: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that hold more than one."""
    rows = members.join(root, "id")
    split = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
    return _keep_few(rows.join(split, "bucket"), "active")


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule them out."""
    sketch = classes.select("id", "sketch")
    rows = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    return rows.where(sketch_similarity("sa", "sb") >= percent / 100 - SLACK).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return _keep_few(both.mapInArrow(_confirm(percent), "a long, b long"), "links")


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """The components after the links."""
    if links.isEmpty():
        return root
    lifted = links.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = components(lifted).toDF("root", "top")
    return _keep_few(root.join(merged, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, s in zip(b.column(0).to_pylist(), b.column(1)):
            t = np.frombuffer(s.as_buffer(), np.int64)
            for at in range(0, len(t), 65_536):
                part = t[at : at + 65_536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), doc_id)), pa.array(np.full(len(part), len(t))), pa.array(part)], names=["id", "n", "token"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, id, n, place: the shingles of each set that come early enough, from rare to frequent, to reach the threshold."""
    rows = sets.select("id", "set").mapInArrow(_tokens, "id long, n long, token long")
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(shared, "token")
    own = Window.partitionBy("id")  # the shingles of one document
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1  # those of no other come first
    rows = rows.withColumn("place", place).where(F.col("place") * 100 <= F.col("n") * (100 - percent))
    return _keep_few(rows.select("token", "id", "n", "place"), "prefixes")


def _reachable(percent: int):
    """Whether two sets that meet at these places can reach the threshold, and belong to different components."""
    need = F.ceil((F.col("n") + F.col("n2")) * percent / F.lit(100 + percent))
    return (F.col("root") != F.col("root2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.col("place") <= F.col("n") - need) & (
        F.col("place2") <= F.col("n2") - need)


def hub_pairs(rows: DataFrame, root: DataFrame, percent: int, partners: int, seed: int) -> DataFrame:
    """Pairs (a, b) of a document and at most `partners` hubs of its prefix shingles. A shingle has up to `partners` hubs, random rows of it."""
    rows = rows.join(root, "id")
    drawn = F.xxhash64("id", "token", F.lit(seed))
    hubs = rows.groupBy("token", F.pmod(drawn, F.lit(partners)).alias("cell")).agg(F.min_by(F.struct("id", "n", "place", "root"), drawn).alias("hub"))
    hubs = hubs.select("token", F.col("hub.id").alias("id2"), F.col("hub.n").alias("n2"), F.col("hub.place").alias("place2"), F.col("hub.root").alias("root2"))
    met = rows.join(hubs, "token").where(_reachable(percent)).select("id", "id2").distinct()
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "id2", F.lit(seed)), "id2"))
    return met.withColumn("turn", turn).where(F.col("turn") <= partners).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def prefix_pairs(rows: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle early enough to reach the threshold: every linked pair is among them."""
    rows = rows.join(root, "id")
    most = rows.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("most"))
    others = rows.join(most, "token").where("root <> most").select(
        "token", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("root").alias("root2"))
    return rows.join(others, "token").where(_reachable(percent)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _kept_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    texts = _fewer(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
    sets = small_batches(texts).mapInArrow(_sets(words), "id long, set binary")
    return keep(sets, "sets")


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: one of each group, rows that repeat an id once; all columns of `docs`."""
    found = _keep_few(link(docs, words, percent), "near")
    gone = _keep_few(found.where("NOT kept").select("doc_id").distinct(), "gone")
    twice = _keep_few(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "twice")
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_IDS else t
    stay = docs.join(small(gone), "doc_id", "left_anti")
    if twice.isEmpty():
        return stay.select(*docs.columns)
    once = stay.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.join(small(twice), "doc_id", "left_anti").unionByName(once).select(*docs.columns)


SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM tokens)),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (
  SELECT doc_id, list(s ORDER BY s)::VARCHAR AS content FROM shingles GROUP BY doc_id),
class AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS rep FROM sets),
reps AS (
  SELECT s.* FROM shingles s JOIN class c USING (doc_id) WHERE c.rep = c.doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS id, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
roots AS (
  SELECT id, min(root) AS root FROM reach GROUP BY id),
found AS (
  SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(r.root, c.rep, d.doc_id) AS component_id
  FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN class c USING (doc_id) LEFT JOIN roots r ON r.id = c.rep)
SELECT *, component_id = doc_id AS kept FROM found
"""
