"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain. The texts' trigrams
(UTF-8 bytes, A-Z as a-z) that occur in some query are indexed: segments of documents, each with a posting list per trigram. A query
is evaluated with intersections and unions of posting lists, segment by segment; only its candidates are read for that rule. A rule whose
expression has no mandatory trigram (a run of hexadecimal digits) reads every text. Postings hold hashes of whole texts,
so copies share an entry, and a clash of hashes only adds a candidate: the expression itself decides.

Cases: null texts are empty; empty texts have no spans; a null id is kept; repeated rows are answered again; a text of any length is searched whole;
an empty table gives an empty result; other columns are ignored. Letters fold in ASCII only. Spans count code points, the end exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import keep, row_slices, text_buffer

BROADCAST_KEYS = 2_000_000
SEGMENT_BYTES, SEGMENT_DOCS = 16_000_000, 16_384
#: Strings of a sub-expression listed one by one, at most (a larger class counts as any character), and their length.
LISTED, LISTED_LENGTH = 64, 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; one stays when `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


# The three base rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Public formats of other credentials, listed after the base rules.
MORE = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("cloud", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]+", 0, 24),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@", 0, 8),
)

# A query is True (anything), a trigram, or ("and" | "or", queries).
_Query = object


def _all(parts) -> _Query:
    found = []
    for p in parts:
        if p is True:
            continue
        found += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    found = list(dict.fromkeys(found))
    return True if not found else found[0] if len(found) == 1 else ("and", tuple(found))


def _any(parts) -> _Query:
    parts = list(dict.fromkeys(parts))
    if not parts or True in parts:
        return True
    needs = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts]
    parts = [p for p, need in zip(parts, needs) if not any(other < need for other in needs)]  # a part that asks for more adds nothing
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _low(code: int) -> str:
    return chr(code + 32 if 65 <= code <= 90 else code)


def _trigrams(text: str) -> _Query:
    raw = text.encode()
    return _all([raw[i : i + 3] for i in range(len(raw) - 2)])


def _of_strings(strings) -> _Query:
    return _any([_trigrams(s) for s in sorted(strings)]) if strings else True


def trigram_query(pattern: str) -> _Query:
    """What every match of `pattern` contains, as a Boolean query over trigrams of lower-case letters; True where nothing is mandatory."""
    import re._parser as parser  # the library's own syntax tree

    def class_of(items) -> set[str] | None:
        out: set[str] = set()
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                out.add(_low(value))
            elif name == "RANGE" and value[1] - value[0] < LISTED:
                out |= {_low(c) for c in range(value[0], value[1] + 1)}
            else:
                return None  # negation, categories, long ranges
        return out if len(out) <= LISTED else None

    def sequence(tree) -> tuple[set[str] | None, _Query]:
        """(all strings that the sequence matches, if they are few; what it must contain otherwise)"""
        run: set[str] = {""}  # strings of the parts since the last one that could not be listed
        must: list[_Query] = []

        def flush():
            nonlocal run
            must.append(_of_strings(run))
            run = {""}

        whole = True
        for op, value in tree:
            exact, query = node(str(op), value)
            if exact is not None and len(exact) * len(run) <= LISTED and max(map(len, run)) < LISTED_LENGTH:
                run = {x + y for x, y in product(run, exact)}
                continue
            flush()
            whole = False
            if exact is not None:
                run = exact
            else:
                must.append(query)
        if whole:
            return run, True
        flush()
        return None, _all(must)

    def node(name: str, value) -> tuple[set[str] | None, _Query]:
        if name == "LITERAL":
            return {_low(value)}, True
        if name == "IN":
            return class_of(value), True
        if name == "SUBPATTERN":
            return sequence(value[-1])
        if name == "BRANCH":
            parts = [sequence(p) for p in value[1]]
            if all(exact is not None for exact, _ in parts) and sum(len(exact) for exact, _ in parts) <= LISTED:
                return set().union(*(exact for exact, _ in parts)), True
            return None, _any([_of_strings(exact) if exact is not None else query for exact, query in parts])
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = value
            exact, query = sequence(body)
            if exact is not None and (low, high) == (0, 1):
                return exact | {""}, True
            if exact is not None and low == high == 1:
                return exact, True
            if low == 0:
                return None, True
            return None, _of_strings(exact) if exact is not None else query
        if name == "AT":
            return {""}, True
        return None, True

    exact, query = sequence(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def _leaves(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(_leaves(q) for q in query[1]))


def _code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def _segments(trigrams: Sequence[int]):
    wanted = sorted(trigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << 24, -1, np.int16)
        place[wanted] = np.arange(len(wanted))
        segment, postings, size, docs = TaskContext.get().partitionId() << 32, [], 0, 0

        def out():
            both = np.unique(np.concatenate(postings), axis=0) if postings else np.zeros((0, 2), np.int64)
            cuts = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
            offsets = np.append(cuts, len(both)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(both[:, 1]))
            codes = np.array(wanted, np.int32)[both[cuts, 0]] if len(cuts) else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), segment)), pa.array(codes), lists], names=["segment", "trigram", "keys"])

        for b in batches:
            keys, (data, offsets) = b.column(0).to_numpy(), text_buffer(b.column(1))
            for first, last in row_slices(offsets, SEGMENT_BYTES):
                raw, ends = _LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
                if len(raw) > 2:
                    found = place[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
                    hits = np.flatnonzero(found >= 0)
                    row = np.searchsorted(ends, hits, "right") - 1
                    inside = hits + 2 < ends[row + 1]
                    pair = np.unique((found[hits[inside]].astype(np.int64) << 32) | row[inside])
                    postings.append(np.stack([pair >> 32, keys[first + (pair & 0xFFFFFFFF)]], axis=1))
                size, docs = size + len(raw), docs + last - first
                if size >= SEGMENT_BYTES or docs >= SEGMENT_DOCS:
                    yield out()
                    segment, postings, size, docs = segment + 1, [], 0, 0
        yield out()

    return run


def index(docs: DataFrame, trigrams: Sequence[bytes]) -> DataFrame:
    """The posting lists: (segment, trigram, keys) for the given trigrams, `keys` the distinct hashes of the segment's texts that hold one."""
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    return rows.mapInArrow(_segments([_code(t) for t in trigrams]), "segment long, trigram int, keys array<long>")


def _evaluate(query, postings: Callable[[bytes], Column]) -> Column:
    if isinstance(query, bytes):
        return postings(query)
    parts = [_evaluate(q, postings) for q in query[1]]
    merge = F.array_intersect if query[0] == "and" else F.array_union
    out = parts[0]
    for p in parts[1:]:
        out = merge(out, p)
    return out


def candidates(postings: DataFrame, queries: dict[int, _Query]) -> DataFrame:
    """(key, rules): the hashes of texts that satisfy some query, with a bit for each of its rules. A segment is the group: its size is bounded."""
    lists = postings.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    empty = F.array().cast("array<long>")

    def of(trigram: bytes) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(_code(trigram)).cast("int")), empty)

    hits = lists.select(F.explode(F.array(*[
        F.struct(F.lit(1 << bit).cast("long").alias("rule"), _evaluate(q, of).alias("keys")) for bit, q in queries.items()])).alias("hit"))
    hits = hits.select(F.col("hit.rule").alias("rule"), F.explode("hit.keys").alias("key"))
    return hits.groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _verify(rules: Sequence[Rule], everywhere: int):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(k, 1 << k, r.kind, r.compiled(), r.group, r.least) for k, r in enumerate(rules)]
        # a run of one class needs no list of its short matches
        patterns = [(k, bit, kind, re.compile(p.pattern[:-1] + f"{{{least},}}", p.flags), 0, 1) if re.fullmatch(r"\[[^\]]+\]\+", p.pattern) else
                    (k, bit, kind, p, group, least) for k, bit, kind, p, group, least in patterns]
        for b in batches:
            spans = []
            for text, mask in zip(b.column(1), b.column(2).to_pylist()):
                found, mask = [], (mask or 0) | everywhere
                text = text.as_py() or ""
                for k, bit, kind, pattern, group, least in patterns:
                    if mask & bit:
                        found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
                spans.append([{"kind": kind, "start": s, "end": e} for s, _, kind, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return run


def find(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """doc_id, spans (kind, start, end; by start, then in the order of `rules`) of every row."""
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q is not True}
    everywhere = sum(1 << k for k, q in queries.items() if q is True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if indexed:
        postings = keep(index(rows, sorted(set().union(*map(_leaves, indexed.values())))), "postings")
        found = keep(candidates(postings, indexed), "candidates")
        few = found.count() <= BROADCAST_KEYS
        rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).join(F.broadcast(found) if few else found, "key", "left")
        rows = rows.select("doc_id", "text", "rules")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    return rows.mapInArrow(_verify(rules, everywhere), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base rules' spans) and spans (of all rules), as kind:start:end, comma-joined."""
    base = [r.kind for r in BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select(
        "doc_id", *[number(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _either_case(pattern: str) -> str:
    """The pattern with every letter outside classes as a class of both cases; classes here hold both cases already."""
    out, inside = [], False
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            size = 4 if pattern[k + 1] == "x" else 2
            out.append(pattern[k : k + size])
            k += size
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c)
        k += 1
    return "".join(out)


def sql(rules: Sequence[Rule] = BASE + MORE) -> str:
    """The twin: every rule over every text; places are sums of the lengths of what lies between matches."""
    parts = []
    for k, r in enumerate(rules):
        pattern = (_either_case(r.pattern) if r.fold else r.pattern).replace("'", "''")
        kept = f"length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least}"
        parts.append(f"""
SELECT row, {k} AS rank, '{r.kind}' AS kind, i, m, {kept} AS kept,
  (list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
FROM (SELECT row, ms, between, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
  FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS between FROM docs) WHERE len(ms) > 0)""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT row, rank, kind, start, kind || ':' || start || ':' || (start + length(m)) AS span FROM matches WHERE kept),
by_row AS (
  SELECT row, {counts}, coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})), '') AS base,
    string_agg(span, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_row USING (row)
"""
