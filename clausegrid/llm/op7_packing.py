"""Packing: concatenate and cut.

The documents' tokens, each document followed by an end id, form one long row of ids in the order of the partitions. The
first pass tokenizes and keeps ids and sums per partition; the partitions' totals give global offsets; the second pass
cuts at multiples of the sequence length. A document across a cut or a partition's end gets a record on either side. Only
the last sequence can be short.

Texts are cut at places where the tokenizer always splits; of each slice of a batch only the distinct pieces are tokenized, and their ids are
taken by the pieces' numbers, without a step per piece (pieces of Latin letters go through the tokenizer's own merges, see `_merges`). A literal added token in a text gets its own id, as the tokenizer alone would give.

Cases: null and empty texts are the end id alone; repeated rows are packed again; very long texts are a slice of their own; an empty
table gives an empty result; other columns are ignored."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import keep, release_memory, row_slices, text_buffer, with_global_sums, with_part_sums

LENGTH = 2048
END_ID = 1
#: Pieces remembered between slices: those that occur so often in one.
CACHED_PIECES, OFTEN = 200_000, 2
SLICE_BYTES = 4_000_000
_loaded: dict[str, tuple] = {}
# Fixed value: the byte-level tokenizers' pattern of words, numbers, punctuation and white space.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class is the same for every library; pieces of others go through the tokenizer itself.
_SURE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*").fullmatch
#: Bytes that may follow a space where a text is cut: no white space, and no first byte of a character that can be white space beyond ASCII.
_SAFE = np.ones(256, bool)
_SAFE[:33] = False
_SAFE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _merges(tokenizer):
    """The tokenizer's own merges as a plain byte-pair encoder, which is several times faster on pieces not met before; None unless the
    tokenizer is a byte-level one without normalisation whose ids follow the order of its merges, so that both give the same ids."""
    spec = json.loads(tokenizer.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("unk_token") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("end_of_word_suffix"):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {a["content"] for a in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m)] for m in model["merges"]]
    if len(ranks) != 256 + len(merged) or merged != list(range(256, 256 + len(merged))):
        return None
    import tiktoken

    return tiktoken.Encoding("merges", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokenizer(path: str):
    """The tokenizer, its merges, its added tokens, and the ids of pieces met so far, kept while the worker lives."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _loaded[path] = (t, _merges(t), [a.content for a in t.get_added_tokens_decoder().values()], {})
    return _loaded[path]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, and before every space that a safe byte follows. A byte-level tokenizer's own pattern always
    splits there, and its added tokens hold no space."""
    begin = np.zeros(len(data) + 1, bool)
    begin[:-2] = (data[:-1] == 32) & _SAFE[data[1:]]
    begin[offsets] = True
    return np.flatnonzero(begin[:-1])


def piece_ids(pieces: list[str], often: list[bool], path: str) -> pa.Array:
    """The ids of distinct pieces, as lists. What occurs `often` is remembered for later slices."""
    tokenizer, merges, added, known = _tokenizer(path)
    found = [known.get(p) for p in pieces]
    for k, ids in enumerate(found):
        if ids is None:
            p = pieces[k]
            if merges and _SURE(p) and not any(a in p for a in added):
                new = merges.encode_ordinary(p)
            else:
                new = tokenizer.encode(p, add_special_tokens=False).ids
            found[k] = array("I", new).tobytes()
            if often[k] and len(known) < CACHED_PIECES:
                known[p] = found[k]
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.uint32)))


def encode(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a column, each followed by the end id, and the number of ids of each text."""
    data, offsets = text_buffer(column)
    begin = cuts(data, offsets)
    bounds = np.append(begin, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    number = pieces.indices.to_numpy()
    often = np.bincount(number, minlength=len(pieces.dictionary)) >= OFTEN
    lists = piece_ids(pieces.dictionary.to_pylist(), often.tolist(), path).take(pieces.indices)
    flat = lists.flatten().to_numpy()
    piece_end = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    at = piece_end[np.searchsorted(begin, offsets)]
    counts = np.diff(at)
    out = np.empty(len(flat) + len(counts), "<u4")
    out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
    out[at[1:] + np.arange(len(counts))] = end_id
    return out, counts + 1


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last in row_slices(text_buffer(b.column(1))[1], SLICE_BYTES):
                ids, counts = encode(b.column(1).slice(first, last - first), path, end_id)
                ends = (np.concatenate([[0], np.cumsum(counts)]) * 4).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(counts.astype(np.int64)), raw], names=["doc_id", "doc_tokens", "ids"])
        release_memory()

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for doc, n, ids, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                    raw, start = memoryview(ids.as_buffer()), 0
                    while start < n:
                        sequence, offset = divmod(before + start, length)
                        size = min(n - start, length - offset)
                        rows.append((doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, sequence, offset))
                        start += size
                cols = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens, ids (with the end id), and `_before_doc_tokens`: the number of ids in front of the document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.mapInArrow(_tokenize(path, end_id), "doc_id long, doc_tokens long, ids binary")
    return with_global_sums(keep(with_part_sums(ids, ["doc_tokens"]), "pack-ids"), ["doc_tokens"])


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return token_table(docs, path, end_id).select("doc_id", "doc_tokens", "ids", "_before_doc_tokens").mapInArrow(_cut(length), PIECES)
