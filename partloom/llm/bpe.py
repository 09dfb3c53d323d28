"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than one chunk is cut into chunks that overlap. Every chunk is pre-tokenised on its own, in parallel.
Two neighbours agree from the first position, inside their overlap, at which both start a pre-token: from there a
regular-expression scan goes the same way whatever came before. The stitch keeps the left chunk's pieces up to that
position and the right chunk's from it on. Texts of one chunk need no shuffle.

Defined results: a null text counts as empty and has no tokens; an empty text has no tokens; repeated rows give
repeated results; a text without any boundary in an overlap is scanned on sequentially from the last agreed boundary.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, free_name, keeps, prepare, without

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
#: Pieces kept per Python worker (some 25 MB); the cache is emptied when full, which changes nothing but time.
CACHE_PIECES = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceEncoder(dict):
    """Pre-token -> its ids, four bytes each; merged by the library when first seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids = array("i", self.library.encode_ordinary(piece)).tobytes()
        return ids


#: Fixed value: the pre-token pattern of the rank files in the terms of Python's own engine, which is faster. Both agree
#: on texts of the characters below (letters are [^\W\d_] and numbers \d as long as there are none like ² or Ⅷ).
PLAIN = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")}
_OTHER = re.compile("[^\t\n\r -~\u00a0-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


class Cutter:
    """Pre-tokens of a text."""

    def __init__(self, pattern: str):
        self.full, self.plain = regex.compile(pattern), PLAIN.get(pattern)

    def __call__(self, text: str):
        return self.plain if self.plain and not _OTHER.search(text) else self.full


_held: dict[int, tuple] = {}
keeps("bpe", _held.clear)


def _encoder(ranks, pattern: str) -> tuple:
    """The worker's encoder for a broadcast rank table; kept until the worker serves another operator."""
    alone("bpe")
    if (key := hash((id(ranks.value), pattern))) not in _held:
        _held.clear()
        _held[key] = (PieceEncoder(ranks.value, pattern), Cutter(pattern), ranks)
    return _held[key][:2]


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as an array of lists."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def stitch(chunks: list[dict], encoder: PieceEncoder, cut: Cutter) -> bytes:
    """Packed ids of a text from its chunks in order; chunk: start, text, starts of pieces, tokens per piece, packed ids."""
    parts: list[bytes] = []
    left, at = chunks[0], 0  # from piece number `at` of `left` on, the scan is the whole text's
    for k, right in enumerate(chunks[1:], 1):
        own, theirs = left["start"] + left["starts"][at:], right["start"] + right["starts"]
        place = np.searchsorted(theirs, own)
        agree = np.flatnonzero(theirs[np.minimum(place, len(theirs) - 1)] == own) if len(theirs) else place[:0]
        base = 4 * int(left["sizes"][:at].sum())
        if not len(agree):  # no common boundary: scan the rest in one go
            begin = int(own[0]) if len(own) else left["start"]
            rest = left["text"][begin - left["start"] :]
            done = left["start"] + len(left["text"])
            for c in chunks[k:]:
                rest += c["text"][max(0, done - c["start"]) :]
                done = max(done, c["start"] + len(c["text"]))
            return b"".join([*parts, *map(encoder.__getitem__, cut(rest).findall(rest))])
        met = int(agree[0])
        parts.append(left["ids"][base : base + 4 * int(left["sizes"][at : at + met].sum())])
        left, at = right, int(place[met])
    return b"".join([*parts, left["ids"][4 * int(left["sizes"][:at].sum()) :]])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "token_ids", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, keep_text: bool = True) -> DataFrame:
    """docs with the array of token ids of each text in `out` (a column of that name is replaced); keep_text: the texts as well.

    ranks is the bounded vocabulary, read from a rank file; it is broadcast to the tasks.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ranks)
    docs = without(docs, out)
    body = F.coalesce(F.col(text), F.lit(""))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def whole(texts: pa.Array) -> pa.Array:
        encoder, cut = _encoder(shared, pattern)
        return _lists([b"".join(map(encoder.__getitem__, cut(t).findall(t))) for t in texts.to_pylist()])

    short = docs.filter(F.length(body) <= chunk_chars).withColumn(out, whole(body))

    row, number, start, piece, begins, lengths, packed = (free_name(docs, x) for x in ("bpe_row", "bpe_number", "bpe_start", "bpe_text", "bpe_begins", "bpe_lengths", "bpe_packed"))
    long = docs.filter(F.length(body) > chunk_chars).withColumn(row, F.monotonically_increasing_id())
    cut_up = long.select("*", F.posexplode(F.sequence(F.lit(0), F.length(body) - 1, F.lit(chunk_chars))).alias(number, start))
    rest = [c for c in docs.columns if c != text]
    cut_up = cut_up.select(row, number, start, F.expr(f"substring(`{text}`, `{start}` + 1, {chunk_chars + overlap_chars})").alias(piece), *[F.when(F.col(number) == 0, F.col(c)).alias(c) for c in rest])
    schema = T.StructType([*cut_up.schema.fields, T.StructField(begins, T.ArrayType(T.IntegerType())), T.StructField(lengths, T.ArrayType(T.IntegerType())), T.StructField(packed, T.BinaryType())])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut = _encoder(shared, pattern)
        for b in batches:
            starts, sizes, ids = [], [], []
            for t in b.column(piece).to_pylist():
                found = [(m.start(), encoder[m.group()]) for m in cut(t).finditer(t)]
                starts.append(array("i", [p for p, _ in found]).tobytes())
                sizes.append(array("i", [len(x) // 4 for _, x in found]).tobytes())
                ids.append(b"".join([x for _, x in found]))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(starts), _lists(sizes), pa.array(ids, pa.binary())], names=[*b.schema.names, begins, lengths, packed])

    held = [f for f in docs.schema.fields if keep_text or f.name != text]
    joined_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in held] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def join(group: pa.Table) -> pa.Table:
        """One long text: its chunks, which together hold no more than that text and its overlaps."""
        encoder, cut = _encoder(shared, pattern)
        numbers = lambda c, i: c[i].values.to_numpy().astype(np.int64)
        at = {n: i for i, n in enumerate(group[number].to_pylist())}
        chunks = [{"start": group[start][i].as_py(), "text": group[piece][i].as_py(), "starts": numbers(group[begins], i), "sizes": numbers(group[lengths], i), "ids": group[packed][i].as_py()} for _, i in sorted(at.items())]
        first = group.slice(at[0], 1)
        made = {out: _lists([stitch(chunks, encoder, cut)])}
        if keep_text:
            made[text] = pa.array(["".join(c["text"][:chunk_chars] for c in chunks)], type=pa.string())
        return pa.table({f.name: made[f.name] if f.name in made else first.column(f.name) for f in joined_schema.fields})

    spread = cut_up.repartition(F.col(row), F.col(number))
    stitched = spread.mapInArrow(chunk, schema).groupBy(row).applyInArrow(join, joined_schema)
    return (short if keep_text else short.drop(text)).unionByName(stitched)


def put_together(rows: pa.Array, tokens: pa.Array) -> pa.Array:
    """The bytes that each list of ids stands for: the tokens' bytes are taken in a row, and the lists' ends are places in them."""
    taken = tokens.take(rows.flatten())
    places = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    ends = np.append(0, np.cumsum(np.array(pc.fill_null(pc.list_value_length(rows), 0), np.int64)))
    whole = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(places[ends])), taken.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(rows.is_null(), pa.scalar(None, pa.binary()), whole) if rows.null_count else whole


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for in `out`: the tokens' bytes, put together. Null ids give null."""
    spark = prepare(df.sparkSession)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = spark.sparkContext.broadcast(pa.array(tokens, pa.binary()))

    @F.arrow_udf(T.BinaryType())
    def together(rows: pa.Array) -> pa.Array:
        alone("bpe")  # a worker decodes and encodes in turn, and stays with its encoder
        return put_together(rows, shared.value)

    return without(df, out).withColumn(out, together(F.col(ids)))
