"""Byte-level BPE: every merge of a public vocabulary replayed over the different words of a corpus."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, scratch_path

ARROW_ROWS = 200
# Bytes of text whose documents share a list of different pieces, and characters from which pieces are taken one by one.
CHUNK_BYTES, LONG_TEXT = 8_000_000, 4_000_000
# Bytes of different pieces whose merges one index holds, and pieces whose ids a task remembers.
INDEX_BYTES, KNOWN_PIECES = 2_000_000, 1_000_000
# Rows of pieces a task holds until their ids are known.
HELD_ROWS = 64
# A chunk is one row of documents (doc_ids, counts of pieces, numbers of pieces, shard of each number) and one row of
# pieces for each shard; blobs hold n pieces or their ids in size bytes before compression.
CHUNK = ("chunk long, doc_ids array<long>, counts array<int>, places binary, shards binary, "
         "shard int, n long, size long, blob binary")
IDS = "chunk long, shard int, n long, size long, blob binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of a token in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Places(dict):
    """Numbers pieces in the order of their first use."""

    def __missing__(self, piece: str) -> int:
        self[piece] = len(self)
        return self[piece]


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, first the lowest of all: small numbers leave rows of zeros."""
    return np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(4, -1).T).view("<u4").ravel()


def _packed(raw: bytes) -> tuple[int, bytes]:
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(size: int, blob: bytes) -> bytes:
    return pa.decompress(blob, size, codec="zstd", asbytes=True)


def _split(pattern: str, shards: int):
    """Documents as numbers of their pieces; the different pieces of a chunk of documents once, by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                            ("places", pa.binary()), ("shards", pa.binary()), ("shard", pa.int32()), ("n", pa.int64()),
                            ("size", pa.int64()), ("blob", pa.binary())])
        chunk = TaskContext.get().partitionId() << 32
        known, ids, places, size = _Places(), [], [], 0

        def flush():
            pieces = [p.encode() for p in known]
            shard = np.fromiter((crc32(p) % shards for p in pieces), "int64", len(pieces))
            rows = [(chunk, ids, [len(x) for x in places], _planes(np.concatenate(places)), _planes(shard), *[None] * 4)]
            order = np.argsort(shard, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                own = [pieces[j] for j in i]
                raw = _planes(np.fromiter(map(len, own), "int64", len(own))) + b"".join(own)
                rows.append((chunk, *[None] * 4, int(shard[i[0]]), len(own), *_packed(raw)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = cut.findall(text) if len(text) < LONG_TEXT else (m[0] for m in cut.finditer(text))
                ids.append(doc_id)
                places.append(np.fromiter(map(known.__getitem__, found), "int32"))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from flush()
                    chunk += 1
                    known, ids, places, size = _Places(), [], [], 0
        if ids:
            yield from flush()
    return run


class Merges:
    """Ranks of pairs of neighbouring tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """The rank of the token that the two make, -1 if there is none."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.pairs[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r


def replay(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each of ``pieces``, a token's rank where the piece is one.

    The bytes of all other pieces stand in one row, and an index holds the
    positions of each pair by its rank.  Ranks are taken in order, each with
    all its positions from left to right; a merge looks up the two pairs it
    makes with its neighbours and adds them to the index.  Entries whose pair
    was broken up by a merge before are passed over.  Should a merge make a
    pair of a lower rank than its own, that one goes first.
    """
    tokens: list[int] = []
    after: list[int] = []  # the place of the next token of the piece, -1 behind the last
    before: list[int] = []
    starts = [-1] * len(pieces)
    for number, piece in enumerate(pieces):
        if piece in merges.ranks or not piece:
            continue
        a = starts[number] = len(tokens)
        tokens.extend(map(merges.byte.__getitem__, piece))
        n = len(tokens)
        after.extend(range(a + 1, n))
        after.append(-1)
        before.append(-1)
        before.extend(range(a, n - 1))
    index: dict[int, list[int]] = {}
    rank = merges.rank
    for p, q in enumerate(after):
        if q >= 0:
            r = rank(tokens[p], tokens[q])
            if r >= 0:
                index.setdefault(r, []).append(p)
    queue = sorted(index)
    while queue:
        r = heappop(queue)
        places = sorted(index.pop(r))
        for i, p in enumerate(places):
            q = after[p]
            if tokens[p] < 0 or q < 0 or rank(tokens[p], tokens[q]) != r:
                continue
            tokens[p], tokens[q] = r, -1
            end = after[p] = after[q]
            lowest = r
            if end >= 0:
                before[end] = p
                made = rank(r, tokens[end])
                if made >= 0:
                    if made not in index:
                        index[made] = []
                        heappush(queue, made)
                    index[made].append(p)
                    lowest = min(lowest, made)
            left = before[p]
            if left >= 0:
                made = rank(tokens[left], r)
                if made >= 0:
                    if made not in index:
                        index[made] = []
                        heappush(queue, made)
                    index[made].append(left)
                    lowest = min(lowest, made)
            if lowest < r:
                if r not in index:
                    heappush(queue, r)
                index.setdefault(r, []).extend(places[i + 1:])
                break
    out = []
    for number, piece in enumerate(pieces):
        if starts[number] < 0:
            out.append([merges.ranks[piece]] if piece else [])
            continue
        ids, p = [], starts[number]
        while p >= 0:
            ids.append(tokens[p])
            p = after[p]
        out.append(ids)
    return out


def _pieces(n: int, size: int, blob: bytes) -> list[bytes]:
    raw = _unpacked(size, blob)
    ends = (4 * n + np.concatenate([[0], np.cumsum(_numbers(raw[:4 * n]).astype("int64"))])).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _encode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(ranks.value)
        known: dict[bytes, list[int]] = {}
        new: dict[bytes, None] = {}
        held: list[tuple] = []
        size = 0

        def flush():
            known.update(zip(new, replay(list(new), merges)))
            rows: list[list] = []
            for chunk, shard, pieces in held:
                ids = [known[p] for p in pieces]
                raw = (_planes(np.fromiter(map(len, ids), "int64", len(ids)))
                       + _planes(np.fromiter(chain.from_iterable(ids), "int64")))
                rows.append([chunk, shard, len(ids), *_packed(raw)])
            if len(known) > KNOWN_PIECES:
                known.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["chunk", "shard", "n", "size", "blob"])

        for batch in batches:
            for chunk, shard, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = _pieces(*blob)
                held.append((chunk, shard, pieces))
                for p in pieces:
                    if p not in known and p not in new:
                        new[p] = None
                        size += len(p)
                if size >= INDEX_BYTES or len(held) >= HELD_ROWS:
                    yield flush()
                    new, held, size = {}, [], 0
        if held:
            yield flush()
    return run


def _gathered(values: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``wanted`` of a row of lists (``values`` cut at ``ends``), one after the other, and their lengths."""
    size = (ends[1:] - ends[:-1])[wanted]
    shift = np.repeat(ends[:-1][wanted] - (np.cumsum(size) - size), size)
    return values[np.arange(len(shift)) + shift], size


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("int32").tobytes()),
                                                              pa.py_buffer(data.tobytes())])


def _assemble(ranks):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        doc = docs.to_pylist()[0]
        ids, sizes = [np.zeros(0, "uint32")], [np.zeros(0, "uint32")]
        for r in words.sort_by("shard").to_pylist():
            raw = _unpacked(r["size"], r["blob"])
            sizes.append(_numbers(raw[:4 * r["n"]]))
            ids.append(_numbers(raw[4 * r["n"]:]))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes).astype("int64"))])
        shard = _numbers(doc["shards"])
        at = np.empty(len(shard), "int64")  # where the pieces, numbered by first use, stand in the order of shards
        at[np.argsort(shard, kind="stable")] = np.arange(len(shard))
        flat, size = _gathered(np.concatenate(ids), ends, at[_numbers(doc["places"])])
        doc_ends = np.concatenate([[0], np.cumsum(doc["counts"])]).astype("int64")
        token_ends = np.concatenate([[0], np.cumsum(size)])[doc_ends]
        # the bytes of all tokens in a row, by id
        table = ranks.value
        tokens = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            tokens[i] = token
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        text, size = _gathered(np.frombuffer(b"".join(tokens), "uint8"), cuts, flat)
        byte_ends = np.concatenate([[0], np.cumsum(size)])[token_ends]
        return pa.table({"doc_id": pa.array(doc["doc_ids"], pa.int64()), "n_tokens": pa.array(np.diff(token_ends)),
                         "ids": _binary(flat.astype("<u4"), token_ends * 4), "decoded": _binary(text, byte_ends)})
    return run


def _bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``column``, as its tasks have it, and read back.

    A join by ``column`` then moves the other side only.  The name in the
    catalog goes again at once; the files stay.
    """
    spark = df.sparkSession
    name = f"playlake_chunks_{uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", scratch_path(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts by the ranks in the file ``path``, each match of ``pattern`` by itself, and decode the ids.

    The driver reads the file once; its tokens (some hundred kilobytes,
    whatever the corpus) are sent to the tasks.  Texts are split once, into
    numbers of the different pieces of their chunk of documents (about
    ``CHUNK_BYTES`` of text; a longer document is a chunk of its own), and
    are not moved.  The different pieces go to shards by their hash, packed
    by chunk; there :func:`replay` encodes each piece of the corpus once, for
    all chunks that have it.  The ids go back to the chunks, which lie in
    buckets, and their documents are put together from them.

    Returns one row per row of ``docs``: doc_id, n_tokens, ids (unsigned
    32-bit integers, little-endian), decoded (bytes of the decoded ids).
    Null texts are empty and have no ids.  Rows that repeat come back each.
    Special tokens are ordinary text.  Empty table: no rows.  Other columns
    are not used.
    """
    spark = docs.sparkSession
    arrow_rows(spark, ARROW_ROWS)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = _bucketed(texts.mapInArrow(_split(pattern, shards), CHUNK), "chunk", shards)
    pieces = parts.where("shard IS NOT NULL").select("chunk", "shard", "n", "size", "blob")
    words = pieces.repartition("shard").mapInArrow(_encode(ranks), IDS)
    rows = parts.where("shard IS NULL").select("chunk", "doc_ids", "counts", "places", "shards")
    return rows.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        _assemble(ranks), "doc_id long, n_tokens long, ids binary, decoded binary")
