"""An interpolated modified Kneser-Ney model of three words as sharded counts, which chunks of documents ask for what they hold."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DROP_SHUFFLES, non_empty, remove, saved, scratch, scratch_path, settings

START, END = "\x02", "\x03"
# Discounts where the counts of counts give none (fixed values).
FALLBACK = (0.5, 1.0, 1.5)
# Words of the runs whose worst mean is a score of its own.
RUNS = (1, 3)
# Words of an n-gram.
WORD_ORDER = 3
# The ids of words that no training text has, and of the places before a text's first word; words have ids from the number of shards on.
UNKNOWN, BEGIN = range(2)
# Bytes of text scored together, at least one document: what they look up is asked for once for all of them.
CHUNK_BYTES = 4 * 2 ** 20
# Bytes by which each document of a chunk counts besides its text.
ROW_BYTES = 64
# Parts of the chunks that are scored one after the other, so that questions and answers of one part only are on the disk.
ROUNDS = 8
# Chunks of a round at least, for parallel work; fewer chunks are one round.
ROUND_CHUNKS = 4
# n-grams of a shard by expectation, and bytes of text that ask one shard.
SHARD_GRAMS, SHARD_BYTES = 500_000, 32 * 2 ** 20
# Fewest shards, for parallel work.
LEAST_SHARDS = 16
# Words of a block of the vocabulary.
BLOCK_WORDS = 100_000
# Places of a chunk whose probabilities are added up at once, so that what a Python worker holds on the way stays small.
BLOCK_PLACES = 65_536
# Rows of one Arrow batch of texts, so that a batch of long ones fits a Python worker.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
# A chunk's blob is some MB: few to an Arrow batch.
BLOB_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2"}
# Character grams are short.
LOG_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "50000"}
# What a row is about.
CHARS, WORDS, PAIRS, TRIPLES, IDS, TEXTS, BLOCK, SPELT, STARTS = range(9)
PACKED = "kind int, part int, chunk long, shard int, train boolean, x binary, y binary, z binary, w binary, v binary"
NUMBERED = "kind int, part int, chunk long, shard int, x binary, y binary, known long"
ROW = "kind int, shard int, chunk long, x binary, y binary, z binary, w binary"
STATS = ("n1", "n2", "n3", "n4", "types", "total")
COUNTED = ROW + "".join(f", {s} long" for s in STATS)
ANSWER = "chunk long, kind int, shard int, x binary, y binary"
SCORES = "id long, k1 long, k2 long, lang string, n long, cost double, spelling double, repeats double" \
    + "".join(f", run{k} double" for k in RUNS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, from the counts of counts."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        own = tuple(i - (i + 1) * y * b / a for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        if all(0 < own[i - 1] <= i for i in (1, 2, 3)):
            return own
    return FALLBACK


def mix(salt: int, *ids: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row of ``ids``; ``salt`` tells kinds of keys apart."""
    h = np.full(len(ids[0]), salt, "uint64") * np.uint64(0x9E3779B97F4A7C15)
    for x in ids:
        h = (h ^ np.asarray(x, "int64").view("uint64")) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h.view("int64")


def windows(words: list[str], n: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The character ``n``-grams that predict each character of a word and its end.

    The padded words as one string, and of each gram its place in it, the word's number and the key.
    """
    start = START * (n - 1)
    joined = "".join([f"{start}{w}{END}" for w in words])
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "uint32").astype("int64")
    # a word of m characters has m + n of the string, of which m + 1 begin a gram
    size = np.array([len(w) + n for w in words], "int64")
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(units)) - np.repeat(np.cumsum(size) - size, size)
    first = np.flatnonzero(at <= size[owner] - n)
    return joined, first, owner[first], mix(n, *[units[first + i] for i in range(n)])


def gram_keys(grams: list[str], n: int) -> np.ndarray:
    """The keys that :func:`windows` gives these grams of ``n`` characters."""
    units = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "uint32").astype("int64").reshape(-1, n)
    return mix(n, *units.T)


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unzip(b: bytes) -> bytes:
    size = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _enc(x: np.ndarray) -> bytes:
    """64-bit values byte by byte, the first bytes of all before the second, as many as the greatest needs: sorted or small ones compress well."""
    x = np.ascontiguousarray(x, "int64").ravel()
    width = (int(x.view("uint64").max()).bit_length() + 7) // 8 or 1 if len(x) else 1
    return bytes([width]) + _zip(x.view("uint8").reshape(-1, 8).T[:width].tobytes())


def _dec(b: bytes) -> np.ndarray:
    width, raw = b[0], _unzip(b[1:])
    out = np.zeros((len(raw) // width, 8), "uint8")
    out[:, :width] = np.frombuffer(raw, "uint8").reshape(width, -1).T
    return out.view("int64").ravel()


def _enc_up(x: np.ndarray) -> bytes:
    """Sorted values by their differences."""
    return _enc(np.diff(x, prepend=x[:1] * 0))


def _dec_up(b: bytes) -> np.ndarray:
    return np.cumsum(_dec(b))


def _all(values, dec=_dec) -> np.ndarray:
    return np.concatenate([np.zeros(0, "int64"), *[dec(v) for v in values]])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: a range of the unsigned keys, so that sorted keys are sorted by shard too."""
    return ((keys.view("uint64") >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype("int64")


def _sorted(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys.view("uint64"))


def _rank(order: np.ndarray) -> np.ndarray:
    """The place of each in ``order``."""
    rank = np.empty(len(order), "int64")
    rank[order] = np.arange(len(order))
    return rank


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, "int64")


def _first(codes: np.ndarray, m: int) -> np.ndarray:
    """The first place of each of ``m`` codes."""
    out = np.zeros(m, "int64")
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


class Layout:
    """Numbers of words and pairs of words with ids up to ``top`` whose order is that of their shards.

    A shard is the remainder of the ids' sum, so that a pair's first word
    and its shard tell the second but for its quotient: numbers of one shard
    lie close and their differences are small.
    """

    def __init__(self, shards: int, top: int):
        self.shards, self.top = shards, top
        self.row = top // shards + 1
        self.width = {WORDS: self.row, PAIRS: (top + 1) * self.row}
        if shards * self.width[PAIRS] >= 2 ** 63:
            raise ValueError(f"{top} words make more pairs than 64 bits tell apart")

    def word(self, b: np.ndarray) -> np.ndarray:
        return b % self.shards * self.row + b // self.shards

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) % self.shards * self.width[PAIRS] + a * self.row + b // self.shards

    def words(self, shard: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two words of pairs that are numbered inside a shard."""
        a = inside // self.row
        return a, inside % self.row * self.shards + (shard - a) % self.shards

    def runs(self, kind: int, numbers: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(shard, start, stop, numbers inside it) of sorted numbers."""
        width = self.width[kind]
        for s, i, j in _by_shard(numbers // width):
            yield s, i, j, numbers[i:j] - s * width


class Places:
    """The words of some texts in one row each: code (number of the word), owner (number of the text), at (place in it).

    ``sizes`` are the characters of each different word and its end.
    """

    def __init__(self, code: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.code, self.counts, self.sizes = code, counts, sizes
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)

    @property
    def size(self) -> np.ndarray:
        """Characters of each place's word and its end."""
        return self.sizes[self.code]

    def before(self, x: np.ndarray, k: int, spare: int) -> np.ndarray:
        """The value of ``x`` ``k`` words ahead in the same text."""
        return np.where(self.at >= k, np.concatenate([np.full(k, spare), x])[:len(x)], spare)


def _strings(data: bytes, size: np.ndarray) -> pa.Array:
    """Strings that stand one after the other in ``data``, from their bytes."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype("int64")
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some strings and where each begins and the last ends."""
    words = words.cast(pa.large_string())
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, "int64")[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, "int64")
    return np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8"), ends


def _dealt(words: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of different words by shard, in which those of a shard that begin alike are neighbours, and the shards in that order."""
    data, ends = _bytes(words)
    size = np.diff(ends)
    first = np.zeros(len(size), "uint64")
    for i in range(8):
        first = first << np.uint64(8) | np.where(size > i, data[np.minimum(ends[:-1] + i, len(data) - 1)], 0).astype("uint64")
    at = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)
    # a sum over the bytes deals the words; they are told apart by themselves
    spread = mix(1, at).view("uint64") | np.uint64(1)
    sums = np.add.reduceat(data[ends[0]:ends[-1]].astype("uint64") * spread, ends[:-1] - ends[0])
    shard = _shard(mix(2, sums.view("int64")), shards)
    order = np.lexsort((first, shard))
    return order, shard[order]


def _give_back() -> None:
    """What Arrow keeps for later goes back: a Python worker lives on after its task, and the next one's arrays are numpy's."""
    pa.default_memory_pool().release_unused()


def _pack(limit: int, shards: int, rounds: int):
    """Rows in chunks of about ``limit`` bytes of text, as numbers of their words; training texts have chunks of their own.

    A chunk is one row without words, and one row for each shard of its
    different words, with how often training texts have them.  The chunk's
    numbers begin with its frequent words.
    """
    names = [x.split()[0] for x in PACKED.split(", ")]

    def packed(table: pa.Table, train: bool, chunk: int) -> pa.RecordBatch:
        parts = pc.utf8_split_whitespace(pc.fill_null(table["text"].combine_chunks().cast(pa.large_string()), ""))
        flat, begin = parts.flatten(), np.asarray(parts.offsets, "int64")
        full = pc.not_equal(flat, "")
        counts = np.diff(np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[begin - begin[0]])
        flat = flat.filter(full).dictionary_encode()
        code, words = flat.indices.to_numpy().astype("int64"), flat.dictionary
        order, shard = _dealt(words, shards) if len(words) else (np.zeros(0, "int64"),) * 2
        words = words.take(pa.array(order))
        code = _rank(order)[code]
        count = np.bincount(code, minlength=len(order))
        sizes = pc.utf8_length(words).to_numpy().astype("int64") + 1
        out = io.BytesIO()
        keys = table.drop_columns(["text"])
        with pa.ipc.new_stream(out, keys.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(keys)
        part = ((chunk >> 33) + (chunk & 2 ** 33 - 1)) % rounds
        frequent = _rank(np.argsort(-count, kind="stable"))
        rows = [(TEXTS, part, chunk, 0, train, out.getvalue(), _enc(counts), _enc(frequent[code]), _enc(count), _enc(sizes))]
        data, ends = _bytes(words)
        trained = count if train else np.zeros(len(count), "int64")
        rows += [(WORDS, 0, chunk, s, train, _zip(data[ends[a]:ends[b]].tobytes()), _enc(np.diff(ends[a:b + 1])), _enc(trained[a:b]), b"", b"")
                 for s, a, b in _by_shard(shard)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}
        chunk = (TaskContext.get().partitionId() << 33) - 1
        for rows in batches:
            for train in (False, True):
                batch = rows.filter(rows["train"] if train else pc.invert(rows["train"])).drop_columns(["train"])
                start = 0
                for i, m in enumerate(pc.binary_length(batch["text"]).to_pylist()):
                    m = ROW_BYTES + (m or 0)
                    if size[train] and size[train] + m > limit:
                        if i > start:
                            kept[train].append(batch.slice(start, i - start))
                        chunk += 1
                        yield packed(pa.Table.from_batches(kept[train]), train, chunk)
                        kept[train].clear()
                        start, size[train] = i, 0
                    size[train] += m
                if batch.num_rows > start:
                    kept[train].append(batch.slice(start))
        for train in (False, True):
            if kept[train]:
                chunk += 1
                yield packed(pa.Table.from_batches(kept[train]), train, chunk)
                kept[train].clear()
        _give_back()
    return run


def _places(packed: pd.DataFrame) -> Places:
    """The places of a chunk; its words are numbered in the order of their shards."""
    row = packed.iloc[0]
    order = np.argsort(-_dec(row["w"]), kind="stable")
    return Places(order[_dec(row["z"])], _dec(row["y"]), _dec(row["v"]))


def _row(kind: int, shard: int, chunk: int, *values: bytes) -> tuple:
    return (kind, shard, chunk, *values, *[b""] * (4 - len(values)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "shard", "chunk", "x", "y", "z", "w"])


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, start, stop) of each run of a sorted array."""
    start = _starts(shard)
    yield from zip(shard[start].tolist(), start.tolist(), [*start[1:].tolist(), len(shard)])


def _number(shards: int, rounds: int, block: int):
    """Ranks of the words of one shard, those of training texts first and the frequent ones first of them.

    One row for each chunk with the ranks of its words (``known`` training
    words lie below the others), and the shard's words in their order with
    their counts in blocks.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        sizes = [_dec(y) for y in pdf["y"]]
        flat = _strings(b"".join([_unzip(x) for x in pdf["x"]]), np.concatenate(sizes)).dictionary_encode()
        codes, words = flat.indices.to_numpy(), flat.dictionary
        count = np.bincount(codes, _all(pdf["z"]), len(words)).astype("int64")
        order = pc.sort_indices(pa.table({"n": count, "word": words}), [("n", "descending"), ("word", "ascending")]).to_numpy()
        rank, known, stop = _rank(order)[codes], np.count_nonzero(count), np.cumsum([len(x) for x in sizes])
        rows = [(IDS, ((c >> 33) + (c & 2 ** 33 - 1)) % rounds, c, shard, _enc(rank[b - len(x):b]), b"", known)
                for c, x, b in zip(pdf["chunk"].tolist(), sizes, stop)]
        words, count = words.take(pa.array(order)), count[order]
        for i, a in enumerate(range(0, len(words), block)):
            own = words.slice(a, block).cast(pa.string())
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_py()
            rows.append((BLOCK, 0, i * shards + shard, shard, _zip(text.encode()), _enc(count[a:a + block]), known))
        del flat, codes, words
        _give_back()
        return pd.DataFrame(rows, columns=[x.split()[0] for x in NUMBERED.split(", ")])
    return run


def block_words(x: bytes, y: bytes) -> tuple[list[str], np.ndarray]:
    """The words of a block of the vocabulary and how often training texts have them; words that they have come first."""
    return _unzip(x).decode().split("\n"), _dec(y)


def _spelt_keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different character grams of ``words`` in their order, of each gram its place among them and its word."""
    _, _, owner, chars = windows(words, order)
    codes, uniq = pd.factorize(chars)
    place = _sorted(uniq)
    return uniq[place], _rank(place)[codes], owner


def _ask_chars(shards: int, order: int):
    """The character grams of each block, by shards of grams."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, x, y in zip(pdf["chunk"], pdf["x"], pdf["y"]):
                keys = _spelt_keys(block_words(x, y)[0], order)[0]
                yield _frame([_row(CHARS, s, block, _enc_up(keys[a:b])) for s, a, b in _by_shard(_shard(keys, shards))])
    return non_empty(run)


def _answer_chars(asked: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
    keys, values = _all(logs["x"], _dec_up), _all(logs["y"])
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], np.append(values[order], 0)
    return pd.DataFrame([(c, CHARS, s, _enc(values[_find(keys, _dec_up(x))]), b"") for c, s, x in zip(asked["chunk"], asked["shard"], asked["x"])],
                        columns=["chunk", "kind", "shard", "x", "y"])


def _spell(shards: int, order: int):
    """The logarithms of the words of a block as spelt."""
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        words = block_words(row["x"], row["y"])[0]
        _, at, owner = _spelt_keys(words, order)
        logs = _all(answers.sort_values("shard")["x"]).view("float64")[at]
        return _frame([_row(SPELT, int(row["shard"]), int(row["chunk"]), b"", _enc(np.bincount(owner, logs, len(words)).view("int64")))])
    return run


def _chunk_ids(rows: pd.DataFrame, shards: int) -> np.ndarray:
    """The ids of a chunk's words: the rank after the shard's first id, and 0 for words that no training text has."""
    out = [np.zeros(0, "int64")]
    for s, x, known in rows[rows["kind"] == IDS].sort_values("shard")[["shard", "x", "known"]].itertuples(index=False):
        rank = _dec(x)
        out.append(np.where(rank < known, (rank + 1) * shards + s, UNKNOWN))
    return np.concatenate(out)


def _grouped(layout: Layout, kind: int, pair: np.ndarray, tail: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """Rows by the shards of ``pair``: the different ones, how many rows each has, and tail and more in that order."""
    order = np.lexsort((tail, pair))
    pair, rest = pair[order], [x[order] for x in (tail, *more)]
    for s, i, j, inside in layout.runs(PAIRS, pair):
        start = _starts(inside)
        yield _row(kind, s, -1, _enc_up(inside[start]), _enc(np.diff(np.append(start, j - i))), *[_enc(x[i:j]) for x in rest])


def _train_rows(layout: Layout):
    """A training chunk's different triples: by their first two words what follows how often."""
    def run(packed: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        p = _places(packed)
        c = _chunk_ids(ids, layout.shards)[p.code]
        ahead = layout.pair(*(p.before(c, k, BEGIN) for k in (2, 1)))
        codes, uniq = pd.factorize(pd.factorize(ahead)[0] * (layout.top + 1) + c)
        first, count = _first(codes, len(uniq)), np.bincount(codes, minlength=len(uniq))
        return _frame(list(_grouped(layout, TRIPLES, ahead[first], c[first], count)))
    return run


def _triples(rows: pd.DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of some rows of :func:`_grouped` in order, and of each row its pair's place times top + 1 and its third word."""
    pair = np.repeat(_all(rows["x"], _dec_up), _all(rows["y"]))
    keys, at = np.unique(pair, return_inverse=True)
    return keys, at * (top + 1) + _all(rows["z"])


def _stats(n: np.ndarray) -> list[int]:
    """Counts of counts, the number of those above 0 and the sum."""
    return [*[int((n == i).sum()) for i in (1, 2, 3, 4)], int((n > 0).sum()), int(n.sum())]


def _counted(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "shard", "chunk", "x", "y", "z", "w", *STATS])


def _count_triples(layout: Layout):
    """The different triples of one shard in the order of their contexts: of a context the sum of its triples' counts and how many of them are 1, 2 and more."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts, triples = _triples(pdf, layout.top)
        triples, (ends,) = _sums(triples, _all(pdf["w"]))
        context, last = np.divmod(triples, layout.top + 1)
        spare = [np.bincount(context, x, len(contexts)).astype("int64") for x in (ends, ends == 1, ends == 2, ends > 2)]
        return _counted([(TRIPLES, int(pdf["shard"].iloc[0]), -1, _enc_up(contexts), _enc(np.stack(spare).ravel()), _enc(last), _enc(ends),
                          *_stats(ends))])
    return run


def _pairs_behind(layout: Layout):
    """For the last two words of the different triples of a shard, how many of these they end: the shards' sums are the words before a pair."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, x, y, z in pdf[["shard", "x", "y", "z"]].itertuples(index=False):
                m = _dec(y).reshape(4, -1)[1:].sum(axis=0)
                b = np.repeat(layout.words(int(shard), _dec_up(x))[1], m)
                pairs, n = _sums(layout.pair(b, _dec(z)), np.ones(len(b), "int64"))
                yield _frame([_row(PAIRS, s, -1, _enc_up(inside), _enc(n[0][i:j])) for s, i, j, inside in layout.runs(PAIRS, pairs)])
    return non_empty(run)


def _count_shard(layout: Layout):
    """The counts of the pairs of one shard, and its pairs' part of the counts of single words.

    Of a pair: words before it, and as a context what :func:`_count_triples`
    has.  Triples follow in the order of their contexts.
    """
    def run(behind: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        shard = int((behind if len(behind) else after)["shard"].iloc[0])
        two, (n2,) = _sums(_all(behind["x"], _dec_up), _all(behind["y"]))
        contexts = _all(after["x"], _dec_up)
        keys = np.union1d(two, contexts)
        values = np.zeros((5, len(keys)), "int64")
        values[0, np.searchsorted(keys, two)] = n2
        values[1:, np.searchsorted(keys, contexts)] = _all(after["y"]).reshape(4, -1)
        triples = [after[x].iloc[0] if len(after) else _enc(contexts) for x in ("z", "w")]
        rows = [(PAIRS, shard, -1, _enc_up(keys), _enc(values.ravel()), *triples, *_stats(n2))]
        b, c = layout.words(shard, two)
        words, codes = np.unique(layout.word(np.concatenate([b, c])), return_inverse=True)
        ahead, behind = codes[:len(b)], codes[len(b):]
        m = len(words)
        count = lambda of, x: np.bincount(of, x, m).astype("int64")
        values = np.stack([count(behind, None), *[count(ahead, x) for x in (n2, n2 == 1, n2 == 2, n2 > 2)]])
        rows += [(WORDS, s, -1, _enc_up(inside), _enc(values[:, i:j].ravel()), b"", b"", *[0] * len(STATS))
                 for s, i, j, inside in layout.runs(WORDS, words)]
        return _counted(rows)
    return run


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """The words of one shard: different words before, and as a context the sum and the kinds of what follows; the start of texts once more."""
    shard = int(pdf["shard"].iloc[0])
    parts = np.concatenate([np.zeros((5, 0), "int64"), *[_dec(y).reshape(5, -1) for y in pdf["y"]]], axis=1)
    keys, values = _sums(_all(pdf["x"], _dec_up), *parts)
    rows = [(WORDS, shard, -1, _enc_up(keys), _enc(np.stack(values).ravel()), b"", b"", *_stats(values[0]))]
    if shard == BEGIN and len(keys) and keys[0] == 0:
        rows.append((STARTS, shard, -1, b"", _enc(np.array([v[0] for v in values])), b"", b"", *[0] * len(STATS)))
    return _counted(rows)


class Wants:
    """What a chunk asks the shards of pairs for: different numbers in their order, and of each place where the answer is.

    Place -1 stands for what the model can't have, for the training texts
    lack one of its words; it takes the zero after the last answer.
    """

    def __init__(self, p: Places, ids: np.ndarray, layout: Layout):
        self.layout = layout
        c = ids[p.code]
        b = p.before(c, 1, BEGIN)
        pairs = np.where((b > UNKNOWN) & (c > UNKNOWN), layout.pair(b, c), -1)
        begin = layout.pair(*np.full((2, 1), BEGIN))
        self.pairs, at = self._places(np.concatenate([pairs, begin]))
        self.at, start = at[:-1], int(at[-1])
        # the two words before a place are the pair that ends one place earlier
        self.context = p.before(self.at, 1, start)
        triples, self.triple = self._places(np.where((self.context >= 0) & (c > UNKNOWN), self.context * (layout.top + 1) + c, -1))
        self.asked, self.last = np.divmod(triples, layout.top + 1)

    @staticmethod
    def _places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ``numbers`` from 0 on, and the place of each among them."""
        order = np.argsort(numbers)
        ordered = numbers[order]
        new = np.ones(len(numbers), "bool")
        new[1:] = ordered[1:] != ordered[:-1]
        new &= ordered >= 0
        at = np.empty(len(numbers), "int64")
        at[order] = np.cumsum(new) - 1
        return ordered[new], at

    def rows(self, chunk: int) -> Iterator[tuple]:
        for s, a, b, inside in self.layout.runs(PAIRS, self.pairs):
            i, j = np.searchsorted(self.asked, [a, b])
            m = np.bincount(self.asked[i:j] - a, minlength=b - a)
            yield _row(PAIRS, s, chunk, _enc_up(inside), _enc(m), _enc(self.last[i:j]))


def _ask(layout: Layout):
    """The questions of a chunk."""
    def run(packed: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        wants = Wants(_places(packed), _chunk_ids(ids, layout.shards), layout)
        return _frame(list(wants.rows(int(packed["chunk"].iloc[0]))))
    return run


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in the sorted ``keys``, or their number."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys in order, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    start = _starts(key[order])
    return key[order][start], [np.add.reduceat(v[order], start) if len(start) else v for v in values]


def _answer_words(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """The counts and the spelling of each chunk's words of one shard."""
    spelt = _all(model[model["kind"] == SPELT].sort_values("chunk")["y"])
    values = np.zeros((5, len(spelt) + 1), "int64")
    for x, y in model.loc[model["kind"] == WORDS, ["x", "y"]].itertuples(index=False):
        values[:, _dec_up(x)] = _dec(y).reshape(5, -1)
    out = []
    for chunk, shard, x in zip(asked["chunk"], asked["shard"], asked["x"]):
        rank = _dec(x)
        out.append((chunk, WORDS, shard, _enc(values[:, rank + 1].ravel()), _enc(spelt[rank])))
    return pd.DataFrame(out, columns=["chunk", "kind", "shard", "x", "y"])


def _answer(top: int):
    """The counts of each chunk's pairs and triples of one shard, in the order of its questions."""
    def run(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        keys = _all(counts["x"], _dec_up)
        values = np.concatenate([np.zeros((5, 0), "int64"), *[_dec(y).reshape(5, -1) for y in counts["y"]]], axis=1)
        ends = np.append(_all(counts["w"]), 0)
        # a context has as many triples as its counts of 1, 2 and more
        triples = np.repeat(np.arange(len(keys)), values[2:].sum(axis=0)) * (top + 1) + _all(counts["z"])
        values = np.concatenate([values, np.zeros((5, 1), "int64")], axis=1)
        out = []
        for chunk, shard, x, y, z in zip(asked["chunk"], asked["shard"], asked["x"], asked["y"], asked["z"]):
            at = _find(keys, _dec_up(x))
            third = ends[_find(triples, np.repeat(at, _dec(y)) * (top + 1) + _dec(z))]
            out.append((chunk, PAIRS, shard, _enc(values[:, at].ravel()), _enc(third)))
        return pd.DataFrame(out, columns=["chunk", "kind", "shard", "x", "y"])
    return run


def _repeats(p: Places) -> np.ndarray:
    """Per text the share of its three-word places whose words stood together earlier in it."""
    pair, _ = pd.factorize(p.before(p.code, 1, -1) * len(p.sizes) + p.code)
    inside = p.at >= WORD_ORDER - 1
    triple, uniq = pd.factorize((p.before(pair, 1, 0) * len(p.sizes) + p.code)[inside])
    owner = p.owner[inside]
    total = np.bincount(owner, minlength=len(p.counts))
    again = pd.Series(owner * len(uniq) + triple).duplicated().to_numpy()
    return np.bincount(owner, again, minlength=len(total)) / np.maximum(total, 1)


def _worst_run(cost: np.ndarray, size: np.ndarray, p: Places, run: int) -> np.ndarray:
    """Per text the greatest cost per character of ``run`` words in a row, of all of its words if it has fewer."""
    out = np.full(len(p.counts), np.nan)
    some = np.flatnonzero(p.counts)
    if len(some):
        first = (np.cumsum(p.counts) - p.counts)[some]
        c, n = (sum([x, *[p.before(x, k, 0) for k in range(1, run)]]) for x in (cost, size))
        # the sum at a text's last word is that of all of its words if it has fewer
        whole = p.at >= np.minimum(run, p.counts[p.owner]) - 1
        out[some] = np.maximum.reduceat(np.where(whole, c / n, -np.inf), first)
    return out


def _interpolated(lower: np.ndarray, cnt: np.ndarray, context: list[np.ndarray], d: tuple[float, float, float]) -> np.ndarray:
    """The logarithm of the probability from that of the order ``lower``, the count and the context's total and counts of counts."""
    total, *spare = context
    with np.errstate(all="ignore"):
        gamma = sum(c * x for c, x in zip(spare, d)) / np.maximum(total, 1)
        own = (cnt - np.array([0.0, *d])[np.minimum(cnt, 3)]) / np.maximum(total, 1)
        backed = lower + np.where(total > 0, np.log(gamma), 0.0)
        return np.where(cnt > 0, np.log(own + gamma * np.exp(lower)), backed)


def _in_blocks(lower: np.ndarray, counts: np.ndarray, at: np.ndarray, context: Callable[[slice], list[np.ndarray]],
               d: tuple[float, float, float]) -> np.ndarray:
    """:func:`_interpolated` of all places, whose counts are ``counts[at]``; what it makes on the way has the size of a block."""
    out = np.empty(len(lower))
    for i in range(0, len(lower), BLOCK_PLACES):
        j = slice(i, i + BLOCK_PLACES)
        out[j] = _interpolated(lower[j], counts[at[j]], context(j), d)
    return out


def _table(answers: pd.Series, m: int, last: list[int]) -> np.ndarray:
    """The five counts of ``m`` numbers, answered shard by shard, and of one more."""
    out = np.empty((5, m + 1), "int64")
    out[:, m] = last
    i = 0
    for x in answers:
        part = _dec(x).reshape(5, -1)
        out[:, i:i + part.shape[1]] = part
        i += part.shape[1]
    return out


def _score_chunk(layout: Layout, stats: dict[int, dict[str, int]], starts: list[int]):
    d = {k: discounts(*[stats.get(k, {}).get(f"n{i}") or 0 for i in (1, 2, 3, 4)]) for k in (WORDS, PAIRS, TRIPLES)}
    total, n1, n2, types = (stats.get(WORDS, {}).get(x) or 0 for x in ("total", "n1", "n2", "types"))

    def run(packed: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        docs = pa.ipc.open_stream(packed["x"].iloc[0]).read_all()
        p = _places(packed)
        repeats = _repeats(p)
        wants = Wants(p, _chunk_ids(rows, layout.shards), layout)
        pairs, at, ahead, triple = len(wants.pairs), wants.at, wants.context, wants.triple
        del wants
        answers = rows[rows["kind"] != IDS].sort_values(["kind", "shard"])
        spelt = _all(answers.loc[answers["kind"] == WORDS, "y"]).view("float64")[p.code]
        # the answers of one kind at a time
        words = _table(answers.loc[answers["kind"] == WORDS, "x"], len(p.sizes), starts)
        # of single words the context is the same everywhere
        same = [total, n1, n2, types - n1 - n2]
        logp = _in_blocks(spelt, words[0], p.code, lambda j: same, d[WORDS])
        before = p.before(p.code, 1, len(p.sizes))
        of = _table(answers.loc[answers["kind"] == PAIRS, "x"], pairs, [0] * 5)
        logp = _in_blocks(logp, of[0], at, lambda j: words[1:, before[j]], d[PAIRS])
        del words, before, at
        ends = np.append(_all(answers.loc[answers["kind"] == PAIRS, "y"]), 0)
        logp = _in_blocks(logp, ends, triple, lambda j: of[1:, ahead[j]], d[TRIPLES])
        del of, ends, ahead, triple
        m, size = len(p.counts), p.size
        add = lambda x: np.bincount(p.owner, x, minlength=m)
        n = add(size)
        with np.errstate(all="ignore"):
            mean = [np.where(n > 0, -add(x) / n, np.nan) for x in (logp, spelt)]
        return pd.DataFrame({**{x: pd.Series(docs[x].to_pylist(), dtype="object") for x in ("id", "k1", "k2", "lang")},
                             "n": n.astype("int64"), "cost": mean[0], "spelling": mean[1], "repeats": repeats,
                             **{f"run{k}": _worst_run(-logp, size, p, k) for k in RUNS}})
    return run


def _log_rows(shards: int, order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = gram_keys(pdf["gram"].tolist(), order)
            at = _sorted(keys)
            logs = pdf["logp"].to_numpy("float64").view("int64")[at]
            keys = keys[at]
            yield _frame([_row(CHARS, s, -1, _enc_up(keys[a:b]), _enc(logs[a:b])) for s, a, b in _by_shard(_shard(keys, shards))])
    return non_empty(run)


def score_documents(docs: DataFrame, logs: DataFrame | Callable, order: int, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """Scores of each row of ``docs`` (id, k1, k2, lang, text, train) under a model of the words of those with train, written.

    ``logs`` (gram, logp) has the logarithms of all character ``order``-grams
    of the words, which spell words below the order of single words; or it
    makes them from the blocks of the vocabulary (:func:`block_words`) and a
    function that writes tables.
    Texts are split once: documents are packed into chunks where they lie,
    as numbers of the chunk's words, training texts into chunks of their
    own.  The words go to shards by hash, where the corpus's different words
    get ranks and, each once, are spelt; each chunk gets the ranks of its words.  Pairs and triples of training words are
    numbers of their ids, so that sorted ones have small differences.  The model is
    its counts: pairs with the number of words before them, words with that
    of the words before and the pairs they begin, contexts and triples, in
    shards, which stay where they are.  Each chunk asks the shards for its different words, pairs and
    triples of training words, at most once each, and gets counts in the
    order of its questions, so that answers carry no keys; it then adds up
    the interpolated probabilities itself.  That goes in ``ROUNDS`` rounds,
    each of a part of the chunks.
    The model is never joined row by row and passes neither the driver nor one task.
    The work follows the texts.

    Returns id, k1, k2, lang, n (characters predicted), cost, spelling,
    repeats and the worst runs; without words all scores are null.
    """
    spark = docs.sparkSession
    docs = docs.select("id", "k1", "k2", "lang", "text", "train")
    size = docs.agg(F.sum(F.octet_length("text")).alias("all"), F.sum(F.when(F.col("train"), F.octet_length("text"))).alias("train")).first()
    # a word takes about eight bytes of text
    shards = int(max(LEAST_SHARDS, -(-(size["train"] or 0) // (8 * shard_grams)), -(-(size["all"] or 0) // SHARD_BYTES)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "packed")
    names = [x.split()[0] for x in ROW.split(", ")]
    try:
        with scratch(spark) as write, settings(spark, BLOB_BATCHES):
            with settings(spark, TEXT_BATCHES | DROP_SHUFFLES):
                docs.mapInArrow(_pack(CHUNK_BYTES, shards, ROUNDS), PACKED).write.partitionBy("kind", "part").parquet(folder)
            packed = spark.read.schema(PACKED).parquet(folder)
            chunks = packed.where(F.col("kind") == TEXTS).select("chunk", "part", "train", "x", "y", "z", "w", "v")
            asked = packed.where(F.col("kind") == WORDS).select("chunk", "shard", "x", "y", "z")
            numbered = write(asked.groupBy("shard").applyInPandas(_number(shards, ROUNDS, BLOCK_WORDS), NUMBERED), "numbered", "kind", "part")
            remove(spark, f"{folder}/kind={WORDS}")
            ids = numbered.where(F.col("kind") == IDS)
            blocks = numbered.where(F.col("kind") == BLOCK).select("chunk", "shard", "x", "y")
            with scratch(spark) as keep:
                found = logs(blocks, keep) if callable(logs) else logs
                with settings(spark, LOG_BATCHES):
                    known = keep(found.mapInPandas(_log_rows(shards, order), ROW), "logs")
                chars = blocks.mapInPandas(_ask_chars(shards, order), ROW)
                answers = chars.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_answer_chars, ANSWER)
                spelt = write(blocks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_spell(shards, order), ROW), "spelt")
            layout = Layout(shards, max(BEGIN, ids.agg(F.max(F.when(F.col("known") > 0, F.col("known") * shards + F.col("shard")))).first()[0] or 0))
            learnt = chunks.where("train")
            own = ids.join(F.broadcast(learnt.select("chunk")), "chunk", "left_semi").select("chunk", "kind", "shard", "x", "known")
            rows = learnt.drop("part", "train").groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(_train_rows(layout), ROW)
            with scratch(spark) as keep:
                triples = keep(rows.groupBy("shard").applyInPandas(_count_triples(layout), COUNTED), "triples", "shard", buckets=buckets)
                behind = triples.mapInPandas(_pairs_behind(layout), ROW)
                counts = write(behind.groupBy("shard").cogroup(triples.groupBy("shard")).applyInPandas(_count_shard(layout), COUNTED),
                               "counts", "shard", buckets=buckets)
                stats = {TRIPLES: triples.agg(*[F.sum(s).alias(s) for s in STATS]).first().asDict()}
            words = write(counts.where(F.col("kind") == WORDS).groupBy("shard").applyInPandas(_count_words, COUNTED), "words")
            both = counts.where(F.col("kind") != WORDS).unionByName(words)
            stats |= {r["kind"]: r.asDict() for r in both.groupBy("kind").agg(*[F.sum(s).alias(s) for s in STATS]).collect()}
            starts = words.where(F.col("kind") == STARTS).select("y").first()
            starts = _dec(starts["y"]).tolist() if starts else [0] * 5
            words = write(words.where(F.col("kind") == WORDS).select(*names).unionByName(spelt), "spelt-words", "shard", buckets=buckets)
            pairs = counts.where(F.col("kind") == PAIRS).select(*names)
            scores = []
            for i in range(ROUNDS) if chunks.count() >= ROUNDS * ROUND_CHUNKS else [None]:
                texts, mine = (x if i is None else x.where(F.col("part") == i) for x in (chunks, ids))
                texts, mine = texts.drop("part", "train"), mine.select("chunk", "kind", "shard", "x", "y", "known")
                asked = texts.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(_ask(layout), ROW)
                with scratch(spark) as keep:
                    answers = keep(asked.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInPandas(_answer(layout.top), ANSWER)
                                   .unionByName(mine.groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(_answer_words, ANSWER)), "answers")
                    given = mine.unionByName(answers.withColumn("known", F.lit(None).cast("long")))
                    out = texts.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(_score_chunk(layout, stats, starts), SCORES)
                    judged = [F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("cost", "spelling", "repeats", *[f"run{k}" for k in RUNS])]
                    with settings(spark, DROP_SHUFFLES):
                        scores.append(saved(out.select("id", "k1", "k2", "lang", "n", *judged), "scores"))
    finally:
        remove(spark, folder)
    return reduce(DataFrame.unionByName, scores)
