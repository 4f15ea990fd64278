"""Token-id output: texts are tokenised and packed into fixed rows by best fit decreasing.

Each document's token ids, with an end mark, are one segment; a document longer than a row is split into pieces of a
row's length and a rest, in order and without loss. Documents are packed in windows of about `window` tokens of
consecutive input, so memory is bounded and the input's order (a curriculum) is kept at that scale. In a window, segments
are placed from the longest to the shortest, each into the fullest row that still has room for it. A segment tree over
the possible remaining capacities finds that row in log(length) steps.

Output, a row per packed row: pack_id, n_tokens, ids (little-endian, 2 bytes each, or 4 for vocabularies beyond 65536;
padded), positions (as ids: 0 at each segment's start), cu_seqlens (0, then the end of each segment), doc_ids, pieces
(the number of each segment's piece), all in the segments' order. `write_shards` writes them as .npz files, which numpy opens:
matrices `ids` and `positions`, `cu_seqlens` of all rows with `row_splits`, and `segments`, an Arrow stream with what has no
fixed width. `read_shards` gives the rows back from these files; `packed_files` does both.

Windows follow the input's partitions, which are the same for every attempt of a task, so a lost executor's rows come
again alike. The tokenizer's file must be there on every machine.

Edge cases: null and empty texts are a segment of the end mark alone; very long texts are split over as many rows as they need
(a task holds one text's tokens at a time); a null doc_id stays null, and ids may be of any type; repeated rows are packed again;
an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import base64
import io
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, flat_bytes, pieces, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the 50k byte-level vocabulary cuts text before merging (a fixed value of that vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SCHEMA = "pack_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{id}>, pieces array<int>"
SHARDS = "shard string, rows long"
SHARD_ROWS = 2048
BATCH_ROWS = 256
_LOADED: dict[str, object] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file; loaded once in each worker."""
    if path not in _LOADED:
        import tiktoken

        _LOADED[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})
    return _LOADED[path]


class CapacityTree:
    """Which remaining capacities have an open row, and the least that holds a size; a segment tree of counts."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def least_at(self, size: int) -> int | None:
        """The least capacity of at least `size` that some row has."""
        i = size + self.size
        if self.count[i]:
            return size
        while i > 1:  # up to the first right sibling with a row, then down its left edge
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, its capacity) of the fullest row with room, removed from the tree."""
        capacity = self.least_at(size)
        if capacity is None:
            return None
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The segments' numbers in each row; ties in size keep their order."""
    tree, rows = CapacityTree(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        hit = tree.take(sizes[k])
        row, room = hit if hit else (len(rows), length)
        if not hit:
            rows.append([])
        rows[row].append(k)
        if room > sizes[k]:
            tree.put(room - sizes[k], row)
    return rows


Batches = Iterator[pa.RecordBatch]


def _packer(length: int = 2048, tokenizer: str = TOKENIZER, end_id: int = 50256, pad_id: int = 50256, window: int = 1 << 20) -> Callable[[Batches], Batches]:
    """What makes a partition's packed rows of its doc_id, text."""

    def run(batches: Batches) -> Batches:
        enc, part, made = encoding(tokenizer), TaskContext.get().partitionId(), 0
        kind = np.dtype("<u2") if max(enc.n_vocab, end_id + 1, pad_id + 1) <= 1 << 16 else np.dtype("<u4")
        where = np.dtype("<u2") if length <= 1 << 16 else np.dtype("<u4")
        ends = np.array([end_id], kind)
        segs: list[tuple[object, int, np.ndarray]] = []
        held, id_type = 0, pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows = best_fit_decreasing([len(s[2]) for s in segs], length)
            out = defaultdict(list)
            for row in rows:
                own = [segs[k] for k in row]
                lens = [len(s[2]) for s in own]
                n = sum(lens)
                ids, pos = np.full(length, pad_id, kind), np.zeros(length, where)
                ids[:n] = np.concatenate([s[2] for s in own])
                pos[:n] = np.concatenate([np.arange(m, dtype=where) for m in lens])
                for c, v in (("pack_id", (part << 33) + made), ("n_tokens", n), ("ids", ids.tobytes()), ("positions", pos.tobytes()), ("cu_seqlens", np.cumsum([0, *lens])), ("doc_ids", [s[0] for s in own]), ("pieces", [s[1] for s in own])):
                    out[c].append(v)
                made += 1
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int32()))
            return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

        for b in pieces(batches, "text", 1 << 20):
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([np.array(enc.encode_ordinary(text or ""), kind), ends])
                for k, a in enumerate(range(0, len(ids), length)):
                    segs.append((doc, k, ids[a : a + length]))
                held += len(ids)
                if held >= window:
                    yield flush()
                    segs, held = [], 0
        if segs:
            yield flush()

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _schema(docs: DataFrame) -> StructType:
    return StructType.fromDDL(SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, length: int = 2048, **how) -> DataFrame:
    """Packs doc_id, text. Deterministic for the same input partitions."""
    return _input(docs).mapInArrow(_packer(length, **how), _schema(docs))


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_id, piece, pack_id, first, last (of each segment, in its row), in whatever order."""
    seg = F.arrays_zip("doc_ids", "pieces", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("first"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("last"))
    return packed.select("pack_id", F.inline(seg)).withColumnsRenamed({"doc_ids": "doc_id", "pieces": "piece"})


def _writer(uri: str, length: int, rows: int) -> Callable[[Batches], Batches]:
    """What writes a partition's packed rows, and gives the names of its files and how many rows each holds."""

    def run(batches: Batches) -> Batches:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def end() -> pa.RecordBatch:
            t, stream = pa.Table.from_batches(held), io.BytesIO()
            rest = t.drop_columns(["ids", "positions"])
            with pa.ipc.new_stream(stream, rest.schema) as w:
                w.write_table(rest)
            matrix = {}
            for c in ("ids", "positions"):  # rows of one width, one after the other
                raw, _ = flat_bytes(t[c])
                matrix[c] = raw.view(f"<u{len(raw) // len(t) // length}").reshape(len(t), length)
            cu = t["cu_seqlens"].combine_chunks()
            splits = np.cumsum([0, *pc.list_value_length(cu).to_pylist()])
            name = f"packed-{part:05d}-{number:05d}.npz"
            half = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(half) as f:
                np.savez(f, **matrix, cu_seqlens=cu.flatten().to_numpy(), row_splits=splits, segments=np.frombuffer(stream.getbuffer(), np.uint8))
            fs.move(half, f"{root}/{name}")
            return pa.record_batch([pa.array([name]), pa.array([len(t)], pa.int64())], names=["shard", "rows"])

        for whole in batches:
            at = 0
            while at < len(whole):
                b = whole.slice(at, rows - n)
                held, n, at = [*held, b], n + len(b), at + len(b)
                if n == rows:
                    yield end()
                    number, held, n = number + 1, [], 0
        if n:
            yield end()

    return run


def write_shards(packed: DataFrame, uri: str, length: int = 2048, rows: int = SHARD_ROWS) -> DataFrame:
    """Writes each partition's rows of `length` tokens, so many to a file, under `uri`, which every executor must reach: shard (file name), rows.

    A file gets its name, that of its partition and number, only when whole, so a repeated task leaves no half and no second."""
    return packed.mapInArrow(_writer(uri, length, rows), SHARDS)


def read_shards(spark: SparkSession, uri: str, schema: StructType) -> DataFrame:
    """The packed rows (of `schema`, that of `pack`) as the files under `uri` hold them.

    Spark lists the files and deals them out by size; a task reads one matrix at a time, and no file is ever a row."""
    names = schema.names

    def run(batches: Batches) -> Batches:
        fs, root = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f, np.load(f) as z:
                    t = pa.ipc.open_stream(z["segments"].tobytes()).read_all()
                    for c in ("ids", "positions"):
                        m = z[c]
                        ends = np.arange(len(m) + 1, dtype=np.int32) * m.itemsize * m.shape[1]
                        t = t.append_column(c, pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(m)]))
                yield from t.select(names).to_batches(BATCH_ROWS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "packed-*.npz").load(uri)
    return files.select(F.substring_index("path", "/", -1).alias("shard")).mapInArrow(run, schema)


def packed_files(docs: DataFrame, uri: str | None = None, length: int = 2048, **how) -> DataFrame:
    """Packs, writes the files and reads them back; `uri` is by default a new folder in the shared one."""
    spark = docs.sparkSession
    root = uri or f"{shared_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    pack_rows, write, schema = _packer(length, **how), _writer(root, length, SHARD_ROWS), _schema(docs)
    # one worker a task does both: packed rows don't go back to the JVM between
    if cut(_input(docs).mapInArrow(lambda batches: write(pack_rows(batches)), SHARDS)).isEmpty():
        return spark.createDataFrame([], schema)
    return read_shards(spark, root, schema)
