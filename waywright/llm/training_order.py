"""Training-order materialisation of token sequences.

Texts are tokenised with a byte-level vocabulary and closed by its end-of-text id; the stream of a task's texts is cut
into sequences of LENGTH ids, and only a task's last one is padded. Sequences are numbered without gaps from 0 to N - 1:
those of a task are consecutive, and tasks follow each other. A keyed Feistel network over the next even power of two permutes the numbers;
values of N or more are mapped again until they are below N (cycle walking), so every sequence has a slot of its own and
every slot below N a sequence, with no state but the key. Slots are dealt in ranges of ROWS to shard files of fixed
stride: slot s is at byte s % ROWS * stride of shard s // ROWS, so that reading in order is sequential and can begin
anywhere. ROWS grows with N up to MOST, so that the number of shards grows slowly. Sequences travel to their shard in
compressed blocks, one for each task and shard; beyond FAN shards they travel in two steps, by groups of shards and then by
shard, so that no step pairs every task with every shard. A shard is filled in a buffer, written under a name of its own attempt and then renamed: a repeated task
replaces it by the same bytes. The manifest names every piece of a document that a sequence holds, so that each document
and each of its tokens can be found.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywright.llm.common import discard, received, send_file, shared_dir, ship, staged, tokenizer_file
from waywright.llm.shingles import mixed

LENGTH = 256
ROWS = 1 << 15  # sequences of a shard: 16 MB of 2-byte ids
MOST = 1 << 19  # 256 MB, which the task that writes a shard holds
SHARDS = 1024  # up to which ROWS is kept
FAN = 2048
PIECE = 1 << 30  # bytes of sequences that a task of the first of two steps passes on
ROUNDS = 6
PARTS = 100_000
HELD = 1 << 25  # bytes of sequences that a task holds before it makes blocks of them


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of numbers below n: a permutation of 0 .. n - 1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % (1 << 64)) for r in range(ROUNDS)]
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


_encoders: dict[str, tuple] = {}


def encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _encoders[path]


#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokens(path, length):
    """Batches of (id, text) to sequences: task, number in it, ids of the texts that it holds pieces of, where each piece
    starts in it, token offset of the first piece in its text, ids before padding, bytes. Further pieces have offset 0."""

    def run(batches):
        own, end = encoder(received(path), PATTERN)
        kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
        part, number = TaskContext.get().partitionId(), 0
        rest, owners, begins, offset = np.zeros(0, kind), [], np.zeros(0, np.int64), 0  # tokens that wait for more, and their pieces
        id_type = None

        def rows(cuts, ids, starts, offsets, filled, payload):
            nonlocal number
            k = len(payload)
            number += k
            cuts = pa.array(cuts, pa.int32())
            pieces = [pa.ListArray.from_arrays(cuts, pa.array(ids, id_type)), pa.ListArray.from_arrays(cuts, pa.array(starts, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(number - k, number), pa.int64()), *pieces, pa.array(offsets, pa.int64()), pa.array(filled, pa.int32()), pa.array(payload, pa.binary())], names=["part", "number", "doc_ids", "starts", "doc_offset", "n_tokens", "payload"])

        for batch in batches:
            id_type = batch.column(0).type
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), 512):
                each = [np.append(own.encode_to_numpy(t or "", disallowed_special=()), end).astype(kind) for t in texts[k : k + 512]]
                who = [*owners, *names[k : k + 512]]
                starts = np.concatenate([begins, len(rest) + np.cumsum([0, *map(len, each)])])
                flat = np.concatenate([rest, *each])
                count = len(flat) // length
                first = np.arange(count + 1) * length
                at = np.searchsorted(starts[:-1], first, side="right") - 1
                inside = first - starts[at] + np.where(at == 0, offset, 0)
                if count:
                    data = flat[: count * length].tobytes()
                    stride = length * kind.itemsize
                    held = np.searchsorted(starts[:-1], first[1:], side="left") - at[:-1]
                    cuts = np.concatenate([[0], np.cumsum(held)])
                    piece = np.arange(cuts[-1]) + np.repeat(at[:-1] - cuts[:-1], held)
                    yield rows(cuts, [who[i] for i in piece.tolist()], np.maximum(starts[piece] - np.repeat(first[:-1], held), 0), inside[:-1], [length] * count, [data[i : i + stride] for i in range(0, len(data), stride)])
                rest = flat[count * length :]
                if len(rest):
                    owners, begins, offset = who[at[-1] :], np.maximum(starts[at[-1] : -1] - first[-1], 0), int(inside[-1])
                else:
                    owners, begins, offset = [], np.zeros(0, np.int64), 0
        if len(rest):
            whole = np.full(length, end, kind)
            whole[: len(rest)] = rest
            yield rows([0, len(owners)], owners, begins, [offset], [len(rest)], [whole.tobytes()])

    return run


#: pieces: of each sequence how many pieces it holds, then where each starts, as compressed 4-byte numbers.
BLOCKS = "shard int, slots binary, doc_ids {0}, pieces binary, doc_offsets array<bigint>, filled array<int>, payload binary"


def fixed(column: pa.Array, stride: int) -> np.ndarray:
    """The bytes of a column of binary values that all have stride bytes, a row each, without a copy."""
    offsets, values = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1], column.buffers()[2]
    return np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, stride) if len(column) else np.zeros((0, stride), np.uint8)


def _blocks(stride, n, key, rows):
    """Batches of (number, ids, starts, offset, ids before padding, bytes) to one compressed block for each shard met."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=6).compress
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches([b.select(range(5)) for b in held]).combine_chunks()
            data = np.concatenate([fixed(b.column(5), stride) for b in held])
            slots = feistel(table.column(0).to_numpy(), n, key)
            order = np.lexsort((slots, slots // rows))
            table = table.take(pa.array(order))
            slots = slots[order]
            shards = slots // rows
            cuts = [0, *(np.nonzero(np.diff(shards))[0] + 1).tolist(), len(slots)]
            ids, starts = table.column(1).combine_chunks(), table.column(2).combine_chunks().flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int32)
            owners = pa.ListArray.from_arrays(pa.array(at[cuts]), ids.flatten())
            pieces = pa.array([pack(np.diff(at[a : b + 1]).tobytes() + starts[at[a] : at[b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)])
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table.column(c).combine_chunks()) for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(shards[cuts[:-1]].astype(np.int32)), pa.array([slots[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]), owners, pieces, *lists, pa.array([pack(data[order[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)])], names=["shard", "slots", "doc_ids", "pieces", "doc_offsets", "filled", "payload"])
            pa.default_memory_pool().release_unused()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows * stride
            if size >= HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def shard_rows(n: int) -> int:
    """Sequences of a shard if there are n."""
    rows = ROWS
    while rows < MOST and n > rows * SHARDS:
        rows *= 2
    return rows


def dealt(blocks: DataFrame, shards: int, size: int, fan: int = FAN) -> DataFrame:
    """Blocks of a shard in one partition each. size: bytes of all sequences."""
    if shards > fan:
        groups = round(shards**0.5)
        own = -(-shards // groups)
        parts = max(1, -(-size // (groups * PIECE)))
        to = F.expr(f"int(shard div {own} * {parts} + pmod(spark_partition_id(), {parts}))")  # a task meets one part of each group
        blocks = blocks.repartitionById(groups * parts, to).mapInArrow(lambda batches: batches, blocks.schema)
    return blocks.repartitionById(shards, F.col("shard"))


def _write(folder, stride, n, rows):
    def run(batches):
        import zstandard
        from pyarrow import fs

        unpack = zstandard.ZstdDecompressor().decompress
        shard, buffer, meta, count = None, None, [], 0
        for batch in batches:
            shards = np.unique(batch.column(0).to_numpy())
            if not len(shards):
                continue
            if len(shards) > 1 or (shard is not None and shards[0] != shard):
                raise ValueError("a partition holds one shard")
            if shard is None:
                shard = int(shards[0])
                buffer = np.zeros((min(rows, n - shard * rows), stride), np.uint8)
            for slots, data in zip(batch.column(1).to_pylist(), batch.column(6).to_pylist(), strict=True):
                at = np.frombuffer(slots, np.int64) - shard * rows
                count += len(at)
                buffer[at] = np.frombuffer(unpack(data), np.uint8).reshape(-1, stride)
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64) - shard * rows
            counts, starts = [], []
            for slots, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                numbers = np.frombuffer(unpack(data), np.int32)
                counts.append(numbers[: len(slots) // 8])
                starts.append(numbers[len(slots) // 8 :])
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32())
            pieces = [pa.ListArray.from_arrays(cuts, x) for x in (batch.column(2).flatten(), pa.array(np.concatenate(starts)))]
            meta.append((at, *pieces, batch.column(4).flatten(), batch.column(5).flatten()))
        if shard is None:
            return
        if count != len(buffer):
            raise ValueError(f"shard {shard} has gaps")
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        own = f"{path}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(buffer.tobytes())
        store.move(own, f"{path}/shard-{shard:06d}.bin")
        at = np.concatenate([m[0] for m in meta])
        order = np.argsort(at)  # in the order of slots the manifest packs well
        at = at[order]
        ids, starts, offsets, filled = (pa.concat_arrays([m[c] for m in meta]).take(pa.array(order)) for c in (1, 2, 3, 4))
        sums = [zlib.crc32(row.tobytes()) for row in buffer]
        yield pa.RecordBatch.from_arrays([ids, starts, offsets, pa.array(at + shard * rows), pa.array(np.full(len(at), shard, np.int32)), filled, pa.array(at * stride), pa.array(sums, pa.int64())], names=["doc_ids", "starts", "doc_offset", "slot", "shard", "n_tokens", "byte_offset", "payload_crc32"])

    return run


def materialise(docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, rows: int | None = None, key: int = 20240607, fan: int = FAN) -> DataFrame:
    """Write the shards, their manifest and their layout to folder (by default a new one in the shared folder) and return
    the manifest.

    (id_col, doc_offset, slot, shard, n_tokens, byte_offset, payload_crc32, segments, path, length, dtype): a row for each
    sequence. slot has every value from 0 to the number of sequences - 1 once; the sequence lies at byte_offset of the file
    path as length ids of type dtype and begins with token doc_offset of document id_col; n_tokens counts the ids before
    padding. segments lists all pieces of documents in the sequence as (id_col, doc_offset, start, n_tokens): the n_tokens
    ids from place start on are those of the document from token doc_offset on.

    Null and empty texts give the end-of-text id alone; texts of any length are cut over as many sequences as they fill.
    Repeated rows are repeated in the stream. An empty table gives no shard and an empty manifest. Further columns of docs
    aren't read. The manifest in the folder is the compact form of what is returned: the ids of each sequence's pieces and
    where they start. Sequences are numbered by the tasks that made them: the same key and the same staged tokens give the same
    order. folder is a URI that pyarrow can open: file, hdfs, s3 and gs.
    """
    spark = docs.sparkSession
    ship(spark)
    path = send_file(spark, path or tokenizer_file("byte_bpe_50k.tiktoken"))
    folder = folder or f"{shared_dir(spark)}/training-{uuid.uuid4().hex}"
    end = encoder(path, PATTERN)[1]
    width = 2 if end < 1 << 16 else 4
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    sequences = staged(base.mapInArrow(_tokens(path, length), f"part int, number long, doc_ids array<{id_type}>, starts array<int>, doc_offset long, n_tokens int, payload binary"), "tokens", "zstd")
    parts = staged(sequences.groupBy("part").agg(F.count("*").alias("own")), "parts")
    n, tasks = parts.agg(F.coalesce(F.sum("own"), F.lit(0)), F.count("*")).first()
    rows = rows or shard_rows(n)
    bases = parts.select(F.col("part").alias("_part"), (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    if tasks <= PARTS:  # a row for each task of the tokenising step
        bases = F.broadcast(bases)
    numbered = sequences.join(bases, F.col("part") == F.col("_part")).select((F.col("base") + F.col("number")).alias("number"), "doc_ids", "starts", "doc_offset", "n_tokens", "payload")
    blocks = numbered.mapInArrow(_blocks(length * width, n, key, rows), BLOCKS.format(f"array<{id_type}>"))
    shards = max(1, -(-n // rows))
    manifest = dealt(blocks, shards, n * length * width, fan).mapInArrow(_write(folder, length * width, n, rows), f"doc_ids array<{id_type}>, starts array<int>, doc_offset long, slot long, shard int, n_tokens int, byte_offset long, payload_crc32 long")
    piece = lambda x, i: F.struct(x.alias(id_col), F.when(i == 0, F.col("doc_offset")).otherwise(0).alias("doc_offset"), F.get("starts", i).alias("start"), (F.coalesce(F.get("starts", i + 1), "n_tokens") - F.get("starts", i)).alias("n_tokens"))
    file = F.concat(F.lit(f"{folder}/shard-"), F.lpad(F.col("shard").cast("string"), 6, "0"), F.lit(".bin"))
    place = [file.alias("path"), F.lit(length).alias("length"), F.lit(f"<u{width}").alias("dtype")]
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest", compression="zstd")
    layout = spark.range(1).select(F.lit(n).cast("long").alias("sequences"), F.lit(rows).alias("rows"), F.lit(length).alias("length"), F.lit(f"<u{width}").alias("dtype"), F.lit(key).cast("long").alias("key"))
    layout.write.mode("overwrite").parquet(f"{folder}/layout")
    discard(sequences, parts)
    held = spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")
    return held.select(F.get("doc_ids", F.lit(0)).alias(id_col), "doc_offset", "slot", "shard", "n_tokens", "byte_offset", "payload_crc32", F.transform("doc_ids", piece).alias("segments"), *place)


def read(folder: str, slots: range):
    """Sequences of the given slots, in order, as the folder's layout says; each shard is opened once."""
    from pyarrow import fs, parquet

    store, path = fs.FileSystem.from_uri(folder)
    layout = parquet.read_table(f"{path}/layout", filesystem=store).to_pylist()[0]
    rows, stride = layout["rows"], layout["length"] * np.dtype(layout["dtype"]).itemsize
    shard, file = None, None
    for s in slots:
        if s // rows != shard:
            shard = s // rows
            file = store.open_input_file(f"{path}/shard-{shard:06d}.bin")
        file.seek(s % rows * stride)
        yield np.frombuffer(file.read(stride), layout["dtype"])
