"""Token-ID output in training order: a keyed permutation gives every sequence its slot; fixed-stride shards hold the slots in order.

1. Texts become ids once, cut into sequences of LENGTH ids (END after the last), in a written table. A sequence's number is the count of
   sequences of the tasks before its own plus its place within its task, so numbers are gapless and nothing is shuffled for them.
2. A Feistel network over the next even number of bits permutes the numbers; values beyond the last are walked on along their
   cycle until they fall inside, so slots are gapless, too. Only key and count are needed to find any sequence's slot, or back.
3. A shard holds SHARD_SLOTS consecutive slots. The shards are written in PASSES runs: each one reads the table, keeps its range of slots,
   range-partitions them by shard, and lets its shuffle files go, so that only one run's share of the ids is in shuffle files at a time.
   Each shard is one file of little-endian 16-bit ids, slot by slot at a fixed stride, filled up with PAD, under a temporary name first.
   A reader seeks to (slot mod SHARD_SLOTS) * stride and may resume at any slot.

The order depends on the key, on the count and on how the input is split into tasks; the written table fixes it for all later steps and retries.
What killed attempts leave under temporary names is deleted in the end.

Defined results: a null or empty text is one sequence with the end-of-text id alone; repeated rows are sequences of their own;
very long texts are many sequences, cut within the task; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, pick, settled, sliced, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
PAD = 50257
LENGTH = 512
SHARD_SLOTS = 8192
KEY = 0x5EED0F7EA1
FEISTEL_ROUNDS = 6
#: Shards that one task writes, at most, where there are more than the session's shuffle partitions.
TASK_SHARDS = 16
#: Runs that write the shards: each reads all sequences and shuffles its share of them.
PASSES = 4
#: Up to this many tasks of step 1, their starts (16 bytes each) are broadcast.
BROADCAST_TASKS = 500_000


@lru_cache(1)
def tokenizer(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(numbers: np.ndarray, count: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A permutation of range(count), applied to numbers (or its inverse)."""
    if count < 2:
        return numbers.astype(np.int64)
    half = max(1, -(-(count - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes((key * 2654435761 + r * 40503 & (1 << 64) - 1).to_bytes(8, "little"), "big") for r in range(FEISTEL_ROUNDS)]
    x, out = numbers.astype(np.uint64), np.empty(len(numbers), np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x >> np.uint64(half), x & mask
        for k in reversed(keys) if back else keys:
            if back:
                a, b = b ^ (_mix(a, k) & mask), a
            else:
                a, b = b, a ^ (_mix(b, k) & mask)
        x = a << np.uint64(half) | b
        done = x < count
        out[todo[done]] = x[done]
        todo, x = todo[~done], x[~done]
    return out.astype(np.int64)


def sequences(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, seq (number within the text), ids (binary, 2 bytes each, not filled up), task and place (within the task)."""

    def run(batches):
        enc, task, place = tokenizer(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in sliced(batch):
                at, seq, ids = [], [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    got = np.array([*enc.encode_ordinary(text or ""), END], "<u2")
                    for k in range(0, len(got), length):
                        at.append(i)
                        seq.append(k // length)
                        ids.append(got[k : k + length].tobytes())
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(at, pa.int64())), pa.array(seq, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(n, task, np.int64)), pa.array(np.arange(place, place + n))],
                    ["doc_id", "seq", "ids", "task", "place"],
                )
                place += n

    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: settled(run(batches)), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, seq long, ids binary, task long, place long")


def with_slots(tables: Tables, seqs: DataFrame, key: int) -> tuple[DataFrame, int]:
    """doc_id, seq, ids and slot (the permuted number) of the kept sequences, and their count."""
    counts = seqs.groupBy("task").agg(F.count("*").alias("rows_in"))
    # one row a task: a window over all of them is small
    start = F.coalesce(F.sum("rows_in").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = tables.keep(counts.select(F.col("task").alias("t"), start.alias("start"), "rows_in"), "starts")
    tasks, total = starts.agg(F.count("*"), F.coalesce(F.sum("rows_in"), F.lit(0))).first()
    small = starts.select("t", "start")
    numbered = seqs.join(F.broadcast(small) if tasks <= BROADCAST_TASKS else small, seqs.task == F.col("t"))

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), total, key))

    return numbered.select("doc_id", "seq", "ids", slot(F.col("start") + F.col("place")).alias("slot")), total


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(rows: DataFrame, folder: str, first: int, end: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Writes the shards first to end - 1 of rows (doc_id, seq, ids, slot) and gives back their index: a row for each sequence, offset in bytes."""
    shard = F.floor(F.col("slot") / shard_slots)
    shards = rows.withColumn("shard", shard).where((F.col("shard") >= first) & (F.col("shard") < end))
    stride = 2 * length
    pad = np.full(length, PAD, "<u2").tobytes()

    def run(batches):
        import os
        import uuid

        fs, base = _open(folder)
        fs.create_dir(base)
        out = name = temp = None
        for batch in batches:
            shard, slot, ids = np.asarray(batch["shard"]), np.asarray(batch["slot"]), batch["ids"]
            crcs, sizes = np.empty(len(shard), np.int64), np.empty(len(shard), np.int32)
            for i in range(len(shard)):
                if name != shard[i]:
                    if out is not None:
                        out.close()
                        fs.move(temp, f"{base}/{shard_name(name)}")
                    name, temp = int(shard[i]), f"{base}/_{shard_name(int(shard[i]))}.{os.getpid()}-{uuid.uuid4().hex}"
                    out, at = fs.open_output_stream(temp), int(shard[i]) * shard_slots
                if slot[i] != at:
                    raise ValueError("slots are not gapless")
                own = ids[i].as_py()
                row = own + pad[len(own) :]
                out.write(row)
                crcs[i], sizes[i] = zlib.crc32(row), len(own) // 2
                at += 1
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["seq"], pa.array(sizes), pa.array(crcs), batch["slot"], batch["shard"], pa.array((slot - shard * shard_slots) * stride)],
                ["doc_id", "seq", "n_ids", "ids_crc32", "slot", "shard", "offset"],
            )
        if out is not None:
            out.close()
            fs.move(temp, f"{base}/{shard_name(name)}")

    # slots are spread evenly, so equal ranges of shards are equal partitions and need no sampling
    n = max(1, min(end - first, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (end - first) // TASK_SHARDS)))
    where = F.floor((F.col("shard") - first) * n / max(1, end - first)).cast("int")
    laid = shards.repartitionById(n, where).sortWithinPartitions("slot")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return laid.mapInArrow(run, f"doc_id {kind}, seq long, n_ids int, ids_crc32 long, slot long, shard long, offset long")


def sweep(folder: str) -> None:
    """Delete what attempts that were killed have left under temporary names. For when no task writes any more."""
    from pyarrow import fs as pafs

    fs, base = _open(folder)
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith("_shard-"):
            fs.delete_file(info.path)


def read_slots(folder: str, start: int, count: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS):
    """The id arrays of slots start to start + count, read in order; a reader that stopped resumes at its next slot."""
    fs, base = _open(folder)
    slot = start
    while slot < start + count:
        with fs.open_input_file(f"{base}/{shard_name(slot // shard_slots)}") as f:
            f.seek(slot % shard_slots * 2 * length)
            until = min(start + count, (slot // shard_slots + 1) * shard_slots)
            while slot < until:
                data = f.read(2 * length)
                if len(data) < 2 * length:
                    return
                yield np.frombuffer(data, "<u2")
                slot += 1


def materialise(df: DataFrame, folder: str | None = None, key: int = KEY, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of df's texts to folder (a shared one) and gives back the index, a row for each sequence."""
    tables = Tables(df.sparkSession)
    seqs = tables.keep(sequences(pick(df, doc_id=id_col, text=text_col), length), "sequences", compression="zstd")
    rows, total = with_slots(tables, seqs, key)
    shards, folder, index = -(-total // SHARD_SLOTS), folder or f"{tables.root}/shards", None
    for k in range(PASSES):
        first, end = shards * k // PASSES, shards * (k + 1) // PASSES
        if first < end or (k == PASSES - 1 and index is None):
            part = tables.keep(write_shards(rows, folder, first, end, length), "index")
            index = part if index is None else index.union(part)
            tables.release()
    sweep(folder)
    return index


def op3_training_order(spark, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
