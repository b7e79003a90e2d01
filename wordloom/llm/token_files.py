"""Token ids in fixed-width bit packing, with block offsets for numpy unpacking and random access.

A container holds the ids of consecutive documents: a header, the first id number and byte offset of every block, then the
blocks. Each id takes the fewest bits that the vocabulary needs, lowest bit first, and every block starts on a byte, so any
range of ids is unpacked by numpy from the blocks it touches. Documents are laid out in ascending doc_id order over shards
(ranges of ids), containers and places; containers are rows of a Parquet folder, which every store that Spark writes can hold.

The tokenizers library encodes each distinct pre-token once. Where pre-tokens begin is found by numpy, by the library's pattern;
tests hold the ids against the library's encoding of whole texts, so an upgrade that changes the pattern shows there. The last
offsets are summed over one row a shard (SHARD_DOCS documents) in one task.

Defined cases: null text counts as empty and holds only the end id; rows with a null doc_id come first; repeated ids lie side
by side, ordered by their text's hash; texts of any length stay in one container; an empty table gives an empty folder and no rows;
other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm.common import saved, ship, small_batches
from wordloom.llm.pretokens import END_OF_TEXT, Ids, encode_texts, stash

MAGIC, BLOCK_IDS = b"WLTK", 4096
#: A container closes when it holds so many ids; documents in a shard (about).
CONTAINER_IDS, SHARD_DOCS = 262_144, 4_096


def width(vocabulary: int) -> int:
    """Bits that ids 0 .. vocabulary - 1 need."""
    return max(1, (vocabulary - 1).bit_length())


def _pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}")[:n].astype(np.uint32)
    planes = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_container(ids: np.ndarray, bits: int) -> bytes:
    """The container of ids."""
    cuts = list(range(0, len(ids), BLOCK_IDS))
    blocks = [_pack(ids[a : a + BLOCK_IDS], bits) for a in cuts]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<III", bits, len(ids), len(blocks)), offsets.tobytes(), *blocks])


class Container:
    """Random access to a container's ids."""

    def __init__(self, raw):
        self.raw = np.frombuffer(raw, np.uint8)
        if self.raw[:4].tobytes() != MAGIC:
            raise ValueError("not a token container")
        self.bits, self.n, blocks = struct.unpack("<III", self.raw[4:16].tobytes())
        self.offsets = self.raw[16 : 16 + 8 * (blocks + 1)].view("<u8").astype(np.int64)
        self.data = self.raw[16 + 8 * (blocks + 1) :]

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a .. b - 1, from the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK_IDS, (b - 1) // BLOCK_IDS
        parts = [_unpack(self.data[self.offsets[k] : self.offsets[k + 1]].copy(), self.bits, min(BLOCK_IDS, self.n - k * BLOCK_IDS)) for k in range(first, last + 1)]
        return np.concatenate(parts)[a - first * BLOCK_IDS : b - first * BLOCK_IDS]


def library(path: str) -> tuple[Tokenizer, Ids, int]:
    """The worker's tokenizer, ids of pre-tokens as the tokenizers library encodes them, and the id of the special token."""

    def make():
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(words: list[bytes]):
            found = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

        return tokenizer, Ids(encode), tokenizer.token_to_id(END_OF_TEXT)

    return stash(f"library {path}", make)


def write(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Containers of docs(doc_id, text), written and read back: shard, place, doc_ids, ends, payload."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, 500)
    shards = max(1, docs.count() // SHARD_DOCS)
    rows = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        tokenizer, ids, special = library(path)
        bits, shard, place = width(tokenizer.get_vocab_size()), TaskContext.get().partitionId(), 0
        docs, parts, ends = [], [], [0]

        def flush():
            payload = write_container(np.concatenate(parts), bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([place], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([ends[1:]], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["shard", "place", "doc_ids", "ends", "payload"])

        end = np.array([end_id], np.int32)
        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text"), ids, special), strict=True):
                docs.append(doc)
                parts += [found, end]
                ends.append(ends[-1] + len(found) + 1)
                if ends[-1] >= CONTAINER_IDS:
                    yield flush()
                    docs, parts, ends, place = [], [], [0], place + 1
        if docs:
            yield flush()

    return saved(rows.mapInArrow(run, "shard long, place long, doc_ids array<long>, ends array<long>, payload binary"), "tokens")


def read(containers: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the containers' bytes."""
    small_batches(containers.sparkSession, 16)

    def run(batches):
        for batch in batches:
            for shard, place, docs, ends, payload in zip(*(batch.column(i) for i in range(5)), strict=True):
                held, ends, docs = Container(payload.as_buffer()), [0, *ends.as_py()], docs.as_py()
                every = held.read(0, held.n).astype("<u4")
                crc = [zlib.crc32(every[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                same = lambda x: pa.array([x.as_py()] * len(docs), pa.int64())
                yield pa.RecordBatch.from_arrays([same(shard), same(place), pa.array(docs, pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["shard", "place", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = containers.select("shard", "place", "doc_ids", "ends", "payload").mapInArrow(run, "shard long, place long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = containers.select("shard", "place", F.element_at("ends", -1).alias("n"))
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    ahead = whole.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ahead, "shard").select("shard", "place", (F.col("inside") + F.col("ahead")).alias("begin"))
    return rows.join(starts, ["shard", "place"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
