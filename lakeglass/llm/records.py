"""Operator 5: length-delimited binary records of token ids, with masked CRC-32C checksums, and a separate offset index.

A record is: length of the data (uint64, little endian), masked checksum of these 8 bytes (uint32), data, masked checksum of
the data. The data are the token ids of a document as little-endian numbers of WIDTH bytes. Each task writes its shard
under a name of its own in the output folder and renames it when it is whole, so a task that fails or runs twice leaves no
half shard, and the index names only shards that are whole. The index is a Parquet table beside them:
(shard, record, doc_id, offset, length, n_tokens, crc). With it records are read in any order (``read_records``).

Tokens are those of a byte-level BPE vocabulary (rank file, a parameter), cut by its own pattern.

Defined results: a null text is a record without tokens and null n_tokens; an empty text a record without tokens. Repeated rows and null
doc_ids are records of their own. Other columns are ignored. An empty table has an empty index. Ids beyond the width are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder, ranks_of
from .common import fresh_path

WIDTH = 2
#: Bytes of a block for which checksums are worked out side by side.
LANE = 512
INDEX = "shard string, record long, doc_id long, offset long, length long, n_tokens long, crc long"


def _tables() -> np.ndarray:
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0][t[k - 1] & np.uint32(255)]
    return t


TABLES = _tables()


def _zeros(n: int) -> np.ndarray:
    """Four tables that move a checksum state over n zero bytes."""
    state = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(n):
        state = (state >> np.uint32(8)) ^ TABLES[0][state & np.uint32(255)]
    out = np.zeros((4, 256), np.uint32)
    for b in range(4):
        for v in range(256):
            for k in range(8):
                if v >> k & 1:
                    out[b, v] ^= state[8 * b + k]
    return out


OVER_LANE = _zeros(LANE)


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of data[start[k]:end[k]] for all k side by side.

    Each is cut, from its end, into lanes of LANE bytes; the first is filled up with zeros in front, which change nothing
    from a state of 0. All lanes are worked out at once, 8 bytes a step, and then joined.
    """
    n = end - start
    # The initial state of ones is the same as inverting the first four bytes; shorter data are done apart.
    out = np.zeros(len(n), np.uint32)
    short = np.flatnonzero(n < 4)
    for k in short:
        c = 0xFFFFFFFF
        for b in data[start[k] : end[k]].tolist():
            c = (c >> 8) ^ int(TABLES[0, (c ^ b) & 255])
        out[k] = c ^ 0xFFFFFFFF
    long = np.flatnonzero(n >= 4)
    if not len(long):
        return out
    lanes = -(-n[long] // LANE)
    first = np.cumsum(lanes) - lanes
    buf = np.zeros((int(lanes.sum()), LANE), np.uint8)
    flat = buf.reshape(-1)
    to = (first + lanes) * LANE - n[long]
    for a, b, t in zip(start[long].tolist(), end[long].tolist(), to.tolist()):
        flat[t : t + b - a] = data[a:b]
    for k in range(4):
        flat[to + k] ^= 255
    words = buf.view("<u4").T.copy()
    state = np.zeros(len(buf), np.uint32)
    for k in range(0, LANE // 4, 2):
        x, y = state ^ words[k], words[k + 1]
        state = TABLES[7][x & 255] ^ TABLES[6][(x >> 8) & 255] ^ TABLES[5][(x >> 16) & 255] ^ TABLES[4][x >> 24]
        state ^= TABLES[3][y & 255] ^ TABLES[2][(y >> 8) & 255] ^ TABLES[1][(y >> 16) & 255] ^ TABLES[0][y >> 24]
    total = state[first].copy()
    for k in range(1, int(lanes.max())):
        on = np.flatnonzero(lanes > k)
        s = total[on]
        total[on] = OVER_LANE[0][s & 255] ^ OVER_LANE[1][(s >> 8) & 255] ^ OVER_LANE[2][(s >> 16) & 255] ^ OVER_LANE[3][s >> 24] ^ state[first[on] + k]
    out[long] = ~total
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def framed(data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the records of data cut in lengths n, their offsets, and the masked checksums of their data."""
    end = np.cumsum(n)
    start = end - n
    head = n.astype("<u8").view(np.uint8)
    at = np.arange(len(n), dtype=np.int64)
    head_crc, crc = masked(crc32c(head, at * 8, at * 8 + 8)), masked(crc32c(data, start, end))
    offset = start + 16 * at
    out = np.empty(int(len(data) + 16 * len(n)), np.uint8)
    body = np.ones(len(out), bool)
    for field, place in ((head.reshape(-1, 8), offset), (head_crc.astype("<u4").view(np.uint8).reshape(-1, 4), offset + 8), (crc.astype("<u4").view(np.uint8).reshape(-1, 4), offset + 12 + n)):
        spots = (place[:, None] + np.arange(field.shape[1])).ravel()
        out[spots] = field.ravel()
        body[spots] = False
    out[body] = data
    return out, offset, crc


def write_records(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, width: int = WIDTH) -> DataFrame:
    """Writes shards and their index under folder, from the executors; returns the index, read again."""
    ranks = ranks_of(vocabulary)
    if max(ranks.values()) >= 1 << (8 * width):
        raise ValueError(f"ids of this vocabulary don't fit into {width} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        place, path = fs.FileSystem.from_uri(f"{folder}/records")
        place.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.rec"
        record = at = 0
        rows = []
        with place.open_output_stream(f"{path}/_{name}") as sink:
            for b in batches:
                texts = b["text"].to_pylist()
                ids = enc.encode_ordinary_batch([t or "" for t in texts], num_threads=1)
                tokens = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate([np.array(x, f"<u{width}") for x in ids]) if len(ids) else np.empty(0, f"<u{width}")
                raw, offset, crc = framed(flat.view(np.uint8), tokens * width)
                sink.write(raw.tobytes())
                rows.append((record, b["doc_id"], at + offset, tokens * width, pa.array(tokens, mask=np.array([t is None for t in texts], bool)), crc))
                record, at = record + len(ids), at + len(raw)
        if record:
            place.move(f"{path}/_{name}", f"{path}/{name}")
        else:
            place.delete_file(f"{path}/_{name}")
        for first, doc_id, offset, length, n, crc in rows:
            m = len(length)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.arange(first, first + m)), doc_id, pa.array(offset), pa.array(length), n, pa.array(crc.astype(np.int64))], ["shard", "record", "doc_id", "offset", "length", "n_tokens", "crc"])

    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """(shard, record, doc_id, ids) of the records of index, in whatever order its rows come; wrong checksums are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = fs.FileSystem.from_uri(f"{folder}/records")
        open_: dict[str, object] = {}
        for b in batches:
            out = []
            for shard, offset, length, crc in zip(b["shard"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), b["crc"].to_pylist()):
                f = open_.get(shard)
                if f is None:
                    f = open_[shard] = place.open_input_file(f"{path}/{shard}")
                raw = np.frombuffer(f.read_at(length + 16, offset), np.uint8)
                if len(raw) != length + 16 or int(raw[:8].view("<u8")[0]) != length:
                    raise ValueError(f"{shard} at {offset}: not a record of {length} bytes")
                sums = masked(crc32c(raw, np.array([0, 12]), np.array([8, 12 + length])))
                if int(raw[8:12].view("<u4")[0]) != sums[0] or int(raw[12 + length :].view("<u4")[0]) != sums[1] or int(sums[1]) != crc:
                    raise ValueError(f"{shard} at {offset}: wrong checksum")
                out.append(raw[12 : 12 + length].view(f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["shard"], b["record"], b["doc_id"], pa.array(out, pa.list_(pa.int32()))], ["shard", "record", "doc_id", "ids"])

    return index.mapInArrow(run, "shard string, record long, doc_id long, ids array<int>")


def records(docs: DataFrame) -> DataFrame:
    """The index of records that are written to a new place in the shared folder."""
    return write_records(docs, fresh_path(docs.sparkSession, "records"))
