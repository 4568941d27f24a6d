"""Operator 2: byte-level BPE by a global shuffle of distinct words, and back by the token-byte table.

1. Documents are dealt to blocks by a hash, their texts compressed; a block's texts are cut into pre-tokens
   (``PATTERN``), in order of position.
2. A block asks once for each of its distinct pre-tokens. Requests meet by pre-token, where each distinct one is
   encoded once for the whole corpus, and the ids go back to each block that asked: a frequent word is sent once a block, not
   once a place, so the join back isn't skewed. Requests and answers are sorted lists, packed by block and part.
3. In the block, the ids take the pre-tokens' places: positions are those of the block's own texts.
4. Decoding joins ids with the token-byte table (one row a token of the vocabulary, whose size doesn't depend on the
   data) and puts the bytes together by position.

The vocabulary is a parameter: the path of a rank file (base64 of the bytes, rank). It is read by the driver.

Defined results: null gives null ids, n_tokens and decoded; an empty text gives []. Rows are encoded as they are: repeated rows
and null doc_ids are rows of their own. Texts of special tokens are ordinary text. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, small, unpack

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text, about, of a block.
BLOCK_BYTES = 24 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pre_tokens(text: str) -> list[str]:
    return _pattern().findall(text)


def _pattern(held: list = []):  # noqa: B006
    if not held:
        held.append(regex.compile(PATTERN))
    return held[0]


def encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def part_of(word: str, parts: int) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % parts


def by_part(words: Iterable[str], parts: int) -> list[list[str]]:
    """Distinct words by the part that they meet in, sorted."""
    out: list[list[str]] = [[] for _ in range(parts)]
    for w in words:
        out[part_of(w, parts)].append(w)
    for ws in out:
        ws.sort()
    return out


def texts_of(blobs: pa.ChunkedArray) -> Iterator[tuple[list[int | None], list[str | None]]]:
    for blob in blobs:
        for b in pa.ipc.open_stream(blob.as_buffer()):
            yield b["doc_id"].to_pylist(), b["text"].to_pylist()


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES, decode: bool = False) -> DataFrame:
    """(doc_id, ids); decode: and decoded, as decoded() makes it, in the task that has the ids, so that no second Python process is needed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))
    blocks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    parts = max(1, blocks // 2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of a batch by block, compressed."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            block = b["block"].to_numpy()
            for k in np.unique(block):
                sink = pa.BufferOutputStream()
                some = b.select(["doc_id", "text"]).take(pa.array(np.flatnonzero(block == k)))
                with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                    out.write_batch(some)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "blob"])

    def ask(t: pa.Table) -> pa.Table:
        """A block's distinct pre-tokens, once each, by the part where they meet those of other blocks."""
        words: set[str] = set()
        for _, texts in texts_of(t["blob"]):
            for text in texts:
                if text:
                    words.update(pre_tokens(text))
        lists = by_part(words, parts)
        packed = [(p, compressed(ws)) for p, ws in enumerate(lists) if ws]
        n = len(packed)
        return pa.table({"part": pa.array([p for p, _ in packed], pa.int64()), "of_block": pa.array([t["block"][0].as_py()] * n, pa.int64()), "words": pa.array([x for _, x in packed], pa.binary())})

    def encode(t: pa.Table) -> pa.Table:
        """Each distinct pre-token of a part is encoded once; every block gets the ids in the order of its request."""
        enc, known = encoder(sent.value), {}
        answers = []
        for blob in t["words"].to_pylist():
            counts, flat = [], []
            for w in opened(blob):
                if (ids := known.get(w)) is None:
                    ids = known[w] = tuple(enc._encode_single_piece(w.encode("utf-8", "surrogatepass")))
                counts.append(len(ids))
                flat.extend(ids)
            answers.append((len(counts), pack(np.array(counts, np.uint32)), len(flat), pack(np.array(flat, np.uint32))))
        columns = [pa.array(c, k) for c, k in zip(zip(*answers), (pa.int64(), pa.binary(), pa.int64(), pa.binary()))]
        return pa.table([t["of_block"], t["part"], *columns], ["of_block", "part", "n", "counts", "total", "ids"])

    def place(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Ids in the places of the pre-tokens."""
        number: dict[str, int] = {}
        ids, codes = [], []
        for some, ts in texts_of(texts["blob"]):
            ids += some
            for text in ts:
                codes.append(None if text is None else np.array([number.setdefault(w, len(number)) for w in pre_tokens(text)], np.int32))
        start, size, flat, at = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [], 0
        lists = by_part(number, parts)
        for r in answers.to_pylist():
            own = np.array([number[w] for w in lists[r["part"]]], np.int64)
            n = unpack(r["counts"], r["n"], np.uint32)[0].astype(np.int64)
            start[own], size[own] = at + np.cumsum(n) - n, n
            flat.append(unpack(r["ids"], r["total"], np.uint32)[0].astype(np.int32))
            at += r["total"]
        del lists
        number.clear()
        flat_ = np.concatenate(flat) if flat else np.empty(0, np.int32)
        out, ends, total = [], [0], 0
        for c in codes:
            if c is not None and len(c):
                n = size[c]
                out.append(flat_[np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
                total += len(out[-1])
            ends.append(total)
        nulls = np.array([c is None for c in codes] + [False])
        values = pa.array(np.concatenate(out) if out else np.empty(0, np.int32), pa.int32())
        out.clear()
        made = pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32), mask=nulls), values)})
        if decode:
            tokens = pa.array(token_bytes(sent.value), pa.binary())
            made = made.append_column("decoded", pa.chunked_array([texts_by(tokens, c["ids"]) for c in small(made.to_batches())], pa.string()))
        return made

    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks))).mapInArrow(deal, "block long, blob binary")
    asked = dealt.groupBy("block").applyInArrow(ask, "part long, of_block long, words binary")
    answered = asked.groupBy("part").applyInArrow(encode, "of_block long, part long, n long, counts binary, total long, ids binary")
    return dealt.groupBy("block").cogroup(answered.groupBy("of_block")).applyInArrow(place, "doc_id long, ids array<int>" + ", decoded string" * decode)


def compressed(words: list[str]) -> bytes:
    """Words as lengths and letters."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    body = len(raw).to_bytes(8, "little") + np.array([len(x) for x in raw], "<u4").tobytes() + b"".join(raw)
    return zstandard.ZstdCompressor(level=3).compress(body)


def opened(blob: bytes) -> Iterator[str]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(body, "<u4", n, 8).astype(np.int64))).tolist()
    at = 8 + 4 * n
    for end in ends:
        yield body[at:end].decode("utf-8", "surrogatepass")
        at = end


def token_bytes(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The token-byte table: bytes by id."""
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        table[r] = b
    return table


def texts_by(tokens: pa.Array, lists: pa.ListArray) -> pa.Array:
    """Ids joined with the token-byte table, their bytes put together by position."""
    parts = pc.take(tokens, lists.flatten())
    offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), parts), b"")
    return pa.array([None if n else x.decode("utf-8", "replace") for x, n in zip(whole.to_pylist(), lists.is_null().to_pylist())], pa.string())


def decoded(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the column decoded: the text of the column ids; bytes that aren't UTF-8 become U+FFFD."""
    sent = df.sparkSession.sparkContext.broadcast(token_bytes(ranks_of(vocabulary)))
    schema = df.drop("decoded").schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(sent.value, pa.binary())
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*(b[c] for c in schema.names[:-1]), texts_by(tokens, b["ids"])], schema.names)

    return df.drop("decoded").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of all documents."""
    return encoded(docs, vocabulary, decode=True).select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "decoded")
