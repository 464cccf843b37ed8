"""Byte-level BPE over a corpus: each distinct word of the corpus is encoded once.

Documents are cut into pre-tokens in their place; the words' positions stay in compact per-block code
lists while only distinct words shuffle. Three steps, cut by tables in the shared folder:

1. *Explode*: each task splits its texts and numbers the words of a block of documents in order of first
   appearance. A document becomes the packed list of its words' numbers (its positions); a block's distinct
   words are dealt to buckets by hash, one packed row a block and bucket.
2. *Encode*: a bucket meets all blocks' words; it runs the merges once for each distinct word and answers
   each block with the ids in the block's own order.
3. *Reassemble*: a block's answers come to its documents, which lie bucketed by block and do not shuffle, and
   each document's numbers turn into ids by place.

A word that fills the corpus is one entry a block, so no key is hot. A block holds
``BLOCK_CHARS`` characters, up to the end of a document, which bounds the memory of steps 1 and 3. Step 2 holds the
distinct words of one bucket, or as many of them as ``KNOWN_WORDS`` allows. The number of buckets follows the
input's partitions up to ``MAX_BUCKETS``, whatever their number: beyond it a bucket has more blocks, one at a time.

The two joins are made of packed lists: "join ids back" is a co-group of a block's documents with its answers and a
gather by word number, decoding a gather from the token-byte table, which has one row a token and is broadcast.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.scale import bound_batches, release_memory
from siltworks.scratch import scratch_buckets

BLOCK_CHARS = 12_000_000
#: Documents whose ids leave a task in one batch.
OUT_ROWS = 250
#: Buckets at most, of blocks as of words; a session may allow fewer (``spark.sql.sources.bucketing.maxBuckets``).
MAX_BUCKETS = 4_096
#: Encoded words that a task of step 2 remembers; it forgets them all and starts anew beyond.
KNOWN_WORDS = 2_000_000

PACKED = T.StructType(
    [
        T.StructField("block", T.LongType(), False),
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("row", T.LongType(), False),
        T.StructField("payload", T.BinaryType(), True),
        T.StructField("codes", T.BinaryType(), True),
    ]
)


def load_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte plane, compressed; planes of small numbers are almost free."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(len(values).to_bytes(8, "little") + planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(4, n).T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.uint32, len(raw)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(raw).to_bytes(8, "little") + sizes + b"".join(raw))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 8)).tolist()
    body, out, at = raw[8 + 4 * n :], [], 0
    for end in ends:
        out.append(body[at:end])
        at = end
    return out


def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _bucket(word: str, buckets: int) -> int:
    import zlib

    return zlib.crc32(word.encode()) % buckets


def _explode(pattern: str, buckets: int, keys: list[str], fields: pa.Schema, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, task = _splitter(pattern), TaskContext.get().partitionId()
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        serial, chars, row = 0, 0, 0

        def words_of_block() -> Iterator[pa.RecordBatch]:
            dealt: list[list[str]] = [[] for _ in range(buckets)]
            places: list[list[int]] = [[] for _ in range(buckets)]
            for w, k in number.items():
                b = _bucket(w, buckets)
                dealt[b].append(w)
                places[b].append(k)
            full = [b for b in range(buckets) if dealt[b]]
            yield table(
                [(task << 32) + serial] * len(full),
                full,
                [-1] * len(full),
                [_pack_words(dealt[b]) for b in full],
                [pack(np.array(places[b], np.uint32)) for b in full],
                None,
            )

        def table(block, bucket, rows, payload, codes, kept) -> pa.RecordBatch:
            own = [
                pa.array(block, pa.int64()),
                pa.array(bucket, pa.int32()),
                pa.array(rows, pa.int64()),
                pa.array(payload, pa.binary()),
                pa.array(codes, pa.binary()),
            ]
            rest = [pa.nulls(len(block), f.type) for f in fields] if kept is None else kept
            return pa.RecordBatch.from_arrays([*own, *rest], names=[*PACKED.names, *keys])

        for batch in batches:
            texts, codes, blocks, first = batch.column(0), [], [], 0
            for i, text in enumerate(texts):
                found = split(text.as_py() or "")
                codes.append(pack(np.fromiter(map(number.__getitem__, found), np.uint32, len(found))))
                blocks.append((task << 32) + serial)
                chars += sum(map(len, found))
                if chars >= block_chars:
                    kept = [batch.column(k + 1).slice(first, i + 1 - first) for k in range(len(keys))]
                    n = i + 1 - first
                    yield table(blocks, [-1] * n, list(range(row, row + n)), [None] * n, codes, kept)
                    yield from words_of_block()
                    number.clear()
                    release_memory()
                    serial, chars, row, first, codes, blocks = serial + 1, 0, 0, i + 1, [], []
            if blocks:
                kept = [batch.column(k + 1).slice(first) for k in range(len(keys))]
                yield table(blocks, [-1] * len(blocks), list(range(row, row + len(blocks))), [None] * len(blocks), codes, kept)
                row += len(blocks)
        if number:
            yield from words_of_block()
            number.clear()
        release_memory()

    return run


def _encode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # A word is a match of the pattern already: here it is one piece, whatever it holds.
        merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for block, b, words, codes in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if b != bucket:
                    known, bucket = {}, b
                ids: list[list[int]] = []
                for w in _unpack_words(words):
                    found = known.get(w)
                    if found is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        found = known[w] = merge.encode_ordinary(w.decode())
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum()))
                answer = len(ids).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(sizes.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([b], pa.int32()),
                        pa.array([-1], pa.int64()),
                        pa.array([answer + b"|ids|" + pack(flat)], pa.binary()),
                        pa.array([codes], pa.binary()),
                    ],
                    names=PACKED.names,
                )
        known.clear()
        release_memory()

    return run


def _answer(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:8], "little")
    middle = zstandard.ZstdDecompressor().decompressobj()
    sizes = np.frombuffer(middle.decompress(payload[8:]), np.uint32)
    assert len(sizes) == n
    return sizes, unpack(middle.unused_data[5:])


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[k] : starts[k] + sizes[k]]`` for each k of ``which``, joined."""
    n = sizes[which]
    ends = np.cumsum(n, dtype=np.int64)
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(len(at), dtype=np.int64)
    return flat[at]


class TokenBytes:
    """The token-byte table: the bytes of each id, and their places in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (1 + max(ranks.values(), default=-1))
        for token, rank in ranks.items():
            table[rank] = token
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of each id, joined by place; an id that is not in the table is an error."""
        return gather(self.starts, self.sizes, self.flat, ids).tobytes() if len(ids) else b""


def _reassemble(keys: list[str], schema: pa.Schema, tokens):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = zip(answers.column("codes"), answers.column("payload"), strict=True)
        words = _merge_answers([(unpack(c.as_py()), *_answer(p.as_py())) for c, p in found])
        pieces = [piece(docs.slice(at, OUT_ROWS), words) for at in range(0, len(docs), OUT_ROWS)]
        release_memory()
        return pa.concat_tables(pieces) if pieces else schema.empty_table()

    def piece(docs: pa.Table, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
        ids = [gather(*words, unpack(c.as_py())) for c in docs.column("codes")]
        offsets = np.cumsum([0, *map(len, ids)])
        values = np.concatenate(ids)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values.astype(np.int32), pa.int32()))
        out = docs.select(keys).append_column("ids", lists.cast(schema.field("ids").type))
        if tokens is not None:
            out = out.append_column("decoded", pa.array([tokens.value.decode(one) for one in ids], pa.binary()))
        return out.cast(schema)

    return run


def _merge_answers(answers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and ids of a block's words, by number."""
    n = sum(len(codes) for codes, _, _ in answers)
    sizes, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for codes, count, ids in answers:
        sizes[codes] = count
        starts[codes] = at + np.cumsum(count, dtype=np.int64) - count
        at += len(ids)
    return starts, sizes, np.concatenate([ids for _, _, ids in answers]) if answers else np.empty(0, np.uint32)


def encode_bpe(
    df: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("doc_id",),
    decoded: bool = False,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``key_cols`` of each row and ``ids array<int>``, the tokens of its whole text, without special tokens.

    With ``decoded`` a column of that name has the bytes that ``decode_bpe`` makes of the ids, in the same task.
    Each match of ``pattern`` is merged by ``ranks`` separately. Null and empty texts have no ids; rows that
    repeat come out as often; an empty table gives an empty table; ``key_cols`` may have any name but ``ids``
    and may hold nulls; other columns of ``df`` are not carried. A text of any length is encoded whole and is a
    block of its own if it is longer than ``block_chars``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    keys = [f"k{i}" for i in range(len(key_cols))]
    slim = df.select(F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in zip(keys, key_cols, strict=True)])
    carried = T.StructType([T.StructField(k, slim.schema[k].dataType, True) for k in keys])
    allowed = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    buckets = min(allowed, max(8, slim.rdd.getNumPartitions()))
    exploded = slim.mapInArrow(
        _explode(pattern, buckets, keys, _arrow_fields(carried), block_chars), T.StructType([*PACKED.fields, *carried.fields])
    )
    exploded = exploded.withColumn("kind", F.when(F.col("row") < 0, 1).otherwise(0))
    exploded = scratch_buckets(exploded, "bpe-words", buckets, "block", "kind")
    shared = spark.sparkContext.broadcast(ranks)
    words = exploded.where("kind = 1").select("block", "bucket", "payload", "codes")
    by_bucket = words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = by_bucket.mapInArrow(_encode(shared), PACKED).select("block", "payload", "codes")
    docs = exploded.where("kind = 0").select("block", "codes", *keys)
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), True)]
    made += [T.StructField("decoded", T.BinaryType(), True)] if decoded else []
    out_schema = T.StructType([*carried.fields, *made])
    tokens = spark.sparkContext.broadcast(TokenBytes(ranks)) if decoded else None
    together = docs.groupBy("block").cogroup(answers.groupBy("block"))
    out = together.applyInArrow(_reassemble(keys, _arrow_fields(out_schema), tokens), out_schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, key_cols, strict=True)], *[f.name for f in made])


def _arrow_fields(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _decode(tokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: TokenBytes = tokens.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            known = [one.values.to_numpy(zero_copy_only=False) if one.is_valid else np.empty(0, np.int32) for one in lists]
            out = pa.array([table.decode(ids) for ids in known], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return run


def decode_bpe(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Add ``decoded binary`` to the rows of ``df``: each id's bytes, from the token-byte table, by place.

    The table has one row a token of the vocabulary (some 50,000), which bounds what is broadcast. Null and
    empty lists decode to no bytes; an id that is not in the table is an error.
    """
    bound_batches(df.sparkSession)
    slim = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ids_col, "decoded")], ids_col)
    schema = T.StructType([*slim.schema.fields, T.StructField("decoded", T.BinaryType(), True)])
    return slim.mapInArrow(_decode(df.sparkSession.sparkContext.broadcast(TokenBytes(ranks))), schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document the number of ids and digests of the ids and of what they decode to."""
    import public_tokenizers

    ranks = load_ranks(path or tokenizer_file())
    out = encode_bpe(docs, ranks, pattern or public_tokenizers.PATTERN, decoded=True)
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(digits, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
