"""Byte-level BPE encoding and decoding by a serialised sentencepiece model (operator 5).

A rank file (base64 token, rank) becomes a sentencepiece BPE ``ModelProto``
without any training: each token's bytes are mapped one to one to printable
characters, the piece's score is the negative rank, and the normaliser is the
identity.  sentencepiece then merges the best-scored neighbouring pair first,
which is the lowest rank first.  Texts are split by the pre-token pattern, each
distinct pre-token is encoded once per worker memo, and decoding maps pieces
back through the inverse byte map.

Defined results: a null text is encoded as the empty text (0 tokens); other
columns are ignored; repeated rows give repeated rows; an empty table gives an
empty result.  A very long text is one row and is never cut.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import column, ship_library, steps, table, tidy

#: Pre-tokens whose ids a worker keeps; the memo is emptied beyond it.
MEMO_PRETOKENS = 120_000


@lru_cache(maxsize=1)
def byte_map() -> tuple[str, ...]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, rest = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(rest)
            rest += 1
    return tuple(chars[b] for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line a token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(r) for a, r in (line.split() for line in f if line.strip())}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank vocabulary; piece ids are the ranks (which must be 0, 1, 2, ...)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0..n-1 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"single bytes without a rank: {missing}")
    chars, model = byte_map(), pb.ModelProto()
    for token, rank in by_rank:
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    unk = "<unk>"
    while unk.encode("latin-1") in ranks:
        unk += ">"
    model.pieces.add(piece=unk, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.unk_piece = pb.TrainerSpec.BPE, len(by_rank) + 1, unk
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(by_rank), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one model and pre-token pattern, with a bounded memo of pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model)
        self.chars = byte_map()
        self.to_chars = dict(enumerate(self.chars))
        back = {c: b for b, c in enumerate(self.chars)}
        n = self.sp.get_piece_size() - 1  # the last piece is the unknown one
        self.tokens = [bytes(back[c] for c in self.sp.id_to_piece(i)) for i in range(n)]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.memo: dict[str, bytes] = {}

    def learn(self, pretokens: set[str]) -> None:
        """Encodes those pre-tokens that the memo lacks, all in one call."""
        if len(self.memo) > MEMO_PRETOKENS:
            self.memo.clear()
        new = [p for p in pretokens if p not in self.memo]
        if new:
            mapped = [p.encode().decode("latin-1").translate(self.to_chars) for p in new]
            for p, ids in zip(new, self.sp.encode(mapped, out_type=int, num_threads=1), strict=True):
                self.memo[p] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; no pre-token is merged with its neighbour."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*split))
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) for p in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    """The worker's codec of a model, made once."""
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded binary: the bytes that the ids stand for.

    The vocabulary file is read on the driver; executors get the serialised
    model (about a megabyte for 50,000 pieces) as a broadcast variable.
    """
    return _encoded(df, ranks_path, pattern, id_col, text_col, digests=False)


def encode_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests (lowercase hex) in place of the two byte strings."""
    return _encoded(df, ranks_path, pattern, id_col, text_col, digests=True)


def encode_rows(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, ids (array<int>) and round_trip: whether the ids decode to the text's bytes."""
    ship_library(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))
    cols = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])

    def run(batches):
        c = codec(model.value, pattern)
        for b in steps(batches, "_text"):
            texts = column(b, "_text").to_pylist()
            ids = c.encode([t or "" for t in texts])
            same = [c.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
            n = np.array([len(i) // 4 for i in ids], dtype=np.int64)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(n), arrays, pa.array(same)], [*keep, "n_tokens", "ids", "round_trip"])
        c.memo = {}  # the worker goes on with other stages

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_text")
    return cols.mapInArrow(tidy(run), f"{schema}, n_tokens long, ids array<int>, round_trip boolean")


def _encoded(df, ranks_path, pattern, id_col, text_col, digests):
    spark = df.sparkSession
    ship_library(spark)
    model = spark.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model.value, pattern)
        for b in steps(batches, "text"):
            ids = c.encode([t or "" for t in column(b, "text").to_pylist()])
            decoded = [c.decode(i) for i in ids]
            if digests:
                tail = [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (ids, decoded)]
            else:
                tail = [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([len(i) // 4 for i in ids], pa.int64()), *tail], names)

    names = ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    cols = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return cols.mapInArrow(run, f"id {id_type}, n_tokens long, {kinds}").withColumnRenamed("id", id_col)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as pt

    docs = table(spark, sf_dir, "documents")
    return encode_digests(docs, pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
