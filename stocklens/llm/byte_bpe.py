"""Byte-level BPE: exact encoding and decoding with a rank file.

The rank file becomes a sentencepiece BPE model without any training: each byte stands as one
character, each entry is a piece made of such characters, its score is the negative rank, and texts
are not normalised. Merging by best score, of equal ones the leftmost, is then merging by lowest
rank. Texts are cut into pre-tokens by the given pattern, and each is encoded by that model alone.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from stocklens.llm.piece_bpe import Memory, model_bytes

# The character that stands for byte 0; the others follow. None of these is white space.
FIRST = 0x100
TO_SIGNS = {b: FIRST + b for b in range(256)}
# Pre-tokens of up to so many characters are remembered by a Python worker, at most 500,000 of them.
TOKEN_CHARS = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Byte strings and their ranks: a line each, the string in base 64."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold all single bytes")
    return ranks


def signs(data: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return data.decode("latin-1").translate(TO_SIGNS)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A BPE model whose ids are the ranks; the last id is the sign for the unknown, which never comes up."""
    proto = sentencepiece_model_pb2.ModelProto()
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    for data, rank in sorted(ranks.items(), key=lambda x: x[1]):
        proto.pieces.add(piece=signs(data), score=-float(rank), type=kinds.NORMAL)
    proto.pieces.add(piece="<unk>", score=0.0, type=kinds.UNKNOWN)
    trainer, normal = proto.trainer_spec, proto.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.byte_fallback = trainer.BPE, len(proto.pieces), False
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(ranks), -1, -1, -1
    normal.name, normal.precompiled_charsmap = "identity", b""
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return proto.SerializeToString()


@lru_cache(maxsize=1)
def differing_signs() -> dict[int, str]:
    """Characters that the tokenizer library and the pattern library of Python class differently, each with a
    character that both put into the class which the tokenizer library sees.

    The two follow different versions of Unicode; the library to be matched is asked once about every character.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    alone = {bytes([b]): b for b in range(256)}
    theirs, ours = {}, {}
    for name, pattern in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s")):
        asked = tiktoken.Encoding("ask", pat_str=pattern, mergeable_ranks=alone, special_tokens={})
        theirs.update(dict.fromkeys(bytes(asked.encode_ordinary(every)).decode(), name))
        ours.update(dict.fromkeys(regex.findall(pattern, every), name))
    same = {"letter": "\u0294", "number": "\u0be6", "space": "\u2003", None: "\ufdd0"}
    return {ord(x): same[theirs.get(x)] for x in {*theirs, *ours} if theirs.get(x) != ours.get(x)}


def _ranges(codes: list[int]) -> str:
    """A pattern of one character out of ``codes`` (in order)."""
    firsts = [x for before, x in zip([-2, *codes], codes) if x - before > 1]
    lasts = [x for x, after in zip(codes, [*codes[1:], codes[-1] + 2]) if after - x > 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts)) + "]"


class RankModel:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, ranks: bytes, model: bytes, pattern: str, differing: dict[int, str]):
        self.ranks = read_ranks(ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern, self.differing = regex.compile(pattern), differing
        self.differs = re.compile(_ranges(sorted(differing))) if differing else None
        back = {chr(sign): byte for byte, sign in TO_SIGNS.items()}
        self.bytes = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(len(self.ranks))]
        self.tokens = Memory(self.token, lambda text: len(text) <= TOKEN_CHARS)

    def token(self, text: str) -> bytes:
        """Ids of a pre-token as 32-bit numbers; one that is an entry as a whole is not taken apart."""
        data = text.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else self.pieces.encode(signs(data), out_type=int)
        return np.array(ids, np.int32).tobytes()

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if text.isascii() or self.differs is None or not self.differs.search(text):
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.differing))]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.tokens.__getitem__, self.cut(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def _model(ranks: bytes, model: bytes, pattern: str) -> RankModel:
    return RankModel(ranks, model, pattern, differing_signs())


def _prepare(rank_path: str) -> tuple[bytes, bytes]:
    data = model_bytes(rank_path)
    return data, sentencepiece_model(read_ranks(data))


def encode_bytes(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: the ids of every whole text, and the bytes that they decode to.

    The rank file is read by the driver and sent to the tasks with the model made of it; its vocabulary bounds
    their size. Null text counts as empty and gives no ids and no bytes. Rows are independent: null or repeated
    ids and repeated rows come out as they went in, an empty table gives an empty result, and other columns,
    whatever their names, are not read. A very long text is one Python string at a time; a pre-token of n
    characters takes time in proportion to n log n.
    """
    ranks, model = _prepare(rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(ranks, model, pattern)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            decoded = pa.array([coder.decode(x.tolist()) for x in ids], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["id", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode_bytes(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` (bytes) of rows with ids. Null ids count as none; an id beyond the vocabulary is an error."""
    ranks, model = _prepare(rank_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(ranks, model, pattern)
        for batch in batches:
            texts = pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "decoded"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    kind = encoded.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
