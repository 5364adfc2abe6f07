"""SentencePiece BPE: exact encoding by backtracking, and decoding.

The greedy merge order of BPE is not run over the text. At each place an Aho-Corasick automaton gives
the pieces that match, longest first; a piece may follow another only if merging the two texts anew
gives back exactly these two pieces; a place from which no piece leads on is marked in a bit field
and never tried again. The sequence found is the one that merging would give.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from stocklens.llm.worker_memory import released, remembers

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
# Latin letters, and signs of ASCII that are no letters.
LETTERS, OTHERS = "[A-Za-z\u00c0-\u024f]", "[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]"
BORDER = re.compile(f"(?<={LETTERS})(?={OTHERS})|(?<={OTHERS})(?={LETTERS})")
# Words of up to so many characters are remembered; of them, and of pairs of pieces, at most twice KEPT
# in a Python worker.
WORD_CHARS, KEPT = 48, 350_000
# Rows that are encoded and given back at once: a task holds the ids and texts of so many.
ROWS = 256


class Memory(dict):
    """Answers of a function by its argument. When full, those not asked for since the last time it was full go."""

    def __init__(self, answer, keeps=lambda key: True):
        super().__init__()
        self.answer, self.keeps, self.older = answer, keeps, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.answer(key)
        if self.keeps(key):
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceModel:
    """The pieces of a model file and the encoding of single words."""

    def __init__(self, data: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        spec, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model must keep the text as it is but for the sign of the blank")
        if kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with pieces of the user's own or unused pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.surfaces = [self._surface(p, proto.trainer_spec.unk_surface) for p in proto.pieces]
        self.is_byte = [p.type == BYTE for p in proto.pieces]
        self.spaced = [p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        # no piece goes on behind a blank, so each run of blanks starts a part that is encoded alone
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # where no piece holds a Latin letter beside such a sign, words part there as well
        self.split = self.parted and not any(BORDER.search(p) for p in self.ids)
        scores = sorted(self.scores.values())
        self.tied = {a for a, b in zip(scores, scores[1:]) if a == b}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        short = lambda text: len(text) <= WORD_CHARS
        self.words = Memory(lambda text: self.word(SPACE + text), short)  # by the text behind the blank
        self.parts = Memory(self._ids, short)  # of words; a first part behind one blank is a word itself
        # whether the second piece may follow the first (or stand first, if that is empty)
        self.pairs = Memory(lambda ab: self.merged(ab[0] + ab[1]) == [x for x in ab if x])

    @staticmethod
    def _surface(p, unknown: str) -> bytes:
        if p.type == BYTE:
            return bytes([int(p.piece[1:-1], 16)])
        return {CONTROL: "", UNKNOWN: unknown}.get(p.type, p.piece.replace(SPACE, " ")).encode()

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, of equal scores the leftmost."""
        if len(text) <= 40:
            part, none, score = list(text), -math.inf, self.scores.get
            gains = [score(a + b, none) for a, b in zip(part, part[1:])]
            while gains and (best := max(gains)) > none:
                i = gains.index(best)
                part[i] += part.pop(i + 1)
                gains.pop(i)
                if i:
                    gains[i - 1] = score(part[i - 1] + part[i], none)
                if i < len(gains):
                    gains[i] = score(part[i] + part[i + 1], none)
            return part
        part, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part) and (score := self.scores.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-score, i, part[i] + part[j], j))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if right[i] != j or j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j], right[i] = both, "", right[j]
            if right[j] < len(part):
                left[right[j]] = i
            right[j] = -1
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text by backtracking; characters without a piece stand alone."""
        if SPACE * 2 in text and self.scores.get(SPACE * 2) in self.tied:
            return self.merged(text)  # runs of blanks have pieces of equal score, whose order depends on the place
        longest = list(text)
        for end, (size, piece) in self.automaton.iter(text):
            longest[end + 1 - size] = piece
        failed = bytearray(len(text) // 8 + 1)
        pairs, out, before, pos = self.pairs, [], "", 0
        piece = longest[0] if text else ""
        while pos < len(text):
            # from the piece at hand to shorter ones, until one fits what stands before
            while True:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and pairs[before, piece]:
                    break
                piece = piece[:-1]
                while len(piece) > 1 and piece not in self.ids:
                    piece = piece[:-1]
                if not piece:
                    break
            if piece:
                out.append(piece)
                before, pos = piece, end
                piece = longest[pos] if pos < len(text) else ""
            else:  # nothing leads on from here: back to the piece before, which now ends at a failed place
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= len(piece)
                before = out[-1] if out else ""
        return out

    def _ids(self, text: str) -> bytes:
        ids = [(self.ids[p],) if p in self.ids else [self.bytes[b] for b in p.encode()] for p in self.pieces(text)]
        return np.fromiter(chain.from_iterable(ids), np.int32).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of a run of blanks and what follows it, as 32-bit numbers."""
        parts = BORDER.split(text) if self.split else [text]
        if len(parts) == 1 and self._one_blank(text):
            return self._ids(text)  # the caller remembers it as a word
        return b"".join([self.words[p[1:]] if self._one_blank(p) else self.parts[p] for p in parts])

    @staticmethod
    def _one_blank(text: str) -> bool:
        return text[0] == SPACE and text[1:2] not in ("", SPACE)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for the empty text."""
        if not text:
            return np.empty(0, np.int32)
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.parted:
            return np.frombuffer(self._ids(text), np.int32)
        first, *rest = text.split(SPACE)
        out = [self.word(first)] if first else []
        if "" not in rest:
            out += map(self.words.__getitem__, rest)
        else:  # an empty part stands between two blanks
            blanks = 0
            for x in rest:
                blanks += 1
                if x:
                    out.append(self.words[x] if blanks == 1 else self.word(SPACE * blanks + x))
                    blanks = 0
            if blanks:
                out.append(self.word(SPACE * blanks))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: a blank that the model put before the text goes, bytes are read as UTF-8."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        if self.prefix:
            first = next((i for i in ids if self.surfaces[i]), None)
            if first is not None and self.spaced[first]:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # every byte that is not part of a character becomes a sign of its own
            return data.decode(errors="surrogateescape").translate({x: 0xFFFD for x in range(0xDC80, 0xDD00)})


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


remembers("piece_bpe", _model.cache_clear)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, ROWS):
            yield batch.slice(row, ROWS)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: the ids of every whole text and the text that they decode to.

    The model file is read by the driver and sent to the tasks; its vocabulary bounds its size. Null
    text counts as empty and gives no ids and an empty text. Rows are independent: null or repeated ids
    and repeated rows come out as they went in, an empty table gives an empty result, and other columns
    are not read. A very long text is one Python string at a time, in time proportional to its length.
    """
    data = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for batch in _small(batches):
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            texts = [model.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(texts, pa.string())],
                ["id", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(released(run, "piece_bpe"), f"id {_id_type(docs, id_col)}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` of rows with ids. Null ids count as none and give an empty text."""
    data = model_bytes(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for batch in _small(batches):
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(released(run, "piece_bpe"), f"id {_id_type(encoded, id_col)}, decoded string").withColumnRenamed("id", id_col)
