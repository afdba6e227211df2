"""SentencePiece encoding that keeps the source bytes of every piece, and decoding."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from loomtrace.llm.common import whole_text

SPACE = "▁"  # stands for a blank in pieces
CACHED, CACHED_CHARS = 200_000, 48  # segments a task remembers, and the longest of them


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that begins at `at`, and its replacement."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class PieceCodec:
    """Encoder and decoder of one model, for use inside a task."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, self.library = proto.normalizer_spec, sentencepiece.SentencePieceProcessor(model_proto=model)
        self.escapes, self.prefixes, self.strips = spec.escape_whitespaces, spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.own = [p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED]
        # The library's segmentation alone: text comes to it normalised.
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.core = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # No merge reaches over a place where a blank follows something else, unless a piece does.
        over = any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces if p.type != kinds.CONTROL)
        merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.words = merges and not over and not self.suffix
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.words else r"(?s).+")
        self.bytes_of = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = proto.trainer_spec.unk_id
        self.known: dict[str, bytes] = {}

    def normalise(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        """(normalised text, source start and source end of each of its bytes)."""
        if self.map is None and not self.own and not self.strips:
            return self._escape(data)
        out, low, high = bytearray(), [], []
        blank = SPACE.encode() if self.escapes else b" "

        def put(piece: bytes, start: int, end: int) -> None:
            for byte in piece:
                part = blank if byte == 32 else bytes((byte,))
                out.extend(part)
                low.extend([start] * len(part))
                high.extend([end] * len(part))

        at, spaced, parts = 0, self.strips, []
        while at < len(data):
            own = max((p for p in self.own if data.startswith(p, at)), key=len, default=None)
            hit = (len(own), own) if own else self.map.longest(data, at) if self.map else None
            if hit is None:
                first = data[at]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                hit = n, data[at : at + n]
            parts.append((hit[1], at, at + hit[0]))
            at += hit[0]
        lead = 0
        if self.strips:
            while lead < len(parts) and parts[lead][0] in (b" ", b""):
                lead += 1
        parts = parts[lead:]
        if not parts:
            return "", np.empty(0, np.int64), np.empty(0, np.int64)
        if self.prefixes and not self.suffix:
            put(b" ", parts[0][1], parts[0][1])
        for piece, start, end in parts:
            if spaced:
                piece = piece.lstrip(b" ")
            put(piece, start, end)
            if piece:
                spaced = self.strips and piece.endswith(b" ")
        if self.strips:
            while out.endswith(blank):
                del out[-len(blank) :], low[-len(blank) :], high[-len(blank) :]
        if self.prefixes and self.suffix:
            put(b" ", len(data), len(data))
        return out.decode(), np.array(low, np.int64), np.array(high, np.int64)

    def _escape(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        """Without a map a blank becomes SPACE and everything else stays."""
        if not data:
            return "", np.empty(0, np.int64), np.empty(0, np.int64)
        text = data.decode("utf-8", "replace")
        text = text.replace(" ", SPACE) if self.escapes else text
        blank = SPACE if self.escapes else " "
        width = np.where(np.frombuffer(data, np.uint8) == 32, len(blank.encode()), 1)
        low = np.repeat(np.arange(len(data)), width)
        high, pad = low + 1, len(blank.encode()) * bool(self.prefixes)
        if not pad:
            return text, low, high
        zero, last = np.zeros(pad, np.int64), np.full(pad, len(data))
        if self.suffix:
            return text + blank, np.concatenate((low, last)), np.concatenate((high, last))
        return blank + text, np.concatenate((zero, low)), np.concatenate((zero, high))

    def _pack(self, segments: list[str]) -> list[bytes]:
        """Ids and byte lengths of the pieces of each segment, packed."""
        parts = self.core.encode(segments, num_threads=1)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter(itertools.chain.from_iterable(parts), "<u4", int(counts.sum()))
        sizes = self.bytes_of[ids]
        if (ids == self.unknown).any():  # only the piece itself tells how much an unknown id stands for
            pieces = itertools.chain.from_iterable(self.core.encode(segments, out_type=str, num_threads=1))
            sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(ids))
        packed, ends = np.stack((ids, sizes.astype("<u4")), axis=1).tobytes(), (8 * np.cumsum(counts)).tolist()
        return [packed[i:j] for i, j in zip([0, *ends[:-1]], ends)]

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, source start, source end) of the pieces of a whole text, without begin and end ids."""
        text, low, high = self.normalise(data)
        if self.words and text[:1] == SPACE and text[-1] != SPACE and 2 * SPACE not in text:
            segments = text[1:].split(SPACE)  # each stands for itself behind one blank
            whole = lambda s: SPACE + s
        else:
            segments, whole = [SPACE + s for s in self.segments.findall(text)], lambda s: s[1:]
        known = self.known
        if len(known) > CACHED:
            known.clear()
        new = [s for s in set(segments) if s not in known]
        known.update(zip(new, self._pack([whole(s) for s in new]) if new else ()))
        both = np.frombuffer(b"".join(map(known.__getitem__, segments)), "<u4").reshape(-1, 2)
        for s in new:
            if len(s) > CACHED_CHARS:
                del known[s]
        ends = np.cumsum(both[:, 1], dtype=np.int64)
        return both[:, 0], low[ends - both[:, 1]], high[ends - 1]

    def with_marks(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate(([self.library.bos_id()], ids, [self.library.eos_id()])).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids (with begin and end), starts and ends (source byte spans of the pieces between them), decoded.

    A null text is an empty one and gives the two marks only. Rows are independent, so repeated rows give repeated
    results; other columns are ignored. The model travels as a broadcast of its file's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):  # a row a batch: spans of long texts are large
                ids, starts, ends = codec.encode(text.as_py())
                marked = codec.with_marks(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()], pa.int64()), pa.array([marked.tolist()], pa.list_(pa.int32())), pa.array([starts.tolist()], pa.list_(pa.int64())),
                     pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([codec.decode(marked)])],
                    ["doc_id", "ids", "starts", "ends", "decoded"],
                )

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return text.mapInArrow(run, "doc_id bigint, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")


def encoding_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """What encode_documents returns, as numbers and digests: doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes.

    ids_sha256 is over little-endian unsigned 32-bit ids; span_bytes is the number of source bytes that pieces cover.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(shared.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids, starts, ends = codec.encode(text.as_buffer().to_pybytes())
                marked = codec.with_marks(ids)
                covered = int((ends - np.maximum(starts, np.concatenate(([0], ends[:-1])))).sum()) if len(ids) else 0
                decoded = codec.decode(marked).encode()
                rows.append((len(marked), sha256(marked.tobytes()).hexdigest(), sha256(decoded).hexdigest(), covered))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return text.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, span_bytes bigint")
