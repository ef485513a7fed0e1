"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here: pieces with scores and kinds, model type, byte
fallback, and the normaliser (character map, dummy prefix, extra white space).  From it a
tokenizers pipeline is rebuilt: a Unigram model with its scores, or a BPE model whose
merges follow from the scores, with the metaspace marker and byte fallback.  No piece of
a usual vocabulary holds the marker after another character; then a normalised text
falls apart before each run of markers without changing the result, so very long texts
are cut there.  Batches of texts go to the library's threads.  Where two unigram cuts of
a text have one score, either is right, and the sentencepiece library may take the other.

Defined results: null and empty texts have no tokens and decode to the empty text; texts
are read whole; rows are coded one by one, so ties, repeated rows and null ids do not
matter; an empty table gives no rows.  All columns are kept; ``ids`` and ``ids_crc32``
(and ``decoded``) are added and replace columns of these names, in any case of letters.
Work is cut into slices of a megabyte of text, so memory does not grow with a batch.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import cut, slices

MARK = "▁"
#: Fixed values of the format: piece kinds and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are encoded at once, and beyond which a text is cut.
_AT_ONCE, _LONG = 1 << 17, 1 << 20
_BREAK = re.compile(f"[^{MARK}](?={MARK})")


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int


@dataclass
class Model:
    pieces: list[Piece] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def parse_model(data: bytes) -> Model:
    """What encoding needs of a ModelProto (fields 1 pieces, 2 trainer, 3 normaliser)."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            model.pieces.append(Piece(f[1].decode("utf-8"), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            model.kind, model.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            model.charsmap, model.dummy_prefix, model.collapse_spaces = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first, as BPE tries them."""
    usable = {p.text: i for i, p in enumerate(model.pieces) if p.kind in (NORMAL, USER_DEFINED)}
    found = []
    for text, i in usable.items():
        for k in range(1, len(text)):
            if text[:k] in usable and text[k:] in usable:
                found.append((-model.pieces[i].score, i, usable[text[:k]], usable[text[k:]], text[:k], text[k:]))
    return [(x[4], x[5]) for x in sorted(found)]


class Codec:
    """One model, ready to encode and decode in this process."""

    def __init__(self, data: bytes):
        from tokenizers import Regex, Tokenizer, models, normalizers

        m = self.model = parse_model(data)
        unk = next((i for i, p in enumerate(m.pieces) if p.kind == UNKNOWN), 0)
        if m.kind == UNIGRAM:
            core = models.Unigram([(p.text, p.score) for p in m.pieces], unk_id=unk, byte_fallback=m.byte_fallback)
        else:
            core = models.BPE({p.text: i for i, p in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[unk].text, fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.collapse_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.plain = not steps
        self.clean = normalizers.Sequence(steps)
        self.parts = not any(re.search(f"[^{MARK}]{MARK}", p.text) for p in m.pieces)
        out = [bytes([int(p.text[3:5], 16)]) if p.kind == BYTE else b"" if p.kind == CONTROL else " ⁇ ".encode() if p.kind == UNKNOWN else p.text.replace(MARK, " ").encode() for p in m.pieces]
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_ends = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.is_byte = np.array([p.kind == BYTE for p in m.pieces])

    def normalise(self, text: str) -> str:
        if not self.plain:
            text = self.clean.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _pieces_of(self, text: str) -> Iterator[str]:
        """A normalised text, cut before runs of markers where it is long; that changes no token."""
        at = 0
        while self.parts and len(text) - at > _LONG:
            found = _BREAK.search(text, at + _LONG)
            if not found:
                break
            yield text[at : found.start() + 1]
            at = found.start() + 1
        if at < len(text):
            yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's bounds in them."""
        ids, bounds, parts, owner = array("i"), np.zeros(len(texts) + 1, dtype=np.int64), [], []

        def flush() -> None:
            # the library's result objects are large, so few texts go to its threads at once
            for k, e in zip(owner, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
                ids.extend(e.ids)
                bounds[k + 1] = len(ids)
            parts.clear()
            owner.clear()

        held = 0
        for k, t in enumerate(texts):
            for part in self._pieces_of(self.normalise(t)):
                parts.append(part)
                owner.append(k)
                held += len(part)
                if held > _AT_ONCE:
                    flush()
                    held = 0
        flush()
        return np.array(ids, dtype=np.int32), np.maximum.accumulate(bounds)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        raw, at = _gather(self.out_bytes, self.out_ends, ids.astype(np.int64), bounds)
        data, skip = raw.tobytes(), int(self.model.dummy_prefix)
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:]))
        return [t[1:] if skip and t.startswith(" ") else t for t in texts]


def _gather(values: np.ndarray, ends: np.ndarray, picks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``values`` (the k-th from ends[k] to ends[k + 1]) named by ``picks``, joined, and ``bounds`` moved along."""
    starts, n = ends[:-1][picks], np.diff(ends)[picks]
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(at[-1])
    index += np.repeat(starts - at[:-1], n)
    return values[index], at[bounds]


@functools.lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: What coding can add to a table, and its types; the first three come from encoding, the others from decoding.
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_crc32": T.LongType(), "decoded": T.StringType(), "n_byte_tokens": T.LongType()}
#: Ids are decoded so many at once, whatever the batch.
_IDS_AT_ONCE = 1 << 19


def _encoded(c: Codec, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids, bounds = c.encode([t or "" for t in part.column("text").to_pylist()])
    return ids.astype("<i4"), bounds


def _decoded(c: Codec, ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    raw = np.concatenate([[0], np.cumsum(c.is_byte[ids])])
    return {"decoded": pa.array(c.decode(ids, bounds), pa.string()), "n_byte_tokens": pa.array(raw[bounds[1:]] - raw[bounds[:-1]], pa.int64())}


def _with(rows: DataFrame, run, *added: str) -> DataFrame:
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(x, OUTPUTS[x]) for x in added]]))


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def encode(docs: DataFrame, model_path: str, *want: str) -> DataFrame:
    """``docs`` with ids (array of int) and ids_crc32 (of the ids as little-endian int32), or with ``want``.

    ``want`` may name any of OUTPUTS; then a text is encoded and decoded in one pass.
    """
    data, want = _read(model_path), want or ("ids", "ids_crc32")  # half a megabyte, sent with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = _encoded(c, part)
                made = {"n_tokens": pa.array(np.diff(bounds), pa.int64())}
                if "ids" in want:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                if "ids_crc32" in want:
                    made["ids_crc32"] = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())
                if "decoded" in want or "n_byte_tokens" in want:
                    made |= _decoded(c, ids, bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, *[made[x] for x in want]], [*part.schema.names, *want])

    return _with(_without(docs, *want), run, *want)


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``coded`` with decoded (text) made from ids, and n_byte_tokens."""
    data = _read(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in cut(batch, sizes, _IDS_AT_ONCE):
                lists = part.column("ids")
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                made = _decoded(c, lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*part.schema.names, *made])

    return _with(_without(coded, "decoded", "n_byte_tokens"), run, "decoded", "n_byte_tokens")


def codec_report(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = encode(plain, model_path, "n_tokens", "n_byte_tokens", "ids_crc32", "decoded")
    return both.select("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", (F.col("decoded") == F.col("text")).alias("round_trip"))
