"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf: pieces with scores and kinds, the trainer's model kind and the normaliser's settings. From these
come a normaliser (precompiled character map if there is one, white-space clean-up, marker for spaces), a unigram model with scores, or a BPE
model whose merges follow from the pieces' ranks, with byte fallback, and the matching decoder. Texts are cut before a marker that follows
another letter, where no piece of the vocabulary reaches over; equal pieces are encoded once. Batches go to the library as a whole, which
spreads them over threads where the task has more than one core.

Null text: no ids. Empty text: no ids. Decoding gives the normalised text back. Repeated rows are encoded alike; other columns are ignored.
"""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.chunks import IdTable, table_of

MARK = "▁"
# fixed values: numbers of the public sentencepiece_model.proto
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNKNOWN, CONTROL, BYTE = 2, 3, 6
UNIGRAM, BPE = 1, 2
CUT = re.compile(" *[^ ]+| +")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and raw value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def read_model(path: str) -> dict:
    """Pieces (text, score, kind) in order of ids, model kind, and the normaliser's settings."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, trainer, rules = [], {}, {}
    for number, value in fields(data):
        if number == PIECES:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            rules = dict(fields(value))
    return {"pieces": pieces, "kind": trainer.get(3, UNIGRAM), "byte_fallback": bool(trainer.get(35, 0)), "map": rules.get(2, b""), "prefix": bool(rules.get(3, 1)), "trim": bool(rules.get(4, 1)), "mark": bool(rules.get(5, 1))}


def build(model: dict):
    """The tokenizers object for a model read by `read_model`. It expects normalised text (see `prepare`)."""
    from tokenizers import Tokenizer, decoders, models

    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    if model["kind"] == UNIGRAM:
        made = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unknown, model["byte_fallback"]))
    elif model["kind"] == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(pieces)}
        ranks = {p: s for p, s, kind in pieces if kind not in (UNKNOWN, CONTROL, BYTE)}
        merges = []
        for whole, score in ranks.items():
            for k in range(1, len(whole)):
                if whole[:k] in ranks and whole[k:] in ranks:
                    merges.append((-score, vocabulary[whole[:k]], vocabulary[whole[k:]], whole[:k], whole[k:]))
        made = Tokenizer(models.BPE(vocabulary, [m[3:] for m in sorted(merges)], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"]))
    else:
        raise ValueError(f"model kind {model['kind']} is neither unigram nor BPE")
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])])
    return made


def preparer(model: dict):
    """Normalise a text and cut it into pieces that can be encoded one by one."""
    from tokenizers import normalizers

    table = normalizers.Precompiled(model["map"]) if model["map"] else None
    # a piece such as "a_" would reach over a cut; then the text stays whole
    whole = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model["pieces"] if kind not in (UNKNOWN, CONTROL, BYTE)) or not model["mark"]

    def prepare(text: str) -> list[str]:
        if table:
            text = table.normalize_str(text)
        if model["trim"]:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        text = text.replace(MARK, " ")
        if model["prefix"]:
            text = " " + text
        return [p.replace(" ", MARK) for p in ([text] if whole else CUT.findall(text))]

    return prepare


class Codec:
    """Encode texts to ids and back."""

    def __init__(self, path: str):
        model = read_model(path)
        self.made, self.prepare = build(model), preparer(model)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in model["pieces"]]
        self.prefix = model["prefix"]
        self.control = {i for i, p in enumerate(model["pieces"]) if p[2] == CONTROL}
        self.known = IdTable(lambda pieces: [e.ids for at in range(0, len(pieces), 5000) for e in self.made.encode_batch_fast(pieces[at : at + 5000], add_special_tokens=False)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.known.ids([self.prepare(t or "") for t in texts])]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """By the library's decoder."""
        return self.made.decode_batch([[i for i in x if i not in self.control] for x in ids], skip_special_tokens=False)

    def joined(self, ids: list[int]) -> bytes:
        """The bytes of the pieces, without the marker put before a text: what decoding gives where ids come from a text."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:] if self.prefix and data[:1] == b" " else data


    def plain(self, text: str) -> bytes:
        """The normalised text, as decoding should give it back."""
        data = "".join(self.prepare(text)).replace(MARK, " ").encode()
        return data[1:] if self.prefix and data else data


def codec_of(path: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if (int(os.environ.get("OMP_NUM_THREADS") or 1)) > 1 else "false"
    return table_of(("pieces", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (null for null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else x.astype(np.int32) for t, x in zip(texts, codec.encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(column).cast("string")).mapInArrow(run, f"{key} bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, text (null for null ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = [None if i is None else t for i, t in zip(ids, codec.decode([i or [] for i in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, same (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = codec.encode(texts)
            same = [codec.joined(x.tolist()) == codec.plain(t) for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "same"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, same boolean")
