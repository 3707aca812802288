"""SentencePiece encoding and decoding on the tokenizers library.

A model file is parsed as protobuf by hand and rebuilt: normaliser, metaspace marker,
unigram scores or the merges that BPE scores stand for, byte fallback, decoder. All ids
and texts come from the rebuilt tokenizer. What it encodes is verified against the
sentencepiece library: ``mismatches`` counts the words of a text (or the whole text, see
below) whose ids differ from that library's. It is 0 wherever parity holds; ids are not
mended.

If no piece has the marker after another sign and the normaliser changes nothing, a
text's ids are those of its marked words in a row. Then each distinct word is encoded
and verified once, many at a time by the library's threads, and kept; otherwise texts
are encoded and verified whole.

Cases: a null text is an empty one and has no ids; a marker character in a text is
taken as a space, as the model does, so that text doesn't come back unchanged; control
pieces (``<s>``) in a text are plain text; null and repeated ``doc_id`` are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordids import IdStore, as_string, in_a_row, offsets, put_back, slices

MARK = "▁"
#: Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept by a worker; words encoded in one string.
CACHE_WORDS, JOINED = 400_000, 64


def protobuf(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; of nested ones, their bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """What a model file says."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        with open(path, "rb") as f:
            for field, value in protobuf(f.read()):
                if field == 1:
                    p = dict(protobuf(value))
                    self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
                elif field == 2:
                    trainer = dict(protobuf(value))
                elif field == 3:
                    normal = dict(protobuf(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_id = trainer.get(40, 0)
        self.unk_surface = trainer[44].decode() if 44 in trainer else " \u2047 "
        self.charsmap = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.squeeze = bool(normal.get(4, 1))
        self.escape = bool(normal.get(5, 1))
        if trainer.get(24, 0) or not self.escape:
            raise NotImplementedError("markers at word ends, or none at all")

    def merges(self) -> list[tuple[str, str]]:
        """Each split of a piece into two pieces, in the order of the piece's score."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    found.append((-self.pieces[i][1], i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]))
        return [(a, b) for *_, a, b in sorted(found)]

    @property
    def words_part(self) -> bool:
        """Whether texts may be encoded word by word."""
        plain = not self.charsmap and not self.squeeze and self.dummy_prefix
        return plain and not any(MARK in p.lstrip(MARK) for p, *_ in self.pieces) and not any(k == USER_DEFINED for *_, k in self.pieces)


def rebuild(model: Model, normalise: bool = True):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, *_) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(vocab, model.merges(), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise NotImplementedError(f"models of kind {model.kind}")
    out = Tokenizer(core)
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    unknown = decoders.Replace(model.pieces[model.unk_id][0], model.unk_surface)  # of whole pieces: no other holds its name
    out.decoder = decoders.Sequence([unknown, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Codec:
    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = Model(path)
        self.truth = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_words = self.model.words_part
        self.tokenizer = rebuild(self.model, normalise=not self.by_words)
        self.begins = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.store = IdStore(CACHE_WORDS)

    def _own(self, texts: list[str]) -> list[list[int]]:
        if self.by_words:  # then the marks are set here
            texts = [MARK + t.replace(" ", MARK) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, lengths and whether the model's ids are others, of each word. A word may begin
        with spaces, besides the one before it; the empty word is that one alone."""
        plain = [i for i, w in enumerate(words) if w and w[:1] != b" "]
        alone = [i for i, w in enumerate(words) if not w or w[:1] == b" "]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        joined = [b" ".join(words[i] for i in g).decode("utf-8", "replace") for g in groups]
        order, lengths, ids, wrong = [], [], [], np.zeros(len(words), bool)
        for group, own, truth in zip(groups, self._own(joined), self.truth.encode(joined, num_threads=1), strict=True):
            own_ids = np.array(own, np.uint32)
            at = np.flatnonzero(self.begins[own_ids])  # each word has one mark, at its beginning
            if own != truth or len(at) != len(group):
                alone += group  # to be told apart word by word
            else:
                order += group
                lengths.append(np.diff(at, append=len(own)))
                ids.append(own_ids)
        texts = [words[i].decode("utf-8", "replace") for i in alone]
        for i, t, own in zip(alone, texts, self._own(texts), strict=True):
            wrong[i] = own != (self.truth.encode(t) if t else [self.truth.piece_to_id(MARK)])
            order.append(i)
            lengths.append(np.array([len(own)]))
            ids.append(np.array(own, np.uint32))
        return *put_back(np.array(order), np.concatenate(lengths), np.concatenate(ids)), wrong

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a binary column's texts in a row, and of each the number of ids and of
        mismatches; null: an empty text."""
        text = as_string(column)
        if not self.by_words:
            texts = [t.decode("utf-8", "replace") for t in text.cast(pa.binary()).to_pylist()]
            own, truth = self._own(texts), self.truth.encode(texts, num_threads=1)
            ids = np.concatenate([np.empty(0, np.uint32), *(np.array(o, np.uint32) for o in own)])
            return ids, np.array([len(o) for o in own], np.int64), np.array([a != b for a, b in zip(own, truth, strict=True)], np.int64)
        text = pc.replace_substring(text, MARK, " ")
        # Texts with empty words between their spaces are parted apart from the others.
        odd = pc.or_(pc.or_(pc.match_substring(text, "  "), pc.equal(text, "")), pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")))
        parted = pc.split_pattern(pc.if_else(odd, "", text), " ")
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        spaced = [[w[1:] for w in re.findall(rb" +[^ ]*", b" " + t)] if t else [] for t in text.filter(odd).cast(pa.binary()).to_pylist()]
        coded = pc.dictionary_encode(pa.concat_arrays([parted.flatten().cast(pa.binary()), pa.array([w for t in spaced for w in t], pa.binary())]))
        at = np.concatenate([offsets(parted), offsets(parted)[-1] + np.cumsum([len(t) for t in spaced], dtype=np.int64)]).astype(np.int32)
        source = np.arange(len(text))
        source[where] = len(text) + np.arange(len(where))
        parted = pa.ListArray.from_arrays(pa.array(at), coded.indices).take(pa.array(source))
        rows = self.store.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn)
        word, text_at = rows[parted.flatten().to_numpy()], offsets(parted)
        wrong = np.concatenate([[0], np.cumsum(self.store.marks[word])])
        return *in_a_row(self.store.lists(), word, text_at), np.diff(wrong[text_at]).astype(np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 2) -> Codec:
    return Codec(path, threads)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, ids and mismatches of each document."""

    def run(batches):
        own = codec(model, threads)
        for batch in batches:
            for lo, texts in slices(batch["text"]):
                ids, counts, wrong = own.encode(texts)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, len(texts)), _lists(ids, counts), pa.array(wrong)], ["doc_id", "ids", "mismatches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, ids array<int>, mismatches long")


def decode(encoded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """Adds the decoded text to ``encoded(doc_id, ids)``."""

    def run(batches):
        own = codec(model, threads)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = own.decode([ids or [] for ids in part["ids"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, whether the decoded text is the text, and
    mismatches, of each document: encoded and decoded in one pass, so ids stay in the worker."""

    def run(batches):
        own = codec(model, threads)
        for batch in batches:
            for lo, texts in slices(batch["text"], 1_000_000):
                ids, counts, wrong = own.encode(texts)
                parts = np.split(ids.astype("<u4", copy=False), np.cumsum(counts)[:-1])
                back = [t.encode() for t in own.decode([p.tolist() for p in parts])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(lo, len(texts)),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                        "round_trip": [b == (t or b"") for b, t in zip(back, texts.to_pylist(), strict=True)],
                        "mismatches": pa.array(wrong),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, mismatches long"
    )


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
