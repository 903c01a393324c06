"""SentencePiece encoding and decoding with work shared between words that begin alike.

Every task marks the words of its batch of texts, sorts the distinct ones, which lays them out in
the order of a trie traversed depth-first, and runs the forward recursion along that order: the
states of the characters that a word has in common with the one before it are kept, only the rest
are computed. Distinct words and their ids stay in a bounded table for later batches of the task.

Two recursions fit. For unigram models the state of a prefix is the best score of its
segmentations, which is Viterbi decoding. The merges of byte-pair models don't maximise a score, so
the best sum is not what the model encodes to. Their state is the last piece of the prefix's
encoding: it is the one piece that ends there and may follow the last piece of the prefix before it,
two pieces being allowed to follow each other if merging their joined text gives them back. That
gives exactly the merged result, from forward states as in Viterbi.

Null texts encode to null, empty texts to no ids. Characters outside the vocabulary become bytes, so
decoding gives the text back, except that U+2581, the mark itself, decodes to a space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from netledger.llm.common import spread, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"

#: Distinct words that a task remembers between batches, and pairs of pieces; bounds of memory only.
REMEMBERED, PAIRS, SLICE = 500_000, 500_000, 1_000


class Codec:
    """Ids of marked words and back, for one SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        normal = proto.normalizer_spec
        if normal.name != "identity" or normal.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models that keep texts as they are and fall back to bytes are supported")
        self.prefix = MARK if normal.add_dummy_prefix else ""
        self.bpe = proto.trainer_spec.model_type == 2
        self.score, self.ids, self.byte, self.text = {}, {}, [0] * 256, []
        for i, piece in enumerate(proto.pieces):
            if piece.type == 6:
                self.byte[int(piece.piece[3:5], 16)] = i
                self.text.append(bytes([int(piece.piece[3:5], 16)]))
            else:
                self.text.append(piece.piece.replace(MARK, " ").encode() if piece.type in (1, 4) else b"")
                if piece.type in (1, 4):
                    self.score[piece.piece], self.ids[piece.piece] = piece.score, i
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that reach over a word boundary are not supported")
        self.longest = max(map(len, self.ids))
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        if self.bpe:  # a piece that no merges lead to never appears
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        # words end where nothing in the vocabulary reaches over: before a mark that follows another
        # character, and around characters that no longer piece holds
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(map(re.escape, sorted(inner - {MARK})))
        self.words = re.compile(f"{MARK}*[{alone}]+|{MARK}+|.", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text by its definition: best merge first, leftmost on ties."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives them back."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words, reusing the states of common prefixes.

        ``last[n]`` is the last piece of the best encoding of the first n characters.
        """
        last: list[str] = [""]
        score = [0.0]
        before = ""
        ids, longest, pairs = self.ids, self.longest, self.pairs
        for word in words:
            n = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], score[n + 1 :]
            if self.bpe:
                for end in range(n + 1, len(word) + 1):
                    start = end - 1
                    piece = word[start]
                    # one piece fits; words are short, so the shorter pieces are tried first
                    while start:
                        fits = pairs.get((last[start], piece))
                        if fits is None:
                            fits = self.follows(last[start], piece)
                        if fits:
                            break
                        start -= 1
                        while start and word[start:end] not in ids:
                            start -= 1
                        piece = word[start:end]
                    last.append(piece)
            else:
                for end in range(n + 1, len(word) + 1):
                    best, piece = self.worst * (end + 1), ""
                    for start in range(max(0, end - longest), end):
                        candidate = word[start:end]
                        s = self.score.get(candidate)
                        if s is None and start == end - 1:
                            s = self.worst
                        if s is not None and score[start] + s > best:
                            best, piece = score[start] + s, candidate
                    last.append(piece)
                    score.append(best)
            before = word
            found, at = [], len(word)
            while at:
                piece = last[at]
                i = ids.get(piece)
                found.extend([i] if i is not None else [self.byte[b] for b in reversed(piece.encode())])
                at -= len(piece)
            found.reverse()
            yield found

    def marked(self, text: str) -> list[str]:
        return self.words.findall((self.prefix + text).replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.text[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int); with ``check`` also ``restored``, whether decoding the
    ids gives the text back. The model file is read once on the driver and sent with the tasks."""
    with open(model, "rb") as f:
        proto = f.read()
    others = [c for c in docs.columns if c not in ("ids", "restored")]
    docs = docs.select(*others)
    at = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = Codec(proto), {}
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = batch.column(at).to_pylist()
                split = [codec.marked(t) if t else [] for t in texts]
                fresh = sorted({w for ws in split for w in ws}.difference(known))
                if len(known) + len(fresh) > REMEMBERED:
                    known = {}
                    fresh = sorted({w for ws in split for w in ws})
                known.update((w, array("i", ids).tobytes()) for w, ids in zip(fresh, codec.encode_sorted(fresh)))
                packed = [b"".join([known[w] for w in ws]) for ws in split]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                missing = batch.column(at).is_null()
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)), mask=missing
                )
                columns = [*batch.columns, ids]
                if check:
                    back = [codec.decode(memoryview(i).cast("i").tolist()) for i in packed]
                    columns.append(pa.array([None if t is None else d == t.replace(MARK, " ") for t, d in zip(texts, back)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "ids", *["restored"] * check])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("restored", T.BooleanType())] * check]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids decode to null."""
    with open(model, "rb") as f:
        proto = f.read()
    encoded = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    names = encoded.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(proto)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")
