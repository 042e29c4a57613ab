"""SentencePiece encoding and decoding (1) with offsets.

A text is normalised by the longest matching prefixes of the model's compiled character map, and for each
normalised byte the original byte it comes from is recorded; the ids are the sentencepiece library's, and
each piece, by its length in normalised bytes, is projected through that alignment to a span of
original bytes. Where no piece of the vocabulary goes on from another character to a space, a text falls
into words that are normalised, encoded and aligned apart, each different one once per worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, remembered, table
from .tokens import in_parts

MEMORY = 400_000
SPACE = "▁".encode()


class CharacterMap:
    """A compiled map: a double-array trie of prefixes, and the strings that replace them, ended by NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found


class Normaliser:
    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.strip, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def align(self, data: bytes) -> tuple[bytes, list[int]]:
        """Normalised bytes and, for each and one more for the end, the original byte it comes from."""
        steps, at = [], 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                n, new = hit
            else:
                first = data[at]
                n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + n]
            steps.append((at, new))
            at += n
        ends = len(data)
        if self.strip:
            while steps and steps[0][1] in (b" ", b""):
                steps.pop(0)
            if not steps:
                return b"", [ends]
        mark = SPACE if self.escape else b" "
        out, origin, after_space = bytearray(), [], self.strip
        if self.prefix and steps:
            out += mark
            origin += [steps[0][0]] * len(mark)
        for at, new in steps:
            if self.strip and after_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            for byte in new:
                part = mark if byte == 32 else bytes([byte])
                out += part
                origin += [at] * len(part)
            after_space = self.strip and new.endswith(b" ")
        if self.strip:
            while out.endswith(mark):
                ends = origin[-1]
                del out[-len(mark) :], origin[-len(mark) :]
        return bytes(out), [*origin, ends]


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        self.normaliser = Normaliser(model.normalizer_spec)
        byte = 6
        self.sizes = np.array([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces], np.int64)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        #: Words can be encoded apart: nothing is stripped, the map is empty, unknown characters become
        #: bytes, and no piece has a space after another character.
        self.apart = (
            not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
            and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix and trainer.model_type == 2
            and not any(re.search("[^▁]▁", p.piece) or p.type == 4 for p in model.pieces)
        )
        self.lengths, self.mark = self.sizes.tolist(), self.library.piece_to_id("▁")
        self.plain = 1 + max((k for k, p in enumerate(model.pieces) if p.type == byte), default=-1)  # byte pieces come first
        self.words: dict[str, tuple] = {}

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and the pieces' bounds: piece k covers original bytes bounds[k] to bounds[k + 1]."""
        ids = self.library.encode(text, num_threads=1)
        data, origin = self.normaliser.align(text.encode())
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])]) if ids else np.zeros(1, np.int64)
        if ends[-1] != len(data):  # an unknown character is one piece of its own length
            ends = self._surfaces(text, ids, data)
        return ids, np.asarray(origin, np.int64)[ends] if ids else np.zeros(1, np.int64)

    def _surfaces(self, text: str, ids: list[int], data: bytes) -> np.ndarray:
        ends, at = [0], 0
        for piece in self.library.encode(text, out_type=str, num_threads=1):
            raw = piece.encode()
            at += len(raw) if data.startswith(raw, at) else 1
            ends.append(at)
        return np.array(ends)

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], bytes, np.ndarray]]:
        """Of each text: ids, the ids in decimals joined by commas, and the pieces' bounds."""
        if not self.apart or any("▁" in t for t in texts):
            # The sign that stands for a space may join those beside it, so a text that holds it is encoded whole.
            apart = iter(self.encode_all([t for t in texts if "▁" not in t]) if self.apart else ())
            return [next(apart) if self.apart and "▁" not in t else self._whole(t) for t in texts]
        # A word keeps its spaces before it; a text starts as if after a space, which has no original byte.
        rows = [([] if not t else t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else [w[1:] for w in re.findall(" +[^ ]*", f" {t}")]) for t in texts]
        if len(self.words) > MEMORY:
            self.words.clear()
        known = self.words
        passing, missing = {}, list(set().union(*rows).difference(known))
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            for word, ids in zip(some, self.library.encode(some, num_threads=1)):
                (passing if "\n" in word or len(word) > 40 else known)[word] = self._word(word, ids)
        out = []
        for row in rows:
            if not row:
                out.append(([], b"", np.zeros(1, np.int64)))
                continue
            own = [known[w] if w in known else passing[w] for w in row] if passing else map(known.__getitem__, row)
            ids, decimals, ends, counts, sizes = zip(*own)
            sizes = np.array(sizes, np.int64)
            # A word's bytes count from the space before it; the first word has none.
            bounds = np.frombuffer(b"".join(ends), "<i4") + np.repeat(np.cumsum(sizes) - sizes - 1, counts)
            out.append((np.frombuffer(b"".join(ids), "<i4").tolist(), b",".join(decimals), np.concatenate([[0], np.maximum(bounds, 0)])))
        return out

    def _whole(self, text: str) -> tuple[list[int], bytes, np.ndarray]:
        ids, spans = self.encode(text)
        return ids, ",".join(map(str, ids)).encode(), spans

    def _word(self, word: str, ids: list[int]) -> tuple[bytes, bytes, bytes, int, int]:
        """Of a word after one more space: ids, their decimals, where pieces end from that space on, their number, bytes."""
        raw = word.encode()
        ids = ids or [self.mark]  # the space alone
        ends = list(accumulate(map(self.lengths.__getitem__, ids)))
        if " " in word or min(ids) < self.plain:  # not a byte for a byte, or characters in several pieces
            data, origin = self.normaliser.align(raw) if raw else (SPACE, [0, 0, 0, 0])
            whole, ends = len(data), [(o + 1 if b > 3 else 1) if b >= 3 else 0 for b in ends for o in [origin[min(b, len(data))]]]
        else:
            whole, ends = len(raw) + 3, [b - 2 for b in ends]
        if sum(map(self.lengths.__getitem__, ids)) != whole:
            raise ValueError(f"pieces do not cover the normalised word {word!r}")
        return np.array(ids, "<i4").tobytes(), ",".join(map(str, ids)).encode(), np.array(ends, "<i4").tobytes(), len(ids), len(raw) + 1

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(path: str) -> Codec:
    """One for each worker process."""
    return remembered(path, lambda: Codec(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, and bounds: piece k is made of bytes bounds[k] to bounds[k + 1] of the UTF-8 text.

    A null or empty text has no ids and the bounds [0]. Repeated rows are each encoded; an empty table
    gives an empty result; other columns are not read.
    """

    def run(batches):
        tool = codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_parts(texts):
                rows = tool.encode_all(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids", "bounds"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, bounds array<long>")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text, and return digests of ids, decoded text and spans."""

    def run(batches):
        tool = codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_parts(texts):
                rows = tool.encode_all(texts[a:b])
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(r[0]) for r in rows], "int64"), pa.array([sha(r[1]) for r in rows]),
                        pa.array([sha(tool.decode(r[0]).encode()) for r in rows]), pa.array([int(r[2][-1]) for r in rows], "int64"), pa.array([sha(r[2].astype("<i8").tobytes()) for r in rows]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "bytes_covered", "spans_sha256"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_covered long, spans_sha256 string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
