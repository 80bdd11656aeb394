"""Operator 7: offset-preserving piece encoding, and decoding."""

from __future__ import annotations

import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.bpe import Cache, merge
from crease.llm.common import held, map_batches, read_table, texts_of

#: Fixed value: the mark that stands for a space.
SPACE = "▁"
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class CharMap:
    """The compiled character map of a model: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of raw[at:] in the map."""
        units = self.units
        if not units:
            return None
        found, node = None, 0
        node ^= self._offset(units[0])
        for n in range(at, len(raw)):
            node ^= raw[n]
            if node >= len(units) or units[node] & 0x800000FF != raw[n]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """A byte-pair piece model with byte fallback: encodes to (id, source bytes) records and decodes ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(Path(path).read_bytes())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.ids, self.ranks, self.byte_ids = {}, {}, [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type in (1, 4, 5):  # normal, user-defined, unused
                self.ids[p.piece] = i
                self.ranks[p.piece] = -p.score
            elif p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            text = p.piece.replace(SPACE, " ").encode()
            self.surface.append(
                bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else text
            )
        if any(p.type in (4, 5) for p in proto.pieces) or any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("user-defined or unused pieces and pieces across spaces are not handled")
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.plain = not self.map.units and self.dummy and self.escape and not self.squeeze
        self.words = Cache(lambda word: self.records(SPACE + word))

    def prefix(self, raw: bytes, at: int) -> tuple[int, str]:
        """Bytes taken at a place of the source and what they become: the map's longest prefix, else one character."""
        hit = self.map.longest(raw, at)
        if hit:
            return hit[0], hit[1].decode()
        lead = raw[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return width, raw[at : at + width].decode()

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters and its end, the byte of the source it starts at.

        Where white space is squeezed, it goes at the start and the end, and at the start of what follows a space.
        """
        raw, out, at, n = text.encode(), [], [], 0
        if self.squeeze:
            while n < len(raw) and (head := self.prefix(raw, n))[1] == " ":
                n += head[0]
        if n == len(raw):
            return "", [n]
        if self.dummy:
            out, at = [" "], [n]
        after_space = self.squeeze
        while n < len(raw):
            width, new = self.prefix(raw, n)
            new = new.lstrip(" ") if after_space else new
            out.extend(new)
            at.extend([n] * len(new))
            if new:
                after_space = self.squeeze and new[-1] == " "
            n += width
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            n = at.pop()
        return "".join(out).replace(" ", SPACE if self.escape else " "), [*at, n]

    def rank(self, left: str, right: str) -> float | None:
        return self.ranks.get(left + right)

    def pieces(self, word: str) -> list[tuple[int, int]]:
        """(id, characters of the normalised text) of each piece; a byte piece has 0 but for its character's last."""
        out = []
        for piece in merge(list(word), self.rank)[0]:
            if piece is None:
                continue
            if (i := self.ids.get(piece)) is not None:
                out.append((i, len(piece)))
            else:
                raw = piece.encode()
                out += [(self.byte_ids[b], 0) for b in raw[:-1]] + [(self.byte_ids[raw[-1]], 1)]
        return out

    def records(self, word: str) -> bytes:
        """Records of int32 (id, source bytes) for a word whose marks are spaces of the source."""
        flat, at = [], 0
        for i, n in self.pieces(word):
            flat += [i, len(word[at : at + n].replace(SPACE, " ").encode())]
            at += n
        return np.array(flat, "<i4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the end id, and the source byte at which each piece ends (it starts where the last one ended)."""
        if not text:
            return np.array([self.end], "<i4"), np.zeros(1, "<i4")
        if self.plain and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            flat = np.frombuffer(b"".join(map(self.words.__getitem__, text.split(" "))), "<i4").reshape(-1, 2)
            ends = np.cumsum(flat[:, 1]) - 1  # the first mark is no byte of the source
            return np.append(flat[:, 0], self.end).astype("<i4"), np.append(ends, ends[-1]).astype("<i4")
        normal, source = self.normalize(text)
        ids, ends, at = [], [], 0
        for word in RUN.findall(normal):
            for i, n in self.pieces(word):
                at += n
                ids.append(i)
                ends.append(source[at])
        return np.array([*ids, self.end], "<i4"), np.array([*ends, source[-1]], "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes as UTF-8, without the space that encoding put in front."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ids array<int> (with the end id), ends array<int>, decoded string.

    ends: the byte of the UTF-8 text where each piece ends; piece k covers ends[k - 1] (0 for the first) to ends[k],
    and the end id covers nothing. A byte piece but the last of its character covers nothing. The text is normalised
    by longest prefixes through the model's compiled character map, with the source byte of each character kept, then
    merged by score, leftmost first; a space never stands inside a piece, so words are merged one by one. A null text
    is empty (the end id alone, decoded ''). Keys may be null or repeat; other columns are left out.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, ends array<int>, decoded string"

    def start():
        m = held(("pieces", path), lambda: PieceModel(path))

        def each(batch: pa.RecordBatch):
            coded = [m.encode(x) for x in texts_of(batch, text)]
            offsets = pa.array(np.cumsum([0, *(len(i) for i, _ in coded)]), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c[k] for c in coded]), pa.int32()))
                for k in (0, 1)
            ]
            decoded = pa.array([m.decode(i.tolist()) for i, _ in coded], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), *lists, decoded], [key, "ids", "ends", "decoded"])

        return each

    return map_batches(docs.select(key, text), schema, start)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("ends").alias("ends_hash"),
    )
