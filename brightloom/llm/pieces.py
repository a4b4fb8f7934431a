"""SentencePiece encoding and decoding with byte offsets into the original text.

Normalisation walks the model's compiled character map (a double-array trie
over UTF-8 with replacement strings): at each place the longest prefix in the
trie is replaced, anything else is copied one character at a time, and every
output byte remembers the input byte span it came from. White space becomes
the meta symbol, a dummy prefix may come first. Byte-pair merging then runs on
chunks that no piece crosses, best score first and leftmost among equals, with
byte fallback. Each piece's normalised bytes are projected to the span of
original bytes they came from.

Chunks repeat, so their pieces are kept per worker in a table that forgets all
beyond a bound. Memory is bounded by that table and the text in hand.

Defined results: a null or empty text has no pieces and decodes to the empty
text. Repeated rows, null ids and other columns pass as they come.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, batched

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brightloom.llm.common import require

META = "▁"
_META = META.encode()


class CharMap:
    """A compiled character map: ``longest(data, at)`` gives replacement and length of the longest prefix, or None."""

    def __init__(self, blob: bytes):
        self.units, self.strings = array("I"), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = array("I", blob[4 : 4 + n])
            self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        units = self.units
        if not units:
            return None
        # A unit holds a label in its low byte, a leaf flag in bit 8 and an offset above, scaled if bit 9 is set.
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, best = step(units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = self.strings[start : self.strings.index(b"\0", start)], i + 1 - at
        return best


class Pieces:
    """A BPE model with its normaliser, for encoding with offsets and decoding."""

    def __init__(self, model: bytes, limit: int = 600_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        if any(p.type in (pb.ModelProto.SentencePiece.USER_DEFINED, pb.ModelProto.SentencePiece.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        kinds, spec = pb.ModelProto.SentencePiece, proto.normalizer_spec
        self.names = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface = proto.trainer_spec.unk_surface.encode()
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        # Chunks end before a meta symbol only if no piece has one after another character.
        free = not any(META in n.lstrip(META) for n in self.ids) and self.escape and not proto.trainer_spec.treat_whitespace_as_suffix
        self.chunk = re.compile(f"{META}*[^{META}]+|{META}+" if free else r"(?s).+")
        self.limit, self.known = limit, {}
        self.decoded = [self.join([i]) for i in range(len(self.names))]
        self.size = [1 if i in self.byte_of else len(n.encode()) for i, n in enumerate(self.names)]
        self.starts = bytes(n.startswith(META) for n in self.names)
        # The library merges chunks many at a time where it wouldn't normalise them any further.
        self.lib = None
        if free and not self.map.units and not self.squeeze and self.dummy and self.bytes:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)

    # Normalisation

    def normalise(self, text: str) -> tuple[str, array]:
        """The normalised text and, for each of its bytes and its end, the original byte it comes from."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", array("l", [0])
        if not self.map.units and not self.squeeze and self.escape and self.dummy:
            return self._plain(text, raw)
        space = _META if self.escape else b" "
        parts: list[tuple[bytes, int]] = []  # replacement, where it starts in raw
        at, ends = 0, []
        while at < len(raw):
            lead = raw[at]
            found = self.map.longest(raw, at)
            size = found[1] if found else 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            parts.append((found[0] if found else raw[at : at + size], at))
            at += size
            ends.append(at)
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0), ends.pop(0)
            if not parts:
                return "", array("l", [len(raw)])
        out, origin, was_space = bytearray(), array("l"), self.squeeze
        if self.dummy:
            out += space
            origin.extend([parts[0][1]] * len(space))
        for piece, start in parts:
            if self.squeeze and was_space:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            was_space = piece.endswith(b" ")
            piece = piece.replace(b" ", space)
            out += piece
            origin.extend([start] * len(piece))
        last = ends[-1]
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                last = origin[len(out)]
                del origin[len(out) :]
        origin.append(last)
        return out.decode("utf-8", "replace"), origin

    def _plain(self, text: str, raw: bytes) -> tuple[str, array]:
        """Without a map only spaces change, each from one byte to three."""
        import numpy as np

        units = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((units & 0xC0) != 0x80)
        lead = units[starts]
        size = np.diff(np.append(starts, len(raw)))
        size[lead == 32] = len(_META)
        origin = array("l")
        origin.frombytes(np.concatenate([np.zeros(len(_META), np.int64), np.repeat(starts, size), [len(raw)]]).astype(np.int64).tobytes())
        return META + text.replace(" ", META), origin

    # Encoding

    def _merge(self, chunk: str) -> list[str]:
        """Byte-pair merges: the pair with the best score first, the leftmost among equals."""
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                pair = symbols[a] + symbols[b]
                score = self.scores.get(pair)
                if score is not None:
                    heapq.heappush(heap, (-score, a, b, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != pair or after[a] != b:
                continue
            symbols[a], symbols[b] = pair, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def _of(self, ids: list[int], sizes: list[int]) -> tuple[bytes, bytes, int, bytes]:
        return "".join([f",{i}" for i in ids]).encode(), array("i", sizes).tobytes(), len(ids), b"".join([self.decoded[i] for i in ids])

    def chunk_pieces(self, chunk: str) -> tuple[bytes, bytes, int, bytes]:
        """Of a chunk: ids as decimals each after a comma, byte sizes of its pieces, their number, decoded bytes."""
        ids, sizes = [], []
        for piece in self._merge(chunk):
            i, raw = self.ids.get(piece), piece.encode("utf-8", "surrogatepass")
            if i is not None:
                ids.append(i)
                sizes.append(len(raw))
            elif self.bytes:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return self._of(ids, sizes)

    def learn(self, chunks: Iterable[str]) -> None:
        """Pieces of new chunks: in one call of the library where each chunk has one meta symbol and that first."""
        plain = []
        for c in chunks:
            if self.lib is not None and c[0] == META and len(c) > 1 and c[1] != META:
                plain.append(c)
            else:
                self.known[c] = self.chunk_pieces(c)
        for some in batched(plain, 2048):
            ids = self.lib.encode("".join(some)[1:].replace(META, " "))
            at = [k for k, i in enumerate(ids) if self.starts[i]]
            if len(at) == len(some) and at[0] == 0:
                for c, a, b in zip(some, at, [*at[1:], len(ids)], strict=True):
                    part = ids[a:b]
                    self.known[c] = self._of(part, [self.size[i] for i in part])
            else:
                self.known.update((c, self.chunk_pieces(c)) for c in some)

    def found(self, normal: list[str]) -> Iterator[list[tuple[bytes, bytes, int, bytes]]]:
        """For each normalised text, what ``chunk_pieces`` gives for its chunks."""
        if len(self.known) > self.limit:
            self.known.clear()
        chunks = [self.chunk.findall(n) for n in normal]
        self.learn(set().union(*chunks).difference(self.known))
        for c in chunks:
            yield list(map(self.known.__getitem__, c))

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """Pieces as (id, first byte, end byte) in the original UTF-8 text; of a character in bytes, the last piece has its span."""
        normal, origin = self.normalise(text)
        found = next(self.found([normal]))
        ids = [int(i) for f in found for i in f[0].split(b",")[1:]]
        ends = list(accumulate(memoryview(b"".join(f[1] for f in found)).cast("i"), initial=0))
        return [(i, origin[a], origin[b]) for i, a, b in zip(ids, ends, ends[1:], strict=False)]

    # Decoding

    def join(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for, meta symbols as spaces, before the dummy prefix goes."""
        out = []
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i == self.unknown:
                out.append(self.surface)
            elif i not in self.control:
                out.append(self.names[i].replace(META, " ").encode())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; of the spaces that start it, the dummy prefix's goes."""
        first = next((i for i in ids if i not in self.control), None)
        out = self.join(ids)
        if first is not None and self.names[first].startswith(META) and (self.dummy or self.squeeze):
            out = out.lstrip(b" ") if self.squeeze else out[1:]
        return out.decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One model for each worker process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Pieces(f.read())
    return _LOADED[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, ids, starts and ends (original byte spans) and the decoded text."""
    require(docs, "doc_id", "text")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        pieces = load(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [pieces.encode(t.as_py() or "") for t in part["text"]]
                ids = [[p[0] for p in r] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array([[p[1] for p in r] for r in rows], pa.list_(pa.int64())),
                     pa.array([[p[2] for p in r] for r in rows], pa.list_(pa.int64())), pa.array([pieces.decode(i) for i in ids], pa.string())],
                    ["doc_id", "ids", "starts", "ends", "decoded"],
                )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for field in T._parse_datatype_string("ids array<int>, starts array<bigint>, ends array<bigint>, decoded string"):
        schema = schema.add(field)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """Encoding and decoding as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_crc32.

    The same encoder as ``encode_documents``, without Python lists of all ids:
    chunks give their ids, sizes and decoded bytes ready to be joined. spans_crc32
    is over the pieces' original byte spans (pairs of little-endian 64-bit ints).
    """
    require(docs, "doc_id", "text")

    def run(batches: Iterable) -> Iterator:
        import zlib
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        pieces = load(model)
        for batch in batches:
            n, ids_sha, text_sha, size, spans = [], [], [], [], []
            for values in batched(batch["text"], 256):
                texts = [v.as_py() or "" for v in values]
                normals = [pieces.normalise(t) for t in texts]
                for text, (_, origin), found in zip(texts, normals, pieces.found([x for x, _ in normals]), strict=True):
                    ids, sizes, counts, surfaces = zip(*found, strict=True) if found else ((), (), (), ())
                    decoded = b"".join(surfaces)
                    if decoded.startswith(b" ") and (pieces.dummy or pieces.squeeze):
                        decoded = decoded.lstrip(b" ") if pieces.squeeze else decoded[1:]
                    n.append(sum(counts))
                    ids_sha.append(sha256(b"".join(ids)[1:]).hexdigest())
                    text_sha.append(sha256(decoded).hexdigest())
                    size.append(len(text.encode("utf-8", "surrogatepass")))
                    where = np.frombuffer(origin, np.int64)
                    cuts = np.zeros(n[-1] + 1, np.int64)
                    np.cumsum(np.frombuffer(b"".join(sizes), np.int32), out=cuts[1:])
                    spans.append(zlib.crc32(np.stack([where[cuts[:-1]], where[cuts[1:]]], 1).tobytes()) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(size, pa.int64()), pa.array(spans, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_crc32"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for field in T._parse_datatype_string("n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, spans_crc32 bigint"):
        schema = schema.add(field)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
