"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by the longest prefixes of the model's compiled character map (a double-array trie; where the map
is empty, characters stay as they are), and every normalised byte keeps the place of the source byte it came from. The
normalised text is cut where no piece can reach across. Cuts met lately are looked up; the others of many texts are merged
together (best score first, leftmost on ties), by the library where it would not normalise them again, else here. The pieces tile the normalised text; their bounds are projected through the
alignment, so every piece has its span of source bytes.

The vocabulary is only read. ``model`` is a path that executors can open, or None for the public 32k piece model that is
installed with every worker.

Defined results: null texts are empty; an empty text has the end id alone. Every text is encoded whole, whatever its
length. Repeated rows get equal results. No shuffle; a worker's table of cuts is bounded by twice ``CUTS``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_small_batches

SPACE = "▁"
#: Cuts of a generation that are kept, the longest of them, and characters of texts that are encoded together.
CUTS, LONGEST_KEPT, TOGETHER = 125_000, 256, 1 << 20
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + n]
            i += n


class CharacterMap:
    """The compiled map: a trie's size, its units, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :] if n else b""
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that ``data`` has at ``at``."""
        if not self.units:
            return None
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    charsmap: CharacterMap
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    @classmethod
    def read(cls, data: bytes) -> Model:
        pieces, spec = [], {}
        for k, v in fields(data):
            if k == 1:
                x = dict(fields(v))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif k == 3:
                spec = dict(fields(v))
        return cls(pieces, CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes, then of its end."""
        if not text:
            return "", np.zeros(1, np.int32)
        data = text.encode()
        head = SPACE if self.dummy_prefix and self.escape else " " if self.dummy_prefix else ""
        if not self.charsmap.units and not self.trim:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, 3, 1) if self.escape else np.ones(len(raw), np.int64)
            align = np.empty(len(head.encode()) + int(width.sum()) + 1, np.int32)
            align[: len(head.encode())] = 0
            align[len(head.encode()) : -1] = np.repeat(np.arange(len(raw), dtype=np.int32), width)
            align[-1] = len(raw)
            return head + (text.replace(" ", SPACE) if self.escape else text), align
        out, align, at, spaced = [], [], 0, self.trim
        started = False
        space = SPACE.encode() if self.escape else b" "
        while at < len(data):
            hit = self.charsmap.longest(data, at)
            if hit is None:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                hit = data[at : at + n], n
            new, n = hit
            if spaced:
                new = new.lstrip(b" ")
            if new:
                if not started and head:
                    out.append(head.encode())
                    align += [at] * len(head.encode())
                started = True
                shown = new.replace(b" ", space)
                out.append(shown)
                align += [at] * len(shown)
                spaced = self.trim and new.endswith(b" ")
            at += n
        whole = b"".join(out)
        if self.trim:
            while whole.endswith(space):
                whole = whole[: -len(space)]
        return whole.decode(), np.array([*align[: len(whole)], align[len(whole)] if len(whole) < len(align) else len(data)], np.int32)


class Encoder:
    """Encodes texts; the ids of cuts are kept in two generations, so that cuts met once go and common ones stay."""

    def __init__(self, model: Model, library: sentencepiece.SentencePieceProcessor | None = None):
        if not any(t == BYTE for _, _, t in model.pieces) or any(t in (USER_DEFINED, UNUSED) for _, _, t in model.pieces):
            raise ValueError("only models with byte pieces, and without user-defined or unused ones, are supported")
        self.model = model
        self.id = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
        order = {s: k for k, s in enumerate(sorted({s for _, s, _ in model.pieces}, reverse=True))}
        self.rank = {p: order[s] for p, s, t in model.pieces if t == NORMAL}  # least first
        self.never = len(order)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.end = next(i for i, (p, _, t) in enumerate(model.pieces) if t == CONTROL and p == "</s>")
        self.width = np.array([1 if t == BYTE else len(p.encode()) if t == NORMAL else 0 for p, _, t in model.pieces], np.int32)
        inner = {c for p in self.id if len(p) > 1 for c in p}
        reach = any(SPACE in p.lstrip(SPACE) for p in self.id)
        line = "" if "\n" in inner else "\n"
        # A cut: spaces and what follows them; a line end stands alone if no piece joins it to anything.
        self.cut = re.compile(r"(?s).+" if reach else f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + ("|\n" if line else ""))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # The library puts a space before a text; it leaves all else as it is if the model has no map and doesn't trim.
        self.library = library if model.dummy_prefix and model.escape and not model.trim and not model.charsmap.units else None

    def merge(self, cut: str) -> list[str]:
        """Best pair first, leftmost on ties, until none is a piece."""
        if len(cut) > 64:
            return self.merge_long(cut)
        s, rank, never = list(cut), self.rank.get, self.never
        r = [rank(a + b, never) for a, b in zip(s, s[1:], strict=False)]
        while r and (best := min(r)) < never:
            i = r.index(best)
            s[i] += s.pop(i + 1)
            del r[i]
            if i:
                r[i - 1] = rank(s[i - 1] + s[i], never)
            if i < len(r):
                r[i] = rank(s[i] + s[i + 1], never)
        return s

    def merge_long(self, cut: str) -> list[str]:
        """The same with a heap, for cuts of any length."""
        left, right = list(range(-1, len(cut) - 1)), [*range(1, len(cut)), -1]
        s: list[str | None] = list(cut)
        heap: list = []

        def offer(a, b):
            if a >= 0 and b >= 0 and (hit := self.rank.get(s[a] + s[b])) is not None:
                heapq.heappush(heap, (hit, a, b, s[a], s[b]))

        for i in range(len(cut) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if s[a] != x or s[b] != y or right[a] != b:
                continue
            s[a], s[b] = x + y, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in s if x is not None]

    def ids_of(self, cut: str) -> list[int]:
        """By merging here."""
        ids = []
        for s in self.merge(cut):
            k = self.id.get(s)
            ids += [k] if k is not None else [self.byte[b] for b in s.encode()]
        return ids

    def learn(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids, 32 bits each, of cuts that aren't among the newer ones; those of usual length are kept."""
        out = {c: v for c in cuts if (v := self.old.get(c)) is not None}
        left = [c for c in cuts if c not in out]
        plain = [c for c in left if len(c) > 1 and c[0] == SPACE] if self.library else []
        if plain:
            for c, ids in zip(plain, self.library.encode([c[1:].replace(SPACE, " ") for c in plain], num_threads=1), strict=True):
                out[c] = array("i", ids).tobytes()
        for c in left:
            if c not in out:
                out[c] = array("i", self.ids_of(c)).tobytes()
        self.new.update((c, v) for c, v in out.items() if len(c) <= LONGEST_KEPT)
        return out

    def encode_many(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids, starts and ends in source bytes; the last is the end id, with an empty span."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(self.new) > CUTS:
            self.old, self.new = self.new, {}
        found = []
        for text in texts:
            norm, align = self.model.normalise(text)
            cuts = self.cut.findall(norm)
            found.append((align, cuts, list(map(self.new.get, cuts))))
        unknown = dict.fromkeys(c for _, cuts, got in found if None in got for c, v in zip(cuts, got, strict=True) if v is None)
        learnt = self.learn(list(unknown)) if unknown else {}
        end_id = array("i", [self.end]).tobytes()
        for align, cuts, got in found:
            if None in got:
                got = [learnt[c] if v is None else v for v, c in zip(got, cuts, strict=True)]
            ids = np.frombuffer(b"".join(got) + end_id, np.int32)
            # The pieces tile the normalised text.
            width = self.width[ids]
            end = np.cumsum(width)
            yield ids, align[end - width], align[end]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return next(self._encoded([text]))


_KEPT: dict[str, tuple] = {}


def tools(model: str | None):
    """(encoder, decoder), made once in each Python worker."""
    if (path := model or public_model()) not in _KEPT:
        with open(path, "rb") as f:
            data = f.read()
        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        _KEPT[path] = Encoder(Model.read(data), library), library
    return _KEPT[path]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends (source bytes of each piece) and decoded, for every document."""

    @F.arrow_udf("ids array<int>, starts array<int>, ends array<int>, decoded string")
    def run(batch: pa.Array) -> pa.Array:
        encoder, decoder = tools(model)
        got = list(encoder.encode_many(t.as_py() or "" for t in batch))
        lists = [pa.array([x[i] for x in got], pa.list_(pa.int32())) for i in range(3)]
        return pa.StructArray.from_arrays([*lists, pa.array([decoder.decode(x[0].tolist()) for x in got], pa.string())], ["ids", "starts", "ends", "decoded"])

    out = by_small_batches(docs).select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("x"))
    return out.select("doc_id", "x.*")


def piece_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_source_bytes (that the pieces' spans cover), ends, and ids if asked for.

    ``ends``: where each piece's span of source bytes ends; it begins where the one before ends, the first at 0.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "ends"] + ["ids"] * with_ids

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_source_bytes bigint, ends array<int>" + ", ids array<int>" * with_ids)
    def run(batch: pa.Array) -> pa.Array:
        encoder, decoder = tools(model)
        decimals = [str(i) for i in range(len(encoder.model.pieces))]
        rows = []
        for array_, starts, ends in encoder.encode_many(t.as_py() or "" for t in batch):
            ids = array_.tolist()
            digest = hashlib.sha256(" ".join(map(decimals.__getitem__, ids)).encode()).hexdigest()
            rows.append((len(ids), digest, hashlib.sha256(decoder.decode(ids).encode()).hexdigest(), int((ends - starts).sum()), ends, array_))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k, _ in zip(columns, kinds, names, strict=False)], names)

    out = by_small_batches(docs).select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("x"))
    return out.select("doc_id", "x.*")
