"""SentencePiece encoding and decoding with spans: normalisation by the model's character map keeps source alignment."""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: Chunks kept with their ids while a task runs (beyond that the store begins anew), and the longest kept (characters).
CACHE_SIZE, CACHE_LONGEST = 200_000, 48


class CharMap:
    """The compiled character map of a model: a double-array trie from UTF-8 prefixes to replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix of data[at:], and that prefix's length."""
        if not self.units:
            return None
        node, found, n = self._offset(self.units[0]), None, 0
        for byte in data[at:]:
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            n += 1
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, n)
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]


def _char_length(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Encoder:
    """Encodes and decodes as the library does with the model; ``model`` is the model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kinds = pb.ModelProto.SentencePiece
        pieces = [p.piece for p in proto.pieces]
        plain = [p.piece for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.user = sorted((p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.bos, self.eos, self.unk = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        self.bytes_too = proto.trainer_spec.byte_fallback
        #: Characters that are pieces; without byte fallback a run of others becomes one unknown piece.
        self.known = {p for p in plain if len(p) == 1}
        #: No piece joins other text to a space mark after it, nor holds a line feed: there the text can be cut.
        self.cuts = self.mark and not any(SPACE_MARK in p.lstrip(SPACE_MARK) or len(p) > 1 and "\n" in p for p in plain) and (self.bytes_too or {SPACE_MARK, "\n"} <= self.known)
        surface = [bytes([int(p[3:5], 16)]) if x.type == kinds.BYTE else b"" if x.type in (kinds.CONTROL, kinds.UNKNOWN) else p.encode() for p, x in zip(pieces, proto.pieces, strict=True)]
        self.width = np.array([len(s) for s in surface], np.int64)
        self.width_in_source = np.array([len(s.replace(SPACE_MARK.encode(), b" ")) for s in surface], np.int64)
        self.shown = [b" \xe2\x81\x87 " if i == self.unk else s.replace(SPACE_MARK.encode(), b" ") for i, s in enumerate(surface)]
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.name = b"", False, False, "identity"
        self._bare_model = proto.SerializeToString()
        self._cache: dict[str, bytes] = {}
        self._chunk = re.compile(r" *[^ \n]+| +|\n") if self.cuts else re.compile(r"(?s).+")

    @cached_property
    def _bare(self):
        """The library's encoder for text that is normalised already."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self._bare_model)

    @property
    def plain(self) -> bool:
        """Normalising changes nothing but the spaces' marks."""
        return not self.map.units and not self.trim and not self.user

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text with spaces unmarked, and for each of its bytes (and its end) the source byte it came from."""
        data, out, origin, at = text.encode(), bytearray(), [], 0
        if not data:
            return "", np.zeros(1, np.int64)

        def step(i):
            for u in self.user:
                if data.startswith(u, i):
                    return u, len(u)
            if found := self.map.longest(data, i):
                return found
            n = _char_length(data[i])
            return data[i : i + n], n

        if self.trim:
            while at < len(data) and (s := step(at))[0] == b" ":
                at += s[1]
            if at == len(data):
                return "", np.array([at], np.int64)
        if self.dummy:
            out += b" "
            origin.append(at)
        after_space = self.trim
        while at < len(data):
            got, used = step(at)
            if self.trim and after_space:
                got = got.lstrip(b" ")
            if got:
                out += got
                origin += [at] * len(got)
                after_space = got.endswith(b" ")
            at += used
            if not self.trim:
                after_space = False
        if self.trim:
            while out.endswith(b" "):
                out.pop()
                at = origin.pop()
        return out.decode(), np.array([*origin, at], np.int64)

    def _keys(self, normal: str) -> list[str]:
        """The chunks of normalised text by the names that the cache knows them by.

        Where the text can be cut: ``w`` stands for a space and the word w, a leading line feed for itself,
        and a leading U+0000 U+0000 for runs of spaces as they are. Else the whole text is one chunk.
        """
        if not self.cuts:
            return [normal] if normal else []
        if not normal.startswith(" ") or normal.startswith("  ") or normal.endswith(" ") or "  " in normal or " \n" in normal or "\0" in normal:
            return ["\0\0" + c for c in self._chunk.findall(normal)]
        return normal[1:].replace("\n", " \n").split(" ")

    def _fill(self, keys: set[str]) -> None:
        texts = [k if not self.cuts or k.startswith("\n") else k[2:] if k.startswith("\0\0") else " " + k for k in keys]
        self._cache.update(zip(keys, (array("I", x).tobytes() for x in self._bare.encode(texts, num_threads=1)), strict=True))

    def ids_of(self, normals: list[str]) -> list[bytes]:
        """Ids of normalised texts as little-endian 32-bit integers."""
        parts = [self._keys(t.replace(SPACE_MARK, " ") if self.mark else t) for t in normals]
        keys = set().union(*parts)
        new = keys - self._cache.keys()
        if new:
            if len(self._cache) + len(new) > CACHE_SIZE:
                self._cache.clear()
                new = keys
            self._fill(new)
        got = [b"".join(map(self._cache.__getitem__, p)) for p in parts]
        for k in new:
            if len(k) > CACHE_LONGEST:
                del self._cache[k]
        return got

    def encode_many(self, texts: list[str | None], ends: bool = True) -> list[bytes]:
        """All ids of each text, with begin and end ids; null text is empty text."""
        normals = [((" " * self.dummy + t if t else "") if self.plain else self.normalize(t)[0]) for t in (t or "" for t in texts)]
        mark = lambda i: struct.pack("<I", i) if ends else b""
        first, last = mark(self.bos), mark(self.eos)
        return [first + x + last for x in self.ids_of(normals)]

    def forget(self) -> None:
        """Lets the kept chunks go: a worker that waits for its next task holds the model only."""
        self._cache.clear()

    def encode(self, text: str | None, ends: bool = True) -> bytes:
        return self.encode_many([text], ends)[0]

    def widths(self, normal: str, ids: np.ndarray) -> np.ndarray:
        """The bytes of normalised text that each id stands for; an unknown piece stands for the run of unknown characters."""
        widths = self.width_in_source[ids]
        if not np.any(ids == self.unk):
            return widths
        data, at = normal.encode(), 0
        known = lambda c: (SPACE_MARK if self.mark and c == " " else c) in self.known
        for k in range(len(ids)):
            if ids[k] == self.unk:
                end = at
                while end < len(data) and (end == at or not known(data[end : end + _char_length(data[end])].decode())):
                    end += _char_length(data[end])
                widths[k] = end - at
            at += int(widths[k])
        return widths

    def spans(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the source bytes [begin, end) that it stands for; begin and end ids stand for none."""
        text = text or ""
        if self.plain:
            normal = (" " * self.dummy + text if text else "").replace(SPACE_MARK, " ")
            upto = np.cumsum(self.widths(normal, ids))
            if SPACE_MARK in text:  # a mark in the text is encoded as a space is, and wider
                wide = np.frombuffer(normal.encode(), np.uint8) == 32
                marked = [c == SPACE_MARK for c in " " * (self.dummy and text != "") + text if c in (" ", SPACE_MARK)]
                steps = np.ones(len(wide), np.int64)
                steps[np.flatnonzero(wide)[marked]] = len(SPACE_MARK.encode())
                upto = np.concatenate([[0], np.cumsum(steps)])[upto]
            if text and self.dummy:
                upto = np.maximum(upto - 1, 0)
            return np.concatenate([[0], upto[:-1]]).astype(np.int64), upto
        normal, origin = self.normalize(text)
        upto = np.cumsum(self.widths(normal, ids))
        begin = origin[np.concatenate([[0], upto[:-1]]).astype(np.int64)]
        return begin, origin[upto]

    def decode(self, ids) -> str:
        data = b"".join(map(self.shown.__getitem__, ids))
        if (self.dummy or self.trim) and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One for each Python worker and model; whoever asks for it ends with ``forget``."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends) of each row of docs (doc_id, text): all ids, and their spans in the text's UTF-8 bytes.

    The model is read on the driver and travels with the tasks. Rows are done by themselves; null and empty
    texts give the begin and end ids only; repeated rows repeat; other columns play no part.
    """
    model = read_model(model_path)

    def work(batches):
        e = _encoder(model)
        for b in batches:
            doc_ids = iter(b.column("doc_id").to_pylist())
            for texts in _groups(b.column("text")):
                ids = [np.frombuffer(raw, "<u4") for raw in e.encode_many(texts)]
                yield _batch([(doc_id, i, *e.spans(t, i)) for t, i, doc_id in zip(texts, ids, doc_ids, strict=False)])
        e.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def _groups(column: pa.Array, size: int = 1 << 18):
    """Texts of a column, by about ``size`` characters at a time."""
    held, n = [], 0
    for text in column:
        held.append(text.as_py())
        n += len(held[-1] or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _lists(parts) -> pa.ListArray:
    upto = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def _batch(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), *(_lists([h[k] for h in held]) for k in (1, 2, 3))], names=["doc_id", "ids", "begins", "ends"])


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes): encode, project the spans, decode, and keep digests only.

    span_bytes is the total length of all spans: the text's UTF-8 length where the spans cover it without gaps.
    """
    model = read_model(model_path)

    def work(batches):
        e = _encoder(model)
        for b in batches:
            rows = []
            for texts in _groups(b.column("text")):
                for text, raw in zip(texts, e.encode_many(texts), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    begins, ends = e.spans(text, ids)
                    rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(e.decode(ids.tolist()).encode()).hexdigest(), int((ends - begins).sum())))
            n, a, d, s = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(s, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])
        e.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
