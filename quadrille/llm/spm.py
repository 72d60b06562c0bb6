"""SentencePiece encoding with offsets, and decoding."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from ._common import lists_of, slices, tidy, worker_cache

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Bytes that the words whose ids a worker remembers may take, and what one takes besides its letters and ids.
KNOWN_BYTES, WORD_BYTES = 24 << 20, 200


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, blob[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie from byte strings to replacements.

    The file format's fixed values: a 32-bit size, so many bytes of 32-bit trie units, then zero-ended replacements. A unit
    holds its label in bits 0-7 and 31, whether a value hangs below it in bit 8, and its offset from bit 10 on, 8 bits further left if bit 9 is set.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """(bytes, place of the replacement) of the longest entry that starts here."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for n in range(at, len(text)):
            node ^= text[n]
            if node >= len(units) or units[node] & 0x800000FF != text[n]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit & 256:
                found = n + 1 - at, units[node] & 0x7FFFFFFF
        return found

    def replacement(self, place: int) -> bytes:
        return self.replacements[place : self.replacements.index(b"\0", place)]


class Normalizer:
    """Text to normalised bytes, with the source offset of each of them."""

    def __init__(self, spec: bytes):
        known = dict(_fields(spec))
        self.map = CharMap(known.get(2, b""))
        self.dummy_prefix, self.tidy, self.escape = (bool(known.get(n, 1)) for n in (3, 4, 5))

    @property
    def plain(self) -> bool:
        """No character changes but for the mark of spaces."""
        return not self.map.units and not self.tidy and self.escape

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source byte offset of each, and of the end)."""
        return self._copied(text) if self.plain else self._mapped(text)

    def _copied(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int32)
        b = np.frombuffer(text, np.uint8)
        at = np.arange(len(b), dtype=np.int32)
        first = np.maximum.accumulate(np.where((b & 0xC0) != 0x80, at, 0))
        source = np.repeat(first, np.where(b == 32, 3, 1))
        start = [0, 0, 0] if self.dummy_prefix else []
        mark = SPACE.encode()
        return mark * self.dummy_prefix + text.replace(b" ", mark), np.concatenate([np.array(start, np.int32), source, np.array([len(b)], np.int32)])

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        if (hit := self.map.longest(text, at)) is not None:
            return self.map.replacement(hit[1]), hit[0]
        lead = text[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + size], size

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        mark = SPACE.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0
        if self.tidy:
            while at < len(text):
                piece, size = self._prefix(text, at)
                if piece != b" ":
                    break
                at += size
        if at >= len(text):
            return b"", np.zeros(1, np.int32)
        if self.dummy_prefix:
            out += mark
            source += [at] * len(mark)
        spaced = self.tidy
        while at < len(text):
            piece, size = self._prefix(text, at)
            if self.tidy and spaced:
                piece = piece.lstrip(b" ")
            if piece:
                escaped = piece.replace(b" ", mark)
                out += escaped
                source += [at] * len(escaped)
                spaced = piece.endswith(b" ")
            at += size
            if not self.tidy:
                spaced = False
        end = at
        if self.tidy:
            while out.endswith(mark):
                end = source[len(out) - len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, end], np.int32)


class Codec:
    """A model's encoder with spans, and its decoder."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        top = list(_fields(model))
        self.normalize = Normalizer(next((v for k, v in top if k == 3), b""))
        size = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(size)]
        self.length = np.array([1 if self.sp.is_byte(i) else 0 if self.sp.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.unknown, self.end = self.sp.unk_id(), self.sp.eos_id()
        # Where no piece runs over the start of a mark, words that a single space parts are encoded each for itself.
        self.by_word = self.normalize.plain and self.normalize.dummy_prefix and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        #: Words, with their ids as 32-bit numbers, and what they take.
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start of each text among them with the end added), with the end id after each."""
        whole = pa.array(np.ones(len(texts), bool))
        if self.by_word:
            whole = pc.or_(pc.match_substring_regex(texts, "^ |  | $"), pc.match_substring(texts, SPACE))
        whole = np.asarray(whole)
        runs: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2] * 2
        parts = texts.filter(pa.array(~whole))
        lists = pc.split_pattern(parts, " ")
        coded = pc.list_flatten(lists).cast(pa.large_binary()).dictionary_encode()
        flat, sizes = self._words(coded.dictionary.to_pylist())
        codes = np.asarray(coded.indices).astype(np.int64)
        per_text = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        word_size = sizes[codes]
        begin = (np.cumsum(sizes) - sizes)[codes]
        total = np.concatenate([[0], np.cumsum(word_size)])
        some = flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], word_size)]
        ends = total[np.concatenate([[0], np.cumsum(per_text)])]
        rest = self.sp.encode(texts.filter(pa.array(whole)).to_pylist(), num_threads=1) if whole.any() else []
        length = np.empty(len(texts), np.int64)
        length[~whole] = np.diff(ends)
        length[whole] = list(map(len, rest))
        starts = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(starts[-1], self.end, np.int64)
        body = np.ones(len(out), bool)
        body[starts[1:] - 1] = False
        of_whole = np.repeat(whole, length + 1)
        out[body & ~of_whole] = some
        if rest:
            out[body & of_whole] = np.concatenate([np.asarray(x, np.int64) for x in rest])
        return out, starts

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if new := [w for w in words if w not in known]:
            if self.held > KNOWN_BYTES:
                known.clear()
                new, self.held = words, 0
            for w, x in zip(new, self.sp.encode([w.decode() for w in new], num_threads=1)):
                known[w] = ids = array("i", x).tobytes()
                self.held += len(w) + len(ids) + WORD_BYTES
        got = [known[w] for w in words]
        return np.frombuffer(b"".join(got), np.int32).astype(np.int64), np.fromiter(map(len, got), np.int64, len(got)) // 4

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) source byte offsets of each id's piece; the end id has the empty span at the end.

        Bytes of a character that the model has no piece for share its span: empty but for the last of them.
        """
        normal, source = self.normalize(text)
        length = self.length[ids]
        if (ids == self.unknown).any():
            length = np.array([0 if self.sp.is_control(int(i)) else n for i, n in zip(ids, self._surface(text, ids, length))], np.int64)
        at = np.concatenate([[0], np.cumsum(length)])
        if at[-1] != len(normal):
            raise ValueError(f"pieces of {at[-1]} bytes for a normalised text of {len(normal)}")
        return source[at[:-1]], source[at[1:]]

    def _surface(self, text: bytes, ids: np.ndarray, length: np.ndarray) -> list[int]:
        pieces = [len(p.encode()) for p in self.sp.encode(text.decode(), out_type=str)]
        return pieces + [0] * (len(ids) - len(pieces))


def encoded(docs: DataFrame, model_path: str, decode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, ids, begins, ends and, with decode, decoded; keep: further columns that stay.

    ids are those of the sentencepiece library with an end id only; begins and ends are each piece's span in the text's
    UTF-8 bytes: the normaliser replaces the longest entry of the compiled character map at each place and notes the source
    offset of each byte it writes, and a piece's bytes are looked up there. decoded is the library's decoding of the ids.

    A null text counts as empty: its only id is the end id. Texts of any length are encoded whole. Rows are
    handled one by one, so nulls in other columns, repeated rows and empty tables need no rule; no shuffle. Columns
    of docs other than doc_id, text and keep are dropped, and those of keep that are named like a new one are replaced.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ("doc_id", "text", "ids", "begins", "ends", "decoded")
    extra = [c for c in keep if c not in made]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    held = ["doc_id", *extra]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codecs, key = worker_cache("codecs"), hash(model.value)
                codec = codecs[key] = codecs.get(key) or Codec(model.value)
                texts = pc.fill_null(part.column("text"), "").cast(pa.large_string())
                ids, starts = codec.ids(texts)
                spans = [codec.spans(t, ids[a:b]) for t, a, b in zip(texts.cast(pa.large_binary()).to_pylist(), starts, starts[1:])]
                cols = [part.column(c) for c in held] + [lists_of(ids, starts, pa.int32())]
                cols += [lists_of(np.concatenate([s[k] for s in spans]), starts, pa.int32()) for k in (0, 1)]
                if decode:
                    cols.append(pa.array([codec.sp.decode(ids[a:b].tolist()) for a, b in zip(starts, starts[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*held, "ids", "begins", "ends", *["decoded"] * decode])

    return docs.select(*held, "text").mapInArrow(tidy(encode), schema)
