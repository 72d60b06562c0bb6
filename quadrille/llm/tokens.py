"""Token ids in binary files: static range asymmetric numeral systems (rANS)."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import lists_of, slices, tasks, worker_cache

#: Fixed values of the format. Frequencies of a segment add up to 1 << SCALE; a lane's state stays in [1 << 31, 1 << 63)
#: and moves 32-bit words; a block of BLOCK ids is dealt to LANES lanes in turn.
SCALE, LOW, BLOCK, LANES = 20, 31, 16384, 32
#: A segment, which shares one frequency table, ends with the document that brings it to so many ids.
SEGMENT = 2 << 20
#: Words whose ids a worker remembers, over all its tasks: some 200 bytes each.
KNOWN = 1_000_000
#: Text tokenised at a time: the more, the fewer distinct words a byte.
SLICE = 8 << 20
#: Unicode's white space, as in a regular expression's class.
SPACES = "\\x09-\\x0d\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: A piece of its own at the end of a word; it and the letters are spelled as themselves.
ENDINGS = frozenset(",.;:!?")
#: How byte-level pre-tokenisers cut a text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
FORMAT = "part int, seq long, n_docs long, n_tokens long, doc_ids binary, lengths binary, symbols binary, freqs binary, block_words binary, block_crcs binary, states binary, words binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their whole-number frequencies, 1 at least, adding up to 1 << SCALE)."""
    counts = np.bincount(ids) if ids.max() < 1 << 22 else None
    symbols, counts = np.unique(ids, return_counts=True) if counts is None else (np.flatnonzero(counts), counts[counts > 0])
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError("too many distinct ids for one segment")
    scaled = np.maximum(1, (counts * float(1 << SCALE) / counts.sum()).astype(np.int64))
    over = int(scaled.sum()) - (1 << SCALE)
    if over < 0:
        scaled[np.argmax(scaled)] -= over
    while over > 0:
        # The most frequent give back in proportion, and never all they have.
        cut = np.minimum(scaled - 1, np.ceil(over * (scaled - 1) / (scaled - 1).sum()).astype(np.int64))
        first = np.argsort(-scaled, kind="stable")
        cut = cut[first]
        cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        scaled[first] -= cut
        over -= int(cut.sum())
    return symbols, scaled


@dataclass
class Segment:
    """Blocks that share a frequency table. Each block's place and lane states are a checkpoint: it decodes by itself."""

    symbols: np.ndarray
    freqs: np.ndarray
    n: int
    block_words: np.ndarray
    block_crcs: np.ndarray
    states: np.ndarray
    words: np.ndarray

    @classmethod
    def encode(cls, ids: np.ndarray) -> Segment:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            none = np.empty(0, np.int64)
            return cls(none, none, 0, none, none, np.empty((0, LANES), np.uint64), np.empty(0, np.uint32))
        symbols, freqs = frequencies(ids)
        blocks, steps = -(-len(ids) // BLOCK), BLOCK // LANES
        place = np.zeros(blocks * BLOCK, np.int64)
        if symbols[-1] < 1 << 22:
            table = np.zeros(symbols[-1] + 1, np.int64)
            table[symbols] = np.arange(len(symbols))
            place[: len(ids)] = table[ids]
        else:
            place[: len(ids)] = np.searchsorted(symbols, ids)
        place = place.reshape(blocks, steps, LANES)
        freq, start = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
        x = np.full((blocks, LANES), 1 << LOW, np.uint64)
        word = np.zeros((blocks, steps, LANES), np.uint32)
        sent = np.zeros((blocks, steps, LANES), bool)
        real = (np.arange(blocks * BLOCK) < len(ids)).reshape(blocks, steps, LANES)
        for s in range(steps - 1, -1, -1):
            f, c = freq[place[:, s]], start[place[:, s]]
            full = (x >= f << np.uint64(LOW + 32 - SCALE)) & real[:, s]
            word[:, s], sent[:, s] = x.astype(np.uint32), full
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = np.where(real[:, s], (q << np.uint64(SCALE)) + (x - q * f) + c, x)
        words = word[sent]
        block_words = sent.sum((1, 2))
        ends = np.cumsum(block_words)
        crcs = [zlib.crc32(words[e - n : e].astype("<u4").tobytes(), zlib.crc32(st.astype("<u8").tobytes())) for n, e, st in zip(block_words, ends, x)]
        return cls(symbols, freqs, len(ids), block_words, np.array(crcs, np.int64), x, words)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last (not with it; all if None). A damaged block raises ValueError."""
        last = len(self.block_words) if last is None else last
        if first >= last:
            return np.empty(0, np.int64)
        ends = np.cumsum(self.block_words)
        at = (ends - self.block_words)[first:last]
        for b in range(first, last):
            own = self.words[ends[b] - self.block_words[b] : ends[b]].astype("<u4").tobytes()
            if zlib.crc32(own, zlib.crc32(self.states[b].astype("<u8").tobytes())) != self.block_crcs[b]:
                raise ValueError(f"block {b} is damaged")
        steps, blocks = BLOCK // LANES, last - first
        n = min(self.n, last * BLOCK) - first * BLOCK
        slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs)
        freq, start = self.freqs.astype(np.uint64), (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)
        stream = np.concatenate([self.words, np.zeros(1, np.uint32)]).astype(np.uint64)
        real = (np.arange(blocks * BLOCK) < n).reshape(blocks, steps, LANES)
        x, out = self.states[first:last].astype(np.uint64), np.zeros((blocks, steps, LANES), np.uint32)
        for s in range(steps):
            slot = x & np.uint64((1 << SCALE) - 1)
            symbol = slots[slot.astype(np.int64)]
            y = freq[symbol] * (x >> np.uint64(SCALE)) + slot - start[symbol]
            take = (y < 1 << LOW) & real[:, s]
            place = at[:, None] + np.cumsum(take, 1) - 1
            y = np.where(take, (y << np.uint64(32)) | stream[np.where(take, place, len(stream) - 1)], y)
            at = at + take.sum(1)
            x = np.where(real[:, s], y, x)
            out[:, s] = symbol
        return self.symbols[out.reshape(-1)[:n]]

    def row(self) -> dict[str, bytes]:
        pack = lambda a, kind: zlib.compress(np.ascontiguousarray(a, kind).tobytes(), 1)
        return {
            "symbols": pack(np.diff(self.symbols, prepend=0), "<u4"), "freqs": pack(self.freqs, "<u4"), "block_words": pack(self.block_words, "<u4"),
            "block_crcs": np.ascontiguousarray(self.block_crcs, "<u4").tobytes(), "states": np.ascontiguousarray(self.states, "<u8").tobytes(), "words": np.ascontiguousarray(self.words, "<u4").tobytes(),
        }

    @classmethod
    def of_row(cls, row: dict) -> Segment:
        read = lambda b, kind: np.frombuffer(zlib.decompress(b), kind).astype(np.int64)
        return cls(
            np.cumsum(read(row["symbols"], "<u4")), read(row["freqs"], "<u4"), row["n_tokens"], read(row["block_words"], "<u4"),
            np.frombuffer(row["block_crcs"], "<u4").astype(np.int64), np.frombuffer(row["states"], "<u8").reshape(-1, LANES), np.frombuffer(row["words"], "<u4"),
        )


class Tokenizer:
    """The ids of the tokenizers library; words that a single space parts are encoded once and remembered.

    That is exact for byte-level pre-tokenisers with the usual pattern: a space before a character that isn't white space always
    starts a new piece. Texts where white space follows a space, or with a special token's string, are encoded whole.
    """

    def __init__(self, blob: str):
        import json

        from tokenizers import Tokenizer as Library

        self.tk = Library.from_str(blob)
        spec = json.loads(blob)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer") and not spec.get("truncation")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: Words and pieces, with their ids as 32-bit numbers.
        self.known: dict[bytes, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        #: The characters that byte-level models write bytes as: themselves where printable, else from U+0100 on.
        self.written = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [self.tk.encode(t, add_special_tokens=False).ids for t in texts]

    def ids(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id after it, start of each text among them with the end added)."""
        whole = pa.array(np.ones(len(texts), bool))
        if self.by_word:
            whole = pc.match_substring_regex(texts, " [" + SPACES + "]| $")
            for s in self.special:
                whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = np.asarray(whole)
        lists = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        per_text = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        parts = pc.list_flatten(lists)
        # All but a text's first part have their space before them.
        later = np.ones(len(parts), bool)
        later[(np.cumsum(per_text) - per_text)[per_text > 0]] = False
        coded = parts.cast(pa.large_binary()).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        firsts = np.unique(codes[~later])
        codes = np.where(later, codes, len(words) + np.searchsorted(firsts, codes))
        flat, sizes = self._words([b" " + w for w in words] + [words[i] for i in firsts])
        word_size, begin = sizes[codes], (np.cumsum(sizes) - sizes)[codes]
        total = np.concatenate([[0], np.cumsum(word_size)])
        some = flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], word_size)]
        rest = self._encode(texts.filter(pa.array(whole)).to_pylist())
        length = np.empty(len(texts), np.int64)
        length[~whole] = np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])
        length[whole] = list(map(len, rest))
        extra = int(end is not None)
        starts = np.concatenate([[0], np.cumsum(length + extra)])
        out, body = np.full(starts[-1], end or 0, np.uint32), np.ones(starts[-1], bool)
        if extra:
            body[starts[1:] - 1] = False
        if not rest:
            out[body] = some
            return out, starts
        of_whole = np.repeat(whole, length + extra)
        out[body & ~of_whole] = some
        out[body & of_whole] = np.concatenate([np.asarray(x, np.uint32) for x in rest])
        return out, starts

    def _piece(self, piece: bytes) -> bytes:
        spelled = piece.decode("latin-1").translate(self.written)
        return self._spelled(piece, spelled)

    def _spelled(self, piece: bytes, spelled: str) -> bytes:
        ids = self.known[piece] = array("I", [t.id for t in self.tk.model.tokenize(spelled)]).tobytes()
        return ids

    def _word(self, word: bytes) -> bytes:
        """By pieces that are remembered; beyond Latin letters, whose classes any two Unicode versions share, by the library's own."""
        known, text = self.known, word.decode()
        start = text[:1] == " "
        if text.isascii():
            body = text[start:]
            mark = self.written[32] if start else ""
            if body.isalpha():
                return self._spelled(word, mark + body)
            if body[-1:] in ENDINGS and body[:-1].isalpha():
                return (known.get(word[:-1]) or self._spelled(word[:-1], mark + body[:-1])) + (known.get(word[-1:]) or self._spelled(word[-1:], body[-1]))
        elif max(text) > "\u024f":
            return array("I", self._encode([text])[0]).tobytes()
        pieces = [p.encode() for p in PIECES.findall(text)]
        return b"".join([known.get(p) or self._piece(p) for p in pieces])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        got = [known.get(w) for w in words]
        for i, ids in enumerate(got):
            if ids is None:
                got[i] = known[words[i]] = self._word(words[i])
        return np.frombuffer(b"".join(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)) // 4


def encoded(docs: DataFrame, tokenizer_path: str, end: int | None = 0) -> DataFrame:
    """(doc_id, text) -> segments (FORMAT) in ascending order of doc_id, ready to be written.

    Documents are ordered by doc_id, then by a hash of the text: a total order but for repeated rows, which are alike. So ranges
    split even where one doc_id has many rows. A null doc_id comes first; a null text is empty. Each task
    tokenises its range and encodes segment by segment, so memory is bounded by a segment and the longest document. seq orders
    the segments of a part. An empty table gives no segments. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, tokenizer = TaskContext.get().partitionId(), 0, None
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def segment() -> pa.RecordBatch:
            ids, lengths, docs = (np.concatenate([k[i] for k in kept]) for i in range(3))
            row = {"part": part, "seq": seq, "n_docs": len(docs), "n_tokens": len(ids), "doc_ids": docs.tobytes(), "lengths": lengths.tobytes()} | Segment.encode(ids).row()
            row["doc_ids"], row["lengths"] = (zlib.compress(row[k], 1) for k in ("doc_ids", "lengths"))
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            for some in slices(batch, "text", SLICE):
                if tokenizer is None:
                    cache, key = worker_cache("tokenizers"), hash(blob.value)
                    tokenizer = cache[key] = cache.get(key) or Tokenizer(blob.value)
                ids, starts = tokenizer.ids(pc.fill_null(some.column("text"), "").cast(pa.large_string()), end)
                # The null doc_id is kept as the least long.
                kept.append((ids, np.diff(starts).astype("<i8"), np.asarray(pc.fill_null(some.column("doc_id").cast(pa.int64()), -(1 << 63))).astype("<i8")))
                if sum(len(k[0]) for k in kept) >= SEGMENT:
                    yield segment()
                    kept, seq = [], seq + 1
        if kept:
            yield segment()

    order = (F.col("doc_id"), F.col("_h"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    return rows.select("doc_id", "text").mapInArrow(encode, FORMAT)


SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in FORMAT.split(", "))])


def decoded(files: DataFrame, ids: bool = True) -> DataFrame:
    """Segments -> one row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids.

    Each segment decodes by itself. Where a part starts follows from the parts' sums, one row a part, which are joined
    to its segments; sums within a part are a window over that part's segments' sizes. Sizes only, no ids, are shuffled.
    """
    sizes = files.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    begin = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("at")).join(parts, "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.of_row(row)
                docs, lengths = (np.frombuffer(zlib.decompress(row[k]), "<i8") for k in ("doc_ids", "lengths"))
                starts = np.concatenate([[0], np.cumsum(lengths)])
                values = segment.decode().astype("<u4")
                if len(values) != starts[-1]:
                    raise ValueError("a segment's documents and ids differ in number")
                raw = memoryview(values.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                cols = {"part": np.full(len(docs), row["part"], np.int32), "seq": np.full(len(docs), row["seq"]), "local": starts[:-1], "n_tokens": lengths, "ids_crc32": np.array(crcs, np.int64)}
                out = {"doc_id": pa.array(docs, pa.int64(), mask=docs == -(1 << 63))} | {k: pa.array(v) for k, v in cols.items()}
                if ids:
                    out["ids"] = lists_of(values, starts, pa.int32())
                yield pa.RecordBatch.from_pydict(out)

    rows = files.mapInArrow(decode, "doc_id long, part int, seq long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    return rows.join(begin, ["part", "seq"]).select(
        "doc_id", (F.col("offset") + F.col("at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids
    )
