"""Substring deduplication: words of passages that a document with a smaller id has are removed."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, hashes, mixed, released, tasks, text_words, tidy, window_hashes, written

#: Words a window.
WINDOW = 13
#: Rows of a slice of documents, bytes of text from which on a slice is cut further, and slices told apart by bounds on doc_id; further
#: ones by even parts between bounds.
SLICE_ROWS, SLICE_TEXT, BOUNDS = 2048, 16 << 20, 512
#: Windows that one task brings together, and slices that one cut of a slice may make.
PART_WINDOWS, CUTS = 2 << 20, 1 << 20
#: Rows of the table of slices to cut up to which it is broadcast.
PLANNED = 1 << 16
#: Bounds of a reference that is broadcast as suffix automata.
SHARD_WORDS, REFERENCE_BYTES = 200_000, 8 << 20
_WORD = re.compile(WORD)


def _slice_of(docs: DataFrame, slices: int) -> Column:
    """A slice number that grows with doc_id: of two documents in different slices, that of the lower slice has the smaller doc_id."""
    cuts = min(BOUNDS, slices)
    found = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 10 * BOUNDS).alias("q")).first()["q"]
    if not found:
        return F.lit(0)
    bounds = sorted(set(found))
    parts = math.ceil(slices / max(1, len(bounds)))
    doc = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    last = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= doc))
    if parts == 1:
        return last
    low = F.element_at(F.array(*map(F.lit, bounds)), F.greatest(last, F.lit(1)))
    high = F.element_at(F.array(*map(F.lit, [*bounds[1:], bounds[-1] + 1])), F.greatest(last, F.lit(1)))
    inside = F.floor((doc.cast("double") - low) / F.greatest(high - low, F.lit(1)) * parts)
    return last * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))


def _sliced(rows: DataFrame) -> tuple[DataFrame, int]:
    """(rows with their slice, windows there may be). A slice of more than SLICE_TEXT bytes is cut between its least and greatest doc_id."""
    n = rows.select("doc_id").count()
    first = rows.withColumn("slice", _slice_of(rows.select("doc_id"), max(tasks(rows.sparkSession), math.ceil(n / SLICE_ROWS))).cast("long") * CUTS)
    doc = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")
    size = F.sum(F.octet_length("text"))
    sizes = written(first.groupBy("slice").agg(size.alias("bytes"), F.min(doc).alias("lo"), F.max(doc).alias("hi")), "substring-slices")
    heavy = sizes.filter((F.col("bytes") > SLICE_TEXT) & (F.col("lo") < F.col("hi"))).select(F.col("slice").alias("s"), "lo", "hi", F.ceil(F.col("bytes") / SLICE_TEXT).alias("cuts"))
    # A word takes two bytes at least, its end counted.
    windows = (sizes.agg(F.sum("bytes")).first()[0] or 0) // 2
    count = heavy.count()
    if not count:
        return first, windows
    joined = first.join(F.broadcast(heavy) if count <= PLANNED else heavy, F.col("slice") == F.col("s"), "left")
    cut = F.least(F.floor((doc - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("cuts")), F.col("cuts") - 1, F.lit(CUTS - 1))
    return joined.withColumn("slice", F.col("slice") + F.coalesce(cut, F.lit(0))).select(*first.columns), windows


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(window hashes, 16 bits more of each, each text's first, first words, word codes, distinct words)."""
    starts, codes, words = text_words(texts)
    each = hashes(words)
    windows, at = window_hashes(each[codes] if len(words) else np.empty(0, np.uint64), starts, WINDOW)
    more, _ = window_hashes(mixed(each ^ np.uint64(0xD6E8FEB86659FD93))[codes] if len(words) else np.empty(0, np.uint64), starts, WINDOW)
    return windows, (more >> np.uint64(48)).astype(np.uint16), at, starts, codes, words


def _ordered(windows: np.ndarray, more: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by window, then by the other arrays, and where in that order a new window starts)."""
    order = np.lexsort((*reversed(then), more, windows))
    w, m = windows[order], more[order]
    first = np.ones(len(order), bool)
    first[1:] = (w[1:] != w[:-1]) | (m[1:] != m[:-1])
    return order, first


def _marked(docs: DataFrame, held: Column, columns: tuple[str, ...]) -> DataFrame:
    """row (held), doc_id, n_words, n_removed and the wanted ones of kept and cleaned; see marked()."""
    rows, total = _sliced(docs.select(held.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    parts = max(tasks(docs.sparkSession), math.ceil(total / PART_WINDOWS))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        windows, more, *_ = _windows(_whole(table.column("text")))
        order, first = _ordered(windows, more)
        order = order[first]
        windows, more = windows[order], more[order]
        # Parts are ranges of the upper 32 bits.
        part = (((windows >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        each, begin = np.unique(part, return_index=True)
        blobs = [_packed(windows[a:b], more[a:b]) for a, b in zip(begin, [*begin[1:], len(part)])]
        out = pa.table({"part": pa.array(each, pa.int32()), "slice": pa.array(np.full(len(each), key[0].as_py()), pa.int64()), "hashes": pa.array(blobs, pa.binary())})
        del table, windows, more, order, first, part
        released()
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, of = [], []
        for batch in batches:
            for s, blob in zip(batch.column("slice").to_pylist(), batch.column("hashes").to_pylist()):
                got.append(_unpacked(blob))
                of.append(np.full(len(got[-1][0]), s, np.int64))
        if not got:
            return
        windows, more = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        slice_ = np.concatenate(of)
        got.clear()
        of.clear()
        # Only hashes that came twice go on.
        order = np.argsort(windows)
        twin = windows[order][1:] == windows[order][:-1]
        some = order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
        windows, more, slice_ = windows[some], more[some], slice_[some]
        order, first = _ordered(windows, more, slice_)
        # All but the lowest slice that has a window get it back.
        again = order[~first]
        again = again[np.argsort(slice_[again], kind="stable")]
        each, begin = np.unique(slice_[again], return_index=True)
        cuts = list(zip(begin, [*begin[1:], len(again)]))
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array(each, pa.int64()),
            "hashes": pa.array([windows[again[a:b]].tobytes() for a, b in cuts], pa.binary()),
            "more": pa.array([more[again[a:b]].tobytes() for a, b in cuts], pa.binary()),
        })

    sent = rows.groupBy("slice").applyInArrow(send, "part int, slice long, hashes binary")
    back = sent.repartitionById(parts, F.col("part")).mapInArrow(tidy(meet), "slice long, hashes binary, more binary")

    def remove(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        texts = _whole(table.column("text"))
        docs_ = np.asarray(pc.fill_null(table.column("doc_id"), -(1 << 63)))
        windows, more, at, starts, codes, words = _windows(texts)
        owner = np.repeat(np.arange(len(docs_)), np.diff(at))
        hit = _among(windows, more, *(np.concatenate([np.empty(0, t), *(np.frombuffer(b, t) for b in known.column(c).to_pylist())]) for c, t in (("hashes", np.uint64), ("more", np.uint16))))
        order, first = _ordered(windows, more, docs_[owner])
        least = docs_[owner][order][np.flatnonzero(first)]
        hit[order] |= docs_[owner][order] > least[np.cumsum(first) - 1]
        # Words that any window hit covers.
        cover = np.zeros(len(codes) + 1, np.int32)
        begin = starts[owner[hit]] + (np.flatnonzero(hit) - at[owner[hit]])
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WINDOW, -1)
        gone = np.cumsum(cover[:-1]) > 0
        of = np.repeat(np.arange(len(docs_)), np.diff(starts))
        removed = np.bincount(of[gone], minlength=len(docs_))
        out = {"row": table.column("row"), "doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(starts)), "n_removed": pa.array(removed.astype(np.int64))}
        if "kept" in columns:
            kept_at = np.concatenate([[0], np.cumsum(np.diff(starts) - removed)])
            left = words.cast(pa.large_string()).take(pa.array(codes[~gone])).cast(pa.string()) if len(words) else pa.array([], pa.string())
            out["kept"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), left), " ")
        if "cleaned" in columns:
            cleaned = texts.to_pylist()
            for i in np.flatnonzero(removed):
                cleaned[i] = _cut(cleaned[i], gone[starts[i] : starts[i + 1]])
            out["cleaned"] = pa.array(cleaned, pa.string())
        del windows, more, owner, order, cover, of
        released()
        return pa.table(out)

    schema = rows.select("row", "doc_id").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")} | {c: F.lit(None).cast("string") for c in columns}).schema
    return rows.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(remove, schema)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept (the words kept, joined by a space).

    A word goes if it is in a window of WINDOW words whose words also start in a document with a smaller doc_id.

    Documents are dealt to slices in order of doc_id, bounded in rows and bytes. Each slice sends the distinct hashes of its windows, dealt
    by ranges of the hash; where a hash comes from several slices, all but the lowest get it back. Within the lowest slice the least document
    that has the window owns it. So neither a passage that many documents share nor a long document is ever gathered: a
    slice sends a window once. Windows are equal if 80 bits of their hashes, from two polynomials, are.

    A null text has no words. A null doc_id is smaller than any. Rows of one doc_id, in one slice, don't remove from each other. Texts are
    read whole; texts under WINDOW words stay. Other columns are not read. An empty table gives an empty result.
    """
    return _marked(docs, F.lit(None).cast("int"), ("kept",)).drop("row")


class SuffixAutomaton:
    """All runs of words of a reference shard: a state is a set of runs that end in the same places.

    moves: (state << 32 | word) to state; link: a state's longest run that ends elsewhere too; length: its longest run.
    Documents of the shard are entered one after the other, so no run goes from one to the next.
    """

    def __init__(self, documents: list[list[int]]):
        self.moves: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]  # the words that leave each state
        for words in documents:
            last = 0
            for w in words:
                last = self._enter(last, w, out)

    def _state(self, length: int, link: int, words: list[int], like: int, out: list[list[int]]) -> int:
        made = len(self.link)
        self.link.append(link)
        self.length.append(length)
        out.append(list(words))
        for w in words:
            self.moves[made << 32 | w] = self.moves[like << 32 | w]
        return made

    def _enter(self, last: int, w: int, out: list[list[int]]) -> int:
        moves, link, length = self.moves, self.link, self.length
        known = moves.get(last << 32 | w)
        if known is not None and length[known] == length[last] + 1:
            return known
        made = -1 if known is not None else self._state(length[last] + 1, 0, [], 0, out)
        at = last
        while made >= 0 and at >= 0 and at << 32 | w not in moves:
            moves[at << 32 | w] = made
            out[at].append(w)
            at = link[at]
        if at < 0:
            return made
        target = moves[at << 32 | w]
        if length[target] != length[at] + 1:
            twin = self._state(length[at] + 1, link[target], out[target], target, out)
            link[target] = twin
            while at >= 0 and moves.get(at << 32 | w) == target:
                moves[at << 32 | w] = twin
                at = link[at]
            target = twin
        if made < 0:
            return target
        link[made] = target
        return made


def matching(automaton: tuple[dict[int, int], list[int], list[int]], words: list[int]) -> list[int]:
    """For each place the length of the longest run that ends there and is in the shard."""
    moves, link, length = automaton
    state = size = 0
    out = []
    for w in words:
        after = moves.get(state << 32 | w)
        while after is None and state > 0:
            state = link[state]
            size = length[state]
            after = moves.get(state << 32 | w)
        if after is None:
            size = 0
        else:
            state, size = after, size + 1
        out.append(size)
    return out


def without_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the maximal spans of `window` words or more that the reference texts (text) have; n_removed is added.

    The reference is cut into shards of SHARD_WORDS words at most, or one text; the suffix automaton of each is broadcast and all
    documents are streamed through all of them. For references up to REFERENCE_BYTES, such as benchmarks; a larger one raises
    ValueError. Null texts have no words; a text without such spans stays as it is.
    """
    size = reference.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > REFERENCE_BYTES:
        raise ValueError(f"a reference of {size} bytes; {REFERENCE_BYTES} can be broadcast")
    number: dict[str, int] = {}
    shards, held = [[]], 0
    for r in reference.select("text").filter("text is not null").distinct().toLocalIterator():
        words = [number.setdefault(w, len(number) + 1) for w in _WORD.findall(r["text"])]
        if held and held + len(words) > SHARD_WORDS:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    made = [(a.moves, a.link, a.length) for a in map(SuffixAutomaton, shards)]
    shared = docs.sparkSession.sparkContext.broadcast((number, made))
    kept = [c for c in docs.columns if c != "n_removed"]
    schema = docs.select(*kept).withColumn("n_removed", F.lit(0).cast("long")).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automata = shared.value
        for batch in batches:
            texts, gone_in = batch.column("text").to_pylist(), []
            for i, text in enumerate(texts):
                words = [known.get(w, 0) for w in _WORD.findall(text or "")]
                gone = np.zeros(len(words) + 1, np.int64)
                for automaton in automata:
                    sizes = np.array(matching(automaton, words), np.int64)
                    ends = np.flatnonzero(sizes >= window)
                    np.add.at(gone, ends - sizes[ends] + 1, 1)
                    np.add.at(gone, ends + 1, -1)
                hit = np.cumsum(gone[:-1]) > 0
                gone_in.append(int(hit.sum()))
                if gone_in[-1]:
                    texts[i] = _cut(text, hit)
            cols = [pa.array(texts, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone_in, pa.int64())], [*kept, "n_removed"])

    return docs.select(*kept).mapInArrow(tidy(remove), schema)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    chunks = column.cast(pa.large_string()).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())


def _packed(windows: np.ndarray, more: np.ndarray) -> bytes:
    """Ascending hashes, the first whole and then differences of as many bytes as the largest needs, and the 16 bits more of each."""
    steps = np.diff(windows)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + windows[:1].astype("<u8").tobytes() + raw.tobytes() + more.astype("<u2").tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = blob[0]
    n = (len(blob) - 9 + width) // (width + 2)
    raw = np.zeros((n, 8), np.uint8)
    raw[0] = np.frombuffer(blob, np.uint8, 8, 1)
    raw[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 9).reshape(-1, width)
    return np.cumsum(raw.reshape(-1).view("<u8"), dtype=np.uint64), np.frombuffer(blob, "<u2", n, 9 + (n - 1) * width)


def _among(windows: np.ndarray, more: np.ndarray, known: np.ndarray, known_more: np.ndarray) -> np.ndarray:
    """Which windows are among the known ones."""
    order = np.argsort(known)
    known, known_more = known[order], known_more[order]
    hit = np.zeros(len(windows), bool)
    place = np.searchsorted(known, windows)
    live = np.flatnonzero(place < len(known))
    while len(live := live[known[place[live]] == windows[live]]):
        hit[live] |= known_more[place[live]] == more[live]
        place[live] += 1
        live = live[place[live] < len(known)]
    return hit


def _cut(text: str, gone: np.ndarray) -> str:
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2]))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents without the passages that marked() finds; the columns stay, whatever their names.

    A text of which nothing is removed stays as it is; of another the kept stretches stay, with the white space between their
    words, joined by a space. Documents of which no word is left go; those that had none, null ones too, stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = _marked(docs, row, ("cleaned",)).filter("n_removed = 0 or n_removed < n_words")
    return found.select(*(F.col("cleaned").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
