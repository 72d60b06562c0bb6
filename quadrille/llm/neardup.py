"""MinHash near-duplicates: BagMinHash signatures of word 5-gram bags, banding, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, hashes, lists_of, mixed, slices, text_words, tidy, window_hashes, written

#: Words a shingle, and weighted Jaccard similarity from which two texts are linked.
WORDS, SIMILAR = 5, 0.8
#: Bands of rows: texts of similarity 0.8 share a band with probability 1 - (1 - 0.8**5)**32, all but 3 in a million.
BANDS, ROWS = 32, 5
#: In a group of up to so many texts, pairs are verified one by one; in a larger one, block by block.
FEW = 8
#: Texts and bytes of a block.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Blocks up to which a component of texts that meet is compared as a whole; a larger one is compared shingle by shingle.
WHOLE = 16
#: Counters, shared by hash, that tell common shingles from rare ones.
COUNTERS = 1 << 18


def signatures(elements: np.ndarray, counts: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash: (documents, m) values that agree in a place with probability weighted Jaccard similarity.

    elements: 64-bit hashes, distinct within a document; counts: how often each occurs; starts: each document's first
    element, with the end added. Every element has a Poisson process of points in time over its possible weights, and each
    point has a place among the m. A weight is cut at powers of two into blocks; a block is a process of its own, of rate m
    times its length, whose points get a level within it by halving. An element of count c keeps the points up to level c. A
    place's value is the first point kept in it. Points are made in order of time and only up to a bound after which
    hardly any place is still empty; documents for which one is are done again with twice the bound.
    """
    n = len(starts) - 1
    out = np.full((n, m), np.inf)
    weight = np.add.reduceat(np.concatenate([counts, [0]]), np.minimum(starts[:-1], len(counts)))[:n] * (np.diff(starts) > 0) if n else np.empty(0)
    bound = (np.log(m) + 3) / np.maximum(weight, 1)
    open_ = np.flatnonzero(np.diff(starts) > 0)
    # A node is an element's block (low, high] of levels; elements of count 1 have just (0, 1].
    owner = np.repeat(np.arange(n), np.diff(starts))
    nodes = [(elements, owner, np.zeros(len(elements), np.int64), counts)]
    block = 0
    while (more := counts > (1 << block)).any():
        some = np.flatnonzero(more)
        nodes.append((elements[some], owner[some], np.full(len(some), block + 1), counts[some]))
        block += 1
    key, doc, depth, count = (np.concatenate([x[i] for x in nodes]) for i in range(4))
    key = mixed(key + np.uint64(0x9E3779B97F4A7C15) * (depth.astype(np.uint64) + np.uint64(1)))
    length = np.where(depth > 0, 1 << np.maximum(depth - 1, 0), 1).astype(np.float64)
    low = np.where(depth > 0, length, 0.0)
    while len(open_):
        still = np.zeros(n, bool)
        still[open_] = True
        at = np.flatnonzero(still[doc])
        state, time = key[at], np.zeros(len(at))
        while len(at):
            state = mixed(state + np.uint64(0xD1B54A32D192ED03))
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / (m * length[at])
            live = time <= bound[doc[at]]
            at, state, time = at[live], state[live], time[live]
            extra = mixed(state ^ np.uint64(0xA0761D6478BD642F))
            place = (extra % np.uint64(m)).astype(np.int64)
            level = low[at] + np.floor((extra >> np.uint64(32)).astype(np.float64) / float(1 << 32) * length[at]) + 1
            kept = level <= count[at]
            np.minimum.at(out, (doc[at][kept], place[kept]), time[kept])
        open_ = open_[np.isinf(out[open_]).any(1)]
        bound[open_] *= 2
    return out


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(distinct shingle hashes in order, their counts, each text's first, a 128-bit digest of each text's words).

    A text of fewer than WORDS words, but one at least, has one shingle: all of its words.
    """
    starts, codes, words = text_words(texts)
    word = hashes(words)[codes] if len(words) else np.empty(0, np.uint64)
    windows, at = window_hashes(word, starts, WORDS)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(at))
    digest = [xxhash.xxh3_128_digest(word[a:b].tobytes()) if b > a else b"" for a, b in zip(starts, starts[1:])]
    short = np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < WORDS))
    windows = np.concatenate([windows, np.array([int.from_bytes(digest[i][:8], "little") for i in short], np.uint64)])
    owner = np.concatenate([owner, short])
    order = np.lexsort((windows, owner))
    windows, owner = windows[order], owner[order]
    first = np.ones(len(windows), bool)
    first[1:] = (windows[1:] != windows[:-1]) | (owner[1:] != owner[:-1])
    places = np.flatnonzero(first)
    return windows[places], np.diff(np.append(places, len(windows))), np.searchsorted(owner[places], np.arange(len(starts))), digest


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, digest, bands): 64-bit band keys, none for texts without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                elements, counts, starts, digest = shingles(part.column("text"))
                some = np.flatnonzero(np.diff(starts) > 0)
                bits = signatures(elements, counts, starts, BANDS * ROWS)[some].view(np.uint64).reshape(len(some), BANDS, ROWS)
                band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(some), 1))
                for r in range(ROWS):
                    band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
                sizes = np.zeros(part.num_rows, np.int64)
                sizes[some] = BANDS
                keys = lists_of(band.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), keys], ["doc_id", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(sketch), "doc_id long, digest binary, bands array<long>")


def _bags(docs: DataFrame) -> DataFrame:
    """(doc_id, bag): shingle hashes in order, then their counts, as bytes."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                elements, counts, starts, _ = shingles(part.column("text"))
                # Counts follow as 32-bit numbers unless all are 1.
                blobs = [elements[a:b].tobytes() + (b"" if (counts[a:b] == 1).all() else b"\1" + counts[a:b].astype("<u4").tobytes()) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "bag": pa.array(blobs, pa.binary())})

    return docs.mapInArrow(tidy(bag), "doc_id long, bag binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    if len(blob) % 8 == 0:
        return np.frombuffer(blob, np.uint64), None
    n = (len(blob) - 1) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, "<u4", n, 8 * n + 1).astype(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    (x, m), (y, n) = _unpacked(a), _unpacked(b)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = len(both) if m is None and n is None else int(np.minimum(1 if m is None else m[i], 1 if n is None else n[j]).sum())
    total = (len(x) if m is None else int(m.sum())) + (len(y) if n is None else int(n.sum())) - shared
    return shared / total if total else 0.0


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags are SIMILAR or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist()
            close = pa.array([similarity(x, y) >= SIMILAR for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(close), batch.column("b").filter(close)], ["a", "b"])

    left = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(tidy(verify), "a long, b long"), "near-links")


def linked(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of the members that have a link. members: doc_id, bands; docs: doc_id, text, with distinct doc_ids.

    Every member of a bucket is verified against the bucket's first, which aggregation finds without a bucket ever meeting in one
    task. What the links found so far join is a class, and a bucket within one class has nothing more to tell. The members
    of all others meet again by their rarest shingles: two texts that are SIMILAR share one of the first fifth of their
    shingles in any order that holds for all texts, here from rare to common. So texts that share a bucket for what
    very many texts have in common hardly meet, and no two similar texts of a bucket are left unverified, whatever its size, unless
    links join them. Texts that meet make components; all pairs of different classes in a component are verified, in a very large one all pairs
    that meet. What is written grows with the rows, not with their square.
    """
    rows = members.select(F.col("doc_id").alias("b"), F.explode("bands").alias("key"))
    buckets = written(rows.groupBy("key").agg(F.min("b").alias("first"), F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    held = written(rows.join(buckets, "key"), "near-held")
    bags = written(_bags(docs.join(held.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")), "near-bags")
    star = _verified(held.filter("first < b").select(F.col("first").alias("a"), "b").distinct(), bags)
    joined = classes(star)
    of = written(held.filter("n > 2").join(joined.withColumnRenamed("doc_id", "b"), "b", "left").select("key", "b", F.coalesce("class_id", "b").alias("class_id")), "near-held")
    keys = written(of.groupBy("key").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo < hi").select("key"), "near-keys")
    open_ = written(of.join(keys, "key").select(F.col("b").alias("doc_id"), "class_id").distinct(), "near-open")
    tokens = written(_rarest(open_.join(bags, "doc_id")), "near-rarest")
    # Of shingles that the same texts have, one is enough.
    same = [F.bit_xor(F.xxhash64("b", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    groups = tokens.groupBy("key").agg(F.count("*").alias("n"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.min("b").alias("least"), *same).filter("lo < hi")
    groups = written(groups.groupBy("n", "h0", "h1").agg(F.min("key").alias("key"), F.first("least").alias("least")).select("key", "least"), "near-groups")
    rest = written(tokens.join(groups, "key"), "near-rest")
    meet = rest.filter("least < b").select(F.col("least").alias("a"), "b").distinct()
    component = classes(meet).withColumnRenamed("doc_id", "b").withColumnRenamed("class_id", "component")
    placed = rest.join(component, "b")
    whole = placed.select(F.col("component").alias("key"), "b", "class_id", "size").distinct()
    sizes = whole.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    large = written(sizes.filter(F.col("blocks") > WHOLE).select("key"), "near-large")
    small = written(whole.join(large, "key", "left_anti"), "near-whole")
    by_shingle = placed.join(large.select(F.col("key").alias("component")), "component", "left_semi").select("key", "b", "class_id", "size")
    parts = small.withColumn("key", F.xxhash64("key", F.lit("whole"))).unionByName(by_shingle)
    parts = written(parts.join(parts.groupBy("key").agg(F.count("*").alias("texts")), "key"), "near-parts")
    few = parts.filter(F.col("texts") <= FEW).select("key", F.col("b").alias("x"), F.col("class_id").alias("cx"))
    other = few.select("key", F.col("x").alias("y"), F.col("cx").alias("cy"))
    pairs = few.join(other, "key").filter("x < y and cx <> cy").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    found = _verified(pairs, bags)
    more = written(_joining(parts.filter(F.col("texts") > FEW), bags), "near-links")
    for table in (buckets, held, bags, of, keys, open_, tokens, groups, rest, component, large, small, parts):
        dropped(table)
    every = classes(star.union(found).union(more))
    for table in (joined, star, found, more):
        dropped(table)
    return every


def _commonness(bags: DataFrame) -> np.ndarray:
    """How often shingles occur in the bags, counted in COUNTERS counters that shingles share by hash: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for blob in batch.column("bag").to_pylist():
                np.add.at(total, (_unpacked(blob)[0] % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some), "n": pa.array(total[some])})

    found = bags.mapInArrow(tidy(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _rarest(bags: DataFrame) -> DataFrame:
    """(doc_id, class_id, bag) -> (key, b, class_id, size): as many of each bag's rarest shingles as similar bags must share one of.

    A shingle of count c stands for c of count 1. Of w in all, a bag shares 0.8 w or more with a similar one, so one of the first
    w - 0.8 w + 1, in an order that is the same for all bags: by commonness, then by hash.
    """
    common = bags.sparkSession.sparkContext.broadcast(_commonness(bags))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, got = batch.column("bag").to_pylist(), []
            for blob in blobs:
                shingle, count = _unpacked(blob)
                order = np.lexsort((shingle, common.value[(shingle % np.uint64(COUNTERS)).astype(np.int64)]))
                each = np.ones(len(shingle), np.int64) if count is None else count[order]
                w = int(each.sum())
                first = w - int(np.ceil(SIMILAR * w - 1e-6)) + 1
                # Those of the first places, by shingle and how many of it came before.
                take = min(len(order), first)
                n = np.minimum(each[:take], np.maximum(first - (np.cumsum(each[:take]) - each[:take]), 0))
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                got.append(mixed(np.repeat(shingle[order[:take]], n) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
            sizes = list(map(len, got))
            cols = [pa.array(np.concatenate([np.empty(0, np.int64), *got])), pa.array(np.repeat(batch.column("doc_id").to_numpy(), sizes)), pa.array(np.repeat(batch.column("class_id").to_numpy(), sizes)), pa.array(np.repeat(list(map(len, blobs)), sizes), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "b", "class_id", "size"])

    return bags.select("doc_id", "class_id", "bag").mapInArrow(tidy(rarest), "key long, b long, class_id long, size long")


def _joining(rest: DataFrame, bags: DataFrame) -> DataFrame:
    """(key, b, class_id, size) -> (a, b): links that join classes, from all pairs of different classes within each group of one key.

    A group's members are dealt to blocks of about BLOCK texts and BLOCK_BYTES bytes; a task compares a pair of blocks and returns only
    links that join classes.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    sized = dealt.join(bags.select(F.col("doc_id").alias("b"), "bag"), "b")
    own = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = own.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "b", "class_id", "bag")

    def compare(table: pa.Table) -> pa.Table:
        ids, labels, block = (np.asarray(table.column(c)) for c in ("b", "class_id", "block"))
        order = np.argsort(ids)
        ids, labels, block = ids[order], labels[order], block[order]
        unpacked = [_unpacked(x) for x in table.column("bag").take(pa.array(order)).to_pylist()]
        shared, weight = overlaps(unpacked)
        total = weight[:, None] + weight[None, :]
        near = (shared >= SIMILAR * (total - shared)) & (labels[:, None] != labels[None, :])
        if table.column("lo")[0] != table.column("hi")[0]:
            near &= block[:, None] != block[None, :]
        label = {c: c for c in labels.tolist()}

        def top(c: int) -> int:
            while label[c] != c:
                label[c] = c = label[label[c]]
            return c

        out = []
        for i, j in np.argwhere(np.triu(near, 1)).tolist():
            x, y = top(int(labels[i])), top(int(labels[j]))
            if x != y:
                label[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


def overlaps(bags: list[tuple[np.ndarray, np.ndarray | None]], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the lesser counts of all pairs of bags, each bag's own sum). A shingle of count c stands for c of count 1."""
    n = len(bags)
    size = [len(x) for x, _ in bags]
    shingle = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in bags)])
    count = np.concatenate([np.empty(0, np.int64), *(np.ones(len(x), np.int64) if c is None else c for x, c in bags)])
    of = np.repeat(np.arange(n), size)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    key, of = np.repeat(shingle, count), np.repeat(of, count)
    key = mixed(key + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weight = np.bincount(of, minlength=n)
    _, place, often = np.unique(key, return_inverse=True, return_counts=True)
    # A shingle of one text overlaps with none.
    place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[place]
    of, place = of[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    shared = np.zeros((n, n), np.float32)
    width = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, width, columns):
        lo, hi = np.searchsorted(place, [start, start + columns])
        x = np.zeros((n, min(columns, width - start)), np.float32)
        x[of[lo:hi], place[lo:hi] - start] = 1
        shared += x @ x.T
    np.fill_diagonal(shared, weight)
    return shared.astype(np.int64), weight


def classes(edges: DataFrame) -> DataFrame:
    """(a, b) -> (doc_id, class_id) for all documents with a link: the least document it is linked to over any path.

    Each round a document takes the least label among itself and its neighbours, then its label's label, so labels run along
    paths in ever longer steps. Neighbours' labels are partly aggregated before they meet.
    """
    both = written(edges.union(edges.select("b", "a")).toDF("a", "b"), "class-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "class-labels")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, "a").select("a", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        after = written(taken.join(jump, "next", "left").select("a", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "class-labels")
        still = not after.filter("moved").isEmpty()
        dropped(labels)
        labels = after.select("a", "label")
        if not still:
            dropped(both)
            return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row a document: doc_id, class_id (the least doc_id of its class), copy_of (the least doc_id of the same words).

    Documents of the same words in the same order are copies; copies are told by a 128-bit digest and only the first of each set goes on. Texts
    whose weighted Jaccard similarity over bags of five-word shingles is SIMILAR or more are linked, and a class is all that
    links join. Candidates come from BagMinHash bands; every link is verified on the whole bags.

    A null text, and one without words, is like no other: a class of its own. Texts of one to four words are alike
    only as copies. Rows without a doc_id get none of the three. Rows of one doc_id are one document; if their texts
    differ, the one of the least digest counts. An empty table gives an empty result. Other columns are not read.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(sketched(some), "near-sketches")
    own = sketches.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("digest", "bands")).alias("s")).select("doc_id", "s.*")
    own = written(own, "near-own")
    real = own.filter(F.length("digest") > 0)
    # Written, so that the joins below deal both sides anew and a digest of very many copies can be split.
    firsts = written(real.groupBy("digest").agg(F.min("doc_id").alias("copy_of")), "near-firsts")
    copies = written(own.join(firsts, "digest", "left").select("doc_id", "digest", F.coalesce("copy_of", "doc_id").alias("copy_of")), "near-copies")
    members = written(own.join(firsts, (own["doc_id"] == firsts["copy_of"]) & (own["digest"] == firsts["digest"])).select("doc_id", "bands"), "near-members")
    dropped(sketches)
    dropped(own)
    texts = some.filter("doc_id is not null and text is not null").join(members.select("doc_id"), "doc_id", "left_semi")
    found = linked(members, texts).withColumnRenamed("doc_id", "copy_of")
    dropped(members)
    dropped(firsts)
    return copies.join(found, "copy_of", "left").select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The first document of each class; the columns stay, whatever their names.

    Rows without a doc_id stay. Of rows that agree in doc_id and text one stays. Rows of one doc_id with different texts are documents of
    their own: that of the least hash has the doc_id, the others come after all doc_ids below 1 << 62 in the order that tells which is first.
    Null texts and texts without words are like no others, and stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.filter("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    again = written(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("hash").alias("least")).filter("n > 1").select(F.col("doc_id").alias("id"), "least"), "near-repeated")
    if again.isEmpty():
        each = rows.select("row", "doc_id", "text")
    else:
        told = rows.join(again, F.col("doc_id") == F.col("id"), "left")
        once = told.filter("id is not null").groupBy("doc_id", "hash", "least").agg(F.first("row").alias("row"), F.first("text").alias("text"))
        late = F.shiftrightunsigned(F.xxhash64("doc_id", "hash"), 2) + F.lit(1 << 62)
        own = once.select("row", F.when(F.col("hash") == F.col("least"), F.col("doc_id")).otherwise(late).alias("doc_id"), "text")
        each = written(told.filter("id is null").select("row", "doc_id", "text").unionAll(own), "near-rows")
    firsts = near_duplicates(each).filter("doc_id = class_id").select("doc_id")
    return each.join(firsts, "doc_id", "left_semi").select("row.*").unionByName(docs.filter("doc_id is null"))
