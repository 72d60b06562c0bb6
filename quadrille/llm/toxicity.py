"""Toxicity: a learned lexicon, matched with misspellings, weighed by context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_words, tidy, worker_cache, written

#: Labels are learned from so many rows at most, those of the smallest hash of doc_id; the only bound on what is learned from.
TRAIN_ROWS = 20_000
#: A term is learned if so many toxic training texts have it that no better term explains, or this share of all of them has it,
#: and this share at least of the texts with it is toxic; and if no more than so many terms would be in as many by chance.
LEAST, SHARE, PURE, CHANCE = 2, 0.05, 0.9, 0.5
#: Parts of the training rows, by crc32 of doc_id mod 4, that by_folds() leaves out in turn; 2 are the held-out rows.
FOLDS = (0, 1, 3)
#: What a misspelt term counts before labels say more, as a share of a term.
MISSPELT = 0.8
#: Lengths of word beginnings that may become terms.
STEMS = range(4, 11)
#: Misspellings: one edit in terms of this length or more, two in those of the second.
ONE_EDIT, TWO_EDITS = 5, 10
#: Words on either side of a term that are looked at for quotation marks.
CONTEXT = 12
#: At this score a document is predicted toxic.
THRESHOLD = 0.3
#: Words whose class a worker remembers, and states of the automaton that it keeps.
KNOWN, STATES = 100_000, 50_000
OPEN, CLOSE, BOTH = "“«„‹", "”»‟›", '"'
_RUN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """What may be a term; by_folds() compares settings."""

    least: int = LEAST
    pure: float = PURE
    stems: range = STEMS


class Trie:
    """Terms as a trie, intersected with Levenshtein automata of up to two edits.

    A position is (node, edits) while a word is read; the set of positions is the state of a deterministic automaton, whose
    transitions are made when first needed and kept. Most words leave the automaton after a few letters. An edit is
    an insertion, a deletion, a change or a swap of neighbours. Stems match any word that begins with them, without edits.
    """

    def __init__(self, words: set[str], stems: set[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word_edits, self.stem, self.room = [-1], [False], [0]
        for term, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            edits = 0 if is_stem or len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2
            node = 0
            self.room[0] = max(self.room[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word_edits.append(-1)
                    self.stem.append(False)
                    self.room.append(0)
                node = self.next[node][c]
                self.room[node] = max(self.room[node], edits)
            if is_stem:
                self.stem[node] = True
            else:
                self.word_edits[node] = max(self.word_edits[node], edits)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, positions: set[tuple[int, int, str]]) -> int:
        todo, closed = list(positions), set()
        while todo:
            node, edits, swap = p = todo.pop()
            if p in closed or edits > self.room[node]:
                continue
            closed.add(p)
            if not swap:  # a letter of the term is left out
                todo += [(child, edits + 1, "") for child in self.next[node].values()]
        least: dict[tuple[int, str], int] = {}
        for node, edits, swap in closed:
            least[node, swap] = min(edits, least.get((node, swap), edits))
        found = frozenset((node, edits, swap) for (node, swap), edits in least.items())
        if found not in self.states:
            self.states[found] = len(self.members)
            self.members.append(found)
            self.moves.append({})
            done = [e for n, e, s in found if not s and e <= self.word_edits[n]]
            stem = any(self.stem[n] and not e and not s for n, e, s in found)
            self.ends.append(-1 if not found else 3 if stem else 1 if 0 in done else 2 if done else 0)
        return self.states[found]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, edits, swap in self.members[state]:
            if swap:
                if c == swap:
                    out.add((node, edits, ""))
                continue
            out.add((node, edits + 1, ""))
            for d, child in self.next[node].items():
                out.add((child, edits + (d != c), ""))
                if c != d and c in self.next[child]:
                    out.add((self.next[child][c], edits + 1, d))
        self.moves[state][c] = found = self._state(out)
        return found

    def match(self, word: str) -> int:
        """0 none, 1 a term or stem, 2 a misspelt term."""
        state, moves, ends = self.start, self.moves, self.ends
        for c in word:
            after = moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if ends[state] == -1:
                return 0
            if ends[state] == 3:
                return 1
        return max(0, ends[state])


def runs(word: str) -> list[str]:
    """The letter and digit runs of a word in lower case, and the word without its other characters if it has several."""
    found = _RUN.findall(word.lower())
    return found if len(found) < 2 else [*found, "".join(found)]


@dataclass
class Model:
    words: set[str]
    stems: set[str]
    #: Words near a term that clean training texts have.
    innocent: set[str] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))

    def held(self) -> tuple[Trie, dict[bytes, int]]:
        """The trie and the words classed so far. A worker keeps those of one model, over all its tasks."""
        cache, key = worker_cache("toxicity"), hash((frozenset(self.words), frozenset(self.stems), frozenset(self.innocent)))
        if key not in cache or len(cache[key][0].members) > STATES:
            cache.clear()
            cache[key] = Trie(self.words, self.stems), {}
        return cache[key]

    def word_classes(self, words: list[bytes]) -> list[int]:
        """0 none, 1 a term, 2 a misspelt term, for each word."""
        trie, known = self.held()
        if len(known) > KNOWN:
            known.clear()
        out = []
        for word in words:
            found = known.get(word)
            if found is None:
                classes = [0 if (c := trie.match(r)) == 2 and r in self.innocent else c for r in runs(word.decode())]
                found = known[word] = 1 if 1 in classes else max(classes, default=0)
            out.append(found)
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: terms, misspelt terms and quoted ones, as counts (logarithm) and as present; and a constant."""
        starts, codes, words = text_words(texts)
        each = words.to_pylist()
        kind = np.array(self.word_classes(each), np.int64)
        hits = np.flatnonzero(kind[codes]) if len(codes) else np.empty(0, np.int64)
        owner = np.searchsorted(starts, hits, "right") - 1
        counts = np.zeros((len(starts) - 1, 3))
        for at, doc in zip(hits.tolist(), owner.tolist()):
            word = lambda i: each[codes[i]].decode()
            left = "".join(map(word, range(max(starts[doc], at - CONTEXT), at)))
            right = "".join(map(word, range(at + 1, min(starts[doc + 1], at + 1 + CONTEXT))))
            counts[doc, 2 if quoted(left, word(at), right) else kind[codes[at]] - 1] += 1
        return np.hstack([np.ones((len(counts), 1)), np.log1p(counts), counts > 0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def quoted(left: str, word: str, right: str) -> bool:
    """Whether a quotation that is open before the word, or opens at its start, closes after it within the context."""
    stem = word.rstrip(OPEN + CLOSE + BOTH + ".,;:!?")
    before, after = left + word[: len(word) - len(word.lstrip(OPEN + CLOSE + BOTH + "("))], word[len(stem) :] + right
    if before.count(BOTH) % 2 and BOTH in after:
        return True
    opened = max(map(before.rfind, OPEN)) > max(map(before.rfind, CLOSE))
    return opened and any(c in after for c in CLOSE)


def _part(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_part(doc_id) == 2, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): at most `rows` labelled texts that aren't held out, each distinct text once."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")
    return written(found.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxicity-train")


def _term_counts(train: DataFrame, lengths: range) -> DataFrame:
    """(term, stem, bad, clean): how many toxic and clean training texts have a word, or a word that begins so."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen: Counter = Counter()
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    words = set(_RUN.findall(text.lower()))
                    seen.update((w, False, bool(toxic)) for w in words)
                    seen.update((s, True, bool(toxic)) for s in {w[:n] for w in words for n in lengths if len(w) >= n})
                terms, stems, toxics = zip(*seen) if seen else ((), (), ())
                n = np.fromiter(seen.values(), np.int64, len(seen))
                bad = np.array(toxics, bool)
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "stem": pa.array(stems, pa.bool_()), "bad": pa.array(np.where(bad, n, 0)), "clean": pa.array(np.where(bad, 0, n))})

    return train.mapInArrow(tidy(count), "term string, stem boolean, bad long, clean long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))


def learned(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, settings: Settings = Settings()) -> Model:
    """Lexicon and weights from labelled texts. Of repeated label rows of one id the larger label counts.

    Words and word beginnings that toxic texts have and clean ones don't become terms. Words of clean texts near a term are
    remembered as innocent. A logistic regression on the counts of
    terms, misspelt terms and quoted terms gives the weights. What reaches the driver is bounded by train_rows: terms that are
    frequent in the sample, and seven numbers for each of its texts. Without labels nothing is learned and all scores are alike.
    """
    train = _training(docs, labels, train_rows)
    total = {bool(r["toxic"]): r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, clean = total.get(True, 0), total.get(False, 0)
    texts = F.col("bad") + F.col("clean")
    counts = written(_term_counts(train, settings.stems).filter(texts >= settings.least), "toxicity-terms") if bad and clean else None
    least = _least({r["n"]: r["count"] for r in counts.groupBy(texts.alias("n")).count().collect()}, bad / (bad + clean), settings.least) if counts else settings.least
    found = counts.filter((F.col("bad") >= least) & (F.col("bad") / texts >= settings.pure)).collect() if counts else []
    words, stems = _chosen({(r["term"], r["stem"]): r["bad"] for r in found if r["stem"] or len(r["term"]) > 2}, train, bad, settings)
    model = Model(words, stems)
    if not words and not stems:
        model.weights[0] = -3.0
        return model
    near = Model(words, stems)
    # Words near a term in clean texts are innocent. The weights are fitted on other clean texts than those these words
    # are from, so that they tell how often an unknown clean word is near a term.
    other = F.pmod(F.xxhash64("text"), F.lit(2)) == 1

    def innocent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                each, (trie, _) = text_words(part.column("text"))[2].to_pylist(), near.held()
                got = {r for w, c in zip(each, near.word_classes(each)) if c == 2 for r in runs(w.decode()) if trie.match(r) == 2}
                yield pa.RecordBatch.from_pydict({"word": pa.array(sorted(got), pa.string())})

    clean_texts = train.filter("toxic = 0")
    words_of = lambda texts: {r["word"] for r in texts.select("text").mapInArrow(tidy(innocent), "word string").distinct().collect()}
    half = words_of(clean_texts.filter(~other))
    tried = Model(words, stems, half)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = tried.features(part.column("text"))
                yield pa.RecordBatch.from_pydict({"y": part.column("toxic").cast(pa.int32())} | {f"x{i}": pa.array(x[:, i]) for i in range(x.shape[1])})

    names = [f"x{i}" for i in range(7)]
    seen = train.filter((F.col("toxic") > 0) | other).mapInArrow(tidy(features), "y int, " + ", ".join(f"{n} double" for n in names)).groupBy("y", *names).count().toPandas()
    # Each clean text of the half that is used stands for two.
    toxic = (seen["y"] > 0).to_numpy()
    model.weights = _fit(seen[names].to_numpy(), toxic.astype(float), seen["count"].to_numpy() * np.where(toxic, 1.0, 2.0))
    model.innocent = half | words_of(clean_texts.filter(other))
    return model


def by_folds(docs: DataFrame, labels: DataFrame, settings: list[Settings], train_rows: int = TRAIN_ROWS) -> list[dict]:
    """How well each setting tells the labels of training rows that it has not seen; held-out rows take no part.

    One dict a setting: setting, rows, log_loss (mean), found (toxic and predicted), false (clean and predicted), missed.
    Each of FOLDS is left out in turn: what is learned from the others scores it. Labels of null ids, and null labels, take
    no part; of repeated label rows of one id the larger counts.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = []
    for setting in settings:
        sums = dict.fromkeys(("rows", "log_loss", "found", "false", "missed"), 0.0)
        for fold in FOLDS:
            model = learned(docs, known.filter(_part(F.col("doc_id")) != fold), train_rows, setting)
            asked = docs.select("doc_id", "text").join(known.filter(_part(F.col("doc_id")) == fold), "doc_id")
            p, toxic, said = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6)), F.col("toxic") > 0, F.col("predicted") > 0
            got = scored(asked, model).agg(
                F.count("*").alias("rows"), F.sum(-F.log(F.when(toxic, p).otherwise(1 - p))).alias("log_loss"), F.count_if(toxic & said).alias("found"), F.count_if(~toxic & said).alias("false"), F.count_if(toxic & ~said).alias("missed")
            ).first()
            sums = {k: v + (got[k] or 0) for k, v in sums.items()}
        out.append({"setting": setting} | sums | {"log_loss": sums["log_loss"] / max(1.0, sums["rows"])})
    return out


def _least(terms: dict[int, int], rate: float, least: int = LEAST) -> int:
    """So many toxic texts must have a term that less than CHANCE terms are in as many and in no other text by chance.

    terms: how many terms are in n texts, for each n; rate: the share of texts that are toxic.
    """
    by_chance = 0.0
    for n in sorted(terms, reverse=True):
        by_chance += terms[n] * rate**n
        if by_chance > CHANCE:
            return max(least, n + 1)
    return least


def _chosen(uses: dict[tuple[str, bool], int], train: DataFrame, bad: int, settings: Settings = Settings()) -> tuple[set[str], set[str]]:
    """(words, stems) out of the candidates with the number of toxic training texts that have them.

    Of a stem and a longer one, or a word, in nearly as many texts the longer is meant. Then the term is taken, again and again,
    that most toxic texts without a taken term have; frequent terms are taken in any case. So words that only copies of a
    few texts share are left out. Candidate words that begin with a taken stem stay, for stems match without edits and words with them.
    """
    lengths, least = settings.stems, settings.least
    near = lambda n, most: n >= 0.95 * most
    longer: dict[str, int] = {}
    for (term, stem), n in uses.items():
        for k in lengths:
            if k < len(term) or (k == len(term) and not stem):
                longer[term[:k]] = max(n, longer.get(term[:k], 0))
    uses = {t: n for t, n in uses.items() if not t[1] or not near(longer.get(t[0], 0), n)}
    words = {t for t, stem in uses if not stem}
    stems = {t for t, stem in uses if stem}

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                runs = set(_RUN.findall(text.lower()))
                got = sorted(runs & words) + sorted({f"{r[:k]}*" for r in runs for k in lengths if r[:k] in stems})
                yield pa.RecordBatch.from_pydict({"terms": pa.array([got], pa.list_(pa.string()))})

    texts = [set(r["terms"]) for r in train.filter("toxic > 0").select("text").mapInArrow(tidy(having), "terms array<string>").collect()] if uses else []
    name = lambda t: f"{t[0]}*" if t[1] else t[0]
    total = {name(t): n for t, n in uses.items()}
    taken = {t for t, n in total.items() if n >= max(least + 1, SHARE * bad)}
    left = [t for t in texts if not t & taken]
    while left:
        counts = Counter(term for t in left for term in t)
        # Ties go to the term with more uses, then to the shorter, a stem.
        term, gain = max(counts.items(), key=lambda x: (x[1], total[x[0]], -len(x[0]), x[0]), default=("", 0))
        if gain < least:
            break
        taken.add(term)
        left = [t for t in left if term not in t]
    got = {t[:-1] for t in taken if t.endswith("*")}
    got = {s for s in got if not any(s != t and s.startswith(t) for t in got)}
    return {t for t in taken if not t.endswith("*")} | {w for w in words if any(w.startswith(s) for s in got)}, got


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.3, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; n is how often each row counts.

    A ridge holds the weights of terms and quoted terms near 0, and those of misspelt terms near MISSPELT times those of terms.
    No weight is below 0.
    """
    x = x.copy()
    x[:, 1] += MISSPELT * x[:, 2]
    x[:, 4] += MISSPELT * x[:, 5]
    w = np.zeros(x.shape[1])
    held = np.where(np.arange(len(w)) > 0, ridge, 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(held)
        step = np.linalg.solve(hess, x.T @ (n * (y - p)) - held * w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    w[2] += MISSPELT * w[1]
    w[5] += MISSPELT * w[4]
    w[1:] = np.maximum(w[1:], 0)
    return w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with score (0 to 1) and predicted (1 from THRESHOLD on) after their columns.

    A null or empty text has the score of a text without terms. Texts are read whole; rows are scored one by one, so nulls
    elsewhere, repeated rows and empty tables need no rule. Columns of docs named like the new ones are replaced.
    """
    held = [c for c in docs.columns if c not in ("score", "predicted")]
    kept = docs.select(*held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(pc.fill_null(part.column("text"), "")), pa.float64())], [*part.schema.names, "score"])

    schema = kept.withColumn("score", F.lit(0.0)).schema
    return kept.mapInArrow(tidy(score), schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic; their columns stay, whatever their names. Null and empty texts are as in scored()."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    kept = scored(docs.select(others, "text"), model).filter("predicted = 0")
    return kept.select(*("text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
