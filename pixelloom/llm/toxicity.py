"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of the examples is a term. Its weight in a text is (1 + log of its count) times its inverse document frequency
over all documents, times its relevance: 1, and more the less its rows among the examples agree with the classes' shares
by chance. Beginnings of words are terms where they are significant for label 1, as endings vary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.sums import summed
from pixelloom.llm.tables import free_shuffles, keep
from pixelloom.llm.words import Words, crc_mod, mix, slices

#: At most so many labelled rows of each class (those of the smallest hashed ids) are examples.
EXAMPLES = 2500
#: Vectors in a block of the index; neighbours that vote; texts whose scores are multiplied out together.
BLOCK, NEIGHBOURS, TOGETHER = 64, 12, 64
#: Terms in more than this share of the entries are a dense matrix: their postings would be nearly all entries.
DENSE = 1 / 16
#: Weight of a constant term that every vector has, so that texts without terms are near one another.
CONSTANT = 1.5
#: The likelihood ratio that chance may give a term; beyond it the root of the excess is added to the relevance.
CHANCE = 8.0
#: A beginning counts as significant from this likelihood ratio and odds ratio for label 1, in so many examples.
MIN_G, MIN_ODDS, MIN_ROWS = 22.0, 8.0, 4
#: Bytes of text taken together, and scores of equal vectors that a task remembers.
SLICE, KNOWN = 1 << 20, 8192
FOLDS, HELD_OUT = 5, 0
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]"]] = True
_U = np.uint64


def word_hashes(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words without punctuation at their ends, where any is left: hashes, texts, first bytes and ends."""
    start, end, doc = w.start.copy(), w.end.copy(), w.doc
    while (cut := (end > start) & _EDGE[w.data[end - 1]]).any():
        end[cut] -= 1
    while (cut := (end > start) & _EDGE[w.data[start]]).any():
        start[cut] += 1
    real = end > start
    start, end, doc = start[real], end[real], doc[real]
    return w.span_hashes(start, end), doc, start, end


def beginnings(w: Words, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of the first 4, 5 and 6 bytes of words."""
    hashes, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for n in (4, 5, 6):
        long = end - start >= n
        hashes.append(mix(w.span_hashes(start[long], start[long] + n) + _U(n)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


class Lookup:
    """Places of 64-bit keys in a sorted array, by way of a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(keys >> _U(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are keys, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(h >> _U(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[place] == h[at]
        return at[good], place[good]


class Space:
    """The terms: all words of the examples (in order of hash), then the significant beginnings."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts = words, starts
        self.size = len(words) + len(starts)
        self._look = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "starts": self.starts, "size": self.size, "_look": None}

    def counted(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of all texts, text after text, ascending in each; how often each occurs; each text's range."""
        if self._look is None:
            self._look = Lookup(self.words), Lookup(self.starts)
        h, doc, start, end = word_hashes(w)
        at, place = self._look[0].find(h)
        pair = doc[at] * self.size + place
        if len(self.starts):
            h, own = beginnings(w, start, end, doc)
            at, place = self._look[1].find(h)
            pair = np.concatenate([pair, own[at] * self.size + place + len(self.words)])
        pair, n = np.unique(pair, return_counts=True)
        doc, term = np.divmod(pair, max(1, self.size))
        return term, n, np.searchsorted(doc, np.arange(len(w) + 1))


def vector_key(terms: np.ndarray, counts: np.ndarray) -> bytes:
    return np.asarray(terms, np.int64).tobytes() + np.asarray(counts, np.int64).tobytes()


@dataclass
class Index:
    """Distinct example vectors with their votes, as an inverted index in blocks.

    Vectors of equal terms are one entry with the votes of all, so ties among copies have no order.
    """

    weights: np.ndarray  # of each term
    column: np.ndarray  # of each term: its row in the dense matrix, or -1
    dense: np.ndarray  # [frequent term, entry]
    entry: np.ndarray  # of each posting of the other terms, by term, ascending
    weight: np.ndarray
    cells: np.ndarray  # of each term: its first cell (term and block with postings)
    block: np.ndarray  # of each cell
    first: np.ndarray  # of each cell: its first posting
    most: np.ndarray  # of each cell: its largest weight
    constant: np.ndarray  # weight of the constant term of each entry
    toxic: np.ndarray
    votes: np.ndarray
    ids: list
    curve: tuple[np.ndarray, np.ndarray]
    prior: float

    @staticmethod
    def vector(terms, counts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.maximum(np.asarray(counts, np.float64), 1))) * weights[t]
        norm = float(np.sqrt(w @ w + CONSTANT**2))
        return t, w / norm, CONSTANT / norm

    @classmethod
    def build(cls, weights: np.ndarray, examples: list[tuple], stands: tuple[float, float] = (1.0, 1.0)) -> Index:
        """examples: terms, counts, label, id. stands: what an example of label 0 and of label 1 stands for."""
        groups: dict[bytes, list] = {}
        for terms, counts, label, ident in examples:
            g = groups.setdefault(vector_key(terms, counts), [terms, counts, 0.0, 0.0, ident])
            g[2] += label * stands[1]
            g[3] += stands[label]
        order = [groups[k] for k in sorted(groups)]
        n, blocks = len(order), max(1, -(-len(order) // BLOCK))
        rows, cols, vals, const = [], [], [], np.zeros(n)
        for i, (terms, counts, *_) in enumerate(order):
            t, w, const[i] = cls.vector(terms, counts, weights)
            rows.append(t), cols.append(np.full(len(t), i)), vals.append(w)
        term, entry, weight = (np.concatenate([np.zeros(0, d), *x]) for x, d in ((rows, np.int64), (cols, np.int64), (vals, np.float64)))
        del rows, cols, vals
        often = np.bincount(term, minlength=len(weights)) > max(DENSE * n, BLOCK)
        column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        dense = np.zeros((int(often.sum()), n))
        on = often[term]
        dense[column[term[on]], entry[on]] = weight[on]
        term, entry, weight = term[~on], entry[~on], weight[~on]
        at = np.lexsort((entry, term))
        term, entry, weight = term[at], entry[at], weight[at]
        cell = term * blocks + entry // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        toxic, votes = (np.array([g[i] for g in order], np.float64) for i in (2, 3))
        return cls(
            weights, column, dense, entry.astype(np.int32), weight, np.searchsorted(term[first], np.arange(len(weights) + 1)), (cell[first] % blocks).astype(np.int32), np.append(first, len(entry)), most,
            const, toxic, votes, [g[4] for g in order], (np.array([0.0, 1.0]), np.array([0.0, 1.0])), float(toxic.sum() / max(1.0, votes.sum())),
        )

    def nearest(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entries and their exact cosines."""
        return next(self.nearest_of([(terms, counts)]))

    def nearest_of(self, texts: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest entries and their exact cosines of each text (terms, counts).

        The constant and the frequent terms give every entry a part of its cosine, the k-th best of which no neighbour is
        below. Blocks whose best part and largest weights can't reach it are skipped; the others' postings are added.
        """
        n = len(self.constant)
        blocks, k = max(1, -(-n // BLOCK)), min(NEIGHBOURS, n)
        for at in range(0, len(texts), TOGETHER):
            made = [self.vector(t, c, self.weights) for t, c in texts[at : at + TOGETHER]]
            head = np.zeros((len(made), len(self.dense)))
            for i, (t, w, _) in enumerate(made):
                on = self.column[t] >= 0
                head[i, self.column[t[on]]] = w[on]
            parts = head @ self.dense + np.array([c for _, _, c in made])[:, None] * self.constant
            for (t, w, _), score in zip(made, parts, strict=True):
                rare = self.column[t] < 0
                t, w = t[rare], w[rare]  # noqa: PLW2901
                size = self.cells[t + 1] - self.cells[t]
                floor = float(np.partition(score, n - k)[n - k])
                if size.sum():
                    cell = np.repeat(self.cells[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                    weight, block = np.repeat(w, size), self.block[cell]
                    top = np.full(blocks * BLOCK, -1.0)
                    top[:n] = score
                    bound = top.reshape(blocks, BLOCK).max(axis=1) + np.bincount(block, weights=weight * self.most[cell], minlength=blocks)
                    on = (bound > floor - 1e-12)[block]
                    if on.any():
                        cell, weight = cell[on], weight[on]
                        first, long = self.first[cell], self.first[cell + 1] - self.first[cell]
                        posting = np.repeat(first - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(int(long.sum()))
                        score += np.bincount(self.entry[posting], weights=self.weight[posting] * np.repeat(weight, long), minlength=n)
                        floor = float(np.partition(score, n - k)[n - k])
                # the best few first, by rounded cosine and then place
                few = np.flatnonzero(score >= floor - 1e-9)
                best = few[np.lexsort((few, -np.round(score[few], 12)))][:NEIGHBOURS]
                yield best, score[best]

    def raw(self, best: np.ndarray, cos: np.ndarray, label: int | None = None, stands: float = 0.0) -> float:
        """Distance-weighted share of toxic votes, drawn a little to the examples' share.

        label: that of an example whose own vote, which stands for so much in the nearest entry, is left out.
        """
        closeness = 1.0 / (0.02 + np.maximum(0.0, 1.0 - cos))
        toxic, votes = self.toxic[best].copy(), self.votes[best].copy()
        if label is not None:
            toxic[0] -= label * stands
            votes[0] -= stands
        toxic, votes = np.maximum(toxic, 0), np.maximum(votes, 0)
        scale = np.sqrt(votes) / np.maximum(votes, 1)  # many copies count, but not in proportion
        return float((closeness * scale * toxic).sum() + 0.5 * self.prior) / float((closeness * scale * votes).sum() + 0.5)

    def calibrated(self, seen: list[tuple[float, float, float]]) -> Index:
        """With the isotonic regression of labels on raw scores (raw, label, weight)."""
        if not seen:
            return self
        pools: list[list[float]] = []
        for x, y, w in sorted(seen):
            pools.append([x * w, y * w, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        # rows of one vote on either side keep the curve from reaching 0 and 1 outright
        return replace(self, curve=(np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.02 * self.prior) / (p[2] + 0.02) for p in pools])))

    def scores(self, texts: list[tuple]) -> list[tuple[float, list]]:
        """Each text's calibrated score and the ids of its three nearest entries."""
        if not len(self.constant):
            return [(0.0, [])] * len(texts)
        return [(float(np.clip(np.interp(self.raw(best, cos), *self.curve), 0.0, 1.0)), [self.ids[i] for i in best[:3]]) for best, cos in self.nearest_of(texts)]


def relevance(toxic: np.ndarray, n: np.ndarray, all_toxic: int, total: int) -> np.ndarray:
    """1, and the root of what the likelihood ratio of a term's rows against the classes' shares exceeds chance by.

    toxic, n: the term's rows of label 1, and all of its rows, among the examples.
    """
    p = all_toxic / max(1, total)
    part = lambda x, mean: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(mean, 1e-300)), 0.0)
    rest = total - n
    g = 2 * (part(toxic, n * p) + part(n - toxic, n * (1 - p)) + part(all_toxic - toxic, rest * p) + part(rest - (all_toxic - toxic), rest * (1 - p)))
    return 1 + np.sqrt(np.maximum(g - CHANCE, 0))


def _tallied(sample: DataFrame) -> DataFrame:
    """(term, start: 0 for a word and 1 for a beginning, toxic, n): the examples that hold each term."""

    def added(key: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        terms, inverse = np.unique(key, return_inverse=True)
        return terms, np.bincount(inverse, weights=toxic, minlength=len(terms)), np.bincount(inverse, weights=n, minlength=len(terms))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        for b in slices(batches, "text", SLICE):
            label = np.asarray(b.column(1)).astype(np.int64)
            w = Words(b.column(2), lower=True)
            h, doc, start, end = word_hashes(w)
            for part, (h, doc) in zip(parts, ((h, doc), beginnings(w, start, end, doc)), strict=True):  # noqa: B020, PLW2901
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                part.append(added(h[new], label[doc[new]], np.ones(int(new.sum()))))
        for kind, part in enumerate(parts):
            if part:
                terms, toxic, n = added(*(np.concatenate(x) for x in zip(*part, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), kind, np.int32)), pa.array(toxic.astype(np.int64)), pa.array(n.astype(np.int64))], names=["term", "start", "toxic", "n"])

    return sample.mapInArrow(tally, "term long, start int, toxic long, n long").groupBy("term", "start").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str):
    """A function that gives a task its Scorer. The index travels once, for calibration and for scoring."""
    spark, key = docs.sparkSession, F.col(id_col)
    usable = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & (F.crc32(key.cast("string")) % FOLDS != HELD_OUT)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_px_label"))
    usable = keep(usable, "labels")
    sums = [F.coalesce(F.sum("_px_label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_px_label")), F.lit(0))]
    all1, all0 = usable.agg(*sums).first()
    order = (F.xxhash64(F.lit(7), key), key)
    picked = usable.where("_px_label = 1").orderBy(*order).limit(EXAMPLES).unionByName(usable.where("_px_label = 0").orderBy(*order).limit(EXAMPLES))
    picked = picked.select(F.col(id_col).alias("_px_id"), "_px_label")
    # at most 2 * EXAMPLES rows of two numbers
    sample = keep(docs.join(F.broadcast(picked), key == F.col("_px_id")).select(key.alias("_px_id"), "_px_label", F.col(text_col).alias("text")), "examples")
    n1, n0 = sample.agg(*sums).first()
    p, k, n = F.lit(n1 / max(1, n1 + n0)), F.col("toxic"), F.col("n")
    part = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0)
    beyond = 2 * (part(k, n * p) + part(n - k, n * (1 - p))) > MIN_G
    significant = (k >= MIN_ROWS) & (k * (1 - p) > MIN_ODDS * (n - k) * p) & beyond
    got = _tallied(sample).where((F.col("start") == 0) | significant).toArrow() if n1 and n0 else None
    columns = [np.asarray(got[c].combine_chunks()) if got is not None and got.num_rows else np.zeros(0, np.int64) for c in ("term", "start", "toxic", "n")]
    term, start, toxic, n = columns
    term = term.astype(np.int64).view(_U)
    order = np.lexsort((term, start))
    term, start, toxic, n = term[order], start[order], toxic[order], n[order]
    space = Space(term[start == 0], term[start == 1])
    shared = spark.sparkContext.broadcast(space)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(space.size + 1)
        for b in slices(batches, "text", SLICE):
            t, _, at = shared.value.counted(Words(b.column(0), lower=True))
            out[:-1] += np.bincount(t, minlength=space.size)
            out[-1] += len(at) - 1
        return out

    df = summed(docs.select(F.col(text_col).alias("text")), frequencies, space.size + 1) if space.size else np.zeros(1)
    weights = np.log((df[-1] + 1) / (df[:-1] + 1)) * relevance(toxic, n, n1, n1 + n0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            t, c, at = shared.value.counted(Words(b.column(2), lower=True))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (t, c)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["id", "label", "terms", "counts"])

    kind = sample.schema["_px_id"].dataType.simpleString()
    rows = keep(sample.mapInArrow(vectors, f"id {kind}, label int, terms array<int>, counts array<int>"), "vectors")
    del got, columns, term, start, toxic, n, df
    free_shuffles(spark)  # building the index takes the driver's Python most of what it ever has
    table = rows.orderBy("id", "label").toArrow()
    parts = [[np.asarray(x.values) for x in table[c]] for c in ("terms", "counts")]
    stands = all0 / max(1, n0), all1 / max(1, n1)
    index = Index.build(weights, list(zip(*parts, table["label"].to_pylist(), table["id"].to_pylist(), strict=True)), stands)
    known = spark.sparkContext.broadcast((space, index))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = known.value[1]
        for b in batches:
            raw = []
            texts = [(np.asarray(t.values), np.asarray(c.values)) for t, c in zip(b.column(2), b.column(3), strict=True)]
            for label, (best, cos) in zip(b.column(1).to_pylist(), ix.nearest_of(texts), strict=True):
                raw.append(ix.raw(best, cos, label, stands[label]))
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), b.column(1)], names=["raw", "label"])

    # at most 2 * EXAMPLES rows of two numbers
    tasks = 2 * spark.sparkContext.defaultParallelism
    seen = [(r.raw, float(r.label), stands[r.label]) for r in rows.repartition(tasks).mapInArrow(alone, "raw double, label int").collect()]
    curve = index.calibrated(seen).curve
    del index, table, parts, weights
    free_shuffles(spark)
    return lambda: Scorer(known.value[0], replace(known.value[1], curve=curve))


class Scorer:
    """Scores of slices of texts; equal vectors are scored once."""

    def __init__(self, space: Space, index: Index):
        self.space, self.index, self.known = space, index, {}

    def __call__(self, texts: pa.Array) -> list[tuple[float, list]]:
        t, c, at = self.space.counted(Words(texts, lower=True))
        if len(self.known) > KNOWN:
            self.known.clear()
        keys = [vector_key(t[a:e], c[a:e]) for a, e in zip(at, at[1:], strict=False)]
        new = {k: i for i, k in enumerate(keys) if k not in self.known}
        texts = [(t[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in new.values()]
        self.known.update(zip(new, self.index.scores(texts), strict=True))
        return [self.known[k] for k in keys]


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A calibrated toxicity score and evidence for every row of docs.

    Only rows of `labels` (id, label 0/1; others are ignored, of repeated ids the larger label counts) whose
    crc32(id as text) mod 5 is not 0 teach; at most EXAMPLES of either class, each standing for its share of its class.
    Document frequencies are those of all rows. Texts are the only input of a score; a null text counts as empty, and an
    empty one has no term but the constant. Of equally near examples the first in order of their vectors votes. Without
    usable labels of both classes no word is a term; without any every score is 0. An empty table gives an empty one. A text
    is one vector and fits a worker's memory. Returns id, held_out (crc32 mod 5 is 0; a null id counts as ''), score in
    [0, 1], predicted (score >= 0.5) and evidence (ids of the nearest examples, nearest first). Other columns are ignored.
    """
    scorer_of = _train(docs, labels, label_col, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of()
        for b in slices(batches, "text", SLICE):
            got = scorer(b.column(1))
            held = crc_mod(b.column(0).to_pylist(), FOLDS) == HELD_OUT
            score = np.array([g[0] for g in got])
            near = pa.array([g[1] for g in got], pa.list_(b.column(0).type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), near], names=[id_col, "held_out", "score", "predicted", "evidence"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(rows, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, evidence array<{kind}>")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns whatever their names.

    Null and empty texts are scored as texts without words; repeated rows stay or go together; an empty table gives an
    empty one. See score_toxicity.
    """
    scorer_of = _train(docs, labels, "toxic", id_col, text_col)
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of()
        for b in slices(batches, text_col, SLICE):
            yield b.filter(pa.array([g[0] < 0.5 for g in scorer(b.column(place))], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
