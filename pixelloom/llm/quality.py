"""Document quality by co-training a text-content and a page-metadata classifier.

The views share nothing: one sees the text only, the other the metadata columns only. In every round both score all rows
without a label, and what one view is surest of in the whole table teaches the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.tables import drop, keep
from pixelloom.llm.words import Words, crc_mod, mix, slices

#: At most so many labelled rows of each class teach (those of the smallest hashed ids).
LABELLED = 4000
#: Rounds of exchange; pseudo-labels that a view hands over per round and class, the surest of all rows; a view offers
#: only what it gives this probability.
ROUNDS, HANDED, CONFIDENT = 3, 300, 0.95
SURE = float(np.log(CONFIDENT / (1 - CONFIDENT)))
BITS = 15
FOLDS, HELD_OUT = 5, 0
_U = np.uint64
_MASK = _U((1 << BITS) - 1)


def _bucket(x: np.ndarray, kind: int, step: float = 0.1, most: int = 40) -> np.ndarray:
    """A feature for each value's place in equal steps."""
    level = np.clip(np.nan_to_num(x) / step, 0, most).astype(_U)
    return (mix(level + _U(kind << 32)) & _MASK).astype(np.int64)


Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]  # text, feature, value


def content_view(w: Words) -> Sparse:
    """Hashed words and word shapes with unit length, and in steps the shares of letters, symbols and repeated words and the
    layout: length, lines, their mean length in bytes and words, length of words.
    """
    n, doc, counts = len(w), w.doc, np.maximum(w.counts, 1)
    h = w.hashes()
    last = w.data[w.end - 1].astype(_U) if len(w.end) else np.zeros(0, _U)
    size = np.minimum(w.end - w.start, 20).astype(_U)
    shape = mix(last * _U(64) + size + _U(1 << 40))
    pair = np.concatenate([doc * (1 << BITS) + (h & _MASK).astype(np.int64), doc * (1 << BITS) + (shape & _MASK).astype(np.int64)])
    key, times = np.unique(pair, return_counts=True)
    d, f = np.divmod(key, 1 << BITS)
    v = 1 + np.log(times)
    norm = np.sqrt(np.bincount(d, weights=v * v, minlength=n))
    v = v / norm[d]
    distinct = np.bincount(np.unique(doc * (1 << 40) + (h >> _U(24)).astype(np.int64)) >> 40, minlength=n) if len(h) else np.zeros(n)
    total = np.maximum(np.diff(w.byte_at), 1)
    text = np.repeat(np.arange(n), np.diff(w.byte_at))
    raw = w.data[: len(text)]
    share = lambda which: np.bincount(text[which], minlength=n) / total
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    symbol = np.isin(raw, np.frombuffer(b"%*#&$|!@=<>{}[]^~_+\\/", np.uint8))
    dense = [_bucket(distinct / counts, 1, 0.05), _bucket(share(upper), 2, 0.02), _bucket(share(symbol), 3, 0.02), _bucket(share(digit), 4, 0.02), _bucket(np.log2(counts), 5, 1.0)]
    size = np.diff(w.byte_at)
    lines = np.bincount(text[raw == 10], minlength=n) + 1
    dense += [_bucket(np.log2(size + 1), 21, 0.5), _bucket(np.log2(lines), 22, 0.5), _bucket(np.log2(size / lines + 1), 23, 0.5), _bucket(np.log2(counts) - np.log2(lines), 24, 0.5), _bucket(size / counts, 25, 0.5)]
    rows = np.arange(n)
    return np.concatenate([d, *[rows] * len(dense)]), np.concatenate([f, *dense]), np.concatenate([v, np.full(len(dense) * n, 0.5)])


def metadata_view(b: pa.RecordBatch, first: int) -> Sparse:
    """Of the columns from `first` on: hashed categories, numbers in steps, and every two of these together."""
    n = b.num_rows
    feats = []
    for c in range(first, b.num_columns):
        col = b.column(c)
        if pa.types.is_integer(col.type) or pa.types.is_floating(col.type):
            x = np.nan_to_num(np.asarray(col.cast(pa.float64()).fill_null(-1)))
            feats.append(_bucket(np.where(x < 0, 0, np.log2(np.maximum(x, 0) + 1) + 1), 100 + c, 0.5))
        else:
            known: dict = {}
            feats.append(np.array([known[v] if v in known else known.setdefault(v, _category(c, v)) for v in col.to_pylist()], np.int64))
    pairs = [(mix(x.astype(_U) * _U(1 << BITS) + y.astype(_U)) & _MASK).astype(np.int64) for k, x in enumerate(feats) for y in feats[:k]]
    feats += pairs
    rows = np.tile(np.arange(n), len(feats))
    return rows, np.concatenate(feats) if feats else np.zeros(0, np.int64), np.ones(len(rows))


def _category(c: int, v) -> int:
    import zlib

    return int(mix(np.array([zlib.crc32(repr(v).encode()) + (c << 33)], _U))[0] & _MASK)


def views(b: pa.RecordBatch) -> tuple[Sparse, Sparse]:
    """Both views of a batch of id, text and metadata columns."""
    return content_view(Words(b.column(1))), metadata_view(b, 2)


def margin(x: Sparse, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(x[0], weights=weights[x[1]] * x[2], minlength=n) + weights[-1]


def fit(x: Sparse, n: int, y: np.ndarray, weight: np.ndarray, steps: int = 120, decay: float = 2e-5) -> np.ndarray:
    """Logistic regression by full-batch Adam; the last weight is the intercept."""
    theta = np.zeros((1 << BITS) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = weight / weight.sum()
    for k in range(1, steps + 1):
        err = (1 / (1 + np.exp(-np.clip(margin(x, n, theta), -30, 30))) - y) * scale
        grad = np.concatenate([np.bincount(x[1], weights=err[x[0]] * x[2], minlength=1 << BITS), [err.sum()]]) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate margins z to labels y, each of its weight."""
    a, c = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        g, w = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[w @ (z * z) + 1e-6, w @ z], [w @ z, w.sum() + 1e-6]])
        da, dc = np.linalg.solve(hess, [g @ z, g.sum()])
        a, c = a - da, c - dc
    return float(a), float(c)


def _take(x: Sparse, rows: np.ndarray, n: int) -> Sparse:
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    on = place[x[0]] >= 0
    return place[x[0][on]], x[1][on], x[2][on]


def _join(parts: list[Sparse], sizes: list[int]) -> Sparse:
    shift = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return tuple(np.concatenate([p[k] + (s if k == 0 else 0) for p, s in zip(parts, shift, strict=True)]) for k in range(3))


Offer = tuple[tuple[Sparse, Sparse], int, np.ndarray]  # both views of some rows, their number, their pseudo-labels


class Model:
    """Both views' weights, their calibration and the weights of the calibrated views in the sum."""

    def __init__(self, x: tuple[Sparse, Sparse], n: int, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0), offer: Callable[[Model], list[Offer]] | None = None):
        """x: both views of n rows; y: label, or -1 for none. A fifth of the labelled rows calibrates and does not teach.

        weights: what a labelled row of class 0 and of class 1 stands for when calibrating. offer gives for each view the
        rows that it hands over now; without it these come from the rows of x without a label.
        """
        labelled = np.flatnonzero(y >= 0)
        aside = labelled[np.arange(len(labelled)) % 5 == 0]
        base = np.setdiff1d(labelled, aside)
        stands = np.array(weights)[y[aside]]
        offer = offer or self._local(x, n, np.flatnonzero(y < 0))
        own = [_take(v, aside, n) for v in x]
        # of each view: what teaches it, a part after the other
        taught = [[(_take(v, base, n), len(base), y[base].astype(float))] for v in x]
        self.handed = []
        for turn in range(ROUNDS + 1):
            self.weights = []
            for parts in taught:
                target = np.concatenate([t for _, _, t in parts])
                balance = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
                self.weights.append(fit(_join([p for p, _, _ in parts], [k for _, k, _ in parts]), len(target), target, balance))
            z = [margin(v, len(aside), w) for v, w in zip(own, self.weights, strict=True)]
            self.scale = [platt(m, y[aside], stands) for m in z]
            if turn == ROUNDS:
                break
            for view, (rows, k, target) in enumerate(offer(self)):  # what one view is sure of teaches the other
                if k:
                    taught[1 - view].append((rows[1 - view], k, target))
            self.handed.append([sum(k for _, k, _ in parts[1:]) for parts in taught])
        logits = np.stack([a * m + c for m, (a, c) in zip(z, self.scale, strict=True)])
        best = max(np.linspace(0, 1.4, 15), key=lambda k: -np.logaddexp(0, -(2 * y[aside] - 1) * (k * logits[0] + max(0.0, 1 - k) * logits[1])) @ stands)
        self.blend = float(best), max(0.0, 1 - float(best))

    def views(self, x: tuple[Sparse, Sparse], n: int) -> list[np.ndarray]:
        """Each view's calibrated logit."""
        return [np.clip(a * margin(v, n, w) + c, -30, 30) for v, w, (a, c) in zip(x, self.weights, self.scale, strict=True)]

    @staticmethod
    def _local(x: tuple[Sparse, Sparse], n: int, pool: np.ndarray) -> Callable[[Model], list[Offer]]:
        given: list[set[int]] = [set(), set()]

        def offer(m: Model) -> list[Offer]:
            out = []
            for view, z in enumerate(m.views(x, n)):
                rows, target = [], []
                for label, sure in ((1.0, z), (0.0, -z)):
                    best = [i for i in pool[np.argsort(-sure[pool], kind="stable")].tolist() if sure[i] >= SURE and i not in given[view]][:HANDED]
                    rows += best
                    target += [label] * len(best)
                given[view].update(rows)
                out.append((tuple(_take(v, np.array(rows, np.int64), n) for v in x), len(rows), np.array(target)))
            return out

        return offer

    def score(self, x: tuple[Sparse, Sparse], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The combined probability, and each view's."""
        z = self.views(x, n)
        return tuple(1 / (1 + np.exp(-t)) for t in (self.blend[0] * z[0] + self.blend[1] * z[1], *z))


def _gathered(rows: DataFrame, extra: str) -> pa.Table:
    """Both views of rows (id, text, metadata, `extra`), in order of id: id, extra, f0, v0, f1, v1."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            order = pa.array([str(i) for i in b.column(0).to_pylist()])
            packed = []
            for v in views(b.select(range(b.num_columns - 1))):
                at = np.argsort(v[0], kind="stable")
                edge = np.searchsorted(v[0][at], np.arange(b.num_rows + 1))
                packed += [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(v[1][at], pa.int32())), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(v[2][at], pa.float32()))]
            yield pa.RecordBatch.from_arrays([order, b.column(b.num_columns - 1).cast(pa.int64()), *packed], names=["id", extra, "f0", "v0", "f1", "v1"])

    return rows.mapInArrow(gather, f"id string, {extra} long, f0 array<int>, v0 array<float>, f1 array<int>, v1 array<float>").orderBy("id", extra).toArrow()


def _sparse(got: pa.Table, pick: np.ndarray | None = None) -> tuple[Sparse, Sparse]:
    """The views in a table of _gathered, or of the rows `pick` of it."""
    if pick is not None:
        got = got.take(pa.array(pick))
    x = []
    for k in "01":
        f, v = got[f"f{k}"].combine_chunks(), got[f"v{k}"].combine_chunks()
        x.append((np.repeat(np.arange(got.num_rows), np.asarray(pa.compute.list_value_length(f))), np.asarray(f.flatten()).astype(np.int64), np.asarray(v.flatten()).astype(np.float64)))
    return tuple(x)


def _offers(docs: DataFrame, columns: list, key, labels: DataFrame, id_col: str) -> Callable[[Model], list[Offer]]:
    """What each view is surest of among all rows without a label, none of them twice."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    given: list[set] = [set(), set()]

    def offer(m: Model) -> list[Offer]:
        shared = spark.sparkContext.broadcast(m)

        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                z = shared.value.views(views(b), b.num_rows)
                on = np.maximum(np.abs(z[0]), np.abs(z[1])) >= SURE
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, z)], names=["_px_id", "z0", "z1"]).filter(pa.array(on))

        # ids and two numbers of all confident rows; of rows that repeat an id one counts
        scored = docs.where(key.isNotNull()).select(*columns).mapInArrow(sure, f"_px_id {kind}, z0 double, z1 double")
        scored = scored.join(labels.select(F.col(id_col).alias("_px_k")), F.col("_px_id") == F.col("_px_k"), "left_anti").groupBy("_px_id").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1"))
        scored = keep(scored, "confident")
        chosen: dict[tuple[int, int], list] = {}
        for view in (0, 1):
            for label, z in ((1, F.col(f"z{view}")), (0, -F.col(f"z{view}"))):
                most = HANDED * (ROUNDS + 1)  # those handed over before may be among them
                best = scored.where(z >= SURE).orderBy(z.desc(), F.xxhash64("_px_id"), "_px_id").limit(most).select("_px_id").collect()
                chosen[view, label] = [r[0] for r in best if r[0] not in given[view]][:HANDED]
                given[view].update(chosen[view, label])
        drop(scored)
        wanted = sorted({i for c in chosen.values() for i in c})
        # at most 4 * HANDED ids
        small = F.broadcast(spark.createDataFrame([(i,) for i in wanted], f"_px_k {kind}"))
        rows = docs.select(*columns, F.lit(0).alias("_px_none")).join(small, key == F.col("_px_k")).drop("_px_k").dropDuplicates([id_col])
        got = _gathered(rows, "none")
        place = {i: k for k, i in enumerate(got["id"].to_pylist())}
        out = []
        for view in (0, 1):
            ids = [(place[str(i)], float(label)) for label in (1, 0) for i in chosen[view, label]]
            out.append((_sparse(got, np.array([k for k, _ in ids], np.int64)), len(ids), np.array([t for _, t in ids])))
        return out

    return offer


def score_quality(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("lang", "source", "n_chars"), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A calibrated quality score of every row of docs.

    Labels (0/1; others are ignored; of repeated ids the larger counts) teach only where crc32(id as text) mod 5 is not
    0, at most LABELLED of either class. In each of ROUNDS rounds all rows without a label are scored, and of either class
    the HANDED rows of which one view is surest (ties: by hashed id) teach the other. Fewer than 10 labelled rows of a class
    give every row 0.5. Null and empty texts are a text without words, null metadata a category of its own; a null id is
    scored and never teaches; of rows that repeat an id one teaches and all are scored; an empty table gives an empty one.
    A text is one row, and its features fit a worker's memory. Returns id, held_out, score in [0, 1], predicted
    (score >= 0.5), content_score and metadata_score. Other columns, whatever their names, are ignored.
    """
    spark, key = docs.sparkSession, F.col(id_col)
    usable = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & (F.crc32(key.cast("string")) % FOLDS != HELD_OUT)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_px_label"))
    usable = keep(usable, "labels")
    totals = {r[0]: r[1] for r in usable.groupBy("_px_label").count().collect()}
    order = (F.xxhash64(F.lit(11), key), key)
    picked = usable.where("_px_label = 1").orderBy(*order).limit(LABELLED).unionByName(usable.where("_px_label = 0").orderBy(*order).limit(LABELLED)).select(F.col(id_col).alias("_px_id"), "_px_label")
    columns = [key, F.col(text_col).alias("text"), *(F.col(c).alias(f"_px_m{k}") for k, c in enumerate(metadata))]
    # at most 2 * LABELLED rows of two numbers
    sample = keep(docs.select(*columns).join(F.broadcast(picked), key == F.col("_px_id")).dropDuplicates([id_col]).drop("_px_id"), "sample")
    got = _gathered(sample, "label")
    y = np.asarray(got["label"].combine_chunks()) if got.num_rows else np.zeros(0, np.int64)
    model = None
    if (y == 1).sum() >= 10 and (y == 0).sum() >= 10:
        model = Model(_sparse(got), len(y), y, tuple(totals.get(c, 0) / (y == c).sum() for c in (0, 1)), _offers(docs, columns, key, labels, id_col))
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            scores = shared.value.score(views(b), b.num_rows) if shared.value is not None else (np.full(b.num_rows, 0.5),) * 3
            held = crc_mod(b.column(0).to_pylist(), FOLDS) == HELD_OUT
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(scores[0]), pa.array((scores[0] >= 0.5).astype(np.int32)), *map(pa.array, scores[1:])], names=[id_col, "held_out", "score", "predicted", "content_score", "metadata_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*columns).mapInArrow(rows, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, content_score double, metadata_score double")
