"""Benchmark decontamination by spaced seeds.

Fixed masks ignore some token positions, so a hash of the others survives substitutions there. Hashes of test and
training texts are joined; around each hit the two token sequences are compared along their diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.words import Words, mix, slices

#: The spaced seeds ('1': the token counts) and the least and greatest items that use them. A stretch of 13 words or more of
#: which 80 % are equal has four equal words in a row, or is 15 words with the 4th, 8th and 12th changed. Of the items of
#: 5 to 12 words some keep two or three in a row only; an item of up to four words tolerates no change and is sought whole.
MASKS = (("1111", 8, 1 << 60), ("11011", 13, 1 << 60), ("111", 6, 7), ("111", 10, 11), ("11", 5, 5))
WHOLE = 4
#: An overlap counts from so many words (an item's own length, if that is less) with this share of equal tokens.
MIN_WORDS, MIN_MATCH = 13, 0.8
#: Test items are matched in blocks of at most so many bytes of text, each broadcast and held against all rows.
BLOCK_BYTES = 16 << 20
#: Where seeds repeat with a period of up to PERIOD (one word many times), only so many at either end of the run are looked up.
PERIOD, ENDS = 4, 16
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked tokens from each start on (h: token hashes)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(hash_of_mask(mask)))
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[k : k + n]) * _M
            out ^= out >> _U(29)
    return mix(out)


def outside_runs(s: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each seed (owner: the text of each): False in the inner part of a run of repeating seeds.

    Of two such runs that overlap the ends still meet, on the diagonals that align their starts or ends; without this a
    text and an item of one word repeated would have hits in the square of their lengths.
    """
    out = np.ones(len(s), bool)
    for p in range(1, min(PERIOD, len(s) - 1) + 1):
        again = np.zeros(len(s) + 1, bool)
        again[p:-1] = (s[p:] == s[:-p]) & (owner[p : len(s)] == owner[: len(s) - p])
        turns = np.flatnonzero(np.diff(again, prepend=False))
        for a, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if e - a > 2 * ENDS:
                out[a - p + ENDS : e - ENDS] = False
    return out


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 0x2545F4914F6CDD1D % 2**64


def _whole(h: np.ndarray) -> np.uint64:
    x = np.array([len(h)], _U)
    for w in h:
        x = mix(x * _M + w)
    return x[0]


class Items:
    """A block of test items: their token hashes end to end, and their seeds, sorted."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = Words(pa.array(texts, pa.string()), lower=True)
        self.ids, self.at, self.h = ids, w.at, w.hashes()
        keys, places = [], []
        owner, count = w.doc, w.counts[w.doc]
        for m, (mask, low, high) in enumerate(MASKS):
            s = seed_hashes(self.h, mask)
            start = np.arange(len(s))
            inside = (owner[start] == owner[start + len(mask) - 1]) & (count[start] >= low) & (count[start] <= high) if len(s) else np.zeros(0, bool)
            inside &= outside_runs(s, owner)
            keys.append(s[inside]), places.append(start[inside] * len(MASKS) + m)
        self.short: dict[int, list[int]] = {}
        for i, n in enumerate(w.counts):
            if 0 < n <= WHOLE:
                self.short.setdefault(int(n), []).append(i)
        self.short_keys = {n: {int(_whole(self.h[self.at[i] : self.at[i + 1]])): i for i in reversed(v)} for n, v in self.short.items()}
        self.twins: dict[int, list[int]] = {}
        for n, v in self.short.items():
            for i in v:
                self.twins.setdefault(self.short_keys[n][int(_whole(self.h[self.at[i] : self.at[i + 1]]))], []).append(i)
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.key >> _U(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in the texts (h, owner: the text of each token) and a place in the items, where a seed agrees."""
        here, there = [], []
        for m, (mask, _, _) in enumerate(MASKS):
            s = seed_hashes(h, mask)
            at = np.flatnonzero(self.maybe[(s >> _U(42)).astype(np.int64)])
            if len(at):
                at = at[owner[at] == owner[at + len(mask) - 1]]
                at = at[outside_runs(s, owner)[at]]
            a, b = np.searchsorted(self.key, s[at]), np.searchsorted(self.key, s[at], side="right")
            n = b - a
            at = np.repeat(at, n)
            entry = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum()))
            place, own = np.divmod(self.place[entry], len(MASKS))
            here.append(at[own == m]), there.append(place[own == m])
        return np.concatenate(here), np.concatenate(there)


def _promising(h: np.ndarray, at: np.ndarray, items: Items, here: np.ndarray, there: np.ndarray, text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Of each hit: whether a stretch near it may count. One of 26 words or more has a part of 13 to 25 that counts too."""
    reach = 2 * MIN_WORDS - 2
    out = np.zeros(len(here), bool)
    for k in range(0, len(here), 1 << 15):
        part = slice(k, k + (1 << 15))
        p, q = (x[part, None] + np.arange(-reach, reach + 1) for x in (here, there))
        t, i = text[part, None], item[part, None]
        inside = (p >= at[t]) & (p < at[t + 1]) & (q >= items.at[i]) & (q < items.at[i + 1])
        equal = inside & (h[np.clip(p, 0, len(h) - 1)] == items.h[np.clip(q, 0, len(items.h) - 1)])
        total = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
        good = (items.at[i + 1] - items.at[i])[:, 0] < MIN_WORDS
        for n in range(MIN_WORDS, reach + 2):
            good |= (total[:, n:] - total[:, :-n]).max(axis=1) >= MIN_MATCH * n - 1e-9
        out[part] = good
    return out


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest stretch [left, right) of `least` words or more with enough equal ones, and those on either side of it."""
    out, todo = [], [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        # with whole numbers: an equal word adds 1, another takes 4
        score = np.concatenate([[0], np.cumsum(np.where(equal[a:b], 1, -4))])
        low = np.minimum.accumulate(score)  # descending: the first place at most as high as each end
        left = np.searchsorted(-low, -score, side="left")
        size = np.arange(len(score)) - left
        right = int(np.argmax(size))
        left = int(left[right])
        if right - left < least:
            continue
        left, right = a + left, a + right
        todo += [(a, left), (right, b)]
        while right - left > least and not equal[right - 1]:
            right -= 1
        while right - left > least and not equal[left]:
            left += 1
        out.append((left, right))
    return out


def overlaps_of(h: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """Verified overlaps: text, item, first word in the text, in the item, words, equal words."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = []
    here, there = items.hits(h, owner)
    if len(here):
        item = np.searchsorted(items.at, there, side="right") - 1
        text = owner[here]
        # hits on one diagonal of one text and item stand together
        shift = here - at[text] - (there - items.at[item])
        order = np.lexsort((here, shift, item, text))
        here, there, item, text, shift = (x[order] for x in (here, there, item, text, shift))
        pick = _promising(h, at, items, here, there, text, item)
        last = None
        for p, q, i, t, s in zip(here[pick].tolist(), there[pick].tolist(), item[pick].tolist(), text[pick].tolist(), shift[pick].tolist(), strict=True):
            if (t, i, s) == last:
                continue
            last = (t, i, s)
            back = min(p - int(at[t]), q - int(items.at[i]))
            ahead = min(int(at[t + 1]) - p, int(items.at[i + 1]) - q)
            equal = h[p - back : p + ahead] == items.h[q - back : q + ahead]
            for left, right in _stretches(equal, min(MIN_WORDS, int(items.at[i + 1] - items.at[i]))):
                out.append((t, i, p - back + left - int(at[t]), q - back + left - int(items.at[i]), right - left, int(equal[left:right].sum())))
    for n, known in items.short_keys.items():
        if len(h) >= n:
            x = np.full(len(h) - n + 1, _U(n))
            for k in range(n):
                x = mix(x * _M + h[k : k + len(x)])
            for p in np.flatnonzero(np.isin(x, np.array(list(known), _U)) & (owner[: len(x)] == owner[n - 1 :])):
                t = int(owner[p])
                out += [(t, i, int(p - at[t]), 0, n, n) for i in items.twins[known[int(x[p])]]]
    return sorted(set(out))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The test items, a bounded block at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        ids.append(r[0]), texts.append(r[1])
        size += len(r[1] or "")
        if size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and test item that overlap.

    Words are lower-cased (A-Z). An overlap is a stretch of the two word sequences along one diagonal, around an
    agreeing seed, of 13 words or more (the whole item, if that is shorter) of which 80 % are equal. Null and empty
    texts overlap nothing; a null id is kept as such; repeated rows and items are reported each; an empty table on either side
    gives an empty one. A text is one row and fits a worker's memory. Inside long runs of repeating words only the
    alignments of their ends are looked at. Returns the ids, n_spans, words (in the longest span), matched (its equal words),
    doc_start and item_start (its first words; of equal spans the first). Other columns are ignored.
    """
    kind, of = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {of}, n_spans long, words long, matched long, doc_start long, item_start long"
    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)
        found = source.mapInArrow(_finder(shared, id_col, item_col, schema), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _finder(shared, id_col: str, item_col: str, schema: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in slices(batches, "text"):
            w = Words(b.column(1), lower=True)
            best: dict[tuple[int, int], list] = {}
            for t, i, p, q, n, same in overlaps_of(w.hashes(), w.at, items):
                g = best.setdefault((t, i), [0, (0, 0, 0, 0)])
                g[0] += 1
                g[1] = max(g[1], (n, same, -p, -q))
            if best:
                cols = list(zip(*((t, items.ids[i], g[0], g[1][0], g[1][1], -g[1][2], -g[1][3]) for (t, i), g in best.items()), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:])], names=[id_col, item_col, "n_spans", "words", "matched", "doc_start", "item_start"])

    return rows


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no test item (see find_overlaps), with all their columns whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty one.
    """
    place = docs.columns.index(text_col)

    def cleaner(shared):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in slices(batches, text_col):
                w = Words(b.column(place), lower=True)
                bad = {x[0] for x in overlaps_of(w.hashes(), w.at, items)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        return rows

    for block in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(cleaner(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
