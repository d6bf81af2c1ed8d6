"""Substring dedup: suffix automata of reference shards, matching statistics, removal of maximal repeated spans.

A window of 13 words is routed by the least hash of its nine 5-word runs, so equal windows meet whatever document they
are in. Runs of windows with one route form a segment; the segments of a route are a reference shard. A shard's
documents are streamed in ascending order of id through the suffix automaton of those before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.batches import answers_of, ask, by_bucket, pack, unpack
from pixelloom.llm.words import Words, mix

WINDOW, RUN = 13, 5
#: A route in more documents than this is cut further, into single windows routed by their own hash.
HOT = 2000
#: A shard of more words than this is matched by a table of its windows instead of an automaton.
AUTOMATON_WORDS = 1 << 15
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


class Automaton:
    """A suffix automaton of several word sequences, added in ascending order of document.

    Each state knows the first, so least, document in which its words occur.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # the sequence so far is known already
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1), first.append(doc)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), self.first.append(self.first[q])
        link[q] = twin
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def first_docs(self, words: list[int], size: int) -> list[int | None]:
        """For each run of `size` words, from the matching statistics: the first document that holds it, or None."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, match, out = 0, 0, []
        for k, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                match = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                match += 1
            if match >= size:
                while length[link[state]] >= size:
                    state = link[state]
                match = min(match, length[state])
                out.append(first[state])
            elif k >= size - 1:
                out.append(None)
        return out


class Windows:
    """A batch's words and windows. Rows with a null id have none: they have no place in the order."""

    def __init__(self, b: pa.RecordBatch):
        self.ids = np.asarray(b.column(0).cast(pa.int64()).fill_null(0))
        self.null = np.asarray(b.column(0).is_null())
        self.w = Words(b.column(1))
        h, owner = self.w.hashes(), self.w.doc
        self.h = h
        n = len(h) - WINDOW + 1
        if n <= 0:
            self.start = np.zeros(0, np.int64)
            self.route = self.hash = np.zeros(0, _U)
            return
        run = np.full(len(h) - RUN + 1, _U(RUN))
        for k in range(RUN):
            run = (run ^ h[k : k + len(run)]) * _M
            run ^= run >> _U(31)
        run = mix(run)
        two = np.minimum(run[:-1], run[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        least = np.minimum(eight[:-1], eight[1:])[:n]  # of 9 runs
        whole = np.full(n, _U(WINDOW))
        for k in range(WINDOW):
            whole = (whole ^ h[k : k + n]) * _M
            whole ^= whole >> _U(29)
        good = (owner[:n] == owner[WINDOW - 1 :]) & ~self.null[owner[:n]]
        self.start = np.flatnonzero(good)
        self.route, self.hash = least[self.start], mix(whole[self.start])
        self.doc = owner[self.start]

    def routes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct routes, ascending, and the number of documents in which each occurs."""
        if not len(self.start):
            return np.zeros(0, _U), np.zeros(0, np.int64)
        new = np.ones(len(self.start), bool)
        new[1:] = (self.route[1:] != self.route[:-1]) | (self.doc[1:] != self.doc[:-1])
        route, ident = self.route[new], self.ids[self.doc[new]]
        order = np.lexsort((ident, route))
        route, ident = route[order], ident[order]
        key = np.ones(len(route), bool)
        key[1:] = route[1:] != route[:-1]
        pair = key.copy()
        pair[1:] |= ident[1:] != ident[:-1]
        return route[key], np.add.reduceat(pair.astype(np.int64), np.flatnonzero(key))

    def segments(self, flag: np.ndarray) -> Segments:
        return Segments(self, flag)


class Segments:
    """Runs of windows of a batch on one repeated route, equal ones taken together.

    flag: of each window: 0 not repeated, 1 repeated, 2 on a hot route.
    """

    def __init__(self, x: Windows, flag: np.ndarray):
        at = np.flatnonzero(flag)
        self.window = at
        start, doc, route, hot = x.start[at], x.doc[at] if len(at) else at, x.route[at], flag[at] == 2
        route = np.where(hot, x.hash[at], route)
        new = np.ones(len(at), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (route[1:] != route[:-1]) | (doc[1:] != doc[:-1]) | hot[1:]
        first = np.flatnonzero(new)
        self.of_window = np.cumsum(new) - 1
        self.offset = np.arange(len(at)) - first[self.of_window] if len(at) else at
        n = np.diff(np.append(first, len(at)))
        ident = x.ids[doc[first]] if len(first) else np.zeros(0, np.int64)
        content = mix(np.add.reduceat(mix(x.hash[at] * _M + self.offset.astype(_U)), first) + n.astype(_U)) if len(first) else np.zeros(0, _U)
        order = np.lexsort((ident, content))
        key = np.ones(len(order), bool)
        key[1:] = content[order][1:] != content[order][:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(key) - 1
        one = order[key]
        self.group = group  # of each run
        self.least = ident[one]  # least id of each distinct segment
        self.ident = ident
        self.route, self.n, self.word = route[first[one]] if len(one) else np.zeros(0, _U), n[one], start[first[one]] if len(one) else one

    def payload(self, x: Windows, pick: np.ndarray) -> bytes:
        n = self.n[pick] + WINDOW - 1
        at = np.repeat(self.word[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        words = (x.h[at] >> _U(32)).astype(np.uint32)
        return b"".join([np.int64(len(pick)).tobytes(), self.route[pick].tobytes(), self.least[pick].astype(np.int64).tobytes(), self.n[pick].astype(np.int32).tobytes(), words.tobytes()])


def _routes_sent(buckets: int):
    def send(row: dict) -> Iterator[tuple[int, bytes]]:
        route, docs = Windows(unpack(row["blob"].as_py())).routes()
        for k, pick in by_bucket(route, buckets):
            yield k, route[pick].tobytes() + np.minimum(docs[pick], 65535).astype(np.uint16).tobytes()

    return send


def _routes_answered(payloads: list[bytes]) -> list[bytes]:
    """Of each route of each payload: 0 in one document only, 1 in several, 2 in more than HOT."""
    sizes = [len(p) // 10 for p in payloads]
    route = np.concatenate([np.frombuffer(p, _U, n) for p, n in zip(payloads, sizes, strict=True)])
    docs = np.concatenate([np.frombuffer(p, np.uint16, n, n * 8) for p, n in zip(payloads, sizes, strict=True)])
    _, inverse = np.unique(route, return_inverse=True)
    total = np.bincount(inverse, weights=docs)
    flag = ((total > 1).astype(np.uint8) + (total > HOT))[inverse]
    return [flag[e - n : e].tobytes() for n, e in zip(sizes, np.cumsum(sizes), strict=True)]


def _flags(x: Windows, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    route, _ = x.routes()
    flag = np.zeros(len(route), np.uint8)
    for k, pick in by_bucket(route, buckets):
        flag[pick] = np.frombuffer(answers[k], np.uint8)
    return flag[np.searchsorted(route, x.route)] if len(x.start) else np.zeros(0, np.uint8)


def _segments_sent(buckets: int):
    def send(row: dict) -> Iterator[tuple[int, bytes]]:
        x = Windows(unpack(row["blob"].as_py()))
        s = x.segments(_flags(x, answers_of(row["answers"]), buckets))
        for k, pick in by_bucket(s.route, buckets):
            yield k, s.payload(x, pick)

    return send


def _segments_answered(payloads: list[bytes]) -> list[bytes]:
    """For each window of each segment: whether it occurs in a document before the segment's least."""
    shards: dict[int, dict[bytes, list]] = {}
    out = []
    for p, data in enumerate(payloads):
        m = int(np.frombuffer(data, np.int64, 1)[0])
        route = np.frombuffer(data, np.int64, m, 8).tolist()
        least = np.frombuffer(data, np.int64, m, 8 + 8 * m).tolist()
        n = np.frombuffer(data, np.int32, m, 8 + 16 * m)
        at, base = 8 + 20 * m, 0
        for r, doc, k in zip(route, least, n.tolist(), strict=True):
            end = at + 4 * (k + WINDOW - 1)
            same = shards.setdefault(r, {}).setdefault(data[at:end], [])
            same.append((doc, p, base, k))
            at, base = end, base + k
        out.append(np.zeros(base, np.uint8))
    for shard in shards.values():
        texts = sorted((min(x[0] for x in v), c) for c, v in shard.items())
        firsts: list[list[int | None]]
        if len(texts) == 1:
            firsts = [[None] * (len(texts[0][1]) // 4 - WINDOW + 1)]
        elif sum(len(c) for _, c in texts) > 4 * AUTOMATON_WORDS:
            firsts = _window_table(texts)
        else:
            known, firsts = Automaton(), []
            for doc, c in texts:
                words = np.frombuffer(c, np.uint32).tolist()
                got = known.first_docs(words, WINDOW)
                firsts.append(got)
                if None in got:  # else it holds nothing new
                    known.add(words, doc)
        for (doc, c), got in zip(texts, firsts, strict=True):
            lows = np.array([doc if f is None else min(f, doc) for f in got], np.int64)
            for own, p, base, k in shard[c]:
                out[p][base : base + k] = lows < own
    return [np.packbits(x).tobytes() for x in out]


def _window_table(texts: list[tuple[int, bytes]]) -> list[list[int | None]]:
    """As the automaton's first_docs, for shards of any size: a table from window to first document."""
    seen: dict[bytes, int] = {}
    out = []
    for doc, c in texts:
        runs = [c[4 * i : 4 * (i + WINDOW)] for i in range(len(c) // 4 - WINDOW + 1)]
        out.append([seen.get(r) for r in runs])
        for r in runs:
            seen.setdefault(r, doc)
    return out


def _covered(x: Windows, flag: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """Of each word of the batch: whether a window that goes covers it."""
    s = x.segments(flag)
    before = np.zeros(int(s.n.sum()), bool)
    at = np.concatenate([[0], np.cumsum(s.n)]).astype(np.int64)
    for k, pick in by_bucket(s.route, buckets):
        n = s.n[pick]
        total = int(n.sum())
        place = np.repeat(at[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        before[place] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=total).astype(bool)
    group = s.group[s.of_window] if len(s.of_window) else s.of_window
    goes = before[at[group] + s.offset] | (s.ident[s.of_window] > s.least[group]) if len(group) else np.zeros(0, bool)
    edge = np.zeros(len(x.h) + 1, np.int64)
    start = x.start[s.window[goes]]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


COLUMNS = {"n_words": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "spans": ("array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": ("string", pa.string()), "kept_sha256": ("string", pa.string())}


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("n_words", "n_removed", "spans", "kept_text"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs without the words that repeat 13 words or more of a document of a smaller id.

    A word goes if a window of 13 consecutive words covers it whose word sequence also starts in a row with a smaller
    id; windows are judged on the input. Words are unchanged runs of non-space bytes; null texts have none. Ids are
    integers; rows with a null id lose nothing and are no reference; rows of one id don't affect one another. Returns
    the id and the chosen of n_words, n_removed, spans (maximal removed ranges of words), kept_text (words that stay,
    joined by one space) and kept_sha256 (its hex digest). Other columns are ignored.
    """
    packed, buckets = pack(docs, id_col, text_col)
    routes = ask(packed, _routes_sent(buckets), _routes_answered, ["batch", "blob"], "routes")
    one = packed.join(routes.select(F.col("batch").alias("b1"), F.col("answers")), F.col("batch") == F.col("b1"), "left")
    found = ask(one, _segments_sent(buckets), _segments_answered, ["batch", "blob", "answers"], "segments")
    both = routes.select("batch", "answers").join(found.select(F.col("batch").alias("b2"), F.col("answers").alias("more")), F.col("batch") == F.col("b2"))
    two = packed.join(both.select(F.col("batch").alias("b1"), "answers", "more"), F.col("batch") == F.col("b1"), "left").select("blob", "answers", "more")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = unpack(b.column(0)[i].as_py())
                x = Windows(part)
                gone = _covered(x, _flags(x, answers_of(b.column(1)[i]), buckets), answers_of(b.column(2)[i]), buckets)
                yield _result(part, x, gone, columns, id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    return two.mapInArrow(rows, ", ".join([f"`{id_col}` {kind}", *(f"{c} {COLUMNS[c][0]}" for c in columns)]))


def _result(part: pa.RecordBatch, x: Windows, gone: np.ndarray, columns: tuple[str, ...], id_col: str) -> pa.RecordBatch:
    w = x.w
    total = np.concatenate([[0], np.cumsum(gone)])
    made = {"n_words": w.counts, "n_removed": total[w.at[1:]] - total[w.at[:-1]]}
    if "spans" in columns:
        made["spans"] = []
        for a, e in zip(w.at, w.at[1:], strict=False):
            d = np.diff(np.concatenate([[0], gone[a:e].astype(np.int8), [0]]))
            made["spans"].append([{"start": int(s), "end": int(t)} for s, t in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)])
    if {"kept_text", "kept_sha256"} & {*columns}:
        # kept words and one space after each, in one array
        keep = ~gone
        start, size = w.start[keep], (w.end - w.start)[keep] + 1
        to = np.concatenate([[0], np.cumsum(size)])
        data = w.data[np.repeat(start - to[:-1], size) + np.arange(int(to[-1]))] if len(start) else np.zeros(0, np.uint8)
        data[to[1:] - 1] = 0x20
        kept = np.concatenate([[0], np.cumsum(keep)])
        edge = to[kept[w.at]]
        raw = data.tobytes()
        texts = [raw[a : max(a, e - 1)] for a, e in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
        made["kept_text"] = [t.decode() for t in texts] if "kept_text" in columns else None
        made["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in texts] if "kept_sha256" in columns else None
    return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(made[c], COLUMNS[c][1]) for c in columns)], names=[id_col, *columns])
