"""Near duplicates by b-bit MinHash: packed low bits of minima, band candidates, collision-corrected estimates, exact links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.components import components
from pixelloom.llm.tables import keep, size_of
from pixelloom.llm.words import Words, mix, shingles, slices

#: Bands of so many minima. At similarity 0.8 a pair misses every band with probability (1 - 0.8 ** 6) ** 40 = 5e-6.
BANDS, ROWS = 40, 6
#: Low bits kept of each minimum.
BITS = 2
K = BANDS * ROWS
#: Candidates are dropped where the estimate is so far below the threshold (4.5 standard errors at 0.8).
SLACK = 0.14
#: About so many nodes, and shingles of theirs, make a part; a tile holds two parts of a route.
TILE, TILE_WORDS = 1024, 1 << 20
#: A table of ids to remove is broadcast up to this size on disk, else joined by shuffle.
BROADCAST_BYTES = 24 << 20
_U = np.uint64


def _constants() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * K + 1, dtype=_U) * _U(0xD1342543DE82EF95))
    return (x[:K] >> _U(32)).astype(np.uint32), ((x[K:] >> _U(32)) | _U(1)).astype(np.uint32)


_XOR, _MUL = _constants()


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The K minima of each range of h (64-bit shingle hashes); empty ranges get the largest value."""
    out = np.full((len(at) - 1, K), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    x = ((h >> _U(32)) ^ h).astype(np.uint32)
    # runs of about 64k shingles stay in the cache
    first = at[full]
    cuts = [0, *(np.flatnonzero(np.diff(first >> 16)) + 1).tolist(), len(full)]
    for p, q in zip(cuts, cuts[1:], strict=False):
        if q > p:
            lo, hi = first[p], at[full[q - 1] + 1]
            part, edge = x[lo:hi], first[p:q] - lo
            for k in range(K):
                y = part ^ _XOR[k]
                y *= _MUL[k]
                out[full[p:q], k] = np.minimum.reduceat(y, edge)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of minima."""
    x = low.astype(_U).reshape(len(low), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h ^ x[:, :, k])
    return h.view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """The minima's low bits, 64 / BITS to a word."""
    per = 64 // BITS
    x = np.zeros((len(low), -(-K // per) * per), _U)
    x[:, :K] = low & np.uint32((1 << BITS) - 1)
    x = x.reshape(len(low), -1, per) << (np.arange(per, dtype=_U) * _U(BITS))
    return np.bitwise_or.reduce(x, axis=2)


_ONES = _U(sum(1 << i for i in range(0, 64, BITS)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate from packed signatures, corrected for chance agreement of BITS bits."""
    x = a ^ b
    for s in range(1, BITS):
        x = x | ((a ^ b) >> _U(s))
    agree = 1 - np.bitwise_count(x & _ONES).sum(axis=-1, dtype=np.int32) / K
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


def sets_of(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, ascending within a text, and their ranges."""
    h, at = shingles(w.hashes(), w.at, n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(at)))


def set_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each range of distinct hashes."""
    total = np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(0xA0761D6478BD642F)))])
    other = np.concatenate([[_U(0)], np.bitwise_xor.accumulate(mix(h))]) if len(h) else np.zeros(1, _U)
    return mix((total[at[1:]] - total[at[:-1]]) ^ mix((other[at[1:]] ^ other[at[:-1]]) + np.diff(at).astype(_U)))


def _signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, at = sets_of(Words(b.column(1), lower=True), n)
            low = minima(h, at)
            keys = band_keys(low)
            size = np.diff(at)
            keep_bands = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(keep_bands), pa.array(keys[size > 0].ravel()))
            sig = pack(low)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size), pa.array(set_hash(h, at).view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()), bands], names=["id", "th", "n", "node", "sig", "bands"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")).mapInArrow(rows, f"id {kind}, th long, n long, node long, sig binary, bands array<long>")


def _estimated(pairs: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose estimate reaches floor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), _U).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
                yield b.select([0, 1]).filter(pa.array(similarity(x, y) >= floor))

    return pairs.mapInArrow(rows, "a long, b long")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes (a kept table, column x)."""
    if size_of(wanted) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    ids = keep(nodes.join(wanted, F.col("node") == F.col("x"), "left_semi").select("node", "rep", "th"), "ids")
    small = F.broadcast(ids) if size_of(ids) <= BROADCAST_BYTES else ids
    own = docs.select(F.col(id_col).alias("_px_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_px_th"))
    # of rows that repeat an id and a text one is enough
    return own.join(small, (F.col("rep") == F.col("_px_id")) & (F.col("th") == F.col("_px_th"))).select("node", "text").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are as similar as asked."""
    pairs = keep(pairs, "candidates")
    wanted = keep(pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct(), "wanted")
    texts = _texts(wanted, nodes, docs, id_col, text_col)
    one, two = texts.select(F.col("node").alias("na"), F.col("text").alias("ta")), texts.select(F.col("node").alias("nb"), F.col("text").alias("tb"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ta", 1 << 20):
            (ha, aa), (hb, ab) = (sets_of(Words(b.column(c), lower=True), n) for c in (2, 3))
            right = (set_hash(ha, aa) == np.asarray(b.column(0)).view(_U)) & (set_hash(hb, ab) == np.asarray(b.column(1)).view(_U))
            row = np.concatenate([np.repeat(np.arange(b.num_rows), np.diff(x)) for x in (aa, ab)])
            h = np.concatenate([ha, hb])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=b.num_rows)
            union = np.diff(aa) + np.diff(ab) - both
            yield b.select([0, 1]).filter(pa.array(right & (100 * both >= percent * union)))

    joined = pairs.join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb")).select("a", "b", "ta", "tb")
    return keep(joined.mapInArrow(rows, "a long, b long").distinct(), "confirmed")


def _tiled(members: DataFrame, column: str) -> DataFrame:
    """members (route, node, comp, n, column, parts) dealt out so that every two parts of a route meet in one tile."""
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = members.withColumn("part", part).withColumn("o", other).select(F.xxhash64("route", F.least("part", "o"), F.greatest("part", "o")).alias("tile"), "route", "node", "comp", "n", column)
    return dealt.repartition("tile").sortWithinPartitions("tile")


def _per_tile(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work on the rows of each tile; the rows come sorted by tile."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            b = pa.concat_batches(held)
            if b.num_rows > 1:
                yield from work(b)
            held.clear()

    owner = None
    for b in batches:
        tile = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for s, e in zip(edges, edges[1:], strict=False):
            if e > s:
                if owner != tile[s]:
                    yield from flush()
                    owner = tile[s]
                held.append(b.slice(s, e - s))
    yield from flush()


def _with_partner(members: DataFrame, floor: float, percent: int) -> DataFrame:
    """(route, node) of nodes that have a node of another component in their tile whose estimate reaches floor."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, comp, n = (np.asarray(b.column(k)) for k in (2, 3, 4))
        sig = np.frombuffer(b"".join(b.column(5).to_pylist()), _U).reshape(len(node), -1)
        has = np.zeros(len(node), bool)
        main = np.unique(comp, return_inverse=True)[1]
        main = main == np.bincount(main).argmax()
        loose = np.flatnonzero(~main)  # of two nodes of different components one at least is not in the largest
        for at in range(0, len(loose), 64):
            i = loose[at : at + 64]
            ok = comp[i][:, None] != comp[None, :]
            ok &= np.minimum(n[i][:, None], n[None, :]) * 100 >= np.maximum(n[i][:, None], n[None, :]) * percent
            p, q = np.nonzero(ok)
            for k in range(0, len(p), 1 << 15):
                good = similarity(sig[i[p[k : k + (1 << 15)]]], sig[q[k : k + (1 << 15)]]) >= floor
                has[i[p[k : k + (1 << 15)][good]]] = True
                has[q[k : k + (1 << 15)][good]] = True
        yield b.select([1, 2]).filter(pa.array(has))

    return _tiled(members, "sig").mapInArrow(lambda batches: _per_tile(batches, work), "route long, node long").distinct()


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """Links between components within a tile, exact on full sets; those that join what is joined already are left out."""

    def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, n = np.asarray(b.column(2)), np.asarray(b.column(4)).astype(np.int64)
        _, comp = np.unique(np.asarray(b.column(3)), return_inverse=True)
        main = np.bincount(comp).argmax()
        h = np.frombuffer(b"".join(b.column(5).to_pylist()), _U)
        owner = np.repeat(np.arange(len(node)), n)
        at = np.concatenate([[0], np.cumsum(n)])
        order = np.argsort(h, kind="stable")
        posting = owner[order]
        word = np.unique(h, return_inverse=True)[1]
        edge = np.concatenate([[0], np.cumsum(np.bincount(word))])
        root = np.arange(int(comp.max()) + 1)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        out = []
        for i in np.flatnonzero(comp != main):
            w = word[at[i] : at[i + 1]]
            size = edge[w + 1] - edge[w]
            where = np.repeat(edge[w] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            both = np.bincount(posting[where], minlength=len(node))
            near = np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (comp != comp[i]))
            for j in near:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((node[i], node[j]))
        if out:
            a, c = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return _tiled(members, "words").mapInArrow(lambda batches: _per_tile(batches, work), "a long, b long").distinct()


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(node, words): each node's full set of shingle hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, at = sets_of(Words(b.column(1), lower=True), n)
            right = set_hash(h, at) == np.asarray(b.column(0)).view(_U)
            words = pa.array([h[s:e].tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), words], names=["node", "words"]).filter(pa.array(right))

    return texts.mapInArrow(rows, "node long, words binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by word-shingle sets with 100 * intersection >= percent * union.

    Words are lower-cased (A-Z); a text of fewer than n words has its whole sequence as its one shingle, a text without
    words (or null) an empty set, linked with nothing. Links are exact on full sets; each comes from a band of 6 equal
    minima, so a pair at 0.8 is missed with probability 5e-6 before transitivity. Returns one row per row of docs: the
    id, n_shingles, component_id (least id in the group) and kept (id = component_id; repeated rows are all kept). A
    null id belongs to no group: component_id is null, kept true. Other columns are ignored. Rows that repeat an id and a
    text are one node; rows of one id with several texts are in every group of these and show the least id of their own.
    An empty table gives an empty one. One text's shingles fit a worker's memory; texts are never cut.

    Equal sets are one node. Every node is first held against the leader (least node) with which it shares most bands.
    Nodes of buckets that then still lie in several components are compared in tiles of bounded size, by estimate and
    then exactly; what leaves a tile is a forest of links, never its pairs.
    """
    floor = percent / 100 - SLACK
    signed = keep(_signatures(docs, id_col, text_col, n), "signatures")
    rows = signed.select("id", "n", "node")
    nodes_min = rows.where("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"))
    of_node = signed.where("n > 0").alias("s").join(nodes_min.alias("m"), F.expr("s.node = m.node AND s.id = m.rep")).select("s.node", F.col("s.id").alias("rep"), "th", "s.n", "sig", "bands")
    # one row per node, also where rows repeat an id and a text; dealt by these two already
    nodes = keep(of_node.dropDuplicates(["node", "rep"]), "nodes")
    flat = nodes.select("node", F.explode("bands").alias("key"))
    buckets = flat.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = keep(flat.join(buckets.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "node", "leader", "size"), "members")
    sigs = nodes.select("node", "n", "sig")
    # each node and the leader with which it shares most bands (of equals the greatest)
    star = members.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("shared")).groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("best")).select("node", "best.leader")
    pairs = (
        star.join(sigs.select(F.col("node").alias("x"), F.col("sig").alias("sig_a")), F.col("leader") == F.col("x"))
        .join(sigs.select(F.col("node").alias("y"), F.col("sig").alias("sig_b")), F.col("node") == F.col("y"))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"), "sig_a", "sig_b")
    )
    links = _confirmed(_estimated(pairs, floor), nodes, docs, id_col, text_col, n, percent)
    roots = keep(components(links), "roots")
    named = members.join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    # buckets of several components; all those with the same least component are one route, in which a node is once
    mixed = named.groupBy("key").agg(F.min("comp").alias("route"), F.max("comp").alias("c1")).where("route <> c1").select(F.col("key").alias("k"), "route")
    open_ = keep(named.join(mixed, F.col("key") == F.col("k")).select("route", "node", "comp").distinct(), "open")
    parts = F.greatest(F.ceil(F.col("many") / TILE), F.ceil(F.col("words") / TILE_WORDS))
    sized = open_.join(sigs.withColumnRenamed("node", "y"), F.col("node") == F.col("y")).select("route", "node", "comp", "n", "sig")
    cut = sized.groupBy("route").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("words")).select(F.col("route").alias("r"), parts.alias("parts"))
    paired = keep(_with_partner(sized.join(cut, F.col("route") == F.col("r")), floor, percent), "partners")
    if not paired.isEmpty():
        wanted = keep(paired.select(F.col("node").alias("x")).distinct(), "wanted")
        sets = keep(_sets(_texts(wanted, nodes, docs, id_col, text_col), n), "sets")
        both = paired.join(open_.select(F.col("route").alias("r2"), F.col("node").alias("n2"), "comp"), F.expr("route = r2 AND node = n2")).select("route", "node", "comp")
        full = both.join(sets.withColumnRenamed("node", "y"), F.col("node") == F.col("y")).select("route", "node", "comp", "words").withColumn("n", (F.length("words") / 8).cast("long"))
        cut = full.groupBy("route").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("words")).select(F.col("route").alias("r"), parts.alias("parts"))
        more = keep(_linked(full.join(cut, F.col("route") == F.col("r")), percent), "more-links")
        if not more.isEmpty():
            roots = keep(components(links.unionByName(more)), "roots")
    first = nodes.select("node", "rep").join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = first.groupBy("root").agg(F.min("rep").alias("least")).withColumnRenamed("root", "r")
    of = keep(first.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("x"), "least").distinct(), "groups")
    out = rows.join(of, F.expr("node = x AND n > 0 AND id IS NOT NULL"), "left").withColumn("least", F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that near_duplicates does not keep; of rows that repeat an id, one stays.

    Rows with a null id all stay, so do empty and null texts; an empty table gives an empty one. Ties (equal texts) keep the
    least id.
    """
    groups = near_duplicates(docs, n, percent, id_col, text_col)
    gone = keep(groups.where("NOT kept").select(F.col(id_col).alias("_px_id")).distinct(), "gone")
    small = F.broadcast(gone) if size_of(gone) <= BROADCAST_BYTES else gone
    out = docs.join(small, F.col(id_col) == F.col("_px_id"), "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_px_n")).where("_px_n > 1").limit(1)
    if not again.isEmpty():
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(out.where(F.col(id_col).isNull()))
    return out
