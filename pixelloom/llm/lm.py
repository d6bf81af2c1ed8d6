"""Language-model scores: causal self-attention over subword ids, trained in numpy, beside corpus word counts.

A text is its lower-cased words and an end. A word is spelled by the subword ids of a public vocabulary; the last one of
a word is an id of its own. The attention model gives the class of the next subword from a window of those before it
(and the subword from its class); a word's probability mixes its spelling's with its share of the training tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.batches import BATCH_BYTES, BATCHES_PER_BUCKET, answers_of, ask, by_bucket
from pixelloom.llm.sums import summed
from pixelloom.llm.tables import drop, keep
from pixelloom.llm.words import Words, crc_mod, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Subwords in a window, those of them that it scores (the rest, before them, are context only), width, classes.
WINDOW, SCORED, WIDTH, CLASSES = 16, 12, 16, 128
#: Subword ids (with their last-of-word twins) that have a place of their own in the model.
TOKENS = 4094
#: Ids whose neighbourhood, in all training texts, makes the embeddings.
TOP = 128
#: Id counts, neighbours, class successions and the mixture are those of all training texts. Every window of theirs gives a
#: gradient once, in one of so many rounds (those of a batch of texts in the same), so many windows to a step.
ROUNDS, STEP = 2, 160
#: Windows whose classes are worked out together: so few that their logits stay in a core's cache.
FEW = 32
#: Steps of the scale on which the mixture sees how likely tokens are by counts and by spelling.
SCALE = 400
FOLDS, HELD_OUT = 7, 2
#: From a query to a key: whether the key is not after it, and how far it is before it.
_CAUSAL = np.arange(WINDOW)[None, :] <= np.arange(SCORED)[:, None] + WINDOW - SCORED
_GAP = np.clip(np.arange(SCORED)[:, None] + WINDOW - SCORED - np.arange(WINDOW)[None, :], 0, WINDOW - 1)
_ONES = np.ones(max(WINDOW, CLASSES), np.float32)
_U = np.uint64
_END_HASH = _U(0x656E64)
PAD, END, OTHER = 0, 1, 2


class Speller:
    """Subword ids of words: 2 * id, or 2 * id + 1 for a word's last."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.size = 2 * (max(ranks.values()) + 1)
        # words have no spaces, so that each is a match
        core = tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.whole, self.one = core.encode_to_tiktoken_buffer, core.encode_single_piece
        self.bytes = np.zeros(self.size // 2, np.int64)
        for piece, k in ranks.items():
            self.bytes[k] = len(piece)

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and how many each has."""
        return self.spell_joined(b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)))

    def spell_joined(self, text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words joined by spaces, and how many bytes each has."""
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        try:
            flat = np.frombuffer(self.whole(text.decode(), set()), np.uint32).astype(np.int64)
        except UnicodeDecodeError:  # texts that are no UTF-8
            flat = np.fromiter(chain.from_iterable(map(self.one, text.split(b" "))), np.int64)
        # a word's last id is that with which its bytes are complete
        last = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum(sizes))
        flat *= 2
        flat[last] += 1
        return flat, np.diff(last, prepend=-1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass
class Model:
    place: np.ndarray  # of each subword id
    embed: np.ndarray
    cls: np.ndarray  # class of each place
    inside: np.ndarray  # log of each place's share of its class
    after: np.ndarray  # [place, class]: log of the class's share after the place
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    out: np.ndarray
    near: np.ndarray  # bias by distance
    mixture: float = 0.5

    PARTS = ("wq", "wk", "wv", "out", "near")

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS]).astype(np.float64)

    def set_vector(self, v: np.ndarray) -> None:
        at = 0
        for p in self.PARTS:
            x = getattr(self, p)
            setattr(self, p, v[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size

    def mask(self) -> np.ndarray:
        """[query, key] bias: by distance, and -1e9 for keys after the query."""
        return np.where(_CAUSAL, self.near[_GAP], np.float32(-1e9))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries of each place, its keys and values side by side."""
        return tuple(np.ascontiguousarray(x, np.float32) for x in (self.embed @ self.wq / np.sqrt(WIDTH), np.concatenate([self.embed @ self.wk, self.embed @ self.wv], axis=1)))


class Room:
    """Space that a few windows after another use: new space for every result would take longer than many a result."""

    def __init__(self, m: Model):
        self.z, self.after = np.empty((2, FEW * SCORED, CLASSES), np.float32)
        self.most = float(m.after.max())

    def classes(self, m: Model, o: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The classes' logits where attention gives o and the last place is own."""
        z, after = self.z[: len(o)], self.after[: len(o)]
        np.matmul(o, m.out, out=z)
        np.take(m.after, own, axis=0, out=after, mode="clip")
        z += after
        return z


def _shut_out(s: np.ndarray, ctx: np.ndarray) -> None:
    """Padding is no key."""
    at = np.flatnonzero(ctx == PAD)
    s[at // WINDOW, :, at % WINDOW] = -1e9


def windows(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over the sequences in ids (ranges at), and the targets that each scores.

    Returns context places (n, WINDOW), targets (n, SCORED) and the targets' positions in ids (-1: none). A sequence's
    first id is context only. Every other id is a target exactly once.
    """
    size = np.diff(at)
    count = np.maximum(0, -(-(size - 1) // SCORED))
    seq = np.repeat(np.arange(len(size)), count)
    first = (np.arange(len(seq)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)) * SCORED
    index = (first + at[seq])[:, None] + np.arange(-(WINDOW - SCORED), SCORED + 1)[None, :]
    none = index < at[seq][:, None]
    none |= index >= at[seq + 1][:, None]
    got = ids.take(index, mode="clip") if len(ids) else index
    got[none] = PAD
    index[none] = -1
    return got[:, :-1], got[:, WINDOW - SCORED + 1 :], index[:, WINDOW - SCORED + 1 :]


def log_probs(m: Model, ctx: np.ndarray, target: np.ndarray, tables: tuple, block: int = FEW) -> np.ndarray:
    """Natural log of each target's probability, by masked attention over batches of windows."""
    q, kv = tables
    mask, out, room = m.mask(), np.empty(target.shape, np.float32), Room(m)
    # where these can't be reached, sums of exponentials can't overflow
    top_s = np.linalg.norm(q, axis=1).max() * np.linalg.norm(kv[:, :WIDTH], axis=1).max() + max(0.0, float(m.near.max()))
    top_z = np.linalg.norm(kv[:, WIDTH:], axis=1).max() * np.linalg.norm(m.out, axis=0).max() + room.most
    for a in range(0, len(ctx), block):
        c, t = ctx[a : a + block], target[a : a + block].ravel()
        own = c[:, WINDOW - SCORED :].ravel()
        both = kv.take(c, axis=0)
        s = np.matmul(q.take(own, axis=0).reshape(len(c), SCORED, WIDTH), both[:, :, :WIDTH].transpose(0, 2, 1))
        s += mask
        _shut_out(s, c)
        if top_s > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        o = np.matmul(s, both[:, :, WIDTH:]).reshape(-1, WIDTH)
        o /= np.maximum(s.reshape(-1, WINDOW) @ _ONES[:WINDOW], 1e-30)[:, None]
        z = room.classes(m, o, own)
        picked = z[np.arange(len(z)), m.cls[t]]
        if top_z > 60:
            np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        out[a : a + block] = (picked - np.log(z @ _ONES[:CLASSES]) + m.inside[t]).reshape(len(c), SCORED)
    return out


def gradient(m: Model, ctx: np.ndarray, target: np.ndarray, logs: np.ndarray | None = None, room: Room | None = None) -> np.ndarray:
    """Gradient of the mean negative log probability of the classes of targets (padding ones don't count).

    logs gets the log probability of each target. Steps may share a room.
    """
    n, room = len(ctx), room or Room(m)
    own = ctx[:, WINDOW - SCORED :].ravel()
    eq, ek = m.embed.take(own, axis=0), m.embed.take(ctx.ravel(), axis=0)
    scale = np.float32(1 / np.sqrt(WIDTH))
    q = (eq @ (m.wq * scale)).reshape(n, SCORED, WIDTH)
    kv = (ek @ np.concatenate([m.wk, m.wv], axis=1)).reshape(n, WINDOW, 2 * WIDTH)
    k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    p = np.matmul(q, k.transpose(0, 2, 1))
    p += m.mask()
    _shut_out(p, ctx)
    # where these can't be reached, sums of exponentials can't overflow (nor become 0)
    if WIDTH * float(np.abs(q).max()) * float(np.abs(k).max()) + float(np.abs(m.near).max()) > 60:
        p -= p.max(axis=2, keepdims=True)
    np.exp(p, out=p)
    p /= np.maximum(p.reshape(-1, WINDOW) @ _ONES[:WINDOW], 1e-30).reshape(n, SCORED, 1)
    o = np.matmul(p, v).reshape(-1, WIDTH)
    high = np.sqrt(WIDTH) * float(np.abs(o).max()) * np.linalg.norm(m.out, axis=0).max() + room.most > 60
    t = target.ravel()
    real = (t != PAD) & (own != PAD)
    weight, cls, inside = (real / max(1, real.sum())).astype(np.float32), m.cls[t], m.inside[t]
    d_out, do, seen, row = np.zeros((CLASSES, WIDTH), np.float32), np.empty_like(o), np.empty(len(t), np.float32), np.arange(FEW * SCORED)
    for a in range(0, len(t), FEW * SCORED):
        to = slice(a, a + FEW * SCORED)
        z, c = room.classes(m, o[to], own[to]), cls[to]
        if high:
            z -= z.max(axis=1, keepdims=True)
        at = row[: len(z)], c
        picked = z[at]
        np.exp(z, out=z)
        total = np.maximum(z @ _ONES[:CLASSES], 1e-30)
        seen[to] = picked - np.log(total)
        # z - total * (the target's class), times share, is the logits' gradient
        share = (weight[to] / total)[:, None]
        z[at] -= total
        d_out += z.T @ (o[to] * share)
        np.matmul(z, m.out.T, out=do[to])
        do[to] *= share
    if logs is not None:
        logs[:] = (seen + inside).reshape(logs.shape)
    inner, do = np.einsum("ij,ij->i", do, o).reshape(n, SCORED, 1), do.reshape(n, SCORED, WIDTH)
    ds = np.matmul(do, v.transpose(0, 2, 1))
    ds -= inner
    ds *= p
    dkv = np.empty_like(kv)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
    np.matmul(p.transpose(0, 2, 1), do, out=dkv[:, :, WIDTH:])
    d_q = eq.T @ np.matmul(ds, k).reshape(-1, WIDTH) * scale
    d_kv = ek.T @ dkv.reshape(-1, 2 * WIDTH)
    near = np.bincount(_GAP[_CAUSAL], weights=(_ONES[:1].repeat(n) @ ds.reshape(n, -1)).reshape(SCORED, WINDOW)[_CAUSAL], minlength=WINDOW)
    return np.concatenate([d_q.ravel(), d_kv[:, :WIDTH].ravel(), d_kv[:, WIDTH:].ravel(), d_out.T.ravel(), near])


def descend(m: Model, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float, steps_at_least: int = 60) -> int:
    """Adam over all windows (ctx, target, logs) of the parts, each once; few windows again until enough steps are made.

    logs gets the targets' log probabilities before the step that learns from them. Returns how many windows there are.
    """
    v = m.vector()
    a, b = np.zeros_like(v), np.zeros_like(v)
    n, seen, held, room = 0, 0, [], Room(m)

    def over(ctx: np.ndarray, target: np.ndarray, logs: np.ndarray) -> None:
        nonlocal v, a, b, n
        order = np.random.default_rng(n).permutation(len(ctx))  # a step's windows come from many texts
        for at in range(0, len(ctx), STEP):
            pick = order[at : at + STEP]
            now = np.empty((len(pick), SCORED), np.float32)
            g = gradient(m, ctx[pick], target[pick], now, room)
            logs[pick] = now
            n += 1
            a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
            v = v - rate / np.sqrt(1 + n / 60) * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.99**n)) + 1e-8)
            m.set_vector(v)

    for part in parts:
        if n < steps_at_least:
            held.append(part)
        seen += len(part[0])
        over(*part)
    while seen and n < steps_at_least:
        for part in held:
            over(*part)
    return seen


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that have a place of their own, and the place of every id."""
    frequent = np.argsort(-counts, kind="stable")[:TOKENS]
    frequent = frequent[counts[frequent] > 0]
    place = np.full(len(counts), OTHER, np.int64)
    place[frequent] = np.arange(3, len(frequent) + 3)
    return frequent, place


def neighbours(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """Of successions a, b of places: how often each place has each of the first TOP after it, and before it."""
    out = np.zeros(n * 2 * TOP)
    for own, other, shift in ((a, b, 0), (b, a, TOP)):
        on = other < TOP
        out += np.bincount(own[on] * (2 * TOP) + shift + other[on], weights=None if weight is None else weight[on], minlength=len(out))
    return out


def shape(runs: list[np.ndarray], counts: np.ndarray, size: int) -> Model:
    """A model shaped by some runs of ids (END: -1) and the counts of all `size` ids."""
    frequent, place = places(counts)
    seqs = [np.where(r < 0, END, place[r]) for r in runs]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in seqs)]) for k in (slice(None, -1), slice(1, None)))
    return shaped(frequent, place, neighbours(a, b, None, len(frequent) + 3), counts)


def shaped(frequent: np.ndarray, place: np.ndarray, near: np.ndarray, counts: np.ndarray) -> Model:
    """Embeddings from the neighbours of places, classes from these, and first weights."""
    n, size = len(frequent) + 3, len(counts)
    rng = np.random.default_rng(1)
    near = near.reshape(n, 2 * TOP)
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    x -= x[3:].mean(axis=0) if n > 3 else 0
    _, vec = np.linalg.eigh(x.T @ (x * np.sqrt(near.sum(axis=1, keepdims=True))))
    embed = x @ vec[:, ::-1][:, :WIDTH]
    embed /= np.maximum(np.linalg.norm(embed, axis=1, keepdims=True), 0.1) / 2
    embed[PAD] = 0
    # classes: k-means of the embeddings, END alone
    weight = np.ones(n)
    weight[3:] = np.sqrt(counts[frequent])
    k = CLASSES - 1
    centre = embed[rng.choice(np.arange(2, n), size=k, p=weight[2:] / weight[2:].sum())]
    for _ in range(12):
        cls = ((embed[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (cls[2:] == c).any():
                centre[c] = np.average(embed[2:][cls[2:] == c], axis=0, weights=weight[2:][cls[2:] == c])
    cls = cls + 1
    cls[END] = cls[PAD] = 0
    total = np.ones(n)
    total[3:] += counts[frequent]
    total[[PAD, END]] = 1
    inside = np.log(total / np.bincount(cls[1:], weights=total[1:], minlength=CLASSES)[cls])
    inside[END] = 0
    inside[OTHER] -= np.log(size)
    small = lambda *s: rng.normal(0, 0.05, s).astype(np.float32)
    return Model(place, embed.astype(np.float32), cls, inside.astype(np.float32), _shut(np.zeros((n, CLASSES)), cls), small(WIDTH, WIDTH), small(WIDTH, WIDTH), small(WIDTH, WIDTH), small(WIDTH, CLASSES), np.zeros(WINDOW, np.float32))


def _shut(after: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Classes without places get no share."""
    return np.where(np.bincount(cls[1:], minlength=CLASSES) > 0, after, -1e4).astype(np.float32)


class Batch:
    """A batch's tokens (words, then one end per text), its distinct words and their spelling.

    held, counts: of each text; which: each word's distinct word (low, high: its parts of 16 bits); flat, size: the ids (end
    to end) and numbers of ids of the distinct words, those that occur most first. Their hashes are kept apart.
    """

    PARTS = ("held", "counts", "low", "high", "flat", "size")

    def __init__(self, blob: bytes):
        row = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        self.ids = row.column(0).flatten()
        for k, name in enumerate(self.PARTS, 1):
            setattr(self, name, row.column(k).flatten().to_numpy(zero_copy_only=False))
        self.which = self.low.astype(np.int64) | self.high.astype(np.int64) << 16
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    @classmethod
    def blob(cls, b: pa.RecordBatch, sp: Speller) -> tuple[bytes, bytes]:
        """The batch of a slice of ids and texts, and the hashes of its distinct words."""
        w = Words(b.column(1), lower=True)
        key, one, which, many = np.unique(w.hashes(), return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key, one, which = key[order], one[order], rank[which]
        flat, size = sp.spell_joined(*w.joined(one))
        held = crc_mod(b.column(0).to_pylist(), FOLDS) == HELD_OUT
        parts = (held, w.counts, which.astype(np.uint16), (which >> 16).astype(np.uint16), flat.astype(np.int32), size.astype(np.int32))
        lists = [pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x if isinstance(x, pa.Array) else pa.array(x)) for x in (b.column(0), *parts)]
        row = pa.RecordBatch.from_arrays(lists, names=["ids", *cls.PARTS])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_batch(row)
        return sink.getvalue().to_pybytes(), key.tobytes()

    def times(self) -> np.ndarray:
        """Counts of the distinct words in training texts."""
        return np.bincount(self.which, weights=~self.held[self.doc], minlength=len(self.size))

    def token_times(self) -> np.ndarray:
        """Counts of the distinct tokens, the end's last, in training texts."""
        return np.append(self.times().astype(np.int64), int((~self.held).sum()))

    def sequences(self, place: np.ndarray, taught: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places of all texts (of those that teach), each END, then its tokens' subwords.

        Returns them end to end, the texts' ranges; each token's distinct word (the end's is the last), the first of its
        subwords, counted without the leading ENDs, and the texts' ranges of tokens.
        """
        counts, words = (self.counts[~self.held], self.which[~self.held[self.doc]]) if taught else (self.counts, self.which)
        n = len(counts)
        at = np.concatenate([[0], np.cumsum(counts + 1)])
        which = np.full(int(at[-1]), len(self.size), np.int64)
        inner = np.ones(len(which), bool)
        inner[at[1:] - 1] = False
        which[inner] = words
        first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        flat, span = np.append(place[self.flat], END), np.append(self.size, 1)[which]
        to = np.concatenate([[0], np.cumsum(span)]).astype(np.int64)
        sub = flat[np.repeat(first[which] - to[:-1], span) + np.arange(int(to[-1]))]
        edge = to[at] + np.arange(n + 1)
        seq = np.full(len(sub) + n, END, np.int64)
        lead = np.zeros(len(seq), bool)
        lead[edge[:-1]] = True
        seq[~lead] = sub
        return seq, edge, which, to, at


def _tokens(docs: DataFrame, id_col: str, text_col: str, speller) -> tuple[DataFrame, int]:
    """A kept table (batch, blob, key) of all rows' ids and tokens, and a number of buckets that fits its size."""
    from pyspark import TaskContext

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sp = TaskContext.get().partitionId() << 32, Speller(speller.value)
        for k, b in enumerate(slices(batches, "text", BATCH_BYTES)):
            blob, key = Batch.blob(b, sp)
            yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([blob], pa.binary()), pa.array([key], pa.binary())], names=["batch", "blob", "key"])

    # small row groups: a task reads few of these large rows at a time
    packed = keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, "batch long, blob binary, key binary"), "tokens", block=8 << 20)
    return packed, max(24, -(-packed.count() // BATCHES_PER_BUCKET))


def _counts_sent(buckets: int):
    def send(row: dict) -> Iterator[tuple[int, bytes]]:
        key, n = _keys(row["key"].as_py()), Batch(row["blob"].as_py()).token_times()
        for k, pick in by_bucket(key, buckets):
            yield k, key[pick].tobytes() + n[pick].astype(np.uint32).tobytes()

    return send


def _counts_answered(payloads: list[bytes]) -> list[bytes]:
    """The distinct and all training tokens of the bucket, then each key's count."""
    sizes = [len(p) // 12 for p in payloads]
    key = np.concatenate([np.frombuffer(p, _U, n) for p, n in zip(payloads, sizes, strict=True)])
    n = np.concatenate([np.frombuffer(p, np.uint32, k, k * 8) for p, k in zip(payloads, sizes, strict=True)])
    _, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=n).astype(np.int64)
    head = np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()
    each = total[inverse]
    return [head + each[e - k : e].tobytes() for k, e in zip(sizes, np.cumsum(sizes), strict=True)]


def _keys(key: bytes) -> np.ndarray:
    """The hashes of a batch's distinct tokens, the end's last."""
    return np.append(np.frombuffer(key, _U), _END_HASH)


def _counts(key: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    out = np.zeros(len(key), np.int64)
    for k, pick in by_bucket(key, buckets):
        out[pick] = np.frombuffer(answers[k], np.int64)[2:]
    return out


def _totals(answered: DataFrame) -> tuple[int, int]:
    """Distinct and all training tokens."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for b in batches:
            for row in b.column(0):
                for x in row.as_py():
                    seen[x["bucket"]] = tuple(np.frombuffer(x["data"][:16], np.int64).tolist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], names=["bucket", "v", "n"])

    got = answered.select("answers").mapInArrow(heads, "bucket long, v long, n long").groupBy("bucket").agg(F.max("v").alias("v"), F.max("n").alias("n")).agg(F.sum("v"), F.sum("n")).first()
    return int(got[0] or 0), int(got[1] or 0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for b in batches:
        for blob in b.column(0):
            yield Batch(blob.as_py())


def _successions(x: Batch, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All successions of places in a batch's training texts, as (from, to, times): within words, between them, at the ends."""
    place, size, n = place[x.flat], x.size, x.times()
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    inner = np.ones(len(place), bool)
    inner[edge[1:] - 1] = False
    at = np.flatnonzero(inner)
    yield place[at], place[at + 1], np.repeat(n, size)[at]
    first, last = place[edge[:-1]], place[edge[1:] - 1]
    doc, which = x.doc, x.which
    taught = ~x.held[doc]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & taught[1:])
    yield last[which[same]], first[which[same + 1]], np.ones(len(same))
    full = np.flatnonzero((x.counts > 0) & ~x.held)
    end = np.full(len(full), END)
    yield end, first[which[x.at[full]]], np.ones(len(full))
    yield last[which[x.at[full + 1] - 1]], end, np.ones(len(full))
    none = int(((x.counts == 0) & ~x.held).sum())
    yield np.full(1, END), np.full(1, END), np.full(1, float(none))


def _together(x: Batch, place: np.ndarray) -> list[np.ndarray]:
    """The successions of a batch in one: each sum of them takes an array as long as all that can follow one another."""
    return [np.concatenate(part) for part in zip(*_successions(x, place), strict=True)]


def train(counted: DataFrame, size: int, total: int) -> Model:
    """The model: id counts, neighbours and class successions of all training texts in counted (batch, blob, counts), then
    rounds of descent, averaged over the partitions, which together take every window of these texts once, and the mixture.
    """
    spark, blobs = counted.sparkSession, counted.select("blob")

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size)
        for x in _batches(batches):
            out += np.bincount(x.flat, weights=np.repeat(x.times(), x.size), minlength=size)
        return out

    counts = summed(blobs, count, size)
    frequent, place = places(counts)
    n = len(frequent) + 3
    where = spark.sparkContext.broadcast(place)

    def near(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(n * 2 * TOP)
        for x in _batches(batches):
            out += neighbours(*_together(x, where.value), n)
        return out

    m = shaped(frequent, place, summed(blobs, near, n * 2 * TOP), counts)
    sent = spark.sparkContext.broadcast(m)

    def follow(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(n * CLASSES)
        for x in _batches(batches):
            a, b, k = _together(x, sent.value.place)
            out += np.bincount(a * CLASSES + sent.value.cls[b], weights=k, minlength=n * CLASSES)
        return out

    pair = summed(blobs, follow, n * CLASSES).reshape(n, CLASSES)
    prior = (pair.sum(axis=0) + 0.5) / (pair.sum() + 0.5 * CLASSES)
    m.after = _shut(np.log((pair + 5 * prior) / (pair.sum(axis=1, keepdims=True) + 5)), m.cls)
    many, tally = len(m.vector()), np.zeros(SCALE + 1)
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(m)

        def step(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> np.ndarray | None:
            own, seen_as = now.value, np.zeros(SCALE + 1)
            seen = descend(own, _taught(batches, own.place, total, seen_as), 0.02 * 0.5**turn)
            return np.concatenate([np.append(own.vector(), 1.0) * seen, seen_as]) if seen else None

        got = summed(counted.where(F.pmod(F.xxhash64("batch"), F.lit(ROUNDS)) == turn).select("blob", "counts"), step, many + SCALE + 2)
        if got[many]:
            m.set_vector(got[:many] / got[many])
        tally += got[many + 1 :]
    m.mixture = _mixture(tally)
    return m


def _taught(batches: Iterator[pa.RecordBatch], place: np.ndarray, total: int, tally: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of each batch's training texts: contexts, targets and a place for the targets' log probabilities.

    What has been put there by the time the next ones are asked for is tallied by token: how often the ratio of the counts'
    probability to the spelling's falls in each step of a fixed scale. A word does not count itself.
    """
    for x, c in _read(batches):
        seq, edge, which, to, _ = x.sequences(place, taught=True)
        ctx, target, where = windows(seq, edge)
        logs = np.zeros(target.shape, np.float32)
        yield ctx, target, logs
        lp = np.zeros(len(seq))
        lp[where[where >= 0]] = logs[where >= 0]
        if len(which):
            spelled = np.add.reduceat(np.delete(lp, edge[:-1]), to[:-1])
            u = np.maximum(c[which] - 1, 0) / max(1, total - 1)
            with np.errstate(divide="ignore"):
                at = np.where(u > 0, 1 + np.clip((np.log(u) - spelled + 20) * 10, 0, SCALE - 1), 0)
            tally += np.bincount(at.astype(np.int64), minlength=SCALE + 1)


def _mixture(tally: np.ndarray) -> float:
    """The share of the word counts in the mixture, by expectation-maximisation over all tokens of all training texts.

    The spelling's probability of a token is that of the model just before it learnt from it.
    """
    if not tally.sum():
        return 0.5
    ratio = np.concatenate([[0.0], np.exp((np.arange(SCALE) + 0.5) / 10 - 20)])
    lam = 0.5
    for _ in range(60):
        r = lam * ratio / (lam * ratio + (1 - lam))
        lam = float(np.clip((r * tally).sum() / tally.sum(), 0.01, 0.99))
    return lam


def _counted(packed: DataFrame, answered: DataFrame, buckets: int) -> DataFrame:
    """A kept table of the batches and the training counts of their distinct tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = _counts(_keys(b.column(2)[i].as_py()), answers_of(b.column(3)[i]), buckets)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in (0, 1)), pa.array([c.tobytes()], pa.binary())], names=["batch", "blob", "counts"])

    joined = packed.join(answered.select(F.col("batch").alias("b1"), "answers"), F.col("batch") == F.col("b1"))
    return keep(joined.select("batch", "blob", "key", "answers").mapInArrow(rows, "batch long, blob binary, counts binary"), "counted", block=8 << 20)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Batch, np.ndarray]]:
    """Of each row (blob, counts): the batch and the counts."""
    for b in batches:
        for blob, c in zip(b.column(0), b.column(1), strict=True):
            yield Batch(blob.as_py()), np.frombuffer(c.as_py(), np.int64)


def _position_logs(m: Model, seq: np.ndarray, at: np.ndarray, tables: tuple) -> np.ndarray:
    """Natural log probability of every position but the sequences' first (these get 0)."""
    out = np.zeros(len(seq), np.float64)
    per = 1 << 16
    ctx, target, where = windows(seq, at)
    for k in range(0, len(ctx), per):
        lp = log_probs(m, ctx[k : k + per], target[k : k + per], tables)
        good = where[k : k + per] >= 0
        out[where[k : k + per][good]] = lp[good]
    return out


def score_texts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of every whole text, under the model and under smoothed word counts.

    Texts whose crc32(id as text) mod 7 is not 2 teach (a null id counts as ''). A word's probability is the model's: the
    attention part's of its spelling and the word's share of all training tokens, mixed by one learnt weight. Null and empty
    texts are their end alone. Repeated rows teach and are scored each; equal texts score alike. A text is one row and fits a
    worker's memory. Returns the id, held_out, n_tokens (words and the end), n_known
    (tokens with a training count), train_tokens, base_score (add-one smoothed counts) and score. Other columns are
    ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    packed, buckets = _tokens(docs, id_col, text_col, spark.sparkContext.broadcast(ranks))
    answered = ask(packed, _counts_sent(buckets), _counts_answered, ["batch", "blob", "key"], "counts")
    v, total = _totals(answered)
    counted = _counted(packed, answered, buckets)
    drop(packed), drop(answered)
    model = spark.sparkContext.broadcast(train(counted, 2 * (max(ranks.values()) + 1), total))
    shift = np.log10(total + v + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tables = m.tables()
        for x, c in _read(batches):
            yield _scored(x, c, m, tables, total, shift, id_col)

    kind = docs.schema[id_col].dataType.simpleString()
    return counted.select("blob", "counts").mapInArrow(rows, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scored(x: Batch, c: np.ndarray, m: Model, tables: tuple, total: int, shift: float, id_col: str) -> pa.RecordBatch:
    n, size = len(x.counts), x.counts + 1
    seq, edge, which, to, at = x.sequences(m.place)
    lp = np.delete(_position_logs(m, seq, edge, tables), edge[:-1])
    spelled = np.add.reduceat(lp, to[:-1]) if len(which) else np.zeros(0)
    count = c[which]
    with np.errstate(divide="ignore"):
        mixed = np.logaddexp(np.log(m.mixture) + np.log(count / max(1, total)), np.log1p(-m.mixture) + spelled) / np.log(10)
    per = lambda y: np.add.reduceat(y, at[:-1]) if n else np.zeros(0)
    base = per(np.log10(count + 1.0)) - size * shift
    return pa.RecordBatch.from_arrays(
        [x.ids, pa.array(x.held), pa.array(size), pa.array(per((count > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(per(mixed))],
        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
