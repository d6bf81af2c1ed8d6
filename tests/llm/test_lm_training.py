"""LM scoring: what the attention model learns from."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa

from pixelloom.llm import lm
from pixelloom.llm.words import Words


def test_every_subword_of_every_training_text_is_a_target_once():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice((0, 1, 5, 60, 300)))) for _ in range(80)] + [None, ""]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    sp = lm.Speller(lm.read_ranks(lm.VOCABULARY))
    place = np.arange(sp.size) + 3
    blob, _ = lm.Batch.blob(part, sp)
    counts = lm.Batch(blob).token_times()
    held = pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["blob", "counts"])
    want = collections.Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            want.update([lm.END, *(place[sp.spell([w.encode() for w in t.split()])[0]].tolist() if t else [])])
    total = int(counts.sum())
    parts = list(lm._taught([held], place, total, np.zeros(lm.SCALE + 1)))
    got = collections.Counter(np.concatenate([t[t != lm.PAD] for _, t, _ in parts]).tolist())
    assert got == want
    m, tally = lm.shape([np.arange(200)], np.ones(sp.size), sp.size), np.zeros(lm.SCALE + 1)
    before = m.vector()
    assert lm.descend(m, lm._taught([held], m.place, total, tally), 0.02, steps_at_least=1) == sum(len(c) for c, *_ in parts)
    # the mixture sees every token of every training text too
    assert tally.sum() == total and (m.vector() != before).any()


def test_words_are_spelled_together_as_they_are_one_by_one(monkeypatch):
    """No call per word: those of a batch are spelled in one."""
    ranks, rng = lm.read_ranks(lm.VOCABULARY), random.Random(4)
    words = ["".join(rng.choice("etaoinß中🙂\xa0'-9") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    sp = lm.Speller(ranks)
    one = [sp.one(w) for w in words]
    want = [2 * k + (j == len(ids) - 1) for ids in one for j, k in enumerate(ids)]
    bad = [*words, b"\xff\xfe", b"ab\x80"]  # no UTF-8
    flat, size = sp.spell(bad)
    assert flat[: len(want)].tolist() == want and size[:500].tolist() == list(map(len, one)) and len(size) == 502 and size.sum() == len(flat)
    monkeypatch.setattr(sp, "one", None)
    flat, size = sp.spell(words)
    assert flat.tolist() == want and size.tolist() == list(map(len, one))
    assert [len(x) for x in sp.spell([])] == [0, 0]
    w = Words(pa.array(["Ab  cd\tefg", None, "", "zß x"]), lower=True)
    assert w.joined(np.array([3, 0, 2]))[0] == "zß ab efg".encode()


def test_padding_is_no_key_and_steps_are_those_of_plain_code():
    """The gradient by shares of classes in double precision, on windows with and without padding."""
    rng = np.random.default_rng(6)
    counts = np.bincount(rng.integers(0, 300, 5000), minlength=300).astype(float)
    m = lm.shape([rng.integers(0, 300, 80) for _ in range(20)], counts, 300)
    v = m.vector()
    m.set_vector(v + rng.normal(0, 0.3, len(v)))
    seq = rng.integers(1, len(m.embed), 100)
    ctx, target, _ = lm.windows(seq, np.array([0, 5, 40, 41, 100]))
    assert (ctx == lm.PAD).any() and (ctx != lm.PAD).all(axis=1).any()
    logs = np.empty(target.shape, np.float32)
    g = lm.gradient(m, ctx, target, logs)
    real = target != lm.PAD
    e, out, mask = m.embed.astype(float)[ctx], m.out.astype(float), m.mask().astype(float)
    s = (e[:, lm.WINDOW - lm.SCORED :] @ m.wq / 4) @ (e @ m.wk).transpose(0, 2, 1) + mask + np.where(ctx == lm.PAD, -1e9, 0)[:, None]
    p = np.exp(s - s.max(axis=2, keepdims=True))
    o = p / p.sum(axis=2, keepdims=True) @ (e @ m.wv)
    z = o @ out + m.after[ctx[:, lm.WINDOW - lm.SCORED :]]
    share = np.exp(z - z.max(axis=2, keepdims=True))
    share /= share.sum(axis=2, keepdims=True)
    hit = np.eye(lm.CLASSES)[m.cls[target]]
    want = np.log((share * hit).sum(axis=2)) + m.inside[target]
    assert np.allclose(logs[real], want[real], atol=1e-4)
    assert np.allclose(lm.log_probs(m, ctx, target, m.tables())[real], want[real], atol=1e-4)
    d_out = np.einsum("nik,nic->kc", o, (share - hit) * real[:, :, None]) / real.sum()
    at = 3 * lm.WIDTH**2
    assert np.allclose(g[at : at + d_out.size], d_out.ravel(), atol=1e-5)


def test_a_step_works_its_classes_out_in_parts_that_fit_a_cache(monkeypatch):
    rng = np.random.default_rng(8)
    counts = np.bincount(rng.integers(0, 300, 5000), minlength=300).astype(float)
    m = lm.shape([rng.integers(0, 300, 80) for _ in range(20)], counts, 300)
    m.set_vector(m.vector() + rng.normal(0, 0.3, len(m.vector())))
    seq = rng.integers(1, len(m.embed), 3 * lm.STEP * lm.SCORED // 2)
    ctx, target, _ = lm.windows(seq, np.array([0, 700, 705, len(seq)]))
    assert len(ctx) > lm.STEP  # and not a whole number of parts
    room = lm.Room(m)
    assert room.z.nbytes + room.after.nbytes <= 512 << 10
    got = []
    for few in (lm.FEW, len(ctx)):
        monkeypatch.setattr(lm, "FEW", few)
        logs = np.empty(target.shape, np.float32)
        got.append((lm.gradient(m, ctx, target, logs), logs, lm.log_probs(m, ctx, target, m.tables(), few)))
    for one, two in zip(*got, strict=True):
        assert np.allclose(one, two, rtol=1e-4, atol=1e-5)
