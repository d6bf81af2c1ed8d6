"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import chat, decontaminate, linededup, lm, media, mixing, neardup, quality, substrings, toxicity
from pixelloom.llm.components import components
from pixelloom.llm.words import Words, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def words_of(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()  # bytes split at exactly 0x20 and 0x09-0x0D


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["É", "a b", "x" * 40]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 150]))) for _ in range(n)]
    for k in range(n // 2):  # copies with few or many edits, joined passages, case
        w = texts[rng.randrange(n)].split(" ")
        for _ in range(rng.choice([0, 1, 2, 5, 12])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w).upper() if k % 7 == 0 else "\n".join([" ".join(w[:10]), " ".join(w[10:])]))
    texts += [None, "", " \t\n", "one", "One", "two words", "x" * 3000, "same " * 500, texts[0], texts[1] + " " + texts[2]]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), 1, "k") for i, t in zip(ids, texts)]
    return rows + [rows[5], (None, texts[0], None, "s1", 3, 1, "k")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words():
    texts = [None, "", " a  bc d\x0b\x85", "x" * 100, "\tq"]
    w = Words(pa.array(texts))
    assert [[w.word(k) for k in range(a, e)] for a, e in zip(w.at, w.at[1:])] == [words_of(t) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len({w.word(k) for k in range(len(h))})
    s, at = shingles(h, w.at, 2)
    assert np.diff(at).tolist() == [0, 0, 2, 1, 1]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 200)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(200)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm(docs, rows, none):
    got = lm.score_texts(docs).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter()
    for i, t, *_ in rows:
        if not held(i):
            c.update([*words_of(t, True), "END"])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t, *_ in rows:
        tok = [*words_of(t, True), "END"]
        want[i, held(i), len(tok), sum(c[x] > 0 for x in tok), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[next(t for i, t, *_ in rows if i == r.doc_id)].add(round(r.score, 4))
    assert all(len(x) == 1 for x in by.values())
    assert lm.score_texts(none).count() == 0


def test_lm_windows_score_each_once():
    at = np.array([0, 1, 30, 32, 100])
    ids = np.arange(100) + 5
    ctx, target, where = lm.windows(ids, at)
    real = where[where >= 0]
    assert sorted(real.tolist()) == [i for i in range(100) if i not in at[:-1]]
    assert (ids[where[where >= 0]] == target[where >= 0]).all()
    own = ctx[:, lm.WINDOW - lm.SCORED :]
    assert (own[where >= 0] == ids[real - 1]).all()


def test_lm_attention_is_masked_and_normalised():
    rng = np.random.default_rng(0)
    m = lm.shape([rng.integers(0, 60, 50) for _ in range(40)], np.bincount(rng.integers(0, 60, 3000), minlength=64).astype(float), 64)
    m.out = rng.normal(0, 1, m.out.shape).astype(np.float32)
    ctx = rng.integers(1, len(m.embed), (3, lm.WINDOW))
    target = rng.integers(1, len(m.embed), (3, lm.SCORED))
    a = lm.log_probs(m, ctx, target, m.tables())
    later = ctx.copy()
    later[:, -1] = 5
    b = lm.log_probs(m, later, target, m.tables())
    assert np.allclose(a[:, :-1], b[:, :-1], atol=1e-5) and not np.allclose(a[:, -1], b[:, -1], atol=1e-5)
    every = np.stack([lm.log_probs(m, ctx, np.full_like(target, t), m.tables()) for t in range(1, len(m.embed))])
    share = np.exp(every)
    share[lm.OTHER - 1] *= len(m.place)  # the place of all other ids
    assert np.allclose(share.sum(axis=0), 1, atol=1e-3)
    g = lm.gradient(m, ctx, target)
    v = m.vector()
    loss = lambda: -(lm.log_probs(m, ctx, target, m.tables()) - m.inside[target]).mean()
    for k in rng.integers(0, len(v), 12):
        d = np.zeros_like(v)
        d[k] = 1e-2
        m.set_vector(v + d)
        up = loss()
        m.set_vector(v - d)
        assert abs((up - loss()) / 2e-2 - g[k]) < 2e-3
    m.set_vector(v)


def labelled(spark, n=400):
    rng = random.Random(5)
    clean = ["".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["vilest", "odious", "loathsome", "wretch", "scoundrel", "blighter"]
    rows, labels = [], []
    for i in range(n):
        toxic, good = i % 4 == 0, i % 3 > 0
        w = [rng.choice(clean) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ",", ".", "s"])
        if not good:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 10 * len(w), 1, "k"))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None, None, None, None, 1, "k"), (n + 1, "", "en", "s0", 0, 1, "k"), (None, "vilest wretch odious blighter loathsome", "en", "s0", 1, 1, "k")]
    labels += [(0, 1, 1), (None, 1, 1), (n, None, None), (n + 9, 1, 0), (n + 1, 7, -1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels if x[0] is not None and x[0] < n}


def test_toxicity(spark, none):
    docs, labels, truth = labelled(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id][2] for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.predicted for r in got}[400] == 0 and {r.doc_id: r.predicted for r in got}[401] == 0 and {r.doc_id: r.predicted for r in got}[None] == 1
    stays = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert stays == {r.doc_id for r in got if not r.predicted}
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_samples_of_either_class_do_not_shift_scores(spark, monkeypatch):
    """More labelled rows than examples: as many of either class are drawn, whatever their shares."""
    docs, labels, truth = labelled(spark)
    monkeypatch.setattr(toxicity, "EXAMPLES", 40)
    monkeypatch.setattr(quality, "LABELLED", 60)
    for got, place in ((toxicity.score_toxicity(docs, labels), 2), (quality.score_quality(docs, labels), 1)):
        got = [r for r in got.collect() if r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][place] for r in got) >= 0.93 * len(got)
        assert abs(np.mean([r.score for r in got]) - np.mean([truth[r.doc_id][place] for r in got])) < 0.06


def test_toxicity_index_is_exact():
    rng = random.Random(2)
    idf = np.linspace(1, 4, 40)
    draw = lambda: tuple(sorted(rng.sample(range(40), rng.randint(0, 9))))
    examples = [(t, tuple(rng.randint(1, 3) for _ in t), rng.randint(0, 1), i) for i, t in enumerate(draw() for _ in range(700))]
    ix = toxicity.Index.build(idf, examples)
    order = [x for _, x in sorted((toxicity.vector_key(*e[:2]), e[:2]) for e in {e[:2]: e for e in examples}.values())]
    dense = np.zeros((len(order), 41))
    for i, (t, c) in enumerate(order):
        a, w, k = ix.vector(t, c, idf)
        dense[i, a], dense[i, 40] = w, k
    assert np.allclose((dense**2).sum(axis=1), 1)
    for _ in range(50):
        t = draw()
        c = tuple(rng.randint(1, 3) for _ in t)
        a, w, k = ix.vector(t, c, idf)
        q = np.zeros(41)
        q[a], q[40] = w, k
        cos = np.round(dense @ q, 12)
        want = np.lexsort((np.arange(len(cos)), -cos))[: toxicity.NEIGHBOURS]
        best, got = ix.nearest(t, c)
        assert np.allclose(got, cos[want], atol=1e-9)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, rows, none, n):
    sets, group = {}, {}
    for i, t, *_ in rows:
        w = words_of(t, True)
        s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        if i is not None:
            sets[i] = s
            group[i] = i
    for _ in range(len(sets)):
        before = dict(group)
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    got = neardup.near_duplicates(docs, n).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)
    kept = neardup.keep_one(docs, n)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([*{i for i in sets if group[i] == i}, None])
    assert neardup.near_duplicates(none, n).count() == 0 and neardup.keep_one(none).count() == 0


def test_near_duplicates_in_one_bucket_of_many_components(spark, monkeypatch):
    """Near-threshold variants of one text, with tiles far smaller than the group."""
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(100), rng.choice([2, 4, 5, 6, 7])):
            w[k] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(w))
    rows = [(i, t, None, None, None, 1, "") for i, t in enumerate(texts)]
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    group = list(range(len(sets)))
    for _ in range(20):
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert len(set(group)) > 5
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == dict(enumerate(group))


def test_minhash_estimate():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for j in (0.0, 0.5, 0.8, 1.0):
        both = int(2000 * 2 * j / (1 + j) + 0.5)
        x, y = a[:2000], np.concatenate([a[:both], rng.integers(0, 2**63, 2000 - both).astype(np.uint64)])
        low = neardup.minima(np.concatenate([x, y]), np.array([0, 2000, 4000]))
        p = neardup.pack(low)
        assert abs(neardup.similarity(p[0], p[1]) - j) < 0.14


def test_chat(spark):
    talk = {
        1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["b"], 6: ["a"], 7: [f"t{k}" for k in range(600)], 8: [f"t{k}" for k in range(300)],
        9: [None, "q"], None: ["z", "y"],
    }
    rows = [(c, k, "user" if k % 2 == 0 else None, t, "extra") for c, turns in talk.items() for k, t in enumerate(turns)]
    rows += [rows[0], (5, None, "system", "", "extra")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)).collect()
    assert {(r.conv_id, r.part, r.n_turns) for r in got} == {(2, 0, 3), (4, 0, 2), (5, -1, 1), (5, 0, 1), (7, 0, 256), (7, 1, 256), (7, 2, 88), (9, 0, 2), (None, 0, 2)}
    assert next(r.rendered for r in got if r.conv_id == 4) == "<|user|>\na<|end|>\n<|unknown|>\nx<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(6)
    item = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    items = [item(n) for n in (30, 15, 13, 7, 1, 60, 20)]
    fill = lambda: item(25)
    changed = list(items[0])
    for k in (4, 11, 19, 27):
        changed[k] = "other"
    rows = {
        1: fill() + items[0] + fill(), 2: fill() + changed, 3: items[1], 4: items[5][20:36] + fill(), 5: items[5][20:30] + fill(), 6: fill(), 7: fill() + items[3] + fill(),
        8: fill() + ["w1"] * 0 + items[4], 9: [w.upper() for w in items[6]] + items[2], 10: [],
    }
    docs = spark.createDataFrame([(i, " ".join(w), None, None, None, 1, "") for i, w in rows.items()] + [(11, None, None, None, None, 1, ""), (None, " ".join(items[1]), None, None, None, 1, "")], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (92, " ".join(items[1]), "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(docs, bench).collect()}
    assert set(got) >= {(1, 0), (2, 0), (3, 1), (3, 92), (4, 5), (7, 3), (8, 4), (9, 6), (9, 2), (None, 1), (None, 92)}
    chance = {(i, k) for i, w in rows.items() for k in (4,) if items[4][0] in w}  # the one-word item, wherever it occurs
    assert set(got) - chance == {(1, 0), (2, 0), (3, 1), (3, 92), (4, 5), (7, 3), (9, 6), (9, 2), (None, 1), (None, 92)} - chance
    assert (got[1, 0].words, got[1, 0].matched, got[1, 0].doc_start, got[1, 0].item_start) == (30, 30, 25, 0)
    clean = decontaminate.drop_overlapping(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {*rows, 11} - {i for i, _ in got}
    assert decontaminate.find_overlaps(none, bench).count() == 0 and decontaminate.find_overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_overlapping(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_in_blocks(spark, monkeypatch, docs):
    bench = spark.createDataFrame([(i, t) for i, t, *_ in corpus()[:9]], "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.find_overlaps(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {tuple(r) for r in decontaminate.find_overlaps(docs, bench).collect()} == whole and whole


def test_quality(spark, none):
    docs, labels, truth = labelled(spark)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_co_training_hands_over_labels():
    rng = np.random.default_rng(3)
    n = 600
    y = rng.integers(0, 2, n)
    view = lambda base: (np.arange(n), base + y * 7 + rng.integers(0, 7, n), np.ones(n))
    known = np.where(np.arange(n) < 80, y, -1)
    m = quality.Model((view(0), view(50)), n, known)
    assert len(m.handed) == quality.ROUNDS and min(m.handed[-1]) > 0
    assert ((m.score((view(0), view(50)), n)[0] >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("hot,limit", [(2000, 1 << 15), (2, 1 << 15), (2000, 20)])
def test_substrings(docs, rows, none, monkeypatch, hot, limit):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "AUTOMATON_WORDS", limit)
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for s in range(len(w) - 12):
            if i is not None:
                k = tuple(w[s : s + 13])
                first[k] = min(first.get(k, i), i)
    want = collections.Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if i is not None and first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    got = substrings.remove_repeats(docs, ("n_words", "n_removed", "spans", "kept_text", "kept_sha256")).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got) and sum(r.n_removed for r in got) > 500
    assert substrings.remove_repeats(none).count() == 0


def test_automaton_knows_first_documents():
    rng = random.Random(9)
    a, seen = substrings.Automaton(), {}
    for doc in range(60):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        runs = [tuple(words[k : k + 4]) for k in range(len(words) - 3)]
        assert a.first_docs(words, 4) == [seen.get(r) for r in runs]
        a.add(words, doc)
        for r in runs:
            seen.setdefault(r, doc)


def test_media(docs, rows, none):
    got = media.media_columns(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter((i, t or "") for i, t, *_ in rows)
    for r in got:
        text = bytes(r.payload)[: r.n_bytes].decode()
        want[r.doc_id, text] -= 1
        assert len(r.payload) % 192 == 0 and len(r.payload) > 0 and bytes(r.payload)[r.n_bytes :].strip(b" ") == b""
        s = media.parse(bytes(r.media))
        assert r.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.tail_crc32 == zlib.crc32(bytes(r.payload)[-16:])
        assert r.frames == len(r.payload) // 192 == len(s.offsets) and r.seconds_num * 48000 == r.frames * 1152 * r.seconds_den and r.seek_offsets == s.offsets and r.checksums_ok == r.frames + 1
    assert not +want and not -want
    assert media.media_columns(none).count() == 0


def test_media_parser_resynchronises_and_checks():
    data = media.store(b"payload " * 240, 1920)
    clean = media.parse(data)
    assert (len(clean.offsets), clean.bad, clean.skipped, clean.tags["n_bytes"], clean.table_frames) == (10, 0, 0, "1920", 10)
    cut = clean.offsets[4]
    torn = b"junk\xff\xfb\x00" + data[:cut] + b"\xff\xe0noise\xff" + data[cut:] + b"TAG" + b"title".ljust(125, b"\0")
    s = media.parse(torn)
    assert len(s.offsets) == 10 and s.skipped > 0 and s.seconds == clean.seconds and s.tags["TIT2"] == "title"
    bad = bytearray(data)
    bad[clean.offsets[2] + 10] ^= 1
    assert media.parse(bytes(bad)).bad == 1
    bad = bytearray(data)
    bad[clean.offsets[2] + 50] ^= 1
    with pytest.raises(ValueError):
        media.payload_of(bytes(bad), media.parse(bytes(bad)))
    assert media.parse(b"").seconds == 0 and media.parse(b"\xff" * 50).offsets == []
    for word, size, samples in ((0xFFFB9064, 417, 1152), (0xFFF36444, 144, 576), (0xFFFD8404, 384, 1152), (0xFFFF9404, 288, 384)):
        assert (media.header(word).size, media.header(word).samples) == (size, samples), hex(word)
    assert media.header(0xFFFBF064) is None and media.header(0x12345678) is None


def test_media_tables_of_other_writers():
    frame = bytes.fromhex("fffb9064")
    plain = frame + bytes(413)  # 417 bytes, MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    xing = frame + bytes(32) + b"Xing" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + (2502).to_bytes(4, "big") + bytes(range(100))
    s = media.parse(xing.ljust(417, b"\0") + plain * 5)
    assert (s.table, s.table_frames, s.table_bytes, s.toc) == ("Xing", 5, 2502, bytes(range(100))) and len(s.offsets) == 5
    assert s.offsets[0] == 417 and np.diff(s.offsets).tolist() == [417] * 4
    vbri = frame + bytes(32) + b"VBRI" + bytes(6) + (2919).to_bytes(4, "big") + (6).to_bytes(4, "big")
    s = media.parse(vbri.ljust(417, b"\0") + plain * 6)
    assert (s.table, s.table_frames, s.table_bytes) == ("VBRI", 6, 2919) and len(s.offsets) == 6
    short = bytes.fromhex("fff39064")  # MPEG-2: frames of 208 bytes
    for end in range(36, 60):
        media.parse((short + bytes(32) + b"VBRI" + bytes(40))[:end])
        media.parse((frame + bytes(32) + b"VBRI" + bytes(40))[:end])


def test_near_duplicates_of_repeated_rows(spark):
    """Two near texts, each row many times: one node each, and no square of repeats."""
    a = " ".join(f"w{k}" for k in range(60))
    b = a.replace("w30", "other")
    rows = [(1, a, None, None, None, 1, "")] * 200 + [(2, b, None, None, None, 1, "")] * 200 + [(3, a, None, None, None, 1, "")]
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect())
    assert got == {(1, 1, True): 200, (2, 1, False): 200, (3, 1, False): 1}


def test_mixing(spark, docs, rows, none):
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(1).alias("copy_no"))
    out = mixing.mix_sources(big, weights={"hot": 1.0, "s1": 2.0, None: 1.0}).groupBy("source").count().collect()
    share = {r.source: r["count"] for r in out}
    assert set(share) == {"hot", "s1", None}
    assert abs(share["hot"] - 1500) < 160 and abs(share["s1"] - 3000) < 220 and abs(share[None] - 1500) < 160
    got = mixing.mix_sources(docs)
    assert got.columns == [*docs.columns, "copy_no", "shuffle_key"]
    again = mixing.mix_sources(docs.repartition(7))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    lam = lambda n, tot, w: w / tot * len(rows) / n
    n = collections.Counter(r[3] for r in rows)
    total = sum(math.sqrt(x) for x in n.values())
    want = collections.Counter()
    for i, _, _, s, *_ in rows:
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}:1".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, p, c = lam(n[s], total, math.sqrt(n[s])), 0, None, 0.0
        p = c = math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want.update({(i, j): 1 for j in range(1, k + 1)})
    assert collections.Counter((r.doc_id, r.copy_no) for r in got.collect()) == want
    assert mixing.mix_sources(none).count() == 0


def brute_lines(rows):
    """(id, line number, normalised line) of the lines that count."""
    norm = lambda s: " ".join(re.sub(r"[.,;:!?\"'()\[\]{}<>\-_*#&%$|]", "", re.sub("[1-9]", "0", s.lower())).replace("\t", " ").split(" ")).strip()
    return [(i, k, re.sub(" +", " ", norm(x))) for i, t, *_ in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if norm(x)]


def line_blocks(spark, lines):
    """The SimHash blocks of each distinct line, bit by bit."""
    texts = {x for _, _, x in lines}
    words = sorted({w for x in texts for w in x.split(" ")})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    count = collections.Counter(h[w] & 0xFFFF for _, _, x in lines for w in x.split(" "))
    common = {k for k, n in count.items() if n > max(linededup.COMMON * len(lines), 20)}
    pairs = {(h[a], h.get(b)) for x in texts for a, b in zip(x.split(" "), [*x.split(" ")[1:], None])}
    ab = spark.createDataFrame(sorted(pairs, key=str), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("p"))
    both = {(r.a, r.b): r.p if r.a & 0xFFFF in common else r.a for r in ab.collect()}
    feature = {(a, b): both[h[a], h.get(b)] for x in texts for a, b in zip(x.split(" "), [*x.split(" ")[1:], None])}
    out = {}
    for x in texts:
        s = sorted({feature[p] for p in zip(x.split(" "), [*x.split(" ")[1:], None])})
        got = set()
        for words in ([3] if len(s) >= 7 else []) + ([2] if len(s) <= 8 else []):
            for k in range(8):
                at = sum(f < -(2**63) + k * 2**61 for f in s)
                votes = [s[(at + j) % len(s)] for j in range(words)] + [0x5DEECE66D1CE4E5B] * (3 - words)
                got.add(sum((sum(v >> b & 1 for v in votes) >= 2) << b for b in range(64)))
        out[x] = got
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar_lines(a, b):
    if max(len(a), len(b)) > 256:
        a, b = a.split(" "), b.split(" ")
    most = 0.2 * max(len(a), len(b)) + 1e-9
    return abs(len(a) - len(b)) <= most and edits(a, b) <= most


def line_groups(blocks):
    """The group of each line, by comparing every pair."""
    texts = sorted(blocks)
    group = {x: x for x in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[:k]:
            if blocks[a] & blocks[b] and similar_lines(a, b):
                group[find(a)] = find(b)
    return find


def test_line_dedup(spark, none):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, long = [line(8) for _ in range(5)], [line(300) for _ in range(4)]
    rows = []
    for i in range(40):
        body = [line(rng.randint(1, 30)) for _ in range(4)] + [" ".join([*shared[3].split(" ")[: rng.randint(5, 8)], rng.choice(vocab)])]
        body[1:1] = [rng.choice(shared).upper() + rng.choice(["", "!!", " ."]), "", f"the page of the {line(6)}"]
        w = rng.choice(long).split()
        w[rng.randrange(300)] = rng.choice(vocab)
        rows.append((i, "\n".join([*body, " ".join(w), "***", "***"]), None, None, None, 1, ""))
    rows += [(50, None, None, None, None, 1, ""), (51, "", None, None, None, 1, ""), (None, shared[0], None, None, None, 1, ""), (52, shared[0], None, None, None, 1, ""), rows[3]]
    rows += [(60, line(1300), None, None, None, 1, "")] * 40  # one row many times, with a long line
    docs = spark.createDataFrame(rows, DOCS)
    gone, roots = linededup.fuzzy_lines(docs)
    lines = sorted(set(brute_lines(rows)))
    every = [x for x in brute_lines(rows)]
    blocks = line_blocks(spark, every)
    h = {r.h: r.norm for r in spark.createDataFrame([(x,) for x in blocks], "norm string").select("norm", F.xxhash64("norm").alias("h")).collect()}
    common = linededup.common_words(spark.createDataFrame(every, "id long, pos int, norm string"))
    assert common  # 'the', 'page', 'of'
    drawn = linededup.simhashes(spark.createDataFrame([(k, x) for x, k in zip(h.values(), h)], "h1 long, norm string"), common).collect()
    assert {h[r.node]: {b % 2**64 for b in r.blocks} for r in drawn} == blocks
    find = line_groups(blocks)
    first, want = {}, collections.defaultdict(set)
    for i, k, x in lines:
        r = find(x)
        if first.setdefault(r, (i, k)) != (i, k):
            want[i].add(k)
    assert {r.id: set(r.gone) for r in gone.collect()} == want
    assert roots.count() > 20 and any(len(x) > 256 and find(x) != x for x in blocks)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect())
    assert got == collections.Counter((i, t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]), 0 if t is None else t.count("\n") + 1, 0 if i is None else len(want[i])) for i, t, *_ in rows)
    assert linededup.dedup_lines(none).count() == 0


def test_lines_of_one_large_bucket(spark, monkeypatch):
    """Many lines share one block; in the finer sub-buckets every group of near lines is found whole."""
    monkeypatch.setattr(linededup, "LARGE", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    head = [word() for _ in range(6)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(20)]
        texts.append([*head, *own])
        for _ in range(2):
            near = list(own)
            near[rng.randrange(20)], near[rng.randrange(20)] = word(), word()
            texts.append([*head, *near])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    gone = {r.id for r in linededup.fuzzy_lines(docs)[0].collect()}
    assert not any(k % 3 == 0 for k in gone) and len(gone) >= 0.95 * 120


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled(spark)
    more = [(900, "alpha beta gamma " * 9, "en", "s9", 5, 1, "k"), (901, "alpha beta gamma " * 9, "en", "s9", 5, 1, "k")]
    item = " ".join(f"b{k}" for k in range(20))
    more += [(902, f"before {item} after", "en", "s9", 5, 1, "k")]
    docs.unionByName(spark.createDataFrame(more, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r.doc_id for r in rows}
    assert got and 902 not in got
    assert not any(r.text for r in rows if r.doc_id == 901)  # its only line is in document 900
    assert not got & {i for i, t in truth.items() if t[2] and zlib.crc32(str(i).encode()) % 5}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, start, str(tmp_path)).columns == start.columns
        assert stage(spark, start.limit(0), str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage again by plain code (but for the classifier, which is asked which rows it rejects)."""
    import corpus_pipeline
    from test_overlaps import brute

    rng = random.Random(21)
    rows = [r for r in corpus(21, 30) if r[1] is None or len(r[1]) < 1500]
    vocab = [f"v{k}" for k in range(400)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (14, 20, 13)]
    rows += [(2000 + k, " ".join(rng.choice(vocab) for _ in range(9)) + " " + " ".join(w), "en", "s1", 9, 1, "k") for k, w in enumerate(items)]
    rows += [(2100 + k, " ".join(["vilest", "wretch", *(rng.choice(vocab) for _ in range(12))]), "en", "s0", 9, 1, "k") for k in range(12)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(2100 + k, 1, 1) for k in range(9)] + [(r[0], 1, 0) for r in rows[:25]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    bad = {(r.doc_id, r.predicted) for r in toxicity.score_toxicity(docs, labels).collect()}
    bad = {i for i, p in bad if p}
    assert {2100, 2108} & bad and len(bad) < 16
    now = [r for r in rows if r[0] not in bad]
    lines = brute_lines(now)
    find, first, gone = line_groups(line_blocks(spark, lines)), {}, collections.defaultdict(set)
    for i, k, x in sorted(set(lines)):
        if first.setdefault(find(x), (i, k)) != (i, k):
            gone[i].add(k)
    cut = lambda i, t: t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
    now = [(i, cut(i, t), *r) for i, t, *r in now]
    sets = {}
    for i, t, *_ in now:
        w = words_of(t, True)
        if i is not None:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    group = {i: i for i in sets}
    for _ in sets:
        before = dict(group)
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    seen, kept = set(), []
    for r in now:
        if r[0] is None or (group[r[0]] == r[0] and r[0] not in seen):
            kept.append(r)
            seen.add(r[0])
    kept = [r for r in kept if not any(brute(w, (r[1] or "").lower().split()) for w in items)]
    n = collections.Counter(r[3] for r in kept)
    total = sum(math.sqrt(x) for x in n.values())
    want = collections.Counter()
    for r in kept:
        u = int(hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) / 2**52
        rate = math.sqrt(n[r[3]]) / total * len(kept) / n[r[3]]
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want.update({(r[0], r[1], j): 1 for j in range(1, k + 1)})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.text, r.copy_no) for r in got) == want
    assert len(kept) < len(now) < len(rows) and not {2000, 2001, 2002} & {r.doc_id for r in got}


def test_registered_queries(spark):
    import __spark_entry__

    names = [q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
