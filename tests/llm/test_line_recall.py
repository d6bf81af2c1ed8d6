"""Line dedup: what equals after normalisation, and how many near lines are found."""

import os
import random
import time

from pyspark.sql import functions as F

from pixelloom.llm import linededup


def gone(spark, lines):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    return {r.id for r in linededup.fuzzy_lines(docs)[0].collect()}


def test_normalised_lines(spark):
    pick = ["Page 12 of 99!", "“x” a\tb", "  A-b_c  [d] {e} <f> (g);h:'i'\"j\"?  ", "3.14, 2", "*** --- !!", "a  \t b\r"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(pick)), "k int, x string").orderBy("k").select(linededup.normalised(F.col("x")).alias("n")).collect()]
    assert got == ["page 00 of 00", "“x” a b", "abc d e f ghij", "000 0", "", "a b"]


def test_lines_equal_but_for_marks_and_numbers(spark):
    lines = ["Page 12 of 99", "page 37 of 41!", "Read on:\tnow", "(read) [on]  now?", "one other line entirely"]
    assert gone(spark, lines) == {1, 3}


def test_recall_near_the_threshold(spark):
    """A fifth of the words replaced by words of equal length (edit similarity 0.8 or more), or one letter of four words."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    whole, near = [], []
    for low, high in ((10, 20), (20, 40), (40, 60)):
        for _ in range(100):
            w = [word(rng.randint(4, 7)) for _ in range(rng.randint(low, high))]
            v, left = list(w), 0.2 * len(" ".join(w))
            for k in rng.sample(range(len(w)), len(w) // 5):
                if len(w[k]) <= left:
                    left -= len(w[k])
                    v[k] = word(len(w[k]))
            whole.append(" ".join(w)), near.append(" ".join(v))
    for _ in range(50):
        w = [word(rng.randint(5, 8)) for _ in range(4)]
        whole.append(" ".join(w)), near.append(" ".join([w[0], w[1][:2] + "0" + w[1][3:], *w[2:]]))
    found = gone(spark, whole + near)
    assert found <= set(range(350, 700))
    by = [len(found & set(range(a, a + n))) / n for a, n in ((350, 100), (450, 100), (550, 100), (650, 50))]
    assert min(by[:3]) >= 0.93 and by[3] >= 0.8, by


def test_recall_of_one_changed_word(spark):
    """In lines of 8 to 120 words one word is another one of equal length."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    sizes = (8, 12, 20, 50, 120)
    whole, near = [], []
    for n in sizes:
        for _ in range(60):
            w = [word(rng.randint(4, 7)) for _ in range(n)]
            k = rng.randrange(n)
            whole.append(" ".join(w)), near.append(" ".join([*w[:k], word(len(w[k])), *w[k + 1 :]]))
    found = gone(spark, whole + near)
    assert found <= set(range(300, 600))
    by = [len(found & set(range(300 + 60 * k, 360 + 60 * k))) / 60 for k in range(len(sizes))]
    assert min(by) >= 0.93, by


def test_every_pair_of_a_large_bucket(spark):
    """Two hundred lines begin alike; two each are near, though all their other words differ by a letter."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    head, lines = [word() for _ in range(18)], []
    for _ in range(100):
        own = [word() for _ in range(12)]
        lines += [" ".join([*head, *own]), " ".join([*head, *(w[:3] + "z" + w[4:] for w in own)])]
    rows = spark.createDataFrame(list(enumerate(lines)), "h1 long, norm string")
    blocks = {r.node: set(r.blocks) for r in linededup.simhashes(rows, linededup.common_words(rows)).collect()}
    assert max(sum(b in x for x in blocks.values()) for b in set().union(*blocks.values())) > 64
    want = {k for k in range(1, 200, 2) if blocks[k] & blocks[k - 1]}
    assert len(want) > 20
    assert gone(spark, lines) == want


def test_a_short_line_beside_one_of_over_256_characters(spark):
    """They are compared by words: four long words of twenty are others, and short."""
    same = [f"word{a}{b}" for a in "abcd" for b in "efgh"]
    lines = [" ".join([*same, *(x * 60 for x in "wxyz")]), " ".join([*same, "s", "t", "u", "v"])]
    assert gone(spark, lines) == {1}


def test_pipeline_stage_loses_no_pair(spark):
    """As above, in documents of the pipeline: the short line goes, as it comes after the long one that it links to."""
    import corpus_pipeline

    same = [f"word{a}{b}" for a in "abcd" for b in "efgh"]
    texts = [" ".join([*same, *(x * 60 for x in "wxyz")]) + "\nfirst", "second\n" + " ".join([*same, "s", "t", "u", "v"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {0: texts[0], 1: "second"}


def test_near_lines_of_a_bucket_make_no_pairs(spark, monkeypatch):
    """Lines that are all near to one another, a chain of lines each near to the next alone, and lines near to none."""
    monkeypatch.setattr(linededup, "LARGE", 64)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, chain = [word() for _ in range(20)], [word() for _ in range(20)]
    lines = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(20) for _ in range(10)]
    for k in range(40):
        for j in range(3):  # three words differ from the line before, six from the one before that
            chain[(3 * k + j) % 18] = word()
        lines.append(" ".join(chain))
    lines += [" ".join(word() for _ in range(20)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(lines)), "h1 long, norm string")
    loose = rows.select(F.lit(0).cast("long").alias("key"), F.col("h1").alias("node"), F.col("h1").alias("comp"))
    links = linededup._across(loose, rows).collect()
    root = list(range(300))
    for r in links:
        a, b = root[r.a], root[r.b]
        root = [a if x == b else x for x in root]
    groups = [sum(x == r for x in root) for r in root]
    assert groups == [200] * 200 + [40] * 40 + [1] * 60
    assert len(links) < 600  # of 19,900 pairs and more


def test_no_shuffle_stays_on_disk(spark):
    """What line dedup has shuffled goes with it, not when the driver's heap is full."""

    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {x for d in dirs for _, _, names in os.walk(d) for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(100)]
    before = files()
    gone(spark, lines + [x.replace("a", "b", 1) for x in lines])
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
