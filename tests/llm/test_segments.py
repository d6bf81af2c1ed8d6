"""Substring dedup: segments with equal ends and another middle are different."""

from pixelloom.llm import substrings


def test_equal_ends_with_another_middle(spark):
    rows = []
    for k in range(30):
        a = " ".join([f"a{k}"] * 13)
        rows += [(2 * k, f"{a} b{k} {a}"), (2 * k + 1, f"{a} c{k} {a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert got == {i: 26 * (i % 2) for i in range(60)}
