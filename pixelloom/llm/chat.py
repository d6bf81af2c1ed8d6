"""Chat formatting: collapse cumulative snapshots of conversations, then render (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation hashed and rendered together; longer ones take several rows and a second level of hashes.
CHUNK = 256


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Keep the conversations that are no prefix of another, and render them.

    A conversation is the set of its distinct rows, ordered by turn, role and text. It goes if a longer one starts
    with exactly its turns (a turn number's rows are taken together), or if an equal one has a smaller id. Prefixes are
    compared by two independent 64-bit rolling hashes. Null ids form one conversation (the smallest id); a null turn
    counts as -1, a null role as 'unknown', a null text as ''. Returns one row per 256 turn numbers of a kept
    conversation: conv_id, part (from 0), n_turns (in this row) and rendered; other columns are ignored.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("part", F.floor(F.col("turn") / CHUNK))
    # one row per turn number: XOR of its distinct rows' hashes
    row = t.select("conv_id", "part", "turn", *(F.xxhash64(F.lit(s), "turn", "role", "text").alias(f"r{s}") for s in (1, 2))).distinct()
    turn = row.groupBy("conv_id", "part", "turn").agg(F.bit_xor("r1").alias("h1"), F.bit_xor("r2").alias("h2"), F.count(F.lit(1)).alias("n"))
    part = turn.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"), F.sum("n").alias("pn"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"p{s}").over(before), F.lit(0)).alias(f"b{s}") for s in (1, 2)), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn"))
    upto = Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turn.select("conv_id", "part", "turn", *(F.bit_xor(f"h{s}").over(upto).alias(f"c{s}") for s in (1, 2)), F.sum("n").over(upto).alias("cn"))
    prefix = (
        rolled.alias("x")
        .join(base.alias("y"), F.expr("x.conv_id <=> y.conv_id AND x.part = y.part"))
        .select(F.col("x.conv_id").alias("conv_id"), F.expr("c1 ^ b1").alias("h1"), F.expr("c2 ^ b2").alias("h2"), (F.col("cn") + F.col("bn")).alias("n"))
    )
    full = turn.groupBy("conv_id").agg(F.bit_xor("h1").alias("f1"), F.bit_xor("h2").alias("f2"), F.sum("n").alias("fn"))
    # of equal conversations the smallest id stays; their prefixes are the same, so one of them speaks for all
    first = full.groupBy("f1", "f2", "fn").agg(F.min(F.struct("conv_id")).alias("s")).select("f1", "f2", "fn", F.col("s.conv_id").alias("conv_id"))
    proper = prefix.alias("p").join(full.alias("q"), F.expr("p.conv_id <=> q.conv_id AND p.n < q.fn")).select("h1", "h2", "n").distinct()
    kept = first.join(proper, F.expr("f1 = h1 AND f2 = h2 AND fn = n"), "left_anti").select(F.col("conv_id").alias("k"))
    said = F.transform(F.array_sort(F.col("turns")), lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("<|end|>\n")))
    return (
        t.join(kept, F.expr("conv_id <=> k"), "left_semi")
        .groupBy("conv_id", "part")
        .agg(F.collect_set(F.struct("turn", "role", "text")).alias("turns"))
        .select("conv_id", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"), F.array_join(said, "").alias("rendered"))
    )


#: DuckDB SQL of format_chats over `conversations`.
SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT conv_id, turn, count(*) AS n, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY role, text)) AS h FROM t GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, sum(n) OVER w AS n, md5(string_agg(turn || ':' || h, ';') OVER w) AS h FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
f AS (SELECT conv_id, max(n) AS n, arg_max(h, turn) AS h FROM p GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n, h FROM f GROUP BY n, h),
kept AS (SELECT conv_id FROM k WHERE NOT EXISTS (SELECT 1 FROM p JOIN f ON p.conv_id = f.conv_id AND p.n < f.n WHERE p.h = k.h AND p.n = k.n))
SELECT conv_id, floor(turn / 256.0)::BIGINT AS part, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY 1, 2
"""
