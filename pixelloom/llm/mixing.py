"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.tables import keep

#: A rate above this is split into equal parts, whose counts are added.
PART = 32.0
#: Counts of a part go up to this: beyond it lies less than 1e-30 of a Poisson distribution of mean 32.
MOST = 160
#: Up to so many sources (at most 1.3 kB each) the table of rates is broadcast; else it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of parts joined by ':', exact in 52 bits."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Repeat each document by a Poisson count whose mean brings its source to the target weight, in a global random order.

    weights: the sources' shares (others get 0); None: shares in proportion to a source's rows to the power
    `temperature`. The expected number of rows is `epochs` times that of docs. A document's count inverts the Poisson
    distribution of mean share * rows * epochs / rows of its source at a number hashed from seed and id, so it doesn't
    depend on partitions or reruns. Rows with a null source form one source; a null id counts as the text 'null';
    repeated rows get equal counts. Returns the columns of docs, copy_no (from 1) and shuffle_key (an md5; the rows are
    dealt out and sorted by it); columns of these names in docs are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    counts = docs.groupBy(F.col(source_col).alias("_px_source")).agg(F.count(F.lit(1)).alias("_px_rows"))
    if weights is None:
        share = F.pow(F.col("_px_rows").cast("double"), F.lit(temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("" if k is None else f"={k}"), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.coalesce(F.concat(F.lit("="), F.col("_px_source").cast("string")), F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
    stats = keep(counts.withColumn("_px_share", share), "sources")
    n, rows, total = stats.agg(F.count(F.lit(1)), F.sum("_px_rows"), F.sum("_px_share")).first()
    rate = F.col("_px_share") / F.lit(total or 1.0) * F.lit(float(rows or 0) * epochs) / F.col("_px_rows")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_px_rate") / F.lit(PART))).cast("int")
    step = F.col("_px_rate") / F.col("_px_parts")
    first = F.exp(-step)
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda a, k: F.struct((a["p"] * step / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * step / k)).alias("c")),
    )["c"]
    rates = stats.select(F.col("_px_source"), rate.alias("_px_rate")).withColumn("_px_parts", parts).withColumn("_px_cdf", cdf).drop("_px_rate")
    if n <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("_px_parts")), F.lit(0), lambda s, j: s + F.size(F.filter(F.col("_px_cdf"), lambda c: c <= uniform(seed, ids, j.cast("string")))))
    one = F.size(F.filter(F.col("_px_cdf"), lambda c: c <= F.col("_px_u")))
    out = (
        docs.join(rates, docs[source_col].eqNullSafe(F.col("_px_source")))
        .withColumn("_px_u", uniform(seed, ids, "1"))
        .withColumn("_px_n", F.when(F.col("_px_parts") == 1, one).otherwise(drawn))
        .where("_px_n > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_px_n"))))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ids, F.col("copy_no").cast("string"))))
    )
    return out.select(*docs.columns, "copy_no", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB SQL of mix_sources over `{docs}` with the default parameters, for rates up to 32.
SQL = """
WITH mx_n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
mx_rate AS (SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM mx_n) * (SELECT sum(n) FROM mx_n)::DOUBLE / n AS lam FROM mx_n),
mx_cdf AS (SELECT source, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf, k FROM mx_rate, range(0, 161) r(k)),
mx_list AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM mx_cdf GROUP BY source),
mx_u AS (SELECT *, ('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM {docs}),
mx_c AS (SELECT d.*, len(list_filter(l.cdfs, lambda c: c <= d.u)) AS n FROM mx_u d JOIN mx_list l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy_no, md5('mix:order:' || doc_id || ':' || k) AS shuffle_key
FROM mx_c, unnest(range(1, n + 1)) t(k)
"""
