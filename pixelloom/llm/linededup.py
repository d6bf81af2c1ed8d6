"""Fuzzy line dedup: SimHash blocks of normalised lines, pigeonhole join, edit similarity, connected groups (DataFrame functions only).

A line's SimHash has BLOCKS blocks of 64 bits. Were every word to vote on every bit, one changed word would flip bits all
over the hash, and no block of a useful width would survive. So a block takes the votes of WORDS words only: those that
follow the block's place on the ring of the line's word hashes. A changed word then touches the blocks near its own hash
and leaves the others whole, and lines that agree in a whole block meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.components import components
from pixelloom.llm.tables import drop, free_shuffles, keep, size_of

#: Blocks of a SimHash and the words that vote on one; lines of up to SHORT distinct words have blocks of two words (those
#: of SHORT - 1 and more have blocks of three as well).
BLOCKS, WORDS, SHORT = 8, 3, 8
#: Words in more than this share of the lines count with their successor.
COMMON = 0.03
#: Least edit similarity of a link: 1 - Levenshtein distance / length of the longer line, over characters; over words
#: where the longer line has more than LONG characters.
SIMILARITY, LONG = 0.8, 256
#: Lines in a part of a bucket: two parts meet in a tile, so that a large bucket is many tasks' work.
LARGE = 1024
#: Comparisons of a task, about.
WORK = 1 << 21
#: Tables of ids are broadcast up to this size on disk, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: A line's characters, words, itself and its words spelled: what two lines are compared by.
FORMS = ("n", "m", "c", "u")
_PUNCTUATION = ".,;:!?\"'()[]{}<>-_*#&%$|"
#: Votes with the two words of a short block, so that no bit is tied.
_THIRD = 0x5DEECE66D1CE4E5B


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, without common punctuation, single spaces, none at the ends."""
    x = F.translate(F.lower(line), "123456789\t\r\f\x0b" + _PUNCTUATION, "000000000    ")
    # the regular expression is the slow part, and few lines need it
    x = F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x)
    return F.trim(x)


def _kind(h: Column) -> Column:
    """One of 65,536 kinds of words, by hash: few enough to count, and a kind is common only if a word of it is."""
    return h.bitwiseAND(F.lit(0xFFFF)).cast("int")


def common_words(lines: DataFrame) -> list[int]:
    """The kinds of words that occur more than COMMON times a line: at most words per line / COMMON of them."""
    n = lines.count()
    kinds = lines.select(F.explode(F.split("norm", " ")).alias("w")).groupBy(_kind(F.xxhash64("w")).alias("k")).count()
    return sorted(r[0] for r in kinds.where(F.col("count") > max(COMMON * n, 20)).select("k").collect())


def _ring(lines: DataFrame, common: list[int], places: int) -> DataFrame:
    """Of each row of lines (h1, norm): h1, how many distinct features it has (n), these in ascending order, four times over
    (ring), and in `at` the number of features before each of `places` equally spaced places.

    A word is a feature, a common one with its successor.
    """
    words = F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))
    feature = F.transform("w", lambda h, i: F.when(_kind(h).isin(common), F.xxhash64(h, F.get("w", i + 1))).otherwise(h)) if common else F.col("w")
    drawn = lines.select("h1", words.alias("w")).select("h1", F.sort_array(F.array_distinct(feature)).alias("s"))
    edges = [-(1 << 63) + k * ((1 << 64) // places) for k in range(1, places)]
    # a place is found by sorting it in: a comparison in the JVM's code for each feature would cost more
    both = F.sort_array(F.concat("s", F.array(*map(F.lit, edges))))
    at = [F.lit(0), *(F.array_position("both", F.lit(e)).cast("int") - 1 - k for k, e in enumerate(edges))]
    return drawn.select("h1", "s", both.alias("both")).select("h1", F.size("s").alias("n"), F.concat("s", "s", "s", "s").alias("ring"), F.array(*at).alias("at"))


def _votes(words: int) -> Column:
    """The blocks of the places on the ring: the bits that most of the next `words` features (3, or 2 and a constant) have."""

    def block(at: Column) -> Column:
        a, b, c = (F.get("ring", at + j) if j < words else F.lit(_THIRD) for j in range(3))
        return a.bitwiseAND(b).bitwiseOR(a.bitwiseOR(b).bitwiseAND(c))

    return F.transform("at", block)


def simhashes(lines: DataFrame, common: list[str]) -> DataFrame:
    """Each row's line (node: h1) and the blocks of its SimHash, distinct ones. lines: h1, norm."""
    none = F.array().cast("array<long>")
    three = F.when(F.col("n") >= SHORT - 1, _votes(WORDS)).otherwise(none)
    two = F.when(F.col("n") <= SHORT, _votes(2)).otherwise(none)
    return _ring(lines, common, BLOCKS).select(F.col("h1").alias("node"), F.array_distinct(F.concat(three, two)).alias("blocks"))


def _occurrence() -> Column:
    """id * 2^31 + line number: the least comes first by id, then line."""
    return (F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")


def _spelled() -> Column:
    """The words of `norm`, each as one character (by hash: two words share one with probability 2e-5)."""
    four = F.transform(F.split("norm", " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(53248)) + 256), 4, "0"))
    return F.decode(F.unhex(F.array_join(four, "")), "UTF-16BE")


def _within(a: Column, b: Column, most: Column) -> Column:
    """Whether the Levenshtein distance of two columns is at most `most`."""
    # the third argument of levenshtein has to be a constant: a step that is at least the bound, then the bound itself
    steps = [0, 4, 8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 2048, 4096, 8192, 16384]
    close = F.levenshtein(a, b) <= most
    for step in reversed(steps):
        # 0 <= d <= most, with d computed once
        close = F.when(most <= step, F.abs(F.levenshtein(a, b, step) * 2 - most) <= most).otherwise(close)
    return close


def _texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, norm) of the distinct lines in `wanted` (a kept table, column w)."""
    small = F.broadcast(wanted) if size_of(wanted) <= BROADCAST_BYTES else wanted
    return lines.select("h1", "norm").join(small, F.col("h1") == F.col("w"), "left_semi").dropDuplicates(["h1"])


def _similar(one: tuple[Column, ...], two: tuple[Column, ...]) -> Column:
    """Whether two lines, each as the columns (characters, words, by characters, by words), reach the edit similarity.

    They are compared by characters if both have LONG at most, else by words.
    """
    by_chars = (one[0] <= LONG) & (two[0] <= LONG)
    answers = []
    for size, text in ((0, 2), (1, 3)):
        n1, n2 = one[size], two[size]
        most = F.floor(F.greatest(n1, n2) * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int")
        answers.append((F.abs(n1 - n2) <= most) & _within(one[text], two[text], most))
    return F.when(by_chars, answers[0]).otherwise(answers[1])


def _forms(wordy: Column) -> list[Column]:
    """Of `norm`: its characters (n) and words (m), itself (c) if it has LONG characters at most, its words spelled (u) where wordy."""
    return [F.length("norm").alias("n"), F.size(F.split("norm", " ")).alias("m"), F.when(F.length("norm") <= LONG, F.col("norm")).alias("c"), F.when(wordy, _spelled()).alias("u")]


def _named(df: DataFrame, k: int) -> tuple[DataFrame, tuple[Column, ...]]:
    """df with k behind every name, and a line's forms by these names."""
    return df.toDF(*(f"{x}{k}" for x in df.columns)), tuple(F.col(f"{x}{k}") for x in FORMS)


def _near(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of pairs (a, b) of distinct lines (by h1), those that reach the edit similarity."""
    pairs = keep(pairs, "line-pairs")
    wanted = keep(pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct(), "wanted")
    text = keep(_texts(wanted, lines), "line-texts")
    # lines of up to LONG characters are spelled by words as well if any partner is longer
    size = text.select(F.col("h1").alias("x"), F.length("norm").alias("size"))
    long = keep(size.where(F.col("size") > LONG), "long-lines")
    small = F.broadcast(long) if size_of(long) <= BROADCAST_BYTES else long
    sides = pairs.join(small, F.col("a") == F.col("x"), "left_semi").select(F.col("b").alias("l")).unionByName(pairs.join(small, F.col("b") == F.col("x"), "left_semi").select(F.col("a").alias("l")))
    wordy = keep(sides.unionByName(long.select(F.col("x").alias("l"))).distinct(), "wordy")
    marked = F.broadcast(wordy) if size_of(wordy) <= BROADCAST_BYTES else wordy
    form = keep(text.join(marked, F.col("h1") == F.col("l"), "left").select("h1", *_forms(F.col("l").isNotNull())), "line-forms")
    drop(wanted), drop(text)
    free_shuffles(pairs.sparkSession)
    (one, first), (two, second) = (_named(form, k) for k in (1, 2))
    # a fixed number of tasks: few bytes make much work here
    tasks = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // 8192)
    joined = pairs.join(one, F.col("a") == F.col("h11")).repartition(tasks, "b").join(two, F.col("b") == F.col("h12"))
    links = keep(joined.where(_similar(first, second)).select("a", "b"), "line-links")
    for t in (pairs, long, wordy, form):
        drop(t)
    return links


def _across(loose: DataFrame, lines: DataFrame) -> DataFrame:
    """Links (a, b) between the components in a bucket, from all pairs of its lines that lie in two of them.

    loose: key, node, comp. The lines outside a bucket's largest component meet all of its lines. Both are cut into parts
    of about LARGE, every two of which meet in a tile. What leaves a tile is lines that have a partner there, never pairs;
    their components are then joined with the largest one, and with one another in rounds.
    """
    wanted = keep(loose.select(F.col("node").alias("w")).distinct(), "wanted")
    text = keep(_texts(wanted, lines).select("h1", "norm", F.length("norm").alias("size")), "line-texts")
    rows = keep(loose.join(text, F.col("node") == F.col("h1")).select("key", "node", "comp", "norm", "size"), "loose-texts")
    drop(wanted), drop(text)
    free_shuffles(loose.sparkSession)
    sized = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("some"), F.max("size").alias("size")).groupBy("key")
    sized = sized.agg(F.sum("some").alias("all"), F.max(F.struct("some", "comp")).alias("main"), F.max("size").alias("longest"))
    sized = sized.select(F.col("key").alias("k"), F.col("main.comp").alias("main"), F.col("all"), (F.col("all") - F.col("main.some")).alias("rest"), "longest")
    sized = keep(sized, "bucket-sizes")
    work = sized.agg(F.sum(F.col("all").cast("double") * F.col("rest"))).first()[0] or 0
    tasks = max(2 * loose.sparkSession.sparkContext.defaultParallelism, int(work // WORK))
    small = F.broadcast(sized) if size_of(sized) <= BROADCAST_BYTES else sized
    parts = rows.join(small, F.col("key") == F.col("k")).select("key", "node", "comp", "main", *_forms(F.col("longest") > LONG), F.ceil(F.col("rest") / LARGE).alias("lefts"), F.ceil(F.col("all") / LARGE).alias("rights"))
    once = (F.col("comp1") != F.col("comp2")) & ((F.col("comp2") == F.col("main1")) | (F.col("node1") < F.col("node2")))
    rest = "comp <> main"
    # a pair of two lines outside the largest component is compared once, by the lesser
    found = keep(_met(parts.where(rest), parts, once, tasks).select("key", "node").distinct(), "met")
    links = []
    if not found.isEmpty():
        keys, known = (F.broadcast(x) if size_of(found) <= BROADCAST_BYTES else x for x in (found.select(F.col("key").alias("k")).distinct(), found.select(F.col("key").alias("k"), F.col("node").alias("x"))))
        hot = keep(parts.join(keys, F.col("key") == F.col("k"), "left_semi"), "met-buckets")
        first = hot.join(known, (F.col("key") == F.col("k")) & (F.col("node") == F.col("x")), "left_semi")
        links.append(keep(_met(first, hot.where("comp = main"), F.lit(True), tasks).select(F.col("comp").alias("a"), F.col("main").alias("b")).distinct(), "main-links"))
        second = _met(hot.where(rest), first, (F.col("comp1") != F.col("comp2")) & (F.col("node2") < F.col("node1")), tasks)
        shown = ("key", "node", "comp", *FORMS)
        links += _joined(keep(first.select(*shown).unionByName(second.select(*shown)).dropDuplicates(["key", "node"]), "partners"), links[0], tasks)
        drop(hot)
    out = loose.where(F.lit(False)).select(F.col("comp").alias("a"), F.col("comp").alias("b"))
    for x in links:
        out = out.unionByName(x)
    out = keep(out, "cross-links")
    for t in (rows, sized, found, *links):
        drop(t)
    return out


def _met(left: DataFrame, right: DataFrame, also: Column, tasks: int) -> DataFrame:
    """The rows of left with a similar line in the same bucket of right for which `also` holds, once for each part of it.

    Parts of a bucket meet in tiles. A row leaves its tile at the first such line, so no tile gives its pairs.
    """
    sides = []
    for k, (side, own, other) in enumerate(((left, "lefts", "rights"), (right, "rights", "lefts")), 1):
        part = F.pmod(F.xxhash64("node"), F.col(own))
        met = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("met")
        dealt = side.select("*", part.alias("part"), met)
        tile = F.xxhash64("key", "part", "met") if k == 1 else F.xxhash64("key", "met", "part")
        dealt = dealt.select(tile.alias("tile"), *(left.columns if k == 1 else ("node", "comp", *FORMS)))
        sides.append(_named(dealt.repartition(tasks, "tile"), k))
    (one, first), (two, second) = sides
    kept = one.join(two, (F.col("tile1") == F.col("tile2")) & also & _similar(first, second), "left_semi")
    return kept.select(*(F.col(f"{x}1").alias(x) for x in left.columns))


def _joined(rows: DataFrame, links: DataFrame, tasks: int) -> list[DataFrame]:
    """What links (a, b) lack to join the components of similar lines in a bucket. rows: key, node, comp and forms, kept.

    In a round each line names one other component that has a line similar to it, if there is one, and these join. So a
    round gives a link a line at most, leaves half of the components at most, and lines that name none are done.
    """
    out = []
    while True:
        roots = keep(components(links).withColumnRenamed("node", "x"), "met-roots")
        free_shuffles(rows.sparkSession)
        named = rows.join(roots, F.col("comp") == F.col("x"), "left").select("key", "node", F.coalesce("root", "comp").alias("comp"), *FORMS)
        # with one line a bucket has one component
        cut = F.ceil(F.count(F.lit(1)) * 8 / LARGE).alias("parts")
        open_ = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), cut).where("c0 <> c1").select(F.col("key").alias("k"), "parts")
        now = keep(named.join(open_, F.col("key") == F.col("k")).drop("k"), "partners")
        drop(rows), drop(roots)
        rows = now
        listed = now.groupBy("key", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("comp", *FORMS)).alias("there"))
        listed = listed.select(F.col("key").alias("k"), F.col("part"), "there")
        asked = now.select("key", "node", "comp", *FORMS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("met"))
        own = tuple(F.col(x) for x in FORMS)
        other = lambda y: (y["comp"] != F.col("comp")) & _similar(own, tuple(y[x] for x in FORMS))
        # the first one found is as good as any: nothing is compared after it
        to = F.aggregate("there", F.lit(None).cast("long"), lambda found, y: F.when(found.isNull(), F.when(other(y), y["comp"])).otherwise(found)).alias("to")
        # so many tasks: few bytes make much work here
        dealt = asked.repartition(tasks, "key", "met").join(listed.repartition(tasks, "k", "part"), (F.col("key") == F.col("k")) & (F.col("met") == F.col("part")))
        told = dealt.select("key", "node", "comp", to).where("to IS NOT NULL")
        told = keep(told.groupBy("key", "node", "comp").agg(F.min("to").alias("to")), "told")
        if told.isEmpty():
            drop(rows), drop(told)
            return out
        links = keep(told.select(F.col("comp").alias("a"), F.col("to").alias("b")).distinct(), "told-links")
        out.append(links)
        left = told.select(F.col("key").alias("k"), F.col("node").alias("x"))
        rows = keep(now.join(left, (F.col("key") == F.col("k")) & (F.col("node") == F.col("x")), "left_semi").select("key", "node", "comp", *FORMS), "partners")
        drop(now), drop(told)


def _linked(lines: DataFrame) -> DataFrame:
    """(node, root) of the distinct lines (by h1) that are linked to others."""
    common = common_words(lines)
    drawn = keep(simhashes(lines, common), "simhashes", dictionary=False)
    flat = drawn.select("node", F.explode("blocks").alias("key"))
    buckets = keep(flat.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select(F.col("key").alias("k"), "leader"), "buckets")
    shared = F.broadcast(buckets) if size_of(buckets) <= BROADCAST_BYTES else buckets
    members = keep(flat.join(shared, F.col("key") == F.col("k")).select("key", "node", "leader").distinct(), "members")
    drop(drawn), drop(buckets)
    free_shuffles(lines.sparkSession)
    links = _near(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), lines)
    roots = keep(components(links), "line-roots")
    drop(links)
    free_shuffles(lines.sparkSession)
    # buckets that are not all linked yet: lines of different components are compared there, all of them
    named = members.join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    named = keep(named, "named-members")
    drop(members)
    open_ = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 <> c1 AND many > 2").select(F.col("key").alias("k"))
    loose = keep(named.join(open_, F.col("key") == F.col("k"), "left_semi"), "loose")
    drop(named)
    between = _across(loose, lines)
    drop(loose)
    if not between.isEmpty():
        # links between components: their roots' components
        joined = keep(components(between).select(F.col("node").alias("old"), F.col("root").alias("new")), "joined-roots")
        known = roots.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        fresh = joined.join(roots.select(F.col("node").alias("x")), F.col("old") == F.col("x"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
        roots = keep(known.unionByName(fresh), "line-roots")
    drop(between)
    return roots


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The lines to remove, as (id, gone: array of line numbers from 0), and the roots (node, root) of linked lines.

    See dedup_lines. Lines are told apart by two 64-bit hashes and linked by the first.
    """
    cut = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    made = cut.where("line <> ''").select("id", "pos", normalised(F.col("line")).alias("norm"))
    made = keep(made.select("id", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), "norm"), "lines", dictionary=False)
    lines = made.where("norm <> ''")  # here, as a filter before it would normalise every line twice
    roots = _linked(lines)
    free_shuffles(docs.sparkSession)
    # of every line that occurs again or is linked: the occurrence that stays
    distinct = lines.groupBy("h1", "h2").agg(F.min(_occurrence()).alias("occ"), F.count(F.lit(1)).alias("times"))
    named = keep(distinct.join(roots, F.col("h1") == F.col("node"), "left").where("times > 1 OR root IS NOT NULL").select("h1", "h2", "occ", F.coalesce("root", "h1").alias("root")), "named-lines")
    stays = named.groupBy("root").agg(F.min("occ").alias("stays")).withColumnRenamed("root", "r")
    fate = named.join(stays, F.col("root") == F.col("r")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "stays")
    gone = lines.select("id", "pos", "h1", "h2").join(fate, F.expr("h1 = g1 AND h2 = g2")).where(_occurrence() != F.col("stays")).groupBy("id").agg(F.collect_set("pos").alias("gone"))
    gone = keep(gone.withColumn("gone", F.array_sort("gone")), "gone-lines")
    drop(made), drop(named)
    free_shuffles(docs.sparkSession)
    return gone, roots


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated lines removed from their texts, and n_lines and n_removed.

    Lines end at '\\n'. They are normalised (lower case, digits as 0, no common punctuation, single spaces); lines that
    are then empty stay and link to nothing. Equal lines are linked, and lines that share a block of their SimHash and
    whose edit similarity is 0.8 or more (over characters; over words beyond 256 characters). Of every connected group
    the first occurrence stays, by id and then line number, so ties can't arise. A text may become empty; null texts stay
    null (0 lines), empty texts have one empty line, rows with a null id stay whole, an empty table gives an empty one.
    Rows that share an id count as one document: they lose lines of the same numbers. A line of any length is one line; its
    words fit a task's memory. Columns named n_lines or n_removed are replaced, others are kept as they are.
    """
    docs = docs.drop("n_lines", "n_removed")
    found, _ = fuzzy_lines(docs, id_col, text_col)
    gone = found.select(F.col("id").alias("_px_id"), F.col("gone").alias("_px_gone"))
    small = F.broadcast(gone) if size_of(found) <= BROADCAST_BYTES else gone
    out = docs.join(small, F.col(id_col) == F.col("_px_id"), "left")
    edges = F.concat(F.array(F.lit(-1)), F.col("_px_gone"), F.array(F.size("_px_lines")))
    kept = F.flatten(F.zip_with(F.slice(edges, 1, F.size("_px_gone") + 1), F.slice(edges, 2, F.size("_px_gone") + 1), lambda a, b: F.slice("_px_lines", a + 2, b - a - 1)))
    ends = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    out = out.withColumn("n_lines", F.coalesce(ends + 1, F.lit(0)).cast("long")).withColumn("_px_lines", F.when(F.col("_px_gone").isNotNull(), F.split(F.col(text_col), "\n")))
    text = F.when(F.col("_px_gone").isNull() | F.col("_px_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn(text_col, text)
    return out.select(*docs.columns, "n_lines", F.coalesce(F.size("_px_gone"), F.lit(0)).cast("long").alias("n_removed"))
