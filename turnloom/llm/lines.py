"""Fuzzy line dedup by MinHash, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import DOC_KEY, TIE_KEY, cut, discard, free_shuffles, materialize, refuse_names, with_row_key
from turnloom.llm.components import connected_components, lift_roots

#: Characters per shingle, least similarity of a link.
SHINGLE, LEAST = 5, 0.8
#: Signature values and values per band. Each value is in two bands: one of neighbours, one of values VALUES / ROWS apart.
VALUES, ROWS = 72, 6
#: Bands that are shuffled at a time.
BANDS_AT_ONCE = 4
#: Values of which a line's sketch has the lowest bit, and differing bits beyond which two lines aren't compared. At a similarity
#: of 0.8 each bit differs with a chance of 0.1, and more than 20 of 64 do with one of 5e-7.
SKETCH, FAR = 64, 20
#: Rounds of one pair per line at most, before all pairs that are left are compared.
ROUNDS = 3
#: Lines and characters of a block of a bucket; two blocks are compared at a time.
BLOCK_LINES, BLOCK_CHARS = 512, 1 << 22
#: Shingles hashed per exploded row; the aggregate's cost is per row.
STRIDE = 4
_GOLD = 0x9E3779B97F4A7C15


def normal_line(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(" \t\r"))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def masks(n: int) -> list[int]:
    """Fixed 64-bit masks; xor with one is a permutation of the hashes."""
    out, x = [], _GOLD
    for _ in range(n):
        x = (x * 0xD1342543DE82EF95 + _GOLD) % 2**64
        y = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
        out.append((y ^ (y >> 32)) - 2**63)
    return out


def band_values(values: int = VALUES, rows: int = ROWS) -> list[list[int]]:
    """The signature values of each band: the rows of a grid of all values, then its columns."""
    bands = values // rows
    return [[b * rows + r for r in range(rows)] for b in range(bands)] + [[r * bands + b for r in range(rows)] for b in range(bands)]


def bound(value: Column, of) -> Column:
    """``of(value)`` with the value evaluated once, also where ``of`` reads it in an inner function."""
    return F.get(F.transform(F.array(value), of), 0)


def shingle_set(coded: Column) -> Column:
    """The shingle hashes of a line of UTF-16 bytes, repeats included."""

    def hashes(b: Column) -> Column:
        last = F.greatest(F.length(b) - (2 * SHINGLE - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last, F.lit(2)), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * SHINGLE))))

    return bound(coded, hashes)


def different_lines(docs: DataFrame) -> DataFrame:
    """Each different line that isn't blank once: h1, h2, the least place (d, t, pos) and its UTF-16 bytes b.

    Two independent 64-bit hashes tell normalised lines apart. Occurrences are
    reduced before the shuffle, so a line that is everywhere is a row per task.
    """
    lines = docs.select(DOC_KEY, TIE_KEY, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("line", normal_line(F.col("line"))).filter("line <> ''")
    keyed = lines.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(_GOLD - 2**63), "line").alias("h2"),
        F.struct(DOC_KEY, TIE_KEY, "pos").alias("p"), "line",
    )
    firsts = keyed.groupBy("h1", "h2").agg(F.min("p").alias("p"), F.first("line").alias("line"))
    return firsts.select("h1", "h2", "p.*", F.encode("line", "UTF-16BE").alias("b"))


def line_bands(docs: DataFrame) -> DataFrame:
    """Each different line with its place (__d, __t, pos), a number ``k``, a sketch ``x`` and its band keys b0, b1 and so on.

    Shingles are runs of SHINGLE characters (UTF-16 units), or the whole of a
    shorter line. Each is hashed once; a signature value is the least xor of
    the hashes with a fixed mask, and a band is the hash of ROWS values. A
    sketch is the lowest bits of SKETCH values. The positions are exploded and aggregated again in generated code, where the
    lines lie by their hashes already: the text is shuffled once, signatures
    never. ``k`` is settled only when the table is written.
    """
    n = F.greatest(F.expr("cast(length(b) div 2 as int)") - (SHINGLE - 1), F.lit(1))
    own = ["h1", "h2", DOC_KEY, TIE_KEY, "pos"]
    at = different_lines(docs).withColumn("n", n).select(*own, "b", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(STRIDE))).alias("i"))
    places = [F.least(F.col("i") + j, F.col("n")) * 2 - 1 for j in range(STRIDE)]
    hashed = at.select(*own, *(F.xxhash64(F.substring("b", x, F.lit(2 * SHINGLE))).alias(f"s{j}") for j, x in enumerate(places)))
    least = [F.min(F.least(*(F.col(f"s{s}").bitwiseXOR(F.lit(m)) for s in range(STRIDE)))).alias(f"m{j}") for j, m in enumerate(masks(VALUES))]
    bands = [F.xxhash64(F.lit(b), *(f"m{v}" for v in values)).alias(f"b{b}") for b, values in enumerate(band_values())]
    sketch = reduce(Column.bitwiseOR, (F.shiftleft(F.col(f"m{v}").bitwiseAND(F.lit(1).cast("long")), v) for v in range(SKETCH)))
    return hashed.groupBy(*own).agg(*least).select(F.monotonically_increasing_id().alias("k"), DOC_KEY, TIE_KEY, "pos", sketch.alias("x"), *bands)


def apart(a: Column, b: Column) -> Column:
    """How many bits of two sketches differ."""
    return F.bit_count(a.bitwiseXOR(b))


def line_buckets(marked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """bucket, k of all buckets with several lines, and the tables that hold them.

    A few bands are shuffled at a time, which bounds the disk that takes. Their
    rows are dealt by bucket once: the counts and the rows of the buckets that
    stay are read from the same shuffle, for which both read the same columns.
    Buckets of two lines, as most are, are left out if the sketches are far apart.
    """
    parts = []
    bands = len(band_values())
    for first in range(0, bands, BANDS_AT_ONCE):
        few = F.array(*(f"b{b}" for b in range(first, min(bands, first + BANDS_AT_ONCE))))
        members = marked.select("k", "x", F.explode(few).alias("bucket")).repartition("bucket")
        met = members.groupBy("bucket").agg(F.count("k").alias("n"), F.bit_xor("x").alias("x"))
        met = met.filter(f"n > 2 or n = 2 and bit_count(x) <= {FAR}").select("bucket")
        parts.append(materialize(members.join(met.hint("shuffle_hash"), "bucket").select("bucket", "k", "x"), "line-buckets"))
    return reduce(DataFrame.unionByName, parts).select("bucket", "k"), parts


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """k and the normalised line at each of the places (__d, __t, pos, k)."""
    wanted = places.groupBy(DOC_KEY, TIE_KEY).agg(F.collect_list(F.struct("pos", "k")).alias("at"))
    found = docs.select(DOC_KEY, TIE_KEY, "text").join(wanted, [DOC_KEY, TIE_KEY])
    lines = bound(split_lines(F.col("text")), lambda own: F.transform("at", lambda x: F.struct(x["k"].alias("k"), F.get(own, x["pos"]).alias("line"))))
    return found.select(F.inline(lines)).select("k", normal_line(F.col("line")).alias("line"))


def similar_pairs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """ru, rv (the components) of those of the pairs (u, v) whose shingle sets have Jaccard similarity LEAST or more.

    Lines travel as text, a fifth to a tenth of their shingles' hashes.
    """
    both = (
        pairs.join(lines.toDF("u", "lu"), "u")
        .join(lines.toDF("v", "lv"), "v")
        .select("ru", "rv", shingle_set(F.encode("lu", "UTF-16BE")).alias("su"), shingle_set(F.encode("lv", "UTF-16BE")).alias("sv"))
        .select("ru", "rv", F.size(F.array_intersect("su", "sv")).alias("common"), F.size(F.array_union("su", "sv")).alias("all"))
    )
    return both.filter(f"common >= {LEAST} * all").select("ru", "rv")


def hub_pairs(members: DataFrame, tried: DataFrame | None, r: int) -> DataFrame:
    """One new pair (u, v) per line at most, with the components (ru, rv): the line and a hub of another component in one of its buckets.

    The hub of a bucket is drawn anew each round, the sooner the more buckets it
    shares (``w``): such a line lies in the middle of its group, and most others
    of the group are similar to it. Of its buckets' hubs whose sketches aren't far
    from its own a line takes the one that shares most.
    """
    u = (F.pmod(F.xxhash64("k", F.lit(r)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    late = -F.log(u) / F.pow("w", F.lit(4.0)) if r else u - F.col("w")
    drawn = members.withColumn("late", late).groupBy("bucket").agg(F.min_by("k", "late").alias("hub"), F.min_by("root", "late").alias("hub_root"), F.min_by("w", "late").alias("hub_w"), F.min_by("x", "late").alias("hub_x"))
    met = members.join(drawn, "bucket").filter(F.expr("root <> hub_root") & (apart(F.col("x"), F.col("hub_x")) <= FAR)).select("k", "root", "hub", "hub_root", "hub_w")
    if tried is not None:
        met = met.join(tried.toDF("k", "hub"), ["k", "hub"], "left_anti")
    best = F.max_by(F.struct("hub", "hub_root"), F.struct("hub_w", "hub"))
    return met.groupBy("k", "root").agg(best.alias("to")).select(F.col("k").alias("u"), F.col("to.hub").alias("v"), F.col("root").alias("ru"), F.col("to.hub_root").alias("rv"))


def cross_links(members: DataFrame, lines: DataFrame) -> DataFrame:
    """The components (ru, rv) of all similar lines that meet in a bucket and are in different ones.

    A bucket's lines are dealt to blocks, and each pair of blocks is a row whose
    lines are compared in place: sketches first, then, of lines with a near one,
    lists of buckets, as of the buckets that two lines share the least compares
    them, and of what is left shingle sets, which are made once a block; only
    links come out.
    """
    shared = members.groupBy("k").agg(F.collect_set("bucket").alias("buckets"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_LINES), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int")
    sizes = members.groupBy("bucket").agg(blocks.alias("blocks"))
    dealt = members.select("bucket", "k", "root", "x").join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("k", "bucket"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("k", "bucket", "root", "x", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def near(a: Column, b: Column) -> Column:
        return (a["root"] != b["root"]) & ((F.col("i") == F.col("j")) | (a["own"] != b["own"])) & (apart(a["x"], b["x"]) <= FAR)

    def least_shared(a: Column, b: Column) -> Column:
        return F.array_min(F.array_intersect(a["buckets"], b["buckets"])) == F.col("bucket")

    def gathered(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct(*columns)).alias("all"))

    def those_with(other: Callable[[Column, Column], Column], rows: DataFrame) -> DataFrame:
        return cut(rows.select("bucket", "i", "j", F.inline(F.filter("all", lambda a: F.exists("all", lambda b: other(a, b))))))

    slim = ["own", "k", "root", "x"]
    met = those_with(near, gathered(dealt, *slim))
    met = those_with(lambda a, b: near(a, b) & least_shared(a, b), gathered(met.join(shared, "k"), *slim, "buckets"))
    rows = gathered(met.join(lines, "k"), *slim, "buckets", "line")

    def with_set(m: Column) -> Column:
        kept = (m[c].alias(c) for c in (*slim, "buckets"))
        return F.struct(*kept, F.array_distinct(shingle_set(F.encode(m["line"], "UTF-16BE"))).alias("s"))

    def similar(a: Column, b: Column) -> Column:
        sizes = F.size(a["s"]) + F.size(b["s"])
        return (
            (a["k"] < b["k"]) & near(a, b) & least_shared(a, b)
            & (F.least(F.size(a["s"]), F.size(b["s"])) >= LEAST * F.greatest(F.size(a["s"]), F.size(b["s"])))
            & bound(F.size(F.array_intersect(a["s"], b["s"])), lambda common: common >= LEAST * (sizes - common))
        )

    def links(own: Column) -> Column:
        return F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: similar(a, b)), lambda b: F.struct(a["root"].alias("ru"), b["root"].alias("rv")))))

    return rows.select(F.inline(bound(F.transform("all", with_set), links))).distinct()


def line_classes(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Map each line ``k`` that has a similar other line to its component's root.

    Lines of one band bucket are candidates. In ROUNDS rounds every line is
    verified against one hub at most (``hub_pairs``), which joins most of each
    large group of copies. Then all pairs of different components that are left
    in a bucket are compared: no pair that met in a bucket and whose sketches
    aren't far apart is lost, whatever the rounds have found.
    """
    full, parts = line_buckets(marked)
    shares = full.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    wanted = materialize(marked.select("k", DOC_KEY, TIE_KEY, "pos", "x").join(shares, "k"), "line-wanted")
    lines = materialize(texts_of(docs, wanted), "line-texts")
    known = wanted.select("k", "w", "x").join(lines.select("k", F.length("line").alias("chars")), "k")
    members = materialize(full.join(known, "k").select("bucket", "k", F.col("k").alias("root"), "w", "x", "chars"), "line-members")
    used = [*parts, wanted, lines, members]
    tried = roots = None
    for r in range(ROUNDS + 1):
        if r < ROUNDS:
            pairs = cut(hub_pairs(members, tried, r))
            now = pairs.select("u", "v")
            tried = now if tried is None else tried.unionByName(now)
            links = similar_pairs(pairs, lines)
        else:
            links = cross_links(members, lines)
        roots, members = lift_roots(roots, members, connected_components(links.toDF("u", "v")))
        free_shuffles(docs.sparkSession)
    for table in used:
        discard(table)
    return roots


def kept_places(docs: DataFrame) -> DataFrame:
    """__d, __t and the sorted positions ``at`` of the lines that stay, of documents that keep any line that isn't blank.

    Of each component of similar lines the one of the least document and place
    stays, of each line its first place.
    """
    marked = materialize(line_bands(docs), "line-bands")
    roots = line_classes(docs, marked)
    place = F.struct(DOC_KEY, TIE_KEY, "pos")
    joined = marked.select("k", DOC_KEY, TIE_KEY, "pos").join(roots, F.col("k") == F.col("node"), "left")
    firsts = joined.groupBy(F.coalesce("root", "k")).agg(F.min(place).alias("p")).select("p.*")
    kept = materialize(firsts.groupBy(DOC_KEY, TIE_KEY).agg(F.array_sort(F.collect_list("pos")).alias("at")), "line-kept")
    discard(marked)
    return kept


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, with repeated lines taken out of ``text``, n_lines and n_removed added.

    Lines are compared over the whole corpus, in lower case and trimmed; lines
    that are blank stay and are no part of it. A line shorter than a shingle
    equals only itself. A document may lose all its lines: it stays, empty.
    Null texts stay null (no lines). Rows with equal ids are separate documents
    (``with_row_key`` orders them); of equal lines the one of the least id, row
    and position stays. A very long text costs time and memory in proportion to
    its length in the task that holds it, a line of any length is one row. All
    columns are returned as they are, except that input columns named n_lines
    or n_removed are replaced; __d, __t and __at are refused.
    """
    refuse_names(docs, "__at")
    keyed = with_row_key(docs)
    joined = keyed.join(kept_places(keyed).withColumnRenamed("at", "__at"), [DOC_KEY, TIE_KEY], "left")
    at = F.coalesce("__at", F.array().cast("array<int>"))

    def left(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        stay = F.array_sort(F.concat(F.filter(every, lambda i: normal_line(F.get(lines, i)) == ""), at))
        same = F.size(stay) == F.size(lines)
        text = F.when(same, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
        return F.struct(text.alias("text"), F.size(lines).alias("n"), (F.size(lines) - F.size(stay)).alias("gone"))

    done = joined.withColumn("__at", bound(split_lines(F.col("text")), left))
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    none = F.col("text").isNull()
    return done.select(
        *columns, F.when(~none, F.col("__at.text")).alias("text"),
        F.when(none, 0).otherwise(F.col("__at.n")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.col("__at.gone")).cast("long").alias("n_removed"),
    )
