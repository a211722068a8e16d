"""Removal of repeated line runs (operator 10, DataFrame functions only).

The corpus is a set of line sequences, a line's ID its 128-bit hash. The suffixes that begin at each
line are ordered by prefix doubling: a suffix's rank is its first line's ID and how many suffixes
with that line come before it. The rank by the first w lines here and that w lines on give the rank
by 2w. Names of a level are numbered in range partitions, so no task sorts all names; suffixes whose
prefix occurs once, or whose document ends, leave as their rank is final. The levels go on until
none is left: the ranks are then the suffix array.

Where a name parts from its neighbour the two share w lines and what is common after these, which
the stored levels tell by binary descent: the longest common prefixes. They cut the suffix array
into intervals; within one, every place but the first, in (doc_id, line) order, is a later copy.
Consecutive ones join to maximal repeated runs, and these are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import free_prefix, jvm_collected, met, scratch, stored

WORD = r"[^\x20\x09-\x0D]"
KEY = ["doc_id", "t"]
#: Names that a task sorts.
PART_NAMES = 100_000
#: Most bits, a power of two, of the map that tells texts with later copies from others: 262144 words at most are broadcast.
BITS = 1 << 24
#: A suffix's rank, and that of the one it is paired with: whether its document goes on that far, and its rank.
RANK = ["a", "b", "r"]
NEXT = ["on", "next_a", "next_b", "next_r"]


def letting(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def written_lines(text: Column) -> Column:
    """Indexes, in the text's \\n-split lines, of those that hold a word."""
    return letting(F.split(text, "\n"), lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: a[i].rlike(WORD)))


def keyed(docs: DataFrame) -> DataFrame:
    """The two columns that tell documents apart: doc_id, and a hash of the text for rows that share it."""
    return docs.withColumn("t", F.xxhash64("text"))


def suffixes(docs: DataFrame) -> DataFrame:
    """KEY, o, rest (lines from here to the end), a, b (the line's ID) of every written line. Rows
    that share id and text are one document."""
    texts = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).where("doc_id IS NOT NULL AND text IS NOT NULL").select(*KEY, "text")
    line = letting(F.split("text", "\n"), lambda a: F.transform(F.filter(a, lambda x: x.rlike(WORD)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))))
    lines = texts.select(*KEY, line.alias("x")).dropDuplicates(KEY).select(*KEY, F.size("x").cast("long").alias("n"), F.posexplode("x").alias("o", "x"))
    return lines.select(*KEY, F.col("o").cast("long").alias("o"), (F.col("n") - F.col("o")).alias("rest"), "x.a", "x.b")


def placed() -> Column:
    return F.struct(*KEY, "o")


def ordered(rows: DataFrame, order: list[str], most: int) -> tuple[DataFrame, WindowSpec]:
    """rows (at most `most`) with `part`: the number of their range partition, stored as it must not
    change; and the order within parts."""
    rows = rows.repartitionByRange(max(1, -(-most // PART_NAMES)), *order).withColumn("part", F.spark_partition_id())
    return stored(rows, "ranged"), Window.partitionBy("part").orderBy(*order)


def numbered(names: DataFrame, most: int) -> DataFrame:
    """The names of a level (RANK, NEXT, copies, first) with `s`, the count after which their
    suffixes stand among those of their first line, and for all but the first name of a rank p: the
    first place of the name before, and p_on: whether that one goes on."""
    order, rank = [*RANK, *NEXT], F.struct(*RANK)
    rows, within = ordered(names, order, most)
    near = F.struct(rank.alias("rank"), F.col("on"), F.col("first"))
    rows = rows.withColumns({"near": F.lag(near).over(within), "at": F.sum("copies").over(within) - F.col("copies")})
    changes = F.col("near").isNull() | (F.col("near.rank") != rank)
    # a row for each part of the sort: few, however many names there are. A rank that goes on from
    # the part before began where that part's last rank did
    inside = rows.withColumn("begins", F.last(F.when(changes, F.col("at")), True).over(within))
    last = F.struct(*order)
    parts = inside.groupBy("part").agg(F.sum("copies").alias("n"), F.min(rank).alias("low"), F.max(rank).alias("high"), F.max_by(near, last).alias("last"), F.max_by("begins", last).alias("begins"))
    by = Window.orderBy("part")
    parts = parts.withColumns({"before": F.sum("n").over(by) - F.col("n"), "last": F.lag("last").over(by), "from": F.coalesce(F.col("low") == F.lag("high").over(by), F.lit(False))})
    own = F.when(~(F.col("from") & (F.col("low") == F.col("high"))), F.col("before") + F.col("begins"))
    parts = parts.withColumn("carried", F.when(F.col("from"), F.last(own, True).over(by.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.join(F.broadcast(parts.select("part", "before", "last", "carried")), "part").withColumn("at", F.col("before") + F.col("at"))
    start = F.when(F.col("near").isNull(), F.coalesce("carried", "at")).when(changes, F.col("at"))
    rows = rows.withColumn("begins", F.last(start, True).over(within)).withColumn("near", F.coalesce("near", "last"))
    same = F.col("near.rank") == rank
    return rows.select(*RANK, *NEXT, "copies", "first", (F.col("r") + F.col("at") - F.col("begins")).alias("s"), F.when(same, F.col("near.first")).alias("p"), F.when(same, F.col("near.on")).alias("p_on"))


def suffix_array(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(places, splits, levels) of the suffixes whose first line occurs twice or more. places: KEY, o,
    rest, RANK (final). splits: for each level j, RANK of the names that parted from the one before
    them at its width w = 2^j, the first places p and q of both, and p_on; one empty table if there is
    no level. levels: for each j, KEY, o, RANK of the suffixes whose first 2^j lines occur twice or more."""
    with ExitStack() as early:
        # what only the first ranks read goes once they are stored
        early.enter_context(scratch(docs.sparkSession))
        lines = stored(suffixes(docs), "lines")
        shared = stored(lines.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1"), "names")
        count = shared.agg(F.sum("copies")).first()[0] or 0
        ranks = met(lines, shared, ["a", "b"], count, "live").select(*KEY, "o", "rest", "a", "b", F.lit(0).cast("long").alias("r"), "live")
        ranks = ranks.withColumn("was", F.col("live"))
        levels, places, splits, width = [], [], [], 1
        while True:
            # `some`: the document has suffixes that go on, and so all of its rows; `was`: this one did until now
            document = Window.partitionBy(*KEY)
            later = F.lead(F.struct(*RANK), width).over(document.orderBy("o"))
            ranks = ranks.withColumns({"some": F.max("live").over(document), "later": later}).where("some OR was")
            none = F.lit(0).cast("long")
            ranks = stored(ranks.select(*KEY, "o", "rest", *RANK, "live", "was", "some", F.col("later").isNotNull().alias("on"), *(F.coalesce(F.col(f"later.{c}"), none).alias(f"next_{c}") for c in RANK)), "ranks", keep=not places)
            early.close()
            places.append(ranks.where("was AND NOT live").select(*KEY, "o", "rest", *RANK))
            if not count:
                break
            levels.append(ranks.where("live").select(*KEY, "o", *RANK))
            pairs = ranks.where("live").select(*KEY, "o", "rest", *RANK, *NEXT)
            names = pairs.groupBy(*RANK, *NEXT).agg(F.count("*").alias("copies"), F.min(placed()).alias("first"))
            with scratch(docs.sparkSession):
                names = stored(numbered(names, count), "numbered", keep=True)
            splits.append(names.where("p IS NOT NULL").select("a", "b", F.col("s").alias("r"), F.lit(width).cast("long").alias("w"), "p", F.col("first").alias("q"), "p_on"))
            goes_on = (F.col("copies") > 1) & F.col("on")
            found = met(pairs, names.select(*RANK, *NEXT, "copies", "s", goes_on.alias("live")), [*RANK, *NEXT], count)
            found = found.select(*KEY, "o", "rest", "a", "b", F.col("s").alias("r"), "live", F.lit(True).alias("was"))
            ranks = ranks.where("some AND NOT live").select(*KEY, "o", "rest", *RANK, "live", F.lit(False).alias("was")).unionByName(found)
            count = names.where(goes_on).agg(F.sum("copies")).first()[0] or 0
            width *= 2
            jvm_collected(docs.sparkSession)
    if not splits:
        none = places[0].where("false")
        splits.append(none.select(*RANK, F.col("o").alias("w"), placed().alias("p"), placed().alias("q"), F.lit(True).alias("p_on")))
    return reduce(DataFrame.unionByName, places), splits, levels


def common_prefixes(splits: list[DataFrame], levels: list[DataFrame]) -> DataFrame:
    """RANK, lcp: how many lines the suffix of that rank has in common with the one before it."""
    # names that parted at a level share its width; only levels below it can add to that, if both go on
    lcp = F.col("w").alias("lcp")
    whole = [splits[0].select(*RANK, lcp), *(x.where("NOT p_on").select(*RANK, lcp) for x in splits[1:])]
    rows = None
    for step, level in enumerate(range(len(levels) - 2, -1, -1)):
        if step % 3 == 2:
            rows = stored(rows, "descent")  # a plan of few joins
            jvm_collected(rows.sparkSession)
        own = splits[level + 1].where("p_on").select(*RANK, "p", "q", lcp)
        rows = rows.unionByName(own) if rows else own
        for side in "pq":
            names = levels[level].select(F.col("doc_id").alias("d"), F.col("t").alias("e"), F.col("o").alias("f"), F.struct(*RANK).alias(f"{side}_rank"))
            rows = rows.join(names, (F.col(f"{side}.doc_id") == F.col("d")) & (F.col(f"{side}.t") == F.col("e")) & (F.col(f"{side}.o") + F.col("lcp") == F.col("f")), "left").drop("d", "e", "f")
        equal = F.coalesce(F.col("p_rank") == F.col("q_rank"), F.lit(False))
        rows = rows.withColumn("lcp", F.col("lcp") + F.when(equal, F.lit(1 << level)).otherwise(F.lit(0))).drop("p_rank", "q_rank")
    return reduce(DataFrame.unionByName, [*whole, *([rows.select(*RANK, "lcp")] if rows else [])])


def repeated_windows(docs: DataFrame, least: int) -> DataFrame:
    """KEY, o of every place that stands in an interval of the suffix array with `least` common lines
    or more, and is not the first place of that interval."""
    places, splits, levels = suffix_array(docs)
    places = places.where(F.col("rest") >= least)
    cuts = stored(common_prefixes(splits, levels), "prefixes").where(F.col("lcp") < least).select(*RANK, F.lit(True).alias("cut"))
    jvm_collected(docs.sparkSession)
    ranks = stored(places.groupBy(*RANK).agg(F.count("*").alias("copies"), F.min(placed()).alias("first")), "array")
    # the cut at or before each rank begins its interval; without one the first line's suffixes do
    rows, within = ordered(ranks.join(cuts, RANK, "full"), RANK, ranks.count())
    cut = F.max(F.when(F.col("cut"), F.struct(*RANK)))
    rows = rows.withColumn("last", cut.over(within))
    carried = rows.groupBy("part").agg(F.max("last").alias("before"))
    carried = carried.select("part", F.max("before").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    rows = rows.join(F.broadcast(carried), "part").withColumn("last", F.coalesce("last", "before"))
    inside = (F.col("last.a") == F.col("a")) & (F.col("last.b") == F.col("b"))
    rows = stored(rows.where("copies IS NOT NULL").select(*RANK, "copies", "first", F.when(inside, F.col("last.r")).otherwise(F.lit(0)).cast("long").alias("interval")), "intervals")
    earliest = rows.groupBy("a", "b", "interval").agg(F.count("*").alias("copies"), F.min("first").alias("earliest"))
    known = met(rows.withColumnRenamed("copies", "own"), stored(earliest, "earliest"), ["a", "b", "interval"])
    known = stored(known.select(*RANK, F.col("own").alias("copies"), "earliest"), "known")
    jvm_collected(docs.sparkSession)
    return met(places, known, RANK).where(F.col("earliest") < placed()).select(*KEY, "o")


def maximal_runs(docs: DataFrame, least: int = 2) -> DataFrame:
    """The later copies of maximal repeated runs: KEY, start (among the lines with a word), lines. Stored."""
    on = Window.partitionBy(*KEY).orderBy("o")
    with scratch(docs.sparkSession):
        runs = repeated_windows(docs, least).withColumn("run", F.col("o") - F.row_number().over(on))
        runs = runs.groupBy(*KEY, "run").agg(F.min("o").alias("start"), (F.count("*") + least - 1).alias("lines"))
        runs = stored(runs.select(*KEY, "start", "lines"), "runs", keep=True)
    jvm_collected(docs.sparkSession)
    return runs


def apart(docs: DataFrame, runs: DataFrame, new: str) -> tuple[DataFrame, DataFrame]:
    """The rows of docs that may have one of runs (all that do, and few others), and the rest. A bit
    map of the keys of runs is broadcast, of bounded size; neither part is shuffled for it. `new`
    begins no column of docs."""
    bits = min(BITS, 1 << max(6, (8 * runs.count()).bit_length()))
    word, spot = f"{new}word", f"{new}spot"

    def place(doc_id: Column, t: Column) -> list[Column]:
        bit = F.pmod(F.xxhash64(doc_id, t), F.lit(bits).cast("long"))
        return [F.shiftright(bit, 6).alias(word), F.pmod(bit, F.lit(64)).cast("int").alias(spot)]

    words = runs.select(*place(F.col("doc_id"), F.col("t"))).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(spot))).alias(f"{new}bits"))
    known = docs.select("*", *place(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.getbit(f"{new}bits", spot) == 1, F.lit(False))
    some, others = (known.where(x).drop(word, spot, f"{new}bits") for x in (hit, ~hit))
    return some, others


def cut(docs: DataFrame, least: int) -> tuple[DataFrame, str]:
    """docs with three columns (how many lines go: removed; lines with a word: lines; the text left:
    kept) under a prefix that no column of docs has, and that prefix."""
    new = free_prefix(docs.columns)
    found = maximal_runs(docs, least)
    late = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "lines")).alias("runs"))
    late = late.select(F.col("doc_id").alias(f"{new}doc"), F.col("t").alias(f"{new}t"), F.col("runs").alias(f"{new}runs"))
    runs = F.col(f"{new}runs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.col("doc_id").cast("long") == F.col(f"{new}doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{new}t"))
    orders = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1))))
    gone = letting(written_lines(text), lambda w: F.transform(orders, lambda o: w[o.cast("int")]))
    left = letting(F.split(text, "\n"), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), gone), lambda i: a[i]), "\n"))
    removed = F.when(runs.isNull(), F.lit(0)).otherwise(F.size(orders)).cast("long")
    kept = F.when(runs.isNull(), F.col("text").cast("string")).otherwise(left)
    # only texts that may have runs meet them
    some, others = apart(docs, found, new)
    none = (F.lit(None).cast(f.dataType).alias(f.name) for f in late.schema)
    rows = some.join(late, same, "left").union(others.select("*", *none))
    return rows.withColumns({f"{new}removed": removed, f"{new}lines": F.size(written_lines(text)).cast("long"), f"{new}kept": kept}), new


def dedup_digest(docs: DataFrame, least: int = 2) -> DataFrame:
    """For every row: doc_id, n_lines, n_removed, kept_sha256 (of what is left, \\n-joined).

    A line goes if a run of `least` lines or more that covers it occurs earlier, in the order of
    doc_id, then line; runs skip lines without a word, which always stay. A null text is empty and
    has no line. Rows with one doc_id but different texts are documents of their own, in the order
    of a hash of the text; rows equal in both are one document, each gives a row. A row without a
    doc_id keeps all its lines and is no earlier place. Other columns are ignored."""
    slim = docs.select("doc_id", "text")
    out, new = cut(slim, least)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{new}lines").alias("n_lines"), F.col(f"{new}removed").alias("n_removed"), F.sha2(F.coalesce(f"{new}kept", F.lit("")), 256).alias("kept_sha256"))


def dedup_text(docs: DataFrame, least: int = 2) -> DataFrame:
    """docs with the repeated lines cut out of text, by the rules of dedup_digest(). Rows that lose
    every line with a word go; rows that lose none stay as they are, also null and empty texts. All
    columns stay, whatever their names; an empty table gives an empty one."""
    out, new = cut(docs, least)
    left = out.where(F.expr(f"`{new}removed` = 0 OR `{new}removed` < `{new}lines`"))
    return left.select(*(F.col(f"{new}kept").alias(c) if c == "text" else F.col(c) for c in docs.columns))
