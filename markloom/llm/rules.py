"""Quality rules: base counts and robust multivariate outliers (operator 5, DataFrame functions only).

Each text gives a vector of transformed statistics. Every language and source has its own minimum
covariance determinant estimate: of the subsets of H of the group's rows the one whose covariance
has the least determinant, sought from several starts by concentration steps (mean and covariance
of the subset, the rows nearest under these, and again) until no determinant falls any more; the
start with the least one counts. Rows whose Mahalanobis distance passes a cutoff are rejected.

Covariances are regularised, alike in groups of any size: a group's subset is joined by PRIOR rows
that stand at its language's medians with its median deviations, and by the least variances. Both
are constants of the group, so a step never makes the determinant larger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Share of rows that an estimate rests on; rows that its language's medians count for; the fall of
#: the determinant's logarithm under which a step has converged.
H, PRIOR, STILL = 0.5, 20.0, 1e-6
#: Makes the covariance of the nearest H of five-dimensional normal rows that of all: H / P(chi2_7 <= q) where P(chi2_5 <= q) = H.
CONSISTENT = 1.912
#: Squared distance beyond which a row is an outlier.
CUTOFF = 30.0
#: The vector: (name, least standard deviation). Below it a statistic counts as constant up to noise.
VECTOR = (("y_words", 1.5), ("y_length", 0.12), ("y_symbols", 0.04), ("y_lines", 0.25), ("y_repeats", 0.25))
#: Steps of one unit in the histograms that give medians and cuts, and of one of these steps again.
GRID, FINE = 64, 1 << 16
#: Starts: median deviations; covariance of the tanh of scaled statistics; of their spatial signs.
STARTS = 3
SALTS = 8


def letting(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has at least twice. The windows' hashes are sorted with
    their places; equal neighbours give the places of repeats, whose spans of three are joined."""

    def of(grams: Column) -> Column:
        last = F.size(grams) - 1
        alike = lambda j: ((j > 0) & (grams[j]["h"] == grams[F.greatest(j - 1, F.lit(0))]["h"])) | ((j < last) & (grams[j]["h"] == grams[F.least(j + 1, last)]["h"]))
        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), alike), lambda j: grams[j]["i"]))
        return letting(places, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"]))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(letting(F.sort_array(grams), of)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every row, from whole texts. A null text has no
    word and no line."""
    column = lambda c: F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column("lang"), column("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = letting(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    size = F.length("text")
    return docs.select(
        "doc_id",
        "lang",
        "source",
        counted.alias("c"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        letting(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        letting(lines, F.size).cast("long").alias("n_lines"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "n_lines")


def vectors(counts: DataFrame) -> DataFrame:
    """counts with base_failed and the transformed vector."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "y_words": F.log1p("n_words"),
            "y_length": F.log1p(F.col("word_chars") / n),
            "y_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "y_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "y_repeats": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def grouped(rows: DataFrame) -> DataFrame:
    """rows with their group, (lang, source), their language, and a salt."""
    name = lambda *c: F.concat_ws("\0", *(F.coalesce(x, F.lit("\1")) for x in c))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return rows.withColumns({"group": name(F.col("lang"), F.col("source")), "language": name(F.col("lang")), "salt": salt})


def salted(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def quantile(cells: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The cell where `share` of the rows is reached: cells has keys, cell, n."""
    upto = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return cells.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("cell").alias("cell"))


def names(letter: str) -> list[str]:
    """m0, m1, ..: a vector's columns; c00, c10, c11, ..: a matrix's."""
    n = range(len(VECTOR))
    return [f"{letter}{i}" for i in n] if letter == "m" else [f"{letter}{i}{j}" for i in n for j in n if j <= i]


def medians(rows: DataFrame) -> DataFrame:
    """group, m0.. (medians) and s0.. (scaled median deviations, the least ones at least)."""
    ys = [y for y, _ in VECTOR]
    pick = lambda k: F.element_at(F.map_from_entries(F.collect_list(F.struct("k", "v"))), k)

    def median(values: DataFrame) -> DataFrame:
        cells = values.groupBy("group", "k", F.floor(F.col("v") * GRID).alias("cell")).agg(F.count("*").alias("n"))
        return quantile(cells, ["group", "k"], 0.5).select("group", "k", ((F.col("cell") + 0.5) / GRID).alias("v"))

    long = rows.select("group", F.inline(F.array(*(F.struct(F.lit(i).alias("k"), F.col(y).alias("v")) for i, y in enumerate(ys)))))
    centre = stored(median(long).groupBy("group").agg(*(pick(i).alias(f"m{i}") for i in range(len(ys)))), "centre")
    near = rows.join(salted(centre), ["group", "salt"])
    away = near.select("group", F.inline(F.array(*(F.struct(F.lit(i).alias("k"), F.abs(F.col(y) - F.col(f"m{i}")).alias("v")) for i, y in enumerate(ys)))))
    scale = median(away).groupBy("group").agg(*(F.greatest(1.4826 * pick(i), F.lit(VECTOR[i][1])).alias(f"s{i}") for i in range(len(ys))))
    return stored(centre.join(scale, "group"), "medians")


def starts(rows: DataFrame, own: DataFrame) -> DataFrame:
    """group, start, m0.., c00..: the first estimates of every group around its medians `own`."""
    n = range(len(VECTOR))
    z = rows.join(salted(own), ["group", "salt"]).select("group", *(((F.col(y) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, (y, _) in enumerate(VECTOR)))
    size = F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in n[1:]), F.col("z0") ** 2)), F.lit(1e-9))
    kinds = (lambda i: F.tanh(F.col(f"z{i}")), lambda i: F.col(f"z{i}") / size * len(VECTOR) ** 0.5)
    moments = z.groupBy("group").agg(*(F.avg(x(i) * x(j)).alias(f"k{k}{i}{j}") for k, x in enumerate(kinds) for i in n for j in n if j <= i))
    own = own.join(moments, "group")
    least = lambda i, j: F.lit(VECTOR[i][1] ** 2 if i == j else 0.0)
    scales = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    out = [own.select("group", F.lit(0).alias("start"), *names("m"), *((scales(i, j) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in n for j in n if j <= i))]
    for k in range(len(kinds)):
        out.append(own.select("group", F.lit(k + 1).alias("start"), *names("m"), *((F.col(f"k{k}{i}{j}") * scales(i, j) + least(i, j)).alias(f"c{i}{j}") for i in n for j in n if j <= i)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def root(estimate: DataFrame) -> DataFrame:
    """The estimate with the Cholesky factor l of its covariance c, and det, the logarithm of its
    determinant. Every diagonal is at least a hundredth of the least variance, so it never fails."""
    keep = [c for c in estimate.columns if c not in names("c")]
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(0.01 * VECTOR[i][1] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            estimate = estimate.withColumn(f"l{i}{j}", value)
    det = sum((F.log(f"l{i}{i}") for i in range(1, len(VECTOR))), F.log("l00")) * 2
    return estimate.select(*keep, *names("l"), det.alias("det"))


def away(rows: DataFrame) -> DataFrame:
    """rows, joined with root(), with d2: the squared Mahalanobis distance."""
    for i, (y, _) in enumerate(VECTOR):
        z = F.col(y) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(1, len(VECTOR))), F.col("z0") ** 2))


def distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with d2 under their group's estimate."""
    return away(rows.join(salted(root(estimate)), ["group", "salt"], "left")).select(*rows.columns, "d2")


def concentrate(rows: DataFrame, sizes: DataFrame, prior: DataFrame, rooted: DataFrame) -> DataFrame:
    """One step for every group and start of root(): the mean and covariance of exactly H of the
    group's rows, the nearest ones; equal last ones share what is left. A distance counts to seven
    digits: its cell in a logarithmic histogram, and its cell within that one. Neither histogram has
    more cells than its grid, so a group of any size is counted in parts."""
    by, ys, n = ["group", "start"], [y for y, _ in VECTOR], range(len(VECTOR))
    place = F.log1p("d2") * GRID
    near = away(rows.join(salted(rooted), ["group", "salt"])).withColumn("cell", F.floor(place))
    near = near.withColumn("fine", F.floor((place - F.col("cell")) * FINE))
    near = stored(near.select(*by, "salt", "cell", "fine", *((F.col(y) - F.col(f"m{i}")).alias(f"y{i}") for i, y in enumerate(ys))), "near")

    def reached(cells: DataFrame, cell: str, need: str) -> DataFrame:
        """The cell in which `need` rows are reached, and how many are still needed of it."""
        upto = Window.partitionBy(*by).orderBy(cell)
        cells = cells.withColumn("upto", F.sum("n").over(upto)).where(f"upto >= {need}")
        return cells.groupBy(*by).agg(F.min(F.struct(cell, "n", "upto", need)).alias("x")).select(*by, f"x.{cell}", "x.n", (F.col(f"x.{need}") - F.col("x.upto") + F.col("x.n")).alias("left"))

    coarse = near.groupBy(*by, "cell").agg(F.count("*").alias("n")).join(sizes.select("group", "h"), "group")
    cut = reached(coarse, "cell", "h").select(*by, F.col("cell").alias("cut"), F.col("left").alias("need"))
    edge = near.join(salted(cut), [*by, "salt"]).where("cell = cut").groupBy(*by, "fine", "cut", "need").agg(F.count("*").alias("n"))
    edge = reached(edge, "fine", "need").select(*by, F.col("fine").alias("fine_cut"), (F.col("left") / F.col("n")).alias("share"))
    cut = stored(cut.join(edge, by).select(*by, "cut", "fine_cut", "share"), "cut")
    weight = F.when((F.col("cell") < F.col("cut")) | (F.col("cell") == F.col("cut")) & (F.col("fine") < F.col("fine_cut")), 1.0).when((F.col("cell") == F.col("cut")) & (F.col("fine") == F.col("fine_cut")), F.col("share"))
    chosen = near.join(salted(cut), [*by, "salt"]).withColumn("w", weight).where("w > 0")
    sums = chosen.groupBy(*by).agg(*(F.sum(F.col("w") * F.col(f"y{i}")).alias(f"t{i}") for i in n), *(F.sum(F.col("w") * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"t{i}{j}") for i in n for j in n if j <= i))
    old = rooted.select(*by, *(F.col(f"m{i}").alias(f"o{i}") for i in n))
    given = prior.select("group", *(F.col(f"m{i}").alias(f"p{i}") for i in n), *(F.col(f"s{i}").alias(f"q{i}") for i in n))
    out = sums.join(old, by).join(sizes.select("group", F.col("h").cast("double").alias("h")), "group").join(given, "group")
    out = out.withColumns({f"e{i}": F.col(f"o{i}") + F.col(f"t{i}") / F.col("h") for i in n} | {"hc": CONSISTENT * F.col("h")})
    means = {f"m{i}": (F.col("hc") * F.col(f"e{i}") + PRIOR * F.col(f"p{i}")) / (F.col("hc") + PRIOR) for i in n}

    def covariance(i: int, j: int) -> Column:
        own = F.col("hc") * (F.col(f"t{i}{j}") / F.col("h") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("h") ** 2)
        apart = F.col("hc") * PRIOR / (F.col("hc") + PRIOR) * (F.col(f"e{i}") - F.col(f"p{i}")) * (F.col(f"e{j}") - F.col(f"p{j}"))
        fixed = F.col("h") * VECTOR[i][1] ** 2 + PRIOR * F.col(f"q{i}") ** 2 if i == j else F.lit(0.0)
        return ((own + apart + fixed) / (F.col("h") + PRIOR)).alias(f"c{i}{j}")

    return out.select(*by, *(x.alias(m) for m, x in means.items()), *(covariance(i, j) for i in n for j in n if j <= i))


def least_determinant(rows: DataFrame) -> DataFrame:
    """group, m0.., c00..: the estimate of each group of rows (doc_id, group, language, salt, vector)."""
    own = medians(rows)
    of = rows.select("group", "language").distinct()
    language = medians(rows.drop("group").withColumnRenamed("language", "group")).withColumnRenamed("group", "language")
    prior = stored(of.join(language, "language"), "prior")
    sizes = stored(rows.groupBy("group").agg(F.ceil(F.count("*") * H).cast("long").alias("h")), "sizes")
    rooted = stored(root(starts(rows, own)), "starts")
    last = None
    while True:
        estimate = stored(concentrate(rows, sizes, prior, rooted), "estimate")
        new = stored(root(estimate), "rooted")
        # the starts are no subsets' estimates: the first step has nothing to be compared with
        if last is not None and new.join(last.select("group", "start", F.col("det").alias("before")), ["group", "start"]).where(F.col("det") < F.col("before") - STILL).isEmpty():
            break
        last = rooted = new
    best = new.groupBy("group").agg(F.min(F.struct("det", "start")).alias("x")).select("group", "x.start")
    return stored(estimate.join(best, ["group", "start"]).drop("start"), "best", keep=True)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """For every row: doc_id, the base counts, base_failed, d2 (null if base_failed), kept.

    Null lang and source are values of their own. Rows that fail the base rules are part of no
    estimate; a group of one row is that row and its language's medians. An empty table gives an
    empty one; repeated rows each count and each give a row; other columns are ignored."""
    rows = stored(grouped(vectors(base_counts(docs))), "vectors")
    fine = rows.where("NOT base_failed").select("doc_id", "group", "language", "salt", *(y for y, _ in VECTOR))
    with scratch(docs.sparkSession):
        best = least_determinant(fine)
    judged = distances(rows, best)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("d2"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
    )
