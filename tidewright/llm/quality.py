"""Quality rules: multivariate outliers by the minimum covariance determinant; DataFrame functions only.

Each document gives a vector of five transformed statistics. For each language and source, the estimate is
the mean and covariance of the three quarters of the documents whose covariance has the least determinant,
found by concentration steps from two starts. A step needs sums by group and a histogram of distances, so
no group is ever gathered. Documents beyond a quantile of the Mahalanobis distance are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window, and base limits: fewest words, most repeated words in a hundred.
WINDOW, FEWEST, MOST = 8, 20, 30

#: Statistics, and the standard deviation that is added to each one's own: ln words, ln word length, ln of 1 + symbols in 1000, duplicate lines, repeated words in 100.
FLOORS = {"x0": 0.8, "x1": 0.05, "x2": 0.5, "x3": 0.6, "x4": 0.6}
#: Share of a group that the estimate rests on, and the factor that makes its covariance that of a normal distribution (five dimensions).
SHARE, CONSISTENCY = 0.75, 1.41
#: The 0.9999 quantile of chi-square with five degrees of freedom.
CUT = 25.74
#: Documents that a group needs to have estimates of its own; smaller ones take their language's, then those of all.
OWN = 50
#: Documents of a group that one part of it has: the group's estimates are repeated for each part, so that parts are joined apart.
SPREAD = 1_000
#: Concentration steps of both starts, and of the better one after that.
STEPS, LAST = 3, 2
#: Bins of the histograms: those of ln(1 + squared distance), and of a statistic.
D_BINS, X_BINS = 400, 50


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of whole texts; null and empty texts count 0 everywhere."""
    word = F.col("h")
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bare", F.btrim("text", F.lit(SPACES)))
    d = d.withColumn("h", F.when(F.col("bare") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("bare", SPACE), lambda w: F.xxhash64(w))))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    d = d.select(
        "doc_id", "lang", "source", "h", F.size(word).cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    some = F.col("n_words") >= WINDOW
    d = d.withColumn("win", F.when(some, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_words") - WINDOW + 1, F.lit(1)).cast("int")), lambda i: F.xxhash64(F.slice(word, i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    d = d.drop("h").withColumn("twice", F.size(F.array_distinct("win")) < F.size("win"))
    sort = F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.col("twice"), sort)).drop("win")
    near = lambda i, k: F.get(F.col("sorted"), i + k)["w"]
    hit = F.filter("sorted", lambda s, i: F.coalesce(s["w"] == near(i, -1), F.lit(False)) | F.coalesce(s["w"] == near(i, 1), F.lit(False)))
    d = d.withColumn("at", F.array_sort(F.transform(hit, lambda s: s["i"]))).drop("sorted")
    covers = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.get(F.col("at"), i + 1) - p))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST * F.col("n_words"))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def vector(d: DataFrame) -> DataFrame:
    """Add x0 ... x4."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.col("word_chars") + 1.0
    return d.withColumns({
        "x0": F.log1p("n_words"), "x1": F.log((F.col("word_chars") + 1) / n), "x2": F.log1p(1000 * F.col("n_symbols") / chars),
        "x3": F.log1p("n_dup_lines"), "x4": F.log1p(100 * F.col("n_repeat_words") / n),
    })


def groups(d: DataFrame, least: int = OWN) -> DataFrame:
    """lang, source, estimate ('source', 'language' or 'all'), grp, the group whose estimates hold for them, and the parts it has."""
    sizes = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    rest = F.when(F.col("n") < least, F.col("n"))
    level = F.when(F.col("n") >= least, "source").when(F.sum(rest).over(Window.partitionBy("lang")) >= least, "language").otherwise("all")
    name = F.struct("estimate", F.when(F.col("estimate") != "all", F.col("lang")).alias("lang"), F.when(F.col("estimate") == "source", F.col("source")).alias("source"))
    named = sizes.withColumn("estimate", level).withColumn("grp", F.to_json(name))
    sums = named.groupBy("grp").agg(F.ceil(F.sum("n") / SPREAD).cast("int").alias("parts"))
    return named.join(sums, "grp").select("lang", "source", "estimate", "grp", "parts")


def _factor(d: DataFrame, scale: float) -> DataFrame:
    """From means m0.. and covariances s00, s10, ..: the Cholesky factor l00, l10, .. of scale * covariance + squared floors, and its determinant."""
    keys = [c for c in d.columns if c in ("grp", "start")]
    names, floors = list(FLOORS), list(FLOORS.values())
    cols: dict[str, Column] = {}
    for i in range(len(names)):
        for j in range(i + 1):
            s = F.col(f"s{i}{j}") * scale + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cols[f"l{i}{j}"] = F.sqrt(s) if i == j else s / F.col(f"l{j}{j}")
            d = d.withColumn(f"l{i}{j}", cols[f"l{i}{j}"])
    det = F.lit(1.0)
    for i in range(len(names)):
        det = det * F.col(f"l{i}{i}")
    return d.select(*keys, *[f"m{i}" for i in range(len(names))], *cols, det.alias("det"))


def _distance(d: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, from x, m and l."""
    p = len(FLOORS)
    for i in range(p):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        d = d.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return d.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, p)), F.col("y0") * F.col("y0")))


def _moments() -> list[Column]:
    p = range(len(FLOORS))
    return [F.avg(f"x{i}").alias(f"m{i}") for i in p] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i in p for j in range(i + 1)]


def _quartiles(x: DataFrame) -> DataFrame:
    """A start for each group: medians, and a diagonal covariance from quartiles, both from histograms."""
    p = range(len(FLOORS))
    long = x.select("grp", F.posexplode(F.array(*[F.floor(F.col(c) * X_BINS).cast("long") for c in FLOORS])).alias("i", "bin")).groupBy("grp", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp", "i")
    long = long.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    reach = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    q = long.groupBy("grp", "i").agg(reach(0.25).alias("a"), reach(0.5).alias("b"), reach(0.75).alias("c"))
    pick = lambda i, e, name: F.max(F.when(F.col("i") == i, e)).alias(name)
    spread = (F.col("c") - F.col("a")) / (X_BINS * 1.349)
    wide = q.groupBy("grp").agg(*[pick(i, (F.col("b") + 0.5) / X_BINS, f"m{i}") for i in p], *[pick(i, spread * spread, f"s{i}{i}") for i in p])
    return wide.select("grp", *[f"m{i}" for i in p], *[(F.col(f"s{i}{i}") if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in p for j in range(i + 1)])


def _spread(estimates: DataFrame) -> DataFrame:
    """A row for each part of each group."""
    return estimates.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _concentrate(x: DataFrame, now: DataFrame, parts: DataFrame, label: str) -> DataFrame:
    """One step: moments of the SHARE of each (grp, start) that is nearest by the estimates `now`, from sums by bin of distance."""
    p = range(len(FLOORS))
    far = _distance(x.join(_spread(now), ["grp", "part"])).withColumn("bin", F.floor(F.log1p("d2") * D_BINS).cast("long"))
    sums = [F.sum(f"x{i}").alias(f"a{i}") for i in p] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i in p for j in range(i + 1)]
    bins = far.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    w = Window.partitionBy("grp", "start")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    near = bins.where(F.col("upto") - F.col("n") < F.col("all") * SHARE).groupBy("grp", "start")
    mean = lambda c: F.sum(c) / F.sum("n")
    cov = {f"s{i}{j}": mean(f"b{i}{j}") - mean(f"a{i}") * mean(f"a{j}") for i in p for j in range(i + 1)}
    half = near.agg(*[mean(f"a{i}").alias(f"m{i}") for i in p], *[(F.greatest(c, F.lit(0.0)) if k[1] == k[2] else c).alias(k) for k, c in cov.items()])
    return settle(_factor(half, 1.0).join(parts, "grp"), label)


def determinant_estimates(x: DataFrame) -> DataFrame:
    """For each grp of x (grp, x0 ... x4; part and parts if groups are dealt in parts): means m0 .. and the factor l00 .. of the covariance, and parts."""
    if "part" not in x.columns:
        x = x.withColumns({"part": F.lit(0), "parts": F.lit(1)})
    parts = settle(x.groupBy("grp").agg(F.max("parts").alias("parts")), "mcd-parts")
    x = x.select("grp", "part", *FLOORS)
    first = x.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(0)).unionByName(_quartiles(x).withColumn("start", F.lit(1)))
    now = settle(_factor(first, 1.0).join(parts, "grp"), "mcd-start")
    for k in range(STEPS):
        now = _concentrate(x, now, parts, f"mcd-{k}")
    fields = [c for c in now.columns if c not in ("grp", "start")]
    best = now.groupBy("grp").agg(F.min_by(F.struct("start", *fields), F.struct("det", "start")).alias("b")).select("grp", "b.*")
    for k in range(LAST):
        best = _concentrate(x, best, parts, f"mcd-last{k}")
    # the factor of scale * covariance + floors: from l l' less the floors
    p, floors = range(len(FLOORS)), list(FLOORS.values())
    cov = lambda i, j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j + 1)), F.col(f"l{i}0") * F.col(f"l{j}0")) - (floors[i] ** 2 if i == j else 0.0)
    return settle(_factor(best.select("grp", *[f"m{i}" for i in p], *[F.greatest(cov(i, j), F.lit(0.0)).alias(f"s{i}{j}") if i == j else cov(i, j).alias(f"s{i}{j}") for i in p for j in range(i + 1)]), CONSISTENCY).join(parts, "grp"), "mcd-end")


def outliers(docs: DataFrame, own: int = OWN) -> DataFrame:
    """Counts, base_failed, distance and kept for documents (doc_id, text, lang, source; other columns are ignored).

    Null languages and sources form groups of their own. Estimates rest on all documents that pass the base
    rules; if none does, none is kept. Groups of fewer than `own` documents are judged with the small groups
    of their language, then with all small groups; `estimate` tells which. Repeated rows keep a row each.
    """
    d = settle(statistics(docs), "quality")
    passed = vector(d.where("not base_failed"))
    homes = settle(groups(passed, own), "quality-groups")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    part = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.col("parts")).cast("int").alias("part")
    x = settle(passed.join(homes, ["lang", "source"]).select("doc_id", "grp", "estimate", "parts", part, *counts, *FLOORS), "quality-x")
    far = _distance(x.drop("parts").join(_spread(determinant_estimates(x.select("grp", "part", "parts", *FLOORS))), ["grp", "part"]))
    good = far.select("doc_id", *counts, F.lit(False).alias("base_failed"), (F.col("d2") <= CUT).alias("kept"), F.round("d2", 4).alias("distance2"), "estimate")
    bad = d.where("base_failed").select("doc_id", *counts, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"), F.lit(None).cast("string").alias("estimate"))
    return good.unionByName(bad)


def op5_covariance_determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; see outliers() for nulls and small groups."""
    return outliers(table(spark, sf_dir, "documents"))
