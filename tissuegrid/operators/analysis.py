"""Quality control, variable genes, differential expression, gene-set and regulator scores, on entries (cell, gene, value) whose zeros are absent."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import ordinals, stage, with_groups
from tissuegrid.functions.special import smoothing_weights, student_two_sided, tail_score
from tissuegrid.operators import spatial


def qc_metrics(entries: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell, total, detected, pct_mt, pct_rb). genes: (gene, mt, rb) with two flags; a gene without a row has neither."""
    flagged = entries.join(genes.select("gene", "mt", "rb"), "gene", "left")
    part = lambda flag: 100 * F.try_divide(F.sum(F.when(F.coalesce(flag, F.lit(False)), F.col("value")).otherwise(0.0)), F.sum("value"))
    return flagged.groupBy("cell").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("detected"), part("mt").alias("pct_mt"), part("rb").alias("pct_rb"))


def qc_filter(metrics: DataFrame, least: float, most: float, max_mt: float, max_rb: float = 100.0) -> DataFrame:
    """Cells with totals within the range (inclusive) and shares below the limits (strictly)."""
    return metrics.filter(F.col("total").between(least, most) & (F.col("pct_mt") < max_mt) & (F.col("pct_rb") < max_rb))


def common_genes(entries: DataFrame, least_cells: int) -> DataFrame:
    """Genes found in at least so many cells."""
    return entries.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("cells")).filter(F.col("cells") >= least_cells)


def dispersions(entries: DataFrame, cells: int, bins: int = 20) -> DataFrame:
    """(gene, mean, dispersion, bin, score): ln(1 + mean), ln(variance / mean) and its z-score among genes of like mean.

    Moments count absent zeros. Bins divide the range of means evenly; a bin of one gene takes the bin's mean as deviation, so that its score is 1.
    """
    m = entries.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    mean = F.col("s") / cells
    variance = (F.col("q") - F.col("s") * mean) / (cells - 1)
    both = m.select("gene", F.log1p(mean).alias("mean"), F.log(F.when(variance / mean > 0, variance / mean)).alias("dispersion"))
    ranged = with_groups(both, [], F.min("mean").alias("_l"), F.max("mean").alias("_u"))
    width = F.when(F.col("_u") > F.col("_l"), F.col("_u") - F.col("_l"))
    placed = ranged.withColumn("bin", F.coalesce(F.least(F.floor((F.col("mean") - F.col("_l")) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("int"))
    stats = placed.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    # A bin has as many genes as there are, never rows of the data; there are `bins` of them.
    scored = placed.join(F.broadcast(stats), "bin")
    z = F.when(F.col("_s").isNull(), F.lit(1.0)).otherwise((F.col("dispersion") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")))
    return scored.select("gene", "mean", "dispersion", "bin", z.alias("score"))


def variable(scores: DataFrame, least_mean: float = 0.0125, most_mean: float = 3.0, least_score: float = 0.5) -> DataFrame:
    """(gene) of `dispersions` within these bounds (strictly), as many as there are; every gene where none is."""
    inside = F.coalesce((F.col("mean") > least_mean) & (F.col("mean") < most_mean) & (F.col("score") > least_score), F.lit(False))
    any_ = scores.agg(F.max(inside).alias("_any"))
    return scores.crossJoin(F.broadcast(any_)).filter(inside | ~F.col("_any")).select("gene")


def by_reconstruction(cosines: DataFrame, means: DataFrame, keep: float = 0.9, least_mean: float = 0.5) -> DataFrame:
    """Genes that a reduced model restores well: among the first `keep` of all in order of 1 - cosine, with at least the mean."""
    n = cosines.agg(F.count("*").alias("_n"))
    far = cosines.withColumn("_far", F.coalesce(1 - F.col("cosine"), F.lit(float("inf"))))
    ranked = ordinals(far, [], ["_far", "gene"], "rank").withColumn("rank", F.col("rank").cast("int")).crossJoin(F.broadcast(n))
    return ranked.join(means, "gene").filter((F.col("rank") < keep * F.col("_n")) & (F.col("mean") >= least_mean)).select("gene", "rank", "mean")


def log2_fold(entries: DataFrame, groups: DataFrame, base: str) -> DataFrame:
    """(group, gene, log2fc): mean share of a gene in the cells of a group against the base group, 1e-6 added to both.

    groups: (cell, group). Each cell's entries are divided by their sum; cells without entries count as zeros. The base itself has 0.
    """
    shares = with_groups(entries, ["cell"], F.sum("value").alias("_t")).withColumn("share", F.col("value") / F.when(F.col("_t") != 0, F.col("_t")))
    sizes = groups.groupBy("group").agg(F.count("*").alias("_n"))
    means = shares.join(groups, "cell").groupBy("group", "gene").agg(F.sum("share").alias("_s")).join(sizes, "group").select("group", "gene", (F.col("_s") / F.col("_n")).alias("m"))
    means = stage(means)
    grid = sizes.select("group").crossJoin(means.select("gene").distinct())
    of_base = means.filter(F.col("group") == base).select("gene", F.col("m").alias("b"))
    met = grid.join(means, ["group", "gene"], "left").join(of_base, "gene", "left")
    return met.select("group", "gene", (F.log2(F.coalesce("m", F.lit(0.0)) + 1e-6) - F.log2(F.coalesce("b", F.lit(0.0)) + 1e-6)).alias("log2fc"))


def _above(n: Column) -> Column:
    return F.when(n > 0, n)


def welch(entries: DataFrame, groups: DataFrame, a: str, b: str, overestimated: bool = False) -> DataFrame:
    """(gene, mean_a, mean_b, t, df) of Welch's test between two groups of cells, absent zeros included. groups: (cell, group). Genes without variance have null t,
    and so has every gene where a group has fewer than two cells.

    overestimated: the second group's variance is divided by the first group's size, and that size stands in the degrees of freedom.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    pick = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    n = sizes.agg(pick(a, "n").alias("na"), pick(b, "n").alias("nb"))
    sums = entries.join(groups.filter(F.col("group").isin(a, b)), "cell").groupBy("gene", "group").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    wide = sums.groupBy("gene").agg(*(F.coalesce(pick(g, c), F.lit(0.0)).alias(f"{c}{k}") for g, k in ((a, "a"), (b, "b")) for c in "sq")).crossJoin(F.broadcast(n))
    mean = {k: F.col(f"s{k}") / F.col(f"n{k}") for k in "ab"}
    size = {"a": F.col("na"), "b": F.col("na" if overestimated else "nb")}
    error = {k: F.greatest(F.col(f"q{k}") - F.col(f"s{k}") * mean[k], F.lit(0.0)) / _above(F.col(f"n{k}") - 1) / size[k] for k in "ab"}
    wide = wide.select("gene", "na", "nb", mean["a"].alias("mean_a"), mean["b"].alias("mean_b"), error["a"].alias("ea"), error["b"].alias("eb"))
    both = F.col("ea") + F.col("eb")
    some = F.when(both > 0, both)
    df = some * some / (F.col("ea") ** 2 / _above(size["a"] - 1) + F.col("eb") ** 2 / _above(size["b"] - 1))
    return wide.select("gene", "mean_a", "mean_b", ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(some)).alias("t"), F.when(both > 0, df).alias("df"))


def rank_sum(entries: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """(gene, z) of the rank-sum test between two groups of cells, equal values sharing their mean rank, absent zeros included.

    Ranks follow from counts of the distinct values, so no gene's cells are ever sorted: values of few distinct numbers stay few rows. Genes that
    occur in neither group have no row; a gene with one value has null z.
    """
    both = groups.filter(F.col("group").isin(a, b))
    pick = lambda g: F.count_if(F.col("group") == g)
    n = both.agg(pick(a).alias("na"), pick(b).alias("nb"))
    stored = entries.filter("value <> 0").join(both, "cell").groupBy("gene", "value").agg(pick(a).alias("ca"), pick(b).alias("cb"))
    zeros = stored.groupBy("gene").agg(F.sum("ca").alias("sa"), F.sum("cb").alias("sb")).crossJoin(F.broadcast(n))
    zeros = zeros.select("gene", F.lit(0.0).alias("value"), (F.col("na") - F.col("sa")).alias("ca"), (F.col("nb") - F.col("sb")).alias("cb"))
    counted = stored.unionByName(zeros).withColumn("c", F.col("ca") + F.col("cb")).filter("c > 0")
    upto = F.sum("c").over(Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("r", upto - (F.col("c") - 1) / 2)
    sums = ranked.groupBy("gene").agg(F.sum(F.col("ca") * F.col("r")).alias("w"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties")).crossJoin(F.broadcast(n))
    total = F.col("na") + F.col("nb")
    spread = F.col("na") * F.col("nb") / 12 * (total + 1 - F.col("ties") / (total * (total - 1)))
    return sums.select("gene", ((F.col("w") - F.col("na") * (total + 1) / 2) / F.sqrt(F.when(spread > 0, spread))).alias("z"))


def adjusted(tests: DataFrame, p: str = "p", out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg over the rows, which are genes: p n / rank, the running minimum from the largest p, at most 1. Null p stay out.

    Ranks are range-partitioned, and the minimum runs within stretches of ranks whose minima are put together.
    """
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    ranked = ordinals(known, [], [p, "gene"], "_r").crossJoin(F.broadcast(known.agg(F.count("*").alias("_n"))))
    raw = stage(ranked.withColumn("_raw", F.col(p) * F.col("_n") / (F.col("_r") + 1)).withColumn("_s", F.floor(F.col("_r") / 65_536)))
    lows = raw.groupBy("_s").agg(F.min("_raw").alias("_low"))
    later = lows.select("_s", F.min("_low").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))  # one row a stretch
    lowest = F.min("_raw").over(Window.partitionBy("_s").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    done = raw.withColumn("_lowest", lowest).join(later, "_s")
    return done.withColumn(out, F.least("_lowest", F.coalesce("_later", F.lit(1.0)), F.lit(1.0))).drop("_r", "_n", "_raw", "_s", "_lowest", "_later")


def differential(entries: DataFrame, groups: DataFrame, a: str, b: str, cutoff: float = 0.01, least_fold: float = 1.0) -> DataFrame:
    """Welch's test with two-sided p, adjusted p and log2 fold change of the means; genes under the cutoff whose fold change is at least `least_fold` in size."""
    tests = welch(entries, groups, a, b)
    fold = F.log2((F.expm1("mean_a") + 1e-9) / (F.expm1("mean_b") + 1e-9))
    done = adjusted(tests.withColumn("p", student_two_sided(F.col("t"), F.col("df"))).withColumn("log2fc", fold))
    return done.filter((F.col("p_adjusted") < cutoff) & (F.abs("log2fc") >= least_fold))


def top_changes(folds: DataFrame, ring: Column, n: int) -> DataFrame:
    """The n genes of strongest rise and of strongest fall in one ring: (gene, log2fc, direction)."""
    last = folds.filter(ring)
    up = last.filter("log2fc > 0").orderBy(F.desc("log2fc"), "gene").limit(n).withColumn("direction", F.lit("up"))
    down = last.filter("log2fc < 0").orderBy(F.asc("log2fc"), "gene").limit(n).withColumn("direction", F.lit("down"))
    return up.unionByName(down).select("gene", "log2fc", "direction")


def against_baseline(entries: DataFrame, distances: DataFrame, reach: tuple[float, float], baseline: tuple[float, float], width: float) -> DataFrame:
    """(ring, gene, log2fc): mean share of a gene in the cells of each ring against those of a baseline band, 1e-6 added to both.

    distances: (cell, distance) from the edge of a region, negative inside. Rings of `width` lie around reach[0], reach[0] + width, ... up to reach[1];
    the baseline is the cells from baseline[0] up to baseline[1], and may overlap rings. Each cell's entries are divided by the sum of their sizes; cells
    without entries count as zeros. Every gene that occurs has a row for each ring that has cells; without baseline cells there is none.
    """
    ring = spatial.ring_index(F.col("distance"), *reach, width)
    inside = (F.col("distance") >= baseline[0]) & (F.col("distance") < baseline[1])
    both = F.array_compact(F.array(ring, F.when(inside, F.lit(-1))))
    of = stage(distances.select("cell", F.explode(both).alias("ring")))
    sizes = of.groupBy("ring").agg(F.count("*").alias("_n"))  # a row for each ring
    shares = with_groups(entries, ["cell"], F.sum(F.abs("value")).alias("_t")).withColumn("share", F.col("value") / F.when(F.col("_t") != 0, F.col("_t")))
    sums = shares.join(of, "cell").groupBy("gene", "ring").agg(F.sum("share").alias("_s"))
    held = sums.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("ring", "_s"))).alias("_sums"))  # as many as there are rings
    known = entries.select("gene").distinct().join(held, "gene", "left")
    rings = sizes.agg(F.sort_array(F.collect_list(F.struct("ring", "_n"))).alias("_rings"))
    each = known.crossJoin(F.broadcast(rings)).select("gene", "_sums", F.explode("_rings").alias("r"), F.get(F.filter("_rings", lambda r: r["ring"] == -1), 0)["_n"].alias("_b"))
    mean = lambda k, n: F.coalesce(F.try_element_at("_sums", k), F.lit(0.0)) / n
    fold = F.log2(mean(F.col("r.ring"), F.col("r._n")) + 1e-6) - F.log2(mean(F.lit(-1), F.col("_b")) + 1e-6)
    return each.filter("r.ring >= 0 and _b is not null").select(F.col("r.ring").alias("ring"), "gene", fold.alias("log2fc"))


def gradient(folds: DataFrame, rings: int, order: int = 5, window: int = 20) -> DataFrame:
    """`against_baseline` with `smooth`: polynomials of the order along the rings, over `window` of them or all. Rings without cells are left out of the places."""
    place = F.row_number().over(Window.partitionBy("gene").orderBy("ring")) - 1  # a gene's rings
    placed = folds.withColumn("place", place)
    return smoothed_series(stage(placed), ["gene"], "place", "log2fc", min(window, rings), order).drop("place")


def expressed(entries: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """(gene) of mean above `least` in the cells, absent zeros included."""
    n = cells.agg(F.count("*").alias("_n"))
    sums = entries.join(cells.select("cell"), "cell", "left_semi").groupBy("gene").agg(F.sum("value").alias("_s"))
    return sums.crossJoin(F.broadcast(n)).filter(F.col("_s") / F.col("_n") > least).select("gene")


def smoothed_series(series: DataFrame, by: list[str], at: str, value: str, window: int, order: int) -> DataFrame:
    """`series` with `smooth`: least-squares polynomials over a window of places along `at` (integers without gaps), the ends repeating the edge value.

    The window reaches as far to both sides, or one place farther ahead if it is even.
    """
    half, weights = (window - 1) // 2, smoothing_weights(window, order)
    ends = series.groupBy(*by).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    offsets = F.explode(F.array(*(F.struct(F.lit(k - half).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights))))
    wanted = series.select(*by, at).join(ends, by).withColumn("_k", offsets)
    wanted = wanted.withColumn("_at", F.greatest("_first", F.least("_last", F.col(at) + F.col("_k.o"))).cast(series.schema[at].dataType))
    source = series.select(*by, F.col(at).alias("_at"), F.col(value).alias("_v"))
    smooth = wanted.join(source, [*by, "_at"]).groupBy(*by, at).agg(F.sum(F.col("_k.w") * F.col("_v")).alias("smooth"))
    return series.join(smooth, [*by, at])


def set_filter(sets: DataFrame, collection: str, keywords: list[str] = []) -> DataFrame:  # noqa: B006
    """(geneset, genesymbol) of one collection, each once, names without what stands before their first underscore; keywords: names hold one of them."""
    kept = sets.filter(F.col("collection") == collection)
    if keywords:
        hits = [F.contains(F.upper("geneset"), F.lit(k.upper())) for k in keywords]
        found = hits[0]
        for h in hits[1:]:
            found = found | h
        kept = kept.filter(found)
    pair = kept.select(F.regexp_replace("geneset", "^[^_]*_", "").alias("geneset"), "genesymbol").dropna()
    return pair.distinct()


def _completed(rows: DataFrame, names: DataFrame, key: str, absent: dict[str, Column]) -> DataFrame:
    """One row for each of the names beside the other columns of `rows`, which has one row a cell: the fields of `_hits`, an array of structs (key, fields of
    `absent`), or null, and those of `absent` for the names that are not among them. The missing pairs are made where the cell is, and are never shuffled."""
    known = names.agg(F.collect_set(key).alias("_names"))  # one row of names
    wide = rows.crossJoin(known)
    lacking = lambda of: F.transform(of, lambda k: F.struct(k.alias(key), *(v.alias(c) for c, v in absent.items())))
    rest = lacking(F.array_except("_names", F.transform("_hits", lambda h: h[key])))
    both = F.when(F.col("_hits").isNull(), lacking(F.col("_names"))).otherwise(F.concat("_hits", rest))
    return wide.withColumn("_hit", F.explode(both)).select(*(c for c in rows.columns if c != "_hits"), *(F.col(f"_hit.{c}") for c in (key, *absent)))


def over_representation(entries: DataFrame, sets: DataFrame, top: int | None = None, background: int = 20_000, least_members: int = 5, every: bool = True) -> DataFrame:
    """(cell, geneset, overlap, score): -log10 of the chance that the `top` genes of a cell hold so many members of the set or more.

    sets: (geneset, gene). Without `top`, 5 % of the measured genes are drawn, rounded up; a cell with fewer entries draws those. The background has at least
    the measured genes. Sets with fewer members among these than `least_members` drop out. Every cell meets every set; no overlap gives 0, and
    without `every` these rows are left out. Only pairs with an overlap are shuffled or written.
    The tail is summed once for each (members, drawn, overlap) that occurs: outwards from its largest term, so that neither tiny nor many terms are lost.
    """
    measured = stage(entries.select("gene").distinct())
    n = measured.count()
    top, background = math.ceil(n / 20) if top is None else top, max(background, n)
    best = Window.partitionBy("cell").orderBy(F.desc("value"), "gene")
    tops = entries.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top).select("cell", "gene")
    tops = stage(tops)
    members = stage(sets.select("geneset", "gene").distinct().join(measured, "gene", "left_semi"))
    sizes = members.groupBy("geneset").agg(F.count("*").alias("members")).filter(F.col("members") >= least_members)
    drawn = tops.groupBy("cell").agg(F.count("*").alias("drawn"))
    met = tops.join(members, "gene").groupBy("cell", "geneset").agg(F.count("*").alias("overlap"))
    met = stage(met.join(sizes, "geneset").join(drawn, "cell"))
    cases = met.select("members", "drawn", "overlap").distinct()
    tails = cases.withColumn("score", tail_score(background, F.col("members"), F.col("drawn"), F.col("overlap")))
    scored = met.join(tails, ["members", "drawn", "overlap"]).select("cell", "geneset", "overlap", "score")
    if not every:
        return scored
    found = scored.groupBy("cell").agg(F.collect_list(F.struct("geneset", "overlap", "score")).alias("_hits"))
    none = {"overlap": F.lit(0).cast("long"), "score": F.lit(0.0)}
    return _completed(drawn.select("cell").join(found, "cell", "left"), sizes, "geneset", none).select("cell", "geneset", "overlap", "score")


def linear_scores(entries: DataFrame, network: DataFrame, genes: int, least_targets: int = 5) -> DataFrame:
    """(cell, source, t): t of the slope of a cell's expression on a source's target weights over all `genes` genes, absent ones being 0 on both sides.

    network: (source, gene, weight), one row a target. Sources with too few targets drop out; every cell meets every other source. A cell without variance has null t.
    """
    by_source = network.groupBy("source").agg(F.count("*").alias("targets"), F.sum("weight").alias("sw"), F.sum(F.col("weight") ** 2).alias("qw")).filter(F.col("targets") >= least_targets)
    by_cell = entries.groupBy("cell").agg(F.sum("value").alias("sv"), F.sum(F.col("value") ** 2).alias("qv"))
    cross = entries.join(network, "gene").groupBy("cell", "source").agg(F.sum(F.col("value") * F.col("weight")).alias("vw"))
    found = cross.join(by_source, "source", "left_semi").groupBy("cell").agg(F.collect_list(F.struct("source", "vw")).alias("_hits"))
    grid = _completed(by_cell.join(found, "cell", "left"), by_source, "source", {"vw": F.lit(0.0)}).join(by_source, "source")
    n = float(genes)
    cov = F.col("vw") - F.col("sv") * F.col("sw") / n
    vv, ww = F.col("qv") - F.col("sv") ** 2 / n, F.col("qw") - F.col("sw") ** 2 / n
    r = F.when((vv > 0) & (ww > 0), cov / F.sqrt(F.when((vv > 0) & (ww > 0), vv * ww)))
    return grid.withColumn("r", r).select("cell", "source", (F.col("r") * F.sqrt((n - 2) / F.greatest(1 - F.col("r") ** 2, F.lit(1e-15)))).alias("t"))


def set_scores(entries: DataFrame, sets: DataFrame, genes: DataFrame, bins: int = 25) -> DataFrame:
    """(cell, geneset, score): mean of a set's genes minus the mean of all other genes whose average falls into the bins of the set's genes.

    genes: (gene, mean); all genes of those bins serve as controls, so nothing is drawn at random. Absent entries are 0.
    """
    n = genes.count()
    small, more = n // bins, n % bins  # the first bins have one gene more
    place = F.col("_place")
    bin = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / max(small, 1)))
    binned = stage(ordinals(genes, [], ["mean", "gene"], "_place").select("gene", (bin + 1).cast("int").alias("bin")))
    members = stage(sets.select("geneset", "gene").distinct().join(binned, "gene"))
    controls = members.select("geneset", "bin").distinct().join(binned, "bin").join(members, ["geneset", "gene"], "left_anti").select("geneset", "gene")
    both = stage(members.select("geneset", "gene", F.lit(True).alias("member")).unionByName(controls.withColumn("member", F.lit(False))))
    count = lambda flag, name: F.count_if(F.col("member") == flag).alias(name)
    sizes = both.groupBy("geneset").agg(count(True, "m"), count(False, "c"))
    part = lambda flag, name: F.sum(F.when(F.col("member") == flag, F.col("value")).otherwise(0.0)).alias(name)
    sums = entries.join(both, "gene").groupBy("cell", "geneset").agg(part(True, "sm"), part(False, "sc")).join(sizes, "geneset")
    return sums.select("cell", "geneset", (F.col("sm") / F.col("m") - F.coalesce(F.try_divide(F.col("sc"), F.col("c")), F.lit(0.0))).alias("score"))


def finite(scores: DataFrame, value: str) -> DataFrame:
    """Infinite, NaN and null values replaced by the largest finite one."""
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    most = scores.agg(F.max(F.when(good, F.col(value))).alias("_most"))
    return scores.crossJoin(F.broadcast(most)).withColumn(value, F.when(good, F.col(value)).otherwise(F.col("_most"))).drop("_most")


def module_means(entries: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, cell, value): mean of a module's genes, scaled to [0, 1] over the modules of each cell. modules: (gene, module); absent entries are 0."""
    sizes = modules.groupBy("module").agg(F.count("*").alias("_n"))
    means = entries.join(modules, "gene").groupBy("module", "cell").agg(F.sum("value").alias("_s")).join(sizes, "module").select("module", "cell", (F.col("_s") / F.col("_n")).alias("v"))
    found = means.groupBy("cell").agg(F.collect_list(F.struct("module", "v")).alias("_hits"), F.min("v").alias("_l"), F.max("v").alias("_u"), F.count("*").alias("_c"))
    whole = found.crossJoin(sizes.agg(F.count("*").alias("_m")))
    low, high = (F.when(F.col("_c") < F.col("_m"), f(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for f, c in ((F.least, "_l"), (F.greatest, "_u")))
    ranged = _completed(whole.withColumn("_low", low).withColumn("_width", F.when(high > low, high - low)), sizes, "module", {"v": F.lit(0.0)})
    return ranged.select("module", "cell", F.coalesce((F.col("v") - F.col("_low")) / F.col("_width"), F.lit(0.0)).alias("value"))
