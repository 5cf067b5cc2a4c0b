"""Mixing sources to target weights by entropy balancing.

*Targets.*  Sources, in code point order with null last, get the weights
5, 2, 1 in turn and share all words by weight; no target exceeds ``most``
times its source, the excess is shared out again by weight.

*Rates.*  Each document gets the rate that stays closest, in relative entropy
with bounds 0 and ``most``, to taking everything once while its source's words
meet the target.  The dual has one variable per source, and the rate is the
exponentially tilted ``most / (1 + (most - 1) exp(-lambda * x))`` with
``x = (size / mean size) ** tilt``; ``tilt`` is the weight of length in the
prior (0: all documents of a source alike).  Newton steps run on Spark: every
step is one aggregate of gradient and curvature per source over the histogram
of (source, size), which is small however many documents share a size.  Each step
is a small plan of its own that writes its state; every fourth step looks
whether the sources are near enough.  A step
that leaves the bracket known so far is replaced by the bracket's middle.

*Copies.*  Rates become whole copies by systematic rounding along each source
in size order, so rounding errors of neighbours cancel; a document's place
within its (source, size) cell is found with salted counts, so a hot cell is
spread over many tasks.  What is left between taken words and target is closed
with one more or one less copy of a few documents of falling size.

Nothing is drawn at random: sums over documents are of integers, the dual, a sum
of doubles whose order may differ, is rounded to nine digits, and documents are
ordered by id, so reruns agree on any number of executors.  Nulls: a null text has size 0, a null source is a source of its
own, null ids are kept.  Repeated rows are documents of their own.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SALTS = 64
PER_CLASS = 3
SETTLED = 1e-6


def documents_by_size(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row.alias("row"))


def source_targets(cells: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """``source, source_size, mean_size, weight, target``: water filling under the caps, one row per source."""
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                          F.sum("n").alias("n_docs"))
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    # sources reach their caps in the order of cap / weight
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy())
             - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / \
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    final = F.max(F.when(F.col("free"), F.col("level"))).over(Window.partitionBy())
    return filled.select(
        "source", "source_size", (F.col("source_size") / F.col("n_docs")).alias("mean_size"), "weight",
        F.when(F.col("free"), final * F.col("weight")).otherwise(F.col("cap")).alias("target"), "free")


def tilted_rate(lam: Column, x: Column, most: float) -> Column:
    return F.lit(most) / (F.lit(1.0) + F.lit(most - 1) * F.exp(-lam * x))


def newton(cells: DataFrame, targets: DataFrame, most: float, tilt: float, tolerance: float = 1e-9,
           steps_a_job: int = 4, jobs: int = 12, most_jobs: int = 40) -> DataFrame:
    """``source, lam``: the dual variables of the free sources.

    After ``jobs`` jobs a gap of ``SETTLED`` of a target is enough; an error if ``most_jobs`` leave more.
    """
    x = F.pow(F.col("size") / F.col("mean_size"), F.lit(tilt))
    state = targets.filter("free and source_size > 0").select(
        "source", "target", "mean_size", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"),
        F.lit(1e6).alias("high"), F.lit(1.0).alias("off"))
    for job in range(1, most_jobs + 1):
        for _ in range(steps_a_job):
            rate = tilted_rate(F.col("lam"), x, most)
            words = F.col("n") * F.col("size")
            sums = join_same(cells, state, "source") \
                .groupBy("source", "target", "mean_size", "lam", "low", "high").agg(
                    F.sum(words * rate).alias("got"),
                    F.sum(words * x * rate * (1 - rate / most)).alias("slope"))
            gap = F.col("got") - F.col("target")
            low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), \
                F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
            stepped = sums.withColumns({"l": low, "h": high, "step": F.col("lam") - F.try_divide(gap, F.col("slope"))})
            inside = (F.col("step") > F.col("l")) & (F.col("step") < F.col("h"))
            state = stepped.select(
                "source", "target", "mean_size",
                F.when(gap == 0, F.col("lam")).when(inside, F.col("step"))
                .otherwise((F.col("l") + F.col("h")) / 2).alias("lam"),
                F.col("l").alias("low"), F.col("h").alias("high"),
                F.abs(gap / F.col("target")).alias("off"))
            state = stage(state, "dual")  # steps planned together cost the driver the square of their number
        worst = state.agg(F.max("off")).first()[0]  # one number for all sources
        if worst is None or worst <= (tolerance if job < jobs else SETTLED):
            break
    else:
        raise RuntimeError(f"the dual has not converged: a source is {worst:.2e} of its target off after "
                           f"{most_jobs * steps_a_job} steps")
    return state.select("source", F.round("lam", 9).alias("lam"))


def copies(docs: DataFrame, cells: DataFrame, most: float) -> DataFrame:
    """Whole copies per document by systematic rounding; ``cells`` carries the rate of (source, size)."""
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0)))
    salted = docs.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.lit(SALTS)))
    counts = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("k"))
    ahead = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "size", "salt", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("ahead"))
    joined = join_same(starts, based, "source", "size").select("source", "size", "salt", "ahead", "base", "rate")
    here = Window.partitionBy("source", "size", "salt").orderBy("doc_id", "row")
    placed = salted.withColumn("place", F.row_number().over(here) - 1)
    full = join_same(placed, joined, "source", "size", "salt").select(
        "doc_id", "row", "source", "size", "rate",
        (F.col("base") + (F.col("ahead") + F.col("place")) * F.col("rate") + 0.5).alias("at"))
    whole = F.floor(F.col("at") + F.col("rate")) - F.floor(F.col("at"))
    return full.select("doc_id", "row", "source", "size", "rate",
                       F.least(F.greatest(whole, F.lit(0)), F.lit(int(most))).cast("long").alias("copies"))


def closing_flips(taken: DataFrame, targets: DataFrame, most: float, past: bool) -> DataFrame:
    """``row, flip``: a few documents per source that get one copy more or less to close the gap.

    With ``past`` a document may step past the target if that comes nearer to it.
    """
    got = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
    gaps = join_same(got, targets, "source").select("source", (F.col("target") - F.col("got")).alias("gap"))
    open_ = join_same(taken, gaps, "source").select("row", "source", "size", "copies", "gap", "doc_id")
    able = ((F.col("gap") > 0) & (F.col("copies") < int(most))) | ((F.col("gap") < 0) & (F.col("copies") > 0))
    in_class = open_.filter(able & (F.col("size") > 0) & (F.col("size") < F.abs("gap") * (2 if past else 1))).withColumn(
        "class", F.floor(F.log2("size")))
    few = in_class.withColumn("k", F.row_number().over(
        Window.partitionBy("source", "class").orderBy("doc_id", "row"))).filter(F.col("k") <= PER_CLASS)
    # at most PER_CLASS documents of each power of two: greedily from the longest
    lists = few.groupBy("source", "gap").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("size", "row")))).alias("able"))
    left = F.struct(F.abs("gap").alias("left"), F.array().cast("array<bigint>").alias("rows"))
    chosen = F.aggregate("able", left, lambda s, d: F.when(
        d["size"] < s["left"] * (2 if past else 1), F.struct((s["left"] - d["size"]).alias("left"),
                                         F.concat(s["rows"], F.array(d["row"])).alias("rows"))).otherwise(s))
    return lists.select(F.explode(chosen["rows"]).alias("row"), F.signum("gap").cast("long").alias("flip"))


def join_same(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, most: int = 3, tilt: float = 0.5, row_col: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source, rate, copies``: one row per document.

    With ``row_col`` the documents' own row numbers are used and returned.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    by_doc = stage(documents_by_size(docs, id_col, text_col, source_col, row), "sizes")
    cells = stage(by_doc.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-cells")
    targets = stage(source_targets(cells, weights, float(most)), "targets")
    dual = newton(cells, targets, float(most), tilt)
    known = join_same(targets, dual, "source", how="left")
    x = F.pow(F.col("size") / F.col("mean_size"), F.lit(tilt))
    rate = F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(tilted_rate(F.col("lam"), x, float(most)))
    rated = join_same(cells, known, "source").select(
        "source", "size", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    taken = stage(copies(by_doc, rated, float(most)), "copies")
    for past in (True, False):
        flips = stage(closing_flips(taken, targets, float(most), past), "flips")
        taken = taken.join(flips, "row", "left").withColumn(
            "copies", F.col("copies") + F.coalesce("flip", F.lit(0))).drop("flip")
        taken = stage(taken, "copies-closed") if past else taken
    return join_same(taken, targets, "source").select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), F.col("source").alias(source_col), "rate", "copies",
        *([F.col("row").alias(row_col)] if row_col else []))
