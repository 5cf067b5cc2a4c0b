"""Registered queries: data selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import HEADER_TOKENS, METRIC_COLUMNS, NON_RANDOM_METRICS, SELECTION_DIVISOR
from ..operators import selection as sel
from ..operators import span_cursor as cursor
from ..operators import spans as sp
from ..operators.ordering import prefix_sum
from ..registry import register
from ..session import scratch_path
from ..sources import files
from ..sources import token_bin as tb
from . import corpus
from . import sql_parts as q
from .q_index import SCORING
from .params import TOP_N


def metrics_standin(spark, sf_dir):
    """Metrics rows for the scoring spans with values by integer arithmetic
    (the geometry scores need model vectors; these stand in with ties and
    NaN so every ordering rule is exercised)."""
    delims, _, _ = corpus.index(spark, sf_dir)
    s = sp.scoring_spans(delims).select("shard_stem", F.col("raw_start_idx").alias("start_idx"),
                                        F.col("raw_end_idx").alias("end_idx"))
    st, en = F.col("start_idx"), F.col("end_idx")
    cols = {f"random_seed_{k}": (F.pmod(st * (2 * k + 3) + en * 7919, F.lit(1009)).cast("double") / 1009.0)
            for k in range(10)}
    cols["schatten_norm"] = (en - st).cast("double")
    cols["effective_rank"] = F.pmod(st * 31 + en, F.lit(101)).cast("double") / 10.0
    cols["MLE"] = F.pmod(en * 17, F.lit(53)).cast("double") / 7.0
    cols["CorrInt"] = F.when(F.pmod(st, F.lit(11)) == 0, F.lit(float("nan"))) \
        .otherwise(F.pmod(st + en, F.lit(89)).cast("double"))
    cols["TwoNN"] = F.pmod(en - st, F.lit(23)).cast("double")
    return s.select("shard_stem", "start_idx", "end_idx",
                    ((en - st - 1) >= 300).alias("has_enough_tokens"),
                    *[cols[c].alias(c) for c in METRIC_COLUMNS])


_VALS = ",\n".join(
    [f"(pmod_s * {2 * k + 3} + pmod_e * 7919) % 1009 / 1009.0 AS random_seed_{k}" for k in range(10)])
METRICS = SCORING + f""",
m0 AS (SELECT shard_stem, raw_start_idx AS start_idx, raw_end_idx AS end_idx,
              raw_start_idx AS pmod_s, raw_end_idx AS pmod_e FROM scoring),
metrics AS (SELECT shard_stem, start_idx, end_idx, (end_idx - start_idx - 1) >= 300 AS has_enough_tokens,
                   {_VALS},
                   (end_idx - start_idx)::DOUBLE AS schatten_norm,
                   ((start_idx * 31 + end_idx) % 101)::DOUBLE / 10.0 AS effective_rank,
                   ((end_idx * 17) % 53)::DOUBLE / 7.0 AS MLE,
                   CASE WHEN start_idx % 11 = 0 THEN 'NaN'::DOUBLE ELSE ((start_idx + end_idx) % 89)::DOUBLE END AS CorrInt,
                   ((end_idx - start_idx) % 23)::DOUBLE AS TwoNN
            FROM m0),
kept AS (SELECT * FROM metrics WHERE has_enough_tokens),
ordered AS (SELECT *, row_number() OVER (ORDER BY shard_stem, start_idx) AS input_ord FROM kept),
trimmed AS (SELECT * FROM ordered WHERE input_ord <= (SELECT (count(*) // {SELECTION_DIVISOR}) * {SELECTION_DIVISOR} FROM ordered)),
long AS (UNPIVOT trimmed ON {", ".join(METRIC_COLUMNS)} INTO NAME metric VALUE value),
ranked AS (SELECT shard_stem, start_idx, end_idx, metric, value,
                  row_number() OVER (PARTITION BY metric ORDER BY isnan(value), value DESC, shard_stem, start_idx) AS rank
           FROM long)"""


@register("x1_enough_tokens", f"""
WITH {METRICS}
SELECT count(*)::BIGINT AS n_total, count(*) FILTER (WHERE has_enough_tokens)::BIGINT AS n_kept,
       count(*) FILTER (WHERE NOT has_enough_tokens)::BIGINT AS n_dropped
FROM metrics
""")
def x1_enough_tokens(spark, sf_dir):
    _, report = sel.keep_enough_tokens(metrics_standin(spark, sf_dir))
    return report


def _trimmed(spark, sf_dir):
    kept, _ = sel.keep_enough_tokens(metrics_standin(spark, sf_dir))
    return sel.trim_to_multiple(sel.input_order(kept))


@register("x2_trim", f"""
WITH {METRICS}
SELECT shard_stem, start_idx, end_idx, input_ord::BIGINT AS input_ord FROM trimmed
""")
def x2_trim(spark, sf_dir):
    return _trimmed(spark, sf_dir).select("shard_stem", "start_idx", "end_idx",
                                          F.col("input_ord").cast("long").alias("input_ord"))


def _ranked(spark, sf_dir):
    t = _trimmed(spark, sf_dir).drop("input_ord", "has_enough_tokens")
    return sel.rank_per_metric(sel.long_form(t))


@register("x3_rank_per_metric", f"""
WITH {METRICS}
SELECT metric, shard_stem, start_idx, value, rank::BIGINT AS rank FROM ranked
""")
def x3_rank_per_metric(spark, sf_dir):
    return _ranked(spark, sf_dir).select("metric", "shard_stem", "start_idx", "value",
                                         F.col("rank").cast("long").alias("rank"))


@register("x4_split_files", f"""
WITH {METRICS},
n AS (SELECT count(*) AS n FROM trimmed),
files AS (SELECT metric, ((rank - 1) // ((SELECT n FROM n) // 10) + 1)::INTEGER AS file_no, end_idx - start_idx AS len
          FROM ranked)
SELECT metric, file_no, count(*)::BIGINT AS n_docs, sum(len)::BIGINT AS n_tokens
FROM files WHERE file_no <= 10 GROUP BY metric, file_no
""")
def x4_split_files(spark, sf_dir):
    t = _trimmed(spark, sf_dir)
    n = t.count()
    ranked = sel.rank_per_metric(sel.long_form(t.drop("input_ord", "has_enough_tokens")))
    files = sel.split_files(ranked, n)
    return files.groupBy("metric", "file_no").agg(
        F.count(F.lit(1)).cast("long").alias("n_docs"),
        F.sum(F.col("end_idx") - F.col("start_idx")).cast("long").alias("n_tokens"))


def _ranked_files(spark, sf_dir, metrics=None):
    """Rows of every metric's selection files with their offsets inside the file."""
    t = _trimmed(spark, sf_dir)
    n = t.count()
    kept = t.drop("input_ord", "has_enough_tokens", *[c for c in METRIC_COLUMNS if c not in (metrics or METRIC_COLUMNS)])
    ranked = sel.rank_per_metric(sel.long_form(kept, metrics))
    ranges = sel.split_files(ranked, n).withColumn("len", F.col("end_idx") - F.col("start_idx"))
    # offsets inside each output file: prefix sum in rank order
    return prefix_sum(ranges, "rank", "len", "out_offset", partition_cols=["metric", "file_no"])


@register("x5_file_offsets", f"""
WITH {METRICS},
n AS (SELECT count(*) AS n FROM trimmed),
files AS (SELECT metric, ((rank - 1) // ((SELECT n FROM n) // 10) + 1)::INTEGER AS file_no, rank,
                 shard_stem, start_idx, end_idx - start_idx AS len FROM ranked)
SELECT metric, file_no, shard_stem, start_idx,
       (sum(len) OVER (PARTITION BY metric, file_no ORDER BY rank ROWS UNBOUNDED PRECEDING) - len)::BIGINT AS out_offset
FROM files WHERE file_no <= 10
""")
def x5_file_offsets(spark, sf_dir):
    return _ranked_files(spark, sf_dir).select("metric", "file_no", "shard_stem", "start_idx", "out_offset")


_NR = ", ".join(f"'{m}'" for m in NON_RANDOM_METRICS)


@register("x5_token_files", f"""
WITH {METRICS},{q.STREAM_ROWS},
n AS (SELECT count(*) AS n FROM trimmed),
files AS (SELECT metric, ((rank - 1) // ((SELECT n FROM n) // 10) + 1)::INTEGER AS file_no, rank,
                 shard_stem, start_idx - 512 AS start_idx, end_idx - 512 AS end_idx, end_idx - start_idx AS len FROM ranked
          WHERE metric IN ({_NR})),
placed AS (SELECT *, sum(len) OVER (PARTITION BY metric, file_no ORDER BY rank ROWS UNBOUNDED PRECEDING) - len AS out_offset
           FROM files WHERE file_no <= 10)
SELECT printf('%s_%02d', metric, file_no) AS file_stem, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS token_sum,
       sum(tok::HUGEINT * (out_offset + pos - start_idx))::BIGINT AS weighted_sum
FROM placed p JOIN (SELECT *, printf('fineweb_%s_%06d', CASE WHEN shard_id = 0 THEN 'val' ELSE 'train' END, shard_id) AS shard_stem
                    FROM token_rows) t
     ON t.shard_stem = p.shard_stem AND t.pos >= p.start_idx AND t.pos < p.end_idx
GROUP BY 1
""")
def x5_token_files(spark, sf_dir):
    """The ranked training files of every geometry metric, written and read back (sums: ``selection.file_sums``)."""
    shards = corpus.shard_files(spark, sf_dir)
    placed = _ranked_files(spark, sf_dir, NON_RANDOM_METRICS).select(
        F.format_string("%s_%02d", "metric", "file_no").alias("shard_stem"), F.col("out_offset").alias("start_pos"),
        F.col("len").alias("n_tokens"), F.col("shard_stem").alias("from_stem"),
        *[(F.col(c) - HEADER_TOKENS).alias(c) for c in ("start_idx", "end_idx")])

    def cut(dealt):
        names = {"shard_stem": "file_stem", "from_stem": "shard_stem"}
        packed = cursor.packed_spans(dealt.withColumnsRenamed(names), shards, dealt=True)
        return packed.drop("shard_stem").withColumnRenamed("file_stem", "shard_stem")

    folder = scratch_path(spark, f"selected-{uuid.uuid4().hex}")
    written = tb.write_long_shards(placed, folder, cut=cut)
    files.delete_on_exit(spark, folder)
    if not written:  # too few documents for the selection files
        return spark.createDataFrame([], "file_stem string, n_tokens long, token_sum long, weighted_sum long")
    return sel.file_sums(tb.read_shards(spark, folder + "/*.bin")).withColumnRenamed("shard_stem", "file_stem")


EXTREMES = METRICS + f""",
kept_long AS (UNPIVOT (SELECT * EXCLUDE (has_enough_tokens) FROM kept) ON {", ".join(METRIC_COLUMNS)} INTO NAME metric VALUE value),
ext AS (
  SELECT metric, 'best' AS best_or_worst, row_number() OVER (PARTITION BY metric ORDER BY value DESC, shard_stem DESC, start_idx DESC) AS num,
         shard_stem, start_idx, end_idx, value FROM kept_long WHERE NOT isnan(value)
  UNION ALL
  SELECT metric, 'worst', row_number() OVER (PARTITION BY metric ORDER BY value ASC, shard_stem ASC, start_idx ASC),
         shard_stem, start_idx, end_idx, value FROM kept_long WHERE NOT isnan(value)),
extremes AS (SELECT * FROM ext WHERE num <= {TOP_N})"""


def extremes_query(spark, sf_dir, n=TOP_N):
    # of every document with enough tokens: extremes are not trimmed to whole selection files
    kept, _ = sel.keep_enough_tokens(metrics_standin(spark, sf_dir))
    return sel.extremes(sel.long_form(kept.drop("has_enough_tokens")), n)


@register("x6_extremes", f"""
WITH {EXTREMES}
SELECT metric, best_or_worst, num::INTEGER AS num, shard_stem, start_idx, end_idx, value FROM extremes
""")
def x6_extremes(spark, sf_dir):
    return extremes_query(spark, sf_dir).select("metric", "best_or_worst", F.col("num").cast("int").alias("num"),
                                                "shard_stem", "start_idx", "end_idx", "value")


@register("x7_preview", f"""
WITH {EXTREMES}
SELECT e.metric, e.best_or_worst, e.num::INTEGER AS num,
       CASE WHEN length(d.text) > 600 THEN substring(d.text, 1, 600) || '…' ELSE d.text END AS preview
FROM extremes e JOIN scoring s ON s.shard_stem = e.shard_stem AND s.raw_start_idx = e.start_idx
     JOIN documents d ON d.doc_id = s.doc_ord
""")
def x7_preview(spark, sf_dir):
    ext = extremes_query(spark, sf_dir)
    # decode only the spans that are reported (header offset removed first)
    want = ext.select("shard_stem", (F.col("start_idx") - 512).alias("start_idx"),
                      (F.col("end_idx") - 512).alias("end_idx")).distinct()
    texts = cursor.decode_spans(want, corpus.shard_files(spark, sf_dir))
    texts = texts.select("shard_stem", (F.col("start_idx") + 512).alias("start_idx"), "text")
    return ext.join(texts, ["shard_stem", "start_idx"]).select(
        "metric", "best_or_worst", F.col("num").cast("int").alias("num"), sel.preview(F.col("text")).alias("preview"))


@register("x8_random_subsets")
def x8_random_subsets(spark, sf_dir):
    m = metrics_standin(spark, sf_dir)
    score = sel.uniform_score(42, F.col("shard_stem"), F.col("start_idx"))
    scored = m.select("shard_stem", "start_idx", score.alias("u42"))
    return scored.select(
        "shard_stem", "start_idx", "u42",
        *[(F.col("u42") < p / 100.0).alias(f"in_random42_{p}") for p in (10, 30, 50, 70)])


@register("s8_s9_metrics_csv", f"""
WITH {METRICS}
SELECT shard_stem, start_idx, end_idx, has_enough_tokens, schatten_norm, CorrInt FROM metrics
WHERE shard_stem LIKE 'fineweb_train%'
""")
def s8_s9_metrics_csv(spark, sf_dir):
    from ..sources import metrics as mx
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    m = metrics_standin(spark, sf_dir)
    # first pass writes the first shard only, the second pass must skip it
    first = m.select("shard_stem").distinct().orderBy("shard_stem").first()["shard_stem"]
    mx.write_metrics(m.where(F.col("shard_stem") == first), path)
    mx.write_metrics(m, path)
    back = mx.read_metrics(spark, path)
    return back.select("shard_stem", "start_idx", "end_idx", "has_enough_tokens", "schatten_norm", "CorrInt")
