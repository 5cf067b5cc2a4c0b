"""Registered queries: pattern labelling (C1-C4) of the reported extremes.

Keys already labelled: extremes whose document appears in ``labels``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import NON_RANDOM_METRICS
from ..operators import labels as lb
from ..operators import span_cursor as cursor
from ..registry import register
from . import corpus
from .q_selection import EXTREMES, extremes_query

_NR = ", ".join(f"'{m}'" for m in NON_RANDOM_METRICS)

WORK = EXTREMES + f""",
ext_t AS (SELECT e.metric AS metric_name, e.best_or_worst, e.num::INTEGER AS num, s.doc_ord, d.text
          FROM extremes e JOIN scoring s ON s.shard_stem = e.shard_stem AND s.raw_start_idx = e.start_idx
               JOIN documents d ON d.doc_id = s.doc_ord
          WHERE e.metric IN ({_NR})),
done AS (SELECT metric_name, best_or_worst, num FROM ext_t WHERE doc_ord IN (SELECT doc_id FROM labels)),
work AS (SELECT * FROM ext_t e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.metric_name = e.metric_name
                 AND d.best_or_worst = e.best_or_worst AND d.num = e.num))"""


def _work(spark, sf_dir):
    ext = extremes_query(spark, sf_dir).where(F.col("metric").isin(NON_RANDOM_METRICS))
    want = ext.select("shard_stem", (F.col("start_idx") - 512).alias("start_idx"),
                      (F.col("end_idx") - 512).alias("end_idx")).distinct()
    texts = cursor.decode_spans(want, corpus.shard_files(spark, sf_dir)).select(
        "shard_stem", (F.col("start_idx") + 512).alias("start_idx"), "text")
    # documents of the spans, to find keys already labelled
    delims, _, _ = corpus.index(spark, sf_dir)
    p = corpus.pieces(spark, sf_dir).where(F.col("doc_start") == 0).select(
        "doc_ord", F.col("shard_id").cast("int").alias("shard_id"), (F.col("shard_pos") + 512).alias("start_idx"))
    from ..operators.tokens import with_shard_names
    p = with_shard_names(p).select("doc_ord", "shard_stem", "start_idx")
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc_ord"))
    done = ext.join(p, ["shard_stem", "start_idx"]).join(labelled, "doc_ord", "left_semi") \
        .select(F.col("metric").alias("metric_name"), "best_or_worst", F.col("num").cast("int").alias("num"))
    ext = ext.withColumn("num", F.col("num").cast("int"))
    return lb.work_list(ext, texts, done)


@register("c1_work_list", f"""
WITH {WORK}
SELECT metric_name, best_or_worst, num, length(text)::INTEGER AS n_chars FROM work
""")
def c1_work_list(spark, sf_dir):
    return _work(spark, sf_dir).select("metric_name", "best_or_worst", "num", F.length("text").alias("n_chars"))


_RULES = """
length(text) > 1000 AS narrative_prose,
length(regexp_replace(text, '[^A-Z]', '', 'g')) * 10 > length(text) AS named_entity_flood,
contains(text, 'http') AS seo_spam,
regexp_matches(text, '[0-9][a-z]') AS ocr_noise,
length(text) < 200 AS semantic_incoherence,
NOT contains(text, '.') AS word_salad,
contains(text, '{') AS metadata_dump,
contains(text, '<') AS mixed_format,
length(text) - length(replace(text, chr(10), '')) > 10 AS repetitive_templates,
regexp_matches(text, '\\n[-*]') AS list_like_structure"""


# every reported extreme with its labels
LABELLED = WORK + f"""
SELECT metric_name, best_or_worst, num, {_RULES} FROM ext_t"""


@register("c2_c4_pattern_labels", f"""
WITH {WORK}
SELECT metric_name, best_or_worst, num, {_RULES} FROM work
""")
def c2_c4_pattern_labels(spark, sf_dir):
    out = lb.classify(_work(spark, sf_dir), lb.rule_classifier)
    return out.select("metric_name", "best_or_worst", "num", *lb.PATTERN_FIELDS)
