"""Registered queries: the other text logs, records and small rules.

Their lines are written from the driver tables in the trainer's formats and
parsed back, so the work grows with the tables: one experiment per event type,
one shard per user, one record per day of events, one pattern per part name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import TARGET_LOSS_SHORT
from ..operators import evaluation as ev
from ..operators import labels as lb
from ..operators import runs as rn
from ..operators import schedule as sc
from ..operators import selection as sel
from ..registry import register
from ..session import scratch_path
from ..sources import logs
from ..sources.tables import read_table
from .params import TOP_N
from .q_eval import TASKS, tasks
from .q_labels import _RULES, WORK, _work
from .q_runs import BASELINE_VARIANT, FINAL, P_LESS, RUNLOG, final_losses, run_log
from .q_selection import EXTREMES, extremes_query

SCHEDULE = [0.25, 0.5, 0.75, 1.0, 0.5]
SCHEDULE_TOTAL = 40


def events(spark, sf_dir):
    return read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])


@register("c3_field_names", """
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS field FROM part
""")
def c3_field_names(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", lb.to_field(F.col("p_name")).alias("field"))


@register("e9_weighted_loss", f"""
SELECT event_id, [{", ".join(map(str, SCHEDULE))}][event_id % {len(SCHEDULE)} + 1]::DOUBLE * (3 + value / 1000) AS weighted FROM events
""")
def e9_weighted_loss(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", ev.weighted_loss(F.col("event_id"), 3 + F.col("value") / 1000, SCHEDULE).alias("weighted"))


LOOKAHEAD = [4.0, 2.0, 1.0]  # whole numbers, so that equal sums round alike in every order


@register("e9_lookahead_loss", f"""
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)
SELECT a.user_id, a.pos::BIGINT AS pos,
       sum([{", ".join(map(str, LOOKAHEAD))}][b.pos - a.pos + 1]::DOUBLE * (3 + abs(a.value - b.value) / 1000)) AS loss
FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos >= a.pos AND b.pos < a.pos + {len(LOOKAHEAD)}
GROUP BY a.user_id, a.pos
""")
def e9_lookahead_loss(spark, sf_dir):
    """A user's events in order are a sequence; the loss of a target is a distance of two events' values."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ahead = F.array(*[F.lead("value", k).over(w) for k in range(len(LOOKAHEAD))])
    rows = events(spark, sf_dir).select("user_id", "value", (F.row_number().over(w) - 1).cast("long").alias("pos"),
                                        ahead.alias("ahead"))
    losses = rows.select("user_id", "pos", "value", F.posexplode("ahead").alias("k", "other")).where("other IS NOT NULL").select(
        "user_id", "pos", (F.col("pos") + F.col("k")).alias("target_pos"), (3 + F.abs(F.col("value") - F.col("other")) / 1000).alias("loss"))
    return ev.lookahead_loss(losses, LOOKAHEAD, ["user_id"])


@register("h6_index_schedule", f"""
SELECT event_id, [{", ".join(map(str, SCHEDULE))}][least(floor({len(SCHEDULE)} * (event_id % 60) / {SCHEDULE_TOTAL}::DOUBLE), {len(SCHEDULE) - 1})::INTEGER + 1]::DOUBLE AS weight
FROM events
""")
def h6_index_schedule(spark, sf_dir):
    schedule = F.array(*[F.lit(x) for x in SCHEDULE])
    return events(spark, sf_dir).select("event_id", sc.index_schedule(
        schedule, F.pmod(F.col("event_id"), F.lit(60)), SCHEDULE_TOTAL).alias("weight"))


@register("s10_label_table", f"""
WITH {WORK}
SELECT metric_name, best_or_worst, num, {_RULES} FROM work
""")
def s10_label_table(spark, sf_dir):
    path = scratch_path(spark, f"labels-{uuid.uuid4().hex}")
    labelled = lb.classify(_work(spark, sf_dir), lb.rule_classifier)
    lb.append_new(labelled.where("num <= 2"), path)
    lb.append_new(labelled, path)  # only keys that are not there yet are added
    lb.append_new(labelled, path)
    return spark.read.parquet(path).select("metric_name", "best_or_worst", "num", *lb.PATTERN_FIELDS)


@register("s11_extremes_report", f"""
WITH {EXTREMES}
SELECT metric, best_or_worst, num::INTEGER AS num,
       printf('%d. %.4f %s [%d,%d)', num, value, shard_stem, start_idx, end_idx) AS line FROM extremes
""")
def s11_extremes_report(spark, sf_dir):
    return extremes_query(spark, sf_dir, TOP_N).select(
        "metric", "best_or_worst", F.col("num").cast("int").alias("num"), sel.report_line().alias("line"))


@register("s13_compact_log", f"""
WITH {RUNLOG}
SELECT run_id, step, val_loss FROM vals
""")
def s13_compact_log(spark, sf_dir):
    rows = run_log(spark, sf_dir).where("kind = 'val'")
    line = F.format_string("s:%d tel:%.4f", F.col("step"), F.col("val_loss"))
    lines = rows.select("run_id", F.explode(F.array(line, F.lit("a line of another kind"))).alias("value"))
    return logs.parse_compact_log(lines)


def loss_log_lines(spark, sf_dir):
    """One experiment per event type: step rows, one mean loss per shard (user), and how it ended."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("run_id"), "event_id", "user_id",
                                     (3 + F.floor("value") / 1000).alias("loss"))
    steps = e.select("run_id", F.format_string("%d,%.4f", "event_id", "loss").alias("value"))
    shards = e.groupBy("run_id", "user_id").agg(F.avg("loss").alias("loss")).select(
        "run_id", F.format_string("shard,fineweb_train_%06d.bin,%.4f", "user_id", "loss").alias("value"))
    ends = e.groupBy("run_id").agg(F.max("event_id").alias("last")).select(
        "run_id", F.format_string("last step %d, error none, really", "last").alias("value"))
    header = e.select("run_id", F.lit("step,val_loss").alias("value")).distinct()
    return header.unionByName(steps).unionByName(shards).unionByName(ends)


LOSS = """
e AS (SELECT event_type AS run_id, event_id, user_id, 3 + floor(value) / 1000 AS loss FROM events),
shard_rows AS (SELECT run_id, printf('fineweb_train_%06d.bin', user_id) AS shard_name, round(avg(loss), 4) AS val_loss
               FROM e GROUP BY run_id, user_id)"""


@register("s14_loss_log", f"""
WITH {LOSS}
SELECT 'step' AS kind, run_id, event_id AS step, NULL AS shard_name, round(loss, 4) AS val_loss, NULL AS error FROM e
UNION ALL SELECT 'end', run_id, max(event_id), NULL, NULL, 'none, really' FROM e GROUP BY run_id
""")
def s14_loss_log(spark, sf_dir):
    views = logs.parse_loss_log(loss_log_lines(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    steps = views["steps"].select(F.lit("step").alias("kind"), "run_id", "step", nothing.alias("shard_name"),
                                  "val_loss", nothing.alias("error"))
    ends = views["ends"].select(F.lit("end").alias("kind"), "run_id", "step", nothing.alias("shard_name"),
                                F.lit(None).cast("double").alias("val_loss"), "error")
    return steps.unionByName(ends)


@register("r3_loss_per_shard", f"""
WITH {LOSS}
SELECT shard_name, count(*)::BIGINT AS n_experiments FROM shard_rows GROUP BY shard_name
""")
def r3_loss_per_shard(spark, sf_dir):
    wide = rn.loss_per_shard(logs.parse_loss_log(loss_log_lines(spark, sf_dir))["shards"])
    experiments = [F.col(f"`{c}`").isNotNull().cast("long") for c in wide.columns if c != "shard_name"]
    return wide.select("shard_name", sum(experiments[1:], experiments[0]).alias("n_experiments"))


def bench_log(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy(F.col("event_type").alias("exp")).agg(
        F.count_if(F.col("value") < 100).alias("n_correct"), F.count(F.lit(1)).alias("n_count"))
    rows = counts.withColumn("accuracy", F.col("n_correct") / F.col("n_count"))
    path = scratch_path(spark, f"bench-{uuid.uuid4().hex}")
    logs.format_bench_rows(rows).write.text(path)
    return logs.read_bench_log(spark, path)


BENCH = """
bench AS (SELECT event_type AS exp, count(*) FILTER (WHERE value < 100) AS n_correct, count(*) AS n_count,
                 round(count(*) FILTER (WHERE value < 100) / count(*), 3) AS accuracy FROM events GROUP BY event_type)"""


@register("s15_bench_log", f"""
WITH {BENCH} SELECT exp, accuracy, n_correct, n_count FROM bench
""")
def s15_bench_log(spark, sf_dir):
    return bench_log(spark, sf_dir)


@register("r21_experiments", f"""
WITH {LOSS}, {BENCH},
last AS (SELECT run_id AS exp, round(arg_max(loss, event_id), 4) AS final_loss FROM e GROUP BY run_id)
SELECT exp, final_loss, accuracy, rank() OVER (ORDER BY final_loss)::INTEGER AS loss_rank,
       rank() OVER (ORDER BY accuracy DESC)::INTEGER AS accuracy_rank
FROM last JOIN bench USING (exp)
""")
def r21_experiments(spark, sf_dir):
    steps = logs.parse_loss_log(loss_log_lines(spark, sf_dir))["steps"]
    return rn.compare_experiments(steps, bench_log(spark, sf_dir))


def record_rows(spark, sf_dir):
    """A record table with one row per day of events, as markdown lines, parsed back."""
    day = events(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("user_id").alias("a"), F.max("user_id").alias("b"))
    line = F.concat_ws(" | ", F.dayofyear("date").cast("string"), F.format_string("%.1f minutes", 10 + F.col("n") / 10),
                       F.format_string("[record of %d events](link)", "n"), F.date_format("date", "MM/dd/yy"),
                       F.lit("[log](link)"), F.format_string("@u%d, [@u%d](link)", "a", "b"))
    head = spark.createDataFrame([("# | Record time | Description | Date | Log | Contributors",)], "value string")
    return logs.parse_record_table(head.unionByName(day.select(line.alias("value"))), "daily")


RECORD_TARGET = 3.2525  # just above the variants' mean losses, so the test decides

RECORDS = """
rec AS (SELECT dayofyear(ts)::INTEGER AS num, round(10 + count(*) / 10, 1) AS minutes, ts::DATE AS date, count(*) AS n,
               min(user_id) AS a, max(user_id) AS b FROM events GROUP BY dayofyear(ts), ts::DATE)"""


@register("s17_record_table", f"""
WITH {RECORDS}
SELECT 'daily' AS track, num, minutes, printf('record of %d events', n) AS description, date,
       ['@u' || a, '@u' || b] AS contributors FROM rec
""")
def s17_record_table(spark, sf_dir):
    return record_rows(spark, sf_dir)


@register("r17_record_progression", f"""
WITH {RECORDS}
SELECT 'daily' AS track, num, minutes, lag(minutes) OVER (ORDER BY num) - minutes AS gain,
       min(minutes) OVER (ORDER BY num) AS best_so_far, first(minutes) OVER (ORDER BY num) / minutes AS speedup FROM rec
""")
def r17_record_progression(spark, sf_dir):
    return rn.record_progression(record_rows(spark, sf_dir))


@register("r19_contributors", f"""
WITH {RECORDS}
SELECT contributor, count(*)::BIGINT AS n_records FROM (SELECT unnest(['@u' || a, '@u' || b]) AS contributor FROM rec)
GROUP BY contributor
""")
def r19_contributors(spark, sf_dir):
    return rn.contributor_counts(record_rows(spark, sf_dir))


@register("r16_r18_record_rule", f"""
WITH {FINAL}, {RECORDS},
tt AS (SELECT variant, count(*) AS n, avg(loss) AS mean, avg(time_s) AS time_s, (count(*) - 1)::DOUBLE AS df,
              (avg(loss) - {RECORD_TARGET}) / (stddev_samp(loss) / sqrt(count(*))) AS t FROM fl GROUP BY variant),
tested AS ({P_LESS}),
x AS (SELECT *, (SELECT min(minutes) FROM rec) AS prior_minutes,
             (SELECT min(minutes) FROM rec) - ((SELECT time_s FROM tt WHERE variant = '{BASELINE_VARIANT}') / 60 - time_s / 60) AS minutes
      FROM tested)
SELECT variant, n::BIGINT AS n, mean, round(greatest(p, 0.0), 5) AS p, minutes, prior_minutes,
       mean <= {RECORD_TARGET} AND p < 0.01 AND minutes < prior_minutes AS is_record FROM x
""")
def r16_r18_record_rule(spark, sf_dir):
    out = rn.record_check(final_losses(spark, sf_dir), record_rows(spark, sf_dir), BASELINE_VARIANT, RECORD_TARGET)
    return out.withColumn("p", F.round(F.greatest("p", F.lit(0.0)), 5))


@register("s16_log_channels", f"""
WITH {LOSS}, {BENCH}
SELECT 'run' AS channel, count(*)::BIGINT AS n_lines FROM events
UNION ALL SELECT 'loss', (SELECT count(*) FROM e) + (SELECT count(*) FROM shard_rows) + 2 * count(DISTINCT run_id) FROM e
UNION ALL SELECT 'bench', count(*) FROM bench
""")
def s16_log_channels(spark, sf_dir):
    path = scratch_path(spark, f"channels-{uuid.uuid4().hex}")
    run = events(spark, sf_dir).select(F.lit("run").alias("channel"), F.format_string("s:%d tel:%.4f", "event_id", "value")
                                       .alias("value"))
    loss = loss_log_lines(spark, sf_dir).select(F.lit("loss").alias("channel"), "value")
    bench = logs.format_bench_rows(bench_log(spark, sf_dir)).select(F.lit("bench").alias("channel"), "value")
    logs.write_channels(run.unionByName(loss), path)
    logs.write_channels(bench, path)  # a later writer appends
    counts = [logs.read_channel(spark, path, c).agg(F.count(F.lit(1)).alias("n_lines")).select(
        F.lit(c).alias("channel"), "n_lines") for c in logs.CHANNELS]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("s18_task_reader", f"""
WITH {TASKS}
SELECT task_id, ctx, endings, label FROM tasks
""")
def s18_task_reader(spark, sf_dir):
    path = scratch_path(spark, f"tasks-{uuid.uuid4().hex}")
    tasks(spark, sf_dir).write.json(path)
    return logs.read_tasks(spark, path).select("task_id", "ctx", "endings", "label")
