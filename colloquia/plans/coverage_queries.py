"""Queries of the coverage calculus and the inbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquia.operators import activity as act
from colloquia.operators import inbox as ib
from colloquia.operators import intervals as iv
from colloquia.plans import views as v
from colloquia.plans.registry import query
from colloquia.plans.views import END, SLOT, START, duck

NOW = END + 3 * 3600
WATCH_START = (NOW + 28800) // 86400 * 86400 - 28800 - 6 * 86400

_EDGES = """SELECT group_id, start_unix, prev, last_end FROM (
  SELECT *, max(end_unix) OVER (PARTITION BY group_id ORDER BY start_unix, end_unix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  max(end_unix) OVER (PARTITION BY group_id) AS last_end FROM scan_ranges) WHERE prev IS NULL OR start_unix > prev"""


def gaps_sql(start, end, groups="groups"):
    return f"""SELECT * FROM (
      SELECT group_id, greatest(coalesce(prev,{start}),{start}) AS start_unix, least(start_unix,{end}) AS end_unix FROM ({_EDGES}) WHERE group_id IN (SELECT group_id FROM {groups})
      UNION ALL SELECT g.group_id, greatest(coalesce(m.e,{start}),{start}), {end} FROM (SELECT DISTINCT group_id FROM {groups}) g
        LEFT JOIN (SELECT group_id, max(end_unix) AS e FROM scan_ranges GROUP BY 1) m ON m.group_id=g.group_id) WHERE start_unix < end_unix"""


def grid_sql(start, end, slot, groups="groups"):
    n = -(-(end - start) // slot)
    return f"""SELECT g.group_id, CAST(i AS BIGINT) AS slot_index, CAST({start}+i*{slot} AS BIGINT) AS start_unix, CAST(least({end},{start}+(i+1)*{slot}) AS BIGINT) AS end_unix
      FROM (SELECT DISTINCT group_id FROM {groups}) g, range({n}) r(i)"""


SLOT_SQL = f"""SELECT group_id, (sent_at-{START})//{SLOT} AS slot_index, count(*) AS message_count, count(*)-CAST(sum(is_media) AS BIGINT) AS text_count,
  CAST(sum(is_media) AS BIGINT) AS media_count, count(DISTINCT speaker) AS speaker_count, min(sent_at) AS first_unix, max(sent_at) AS last_unix
  FROM heads WHERE sent_at >= {START} AND sent_at < {END} GROUP BY 1,2"""
TOP_SQL = f"""SELECT group_id, slot_index, speaker, message_count, speaker_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, slot_index ORDER BY message_count DESC, speaker) AS speaker_rank FROM (
   SELECT group_id, (sent_at-{START})//{SLOT} AS slot_index, speaker, count(*) AS message_count FROM heads WHERE sent_at >= {START} AND sent_at < {END} GROUP BY 1,2,3)) WHERE speaker_rank <= 3"""
BUSY_SQL = f"""SELECT group_id, slot_index, {START}+hour_index*3600 AS busiest_hour_unix, n AS busiest_hour_count FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, slot_index ORDER BY n DESC, hour_index) AS r FROM (
   SELECT group_id, (sent_at-{START})//{SLOT} AS slot_index, (sent_at-{START})//3600 AS hour_index, count(*) AS n FROM heads WHERE sent_at >= {START} AND sent_at < {END} GROUP BY 1,2,3)) WHERE r = 1"""
COVER_SQL = f"""SELECT g.group_id, g.slot_index, CAST(sum(least(m.end_unix,g.end_unix)-greatest(m.start_unix,g.start_unix)) AS BIGINT) AS covered_seconds, count(*) AS segment_count,
  min(greatest(m.start_unix,g.start_unix)) AS coverage_start, max(least(m.end_unix,g.end_unix)) AS coverage_end
  FROM grid g JOIN merged m ON m.group_id=g.group_id AND m.start_unix < g.end_unix AND m.end_unix > g.start_unix GROUP BY 1,2"""
TIMELINE_SQL = """SELECT g.group_id, coalesce(n.name,'') AS name, g.slot_index, g.start_unix, g.end_unix, coalesce(c.covered_seconds,0) AS covered_seconds,
  coalesce(c.covered_seconds,0)/CAST(g.end_unix-g.start_unix AS DOUBLE) AS coverage_ratio, coalesce(c.segment_count,0) AS segment_count, c.coverage_start, c.coverage_end,
  coalesce(a.message_count,0) AS message_count, coalesce(a.text_count,0) AS text_count, coalesce(a.media_count,0) AS media_count, coalesce(a.speaker_count,0) AS speaker_count,
  a.first_unix, a.last_unix, b.busiest_hour_unix, coalesce(b.busiest_hour_count,0) AS busiest_hour_count, coalesce(t.top_speakers,'') AS top_speakers
  FROM grid g LEFT JOIN group_names n ON n.group_id=g.group_id LEFT JOIN cover c ON c.group_id=g.group_id AND c.slot_index=g.slot_index
  LEFT JOIN slots a ON a.group_id=g.group_id AND a.slot_index=g.slot_index LEFT JOIN busy b ON b.group_id=g.group_id AND b.slot_index=g.slot_index
  LEFT JOIN (SELECT group_id, slot_index, string_agg(speaker || ':' || message_count, ',' ORDER BY speaker_rank) AS top_speakers FROM tops GROUP BY 1,2) t
    ON t.group_id=g.group_id AND t.slot_index=g.slot_index"""
TIMELINE = dict(grid=grid_sql(START, END, SLOT), cover=COVER_SQL, slots=SLOT_SQL, busy=BUSY_SQL, tops=TOP_SQL, timeline=TIMELINE_SQL)
TIMELINE_VIEWS = "heads merged groups group_names"


def tl(body):
    return duck(TIMELINE_VIEWS, body, **TIMELINE)


def timeline(spark, d):
    return act.coverage_timeline(v.heads(spark, d), v.scan_ranges(spark, d), v.groups(spark, d), v.group_names(spark, d), START, END, SLOT)


query("merge_intervals", duck("merged", "SELECT * FROM merged"))(lambda s, d: iv.merge_intervals(v.scan_ranges(s, d)))
query("gaps", duck("scan_ranges groups", gaps_sql(START, END)))(lambda s, d: iv.gaps(v.scan_ranges(s, d), v.groups(s, d), START, END))
query("slot_grid", duck("groups", grid_sql(START, END, SLOT)))(lambda s, d: iv.slot_grid(v.groups(s, d), START, END, SLOT))
query("slot_activity", duck("heads", SLOT_SQL))(lambda s, d: act.slot_activity(v.heads(s, d), START, END, SLOT))
query("top_speakers", duck("heads", TOP_SQL))(lambda s, d: act.top_speakers(v.heads(s, d), START, END, SLOT))
query("busiest_hour", duck("heads", BUSY_SQL))(lambda s, d: act.busiest_hour(v.heads(s, d), START, END, SLOT))
query("slot_coverage", duck("merged groups", "SELECT * FROM cover", grid=grid_sql(START, END, SLOT), cover=COVER_SQL))(
    lambda s, d: iv.slot_coverage(v.scan_ranges(s, d), START, END, SLOT))
query("coverage_timeline", tl("SELECT * REPLACE (round(coverage_ratio,6) AS coverage_ratio) FROM timeline"))(
    lambda s, d: timeline(s, d).withColumn("coverage_ratio", F.round("coverage_ratio", 6)))

_SLOT_GAPS = f"""SELECT x.group_id, g.slot_index, greatest(x.start_unix,g.start_unix) AS start_unix, least(x.end_unix,g.end_unix) AS end_unix
  FROM gap x JOIN grid g ON g.group_id=x.group_id AND x.start_unix < g.end_unix AND x.end_unix > g.start_unix"""
query("slot_gaps", duck("scan_ranges groups", "SELECT * FROM sg", gap=gaps_sql(START, END), grid=grid_sql(START, END, SLOT), sg=_SLOT_GAPS))(
    lambda s, d: iv.slot_gaps(v.scan_ranges(s, d), v.groups(s, d), START, END, SLOT))

_DIGESTS = """CAST(CAST(sum(CAST('0x' || substr(sha256({0}),1,15) AS BIGINT)) AS HUGEINT) AS VARCHAR) || ':' ||
  CAST(CAST(sum(CAST('0x' || substr(sha256({0}),16,15) AS BIGINT)) AS HUGEINT) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)"""
_BATCH = f"""SELECT g.start_unix, g.end_unix, k.batch_key, g.group_id FROM (SELECT DISTINCT * FROM gap) g JOIN (
  SELECT start_unix, end_unix, {_DIGESTS.format("group_id")} AS batch_key FROM (SELECT DISTINCT * FROM gap) GROUP BY 1,2) k ON k.start_unix=g.start_unix AND k.end_unix=g.end_unix"""

query("rescan_batches", duck("scan_ranges groups", _BATCH, gap=gaps_sql(START, END)))(
    lambda s, d: iv.rescan_batches(iv.gaps(v.scan_ranges(s, d), v.groups(s, d), START, END)))

# slot gaps that touch fold back into the whole gaps, so the batches equal those of the gaps
query("merge_batches", duck("scan_ranges groups", _BATCH, gap=gaps_sql(START, END)))(
    lambda s, d: act.repair_batches(v.scan_ranges(s, d), v.groups(s, d), START, END, SLOT))

CHUNK = 6 * 3600
_TASKS = f"""SELECT substr(sha256(group_id || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR)),1,20) AS task_id, group_id, a AS start_unix, b AS end_unix FROM (
  SELECT group_id, start_unix + i*{CHUNK} AS a, least(start_unix+(i+1)*{CHUNK}, end_unix) AS b FROM (
   SELECT *, unnest(range(CAST(ceil((end_unix-start_unix)/{CHUNK}.0) AS BIGINT))) AS i FROM gap))"""


def _batches(s, d):
    return iv.rescan_batches(iv.gaps(v.scan_ranges(s, d), v.groups(s, d), START, END))


def _tasks(s, d):
    return iv.backfill_plan(_batches(s, d), CHUNK)


query("backfill_plan", duck("scan_ranges groups", _TASKS, gap=gaps_sql(START, END)))(_tasks)


@query("plan_totals", duck("scan_ranges groups", f"""SELECT substr(sha256({_DIGESTS.format("task_id")}),1,24) AS plan_id, count(*) AS task_count, count(DISTINCT group_id) AS group_count,
  CAST(sum(end_unix-start_unix) AS BIGINT) AS total_group_seconds, (SELECT count(*) FROM (SELECT DISTINCT start_unix, end_unix FROM gap)) AS source_batch_count FROM tasks""",
                           gap=gaps_sql(START, END), tasks=_TASKS))
def _plan_totals(s, d):
    return iv.plan_totals(_tasks(s, d), _batches(s, d))


@query("check_header", duck("scan_ranges groups", "SELECT unnest(['plan_id', 'task_count']) AS violation FROM (SELECT count(*) AS n FROM tasks) WHERE n > 0", gap=gaps_sql(START, END), tasks=_TASKS))
def _check_header(s, d):
    """A header that claims one task more than the stored plan has."""
    tasks = _tasks(s, d)
    claimed = iv.plan_totals(tasks, _batches(s, d)).withColumn("task_count", F.col("task_count") + 1).withColumn("plan_id", F.lit("0" * 24))
    return iv.check_header(claimed, tasks)


@query("check_plan", duck("scan_ranges groups", """SELECT CASE WHEN start_unix % 3 = 0 THEN 'x' || task_id ELSE task_id END AS task_id,
  'id-mismatch' AS violation FROM tasks WHERE start_unix % 3 = 0""", gap=gaps_sql(START, END), tasks=_TASKS))
def _check_plan(s, d):
    damaged = _tasks(s, d).withColumn("task_id", F.when(F.col("start_unix") % 3 == 0, F.concat(F.lit("x"), "task_id")).otherwise(F.col("task_id")))
    return iv.check_plan(damaged, CHUNK)


def _state(s, d):
    status = F.when(F.col("start_unix") % 3 == 0, "done").when(F.col("start_unix") % 3 == 1, "failed")
    return _tasks(s, d).select("task_id", status.alias("status"), F.when(status == "failed", "timeout").otherwise("").alias("message")).filter("status is not null")


query("pending_tasks", duck("scan_ranges groups", "SELECT * FROM tasks WHERE start_unix % 3 <> 0", gap=gaps_sql(START, END), tasks=_TASKS))(
    lambda s, d: iv.pending_tasks(_tasks(s, d), _state(s, d)))


@query("backfill_progress", duck("scan_ranges groups", """SELECT count(*) AS total_tasks, count(*) FILTER (start_unix%3=0) AS completed_tasks,
  count(*) FILTER (start_unix%3=1) AS failed_tasks, CAST(coalesce(sum(end_unix-start_unix) FILTER (start_unix%3=0),0) AS BIGINT) AS completed_seconds FROM tasks""",
                                 gap=gaps_sql(START, END), tasks=_TASKS))
def _progress(s, d):
    return iv.progress(_tasks(s, d), _state(s, d))


@query("backfill_state", duck("scan_ranges groups", """SELECT task_id, CASE WHEN start_unix%3=0 OR end_unix%2=0 THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN start_unix%3=0 OR end_unix%2=0 THEN '' ELSE 'second try' END AS message FROM tasks""", gap=gaps_sql(START, END), tasks=_TASKS))
def _advance(s, d):
    tries = _tasks(s, d).select("task_id", F.lit(1).alias("attempt"), F.when(F.col("end_unix") % 2 == 0, "done").otherwise("failed").alias("status"), F.lit("second try").alias("message"))
    return iv.advance_state(_state(s, d), tries)


query("coverage_health", duck("scan_ranges groups", f"""SELECT count(*) AS group_count, CAST(count(*)*{END-START} AS BIGINT) AS total_seconds,
  CAST(count(*)*{END-START}-coalesce(sum(x.m),0) AS BIGINT) AS covered_seconds, CAST(coalesce(sum(x.m),0) AS BIGINT) AS missing_seconds,
  round((count(*)*{END-START}-coalesce(sum(x.m),0))/CAST(count(*)*{END-START} AS DOUBLE),6) AS coverage_ratio, count(x.s) AS affected_group_count, min(x.s) AS earliest_gap_unix
  FROM groups g LEFT JOIN (SELECT group_id, sum(end_unix-start_unix) AS m, min(start_unix) AS s FROM gap GROUP BY 1) x ON x.group_id=g.group_id""", gap=gaps_sql(START, END)))(
    lambda s, d: act.coverage_health(v.scan_ranges(s, d), v.groups(s, d), START, END))

R0, R1 = START + 5 * 86400, START + 12 * 86400
_RANGE = f"""SELECT g.group_id, coalesce(a.n,0) AS message_count, coalesce(a.m,0) AS media_count, coalesce(c.s,0) AS covered_seconds, round(coalesce(c.s,0)/{float(R1-R0)},6) AS coverage_ratio
  FROM groups g LEFT JOIN (SELECT group_id, count(*) AS n, CAST(sum(is_media) AS BIGINT) AS m FROM heads WHERE sent_at>={R0} AND sent_at<{R1} GROUP BY 1) a ON a.group_id=g.group_id
  LEFT JOIN (SELECT group_id, CAST(sum(greatest(0,least(end_unix,{R1})-greatest(start_unix,{R0}))) AS BIGINT) AS s FROM merged GROUP BY 1) c ON c.group_id=g.group_id"""


def _range(s, d):
    return act.range_activity(v.heads(s, d), v.scan_ranges(s, d), v.groups(s, d), R0, R1)


query("range_activity", duck("heads merged groups", _RANGE))(_range)
query("pooled_range", duck("heads merged groups", f"""SELECT round(sum(covered_seconds)/(count(*)*{float(R1-R0)}),6) AS coverage_ratio,
  CAST(sum(message_count) AS BIGINT) AS message_count, CAST(sum(media_count) AS BIGINT) AS media_count FROM r""", r=_RANGE))(lambda s, d: act.pooled_range(_range(s, d), R0, R1))


def gallery_spans(s, d):
    """Event windows: one per order, of 20 minutes to 2 hours."""
    key = F.col("o_orderkey")
    start = F.lit(START) + (key * 104729) % 2592000
    return v.table(s, d, "orders").select(key.cast("string").alias("id"), (F.lit(1001) + F.col("o_custkey") % 25).cast("string").alias("group_id"),
                                          start.alias("from_unix"), (start + 1200 + (key * 31) % 6000).alias("to_unix"))


SPANS = f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(1001+o_custkey%25 AS VARCHAR) AS group_id, {START}+(o_orderkey*104729)%2592000 AS from_unix,
  {START}+(o_orderkey*104729)%2592000+1200+(o_orderkey*31)%6000 AS to_unix FROM orders"""
_OVER = """SELECT s.id, s.group_id, s.from_unix, s.to_unix, CAST(coalesce(sum(CASE WHEN m.group_id IS NOT NULL THEN least(m.end_unix,s.to_unix)-greatest(m.start_unix,s.from_unix) END),0) AS BIGINT) AS covered_seconds
  FROM spans s LEFT JOIN merged m ON m.group_id=s.group_id AND m.start_unix<s.to_unix AND m.end_unix>s.from_unix GROUP BY ALL"""
query("overlap_seconds", duck("merged", _OVER, spans=SPANS))(lambda s, d: iv.overlap_seconds(v.scan_ranges(s, d), gallery_spans(s, d)))
query("event_activity", duck("heads merged", """SELECT o.id, coalesce(a.n,0) AS message_count, coalesce(a.m,0) AS media_count, coalesce(a.p,0) AS speaker_count, a.f AS first_unix, a.l AS last_unix,
  round(o.covered_seconds/CAST(o.to_unix-o.from_unix AS DOUBLE),6) AS coverage_ratio, o.to_unix-o.from_unix-o.covered_seconds AS missing_seconds FROM over o LEFT JOIN (
  SELECT s.id, count(*) AS n, CAST(sum(h.is_media) AS BIGINT) AS m, count(DISTINCT h.speaker) AS p, min(h.sent_at) AS f, max(h.sent_at) AS l
  FROM spans s JOIN heads h ON h.group_id=s.group_id AND h.sent_at>=s.from_unix AND h.sent_at<s.to_unix GROUP BY 1) a ON a.id=o.id""", spans=SPANS, over=_OVER))(
    lambda s, d: act.event_activity(gallery_spans(s, d), v.heads(s, d), v.scan_ranges(s, d)))
query("event_story", duck("heads", """SELECT s.id, h.group_id, h.row_id, h.sent_at, CASE WHEN h.sent_at<s.from_unix THEN 'before' WHEN h.sent_at<s.to_unix THEN 'during' ELSE 'after' END AS phase
  FROM spans s JOIN heads h ON h.group_id=s.group_id AND h.sent_at>=s.from_unix-900 AND h.sent_at<s.to_unix+900""", spans=SPANS))(
    lambda s, d: act.event_story(gallery_spans(s, d), v.heads(s, d)))
query("event_gaps", duck("merged", """SELECT s.id, s.group_id, greatest(g.a, s.from_unix-900) AS start_unix, least(g.b, s.to_unix+900) AS end_unix FROM spans s JOIN (
  SELECT group_id, coalesce(lag(end_unix) OVER w, 0) AS a, start_unix AS b FROM merged WINDOW w AS (PARTITION BY group_id ORDER BY start_unix)
  UNION ALL SELECT group_id, max(end_unix), 99999999999 FROM merged GROUP BY 1
  UNION ALL SELECT DISTINCT group_id, 0, 99999999999 FROM spans WHERE group_id NOT IN (SELECT group_id FROM merged)) g
  ON g.group_id=s.group_id AND g.a < s.to_unix+900 AND g.b > s.from_unix-900""", spans=SPANS))(
    lambda s, d: act.event_gaps(gallery_spans(s, d), v.scan_ranges(s, d)))
query("slots_for_events", duck("groups", """SELECT DISTINCT s.id, g.group_id, g.slot_index FROM spans s JOIN grid g ON g.group_id=s.group_id AND g.start_unix < s.to_unix+1 AND g.end_unix > s.from_unix""",
                               spans=SPANS, grid=grid_sql(START, END, SLOT)))(
    lambda s, d: iv.slots_touching(iv.slot_grid(v.groups(s, d), START, END, SLOT), gallery_spans(s, d).withColumn("to_unix", F.col("to_unix") + 1)))
query("slots_for_range", duck("groups", f"""SELECT 'range' AS id, group_id, slot_index FROM grid WHERE start_unix < {R1} AND end_unix > {R0}""", grid=grid_sql(START, END, SLOT)))(
    lambda s, d: iv.slots_touching(iv.slot_grid(v.groups(s, d), START, END, SLOT), v.groups(s, d).select(
        F.lit("range").alias("id"), "group_id", F.lit(R0).alias("from_unix"), F.lit(R1).alias("to_unix"))))
query("coverage_breaks", duck("heads merged", """SELECT group_id, prev AS before_unix, sent_at AS after_unix FROM (
  SELECT group_id, sent_at, lag(sent_at) OVER (PARTITION BY group_id ORDER BY sent_at) AS prev FROM (SELECT DISTINCT group_id, sent_at FROM heads)) x
  WHERE EXISTS (SELECT 1 FROM merged m WHERE m.group_id=x.group_id AND m.end_unix > x.prev AND m.end_unix < x.sent_at)"""))(
    lambda s, d: iv.coverage_breaks(v.heads(s, d), v.scan_ranges(s, d)))

for _mode, _cond in {"gaps": "coverage_ratio < 0.999", "result": "coverage_ratio > 0 AND message_count > 0", "no-messages": "coverage_ratio > 0 AND message_count = 0", "unscanned": "coverage_ratio <= 0"}.items():
    query(f"timeline_filter_{_mode.replace('-', '_')}", tl(f"SELECT DISTINCT group_id FROM timeline WHERE {_cond}"))(
        lambda s, d, m=_mode: act.timeline_filter(timeline(s, d), m))
for _mode, _sql in {"gaps": "CAST(sum(greatest(0,end_unix-start_unix-covered_seconds)) AS BIGINT)", "messages": "CAST(sum(message_count) AS BIGINT)", "recent": "max(last_unix)", "default": "CAST(0 AS BIGINT)"}.items():
    query(f"timeline_sort_{_mode}", tl(f"SELECT *, row_number() OVER (ORDER BY metric DESC NULLS LAST, group_id) AS rank FROM (SELECT group_id, {_sql} AS metric FROM timeline GROUP BY 1)"))(
        lambda s, d, m=_mode: act.timeline_sort(timeline(s, d), m))

_A, _E = "coverage_ratio > 0 AND message_count > 0", "coverage_ratio > 0 AND message_count = 0"
query("fleet_timeline", tl(f"""SELECT p.*, coalesce(t.top_groups,'') AS top_groups FROM (SELECT slot_index, round(sum(coverage_ratio)/count(*),6) AS coverage_ratio,
  round(sum(CASE WHEN {_A} THEN coverage_ratio ELSE 0 END)/count(*),6) AS result_ratio, round(sum(CASE WHEN {_E} THEN coverage_ratio ELSE 0 END)/count(*),6) AS empty_ratio,
  CAST(sum(covered_seconds) AS BIGINT) AS covered_seconds, CAST(sum(message_count) AS BIGINT) AS message_count, CAST(sum(text_count) AS BIGINT) AS text_count, CAST(sum(media_count) AS BIGINT) AS media_count,
  count(*) FILTER (coverage_ratio>=0.999) AS complete_groups, count(*) FILTER (coverage_ratio>0 AND coverage_ratio<0.999) AS partial_groups, count(*) FILTER (coverage_ratio<=0) AS unscanned_groups,
  count(*) FILTER ({_A}) AS active_groups, count(*) FILTER ({_E}) AS empty_groups, count(*) AS total_groups FROM timeline GROUP BY 1) p LEFT JOIN (
  SELECT slot_index, string_agg(group_id || ':' || message_count, ',' ORDER BY r) AS top_groups FROM (SELECT slot_index, group_id, message_count,
   row_number() OVER (PARTITION BY slot_index ORDER BY message_count DESC, group_id) AS r FROM timeline WHERE {_A}) WHERE r<=3 GROUP BY 1) t ON t.slot_index=p.slot_index"""))(
    lambda s, d: act.fleet_timeline(timeline(s, d)))
query("selection_summary", tl("""SELECT min(a) AS start_unix, max(b) AS end_unix, CAST(sum(total) AS BIGINT) AS total_seconds, CAST(sum(covered) AS BIGINT) AS covered_seconds, round(sum(covered)/CAST(sum(total) AS DOUBLE),6) AS coverage_ratio,
  CAST(sum(total)-sum(covered) AS BIGINT) AS missing_seconds, CAST(sum(m) AS BIGINT) AS message_count, CAST(sum(t) AS BIGINT) AS text_count, CAST(sum(md) AS BIGINT) AS media_count, CAST(sum(sp) AS BIGINT) AS speaker_count,
  min(f) AS first_unix, max(l) AS last_unix, (SELECT busiest_hour_unix FROM timeline WHERE busiest_hour_unix IS NOT NULL ORDER BY busiest_hour_count DESC, busiest_hour_unix LIMIT 1) AS busiest_hour_unix,
  (SELECT max(busiest_hour_count) FROM timeline) AS busiest_hour_count, count(*) AS group_count, count(*) FILTER (act) AS active_groups, count(*) FILTER (sc AND NOT act) AS empty_groups, count(*) FILTER (NOT sc) AS unscanned_groups,
  count(*) FILTER (aff) AS affected_groups FROM (SELECT group_id, min(start_unix) AS a, max(end_unix) AS b, sum(end_unix-start_unix) AS total, sum(covered_seconds) AS covered, sum(message_count) AS m, sum(text_count) AS t,
  sum(media_count) AS md, sum(speaker_count) AS sp, min(first_unix) AS f, max(last_unix) AS l, bool_or(message_count>0) AS act, bool_or(coverage_ratio>0) AS sc, bool_or(covered_seconds<end_unix-start_unix) AS aff FROM timeline GROUP BY 1)"""))(
    lambda s, d: act.selection_summary(timeline(s, d)))
query("selection_speakers", duck("heads", "SELECT speaker, CAST(sum(message_count) AS BIGINT) AS message_count FROM tops GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", tops=TOP_SQL))(
    lambda s, d: act.selection_speakers(act.top_speakers(v.heads(s, d), START, END, SLOT)))
query("exact_speakers", duck("heads", f"SELECT count(DISTINCT speaker) AS speaker_count FROM heads WHERE sent_at>={R0} AND sent_at<{R1}"))(
    lambda s, d: act.exact_speakers(v.heads(s, d), R0, R1))
query("coverage_status", tl("SELECT group_id, slot_index, CASE WHEN coverage_ratio>=0.999 THEN 'complete' WHEN coverage_ratio>0 THEN 'partial' ELSE 'none' END AS status FROM timeline"))(
    lambda s, d: timeline(s, d).select("group_id", "slot_index", act.coverage_status(F.col("coverage_ratio")).alias("status")))
query("window_filter", duck("heads", f"SELECT group_id, row_id, sent_at FROM heads WHERE group_id='1003' AND sent_at>={R0} AND sent_at<{R1}"))(
    lambda s, d: act.window_filter(v.heads(s, d), R0, R1, "1003").select("group_id", "row_id", "sent_at"))

# ---- inbox ----
_STORED = """SELECT m.group_id, coalesce(max(n.name),'') AS name, count(*) AS message_count, min(m.sent_at) AS first_unix, max(m.sent_at) AS last_unix
  FROM heads m LEFT JOIN group_names n ON n.group_id=m.group_id GROUP BY 1"""
_UNREAD = """SELECT m.group_id, CAST(sum(CASE WHEN m.sent_at>coalesce(r.sent_at,0) OR (m.sent_at=coalesce(r.sent_at,0) AND m.row_id>coalesce(r.row_id,'')) THEN 1 ELSE 0 END) AS BIGINT) AS unread_count
  FROM heads m LEFT JOIN read_marks r ON r.group_id=m.group_id GROUP BY 1"""
_LAST = """SELECT group_id, row_id AS last_row_id, sent_at AS last_unix, speaker AS last_speaker, is_media AS last_is_media, media_kinds AS last_media_kinds FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sent_at DESC, row_id DESC) AS r FROM heads) WHERE r=1"""
query("stored_groups", duck("heads group_names", _STORED))(lambda s, d: ib.stored_groups(v.heads(s, d), v.group_names(s, d)))
query("unread", duck("heads read_marks", _UNREAD))(lambda s, d: ib.unread(v.heads(s, d), v.read_marks(s, d)))
query("coverage_ends", duck("scan_ranges", "SELECT group_id, max(end_unix) AS coverage_end FROM scan_ranges GROUP BY 1"))(lambda s, d: ib.coverage_ends(v.scan_ranges(s, d)))
query("latest_message", duck("heads", _LAST))(lambda s, d: ib.latest_message(v.heads(s, d)))
query("inbox", duck("heads group_names read_marks scan_ranges", f"""SELECT a.*, b.unread_count, c.coverage_end, l.last_row_id, l.last_speaker, l.last_is_media, l.last_media_kinds FROM ({_STORED}) a JOIN ({_UNREAD}) b ON a.group_id=b.group_id
  LEFT JOIN (SELECT group_id, max(end_unix) AS coverage_end FROM scan_ranges GROUP BY 1) c ON c.group_id=a.group_id JOIN ({_LAST}) l ON l.group_id=a.group_id"""))(
    lambda s, d: ib.inbox(v.heads(s, d), v.group_names(s, d), v.read_marks(s, d), v.scan_ranges(s, d)))
query("resume_point", duck("scan_ranges watchlist", f"""SELECT CAST(coalesce(greatest(min(e),{NOW-30*86400})-600, {NOW-26*3600}) AS BIGINT) AS start_unix, CAST({NOW} AS BIGINT) AS end_unix, count(*)-count(e) AS unscanned_groups
  FROM (SELECT w.group_id, max(s.end_unix) AS e FROM watchlist w LEFT JOIN scan_ranges s ON s.group_id=w.group_id GROUP BY 1)"""))(
    lambda s, d: ib.resume_point(v.scan_ranges(s, d), v.watchlist(s, d), NOW))
query("automation_coverage", duck("scan_ranges watchlist", """SELECT count(*) AS target_groups, count(*)-count(e) AS unscanned_groups, CASE WHEN count(*)=count(e) THEN min(e) END AS coverage_through
  FROM (SELECT w.group_id, max(s.end_unix) AS e FROM watchlist w LEFT JOIN scan_ranges s ON s.group_id=w.group_id GROUP BY 1)"""))(
    lambda s, d: ib.automation_coverage(v.watchlist(s, d), v.scan_ranges(s, d)))
_HEALTH = f"""SELECT w.group_id, w.name, round(({NOW-WATCH_START}-coalesce(g.m,0))/{float(NOW-WATCH_START)},6) AS coverage_ratio, CAST(coalesce(g.m,0) AS BIGINT) AS missing_seconds, g.s AS earliest_gap_unix,
  c.e AS latest_scan_unix, h.l AS latest_message_unix, coalesce(u.unread_count,0) AS unread_count FROM watchlist w LEFT JOIN (SELECT group_id, sum(end_unix-start_unix) AS m, min(start_unix) AS s FROM gap GROUP BY 1) g ON g.group_id=w.group_id
  LEFT JOIN (SELECT group_id, max(end_unix) AS e FROM scan_ranges GROUP BY 1) c ON c.group_id=w.group_id LEFT JOIN (SELECT group_id, max(sent_at) AS l FROM heads GROUP BY 1) h ON h.group_id=w.group_id LEFT JOIN ({_UNREAD}) u ON u.group_id=w.group_id"""


def _health(s, d):
    return ib.watch_health(v.watchlist(s, d), v.heads(s, d), v.scan_ranges(s, d), v.read_marks(s, d), NOW)


query("watch_health", duck("heads scan_ranges watchlist read_marks", _HEALTH, gap=gaps_sql(WATCH_START, NOW, "watchlist")))(_health)
query("unread_total", duck("heads watchlist read_marks", f"SELECT CAST(sum(u.unread_count) AS BIGINT) AS unread_total FROM watchlist w JOIN ({_UNREAD}) u ON u.group_id=w.group_id"))(
    lambda s, d: _health(s, d).agg(F.sum("unread_count").alias("unread_total")))
_ACTIVITY = """SELECT c.group_id, c.e AS latest_scan_unix, h.l AS latest_message_unix FROM (SELECT group_id, max(end_unix) AS e FROM scan_ranges GROUP BY 1) c
  LEFT JOIN (SELECT group_id, max(sent_at) AS l FROM heads GROUP BY 1) h ON h.group_id=c.group_id"""
query("group_activity", duck("heads scan_ranges", _ACTIVITY))(lambda s, d: ib.group_activity(v.heads(s, d), v.scan_ranges(s, d)))
query("unread_window", duck("groups read_marks", f"SELECT g.group_id, CAST(coalesce(r.sent_at-1800,{NOW-48*3600}) AS BIGINT) AS from_unix FROM groups g LEFT JOIN read_marks r ON r.group_id=g.group_id"))(
    lambda s, d: ib.unread_window(v.groups(s, d), v.read_marks(s, d), NOW))
query("search_messages", duck("messages", "SELECT group_id, row_id FROM messages WHERE contains(lower(text),'thnt') OR contains(lower(speaker),'thnt')"))(
    lambda s, d: ib.search_messages(v.messages(s, d), " Th_nt% ").select("group_id", "row_id"))
_PAGE_AT = START + 10 * 86400
query("page_forward", duck("heads", f"""SELECT row_id, sent_at, speaker, (SELECT count(*)>40 FROM (SELECT 1 FROM heads WHERE group_id='1004' AND (sent_at>{_PAGE_AT} OR (sent_at={_PAGE_AT} AND row_id>'m1')) LIMIT 41)) AS has_more
  FROM heads WHERE group_id='1004' AND (sent_at>{_PAGE_AT} OR (sent_at={_PAGE_AT} AND row_id>'m1')) ORDER BY sent_at, row_id LIMIT 40"""))(
    lambda s, d: ib.page(v.heads(s, d).filter("group_id='1004'").select("row_id", "sent_at", "speaker"), 40, after=(_PAGE_AT, "m1")))
query("page_backward", duck("heads", f"""SELECT row_id, sent_at, speaker, (SELECT count(*)>300 FROM (SELECT 1 FROM heads WHERE group_id='1004' AND (sent_at<{_PAGE_AT} OR (sent_at={_PAGE_AT} AND row_id<'m1')) LIMIT 301)) AS has_more
  FROM heads WHERE group_id='1004' AND (sent_at<{_PAGE_AT} OR (sent_at={_PAGE_AT} AND row_id<'m1')) ORDER BY sent_at DESC, row_id DESC LIMIT 300"""))(
    lambda s, d: ib.page(v.heads(s, d).filter("group_id='1004'").select("row_id", "sent_at", "speaker"), 0, before=(_PAGE_AT, "m1")))
query("selection", duck("messages", f"""SELECT row_id, sent_at FROM (SELECT * FROM messages WHERE group_id='1005' AND sent_at>={R0} AND sent_at<{R1+1} ORDER BY sent_at,row_id LIMIT 500) WHERE is_media=0 AND trim(text)<>''"""))(
    lambda s, d: ib.selection(v.messages(s, d), "1005", R0, R1).select("row_id", "sent_at"))
query("chat_segments", duck("heads read_marks", """SELECT group_id, row_id, sent_at, new_day, unread_divider, new_bubble, CAST(sum(CASE WHEN new_bubble THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY sent_at,row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bubble FROM (
  SELECT *, new_day OR unread_divider OR ps<>speaker OR sent_at-pa>=300 AS new_bubble FROM (SELECT *, pa IS NULL OR (sent_at+28800)//86400<>(pa+28800)//86400 AS new_day, coalesce(sent_at>mark_at AND (pa IS NULL OR pa<=mark_at),false) AS unread_divider FROM (
  SELECT h.group_id,h.row_id,h.sent_at,h.speaker, r.sent_at AS mark_at, lag(h.sent_at) OVER (PARTITION BY h.group_id ORDER BY h.sent_at,h.row_id) AS pa, lag(h.speaker) OVER (PARTITION BY h.group_id ORDER BY h.sent_at,h.row_id) AS ps
  FROM heads h LEFT JOIN read_marks r ON r.group_id=h.group_id)))"""))(
    lambda s, d: ib.chat_segments(v.heads(s, d), v.read_marks(s, d)))
query("group_sections", duck("heads scan_ranges watchlist groups", f"""SELECT group_id, section_rank, CASE section_rank WHEN 0 THEN 'gaps' WHEN 1 THEN 'watched' WHEN 2 THEN 'recent' ELSE 'all' END AS section FROM (SELECT group_id, min(k) AS section_rank FROM (
  SELECT DISTINCT group_id, CAST(0 AS BIGINT) AS k FROM gap UNION ALL SELECT group_id, 1 FROM watchlist UNION ALL SELECT * FROM (SELECT group_id, 2 FROM ({_ACTIVITY}) ORDER BY latest_scan_unix DESC, group_id LIMIT 20) UNION ALL SELECT group_id, 3 FROM groups)
  WHERE group_id IN (SELECT group_id FROM groups) GROUP BY 1)""", gap=gaps_sql(WATCH_START, NOW, "watchlist")))(
    lambda s, d: ib.group_sections(v.groups(s, d), _health(s, d), v.watchlist(s, d), ib.group_activity(v.heads(s, d), v.scan_ranges(s, d))))
query("search_groups", duck("group_names", "SELECT group_id, name FROM group_names WHERE contains(group_id,'on_1') OR contains(lower(name),'on_1') ORDER BY group_id LIMIT 80"))(
    lambda s, d: ib.search_groups(v.group_names(s, d), "ON_1"))


# ---- collections and runs ----
def _left(s, d):
    return v.media_index(s, d).filter(F.col("sent_at") < START + 20 * 86400)


def _right(s, d):
    return v.media_index(s, d).filter(F.col("sent_at") >= START + 10 * 86400)


query("compare_collections", duck("media_index", f"""SELECT content_key, CASE WHEN l AND r THEN 'both' WHEN l THEN 'left' ELSE 'right' END AS side FROM (
  SELECT content_key, bool_or(sent_at<{START+20*86400}) AS l, bool_or(sent_at>={START+10*86400}) AS r FROM media_index GROUP BY 1)"""))(
    lambda s, d: iv.compare_collections(_left(s, d), _right(s, d)))


def runs_listing(s, d):
    """One run per customer-day; groups from the customers' orders."""
    key = F.col("o_orderkey")
    return v.table(s, d, "orders").select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"), F.array((F.lit(1001) + F.col("o_custkey") % 25).cast("string"), F.lit("1001")).alias("group_ids"),
        (F.lit(START) + (F.col("o_custkey") % 30) * 86400).alias("start_unix"), F.lit(END).cast("long").alias("end_unix"),
        (key % 3).alias("text_messages"), (key % 2).alias("media_messages"), key.alias("list_order"))


query("duplicate_runs", duck("", f"""SELECT run_id, row_number() OVER (PARTITION BY g, start_unix, t, m ORDER BY k) > 1 AS is_duplicate FROM (SELECT 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id,
  CAST(1001+o_custkey%25 AS VARCHAR) AS g, {START}+(o_custkey%30)*86400 AS start_unix, o_orderkey%3 AS t, o_orderkey%2 AS m, o_orderkey AS k FROM orders)"""))(
    lambda s, d: iv.duplicate_runs(runs_listing(s, d)).select("run_id", "is_duplicate"))
