"""Queries that run as streams over the events files, to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.relations import HI, cte, load, relation
from tidemark.plans.shared import folder
from tidemark.plans.signals import _peaks_sql, the_track
from tidemark.streaming import collapse, peaks, streams


MOST = 4_000_000  # rows that a stream takes at once


def _events(spark, sf_dir):
    rows = streams.follow(spark, sf_dir, "events.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream, mode="append"):
    at = folder(stream.sparkSession, "streams")
    return streams.run_once(stream, f"{at}/out", f"{at}/state", mode)


CLOSED = "(SELECT max(ts) FROM events)"


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL HAVING start + INTERVAL 6 HOURS <= {CLOSED} - INTERVAL 1 HOUR""")
def op_stream_tumbling(spark, sf_dir):
    out = streams.binned(_events(spark, sf_dir), "ts", ["event_type"], "6 hours", None, "1 hour", F.count("*").alias("n"), F.sum("value").alias("total"))
    return _run(out).withColumn("total", F.round("total", 4))


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOURS * k AS start, event_type FROM events, (SELECT unnest(range(3)) AS k))
SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL HAVING start + INTERVAL 6 HOURS <= {CLOSED} - INTERVAL 1 HOUR""")
def op_stream_sliding(spark, sf_dir):
    return _run(streams.binned(_events(spark, sf_dir), "ts", ["event_type"], "6 hours", "2 hours", "1 hour", F.count("*").alias("n")))


@query(f"""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS opens FROM events),
k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM k GROUP BY user_id, k.k HAVING max(ts) + INTERVAL 3 HOURS <= {CLOSED} - INTERVAL 1 HOUR""")
def op_stream_merged(spark, sf_dir):
    return _run(streams.merged(_events(spark, sf_dir), "ts", ["user_id"], "3 hours", "1 hour"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def op_stream_first(spark, sf_dir):
    return _run(streams.first_of(_events(spark, sf_dir), "ts", ["user_id", "event_type"], "100 days")).select("user_id", "event_type")


@query("""WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
f AS (SELECT *, median(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS m FROM e)
SELECT event_type, event_id, value, round(CASE WHEN rn < 11 THEN max(CASE WHEN rn = 11 THEN m END) OVER (PARTITION BY event_type) ELSE m END, 6) AS median FROM f QUALIFY rn <= n - 9""")
def op_stream_running_median(spark, sf_dir, most=MOST):
    """The stream takes at most some ``most`` events at once, in order."""
    rows = load(spark, sf_dir, "events").select("event_type", "event_id", "value")
    parts = rows.count() // most + 1
    cuts = rows.stat.approxQuantile("event_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    batch = sum((F.coalesce((F.col("event_id") > int(c)).cast("int"), F.lit(1)) for c in sorted(set(cuts))), F.lit(0))
    out = streams.run_in_batches(rows, batch, lambda stream: streams.running_median(stream, "event_type", "event_id", "value", 20), folder(spark, "streams"))
    return out.withColumn("median", F.round("median", 6))


@query("""SELECT a.event_id AS event_id_1, b.event_id AS event_id_2, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTES AND a.ts + INTERVAL 30 MINUTES""")
def op_stream_paired(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    first = rows.filter("event_type = 'click'").drop("event_type")
    second = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts").filter("event_type = 'purchase'").drop("event_type")
    return _run(streams.paired(first, second, ["user_id"], "ts", "30 minutes")).select("event_id_1", "event_id_2", "user_id")


def _in_batches(rows, at: str, step: int, last: int, end) -> None:
    """rows as files of ``step`` positions each, in order, and a file of end marks: as many micro-batches."""
    for first in range(0, last + 1, step):
        rows.filter(F.col("pos").between(first, first + step - 1)).coalesce(1).write.mode("append").parquet(at)
    end.coalesce(1).write.mode("append").parquet(at)


@query(_peaks_sql(False))
def op_stream_peaks(spark, sf_dir):
    """The peak caller on a stream of the track in nine micro-batches, to the end of input."""
    at, track = folder(spark, "track"), the_track(spark, sf_dir).select("chrom", "pos", "wps")
    track.write.parquet(f"{at}/whole")
    rows = spark.read.parquet(f"{at}/whole")
    _in_batches(rows, f"{at}/parts", 2600, HI, peaks.end_marks(rows, "chrom", rows.schema))
    stream = streams.follow(spark, f"{at}/parts", "*.parquet", rows.schema, 1)
    return _run(peaks.peaks(stream, "chrom", "pos", "wps"))


MATED = cte("reads") + """,
both_ AS (SELECT rid, grp, paired, reverse, ref_len, unmapped, mate_unmapped, qcfail, cigar, chrom, pos, qname, true AS is_read1 FROM b UNION ALL
  SELECT rid + 1000000000, grp, true, NOT reverse, ref_len, unmapped, mate_unmapped, qcfail, cigar, chrom, pos + isize, qname, false FROM b WHERE paired AND rid % 31 > 0)"""
SINGLE = [
    "rid", "CASE WHEN qid % 5 = 0 THEN 'U' || qid % 3 ELSE 'L' || qid % 2 END AS grp", "(flag & 1) <> 0 AS paired", "(flag & 16) <> 0 AS reverse", "qlen AS ref_len", "(flag & 4) <> 0 AS unmapped", "rid % 17 = 0 AS mate_unmapped",
    "(flag & 512) <> 0 AS qcfail", "CAST(qlen AS VARCHAR(9)) || CASE WHEN rid % 4 = 0 THEN 'M2D' ELSE 'M' END AS cigar", "chrom", "pos - pos % 40 AS pos", "isize - isize % 40 AS isize", "qname",
]


def _mated(spark, sf_dir):
    rows = relation(spark, sf_dir, "reads").selectExpr(*SINGLE)
    second = rows.filter("paired AND rid % 31 > 0").withColumns({"rid": F.col("rid") + 1000000000, "reverse": ~F.col("reverse"), "pos": F.col("pos") + F.col("isize"), "is_read1": F.lit(False)})
    return rows.withColumn("is_read1", F.lit(True)).unionByName(second).drop("isize").withColumn("quality", F.lit(1))


@query(MATED.replace("both_ AS (", f"b AS (SELECT {', '.join(SINGLE)} FROM reads),\nboth_ AS (") + """,
ok AS (SELECT *, pos + CASE WHEN reverse THEN ref_len ELSE 0 END AS outer_ FROM both_ WHERE NOT qcfail),
m AS (SELECT * FROM ok WHERE NOT unmapped AND NOT (paired AND mate_unmapped)),
p AS (SELECT a.grp, a.qname, a.chrom, b.chrom AS chrom2, a.outer_ AS pos, b.outer_ AS pos2, least(a.rid, b.rid) AS rid, a.cigar || '|' || b.cigar AS cigar
  FROM m a JOIN m b ON a.grp = b.grp AND a.qname = b.qname AND a.chrom = b.chrom WHERE a.paired AND b.paired AND a.is_read1 AND NOT b.is_read1 AND abs(a.outer_ - b.outer_) <= 600),
pb AS (SELECT grp, chrom, chrom2, pos, pos2, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT grp, chrom, chrom2, pos, pos2, cigar, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL),
s AS (SELECT *, pos AS spot FROM m WHERE NOT paired),
sb AS (SELECT grp, chrom, reverse, spot, ref_len, arg_max(cigar, (n, -length(cigar), cigar)) AS cigar FROM (SELECT grp, chrom, reverse, spot, ref_len, cigar, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)
SELECT 'pair' AS kind, grp, chrom, chrom2, pos, pos2, arg_min(qname, (rid, qname)) AS qname, count(*) AS xp FROM p JOIN pb USING (grp, chrom, chrom2, pos, pos2, cigar) GROUP BY grp, chrom, chrom2, pos, pos2
UNION ALL SELECT 'single', grp, chrom, NULL, spot, NULL, arg_min(qname, (rid, qname)), count(*) FROM s JOIN sb USING (grp, chrom, reverse, spot, ref_len, cigar) GROUP BY grp, chrom, reverse, spot, ref_len
UNION ALL SELECT 'kept', grp, chrom, NULL, pos, NULL, qname, 1 FROM ok WHERE unmapped OR paired AND mate_unmapped""")
def op_stream_collapse(spark, sf_dir, most=7 * MOST):
    """Duplicates collapsed on a stream of reads in order of position, a contig a micro-batch, or a stretch of one that has
    some ``most`` reads, to the end of input."""
    rows = _mated(spark, sf_dir).filter("chrom BETWEEN 1 AND 7")
    parts = 2 * load(spark, sf_dir, "lineitem").count() // (7 * most) + 1
    batch = F.col("chrom") * parts + F.least(F.greatest(F.floor(F.col("pos") * parts / HI), F.lit(0)), F.lit(parts - 1))
    make = lambda stream: collapse.collapse(stream, F.col("chrom") * 1_000_000, 600, keep=True)
    return streams.run_in_batches(rows, batch, make, folder(spark, "reads"), collapse.end_marks(spark, rows.schema, 1))
