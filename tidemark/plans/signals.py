"""Queries on per-position signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.intervals import per_coverage, ratio_or_zero
from tidemark.operators import joins, overlay, segment, signal, spectral, windows
from tidemark.plans.registry import query
from tidemark.plans.relations import HI, LO, cte, load, relation, track_cte


#: Contigs have 20,200 positions; small tiles let them pass values on.
TILE = 4096


def the_track(spark, sf_dir):
    return signal.full_track(relation(spark, sf_dir, "fragments"), LO, HI, tile=TILE)


TRACK = cte("fragments") + track_cte()


@query(TRACK + "\nSELECT chrom, pos, cov, ends, wps FROM track")
def op_signal_wps_track(spark, sf_dir):
    return the_track(spark, sf_dir)


@query(cte("short_fragments") + track_cte("short_fragments", 8) + "\nSELECT chrom, pos, cov, ends, wps FROM track")
def op_signal_short_track(spark, sf_dir):
    return signal.full_track(relation(spark, sf_dir, "short_fragments"), LO, HI, protection=16, tile=TILE)


@query(cte("fragments") + """,
slice AS (SELECT DISTINCT chrom, pos FROM (SELECT chrom, unnest(range(1, 20201)) AS pos FROM (SELECT DISTINCT chrom FROM fragments)))
SELECT p.chrom, p.pos, CAST(coalesce(sum(CASE WHEN s IS NULL THEN 0 WHEN s > pos - 60 OR e < pos + 60 THEN -1 ELSE 1 END), 0) AS BIGINT) AS wps
FROM slice p LEFT JOIN fragments f ON f.chrom = p.chrom AND f.e > p.pos - 60 AND f.s < p.pos + 60 GROUP BY ALL""")
def op_signal_wps_by_definition(spark, sf_dir):
    frags = relation(spark, sf_dir, "fragments")
    positions = frags.select("chrom").distinct().withColumn("pos", F.explode(F.sequence(F.lit(LO).cast("long"), F.lit(HI).cast("long"))))
    return signal.score_literal(frags, positions)


REGIONS = cte("fragments", "regions") + track_cte()


@query(REGIONS + """,
rows_ AS (SELECT r.cid, r.strand, r.chrom, p.pos, coalesce(t.cov, 0) AS cov, coalesce(t.ends, 0) AS ends, coalesce(t.wps, 0) AS wps
  FROM (SELECT cid, strand, chrom, unnest(range(lo, hi + 1)) AS pos FROM regions) p JOIN regions r ON r.cid = p.cid LEFT JOIN track t ON t.chrom = p.chrom AND t.pos = p.pos),
ranked AS (SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) AS rank, chrom, pos, cov, ends, wps FROM rows_)
SELECT * FROM ranked WHERE cid IN (SELECT cid FROM ranked GROUP BY cid HAVING sum(cov) > 0)""")
def op_signal_region_track(spark, sf_dir):
    return signal.region_track(the_track(spark, sf_dir), relation(spark, sf_dir, "regions"))


SITES = cte("fragments", "sites") + track_cte() + """,
aligned AS (
  SELECT site, name, strand, CASE WHEN strand = '-' THEN c + 100 - t.pos ELSE t.pos - (c - 99) END - 99 AS off, wps
  FROM sites JOIN track t ON t.chrom = sites.chrom AND t.pos BETWEEN c - 99 AND c + 100),
full_ AS (SELECT * FROM aligned WHERE site IN (SELECT site FROM aligned GROUP BY site HAVING count(*) = 200)),
profile AS (SELECT name, CAST(site % 10 AS INT) AS bin, off AS "offset", CAST(sum(wps) AS BIGINT) AS total FROM full_ GROUP BY ALL)"""


def _profile(spark, sf_dir):
    return overlay.profile(relation(spark, sf_dir, "sites"), the_track(spark, sf_dir), "wps", 100)


@query(SITES + '\nSELECT name, bin, "offset", total FROM profile')
def op_overlay_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(SITES + '\nSELECT name, bin, "offset", total, CAST(sum(total) OVER (PARTITION BY name, "offset") - total AS BIGINT) AS rest FROM profile')
def op_overlay_leave_one_out(spark, sf_dir):
    return overlay.leave_one_out(_profile(spark, sf_dir))


NORMALISED = SITES + """,
summed AS (SELECT name, "offset", CAST(sum(total) AS BIGINT) AS total FROM profile GROUP BY ALL),
normed AS (SELECT *, avg(CASE WHEN "offset" <= -60 OR "offset" >= 60 THEN total END) OVER (PARTITION BY name) AS m FROM summed)"""


def _summed(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("name", "offset").agg(F.sum("total").alias("total"))


@query(NORMALISED + '\nSELECT name, "offset", total, round(total / abs(m), 6) AS norm, round(total - m, 6) AS less FROM normed WHERE abs(m) > 1e-9')
def op_overlay_normalise(spark, sf_dir):
    rows = overlay.normalise(_summed(spark, sf_dir), "total", ["name"], 40, 100, subtract=True, out="less")
    kept = rows.filter(F.abs(F.col("total") - F.col("less")) > 1e-9)
    return overlay.normalise(kept, "total", ["name"], 40, 100).select("name", "offset", "total", F.round("norm", 6).alias("norm"), F.round("less", 6).alias("less"))


@query(SITES + """,
sides AS (SELECT name, bin < 5 AS control, "offset", CAST(sum(total) AS BIGINT) AS total FROM profile GROUP BY ALL)
SELECT a.name, a."offset", a.total, a.total - b.total AS difference FROM sides a JOIN sides b ON a.name = b.name AND a."offset" = b."offset" WHERE NOT a.control AND b.control""")
def op_overlay_subtract(spark, sf_dir):
    rows = _profile(spark, sf_dir).groupBy("name", (F.col("bin") < 5).alias("control"), "offset").agg(F.sum("total").alias("total"))
    return overlay.subtract(rows.filter("NOT control").drop("control"), rows.filter("control"), ["name", "offset"], "total")


@query(SITES + """
SELECT "offset", """ + ", ".join(f"sum(total) FILTER (bin = {b})::BIGINT AS sites_{b}" for b in range(10)) + ' FROM profile GROUP BY "offset"')
def op_overlay_wide(spark, sf_dir):
    rows = _profile(spark, sf_dir).groupBy("offset", F.concat(F.lit("sites_"), F.col("bin")).alias("bin")).agg(F.sum("total").alias("total"))
    return overlay.wide(rows, ["offset"], "bin", "total", [f"sites_{b}" for b in range(10)])


MEDIANS = TRACK + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn, count(*) OVER (PARTITION BY chrom) AS n FROM track),
framed AS (SELECT *, median(wps) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING) AS m FROM placed),
medians AS (SELECT chrom, pos, cov, wps, rn, n, CASE WHEN rn < 501 THEN max(CASE WHEN rn = 501 THEN m END) OVER (PARTITION BY chrom) WHEN rn > n - 499 THEN max(CASE WHEN rn = n - 499 THEN m END) OVER (PARTITION BY chrom) ELSE m END AS median FROM framed)"""


def _medians(spark, sf_dir):
    return windows.running_median(the_track(spark, sf_dir), "wps", ["chrom"], bounds=(LO, HI))


@query(MEDIANS + "\nSELECT chrom, pos, wps, CAST(median AS DOUBLE) AS median, CAST(wps - median AS DOUBLE) AS adj FROM medians")
def op_windows_running_median(spark, sf_dir):
    return _medians(spark, sf_dir).select("chrom", "pos", "wps", "median", (F.col("wps") - F.col("median")).alias("adj"))


@query(MEDIANS + "\nSELECT chrom, pos, wps, CAST(median AS DOUBLE) AS median FROM medians")
def op_windows_native_median(spark, sf_dir):
    """The running median without Python."""
    return windows.running_median(the_track(spark, sf_dir), "wps", ["chrom"], native=True, tile=TILE, bounds=(LO, HI)).select("chrom", "pos", "wps", "median")


@query(MEDIANS + "\nSELECT chrom, pos, wps, cov, CAST(median AS DOUBLE) AS median, round(CASE WHEN cov = 0 THEN 0 ELSE (wps - median)::DOUBLE / cov * 100::DOUBLE END, 6) AS norm FROM medians")
def op_windows_per_coverage(spark, sf_dir):
    rows = _medians(spark, sf_dir)
    return rows.select("chrom", "pos", "wps", "cov", "median", F.round(per_coverage(F.col("wps"), F.col("median"), F.col("cov")), 6).alias("norm"))


def _smooth_sql() -> str:
    terms = ["(329 / 3059.0::DOUBLE) * v"]
    for k in range(1, 11):
        w = f"({329 - 5 * k * k} / 3059.0::DOUBLE)"
        back, ahead = f"lag(v, {k}) OVER w", f"lead(v, {k}) OVER w"
        terms.append(f"{w} * (CASE WHEN rn <= 10 THEN v - abs({ahead} - v) ELSE {back} END) + {w} * (CASE WHEN rn > n - 10 THEN v + abs({back} - v) ELSE {ahead} END)")
    return " + ".join(terms)


@query(MEDIANS + f",\nvals AS (SELECT *, wps::DOUBLE AS v FROM medians)\nSELECT chrom, pos, round({_smooth_sql()}, 6) AS smooth, round({_smooth_sql()} - median, 6) AS adj FROM vals WINDOW w AS (PARTITION BY chrom ORDER BY pos)")
def op_windows_smoothed(spark, sf_dir):
    rows = windows.adjusted(the_track(spark, sf_dir), "wps", ["chrom"], smoothed=True, bounds=(LO, HI))
    return rows.select("chrom", "pos", F.round("smooth", 6).alias("smooth"), F.round("adj", 6).alias("adj"))


@query(SITES + """,
summed AS (SELECT name, "offset", CAST(sum(total) AS BIGINT) AS total FROM profile GROUP BY ALL)
SELECT name, "offset", round(total - avg(total) OVER (PARTITION BY name ORDER BY "offset" ROWS BETWEEN 99 PRECEDING AND 100 FOLLOWING), 6) AS detrended FROM summed""")
def op_windows_running_mean(spark, sf_dir):
    rows = windows.running_mean(_summed(spark, sf_dir), "total", ["name"], "offset")
    return rows.select("name", "offset", F.round(F.col("total") - F.col("mean"), 6).alias("detrended"))


ADJUSTED = MEDIANS + ",\nadjusted AS (SELECT chrom, pos, CAST(wps - median AS DOUBLE) AS adj FROM medians)"
RUNS = ADJUSTED + """,
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 5 THEN 0 ELSE 1 END AS opens FROM adjusted WHERE adj > 0),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM marked),
spans AS (SELECT chrom, k, min(pos) AS run, max(pos) AS run_end, count(*) AS n_positive, max(adj) AS top FROM numbered GROUP BY ALL)"""


def _adjusted(spark, sf_dir):
    return _medians(spark, sf_dir).select("chrom", "pos", (F.col("wps") - F.col("median")).alias("adj"))


@query(RUNS + "\nSELECT chrom, run, run_end, n_positive, top FROM spans")
def op_segment_runs(spark, sf_dir):
    return segment.run_spans(_adjusted(spark, sf_dir), "adj", ["chrom"], tile=TILE)


def _peaks_sql(compat: bool) -> str:
    """compat: the element that ends a stretch is lost. Of stretches of adjacent positions in a run, each but the first
    thus lacks its first element, unless the one before it was a single element and lost."""
    lost = """,
islands AS (SELECT chrom, run, g, count(*) AS len, row_number() OVER (PARTITION BY chrom, run ORDER BY min(pos)) AS k FROM raw GROUP BY chrom, run, g),
before AS (SELECT *, max(CASE WHEN len > 1 THEN k END) OVER (PARTITION BY chrom, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS long FROM islands),
losses AS (SELECT chrom, run, g, (k - 1 - coalesce(long, 0)) % 2 = CASE WHEN long IS NULL THEN 1 ELSE 0 END AS lost FROM before),
high AS (SELECT * EXCLUDE (place, lost) FROM (SELECT r.*, lost, row_number() OVER (PARTITION BY r.chrom, r.run, r.g ORDER BY pos) AS place FROM raw r JOIN losses USING (chrom, run, g)) WHERE NOT lost OR place > 1)"""
    return RUNS + """,
cells AS (SELECT s.chrom, s.run, s.run_end - s.run + 1 AS size, p.pos, coalesce(a.adj, 0) AS v
  FROM spans s, LATERAL (SELECT unnest(range(s.run, s.run_end + 1)) AS pos) p LEFT JOIN (SELECT * FROM adjusted WHERE adj > 0) a ON a.chrom = s.chrom AND a.pos = p.pos
  WHERE s.run_end - s.run + 1 BETWEEN 50 AND 450),
ordered AS (SELECT *, row_number() OVER (PARTITION BY chrom, run ORDER BY v) AS r FROM cells),
mids AS (SELECT chrom, run, CASE WHEN any_value(size) % 2 = 0 THEN max(CASE WHEN r = size / 2 + 1 THEN v END)
  ELSE (max(CASE WHEN r = (size - 1) / 2 + 1 THEN v END) + max(CASE WHEN r = (size + 1) / 2 + 1 THEN v END)) / 2 END AS m FROM ordered GROUP BY ALL),
raw AS (SELECT c.*, c.pos - row_number() OVER (PARTITION BY c.chrom, c.run ORDER BY c.pos) AS g FROM cells c JOIN mids USING (chrom, run) WHERE v >= m)""" + (lost if compat else ",\nhigh AS (SELECT * FROM raw)") + """,
stretches AS (SELECT chrom, run, any_value(size) AS size, g, sum(v) AS total, min(pos) AS start, max(pos) AS end_, max(v) AS top FROM high GROUP BY chrom, run, g),
best AS (SELECT *, row_number() OVER (PARTITION BY chrom, run ORDER BY total DESC, start DESC) AS place FROM stretches)
SELECT chrom, start, end_ AS "end", start + CAST(round((end_ - start) * 0.5::DOUBLE) AS BIGINT) AS mid, top AS score FROM best
WHERE top > 5 AND (size <= 150 AND place = 1 OR size > 150 AND end_ - start + 1 BETWEEN 50 AND 150)"""


@query(_peaks_sql(False))
def op_segment_peaks(spark, sf_dir):
    return segment.peaks(_adjusted(spark, sf_dir), "adj", ["chrom"], tile=TILE)


@query(_peaks_sql(True))
def op_segment_peaks_compat(spark, sf_dir):
    return segment.peaks(_adjusted(spark, sf_dir), "adj", ["chrom"], compat=True, tile=TILE)


@query("""WITH orders_ AS (SELECT DISTINCT o_orderkey * 3 // 2 AS pos, o_custkey % 5 AS chrom FROM orders),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) = 1 THEN 0 ELSE 1 END AS opens FROM orders_),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM marked)
SELECT chrom, pos, min(pos) OVER (PARTITION BY chrom, k) AS block FROM numbered""")
def op_segment_blocks(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").selectExpr("o_orderkey * 3 div 2 AS pos", "o_custkey % 5 AS chrom").distinct()
    return segment.blocks(rows, ["chrom"], tile=TILE)


PEAK_POINTS = cte("fragments", "sites") + ",\ntargets AS (SELECT DISTINCT chrom, s AS t FROM fragments WHERE e - s >= 167)"


@query(PEAK_POINTS + """
SELECT site, chrom, c, (SELECT max(t) FROM targets WHERE targets.chrom = sites.chrom AND t <= c) AS before, (SELECT min(t) FROM targets WHERE targets.chrom = sites.chrom AND t > c) AS after,
       c - (SELECT max(t) FROM targets WHERE targets.chrom = sites.chrom AND t <= c) + (SELECT min(t) FROM targets WHERE targets.chrom = sites.chrom AND t > c) - c - 1 AS total FROM sites""")
def op_joins_nearest(spark, sf_dir):
    targets = relation(spark, sf_dir, "fragments").filter("e - s >= 167").selectExpr("chrom", "s AS t")
    rows = joins.nearest(relation(spark, sf_dir, "sites").select("site", "chrom", "c"), targets, "chrom", "c", "t", TILE)
    return rows.withColumn("total", F.col("c") - F.col("before") + F.col("after") - F.col("c") - 1)


@query(PEAK_POINTS + """,
near AS (SELECT site, chrom, c, t AS target, CASE WHEN t <= c THEN -1 ELSE 1 END AS side FROM sites JOIN targets USING (chrom) WHERE abs(t - c) <= 500),
ranked AS (SELECT *, row_number() OVER w AS rank, abs(lead(target) OVER w - target) AS spacing FROM near WINDOW w AS (PARTITION BY site, chrom, c, side ORDER BY abs(target - c)))
SELECT site, chrom, c, target, side, rank, spacing FROM ranked WHERE rank <= 10""")
def op_joins_nearest_k(spark, sf_dir):
    targets = relation(spark, sf_dir, "fragments").filter("e - s >= 167").selectExpr("chrom", "s AS t").distinct()
    rows = joins.nearest_k(relation(spark, sf_dir, "sites").select("site", "chrom", "c"), targets, "chrom", "c", "t", 10, 500, TILE)
    return rows.select("site", "chrom", "c", "target", "side", "rank", "spacing")


@query(PEAK_POINTS + """,
near AS (SELECT site, chrom, c, t AS target, CASE WHEN t <= c THEN -1 ELSE 1 END AS side FROM sites JOIN targets USING (chrom) WHERE abs(t - c) <= 500),
firsts AS (SELECT site, min(CASE WHEN side = 1 THEN target END) - max(CASE WHEN side = -1 THEN target END) AS spacing FROM near GROUP BY site)
SELECT CASE WHEN spacing <= 160 THEN '<=160' WHEN spacing <= 200 THEN '161-200' WHEN spacing <= 230 THEN '201-230' WHEN spacing <= 270 THEN '231-270' WHEN spacing <= 420 THEN '271-420' WHEN spacing <= 460 THEN '421-460' ELSE '>460' END AS class,
       count(*) AS n, round(avg(spacing), 6) AS mean FROM firsts WHERE spacing IS NOT NULL GROUP BY 1""")
def op_overlay_spacing_classes(spark, sf_dir):
    targets = relation(spark, sf_dir, "fragments").filter("e - s >= 167").selectExpr("chrom", "s AS t").distinct()
    near = joins.nearest_k(relation(spark, sf_dir, "sites").select("site", "chrom", "c"), targets, "chrom", "c", "t", 1, 500, TILE)
    per = near.groupBy("site").agg((F.max(F.when(F.col("side") == 1, F.col("target"))) - F.max(F.when(F.col("side") == -1, F.col("target")))).alias("spacing")).filter("spacing IS NOT NULL")
    return per.groupBy(overlay.spacing_class(F.col("spacing")).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("spacing"), 6).alias("mean"))


#: Regions are 1,000 positions wide: padded by a third to 1,300, and on to the next number of factors 2, 3 and 5, 1,350. Periods
#: of 120 to 280 positions are its frequencies 5 to 11.
SPECTRA = REGIONS + f""",
rows_ AS (SELECT r.cid, r.strand, r.chrom, p.pos, coalesce(t.cov, 0) AS cov, coalesce(t.ends, 0) AS ends, coalesce(t.wps, 0) AS wps
  FROM (SELECT cid, strand, chrom, unnest(range(lo, hi + 1)) AS pos FROM regions) p JOIN regions r ON r.cid = p.cid LEFT JOIN track t ON t.chrom = p.chrom AND t.pos = p.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) AS rank FROM rows_ WHERE cid IN (SELECT cid FROM rows_ GROUP BY cid HAVING sum(cov) > 0)),
long AS (SELECT cid, 'cov' AS m, rank, cov::DOUBLE AS v FROM ranked UNION ALL SELECT cid, 'starts', rank, CASE WHEN cov = 0 THEN 0 ELSE ends / cov::DOUBLE END FROM ranked UNION ALL SELECT cid, 'wps', rank, wps::DOUBLE FROM ranked),
lists AS (SELECT cid, m, list(v ORDER BY rank) AS v FROM long GROUP BY ALL),
filtered AS (
  SELECT cid, m, list_reduce(list_concat([list_transform(range(24), lambda i: 0::DOUBLE)], list_transform(list_concat(v[1:300], v), lambda x: [x])),
    lambda a, x: list_append(a, x[1] + list_dot_product(a[len(a) - 23:len(a)], [{', '.join(f"1 / {k}::DOUBLE" for k in range(97, 4, -4))}]))) AS y FROM lists),
values_ AS (SELECT cid, m, unnest(y[325:1324]) AS y, unnest(range(1000)) AS i FROM filtered),
trends AS (SELECT cid, m, avg(y) AS mean, regr_slope(y, i) AS slope FROM values_ GROUP BY ALL),
tapered AS (
  SELECT cid, m, i, (y - mean - slope * (i - 499.5::DOUBLE)) * CASE WHEN least(i, 999 - i) < 300 THEN 0.5::DOUBLE * (1 - cos(pi() * (2 * least(i, 999 - i) + 1) / 600)) ELSE 1 END AS x FROM values_ JOIN trends USING (cid, m)),
power AS (
  SELECT cid, m, k, (pow(sum(x * cos(2 * pi() * k * i / 1350)), 2) + pow(sum(x * sin(2 * pi() * k * i / 1350)), 2)) / 1000 AS p FROM tapered, (SELECT unnest(range(4, 13)) AS k) GROUP BY ALL),
flat AS (SELECT cid, m, k, (lag(p) OVER w / 4 + p / 2 + lead(p) OVER w / 4) / 0.625::DOUBLE AS s FROM power WINDOW w AS (PARTITION BY cid, m ORDER BY k))"""


@query(SPECTRA + """
SELECT cid, CAST(round(1350 / k::DOUBLE) AS INT) AS freq, """ + ", ".join(f"round(log10(max(s) FILTER (m = '{m}' AND s > 0)), 6) AS log_{m}" for m in ("cov", "starts", "wps")) + " FROM flat WHERE k BETWEEN 5 AND 11 GROUP BY cid, k")
def op_spectral_spectra(spark, sf_dir):
    """Spectra of the regions' coverage, ends per coverage and scores, as decimal logarithms to six places."""
    rows = signal.region_pieces(the_track(spark, sf_dir), relation(spark, sf_dir, "regions"))
    rows = rows.withColumn("starts", F.zip_with("ends", "cov", ratio_or_zero))
    found = spectral.spectra(rows, "cid", "at", ["cov", "starts", "wps"], some="cov")
    return found.select("cid", "freq", *[F.round(F.log10(F.when(F.col(c) > 0, F.col(c))), 6).alias(f"log_{c}") for c in ("cov", "starts", "wps")])
