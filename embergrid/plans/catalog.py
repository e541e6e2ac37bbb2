"""All queries of the hotspot engine by name, and their SQL for DuckDB.

Each pair stands together: the query builds on the operators, the SQL states the same from scratch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.config import CusumConfig, FusionConfig, PersistenceConfig
from embergrid.functions import geo, records, solar
from embergrid.operators import calibration, classify, contextual, cusum, events, fusion, interaction, lifecycle, masks, merge, report, validate
from embergrid.operators import persistence as persist
from embergrid.operators import series as ops
from embergrid.operators.spatial import pairs_within, spatial_join
from embergrid.plans import views as v
from embergrid.sources import feeds
from embergrid.sources.tables import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"a query is named {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(df: DataFrame) -> DataFrame:
    return df.withColumn("lat", F.col("lat_u") / 1e6).withColumn("lon", F.col("lon_u") / 1e6)


def _right(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, (F.col("lat_u") / 1e6).alias("r_lat"), (F.col("lon_u") / 1e6).alias("r_lon"))


def _valid(spark: SparkSession, d: str) -> DataFrame:
    px = v.pix(spark, d)
    return masks.dilate(px, "cloud", "cloud_adjacent", 1).withColumn("valid", ~F.col("cloud_adjacent"))


VALID = v.PIX + """,
near AS (SELECT DISTINCT frame_id, "row" + dr AS "row", col + dc AS col FROM pix, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) WHERE cloud),
px AS (SELECT p.*, n.frame_id IS NULL AS valid, p.bt7 - p.bt14 AS btd FROM pix p LEFT JOIN near n USING (frame_id, "row", col)),
cl AS (SELECT *, valid AND NOT is_water AS land FROM px),
ab AS (SELECT *, land AND (bt7 >= 40000 OR bt7 >= CASE WHEN is_day THEN 36000 ELSE 32000 END) AS absolute FROM cl),
ca AS (SELECT *, land AND NOT absolute AND bt7 >= CASE WHEN is_day THEN 31500 ELSE 29000 END AND btd >= CASE WHEN is_day THEN 2200 ELSE 1000 END AS candidate,
  land AND bt7 >= CASE WHEN is_day THEN 33500 ELSE 30000 END AND btd >= CASE WHEN is_day THEN 3000 ELSE 1000 END AS bgfire FROM ab),
bg AS (SELECT *, land AND NOT absolute AND NOT candidate AND NOT bgfire AS background FROM ca)"""

_SUMS = ", ".join(
    f"count(*) FILTER (far <= {w // 2}) AS n_{w}" + "".join(f", sum(b{x}) FILTER (far <= {w // 2}) AS s_{x}_{w}, sum(b{x} * b{x}) FILTER (far <= {w // 2}) AS q_{x}_{w}" for x in ("bt7", "btd", "bt14"))
    for w in (11, 15, 21, 31)
)
_NEED = {11: 31, 15: 57, 21: 111, 31: 241}


def _first(form: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN n_{w} >= {_NEED[w]} THEN {form.format(w=w)} END" for w in _NEED) + ")"


_STATS = ", ".join(
    [f"{_first('{w}')} AS win", f"{_first('n_{w}')} AS n_background"]
    + [f"{_first(f'CAST(s_{x}_{{w}} AS DOUBLE) / n_{{w}}')} AS mu_{x}, {_first(f'CAST(q_{x}_{{w}} AS DOUBLE) / n_{{w}} - (CAST(s_{x}_{{w}} AS DOUBLE) / n_{{w}}) * (CAST(s_{x}_{{w}} AS DOUBLE) / n_{{w}})')} AS var_{x}" for x in ("bt7", "btd", "bt14")]
)
STATS = VALID + f""",
met AS (SELECT c.frame_id, c."row", c.col, greatest(abs(c."row" - b."row"), abs(c.col - b.col)) AS far, CAST(b.bt7 AS DOUBLE) AS bbt7, CAST(b.btd AS DOUBLE) AS bbtd, CAST(b.bt14 AS DOUBLE) AS bbt14
  FROM bg c JOIN bg b ON c.frame_id = b.frame_id AND abs(c."row" - b."row") <= 15 AND abs(c.col - b.col) <= 15 WHERE c.candidate AND b.background),
sums AS (SELECT frame_id, "row", col, {_SUMS} FROM met GROUP BY ALL),
raw AS (SELECT frame_id, "row", col, {_STATS} FROM sums),
stats AS (SELECT *, greatest(sqrt(greatest(var_bt7, 0)), 200.0) AS sd_bt7, greatest(sqrt(greatest(var_btd, 0)), 200.0) AS sd_btd, greatest(sqrt(greatest(var_bt14, 0)), 200.0) AS sd_bt14 FROM raw)"""

DETECT = STATS + """,
tests AS (SELECT bg.*, s.n_background, s.mu_btd, coalesce(candidate AND bt7 > mu_bt7 + CASE WHEN is_day THEN 3.5 ELSE 3.0 END * sd_bt7 AND btd > mu_btd + CASE WHEN is_day THEN 3.5 ELSE 3.0 END * sd_btd
  AND btd > mu_btd + CASE WHEN is_day THEN 1000 ELSE 800 END AND bt7 >= CASE WHEN is_day THEN 31000 ELSE 29500 END AND (NOT is_day OR bt14 > mu_bt14 + sd_bt14 - 400), false) AS contextual,
  count(*) FILTER (candidate) OVER (PARTITION BY frame_id) AS nc FROM bg LEFT JOIN stats s USING (frame_id, "row", col)),
raw_mask AS (SELECT *, CASE WHEN absolute THEN 3 WHEN contextual THEN CASE WHEN btd - mu_btd > 1500 AND NOT (is_day AND glint < 12) THEN 2 ELSE 1 END ELSE 0 END AS m FROM tests),
mask AS (SELECT *, CASE WHEN m >= 2 AND is_industrial AND nc > 0 THEN 1 ELSE m END AS fire_mask FROM raw_mask)"""


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return contextual.detect(_valid(spark, d), scale=100.0)


@query(f"WITH {v.DET} SELECT det_id, lat_u, lon_u FROM det WHERE lat_u BETWEEN -33500000 AND -32500000 AND lon_u BETWEEN 150500000 AND 151500000")
def roi_filter(spark, d):
    from embergrid.config import Region

    px = _place(v.det(spark, d))
    return px.where(masks.in_region(F.col("lat"), F.col("lon"), Region(150.5, -33.5, 151.5, -32.5))).select("det_id", "lat_u", "lon_u")


@query(f'WITH {v.PIX} SELECT frame_id, "row", col, bt14 < 27500 AS cloud_cold FROM pix')
def cloud_mask(spark, d):
    return v.pix(spark, d).select("frame_id", "row", "col", (F.col("bt14") < 27500).alias("cloud_cold"))


@query(f"""WITH {v.PIX}, near AS (SELECT DISTINCT frame_id, "row" + dr AS "row", col + dc AS col FROM pix, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) WHERE cloud)
SELECT p.frame_id, p."row", p.col, n.frame_id IS NOT NULL AS cloud_adjacent FROM pix p LEFT JOIN near n USING (frame_id, "row", col)""")
def cloud_adjacency_5x5(spark, d):
    return masks.dilate(v.pix(spark, d), "cloud", "cloud_adjacent", 2).select("frame_id", "row", "col", "cloud_adjacent")


@query(f"WITH {VALID} SELECT frame_id, count(*) AS n_pixels, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND is_water) AS n_water FROM px GROUP BY 1")
def valid_mask_counts(spark, d):
    return _valid(spark, d).groupBy("frame_id").agg(F.count("*").alias("n_pixels"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("valid") & F.col("is_water")).alias("n_water"))


@query(f'WITH {VALID} SELECT frame_id, "row", col, bt7, btd, absolute, candidate, background FROM bg WHERE absolute OR candidate')
def candidate_select(spark, d):
    return contextual.classify(_valid(spark, d), scale=100.0).where("absolute or candidate").select("frame_id", "row", "col", "bt7", "btd", "absolute", "candidate", "background")


@query(f"""WITH {VALID}, c AS (SELECT frame_id, "row", col FROM bg WHERE candidate) SELECT a.frame_id, a."row", a.col FROM c a WHERE EXISTS
(SELECT 1 FROM c b WHERE a.frame_id = b.frame_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col))""")
def adjacent_candidates_3x3(spark, d):
    px = contextual.classify(_valid(spark, d), scale=100.0)
    return masks.has_neighbour(px, "candidate", "near").where("candidate and near").select("frame_id", "row", "col")


@query(f"""WITH {VALID} SELECT a.frame_id, a."row", a.col, count(b.frame_id) AS n_box, CAST(coalesce(sum(b.bt7), 0) AS BIGINT) AS s_box FROM bg a LEFT JOIN bg b ON a.frame_id = b.frame_id AND b.background
AND abs(a."row" - b."row") <= 5 AND abs(a.col - b.col) <= 5 WHERE a.candidate GROUP BY ALL""")
def box_background_stats(spark, d):
    px = contextual.classify(_valid(spark, d), scale=100.0)
    sums = contextual.background_near(px, 5, "bt7").groupBy("frame_id", "row", "col").agg(F.count("*").alias("n_box"), F.sum("v").cast("long").alias("s_box"))
    return px.where("candidate").select("frame_id", "row", "col").join(sums, ["frame_id", "row", "col"], "left").na.fill(0, ["n_box", "s_box"])


@query(f'WITH {STATS} SELECT frame_id, "row", col, CAST(win AS INTEGER) AS win, CAST(n_background AS BIGINT) AS n_background, round(mu_bt7, 4) AS mu_bt7, round(mu_btd, 4) AS mu_btd, round(CASE WHEN win IS NOT NULL THEN sd_bt7 END, 4) AS sd_bt7 FROM stats')
def expanding_window_pick(spark, d):
    out = contextual.background_stats(contextual.classify(_valid(spark, d), scale=100.0), scale=100.0)
    return out.select("frame_id", "row", "col", F.col("window").alias("win"), "n_background", *[F.round(c, 4).alias(c) for c in ("mu_bt7", "mu_btd", "sd_bt7")])


@query(f"""WITH {STATS} SELECT frame_id, "row", col, round(b.btd - (mu_btd + 3.5 * sd_btd), 4) AS x1, round(b.btd - (mu_btd + 550), 4) AS x2, round(b.bt7 - (mu_bt7 + 3 * sd_bt7), 4) AS x3, round(b.bt14 - (mu_bt14 + sd_bt14 - 400), 4) AS x4
FROM bg b LEFT JOIN stats USING (frame_id, "row", col) WHERE candidate""")
def context_parameters(spark, d):
    out = classify.context_parameters(_detected(spark, d).where("candidate"), scale=100.0)
    return out.select("frame_id", "row", "col", *[F.round(x, 4).alias(x) for x in classify.CONTEXT])


@query()
def forest_verdicts(spark, d):
    """A forest learns the contextual verdict on candidates of most pixels and scores all of them; one pixel in four is held out."""
    px = classify.context_parameters(_detected(spark, d).where("candidate"), scale=100.0).withColumn("day", F.col("is_day").cast("int")).withColumn("label", F.col("contextual").cast("int"))
    px = cut(px.select("frame_id", "row", "col", "label", *classify.FEATURES, (F.pmod(F.xxhash64("row", "col"), F.lit(4)) == 0).alias("held_out")))
    scored = classify.forest_scores(px, classify.fit_forest(px.where("not held_out")))
    return scored.select("frame_id", "row", "col", "held_out", "label", "score", "predicted")


@query(f'WITH {DETECT} SELECT frame_id, "row", col, bt7, btd, contextual, absolute, CAST(fire_mask AS INTEGER) AS fire_mask FROM mask WHERE fire_mask > 0')
def contextual_fires(spark, d):
    return _detected(spark, d).where("fire_mask > 0").select("frame_id", "row", "col", "bt7", "btd", "contextual", "absolute", "fire_mask")


@query(f'WITH {DETECT} SELECT frame_id, "row", col, CAST(m AS INTEGER) AS before_site, CAST(fire_mask AS INTEGER) AS after_site FROM mask WHERE m > 0 AND is_industrial')
def confidence_downgrade(spark, d):
    out = _detected(spark, d).where("fire_mask > 0 and is_industrial")
    level = F.when(F.col("absolute"), 3).when((F.col("btd") - F.col("mu_btd") > 1500) & ~(F.col("is_day") & (F.col("glint") < 12)), 2).otherwise(1)
    return out.select("frame_id", "row", "col", level.alias("before_site"), F.col("fire_mask").alias("after_site"))


@query(f"""WITH {DETECT} SELECT frame_id, count(*) AS n_pixels, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid AND is_water) AS n_water_rejected, count(*) FILTER (candidate) AS n_candidates,
count(*) FILTER (absolute) AS n_absolute, count(*) FILTER (contextual) AS n_contextual, count(*) FILTER (candidate AND n_background IS NULL) AS n_insufficient_bg, count(*) FILTER (absolute OR contextual) AS n_fires FROM mask GROUP BY 1""")
def frame_counters(spark, d):
    return contextual.frame_counters(_detected(spark, d))


_ELLIPSE = " OR ".join(f"(pow((lat_u / 1e6 - ({lat})) / (4.0 / 111.0), 2) + pow((lon_u / 1e6 - {lon}) / (4.0 / (111.0 * cos(radians({lat})))), 2) <= 1)" for lat, lon in masks.INDUSTRIAL_SITES)


@query(f"WITH {v.DET} SELECT det_id FROM det WHERE {_ELLIPSE}")
def industrial_mask(spark, d):
    return masks.industrial(_place(v.det(spark, d))).where("is_industrial").select("det_id")


@query(f"WITH {v.DET}, {v.TRUTH} SELECT truth_id, det_id, round({v.km_sql('t', 'd')}, 6) AS km FROM truth t JOIN det d ON {v.near_sql('t', 'd', 5.0)}")
def haversine_pairs(spark, d):
    pairs = pairs_within(_place(v.det(spark, d)).select("det_id", "lat", "lon"), _right(v.truth(spark, d), "truth_id"), 5.0)
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    return pairs.select("truth_id", "det_id", (F.floor(km * 1e6 + 0.5) / 1e6).alias("km"))  # a round() parses each number's text


@query(f"WITH {v.DET}, {v.TRUTH} SELECT det_id FROM det d WHERE EXISTS (SELECT 1 FROM truth t WHERE {v.near_sql('d', 't', 5.0)})")
def spatial_semi_join(spark, d):
    return spatial_join(_place(v.det(spark, d)), _right(v.truth(spark, d)), 5.0, "left_semi").select("det_id")


@query(f"WITH {v.DET}, {v.TRUTH} SELECT det_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE {v.near_sql('d', 't', 5.0)})")
def spatial_anti_join(spark, d):
    return spatial_join(_place(v.det(spark, d)), _right(v.truth(spark, d)), 5.0, "left_anti").select("det_id")


def _method():
    return F.when(F.col("confidence") == "high", "both").when(F.col("source") == "HIMAWARI", "cusum").otherwise("contextual")


_METHOD_SQL = "CASE WHEN confidence = 'high' THEN 'both' WHEN source = 'HIMAWARI' THEN 'cusum' ELSE 'contextual' END"
MATCH = f"""{v.DET}, {v.TRUTH}, hits AS (SELECT t.truth_id, d.det_id, d.day, {_METHOD_SQL} AS method FROM truth t JOIN det d ON {v.near_sql('t', 'd', 5.0)}),
firsts AS (SELECT truth_id, min({{'day': day, 'det_id': det_id, 'method': method}}) AS f, count(*) FILTER (method IN ('contextual', 'both')) AS n_ctx, count(*) FILTER (method IN ('cusum', 'both')) AS n_cus FROM hits GROUP BY 1),
matched AS (SELECT t.*, f.truth_id IS NOT NULL AS matched, f.f.day AS our_day, f.f.method AS our_method, date_diff('minute', CAST(t.first_day AS TIMESTAMP), CAST(f.f.day AS TIMESTAMP)) AS latency,
 coalesce(n_ctx, 0) AS n_ctx, coalesce(n_cus, 0) AS n_cus FROM truth t LEFT JOIN firsts f USING (truth_id)),
alarms AS (SELECT det_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE {v.near_sql('d', 't', 5.0)} AND abs(date_diff('hour', CAST(t.first_day AS TIMESTAMP), CAST(d.day AS TIMESTAMP))) <= 24))"""


def _matched(spark, d):
    dets = _right(v.det(spark, d).withColumn("method", _method()).withColumn("level", F.lit(1)), "det_id", F.col("day").alias("obs_time"), "method", "level")
    t = _place(v.truth(spark, d)).withColumn("first_dt", F.col("first_day"))
    return validate.match_truth(t, dets)


def _alarms(spark, d):
    return validate.false_alarms(_place(v.det(spark, d)).withColumn("obs_time", F.col("day")), _right(v.truth(spark, d), F.col("first_day").alias("r_dt")))


@query(f"WITH {MATCH} SELECT truth_id, matched, CAST(our_day AS VARCHAR) AS our_day, our_method, CAST(latency AS DOUBLE) AS latency_min, n_ctx AS n_ctx_matches, n_cus AS n_cusum_matches FROM matched")
def match_truth_earliest(spark, d):
    return _matched(spark, d).select("truth_id", "matched", F.col("our_first_dt").cast("string").alias("our_day"), F.col("our_first_method").alias("our_method"), "latency_min", "n_ctx_matches", "n_cusum_matches")


@query(f"WITH {MATCH} SELECT det_id FROM alarms")
def false_alarms(spark, d):
    return _alarms(spark, d).select("det_id")


@query(f"""WITH {MATCH} SELECT n_truth, n_matched, n_early, n_fa AS n_false_alarms, n_det AS n_detections, round(n_matched / n_truth, 6) AS detection_rate, round(n_early / n_truth, 6) AS early_rate, round(n_fa / n_det, 6) AS false_alarm_rate
FROM (SELECT count(*) AS n_truth, count(*) FILTER (matched) AS n_matched, count(*) FILTER (latency < 0) AS n_early FROM matched), (SELECT count(*) AS n_fa FROM alarms), (SELECT count(*) AS n_det FROM det)""")
def validation_summary(spark, d):
    out = validate.summary(_matched(spark, d), _alarms(spark, d), v.det(spark, d))
    return out.select("n_truth", "n_matched", "n_early", "n_false_alarms", "n_detections", *[F.round(c, 6).alias(c) for c in ("detection_rate", "early_rate", "false_alarm_rate")])


_Q = ", ".join(f"round(quantile_cont(CAST(latency AS DOUBLE), {p / 100}), 4) AS latency_p{p}" for p in (10, 25, 50, 75, 90))


@query(f"WITH {MATCH} SELECT {_Q}, round(avg(latency), 4) AS latency_mean, CAST(min(latency) AS DOUBLE) AS latency_min, CAST(max(latency) AS DOUBLE) AS latency_max FROM matched")
def latency_quantiles(spark, d):
    out = validate.latency(_matched(spark, d))
    return out.select(*[F.round(c, 4).alias(c) for c in (*[f"latency_p{p}" for p in validate.LATENCY_PERCENTS], "latency_mean")], "latency_min", "latency_max")


@query(f"WITH {MATCH} SELECT CAST(b AS INTEGER) AS frp_from, count(*) AS n, count(*) FILTER (matched) AS n_matched FROM (SELECT *, CASE WHEN frp < 2 THEN 0 WHEN frp < 5 THEN 2 WHEN frp < 10 THEN 5 WHEN frp < 25 THEN 10 WHEN frp < 50 THEN 25 WHEN frp < 100 THEN 50 WHEN frp < 1000 THEN 100 END AS b FROM matched WHERE frp >= 0) WHERE b IS NOT NULL GROUP BY 1")
def frp_histogram(spark, d):
    return validate.frp_histogram(_matched(spark, d))


@query(f"WITH {MATCH} SELECT daynight, count(*) AS n, count(*) FILTER (matched) AS n_matched FROM matched GROUP BY 1")
def by_day_night(spark, d):
    return _matched(spark, d).groupBy("daynight").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"))


@query(f"WITH {MATCH} SELECT our_method AS method, count(*) AS n FROM matched WHERE matched GROUP BY 1")
def by_method(spark, d):
    return _matched(spark, d).where("matched").groupBy(F.col("our_first_method").alias("method")).agg(F.count("*").alias("n"))


_APART = "pow(t.lat_u / 1e6 - c.lat_u / 1e6, 2) + pow(t.lon_u / 1e6 - c.lon_u / 1e6, 2)"


@query(f"""WITH {v.DET}, c AS (SELECT * FROM det WHERE source = 'FIRMS'), t AS (SELECT * FROM det WHERE source = 'HIMAWARI'),
met AS (SELECT t.det_id, min({{'far': sqrt({_APART}), 'c_id': c.det_id}}) AS m FROM t JOIN c ON t.frame_no = c.frame_no AND abs(t.lat_u - c.lat_u) <= 20001 AND abs(t.lon_u - c.lon_u) <= 20001 AND sqrt({_APART}) <= 0.02 GROUP BY 1),
up AS (SELECT DISTINCT m.c_id AS det_id FROM met)
SELECT c.frame_no AS frame_id, c.det_id, CASE WHEN up.det_id IS NOT NULL AND c.confidence = 'low' THEN 'nominal' ELSE c.confidence END AS confidence, CASE WHEN up.det_id IS NOT NULL THEN 'both' ELSE 'contextual' END AS method FROM c LEFT JOIN up USING (det_id)
UNION ALL SELECT t.frame_no, t.det_id, t.confidence, 'temporal' FROM t WHERE det_id NOT IN (SELECT det_id FROM met)""")
def merge_nearest_boost(spark, d):
    dets = _place(v.det(spark, d)).select(F.col("frame_no").alias("frame_id"), "det_id", "lat", "lon", "confidence", "source")
    out = merge.merge_detections(dets.where("source = 'FIRMS'").drop("source"), dets.where("source = 'HIMAWARI'").drop("source"))
    return out.select("frame_id", "det_id", "confidence", "method")


@query(f"""WITH {v.PIX}, a AS (SELECT frame_id, "row", col FROM pix WHERE bt7 >= 30000), b AS (SELECT frame_id, "row", col FROM pix WHERE bt14 >= 27800)
SELECT frame_id, "row", col, CASE WHEN a.frame_id IS NULL THEN 'temporal' WHEN b.frame_id IS NULL THEN 'contextual' ELSE 'both' END AS method FROM a FULL JOIN b USING (frame_id, "row", col)""")
def method_tags(spark, d):
    px = v.pix(spark, d)
    return merge.method_tags(px.where("bt7 >= 30000"), px.where("bt14 >= 27800"))


PERSIST = f"""{v.DET}, s AS (SELECT unnest([-1, 1, 2, 3]) AS step),
met AS (SELECT a.det_id, count(DISTINCT CASE WHEN step > 0 THEN b.frame_no END) AS n_prior, bool_or(step = -1) AS nxt FROM det a, s, det b WHERE b.frame_no = a.frame_no - step AND {v.near_sql('a', 'b', 4.0)} GROUP BY 1),
judged AS (SELECT d.*, coalesce(n_prior, 0) AS n_prior, CASE WHEN confidence = 'high' THEN 'bypass' WHEN coalesce(n_prior, 0) >= 1 THEN 'persistent' WHEN coalesce(nxt, false) THEN 'promoted'
 WHEN frame_no < (SELECT max(frame_no) FROM det) THEN 'discarded' ELSE 'held' END AS outcome FROM det d LEFT JOIN met USING (det_id))"""


@query(f"WITH {PERSIST} SELECT det_id, frame_no, n_prior, outcome, CASE WHEN outcome IN ('bypass', 'persistent') THEN frame_no WHEN outcome = 'promoted' THEN frame_no + 1 END AS emit_frame FROM judged")
def persistence_filter(spark, d):
    return persist.persistence(_place(v.det(spark, d)), PersistenceConfig()).select("det_id", "frame_no", "n_prior", "outcome", "emit_frame")


@query(f"""WITH {PERSIST} SELECT frame_no, CAST(sum(received) AS BIGINT) AS received, CAST(sum(bypassed) AS BIGINT) AS bypassed, CAST(sum(persistent) AS BIGINT) AS persistent, CAST(sum(held) AS BIGINT) AS held, CAST(sum(promoted) AS BIGINT) AS promoted,
CAST(sum(discarded) AS BIGINT) AS discarded, CAST(sum(bypassed + persistent + promoted) AS BIGINT) AS passed FROM (SELECT frame_no, 1 AS received, CAST(outcome = 'bypass' AS INT) AS bypassed, CAST(outcome = 'persistent' AS INT) AS persistent,
CAST(outcome IN ('held', 'promoted', 'discarded') AS INT) AS held, 0 AS promoted, 0 AS discarded FROM judged UNION ALL SELECT frame_no + 1, 0, 0, 0, 0, CAST(outcome = 'promoted' AS INT), CAST(outcome = 'discarded' AS INT) FROM judged WHERE outcome IN ('promoted', 'discarded')) GROUP BY 1""")
def persistence_stats(spark, d):
    return persist.persistence_stats(persist.persistence(_place(v.det(spark, d))))



@query(f"""WITH {v.SERIES}, r AS (SELECT *, sum(z100 - 50) OVER w AS p, sum(z100 - 150) OVER w AS q FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING))
SELECT user_id, ord, CAST(p - least(0, min(p) OVER w) AS BIGINT) AS s_slow, CAST(q - least(0, min(q) OVER w) AS BIGINT) AS s_fast FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING)""")
def cusum_slow_fast(spark, d):
    df = cusum.cusum_by_windows(v.series(spark, d), "user_id", ["t", "ord"], "z100", 50, "s_slow")
    return cusum.cusum_by_windows(df, "user_id", ["t", "ord"], "z100", 150, "s_fast").select("user_id", "ord", "s_slow", "s_fast")


@query(f"""WITH {v.SERIES}, r AS (SELECT *, count(*) FILTER (z100 <= 0) OVER (PARTITION BY user_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS run FROM series)
SELECT user_id, ord, count(*) FILTER (z100 > 0) OVER (PARTITION BY user_id, run ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS n_consecutive FROM r""")
def consecutive_anomalies(spark, d):
    return cusum.consecutive_anomalies(v.series(spark, d), "user_id", ["t", "ord"], F.col("z100") > 0, "n_consecutive").select("user_id", "ord", "n_consecutive")


@query(f"""WITH {v.SERIES}, r AS (SELECT *, sum(z100 - 50) OVER w AS p, row_number() OVER w - 1 AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, p - least(0, min(p) OVER w) AS s FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING))
SELECT user_id, ord, CASE WHEN n >= 48 THEN round(1 / (1 + exp(-greatest(-50.0, least(50.0, ln(0.00001 / 0.99999) + 2 * (s / 100.0))))), 6) END AS confidence FROM s""")
def cusum_confidence(spark, d):
    from pyspark.sql import Window

    df = cusum.cusum_by_windows(v.series(spark, d), "user_id", ["t", "ord"], "z100", 50, "s")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "ord")) - 1
    return df.select("user_id", "ord", F.round(records.fire_probability(F.col("s") / 100, n, 1e-5), 6).alias("confidence"))


_FOLD = """WITH RECURSIVE {series}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, ord) AS i FROM series),
f AS (SELECT user_id, i, t, {first} AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.t, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, round(s, 6) AS s, n FROM (SELECT user_id, arg_max(s, i) AS s, max(i) AS n FROM f GROUP BY 1)"""


@query(_FOLD.format(series=v.SERIES, first="CASE WHEN clear THEN greatest(0.0, z100 / 100.0 - 0.5) ELSE 0.0 END", step="CASE WHEN o.clear THEN greatest(0.0, f.s + o.z100 / 100.0 - 0.5) ELSE f.s * exp(-greatest(o.t - f.t, 0) / 10800.0) END"))
def cusum_decay_fold(spark, d):
    df = v.series(spark, d).withColumn("z", F.col("z100") / 100)
    return cusum.decay_fold(df, "user_id", 0.5).select("user_id", F.round("s", 6).alias("s"), "n")


@query(_FOLD.format(series=v.SERIES, first="CAST(z100 AS DOUBLE)", step="f.s + 0.125 * (o.z100 - f.s)").replace("round(s, 6) AS s, n", "round(s, 6) AS ema"))
def ema_bt14(spark, d):
    return cusum.ema_fold(v.series(spark, d), "user_id", "z100", 0.125).select("user_id", F.round("ema", 6).alias("ema"))


@query(f"WITH {v.SERIES} SELECT user_id, round(greatest(var_pop(CAST(z100 AS DOUBLE)), 1.0), 4) AS var FROM series GROUP BY 1")
def welford_var(spark, d):
    return v.series(spark, d).groupBy("user_id").agg(F.round(F.greatest(F.var_pop("z100"), F.lit(1.0)), 4).alias("var"))


def _kalman_input(spark, d):
    px = v.pix(spark, d)
    return px.select("pixel_id", "frame_id", "row", "col", F.lit(147.0).alias("lon"), (F.col("frame_id") * 86400 + 3600).cast("double").alias("t"), ((F.col("bt7") - F.col("bt14")) / 100).alias("btd"), (F.col("bt14") / 100).alias("bt14"), (~F.col("cloud")).alias("clear"), "is_day", F.col("is_water").alias("suppressed"))


def _kalman_frames(spark, d):
    """The whole model over all frames: neighbours decide which candidates count and are reset."""
    return cusum.run_tiles(_kalman_input(spark, d), CusumConfig(min_clear=5))


KALMAN_OUT = ("pixel_id", "frame_id", "z", "confidence", "s_slow", "s_fast", "n_obs", "candidate")


@query()
def kalman_cusum_full(spark, d):
    return _kalman_frames(spark, d).select(*KALMAN_OUT)


@query()
def kalman_cusum_without_neighbours(spark, d):
    return cusum.run_series(_kalman_input(spark, d), CusumConfig(require_adjacent=False, min_clear=5)).select(*KALMAN_OUT)


PASSES = f"""RECURSIVE {v.SITES}, o AS (SELECT site, minute, row_number() OVER (PARTITION BY site ORDER BY minute, seq) AS i FROM sites),
f AS (SELECT site, i, minute AS st, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.site, o.i, CASE WHEN o.minute - f.st > 30 THEN o.minute ELSE f.st END, f.n + CASE WHEN o.minute - f.st > 30 THEN 1 ELSE 0 END FROM f JOIN o ON o.site = f.site AND o.i = f.i + 1),
passes AS (SELECT site, max(n) AS n_passes FROM f GROUP BY 1),
roll AS (SELECT site, min(seq) AS event_seq, round(avg(lat_u / 1e6), 6) AS centroid_lat, round(avg(lon_u / 1e6), 6) AS centroid_lon, CASE WHEN arg_min(source, seq) = 'HIMAWARI' THEN 4000.0 ELSE 2000.0 END AS location_uncertainty_m,
 count(*) AS detection_count, max(frp) AS max_frp, CASE WHEN bool_or(confidence = 'high') THEN 'high' WHEN bool_or(confidence = 'nominal') THEN 'nominal' ELSE 'low' END AS max_confidence,
 string_agg(DISTINCT source, ',' ORDER BY source) AS source_set, count(DISTINCT source) AS ns, min(minute) AS first_minute, max(minute) AS last_minute FROM sites GROUP BY 1),
ev AS (SELECT *, CASE WHEN n_passes >= 3 THEN 'CONFIRMED' WHEN ns >= 2 OR n_passes >= 2 THEN 'LIKELY' ELSE 'PROVISIONAL' END AS status FROM roll JOIN passes USING (site))"""


def _members(spark, d):
    s = _place(v.sites(spark, d))
    return s.join(s.groupBy("site").agg(F.min("seq").alias("event_seq")), "site")


def _events(spark, d):
    return events.rollup(_members(spark, d))


@query(f"WITH {PASSES} SELECT event_seq, CAST(n_passes AS INTEGER) AS n_passes, status FROM ev")
def event_passes_ladder(spark, d):
    return _events(spark, d).select("event_seq", "n_passes", "status")


@query(f"WITH {PASSES} SELECT event_seq, centroid_lat, centroid_lon, location_uncertainty_m, detection_count, max_frp, max_confidence, source_set, first_minute, last_minute, status FROM ev")
def event_rollup(spark, d):
    minute = lambda c: ((F.unix_seconds(c) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 60).cast("long")
    return _events(spark, d).select("event_seq", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"), "location_uncertainty_m", "detection_count", "max_frp", "max_confidence", "source_set", minute("first_detection_time").alias("first_minute"), minute("latest_detection_time").alias("last_minute"), "status")


@query(f"WITH {PASSES} SELECT status, count(*) AS n FROM ev GROUP BY 1")
def event_status_counts(spark, d):
    return report.status_counts(_events(spark, d))


@query(f"WITH {PASSES} SELECT event_seq, row_number() OVER (ORDER BY event_seq) AS id FROM ev")
def event_ids(spark, d):
    return events.numbered(_events(spark, d)).select("event_seq", "id")


@query(f"WITH {v.SITES} SELECT seq, round(avg(lat_u / 1e6) OVER w, 6) AS run_lat, round(avg(lon_u / 1e6) OVER w, 6) AS run_lon FROM sites WINDOW w AS (PARTITION BY site ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def running_centroid(spark, d):
    return events.running_centroid(_members(spark, d)).select("seq", F.round("run_lat", 6).alias("run_lat"), F.round("run_lon", 6).alias("run_lon"))


_AWAY = "2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="least(1.0, pow(sin(radians(e.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - s.lon) / 2), 2))")


@query(f"""WITH RECURSIVE {v.SITES}, o AS (SELECT seq, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, minute, row_number() OVER (ORDER BY seq) AS i FROM sites),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS event_seq, CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE, n BIGINT, latest BIGINT)[]) AS ev
 UNION ALL SELECT i, seq, coalesce(best.id, seq), CASE WHEN best IS NULL THEN list_append(ev, {{'id': seq, 'lat': lat, 'lon': lon, 'n': CAST(1 AS BIGINT), 'latest': minute}})
  ELSE list_transform(ev, lambda e: CASE WHEN e.id = best.id THEN {{'id': e.id, 'lat': (e.lat * e.n + lat) / (e.n + 1), 'lon': (e.lon * e.n + lon) / (e.n + 1), 'n': e.n + 1, 'latest': greatest(e.latest, minute)}} ELSE e END) END
 FROM (SELECT s.*, w.ev, list_min(list_transform(list_filter(w.ev, lambda e: {_AWAY} < 2.0), lambda e: {{'far': {_AWAY}, 'late': -e.latest, 'id': e.id}})) AS best FROM walk w JOIN o s ON s.i = w.i + 1))
SELECT seq, event_seq FROM walk WHERE i > 0""")
def event_association(spark, d):
    return events.associate(_place(v.sites(spark, d))).select("seq", "event_seq")


def _fuse_sql() -> str:
    """One step at a time: expire, join or open, then merge with all circles that the joined event's half covers."""
    cfg = FusionConfig()
    big, small = cfg.coarse_uncertainty_km, cfg.fine_uncertainty_km
    cover = f"CASE e.unc + c.unc WHEN {2 * big} THEN {fusion.half_covered_km(big, big)!r} WHEN {2 * small} THEN {fusion.half_covered_km(small, small)!r} ELSE {fusion.half_covered_km(big, small)!r} END"
    apart = _AWAY.replace("s.lat", "c.lat").replace("s.lon", "c.lon")
    event = "STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE, n BIGINT, latest BIGINT, unc DOUBLE, members BIGINT[])"
    return f"""WITH RECURSIVE {v.SITES}, o AS (SELECT seq, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, minute * 10 AS t, source = 'HIMAWARI' AS coarse, row_number() OVER (ORDER BY minute, seq) AS i FROM sites),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS {event}[]) AS ev, CAST([] AS {event}[]) AS old
 UNION ALL SELECT i, list_append(list_filter(now, lambda e: NOT list_contains(with_it, e.id) AND e.id <> c.id), CASE WHEN len(with_it) = 0 THEN c ELSE {{'id': least(c.id, list_min(with_it)),
   'lat': list_reduce(list_transform(parts, lambda e: {{'v': e.lat, 'n': e.n}}), lambda x, y: {{'v': (x.v * x.n + y.v * y.n) / (x.n + y.n), 'n': x.n + y.n}}).v, 'lon': list_reduce(list_transform(parts, lambda e: {{'v': e.lon, 'n': e.n}}), lambda x, y: {{'v': (x.v * x.n + y.v * y.n) / (x.n + y.n), 'n': x.n + y.n}}).v,
   'n': CAST(list_sum(list_transform(parts, lambda e: e.n)) AS BIGINT), 'latest': c.latest, 'unc': list_min(list_transform(parts, lambda e: e.unc)), 'members': flatten(list_transform(parts, lambda e: e.members))}} END), old
 FROM (SELECT *, list_prepend(c, list_transform(near, lambda x: list_filter(now, lambda e: e.id = x.id)[1])) AS parts, list_transform(near, lambda x: x.id) AS with_it FROM (
  SELECT *, list_sort(list_transform(list_filter(now, lambda e: e.id <> c.id AND {apart} < {cover}), lambda e: {{'far': {apart}, 'late': -e.latest, 'id': e.id}})) AS near FROM (
  SELECT i, old, now, list_filter(now, lambda e: e.id = coalesce(best.id, seq))[1] AS c FROM (
  SELECT s.*, old, best, CASE WHEN best IS NULL THEN list_append(live, {{'id': s.seq, 'lat': s.lat, 'lon': s.lon, 'n': CAST(1 AS BIGINT), 'latest': s.t, 'unc': CASE WHEN s.coarse THEN {big} ELSE {small} END, 'members': [s.seq]}})
   ELSE list_transform(live, lambda e: CASE WHEN e.id = best.id THEN {{'id': e.id, 'lat': (e.lat * e.n + s.lat) / (e.n + 1), 'lon': (e.lon * e.n + s.lon) / (e.n + 1), 'n': e.n + 1, 'latest': s.t, 'unc': least(e.unc, CASE WHEN s.coarse THEN {big} ELSE {small} END), 'members': list_append(e.members, s.seq)}} ELSE e END) END AS now
  FROM (SELECT s.*, live, old, list_min(list_transform(list_filter(live, lambda e: {_AWAY} < CASE WHEN s.coarse THEN {cfg.coarse_km} ELSE {cfg.fine_km} END), lambda e: {{'far': {_AWAY}, 'late': -e.latest, 'id': e.id}})) AS best
   FROM (SELECT s.*, list_filter(w.ev, lambda e: e.latest >= s.t - {cfg.window_days * 1440}) AS live, list_concat(w.old, list_filter(w.ev, lambda e: e.latest < s.t - {cfg.window_days * 1440})) AS old FROM walk w JOIN o s ON s.i = w.i + 1) s) s) s) s) s) s)
SELECT unnest(e.members) AS seq, e.id AS event_seq FROM (SELECT unnest(list_concat(ev, old)) AS e FROM walk ORDER BY i DESC LIMIT (SELECT len(ev) + len(old) FROM walk ORDER BY i DESC LIMIT 1))"""


def _spread_sites(spark, d):
    """The sites' detections with ten times as much time between them, so that events fall silent."""
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return _place(v.sites(spark, d)).withColumn("acq", F.timestamp_seconds(start + F.col("minute") * 600))


@query(_fuse_sql())
def event_fusion(spark, d):
    """Radii by sensor, a window of five days, and events whose circles overlap made one."""
    return fusion.fuse(_spread_sites(spark, d)).select("seq", "event_seq")


_CROSS = f"""{v.SITES}, s AS (SELECT *, lat_u / 1e6 AS lat, lon_u / 1e6 AS lon, minute AS t FROM sites),
met AS (SELECT s.seq, e.seq AS r_seq, e.source AS r_source, {_AWAY} AS km, e.t - s.t AS minutes, e.lat, e.lon FROM s JOIN s e ON s.source = 'HIMAWARI' AND abs(e.t - s.t) <= CASE e.source WHEN 'DEA' THEN 180 WHEN 'FIRMS' THEN 360 END AND {_AWAY} < 2.0)"""


def _cross(spark, d):
    s = _place(v.sites(spark, d))
    fine = s.select(F.col("seq").alias("r_seq"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("acq").alias("r_acq"), F.col("source").alias("r_source"))
    return s.where("source = 'HIMAWARI'").select("seq", "lat", "lon", "acq"), fine


@query(f"WITH {_CROSS} SELECT seq, r_seq, r_source, round(km, 6) AS km, CAST(minutes AS DOUBLE) AS minutes FROM met")
def cross_resolution_match(spark, d):
    return fusion.cross_resolution(*_cross(spark, d)).select("seq", "r_seq", "r_source", F.round("km", 6).alias("km"), "minutes")


@query(f"""WITH {_CROSS}, best AS (SELECT seq, min({{'km': km, 'minutes': minutes, 'r_seq': r_seq, 'lat': lat, 'lon': lon}}) AS m, count(DISTINCT r_source) AS n FROM met GROUP BY 1)
SELECT seq, m.r_seq AS match_seq, round(coalesce(m.lat, s.lat), 6) AS refined_lat, round(coalesce(m.lon, s.lon), 6) AS refined_lon, CASE WHEN m IS NULL THEN 4.0 ELSE 2.0 END AS uncertainty_km, coalesce(n, 0) AS n_sources FROM s LEFT JOIN best USING (seq) WHERE source = 'HIMAWARI'""")
def cross_resolution_refine(spark, d):
    coarse, fine = _cross(spark, d)
    out = fusion.match_and_refine(coarse, fine)
    return out.select("seq", "match_seq", F.round("refined_lat", 6).alias("refined_lat"), F.round("refined_lon", 6).alias("refined_lon"), "uncertainty_km", "n_sources")


@query(f"WITH {PASSES} SELECT event_seq, detection_count, status FROM ev WHERE status NOT IN ('RETRACTED', 'CLOSED')")
def active_events(spark, d):
    return events.active(_events(spark, d)).select("event_seq", "detection_count", "status")


@query(f"WITH {PASSES} SELECT s.seq, e.event_seq, e.status, s.minute FROM sites s JOIN ev e USING (site)")
def event_detail(spark, d):
    return _members(spark, d).select("seq", "event_seq", "minute").join(_events(spark, d).select("event_seq", "status"), "event_seq")


@query(f"WITH {v.SITES} SELECT seq, minute FROM sites WHERE minute >= 5002 - 24 * 60")
def recent_detections(spark, d):
    as_of = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + 5002 * 60)
    return events.recent(v.sites(spark, d), as_of, 24).select("seq", "minute")


@query("""SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def dedup_insert_ignore(spark, d):
    stored = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return events.insert_ignore(stored, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
def dedup_keep_last(spark, d):
    return events.keep_last(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], [F.desc("l_linenumber")])


@query(f"WITH {v.DET} SELECT det_id, sha256('FIRMS|' || CAST(det_id % 97 AS VARCHAR) || '|' || strftime(day, '%Y-%m-%dT%H:%M:%S') || '+00:00') AS sid FROM det")
def sha_ids(spark, d):
    return v.det(spark, d).select("det_id", F.sha2(F.concat_ws("|", F.lit("FIRMS"), (F.col("det_id") % 97).cast("string"), records.iso_utc(F.col("day").cast("timestamp"))), 256).alias("sid"))


@query("""SELECT event_id, CASE WHEN r IN ('l', 'low') THEN 'low' WHEN r IN ('h', 'high') THEN 'high' WHEN r IN ('n', 'nominal') THEN 'nominal' WHEN TRY_CAST(r AS INT) >= 80 THEN 'high' WHEN TRY_CAST(r AS INT) >= 30 THEN 'nominal' WHEN TRY_CAST(r AS INT) IS NOT NULL THEN 'low' ELSE 'nominal' END AS confidence
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'Low' WHEN 2 THEN 'x' ELSE CAST(event_id % 101 AS VARCHAR) END AS raw FROM events), LATERAL (SELECT lower(raw) AS r)""")
def firms_confidence(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "h").when(i % 5 == 1, "Low").when(i % 5 == 2, "x").otherwise((i % 101).cast("string"))
    return table(spark, d, "events").select("event_id", records.feed_confidence(raw).alias("confidence"))


@query("SELECT event_id, CAST(coalesce(nullif(event_id % 3, 0), nullif(event_id % 5, 0), event_id % 7) AS BIGINT) AS v FROM events")
def truthy_coalesce(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", records.first_truthy(i % 3, i % 5, i % 7).alias("v"))


@query("SELECT event_id, (floor(epoch(ts)) % 86400) / 3600.0 + 10 >= 24 AS next_day, CAST((CAST(floor(epoch(ts)) AS BIGINT) % 86400 * 15 + 147 * 3600) % (86400 * 15) BETWEEN 6 * 54000 AND 18 * 54000 AS BOOLEAN) AS is_day FROM events")
def lst_day_flag(spark, d):
    t = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", (F.pmod(F.unix_seconds(t), F.lit(86400)) / 3600 + 10 >= 24).alias("next_day"), solar.is_day_by_hour(t, F.lit(147.0)).alias("is_day"))


@query("SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 13 THEN CAST(n AS INTEGER) END AS day_no FROM (SELECT o_orderkey, date_diff('day', DATE '2026-04-09', CAST(DATE '2026-04-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE)) + 1 AS n FROM orders)")
def competition_day(spark, d):
    return table(spark, d, "orders").select("o_orderkey", records.competition_day(F.date_add(F.lit("2026-04-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))).alias("day_no"))


@query(f"""WITH {PASSES} SELECT event_seq, 'GeometryCollection' AS geometry_type, centroid_lon AS lon, centroid_lat AS lat, CAST(33 AS BIGINT) AS n_vertices, true AS closed, round(centroid_lon + location_uncertainty_m / (111320.0 * cos(radians(centroid_lat))), 4) AS east,
status, detection_count, max_frp, location_uncertainty_m, source_set FROM ev""")
def geojson_features(spark, d):
    """Features written as text and read back, so that malformed JSON shows."""
    shape = "geometry struct<type: string, geometries: array<struct<type: string, coordinates: string>>>, properties struct<status: string, detection_count: long, max_frp: long, location_uncertainty_m: double, source_set: string>"
    f = report.features(_events(spark, d), with_circle=True).select("event_seq", F.from_json("feature", shape, {"mode": "FAILFAST"}).alias("f"))
    parts = f.select("event_seq", "f", F.from_json(F.col("f.geometry.geometries")[0]["coordinates"], "array<double>").alias("point"), F.from_json(F.col("f.geometry.geometries")[1]["coordinates"], "array<array<array<double>>>")[0].alias("ring"))
    return parts.select(
        "event_seq", F.col("f.geometry.type").alias("geometry_type"), F.round(F.col("point")[0], 6).alias("lon"), F.round(F.col("point")[1], 6).alias("lat"), F.size("ring").cast("long").alias("n_vertices"), (F.col("ring")[0] == F.element_at("ring", -1)).alias("closed"), F.round(F.col("ring")[0][0], 4).alias("east"),
        F.col("f.properties.status").alias("status"), F.col("f.properties.detection_count").alias("detection_count"), F.col("f.properties.max_frp").alias("max_frp"), F.col("f.properties.location_uncertainty_m").alias("location_uncertainty_m"), F.col("f.properties.source_set").alias("source_set"),
    )


@query(f"""WITH {PASSES}, n AS (SELECT count(*) AS total, count(*) FILTER (status = 'LIKELY') AS likely, count(*) FILTER (status = 'CONFIRMED') AS confirmed FROM ev)
SELECT 0 AS part, CAST(NULL AS BIGINT) AS event_seq, 'FeatureCollection' AS type, total AS total_events, nullif(likely, 0) AS likely, nullif(confirmed, 0) AS confirmed, 2 AS competition_day FROM n
UNION ALL SELECT 1, event_seq, 'Feature', NULL, NULL, NULL, NULL FROM ev UNION ALL SELECT 2, NULL, 'end', NULL, NULL, NULL, NULL""")
def report_document(spark, d):
    """The lines of a daily report's document, each read back on its own."""
    doc = report.collection(_events(spark, d), "daily_report", True, "2026-04-10", "2026-04-10 20:00:00")
    line = F.when(F.col("part") == 0, F.concat("line", F.lit("]}"))).otherwise(F.regexp_replace("line", "^,", ""))
    at = lambda p: F.get_json_object(line, f"$.{p}")
    return doc.select(
        "part", "event_seq", F.when(F.col("line") == "]}", "end").otherwise(at("type")).alias("type"), at("metadata.total_events").cast("long").alias("total_events"),
        at("metadata.status_summary.LIKELY").cast("long").alias("likely"), at("metadata.status_summary.CONFIRMED").cast("long").alias("confirmed"), at("metadata.competition_day").cast("int").alias("competition_day"),
    )


@query(f"WITH {PASSES} SELECT (SELECT count(*) FROM sites) AS total_detections, count(*) AS total_events, count(*) FILTER (status NOT IN ('RETRACTED', 'CLOSED')) AS active_events FROM ev")
def system_status(spark, d):
    return events.system_status(v.sites(spark, d), _events(spark, d))


@query(f"""WITH {PASSES}, c AS (SELECT event_seq, centroid_lat, centroid_lon, location_uncertainty_m AS m, unnest(range(33)) AS i FROM ev)
SELECT event_seq, i AS vertex, round(centroid_lon + m * cos((i % 32) * (2 * pi() / 32)) / (111320.0 * cos(radians(centroid_lat))), 4) AS lon, round(centroid_lat + m * sin((i % 32) * (2 * pi() / 32)) / 111320.0, 4) AS lat FROM c""")
def uncertainty_circle(spark, d):
    ev = _events(spark, d).select("event_seq", F.posexplode(geo.circle(F.round("centroid_lat", 6), F.round("centroid_lon", 6), F.col("location_uncertainty_m"))).alias("vertex", "p"))
    return ev.select("event_seq", F.col("vertex").cast("long").alias("vertex"), F.round(F.col("p")[0], 4).alias("lon"), F.round(F.col("p")[1], 4).alias("lat"))


@query(f"WITH {PASSES} SELECT source_set, count(*) AS n_events, CAST(sum(detection_count) AS BIGINT) AS n_detections, max(max_frp) AS max_frp FROM ev GROUP BY 1")
def daily_report_counts(spark, d):
    return _events(spark, d).groupBy("source_set").agg(F.count("*").alias("n_events"), F.sum("detection_count").alias("n_detections"), F.max("max_frp").alias("max_frp"))


@query("""WITH e AS (SELECT value, ts + to_days(CAST(event_id % 450 AS INTEGER)) AS t FROM events),
l AS (SELECT value, t + to_hours(CASE WHEN t < TIMESTAMP '2024-04-06 16:00:00' OR t >= TIMESTAMP '2024-10-05 16:00:00' AND t < TIMESTAMP '2025-04-05 16:00:00' OR t >= TIMESTAMP '2025-10-04 16:00:00' THEN 11 ELSE 10 END) AS local FROM e),
d AS (SELECT CAST(local + INTERVAL '4 hours 10 minutes' AS DATE) AS day, value FROM l),
w AS (SELECT day, CASE WHEN x >= TIMESTAMP '2024-04-07 03:00:00' AND x < TIMESTAMP '2024-10-06 03:00:00' OR x >= TIMESTAMP '2025-04-06 03:00:00' AND x < TIMESTAMP '2025-10-05 03:00:00' THEN x - INTERVAL '10 hours' ELSE x - INTERVAL '11 hours' END AS to_utc, value FROM (SELECT day, CAST(day AS TIMESTAMP) + INTERVAL '19 hours 50 minutes' AS x, value FROM d)),
f AS (SELECT DISTINCT day, to_utc, CASE WHEN x >= TIMESTAMP '2024-04-07 03:00:00' AND x < TIMESTAMP '2024-10-06 03:00:00' OR x >= TIMESTAMP '2025-04-06 03:00:00' AND x < TIMESTAMP '2025-10-05 03:00:00' THEN x - INTERVAL '10 hours' ELSE x - INTERVAL '11 hours' END AS from_utc FROM (SELECT DISTINCT day, to_utc, CAST(day AS TIMESTAMP) - INTERVAL '4 hours 10 minutes' AS x FROM w))
SELECT CAST(day AS VARCHAR) AS report_date, from_utc, to_utc, count(*) AS n, max(value) AS greatest FROM w JOIN f USING (day, to_utc) GROUP BY ALL""")
def daily_report_windows(spark, d):
    """Events shifted over fifteen months, by the daily report that ends at 19:50 in Sydney; two reports each run 23 and 25 hours."""
    e = table(spark, d, "events")
    t = (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 450).cast("int"))).cast("timestamp")
    return report.daily_windows(e.select(t.alias("t"), "value"), "t", "value").withColumn("report_date", F.col("report_date").cast("string"))


@query(f"""WITH {v.PIX}, p AS (SELECT frame_id, "row", col, CASE WHEN pixel_id % 13 <> 0 THEN CAST(bt7 - bt14 AS DOUBLE) END AS v FROM pix),
m AS (SELECT a.frame_id, a."row", a.col, a.v, CASE WHEN a.v IS NOT NULL THEN count(b.v) END AS n_near, avg(b.v) AS near, a.v - avg(b.v) AS anomaly, greatest(abs(a.v - min(b.v)), abs(max(b.v) - a.v)) AS gradient
 FROM p a LEFT JOIN p b ON a.frame_id = b.frame_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) AND b.v IS NOT NULL GROUP BY a.frame_id, a."row", a.col, a.v)
SELECT frame_id, "row", col, n_near, round(anomaly, 4) AS anomaly, CASE WHEN v IS NOT NULL THEN gradient END AS gradient, round(anomaly - avg(anomaly) OVER w, 4) AS anomaly_trend, CASE WHEN v IS NOT NULL THEN round(gradient - avg(gradient) OVER w, 4) END AS gradient_change,
 v > avg(v) OVER w AND near <= avg(near) OVER w AS diverging FROM (SELECT * REPLACE (CASE WHEN v IS NOT NULL THEN gradient END AS gradient) FROM m) WINDOW w AS (PARTITION BY "row", col ORDER BY frame_id RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def interaction_features(spark, d):
    px = v.pix(spark, d).select("frame_id", "row", "col", F.when(F.col("pixel_id") % 13 != 0, F.col("bt7") - F.col("bt14")).alias("btd"))
    out = interaction.interaction_features(px)
    return out.select("frame_id", "row", "col", "n_near", F.round("anomaly", 4).alias("anomaly"), "gradient", F.round("anomaly_trend", 4).alias("anomaly_trend"), F.round("gradient_change", 4).alias("gradient_change"), "diverging")


@query(f"""WITH {v.PIX}, px AS (SELECT frame_id, pixel_id, (bt7 - 29000) / CAST(40000 AS DOUBLE) AS probability, NOT cloud AS clear, bt14 / CAST(100 AS DOUBLE) AS z FROM pix),
pool AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY md5(pixel_id || ':42'), pixel_id) AS rn, count(*) OVER (PARTITION BY frame_id) AS n FROM px WHERE probability <= 0.01 AND clear)
SELECT *, 'fire_candidate' AS pixel_type FROM px WHERE probability > 0.01 UNION ALL SELECT * EXCLUDE (rn, n), 'background_sample' FROM pool WHERE rn <= greatest(1, floor(n * CAST(0.1 AS DOUBLE)))""")
def training_sample(spark, d):
    px = v.pix(spark, d).select("frame_id", "pixel_id", ((F.col("bt7") - 29000) / 40000.0).alias("probability"), (~F.col("cloud")).alias("clear"), (F.col("bt14") / 100.0).alias("z"))
    return ops.training_sample(px, rate=0.1)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE (i - 1) % 6 = 0")
def subsample_every_k(spark, d):
    return ops.every_kth(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 6).select("user_id", "event_id")


@query("SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY)) AS x) WHERE CAST(x AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 300000)")
def date_catchup(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 300000").select(F.to_date("o_orderdate").alias("day")).distinct()
    return ops.missing_dates(spark, "1992-01-01", "1998-12-31", done).select(F.col("day").cast("string").alias("day"))


LABELLED = v.PIX + ", lab AS (SELECT pixel_id % 20 AS label, frame_id, pixel_id, bt7 - bt14 AS btd, is_day, cloud FROM pix)"


@query(f"""WITH {LABELLED}, s AS (SELECT label, avg(btd) AS mu, stddev_samp(btd) AS sd FROM lab WHERE NOT cloud AND is_day GROUP BY 1)
SELECT label, CAST(k AS INTEGER) AS k, min(CASE WHEN btd > mu + k * sd THEN frame_id END) AS first_ts FROM lab JOIN s USING (label), (SELECT unnest([2, 3, 4, 5]) AS k) WHERE NOT (NOT cloud AND is_day) GROUP BY 1, 2""")
def sigma_exceedance_first(spark, d):
    px = v.pix(spark, d).select((F.col("pixel_id") % 20).alias("label"), F.col("frame_id").alias("ts"), (F.col("bt7") - F.col("bt14")).alias("btd"), (~F.col("cloud") & F.col("is_day")).alias("is_background"))
    return validate.sigma_exceedance(px)


@query(f"""WITH {LABELLED}, s AS (SELECT label, avg(btd) AS mu, stddev_samp(btd) AS sd FROM lab WHERE NOT cloud AND is_day GROUP BY 1),
x AS (SELECT label, CAST(k AS INTEGER) AS k, min(CASE WHEN btd > mu + k * sd THEN frame_id END) AS ts FROM lab JOIN s USING (label), (SELECT unnest([2, 3, 4, 5]) AS k) WHERE NOT (NOT cloud AND is_day) GROUP BY 1, 2)
SELECT label, k, (CAST(epoch(TIMESTAMP '2024-01-20') AS BIGINT) + label * 3600 - ts * 86400) / CAST(3600 AS DOUBLE) AS hours_before FROM x""")
def lead_hours(spark, d):
    first = sigma_exceedance_first(spark, d).withColumn("first_ts", F.timestamp_seconds(F.col("first_ts") * 86400))
    truth = first.select("label").distinct().withColumn("first_dt", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-20").cast("timestamp")) + F.col("label") * 3600))
    return validate.lead_hours(first, truth).select("label", "k", "hours_before")


@query(f"""WITH {LABELLED} SELECT label, count(*) FILTER (NOT cloud) AS n_all, round(avg(btd) FILTER (NOT cloud), 4) AS mean_all, round(stddev_samp(btd) FILTER (NOT cloud), 4) AS std_all, min(btd) FILTER (NOT cloud) AS min_all, max(btd) FILTER (NOT cloud) AS max_all,
count(*) FILTER (NOT cloud AND is_day) AS n_day, round(avg(btd) FILTER (NOT cloud AND NOT is_day), 4) AS mean_night, round(avg(CAST(cloud AS INT)), 6) AS cloud_fraction FROM lab GROUP BY 1""")
def clear_sky_stats(spark, d):
    px = v.pix(spark, d).select((F.col("pixel_id") % 20).alias("label"), (F.col("bt7") - F.col("bt14")).alias("btd"), "is_day", "cloud")
    s = validate.clear_sky_stats(px)
    return s.select("label", "n_all", F.round("mean_all", 4).alias("mean_all"), F.round("std_all", 4).alias("std_all"), "min_all", "max_all", "n_day", F.round("mean_night", 4).alias("mean_night"), F.round("cloud_fraction", 6).alias("cloud_fraction"))


def _weather(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 7).alias("lat"), (F.col("user_id") % 5).alias("lon"), F.col("event_type").alias("code")).agg(F.max(F.round(F.col("value") * 100).cast("long")).alias("value"), F.count("*").alias("source"))


WEATHER = "w AS (SELECT CAST(ts AS DATE) AS date, user_id % 7 AS lat, user_id % 5 AS lon, event_type AS code, max(CAST(round(value * 100) AS BIGINT)) AS value, count(*) AS source FROM events GROUP BY ALL)"


@query(f"""WITH {WEATHER} SELECT CAST(date AS VARCHAR) AS date, lat, lon, max(value) FILTER (code = 'click') AS click_value, max(source) FILTER (code = 'click') AS click_source, max(value) FILTER (code = 'error') AS error_value, max(source) FILTER (code = 'error') AS error_source FROM w GROUP BY 1, 2, 3""")
def weather_pivot(spark, d):
    return ops.weather_pivot(_weather(spark, d), ["click", "error"]).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {WEATHER} SELECT code, source, count(*) AS n, count(DISTINCT (lat, lon)) AS n_places FROM w GROUP BY 1, 2")
def weather_sources(spark, d):
    return ops.weather_sources(_weather(spark, d))


@query("""WITH g AS (SELECT DISTINCT user_id % 97 AS i FROM events), h AS (SELECT DISTINCT round_even((-30 - (user_id % 53) * 0.05) * 20, 0) / 20 AS lat, 150.0 AS lon FROM events),
w AS (SELECT i, round_even((-30 - i * 0.0487) * 20, 0) / 20 AS lat, round_even(150.01 * 20, 0) / 20 AS lon FROM g) SELECT i, round(lat, 2) AS lat, round(lon, 2) AS lon FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE abs(h.lat - w.lat) < 0.001 AND abs(h.lon - w.lon) < 0.001)""")
def places_to_fetch(spark, d):
    """Wanted places less those that are stored, both snapped to the same grid."""
    u = table(spark, d, "events").select("user_id")
    wanted = u.select((F.col("user_id") % 97).alias("i")).distinct().select("i", (-30 - F.col("i") * 0.0487).alias("lat"), F.lit(150.01).alias("lon"))
    stored = u.select((-30 - (F.col("user_id") % 53) * 0.05).alias("lat"), F.lit(150.0).alias("lon"))
    return ops.places_to_fetch(wanted, stored).select("i", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"))


@query(f"WITH {WEATHER} SELECT code, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, max(value) AS most FROM w GROUP BY 1")
def weather_summary(spark, d):
    s = ops.weather_summary(_weather(spark, d))
    return s.select("code", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", "most")


@query("""WITH p AS (SELECT user_id, event_id, 'HS_H09_' || strftime(ts, '%Y%m%d_%H%M') || CASE event_id % 3 WHEN 0 THEN '_B07' WHEN 1 THEN '_B14' ELSE '_B03' END || '_FLDK_R20_S' || CASE event_id % 2 WHEN 0 THEN '0810' ELSE '0910' END AS path, strftime(ts, '%Y%m%d_%H%M') AS frame FROM events)
SELECT frame, count(DISTINCT event_id % 6) AS n, CASE WHEN count(DISTINCT event_id % 6) >= 4 THEN 'ok' ELSE 'incomplete' END AS status FROM p WHERE event_id % 3 < 2 GROUP BY 1""")
def segment_completeness(spark, d):
    i = F.col("event_id")
    name = F.concat(F.lit("HS_H09_"), F.date_format("ts", "yyyyMMdd_HHmm"), F.when(i % 3 == 0, "_B07").when(i % 3 == 1, "_B14").otherwise("_B03"), F.lit("_FLDK_R20_S"), F.when(i % 2 == 0, "0810").otherwise("0910"))
    return feeds.complete_frames(feeds.segments(table(spark, d, "events").select(name.alias("path"))))




@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT l_orderkey) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS BIGINT) AS new, CAST(count(*) - count(DISTINCT l_orderkey) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS BIGINT) AS duplicates FROM lineitem")
def ingest_summary(spark, d):
    stored = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return events.ingest_summary(stored, table(spark, d, "lineitem"), "l_orderkey")


@query(f"""WITH {v.DET}, {v.TRUTH}, d AS (SELECT t.truth_id, d.det_id, sqrt(pow(t.lat_u / 1e6 - d.lat_u / 1e6, 2) + pow(t.lon_u / 1e6 - d.lon_u / 1e6, 2)) AS far FROM truth t JOIN det d ON abs(t.lat_u - d.lat_u) <= 50001 AND abs(t.lon_u - d.lon_u) <= 50001)
SELECT t.truth_id, m.m.det_id AS det_id, round(m.m.far, 9) AS far FROM truth t LEFT JOIN (SELECT truth_id, min({{'far': far, 'det_id': det_id}}) AS m FROM d WHERE far <= 0.05 GROUP BY 1) m USING (truth_id)""")
def nearest_pixel(spark, d):
    grid = _right(v.det(spark, d), F.col("det_id").alias("row"), F.lit(0).alias("col"))
    out = calibration.nearest_pixel(_place(v.truth(spark, d)).select(F.col("truth_id").alias("label"), "lat", "lon"), grid, 0.05)
    return out.select(F.col("label").alias("truth_id"), F.col("row").alias("det_id"), F.round("pixel_dist_deg", 9).alias("far"))


@query(f"""WITH {v.DET}, {v.TRUTH}, d AS (SELECT t.truth_id, d.det_id, sqrt(pow(t.lat_u / 1e6 - d.lat_u / 1e6, 2) + pow(t.lon_u / 1e6 - d.lon_u / 1e6, 2)) AS far FROM truth t, det d)
SELECT truth_id, m.det_id AS det_id, round(m.far, 9) AS far FROM (SELECT truth_id, min({{'far': far, 'det_id': det_id}}) AS m FROM d GROUP BY 1)""")
def nearest_pixel_anywhere(spark, d):
    """The first look goes not far, so that some targets look several times."""
    grid = _right(v.det(spark, d), F.col("det_id").alias("row"), F.lit(0).alias("col"))
    out = calibration.nearest_pixel_anywhere(_place(v.truth(spark, d)).select(F.col("truth_id").alias("label"), "lat", "lon"), grid, 0.0005)
    return out.select(F.col("label").alias("truth_id"), F.col("row").alias("det_id"), F.round("pixel_dist_deg", 9).alias("far"))


@query("""WITH t AS (SELECT s_suppkey AS truth_id, CAST(DATE '2023-12-20' + CAST(s_suppkey * 37 % 60 AS INTEGER) AS TIMESTAMP) AS first_dt FROM supplier)
SELECT truth_id FROM t WHERE first_dt BETWEEN (SELECT min(ts) - INTERVAL 24 HOUR FROM events) AND (SELECT max(ts) + INTERVAL 24 HOUR FROM events)""")
def eligible_truth(spark, d):
    first = F.date_add(F.lit("2023-12-20").cast("date"), (F.col("s_suppkey") * 37 % 60).cast("int"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("truth_id"), first.alias("first_dt"))
    return calibration.eligible_truth(t, table(spark, d, "events").select(F.col("ts").alias("obs_time"))).select("truth_id")


@query(f"WITH {v.SITES} SELECT seq, row_number() OVER (PARTITION BY site, minute // 1000 ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'nominal' THEN 1 ELSE 0 END DESC, seq) > 1 AS derived FROM sites")
def provenance_dedup(spark, d):
    members = _members(spark, d).withColumn("observation_key", F.floor(F.col("minute") / 1000))
    return lifecycle.provenance(members).select("seq", "derived")


@query(f"""WITH {PASSES} SELECT event_seq, CASE WHEN status = 'PROVISIONAL' AND detection_count % 3 >= 2 AND (5002 - last_minute) / 60 >= 6 THEN 'RETRACTED' WHEN (5002 - last_minute) / 60 >= 12 THEN 'CLOSED'
WHEN status = 'CONFIRMED' AND (5002 - last_minute) / 60 > 1 THEN 'MONITORING' ELSE status END AS status FROM ev""")
def event_lifecycle(spark, d):
    as_of = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + 5002 * 60)
    ev = _events(spark, d).withColumn("missed_frames", F.col("detection_count") % 3)
    return lifecycle.transitions(ev, as_of).select("event_seq", "status")


@query(f"""WITH {VALID}, met AS (SELECT c.frame_id, c."row", c.col, CAST(b.btd AS DOUBLE) AS x FROM bg c JOIN bg b ON c.frame_id = b.frame_id AND abs(c."row" - b."row") <= 5 AND abs(c.col - b.col) <= 5 WHERE c.candidate AND b.background),
mid AS (SELECT frame_id, "row", col, median(x) AS median, count(*) AS n FROM met GROUP BY ALL HAVING count(*) >= 10) SELECT frame_id, "row", col, n, median, median(abs(x - median)) AS mad FROM met JOIN mid USING (frame_id, "row", col) GROUP BY ALL""")
def mad_background(spark, d):
    return lifecycle.mad_background(contextual.classify(_valid(spark, d), scale=100.0))


@query(f"WITH {v.DET} SELECT det_id, round_even(lat_u / 1e6 * 20, 0) / 20 AS lat, round_even(lon_u / 1e6 * 20, 0) / 20 AS lon FROM det")
def snap_grid(spark, d):
    p = _place(v.det(spark, d))
    return p.select("det_id", records.snap(F.col("lat")).alias("lat"), records.snap(F.col("lon")).alias("lon"))


@query(f"""WITH {PASSES} SELECT event_seq, '| ' || event_seq || ' | ' || status || ' | ' || detection_count || ' | ' || CASE WHEN max_frp IS NULL OR max_frp = 0 THEN '—' ELSE max_frp || '.0' END || ' | ' || source_set || ' |' AS line FROM ev""")
def markdown_table(spark, d):
    rows = report.markdown_rows(_events(spark, d).withColumn("max_frp", F.col("max_frp").cast("double")))
    return rows.select("event_seq", F.regexp_replace("line", r" \| -\d+\.\d{4} \| \d+\.\d{4}", "").alias("line"))


@query()
def calibration_series(spark, d):
    s = v.series(spark, d).select(F.col("user_id").cast("string").alias("label"), F.timestamp_seconds("t").alias("obs_time"), (F.col("z100") / 100.0).alias("btd"), (~F.col("clear")).cast("int").alias("cloud_flag"), (F.col("ord") % 2 == 0).alias("is_day"), F.lit(147.0).alias("lon"))
    return calibration.follow_targets(s)


@query()
def cusum_heatmap(spark, d):
    return cusum.heatmap(_kalman_frames(spark, d), floor=0.00001)


_IDS = f"""WITH {v.DET}, x AS (SELECT det_id, frame_no, (lat_u - (lat_u % 100)) / 1e6 AS lat, (lon_u - (lon_u % 100)) / 1e6 AS lon, day, frp FROM det)
SELECT det_id, frame_no, sha256('HIMAWARI|' || printf('%.4f', lat) || '|' || printf('%.4f', lon) || '|' || strftime(day, '{{iso}}')) AS source_id,
CASE frp % 5 WHEN 3 THEN 'high' WHEN 2 THEN 'nominal' ELSE 'low' END AS decoded,
CASE WHEN frp % 7 = 0 THEN 'low' WHEN frp % 7 = 1 THEN 'high' WHEN frp % 7 = 2 THEN 'nominal' WHEN frp >= 80 THEN 'high' WHEN frp >= 30 THEN 'nominal' ELSE 'low' END AS feed,
CASE WHEN frp % 3 = 0 THEN 'nominal' WHEN frp % 3 = 1 THEN CAST(frp AS VARCHAR) WHEN frp >= 80 THEN 'high' WHEN frp >= 30 THEN 'nominal' ELSE 'low' END AS typed,
CASE WHEN frp % 10 <> 0 THEN frp % 10 WHEN frp % 4 <> 0 THEN frp % 4 ELSE 0 END AS truthy,
CASE WHEN frp % 180 < 85 THEN 'D' ELSE 'N' END AS daynight,
CASE WHEN frp % 101 > 80 THEN 'very high' WHEN frp % 101 > 50 THEN 'high' WHEN frp % 101 > 20 THEN 'moderate' ELSE 'low' END AS band,
day + to_minutes(CAST(60 * (frp % 24) + frp % 60 AS BIGINT)) AS seen FROM x"""


@query(_IDS.replace("{iso}", "%Y-%m-%dT%H:%M:%S+00:00"))
def record_fields(spark, d):
    """Record fields of every detection: ids, the feeds' confidence forms, first values, day letters, bands and clocks."""
    frp = F.col("frp")
    x = v.det(spark, d).withColumn("lat", (F.col("lat_u") - F.col("lat_u") % 100) / 1e6).withColumn("lon", (F.col("lon_u") - F.col("lon_u") % 100) / 1e6)
    raw = F.when(frp % 7 == 0, "L").when(frp % 7 == 1, " high").when(frp % 7 == 2, "odd").otherwise(frp.cast("string"))
    clock = F.concat((frp % 24).cast("string"), F.lpad((frp % 60).cast("string"), 2, "0"))
    return x.select(
        "det_id", "frame_no", records.grid_source_id("HIMAWARI", F.col("lat"), F.col("lon"), F.col("day").cast("timestamp")).alias("source_id"), records.decode_confidence(frp % 5).alias("decoded"), records.feed_confidence(raw).alias("feed"),
        records.number_confidence(F.when(frp % 3 != 0, frp.cast("string")), frp % 3 == 2).alias("typed"), records.first_truthy(frp % 10, frp % 4, F.lit(0).cast("long")).alias("truthy"), records.day_night(frp % 180).alias("daynight"),
        records.probability_band((frp % 101) / 100).alias("band"), records.hhmm(F.col("day").cast("string"), clock).cast("timestamp_ntz").alias("seen"),
    )


@query(f"""WITH {v.PIX}, p AS (SELECT frame_id, "row", col, CASE WHEN pixel_id % 13 <> 0 THEN bt7 END AS bt7, bt14, pixel_id % 17 <> 0 AS in_roi FROM pix),
near AS (SELECT DISTINCT frame_id, "row" + dr AS "row", col + dc AS col FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS dr), (SELECT unnest([-2, -1, 0, 1, 2]) AS dc) WHERE bt14 < 27315)
SELECT frame_id, "row", col, bt14 < 27315 AS cloud, n.col IS NOT NULL AS cloud_adjacent, in_roi AND n.col IS NULL AND bt7 IS NOT NULL AS valid FROM p LEFT JOIN near n USING (frame_id, "row", col)""")
def valid_pixels(spark, d):
    """The valid mask itself: region, clouds with their buffer of two pixels, both bands."""
    px = v.pix(spark, d).withColumn("bt7", F.when(F.col("pixel_id") % 13 != 0, F.col("bt7"))).withColumn("in_roi", F.col("pixel_id") % 17 != 0)
    return masks.valid_pixels(px, 27315).select("frame_id", "row", "col", "cloud", "cloud_adjacent", "valid")


@query(f"WITH {v.DET} SELECT det_id, frame_no, CAST(day AS VARCHAR) AS day, confidence, frp FROM det WHERE day <= DATE '1996-06-30' ORDER BY det.day DESC, det_id, frp, frame_no LIMIT 100")
def latest_detections(spark, d):
    """The hundred latest detections up to a day, newest first: the limit is the feature."""
    seen = v.det(spark, d).where(F.col("day") <= F.lit("1996-06-30").cast("date"))
    return seen.orderBy(F.desc("day"), "det_id", "frp", "frame_no").limit(100).select("det_id", "frame_no", F.col("day").cast("string").alias("day"), "confidence", "frp")


@query(f"WITH {v.DET} SELECT confidence, source, CAST(count(DISTINCT frame_no) AS BIGINT) AS n_frames, CAST(count(DISTINCT day) AS BIGINT) AS n_days, max(CASE WHEN frp % 5 <> 0 THEN frp / 10.0 END) AS max_frp FROM det GROUP BY 1, 2")
def distinct_counts(spark, d):
    """Frames and days by confidence and source, and the greatest value with NaN taken for missing."""
    det = v.det(spark, d).withColumn("f", F.when(F.col("frp") % 5 != 0, F.col("frp") / 10).otherwise(F.lit(float("nan"))))
    return masks.nan_to_null(det, "f").groupBy("confidence", "source").agg(F.count_distinct("frame_no").alias("n_frames"), F.count_distinct("day").alias("n_days"), F.max("f").alias("max_frp"))
