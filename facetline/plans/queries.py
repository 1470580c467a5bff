"""The engine's operators on the driver's tables, each beside its SQL.

`embeddings` stands for variants (label for identity), `events` for a video's frames (event_type for the video, user_id
for a track, value for a quality), the star tables for identities, commits and ledgers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetline.functions import exprs as X
from facetline.kernels import redaction, tracker
from facetline.operators import aggregates, dml, joins, search, video, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, video, track, sec (whole seconds of the month), frame (its number within the track's order), quality."""
    return _t(spark, d, "events").select("event_id", F.col("event_type").alias("video"), F.col("user_id").alias("track"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"), F.col("value").alias("quality"))


EV = "SELECT event_id, event_type AS video, user_id AS track, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value AS quality FROM events"
#: Queries of a search: every vector whose id is divisible by 20, against all.
_KNN = """
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (
  SELECT query_id, e.vec_id AS variant_id, e.label, round(list_cosine_distance(q.vec, CAST(e.embedding AS DOUBLE[])), 9) AS distance
  FROM q, embeddings e),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, variant_id) AS rank FROM pairs)
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("variant_id"), F.col("embedding").alias("vec"))


@query(_KNN + "SELECT query_id, variant_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance, 'Identity ' || label AS identity, 'Default' AS variant FROM best WHERE rank <= 2")
def knn_top2(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    e = _t(spark, d, "embeddings")
    variants = e.select(F.col("vec_id").alias("id"), F.col("label").alias("identity_id"), F.lit(None).cast("string").alias("name"))
    identities = e.select(F.col("label").alias("id"), F.lit(None).cast("string").alias("name")).distinct()
    out = search.named(search.nearest(q, v, 2), variants, identities)
    return out.select("query_id", "variant_id", "rank", F.round("distance", 6).alias("distance"), "identity", "variant")


@query(_KNN.replace("FROM q, embeddings e)", "FROM q, embeddings e WHERE e.vec_id != q.query_id)") + "SELECT q.query_id, coalesce(variant_id, -1) AS variant_id, round(distance, 6) AS distance FROM q LEFT JOIN (SELECT * FROM best WHERE rank = 1 AND distance < 0.5) b ON b.query_id = q.query_id")
def knn_closest_threshold(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return search.closest(q, v, 0.5, others=True).select("query_id", "variant_id", F.round("distance", 6).alias("distance"))


@query(_KNN.replace("FROM q, embeddings e)", "FROM q, embeddings e WHERE e.vec_id != q.query_id)") + """,
two AS (SELECT query_id, max(CASE WHEN rank = 1 THEN variant_id END) AS nearest_id, max(CASE WHEN rank = 1 THEN distance END) AS d1, max(CASE WHEN rank = 2 THEN distance END) AS d2 FROM best WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, nearest_id, round(d1 * 1000) / 1000 AS d1, round(d2 * 1000) / 1000 AS d2, round(100 * (1 - d1 / 2)) / 100 AS confidence,
  CASE WHEN d1 > 0.6 THEN 'new_identity' WHEN abs(d2 - d1) < 0.05 THEN '' WHEN d1 > 0.35 THEN 'new_variant' ELSE 'merge' END AS action
FROM two""")
def staged_action(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return search.staged_actions(q, v, others=True)


@query(_KNN.replace("FROM q, embeddings e)", "FROM q, embeddings e WHERE e.vec_id != q.query_id)") + """,
per AS (SELECT query_id, label, min(distance) AS score FROM best GROUP BY query_id, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, label) AS r FROM per),
two AS (SELECT query_id, max(CASE WHEN r = 1 THEN label END) AS cluster, max(CASE WHEN r = 1 THEN score END) AS s1, max(CASE WHEN r = 2 THEN score END) AS s2 FROM ranked WHERE r <= 2 GROUP BY query_id)
SELECT query_id, cluster, round(s1 * 1000) / 1000 AS s1,
  CASE WHEN s1 > 0.35 THEN 'NEW' WHEN s2 <= 0.35 AND abs(s2 - s1) < 0.05 THEN 'AMBIGUOUS' WHEN s1 <= 0.25 THEN 'STRONG' ELSE 'POSSIBLE' END AS link
FROM two""")
def link_class(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("variant_id"), F.col("label").alias("cluster"))
    v = v.join(labels, "variant_id")
    two = search.nearest_clusters(q, v, others=True)
    best = two.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("cluster", "score")])
    return best.select("query_id", F.col("cluster1").alias("cluster"), X.round_to(F.col("score1"), 3).alias("s1"), X.link_class(F.col("score1"), F.col("score2")).alias("link"))


@query("""SELECT n_nationkey AS id, n_name AS name, CAST(coalesce(sum(CAST(floor(c_acctbal) AS BIGINT)), 0) AS BIGINT) AS face_count, count(c_custkey) AS variant_count
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def identity_summary(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    variants = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("identity_id"), F.floor("c_acctbal").alias("face_count"))
    return aggregates.identity_summary(ids, variants).withColumn("face_count", F.col("face_count").cast("long"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS face_count, count(l_linenumber) AS track_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, status, strftime(created_at, '%Y-%m-%d') AS created_on, face_count, track_count FROM s ORDER BY created_at DESC, id LIMIT 100""")
def commit_summary(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).limit(100).drop("created_at")


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS face_count, count(l_linenumber) AS track_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, status, strftime(created_at, '%Y-%m-%d') AS created_on, face_count, track_count FROM s ORDER BY created_at DESC, id""")
def commit_list(spark: SparkSession, d: str) -> DataFrame:
    """All commits; commit_summary is its first page."""
    return _commits(spark, d).drop("created_at")


def _commits(spark: SparkSession, d: str) -> DataFrame:
    commits = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    ledger = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("long").alias("added_count"))
    out = aggregates.commit_summary(commits, ledger).orderBy(F.desc("created_at"), "id")
    return out.select("id", "status", "created_at", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "face_count", "track_count")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_name ILIKE '%SUPPLIER%1%' ORDER BY s_suppkey LIMIT 20 OFFSET 5")
def name_filter_page(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.display_identity(F.col("s_name"), F.col("s_suppkey")).alias("name"))
    return s.where(F.col("name").ilike("%SUPPLIER%1%")).orderBy("id").offset(5).limit(20)


@query("SELECT vec_id AS id, label AS identity_id, len(embedding) AS dim FROM embeddings WHERE label IN (1, 3)")
def variants_for_identity(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").where(F.col("label").isin(1, 3)).select(F.col("vec_id").alias("id"), F.col("label").alias("identity_id"), F.size("embedding").cast("long").alias("dim")).orderBy("id")


_TIMELINE = f"""
WITH ev AS ({EV}), v AS (SELECT vec_id AS id, label FROM embeddings WHERE label = 3),
rows AS (SELECT video, sec, track FROM ev JOIN v ON v.id = ev.track)
"""


@query(_TIMELINE + "SELECT 'Path ' || video AS path, video AS video_id, sec AS start_time, sec + 60 AS end_time, track AS variant_id FROM rows")
def timeline_for_identity(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(spark, d).select("path", "video_id", "start_time", "end_time", "variant_id").orderBy("path", "video_id", "start_time")


@query(_TIMELINE + "SELECT 'Path ' || video AS path, video AS video_id, count(*) AS n, min(sec) AS first, max(sec) + 60 AS last FROM rows GROUP BY video")
def timeline_report(spark: SparkSession, d: str) -> DataFrame:
    return joins.timeline_report(_timeline(spark, d)).select("path", "video_id", "n", "first", "last")


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    intervals = ev.select(F.col("video").alias("video_id"), F.col("sec").alias("start_time"), (F.col("sec") + 60).alias("end_time"), F.lit(1).alias("face_count"), F.col("track").alias("variant_id"))
    videos = ev.select(F.col("video").alias("id")).distinct().withColumn("path", F.concat(F.lit("Path "), F.col("id")))
    variants = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("identity_id"))
    return joins.timeline(intervals, variants, videos, 3)


_GUARD = """
SELECT a.o_orderkey AS id, (SELECT b.o_orderkey FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderstatus IN ('O', 'P') ORDER BY b.o_orderdate, b.o_orderkey LIMIT 1) AS blocker
FROM orders a
"""


@query(_GUARD)
def rollback_guard(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", "o_orderstatus")
    return windows.later_commit(o, "o_custkey", "o_orderdate", "id", F.col("o_orderstatus").isin("O", "P"))


@query("""
WITH f AS (SELECT label, 1.0 + vec_id % 3 AS w, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, CAST(i - 1 AS INT) AS i, round(sum(x * w) / sum(w), 6) AS m FROM f GROUP BY label, i""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = aggregates.centroids(_t(spark, d, "embeddings"), "label", "embedding", 1 + F.col("vec_id") % 3)
    return c.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))


@query("""
WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 10),
f AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM f GROUP BY label, i) GROUP BY label),
d AS (SELECT top.label, vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), c), 9) AS dist FROM top JOIN m USING (label))
SELECT label, vec_id, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS r FROM d) WHERE r = 1""")
def representative(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    top = aggregates.top_frames(e.withColumn("q", F.lit(1.0)), ["label"], "q", "vec_id")
    means = aggregates.centroids(e, "label", "embedding", F.lit(1))
    return aggregates.representatives(top, means, "label", "embedding", "vec_id").select("label", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH ev AS ({EV})
SELECT video, track, count(*) AS n, arg_min(event_id, (-quality, event_id)) AS best, arg_min(event_id, (quality, event_id)) AS lowest, min(event_id) AS first, max(event_id) AS last FROM ev GROUP BY video, track""")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.extremes(_events(spark, d), ["video", "track"], "quality", "event_id")


@query(f"WITH ev AS ({EV}) SELECT video, track, event_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY quality DESC, event_id) AS r FROM ev) WHERE r <= 10")
def top10_per_track(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_frames(_events(spark, d), ["video", "track"], "quality", "event_id").select("video", "track", "event_id", "rank")


_SESSIONS = f"""
ev AS ({EV}),
marked AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY video, track ORDER BY sec) > 86400 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT video, track, sec FROM ev)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY video, track ORDER BY sec) AS session FROM marked),
spans AS (SELECT video, track, CAST(session AS BIGINT) AS session, min(sec) AS s, max(sec) AS e, count(*) AS n FROM numbered GROUP BY video, track, session)
"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    moments = _events(spark, d).select("video", "track", "sec").distinct()
    return windows.gap_sessions(moments, ["video", "track"], "sec", 86400).groupBy("video", "track", "session").agg(F.min("sec").alias("s"), F.max("sec").alias("e"), F.count("*").alias("n"))


@query(f"WITH {_SESSIONS} SELECT * FROM spans WHERE e - s >= 3600")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).where("e - s >= 3600")


@query(f"WITH {_SESSIONS} SELECT a.track, a.video || ':' || a.session AS a, b.video || ':' || b.session AS b FROM spans a JOIN spans b ON a.track = b.track AND a.video || ':' || a.session < b.video || ':' || b.session AND a.s < b.e AND b.s < a.e")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d).withColumn("id", F.concat_ws(":", "video", F.col("session").cast("string")))
    return joins.overlap_pairs(spans, "track", "id", "s", "e", 172800.0)


@query(f"""
WITH RECURSIVE ev AS ({EV}), o AS (SELECT video, track, event_id, quality, row_number() OVER (PARTITION BY video, track ORDER BY event_id) AS n FROM ev),
r AS (SELECT video, track, event_id, quality AS last, n, true AS kept FROM o WHERE n = 1
  UNION ALL
  SELECT o.video, o.track, o.event_id, CASE WHEN r.last > 0.001 AND abs(o.quality - r.last) >= 0.1 * r.last THEN o.quality ELSE r.last END, o.n, r.last > 0.001 AND abs(o.quality - r.last) >= 0.1 * r.last
  FROM r JOIN o ON o.video = r.video AND o.track = r.track AND o.n = r.n + 1)
SELECT video, track, event_id, last AS quality FROM r WHERE kept""")
def delta_samples(spark: SparkSession, d: str) -> DataFrame:
    return windows.delta_samples(_events(spark, d), ["video", "track"], "event_id", "quality")


@query(f"""WITH ev AS (SELECT video, track, sec, max(event_id) AS event_id, max(CASE WHEN quality > 20 THEN quality END) AS box FROM ({EV}) GROUP BY video, track, sec),
l AS (SELECT *, last_value(CASE WHEN box IS NOT NULL THEN sec END IGNORE NULLS) OVER w AS seen_at, last_value(box IGNORE NULLS) OVER w AS v FROM ev WINDOW w AS (PARTITION BY video, track ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT video, track, sec, event_id, CASE WHEN sec - seen_at <= 100000 THEN v END AS held FROM l""")
def linger_asof(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).groupBy("video", "track", "sec").agg(F.max("event_id").alias("event_id"), F.max(F.when(F.col("quality") > 20, F.col("quality"))).alias("box"))
    return windows.last_seen(ev, ["video", "track"], "sec", "box", 100000).select("video", "track", "sec", "event_id", "held")


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_slice(CAST(embedding AS DOUBLE[]), 1, 32) ELSE CAST(embedding AS DOUBLE[]) END AS vec FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS variant_id, CASE WHEN len(q.vec) = len(v.vec) THEN round(list_cosine_distance(q.vec, v.vec), 9) ELSE 1 END AS distance FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, variant_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, variant_id) AS rank FROM p) WHERE rank <= 2""")
def knn_mixed_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest variants where a third of the vectors has half the length: those are at distance 1 from others."""
    vec = F.col("embedding").cast("array<double>")
    v = _t(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.slice(vec, 1, 32)).otherwise(vec).alias("vec"))
    queries = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return search.nearest(queries, v.withColumnRenamed("vec_id", "variant_id"), 2, others=True).select("query_id", "variant_id", "distance", "rank")


_MEMBERS = """
SELECT o_custkey AS grp, CASE o_orderstatus WHEN 'F' THEN 'merge' WHEN 'O' THEN 'new_variant' ELSE CASE WHEN o_custkey % 5 = 0 THEN 'discard' ELSE ' new_identity' END END AS action,
  CASE WHEN o_custkey % 3 > 0 THEN concat(' ', o_custkey % 7) ELSE o_orderpriority END AS identity, CASE WHEN o_custkey % 2 = 0 THEN 'v' ELSE o_orderpriority END AS variant
FROM orders"""


@query(f"""
WITH m AS ({_MEMBERS}),
g AS (SELECT grp, CASE WHEN count(DISTINCT trim(action)) = 1 THEN min(trim(action)) ELSE '' END AS a, CASE WHEN count(DISTINCT trim(identity)) = 1 THEN min(trim(identity)) ELSE '' END AS i, CASE WHEN count(DISTINCT trim(variant)) = 1 THEN min(trim(variant)) ELSE '' END AS v FROM m GROUP BY grp)
SELECT grp, CASE WHEN a IN ('new_identity', 'discard') OR (a = 'new_variant' AND i <> '') OR (a = 'merge' AND i <> '' AND v <> '') THEN a ELSE '' END AS action,
  CASE WHEN a IN ('new_identity', 'discard') THEN '' ELSE i END AS identity, CASE WHEN a = 'merge' AND i <> '' AND v <> '' THEN v ELSE '' END AS variant FROM g""")
def group_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """What a review offers for groups whose members agree, or do not, on action, identity and variant."""
    o, c = _t(spark, d, "orders"), F.col("o_custkey")
    new = F.when(c % 5 == 0, "discard").otherwise(" new_identity")
    action = F.when(F.col("o_orderstatus") == "F", "merge").when(F.col("o_orderstatus") == "O", "new_variant").otherwise(new)
    identity = F.when(c % 3 > 0, F.concat(F.lit(" "), (c % 7).cast("string"))).otherwise(F.col("o_orderpriority"))
    variant = F.when(c % 2 == 0, "v").otherwise(F.col("o_orderpriority"))
    return aggregates.suggestion(o.select(c.alias("grp"), action.alias("action"), identity.alias("identity"), variant.alias("variant")), "grp")


@query(f"WITH ev AS ({EV}) SELECT sec // 3600 AS frame, count(DISTINCT CASE WHEN track < 10 THEN track END) AS seen, count(DISTINCT CASE WHEN track < 10 THEN track END) < 10 AS paranoid FROM ev GROUP BY frame")
def paranoid_strict(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).withColumn("frame", F.floor(F.col("sec") / 3600))
    seen = ev.groupBy("frame").agg(F.count_distinct(F.when(F.col("track") < 10, F.col("track"))).alias("seen"))
    return seen.withColumn("paranoid", F.col("seen") < 10)


@query(f"""WITH ev AS ({EV})
SELECT video, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(*) = (max(event_id) - min(event_id)) // 5 + 1 AS complete FROM ev WHERE event_id % 5 = 0 GROUP BY video
UNION ALL SELECT 'all', count(*), min(event_id), max(event_id), count(*) = (max(event_id) - min(event_id)) // 5 + 1 FROM ev WHERE event_id % 5 = 0""")
def nth_frame_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth frame, as the decoder samples them, and whether none is missing."""
    ev = video.sample_frames(_events(spark, d).withColumn("frame_index", F.col("event_id")), 5)
    ev = ev.select(F.explode(F.array(F.col("video"), F.lit("all"))).alias("video"), "event_id")
    n, lo, hi = F.count("*"), F.min("event_id"), F.max("event_id")
    return ev.groupBy("video").agg(n.alias("n"), lo.alias("first"), hi.alias("last")).withColumn("complete", F.expr("n = (last - first) div 5 + 1"))


_BOX = "SELECT event_id, event_id % 1900 AS x1, event_id % 1060 AS y1, event_id % 1900 + 1 + user_id % 90 AS x2, event_id % 1060 + 1 + event_id % 70 AS y2 FROM events"


@query(f"""WITH b AS ({_BOX}), s AS (SELECT *, greatest(1, round((x2 - x1) * 1.2::DOUBLE)) AS w, greatest(1, round((y2 - y1) * 1.2::DOUBLE)) AS h, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM b),
c AS (SELECT event_id, CAST(least(greatest(floor(cx - w / 2), 0), 1920) AS INT) AS x1, CAST(least(greatest(floor(cy - h / 2), 0), 1080) AS INT) AS y1, CAST(least(greatest(ceil(cx + w / 2), 0), 1920) AS INT) AS x2, CAST(least(greatest(ceil(cy + h / 2), 0), 1080) AS INT) AS y2, (x1 + x2) AS sx, (y1 + y2) AS sy FROM s)
SELECT c.event_id, c.x1, c.y1, c.x2, c.y2, NOT (c.x2 > c.x1 AND c.y2 > c.y1) AS empty, CAST((b.x1 + b.x2 - 1920) * (b.x1 + b.x2 - 1920) + (b.y1 + b.y2 - 1080) * (b.y1 + b.y2 - 1080) AS BIGINT) AS off_centre FROM c JOIN b USING (event_id)""")
def scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "events").selectExpr("event_id", "event_id % 1900 as x1", "event_id % 1060 as y1", "event_id % 1900 + 1 + user_id % 90 as x2", "event_id % 1060 + 1 + event_id % 70 as y2")
    whole = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(1920).alias("x2"), F.lit(1080).alias("y2"))
    own = F.struct("x1", "y1", "x2", "y2")
    b = b.withColumn("box", X.scaled_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(1920), F.lit(1080))).withColumn("off_centre", X.centre_distance(own, whole))
    return b.select("event_id", "box.x1", "box.y1", "box.x2", "box.y2", X.box_is_empty(F.col("box")).alias("empty"), "off_centre")


@query("""SELECT p_partkey, round((ln(greatest(1.0, p_retailprice)) + 1.5 * ln(greatest(1.0, p_size * 7.0)) - CASE WHEN (p_size % 9 - p_size % 5) < 0.5 * (p_size % 5 - p_size % 3) THEN 2.0 ELSE 0.0 END) * (0.5 + (p_partkey % 50) / 100.0::DOUBLE), 6) AS score FROM part""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    p, s = _t(spark, d, "part"), F.col("p_size")
    return p.select("p_partkey", F.round(X.quality_score(F.col("p_retailprice"), s * F.lit(7.0), 0.5 + (F.col("p_partkey") % 50) / F.lit(100.0), s % 3, s % 5, s % 9), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 1000) / 1000 AS r3, round(100 * (1 - l_tax / 2)) / 100 AS confidence FROM lineitem")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.round_to(F.col("l_discount"), 3).alias("r3"), X.confidence(F.col("l_tax")).alias("confidence"))


@query("SELECT event_id, printf('%02d:%02d:%02d', CAST(floor(value * 500) AS BIGINT) // 3600, CAST(floor(value * 500) AS BIGINT) // 60 % 60, CAST(floor(value * 500) AS BIGINT) % 60) AS hms FROM events")
def time_format(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", X.fmt_time(F.col("value") * 500).alias("hms"))


_FPS = ["30000/1001", "25", "N/A", "0/0", "24/1", "", "1/2/3"]


@query(f"""WITH t(s) AS (VALUES {', '.join(f"('{x}')" for x in _FPS)}), r AS (SELECT s, CASE len(string_split(s, '/')) WHEN 1 THEN try_cast(s AS DOUBLE) WHEN 2 THEN try_cast(split_part(s, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(s, '/', 2) AS DOUBLE), 0) END AS f FROM t)
SELECT s, round(CASE WHEN f > 0 THEN f END, 6) AS fps FROM r""")
def fps_parse(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _FPS], "s string").select("s", F.round(X.fps(F.col("s")), 6).alias("fps"))


@query("""WITH r AS (SELECT p_size AS grp, min(p_partkey) AS a, min(p_partkey) + 9 AS b FROM part GROUP BY p_size), x AS (SELECT grp, unnest(generate_series(a, b)) AS track FROM r)
SELECT x.grp, x.track, p.p_partkey IS NULL AS missing, count(*) OVER (PARTITION BY x.track) AS n_groups FROM x LEFT JOIN part p ON p.p_partkey = x.track""")
def track_range_expand(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of tracks per group, expanded: which do not exist, and in how many groups each is."""
    p = _t(spark, d, "part")
    r = p.groupBy(F.col("p_size").alias("grp")).agg(F.min("p_partkey").alias("a"))
    x = r.select("grp", F.explode(F.expr("sequence(a, a + 9)")).alias("track"))
    n = x.groupBy("track").agg(F.count("*").alias("n_groups"))
    known = p.select(F.col("p_partkey").alias("track"), F.lit(True).alias("known"))
    return x.join(n, "track").join(known, "track", "left").select("grp", "track", F.col("known").isNull().alias("missing"), "n_groups")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def sidecar_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return joins.mismatches(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unassigned(spark: SparkSession, d: str) -> DataFrame:
    return joins.unassigned(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


@query("""SELECT video, track, n, CASE WHEN lo = hi THEN lo ELSE '' END AS label FROM (
SELECT event_type AS video, user_id AS track, count(*) AS n, min(CASE WHEN value > 100 THEN 'high' ELSE 'low' END) AS lo, max(CASE WHEN value > 100 THEN 'high' ELSE 'low' END) AS hi FROM events GROUP BY ALL)""")
def group_consensus(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).withColumn("label", F.when(F.col("quality") > 100, " high").otherwise("low "))
    return aggregates.consensus(ev, ["video", "track"], "label")


@query("SELECT lower(c_mktsegment) AS name, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.duplicates(_t(spark, d, "customer"), F.col("c_mktsegment"))


@query(f"WITH ev AS ({EV}) SELECT event_id, video, track FROM ev WHERE video != 'click' UNION ALL SELECT event_id + 1000000, video, track FROM ev WHERE video = 'click' AND quality > 50")
def interval_replace(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d).select("event_id", "video", "track", "quality")
    new = ev.where("video = 'click' and quality > 50").withColumn("event_id", F.col("event_id") + 1000000)
    return dml.replace_for(ev, new, "video", spark.createDataFrame([("click",)], "video string")).drop("quality")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name FROM customer WHERE c_custkey % 10 = 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.where("id % 3 = 0").select("id", F.concat(F.lit("new "), "name").alias("name")).unionByName(c.where("id % 10 = 0").select((F.col("id") + 1000000000).alias("id"), "name"))
    return dml.upsert(c, new, "id")


@query("""WITH f AS (SELECT vec_id, 1 + vec_id % 4 AS n, vec_id % 5 - 2 AS dn, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id AS id, n + dn AS face_count, CAST(i - 1 AS INT) AS i, round(CAST((x * n + x * dn * 0.5) / (n + dn) AS FLOAT)::DOUBLE, 4) AS x FROM f WHERE n + dn > 0""")
def apply_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), "embedding", (1 + F.col("vec_id") % 4).alias("face_count"))
    n = F.col("vec_id") % 5 - 2
    deltas = e.select(F.col("vec_id").alias("id"), X.scale_vector(F.col("embedding"), n * 0.5).alias("delta"), n.alias("n"))
    out = dml.apply_deltas(v, deltas)
    return out.select("id", "face_count", F.posexplode("embedding").alias("i", "x")).select("id", "face_count", "i", F.round(F.col("x").cast("double"), 4).alias("x"))


@query(f"WITH ev AS ({EV}) SELECT event_id, track FROM ev WHERE track IN (SELECT vec_id FROM embeddings WHERE label != 3)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Without identity 3: its variants go, and the intervals of these."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    identities = e.select(F.col("label").alias("id")).distinct().where("id != 3")
    variants = dml.cascade(identities, e, "label")
    return dml.cascade(variants, _events(spark, d), "track").select("event_id", "track")


_ACTION = "CASE o_orderstatus WHEN 'F' THEN 'merge' WHEN 'O' THEN 'new_identity' ELSE 'new_variant' END"


@query(f"SELECT id, action, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE action WHEN 'new_identity' THEN 0 WHEN 'new_variant' THEN 1 WHEN 'merge' THEN 2 ELSE 3 END, id) AS INT) AS place FROM (SELECT o_orderkey AS id, o_custkey, {_ACTION} AS action FROM orders)")
def action_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.expr(_ACTION).alias("action"))
    w = Window.partitionBy("o_custkey").orderBy(dml.phase(F.col("action")), "id")
    return a.select("id", "action", F.row_number().over(w).alias("place"))


@query("SELECT doc_id, sha256(concat_ws('|', coalesce('=' || doc_id, '~'), coalesce('=' || text, '~'), coalesce('=' || lang, '~'))) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.fingerprint(F.col("doc_id"), F.col("text"), F.col("lang")).alias("fingerprint"))


@query("SELECT vec_id, round(sqrt(list_sum([x * x for x in CAST(embedding AS DOUBLE[])])), 6) AS norm, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), [-x for x in CAST(embedding AS DOUBLE[])]), 6) AS to_negative FROM embeddings")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(F.transform(v.cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return e.select("vec_id", F.round(norm, 6).alias("norm"), F.round(X.cosine_distance(v, X.negate_vector(X.normalize(v))), 6).alias("to_negative"))


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """Events as a video per user: a frame per event in order of time, its face the vector of the event's number."""
    from pyspark.sql import Window

    e = _t(spark, d, "embeddings")
    n = e.count()
    ev = _t(spark, d, "events").withColumn("vec_id", F.col("event_id") % n)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = ev.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").withColumn("frame_index", F.row_number().over(w).cast("long") - 1)
    x, y = (F.col("event_id") % 1800).cast("int"), (F.col("event_id") % 1000).cast("int")
    return rows.select(F.col("user_id").cast("string").alias("video_id"), "frame_index", F.lit(0).alias("face_idx"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 60).alias("y2"), "vec", F.col("value").alias("quality"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(-1).cast("long").alias("known"))


_TRACKING = tracker.Options(threshold=0.8, grace=1.0, blip=0.0, fps=10.0)


@query()
def tracker_per_video(spark: SparkSession, d: str) -> DataFrame:
    return video.track_videos(video.valid(_detections(spark, d)), _TRACKING, complete=True).select("video_id", "track_id", "start_time", "end_time", "count", "best_frame", "representative_frame")


@query()
def regroup_per_video(spark: SparkSession, d: str) -> DataFrame:
    return video.regroup_videos(video.track_videos(video.valid(_detections(spark, d)), _TRACKING))


@query()
def redaction_boxes(spark: SparkSession, d: str) -> DataFrame:
    targets = [(r.label, r.embedding) for r in _t(spark, d, "embeddings").where("vec_id < 3").orderBy("vec_id").collect()]
    return video.redaction_plan(_detections(spark, d), targets, redaction.Options(threshold=0.5, linger=0.5, fps=10.0, paranoid=True))


@query()
def painted_frames(spark: SparkSession, d: str) -> DataFrame:
    """Small frames of one colour each, painted by a plan of all their boxes."""
    dets = _detections(spark, d).withColumns({"width": F.lit(32), "height": F.lit(18), "x1": F.col("x1") % 20, "y1": F.col("y1") % 10}).withColumns({"x2": F.col("x1") + 8, "y2": F.col("y1") + 6})
    plan = video.redaction_plan(dets, [], redaction.Options(mode="blur-all"))
    frames = dets.select("video_id", "frame_index", "width", "height", F.expr("unhex(repeat(concat(lpad(hex(frame_index % 256), 2, '0'), '4080FF'), 32 * 18))").alias("data"))
    return video.paint_frames(frames, plan, "black").select("video_id", "frame_index", F.sha2("data", 256).alias("painted"))
