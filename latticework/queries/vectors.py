"""Descriptor and latent-space queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.functions import vector as V
from latticework.functions.ids import SQL_KEY, id_key
from latticework.operators import diversity, latent
from latticework.session import materialise, table

QUERIES, ORACLES = {}, {}
KEY = SQL_KEY.format(c="atl_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


E = "e as (select vec_id, label, embedding::double[] as v from embeddings)"


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"with {E}, t as (select v as t from e where vec_id = 0) select vec_id, round(1 - list_dot_product(v, t) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(t, t))), 6) as cosine, round(sqrt(list_sum(list_transform(list_zip(v, t), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) as euclidean, round(1 - list_dot_product(v, t) / list_sum(list_transform(list_zip(v, t), lambda p: greatest(p[1] * p[1], p[2] * p[2]))), 6) as tanimoto from e, t")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    t = e.where("vec_id = 0").select(F.col("v").alias("t"))
    v, w = F.col("v"), F.col("t")
    return e.join(F.broadcast(t)).select("vec_id", F.round(V.cosine_distance(v, w), 6).alias("cosine"), F.round(V.euclidean(v, w), 6).alias("euclidean"), F.round(V.tanimoto_distance(v, w), 6).alias("tanimoto"))


@query(f"with {E}, u as (select unnest(v) as x, unnest(range(1, 65)) as pos from e) select pos::int - 1 as pos, round(min(x), 6) as lo, round(max(x), 6) as hi, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from u group by pos")
def descriptor_ranges(spark: SparkSession, d: str) -> DataFrame:
    u = _e(spark, d).select(F.posexplode("v").alias("pos", "x"))
    return u.groupBy("pos").agg(F.round(F.min("x"), 6).alias("lo"), F.round(F.max("x"), 6).alias("hi"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query(f"with {E}, u as (select unnest(v) as x, unnest(range(1, 65)) as pos from e where label < 8), m as (select list(lo order by pos) as lo, list(hi order by pos) as hi from (select pos, min(x) as lo, max(x) as hi from u group by pos)) select vec_id, list_bool_or(list_transform(list_zip(v, lo, hi), lambda p: p[1] < p[2] or p[1] > p[3])) as extrapolating from e, m")
def basic_extrapolation(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    bounds = V.by_position(e.where("label < 8"), "v", lo=F.min, hi=F.max)
    return e.join(F.broadcast(bounds)).select("vec_id", V.outside(F.col("v"), F.col("lo"), F.col("hi")).alias("extrapolating"))


@query(f"with {E}, u as (select label, unnest(v) as x, unnest(range(1, 65)) as pos from e) select label, pos::int - 1 as pos, round(avg(x), 6) as mean from u group by 1, 2")
def outer_average(spark: SparkSession, d: str) -> DataFrame:
    u = _e(spark, d).select("label", F.posexplode("v").alias("pos", "x"))
    return u.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


@query(f"with {E}, t as (select vec_id as tid, v as t from e where vec_id in (1, 2, 3)), x as (select tid, vec_id, round(sqrt(list_sum(list_transform(list_zip(v, t), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 7) as dist from e, t) select tid, vec_id, row_number() over (partition by tid order by dist, vec_id)::int as rank from x qualify rank <= 10")
def nearest_seeds(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    t = e.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("tid"), F.col("v").alias("target"))
    return latent.nearest_to(t, e.withColumn("v", F.col("v")), "v", 10, "vec_id").select("tid", "vec_id", "rank")


L = f"l as (select {KEY} as key, unnest(latent_space::double[][]) as p from descriptor_dict where latent_space is not null), m as (select key, avg(p[1]) as x, avg(p[2]) as y, count(*) as n from l group by key)"


def _latent(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "descriptor_dict").select(id_key("atl_id").alias("key"), F.explode("latent_space").alias("p"))
    return p.groupBy("key").agg(F.avg(F.col("p")[0].cast("double")).alias("x"), F.avg(F.col("p")[1].cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))


@query(f"with {L} select key, round(x, 5) as x, round(y, 5) as y, n from m")
def structure_latents(spark: SparkSession, d: str) -> DataFrame:
    return _latent(spark, d).select("key", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "n")


@query(f"with {L}, t as (select unnest([0, 1, 2, 3])::int as tid, unnest([0.0, 1.0, -2.0, 20.0])::double as tx, unnest([0.0, 1.5, 0.5, 20.0])::double as ty), h as (select tid, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) as dist from t, m) select t.tid, count(dist) as n, round(min(dist), 5) as nearest from t left join h on t.tid = h.tid and dist <= 0.5 group by t.tid")
def latent_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.5), (2, -2.0, 0.5), (3, 20.0, 20.0)], "tid int, tx double, ty double")
    return latent.neighbourhood(t, _latent(spark, d), 0.5).select("tid", "n", F.round("nearest", 5).alias("nearest"))


#: Two stated hulls, as a trained latent map would give.
HULLS = ([(-1.5, -1.0), (1.25, -1.5), (1.5, 1.0), (0.0, 1.75), (-1.25, 1.0)], [(1.0, 0.5), (3.0, 0.75), (2.5, 2.5)])


def _ray(poly) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(poly, [*poly[1:], poly[0]], strict=True):
        if y1 != y2:
            parts.append(f"(case when y >= {min(y1, y2)} and y < {max(y1, y2)} and x < {x1} + (y - {y1}) * (({x2} - {x1}) / ({y2} - {y1})::double) then 1 else 0 end)")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query(f"with {L}, a as (select key, p[1] as x, p[2] as y from l) select key, count(*) as n, count(*) filter (where {_ray(HULLS[0])}) as first_hull, count(*) filter (where not ({_ray(HULLS[0])}) and {_ray(HULLS[1])}) as second_hull, bool_and(({_ray(HULLS[0])}) or ({_ray(HULLS[1])})) as in_domain from a group by key")
def points_in_hulls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "descriptor_dict").select(id_key("atl_id").alias("key"), F.explode("latent_space").alias("p")).select("key", F.col("p")[0].cast("double").alias("x"), F.col("p")[1].cast("double").alias("y"))
    at = G.first_polygon(F.col("x"), F.col("y"), HULLS)
    return p.withColumn("hull", at).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hull") == 0).alias("first_hull"), F.count_if(F.col("hull") == 1).alias("second_hull"), F.bool_and(F.col("hull").isNotNull()).alias("in_domain"))


@query(f"with {L}, s as (select lower(trim(split_name)) as step, {KEY} as k from split_members), x as (select distinct step, key, x, y from s join m on s.k = m.key) select step, count(*) as n, round(max(x) - min(x), 5) as wide, round(max(y) - min(y), 5) as high from x group by step")
def latent_extent(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "split_members").select(F.lower(F.trim("split_name")).alias("step"), id_key("atl_id").alias("key")).distinct()
    x = s.join(_latent(spark, d), "key")
    return x.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("x") - F.min("x"), 5).alias("wide"), F.round(F.max("y") - F.min("y"), 5).alias("high"))


@query(f"with {L}, c as (select floor(x / 0.25)::bigint as cx, floor(y / 0.25)::bigint as cy, count(*) as n from m group by 1, 2) select c.cx, c.cy, c.n, sum(o.n)::bigint as around from c join c o on o.cx between c.cx - 1 and c.cx + 1 and o.cy between c.cy - 1 and c.cy + 1 group by 1, 2, 3")
def raster_density(spark: SparkSession, d: str) -> DataFrame:
    c = _latent(spark, d).groupBy(F.floor(F.col("x") / 0.25).alias("cx"), F.floor(F.col("y") / 0.25).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = c.select("cx", "cy", "n", F.explode(near).alias("dx")).select("*", F.explode(near).alias("dy"))
    sums = spread.groupBy((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).agg(F.sum("n").alias("around"))
    return c.join(sums, ["cx", "cy"]).select("cx", "cy", "n", "around")


@query(f"with {E}, x as (select vec_id, label, v, first_value(v) over (partition by label order by vec_id) as f from e) select vec_id from x where vec_id not in (select min(vec_id) from e group by label) and list_bool_or(list_transform(list_zip(v, f), lambda p: abs(p[1] - p[2]) <= 1e-8 + 1e-5 * abs(p[2])))")
def loose_repeats(spark: SparkSession, d: str) -> DataFrame:
    first = Window.partitionBy("label").orderBy("vec_id")
    e = _e(spark, d).select("vec_id", "v", F.first("v").over(first).alias("f"), F.row_number().over(first).alias("k"))
    close = F.exists(F.zip_with("v", "f", lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)), lambda c: c)
    return e.where(close & (F.col("k") > 1)).select("vec_id")


@query()
def vendi_by_label(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(diversity.vendi_linear(_e(spark, d), "v", 64), 6),)], "vendi double")


@query()
def vendi_subsampled(spark: SparkSession, d: str) -> DataFrame:
    return diversity.vendi_subsampled(_e(spark, d), "vec_id", "v", size=10_000, rounds=4, sigma=None).select("round", "n", F.round("score", 6).alias("score"))


def sql_farthest(n: int, start: str = "") -> str:
    """The selection step by step: the farthest row, then every row's distance to what is selected."""
    dist = "sqrt(list_sum(list_transform(list_zip(n.v, s.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    first = f"(select min({dist}) from e s where s.vec_id in ({start}))" if start else "'inf'::double"
    parts = ["e as materialized (select vec_id, embedding::double[] as v from embeddings)", f"n0 as materialized (select vec_id, v, {first} as near from e n)"]
    for i in range(n):
        parts.append(f"s{i} as materialized (select vec_id, v, near from n{i} order by near desc, vec_id limit 1)")
        parts.append(f"n{i + 1} as materialized (select n.vec_id, n.v, least(n.near, {dist}) as near from n{i} n, s{i} s)")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select vec_id, {i} as rank, case when isinf(near) then null else round(near, 6) end as distance from s{i}" for i in range(n))


@query(sql_farthest(10))
def farthest_points(spark: SparkSession, d: str) -> DataFrame:
    f = diversity.farthest(_e(spark, d), "vec_id", "v", 10)
    return f.select("vec_id", "rank", F.when(F.col("distance") < float("inf"), F.round("distance", 6)).alias("distance"))


@query("""with recursive e as (select vec_id, embedding::double[] as v, row_number() over (order by md5('0:' || vec_id), vec_id) as k from embeddings), u as materialized (select vec_id, k, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
g as (select k, vec_id, true as keep, [v] as kept from u where k = 1 union all
select k, vec_id, keep, case when keep then list_append(kept, v) else kept end as kept
from (select u.k, u.vec_id, u.v, g.kept, coalesce(list_bool_and(list_transform(g.kept, lambda x: 1 - list_dot_product(x, u.v) > 0.8)), true) as keep from g join u on u.k = g.k + 1))
select vec_id, (row_number() over (order by k) - 1)::int as rank from g where keep""")
def circles(spark: SparkSession, d: str) -> DataFrame:
    return diversity.circles(_e(spark, d), "vec_id", "v", 0.8)


def _cloud(spark: SparkSession, d: str) -> tuple[list, list, float]:
    """All averaged latent points as those that bound them, their weights, and the mean nearest distance of all."""
    from latticework.operators import hulls

    p = materialise(_latent(spark, d), "latent")
    got = hulls.extremes(p, "x", "y").orderBy("x", "y").collect()  # at most LIMIT
    return [(r["x"], r["y"]) for r in got], [float(r["n"]) for r in got], hulls.mean_nearest(p, "x", "y")


@query()
def concave_hull(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators import hulls

    points, weights, distance = _cloud(spark, d)
    ring, alpha = hulls.concave_hull(np.array(points).reshape(-1, 2), distance=distance, weights=np.array(weights))
    return spark.createDataFrame([(i, float(x), float(y), float(alpha)) for i, (x, y) in enumerate(ring)], "corner int, x double, y double, alpha double")


@query()
def optimised_hull(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators import hulls

    ring, alpha = hulls.optimised_hull(np.array(_cloud(spark, d)[0]).reshape(-1, 2), exact=0.05)
    return spark.createDataFrame([(i, float(x), float(y), float(alpha)) for i, (x, y) in enumerate(ring)], "corner int, x double, y double, alpha double")


@query(f"with {L}, p as (select distinct x, y from m where x is not null and y is not null and not isnan(x) and not isnan(y)), n as (select a.x, a.y, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as d from p a join p b on a.x <> b.x or a.y <> b.y group by 1, 2) select round(avg(d), 6) as mean_nearest from n")
def mean_nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators import hulls

    return spark.createDataFrame([(round(hulls.mean_nearest(_latent(spark, d), "x", "y"), 6),)], "mean_nearest double")


@query("select n_nationkey * 1.0::double as width, n_nationkey / 2.0::double as cx, (n_regionkey + 1) / 2.0::double as cy, n_nationkey * (n_regionkey + 1.0)::double as area from nation where n_nationkey > 0")
def polygon_centroids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("double").alias("w"), (F.col("n_regionkey") + 1.0).alias("h"))
    rows = []
    for r in n.collect():  # 24 boxes
        box = [(0.0, 0.0), (r["w"], 0.0), (r["w"], r["h"]), (0.0, r["h"])]
        rows.append((r["w"], *(float(x) for x in G.centroid(box)), float(G.area(box))))
    return spark.createDataFrame(rows, "width double, cx double, cy double, area double")


@query("select unnest(['leaves hold every point once', 'no leaf holds more than its capacity', 'dense leaves are as wide at most', 'dense leaves are as dense at least']) as rule, true as holds")
def quadtree_rules(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of the quadtree over the bounding points: capacity 1.5 %, margin a tenth."""
    from latticework.operators import hulls

    p = np.unique(np.array(_cloud(spark, d)[0]).reshape(-1, 2), axis=0)
    capacity = max(1, int(0.015 * len(p)))
    boxes = hulls.leaves(p, capacity)
    widths = sorted(b[2] for b in boxes)
    width = widths[len(widths) // 4]
    density = len(p) / sum(b[2] * b[3] for b in boxes)
    rules = [
        ("leaves hold every point once", sum(b[4] for b in boxes) == len(p)), ("no leaf holds more than its capacity", max(b[4] for b in boxes) <= capacity),
        ("dense leaves are as wide at most", all(b[2] <= width and b[4] for b in hulls.dense_leaves(boxes, width=width))), ("dense leaves are as dense at least", all(b[4] / b[2] / b[3] >= density for b in hulls.dense_leaves(boxes, density=density))),
    ]
    return spark.createDataFrame([(r, bool(h)) for r, h in rules], "rule string, holds boolean")


@query("with recursive b as (select n_nationkey as i, (n_nationkey * 7 % 25)::double as x, (n_nationkey * 11 % 13)::double as y from nation), t as (select u.i, v.i as j from b u join b v on u.x <= v.x + 1.5 and v.x <= u.x + 1.5 and u.y <= v.y + 1 and v.y <= u.y + 1), r as (select i, j from t union select r.i, t.j from r join t on r.j = t.i) select i as box, min(j) as cluster from r group by i")
def touching_boxes(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators import hulls

    rows = sorted(r["n_nationkey"] for r in table(spark, d, "nation").select("n_nationkey").collect())  # 25 boxes
    of = hulls.touching([(float(i * 7 % 25), float(i * 11 % 13), 1.5, 1.0) for i in rows])
    first = {c: min(i for i, o in zip(rows, of, strict=True) if o == c) for c in of}
    return spark.createDataFrame([(i, first[c]) for i, c in zip(rows, of, strict=True)], "box long, cluster long")


@query(f"with {L}, p as (select distinct x, y from m where x is not null and y is not null and not isnan(x) and not isnan(y)) select count(*) as n_points, true as corners_are_points, true as within_convex from p")
def hull_rules(spark: SparkSession, d: str) -> DataFrame:
    """The concave hull over all points: its corners are points of the data, and it lies within the convex hull."""
    from latticework.operators import hulls

    p = materialise(_latent(spark, d).select("x", "y").distinct(), "latent")
    corners = [(r["x"], r["y"]) for r in concave_hull(spark, d).orderBy("corner").collect()]
    ring = spark.createDataFrame(corners, "x double, y double")
    found = p.join(F.broadcast(ring), ["x", "y"], "left_semi").count()
    return spark.createDataFrame([(p.count(), found == len(set(corners)), bool(G.area(corners) <= G.area(hulls.convex_hull(np.array(corners))) + 1e-9))], "n_points long, corners_are_points boolean, within_convex boolean")


@query("select r.round::int as round, least(10000, (select count(*) from embeddings)) as n, true as within_bounds from (select unnest(range(4)) as round) r")
def vendi_rules(spark: SparkSession, d: str) -> DataFrame:
    """A score lies between one and the number of rows, and that of the linear kernel below the number of dimensions too."""
    linear = vendi_by_label(spark, d).first()["vendi"]
    return vendi_subsampled(spark, d).select("round", "n", ((F.col("score") >= 1) & (F.col("score") <= F.col("n") + 1e-6) & F.lit(1 <= linear <= 64 + 1e-6)).alias("within_bounds"))
