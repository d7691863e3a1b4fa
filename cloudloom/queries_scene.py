"""Queries of scene and evaluation operators, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import points as P
from .operators import scene as Z
from .operators import tracks as T
from .queries_core import PTS, SEEN, _points, _seen
from .util import table

C = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return add


@query("""WITH i AS (SELECT image_id, scene, qvec q, tvec t, qvec[1]**2+qvec[2]**2+qvec[3]**2+qvec[4]**2 n FROM images WHERE tvec IS NOT NULL AND qvec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY loaded_at)=1),
 c AS (SELECT scene, -((1-2*(q[3]*q[3]+q[4]*q[4])/n)*t[1]+(2*(q[2]*q[3]+q[1]*q[4])/n)*t[2]+(2*(q[2]*q[4]-q[1]*q[3])/n)*t[3]) AS cx,
 -((2*(q[2]*q[3]-q[1]*q[4])/n)*t[1]+(1-2*(q[2]*q[2]+q[4]*q[4])/n)*t[2]+(2*(q[3]*q[4]+q[1]*q[2])/n)*t[3]) AS cy,
 -((2*(q[2]*q[4]+q[1]*q[3])/n)*t[1]+(2*(q[3]*q[4]-q[1]*q[2])/n)*t[2]+(1-2*(q[2]*q[2]+q[3]*q[3])/n)*t[3]) AS cz FROM i WHERE n>0), m AS (SELECT scene, avg(cx) mx, avg(cy) my, avg(cz) mz FROM c GROUP BY scene)
 SELECT scene, round(any_value(mx),4) AS m_cx, round(max(sqrt((cx-mx)**2+(cy-my)**2+(cz-mz)**2))*1.1,4) AS radius FROM c JOIN m USING (scene) GROUP BY scene""")
def f_scene_normalisation(spark, d):
    i = table(spark, d, "images").where(C("tvec").isNotNull() & C("qvec").isNotNull()).groupBy("image_id").agg(F.min(F.struct("loaded_at", "scene", C("qvec").alias("q"), C("tvec").alias("t"))).alias("r")).select("image_id", "r.scene", "r.q", "r.t")
    c = i.select("scene", *[e.alias(n) for e, n in zip(T.camera_centre(C("q"), C("t")), ("cx", "cy", "cz"))]).where(C("cx").isNotNull())
    return Z.normalisation(c, ["scene"]).select("scene", F.round("m_cx", 4).alias("m_cx"), F.round("radius", 4).alias("radius"))


@query(PTS + """ SELECT scene, round(min(x)-(max(x)-min(x))*0.1-0.5,4) AS x_min, round(max(z)+(max(z)-min(z))*0.1+0.5,4) AS z_max FROM pts GROUP BY scene""")
def f_padded_box(spark, d):
    b = Z.pad(P.bounds(_points(spark, d, "scene", "x", "y", "z"), ["scene"]), 0.1, 0.5)
    return b.select("scene", F.round("x_min", 4).alias("x_min"), F.round("z_max", 4).alias("z_max"))


@query("""WITH c AS (SELECT DISTINCT camera_id, model, params FROM cameras) SELECT camera_id, round(params[1],3) AS fx, round(CASE WHEN model IN ('PINHOLE','OPENCV') THEN params[2] ELSE params[1] END,3) AS fy, round(CASE WHEN model IN ('PINHOLE','OPENCV') THEN params[3] ELSE params[2] END,3) AS cx FROM c
 WHERE model IN ('SIMPLE_PINHOLE','SIMPLE_RADIAL','RADIAL','PINHOLE','OPENCV') AND params IS NOT NULL""")
def s_intrinsics(spark, d):
    c = table(spark, d, "cameras").select("camera_id", "model", "params").distinct()
    k = c.select("camera_id", *[F.round(e, 3).alias(n) for e, n in zip(Z.intrinsics(C("model"), C("params")), ("fx", "fy", "cx", "cy"))])
    return k.where(C("fx").isNotNull()).drop("cy")


@query(PTS + """, u AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM pts) SELECT point_id, round(greatest(0.28209479177387814*f_dc_0::DOUBLE-0.4886025119029199*(y/n)*coalesce(f_rest[1]::DOUBLE,0)+0.4886025119029199*(z/n)*coalesce(f_rest[2]::DOUBLE,0)-0.4886025119029199*(x/n)*coalesce(f_rest[3]::DOUBLE,0)+0.5,0),4) AS red FROM u WHERE n > 0""")
def f_harmonics(spark, d):
    n = F.sqrt(C("x") * C("x") + C("y") * C("y") + C("z") * C("z"))
    p = _points(spark, d, "x", "y", "z", "f_dc_0", "f_rest").withColumn("n", n).where("n > 0")
    return p.select("point_id", F.round(Z.harmonics(C("f_dc_0").cast("double"), C("f_rest"), C("x") / C("n"), C("y") / C("n"), C("z") / C("n")), 4).alias("red"))


@query(PTS + """ SELECT scene, round(-10*log10(avg((red/255.0-least(greatest(f_dc_0::DOUBLE*0.28209479177387814+0.5,0),1))**2)),4) AS psnr FROM pts GROUP BY scene""")
def a_psnr(spark, d):
    from .functions.exprs import sh_colour

    p = _points(spark, d, "scene", "red", "f_dc_0")
    return p.groupBy("scene").agg(F.round(Z.psnr(C("red").cast("double") / 255.0, sh_colour(C("f_dc_0").cast("double"))), 4).alias("psnr"))


@query(SEEN + """, l AS (SELECT view_idx, u//32 AS bu, v//32 AS bv, (point_id%5)::BIGINT AS label, round(depth_,6) AS score FROM (SELECT *, pz AS depth_ FROM seen)) SELECT view_idx, bu::BIGINT AS bu, bv::BIGINT AS bv, label FROM l QUALIFY row_number() OVER (PARTITION BY view_idx, bu, bv ORDER BY score DESC, label)=1""")
def w_paint(spark, d):
    s = _seen(spark, d).select("view_idx", F.floor(C("u") / 32).alias("bu"), F.floor(C("v") / 32).alias("bv"), (C("point_id") % 5).alias("label"), F.round("depth", 6).alias("score"))
    return Z.paint(s, ["view_idx", "bu", "bv"], "label", "score")


@query("""SELECT series, max(regexp_extract(file_path,'iteration_(\\d+)',1)::INTEGER) AS iteration, count(DISTINCT file_id)::BIGINT AS n_files FROM ply_files GROUP BY series""")
def s_latest_iteration(spark, d):
    f = table(spark, d, "ply_files")
    return f.groupBy("series").agg(F.max(F.regexp_extract("file_path", r"iteration_(\d+)", 1).try_cast("int")).alias("iteration"), F.countDistinct("file_id").alias("n_files"))


@query(SEEN + """, g AS (SELECT view_idx, count(*) FILTER (WHERE point_id%3=0 AND u%2=0) AS i, count(*) FILTER (WHERE point_id%3=0 OR u%2=0) AS un FROM seen GROUP BY view_idx), f AS (SELECT view_idx, CASE WHEN un>0 THEN i::DOUBLE/un ELSE 0 END AS iou FROM g)
 SELECT round(avg(iou),6) AS mean_iou, round(avg((iou>0.25)::INT),6) AS acc_25, round(avg((iou>0.5)::INT),6) AS acc_50, count(*)::BIGINT AS n FROM f""")
def a_image_iou(spark, d):
    a, b = C("point_id") % 3 == 0, C("u") % 2 == 0
    g = _seen(spark, d).groupBy("view_idx").agg(F.count_if(a & b).alias("i"), F.count_if(a | b).alias("un"))
    f = g.select(F.when(C("un") > 0, C("i") / C("un")).otherwise(0.0).alias("iou"))
    return f.agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg((C("iou") > 0.25).cast("int")), 6).alias("acc_25"), F.round(F.avg((C("iou") > 0.5).cast("int")), 6).alias("acc_50"), F.count("*").alias("n"))


@query(SEEN + """, m AS (SELECT view_idx, ((u//64)+2*(v//64))%32 AS mask_id, count(*) AS n, var_pop(f_dc_0::DOUBLE) AS va FROM seen JOIN pts USING (point_id) GROUP BY ALL), x AS (SELECT *, max(n) OVER (PARTITION BY view_idx) AS most FROM m)
 SELECT view_idx, mask_id::INT AS mask_id, n::BIGINT AS n FROM x WHERE va <= 0.006 OR n > 0.8*most""")
def p_steady_masks(spark, d):
    mask = F.pmod(F.floor(C("u") / 64) + 2 * F.floor(C("v") / 64), F.lit(32)).cast("int").alias("mask_id")
    s = _seen(spark, d, "f_dc_0").select("view_idx", mask, C("f_dc_0").cast("double").alias("c")).groupBy("view_idx", "mask_id").agg(F.count("*").alias("n"), F.var_pop("c").alias("var"))
    return Z.steady_masks(s, ["view_idx"]).drop("var")


@query(r"""SELECT annotation_id, CASE WHEN regexp_matches(p,'^[A-Za-z]:/') THEN '/mnt/'||lower(p[1])||substr(p,3) ELSE p END AS path, 'a photo of '||w||'.' AS prompt,
 (CASE WHEN regexp_matches(w,'facade|roof') THEN 1 WHEN regexp_matches(w,'scaffold|pave') THEN 2 WHEN regexp_matches(w,'o') THEN 3 ELSE 0 END)::INT AS rule FROM (SELECT DISTINCT annotation_id, replace(mask_path,'\','/') AS p, lower(trim(label)) AS w FROM mask_labels)""")
def f_paths_phrases(spark, d):
    from .functions import exprs as X

    m = table(spark, d, "mask_labels").select("annotation_id", F.translate("mask_path", "\\", "/").alias("p"), F.lower(F.trim("label")).alias("w")).distinct()
    rules = [("facade|roof", 1), ("scaffold|pave", 2), ("o", 3)]
    return m.select("annotation_id", X.drive_path(C("p")).alias("path"), X.fill("a photo of {label}.", C("w")).alias("prompt"), X.phrase_id(C("w"), rules).alias("rule"))


@query(PTS + """, l AS (SELECT point_id%50 AS leaf, 1/(1+exp(-coalesce(opacity,0)::DOUBLE)) AS w, (f_dc_0 > 0) AS hit FROM pts)
 SELECT leaf, round(sum(CASE WHEN hit THEN w ELSE 0 END)/(sum(hit::INT)+1e-6),5) AS score, sum(hit::INT)::BIGINT AS n FROM l GROUP BY leaf""")
def a_leaf_score(spark, d):
    from .functions.exprs import sigmoid

    l = _points(spark, d, "opacity", "f_dc_0").select((C("point_id") % 50).alias("leaf"), sigmoid(F.coalesce("opacity", F.lit(0)).cast("double")).alias("w"), (C("f_dc_0") > 0).alias("hit"))
    return Z.leaf_scores(l, "leaf", "w", "hit")


@query("""WITH l AS (SELECT DISTINCT annotation_id, view_name, lower(trim(label)) AS prompt FROM mask_labels WHERE view_name IS NOT NULL AND label IS NOT NULL AND trim(label)<>''), s AS (SELECT view_name, prompt, count(*) AS n FROM l GROUP BY ALL) SELECT view_name, prompt, n::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY view_name ORDER BY n DESC, prompt)=1""")
def a_best_prompt(spark, d):
    l = table(spark, d, "mask_labels").where(C("view_name").isNotNull() & (F.length(F.trim("label")) > 0)).select("annotation_id", "view_name", F.lower(F.trim("label")).alias("prompt")).distinct()
    s = l.groupBy("view_name", "prompt").agg(F.count("*").alias("n"))
    best = s.groupBy("view_name").agg(F.min(F.struct((-C("n")).alias("k"), "prompt")).alias("b"))
    return best.select("view_name", C("b.prompt").alias("prompt"), (-C("b.k")).alias("score"))
