"""Queries of the core operators over the project's tables, with independent SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import points as P
from .operators import spatial as S
from .operators import tracks as T
from .operators import views as V
from .operators import voxels as B
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


def _r(c, n=4):
    return F.round(c, n)


def _points(spark, d, *cols):
    """The columns ``cols`` of the points, once per key: of repeated rows the one loaded first, ties going to the smaller values (a
    shorter f_rest before a longer, as in PTS). Coordinates as doubles. Only these columns and the time are scanned."""
    p = table(spark, d, "points").where(C("point_id").isNotNull())
    late = F.coalesce("loaded_at", F.lit("9999-01-01").cast("timestamp")).alias("_at")
    first = [c for c in cols if c == "f_rest"] + [c for c in cols if c != "f_rest"]
    one = p.groupBy("point_id").agg(F.min(F.struct(late, *[F.coalesce(c, F.array().cast("array<float>")).alias(c) if c == "f_rest" else c for c in first])).alias("r"))
    return one.select("point_id", *[C(f"r.{c}").cast("double").alias(c) if c in ("x", "y", "z") else C(f"r.{c}") for c in cols])


#: Points once per key in SQL.
PTS = """WITH pts AS (SELECT * REPLACE (x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z) FROM points WHERE point_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY loaded_at, coalesce(f_rest,[])) = 1)"""


@query(PTS + """ SELECT point_id, round(1/(1+exp(-opacity::DOUBLE)),4) AS alpha, round(exp(greatest(scale_0,scale_1,scale_2)::DOUBLE),4) AS size,
 round((1/(1+exp(-opacity::DOUBLE)))/(1+exp(greatest(scale_0,scale_1,scale_2)::DOUBLE)),4) AS quality FROM pts""")
def f_activation(spark, d):
    o, s = C("opacity").cast("double"), [C(f"scale_{i}").cast("double") for i in range(3)]
    return _points(spark, d, "opacity", "scale_0", "scale_1", "scale_2").select("point_id", _r(X.sigmoid(o)).alias("alpha"), _r(F.exp(F.greatest(*s))).alias("size"), _r(X.quality(o, *s)).alias("quality"))


@query(PTS + """, f AS (SELECT point_id, list_transform(ins_feat, lambda x: x::DOUBLE) AS v FROM pts WHERE len(ins_feat)=6 AND len(list_filter(ins_feat, lambda x: x IS NULL OR NOT isfinite(x)))=0)
 SELECT point_id, round(sqrt(list_sum(list_transform(v, lambda x: x*x))),4) AS norm, round(v[1]/CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x*x)))<1e-8 THEN 1 ELSE sqrt(list_sum(list_transform(v, lambda x: x*x))) END,4) AS unit_0,
 round(list_sum(list_transform(v, lambda x: abs(x-0.5))),4) AS l1, round(sqrt(list_sum(list_transform(v, lambda x: (x-0.5)*(x-0.5)))),4) AS l2 FROM f""")
def f_vectors(spark, d):
    ok = (F.size("ins_feat") == 6) & F.forall("ins_feat", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    half = F.array_repeat(F.lit(0.5), 6)
    f = C("ins_feat")
    return _points(spark, d, "ins_feat").where(ok).select("point_id", _r(X.norm(f)).alias("norm"), _r(X.normalise(f)[0]).alias("unit_0"), _r(X.l1(f, half)).alias("l1"), _r(X.l2(f, half)).alias("l2"))


@query(PTS + """ , q AS (SELECT point_id, rot_0::DOUBLE/n AS w, rot_1::DOUBLE/n AS x, rot_2::DOUBLE/n AS y, rot_3::DOUBLE/n AS z, exp(2*scale_0::DOUBLE) AS a, exp(2*scale_1::DOUBLE) AS b, exp(2*scale_2::DOUBLE) AS c
 FROM (SELECT *, sqrt(rot_0::DOUBLE*rot_0+rot_1::DOUBLE*rot_1+rot_2::DOUBLE*rot_2+rot_3::DOUBLE*rot_3) AS n FROM pts) WHERE n > 0)
 SELECT point_id, round(1-2*(y*y+z*z),4) AS r00, round(2*(x*y-w*z),4) AS r01, round((1-2*(y*y+z*z))*(1-2*(y*y+z*z))*a+(2*(x*y-w*z))*(2*(x*y-w*z))*b+(2*(x*z+w*y))*(2*(x*z+w*y))*c,4) AS cov_xx FROM q""")
def f_rotation_covariance(spark, d):
    r = X.rotation(*[C(f"rot_{i}").cast("double") for i in range(4)])
    cov = X.covariance(r, [F.exp(C(f"scale_{i}").cast("double")) for i in range(3)])
    return _points(spark, d, "rot_0", "rot_1", "rot_2", "rot_3", "scale_0", "scale_1", "scale_2").select("point_id", _r(r[0]).alias("r00"), _r(r[1]).alias("r01"), _r(cov[0]).alias("cov_xx")).where(C("r00").isNotNull())


@query(PTS + """ SELECT point_id, round(least(greatest(f_dc_0::DOUBLE*0.28209479177387814+0.5,0),1),4) AS r, CASE WHEN scale_0<=scale_1 AND scale_0<=scale_2 THEN 0 WHEN scale_1<=scale_2 THEN 1 ELSE 2 END AS normal_axis,
 ((point_id*53+29)%256)::INTEGER AS pal_r FROM pts""")
def f_colours(spark, d):
    axis = F.when((C("scale_0") <= C("scale_1")) & (C("scale_0") <= C("scale_2")), 0).when(C("scale_1") <= C("scale_2"), 1).otherwise(2)
    pal = F.pmod(C("point_id") * 53 + 29, F.lit(256)).cast("int")
    return _points(spark, d, "f_dc_0", "scale_0", "scale_1", "scale_2").select("point_id", _r(X.sh_colour(C("f_dc_0").cast("double"))).alias("r"), axis.alias("normal_axis"), pal.alias("pal_r"))


@query("""SELECT DISTINCT view_idx, coalesce(nullif(regexp_replace(regexp_replace(trim(name),'[^0-9A-Za-z._-]+','_','g'),'^_+|_+$','','g'),''),'unnamed') AS safe, regexp_replace(name,'\\.[^.]*$','') AS stem,
 round(2*atan(width/(2*fx)),6) AS fov_x FROM camera_views""")
def f_names_fov(spark, d):
    v = table(spark, d, "camera_views")
    return v.select("view_idx", X.safe_name(C("name")).alias("safe"), X.stem(C("name")).alias("stem"), _r(X.fov(C("fx"), C("width")), 6).alias("fov_x")).distinct()


@query(PTS + """ SELECT count(*)::BIGINT AS n, sum(point_id)::BIGINT AS ids FROM pts WHERE coalesce(1/(1+exp(-opacity::DOUBLE)),1) > 0.05 AND greatest(scale_0,scale_1,scale_2) < 2.0 GROUP BY scene""")
def p_filter_opaque(spark, d):
    return P.opaque(_points(spark, d, "scene", "opacity", "scale_0", "scale_1", "scale_2")).groupBy("scene").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids")).drop("scene")


@query(PTS + """, l AS (SELECT scene, min(x) a, max(x) b, min(z) c, max(z) e FROM pts GROUP BY scene) SELECT point_id, round((x-a)/CASE WHEN b-a<1e-8 THEN 1 ELSE b-a END,4) AS x, round((z-c)/CASE WHEN e-c<1e-8 THEN 1 ELSE e-c END,4) AS z FROM pts JOIN l USING (scene)""")
def f_min_max(spark, d):
    return P.min_max(_points(spark, d, "scene", "x", "z").select("point_id", "scene", "x", "z"), ["x", "z"], ["scene"]).select("point_id", _r(C("x")).alias("x"), _r(C("z")).alias("z"))


@query(PTS + """ SELECT scene, count(*)::BIGINT AS n, min(x) AS x_min, max(x) AS x_max, (min(x)+max(x))/2 AS x_mid, min(z) AS z_min, max(z) AS z_max FROM pts GROUP BY scene""")
def a_bounds(spark, d):
    return P.bounds(_points(spark, d, "scene", "x", "y", "z"), ["scene"]).select("scene", "n", "x_min", "x_max", "x_mid", "z_min", "z_max")


@query(PTS + """, b AS (SELECT scene, min(x) xa, max(x) xb, min(y) ya, max(y) yb, min(z) za, max(z) zb FROM pts GROUP BY scene) SELECT point_id FROM pts JOIN b USING (scene)
 WHERE abs(x-(xa+xb)/2) <= (xb-xa)/2*0.5 AND abs(y-(ya+yb)/2) <= (yb-ya)/2*0.5 AND abs(z-(za+zb)/2) <= (zb-za)/2*1.0""")
def p_centre_crop(spark, d):
    return P.centre_crop(_points(spark, d, "scene", "x", "y", "z"), ["scene"]).select("point_id")


@query(PTS + """, b AS (SELECT scene, (min(x)+max(x))/2 xm, (min(y)+max(y))/2 ym FROM pts GROUP BY scene) SELECT scene, (x>xm)::INT+2*(y>ym)::INT AS quarter, count(*)::BIGINT AS n FROM pts JOIN b USING (scene) GROUP BY ALL""")
def p_quarters(spark, d):
    return P.quarters(_points(spark, d, "scene", "x", "y", "z"), ["scene"]).groupBy("scene", "quarter").agg(F.count("*").alias("n"))


@query(PTS + """ SELECT min(point_id) AS point_id, count(*)::BIGINT AS n FROM pts GROUP BY scene, floor(x/2.0), floor(y/2.0), floor(z/2.0)""")
def p_first_in_cell(spark, d):
    return P.first_in_cell(_points(spark, d, "scene", "x", "y", "z"), "point_id", ["scene"], 2.0).select("point_id", "n")


@query(PTS + """ SELECT point_id FROM pts QUALIFY (row_number() OVER (PARTITION BY scene ORDER BY point_id)-1)%8=0""")
def p_every_nth(spark, d):
    return P.every_nth(_points(spark, d, "scene").select("point_id", "scene"), "point_id", ["scene"], 8)[["point_id"]]


@query(PTS + """, s AS (SELECT point_id, scene, coalesce(opacity,0)::DOUBLE AS o, count(*) OVER (PARTITION BY scene) AS n FROM pts) SELECT point_id FROM s
 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY o DESC, point_id) <= least(greatest(round_even(n*0.3,0),50),least(n,20000))""")
def p_core_points(spark, d):
    return P.core_points(_points(spark, d, "scene", "opacity").select("point_id", "scene", "opacity"), "point_id", ["scene"], F.coalesce(C("opacity"), F.lit(0)).cast("double"), least=50).select("point_id")


def _views(spark, d):
    """Views once per key: of repeated rows the least by name, then by the other columns."""
    v = table(spark, d, "camera_views").where(C("view_idx").isNotNull())
    return v.groupBy("view_idx").agg(F.min(F.struct("name", *[c for c in v.columns if c not in ("view_idx", "name")])).alias("r")).select("view_idx", "r.*")


@query()
def p_view_stride(spark, d):
    """Every second view of each scene in the order of its list (the reference's vote_stride, an option of voting and fusing alone)."""
    return P.every_nth(_views(spark, d).select("view_idx", "scene"), "view_idx", ["scene"], 2)[["view_idx"]]


#: A mask is an 8 x 8 pixel checker of eight labels.
SEEN = PTS + """, vw AS (SELECT *, coalesce(fx,width) AS gx, coalesce(fy,width) AS gy, coalesce(cx,width/2) AS hx, coalesce(cy,height/2) AS hy FROM camera_views QUALIFY row_number() OVER (PARTITION BY view_idx ORDER BY name)=1),
 cam AS (SELECT v.*, p.point_id, w2c[1]*x+w2c[2]*y+w2c[3]*z+w2c[4] AS px, w2c[5]*x+w2c[6]*y+w2c[7]*z+w2c[8] AS py, w2c[9]*x+w2c[10]*y+w2c[11]*z+w2c[12] AS pz FROM pts p JOIN vw v USING (scene)),
 uv AS (SELECT view_idx, point_id, pz, width, height, projection_mode='orthographic' AS ortho, CASE WHEN projection_mode='orthographic' THEN round_even((px-ortho_x_min)/(CASE WHEN ortho_x_max>ortho_x_min THEN ortho_x_max-ortho_x_min END)*(width-1),0) ELSE round_even(gx*px/pz+hx,0) END AS u,
 CASE WHEN projection_mode='orthographic' THEN round_even((ortho_y_max-py)/(CASE WHEN ortho_y_max>ortho_y_min THEN ortho_y_max-ortho_y_min END)*(height-1),0) ELSE round_even(gy*py/pz+hy,0) END AS v FROM cam WHERE pz > 1e-6),
 seen AS (SELECT view_idx, point_id, u::INT AS u, v::INT AS v, pz FROM uv WHERE u>=0 AND u<width AND v>=0 AND v<height QUALIFY ortho OR row_number() OVER (PARTITION BY view_idx, u, v, ortho ORDER BY pz, point_id)=1)"""


def _seen(spark, d, *cols, each=None):
    """Visible points of each view, with their columns ``cols``, or what ``each`` makes of a view."""
    return V.visible(_points(spark, d, "scene", "x", "y", "z", *cols), _views(spark, d), cols, each=each)


@query(SEEN + " SELECT view_idx, count(*)::BIGINT AS n, sum(point_id)::BIGINT AS ids, sum(u)::BIGINT AS us, sum(v)::BIGINT AS vs FROM seen GROUP BY view_idx")
def j_project_zbuffer(spark, d):
    return _seen(spark, d).groupBy("view_idx").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"), F.sum("u").alias("us"), F.sum("v").alias("vs"))


@query(SEEN + """, vt AS (SELECT s.point_id%16 AS cluster, ((u//8)+2*(v//8))%8 AS mask_id, count(*) AS n, min(view_idx) AS fv FROM seen s GROUP BY 1,2), rk AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS total, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, fv, mask_id) AS r FROM vt)
 SELECT cluster, max(total)::BIGINT AS total, max(CASE WHEN r=1 THEN mask_id END)::INT AS top1, round(max(CASE WHEN r=1 THEN n::DOUBLE/total END),6) AS top1_ratio, coalesce(max(CASE WHEN r=2 THEN mask_id END),-1)::INT AS top2, round(sum(-(n::DOUBLE/total)*ln(n::DOUBLE/total)),6) AS entropy,
 CASE WHEN max(total)>=20 AND max(CASE WHEN r=1 THEN n::DOUBLE/total END)>=0.15 THEN max(CASE WHEN r=1 THEN mask_id END) ELSE 255 END::INT AS label FROM rk GROUP BY cluster""")
def a_votes(spark, d):
    mask = F.pmod(F.floor(C("u") / 8) + 2 * F.floor(C("v") / 8), F.lit(8)).cast("int")
    clusters = _points(spark, d).select("point_id", (C("point_id") % 16).alias("cluster"))
    s = V.vote_stats(V.votes(_seen(spark, d), clusters, mask), 20, 0.15)
    return s.select("cluster", "total", "top1", _r("top1_ratio", 6).alias("top1_ratio"), "top2", _r("entropy", 6).alias("entropy"), "label")


CENTRES = [[(-1.0) ** (k >> j & 1) * 0.5 for j in range(3)] for k in range(8)]


@query(PTS + """, c AS (SELECT k, unnest([{'j':0}]) AS t, (CASE WHEN k&1=1 THEN -0.5 ELSE 0.5 END) AS a, (CASE WHEN (k>>1)&1=1 THEN -0.5 ELSE 0.5 END) AS b, (CASE WHEN (k>>2)&1=1 THEN -0.5 ELSE 0.5 END) AS e FROM range(8) r(k)),
 ds AS (SELECT point_id, k, sqrt((f_dc_0::DOUBLE-a)*(f_dc_0::DOUBLE-a)+(f_dc_1::DOUBLE-b)*(f_dc_1::DOUBLE-b)+(f_dc_2::DOUBLE-e)*(f_dc_2::DOUBLE-e)) AS dist FROM pts, c)
 SELECT point_id, k::INT AS code, round(dist,4) AS dist FROM ds QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, k)=1""")
def j_nearest_centre(spark, d):
    return S.nearest_centre(_points(spark, d, "f_dc_0", "f_dc_1", "f_dc_2").select("point_id", "f_dc_0", "f_dc_1", "f_dc_2"), CENTRES, ["f_dc_0", "f_dc_1", "f_dc_2"]).select("point_id", "code", _r("dist").alias("dist"))


@query()
def g_codebook(spark, d):
    cols = ["f_dc_0", "f_dc_1", "f_dc_2"]
    p = _points(spark, d, "f_dc_0", "f_dc_1", "f_dc_2").select("point_id", *cols)
    return S.nearest_centre(p, S.lloyd(p, CENTRES, cols), cols).groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 3).alias("mean_dist"))


SP = """WITH sp AS (SELECT * FROM sparse_points WHERE point3d_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point3d_id ORDER BY loaded_at)=1)"""


def _sparse(spark, d, *cols):
    """Sparse points once per key: the row loaded first, ties going to the smaller values. ``cols``: only these columns, which are the
    first of the ordered ones, so that the same row is taken."""
    s = table(spark, d, "sparse_points").where(C("point3d_id").isNotNull())
    return s.groupBy("point3d_id").agg(F.min(F.struct("loaded_at", *(cols or ("scene", "x", "y", "z", "error", "track")))).alias("r")).select("point3d_id", "r.*").drop("loaded_at")


@query(SP + """, e AS (SELECT scene, floor(x/10)::BIGINT AS tx, floor(y/10)::BIGINT AS ty, unnest(track).image_id AS image_id FROM sp), n AS (SELECT scene, tx, ty, image_id, count(*) AS n FROM e GROUP BY ALL)
 SELECT scene, tx, ty, image_id, n::BIGINT AS n, row_number() OVER (PARTITION BY scene, tx, ty ORDER BY n DESC, image_id)::INT AS rank FROM n QUALIFY rank <= 5""")
def w_tile_support(spark, d):
    s = _sparse(spark, d)
    tile = [C("scene"), F.floor(C("x") / 10).alias("tx"), F.floor(C("y") / 10).alias("ty")]
    return T.tile_support(s, T.edges(s), tile, 5)


@query("""WITH b AS (SELECT scene, min(x)+(max(x)-min(x))*0.25 xa, max(x)-(max(x)-min(x))*0.25 xb, min(y)+(max(y)-min(y))*0.25 ya, max(y)-(max(y)-min(y))*0.25 yb, min(z) za, max(z) zb FROM sparse_points GROUP BY scene)
 SELECT scene, count(DISTINCT point3d_id)::BIGINT AS n FROM sparse_points JOIN b USING (scene) WHERE x BETWEEN xa AND xb AND y BETWEEN ya AND yb AND z BETWEEN za AND zb GROUP BY scene""")
def j_box(spark, d):
    s = table(spark, d, "sparse_points").select("point3d_id", "scene", "x", "y", "z")
    b = s.groupBy("scene").agg(*[F.min(a).alias(f"{a}0") for a in "xyz"], *[F.max(a).alias(f"{a}1") for a in "xyz"])
    cut_ = {"x": 0.25, "y": 0.25, "z": 0.0}
    box = b.select("scene", *[(C(f"{a}0") + (C(f"{a}1") - C(f"{a}0")) * k).alias(f"{a}_min") for a, k in cut_.items()], *[(C(f"{a}1") - (C(f"{a}1") - C(f"{a}0")) * k).alias(f"{a}_max") for a, k in cut_.items()])
    return S.box_join(s, box, ["scene"], 10.0).groupBy("scene").agg(F.countDistinct("point3d_id").alias("n"))


@query("""WITH i AS (SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY loaded_at)=1), o AS (SELECT image_id, unnest(points2d).point3d_id AS p FROM i), k AS (SELECT DISTINCT point3d_id FROM sparse_points WHERE len(track) >= 3)
 SELECT image_id, count(*)::BIGINT AS n, sum(CASE WHEN k.point3d_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS dropped FROM o LEFT JOIN k ON o.p=k.point3d_id GROUP BY image_id""")
def j_drop_unseen(spark, d):
    i = table(spark, d, "images").groupBy("image_id").agg(F.min(F.struct("loaded_at", "points2d"))["points2d"].alias("points2d"))
    kept = table(spark, d, "sparse_points").where(F.size("track") >= 3)
    return T.drop_unseen(i, kept).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(C("point3d_id") == -1).alias("dropped"))


@query("""WITH i AS (SELECT image_id, scene, qvec q, tvec t, sqrt(qvec[1]*qvec[1]+qvec[2]*qvec[2]+qvec[3]*qvec[3]+qvec[4]*qvec[4]) n FROM images WHERE tvec IS NOT NULL AND qvec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY loaded_at)=1),
 c AS (SELECT image_id, scene, -((1-2*(q[3]*q[3]+q[4]*q[4])/(n*n))*t[1]+(2*(q[2]*q[3]+q[1]*q[4])/(n*n))*t[2]+(2*(q[2]*q[4]-q[1]*q[3])/(n*n))*t[3]) AS cx FROM i WHERE n > 0) SELECT image_id, round(cx,4) AS cx, round(cx-avg(cx) OVER (PARTITION BY scene),4) AS dx FROM c""")
def f_camera_centre(spark, d):
    i = table(spark, d, "images").where(C("tvec").isNotNull() & C("qvec").isNotNull()).groupBy("image_id").agg(F.min(F.struct("loaded_at", "scene", C("qvec").alias("q"), C("tvec").alias("t"))).alias("r")).select("image_id", "r.scene", "r.q", "r.t")
    c = i.select("image_id", "scene", T.camera_centre(C("q"), C("t"))[0].alias("cx")).where(C("cx").isNotNull())
    mean = c.groupBy("scene").agg(F.avg("cx").alias("m"))
    return c.join(mean, "scene").select("image_id", _r("cx").alias("cx"), _r(C("cx") - C("m")).alias("dx"))


@query("""WITH i AS (SELECT DISTINCT image_id, camera_id, scene FROM images), c AS (SELECT DISTINCT camera_id, model, width, height FROM cameras) SELECT i.scene, model, count(*)::BIGINT AS n_images, sum(width*height)::BIGINT AS pixels FROM i JOIN c USING (camera_id) GROUP BY ALL""")
def j_image_camera(spark, d):
    i = table(spark, d, "images").select("image_id", "camera_id", "scene").distinct()
    c = table(spark, d, "cameras").select("camera_id", "model", "width", "height").distinct()
    return i.join(c, "camera_id").groupBy("scene", "model").agg(F.count("*").alias("n_images"), F.sum(C("width") * C("height")).alias("pixels"))


@query(PTS + """, l AS (SELECT point_id, scene, point_id%7 AS gt, CASE WHEN f_dc_0 > 0 THEN point_id%7 ELSE (point_id//3)%7 END AS pr FROM pts), f AS (SELECT * FROM l WHERE gt<>0), cls AS (SELECT scene, gt AS cls, count(*) nt, sum((gt=pr)::INT) hit FROM f GROUP BY ALL), g AS (SELECT scene, pr AS cls, count(*) ng FROM f GROUP BY ALL)
 SELECT scene, cls, hit::BIGINT AS hit, (nt+coalesce(ng,0)-hit)::BIGINT AS union_n, round(hit::DOUBLE/(nt+coalesce(ng,0)-hit),6) AS iou, round(hit::DOUBLE/nt,6) AS acc FROM cls LEFT JOIN g USING (scene, cls)""")
def a_confusion(spark, d):
    gt = C("point_id") % 7
    l = _points(spark, d, "scene", "f_dc_0").select("scene", gt.alias("gt"), F.when(C("f_dc_0") > 0, gt).otherwise(F.floor(C("point_id") / 3) % 7).alias("pr"))
    return T.confusion(l, "gt", "pr", ["scene"]).select("scene", "cls", "hit", "union_n", _r("iou", 6).alias("iou"), _r("acc", 6).alias("acc"))


@query(PTS + """, l AS (SELECT point_id, floor(x/10)::BIGINT AS a, floor(z/10)::BIGINT AS b FROM pts), i AS (SELECT a,b,count(*) n FROM l GROUP BY ALL), na AS (SELECT a,count(*) n FROM l GROUP BY a), nb AS (SELECT b,count(*) n FROM l GROUP BY b) SELECT i.a, i.b, i.n::BIGINT AS inter, round(i.n::DOUBLE/(na.n+nb.n-i.n),6) AS iou FROM i JOIN na ON i.a=na.a JOIN nb ON i.b=nb.b""")
def j_set_overlap(spark, d):
    l = _points(spark, d, "x", "z").select("point_id", F.floor(C("x") / 10).alias("a"), F.floor(C("z") / 10).alias("b"))
    return T.set_overlap(l, "a", "b", "point_id").select("a", "b", "inter", _r("iou", 6).alias("iou"))


VOX = PTS + """, vx AS (SELECT scene, floor(x/4.0)::INT AS i, floor(y/4.0)::INT AS j, floor(z/4.0)::INT AS k, sum(1) AS w FROM pts GROUP BY ALL)"""


def _voxels(spark, d):
    return B.occupancy(_points(spark, d, "scene", "x", "y", "z"), ["scene"], 4.0, F.lit(1.0))


@query(VOX + """, t AS (SELECT scene, quantile_cont(w,0.55) AS q FROM vx GROUP BY scene) SELECT scene, count(*)::BIGINT AS n, sum(w)::DOUBLE AS w FROM vx JOIN t USING (scene) WHERE w >= q GROUP BY scene""")
def a_voxel_quantile(spark, d):
    return B.dense(_voxels(spark, d), ["scene"], 0.55).groupBy("scene").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query(VOX + """, f AS (SELECT vx.*, q.dx, q.dy, q.dz FROM vx, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) q(dx,dy,dz)) SELECT scene, dx, dy, dz, count(*)::BIGINT AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM vx o WHERE o.scene=f.scene AND o.i=f.i+dx AND o.j=f.j+dy AND o.k=f.k+dz) GROUP BY ALL""")
def g_exposed_faces(spark, d):
    return B.exposed_faces(_voxels(spark, d), ["scene"]).groupBy("scene", "dx", "dy", "dz").agg(F.count("*").alias("n"))


@query(VOX + """ SELECT scene, i, j, k FROM vx WHERE (SELECT count(*) FROM vx o WHERE o.scene=vx.scene AND abs(o.i-vx.i)+abs(o.j-vx.j)+abs(o.k-vx.k)=1) = 6""")
def g_erode(spark, d):
    return B.erode(_voxels(spark, d), ["scene"])


@query(PTS + """, s AS (SELECT scene, point_id%9 AS inst, floor(x/3.0)::BIGINT AS cx, floor(y/3.0)::BIGINT AS cy FROM pts WHERE point_id%9>0), z AS (SELECT scene, inst, count(*) AS size FROM s GROUP BY ALL), c AS (SELECT DISTINCT * FROM s)
 SELECT scene, cx, cy, inst AS owner FROM c JOIN z USING (scene, inst) QUALIFY row_number() OVER (PARTITION BY scene, cx, cy ORDER BY size DESC, inst)=1""")
def w_column_owner(spark, d):
    return S.column_owner(_points(spark, d, "scene", "x", "y", "z").withColumn("inst", C("point_id") % 9), ["scene"], "inst", 3.0)


@query(PTS + """, l AS (SELECT point_id, scene, point_id%97 AS inst FROM pts), k AS (SELECT scene, inst, dense_rank() OVER (PARTITION BY scene ORDER BY inst) AS r FROM (SELECT scene, inst FROM l GROUP BY ALL HAVING count(*)>=10)) SELECT point_id, coalesce(r,0)::INT AS new_label FROM l LEFT JOIN k USING (scene, inst)""")
def w_relabel(spark, d):
    return S.relabel(_points(spark, d, "scene").select("point_id", "scene", (C("point_id") % 97).alias("inst")), "inst", 10, ["scene"]).select("point_id", "new_label")


@query("""WITH p AS (SELECT point3d_id a, scene, x, y, z FROM sparse_points WHERE point3d_id IS NOT NULL AND x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point3d_id ORDER BY loaded_at)=1) SELECT p.a, q.a AS b, round(sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2),4) AS dist FROM p JOIN p q ON p.scene=q.scene AND p.a<q.a WHERE sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)<=1.0""")
def j_within_radius(spark, d):
    return S.within(_sparse(spark, d), "point3d_id", ["scene"], 1.0).select("a", "b", _r("dist").alias("dist"))


@query()
def g_dbscan(spark, d):
    return S.dbscan(_sparse(spark, d), "point3d_id", ["scene"], 2.0, 4)


@query()
def g_components(spark, d):
    s = _sparse(spark, d)
    return S.components(s.select(C("point3d_id").alias("node")), S.within(s, "point3d_id", ["scene"], 1.5))


@query()
def r_composite(spark, d):
    """Splat centres of each pixel block of a view, blended front to back."""
    p = _points(spark, d, "scene", "x", "y", "z", "opacity", "f_dc_0")
    p = p.withColumns({"alpha": X.sigmoid(F.coalesce("opacity", F.lit(0)).cast("double")), "red": X.sh_colour(C("f_dc_0").cast("double"))})
    views = _views(spark, d)
    blend, pick = B.blender(16, "point_id", "alpha", "red")
    return V.visible(p, views, ("alpha", "red"), each=(blend, f"view_idx {dict(views.dtypes)['view_idx']}, bu bigint, bv bigint, red double, light double"), pick=pick)


@query("""WITH l AS (SELECT DISTINCT annotation_id, trim(lower(label)) AS w FROM mask_labels) SELECT coalesce(c.id, 255)::INT AS id, count(*)::BIGINT AS n FROM l LEFT JOIN (SELECT id, lower(label) AS w FROM id2label) c USING (w) GROUP BY 1""")
def f_label_ids(spark, d):
    l = table(spark, d, "mask_labels").select("annotation_id", F.trim(F.lower("label")).alias("w")).distinct()
    c = table(spark, d, "id2label").select("id", F.lower("label").alias("w"))
    return l.join(c, "w", "left").groupBy(F.coalesce("id", F.lit(255)).alias("id")).agg(F.count("*").alias("n"))
