"""Queries of expressions, subsets, camera placement, voxels and meshes, and of scenes out of sparse models, with independent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import geometry as G
from .operators import points as P
from .operators import rasters as R
from .operators import scene as Z
from .operators import voxels as B
from .queries_core import PTS, VOX, _points, _sparse, _voxels
from .sources import scenes
from .util import cut, shared_folder, table

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


FEAT = PTS + """, f AS (SELECT point_id, scene, x, y, z, list_transform(ins_feat, lambda x: x::DOUBLE) AS v, opacity, scale_0, scale_1, scale_2 FROM pts WHERE len(ins_feat)=6 AND len(list_filter(ins_feat, lambda x: x IS NULL OR NOT isfinite(x)))=0)"""


def _featured(spark, d, *cols):
    ok = (F.size("ins_feat") == 6) & F.forall("ins_feat", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _points(spark, d, "scene", "x", "y", "z", "ins_feat", *cols).where(ok)


@query(FEAT + """, l AS (SELECT scene, min(v[1]) a, max(v[1]) b, min(z) c, max(z) e FROM f GROUP BY scene) SELECT point_id, round((v[1]-a)/CASE WHEN b-a<1e-8 THEN 1 ELSE b-a END*0.5,4) AS first, round((z-c)/CASE WHEN (e-c)*0.1<1e-8 THEN 1 ELSE e-c END*2.0,4) AS last FROM f JOIN l USING (scene)""")
def f_feature_space(spark, d):
    s = P.feature_space(_featured(spark, d), ["scene"], "ins_feat", 6, 0.5, 2.0, 0.1)
    return s.select("point_id", _r(C("space")[0]).alias("first"), _r(C("space")[8]).alias("last"))


@query(PTS + """, q AS (SELECT point_id, rot_0::DOUBLE*rot_0+rot_1::DOUBLE*rot_1+rot_2::DOUBLE*rot_2+rot_3::DOUBLE*rot_3 AS n, rot_0::DOUBLE AS w, rot_1::DOUBLE AS x, rot_3::DOUBLE AS z FROM pts)
 SELECT point_id, round(w*w/n,4) AS ww, round(w*x/n,4) AS wx, round(x*z/n,4) AS xz FROM q WHERE n > 0""")
def f_matrix_quaternion(spark, d):
    """Quaternions of the points' matrices as products, which don't depend on the sign where w is about 0."""
    p = _points(spark, d, "rot_0", "rot_1", "rot_2", "rot_3")
    m = p.select("point_id", *[c.alias(f"r{k}") for k, c in enumerate(X.rotation(*[C(f"rot_{i}").cast("double") for i in range(4)]))]).where("r0 is not null")
    q = X.matrix_quaternion([C(f"r{k}") for k in range(9)])
    return m.select("point_id", _r(q[0] * q[0]).alias("ww"), _r(q[0] * q[1]).alias("wx"), _r(q[1] * q[3]).alias("xz"))


@query(PTS + """, q AS (SELECT point_id, rot_0::DOUBLE AS w, rot_1::DOUBLE AS x, rot_2::DOUBLE AS y, rot_3::DOUBLE AS z FROM pts) SELECT point_id, round(0.8*w-0.6*z,4) AS w, round(0.8*x-0.6*y,4) AS x, round(0.8*y+0.6*x,4) AS y, round(0.8*z+0.6*w,4) AS z FROM q""")
def f_quaternion_product(spark, d):
    turn = [F.lit(0.8), F.lit(0.0), F.lit(0.0), F.lit(0.6)]
    q = X.quaternion_product(turn, [C(f"rot_{i}").cast("double") for i in range(4)])
    return _points(spark, d, "rot_0", "rot_1", "rot_2", "rot_3").select("point_id", *[_r(c).alias(n) for c, n in zip(q, "wxyz")])


@query(PTS + """ SELECT point_id, round(x/tan(0.5)/(z+1e-7),3) AS u, round(y/tan(0.4)/(z+1e-7),3) AS v, round((100.0*z/99.0-100.0/99.0)/(z+1e-7),3) AS depth FROM pts WHERE z > 1""")
def f_homogeneous(spark, d):
    h = X.homogeneous(X.perspective(1.0, 100.0, 1.0, 0.8), C("x"), C("y"), C("z"))
    return _points(spark, d, "x", "y", "z").where("z > 1").select("point_id", *[_r(c, 3).alias(n) for c, n in zip(h, ("u", "v", "depth"))])


@query("""WITH i AS (SELECT image_id, qvec AS q, tvec AS t, sqrt(qvec[1]**2+qvec[2]**2+qvec[3]**2+qvec[4]**2) AS n FROM images WHERE image_id IS NOT NULL AND tvec IS NOT NULL AND qvec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY loaded_at)=1),
 r AS (SELECT image_id, t, 1-2*(q[3]**2+q[4]**2)/(n*n) AS a, 2*(q[2]*q[3]-q[1]*q[4])/(n*n) AS b, 2*(q[2]*q[4]+q[1]*q[3])/(n*n) AS c FROM i WHERE n > 0) SELECT image_id, round(a,4) AS r00, round(2.0*t[1]-2.0*(a*1.0+b*2.0+c*3.0),3) AS t0 FROM r""")
def f_view_matrix(spark, d):
    i = table(spark, d, "images").where(C("image_id").isNotNull() & C("tvec").isNotNull() & C("qvec").isNotNull())
    i = i.groupBy("image_id").agg(F.min(F.struct("loaded_at", "qvec", "tvec")).alias("m"))
    q, t = C("m.qvec"), C("m.tvec")
    m = X.view_matrix(X.rotation(q[0], q[1], q[2], q[3]), [t[0], t[1], t[2]], (1.0, 2.0, 3.0), 2.0)
    return i.select("image_id", _r(m[0]).alias("r00"), _r(m[3], 3).alias("t0")).where("r00 is not null")


@query(PTS + """, u AS (SELECT point_id, f_dc_0::DOUBLE AS dc, list_transform(range(15), lambda i: coalesce(f_rest[i+1]::DOUBLE,0)) AS c, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM pts WHERE x*x+y*y+z*z > 0)
 SELECT point_id, round(greatest(0.28209479177387814*dc-0.4886025119029199*(y*c[1]-z*c[2]+x*c[3])+1.0925484305920792*(x*y*c[4]-y*z*c[5]-x*z*c[7])+0.31539156525252005*(2*z*z-x*x-y*y)*c[6]+0.5462742152960396*(x*x-y*y)*c[8]
 -0.5900435899266435*(y*(3*x*x-y*y)*c[9]+x*(x*x-3*y*y)*c[15])+2.890611442640554*x*y*z*c[10]-0.4570457994644658*(4*z*z-x*x-y*y)*(y*c[11]+x*c[13])+0.3731763325901154*z*(2*z*z-3*x*x-3*y*y)*c[12]+1.445305721320277*z*(x*x-y*y)*c[14]+0.5,0),4) AS red FROM u""")
def f_harmonics_cubic(spark, d):
    p = _points(spark, d, "x", "y", "z", "f_dc_0", "f_rest").withColumn("n", F.sqrt(C("x") * C("x") + C("y") * C("y") + C("z") * C("z"))).where("n > 0")
    return p.select("point_id", _r(Z.harmonics(C("f_dc_0").cast("double"), C("f_rest"), C("x") / C("n"), C("y") / C("n"), C("z") / C("n"), 3)).alias("red"))


@query(FEAT + """ SELECT point_id, floor(least(greatest((v[1]+1)/2*255,0),255))::INT AS red, CASE WHEN 1/(1+exp(-opacity::DOUBLE))<0.1 THEN 128 ELSE floor(least(greatest((v[2]+1)/2*255,0),255))::INT END AS green,
 CASE WHEN point_id%9=0 THEN 0 ELSE ((point_id%9)*97+71)%256 END::INT AS palette, round(CASE WHEN point_id%9=0 THEN 0.5*0.3+0.7 ELSE 0.5 END,4)::DOUBLE AS marked FROM f""")
def f_feature_bytes(spark, d):
    """Colours from features, the faint painted grey; palette of an id; a marked colour."""
    p = _featured(spark, d, "opacity")
    i = C("point_id") % 9
    grey = F.when(X.sigmoid(C("opacity").cast("double")) < 0.1, 128).otherwise(X.feature_byte(C("ins_feat")[1]))
    half = F.lit(0.5)
    return p.select("point_id", X.feature_byte(C("ins_feat")[0]).alias("red"), grey.alias("green"), X.palette(i)[1].cast("int").alias("palette"), _r(X.highlight([half, half, half], i == 0)[0]).alias("marked"))


@query(r"""WITH n AS (SELECT DISTINCT view_name AS name FROM mask_labels WHERE view_name IS NOT NULL) SELECT name, regexp_replace(regexp_replace(lower(trim(name)),'[^0-9a-z]+','_','g'),'^_+|_+$','','g') AS compact,
 coalesce(nullif(substr(regexp_replace(trim(regexp_replace(name,'[<>:"/\\|?*\x00-\x1f]','','g')),'\s+','_','g'),1,80),''),'unnamed') AS file FROM n""")
def f_name_variants(spark, d):
    n = table(spark, d, "mask_labels").where("view_name is not null").select(C("view_name").alias("name")).distinct()
    return n.select("name", X.compact_name(C("name")).alias("compact"), X.file_name(C("name")).alias("file"))


@query("""WITH l AS (SELECT DISTINCT lower(trim(label)) AS t FROM mask_labels WHERE label IS NOT NULL AND trim(label)<>''), c AS (SELECT DISTINCT id, lower(label) AS w FROM id2label),
 e AS (SELECT t, min(id) AS id FROM l JOIN c ON t=w GROUP BY t), s AS (SELECT t, min(id) AS id FROM l JOIN c ON contains(w,t) OR contains(t,w) GROUP BY t)
 SELECT t AS word, coalesce(try_cast(t AS INTEGER), e.id, s.id) AS id FROM l LEFT JOIN e USING (t) LEFT JOIN s USING (t)""")
def f_resolve_label(spark, d):
    labels = [(r[0], r[1]) for r in table(spark, d, "id2label").select("id", "label").distinct().orderBy("id").collect()]  # the fixed list of classes
    l = table(spark, d, "mask_labels").select(F.lower(F.trim("label")).alias("word")).where(F.length("word") > 0).distinct()
    return l.select("word", X.resolve_label(C("word"), labels).alias("id"))


@query("""SELECT DISTINCT id, label FROM id2label""")
def f_label_map(spark, d):
    """The classes written as one text, half of them turned round, and read again."""
    entry = F.when(C("id") % 2 == 0, F.concat_ws(":", C("id").cast("string"), "label")).otherwise(F.concat_ws(":", "label", C("id").cast("string")))
    text = table(spark, d, "id2label").select(F.concat_ws(",", F.sort_array(F.collect_set(entry))).alias("t"))  # the fixed list of classes
    return text.select(F.explode(X.label_map(C("t"))).alias("id", "label"))


@query(PTS + """ SELECT point_id, (floor(x/2.0)::BIGINT<<32)|(floor(y/2.0)::BIGINT&4294967295) AS cell FROM pts WHERE floor(x/2.0)>=0 UNION ALL SELECT point_id, -((-floor(x/2.0)::BIGINT)<<32)|(floor(y/2.0)::BIGINT&4294967295) AS cell FROM pts WHERE floor(x/2.0)<0""")
def f_packed_cell(spark, d):
    return _points(spark, d, "x", "y").where("x is not null").select("point_id", X.packed_cell(X.cell(C("x"), F.lit(0.0), 2.0), X.cell(C("y"), F.lit(0.0), 2.0)).alias("cell"))


BOX = PTS + """, b AS (SELECT scene, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM pts GROUP BY scene)"""


def _boxes(spark, d):
    return P.bounds(_points(spark, d, "scene", "x", "y", "z"), ["scene"])


@query(BOX + """, c AS (SELECT scene, k, (x0+x1)/2+sqrt((x1-x0)**2+(y1-y0)**2+(z1-z0)**2)/2*1.5*cos(2*pi()*(k%8)/8) AS ex, z0+(z1-z0)*(k//8+1)/2 AS ez, (z0+z1)/2 AS zm, (x0+x1)/2 AS xm, (y0+y1)/2 AS ym, (y0+y1)/2+sqrt((x1-x0)**2+(y1-y0)**2+(z1-z0)**2)/2*1.5*sin(2*pi()*(k%8)/8) AS ey FROM b, range(16) t(k))
 SELECT scene, k::INT AS cam, round(ex,3) AS ex, round(ez,3) AS ez, round((zm-ez)/sqrt((xm-ex)**2+(ym-ey)**2+(zm-ez)**2),4) AS ahead_z FROM c WHERE (xm-ex)**2+(ym-ey)**2+(zm-ez)**2 > 0""")
def f_camera_ring(spark, d):
    return G.ring(_boxes(spark, d), 8, 2, 1.5).select("scene", "cam", _r("ex", 3).alias("ex"), _r("ez", 3).alias("ez"), _r(C("w2c")[10]).alias("ahead_z")).where("ahead_z is not null")


@query(BOX + """, n AS (SELECT *, greatest(ceil((x1-x0)/10),1)::INT AS nx, greatest(ceil((y1-y0)/10),1)::INT AS ny FROM b), c AS (SELECT *, unnest(range(nx*ny))::INT AS cam FROM n) SELECT scene, cam, round(x0+(cam%nx+0.5)*10,3) AS ex, round(y0+(cam//nx+0.5)*10,3) AS ey, round(z1+5,3) AS ez FROM c""")
def f_camera_grid(spark, d):
    return G.grid(_boxes(spark, d), 10.0, 5.0).select("scene", "cam", *[_r(a, 3).alias(a) for a in ("ex", "ey", "ez")])


@query(BOX + """, s AS (SELECT scene, (x0+x1)/2 AS xm, (y0+y1)/2 AS ym, (x1-x0)*1.1 AS w, (y1-y0)*1.1 AS h FROM b) SELECT scene, round(xm-greatest(w,h*1.5)/2,3) AS x_min, round(ym+greatest(h,w/1.5)/2,3) AS y_max FROM s""")
def f_ortho_bounds(spark, d):
    return G.ortho_bounds(_boxes(spark, d), 0.05, 1.5).select("scene", _r("ortho_x_min", 3).alias("x_min"), _r("ortho_y_max", 3).alias("y_max"))


@query(BOX + """, s AS (SELECT scene, k, 0.5*1.2**k AS side, (ceil((x1-x0)/(0.5*1.2**k))+1)*(ceil((y1-y0)/(0.5*1.2**k))+1)*(ceil((z1-z0)/(0.5*1.2**k))+1) AS cells FROM b, range(201) t(k)) SELECT scene, round(side,4) AS side, cells::DOUBLE AS cells FROM s WHERE cells <= 1000 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY k)=1""")
def a_voxel_cap(spark, d):
    return G.voxel_size(_boxes(spark, d), 0.5, 1000).select("scene", _r("side").alias("side"), "cells")


@query(PTS + """ SELECT scene, round(sum(CASE WHEN point_id%3=0 THEN abs(red/255.0-f_dc_0::DOUBLE) ELSE 0 END)/greatest(1,sum((point_id%3=0)::INT)),4) AS l1 FROM pts WHERE red IS NOT NULL GROUP BY scene""")
def a_masked_error(spark, d):
    e = F.abs(C("red").cast("double") / 255.0 - C("f_dc_0").cast("double"))
    return _points(spark, d, "scene", "red", "f_dc_0").where("red is not null").groupBy("scene").agg(_r(X.masked_mean(e, C("point_id") % 3 == 0)).alias("l1"))


@query(FEAT + """ SELECT point_id FROM f WHERE coalesce(1/(1+exp(-opacity::DOUBLE)),1) > 0.05 AND greatest(scale_0,scale_1,scale_2) < 2.0 AND sqrt(list_sum(list_transform(v, lambda x: x*x))) >= 0.8""")
def p_filter_norm(spark, d):
    return P.opaque(_featured(spark, d, "opacity", "scale_0", "scale_1", "scale_2"), min_norm=0.8).select("point_id")


@query(PTS + " SELECT point_id FROM pts WHERE opacity >= 0.5")
def p_filter_logit(spark, d):
    return P.above_logit(_points(spark, d, "opacity"), 0.5).select("point_id")


CORE = PTS + """, m AS (SELECT scene, avg(x) mx, avg(y) my, avg(z) mz FROM pts GROUP BY scene), s AS (SELECT point_id, scene, coalesce(1/(1+exp(-opacity::DOUBLE)),0) AS q, -sqrt((x-mx)**2+(y-my)**2+(z-mz)**2) AS c FROM pts JOIN m USING (scene))"""


@query(CORE + """ SELECT point_id FROM s QUALIFY row_number() OVER (PARTITION BY scene ORDER BY c DESC, point_id) <= least(greatest(round_even(count(*) OVER (PARTITION BY scene)*0.3,0),20),count(*) OVER (PARTITION BY scene))""")
def p_core_centroid(spark, d):
    near = P.centrality(_points(spark, d, "scene", "x", "y", "z"), ["scene"])
    return P.core_points(near, "point_id", ["scene"], C("_s"), least=20).select("point_id")


@query(CORE + """, l AS (SELECT scene, min(q) qa, max(q) qb, min(c) ca, max(c) cb FROM s GROUP BY scene), x AS (SELECT point_id, scene, ((q-qa)/CASE WHEN qb-qa<1e-8 THEN 1 ELSE qb-qa END+(c-ca)/CASE WHEN cb-ca<1e-8 THEN 1 ELSE cb-ca END)/2 AS b FROM s JOIN l USING (scene))
 SELECT point_id FROM x QUALIFY row_number() OVER (PARTITION BY scene ORDER BY b DESC, point_id) <= least(greatest(round_even(count(*) OVER (PARTITION BY scene)*0.3,0),20),count(*) OVER (PARTITION BY scene))""")
def p_core_mixed(spark, d):
    p = _points(spark, d, "scene", "x", "y", "z", "opacity")
    both = P.centrality(p, ["scene"], F.coalesce(X.sigmoid(C("opacity").cast("double")), F.lit(0.0)))
    return P.core_points(both, "point_id", ["scene"], C("_s"), least=20).select("point_id")


@query("""WITH n AS (SELECT image_id, name FROM images WHERE name IS NOT NULL AND image_id IS NOT NULL) SELECT min(image_id)::INT AS image_id FROM n GROUP BY lower(name)""")
def g_dedup_names(spark, d):
    """One image per name in any case: the first."""
    n = table(spark, d, "images").where("name is not null and image_id is not null").select("image_id", F.lower("name").alias("k"))
    return n.groupBy("k").agg(F.min("image_id").alias("image_id")).select("image_id")


@query(PTS + """ SELECT kind, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM (SELECT 'dense' AS kind, point_id AS id FROM pts UNION ALL SELECT 'sparse', point3d_id FROM (SELECT DISTINCT point3d_id FROM sparse_points WHERE point3d_id IS NOT NULL)) GROUP BY kind""")
def g_union(spark, d):
    """Dense and sparse points as one table, with the columns of both."""
    dense = _points(spark, d, "x", "y", "z", "opacity").select(F.lit("dense").alias("kind"), C("point_id").alias("id"), "x", "y", "z", "opacity")
    sparse = _sparse(spark, d).select(F.lit("sparse").alias("kind"), C("point3d_id").alias("id"), "x", "y", "z", "error")
    return B.union_all([dense, sparse]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


CLOSED = VOX.replace("/4.0", "/6.0").replace("WITH pts", "WITH RECURSIVE pts") + """, st AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) q(dx,dy,dz)), g AS (SELECT DISTINCT scene, i+dx AS i, j+dy AS j, k+dz AS k FROM vx, st),
 cl AS (SELECT g.scene, g.i-dx AS i, g.j-dy AS j, g.k-dz AS k FROM g, st GROUP BY ALL HAVING count(*)=7)"""


def _six(spark, d):
    return B.occupancy(_points(spark, d, "scene", "x", "y", "z"), ["scene"], 6.0, F.lit(1.0))


@query(CLOSED + " SELECT scene, count(*)::BIGINT AS n, sum(i)::BIGINT AS si, sum(j)::BIGINT AS sj, sum(k)::BIGINT AS sk FROM cl GROUP BY scene")
def g_close(spark, d):
    return G.close(_six(spark, d), ["scene"]).groupBy("scene").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "ijk"])


@query(CLOSED + """, bx AS (SELECT scene, min(i) i0, max(i) i1, min(j) j0, max(j) j1, min(k) k0, max(k) k1 FROM vx GROUP BY scene), al AS (SELECT scene, i0, i1, j0, j1, k0, k1, i, j, unnest(range(k0-1,k1+2)) AS k FROM (SELECT *, unnest(range(j0-1,j1+2)) AS j FROM (SELECT *, unnest(range(i0-1,i1+2)) AS i FROM bx))),
 em AS (SELECT al.* FROM al ANTI JOIN vx ON al.scene=vx.scene AND al.i=vx.i AND al.j=vx.j AND al.k=vx.k), wet AS (SELECT scene, i, j, k FROM em WHERE i<i0 OR i>i1 OR j<j0 OR j>j1 OR k<k0 OR k>k1 UNION SELECT em.scene, em.i, em.j, em.k FROM wet, st, em WHERE em.scene=wet.scene AND em.i=wet.i+dx AND em.j=wet.j+dy AND em.k=wet.k+dz),
 n AS (SELECT scene, count(*) AS e FROM em GROUP BY scene), w AS (SELECT scene, count(*) AS w FROM wet GROUP BY scene), f AS (SELECT scene, count(*) AS f FROM vx GROUP BY scene) SELECT scene, (f+e-w)::BIGINT AS n FROM f JOIN n USING (scene) JOIN w USING (scene)""")
def g_fill(spark, d):
    return G.fill(_six(spark, d), ["scene"]).groupBy("scene").agg(F.count("*").alias("n"))


@query(CLOSED + """, fi AS (SELECT scene, i, j, k FROM vx WHERE NOT EXISTS (SELECT 1 FROM st WHERE NOT EXISTS (SELECT 1 FROM vx o WHERE o.scene=vx.scene AND o.i=vx.i+dx AND o.j=vx.j+dy AND o.k=vx.k+dz))) SELECT scene, count(*)::BIGINT AS n FROM (SELECT scene, i, j, k FROM vx EXCEPT SELECT * FROM fi) GROUP BY scene""")
def g_shell(spark, d):
    return G.shell(_six(spark, d), ["scene"]).groupBy("scene").agg(F.count("*").alias("n"))


@query(PTS + """, vx AS (SELECT DISTINCT floor(x/10.0)::INT AS i, floor(y/10.0)::INT AS j, floor(z/10.0)::INT AS k FROM pts), st AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) q(dx,dy,dz))
 SELECT i, j, k FROM vx WHERE (SELECT count(*) FROM st JOIN vx o ON o.i=vx.i+dx AND o.j=vx.j+dy AND o.k=vx.k+dz)=7""")
def g_erode_coarse(spark, d):
    """Erosion of all scenes laid over each other, on voxels of 10 units."""
    return B.erode(B.occupancy(_points(spark, d, "x", "y", "z"), [], 10.0, F.lit(1.0)), [])


@query(VOX + """, f AS (SELECT vx.*, q.dx, q.dy, q.dz FROM vx, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) q(dx,dy,dz)), e AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM vx o WHERE o.scene=f.scene AND o.i=f.i+dx AND o.j=f.j+dy AND o.k=f.k+dz)),
 c AS (SELECT DISTINCT scene, CASE WHEN dx<>0 THEN i+(dx>0)::INT ELSE i+a END AS x, CASE WHEN dy<>0 THEN j+(dy>0)::INT WHEN dx<>0 THEN j+a ELSE j+b END AS y, CASE WHEN dz<>0 THEN k+(dz>0)::INT ELSE k+b END AS z FROM e, range(2) p(a), range(2) q(b))
 SELECT scene, (2*t)::BIGINT AS triangles, v::BIGINT AS vertices FROM (SELECT scene, count(*) AS t FROM e GROUP BY scene) JOIN (SELECT scene, count(*) AS v FROM c GROUP BY scene) USING (scene)""")
def g_mesh(spark, d):
    vertices, triangles = G.mesh(_voxels(spark, d), ["scene"], 4.0)
    return triangles.groupBy("scene").agg(F.count("*").alias("triangles")).join(vertices.groupBy("scene").agg(F.count("*").alias("vertices")), "scene")


@query()
def g_align(spark, d):
    """Trimmed fit of the sparse points to a moved copy of themselves: mean distance left, per scene."""
    s = cut(_sparse(spark, d).where("x is not null and y is not null and z is not null").select("point3d_id", "scene", "x", "y", "z"))
    goal = s.withColumns({"x": C("x") * 1.02 + 0.1, "y": C("y") * 1.02 - 0.1, "z": C("z") * 1.02})
    fit = G.align(s, goal, "point3d_id", 4.0, 3)
    m = G.moved(s, *fit).join(goal.select("point3d_id", *[C(a).alias(f"t{a}") for a in "xyz"]), "point3d_id")
    return m.groupBy("scene").agg(_r(F.avg(F.sqrt(sum((C(a) - C(f"t{a}")) ** 2 for a in "xyz"))), 2).alias("left"))


@query("""WITH v AS (SELECT DISTINCT view_idx, width//16 AS w, height//16 AS h FROM camera_views WHERE view_idx IS NOT NULL), p AS (SELECT view_idx, w, h, u, unnest(range(h)) AS y FROM (SELECT *, unnest(range(w)) AS u FROM v)),
 s AS (SELECT view_idx, CASE WHEN (u-w/2.0)**2+(y-h/2.0)**2 <= 9 THEN 2 WHEN u BETWEEN 2 AND w-3 AND y BETWEEN 2 AND h-3 THEN 1 ELSE 0 END AS m FROM p) SELECT view_idx, m::INT AS mask_id, count(*)::BIGINT AS n FROM s WHERE m > 0 GROUP BY ALL""")
def g_shapes(spark, d):
    """A rectangle within each view's frame and a circle over it, on pixels of 16."""
    v = table(spark, d, "camera_views").where("view_idx is not null").select("view_idx", F.floor(C("width") / 16).cast("int").alias("width"), F.floor(C("height") / 16).cast("int").alias("height")).distinct()
    w, h = C("width").cast("double"), C("height").cast("double")
    point = lambda x, y: F.array(x, y)
    box = F.struct(F.lit(0).alias("shape_no"), F.lit("rectangle").alias("kind"), F.array(point(F.lit(2.0), F.lit(2.0)), point(w - 3, h - 3)).alias("points"), F.lit(1).alias("mask_id"))
    disc = F.struct(F.lit(1).alias("shape_no"), F.lit("circle").alias("kind"), F.array(point(w / 2, h / 2), point(w / 2 + 3, h / 2)).alias("points"), F.lit(2).alias("mask_id"))
    s = v.select("view_idx", "width", "height", F.explode(F.array(box, disc)).alias("s")).select("view_idx", "width", "height", "s.*")
    return R.draw_shapes(s).groupBy("view_idx", "mask_id").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT image_id, qvec q, tvec t, camera_id, name, sqrt(qvec[1]**2+qvec[2]**2+qvec[3]**2+qvec[4]**2) AS n FROM images WHERE image_id IS NOT NULL AND tvec IS NOT NULL AND qvec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY loaded_at)=1),
 c AS (SELECT * FROM cameras WHERE camera_id IS NOT NULL AND model IN ('SIMPLE_PINHOLE','SIMPLE_RADIAL','RADIAL','PINHOLE','OPENCV') AND params IS NOT NULL QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY loaded_at)=1)
 SELECT image_id, round(1-2*(q[3]**2+q[4]**2)/(n*n),4) AS r00, round(t[3],4) AS tz, round(params[1],3) AS fx, round(CASE WHEN model IN ('PINHOLE','OPENCV') THEN params[4] ELSE params[3] END,3) AS cy FROM i JOIN c USING (camera_id) WHERE n > 0""")
def s_colmap_views(spark, d):
    v = scenes.views_of(table(spark, d, "images"), table(spark, d, "cameras"))
    return v.select("image_id", _r(C("w2c")[0]).alias("r00"), _r(C("w2c")[11]).alias("tz"), _r("fx", 3).alias("fx"), _r("cy", 3).alias("cy"))


@query(r"""WITH n AS (SELECT DISTINCT annotation_id, lower(trim(label))||'__'||regexp_replace(list_last(string_split(replace(mask_path,'\','/'),'/')),'\.[^.]*$','') AS base FROM mask_labels WHERE mask_path IS NOT NULL AND label IS NOT NULL AND annotation_id IS NOT NULL)
 SELECT annotation_id, CASE WHEN r=1 THEN base ELSE base||'_'||r END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY annotation_id) AS r FROM n)""")
def k_renamed(spark, d):
    """Files renamed to prompt and stem; the second of one name gets the suffix _2, and so on."""
    m = table(spark, d, "mask_labels").where("mask_path is not null and label is not null and annotation_id is not null")
    base = F.concat(F.lower(F.trim("label")), F.lit("__"), X.stem(C("mask_path")))
    n = P.ranks(m.select("annotation_id", base.alias("base")).distinct(), ["base"], [C("annotation_id").asc()])
    return n.select("annotation_id", F.when(C("_rn") == 1, C("base")).otherwise(F.concat_ws("_", "base", C("_rn").cast("string"))).alias("name"))


@query(PTS + " SELECT (point_id%7)::INT AS semantic, count(*)::BIGINT AS n, sum(point_id)::BIGINT AS ids FROM pts GROUP BY 1")
def k_by_class(spark, d):
    """Points written as one folder per class and read again."""
    path = f"{shared_folder(spark)}/cloudloom-{uuid.uuid4().hex}"
    scenes.write_by(_points(spark, d, "x", "y", "z").withColumn("semantic", (C("point_id") % 7).cast("int")), path, ["semantic"])
    return spark.read.parquet(path).groupBy("semantic").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query("""WITH sp AS (SELECT * FROM sparse_points WHERE point3d_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point3d_id ORDER BY loaded_at)=1), o AS (SELECT scene, floor(x/20)::BIGINT AS tx, floor(y/20)::BIGINT AS ty, point3d_id, unnest(track).image_id AS image_id FROM sp)
 SELECT scene, tx, ty, count(DISTINCT point3d_id)::BIGINT AS n_points, count(*)::BIGINT AS n_observations, list(DISTINCT image_id ORDER BY image_id) AS images FROM o WHERE tx IS NOT NULL AND ty IS NOT NULL AND image_id IS NOT NULL GROUP BY ALL""")
def k_tile_report(spark, d):
    """Per tile: its points, observations and images."""
    s = _sparse(spark, d).where("x is not null and y is not null")
    o = s.select("scene", F.floor(C("x") / 20).alias("tx"), F.floor(C("y") / 20).alias("ty"), "point3d_id", F.explode("track.image_id").alias("image_id")).where("image_id is not null")
    return o.groupBy("scene", "tx", "ty").agg(F.countDistinct("point3d_id").alias("n_points"), F.count("*").alias("n_observations"), F.sort_array(F.collect_set("image_id")).alias("images"))
