"""Queries of lookups by vector, rasters and evaluation of masks, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import rasters as R
from .operators import spatial as S
from .operators import tracks as T
from .operators import vectors as W
from .operators import views as V
from .queries_core import CENTRES, PTS, SEEN, SP, _points, _seen, _sparse, _views
from .util import cut, table

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


def _leaves(spark, d, n):
    e = table(spark, d, "embeddings").select((C("vec_id") % n).alias("leaf"), C("embedding").alias("v"))
    return W.mean_vectors(e, ["leaf"], "v")


def _texts(spark, d):
    return W.mean_vectors(table(spark, d, "embeddings").select(C("label").cast("bigint").alias("text"), C("embedding").alias("v")), ["text"], "v").select("text", "feat")


def _lv(n):
    return f"""WITH e AS (SELECT vec_id, label::BIGINT AS label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
 lv AS (SELECT leaf, list(x ORDER BY i) AS v FROM (SELECT vec_id%{n} AS leaf, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY leaf), oc AS (SELECT vec_id%{n} AS leaf, count(*) AS n FROM embeddings GROUP BY 1),
 tx AS (SELECT label AS text, list(x ORDER BY i) AS tv FROM (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY label)"""


@query(_lv(97) + """, s AS (SELECT text, leaf, v, CASE WHEN n>=5 THEN list_cosine_similarity(v, tv) ELSE 0 END AS score FROM lv JOIN oc USING (leaf), tx), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, leaf) AS rank FROM s), b AS (SELECT text, v AS bv FROM r WHERE rank=1)
 SELECT text, leaf, rank::INT AS rank, round(score,4) AS score FROM r JOIN b USING (text) WHERE rank<=10 AND list_distance(v[1:6], bv[1:6]) < 0.9""")
def q_text_leaf(spark, d):
    return W.text_query(_leaves(spark, d, 97), _texts(spark, d)).select("text", "leaf", "rank", _r("score").alias("score"))


@query(_lv(300) + """, s AS (SELECT leaf, text, CASE WHEN n>=2 THEN list_cosine_similarity(v, tv) ELSE 0 END AS score FROM lv JOIN oc USING (leaf), tx) SELECT leaf, text AS label, round(score,4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY score DESC, text)=1""")
def q_leaf_classes(spark, d):
    return W.leaf_classes(_leaves(spark, d, 300), _texts(spark, d)).select("leaf", "label", _r("score").alias("score"))


@query(_lv(300) + """, s AS (SELECT leaf, text, n, CASE WHEN n>=2 THEN list_cosine_similarity(v, tv) ELSE 0 END AS score FROM lv JOIN oc USING (leaf), tx), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY score DESC, text)=1)
 SELECT leaf, CASE WHEN score < 0.5 OR n < 2 THEN 255 ELSE text END AS label FROM b""")
def q_leaf_semantics(spark, d):
    return W.leaf_classes(_leaves(spark, d, 300), _texts(spark, d), 2, 0.5).select("leaf", C("label").cast("bigint").alias("label"))


@query(_lv(300) + """, s AS (SELECT leaf, text, CASE WHEN n>=2 THEN list_cosine_similarity(v, tv) ELSE 0 END AS score FROM lv JOIN oc USING (leaf), tx), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY score DESC, text)=1),
 p AS (SELECT DISTINCT point_id, least(greatest(point_id%320-10,0),299) AS leaf FROM points WHERE point_id IS NOT NULL) SELECT text AS label, count(*)::BIGINT AS n, sum(point_id)::BIGINT AS ids FROM p JOIN b USING (leaf) GROUP BY text""")
def j_leaf_dictionary(spark, d):
    leaf = W.leaf_classes(_leaves(spark, d, 300), _texts(spark, d)).select("leaf", "label")
    out = W.by_dictionary(_points(spark, d), C("point_id") % 320 - 10, leaf, "leaf", 300)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query("""WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label::BIGINT AS mask_id, avg(x) AS x FROM e WHERE i=1 AND label<>0 GROUP BY label)
 SELECT vec_id, round(coalesce(m.x,0),4) AS x FROM embeddings LEFT JOIN m ON vec_id%12 = m.mask_id""")
def j_mask_features(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (C("vec_id") % 12).alias("mask_id"))
    return W.mask_features(rows, ["mask_id"], _texts(spark, d).withColumnRenamed("text", "mask_id"), 64).select("vec_id", _r(C("feat")[1]).alias("x"))


@query("""SELECT min(id)::INT AS id, label AS text FROM id2label GROUP BY label""")
def j_text_ids(spark, d):
    t = table(spark, d, "id2label").select("id", C("label").alias("text"))
    names = sorted(r[0] for r in t.select("text").distinct().collect())  # the fixed list of classes
    return W.named_texts(t, names).select("id", "text")


@query(PTS + """, f AS (SELECT point_id, scene, x, y, z, list_transform(ins_feat, lambda x: x::DOUBLE) AS v FROM pts WHERE len(ins_feat)=6 AND len(list_filter(ins_feat, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 s AS (SELECT scene, list(x ORDER BY i) AS sv FROM (SELECT scene, i, avg(x) AS x FROM (SELECT scene, unnest(range(6)) AS i, unnest(v) AS x FROM f WHERE x*x+y*y+z*z <= 100) GROUP BY ALL) GROUP BY scene)
 SELECT point_id FROM f JOIN s USING (scene) WHERE CASE WHEN list_sum(list_transform(v, lambda x: x*x))=0 THEN 0 ELSE list_cosine_similarity(v, sv) END >= 0.6""")
def p_seed_similar(spark, d):
    ok = (F.size("ins_feat") == 6) & F.forall("ins_feat", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    p = _points(spark, d, "scene", "x", "y", "z", "ins_feat").where(ok)
    near = C("x") * C("x") + C("y") * C("y") + C("z") * C("z") <= 100
    return W.seed_similar(p, ["scene"], "ins_feat", near, 0.6).select("point_id")


@query(SEEN + """, px AS (SELECT view_idx, u, v, f_dc_0::DOUBLE AS a, f_dc_1::DOUBLE AS b, f_dc_2::DOUBLE AS e FROM seen JOIN pts USING (point_id)), ck AS (SELECT view_idx, u AS cu, v AS cv FROM seen QUALIFY row_number() OVER (PARTITION BY view_idx ORDER BY point_id)=1),
 m AS (SELECT view_idx, avg(a) AS a, avg(b) AS b, avg(e) AS e FROM px JOIN ck USING (view_idx) WHERE abs(u-cu)<=20 AND abs(v-cv)<=20 GROUP BY view_idx), r AS (SELECT k, CASE WHEN k&1=1 THEN -0.5 ELSE 0.5 END AS ra, CASE WHEN (k>>1)&1=1 THEN -0.5 ELSE 0.5 END AS rb, CASE WHEN (k>>2)&1=1 THEN -0.5 ELSE 0.5 END AS re FROM range(8) t(k)),
 b AS (SELECT m.*, k, ra, rb, re FROM m, r QUALIFY row_number() OVER (PARTITION BY view_idx ORDER BY (a-ra)**2+(b-rb)**2+(e-re)**2, k)=1)
 SELECT view_idx::BIGINT AS click, k::BIGINT AS root, (k*3+j)::BIGINT AS leaf FROM b, range(3) t(j) QUALIFY row_number() OVER (PARTITION BY view_idx ORDER BY (a-ra*(0.6+0.4*j))**2+(b-rb*(0.6+0.4*j))**2+(e-re*(0.6+0.4*j))**2, j)=1""")
def q_clicked_leaf(spark, d):
    dc = ["f_dc_0", "f_dc_1", "f_dc_2"]
    pixels = _seen(spark, d, *dc).select("view_idx", "u", "v", F.array(*[C(c).cast("double") for c in dc]).alias("feat"))
    place = F.min_by(C("u").cast("bigint") * (1 << 31) + C("v"), "point_id").alias("m")
    clicks = _seen(spark, d).groupBy("view_idx").agg(place).select(C("view_idx").cast("bigint").alias("click"), "view_idx", F.floor(C("m") / (1 << 31)).cast("int").alias("u"), F.pmod("m", F.lit(1 << 31)).cast("int").alias("v"))
    # one click a view, so that no pixel is shuffled to it
    clicks = F.broadcast(cut(clicks))
    roots = spark.createDataFrame(list(enumerate(CENTRES)), "root bigint, centre array<double>")
    leaves = roots.select("root", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"), "centre").select("root", (C("root") * 3 + C("j")).alias("leaf"), F.transform("centre", lambda x: x * (0.6 + 0.4 * C("j"))).alias("centre"))
    return W.clicked_leaf(pixels, clicks, 20, roots, leaves).select("click", "root", "leaf")


def _feature_points(spark, d):
    ok = (F.size("ins_feat") == 6) & F.forall("ins_feat", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return _points(spark, d, "x", "y", "z", "ins_feat").where(ok & C("x").isNotNull() & C("y").isNotNull() & C("z").isNotNull())


@query()
def g_two_level(spark, d):
    """Roots on vector and position, leaves on the vector within a root: members of each leaf."""
    p = _feature_points(spark, d).select("point_id", C("ins_feat").cast("array<double>").alias("feat"), F.array(*[C(a) * 0.05 for a in "xyz"]).alias("pos"))
    start = p.orderBy("point_id").limit(8).select("point_id", F.concat("feat", "pos").alias("centre")).collect()  # eight rows
    roots = spark.createDataFrame([(k, r["centre"]) for k, r in enumerate(start)], "code bigint, centre array<double>")
    counts = roots.select(C("code").alias("root"), (F.lit(2) + C("code") % 3).cast("int").alias("n"))
    return W.two_level(p, "point_id", "feat", "pos", roots, counts).groupBy("root", "leaf").agg(F.count("*").alias("n"))


@query(SEEN + """, m AS (SELECT DISTINCT point_id%16 AS root, view_idx, ((u//64)+2*(v//64))%32 AS mask_id FROM seen), c AS (SELECT root, view_idx, count(*) AS m FROM m GROUP BY ALL) SELECT root, least(max(m)+1, 10)::INT AS n FROM c GROUP BY root""")
def g_leaf_counts(spark, d):
    mask = F.pmod(F.floor(C("u") / 64) + 2 * F.floor(C("v") / 64), F.lit(32))
    return W.leaf_counts(_seen(spark, d).select((C("point_id") % 16).alias("root"), "view_idx", mask.alias("mask_id")), 10)


@query("""WITH e AS (SELECT vec_id%60 AS leaf, label%2=0 AS hit, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL)
 SELECT leaf, i, round(sum(CASE WHEN hit THEN x ELSE 0 END)/(sum(hit::INT)+1e-4),4) AS x FROM e GROUP BY ALL""")
def a_leaf_vectors(spark, d):
    e = table(spark, d, "embeddings").select((C("vec_id") % 60).alias("leaf"), (C("label") % 2 == 0).alias("hit"), C("embedding").alias("v"))
    return W.mean_vectors(e, ["leaf"], "v", 1e-4, C("hit")).select("leaf", F.posexplode("feat").alias("i", "x")).select("leaf", "i", _r("x").alias("x"))


@query("""WITH l AS (SELECT label, sum(embedding[1]::DOUBLE * (vec_id%3=0)::INT)/(sum((vec_id%3=0)::INT)+1e-6) AS x FROM embeddings GROUP BY label) SELECT label, round(x,4) AS x FROM l""")
def a_masked_mean(spark, d):
    hit = C("vec_id") % 3 == 0
    e = table(spark, d, "embeddings").groupBy("label").agg((F.sum(F.when(hit, C("embedding")[0].cast("double")).otherwise(0.0)) / (F.count_if(hit) + 1e-6)).alias("x"))
    return e.select("label", _r("x").alias("x"))


OVER = PTS + """, l AS (SELECT point_id, floor(x/10)::BIGINT AS a, floor(z/10)::BIGINT AS b, f_dc_0::DOUBLE AS p, f_dc_1::DOUBLE AS q FROM pts WHERE x IS NOT NULL AND z IS NOT NULL), ma AS (SELECT a, count(*) AS na, avg(p) AS pa, avg(q) AS qa FROM l GROUP BY a), mb AS (SELECT b, count(*) AS nb, avg(p) AS pb, avg(q) AS qb FROM l GROUP BY b),
 o AS (SELECT a, b, n, na, nb, abs(pa-pb)+abs(qa-qb) AS l1, sqrt((pa-pb)**2+(qa-qb)**2) AS l2 FROM (SELECT a, b, count(*) AS n FROM l GROUP BY ALL) JOIN ma USING (a) JOIN mb USING (b))"""


def _overlap(spark, d, base):
    l = _points(spark, d, "x", "z", "f_dc_0", "f_dc_1").select("point_id", F.floor(C("x") / 10).alias("a"), F.floor(C("z") / 10).alias("b"), C("f_dc_0").cast("double").alias("p"), C("f_dc_1").cast("double").alias("q"))
    l = l.where(C("a").isNotNull() & C("b").isNotNull())
    mean = lambda k: l.groupBy(k).agg(F.avg("p").alias(f"p{k}"), F.avg("q").alias(f"q{k}"))
    o = T.set_overlap(l, "a", "b", "point_id", base).join(mean("a"), "a").join(mean("b"), "b")
    return o.withColumn("l1", F.abs(C("pa") - C("pb")) + F.abs(C("qa") - C("qb"))).withColumn("l2", F.sqrt((C("pa") - C("pb")) ** 2 + (C("qa") - C("qb")) ** 2))


@query(OVER + " SELECT a, b, round(n::DOUBLE/na,4) AS iou FROM o")
def j_overlap_former(spark, d):
    return _overlap(spark, d, "former").select("a", "b", _r("iou").alias("iou"))


@query(OVER + ", s AS (SELECT a, b, n::DOUBLE/(na+nb-n)*(1-l1) AS score FROM o), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b)=1) SELECT a, b, round(score,4) AS score FROM m WHERE score > 0.2")
def j_matched_pairs(spark, d):
    return W.matched_pairs(_overlap(spark, d, "union")).select("a", "b", _r("score").alias("score"))


@query(OVER + " SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n::DOUBLE/na DESC, b)::INT AS rank FROM o WHERE n::DOUBLE/na > 0.2 AND l1 < 0.9 AND l2 < 0.5 QUALIFY rank <= 10")
def j_related_masks(spark, d):
    return W.related(_overlap(spark, d, "former")).select("a", "b", "rank")


RASTER = SEEN + """, ra AS (SELECT view_idx, v//8 AS v, u//8 AS u, (1+min(point_id)%7)::INT AS mask_id FROM seen WHERE (u//8+v//8)%3<>0 GROUP BY ALL)"""


def _raster(spark, d, seen):
    """A label raster on blocks of 8 x 8 pixels: the lowest point of each block names its mask; every third block is unlabelled."""
    b = seen.select("view_idx", F.floor(C("v") / 8).cast("int").alias("v"), F.floor(C("u") / 8).cast("int").alias("u"), "point_id").where((C("u") + C("v")) % 3 != 0)
    return b.groupBy("view_idx", "v", "u").agg((1 + F.min("point_id") % 7).cast("int").alias("mask_id"))


@query(RASTER + " SELECT s.view_idx, coalesce(ra.mask_id,0)::INT AS mask_id, count(*)::BIGINT AS n, sum(point_id)::BIGINT AS ids FROM seen s LEFT JOIN ra ON s.view_idx=ra.view_idx AND s.v//8=ra.v AND s.u//8=ra.u GROUP BY ALL")
def j_raster_lookup(spark, d):
    px = _seen(spark, d).select("view_idx", "point_id", F.floor(C("v") / 8).cast("int").alias("v"), F.floor(C("u") / 8).cast("int").alias("u"))
    # points of a block look the same pixel up; the raster is made of these blocks too
    blocks = cut(px.groupBy("view_idx", "v", "u").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"), F.min("point_id").alias("point_id")))
    raster = blocks.where((C("u") + C("v")) % 3 != 0).select("view_idx", "v", "u", (1 + C("point_id") % 7).cast("int").alias("mask_id"))
    return R.look_up(blocks, raster, 0).groupBy("view_idx", "mask_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


@query("""WITH m AS (SELECT DISTINCT image_id AS view_idx, o.point3d_id AS p, floor(o.y)::INT AS v, floor(o.x)::INT AS u FROM (SELECT image_id, unnest(points2d) AS o FROM images) WHERE o.point3d_id >= 0 AND o.x IS NOT NULL AND o.y IS NOT NULL), g AS (SELECT view_idx, v, u, min(p) AS p FROM m GROUP BY ALL), l AS (SELECT view_idx, lev, v, u, CASE WHEN lev=0 THEN p%5 ELSE p%9-1 END AS id FROM g, range(2) t(lev)),
 top AS (SELECT view_idx, max(id) AS top FROM l WHERE lev=0 GROUP BY view_idx) SELECT view_idx, mask_id::INT AS mask_id, (mask_id>0)::INT AS bin, count(*)::BIGINT AS n FROM (SELECT l.view_idx, CASE WHEN id<0 THEN -1 ELSE greatest(id-top-1,-1) END+1 AS mask_id FROM l JOIN top USING (view_idx) WHERE lev=1) GROUP BY ALL""")
def f_level_offset(spark, d):
    o = table(spark, d, "images").select(C("image_id").alias("view_idx"), F.explode("points2d").alias("o")).where("o.point3d_id >= 0 and o.x is not null and o.y is not null")
    m = o.select("view_idx", C("o.point3d_id").alias("p"), F.floor("o.y").cast("int").alias("v"), F.floor("o.x").cast("int").alias("u")).groupBy("view_idx", "v", "u").agg(F.min("p").alias("p"))
    both = m.select("view_idx", F.lit(0).alias("level"), "v", "u", (C("p") % 5).alias("mask_id")).unionByName(m.select("view_idx", F.lit(1).alias("level"), "v", "u", (C("p") % 9 - 1).alias("mask_id")))
    return R.level_offset(both, 1).groupBy("view_idx", C("mask_id").cast("int").alias("mask_id"), R.binarise(C("mask_id")).alias("bin")).agg(F.count("*").alias("n"))


@query(RASTER.replace("WITH pts", "WITH RECURSIVE pts") + """, nd AS (SELECT view_idx, mask_id, v, u, v*1000000+u AS k FROM ra), ed AS (SELECT a.view_idx, a.k AS a, b.k AS b FROM nd a JOIN nd b ON a.view_idx=b.view_idx AND a.mask_id=b.mask_id AND abs(a.v-b.v)+abs(a.u-b.u)=1),
 cl AS (SELECT view_idx, k AS n, k AS root FROM nd UNION SELECT cl.view_idx, ed.b, cl.root FROM cl JOIN ed ON cl.view_idx=ed.view_idx AND cl.n=ed.a), co AS (SELECT view_idx, n, min(root) AS comp FROM cl GROUP BY ALL)
 SELECT view_idx, mask_id, comp_area::BIGINT AS area, count(*)::BIGINT AS n FROM (SELECT co.view_idx, nd.mask_id, co.comp, count(*) AS comp_area FROM co JOIN nd ON co.view_idx=nd.view_idx AND co.n=nd.k GROUP BY ALL HAVING count(*)>=2) GROUP BY ALL""")
def g_mask_components(spark, d):
    """Sizes of the components of each mask, of two blocks or more."""
    comp = R.mask_components(_raster(spark, d, _seen(spark, d)), 2)
    one = comp.select("view_idx", "mask_id", "instance", "area").distinct()
    return one.groupBy("view_idx", "mask_id", "area").agg(F.count("*").alias("n"))


@query(SEEN + """, of AS (SELECT (y+1)*3+x+1 AS k, y, x FROM range(-1,2) a(y), range(-1,2) b(x)), sp AS (SELECT view_idx, v::INT+y AS v, u::INT+x AS u, pz, k, point_id FROM seen, of), fr AS (SELECT s.* FROM sp s JOIN vw USING (view_idx) WHERE u>=0 AND v>=0 AND u<width AND v<height QUALIFY row_number() OVER (PARTITION BY view_idx, v, u ORDER BY pz, k, point_id)=1)
 SELECT view_idx, count(*)::BIGINT AS n, sum(point_id)::BIGINT AS ids FROM fr GROUP BY view_idx""")
def w_splats(spark, d):
    sizes = _views(spark, d).select("view_idx", "width", "height")
    return R.splats(_seen(spark, d), sizes, 1).groupBy("view_idx").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


@query()
def w_free_paint(spark, d):
    """Masks of each view by falling score on free blocks: blocks of each mask that was painted."""
    paint = R.painter(3)

    def run(pdf):
        pdf = pdf.assign(mask_id=pdf["point_id"] % 40, v=pdf["v"] // 16, u=pdf["u"] // 16, score=pdf["depth"].round(6))
        return paint(pdf)[["view_idx", "mask_id"]]

    return _seen(spark, d, each=(run, "view_idx int, mask_id bigint")).groupBy("view_idx", "mask_id").agg(F.count("*").alias("n"))


@query()
def p_suppress_boxes(spark, d):
    """Boxes of 40 masks of each view, suppressed within five classes."""
    b = _seen(spark, d).groupBy("view_idx", (C("point_id") % 40).alias("box_id")).agg(F.min("u").alias("x0"), F.min("v").alias("y0"), F.max("u").alias("x1"), F.max("v").alias("y1"), F.count("*").cast("double").alias("score"))
    return R.suppress(b.withColumn("cls", C("box_id") % 5), ["view_idx", "cls"], 0.5, 16.0).select("view_idx", "cls", "box_id", "score")


MASKF = SEEN + """, px AS (SELECT view_idx, ((u//64)+2*(v//64))%32 AS m, f_dc_0::DOUBLE AS a, f_dc_1::DOUBLE AS b FROM seen JOIN pts USING (point_id)), mm AS (SELECT view_idx, m, avg(a) AS ma, avg(b) AS mb FROM px GROUP BY ALL)"""


def _mask_pixels(spark, d):
    mask = F.pmod(F.floor(C("u") / 64) + 2 * F.floor(C("v") / 64), F.lit(32)).cast("int").alias("m")
    return _seen(spark, d, "f_dc_0", "f_dc_1").select("view_idx", mask, "point_id", C("f_dc_0").cast("double").alias("a"), C("f_dc_1").cast("double").alias("b"))


@query(MASKF + ", c AS (SELECT view_idx, m, avg(sqrt((a-ma)**2+(b-mb)**2)) AS d FROM px JOIN mm USING (view_idx, m) GROUP BY ALL) SELECT view_idx, round(avg(d),4) AS cohesion, count(*)::BIGINT AS n_masks FROM c GROUP BY view_idx")
def a_mask_cohesion(spark, d):
    return R.cohesion(_mask_pixels(spark, d), ["view_idx"], "m", ["a", "b"]).select("view_idx", _r("cohesion").alias("cohesion"), "n_masks")


@query(MASKF + """, pr AS (SELECT x.view_idx, x.m, y.m AS o, (x.ma-y.ma)**2+(x.mb-y.mb)**2 AS d2 FROM mm x JOIN mm y ON x.view_idx=y.view_idx AND x.m<>y.m), rk AS (SELECT *, row_number() OVER (PARTITION BY view_idx, m ORDER BY d2, o) AS r, count(*) OVER (PARTITION BY view_idx, m) AS n FROM pr)
 SELECT view_idx, round(avg((CASE WHEN n>1 THEN 1-0.9*(r-1)/(n-1) ELSE 1 END)/(d2+1)),4) AS separation, count(DISTINCT m)::BIGINT AS n_masks FROM rk GROUP BY view_idx""")
def a_mask_separation(spark, d):
    return R.separation(_mask_pixels(spark, d), ["view_idx"], "m", ["a", "b"]).select("view_idx", _r("separation").alias("separation"), "n_masks")


@query()
def a_view_ssim(spark, d):
    """Structural similarity of stored and computed red of each view's visible points on blocks of 16 pixels."""
    p = _seen(spark, d, "red", "f_dc_0").select("view_idx", "u", "v", (C("red").cast("double") / 255.0).alias("a"), X.sh_colour(C("f_dc_0").cast("double")).alias("b"))
    px = p.groupBy("view_idx", F.floor(C("v") / 16).alias("v"), F.floor(C("u") / 16).alias("u")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return R.ssim(px, ["view_idx"], "a", "b")


@query(SEEN + """, e AS (SELECT view_idx, -10*log10(avg((red/255.0-least(greatest(f_dc_0::DOUBLE*0.28209479177387814+0.5,0),1))**2)) AS q FROM seen JOIN pts USING (point_id) WHERE red IS NOT NULL GROUP BY view_idx)
 SELECT scene, list(view_idx ORDER BY view_idx) AS views, list(round(q,3) ORDER BY view_idx) AS psnr FROM e JOIN vw USING (view_idx) WHERE q IS NOT NULL GROUP BY scene""")
def a_view_psnr(spark, d):
    """Quality per view, gathered per scene; a scene's map has one entry a view."""
    from .operators.scene import psnr

    p = _points(spark, d, "red", "f_dc_0").where("red is not null").select("point_id", (C("red").cast("double") / 255.0).alias("a"), X.sh_colour(C("f_dc_0").cast("double")).alias("b"))
    per = _seen(spark, d).join(p, "point_id").groupBy("view_idx").agg(_r(psnr(C("a"), C("b")), 3).alias("q")).where("q is not null").join(_views(spark, d).select("view_idx", "scene"), "view_idx")
    m = per.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("view_idx", "q"))).alias("m"))
    return m.select("scene", C("m.view_idx").alias("views"), C("m.q").alias("psnr"))


MERGE = PTS + """, l AS (SELECT point_id, point_id%7 AS semantic, (point_id//7)%11 AS inst FROM pts WHERE f_dc_0 > 0), s AS (SELECT semantic, inst, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 5),
 r AS (SELECT semantic, count(*) AS n_instances, sum(n)::BIGINT AS n_points, max(n) AS largest FROM s GROUP BY semantic)"""


def _merged(spark, d):
    l = _points(spark, d, "f_dc_0").where("f_dc_0 > 0").select((C("point_id") % 7).alias("semantic"), (F.floor(C("point_id") / 7) % 11).alias("inst"))
    s = l.groupBy("semantic", "inst").agg(F.count("*").alias("n")).where("n >= 5")
    return s.groupBy("semantic").agg(F.count("*").alias("n_instances"), F.sum("n").alias("n_points"), F.max("n").alias("largest"))


@query(MERGE + " SELECT semantic, n_instances, n_points, largest, (coalesce(sum(n_instances) OVER (ORDER BY semantic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)+1)::BIGINT AS first_id FROM r")
def a_semantic_merge(spark, d):
    """Instances of each class put together: their number, points, the largest, and the first of their running numbers."""
    from pyspark.sql import Window

    # one row per class
    first = F.coalesce(F.sum("n_instances").over(Window.orderBy("semantic").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return _merged(spark, d).withColumn("first_id", first)


@query(MERGE + " SELECT semantic, to_json({'n_instances': n_instances, 'n_points': n_points, 'largest': largest})::VARCHAR AS report FROM r")
def k_report_json(spark, d):
    return _merged(spark, d).select("semantic", F.to_json(F.struct("n_instances", "n_points", "largest")).alias("report"))


CLOSE = SP.replace("WITH sp", "WITH RECURSIVE sp") + """, pt AS (SELECT point3d_id AS id, scene, x, y, z FROM sp WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"""
REACH = """, cl AS (SELECT id AS n, id AS root FROM nd UNION SELECT ed.b, cl.root FROM cl JOIN ed ON cl.n=ed.a), co AS (SELECT n AS node, min(root) AS component FROM cl GROUP BY n)"""
ORACLES["g_components"] = " ".join((CLOSE + """, nd AS (SELECT point3d_id AS id FROM sp), ed AS (SELECT p.id AS a, q.id AS b FROM pt p JOIN pt q ON p.scene=q.scene AND p.id<>q.id WHERE sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)<=1.5)""" + REACH + " SELECT node, component FROM co").split())
ORACLES["g_dbscan"] = " ".join((CLOSE + """, nb AS (SELECT p.id AS a, q.id AS b FROM pt p JOIN pt q ON p.scene=q.scene AND p.id<>q.id WHERE sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)<=2.0), nd AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*)+1>=4),
 ed AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM nd) AND b IN (SELECT id FROM nd))""" + REACH + """, bo AS (SELECT a AS node, min(component) AS near FROM nb JOIN co ON nb.b=co.node GROUP BY a)
 SELECT point3d_id, coalesce(component, near) AS component FROM sp LEFT JOIN co ON point3d_id=co.node LEFT JOIN bo ON point3d_id=bo.node""").split())


@query(CLOSE + """, nd AS (SELECT id FROM pt), ed AS (SELECT p.id AS a, q.id AS b FROM pt p JOIN pt q ON p.scene=q.scene AND p.id<>q.id WHERE sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2)<=3.0)""" + REACH + """
 SELECT scene, component, n FROM (SELECT scene, component, count(*)::BIGINT AS n FROM co JOIN pt ON co.node=pt.id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scene ORDER BY n DESC, component)=1""")
def a_majority_component(spark, d):
    """The component with most points of each scene; ties to the lower."""
    s = _sparse(spark, d).where("x is not null and y is not null and z is not null")
    comp = S.components(s.select(C("point3d_id").alias("node")), S.within(s, "point3d_id", ["scene"], 3.0))
    n = comp.join(s.select(C("point3d_id").alias("node"), "scene"), "node").groupBy("scene", "component").agg(F.count("*").alias("n"))
    best = n.groupBy("scene").agg(F.max(F.struct("n", (-C("component")).alias("c"))).alias("m"))
    return best.select("scene", (-C("m.c")).alias("component"), C("m.n").alias("n"))


@query(SEEN + """, i AS (SELECT view_idx, count(DISTINCT point_id%23)::BIGINT AS n FROM seen GROUP BY view_idx) SELECT scene, view_idx, n FROM i JOIN vw USING (view_idx) QUALIFY row_number() OVER (PARTITION BY scene ORDER BY n DESC, view_idx)=1""")
def a_busiest_view(spark, d):
    """The view of each scene that shows most instances; ties to the lower view."""
    n = _seen(spark, d).groupBy("view_idx").agg(F.countDistinct(C("point_id") % 23).alias("n")).join(_views(spark, d).select("view_idx", "scene"), "view_idx")
    best = n.groupBy("scene").agg(F.max(F.struct("n", (-C("view_idx")).alias("v"))).alias("m"))
    return best.select("scene", (-C("m.v")).alias("view_idx"), C("m.n").alias("n"))


@query(SP + """, p AS (SELECT point3d_id AS a, scene, x, y, z, point3d_id%5=0 AS has FROM sp WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) SELECT p.a, q.a AS b FROM p JOIN p q ON p.scene=q.scene AND q.has QUALIFY row_number() OVER (PARTITION BY p.a ORDER BY sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2), q.a)=1""")
def j_nearest_sample(spark, d):
    """Every point takes its nearest sampled point (itself, if sampled), at any distance."""
    s = _sparse(spark, d)
    return S.nearest_k(s, "point3d_id", ["scene"], 4.0, 1, others=s.where("point3d_id % 5 = 0")).select("a", "b")


@query(SP + """, p AS (SELECT point3d_id AS a, scene, x, y, z, floor(sqrt(count(*) OVER (PARTITION BY scene))) AS k FROM sp WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL), n AS (SELECT p.a, p.k, sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2) AS dist, row_number() OVER (PARTITION BY p.a ORDER BY sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2), q.a) AS r FROM p JOIN p q ON p.scene=q.scene AND p.a<>q.a),
 m AS (SELECT a, dist*dist AS d2 FROM n WHERE r<=k), t AS (SELECT avg(d2)+stddev_samp(d2) AS t FROM m) SELECT a, round(avg(d2),3) AS mean_d2 FROM m, t GROUP BY a HAVING avg(d2) >= any_value(t)""")
def j_root_outliers(spark, d):
    """Outliers by the mean squared distance to the root-of-n nearest of their scene."""
    n = S.nearest_k(_sparse(spark, d), "point3d_id", ["scene"], 8.0, lambda n: F.floor(F.sqrt(n)))
    return S.sparse_outliers(n).select("a", _r("mean_d2", 3).alias("mean_d2"))


def _codebook_sql(rounds: int = 5) -> str:
    """Lloyd rounds written out: each is an assignment and a mean."""
    sql = PTS + """, f AS (SELECT point_id, f_dc_0::DOUBLE AS a, f_dc_1::DOUBLE AS b, f_dc_2::DOUBLE AS e FROM pts), c0 AS (SELECT k, CASE WHEN k&1=1 THEN -0.5 ELSE 0.5 END AS ca, CASE WHEN (k>>1)&1=1 THEN -0.5 ELSE 0.5 END AS cb, CASE WHEN (k>>2)&1=1 THEN -0.5 ELSE 0.5 END AS ce FROM range(8) t(k))"""
    for r in range(rounds + 1):
        sql += f", n{r} AS (SELECT f.*, k, sqrt((a-ca)**2+(b-cb)**2+(e-ce)**2) AS dist FROM f, c{r} QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt((a-ca)**2+(b-cb)**2+(e-ce)**2), k)=1)"
        sql += f", c{r + 1} AS (SELECT r.k, coalesce(avg(a),0) AS ca, coalesce(avg(b),0) AS cb, coalesce(avg(e),0) AS ce FROM range(8) r(k) LEFT JOIN n{r} USING (k) GROUP BY r.k)"
    return sql + f" SELECT k::INT AS code, count(*)::BIGINT AS n, round(avg(dist),3) AS mean_dist FROM n{rounds} GROUP BY k"


ORACLES["g_codebook"] = " ".join(_codebook_sql().split())


@query(CLOSE + """, dd AS (SELECT p.scene, p.id AS a, q.id AS b, sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2) AS dist FROM pt p JOIN pt q ON p.scene=q.scene AND p.id<>q.id), kd AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b)<=4),
 la AS (SELECT scene, a, max(dist) AS dist FROM kd GROUP BY ALL), ep AS (SELECT scene, CASE WHEN quantile_cont(dist,0.4)>0 THEN quantile_cont(dist,0.4) ELSE 1e-4 END AS eps FROM la GROUP BY scene),
 nb AS (SELECT a, b FROM dd JOIN ep USING (scene) WHERE dist<=eps), nd AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*)+1>=4), ed AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM nd) AND b IN (SELECT id FROM nd))""" + REACH + """
 , bo AS (SELECT a AS node, min(component) AS near FROM nb JOIN co ON nb.b=co.node GROUP BY a) SELECT pt.id AS point3d_id, coalesce(component, near) AS component FROM pt LEFT JOIN co ON pt.id=co.node LEFT JOIN bo ON pt.id=bo.node""")
def g_dbscan_by_quantile(spark, d):
    """DBSCAN within each scene, with the scene's own eps: the 0.4 quantile of the distances to the fourth nearest other."""
    s = cut(_sparse(spark, d).where("x is not null and y is not null and z is not null").select("scene", "point3d_id", "x", "y", "z"))
    eps = S.neighbour_eps(s, "point3d_id", ["scene"], 4, 0.4, 2.0)
    # such an eps holds few points, so cells may be wide
    return S.dbscan(s.join(eps, "scene"), "point3d_id", ["scene"], "eps", 4, side=3.0)
