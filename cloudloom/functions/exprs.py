"""Column expressions on points, vectors, rotations and names. All run inside generated code; nulls give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the constant of the zeroth spherical harmonic.
SH0 = 0.28209479177387814


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    """Null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1.0 - p)))


def quality(opacity: Column, *log_scales: Column) -> Column:
    """Sharp and opaque points score high: sigmoid(opacity) / (1 + largest scale)."""
    return sigmoid(opacity) / (1.0 + F.exp(F.greatest(*log_scales)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalise(a: Column, mode: str = "plain") -> Column:
    """Unit vector. ``plain``: a zero vector stays (norm below 1e-8 counts as 1); ``soft``: 1e-6 is added to the norm."""
    n = norm(a)
    by = n + 1e-6 if mode == "soft" else F.when(n < 1e-8, 1.0).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / by)


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def rotation(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Row-major rotation matrix of a quaternion, which is normalised first; null for a zero quaternion."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.when(n > 0, c / n) for c in (w, x, y, z))
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def covariance(r: list[Column], scales: list[Column]) -> list[Column]:
    """Upper triangle xx xy xz yy yz zz of R S S' R'."""
    m = [[r[3 * i + k] * scales[k] for k in range(3)] for i in range(3)]
    return [sum(m[i][k] * m[j][k] for k in range(3)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def sh_colour(dc: Column) -> Column:
    """Display value of a zeroth coefficient, clipped to [0, 1]."""
    return F.least(F.greatest(dc * SH0 + 0.5, F.lit(0.0)), F.lit(1.0))


# The constants of the sRGB transfer curve.
def srgb_to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def fov(focal: Column, pixels: Column) -> Column:
    return 2.0 * F.atan(pixels / (2.0 * focal))


def focal(angle: Column, pixels: Column) -> Column:
    return pixels / (2.0 * F.tan(angle / 2.0))


def cell(x: Column, low: Column, side: float) -> Column:
    return F.floor((x - low) / side)


def palette(i: Column) -> list[Column]:
    """Colour of an id; id 0 is black."""
    return [F.when(i == 0, 0).otherwise(F.pmod(i * k + o, F.lit(256))) for k, o in ((53, 29), (97, 71), (193, 113))]


def safe_name(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore; runs of anything else become one underscore; ``unnamed`` if nothing is left."""
    s = F.regexp_replace(F.trim(name), r"[^0-9A-Za-z._-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise("unnamed")


def stem(path: Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1), r"\.[^.]*$", "")


def phrase_id(text: Column, rules: list[tuple[str, int]], other: int = 0) -> Column:
    """Id of the first rule whose pattern is found in the trimmed lower-case text; ``other`` if none is, or for null."""
    t = F.lower(F.trim(text))
    out = F.lit(other)
    for pattern, i in reversed(rules):
        out = F.when(t.rlike(pattern), F.lit(i)).otherwise(out)
    return out


def drive_path(path: Column) -> Column:
    """A path with forward slashes; a drive letter becomes a mount point."""
    p = F.translate(path, "\\", "/")
    return F.when(p.rlike("^[A-Za-z]:/"), F.concat(F.lit("/mnt/"), F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(3)))).otherwise(p)


def fill(template: str, label: Column) -> Column:
    """The template with each {label} replaced."""
    return F.replace(F.lit(template), F.lit("{label}"), label)


def compact_name(name: Column) -> Column:
    """Lower-case name with runs of anything but letters and digits as one underscore, without underscores at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^0-9a-z]+", "_"), r"^_+|_+$", "")


def file_name(name: Column, most: int = 80) -> Column:
    """Name that any file system takes: reserved and control characters go, spaces become underscores, at most ``most`` characters;
    ``unnamed`` if nothing is left."""
    s = F.substring(F.regexp_replace(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "")), r"\s+", "_"), 1, most)
    return F.when(F.length(s) > 0, s).otherwise("unnamed")


def label_map(text: Column) -> Column:
    """MAP of id to label out of ``id:label`` or ``label:id`` entries parted by commas; entries without a number are passed over, and of
    several entries of one id the last counts."""
    entry = F.transform(F.filter(F.split(text, ","), lambda e: e.contains(":")), lambda e: F.split(e, ":", 2))
    pair = F.transform(entry, lambda p: F.when(F.trim(p[0]).try_cast("int").isNotNull(), F.struct(F.trim(p[0]).try_cast("int").alias("k"), F.trim(p[1]).alias("v"))).otherwise(F.struct(F.trim(p[1]).try_cast("int").alias("k"), F.trim(p[0]).alias("v"))))
    good = F.filter(pair, lambda p: p["k"].isNotNull())
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def int_list(text: Column) -> Column:
    """Whole numbers of a list parted by commas or spaces; anything else is passed over."""
    return F.filter(F.transform(F.split(F.trim(text), r"[,\s]+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def resolve_label(text: Column, labels: list[tuple[int, str]]) -> Column:
    """Id of a text: a number stands for itself, else the label that equals it in any case, else the first that contains it or that it
    contains; null if none does or the text is empty. ``labels`` is a short list in the order of preference."""
    t = F.lower(F.trim(text))
    out = F.lit(None).cast("int")
    for i, label in reversed(labels):
        out = F.when(F.lit(label.lower()).contains(t) | t.contains(label.lower()), F.lit(i)).otherwise(out)
    for i, label in reversed(labels):
        out = F.when(t == label.lower(), F.lit(i)).otherwise(out)
    return F.when(F.length(t) > 0, F.coalesce(t.try_cast("int"), out))


def feature_byte(f: Column) -> Column:
    """A feature in [-1, 1] as a byte: (f + 1) / 2 * 255, clipped and truncated."""
    return F.floor(F.least(F.greatest((f.cast("double") + 1.0) / 2.0 * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int")


def highlight(colour: list[Column], marked: Column, strength: float = 0.7) -> list[Column]:
    """Colour in [0, 1] drawn towards red where marked."""
    return [F.when(marked, c * (1.0 - strength) + strength * float(k == 0)).otherwise(c) for k, c in enumerate(colour)]


def packed_cell(x: Column, y: Column) -> Column:
    """Two whole cell numbers as one key: the first in the upper 32 bits, the second in the lower."""
    return F.shiftleft(x.cast("bigint"), 32).bitwiseOR(y.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def matrix_quaternion(r: list[Column]) -> list[Column]:
    """Unit quaternion (w >= 0) of a row-major rotation matrix, from its greatest component, so it is stable at every angle."""
    s = [1 + r[0] + r[4] + r[8], 1 + r[0] - r[4] - r[8], 1 - r[0] + r[4] - r[8], 1 - r[0] - r[4] + r[8]]
    big = F.greatest(*s)
    d = 2 * F.sqrt(big)
    cross = [[d / 4, (r[7] - r[5]) / d, (r[2] - r[6]) / d, (r[3] - r[1]) / d], [(r[7] - r[5]) / d, d / 4, (r[1] + r[3]) / d, (r[2] + r[6]) / d],
             [(r[2] - r[6]) / d, (r[1] + r[3]) / d, d / 4, (r[5] + r[7]) / d], [(r[3] - r[1]) / d, (r[2] + r[6]) / d, (r[5] + r[7]) / d, d / 4]]
    q = [F.when(s[0] == big, cross[0][k]).when(s[1] == big, cross[1][k]).when(s[2] == big, cross[2][k]).otherwise(cross[3][k]) for k in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return [sign * c for c in q]


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    """a * b, both as w, x, y, z."""
    w, x, y, z = a
    p, q, r, s = b
    return [w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p]


def homogeneous(m: list[float], x: Column, y: Column, z: Column) -> list[Column]:
    """x, y, z after a 4 x 4 matrix (row-major) and the division by w + 1e-7."""
    v = [float(m[4 * i]) * x + float(m[4 * i + 1]) * y + float(m[4 * i + 2]) * z + float(m[4 * i + 3]) for i in range(4)]
    return [c / (v[3] + 1e-7) for c in v[:3]]


def perspective(near: float, far: float, fov_x: float, fov_y: float) -> list[float]:
    """4 x 4 projection (row-major) with depth from 0 at ``near`` to 1 at ``far``."""
    tx, ty = math.tan(fov_x / 2), math.tan(fov_y / 2)
    return [1 / tx, 0, 0, 0, 0, 1 / ty, 0, 0, 0, 0, far / (far - near), -far * near / (far - near), 0, 0, 1, 0]


def orthographic(left: float, right: float, bottom: float, top: float, near: float, far: float) -> list[float]:
    """4 x 4 projection (row-major) of a box to x, y in [-1, 1] and depth in [0, 1]."""
    return [2 / (right - left), 0, 0, -(right + left) / (right - left), 0, 2 / (top - bottom), 0, -(top + bottom) / (top - bottom), 0, 0, 1 / (far - near), -near / (far - near), 0, 0, 0, 1]


def view_matrix(r: list[Column], t: list[Column], shift: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 1.0) -> list[Column]:
    """World-to-view rows (12) of a pose (rotation rows, translation) whose camera centre is moved by ``shift`` and then scaled."""
    centre = [-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)]
    centre = [(c + s) * scale for c, s in zip(centre, shift)]
    rows = []
    for i in range(3):
        rows += [r[3 * i], r[3 * i + 1], r[3 * i + 2], -(r[3 * i] * centre[0] + r[3 * i + 1] * centre[1] + r[3 * i + 2] * centre[2])]
    return rows


# The constants of the spherical harmonics of degree 1 to 4, by degree and order.
SH = [
    [0.4886025119029199],
    [1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396],
    [-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435],
    [2.5033429417967046, -1.7701307697799304, 0.9461746957575601, -0.6690465435572892, 0.10578554691520431, -0.6690465435572892, 0.47308734787878004, -1.7701307697799304, 0.6258357354491761],
]


def harmonic_basis(degree: int, x: Column, y: Column, z: Column) -> list[Column]:
    """The harmonics of degree 1 to ``degree`` in the unit direction x, y, z, in the order of their coefficients."""
    out = [-SH[0][0] * y, SH[0][0] * z, -SH[0][0] * x]
    xx, yy, zz, xy, yz, xz = x * x, y * y, z * z, x * y, y * z, x * z
    if degree > 1:
        out += [c * p for c, p in zip(SH[1], (xy, yz, 2 * zz - xx - yy, xz, xx - yy))]
    if degree > 2:
        out += [c * p for c, p in zip(SH[2], (y * (3 * xx - yy), xy * z, y * (4 * zz - xx - yy), z * (2 * zz - 3 * xx - 3 * yy), x * (4 * zz - xx - yy), z * (xx - yy), x * (xx - 3 * yy)))]
    if degree > 3:
        out += [
            c * p
            for c, p in zip(
                SH[3],
                (xy * (xx - yy), yz * (3 * xx - yy), xy * (7 * zz - 1), yz * (7 * zz - 3), zz * (35 * zz - 30) + 3, xz * (7 * zz - 3), (xx - yy) * (7 * zz - 1), xz * (xx - 3 * yy), xx * (xx - 3 * yy) - yy * (3 * xx - yy)),
            )
        ]
    return out


def sh_dc(colour: Column) -> Column:
    """Zeroth coefficient of a display value; the inverse of ``sh_colour`` within its range."""
    return (colour - 0.5) / SH0


def masked_mean(error: Column, mask: Column) -> Column:
    """Aggregate: sum of the errors under the mask over its size, at least 1."""
    return F.sum(F.when(mask, error).otherwise(0.0)) / F.greatest(F.count_if(mask), F.lit(1))
