"""Camera geometry as column expressions: axes, ground points, poses, lens models, radiometric factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagonal of a 35 mm frame, focal length where none is known, reach of a ray in heights, shallowest downward ray.
FULL_FRAME, DEFAULT_FOCAL, RANGE_FACTOR, LEAST_DOWN = 43.27, 24.0, 4.0, 1e-3


def focal_px(focal_35mm: Column, width: Column, height: Column) -> Column:
    """Focal length in pixels from the 35 mm equivalent (or the default)."""
    return F.coalesce(F.when(focal_35mm > 0, focal_35mm), F.lit(DEFAULT_FOCAL)) / FULL_FRAME * F.hypot(width.cast("double"), height.cast("double"))


def camera_axes(yaw: Column, pitch: Column) -> Column:
    """Struct of the camera's axes (right, down, forward) in east, north, up: x, y, z, each an array of three."""
    tilt, turn = F.radians(pitch + 90.0), F.radians(yaw)
    ct, st, cy, sy = F.cos(tilt), F.sin(tilt), F.cos(turn), F.sin(turn)
    spin = lambda e, n, u: F.array(cy * e + sy * n, -sy * e + cy * n, u)
    zero = F.lit(0.0)
    return F.struct(spin(F.lit(1.0), zero, zero).alias("x"), spin(zero, -ct, -st).alias("y"), spin(zero, st, -ct).alias("z"))


def ground_point(e: Column, n: Column, height: Column, yaw: Column, pitch: Column, focal: Column, width: Column, height_px: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Where the ray of pixel (u, v) meets flat ground, no farther than RANGE_FACTOR heights."""
    a = camera_axes(yaw, pitch)
    fx, fy = (u - width / 2.0) / focal, (v - height_px / 2.0) / focal
    d = [fx * a["x"][i] + fy * a["y"][i] + a["z"][i] for i in range(3)]
    t = height / -F.least(d[2], F.lit(-LEAST_DOWN))
    dx, dy = t * d[0], t * d[1]
    far = F.hypot(dx, dy)
    shrink = F.when(far > RANGE_FACTOR * height, RANGE_FACTOR * height / far).otherwise(1.0)
    return e + dx * shrink, n + dy * shrink


def border_points(width: Column, height: Column, samples: int = 5) -> Column:
    """Array of structs (i, u, v): `samples` points on each side, around the frame."""
    steps = [k / (samples - 1) for k in range(samples)]
    sides = [*((s, 0.0) for s in steps), *((1.0, s) for s in steps), *((s, 1.0) for s in reversed(steps)), *((0.0, s) for s in reversed(steps))]
    return F.array(*(F.struct(F.lit(i).alias("i"), (width * p).alias("u"), (height * q).alias("v")) for i, (p, q) in enumerate(sides)))


def rotation_from_opk(omega: Column, phi: Column, kappa: Column) -> Column:
    """World to camera rotation (row-major array of nine) of photogrammetric angles in degrees; the camera looks along +z, y down."""
    o, p, k = F.radians(omega), F.radians(phi), F.radians(kappa)
    co, so, cp, sp, ck, sk = F.cos(o), F.sin(o), F.cos(p), F.sin(p), F.cos(k), F.sin(k)
    m = [cp * ck, co * sk + so * sp * ck, so * sk - co * sp * ck, -cp * sk, co * ck - so * sp * sk, so * ck + co * sp * sk, sp, -so * cp, co * cp]
    return F.array(*m[:3], *(-x for x in m[3:]))


def opk_from_rotation(r: Column) -> Column:
    """Struct omega, phi, kappa in degrees of a world to camera rotation."""
    m = [r[i] if i < 3 else -r[i] for i in range(9)]
    return F.struct(F.degrees(F.atan2(-m[7], m[8])).alias("omega"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[6])))).alias("phi"), F.degrees(F.atan2(-m[3], m[0])).alias("kappa"))


def rotation_vector(r: Column) -> Column:
    """Axis times angle of a rotation below a half turn."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1.0) / 2.0))
    angle = F.acos(c)
    k = F.when(F.abs(F.sin(angle)) > 1e-12, angle / (2.0 * F.sin(angle))).otherwise(0.5)
    return F.array(k * (r[7] - r[5]), k * (r[2] - r[6]), k * (r[3] - r[1]))


def rig_rotation(rx: Column, ry: Column, rz: Column) -> Column:
    """Rx Ry Rz of angles in degrees."""
    a, b, c = F.radians(rx), F.radians(ry), F.radians(rz)
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return F.array(cb * cc, -cb * sc, sb, ca * sc + sa * sb * cc, ca * cc - sa * sb * sc, -sa * cb, sa * sc - ca * sb * cc, sa * cc + ca * sb * sc, ca * cb)


def times(a: Column, b: Column) -> Column:
    """Product of two row-major 3x3 matrices."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def transposed(a: Column) -> Column:
    return F.array(*(a[3 * j + i] for i in range(3) for j in range(3)))


def band_from_reference(band: Column, reference: Column) -> Column:
    """Rotation from the reference band's camera to another band's (both world to camera or rig rotations)."""
    return times(transposed(band), reference)


def to_camera(r: Column, t: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2] * z + t[i] for i in range(3)]


def projection_matrix(k: Column, r: Column, t: Column) -> Column:
    """K [R | t], row-major 3x4."""
    rt = [[r[3 * i + j] for j in range(3)] + [t[i]] for i in range(3)]
    return F.array(*(k[3 * i] * rt[0][j] + k[3 * i + 1] * rt[1][j] + k[3 * i + 2] * rt[2][j] for i in range(3) for j in range(4)))


# Lens models and the places of fx, fy, cx, cy, k1, k2, p1, p2, k3 in their parameters (-1: zero).
LENS_MODELS = {
    "SIMPLE_PINHOLE": (0, 0, 1, 2, -1, -1, -1, -1, -1),
    "PINHOLE": (0, 1, 2, 3, -1, -1, -1, -1, -1),
    "SIMPLE_RADIAL": (0, 0, 1, 2, 3, -1, -1, -1, -1),
    "RADIAL": (0, 0, 1, 2, 3, 4, -1, -1, -1),
    "OPENCV": (0, 1, 2, 3, 4, 5, 6, 7, -1),
    "FULL_OPENCV": (0, 1, 2, 3, 4, 5, 6, 7, 8),
}


def intrinsics(model: Column, params: Column) -> Column:
    """Struct of fx, fy, cx, cy, k1, k2, p1, p2, k3; null for an unknown model."""
    out = F.lit(None).cast("struct<fx:double,fy:double,cx:double,cy:double,k1:double,k2:double,p1:double,p2:double,k3:double>")
    for name, places in LENS_MODELS.items():
        fields = [(F.coalesce(F.try_element_at(params, F.lit(i + 1)), F.lit(0.0)) if i >= 0 else F.lit(0.0)).alias(n) for n, i in zip(("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3"), places)]
        out = F.when(model == name, F.struct(*fields)).otherwise(out)
    return out


def distorted(c: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel of normalised image coordinates under the intrinsics struct c."""
    q = x * x + y * y
    radial = 1.0 + q * (c["k1"] + q * (c["k2"] + q * c["k3"]))
    dx, dy = x * radial + 2.0 * c["p1"] * x * y + c["p2"] * (q + 2.0 * x * x), y * radial + c["p1"] * (q + 2.0 * y * y) + 2.0 * c["p2"] * x * y
    return c["fx"] * dx + c["cx"], c["fy"] * dy + c["cy"]


def undistorted(c: Column, u: Column, v: Column, rounds: int = 20) -> Column:
    """Struct x, y of a pixel's normalised image coordinates: the inverse of distorted(), by fixed-point steps."""
    x0, y0 = (u - c["cx"]) / c["fx"], (v - c["cy"]) / c["fy"]

    def step(p, _):
        x, y = p["x"], p["y"]
        q = x * x + y * y
        radial = 1.0 + q * (c["k1"] + q * (c["k2"] + q * c["k3"]))
        dx, dy = 2.0 * c["p1"] * x * y + c["p2"] * (q + 2.0 * x * x), c["p1"] * (q + 2.0 * y * y) + 2.0 * c["p2"] * x * y
        return F.struct(((x0 - dx) / radial).alias("x"), ((y0 - dy) / radial).alias("y"))

    plain = (c["k1"] == 0) & (c["k2"] == 0) & (c["k3"] == 0) & (c["p1"] == 0) & (c["p2"] == 0)
    return F.aggregate(F.when(plain, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(rounds))), F.struct(x0.alias("x"), y0.alias("y")), step)


def centre(r: Column, t: Column) -> list[Column]:
    """Where the camera stands."""
    return [-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)]


def once(value: Column, f) -> Column:
    """f of a value that is made once, however often f names it (through an array of one)."""
    return F.transform(F.array(value), f)[0]


def pixel(c: Column, r: Column, t: Column, x: Column, y: Column, z: Column) -> Column:
    """Struct u, v of project()."""
    p = to_camera(r, t, x, y, z)
    return once(
        F.struct(*(a.alias(n) for a, n in zip(p, ("x", "y", "z")))),
        lambda p: once(
            F.struct(F.when(p["z"] > 0, F.try_divide(p["x"], p["z"])).alias("x"), F.when(p["z"] > 0, F.try_divide(p["y"], p["z"])).alias("y")),
            lambda q: F.struct(*(a.alias(n) for a, n in zip(distorted(c, q["x"], q["y"]), ("u", "v")))),
        ),
    )


def ray(c: Column, r: Column, u: Column, v: Column) -> Column:
    """Unit direction in the world (array of three) of a pixel's ray."""
    sized = once(undistorted(c, u, v), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + 1.0).alias("size")))
    return once(sized, lambda p: F.array(*((r[i] * p["x"] + r[3 + i] * p["y"] + r[6 + i]) / p["size"] for i in range(3))))


def on_plane(c: list[Column], d: Column, z: Column) -> list[Column]:
    """Where a ray from c meets the level z; null if it does not point down."""
    return [F.when(d[2] < -1e-9, c[i] + (z - c[2]) / d[2] * d[i]) for i in range(2)] + [F.when(d[2] < -1e-9, z)]


def project(c: Column, r: Column, t: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a world point; null behind the camera."""
    p = to_camera(r, t, x, y, z)
    u, v = distorted(c, p[0] / p[2], p[1] / p[2])
    front = p[2] > 0
    return F.when(front, u), F.when(front, v)


def in_image(u: Column, v: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    return (u >= margin) & (u < width - margin) & (v >= margin) & (v < height - margin)


def vignette(radial: Column, x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Inverse of 1 + sum k_i r^i (i from 1) about the optical centre; 1 without coefficients."""
    r = F.hypot(x - cx, y - cy)
    # Horner from the last coefficient
    poly = F.aggregate(F.reverse(radial), F.lit(0.0), lambda acc, k: (acc + k) * r)
    return F.when(F.size(radial) > 0, 1.0 / (1.0 + poly)).otherwise(1.0)


def vignette_2d(coefficients: Column, px: Column, py: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Inverse of sum c_i (x/W)^a_i (y/H)^b_i."""
    terms = F.arrays_zip(coefficients.alias("c"), px.alias("a"), py.alias("b"))
    return 1.0 / F.aggregate(terms, F.lit(0.0), lambda acc, s: acc + s["c"] * F.pow(x / width, s["a"]) * F.pow(y / height, s["b"]))


def radiance(raw: Column, black: Column, vig: Column, row: Column, a1: Column, a2: Column, a3: Column, gain: Column, exposure: Column, bits: Column) -> Column:
    """(raw - black) V R a1 / (gain t 2^bits) with R = 1 / (1 + a2 row / t - a3 row); negatives stay. Null without calibration."""
    return (raw - black) * vig / (1.0 + a2 * row / exposure - a3 * row) * a1 / (gain * exposure * F.pow(F.lit(2.0), bits))


def full_lens(c: Column) -> Column:
    """Parameters of the fullest lens model of an intrinsics struct: fx, fy, cx, cy, k1, k2, p1, p2, k3 and three zeros."""
    return F.array(*(c[n] for n in ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")), *(F.lit(0.0),) * 3)


def lens_text(c: Column) -> Column:
    """full_lens() as text, ten significant digits each."""
    return F.array_join(F.transform(full_lens(c), significant), ",")


def significant(value: Column) -> Column:
    """A number to ten significant digits, as text without trailing zeros."""
    return F.regexp_replace(F.format_string("%.9e", value).cast("decimal(38,18)").cast("string"), r"\.?0+$", "")


def matrix(c: Column, shift: float = 0.5) -> Column:
    """K (row-major array of nine) whose pixel centres are whole numbers."""
    zero = F.lit(0.0)
    return F.array(c["fx"], zero, c["cx"] - shift, zero, c["fy"], c["cy"] - shift, zero, zero, F.lit(1.0))


def distortion(c: Column) -> Column:
    """k1, k2, p1, p2, k3."""
    return F.array(*(c[n] for n in ("k1", "k2", "p1", "p2", "k3")))
