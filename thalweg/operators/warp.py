"""Transverse Mercator, degrees and datum shifts as column expressions, and reprojection."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Of a datum: shifts in metres, rotations in seconds of arc (position vector), scale in millionths, to WGS84.
NO_SHIFT = (0.0,) * 7


@dataclass(frozen=True)
class Degrees:
    """A system of longitudes and latitudes."""

    a: float = 6378137.0
    inverse_flattening: float = 298.257223563
    shift: tuple[float, ...] = NO_SHIFT

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    def inverse(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat


@dataclass(frozen=True)
class TransverseMercator:
    """A projection of any ellipsoid, by Krueger's series of the third order in n; lengths are in `unit` metres."""

    central: float
    scale: float
    false_east: float
    false_north: float
    origin: float = 0.0
    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    shift: tuple[float, ...] = NO_SHIFT
    unit: float = 1.0

    @property
    def _n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def _radius(self) -> float:
        n = self._n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def _forward(self) -> tuple[float, ...]:
        n = self._n
        return (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)

    @property
    def _inverse(self) -> tuple[float, ...]:
        n = self._n
        return (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)

    def _northing0(self) -> float:
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s = math.sin(math.radians(self.origin))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return self._radius * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(self._forward)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Degrees to easting and northing."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        d = F.radians(lon - self.central)
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, c in enumerate(self._forward, 1):
            x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        k = self.scale * self._radius
        return self.false_east + k * x / self.unit, self.false_north + (k * y - self.scale * self._northing0()) / self.unit

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Easting and northing to degrees of longitude and latitude."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        k = self.scale * self._radius
        xi0, eta0 = ((north - self.false_north) * self.unit + self.scale * self._northing0()) / k, (east - self.false_east) * self.unit / k
        xi, eta = xi0, eta0
        for j, c in enumerate(self._inverse, 1):
            xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lon = self.central + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))
        # the geographic latitude by a few fixed-point steps
        psi = F.atanh(F.sin(chi))
        s = F.sin(chi)
        for _ in range(6):
            s = F.tanh(psi + e * F.atanh(e * s))
        return lon, F.degrees(F.asin(s))


# Parameters of systems by their codes. Zones of UTM are worked out in system().
AIRY, AIRY_MODIFIED, INTERNATIONAL = (6377563.396, 299.3249646), (6377340.189, 299.3249646), (6378388.0, 297.0)
TO_WGS84 = {"TM65": (482.5, -130.6, 564.6, -1.042, -0.214, -0.631, 8.15), "OSGB36": (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489), "ED50": (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0)}
SYSTEMS = {
    "EPSG:2157": TransverseMercator(-8.0, 0.99982, 600000.0, 750000.0, 53.5),
    "EPSG:32629": TransverseMercator(-9.0, 0.9996, 500000.0, 0.0, inverse_flattening=298.257223563),
    "EPSG:29902": TransverseMercator(-8.0, 1.000035, 200000.0, 250000.0, 53.5, *AIRY_MODIFIED, TO_WGS84["TM65"]),
    "EPSG:29903": TransverseMercator(-8.0, 1.000035, 200000.0, 250000.0, 53.5, *AIRY_MODIFIED, TO_WGS84["TM65"]),
    "EPSG:27700": TransverseMercator(-2.0, 0.9996012717, 400000.0, -100000.0, 49.0, *AIRY, TO_WGS84["OSGB36"]),
    "EPSG:4326": Degrees(),
    "EPSG:4979": Degrees(),
    "EPSG:4258": Degrees(inverse_flattening=298.257222101),
    "EPSG:4173": Degrees(inverse_flattening=298.257222101),
    "EPSG:4277": Degrees(*AIRY, TO_WGS84["OSGB36"]),
    "EPSG:4299": Degrees(*AIRY_MODIFIED, TO_WGS84["TM65"]),
    "EPSG:4230": Degrees(*INTERNATIONAL, TO_WGS84["ED50"]),
}
#: (first code, first zone, zones, south, flattening and datum) of UTM series.
UTM_SERIES = ((32601, 1, 60, False, (6378137.0, 298.257223563), NO_SHIFT), (32701, 1, 60, True, (6378137.0, 298.257223563), NO_SHIFT), (25828, 28, 11, False, (6378137.0, 298.257222101), NO_SHIFT), (23028, 28, 11, False, INTERNATIONAL, TO_WGS84["ED50"]))


def _node(text: str, name: str) -> str | None:
    """What stands in the brackets of the first `name[...]` of a definition."""
    m = re.search(rf"\b{name}\s*[\[(]", text, re.I)
    if not m:
        return None
    depth, at = 1, m.end()
    while depth and at < len(text):
        depth += {"[": 1, "(": 1, "]": -1, ")": -1}.get(text[at], 0)
        at += 1
    return text[m.end() : at - 1]


def _numbers(text: str) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?", re.sub(r'"[^"]*"', "", text))]


def defined(wkt: str) -> Degrees | TransverseMercator:
    """The system of a definition in WKT, as .prj files hold them: degrees, or a Transverse Mercator (UTM, ITM, national grids) with its ellipsoid and datum shift."""
    name = re.search(r'"([^"]*)"', wkt)
    name = name[1] if name else wkt[:40]
    spheroid = _node(wkt, "(?:SPHEROID|ELLIPSOID)")
    if spheroid is None:
        raise ValueError(f"{name}: no ellipsoid in its definition")
    a, inverse_flattening = _numbers(spheroid)[:2]
    shift = _node(wkt, "TOWGS84")
    shift = tuple((_numbers(shift) + [0.0] * 7)[:7]) if shift else next((v for k, v in TO_WGS84.items() if re.search(k if k != "OSGB36" else "OSGB_?(19)?36", _node(wkt, "DATUM") or "", re.I)), NO_SHIFT)
    # without flattening a sphere
    inverse_flattening = inverse_flattening or 1e12
    projection = _node(wkt, "PROJECTION")
    if projection is None:
        return Degrees(a, inverse_flattening, shift)
    if not re.search("transverse_?mercator|gauss_?kruger", projection, re.I) or re.search("oblique|south", projection, re.I):
        raise ValueError(f"{name}: projection {projection.strip()} is not known")
    given = {m[1].lower(): float(m[2]) for m in re.finditer(r'PARAMETER\s*[\[(]\s*"([^"]+)"\s*,\s*([-+\d.eE]+)', wkt, re.I)}
    unit = re.findall(r'\bUNIT\s*[\[(]\s*"[^"]*"\s*,\s*([-+\d.eE]+)', wkt, re.I)
    # the last unit is that of the projection, the first that of its angles
    return TransverseMercator(given.get("central_meridian", 0.0), given.get("scale_factor", 1.0), given.get("false_easting", 0.0), given.get("false_northing", 0.0), given.get("latitude_of_origin", given.get("latitude_of_center", 0.0)), a, inverse_flattening, shift, float(unit[-1]) if len(unit) > 1 else 1.0)


def system(crs: str) -> Degrees | TransverseMercator:
    """The system that a code (EPSG:n) or a definition in WKT names; an unknown one raises with its name."""
    if (code := to_epsg(crs)) is None:
        if crs and "[" in crs:
            return defined(crs)
        raise ValueError(f"system {crs!r} is not known")
    if f"EPSG:{code}" in SYSTEMS:
        return SYSTEMS[f"EPSG:{code}"]
    for first, zone, n, south, ellipsoid, shift in UTM_SERIES:
        if first <= code < first + n:
            return TransverseMercator((zone + code - first) * 6.0 - 183.0, 0.9996, 500000.0, 10000000.0 if south else 0.0, 0.0, *ellipsoid, shift)
    raise ValueError(f"system EPSG:{code} is not known")


def to_epsg(crs: str | None) -> int | None:
    """G7."""
    return int(crs[5:]) if crs and crs.upper().startswith("EPSG:") and crs[5:].isdigit() else None


def is_geographic(crs: str | None) -> bool:
    """G7."""
    try:
        return bool(crs) and isinstance(system(crs), Degrees)
    except ValueError:
        return False


def _geocentric(lon: Column, lat: Column, s: Degrees | TransverseMercator) -> tuple[Column, Column, Column]:
    f = 1 / s.inverse_flattening
    e2 = f * (2 - f)
    lam, phi = F.radians(lon), F.radians(lat)
    n = s.a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)


def _geographic(x: Column, y: Column, z: Column, s: Degrees | TransverseMercator) -> tuple[Column, Column]:
    """On the ellipsoid of s, by Bowring's formula (a few hundredths of a millimetre at these heights)."""
    f = 1 / s.inverse_flattening
    e2, b = f * (2 - f), s.a * (1 - f)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * s.a, p * b)
    top = z + e2 / (1 - e2) * b * F.pow(F.sin(theta), F.lit(3.0))
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(top, p - e2 * s.a * F.pow(F.cos(theta), F.lit(3.0))))


def _shifted(x: Column, y: Column, z: Column, shift: tuple[float, ...]) -> tuple[Column, Column, Column]:
    """Seven parameters, to WGS84."""
    dx, dy, dz = shift[:3]
    rx, ry, rz = (math.radians(r / 3600) for r in shift[3:6])
    m = 1 + shift[6] * 1e-6
    return dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z)


def _unshifted(x: Column, y: Column, z: Column, shift: tuple[float, ...]) -> tuple[Column, Column, Column]:
    """From WGS84: the exact inverse of _shifted()."""
    rx, ry, rz = (math.radians(r / 3600) for r in shift[3:6])
    inverse = np.linalg.inv((1 + shift[6] * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])).tolist()
    x, y, z = x - shift[0], y - shift[1], z - shift[2]
    return tuple(row[0] * x + row[1] * y + row[2] * z for row in inverse)


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates from one system to the other (codes or definitions), with a datum shift where either datum has one; datums without count as WGS84, to which they agree to a metre."""
    if source == target:
        return x, y
    a, b = system(source), system(target)
    if a.shift == b.shift:
        return b.forward(*a.inverse(x, y))
    at = F.struct(x.cast("double").alias("v0"), y.cast("double").alias("v1"))
    steps = ((2, a.inverse), (2, lambda *p: _geocentric(*p, a)), (3, lambda *p: _shifted(*p, a.shift)), (3, lambda *p: _unshifted(*p, b.shift)), (3, lambda *p: _geographic(*p, b)), (2, b.forward))
    for n, step in steps:
        at = _then(at, n, step)
    return at["v0"], at["v1"]


def _then(at: Column, n: int, step: Callable) -> Column:
    """A struct of the columns that step gives for the n of a struct, which are worked out once however often step uses them."""
    return F.get(F.transform(F.array(at), lambda s: F.struct(*[c.alias(f"v{i}") for i, c in enumerate(step(*[s[f"v{i}"] for i in range(n)]))])), F.lit(0))


def bounds_in(boxes: DataFrame, source: str, target: str, edge_points: int = 21) -> DataFrame:
    """Bounds (id, left, bottom, right, top) in another system, along points of each edge."""
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(edge_points - 1)), lambda i: i / (edge_points - 1)))
    p = boxes.withColumn("t", t)
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("t")
    edges = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((at("left", "right"), F.col("bottom")), (at("left", "right"), F.col("top")), (F.col("left"), at("bottom", "top")), (F.col("right"), at("bottom", "top")))])
    p = p.select("id", F.explode(edges).alias("p"))
    x, y = transform(F.col("p.x"), F.col("p.y"), source, target)
    return p.select("id", x.alias("x"), y.alias("y")).groupBy("id").agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"))


def target_grid(left: float, bottom: float, right: float, top: float, width: int, height: int) -> tuple[tuple, int, int]:
    """Transform and size in the target system: square pixels, the same number along the diagonal."""
    step = math.hypot(right - left, top - bottom) / math.hypot(width, height)
    return (step, 0.0, left, 0.0, -step, top), max(1, math.ceil((right - left) / step)), max(1, math.ceil((top - bottom) / step))


def _keys_weight(t: np.ndarray) -> np.ndarray:
    """Of cubic convolution with a = -0.5."""
    t = np.abs(t)
    return np.where(t <= 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))


#: Rows and columns of a source block at most, target pixels that lie in one by the grids' scales, bytes of a task's share.
BLOCK, PLACES, SHARE = 64, 1 << 20, 32 << 20
#: Places weighed in one numpy step.
AT_ONCE = 1 << 16
#: Columns of the strips in which target pixels are numbered, so that those of a batch lie near each other.
STRIP = 128
PACKED = "br bigint, bc bigint, place boolean, at binary, a binary, b binary"


def _block_size(source: str, source_transform: tuple, target: str, transform: tuple) -> int:
    """Smaller where the target is much finer than the source, for a block's places are read by one task."""
    metres = lambda crs: 111320.0 if isinstance(s := system(crs), Degrees) else s.unit
    ratio = 1.0 if source == target else metres(source) / metres(target)
    finer = ratio * math.sqrt(abs(source_transform[0] * source_transform[4] / (transform[0] * transform[4])))
    return max(1, min(BLOCK, int(math.sqrt(PLACES) / finer)))


def _packs(br: np.ndarray, bc: np.ndarray, place: bool, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of PACKED, one for each block of a batch."""
    order = np.lexsort((bc, br))
    br, bc, columns = br[order], bc[order], [x[order] for x in columns]
    first = np.flatnonzero(np.r_[True, (np.diff(br) != 0) | (np.diff(bc) != 0)]) if len(br) else np.zeros(0, np.int64)
    ends = [*first[1:].tolist(), len(br)]
    binary = [pa.array([x[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=False)], pa.binary()) for x in columns]
    binary += [pa.nulls(len(first), pa.binary())] * (3 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(br[first], pa.int64()), pa.array(bc[first], pa.int64()), pa.array([place] * len(first), pa.bool_()), *binary], ["br", "bc", "place", "at", "a", "b"])


def reproject(px: DataFrame, source: str, source_transform: tuple, target: str, grid: tuple[tuple, int, int], method: str = "bilinear", shape: tuple[int, int] = (0, 0)) -> DataFrame:
    """Every target pixel is mapped back to the source and reads 2 x 2 or 4 x 4 pixels; missing ones do not weigh, places that the source system lacks have no pixel.

    Target pixels and source pixels go once, packed, to the source block that the
    target's place lies in, source pixels also to blocks that reach over the edge.
    There they are read in order, the block before the places in it, so that a task
    holds one block and one batch of places. Tasks follow from the numbers of
    pixels: those of the target, and of the source where its `shape` is given.
    """
    if method not in ("bilinear", "cubic"):
        raise ValueError(f"method {method!r} is neither bilinear nor cubic")
    (a, _, c, _, e, f), width, height = grid
    sa, _, sc, _, se, sf = source_transform
    low, high = (0, 1) if method == "bilinear" else (-1, 2)
    near = (lambda d: 1 - np.abs(d)) if method == "bilinear" else _keys_weight
    size = _block_size(source, source_transform, target, grid[0])
    side = size + high - low
    spark, n_bytes = px.sparkSession, 24 * width * height

    strip, rest = F.expr(f"id div {max(1, height) * STRIP}"), F.expr(f"id % {max(1, height) * STRIP}")
    t = spark.range(0, width * height, 1, max(spark.sparkContext.defaultParallelism, -(-n_bytes // SHARE))).select("id", strip.alias("strip"), rest.alias("rest"))
    t = t.withColumn("across", F.least(F.lit(STRIP), width - F.col("strip") * STRIP))
    t = t.select(F.expr("rest div across").alias("row"), (F.col("strip") * STRIP + F.col("rest") % F.col("across")).alias("col"))
    x, y = transform(c + (F.col("col") + 0.5) * a, f + (F.col("row") + 0.5) * e, target, source)
    t = t.select((F.col("row") * width + F.col("col")).alias("id"), ((y - sf) / se - 0.5).cast("double").alias("sr"), ((x - sc) / sa - 0.5).cast("double").alias("sc"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, sr, sc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            there = (np.abs(sr) < 2.0**40) & (np.abs(sc) < 2.0**40)  # neither NaN
            i, sr, sc = i[there], sr[there], sc[there]
            yield _packs(*(np.floor(q).astype(np.int64) // size for q in (sr, sc)), True, i, sr, sc)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = range(-(-(high - low) // size) + 1)
        for batch in batches:
            r, c, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            parts = []
            for br in ((r - high) // size + k for k in steps):
                for bc in ((c - high) // size + k for k in steps):
                    at = np.flatnonzero((br * size <= r - low) & (bc * size <= c - low))
                    parts.append((br[at], bc[at], ((r - br * size - low) * side + c - bc * size - low)[at].astype(np.int32), v[at]))
            br, bc, at, v = map(np.concatenate, zip(*parts, strict=True))
            yield _packs(br, bc, False, at, v)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, s = None, None, None
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for (br, bc, place), run in groupby(enumerate(keys), lambda x: x[1]):
                run = [i for i, _ in run]
                column = lambda k, kind: np.frombuffer(b"".join(batch.column(k).slice(run[0], len(run)).to_pylist()), kind)  # noqa: B023, E731
                if now != (br, bc):
                    now, n = (br, bc), None
                if not place:
                    if n is None:
                        n, s = np.zeros(side * side), np.zeros(side * side)
                    at = column(3, np.int32)
                    np.add.at(n, at, 1.0)
                    np.add.at(s, at, column(4, np.float64))
                elif n is not None:
                    i, sr, sc = column(3, np.int64), column(4, np.float64), column(5, np.float64)
                    for k in range(0, len(i), AT_ONCE):
                        yield weighed(br, bc, n, s, i[k : k + AT_ONCE], sr[k : k + AT_ONCE], sc[k : k + AT_ONCE])

    def weighed(br: int, bc: int, n: np.ndarray, s: np.ndarray, i: np.ndarray, sr: np.ndarray, sc: np.ndarray) -> pa.RecordBatch:
        r, c = np.floor(sr), np.floor(sc)
        first = ((r - br * size) * side + c - bc * size).astype(np.int64)
        weight, total = np.zeros(len(i)), np.zeros(len(i))
        across = [near(sc - c - q) for q in range(low, high + 1)]
        for p in range(high - low + 1):
            down = near(sr - r - low - p)
            for q, w in enumerate(across):
                w, at = down * w, first + p * side + q
                weight += w * n[at]
                total += w * s[at]
        kept = np.abs(weight) > 1e-9
        i = i[kept]
        return pa.RecordBatch.from_arrays([pa.array(i // width), pa.array(i % width), pa.array(total[kept] / weight[kept])], ["r", "c", "v"])

    sources = px.filter(F.col("v").isNotNull()).select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("v").cast("double").alias("v"))
    both = sources.mapInArrow(pieces, PACKED).unionAll(t.mapInArrow(places, PACKED))
    tasks = -(-(n_bytes + 12 * shape[0] * shape[1]) // SHARE)
    dealt = both.repartition(tasks, "br", "bc") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else both.repartition("br", "bc")
    return dealt.sortWithinPartitions("br", "bc", "place").mapInArrow(read, "r bigint, c bigint, v double")
