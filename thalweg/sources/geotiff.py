"""GeoTIFF as a Python data source and sink: format("geotiff"), a row for each strip or tile and band.

Reads files, folders and globs on any file system that Arrow reaches (local and
shared paths, hdfs, s3, gcs); uncompressed or deflate, predictors 1 to 3, strips
or tiles, bands beside each other or in planes. Each strip or tile is a partition
of its own and is read by offset; filters on the columns that place a block
(raster_id, band, block_row, block_col, row0, col0, h, w) are pushed down after
register(spark), so that only what they leave is read.

df.write.format("geotiff").save(path) writes one tiled file from many tasks:
tasks compress blocks into part files beside it, the commit lays out the offsets
and joins the parts, an abort removes them. export_blocks() writes a file for
each block instead; write_strip_tiff() writes a small raster from the driver.
"""

from __future__ import annotations

import json
import operator
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import RASTER_BLOCK, RASTER_META

# Fixed values of the TIFF format: bytes of each field type, and sample kinds.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
LETTERS = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def expanded(path: str) -> list[str]:
    """The files of a path: itself, those that a glob matches, or the .tif and .tiff files of a folder; sorted."""
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    system_, place = located(path)
    if any(x in place for x in "*?["):
        top = PurePosixPath(place)
        while any(x in str(top) for x in "*?["):
            top = top.parent
        found = system_.get_file_info(fs.FileSelector(str(top), recursive=True, allow_not_found=True))
        places = [f.path for f in found if f.is_file and PurePosixPath(f.path).match(place)]
    elif system_.get_file_info(place).type == fs.FileType.Directory:
        places = [f.path for f in system_.get_file_info(fs.FileSelector(place)) if f.is_file and f.path.lower().endswith((".tif", ".tiff"))]
    else:
        return [path]
    return [prefix + p for p in sorted(places)]


def read_tags(path: str) -> tuple[str, dict[int, list]]:
    """Byte order and tags of the first image; classic and big TIFF."""
    system_, place = located(path)
    with system_.open_input_file(place) as f:
        head = f.read(16)
        order = "<" if head[:2] == b"II" else ">"
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        f.seek(struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0])
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        entries = [f.read(20 if big else 12) for _ in range(n)]
        tags: dict[int, list] = {}
        for e in entries:
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            raw, size = e[12 if big else 8 :], count * SIZES.get(kind, 1)
            if size > len(raw):
                f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
                raw = f.read(size)
            if kind == 2:
                tags[tag] = [raw[:size].split(b"\0")[0].decode()]
            elif kind in LETTERS:
                tags[tag] = list(struct.unpack(f"{order}{count}{LETTERS[kind]}", raw[:size]))
        return order, tags


def system(tags: dict[int, list]) -> str | None:
    """The code of the projected or else the geographic system among the GeoKeys."""
    keys = tags.get(34735, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(3072, codes.get(2048))
    return None if code in (None, 32767) else f"EPSG:{code}"


def metadata(path: str) -> dict:
    """Size, transform and nodata without any pixel."""
    _, t = read_tags(path)
    step, tie = t.get(33550, [1.0, 1.0, 0.0]), t.get(33922, [0.0] * 6)
    return {"width": t[256][0], "height": t[257][0], "transform": (step[0], 0.0, tie[3] - tie[0] * step[0], 0.0, -step[1], tie[4] + tie[1] * step[1]), "nodata": float(t[42113][0]) if 42113 in t else None}


def described(path: str) -> dict:
    """metadata() with the number of bands, the system and the type of the values."""
    _, t = read_tags(path)
    kind = {"u": "uint", "i": "int", "f": "float"}[KINDS[t.get(339, [1])[0]]] + str(t[258][0])
    return metadata(path) | {"bands": t.get(277, [1])[0], "crs": system(t), "dtype": kind}


def raster_meta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row of RASTER_META for each file, read on the executors."""

    def read(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for path in frame["path"]:
                m = described(path)
                a, _, c, _, e, f = m["transform"]
                names = ("left", "bottom", "right", "top")
                bounds = dict(zip(names, (c, f + m["height"] * e, c + m["width"] * a, f), strict=True))
                rows.append((path.rsplit("/", 1)[-1], m["width"], m["height"], dict(zip("abcdef", m["transform"], strict=True)), m["crs"], m["nodata"], m["dtype"], bounds))
            yield pd.DataFrame(rows, columns=["raster_id", "width", "height", "transform", "crs", "nodata", "dtype", "bounds"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(read, RASTER_META)


def decode(raw: bytes, rows: int, cols: int, order: str, tags: dict[int, list], bands: int = 1) -> np.ndarray:
    """(rows, cols, bands) of one strip or tile."""
    compression, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif compression != 1:
        raise ValueError(f"compression {compression} is not supported")
    width = tags[258][0] // 8
    kind = f"{KINDS[tags.get(339, [1])[0]]}{width}"
    across = cols * bands
    if predictor == 3:
        data = np.frombuffer(raw, np.uint8)[: rows * across * width].reshape(rows, cols * width, bands).cumsum(axis=1, dtype=np.uint8)
        return np.ascontiguousarray(data.reshape(rows, width, across).transpose(0, 2, 1)).view(">" + kind).reshape(rows, cols, bands)
    out = np.frombuffer(raw, order + kind)[: rows * across].reshape(rows, cols, bands)
    return out.cumsum(axis=1, dtype=out.dtype) if predictor == 2 else out


class Block(InputPartition):
    """A strip or tile of a file; `columns` are the values that its rows have in common."""

    def __init__(self, path: str, columns: dict, rows: int, cols: int, offset: int, size: int, bands: list[int]) -> None:
        self.path, self.columns, self.rows, self.cols, self.offset, self.size, self.bands = path, columns, rows, cols, offset, size, bands


#: Columns known before a block is read.
PLACES = ("raster_id", "band", "block_row", "block_col", "row0", "col0", "h", "w")
_COMPARE: dict[type, Callable] = {ds.EqualTo: operator.eq, ds.EqualNullSafe: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.In: lambda x, some: x in some}


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        given = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths = [p for g in given for p in expanded(g)]
        if not self.paths:
            raise FileNotFoundError(f"no GeoTIFF at {', '.join(given)}")
        self.raster_id = options.get("raster_id")
        self.window = tuple(int(x) for x in options["window"].split(",")) if "window" in options else None
        self.tests: list[tuple[str, Callable, object]] = []

    def passes(self, columns: dict) -> bool:
        return all(test(columns[c], value) for c, test, value in self.tests if c in columns)

    def partitions(self) -> list[Block]:
        out = []
        for path in self.paths:
            _, t = read_tags(path)
            width, height = t[256][0], t[257][0]
            bw, bh = (t[322][0], t[323][0]) if 322 in t else (width, t.get(278, [height])[0])
            offsets, sizes = (t[324], t[325]) if 324 in t else (t[273], t[279])
            across, name = -(-width // bw), self.raster_id or path.rsplit("/", 1)[-1]
            of_plane = across * -(-height // bh)
            chunky = t.get(277, [1])[0] if t.get(284, [1])[0] == 1 else 0
            for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
                row, col = divmod(i % of_plane, across)
                columns = {"raster_id": name, "block_row": row, "block_col": col, "row0": row * bh, "col0": col * bw, "h": min(bh, height - row * bh), "w": min(bw, width - col * bw)}
                bands = [b for b in (range(1, chunky + 1) if chunky else [i // of_plane + 1]) if self.passes(columns | {"band": b})]
                inside = self.window is None or (columns["row0"] < self.window[2] and columns["row0"] + bh > self.window[0] and columns["col0"] < self.window[3] and columns["col0"] + bw > self.window[1])
                if inside and bands:
                    out.append(Block(path, columns, bh if 322 in t else columns["h"], bw, offset, size, bands))
        return out

    def read(self, partition: Block) -> Iterator[tuple]:
        order, t = read_tags(partition.path)
        bands = t.get(277, [1])[0] if t.get(284, [1])[0] == 1 else 1
        nodata = float(t[42113][0]) if 42113 in t else None
        c = partition.columns
        if partition.size:
            system_, place = located(partition.path)
            with system_.open_input_file(place) as f:
                f.seek(partition.offset)
                data = decode(f.read(partition.size), partition.rows, partition.cols, order, t, bands)
            data = data[: c["h"], : c["w"]].astype(float)
        else:  # a tile that was never written
            data = np.full((c["h"], c["w"], bands), np.nan)
        for k in partition.bands:
            plane = data[:, :, k - 1 if bands > 1 else 0]
            values = [None if v != v or v == nodata else v for v in plane.ravel().tolist()]
            yield (c["raster_id"], k, c["block_row"], c["block_col"], c["row0"], c["col0"], c["h"], c["w"], values)


class PushingReader(GeoTiffReader):
    """Takes the filters on PLACES, so that only what they leave is read."""

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, ds.IsNotNull) and column in PLACES:
                continue
            if type(f) in _COMPARE and column in PLACES:
                self.tests.append((column, _COMPARE[type(f)], f.value))
            else:
                yield f


@dataclass
class Part(WriterCommitMessage):
    """A part file, and (band, block row, block column, bytes) of the tiles in it, in order."""

    name: str
    tiles: list[tuple[int, int, int, int]]


class GeoTiffWriter(DataSourceArrowWriter):
    """One tiled file of a raster whose rows (RASTER_BLOCK) are blocks of `tile` x `tile`, smaller at the edges; blocks that aren't there are missing."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.height, self.width, self.tile = (int(options[k]) for k in ("height", "width", "tile"))
        self.bands, self.predictor = int(options.get("bands", 1)), int(options.get("predictor", 1))
        self.transform = tuple(float(x) for x in options["transform"].split(","))
        self.nodata, self.epsg = float(options.get("nodata", -9999.0)), int(options["epsg"]) if options.get("epsg") else None
        self.big = {"true": True, "false": False}.get(options.get("big", "auto").lower())
        if self.tile % 16:
            raise ValueError("tiles of a GeoTIFF have sides of a multiple of 16")
        system_, place = located(self.path)
        if not overwrite and system_.get_file_info(place).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        self.job = uuid.uuid4().hex

    @property
    def parts(self) -> str:
        return f"{located(self.path)[1]}.parts-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system_, _ = located(self.path)
        system_.create_dir(self.parts, recursive=True)
        part = Part(f"{self.parts}/{uuid.uuid4().hex}", [])
        with system_.open_output_stream(part.name) as out:
            for batch in iterator:
                at = {n: batch.column(n).to_pylist() for n in ("band", "block_row", "block_col", "row0", "col0", "h", "w")}
                for i in range(len(batch)):
                    band, row, col, row0, col0, h, w = (at[n][i] for n in at)
                    if (row0, col0, h, w) != (row * self.tile, col * self.tile, min(self.tile, self.height - row0), min(self.tile, self.width - col0)) or not 1 <= band <= self.bands:
                        raise ValueError(f"block {row}, {col} of band {band} doesn't fit tiles of {self.tile} in {self.height} x {self.width}, {self.bands} bands")
                    values = np.full((self.tile, self.tile), np.nan)
                    values[:h, :w] = batch.column("data")[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)
                    raw = encoded(values[:, :, None], self.nodata, True, self.predictor)
                    out.write(raw)
                    part.tiles.append((band, row, col, len(raw)))
        return part

    def commit(self, messages: list) -> None:
        system_, place = located(self.path)
        across, down = -(-self.width // self.tile), -(-self.height // self.tile)
        sizes, within, bases = [0] * (across * down * self.bands), [0] * (across * down * self.bands), []
        total = 0
        try:
            for m in messages:
                bases.append(m.name)
                for band, row, col, n in m.tiles:
                    i = ((band - 1) * down + row) * across + col
                    if sizes[i]:
                        raise ValueError(f"block {row}, {col} of band {band} is there twice")
                    sizes[i], within[i] = n, total
                    total += n
            big = total + 32 * len(sizes) > 0xFFFF0000 if self.big is None else self.big
            kind = 16 if big else 4
            fields = [(256, 4, [self.width]), (257, 4, [self.height]), (258, 3, [32] * self.bands), (259, 3, [8]), (262, 3, [1]), (277, 3, [self.bands]), (284, 3, [2 if self.bands > 1 else 1]), (317, 3, [self.predictor]), (322, 4, [self.tile]), (323, 4, [self.tile]), (324, kind, [0] * len(sizes)), (325, kind, sizes), (339, 3, [3] * self.bands), *georeferenced(self.transform, self.epsg, self.nodata)]
            start = len(headed(fields, big))
            offsets = [start + at if n else 0 for at, n in zip(within, sizes, strict=True)]
            whole = f"{self.parts}/whole"
            system_.create_dir(self.parts, recursive=True)
            with system_.open_output_stream(whole) as out:
                out.write(headed([(t, k, offsets if t == 324 else v) for t, k, v in fields], big))
                for name in bases:
                    with system_.open_input_stream(name) as f:
                        while piece := f.read(1 << 24):
                            out.write(piece)
            system_.move(whole, place)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        system_, _ = located(self.path)
        if system_.get_file_info(self.parts).type == fs.FileType.Directory:
            system_.delete_dir(self.parts)


class GeoTiffSource(DataSource):
    """register(spark); spark.read.format("geotiff").load(path), df.write.format("geotiff").options(..).save(path). Executors need the path."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return RASTER_BLOCK

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options, overwrite)


class PushingSource(GeoTiffSource):
    """The same, with filters pushed down; Spark accepts it only where the session enables that."""

    def reader(self, schema) -> PushingReader:
        return PushingReader(self.options)


def register(spark: SparkSession) -> None:
    """format("geotiff") for a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PushingSource)


def save(blocks: DataFrame, path: str, height: int, width: int, tile: int, transform: tuple, mode: str = "overwrite", **options) -> None:
    """K1, K3: blocks (RASTER_BLOCK) of one raster as one GeoTIFF."""
    register(blocks.sparkSession)
    given = {"height": height, "width": width, "tile": tile, "transform": ",".join(map(repr, map(float, transform)))} | {k: str(v).lower() for k, v in options.items() if v is not None}
    blocks.write.format("geotiff").mode(mode).options(**{k: str(v) for k, v in given.items()}).save(path)


def encoded(values: np.ndarray, nodata: float, deflate: bool, predictor: int) -> bytes:
    """A strip or tile (rows, columns, bands) as float32."""
    part = np.where(np.isnan(values), nodata, values).astype("<f4")
    n, w, bands = part.shape
    raw = part.tobytes()
    if predictor == 3:
        planes = np.ascontiguousarray(part.astype(">f4")).view(np.uint8).reshape(n, w * bands, 4).transpose(0, 2, 1).reshape(n, w * 4, bands)
        raw = np.diff(planes, axis=1, prepend=np.zeros((n, 1, bands), np.uint8)).astype(np.uint8).tobytes()
    return zlib.compress(raw) if deflate else raw


def georeferenced(transform: tuple, epsg: int | None, nodata: float) -> list[tuple]:
    a, _, c, _, e, f = transform
    keys = [] if epsg is None else [(34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg])]
    return [(33550, 12, [a, -e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, c, f, 0.0]), *keys, (42113, 2, f"{nodata:g}\0".encode())]


def headed(fields: list[tuple], big: bool) -> bytes:
    """What stands before the pixels: the head, the directory of (tag, kind, values) and the values that don't fit into it."""
    place, count, room = ("Q", "Q", 8) if big else ("I", "H", 4)
    packed = lambda kind, v: v if kind == 2 else struct.pack(f"<{len(v)}{LETTERS[kind]}", *v)
    head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8))
    first = len(head) + struct.calcsize("<" + count) + len(fields) * (4 + 2 * room) + room
    entries, extra = b"", []
    at = first
    for tag, kind, v in fields:
        raw = packed(kind, v)
        entries += struct.pack(f"<HH{place}", tag, kind, len(v))
        if len(raw) > room:
            entries += struct.pack("<" + place, at)
            extra.append(raw)
            at += len(raw)
        else:
            entries += raw.ljust(room, b"\0")
    return head + struct.pack("<" + count, len(fields)) + entries + b"\0" * room + b"".join(extra)


def tiff_bytes(data: np.ndarray, transform: tuple, nodata: float = -9999.0, deflate: bool = True, predictor: int = 1, rows_per_strip: int = 64, epsg: int | None = None, big: bool = False) -> bytes:
    """K1-K3: a float32 file of (rows, columns) or (rows, columns, bands); missing values are nodata; big: with offsets of 64 bits."""
    values = np.asarray(data, float).reshape(*data.shape[:2], -1)
    h, w, bands = values.shape
    strips = [encoded(values[r : r + rows_per_strip], nodata, deflate, predictor) for r in range(0, h, rows_per_strip)]
    kind = 16 if big else 4
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [32] * bands), (259, 3, [8 if deflate else 1]), (262, 3, [1]), (273, kind, [0] * len(strips)), (277, 3, [bands]), (278, 4, [rows_per_strip]), (279, kind, [len(s) for s in strips]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [3] * bands), *georeferenced(transform, epsg, nodata)]
    at = np.cumsum([len(headed(fields, big)), *(len(x) for x in strips)]).tolist()
    return headed([(t, k, at[:-1] if t == 273 else v) for t, k, v in fields], big) + b"".join(strips)


def write_strip_tiff(path: str, data: np.ndarray, transform: tuple, **options) -> None:
    """K1: a small raster as one file; a large one goes by export_blocks()."""
    with open(path, "wb") as out:
        out.write(tiff_bytes(data, transform, **options))


def export_blocks(blocks: DataFrame, folder: str, transform: tuple, **options) -> DataFrame:
    """K1-K3: every block (RASTER_BLOCK) as a GeoTIFF with its own place in the world: (path, length), written when the result is read.

    Executors write into `folder`, which they share; a file appears whole, so a task that runs again does no harm.
    """

    def write(frames: Iterator) -> Iterator:
        import pandas as pd

        a, b, c, d, e, f = transform
        for frame in frames:
            out = []
            for x in frame.itertuples(index=False):
                data = np.array([np.nan if v is None else v for v in x.data], float).reshape(x.h, x.w)
                raw = tiff_bytes(data, (a, b, c + x.col0 * a, d, e, f + x.row0 * e), **options)
                path = f"{folder}/{x.raster_id}_{x.band}_{x.block_row}_{x.block_col}.tif"
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as file:
                    file.write(raw)
                os.replace(part, path)
                out.append((path, len(raw)))
            yield pd.DataFrame(out, columns=["path", "length"])

    return blocks.mapInPandas(write, "path string, length bigint")
