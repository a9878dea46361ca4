"""Neighbourhood work on blocks of pixels: blocks exchange edge strips, then one numpy step a block.

A raster is packed into blocks of size x size doubles (missing and absent pixels
are NaN) by one exchange of its pixels. For a stencil each block sends itself to
its own place and to others only the strips that lie in their halo, so that
somewhat more than one copy of the raster is exchanged, whatever the stencil's
width, and a task holds one block with its halo at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RASTER_BLOCK

RASTER_BLOCK_NAMES = ["raster_id", "band", "block_row", "block_col", "row0", "col0", "h", "w", "data"]
BLOCK = "br bigint, bc bigint, data binary"
PART = "br bigint, bc bigint, r0 bigint, c0 bigint, h int, w int, data binary"
#: The height or width of a raster whose extent doesn't matter.
OPEN = 1 << 40


@dataclass(frozen=True)
class Grid:
    """How a raster is cut into blocks."""

    height: int
    width: int
    size: int = 256

    def block(self, br: int, bc: int) -> tuple[int, int, int, int]:
        """First row and column, height and width of a block."""
        r0, c0 = br * self.size, bc * self.size
        return r0, c0, min(self.size, self.height - r0), min(self.size, self.width - c0)


#: ((before, after) along rows, (before, after) along columns)
Halo = tuple[tuple[int, int], tuple[int, int]]


def pack(px: DataFrame, grid: Grid) -> DataFrame:
    """Pixels (r, c, v) as blocks; of a pixel that is there twice one counts, pixels beyond the grid are left out."""
    size = grid.size
    r, c = F.col("r").cast("bigint"), F.col("c").cast("bigint")
    inside = px.filter(r.between(0, grid.height - 1) & c.between(0, grid.width - 1) & F.col("v").isNotNull())
    keyed = inside.select(F.expr(f"cast(r as bigint) div {size}").alias("br"), F.expr(f"cast(c as bigint) div {size}").alias("bc"), (r % size).cast("int").alias("r"), (c % size).cast("int").alias("c"), F.col("v").cast("double").alias("v"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            br, bc, row, col, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.r_[0, np.flatnonzero((np.diff(br) != 0) | (np.diff(bc) != 0)) + 1, len(br)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if now != (br[a], bc[a]):
                    if now is not None:
                        yield packed(now, block)
                    now = (br[a], bc[a])
                    block = np.full(grid.block(*map(int, now))[2:], np.nan)
                block[row[a:b], col[a:b]] = v[a:b]
        if now is not None:
            yield packed(now, block)

    def packed(at: tuple, block: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(at[0])]), pa.array([int(at[1])]), pa.array([block.tobytes()], pa.binary())], ["br", "bc", "data"])

    return keyed.repartition("br", "bc").sortWithinPartitions("br", "bc").mapInArrow(gather, BLOCK)


def neighbourhoods(blocks: DataFrame, grid: Grid, halo: Halo, step: Callable[[int, int, int, int, np.ndarray], pa.Table], schema: str, edge: str = "symmetric") -> DataFrame:
    """step(r0, c0, h, w, region) of every block that has pixels in it or in its halo.

    The region is the block with its halo. Beyond the raster the halo is filled by
    `edge`: `symmetric` mirrors with the edge pixel repeated, `missing` gives NaN,
    `clip` leaves it out. A block outside which nothing is stored is not visited.
    """
    (top, bottom), (left, right) = halo
    size = grid.size

    def reach(first: int, n: int, before: int, after: int, extent: int) -> Iterator[tuple[int, int, int]]:
        """Blocks along one axis whose halo meets the n places from `first`: block, from, to."""
        for b in range(max(0, (first - after) // size), min(-(-extent // size) - 1, (first + n - 1 + before) // size) + 1):
            low, high = max(first, b * size - before), min(first + n, min((b + 1) * size, extent) + after)
            if low < high:
                yield b, low, high

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for br, bc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                r0, c0, h, w = grid.block(br, bc)
                block = np.frombuffer(data.as_buffer(), np.float64).reshape(h, w)
                rows = [(tr, tc, a, x, b - a, y - x, block[a - r0 : b - r0, x - c0 : y - c0].tobytes()) for tr, a, b in reach(r0, h, top, bottom, grid.height) for tc, x, y in reach(c0, w, left, right, grid.width)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["br", "bc", "r0", "c0", "h", "w", "data"])

    def together(key: tuple, table: pa.Table) -> pa.Table:
        r0, c0, h, w = grid.block(key[0].as_py(), key[1].as_py())
        a, b, x, y = max(0, r0 - top), min(grid.height, r0 + h + bottom), max(0, c0 - left), min(grid.width, c0 + w + right)
        region = np.full((b - a, y - x), np.nan)
        for at_r, at_c, n, m, data in zip(*(table[c].to_pylist() for c in ("r0", "c0", "h", "w", "data")), strict=True):
            region[at_r - a : at_r - a + n, at_c - x : at_c - x + m] = np.frombuffer(data, np.float64).reshape(n, m)
        if edge != "clip":
            beyond = ((top - (r0 - a), bottom - (b - r0 - h)), (left - (c0 - x), right - (y - c0 - w)))
            region = np.pad(region, beyond, mode="symmetric") if edge == "symmetric" else np.pad(region, beyond, constant_values=np.nan)
        return step(r0, c0, h, w, region)

    # a group is one block with its halo
    return blocks.mapInArrow(send, PART).groupBy("br", "bc").applyInArrow(together, schema)


def pixel_table(r0: int, c0: int, values: dict[str, np.ndarray], keep: np.ndarray | None = None) -> pa.Table:
    """(r, c, ..) of arrays of one shape whose first item is pixel (r0, c0), NaN as null; with `keep`, of some of them."""
    shape = next(iter(values.values())).shape
    at = np.arange(shape[0] * shape[1]) if keep is None else np.flatnonzero(keep.ravel())
    cols = {"r": pa.array(r0 + at // shape[1]), "c": pa.array(c0 + at % shape[1])}
    return pa.table(cols | {k: pa.array(v.ravel()[at], pa.float64(), from_pandas=True) for k, v in values.items()})


def unpack(blocks: DataFrame, grid: Grid) -> DataFrame:
    """Pixels (r, c, v) of every place of the blocks, null where missing."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for br, bc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                r0, c0, h, w = grid.block(br, bc)
                yield from pixel_table(r0, c0, {"v": np.frombuffer(data.as_buffer(), np.float64).reshape(h, w)}).to_batches()

    return blocks.mapInArrow(spread, "r bigint, c bigint, v double")


def convolved(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Sums of x with a kernel of odd length along an axis, where the whole kernel fits."""
    x = np.moveaxis(x, axis, 0)
    n = x.shape[0] - len(kernel) + 1
    out = np.zeros((n, *x.shape[1:]))
    for k, weight in enumerate(kernel.tolist()):
        out += weight * x[k : k + n]
    return np.moveaxis(out, 0, axis)


def raster_blocks(blocks: DataFrame, grid: Grid, raster_id: str, band: int = 1) -> DataFrame:
    """Blocks as rows of RASTER_BLOCK, the form that sources store and export."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for br, bc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                r0, c0, h, w = grid.block(br, bc)
                values = pa.array(np.frombuffer(data.as_buffer(), np.float64).astype(np.float32), pa.float32(), from_pandas=True)
                ints = [pa.array([x], pa.int32()) for x in (band, br, bc, r0, c0, h, w)]
                yield pa.RecordBatch.from_arrays([pa.array([raster_id]), *ints, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], RASTER_BLOCK_NAMES)

    return blocks.mapInArrow(rows, RASTER_BLOCK)
