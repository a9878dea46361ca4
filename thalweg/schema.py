"""Schemas of rasters, tiles, points and results."""

AFFINE = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
BOUNDS = "struct<left:double,bottom:double,right:double,top:double>"
RASTER_META = f"raster_id string, width int, height int, transform {AFFINE}, crs string, nodata double, dtype string, bounds {BOUNDS}"
RASTER_BLOCK = "raster_id string, band int, block_row int, block_col int, row0 int, col0 int, h int, w int, data array<float>"
RASTER_PIXEL = "raster_id string, band int, row int, col int, value float"
WORK_LIST = "tile_num int, dsm_pct double, dtm_pct double, image_file string, mask_file string"
GAUGE = "date date, level_min double, level_max double"
POINT = "id bigint, x double, y double, z double"
TILE_DEPTH = "tile bigint, method string, rank int, status string, water_pixels bigint, valid_pixels bigint, coverage_pct double, depth_mean double, depth_median double, depth_std double, depth_min double, depth_max double, surface_mean double, surface_std double, riverbed_mean double, riverbed_std double"
