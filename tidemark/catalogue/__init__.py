"""Named queries over the driver's tables, with SQL that gives the same rows."""

from tidemark.catalogue import diagnostics, exchange, fields, functions, interpolation, mosaics, polygons, registries, series, surface, tables, tiles, vapour
from tidemark.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "diagnostics", "exchange", "fields", "functions", "interpolation", "mosaics", "polygons", "registries", "series", "surface", "tables", "tiles", "vapour"]
