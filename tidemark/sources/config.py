"""Configuration: override tables, field tables and a tree of named values."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.fields import Override

GRIDS = ("ATM", "OCN", "LND", "ICE")
METHODS = ("none", "bilinear", "bicubic")


def parse_overrides(text: str) -> list[Override]:
    """Read and check an override table."""
    rows = []
    for r in (yaml.safe_load(text) or {}).get("data_table", []):
        if r["grid_name"] not in GRIDS:
            raise ValueError(f"unknown grid {r['grid_name']!r}")
        files = r.get("override_file") or [{}]
        f = files[0]
        if f.get("interp_method", "none") not in METHODS:
            raise ValueError(f"unknown method {f['interp_method']!r}")
        region = None
        if sub := (r.get("subregion") or [None])[0]:
            region = tuple(float(sub[k]) for k in ("lon_start", "lon_end", "lat_start", "lat_end"))
            if region[0] > region[1] or region[2] > region[3]:
                raise ValueError("a region ends before it starts")
        outside = bool(sub) and sub.get("type") == "outside_region"
        rows.append(Override(r["grid_name"], r["fieldname_in_model"], f.get("fieldname_in_file") or None, float(r.get("factor", 1.0)), region, outside))
    return rows


def parse_values(text: str) -> dict[str, list[str]]:
    """``"a=1,2; b=x"`` to lists of values by name."""
    pairs = (part.partition("=") for part in text.split(";") if part.strip())
    return {k.strip(): [v.strip() for v in values.split(",")] for k, _, values in pairs}


class Tree:
    """Values under paths such as ``/atmos/tracer/radon/units``."""

    def __init__(self):
        self.values: dict[str, list] = {}

    @staticmethod
    def path(*parts: str) -> str:
        return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))

    def set(self, path: str, value, index: int | None = None, protect: bool = False) -> None:
        """Set a value or one of an array; ``protect`` refuses to change what is there."""
        held = self.values.setdefault(self.path(path), [])
        if protect and held:
            raise ValueError(f"{path} is set already")
        if index is None:
            held[:] = list(value) if isinstance(value, (list, tuple)) else [value]
        elif index == len(held):
            held.append(value)
        else:
            held[index] = value

    def get(self, path: str, default=None, index: int = 0):
        held = self.values.get(self.path(path))
        return default if held is None else held[index]

    def length(self, path: str) -> int:
        return len(self.values.get(self.path(path), []))

    def exists(self, path: str) -> bool:
        p = self.path(path)
        return p in self.values or any(k.startswith(p + "/") for k in self.values)

    def children(self, path: str) -> list[str]:
        p = self.path(path).rstrip("/") + "/"
        return list(dict.fromkeys(k[len(p) :].split("/")[0] for k in self.values if k.startswith(p)))

    def copy(self, path: str, new: str) -> None:
        p, n = self.path(path), self.path(new)
        for k in [k for k in self.values if k == p or k.startswith(p + "/")]:
            self.values[n + k[len(p) :]] = list(self.values[k])

    def rename(self, path: str, new: str) -> None:
        self.copy(path, new)
        p = self.path(path)
        for k in [k for k in self.values if k == p or k.startswith(p + "/")]:
            del self.values[k]

    def unknown(self, path: str, allowed: list[str]) -> list[str]:
        return [c for c in self.children(path) if c not in allowed]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """``path, index, value, type`` of every value."""
        rows = [(k, i, str(v), type(v).__name__) for k, held in self.values.items() for i, v in enumerate(held)]
        return spark.createDataFrame(rows, "path string, index int, value string, type string")


def parse_field_table(text: str) -> Tree:
    """A field table in YAML: field types, models and variables with their methods."""
    tree = Tree()

    def walk(path: str, node) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(f"{path}/{k}", v)
        elif isinstance(node, list) and node and isinstance(node[0], dict):
            for item in node:
                name = next((item[k] for k in ("field_type", "model_type", "variable") if k in item), None)
                rest = {k: v for k, v in item.items() if k not in ("field_type", "model_type", "variable")}
                nested = {k: rest.pop(k) for k in ("modlist", "varlist") if k in rest}
                own = f"{path}/{name}" if name else path
                walk(own, rest)
                for v in nested.values():
                    walk(own, v)
        else:
            tree.set(path, node)

    walk("", (yaml.safe_load(text) or {}).get("field_table", []))
    return tree
