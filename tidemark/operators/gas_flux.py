"""Fluxes between air, sea and land by registry: a row a flux, its type, implementation and parameters.

A type says which fields it needs and which it makes; an implementation is a formula with
so many parameters. Each registered flux becomes one expression, its parameters literals
of it, and all of them one pass over the cells: nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-30


@dataclass(frozen=True)
class Formula:
    """The fields of a flux type, how many parameters an implementation has, and what it makes of them."""

    inputs: tuple[str, ...]
    n_parameters: int
    make: Callable[[dict[str, Column], tuple[float, ...]], dict[str, Column]]


def _exchange(f: dict[str, Column], speed: Column, solubility: float) -> tuple[Column, Column]:
    """Upward flux of a transfer speed, and the concentration that the air would hold in balance."""
    balance = f["alpha"] * f["pcair"] * f["psurf"] * solubility
    return speed * (f["csurf"] - balance), balance


def _quadratic(f, p):
    return {"flux": _exchange(f, p[0] * f["u10"] * f["u10"], p[1])[0]}


def _linear(f, p):
    return {"flux": _exchange(f, p[0] * F.greatest(F.lit(0.0), f["u10"] - p[1]), p[2])[0]}


def _generic(f, p):
    speed = p[0] * f["u10"] * f["u10"] * F.sqrt(660.0 / (f["sc_no"] + TINY))
    flux, balance = _exchange(f, speed, p[1])
    return {"flux": flux, "kw": speed, "flux0": speed * f["csurf"], "deltap": (f["csurf"] - balance) / (f["alpha"] * p[1] + TINY)}


_GAS = ("pcair", "u10", "psurf", "alpha", "csurf")
#: Flux types and their implementations, by name.
FORMULAS: dict[tuple[str, str], Formula] = {
    ("air_sea_gas_flux", "ocmip2"): Formula(_GAS, 2, _quadratic),
    ("air_sea_gas_flux", "linear"): Formula(_GAS, 3, _linear),
    ("air_sea_gas_flux_generic", "ocmip2"): Formula((*_GAS, "sc_no"), 2, _generic),
    ("air_sea_deposition", "dry"): Formula(("deposition",), 1, lambda f, p: {"flux": f["deposition"] / p[0]}),
    ("air_sea_deposition", "wet"): Formula(("deposition",), 1, lambda f, p: {"flux": f["deposition"] / p[0]}),
    ("land_sea_runoff", "river"): Formula(("runoff",), 1, lambda f, p: {"flux": f["runoff"] / p[0]}),
}
OUTPUTS = ("flux", "kw", "flux0", "deltap")


@dataclass(frozen=True)
class Flux:
    name: str
    flux_type: str
    implementation: str
    parameters: tuple[float, ...] = ()
    factor: float = 1.0


def register(defaults: list[Flux], overrides: list[dict] = ()) -> list[Flux]:
    """Fluxes as a table changes them: each of ``overrides`` has a ``name`` and what it replaces.

    ``parameters`` may be a list or a dict from places (from 1). A name given twice, an
    override of no flux, an unknown type or implementation and a flux with too few
    parameters are errors; parameters beyond those of the implementation are left out.
    """
    found: dict[str, Flux] = {}
    for f in defaults:
        if f.name in found:
            raise ValueError(f"{f.name}: registered twice")
        found[f.name] = f
    for change in overrides:
        change = dict(change)
        name = change.pop("name")
        if name not in found:
            raise ValueError(f"{name}: no such flux")
        if isinstance(places := change.get("parameters"), dict):
            own = list(found[name].parameters)
            own += [None] * (max(places) - len(own))
            for k, v in places.items():
                own[k - 1] = v
            change["parameters"] = tuple(own)
        found[name] = replace(found[name], **change)
    out = []
    for f in found.values():
        formula = FORMULAS.get((f.flux_type, f.implementation))
        if formula is None:
            raise ValueError(f"{f.name}: undefined flux type or implementation {f.flux_type}/{f.implementation}")
        own = tuple(f.parameters)[: formula.n_parameters]
        if len(own) < formula.n_parameters or None in own:
            raise ValueError(f"{f.name}: {formula.n_parameters} parameters are needed")
        out.append(replace(f, parameters=own))
    return out


def fluxes(cells: DataFrame, registered: list[Flux], keys: list[str], names: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``keys, name`` and what the formulas make (``OUTPUTS``, null where one makes no such thing): a row a cell and flux.

    ``names`` gives, by flux, the columns of ``cells`` that hold its fields; a field that is
    not named has a column of its own name. ``factor`` scales all that is made. A null
    input makes null.
    """
    made = []
    for f in registered:
        formula = FORMULAS[f.flux_type, f.implementation]
        own = (names or {}).get(f.name, {})
        got = formula.make({x: F.col(own.get(x, x)) for x in formula.inputs}, f.parameters)
        values = [(got[o] * f.factor if o in got else F.lit(None)).cast("double").alias(o) for o in OUTPUTS]
        made.append(F.struct(F.lit(f.name).alias("name"), *values))
    if not made:
        return cells.select(*keys, F.lit("").alias("name"), *[F.lit(None).cast("double").alias(o) for o in OUTPUTS]).where("false")
    return cells.select(*keys, F.explode(F.array(*made)).alias("made")).select(*keys, "made.*")
