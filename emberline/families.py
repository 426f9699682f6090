"""Component families: which parameters a kind of component has, in which units, with which limits and references.

A family refers to base parameters and may override their limits for a run; a component without a family falls back to
the parameter registry. The dimension has a row per family and parameter, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Allowed:
    """A parameter as a family has it."""

    parameter_name: str
    unit: str
    transform: str
    user_limit_low: float | None = None
    user_limit_high: float | None = None
    reference_value: float | None = None
    reference_source: str | None = None
    verified: bool = False


@dataclass(frozen=True)
class Family:
    family_id: str
    name: str
    framing: str
    parameters: tuple[Allowed, ...]


# Base parameters and families of the contract
LEAKAGE = Allowed("leakage_current", "uA", "log", user_limit_high=50.0)
IDDQ = Allowed("iddq", "mA", "log")
DELAY = Allowed("propagation_delay", "ns", "linear")
FAMILIES = (
    Family("DC_DC_CONVERTER", "DC-DC Power Converter Assembly", "BOARD_LEVEL_ASSEMBLY", (LEAKAGE, IDDQ)),
    Family("POWER_SUPPLY_UNIT", "Power Supply Unit (PSU)", "BOARD_LEVEL_ASSEMBLY", (LEAKAGE, IDDQ)),
    Family("ELECTRONIC_CONTROL_BOARD", "Electronic Control Board (ECB)", "BOARD_LEVEL_ASSEMBLY", (LEAKAGE, IDDQ, DELAY)),
    Family("PACKAGED_MMIC", "Packaged MMIC Module", "PACKAGED_MMIC", (LEAKAGE,)),
)


def with_user_limits(families: Sequence[Family], family_id: str, parameter: str, low: float | None, high: float | None) -> tuple[Family, ...]:
    """The families with other user limits in one place; references and the given families stay as they are."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"limits of {parameter}: {low} is above {high}")
    if not any(f.family_id == family_id.upper() and any(a.parameter_name == parameter for a in f.parameters) for f in families):
        raise KeyError(f"{parameter} is no parameter of family {family_id}")

    def changed(a: Allowed) -> Allowed:
        return replace(a, user_limit_low=low, user_limit_high=high) if a.parameter_name == parameter else a

    return tuple(replace(f, parameters=tuple(map(changed, f.parameters))) if f.family_id == family_id.upper() else f for f in families)


def to_df(spark: SparkSession, families: Sequence[Family] = FAMILIES) -> DataFrame:
    """family_id, framing and the columns of Allowed: one row per family and parameter."""
    kinds = {"user_limit_low": "double", "user_limit_high": "double", "reference_value": "double", "verified": "boolean"}
    names = [f.name for f in fields(Allowed)]
    ddl = "family_id string, framing string, " + ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    rows = [(f.family_id, f.framing, *(getattr(a, n) for n in names)) for f in families for a in f.parameters]
    return spark.createDataFrame(rows, ddl)
