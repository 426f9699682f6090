"""Parameter registry: units, transforms, noise floors, limits and safety thresholds.

The registry is a small dimension.  It is available as a DataFrame (for joins and
audits) and as literal ``CASE`` expressions (for the hot path: no join, no shuffle).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameter:
    name: str
    ordinal: int
    tag: str
    unit: str
    transform: str  # log | linear | asinh
    scale: float
    floor: float
    spec_low: float | None = None
    spec_high: float | None = None
    margin_high: float | None = None
    safe_direction: str | None = None  # upper | lower | two_sided
    safe_low: float | None = None
    safe_high: float | None = None
    population_u: float = 0.0
    beta0: float | None = None
    beta1: float | None = None
    beta2: float | None = None
    sigma_eff: float | None = None


# Parameter table, limits, noise floors, locked linear coefficients and
# locked residual scales.
PRIMARY = (
    Parameter("IDSS", 1, "IDSS", "uA", "log", 1.0, 0.05, None, 10.0, None, "upper", None, 10.0,
              -2.302585092994046, 0.002339561050919542, 0.4657038355352779, 0.49182429074872763,
              0.10770869821030792),
    Parameter("VGS(th)", 2, "VGSTH", "V", "linear", 1.0, 0.01, 2.0, 4.0, None, "two_sided", 2.0, 4.0,
              3.0, 0.10161611496225995, 0.46955701792095267, 0.49620187685502853,
              0.03048219222793542),
    Parameter("RDS(on)", 3, "RDSON", "mOhm", "log", 1.0, 0.01, None, 65.0, 60.0, "upper", None, 60.0,
              3.8066624897703196, 0.2216503092658105, 0.47211305007616733, 0.47157972530839826,
              0.01849040791683378),
    Parameter("IGSS", 4, "IGSS", "nA", "asinh", 1.0, 0.1, -100.0, 100.0, None, "two_sided", -100.0, 100.0,
              0.0, 0.32574744762123486, 0.39407454363980804, 0.3816214087816265,
              0.313914638540121),
)

# Conformal quantiles (90 %, 95 %) per regime and the regime gate.
REGIME_GATE = {
    "IDSS": 0.0648496515277103,
    "VGS(th)": 0.021568977823908864,
    "RDS(on)": 0.013243167732299863,
    "IGSS": 0.18743324021279184,
}
CONFORMAL_QUANTILES = {
    ("IDSS", "ZERO_ANCHORED"): (1.7310065961056587, 1.775533162799307),
    ("IDSS", "DRIFT_MODEL"): (1.426713739798579, 1.5214188730997327),
    ("VGS(th)", "ZERO_ANCHORED"): (0.6755717616111105, 0.7519662828698007),
    ("VGS(th)", "DRIFT_MODEL"): (0.44986358170275814, 0.5394605929653896),
    ("RDS(on)", "ZERO_ANCHORED"): (0.4717169476722369, 0.5697359556101429),
    ("RDS(on)", "DRIFT_MODEL"): (0.36643807212470775, 0.37849102434517173),
    ("IGSS", "ZERO_ANCHORED"): (3.173402778732049, 3.996544929849206),
    ("IGSS", "DRIFT_MODEL"): (1.938428807802817, 2.180031899120612),
}

DEFAULT_FLOOR = 0.01
SCHEDULE = (0, 24, 96, 168)
TARGET_HOURS = 168


class Registry:
    """A set of parameters; every operator takes one, none hard-codes names."""

    def __init__(self, parameters: Iterable[Parameter] = PRIMARY):
        self.parameters: Sequence[Parameter] = tuple(parameters)

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.parameters]

    def lookup(self, field: str, param: Column | str = "parameter_name", default=None) -> Column:
        """Value of a registry field for the parameter named in ``param`` (CASE literal)."""
        col = F.col(param) if isinstance(param, str) else param
        typ = "string" if field in ("name", "tag", "unit", "transform", "safe_direction") else "double"
        if field == "ordinal":
            typ = "int"
        out = None
        for p in self.parameters:
            val = getattr(p, field)
            if val is None:
                continue
            lit = F.lit(val).cast(typ)
            out = F.when(col == p.name, lit) if out is None else out.when(col == p.name, lit)
        fallback = F.lit(default).cast(typ)
        return fallback if out is None else out.otherwise(fallback)

    def floor(self, param: Column | str = "parameter_name") -> Column:
        return self.lookup("floor", param, DEFAULT_FLOOR)

    def known(self, param: Column | str = "parameter_name") -> Column:
        col = F.col(param) if isinstance(param, str) else param
        return col.isin(*self.names)

    def to_df(self, spark: SparkSession) -> DataFrame:
        cols = [f.name for f in fields(Parameter)]
        ints, strs = {"ordinal"}, {"name", "tag", "unit", "transform", "safe_direction"}
        ddl = ", ".join(f"`{c}` " + ("INT" if c in ints else "STRING" if c in strs else "DOUBLE") for c in cols)
        rows = [tuple(getattr(p, c) for c in cols) for p in self.parameters]
        return spark.createDataFrame(rows, ddl).withColumnRenamed("name", "parameter_name")


REGISTRY = Registry()
