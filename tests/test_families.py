"""Component families: limits of a run leave the defaults alone, unknown families and parameters show."""

import pytest

from emberline import families
from emberline.operators import quality


def test_user_limits():
    other = families.with_user_limits(families.FAMILIES, "packaged_mmic", "leakage_current", 1.0, 2.0)
    limits = {f.family_id: (f.parameters[0].user_limit_low, f.parameters[0].user_limit_high) for f in other}
    assert limits["PACKAGED_MMIC"] == (1.0, 2.0) and limits["DC_DC_CONVERTER"] == (None, 50.0)
    assert families.FAMILIES[3].parameters[0].user_limit_high == 50.0
    with pytest.raises(ValueError):
        families.with_user_limits(families.FAMILIES, "PACKAGED_MMIC", "leakage_current", 3.0, 2.0)
    with pytest.raises(KeyError):
        families.with_user_limits(families.FAMILIES, "PACKAGED_MMIC", "iddq", 1.0, 2.0)


def test_fallback_and_issues(spark):
    rows = [("a", "packaged_mmic", "leakage_current", 0, "uA"), ("b", "PACKAGED_MMIC", "iddq", 0, "mA"), ("c", "nobody", "iddq", 0, "mA"), ("d", None, "IDSS", 0, "uA"), ("e", None, "iddq", 0, "mA"), ("f", "DC_DC_CONVERTER", "iddq", 0, None)]
    df = spark.createDataFrame(rows, "component_id string, family_id string, parameter_name string, elapsed_hours int, unit string")
    found = {r.component_id: r.issue for r in quality.family_issues(df, families.to_df(spark)).collect()}
    assert found == {"b": "PARAMETER_NOT_ALLOWED", "c": "FAMILY_UNKNOWN", "e": "PARAMETER_NOT_ALLOWED", "f": "UNIT_MISMATCH"}
