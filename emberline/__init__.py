"""Screening and prognostics of component burn-in telemetry as Spark DataFrame plans."""
