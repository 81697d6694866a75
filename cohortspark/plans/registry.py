"""The registry of the feature view."""

from __future__ import annotations

from ..functions.units import Measure, Prepare, Use, Variable, registry_of

FEAT = registry_of(
    Variable("id", Use("id", in_model=False, in_selection=False)),
    Variable("r_min", Use(domain="quantity"), Measure("g/dL", "g/L", "gdl_to_gl_multiply_10", (20.0, 400.0), "min", 24.0), Prepare((2.0, 45.0), "median", zscore=True)),
    Variable("r_max", Use(domain="quantity"), Measure("g/dL", "g/L", "gdl_to_gl_multiply_10", (51.0, 500.0), "max", 24.0), Prepare((5.0, 48.0), "mean", zscore=True)),
    Variable("a_price", Use(domain="price"), Measure(plausible=(1000.0, 100000.0), how="max", hours=48.0), Prepare((2000.0, 100000.0), "median", log=True, zscore=True)),
    Variable("n_price", Use(domain="price"), Measure("mg/dL", "mmol/L", "glucose_mgdl_to_mmol", (10000.0, 100000.0), "mean"), Prepare((3000.0, 90000.0), log=True, zscore=True)),
    Variable("disc", Use(domain="rate"), Measure(plausible=(0.0, 0.1)), Prepare((0.01, 0.09), "constant_zero", zscore=True)),
    Variable("tax", Use(domain="rate"), Measure("mg/dL", "umol/L", "bilirubin_mgdl_to_umol", (0.0, 0.08)), Prepare((0.01, 0.07), "median", zscore=True)),
    Variable("n_lines", Use("confounder", in_selection=False)),
    Variable("any_f", Use("outcome", in_model=False, in_selection=False)),
    Variable("rf_qty", Use(domain="quantity", in_model=False), prepare=Prepare(impute="median")),
)
