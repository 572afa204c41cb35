"""Named queries over the panel, grouped as in the operator modules."""
import importlib

GROUPS = ["sources", "calendar", "cleaning", "weekly", "lags", "climatology", "indices",
          "known", "splits", "weights", "metrics", "blend", "drift", "models"]


def load():
    from panelcast.plans import base
    for name in GROUPS:
        importlib.import_module(f"panelcast.plans.{name}")
    return base
