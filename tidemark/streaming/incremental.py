"""One bar at a time, without Spark: for callers that hold the state themselves."""

from __future__ import annotations

import math
import pickle
from typing import Any

import numpy as np

from tidemark.operators.arrays import stepper
from tidemark.operators.catalog import CATALOG


class Incremental:
    """An operator over one series; every step costs no more than the operator's own look-back."""

    def __init__(self, name: str, **params: Any):
        if name not in CATALOG:
            raise ValueError(f"there is no operator {name}")
        self.operator = CATALOG[name]
        self.kernel = stepper(name, self.operator.checked(params))

    def step(self, **bar: float | None) -> dict[str, Any]:
        """The outputs at this bar; ``bar`` has the operator's roles. None: no value."""
        missing = set(self.operator.roles) ^ bar.keys()
        if missing:
            raise ValueError(f"{self.operator.name} takes {', '.join(self.operator.roles)}")
        out = self.kernel({r: np.array([np.nan if v is None else float(v)]) for r, v in bar.items()})
        return {n: self._plain(out[n][0], t) for n, t in self.operator.outputs}

    @staticmethod
    def _plain(value: Any, kind: str) -> Any:
        if kind == "double":
            return float(value) if math.isfinite(value) else None
        return value if value is None or kind == "boolean" else int(value)

    def state(self) -> bytes:
        """All that later steps need."""
        return pickle.dumps(self)

    @staticmethod
    def restored(state: bytes) -> Incremental:
        """Only states that this process's owner has stored may be restored: they are pickles."""
        return pickle.loads(state)

    def __getstate__(self) -> dict[str, Any]:
        return {"name": self.operator.name, "kernel": self.kernel}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.operator, self.kernel = CATALOG[state["name"]], state["kernel"]
