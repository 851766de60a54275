"""Plug-in points for models (text recognition, layout, dewarping): named factories, one instance per Python worker."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

Factory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
_factories: dict[tuple[str, str], Factory] = {}


def register(kind: str, name: str, factory: Factory, replace: bool = False) -> None:
    if (kind, name) in _factories and not replace:
        raise ValueError(f"{kind} {name!r} is registered already")
    _factories[kind, name] = factory


def unregister(kind: str, name: str) -> None:
    _factories.pop((kind, name), None)


def available(kind: str) -> list[str]:
    return sorted(n for k, n in _factories if k == kind)


def get(kind: str, name: str) -> Factory:
    if (kind, name) not in _factories:
        raise KeyError(f"no {kind} named {name!r}; there are: {', '.join(available(kind)) or 'none'}")
    return _factories[kind, name]


def apply_model(df: DataFrame, kind: str, name: str, schema: str) -> DataFrame:
    """df through a model in batches; each Python worker builds the model once.  A column inference_ms is added."""
    packed = cloudpickle.dumps(get(kind, name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sys.__dict__.setdefault("_quire_models", {})
        if (kind, name) not in held:
            held[kind, name] = cloudpickle.loads(packed)()
        for batch in batches:
            began = time.perf_counter()
            out = held[kind, name](batch)
            out["inference_ms"] = (time.perf_counter() - began) * 1000 / max(1, len(batch))
            yield out

    return df.mapInPandas(run, f"{schema}, inference_ms double")


def _no_regions() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The layout detector that finds nothing."""
    return lambda batch: pd.DataFrame({"page_id": batch["page_id"], "regions": [[] for _ in range(len(batch))]})


register("layout", "none", _no_regions)
