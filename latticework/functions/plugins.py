"""Registries of what the engine does not compute itself: descriptors, energies, confidences, filters.

A backend is a name and the functions it offers. Functions get and give pandas batches over Arrow;
a later registration of a name replaces the earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: descriptors, frames (of a simulation), energies (also of pretrained models), confidence: functions of a pandas batch; gradients: of descriptors; train, compile: of a table.
OFFERS = ("descriptors", "gradients", "energies", "frames", "confidence", "train", "compile", "pretrained")
_BACKENDS: dict[str, dict[str, Callable]] = {}
_FILTERS: dict[str, Callable[..., Column]] = {}


def register_backend(name: str, **offers: Callable) -> None:
    wrong = set(offers) - set(OFFERS)
    if wrong:
        raise ValueError(f"a backend offers {OFFERS}, not {sorted(wrong)}")
    _BACKENDS[name] = offers


def backend(name: str) -> dict[str, Callable]:
    if name not in _BACKENDS:
        raise KeyError(f"no backend {name!r}; there are {sorted(_BACKENDS)}")
    return _BACKENDS[name]


def backends(offering: str | None = None) -> list[str]:
    return sorted(n for n, o in _BACKENDS.items() if offering is None or offering in o)


def filter_rule(name: str) -> Callable:
    """Register a builder of a boolean column as a structure filter."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        _FILTERS[name] = f
        return f

    return add


def filters(settings: dict[str, dict | bool]) -> dict[str, Column]:
    """The enabled filters, in the order of the settings."""
    unknown = [n for n in settings if n not in _FILTERS]
    if unknown:
        raise KeyError(f"no filter {unknown}; there are {sorted(_FILTERS)}")
    return {n: _FILTERS[n](**(s if isinstance(s, dict) else {})) for n, s in settings.items() if s is not False and s is not None}


def describe(df: DataFrame, name: str, columns: list[str], key: str) -> DataFrame:
    """(key, atom_idx, embedding) by a backend's ``descriptors``: a function of a pandas batch that gives one matrix per row."""
    f = backend(name)["descriptors"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            rows = [(k, i, list(map(float, v))) for k, m in zip(batch[key], f(batch), strict=True) for i, v in enumerate(m)]
            yield pd.DataFrame(rows, columns=[key, "atom_idx", "embedding"])

    return df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, atom_idx int, embedding array<float>")


def committee(df: DataFrame, models: list[str], columns: list[str], key: str) -> DataFrame:
    """(key, model, energy): every model's ``energies`` for every row; a model that fails on a batch gives nulls."""
    offered = {m: backend(m)["energies"] for m in models}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for m, energies in offered.items():  # workers have no registry; the functions travel with the plan
                try:
                    e = pd.Series(energies(batch), dtype=float)
                except Exception:
                    e = pd.Series([float("nan")] * len(batch))
                yield pd.DataFrame({key: batch[key].to_numpy(), "model": m, "energy": e.to_numpy()})

    out = df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, model string, energy double")
    return out.withColumn("energy", F.when(~F.isnan("energy"), F.col("energy")))


def confidence(df: DataFrame, name: str, columns: list[str], key: str, how: str = "max") -> DataFrame:
    """(key, confidence): a backend's ``confidence`` of each row's parts, reduced by max, min or mean; a row without parts has none."""
    f = backend(name)["confidence"]
    reduce = {"max": max, "min": min, "mean": lambda v: sum(v) / len(v)}[how]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            yield pd.DataFrame({key: batch[key].to_numpy(), "confidence": [float(reduce(v)) if len(v) else None for v in map(list, f(batch))]})

    return df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, confidence double")


def checked(energies: Callable, most: float = 100.0, size: str = "n_atoms") -> Callable:
    """A calculator that raises on an energy out of reach of physics instead of handing it on."""

    def run(batch: pd.DataFrame) -> pd.Series:
        e = pd.Series(energies(batch), dtype=float)
        bad = e.isna().to_numpy() | (e.abs().to_numpy() > most * batch[size].clip(lower=1).to_numpy())
        if bad.any():
            raise ValueError(f"{int(bad.sum())} unphysical energies")
        return e

    return run


def physical(energy: Column, n_atoms: Column, most: float = 100.0) -> Column:
    """Whether an energy per atom is within reach of physics."""
    return energy.isNotNull() & ~F.isnan(energy) & (F.abs(energy / F.greatest(n_atoms, F.lit(1))) <= most)


@filter_rule("atom_count")
def _atom_count(least: int = 1, most: int = 10_000) -> Column:
    return ~F.col("n_atoms").between(least, most)


@filter_rule("positive_energy")
def _positive_energy() -> Column:
    return F.col("energy") > 0


@filter_rule("high_energy")
def _high_energy(limit: float = -3.4) -> Column:
    return F.try_divide("energy", "n_atoms") > limit


@filter_rule("no_phase")
def _no_phase() -> Column:
    return F.col("phase").isNull()


def trajectories(df: DataFrame, name: str, columns: list[str], key: str) -> DataFrame:
    """(key, frame, energy) by a backend's ``frames``: a function of a pandas batch that gives one series of energies per row."""
    f = backend(name)["frames"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            rows = [(k, i, float(e)) for k, series in zip(batch[key], f(batch), strict=True) for i, e in enumerate(series)]
            yield pd.DataFrame(rows, columns=[key, "frame", "energy"])

    return df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, frame int, energy double")
