"""The active-learning loop as a driver over DataFrames. Simulation, labelling and training are plug-ins.

The plans of a step are declarative; the driver only carries counters and decides when to stop. Each
step's training and seed tables are stored, so lineage does not grow with the number of steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import committee, linking, selection
from latticework.session import materialise


@dataclass
class Step:
    number: int
    n_training: int
    n_seed: int
    n_frames: int
    n_selected: int
    rmse_energy: float
    rmse_force: float


@dataclass
class Loop:
    """``simulate`` (seed rows) -> frames (key, frame, ...); ``predict`` (frames) -> (key, frame, model, energy); ``label`` (frames) -> training rows; ``train`` (step, training) -> [(model, rmse_e, rmse_f)]."""

    simulate: Callable[[DataFrame], DataFrame]
    predict: Callable[[DataFrame], DataFrame]
    label: Callable[[DataFrame], DataFrame]
    train: Callable[[int, DataFrame], list[tuple[str, float, float]]]
    target_energy: float = 43.0
    target_force: float = 50.0
    factor: float = 1.5
    most_steps: int = 10
    most_labels: int = 1_000
    seed_share: float = 0.2
    seed_most: int = 500
    history: list[Step] = field(default_factory=list)
    why: str = ""

    def run(self, training: DataFrame, seed: DataFrame, key: str = "key") -> DataFrame:
        """The final training table."""
        spark = training.sparkSession
        seed = materialise(linking.missing(seed, training, [key]), "seed")
        training = materialise(training, "training")
        for number in range(1, self.most_steps + 1):
            results = spark.createDataFrame([(m, float(e) if e is not None else None, float(f) if f is not None else None) for m, e, f in self.train(number, training)], "model string, rmse_e double, rmse_f double")
            best = committee.best_model(results, "rmse_e", "rmse_f", 0.1, "model").where("best").first()
            if best is None:
                self.why = "no model could be trained"
                return training
            n_seed = seed.count()
            if n_seed == 0:
                self.why = "the seed table is exhausted"
                return training
            size = max(1, min(n_seed, self.seed_most, int(n_seed * self.seed_share) or 1))
            picked = materialise(selection.sample(seed, size, number, key), "picked")
            frames = materialise(self.simulate(picked), "frames")
            spread = committee.spread(self.predict(frames), [key, "frame"], "energy")
            unsure = spread.where(committee.flag_training(F.col("spread"), best["rmse_e"], self.target_energy, self.factor))
            chosen = materialise(frames.join(unsure.select(key, "frame"), [key, "frame"], "left_semi").orderBy(selection.draw(number, key, "frame"), key, "frame").limit(self.most_labels), "chosen")
            n_chosen = chosen.count()
            self.history.append(Step(number, training.count(), n_seed, frames.count(), n_chosen, best["rmse_e"], best["rmse_f"]))
            agreed = picked.join(chosen.select(key).distinct(), key, "left_anti")
            seed = materialise(linking.missing(seed, agreed, [key]), "seed")
            if n_chosen == 0:
                self.why = "the models agree"
                return training
            labelled = self.label(chosen).withColumn("al_step", F.lit(number))
            training = materialise(training.unionByName(labelled, allowMissingColumns=True), "training")
            if best["rmse_e"] <= self.target_energy and best["rmse_f"] <= self.target_force and seed.isEmpty():
                self.why = "the errors are below their targets"
                return training
        self.why = "the most steps were made"
        return training
