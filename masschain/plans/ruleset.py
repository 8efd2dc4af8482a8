"""The uncertainty ruleset as data: bands, weights, defaults and how uncertainty propagates."""

from __future__ import annotations

from dataclasses import dataclass

DIMENSIONS = ("validity", "accuracy", "consistency", "integrity", "timeliness", "completeness")


@dataclass(frozen=True)
class Ruleset:
    """Fixed values of the default ruleset; another instance swaps any of them."""

    #: mean quality from, below, score, relative uncertainty; the last band is open
    score_bands: tuple = ((1.0, 1.3, 1, 0.10), (1.3, 2.3, 2, 0.20), (2.3, 3.3, 3, 0.40), (3.3, None, 4, 0.60))
    #: weighted quality sum from, below, limit
    limit_bands: tuple = ((0.0, 7.0, 0.10), (7.0, 9.0, 0.15), (9.0, 10.0, 0.20), (10.0, 14.0, 0.25), (14.0, 15.0, 0.30), (15.0, 99.0, 0.35))
    weights: tuple = (("integrity", 0.5), ("timeliness", 1.5))  # all others 1
    mean_again: tuple = ("accuracy", "consistency", "completeness")  # their mean is a seventh term
    defaults: tuple = (("validity", 2), ("accuracy", 2), ("consistency", 3), ("integrity", 2), ("timeliness", 3), ("completeness", 2))
    compounds: bool = False  # whether the uncertainties of multiplied edges add up (in squares)
    epsilon: float = 1e-6  # of mass conservation

    def mean_quality(self, of: str = "q_{}") -> str:
        """SQL of the mean of the six scores and the seventh term; null if one is missing."""
        scores = [of.format(d) for d in DIMENSIONS]
        again = " + ".join(of.format(d) for d in self.mean_again)
        return f"({' + '.join(scores)} + ({again}) / {len(self.mean_again)}.0E0) / {len(scores) + 1}.0E0"

    def weighted_quality(self, of: str = "q_{}") -> str:
        weight = dict(self.weights)
        return " + ".join(of.format(d) if d not in weight else f"{weight[d]}E0 * {of.format(d)}" for d in DIMENSIONS)

    def _banded(self, bands: tuple, value: str, result: int) -> str:
        arms = [f"WHEN {value} >= {b[0]}E0{'' if b[1] is None else f' AND {value} < {b[1]}E0'} THEN {b[result]}{'E0' if isinstance(b[result], float) else ''}" for b in bands]
        return f"CASE {' '.join(arms)} END"

    def score_of(self, mean: str) -> str:
        return self._banded(self.score_bands, mean, 2)

    def limit_of(self, weighted: str) -> str:
        return self._banded(self.limit_bands, weighted, 2)

    def score_table(self) -> str:
        rows = ", ".join(f"({lo}E0, {'CAST(NULL AS DOUBLE)' if hi is None else f'{hi}E0'}, {score}, {rel}E0)" for lo, hi, score, rel in self.score_bands)
        return f"SELECT * FROM (VALUES {rows}) AS t(lo, hi, dqs, rel)"

    def limit_table(self) -> str:
        rows = ", ".join(f"({lo}E0, {hi}E0, {lim}E0)" for lo, hi, lim in self.limit_bands)
        return f"SELECT * FROM (VALUES {rows}) AS t(lo, hi, lim)"

    def defaults_of(self, dimension: str) -> int:
        return dict(self.defaults)[dimension]


DEFAULT = Ruleset()
