"""Options of keyword extraction, checked once."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

SIMILARITIES = ("seqm", "levs", "jaro")
FEATURES = ("wrel", "wfreq", "wspread", "wcase", "wpos", "KPF")


@dataclass(frozen=True)
class Options:
    """language: of all documents, or None for each document's own label; n: words of a phrase at most; dedup_lim: a
    phrase more similar than this to a better one is left out, 1 or more keeps all; window: words a word co-occurs with
    on either side; top: phrases of a document; features: those that count, None for all."""

    language: str | None = None
    n: int = 3
    dedup_lim: float = 0.9
    dedup_func: str = "seqm"
    window: int = 1
    top: int = 20
    features: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        for name in ("n", "window", "top"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer, not {value!r}")
        if isinstance(self.dedup_lim, bool) or not isinstance(self.dedup_lim, (int, float)) or not math.isfinite(self.dedup_lim) or self.dedup_lim < 0:
            raise ValueError(f"dedup_lim must be a finite number of 0 or more, not {self.dedup_lim!r}")
        if not isinstance(self.dedup_func, str) or self.dedup_func.lower() not in SIMILARITIES:
            raise ValueError(f"dedup_func must be one of {', '.join(SIMILARITIES)}, not {self.dedup_func!r}")
        object.__setattr__(self, "dedup_func", self.dedup_func.lower())
        if self.features is not None:
            if unknown := [f for f in self.features if f not in FEATURES]:
                raise ValueError(f"features must be among {', '.join(FEATURES)}, not {unknown[0]!r}")
            object.__setattr__(self, "features", tuple(self.features))

    @classmethod
    def parse(cls, **given) -> Options:
        """Options by name; a name that isn't one is an error that says so."""
        known = {f.name for f in fields(cls)}
        if unknown := [k for k in given if k not in known]:
            raise ValueError(f"unknown option {unknown[0]!r}; options are {', '.join(sorted(known))}")
        return cls(**given)

    def has(self, feature: str) -> bool:
        return self.features is None or feature in self.features
