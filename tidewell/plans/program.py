"""Programs: named outputs over named sources, with all mistakes reported together."""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.tables import Sources


class ProgramError(ValueError):
    """Every output that could not be built, with the place of its fault."""

    def __init__(self, faults: dict[str, tuple[Exception, str]]):
        self.faults = faults
        super().__init__("; ".join(f"{name}: {fault} ({where})" for name, (fault, where) in faults.items()))


class Program:
    """Outputs by name, each a function of the sources (and of earlier outputs by ``program[name]``)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sources = spark, Sources()
        self._makers: dict[str, Callable] = {}
        self._built: dict[str, DataFrame] = {}

    def output(self, name: str):
        def keep(make: Callable[[Program], DataFrame]):
            if name in self._makers:
                raise ValueError(f"output {name!r} is defined twice")
            self._makers[name] = make
            return make

        return keep

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._makers:
                raise KeyError(f"no output {name!r}; there are {sorted(self._makers)}")
            self._built[name] = self._makers[name](self)
        return self._built[name]

    def build(self) -> dict[str, DataFrame]:
        """All outputs; one ProgramError for all that fail."""
        faults = {}
        for name in self._makers:
            try:
                self[name]
            except Exception as fault:  # collected and raised together below
                at = traceback.extract_tb(fault.__traceback__)[-1]
                faults[name] = (fault, f"{at.filename}:{at.lineno}")
        if faults:
            raise ProgramError(faults)
        return {name: self._built[name] for name in self._makers}

    def explain(self, mode: str = "formatted") -> None:
        for name, df in self.build().items():
            print(f"== {name} ==")
            df.explain(mode)
