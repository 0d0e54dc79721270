"""The recurrences as SQL table functions, after ``register(spark)``:

    SELECT * FROM rls(TABLE(ecg) PARTITION BY k ORDER BY n)
    SELECT * FROM iir(TABLE(ecg) PARTITION BY k ORDER BY n, value => 'v', wn => ARRAY(0.5D, 40D), fs => 250, btype => 'bandpass')

A partition is a signal. The result has the table's column ``key``, the sample's number n and the results, with types as the table
has them: column names are arguments, checked when the query is analysed. Rows must come in the signal's order (ORDER BY); with
``by``, the name of that column, tied orders are errors. A null value is an error.

    SELECT k, posexplode(clean) FROM rls(TABLE(signals))

Where the columns are arrays, as ``signal.gathered`` makes them, each row is a signal and so is each row of the result: ``key``
and an array per result. No partitioning is asked for, and a task's signals step through time together. Use it for large
tables: Spark hands a table function its rows one by one, which costs far more than a filter's step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidewave.functions import design, kernels, sections

SHARED = {"key": "k", "by": "n"}
#: Signals given as arrays step together in groups of at most so many samples (or of one signal) and so many signals.
TOGETHER, SIGNALS = 500_000, 1000


@dataclass
class Analysed(AnalyzeResult):
    """What a call's arguments come to, kept for the tasks: options, places of key, order and values in a row, and whether values are arrays."""

    given: dict = field(default_factory=dict)
    key: int = 0
    by: int | None = None
    values: tuple[int, ...] = ()
    arrays: bool = False


def _given(defaults: dict, args: dict) -> dict:
    """The arguments' values over their defaults; an unknown name is an error."""
    if unknown := set(args) - set(defaults):
        raise ValueError(f"unknown argument {sorted(unknown)}: there are {sorted(defaults)}")
    return defaults | args


def _analysed(table: AnalyzeArgument, given: dict, columns: list[str], results: list[str]) -> Analysed:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(t) PARTITION BY ... ORDER BY ...")
    found, places = {f.name: f for f in table.dataType.fields}, {f.name: i for i, f in enumerate(table.dataType.fields)}
    kinds = {isinstance(found[c].dataType, ArrayType) for c in columns if c in found}
    if len(kinds) > 1:
        raise ValueError(f"some of {', '.join(columns)} are arrays and some are not")
    arrays = kinds == {True}
    by = None if arrays else given["by"]
    for c in [given["key"], *([by] if by else []), *columns]:
        if c not in found:
            raise ValueError(f"the table has no column {c}")
    if given["key"] in (*([] if arrays else ["n"]), *results):
        raise ValueError(f"the key column is named like a result, {given['key']}: rename it")
    schema = StructType([found[given["key"]]])
    if not arrays:
        schema = schema.add("n", IntegerType())
    for r in results:
        schema = schema.add(r, ArrayType(DoubleType()) if arrays else DoubleType())
    return Analysed(schema, given=given, key=places[given["key"]], by=places[by] if by else None, values=tuple(places[c] for c in columns), arrays=arrays)


class _Signal:
    """Gathers a partition's rows and gives the filter's results at its end; rows of arrays are filtered in groups."""

    DEFAULTS: dict = {}
    RESULTS = ["clean"]

    def __init__(self, found: Analysed) -> None:
        self.found, self.given = found, found.given
        self.rows: list[tuple] = []
        self.last = None
        self.waiting: list[tuple] = []  # keys and signals
        self.samples = 0

    @classmethod
    def columns(cls, given: dict) -> list[str]:
        return [given["raw"], *given["refs"]]

    @classmethod
    def checked(cls, given: dict) -> None:
        """Raises where the options don't fit."""

    @classmethod
    def described(cls, table: AnalyzeArgument, args: dict[str, AnalyzeArgument]) -> Analysed:
        given = _given(SHARED | cls.DEFAULTS, {k: v.value for k, v in args.items()})
        cls.checked(given)
        return _analysed(table, given, cls.columns(given), cls.RESULTS)

    def eval(self, row, **args) -> Iterator[tuple] | None:
        values = tuple([row[i] for i in self.found.values])
        if any([v is None or self.found.arrays and None in v for v in values]):
            raise ValueError(f"null in {', '.join(self.columns(self.given))}")
        if self.found.arrays:
            return self.wait(row[self.found.key], [np.array(v, float) for v in values])
        if self.found.by is not None:
            at = row[self.found.by]
            if self.rows and at == self.last:
                raise ValueError("tied order")
            self.last = at
        if not self.rows:
            self.key = row[self.found.key]
        self.rows.append(values)

    def wait(self, key, x: list[np.ndarray]) -> Iterator[tuple] | None:
        if len({v.size for v in x}) > 1:
            raise ValueError(f"arrays of different lengths in {', '.join(self.columns(self.given))}")
        self.waiting.append((key, x))
        self.samples += x[0].size
        if self.samples >= TOGETHER or len(self.waiting) >= SIGNALS:
            return self.filtered()

    def filtered(self) -> Iterator[tuple]:
        """The results of the signals that wait, which are done then."""
        longest_first = sorted(self.waiting, key=lambda w: -w[1][0].size)
        self.waiting, self.samples = [], 0
        while longest_first:
            room = max(1, TOGETHER // max(1, longest_first[0][1][0].size))
            group, longest_first = longest_first[:room], longest_first[room:]
            full = [w for w in group if w[1][0].size]
            out = self.run([np.stack(x) for _, x in full], self.given) if full else ()
            for i, (key, _) in enumerate(group):  # those without a sample come last
                yield (key, *([r[i].tolist() for r in out] if i < len(full) else [[] for _ in self.RESULTS]))

    def terminate(self) -> Iterator[tuple]:
        yield from self.filtered()
        if self.rows:
            out = self.run([np.array(self.rows, float).T], self.given)
            yield from zip([self.key] * len(self.rows), range(len(self.rows)), *(r[0].tolist() for r in out), strict=True)

    def run(self, signals: list[np.ndarray], given: dict) -> tuple:
        """A list of arrays for each result, one for each signal's (columns, n)."""
        raise NotImplementedError


def _refs(signals: list[np.ndarray], given: dict, first: int = 1) -> list[np.ndarray]:
    return [np.sqrt((x[first:] ** 2).sum(axis=0))[None] if given["svm"] else x[first:] for x in signals]


REFERENCED = {"raw": "raw", "refs": ["rx", "ry", "rz"], "svm": False}


class Rls(_Signal):
    DEFAULTS = REFERENCED | {"filter_order": 5, "lam": 0.99, "delta": 1.0}

    @staticmethod
    def analyze(table: AnalyzeArgument, **args: AnalyzeArgument) -> Analysed:
        return Rls.described(table, args)

    @classmethod
    def checked(cls, given: dict) -> None:
        kernels.check_forgetting(float(given["lam"]))

    def run(self, signals: list[np.ndarray], given: dict) -> tuple:
        return (kernels.rls_all([x[0] for x in signals], _refs(signals, given), given["filter_order"], float(given["lam"]), float(given["delta"])),)


class Lms(_Signal):
    DEFAULTS = REFERENCED | {"lowpass": None, "filter_order": 5, "mu": 0.001}

    @staticmethod
    def analyze(table: AnalyzeArgument, **args: AnalyzeArgument) -> Analysed:
        return Lms.described(table, args)

    @classmethod
    def columns(cls, given: dict) -> list[str]:
        return [given["raw"], given["lowpass"] or given["raw"], *given["refs"]]

    def run(self, signals: list[np.ndarray], given: dict) -> tuple:
        return (kernels.lms_all([x[0] for x in signals], [x[1] for x in signals], _refs(signals, given, 2), float(given["mu"]), given["filter_order"]),)


class Blms(_Signal):
    DEFAULTS = REFERENCED | {"l": 10, "filter_order": 32, "mu": 0.01}

    @staticmethod
    def analyze(table: AnalyzeArgument, **args: AnalyzeArgument) -> Analysed:
        return Blms.described(table, args)

    @classmethod
    def checked(cls, given: dict) -> None:
        kernels.check_block(given["l"])

    def run(self, signals: list[np.ndarray], given: dict) -> tuple:
        return (kernels.blms_all([x[0] for x in signals], _refs(signals, given), given["l"], float(given["mu"]), given["filter_order"]),)


class Hybrid(_Signal):
    DEFAULTS = {"raw": "raw", "refs": ["rx", "ry", "rz"], "m": 5, "beta": 1.0, "alpha": 0.0, "eps": 1e-3, "lam": 0.99, "delta": 1.0}
    RESULTS = ["clean", "y_total"]

    @staticmethod
    def analyze(table: AnalyzeArgument, **args: AnalyzeArgument) -> Analysed:
        return Hybrid.described(table, args)

    @classmethod
    def checked(cls, given: dict) -> None:
        kernels.check_forgetting(float(given["lam"]), "lam")

    def run(self, signals: list[np.ndarray], given: dict) -> tuple:
        found = kernels.hybrid_all([x[0] for x in signals], [x[1:] for x in signals], given["m"], *(float(given[c]) for c in ("beta", "alpha", "eps", "lam", "delta")))
        return [clean for clean, _, _ in found], [noise for _, noise, _ in found]


class Iir(_Signal):
    DEFAULTS = {"value": "v", "filter_order": 2, "wn": None, "fs": None, "btype": "lowpass", "ftype": "butter", "rp": None, "rs": None, "zero_phase": True}
    RESULTS = ["v"]

    @staticmethod
    def analyze(table: AnalyzeArgument, **args: AnalyzeArgument) -> Analysed:
        return Iir.described(table, args)

    @classmethod
    def columns(cls, given: dict) -> list[str]:
        return [given["value"]]

    @classmethod
    def sections(cls, given: dict) -> np.ndarray:
        number = lambda c: None if given[c] is None else float(given[c])
        wn = [float(x) for x in given["wn"]] if isinstance(given["wn"], (list, tuple)) else number("wn")
        if wn is None:
            raise ValueError("wn is missing: the band's edge or edges in Hz")
        return design.iir_sections(given["filter_order"], wn, number("rp"), number("rs"), given["btype"], False, number("fs"), given["ftype"])

    @classmethod
    def checked(cls, given: dict) -> None:
        cls.sections(given)

    def run(self, signals: list[np.ndarray], given: dict) -> tuple:
        sos = self.sections(given)
        return ([kernels.sos_zero_phase(sos, x[0]) if given["zero_phase"] else sections.run(sos, x[0], np.zeros(2 * len(sos)))[0] for x in signals],)


FUNCTIONS = {"rls": Rls, "lms": Lms, "blms": Blms, "hybrid_kalman": Hybrid, "iir": Iir}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
