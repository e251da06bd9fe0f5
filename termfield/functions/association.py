"""Association measures as column expressions over observed and expected frequencies.

Every measure takes a :class:`Table` of columns for one cell and returns a column, so a whole
scoring run is one projection that Catalyst compiles.  ``sparse`` gives the form that is 0
wherever a cell is not more frequent than expected; the signed form is used for densified
tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """The contingency table of a cell: O observed, R1 and C1 marginals, N the sample size."""

    O: Column
    R1: Column
    C1: Column
    N: Column

    @cached_property
    def E(self) -> Column:
        return self.R1 * self.C1 / self.N

    @cached_property
    def R2(self) -> Column:
        return self.N - self.R1

    @cached_property
    def C2(self) -> Column:
        return self.N - self.C1

    @cached_property
    def O11(self) -> Column:
        return self.O

    @cached_property
    def O12(self) -> Column:
        return self.R1 - self.O

    @cached_property
    def O21(self) -> Column:
        return self.C1 - self.O

    @cached_property
    def O22(self) -> Column:
        return self.C2 - self.O12

    @cached_property
    def E11(self) -> Column:
        return self.E

    @cached_property
    def E12(self) -> Column:
        return self.R1 * self.C2 / self.N

    @cached_property
    def E21(self) -> Column:
        return self.R2 * self.C1 / self.N

    @cached_property
    def E22(self) -> Column:
        return self.R2 * self.C2 / self.N


def _attracted(t: Table, value: Column) -> Column:
    return F.when(t.O > t.E, value).otherwise(F.lit(0.0))


def _signed(t: Table, value: Column) -> Column:
    return F.when(t.O >= t.E, value).otherwise(-value)


def _entropy_term(o: Column, e: Column) -> Column:
    """o ln(o / e), 0 for an empty cell."""
    return F.when(o > 0, o * F.ln(o / e)).otherwise(F.lit(0.0))


def frequency(t: Table, sparse: bool = True) -> Column:
    return t.O


def simple_ll(t: Table, sparse: bool = True) -> Column:
    value = 2 * (_entropy_term(t.O, t.E) - (t.O - t.E))
    return _attracted(t, value) if sparse else _signed(t, value)


def t_score(t: Table, sparse: bool = True) -> Column:
    if sparse:
        return _attracted(t, (t.O - t.E) / F.sqrt(t.O))
    return (t.O - t.E) / F.sqrt(t.O + 1)


def z_score(t: Table, sparse: bool = True) -> Column:
    value = (t.O - t.E) / F.sqrt(t.E)
    return _attracted(t, value) if sparse else value


def dice(t: Table, sparse: bool = True) -> Column:
    return 2 * t.O / (t.R1 + t.C1)


def mutual_information(t: Table, sparse: bool = True) -> Column:
    """Pointwise, in bits; the sparse form is PPMI, the other is -Infinity for an empty cell."""
    value = F.when(t.O > 0, F.log2(t.O / t.E)).otherwise(F.lit(float("-inf")))
    return _attracted(t, value) if sparse else value


def log_likelihood(t: Table, sparse: bool = True) -> Column:
    terms = [_entropy_term(o, e) for o, e in ((t.O11, t.E11), (t.O12, t.E12), (t.O21, t.E21), (t.O22, t.E22))]
    value = 2 * (terms[0] + terms[1] + terms[2] + terms[3])
    return _attracted(t, value) if sparse else _signed(t, value)


def chi_squared(t: Table, sparse: bool = True) -> Column:
    """With Yates' correction, which is not kept from turning the difference negative."""
    gap = F.abs(t.O11 * t.O22 - t.O12 * t.O21) - t.N / 2
    value = t.N * gap * gap / (t.R1 * t.R2 * t.C1 * t.C2)
    return _attracted(t, value) if sparse else _signed(t, value)


def tf_idf(t: Table, sparse: bool = True) -> Column:
    """C1 is the feature's document frequency here and N the number of documents."""
    return F.when(t.C1 > 0, t.O * F.ln(t.N / t.C1)).otherwise(F.lit(0.0))


Measure = Callable[..., Column]

MEASURES: dict[str, Measure] = {
    "frequency": frequency,
    "simple-ll": simple_ll,
    "t-score": t_score,
    "z-score": z_score,
    "Dice": dice,
    "MI": mutual_information,
    "tf.idf": tf_idf,
    "log-likelihood": log_likelihood,
    "chi-squared": chi_squared,
}

#: Measures that are the same in both forms.
ALWAYS_SPARSE = {"frequency", "Dice", "tf.idf"}


def named(choice: str, options: list[str], what: str) -> str:
    """The option that ``choice`` is, or is the only beginning of."""
    if choice in options:
        return choice
    found = [o for o in options if o.startswith(choice)]
    if len(found) != 1:
        raise ValueError(f"{what} must be one of {', '.join(options)}: {choice!r}")
    return found[0]


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "none": lambda x: x,
    "log": lambda x: F.signum(x) * F.log1p(F.abs(x)),
    "root": lambda x: F.signum(x) * F.sqrt(F.abs(x)),
    "sigmoid": lambda x: F.tanh(x),
}
