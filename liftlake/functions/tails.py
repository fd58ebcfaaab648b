"""Tail probabilities and quantiles as Spark SQL expressions.

Spark SQL has no distribution functions. These are meant for facts rows (one per
comparison), never for unit rows. Integrals use Gauss-Legendre nodes over a range
chosen per row, so far tails keep their relative precision.

Arguments are SQL text (a column name or an expression over columns); the
``*_sql`` forms return text, the others a Column. Text keeps the driver's work
at one call per expression.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = 48
_NODES = [((x + 1.0) / 2.0, w / 2.0) for x, w in zip(*leggauss(_ORDER))]  # on [0, 1]
_NODE_SQL = "array(" + ", ".join(f"named_struct('u', {float(u)!r}D, 'w', {float(w)!r}D)" for u, w in _NODES) + ")"
_SPAN = 38.0  # integrate until the integrand has fallen by e**-38
_PI = repr(math.pi) + "D"


def z_quantile(p: float) -> float:
    """Standard normal quantile of a constant."""
    return NormalDist().inv_cdf(p)


def _let(name: str, values: dict[str, str], body: str) -> str:
    """Evaluate ``values`` once and bind them as fields of ``name`` in ``body``."""
    fields = ", ".join(f"'{k}', cast({v} as double)" for k, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def _integral(f: str, length: str) -> str:
    """Integral over [0, length]; ``f`` is written in ``n.u * length``."""
    return f"({length} * aggregate({_NODE_SQL}, 0D, (acc, n) -> acc + n.w * ({f})))"


def normal_upper_sql(a: str) -> str:
    """P(Z > a) for a ≥ 0."""
    f = "exp(-nb.a * n.u * nb.l - n.u * nb.l * n.u * nb.l / 2D)"
    body = f"exp(-nb.a * nb.a / 2D) / sqrt(2D * {_PI}) * {_integral(f, 'nb.l')}"
    return _let("na", {"a": a}, _let("nb", {"a": "na.a", "l": f"sqrt(na.a * na.a + {2 * _SPAN}D) - na.a"}, body))


def normal_sf_sql(z: str) -> str:
    inner = _let("nq", {"p": normal_upper_sql("abs(nz.z)"), "z": "nz.z"}, "if(nq.z >= 0D, nq.p, 1D - nq.p)")
    return _let("nz", {"z": z}, inner)


def normal_two_sided_sql(z: str) -> str:
    return f"(2D * {normal_upper_sql(f'abs({z})')})"


def _log_half_step(x: str) -> str:
    """ln Γ(x + 1/2) − ln Γ(x) for a bound name, free of the cancellation of two large values."""
    y = f"({x} + 12D)"
    series = f"0.5D * ln({y}) - 1D / (8D * {y}) + 1D / (192D * pow({y}, 3D)) - 1D / (640D * pow({y}, 5D))"
    down = " * ".join(f"(({x} + {i}.5D) / ({x} + {i}D))" for i in range(12))
    return f"({series} - ln({down}))"


def student_t_two_sided_sql(t: str, df: str) -> str:
    """P(|T| > |t|), real-valued df ≥ 1.

    With t = √df·tan θ the density becomes cos(θ)^(df−1); the integral is taken
    relative to its value at the lower end.
    """
    f = "pow(greatest(cos(tc.th + n.u * tc.l), 0D) / cos(tc.th), tc.nu - 1D)"
    scale = f"{_log_half_step('tc.h')} - {0.5 * math.log(math.pi)!r}D + (tc.nu - 1D) * ln(cos(tc.th))"
    body = _let("tp", {"p": f"2D * exp({scale}) * {_integral(f, 'tc.l')}"}, "if(tp.p > 1D, 1D, tp.p)")
    reach = f"sqrt(pow(tan(tb.th), 2D) + {2 * _SPAN}D / greatest(tb.nu - 1D, 1e-9D)) - tan(tb.th)"
    bound = {"th": "tb.th", "nu": "tb.nu", "h": "tb.nu / 2D", "l": f"least({_PI} / 2D - tb.th, {reach})"}
    inner = _let("tb", {"th": "atan(abs(ta.t) / sqrt(ta.nu))", "nu": "ta.nu"}, _let("tc", bound, body))
    return _let("ta", {"t": t, "nu": df}, inner)


def student_t_critical_sql(df: str, alpha: float = 0.05) -> str:
    """Two-sided critical value: Cornish-Fisher start, then Newton steps."""
    z = z_quantile(1.0 - alpha / 2.0)
    start = (
        f"{z!r}D + {(z**3 + z) / 4.0!r}D / cr.nu + {(5 * z**5 + 16 * z**3 + 3 * z) / 96.0!r}D / pow(cr.nu, 2D)"
        f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384.0!r}D / pow(cr.nu, 3D)"
    )
    density = (
        f"exp({_log_half_step('cr.h')} - 0.5D * ln(cr.nu * {_PI}) - (cr.nu + 1D) / 2D * log1p(x * x / cr.nu))"
    )
    step = f"greatest(x / 2D, x + ({student_t_two_sided_sql('x', 'cr.nu')} - {alpha!r}D) / (2D * {density}))"
    # the series is near exact for many degrees of freedom; few need all steps
    steps = "if(cr.nu > 40D, sequence(1, 2), sequence(1, 6))"
    return _let("cr", {"nu": df, "h": f"({df}) / 2D"}, f"aggregate({steps}, {start}, (x, k) -> {step})")


def chi_square_sf_sql(x: str, df: str) -> str:
    """P(X > x) for integer df, by the recurrence of the incomplete gamma function."""
    start = f"if(cq.k % 2D = 1D, {normal_two_sided_sql('sqrt(cq.x)')}, exp(-cq.x / 2D))"
    first = f"if(cq.k % 2D = 1D, 2D * sqrt(cq.x / 2D / {_PI}), cq.x / 2D) * exp(-cq.x / 2D)"
    base = "if(cq.k % 2D = 1D, 0.5D, 1D)"
    steps = "if(cq.k >= 3D, sequence(1, int((cq.k - 1D) / 2D)), cast(array() as array<int>))"
    folded = (
        f"aggregate({steps}, named_struct('total', {start}, 'term', {first}), (a, j) -> "
        f"named_struct('total', a.total + a.term, 'term', a.term * cq.x / 2D / ({base} + j)), a -> if(a.total > 1D, 1D, a.total))"
    )
    return _let("cq", {"x": x, "k": df}, f"if(cq.x <= 0D, 1D, {folded})")


def f_sf_sql(f: str, df1: str, df2: str) -> str:
    """P(F > f) for integer df1 and real df2, by the recurrence of the incomplete beta function."""
    log_x = "(-log1p(fq.d1 * fq.f / fq.d2))"
    w = "(fq.d1 * fq.f / (fq.d2 + fq.d1 * fq.f))"
    odd = "fq.d1 % 2D = 1D"
    start = f"if({odd}, {student_t_two_sided_sql('sqrt(fq.d1 * fq.f)', 'fq.d2')}, exp(fq.a * {log_x}))"
    first = (
        f"if({odd}, 2D * sqrt({w}) * exp(fq.a * {log_x} + {_log_half_step('fq.a')} - {0.5 * math.log(math.pi)!r}D),"
        f" fq.a * {w} * exp(fq.a * {log_x}))"
    )
    base = f"if({odd}, 0.5D, 1D)"
    steps = "if(fq.d1 >= 3D, sequence(0, int((fq.d1 - 1D) / 2D) - 1), cast(array() as array<int>))"
    folded = (
        f"aggregate({steps}, named_struct('total', {start}, 'term', {first}), (s, j) -> "
        f"named_struct('total', s.total + s.term, 'term', s.term * {w} * (fq.a + {base} + j) / ({base} + j + 1D)), s -> if(s.total > 1D, 1D, s.total))"
    )
    return _let("fq", {"f": f, "d1": df1, "d2": df2, "a": f"({df2}) / 2D"}, f"if(fq.f <= 0D, 1D, {folded})")


def normal_sf(z: str) -> Column:
    return F.expr(normal_sf_sql(z))


def normal_two_sided(z: str) -> Column:
    return F.expr(normal_two_sided_sql(z))


def student_t_two_sided(t: str, df: str) -> Column:
    return F.expr(student_t_two_sided_sql(t, df))


def student_t_critical(df: str, alpha: float = 0.05) -> Column:
    return F.expr(student_t_critical_sql(df, alpha))


def chi_square_sf(x: str, df: str) -> Column:
    return F.expr(chi_square_sf_sql(x, df))


def f_sf(f: str, df1: str, df2: str) -> Column:
    return F.expr(f_sf_sql(f, df1, df2))
