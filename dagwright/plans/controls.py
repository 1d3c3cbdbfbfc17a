"""Options of cache builds and fits, with their defaults, checked by name."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from ..operators.models import Priors


@dataclass(frozen=True)
class BuildControl:
    """Defaults of a cache build. Priors: normal coefficients (mean, precision),
    gamma precisions (shape, inverse scale)."""

    mean: float = 0.0
    prec: float = 0.001
    loggam_shape: float = 1.0
    loggam_inv_scale: float = 5e-05
    max_iters: int = 100
    tol: float = 1e-8
    seed: int = 9062019

    def priors(self) -> Priors:
        return Priors(self.mean, self.prec, self.loggam_shape, self.loggam_inv_scale)


@dataclass(frozen=True)
class FitControl(BuildControl):
    """Defaults of a fit: a finer tolerance, and the grids of the marginals."""

    tol: float = 1e-11
    n_grid: int = 250
    min_pdf: float = 0.001
    std_area: bool = True
    quantiles: tuple[float, ...] = (0.025, 0.25, 0.5, 0.75, 0.975)
    max_grid_iter: int = 1000


#: Options that only Bayesian fits read.
BAYES = frozenset("mean prec loggam_shape loggam_inv_scale n_grid min_pdf std_area quantiles max_grid_iter".split())
#: Options of other engines that nothing here could read: derivatives are exact or
#: central differences, integrals are Laplace's, tasks are Spark's.
ELSEWHERE = frozenset("ncores cluster_type max_mode_error epsabs epsabs_inner max_hessian_error max_iters_inner max_iters_hessian finite_step_size hessian_params factor_brent maxiters_hessian_brent num_intervals_brent trace error_verbose".split())


def control(method: str = "bayes", fit: bool = False, **options) -> BuildControl:
    """Options over the defaults, for ``build_cache(control=...)``, ``fit(control=...)``
    and ``marginals(control=...)``. An unknown name is an error; one that the
    method doesn't read, or no engine here (ELSEWHERE), a warning."""
    if method not in ("mle", "bayes"):
        raise ValueError("method is 'mle' or 'bayes'")
    kind = FitControl if fit else BuildControl
    if none := ELSEWHERE & set(options):
        warnings.warn(f"read by no engine here: {sorted(none)}", stacklevel=2)
        options = {k: v for k, v in options.items() if k not in none}
    if unknown := set(options) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    if method == "mle" and (idle := BAYES & set(options)):
        warnings.warn(f"not read by mle: {sorted(idle)}", stacklevel=2)
    return kind(**options)
