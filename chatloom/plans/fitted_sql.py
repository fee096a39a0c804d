"""SQL that fits the linear models by itself, to compare the fitted ones with.

The models have four features, so all that a fit needs from the rows is the sums of a five by five
system, the intercept first; it is solved by elimination in nested selects. Gaussian ridge is one
such system. The other families repeat it with new weights in a recursive query until nothing moves,
and the elastic net descends by coordinates on the correlations.
"""

from ..operators.features import STATS_FEATURES

# The penalty of all linear models and the share of its absolute part in the elastic net.
PENALTY, ABSOLUTE_SHARE = 0.3, 0.8
# Fixed value: reweighting ends when no term moves by more.
TOLERANCE = 1e-6
_SIZE = len(STATS_FEATURES) + 1
_TERMS = range(_SIZE)


def _names(prefix: str, pairs) -> str:
    return ", ".join(prefix.format(*p) for p in pairs)


def rows(combined: str, months: str, label: str) -> str:
    """x0 (one) to x4, the label y, and the side of the split."""
    columns = ", ".join(f'cast(coalesce("{c}", 0) AS double) AS x{i + 1}' for i, c in enumerate(STATS_FEATURES))
    return f"SELECT 1.0::double AS x0, {columns}, {label} AS y, split FROM ({combined}) JOIN {months} USING (period)"


def sums(weight: str = "1.0", target: str = "y") -> str:
    """Weighted means of products: a{i}_{j} of two features, b{i} of a feature with the target."""
    products = [f"sum({weight} * x{i} * x{j}) / sum({weight}) AS a{i}_{j}" for i in _TERMS for j in _TERMS]
    with_target = [f"sum({weight} * x{i} * ({target})) / sum({weight}) AS b{i}" for i in _TERMS]
    return ", ".join((*products, *with_target, f"sum({weight} * ({target}) * ({target})) / sum({weight}) AS t"))


def solved(system: str, penalties: list[str], keep: str = "") -> str:
    """c0 to c4 from a select of ``sums``; ``penalties`` are added to the features' diagonal."""
    added = {(i + 1, i + 1): f" + ({p})" for i, p in enumerate(penalties)}
    entries = [f"a{i}_{j}{added.get((i, j), '')} AS a{i}_{j}" for i in _TERMS for j in _TERMS]
    query = f"SELECT {keep}{', '.join(entries)}, {_names('b{}', [(i,) for i in _TERMS])} FROM ({system})"
    for k in _TERMS:  # elimination below the diagonal
        entries = [
            (f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}" if i > k and j >= k else f"a{i}_{j}") + f" AS a{i}_{j}"
            for i in _TERMS for j in _TERMS
        ]
        right = [(f"b{i} - a{i}_{k} * b{k} / a{k}_{k}" if i > k else f"b{i}") + f" AS b{i}" for i in _TERMS]
        query = f"SELECT {keep}{', '.join(entries + right)} FROM ({query})"
    for k in reversed(_TERMS):  # back substitution
        rest = "".join(f" - a{k}_{j} * c{j}" for j in range(k + 1, _SIZE))
        query = f"SELECT *, (b{k}{rest}) / a{k}_{k} AS c{k} FROM ({query})"
    return f"SELECT {keep}{_names('c{}', [(i,) for i in _TERMS])} FROM ({query})"


def _variances() -> tuple[list[str], str]:
    """Of the features and of the target, from ``sums``."""
    return [f"(a{i}_{i} - a0_{i} * a0_{i})" for i in _TERMS[1:]], "(t - b0 * b0)"


def standardised_ridge(source: str, target: str = "y") -> str:
    """Ridge on features and target of variance one, as the normal equations are solved with both scaled."""
    features, of_target = _variances()
    system = f"SELECT {sums(target=target)} FROM ({source}) WHERE split = 'train'"
    return solved(system, [f"{PENALTY} / sqrt{of_target} * {v}" for v in features])


def reweighted(source: str, start: str, mean: str, slope: str, weight: str, steps: int = 25) -> str:
    """Iteratively reweighted ridge: ``mean`` of eta, ``slope`` of the link and ``weight``, both of mu.

    The first system takes ``start``, the linked first guess, as its target; the steps after it
    have a plain penalty. It ends with the first step that moves no term by ``TOLERANCE``.
    """
    eta = " + ".join(f"c{i} * x{i}" for i in _TERMS)
    state, before = _names("c{}", [(i,) for i in _TERMS]), _names("p{}", [(i,) for i in _TERMS])
    step = f"""SELECT step + 1 AS step, {_names('c{0} AS p{0}', [(i,) for i in _TERMS])}, {sums('w', 'z')} FROM (
      SELECT *, {weight} AS w, eta + (y - mu) * ({slope}) AS z FROM (
        SELECT *, {mean} AS mu FROM (
          SELECT *, {eta} AS eta FROM fit_rows, fit WHERE step < {steps} AND moved >= {TOLERANCE})))
    GROUP BY step, {state}"""
    moved = "greatest(" + ", ".join(f"abs(c{i} - p{i})" for i in _TERMS) + ")"
    return f"""WITH RECURSIVE fit_rows AS MATERIALIZED (SELECT * FROM ({source}) WHERE split = 'train'),
  fit AS (SELECT 0 AS step, {state}, 1.0::double AS moved FROM ({standardised_ridge(source, start)})
    UNION ALL SELECT step, {state}, {moved} AS moved
    FROM ({solved(step, [str(PENALTY)] * (_SIZE - 1), f'step, {before}, ')}))
  SELECT {state} FROM fit ORDER BY step DESC LIMIT 1"""


def elastic_net(source: str, sweeps: int = 200) -> str:
    """Coordinate descent on correlations: each step sets one coefficient, soft-thresholded, by the others."""
    system = f"SELECT {sums()} FROM ({source}) WHERE split = 'train'"
    features, of_target = _variances()
    spread = [f"sqrt{v}" for v in features]
    size = _SIZE - 1
    cor = [f"(a{i + 1}_{j + 1} - a0_{i + 1} * a0_{j + 1}) / ({spread[i]} * {spread[j]}) AS r{i}_{j}" for i in range(size) for j in range(size)]
    with_target = [f"(b{i + 1} - a0_{i + 1} * b0) / ({spread[i]} * sqrt{of_target}) AS q{i}" for i in range(size)]
    scale = [f"sqrt{of_target} / {spread[i]} AS s{i}" for i in range(size)] + [f"a0_{i + 1} AS m{i}" for i in range(size)]
    penalty = f"({PENALTY} / sqrt{of_target}) AS penalty"
    facts = f"SELECT {', '.join((*cor, *with_target, *scale))}, {penalty}, b0 FROM ({system})"
    sweep = f"SELECT step + 1 AS step, facts.*, {_names('w{}', [(i,) for i in range(size)])} FROM descent, facts WHERE step < {sweeps}"
    for k in range(size):
        rest = "".join(f" - r{k}_{j} * w{j}" for j in range(size) if j != k)
        left = f"(q{k}{rest})"
        new = f"sign({left}) * greatest(abs({left}) - penalty * {ABSOLUTE_SHARE}, 0) / (1 + penalty * {1 - ABSOLUTE_SHARE:.1f})"
        sweep = f"SELECT * REPLACE ({new} AS w{k}) FROM ({sweep})"
    state = _names("w{}", [(i,) for i in range(size)])
    weights = ", ".join(f"w{i} * s{i} AS c{i + 1}" for i in range(size))
    intercept = "b0" + "".join(f" - w{i} * s{i} * m{i}" for i in range(size))
    return f"""WITH RECURSIVE facts AS MATERIALIZED ({facts}),
  descent AS (SELECT 0 AS step, {', '.join(f'0.0::double AS w{i}' for i in range(size))}
    UNION ALL SELECT step, {state} FROM ({sweep}))
  SELECT {intercept} AS c0, {weights} FROM descent, facts ORDER BY step DESC LIMIT 1"""


def scores(source: str, fit: str, model: str, label: str, mean: str = "eta") -> str:
    """The row of ``score_regressors`` for the fitted terms."""
    eta = " + ".join(f"c{i} * x{i}" for i in _TERMS)
    parts = []
    for title, side in (("Train", "train"), ("Test", "test")):
        only = f"FILTER (split = '{side}')"
        parts += [
            f'round(avg(e * e) {only}, 6) AS "{title} MSE"', f'round(sqrt(avg(e * e) {only}), 6) AS "{title} RMSE"',
            f'round(avg(abs(e)) {only}, 6) AS "{title} MAE"',
        ]
    return f"""WITH terms AS MATERIALIZED ({fit})
  SELECT '{model}' AS model, '{label}' AS label_col, {', '.join(parts)} FROM (
    SELECT y - ({mean}) AS e, split FROM (SELECT *, {eta} AS eta FROM ({source}), terms))"""


def terms(fit: str) -> str:
    """Rows of term and weight."""
    named = [*enumerate(STATS_FEATURES, 1), (0, "(intercept)")]
    each = " UNION ALL ".join(f"SELECT '{name}' AS term, round(c{i}, 6) AS weight FROM fitted" for i, name in named)
    return f"WITH fitted AS MATERIALIZED ({fit}) {each}"
