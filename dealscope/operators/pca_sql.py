"""The principal components of the amounts in SQL: power iteration in a recursive common table, with deflation, as counterpart of ``points.pca``."""

from __future__ import annotations

from ..plans.roles import AMOUNTS

STEPS = 3000


def axes_sql(source: str, cols: list[str] = AMOUNTS, steps: int = STEPS) -> str:
    """Common tables: ``known`` (rows of ``source`` with all columns), ``z`` (code, v: z-scores), ``axis`` (a, ev, v): eigenvalues with n / (n - 1), and loadings whose largest is positive.

    The walk starts at 1, 1/2, 1/3, ...; a deflated matrix has the found axes taken off."""
    p = len(cols)
    start = ", ".join(f"{1 / (i + 1)!r}" for i in range(p))
    rows = ", ".join("[" + ", ".join("1.0" if i == j else f"coalesce(corr({a}, {b}), 0)" for j, b in enumerate(cols)) + "]" for i, a in enumerate(cols))
    out = [
        f"known as materialized (select code, {', '.join(cols)} from {source} where {' and '.join(f'{c} is not null' for c in cols)})",
        f"m0 as materialized (select [{rows}] as m, count(*) as n from known)",
        "z as materialized (select code, [" + ", ".join(f"case when stddev_pop({c}) over () > 0 then ({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end" for c in cols) + "] as v from known)",
    ]
    for a in range(p):
        out += [
            f"""w{a} as (select 0 as i, [{start}] as v union all select i + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) from (
  select i, list_transform(m, lambda r: list_dot_product(r, v)) as u from w{a}, m{a}) where i < {steps} and list_dot_product(u, u) > 0)""",
            f"""e{a} as materialized (select list_transform(v, lambda x: x * s) as v, l from (select v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) as l,
  case when v[list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x))))] < 0 then -1 else 1 end as s from (select v from w{a} order by i desc limit 1), m{a}))""",
            f"m{a + 1} as materialized (select list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 1}), lambda j: m[i][j] - l * v[i] * v[j])) as m, n from m{a}, e{a})",
        ]
    out.append("axis as materialized (" + " union all ".join(f"select {a + 1} as a, l * n / greatest(n - 1, 1) as ev, v from e{a}, m0" for a in range(p)) + ")")
    return ",\n".join(out)


def scores_sql(source: str, body: str, cols: list[str] = AMOUNTS) -> str:
    return f"with recursive {axes_sql(source, cols)}\n{body}"
