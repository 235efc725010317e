"""Oracle-side formulas for tail probabilities (finite series, exact for integer degrees of freedom)."""


def t_p(t: str, df: str) -> str:
    """Two-sided Student p by the trigonometric series for integer df."""
    th = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    even = (f"sin({th}) * coalesce(list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1))"
            f" / sqrt(pi()) * pow(cos({th}), 2 * k))), 0)")
    odd = (f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, ((({df}) - 1) // 2)::BIGINT), lambda k: sqrt(pi()) / 2"
           f" * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({th}), 2 * k + 1))), 0))")
    return f"(CASE WHEN ({t}) IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, 1 - (CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)) END)"


def bh(p: str, part: str = "") -> tuple[str, str]:
    """(raw, q) window expressions: q needs raw as column `raw_q` in an outer query."""
    w = f"PARTITION BY {part}" if part else ""
    raw = (f"{p} * count({p}) OVER ({w}) / count({p}) OVER ({w} ORDER BY {p} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    q = (f"CASE WHEN {p} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, min(raw_q) OVER ({w} ORDER BY {p} NULLS LAST "
         "RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) END")
    return raw, q


def avg_rank(x: str, part: str = "") -> str:
    w = f"PARTITION BY {part}" if part else ""
    c = f"PARTITION BY {part}, {x}" if part else f"PARTITION BY {x}"
    return f"(rank() OVER ({w} ORDER BY {x}) + (count(*) OVER ({c}) - 1) / 2.0::DOUBLE)"


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided Fisher p by the full hypergeometric sum."""
    r, k, n = f"(({a}) + ({b}))", f"(({a}) + ({c}))", f"(({a}) + ({b}) + ({c}) + ({d}))"
    lc = lambda x, y: f"(lgamma({x} + 1) - lgamma({y} + 1) - lgamma({x} - {y} + 1))"
    lp = lambda v: f"({lc(r, v)} + {lc(f'({n} - {r})', f'({k} - {v})')} - {lc(n, k)})"
    return (f"least(1.0::DOUBLE, list_sum(list_transform(list_filter(range(greatest(0, {r} + {k} - {n})::BIGINT, least({r}, {k})::BIGINT + 1), "
            f"lambda v: {lp('v')} <= {lp(f'({a})')} + 1e-7), lambda v: exp({lp('v')}))))")
