"""Many trailing windows from one short one.

A trailing window of 7 k rows is k seven-row windows laid end to end. The short window
is computed once per row and packed into a struct; longer windows read the structs 7,
14, .. rows back and combine them. A 91-row window costs 13 additions instead of 91.
Expressions are written as SQL text because there are hundreds of them.
"""
from panelcast.config import DAY, DAY_CHUNK, KEY
from panelcast.functions.chunks import chunked, owned, over

STEP = 7


def top_p95_sql(n, top):
    """95th percentile of n <= 21 values, given their largest ones in falling order."""
    rank = f"(0.95D * ({n} - 1))"
    low = f"get({top}, CAST({n} - 1 - floor({rank}) AS INT))"
    high = f"get({top}, CAST({n} - 1 - ceil({rank}) AS INT))"
    return f"CASE WHEN {n} > 0 THEN {low} + ({high} - {low}) * ({rank} - floor({rank})) END"


SHORT = {
    "n": "count({c}) {w}", "s": "sum({c}) {w}", "q": "var_pop({c}) {w} * count({c}) {w}",
    "lo": "min({c}) {w}", "hi": "max({c}) {w}",
    "top": "slice(sort_array(collect_list({c}) {w}, false), 1, 2)",
}
NEEDS = {"mean": "", "sum": "", "count": "", "rows": "", "std": "q", "min": "lo", "max": "hi", "p95": "top"}


def _blocks(df, fields, widest, key, pos, size):
    """Pack the seven-row fields into _b0 and the earlier packs into _b1, _b2, .."""
    cut = chunked(df, pos, size, before=widest - 1)
    cut = cut.selectExpr("*", f"named_struct({fields}) AS _b0")
    one = over(key, pos)
    later = [f"lag(_b0, {STEP * k}) {one} AS _b{k}" for k in range(1, widest // STEP)]
    return owned(cut.selectExpr("*", *later))


def _join(terms):
    return "(" + " + ".join(terms) + ")"


def rolling_stats(df, wanted, key=KEY, pos=DAY, size=DAY_CHUNK):
    """Add the trailing-window columns named in `wanted`.

    `wanted` maps an output name to (column, statistic, window); windows are multiples of
    seven rows, statistics are mean, std (population), min, max, sum, p95, count and rows.
    Nulls are skipped; a window without values gives null (sum 0, count 0). Early rows use
    the rows that exist.
    """
    widest = max(w for _, _, w in wanted.values())
    w7 = over(key, pos, STEP - 1)
    need = {}
    for col, stat, _ in wanted.values():
        need.setdefault(col, {"n", "s"}).update({NEEDS[stat]} - {""})
    fields = f"'rows', count(*) {w7}"
    for col, kinds in need.items():
        for kind in sorted(kinds):
            fields += f", '{col}__{kind}', " + SHORT[kind].format(c=col, w=w7)
    base = df.columns
    cut = _blocks(df, fields, widest, key, pos, size)
    pairs = sorted({(c, w) for c, _, w in wanted.values()})
    sums = [f"{_join([f'coalesce(_b{k}.{c}__n, 0)' for k in range(w // STEP)])} AS _n_{c}_{w}" for c, w in pairs]
    sums += [f"{_join([f'coalesce(_b{k}.{c}__s, 0D)' for k in range(w // STEP)])} AS _s_{c}_{w}" for c, w in pairs]
    out = []
    for name, (c, stat, w) in wanted.items():
        ks, n, s = range(w // STEP), f"_n_{c}_{w}", f"_s_{c}_{w}"
        if stat == "mean":
            value = f"CASE WHEN {n} > 0 THEN {s} / {n} END"
        elif stat == "sum":
            value = s
        elif stat == "count":
            value = n
        elif stat == "rows":
            value = _join([f"coalesce(_b{k}.rows, 0)" for k in ks])
        elif stat in ("min", "max"):
            field, pick = ("lo", "array_min") if stat == "min" else ("hi", "array_max")
            value = f"{pick}(array({', '.join(f'_b{k}.{c}__{field}' for k in ks)}))"
        elif stat == "std":
            far = [f"CASE WHEN _b{k}.{c}__n > 0 THEN _b{k}.{c}__q + _b{k}.{c}__n * "
                   f"pow(_b{k}.{c}__s / _b{k}.{c}__n - {s} / {n}, 2) ELSE 0D END" for k in ks]
            value = f"CASE WHEN {n} > 0 THEN sqrt({_join(far)} / {n}) END"
        else:
            if w > 21:
                raise ValueError("p95 needs a window of at most 21 rows")
            tops = ", ".join(f"coalesce(_b{k}.{c}__top, array())" for k in ks)
            value = top_p95_sql(n, f"sort_array(concat({tops}), false)")
        out.append(f"{value} AS {name}")
    return cut.selectExpr("*", *sums).selectExpr(*base, *out)


def rolling_slopes(df, wanted, key=KEY, pos=DAY, size=DAY_CHUNK):
    """Add least-squares slopes over the valid points; `wanted` maps name to (column, window).

    0 unless more than two points are valid.
    """
    widest = max(w for _, w in wanted.values())
    w7 = over(key, pos, STEP - 1)
    fields = []
    for c in sorted({c for c, _ in wanted.values()}):
        x = f"CASE WHEN {c} IS NOT NULL THEN CAST({pos} AS DOUBLE) END"
        fields += [f"'{c}__n', count({c}) {w7}", f"'{c}__x', avg({x}) {w7}", f"'{c}__y', avg({c}) {w7}",
                   f"'{c}__xy', covar_pop({x}, {c}) {w7} * count({c}) {w7}",
                   f"'{c}__xx', var_pop({x}) {w7} * count({c}) {w7}"]
    base = df.columns
    cut = _blocks(df, ", ".join(fields), widest, key, pos, size)
    pre, out = [], []
    for name, (c, w) in wanted.items():
        ks = range(w // STEP)
        n = [f"coalesce(_b{k}.{c}__n, 0)" for k in ks]
        pre += [f"{_join(n)} AS _n_{c}_{w}"] + [
            f"try_divide({_join([f'coalesce(_b{k}.{c}__n * _b{k}.{c}__{a}, 0D)' for k in ks])}, {_join(n)}) AS _{a}_{c}_{w}"
            for a in "xy"]
        dx = [f"(_b{k}.{c}__x - _x_{c}_{w})" for k in ks]
        dy = [f"(_b{k}.{c}__y - _y_{c}_{w})" for k in ks]
        xy = _join([f"coalesce(_b{k}.{c}__xy + _b{k}.{c}__n * {dx[k]} * {dy[k]}, 0D)" for k in ks])
        xx = _join([f"coalesce(_b{k}.{c}__xx + _b{k}.{c}__n * {dx[k]} * {dx[k]}, 0D)" for k in ks])
        out.append(f"CASE WHEN _n_{c}_{w} > 2 THEN {xy} / {xx} ELSE 0D END AS {name}")
    return cut.selectExpr("*", *pre).selectExpr(*base, *out)
