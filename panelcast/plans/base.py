"""Registry of named queries, each with its result columns and, where SQL can say it, its SQL.

Column specs are `name:type`, with type i (bigint), s (string), b (boolean), d (double, the
default) or r (double of any size). Doubles are cut to four decimals on both sides in the same
way, those of type r to two decimals from 1,000 on.
"""
QUERIES, SQL = {}, {}


def _spec(cols):
    cols = cols.split() if isinstance(cols, str) else list(cols)
    return [(c.split(":") + ["d"])[:2] for c in cols]


def shape(df, cols):
    text = {"d": "floor(CAST({n} AS DOUBLE) * 10000 + 0.501D) / 10000D AS {n}",
            "i": "CAST({n} AS BIGINT) AS {n}",
            "r": "CASE WHEN {n} IS NULL THEN NULL WHEN abs({n}) < 1000 THEN floor(CAST({n} AS DOUBLE) * 10000 + 0.501D) / 10000D "
                 "ELSE floor(CAST({n} AS DOUBLE) * 100 + 0.501D) / 100D END AS {n}"}
    return df.selectExpr(*[text.get(kind, "{n}").format(n=name) for name, kind in _spec(cols)])


def shape_sql(cols):
    out = []
    for name, kind in _spec(cols):
        if kind == "d":
            out.append(f"floor(CAST({name} AS DOUBLE)*10000+0.501)/10000.0 AS {name}")
        elif kind == "r":
            out.append(f"CASE WHEN abs({name}) < 1000 THEN floor(CAST({name} AS DOUBLE)*10000+0.501)/10000.0 "
                       f"ELSE floor(CAST({name} AS DOUBLE)*100+0.501)/100.0 END AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return ", ".join(out)


def query(name, cols, sql=None, prefix=None):
    """Register fn(spark, sf_dir) -> DataFrame under `name`."""
    def register(fn):
        def run(spark, sf_dir):
            return shape(fn(spark, sf_dir), cols)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            from panelcast.plans.prefix import PREFIX
            head = PREFIX if prefix is None else prefix
            SQL[name] = f"WITH {head},\nr AS (\n{sql.strip()}\n)\nSELECT {shape_sql(cols)} FROM r"
        return fn
    return register
