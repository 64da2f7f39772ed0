"""Rows of a DataFrame and of a SQL result as comparable text."""


def _text(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_text, v)) + "]"
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_text(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_text(r[i]) for i in order) for r in found.fetchall())
