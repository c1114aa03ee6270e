"""Rows of a Spark result and of its SQL, in one form."""


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(r[c]) for c in names]) for r in df.collect())


def sql_rows(con, sql):
    r = con.execute(sql)
    columns = [d[0] for d in r.description]
    names = sorted(columns)
    return names, sorted(str([plain(row[columns.index(c)]) for c in names]) for row in r.fetchall())
