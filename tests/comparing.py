def same_rows(spark_frame, duck_relation) -> None:
    """Equal columns and equal rows in any order; floats to nine digits."""
    ours, theirs = spark_frame.toPandas(), duck_relation.df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def cell(x):
        if x is None or x != x:
            return "NULL"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    rows = lambda frame: sorted(tuple(cell(x) for x in row) for row in frame[columns].itertuples(index=False))
    assert rows(ours) == rows(theirs)
