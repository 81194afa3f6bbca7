"""What several test modules need."""


def values(frame, *columns):
    """Rows as a set of tuples, or of plain values for one column."""
    return {row[0] if len(columns) == 1 else tuple(row) for row in frame.select(*columns).collect()}
