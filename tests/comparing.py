"""What tests share: the smallest tables, and rows as both engines can be compared by."""

SF = "/root/testdata/sf0.001"


def plain(value):
    """A value as both engines can be compared by: floats rounded, NaN and NA as None."""
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if value is None or type(value).__name__ == "NAType" or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=repr)
