"""Rows in a form that two engines share."""

import datetime
import decimal


def plain(value: object) -> object:
    if isinstance(value, float):
        return ("f", round(value, 5) + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("f", round(float(value), 5))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
