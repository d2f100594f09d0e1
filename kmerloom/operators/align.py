"""Semi-global alignment: a whole query against the best place in a reference, unit edit costs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "struct<start:int,end:int,min_errors:int,aligned_reference:string,symbols:string,aligned_query:string>"
GAP = "-"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _next_row(above: np.ndarray, r: np.ndarray, symbol: int, i: int, places: np.ndarray) -> np.ndarray:
    """Edit costs of the query's first i symbols against references that end at each place, from the row before.

    The left-to-right insertions of a row are a running minimum of cost - place.
    """
    row = np.empty(len(above), np.int32)
    row[0] = i
    np.minimum(above[1:] + 1, above[:-1] + (r[: len(above) - 1] != symbol), out=row[1:])
    row -= places[: len(row)]
    np.minimum.accumulate(row, out=row)
    row += places[: len(row)]
    return row


def _bit(bits: np.ndarray, at: int) -> bool:
    return bool(bits[at >> 3] >> (7 - (at & 7)) & 1)


def align(reference: str, query: str) -> dict:
    """First end with the fewest errors; on the way back a query symbol alone comes before a reference symbol alone, before a pair.

    Memory is that of a few rows for each of ``sqrt(len(query))`` query symbols: going forward, every ``step``-th row is kept as its differences (-1, 0, 1); on the way
    back the rows between two kept ones are made again, up to the place that is reached, as two bits for each place.
    """
    r, q = _codes(reference), _codes(query)
    places = np.arange(len(r) + 1, dtype=np.int32)
    step = math.isqrt(len(q)) + 1
    row, kept = np.zeros(len(r) + 1, np.int32), []
    for i, symbol in enumerate(q, 1):
        if (i - 1) % step == 0:
            kept.append(np.diff(row).astype(np.int8))
        row = _next_row(row, r, symbol, i, places)
    j = end = int(row.argmin())
    errors = int(row[end])
    i = len(query)
    steps: list[tuple[str, str]] = []
    while i:
        # bits say whether a cost is one more than the one above, and one more than the one to the left
        first = (i - 1) // step * step
        row = np.concatenate([[first], kept.pop()[:j].astype(np.int32)]).cumsum(dtype=np.int32)
        ups, lefts = [], []
        for k in range(first, i):
            above, row = row, _next_row(row, r, q[k], k + 1, places)
            ups.append(np.packbits(row == above + 1))
            lefts.append(np.packbits(np.concatenate([[False], row[1:] == row[:-1] + 1])))
        while i > first:
            if _bit(ups[i - 1 - first], j):
                i, pair = i - 1, (GAP, query[i - 1])
            elif j and _bit(lefts[i - 1 - first], j):
                j, pair = j - 1, (reference[j - 1], GAP)
            else:
                i, j, pair = i - 1, j - 1, (reference[j - 1], query[i - 1])
            steps.append(pair)
    steps.reverse()
    sign = lambda a, b: "|" if a == b else "I" if a == GAP else "D" if b == GAP else "*"
    return {
        "start": j,
        "end": end,
        "min_errors": errors,
        "aligned_reference": "".join(a for a, _ in steps),
        "symbols": "".join(sign(a, b) for a, b in steps),
        "aligned_query": "".join(b for _, b in steps),
    }


def _aligned(reference: pd.Series, query: pd.Series) -> pd.DataFrame:
    rows = [align(r or "", q or "") for r, q in zip(reference, query)]
    return pd.DataFrame(rows, columns=["start", "end", "min_errors", "aligned_reference", "symbols", "aligned_query"])


def semiglobal(reference: Column, query: Column) -> Column:
    """Struct start, end, min_errors, aligned_reference, symbols, aligned_query. Null counts as empty."""
    return F.pandas_udf(_aligned, RESULT)(reference, query)


# Terminal colours of the symbols.
COLOURS = {"|": "\033[92m", "*": "\033[91m", "I": "\033[93m", "D": "\033[94m"}
RESET = "\033[0m"


def coloured(aligned: str, symbols: str) -> str:
    """A line of an alignment with each symbol's colour."""
    return "".join(f"{COLOURS.get(s, '')}{a}{RESET}" for a, s in zip(aligned, symbols))


def coloured_column(aligned: Column, symbols: Column) -> Column:
    """The same of two columns."""
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    one = lambda a, s: F.concat(F.coalesce(F.try_element_at(colours, s), F.lit("")), a, F.lit(RESET))
    # the regular expression takes code points one by one; an empty line has none
    each = lambda c: F.regexp_extract_all(c, F.lit(r"([\s\S])"), F.lit(1))
    return F.array_join(F.zip_with(each(aligned), each(symbols), one), "")
