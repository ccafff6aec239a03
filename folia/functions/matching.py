"""Error-tolerant matching by edit distance, in bits of whole numbers: all rows of the table at a time, a column a step."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def column_distances(needle: str, text: str, anchored: bool = False) -> list[int]:
    """The edit distance of needle to the best part of text that ends at each place, or if anchored to the whole text up to it.

    Differences of neighbouring rows are bits of two whole numbers, so a place costs a few operations
    whatever the length of the needle (up to a machine word).
    """
    size = len(needle)
    if not size:
        return list(range(1, len(text) + 1)) if anchored else [0] * len(text)
    every, top = (1 << size) - 1, 1 << (size - 1)
    held: dict[str, int] = {}
    for i, c in enumerate(needle):
        held[c] = held.get(c, 0) | 1 << i
    more, less, score, out = every, 0, size, []
    for c in text:
        same = held.get(c, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        grows, shrinks = less | (~(across | more) & every), more & across
        score += (grows & top > 0) - (shrinks & top > 0)
        grows = (grows << 1 | anchored) & every
        shrinks = (shrinks << 1) & every
        more, less = shrinks | (~(down | grows) & every), grows & down
        out.append(score)
    return out


def best_match(needle: str, text: str, most: int, before: int | None = None) -> tuple[int, int, int] | None:
    """(errors, start, end) of the part of text nearest to needle, with ``most`` errors at most: of equal ones the
    first, then the shortest. before: it must start before this place."""
    ends = [(d, j + 1) for j, d in enumerate(column_distances(needle, text)) if d <= most]
    best: tuple[int, int, int] | None = None
    for least, end in sorted(ends):
        if best is not None and least > best[0]:
            break
        low = max(0, end - len(needle) - most)
        # all starts of parts that end here, from the end backwards
        for n, errors in enumerate(column_distances(needle[::-1], text[low:end][::-1], anchored=True)):
            start = end - n - 1
            if errors <= most and (before is None or start < before):
                best = min(best or (errors, start, end), (errors, start, end))
    return best


@F.pandas_udf(IntegerType())
def edit_le(needles: pd.Series, texts: pd.Series, most: pd.Series) -> pd.Series:
    """The least edit distance of needle to any part of text, null if it is more than ``most`` or an input is null."""

    def least(needle: str | None, text: str | None, limit: float | None) -> int | None:
        if needle is None or text is None or limit is None or limit != limit:
            return None
        found = min([len(needle), *column_distances(needle, text)])
        return found if found <= limit else None

    return pd.Series([least(*row) for row in zip(needles, texts, most, strict=True)], dtype="Int32")
