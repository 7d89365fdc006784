"""Edit scripts between two token lists."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame


def edit_scripts(pairs: DataFrame, key: str, kind: str, more: dict[str, str] | None = None) -> DataFrame:
    """(key, step, op, left_from, left_to, right_from, right_to) that turn ``left`` into ``right``, both arrays of tokens.
    ``more``: further columns of the key, with their types, after the first."""
    kinds = {key: kind} | (more or {})

    def run(frames):
        for frame in frames:
            rows = []
            for *own, left, right in zip(*(frame[k] for k in kinds), frame["left"], frame["right"], strict=True):
                ops = SequenceMatcher(None, list(left), list(right), autojunk=False).get_opcodes()
                rows += [(*own, n, *op) for n, op in enumerate(ops)]
            yield pd.DataFrame(rows, columns=[*kinds, "step", "op", "left_from", "left_to", "right_from", "right_to"])

    return pairs.select(*kinds, "left", "right").mapInPandas(run, f"{', '.join(f'{k} {v}' for k, v in kinds.items())}, step int, op string, left_from int, left_to int, right_from int, right_to int")
