"""Frames handled one Arrow batch at a time, for processing that has no SQL form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def energies(frames: DataFrame) -> DataFrame:
    """Of (track, frame, x: array): the energy of each frame, streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"track": pdf["track"], "frame": pdf["frame"], "energy": [float(np.square(np.asarray(x, np.float64)).sum()) for x in pdf["x"]]})

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    return frames.mapInPandas(run, f"track {kinds['track']}, frame {kinds['frame']}, energy double")
