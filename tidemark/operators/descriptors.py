"""Feature jobs over windows: spectral descriptors, log-mel images, encoders.

Each job maps Arrow batches of window rows where they are; nothing is shuffled and a
batch is worked through in blocks of windows, never row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import spectrum
from tidemark.parameters import Band

BLOCK = 64


def _in_blocks(df: DataFrame, work: Callable[[np.ndarray], np.ndarray], extra=()) -> DataFrame:
    kept = [field for field in df.schema.fields if field.name != "samples"]
    added = [T.StructField("features", T.ArrayType(T.FloatType()))]
    added += [T.StructField(name, T.IntegerType()) for name, _ in extra]

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                rows = batch.iloc[at : at + BLOCK]
                block = np.stack(rows["samples"].to_numpy()).astype(float)
                flat = work(block).reshape(len(rows), -1).astype(np.float32)
                yield rows.drop(columns="samples").assign(features=list(flat), **dict(extra))

    return df.mapInPandas(job, T.StructType([*kept, *added]))


def _filters(band: Band) -> np.ndarray:
    top = band.target_rate / 2 if band.fmax is None else band.fmax
    return spectrum.mel_filters(band.target_rate, band.n_fft, band.n_mels, band.fmin, top)


def spectral_job(windows: DataFrame, band: Band, n_mfcc: int = 20) -> DataFrame:
    """Replace ``samples`` by the hand-made descriptors of each window."""
    filters = _filters(band)
    rate, n_fft, hop = band.target_rate, band.n_fft, band.fft_hop
    return _in_blocks(
        windows, lambda block: spectrum.descriptors(block, rate, n_fft, hop, filters, n_mfcc)
    )


def log_mel_job(windows: DataFrame, band: Band) -> DataFrame:
    """Replace ``samples`` by a flattened standardised log-mel image and its shape."""
    filters = _filters(band)
    rate, n_fft, hop = band.target_rate, band.n_fft, band.fft_hop
    shape = (("n_mels", band.n_mels), ("n_frames", 1 + band.window // hop))
    return _in_blocks(
        windows, lambda block: spectrum.log_mel(block, rate, n_fft, hop, filters), shape
    )


def embed_windows(
    windows: DataFrame,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    *,
    window: int,
    width: int,
    pooling: str = "mean",
    batch_size: int = 64,
) -> DataFrame:
    """Replace ``samples`` by a frozen encoder's states pooled over time.

    ``make_encoder`` is called once per Python worker and returns a function from
    ``(n, window)`` to ``(n, time, width)``.
    """
    if pooling not in ("mean", "max"):
        raise ValueError("pooling must be mean or max")

    def make_predict():
        encode = make_encoder()

        def predict(block: np.ndarray) -> np.ndarray:
            states = np.asarray(encode(block))
            pooled = states.max(axis=1) if pooling == "max" else states.mean(axis=1)
            if pooled.shape[1] != width:
                raise ValueError(f"encoder gave {pooled.shape[1]} values, expected {width}")
            return pooled.astype(np.float32)

        return predict

    encode = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[window]],
    )
    samples = F.col("samples").cast("array<float>")
    return windows.withColumn("features", encode(samples)).drop("samples")
