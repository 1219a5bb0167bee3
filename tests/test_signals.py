"""Windows, padding, descriptors and one end-to-end run on synthetic tones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ExtractionIncomplete
from tidemark.functions import signal, spectrum
from tidemark.operators import descriptors, models, windows
from tidemark.parameters import Band, Split
from tidemark.plans.crossval import cross_validate
from tidemark.plans.registry import UnknownName, build_extractor, control, get, silent_models

RATE = 4000
BAND = Band(
    target_rate=RATE, min_native_rate=RATE, window=1024, hop=512, max_windows=4, n_fft=256,
    fft_hop=128, n_mels=32, fmin=50.0,
)


@pytest.mark.parametrize(
    "n, window, hop, most, expected",
    [
        (10, 16, 8, 0, [0]),
        (16, 16, 8, 0, [0]),
        (32, 16, 8, 0, [0, 8, 16]),
        (35, 16, 8, 0, [0, 8, 16, 19]),
        (67, 16, 8, 4, [0, 16, 40, 51]),
        (67, 16, 8, 1, [0]),
        (67, 16, 8, 2, [0, 51]),
    ],
)
def test_window_starts(spark, n, window, hop, most, expected):
    assert spark.range(1).select(signal.window_starts(F.lit(n), window, hop, most)).head()[0] == expected


@pytest.mark.parametrize("mode", ["reflect", "wrap", "edge", "constant"])
@pytest.mark.parametrize("size", [1, 2, 5, 20])
def test_padding_as_numpy(spark, mode, size):
    values = [float(v * v - 3) for v in range(size)]
    frame = spark.createDataFrame([(values,)], "s array<double>")
    got = frame.select(signal.pad_signal(F.col("s"), 17, mode)).head()[0]
    used = mode if size > 1 else "constant"
    wanted = np.pad(values, (0, max(17 - size, 0)), mode=used)
    assert np.array_equal(got, wanted)


@pytest.mark.parametrize("mode", ["reflect", "wrap", "edge", "constant"])
@pytest.mark.parametrize("most", [0, 1, 3])
def test_sample_rows_cut_as_arrays_do(spark, mode, most):
    band = Band(
        target_rate=10, min_native_rate=10, window=12, hop=5, max_windows=most, pad_mode=mode
    )
    signals = {i: [float((i * 31 + v * v) % 17) for v in range(n)] for i, n in enumerate((1, 2, 7, 12, 13, 40, 97))}
    arrays = spark.createDataFrame(list(signals.items()), "item_id long, signal array<double>")
    rows = spark.createDataFrame(
        [(i, p, v) for i, s in signals.items() for p, v in enumerate(s)],
        "item_id long, position long, value double",
    )
    names = ["item_id", "window_index", "offset", "value"]
    left = windows.split_windows(arrays, band).select(
        "item_id", "window_index", F.posexplode("samples").alias("offset", "value")
    )
    right = windows.split_samples(rows, band)
    assert sorted(map(tuple, left.select(names).collect())) == sorted(
        map(tuple, right.select(names).collect())
    )


def describe(*blocks):
    filters = spectrum.mel_filters(RATE, 256, 32, 50.0, RATE / 2)
    names = spectrum.descriptor_names(RATE)
    table = spectrum.descriptors(np.stack(blocks), RATE, 256, 128, filters)
    assert table.shape == (len(blocks), len(names)) and np.isfinite(table).all()
    return [dict(zip(names, row)) for row in table]


def test_descriptors_tell_tone_from_noise():
    time = np.arange(2048) / RATE
    tone = np.sin(2 * np.pi * 750 * time)
    noise = np.random.default_rng(0).normal(size=2048)
    a, quiet, b, silence = describe(tone, tone * 0.1, noise, np.zeros(2048))
    assert abs(a["dominant_frequency"] - 750) <= RATE / 256
    assert abs(a["centroid_mean"] - 750) < 60 and a["dominant_frequency_ratio"] > 0.4
    assert a["spectral_entropy_mean"] < 0.4 < 0.85 < b["spectral_entropy_mean"] <= 1
    assert a["flatness_mean"] < b["flatness_mean"]
    assert a["mfcc_3_mean"] == pytest.approx(quiet["mfcc_3_mean"], rel=0.01)
    assert a["zero_crossing_rate_mean"] == pytest.approx(2 * 750 / RATE, abs=0.05)
    assert silence["rms_mean"] == 0


def test_contrast_bands():
    assert [spectrum.contrast_bands(r) for r in (10000, 5120, 300, 12800)] == [5, 4, 1, 5]


def test_mel_filters_cover_the_band():
    filters = spectrum.mel_filters(RATE, 512, 32, 50.0, RATE / 2)
    assert filters.shape == (32, 257) and (filters.sum(axis=1) > 0).all()
    assert spectrum.mel_to_hz(spectrum.hz_to_mel(1234.5)) == pytest.approx(1234.5)


def test_jobs_keep_rows_and_shapes(spark):
    noise = np.random.default_rng(1).normal(size=(150, 1024)).tolist()
    frame = spark.createDataFrame(list(enumerate(noise)), "item_id int, samples array<double>").repartition(3)
    images = descriptors.log_mel_job(frame, BAND)
    row = images.head()
    assert images.count() == 150 and len(row["features"]) == row["n_mels"] * row["n_frames"] == 32 * 9
    assert abs(np.mean(row["features"])) < 1e-3 and np.std(row["features"]) == pytest.approx(1, abs=1e-3)

    def encoder():
        return lambda block: np.stack([block[:, :4], block[:, 4:8] * 2], axis=1)

    pooled = descriptors.embed_windows(frame, encoder, window=1024, width=4, pooling="max")
    got = {r["item_id"]: r["features"] for r in pooled.collect()}
    x = np.array(noise[7], dtype=np.float32)
    assert np.allclose(got[7], np.maximum(x[:4], x[4:8] * 2), atol=1e-6)


def test_missing_items_stop_the_extraction(spark):
    kept = spark.createDataFrame([("a",), ("b",)], "item_id string")
    made = kept.filter("item_id = 'a'")
    with pytest.raises(ExtractionIncomplete, match="'b'"):
        windows.extract_complete(kept, made)
    assert windows.extract_complete(kept, made, allow_missing=True).count() == 1


def test_registries():
    assert silent_models() == ["logbook", "metadata"] and control().name == "metadata"
    assert get("probe").hears_signal
    with pytest.raises(UnknownName):
        get("nothing")
    with pytest.raises(UnknownName):
        build_extractor("nothing", BAND)


def test_end_to_end_on_tones(spark):
    """Three classes of tone over four groups each; a linear probe must tell them apart."""
    rng, rows = np.random.default_rng(4), []
    for label, pitch in enumerate((300, 700, 1300)):
        for group in range(6):
            for item in range(2):
                length = int(rng.integers(700, 4000))
                time = np.arange(length) / RATE
                wave = np.sin(2 * np.pi * (pitch + 10 * group) * time) + 0.3 * rng.normal(size=length)
                rows.append((f"{label}-{group}-{item}", f"{label}-{group}", str(label), label, wave.tolist()))
    items = spark.createDataFrame(
        rows, "item_id string, group_id string, class string, label int, signal array<double>"
    )
    cut = windows.split_windows(items, BAND)
    features = build_extractor("acoustic", BAND)(cut)
    assert windows.missing_items(items, features).count() == 0
    done = cross_validate(
        features, ["0", "1", "2"], models.fit_probe((0.05,), 20), Split(n_folds=2), "probe"
    )
    scores = {r["metric"]: r["mean"] for r in done["summary"].collect()}
    assert scores["macro_f1"] > 0.9 and scores["roc_auc_ovr_macro"] > 0.9
    assert done["predictions"].count() == 36
