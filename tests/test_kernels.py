import numpy as np
from pyspark.sql import functions as F

from echogrid.functions import kernels
from echogrid.operators import series as w
from echogrid.operators import signals as g


def test_bandpass_keeps_the_band_and_removes_the_rest():
    fs, t = 100.0, np.arange(0, 10, 0.01)
    tone = lambda f: np.sin(2 * np.pi * f * t)
    gain = lambda f: np.abs(kernels.zero_phase_bandpass(tone(f)[None], fs, 2.0, 20.0)[0][300:700]).max()
    assert abs(gain(8.0) - 1) < 0.01 and gain(0.3) < 0.01 and gain(45.0) < 0.01
    assert np.allclose(kernels.zero_phase_bandpass(tone(8.0)[None], fs, 2.0, 20.0)[0][300:700], tone(8.0)[300:700], atol=0.02)


def test_bandpass_leaves_short_input_alone():
    x = np.ones((1, 20))
    assert kernels.zero_phase_bandpass(x, 100.0, 2.0, 20.0) is x


def test_components_rebuild_the_window():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 1)) * np.array([[3.0, 1.0, 0.5]]) + 0.01 * rng.normal(size=(60, 3))
    r = kernels.svd_components(np.stack([x.T, 2 * x.T]), 5)
    assert r["chosen"].tolist() == [[True, False, False]] * 2 and np.allclose(r["energy"], [((x - x.mean(0)) ** 2).sum() * k for k in (1, 4)])
    assert np.allclose((r["signal"] ** 2).sum(-1), [np.linalg.svd(x - x.mean(0))[1][0] ** 2 * k for k in (1, 4)])


def test_covariance_choice_follows_its_definition():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(6, 5, 64)), -1)
    got, every = kernels.covariance_components(x, 4), kernels.covariance_components(x, 4, "variance95")
    for b, w in enumerate(x):
        values, vectors = np.linalg.eigh(np.cov(w))
        q = {}
        for k in range(5):
            if values[4 - k] >= values[4] / 1000:
                padded = np.pad(np.abs(vectors[:, 4 - k] @ w), 4, mode="edge")
                v = [padded[t : t + 9].var(ddof=1) for t in range(64)]
                q[k] = max(v) / np.mean(v)
        wanted = sorted((k for k in q if q[k] / sum(q.values()) >= 1 / max(len(q) - 1, 1)), key=lambda k: -q[k])[:3]
        assert list(got["order"][b]) == (wanted or [max(q, key=q.get)])
        n = 1 + next(k for k in range(5) if values[::-1][: k + 1].sum() >= 0.95 * values.sum())
        assert list(every["order"][b]) == list(range(n))


def test_channel_products_equal_the_sums_they_stand_for():
    rng = np.random.default_rng(3)
    x, fs = rng.normal(size=(2, 3, 64)), 20.0
    x[1, 2] = 5.0
    got = kernels.channel_products(x, fs, 16)
    assert got["active"].tolist() == [[True] * 3, [True, True, False]]
    points = np.linspace(0, 0.4, 129) * fs
    for b in range(2):
        c = x[b] - x[b].mean(-1, keepdims=True)
        e = (c**2).sum(-1)
        u = np.where(e[:, None] > 1e-12, c / np.sqrt(np.maximum(e, 1e-12))[:, None], 0)
        lagged = lambda k, lag: np.array([u[k, t] * u[k, t - lag] if t >= lag else 0.0 for t in range(64)])
        prod = np.array([[lagged(k, lag) for lag in range(9)] for k in range(3)])
        cells = prod.reshape(3, 9, 16, 4).sum(-1) * 16
        for name, weight in (("mean", (e > 1e-12) / (e > 1e-12).sum()), ("energy", e / e.sum())):
            rows = np.einsum("k,klc->lc", weight, cells)
            assert np.allclose(got[name][b], [[np.interp(p, np.arange(9), rows[:, c]) for c in range(16)] for p in points])
        assert np.allclose(got["curves"][b], [[np.interp(p, np.arange(9), prod[k].sum(-1)) for k in range(3)] for p in points])


def test_scalogram_peaks_at_the_tone():
    fs, freqs = 50.0, np.linspace(1, 20, 20)[::-1]
    m = kernels.morlet_scalograms(np.sin(2 * np.pi * 8 * np.arange(400) / fs)[None], freqs, fs)[0]
    assert m.shape == (20, 400) and abs(freqs[m[:, 200].argmax()] - 8) <= 1


def test_reachable_frequencies_match_a_cell_by_cell_walk():
    rng = np.random.default_rng(1)
    for _ in range(50):
        img, freqs, step = (rng.random((6, 9)) > 0.5) * rng.random((6, 9)), np.arange(6, 0, -1.0), 1.5
        want, top = img.copy(), 0.0
        for c in range(9):
            for r in np.argsort(-freqs):
                if want[r, c] <= 0:
                    continue
                if top <= 0 or freqs[r] - top <= step:
                    top = max(top, freqs[r])
                    break
                want[r, c] = 0.0
        assert np.array_equal(kernels.keep_reachable(img, freqs, step), want)


def test_wavelet_round_trip_for_odd_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=n).tolist()) for n in (64, 75, 101, 200)]
    b = g.reconstruct(g.wavelet_bands(spark.createDataFrame(rows, "n int, x array<double>"), "x"))
    for r in b.collect():
        assert np.allclose(r.rebuilt[: r.n], r.x, atol=1e-9)
    e = g.energy_entropy(g.wavelet_bands(spark.createDataFrame([(1, [0.0] * 64)], "n int, x array<double>"), "x")).first()
    assert e.entropy == 0.0


def test_acf_is_one_at_lag_zero_and_null_for_constants(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 3.0],), ([5.0] * 4,)], "x array<double>")
    a, b = [r.a for r in df.select(g.standard_acf(F.col("x"), F.lit(2)).alias("a")).collect()]
    assert a[0] == 1.0 and b is None


def test_peaks_apart_higher_wins(spark):
    rng = np.random.default_rng(4)
    x = rng.random(400)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    got = sorted(r.peak for r in w.local_peaks(df, ["k"], "i", "v", 10, chunk_rows=37).collect())
    level = x.mean() + x.std()
    tops = [i for i in range(1, 399) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= level]
    kept = []
    for i in sorted(tops, key=lambda i: -x[i]):
        if all(abs(i - k) >= 10 for k in kept):
            kept.append(i)
    assert got == sorted(kept)


def test_higuchi_of_line_and_noise(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(0, np.arange(60.0).tolist()), (1, rng.normal(size=400).tolist()), (2, [1.0] * 10), (3, [1.0, 2.0])], "k int, x array<double>")
    d = {r.k: r.d for r in df.select("k", g.higuchi(F.col("x")).alias("d")).collect()}
    assert abs(d[0] - 1) < 1e-9 and d[1] > 1.8 and d[2] == 1.0 and d[3] is None
