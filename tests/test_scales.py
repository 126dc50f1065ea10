import numpy as np
import pytest

from sigloom.functions.transforms import dct2_matrix, dct4_matrix, fft_resampled, fir_bank, frequency_decomposition, mdct_matrix, morlet_bank, rfft_matrices
from sigloom.functions.windows import hann, oggvorbis
from sigloom.scales import Band, BarkScale, ChromaScale, GeometricScale, LinearScale, MelScale, Scale, a_weighting, bark_to_hz, erb, hz_to_bark, hz_to_mel, mel_to_hz


def test_bands():
    assert Band.from_center(1000, 50) == Band(975, 1025) and Band(0, 100).intersect(Band(50, 150)) == Band(50, 100) and Band(0, 100).intersection_ratio(Band(50, 150)) == 0.5
    assert Band.from_start(10, 5).center == 12.5 and Band(0, 10).bandwidth_ratio(Band(0, 5)) == 0.5 and Band.audible(5000) == Band(20, 5000)
    for a, b in ((10, 10), (10, 5)):
        with pytest.raises(ValueError):
            Band(a, b)
    with pytest.raises(ValueError):
        Band(0, 1).intersect(Band(2, 3))


def test_bins():
    assert LinearScale(Band(0, 100), 10).bins(Band(0, 20)) == (0, 2) and LinearScale(Band(0, 1000), 100).bins(Band(500, 700)) == (49, 70) and LinearScale(Band(0, 1000), 10).bins(Band(495, 705)) == (4, 8)
    assert LinearScale(Band(100, 500), 4).starts == [100, 200, 300, 400]
    assert LinearScale(Band(0, 1000), 10, always_even=True).bins(Band(495, 605)) == (4, 8)
    s = LinearScale(Band(0, 1000), 10)
    assert s.between(-300) == s.bins(Band(700, 1000)) and s.between(None, 200) == s.bins(Band(0, 200))
    assert s[2] == Band(200, 300) and len(s[2:5]) == 3 and s[Band(495, 705)].starts == [400, 500, 600, 700] and s.q[1] == 1.5


def test_round_trips():
    for x in (20.0, 440.0, 9000.0):
        assert bark_to_hz(hz_to_bark(x)) == pytest.approx(x) and mel_to_hz(hz_to_mel(x)) == pytest.approx(x)
    assert hz_to_bark(1000) == pytest.approx(7.7027739765) and hz_to_mel(1000) == pytest.approx(999.990700766) and erb(1000) == pytest.approx(132.7)
    g = GeometricScale(300, 3040, 0.1, 4)
    assert g.centers == pytest.approx([300, 649.190313, 1404.826876, 3040]) and Scale.decoded(g.encoded()) == g


def test_overlap_ratio():
    for ratio, fine in ((0.001, False), (0.01, False), (0.017, True)):
        s = GeometricScale(300, 3030, ratio, 300)
        if fine:
            s.ensure_overlap_ratio(0.5)
        else:
            with pytest.raises(AssertionError):
                s.ensure_overlap_ratio(0.5)


def test_weighting_and_bases():
    s = Scale([Band.from_center(c, 10) for c in (100, 1000, 5000)])
    assert a_weighting(s) == pytest.approx([1, 20.145152, 20.700617])
    bins = LinearScale(Band(0, 5000), 100)
    assert BarkScale(Band(50, 4000), 8).basis(bins).shape == (8, 100) and (MelScale(Band(50, 4000), 8).basis(bins, hann) >= 0).all()
    chroma = ChromaScale(Band(200, 4000))
    b = chroma.basis(LinearScale(Band(0, 5000), 2000))
    assert b[0, int(440 / 2.5)] > 0 and b[0, int(880 / 2.5)] > 0 and b[6, int(440 / 2.5)] == 0


def test_windows():
    assert oggvorbis(8) == pytest.approx([0.059856, 0.4669, 0.886333, 1, 1, 0.886333, 0.4669, 0.059856], abs=1e-6)
    assert hann(8) == pytest.approx([0, 0.188255, 0.61126, 0.950484, 0.950484, 0.61126, 0.188255, 0], abs=1e-6)


def test_transform_matrices():
    for m in (dct2_matrix(16), dct4_matrix(16)):
        assert m @ m.T == pytest.approx(np.eye(16), abs=1e-12)
    assert dct4_matrix(16) @ dct4_matrix(16) == pytest.approx(np.eye(16), abs=1e-12)
    x = np.random.default_rng(0).normal(size=64)
    re, im = rfft_matrices(64)
    assert re @ x + 1j * (im @ x) == pytest.approx(np.fft.rfft(x, norm="ortho"))
    w, m, out = oggvorbis(32), mdct_matrix(16), np.zeros(64)
    for at in range(0, 48, 16):
        out[at : at + 32] += w * (m.T @ (m @ (w * x[at : at + 32])))
    assert out[16:48] == pytest.approx(x[16:48], abs=1e-4)


def test_resampling_and_banks():
    t = np.arange(64)
    assert fft_resampled(np.cos(2 * np.pi * 3 * t / 64)[None], 128)[0] == pytest.approx(np.cos(2 * np.pi * 3 * np.arange(128) / 128), abs=1e-9)
    x = np.random.default_rng(1).normal(size=64)
    bands = frequency_decomposition(x, [64, 16, 32])
    assert sum(fft_resampled(b[None], 64)[0] for b in bands) == pytest.approx(x)
    scale = GeometricScale(300, 4000, 0.2, 5)
    bank = morlet_bank(11025, 128, scale, 0.5)
    assert np.linalg.norm(bank, axis=1) == pytest.approx(np.ones(5), abs=1e-6)
    peaks = np.abs(np.fft.rfft(bank, 4096)).argmax(1) * 11025 / 4096
    assert peaks == pytest.approx(scale.centers, rel=0.25)
    with pytest.raises(ValueError):
        morlet_bank(11025, 128, scale, [0.5])
    fir = fir_bank(LinearScale(Band(500, 4500), 4), 128, 11025)
    assert np.abs(np.fft.rfft(fir, 4096)).argmax(1) * 11025 / 4096 == pytest.approx(LinearScale(Band(500, 4500), 4).centers, rel=0.15)
