import pytest

from sigloom.units import (
    MS, S, SR11025, SR44100, IdentityDimension, SampleRate, Stride, TimeDimension, TimeSlice, audio_rate, frame_count, half_lapped, leftover_start, milliseconds, nearest_audio_rate, padded_length, rate, seconds,
)


@pytest.mark.parametrize("sr,ps", [(96000, 10416666), (48000, 20833333), (44100, 22675736), (22050, 45351473), (16000, 62500000), (11025, 90702947)])
def test_rates(sr, ps):
    assert rate(sr).frequency == ps and rate(sr).samples_per_second == sr and rate(sr).nyquist == sr // 2


def test_rates_by_name():
    assert audio_rate(44100) == SR44100 and nearest_audio_rate(44000) == SR44100
    with pytest.raises(ValueError):
        audio_rate(12345)
    with pytest.raises(ValueError):
        SampleRate(0)
    h = half_lapped()
    assert (h.frequency, h.duration) == (23219953664, 46439907328) and h.overlap_ratio == 0.5


@pytest.mark.parametrize("sr,expected", [(11025, (256, 512)), (22050, (512, 1024)), (44100, (1024, 2048))])
def test_discrete_samples(sr, expected):
    assert half_lapped().discrete_samples(TimeDimension(rate(sr).frequency)) == expected


@pytest.mark.parametrize("sr,window,step", [(96000, 4096, 2048), (48000, 2048, 1024), (44100, 2048, 1024), (22050, 1024, 512), (11025, 512, 256)])
def test_windows_of_half_lapped_schemes(sr, window, step):
    assert TimeDimension(rate(sr).frequency).window_of(half_lapped(sr)) == (window, step)


def test_fractions_round_up():
    axis = TimeDimension(SR11025.frequency)
    assert axis.window_of(SampleRate(250 * MS, 500 * MS)) == (5513, 2757)


def test_lapped_frames_are_one_row_longer():
    frames = half_lapped() * Stride(2, 4)
    assert TimeDimension(half_lapped().frequency, half_lapped().duration).window_of(frames) == (5, 2)
    outer, _ = TimeDimension(half_lapped().frequency, half_lapped().duration).windowed(5, 2)
    assert outer.frequency == 2 * half_lapped().frequency and outer.duration == 6 * half_lapped().frequency
    assert SampleRate(10) * 3 == SampleRate(30, 30) and SampleRate(10) * (3,) == SampleRate(30, 30)


def test_slices_by_bounds():
    axis = TimeDimension(S, S, 10)
    size = lambda a, b: (lambda lo, hi: hi - lo)(*axis.rows(axis.between(a, b)))
    assert [size(None, 7 * S), size(7 * S, None), size(5 * S, 7 * S), size(-7 * S, None), size(None, -2 * S)] == [7, 3, 2, 7, 8]


def test_slices_of_rows():
    axis = TimeDimension(S, S, 10)
    assert axis.rows(TimeSlice(2 * S, 2 * S)) == (2, 4) and axis.rows(TimeSlice(None, 2 * S)) == (2, 10)
    assert axis.rows(TimeSlice(100 * MS, 1500 * MS)) == (1, 2) and axis.rows(TimeSlice(2 * S, 1500 * MS)) == (1, 4)
    assert TimeDimension(S, 2 * S, 10).rows(TimeSlice(2 * S, S)) == (0, 3)
    assert TimeDimension(S, 3 * S, 10).rows(TimeSlice(2 * S, 5 * S)) == (3, 7) and TimeDimension(S, 3 * S, 10).rows(TimeSlice(2 * S, 6 * S)) == (4, 8)
    assert TimeDimension(S // 2, S, 10).rows(TimeSlice(2 * S, 600 * MS)) == (0, 6)


def test_slice_algebra():
    assert (TimeSlice(100, 100) & TimeSlice(100, 101)).duration == 99 and (TimeSlice(10, 0) & TimeSlice(10, 50)).duration == 0
    assert (TimeSlice(100, 100) & TimeSlice(100, 101)).start == 101 and (TimeSlice(None, 5) & TimeSlice(None, 7)) == TimeSlice(None, 7)
    assert 210 in TimeSlice(100, 200) and 200 not in TimeSlice(100, 200) and TimeSlice(10, 210) in TimeSlice(100, 200) and TimeSlice(None, 210) not in TimeSlice(100, 200)
    assert TimeSlice.between([30, 10, 20]) == [TimeSlice(10, 10), TimeSlice(10, 20)]
    assert TimeSlice(5, 1) < TimeSlice(1, 2) and TimeSlice(5, 1) + 4 == TimeSlice(5, 5)
    for bad in (1.5, "x", True):
        with pytest.raises(ValueError):
            TimeSlice(bad)
    with pytest.raises(ValueError):
        "x" in TimeSlice(1)


@pytest.mark.parametrize("n,w,s,padded,frames,whole,left", [(100, 10, 5, 105, 20, 19, 95), (103, 10, 5, 105, 20, 19, 95), (10, 10, 5, 10, 1, 0, 0), (7, 10, 5, 10, 1, 0, 0), (103, 10, 10, 110, 11, 10, 100), (103, 10, 7, 101, 14, 14, 98), (10, 2, 1, 11, 10, 9, 9), (10, 3, 2, 11, 5, 4, 8), (10, 3, 3, 12, 4, 3, 9), (5, 6, 1, 6, 1, 0, 0)])
def test_framing(n, w, s, padded, frames, whole, left):
    assert padded_length(n, w, s) == padded and frame_count(n, w, s) == frames and frame_count(n, w, s, pad=False) == whole and leftover_start(n, w, s) == left


def test_durations_are_truncated():
    assert seconds(1.9) == S and milliseconds(2.7) == 2 * MS
    d = TimeDimension(S, 2 * S, 5)
    assert d.span == 6 * S and d.end_seconds == 6 and TimeDimension.from_metadata(d.metadata()) == d and d.resample(0.5).frequency == S // 2
    with pytest.raises(ValueError):
        IdentityDimension(10).windowed(5, 1)
    with pytest.raises(ValueError):
        frame_count(5, 0, 1)
