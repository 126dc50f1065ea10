"""Frames that grow leave the worker some at a time."""

import numpy as np
import pyarrow as pa

from sigloom.functions import transforms as X


def test_correlograms_leave_in_parts(monkeypatch):
    held = []
    monkeypatch.setattr(X.F, "arrow_udf", lambda f, kind: held.append(f) or (lambda a: None))
    bank, v = np.random.default_rng(1).normal(size=(4, 9)), np.random.default_rng(2).normal(size=(700, 64))
    X.auto_correlogram(None, bank, 16)
    rows = [*v.tolist(), None, [1.0, 2.0]]
    parts = list(held[0](iter([pa.array(rows, pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64()))])))
    sizes = [len(p.flatten()) for p in parts]
    assert max(sizes) <= X.AT_ONCE and len(parts) > 5 and sum(map(len, parts)) == 702 and sum(sizes) == 700 * 41 * 32 * 4
    got = pa.concat_arrays(parts)
    assert got[700].as_py() is None and got[701].as_py() == []
    for i in (0, 101, 102, 699):
        y = np.lib.stride_tricks.sliding_window_view(v[i], 9) @ bank.T
        whole = np.array(got[i].as_py()).reshape(41, 32, 4)
        assert np.allclose(whole[3, 16 + 5], (y[3 : 3 + 11] * y[8 : 8 + 11]).sum(0) / np.sqrt(32))
