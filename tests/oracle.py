"""The chunk codec in NumPy, written from its formulas: what the tests hold the engine against."""

import numpy as np

C0 = 0.28209479177387814


def bounds(v):
    """Per chunk of 256 rows: minima and maxima of (n, k) values."""
    parts = [v[k : k + 256] for k in range(0, len(v), 256)]
    return np.array([p.min(0) for p in parts]), np.array([p.max(0) for p in parts])


def codes(v, low, high, bits):
    chunk = np.arange(len(v)) // 256
    unit = np.clip((v - low[chunk]) / np.maximum(high - low, 1e-10)[chunk], 0, 1)
    return np.floor(unit * (2 ** np.array(bits) - 1) + 0.5).astype(np.int64)


def words(means, scales, quats, opacities, sh0):
    out = {}
    for name, v, clamp in (("packed_position", means, False), ("packed_scale", scales, True)):
        low, high = bounds(v)
        if clamp:
            low, high = np.clip(low, -20, 20), np.clip(high, -20, 20)
        c = codes(v, low, high, (11, 10, 11))
        out[name] = c[:, 0] << 21 | c[:, 1] << 11 | c[:, 2]
    rgb = sh0 * C0 + 0.5
    c = codes(rgb, *bounds(rgb), (8, 8, 8))
    o = np.floor(1 / (1 + np.exp(-opacities)) * 255 + 0.5).astype(np.int64)
    out["packed_color"] = c[:, 0] << 24 | c[:, 1] << 16 | c[:, 2] << 8 | o
    rotation = []
    for q in quats:
        n = np.sqrt((q * q).sum())
        q = q / n if n > 0 else q
        w = int(np.abs(q).argmax())
        q = -q if q[w] < 0 else q
        a, b, c3 = np.floor(np.clip(np.delete(q, w) * np.sqrt(2) * 0.5 + 0.5, 0, 1) * 1023 + 0.5).astype(np.int64)
        rotation.append(w << 30 | a << 20 | b << 10 | c3)
    out["packed_rotation"] = np.array(rotation)
    return out


def scene(n, degree=0, seed=42):
    r = np.random.default_rng(seed)
    k = {0: 0, 1: 3, 2: 8, 3: 15}[degree]
    return {
        "means": r.normal(size=(n, 3)).astype("f4"), "scales": (r.normal(size=(n, 3)) * 0.5 - 1).astype("f4"), "quats": r.normal(size=(n, 4)).astype("f4"),
        "opacities": r.normal(size=n).astype("f4"), "sh0": (r.normal(size=(n, 3)) * 0.3).astype("f4"), "shN": (r.normal(size=(n, k, 3)) * 0.1).astype("f4"),
    }
