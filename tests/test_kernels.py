"""Numpy kernels against properties and hand-made values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framefold.functions.stencils import ELLIPSE11
from framefold.operators import estimation, kernels
from framefold.plans import previews
from framefold.sources import images

RNG = np.random.default_rng(1)


def picture(h, w, c=1):
    return RNG.integers(0, 256, (h, w) if c == 1 else (h, w, c), dtype=np.uint8)


def scene(h=64, w=64):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 60 * np.sin(x / 5.0) * np.cos(y / 7.0) + 40 * np.sin((x + y) / 11.0), 0, 255)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (8, 8), (13, 31), (64, 48)])
def test_pyramid_is_undone(shape):
    image = picture(*shape).astype(float)
    assert np.allclose(kernels.collapsed(kernels.built(image), clip=False), image)


def test_laplacian_of_a_plane_is_zero_inside():
    y, x = np.mgrid[:9, :9].astype(float)
    assert np.allclose(kernels.laplacian(3 * x + 2 * y)[2:-2, 2:-2], 0)


def test_reflection_leaves_out_the_edge():
    assert kernels.reflected(np.array([[1, 2, 3]]), 2).tolist()[0] == [3, 2, 1, 2, 3, 2, 1]


def test_identity_warps():
    image = picture(9, 11, 3).astype(float)
    for taps in (kernels.linear_taps, kernels.lanczos_taps):
        assert np.allclose(kernels.warped(image, np.eye(3)[:2], taps=taps), image)
    moved = kernels.warped(image, np.array([[1, 0, 2.0], [0, 1, 1.0]]), taps=kernels.linear_taps)
    assert np.allclose(moved[1:, 2:], image[:-1, :-2]) and not moved[0].any() and not moved[:, :2].any()


def test_resizing_keeps_constants():
    image = np.full((7, 5), 42.0)
    assert np.allclose(kernels.resized(image, 3, 9), 42) and np.allclose(kernels.area_resized(image, 3, 2), 42)
    assert np.allclose(kernels.area_resized(np.array([[0.0, 2, 4, 6]]), 1, 2), [[1, 5]])


def test_point_filters():
    image = picture(12, 12, 4)
    assert (kernels.sharpened(image, 0) == image).all()
    assert (kernels.bilateral(image, 1.0)[..., 3] == image[..., 3]).all()
    flat = np.full((16, 16), 90, np.uint8)
    assert len(np.unique(kernels.equalised(flat))) == 1 and (kernels.bilateral(flat, 2.0) == 90).all()


def test_fusing_equal_frames_gives_the_frame():
    image = picture(20, 24, 3)
    stack = kernels.Stack()
    for _ in range(3):
        stack.add(image)
    assert np.abs(stack.result().astype(int) - image).max() <= 1


def test_fusion_takes_the_sharp_half():
    sharp = picture(64, 64).astype(float)
    soft = kernels.gaussian(sharp, 3)
    left, right = sharp.copy(), sharp.copy()
    left[:, 32:], right[:, :32] = soft[:, 32:], soft[:, :32]
    stack = kernels.Stack()
    for image in (left, right):
        stack.add(kernels.to_bytes(image))
    out = stack.result().astype(float)
    assert np.abs(out - sharp)[:, 8:24].mean() < 4 and np.abs(out - sharp)[:, 40:56].mean() < 4 < np.abs(soft - sharp).mean()


def test_alpha_is_opaque_where_all_are():
    a, b = picture(8, 8, 4), picture(8, 8, 4)
    a[..., 3], b[..., 3] = 255, 255
    a[0, 0, 3] = b[3, 3, 3] = 0
    stack = kernels.Stack()
    stack.add(a)
    stack.add(b)
    assert stack.alpha[0, 0] == stack.alpha[3, 3] == 0 and (stack.alpha == 255).sum() == 62
    # The result's alpha is eroded by an ellipse of 11 by 11.
    reach = [(y - 5, x) for y, r in enumerate(ELLIPSE11) for x in range(-r, r + 1)]
    told = [[min(stack.alpha[y + dy, x + dx] for dy, dx in reach if 0 <= y + dy < 8 and 0 <= x + dx < 8) for x in range(8)] for y in range(8)]
    assert stack.result()[..., 3].tolist() == told
    wide = np.full((40, 40), 255, np.uint8)
    wide[20, 20] = 0
    assert (kernels.eroded(wide, ELLIPSE11) == 0).sum() == len(reach)


def test_sampling_against_brute_force():
    """Every tap of every place, outside 0 or the edge."""
    image = picture(7, 9).astype(float)
    y, x = RNG.uniform(-9, 15, (6, 5)), RNG.uniform(-9, 17, (6, 5))
    for taps in (kernels.linear_taps, kernels.lanczos_taps):
        for edge in (False, True):
            told = np.zeros((6, 5))
            for i in range(6):
                for j in range(5):
                    cy, cx = np.clip(y[i, j], -4, 10), np.clip(x[i, j], -4, 12)
                    for dy, wy in taps(np.array([cy - np.floor(cy)])):
                        for dx, wx in taps(np.array([cx - np.floor(cx)])):
                            yy, xx = int(np.floor(cy)) + dy, int(np.floor(cx)) + dx
                            if edge or 0 <= yy < 7 and 0 <= xx < 9:
                                told[i, j] += wy[0] * wx[0] * image[min(max(yy, 0), 6), min(max(xx, 0), 8)]
            assert np.allclose(kernels.sampled(image, y, x, taps, edge), told)
    t = np.array([0.0, 1e-12, 0.3, 0.5, 0.999999])
    plain = np.array([np.sinc(t - k) * np.sinc((t - k) / 4) for k in range(-3, 5)])
    assert np.allclose([w for _, w in kernels.lanczos_taps(t)], plain / plain.sum(axis=0), atol=1e-6)


def test_bilateral_against_brute_force():
    image = picture(6, 7, 3)
    padded = kernels.reflected(image.astype(float), 4)
    told = np.zeros((6, 7, 3))
    for y in range(6):
        for x in range(7):
            total = weight = 0.0
            for dy in range(-4, 5):
                for dx in range(-4, 5):
                    if dy * dy + dx * dx <= 16:
                        near = padded[4 + y + dy, 4 + x + dx]
                        far = np.abs(near - image[y, x]).sum()
                        k = np.exp(-(dy * dy + dx * dx) / (2 * 10**2) - far**2 / (2 * 50**2))
                        total, weight = total + k * near, weight + k
            told[y, x] = total / weight
    assert np.abs(kernels.bilateral(image, 1.0) - told).max() <= 0.501


@pytest.mark.parametrize("model", ["similarity", "affine", "homography"])
def test_ransac_finds_the_transform(model):
    true = np.array([[0.98, -0.1, 5], [0.1, 0.98, -3], [0, 0, 1.0]])
    a = RNG.uniform(0, 100, (60, 2))
    b = estimation.moved(true, a)
    b[:15] += RNG.uniform(20, 50, (15, 2))
    m, inside = estimation.ransac(model, a, b, 1.0, 2000, 0.995, 7)
    assert np.allclose(m, true, atol=1e-6) and inside.sum() == 45
    assert estimation.ransac(model, a[:3], b[:3], 1.0, 10, 0.9, 7)[0] is None


def test_similarities_of_many_pairs_are_fitted_together(monkeypatch):
    rng, sets = np.random.default_rng(11), []
    for k in range(300):
        a = rng.uniform(0, 60, (k % 14, 2))
        b = estimation.moved(np.array([[0.98, -0.1, 5], [0.1, 0.98, -3], [0, 0, 1.0]]), a) + rng.normal(0, 0.6, a.shape)
        b[: len(b) // 3] += 30
        if k % 5 == 0 and len(a) > 3:
            a[1], b[2] = a[0], b[0]
        if k % 7 == 0:
            a[:] = 4.0
        sets.append(np.c_[a, b])
    told = []
    for v in sets:
        v = v[np.lexsort((*v[:, 2:].T, *v[:, :2].T))]
        told.append(estimation.ransac("similarity", v[:, :2], v[:, 2:], 1.5, 5000, 0.995, 7))
    monkeypatch.setattr(estimation, "ransac", None)  # no set has a fit of its own
    found, inliers, ms = estimation.fits(np.concatenate(sets), np.cumsum([len(v) for v in sets]), "similarity", 1.5, 5000, 0.995, lambda k: 7)
    assert found.tolist() == [m is not None for m, _ in told] and 100 < found.sum() < 300
    assert inliers.tolist() == [inside.sum() for _, inside in told]
    assert all(np.allclose(m, np.eye(3) if t is None else t, rtol=1e-12, atol=1e-12) for m, (t, _) in zip(ms, told))


@pytest.mark.parametrize("motion", list(estimation.MOTIONS))
def test_ecc_recovers_a_shift(motion):
    image = scene()
    moved = kernels.warped(image, np.array([[1, 0, 1.5], [0, 1, -0.75]]), taps=kernels.linear_taps)
    m, rho = estimation.ecc(image[8:-8, 8:-8], moved[8:-8, 8:-8], motion, rounds=200, epsilon=1e-9)
    assert rho > 0.99 and np.allclose(m[:2, 2], [1.5, -0.75], atol=0.1)
    assert np.isnan(estimation.ecc(np.full((16, 16), 5.0), np.full((16, 16), 5.0))[1])


@pytest.mark.parametrize("motion", list(estimation.MOTIONS))
def test_pairs_correlated_together_are_as_alone(motion):
    rng = np.random.default_rng(5)
    big = kernels.gaussian(rng.uniform(0, 255, (60, 60)), 2.0)
    refs = np.stack([big[8:32, 8:36]] * 12 + [rng.uniform(0, 255, (24, 28))] * 12)
    images = np.stack([big[8 + k % 3 : 32 + k % 3, 8 + k % 5 : 36 + k % 5] for k in range(12)] + list(rng.uniform(0, 255, (12, 24, 28))))
    images[3], images[5] = 7.0, refs[5]
    starts, rounds = rng.normal(0, 1e-3, (24, estimation.MOTIONS[motion])), np.arange(24) * 3
    ms, rhos = estimation.ecc_each(refs, images, motion, rounds, 1e-6, 5, starts)
    alone = [estimation.ecc(*v[:2], motion, v[2], 1e-6, 5, v[3]) for v in zip(refs, images, rounds, starts)]
    assert np.array_equal(rhos, [rho for _, rho in alone], equal_nan=True) and 5 < np.isfinite(rhos).sum() < 24
    assert np.array_equal(ms, [m for m, _ in alone])


def test_keypoints_of_a_reference_are_found_once(monkeypatch):
    seen = []
    monkeypatch.setitem(estimation.FINDERS, "orb", lambda image, most: seen.append(image.mean()) or (np.zeros((0, 2)), np.zeros(0), np.zeros((0, 4), np.int64)))
    known = {}
    assert all(estimation.by_features(np.ones((9, 9)), np.zeros((9, 9)), "orb", "affine", 10, known) is None for _ in range(3))
    assert seen == [1.0]  # and none of the other raster, where the reference has too few


def test_ladder():
    image = scene(96, 96) + RNG.normal(0, 2, (96, 96))
    moved = kernels.warped(image, np.array([[1, 0, 3.0], [0, 1, -2.0]]), taps=kernels.linear_taps)
    ways = dict(estimation.fallbacks(image[10:-10, 10:-10], moved[10:-10, 10:-10], "translation", 200, 1e-8, (1.5, 500.0, 2.5)))
    assert np.allclose(ways["correlation"][:2, 2], [3, -2], atol=0.1)
    flat = np.full((32, 32), 7.0)
    ways = estimation.fallbacks(flat, flat, "affine", 10, 1e-6, (1.5, 500.0, 2.5))
    assert [m is None for _, m in ways] == [True, True, False]
    ways = dict(estimation.fallbacks(image, moved, "translation", 200, 1e-8, (1.5, 1.0, 2.5)))
    assert ways["correlation"] is None and ways["features"] is None  # too far


def test_previews():
    image = picture(40, 60, 3)
    assert previews.thumbnail(image, 30).shape == (20, 30, 4) and previews.thumbnail(image, 120).shape == (80, 120, 4)
    assert previews.preview(image, 61, 41) is image and previews.preview(image, 30, 30).shape == (20, 30, 3)
    assert (previews.rgba(image)[..., :3] == image[..., ::-1]).all()
    with pytest.raises(ValueError):
        previews.rgba(np.zeros((2, 2, 2), np.uint8))
    wide = np.tile(np.arange(16.0), (3, 1))
    assert np.allclose(kernels.resized(wide, 3, 16, kernels.lanczos_taps), wide)


def test_corners_keep_their_descriptors():
    image = kernels.to_bytes(scene()).astype(float)
    points, response, codes = estimation.corners(image, 20)
    fewer = estimation.corners(image, 5)
    assert (np.diff(response) <= 0).all() and (points[:5] == fewer[0]).all() and (codes[:5] == fewer[2]).all()


@pytest.mark.parametrize("detector", list(estimation.FINDERS))
@pytest.mark.parametrize("angle, scale", [(0.5, 1.0), (2.0, 1.0), (0.0, 1.4), (-1.0, 0.8)])
def test_keypoints_turned_and_scaled_are_recognised(angle, scale, detector):
    """Mutual nearest descriptors of a picture and its turned, scaled copy fit the transform that made it."""
    base = np.clip(scene(200, 200) + np.kron(np.random.default_rng(3).normal(0, 30, (40, 40)), np.ones((5, 5))), 0, 255)
    c, s = scale * np.cos(angle), scale * np.sin(angle)
    m = np.array([[c, -s, 100 - 100 * c + 100 * s], [s, c, 100 - 100 * s - 100 * c]])
    other = kernels.warped(base, m, taps=kernels.linear_taps)
    found = estimation.by_features(base, other, detector, "euclidean", 500)
    places = RNG.uniform(40, 160, (50, 2))
    assert np.allclose(found[:2, :2], m[:, :2], atol=0.01) and np.abs(estimation.moved(found, places) - places @ m[:, :2].T - m[:, 2]).max() < 1
    fewer, more = estimation.FINDERS[detector](base, 5), estimation.FINDERS[detector](base, 200)
    assert all((f == v[:5]).all() for f, v in zip(fewer, more, strict=True)) and (np.diff(more[1]) <= 0).all()


@pytest.mark.parametrize("detector", list(estimation.FINDERS))
def test_flat_and_tiny_rasters_have_no_keypoints(detector):
    for shape in ((1, 1), (5, 40), (64, 48)):
        points, response, codes = estimation.FINDERS[detector](np.full(shape, 90.0), 10)
        assert len(points) == len(response) == len(codes) == 0
    assert estimation.by_features(np.zeros((40, 40)), np.zeros((40, 40)), detector, "affine", 10) is None


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3, 4]), st.integers(0, 2**32 - 1))
def test_png_round_trip(h, w, c, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w) if c == 1 else (h, w, c), dtype=np.uint8)
    assert (images.decoded(images.encoded(image)) == image).all()


def made_png(w, h, depth, kind, lines, extra=()):
    import struct
    import zlib

    def chunk(name, part):
        return struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))

    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_depths_and_filters():
    assert images.decoded(made_png(1, 1, 16, 0, b"\0\x12\x34")).tolist() == [[0x12]]
    assert images.decoded(made_png(8, 1, 1, 0, b"\0\xa0")).tolist() == [[255, 0, 255, 0, 0, 0, 0, 0]]
    assert images.decoded(made_png(2, 1, 8, 3, b"\0\0\1", [(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))])).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert images.decoded(made_png(3, 2, 8, 0, b"\1\1\1\1\2\1\1\1")).tolist() == [[1, 2, 3], [2, 3, 4]]
    assert images.decoded(made_png(2, 2, 8, 0, b"\3\2\2\4\1\1")).tolist() == [[2, 3], [3, 4]]
    lines = [[(k, [RNG.integers(0, 256) for _ in range(12)]) for k in RNG.integers(0, 5, 9)] for _ in range(20)]
    for rows in lines:
        got = images.unfiltered(b"".join(bytes([k, *r]) for k, r in rows), 9, 12, 3)
        above, told = [0] * 12, []
        for k, r in rows:
            here = []
            for i, v in enumerate(r):
                a, b, c = here[i - 3] if i > 2 else 0, above[i], above[i - 3] if i > 2 else 0
                near = min((abs(a + b - c - q), n, q) for n, q in enumerate((a, b, c)))[2]
                here.append((int(v) + [0, a, b, (a + b) // 2, near][k]) % 256)
            told.append(here)
            above = here
        assert got.tolist() == told
    with pytest.raises(ValueError):
        images.decoded(b"nothing")


@pytest.mark.parametrize("w, h, depth, c", [(1, 1, 8, 1), (5, 3, 8, 3), (9, 11, 8, 4), (13, 10, 1, 1), (7, 9, 4, 1), (8, 8, 16, 3)])
def test_interlaced_png(w, h, depth, c):
    """The passes as the format has them: the pixel at (y, x) belongs to the pass that an 8 by 8 table names."""
    import zlib

    names = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]
    values = RNG.integers(0, 1 << depth, (h, w, c))
    raw = b""
    for name in "1234567":
        for y in range(h):
            line = [v for x in range(w) if names[y % 8][x % 8] == name for v in values[y, x]]
            if line:
                bits = "".join(f"{v:0{depth}b}" for v in line)
                bits += "0" * (-len(bits) % 8)
                raw += b"\0" + int(bits, 2).to_bytes(len(bits) // 8, "big")
    plain = made_png(w, h, depth, {1: 0, 3: 2, 4: 6}[c], b"")
    head = bytearray(plain[8 + 8 : 8 + 8 + 13])
    head[12] = 1
    import struct

    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))
    got = images.decoded(images.SIGNATURE + chunk(b"IHDR", bytes(head)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    told = values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))
    told = told[..., 0] if c == 1 else np.dstack([told[..., 2::-1], told[..., 3:]])
    assert (got == told).all()


def made_tiff(image, packing=1, depth=8, order="<", predictor=1):
    """A TIFF file in two strips, put together by hand."""
    import struct
    import zlib

    h, w = image.shape[:2]
    c = 1 if image.ndim == 2 else image.shape[2]
    rgb = image.reshape(h, w, c) if c == 1 else np.dstack([image[..., 2::-1], image[..., 3:]])
    values = rgb.astype(np.uint16) * 257 if depth == 16 else rgb
    if predictor == 2:
        values = np.diff(values.astype(np.int64), axis=1, prepend=0).astype(values.dtype)
    half = -(-h // 2)
    strips = [values[:half], values[half:]] if h > 1 else [values]
    raw = [np.ascontiguousarray(x.astype(order + ("u2" if depth == 16 else "u1"))).tobytes() for x in strips]
    if packing == 8:
        raw = [zlib.compress(x) for x in raw]
    elif packing == 32773:
        raw = [b"".join(bytes([len(x[i : i + 100]) - 1]) + x[i : i + 100] for i in range(0, len(x), 100)) + b"\x80" for x in raw]
    elif packing == 5:
        packed = []
        for x in raw:  # a clear code before the table grows past nine bits
            codes = []
            for i, byte in enumerate(x):
                codes += ([256] if i % 200 == 0 else []) + [byte]
            bits = "".join(f"{v:09b}" for v in [*codes, 257])
            bits += "0" * (-len(bits) % 8)
            packed.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
        raw = packed
    offsets, at = [], 8
    for x in raw:
        offsets.append(at)
        at += len(x)
    extra = b""

    def field(tag, kind, numbers):
        nonlocal extra
        body = struct.pack(f"{order}{len(numbers)}{ {3: 'H', 4: 'I'}[kind] }", *numbers)
        if len(body) > 4:
            where, extra = at + len(extra), extra + body
            body = struct.pack(order + "I", where)
        return struct.pack(order + "HHI", tag, kind, len(numbers)) + body.ljust(4, b"\0")

    fields = [field(256, 4, [w]), field(257, 4, [h]), field(258, 3, [depth] * c), field(259, 3, [packing]), field(262, 3, [1 if c == 1 else 2]), field(273, 4, offsets), field(277, 3, [c]), field(278, 4, [half]), field(279, 4, [len(x) for x in raw]), field(317, 3, [predictor])]
    directory = struct.pack(order + "H", len(fields)) + b"".join(fields) + b"\0\0\0\0"
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at + len(extra)) + b"".join(raw) + extra + directory


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("c", [1, 3, 4])
@pytest.mark.parametrize("depth, predictor", [(8, 1), (8, 2), (16, 1), (16, 2)])
def test_tiff_files(packing, order, c, depth, predictor):
    image = picture(5, 13, c)
    assert (images.decoded_tiff(made_tiff(image, packing, depth, order, predictor)) == image).all()


def test_tiff_lzw_with_a_growing_table():
    """Codes by the rule of the format, from an encoder of our own."""
    data = bytes(RNG.integers(0, 4, 6000, dtype=np.uint8))
    table, codes, here = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    size, width = 258, 9
    for b in data:
        longer = here + bytes([b])
        if longer in table:
            here = longer
            continue
        codes.append((table[here], width))
        table[longer], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        here = bytes([b])
        if size == 4094:
            codes.append((table[here], width))
            codes.append((256, width))
            table, size, width, here = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if here:
        codes.append((table[here], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits = "".join(f"{v:0{n}b}" for v, n in [*codes, (257, width)])
    bits += "0" * (-len(bits) % 8)
    assert images._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == data


def test_broken_tiff():
    for data in (b"", b"II*\0", b"II*\0\xff\0\0\0", made_tiff(picture(3, 3))[:20]):
        with pytest.raises((ValueError, KeyError, IndexError, images.struct.error)):
            images.decoded_tiff(data)


def test_sizes():
    from framefold.config import image_megabytes

    assert image_megabytes(1024, 1024, 4) == 6.0


def test_correlation_gives_up_in_time():
    image = scene()
    moved = kernels.warped(image, np.array([[1, 0, 1.5], [0, 1, -0.75]]), taps=kernels.linear_taps)
    assert np.isnan(estimation.ecc(image, moved, "affine", 10**6, 0.0, seconds=0.0)[1])


def test_aligning_by_correlation(spark):
    """Frames that were shifted come back to the first one's places, either way."""
    from framefold.config import Settings
    from framefold.plans import align

    base = np.clip(scene(120, 120) + np.kron(RNG.normal(0, 25, (30, 30)), np.ones((4, 4))), 0, 255)
    shifts = [(0, 0), (2, -1), (-3, 2)]
    rows = [("s", i, 90, 90, 1, kernels.to_bytes(base[15 + dy : 105 + dy, 15 + dx : 105 + dx]).tobytes()) for i, (dx, dy) in enumerate(shifts)]
    frames = spark.createDataFrame(rows, "stack string, img long, h int, w int, c int, data binary")
    settings = Settings(motion="translation", use_clahe=False, ecc_iterations=3000, ecc_blur=5, sharpness_threshold=10)
    found = {r.img: r for r in align.ecc_transforms(frames, settings).collect()}
    assert found[0].way == "reference" and found[1].way == found[2].way == "correlation"
    assert all(abs(found[i].m02 + dx) < 0.1 and abs(found[i].m12 + dy) < 0.1 for i, (dx, dy) in enumerate(shifts))
    for r in align.align(frames, settings, way="ecc").collect():
        image = np.frombuffer(r.data, np.uint8).reshape(90, 90, 4)
        inside = image[10:-10, 10:-10]
        assert np.abs(inside[..., 0].astype(int) - kernels.to_bytes(base[25:95, 25:95])).mean() < 3 and (inside[..., 3] == 255).all()
    with pytest.raises(ValueError):
        align.places(frames, settings, way="guess")


def test_folder_of_all_kinds(spark, tmp_path):
    from framefold.plans import series

    image = picture(6, 8, 3)
    (tmp_path / "a.png").write_bytes(images.encoded(image))
    (tmp_path / "b.tif").write_bytes(made_tiff(image, 8))
    (tmp_path / "c.tif").write_bytes(b"broken")
    (tmp_path / ".thumbnails").mkdir()
    frames = series.frames_of(spark, str(tmp_path)).orderBy("img").collect()
    assert [(r.img, r.path.rsplit("/", 1)[1]) for r in frames] == [(1, "a.png"), (2, "b.tif")] and all(r.data == image.tobytes() for r in frames)
    small = series.resized(series.frames_of(spark, str(tmp_path)), str(tmp_path), 3, 4).collect()
    assert {(r.h, r.w, r.c) for r in small} == {(3, 4, 3)} and len(small) == 2
    assert series.clear_cache(spark, str(tmp_path)) and not series.clear_cache(spark, str(tmp_path))
