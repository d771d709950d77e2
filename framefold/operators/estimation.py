"""Estimating transforms between frames: features, robust fits, and correlation maximisation.  (A19-A23, A25)

Each pair of frames is its own group with a bounded number of points or pixels, so groups run in parallel and
none grows with the collection.  Random choices are seeded by the pair, so results repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import monotonic
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.operators import matching, scales
from framefold.operators.kernels import STRIP, area_resized, equalised, filtered, gaussian, grey, single, unpacked

MODELS = {"similarity": 2, "affine": 3, "homography": 4}
MOTIONS = {"translation": 2, "euclidean": 3, "affine": 6, "homography": 8}


def solved(model: str, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray | None:
    """The (weighted) least squares transform (3 by 3) that takes points a to b, or None if they don't decide one."""
    n = len(a)
    if model == "similarity":  # as complex numbers v = c z + t, in closed form
        z, v = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
        share = np.full(n, 1 / n) if weight is None else weight / weight.sum()
        middle, to = share @ z, share @ v
        spread = share @ np.abs(z - middle) ** 2
        if not spread > 1e-18 * (1 + abs(middle) ** 2):
            return None
        c = (share * (z - middle).conj()) @ (v - to) / spread
        t = to - c * middle
        return np.array([[c.real, -c.imag, t.real], [c.imag, c.real, t.imag], [0, 0, 1.0]])
    x, y, one, zero = a[:, 0], a[:, 1], np.ones(n), np.zeros(n)
    if model == "homography":
        u, v = b[:, 0], b[:, 1]
        rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 1)])
    else:
        rows = np.concatenate([np.stack([x, y, one, zero, zero, zero], 1), np.stack([zero, zero, zero, x, y, one], 1)])
    told = np.concatenate([b[:, 0], b[:, 1]])
    if weight is not None:
        each = np.sqrt(np.concatenate([weight, weight]))
        rows, told = rows * each[:, None], told * each
    found, _, rank, _ = np.linalg.lstsq(rows, told, rcond=None)
    if rank < rows.shape[1]:
        return None
    if model == "homography":
        return np.append(found, 1).reshape(3, 3)
    return np.vstack([found.reshape(2, 3), [0, 0, 1]])


def moved(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.c_[points, np.ones(len(points))] @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return out[:, :2] / out[:, 2:]


def _best_similarity(a: np.ndarray, b: np.ndarray, threshold: float, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray | None, np.ndarray]:
    """The similarity through two points with the most points near, over all pairs of points, or `rounds` random ones
    where there are more; as complex numbers w = c z + t, many pairs at a time.
    """
    z, w, n = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1], len(a)
    if n * (n - 1) // 2 <= rounds:
        i, j = np.triu_indices(n, 1)
    else:
        i = rng.integers(0, n, rounds)
        j = (i + rng.integers(1, n, rounds)) % n
    best, inside = None, np.zeros(n, bool)
    for k in range(0, len(i), 512):
        p, q = i[k : k + 512], j[k : k + 512]
        apart = z[q] != z[p]
        p, q = p[apart], q[apart]
        c = (w[q] - w[p]) / (z[q] - z[p])
        t = w[p] - c * z[p]
        near = np.abs(c[:, None] * z + t[:, None] - w) <= threshold
        counts = near.sum(axis=1)
        if len(counts) and counts.max() > inside.sum():
            at = int(counts.argmax())
            best, inside = np.array([[c[at].real, -c[at].imag, t[at].real], [c[at].imag, c[at].real, t[at].imag], [0, 0, 1.0]]), near[at]
    return best, inside


#: Trials of a robust fit that are solved at once.
TRIALS = 128


def _trials(model: str, a: np.ndarray, b: np.ndarray, pick: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The exact transform through each pick of points, with the points that it brings near; singular picks are left out."""
    p, q = a[pick], b[pick]
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    if model == "homography":
        system = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 2), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 2)], 1)
    else:
        system = np.concatenate([np.stack([x, y, one, zero, zero, zero], 2), np.stack([zero, zero, zero, x, y, one], 2)], 1)
    # Rows are brought to one scale, so that the determinant tells what is singular.
    scale = np.abs(system).max(axis=2, keepdims=True)
    ok = np.abs(np.linalg.det(system / scale)) > 1e-12
    if not ok.any():
        return
    told = np.concatenate([u, v], 1)[ok]
    found = np.linalg.solve(system[ok], told[..., None])[..., 0]
    full = np.concatenate([found, np.tile([1.0] if model == "homography" else [0.0, 0.0, 1.0], (len(found), 1))], 1).reshape(-1, 3, 3)
    out = np.c_[a, np.ones(len(a))] @ full.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.linalg.norm(out[..., :2] / out[..., 2:] - b, axis=2)
    near = np.nan_to_num(far, nan=np.inf) <= threshold
    for k in np.argsort(-near.sum(axis=1), kind="stable")[:1]:
        yield full[k], near[k]


def ransac(model: str, a: np.ndarray, b: np.ndarray, threshold: float, rounds: int, confidence: float, seed: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The transform with the most points within `threshold`, refined on those; None below four points."""
    need, inside = MODELS[model], np.zeros(len(a), bool)
    if len(a) < 4:
        return None, inside
    rng, best, k, limit = np.random.default_rng(seed), None, 0, rounds
    if model == "similarity":
        best, inside = _best_similarity(a, b, threshold, rounds, rng)
    while k < limit and model != "similarity":
        # Some trials at a time: their places are drawn, solved and counted together.
        n = min(TRIALS, limit - k)
        k += n
        pick = rng.random((n, len(a))).argpartition(need - 1, axis=1)[:, :need]
        for m, near in _trials(model, a, b, pick, threshold):
            if near.sum() > inside.sum():
                best, inside = m, near
        share = min(max(inside.mean() ** need, 1e-12), 1 - 1e-12)
        limit = min(limit, max(k, int(np.ceil(np.log(1 - confidence) / np.log(1 - share))) + 1))
    for _ in range(10):
        refined = solved(model, a[inside], b[inside]) if inside.sum() >= need else None
        if refined is None:
            break
        near = np.nan_to_num(np.linalg.norm(moved(refined, a) - b, axis=1), nan=np.inf) <= threshold
        if near.sum() < inside.sum():
            break
        best, same, inside = refined, (near == inside).all(), near
        if same:
            break
    if best is None:
        return best, inside
    # Points of coarse scales are less exact than those of fine ones: the nearer a point is, the more it counts.
    for _ in range(10):
        away = np.linalg.norm(moved(best, a[inside]) - b[inside], axis=1)
        usual = np.median(away)
        refined = solved(model, a[inside], b[inside], 1 / (1 + (away / usual) ** 2)) if usual > 1e-9 else None
        if refined is None:
            break
        best, settled = refined, np.abs(refined - best).max() < 1e-6
        if settled:
            break
    return best, inside


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The scalar product of each row of a with the same row of b."""
    return np.matmul(a[:, None, :], b[:, :, None])[:, 0, 0]


def _solved_each(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """solved("similarity") of each of many sets (sets, points, 2), to the last bit, and whether its points decide it."""
    z, v = a[..., 0] + 1j * a[..., 1], b[..., 0] + 1j * b[..., 1]
    share = np.full(z.shape, 1 / z.shape[1]) if weight is None else weight / weight.sum(axis=1, keepdims=True)
    middle, to = _dots(share, z), _dots(share, v)
    spread = _dots(share, np.abs(z - middle[:, None]) ** 2)
    ok = spread > 1e-18 * (1 + np.abs(middle) ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = _dots(share * (z - middle[:, None]).conj(), v - to[:, None]) / spread
        out = np.zeros((len(a), 3, 3))
        out[:, 0, 0] = out[:, 1, 1] = c.real
        out[:, 0, 1], out[:, 1, 0] = -c.imag, c.imag
        # In parts, as products of complex arrays are rounded otherwise than those of single numbers.
        out[:, 0, 2] = to.real - (c.real * middle.real - c.imag * middle.imag)
        out[:, 1, 2] = to.imag - (c.real * middle.imag + c.imag * middle.real)
        out[:, 2, 2] = 1.0
    return out, ok


def _away(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far each transform takes the points of its set in a from those in b."""
    out = np.concatenate([a, np.ones((*a.shape[:2], 1))], 2) @ m.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.linalg.norm(out[..., :2] / out[..., 2:] - b, axis=2)


def _alike(counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each count with the places that have it."""
    order = np.argsort(counts, kind="stable")
    first = np.flatnonzero(np.diff(counts[order], prepend=-1))
    return ((int(counts[part[0]]), part) for part in np.split(order, first[1:]) if len(part))


#: What similarities are tried on at once: pairs of points, by points, by sets; and the most of one set for that.
TRIED, SMALL = 1 << 18, 1 << 14


def similarities(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ransac("similarity") of many sets of equally many points (sets, points, 2), with the same results: (whether one is
    found, transforms, points within the threshold).  Each set has all its pairs of points tried.

    Sets that have equally many points left are solved together.
    """
    sets, n = a.shape[:2]
    found, best, inside = np.zeros(sets, bool), np.tile(np.eye(3), (sets, 1, 1)), np.zeros((sets, n), bool)
    if n < 4:
        return found, best, inside
    i, j = np.triu_indices(n, 1)
    step = max(1, TRIED // (len(i) * n))
    for k in range(0, sets, step):
        z, w = (v[k : k + step, :, 0] + 1j * v[k : k + step, :, 1] for v in (a, b))
        with np.errstate(all="ignore"):
            c = (w[:, j] - w[:, i]) / (z[:, j] - z[:, i])
            t = w[:, i] - c * z[:, i]
            near = np.abs(c[..., None] * z[:, None, :] + t[..., None] - w[:, None, :]) <= threshold
        counts = np.where(z[:, j] != z[:, i], near.sum(axis=2), 0)
        every, at = np.arange(len(z)), counts.argmax(axis=1)
        some = counts[every, at] > 0
        c, t = c[every, at], t[every, at]
        m = np.stack([c.real, -c.imag, t.real, c.imag, c.real, t.imag, *np.broadcast_to([[0.0], [0.0], [1.0]], (3, len(c)))], 1).reshape(-1, 3, 3)
        found[k : k + step], inside[k : k + step] = some, near[every, at] & some[:, None]
        best[k : k + step][some] = m[some]

    def of(sets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(v[sets][inside[sets]].reshape(len(sets), count, 2) for v in (a, b))

    open_ = np.flatnonzero(found)
    for _ in range(10):
        left = []
        for count, part in _alike(inside[open_].sum(axis=1)):
            part = open_[part]
            if count < MODELS["similarity"]:
                continue
            refined, ok = _solved_each(*of(part, count))
            near = np.nan_to_num(_away(refined, a[part], b[part]), nan=np.inf) <= threshold
            ok &= near.sum(axis=1) >= count
            part, refined, near = part[ok], refined[ok], near[ok]
            best[part], same = refined, (near == inside[part]).all(axis=1)
            inside[part] = near
            left.append(part[~same])
        open_ = np.concatenate([*left, np.zeros(0, np.intp)])
        if not len(open_):
            break
    held = np.flatnonzero(found)
    for count, part in _alike(inside[held].sum(axis=1)):
        part = held[part]
        p, q = of(part, count)
        for _ in range(10):
            away = _away(best[part], p, q)
            usual = np.median(away, axis=1)
            some = usual > 1e-9
            part, p, q, away, usual = (v[some] for v in (part, p, q, away, usual))
            if not len(part):
                break
            refined, ok = _solved_each(p, q, 1 / (1 + (away / usual[:, None]) ** 2))
            part, p, q, refined = (v[ok] for v in (part, p, q, refined))
            moving = ~(np.abs(refined - best[part]).max(axis=(1, 2)) < 1e-6)
            best[part] = refined
            part, p, q = part[moving], p[moving], q[moving]
            if not len(part):
                break
    return found, best, inside


def fits(values: np.ndarray, ends: np.ndarray, model: str, threshold: float, rounds: int, confidence: float, seed: Callable[[int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, inliers, transforms) of each set of matched points: rows (qx, qy, tx, ty) that are up to `ends`.

    Similarities of sets with equally many points, few enough that all pairs of points are tried, are fitted together.
    """
    counts = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(counts)), counts)
    values = values[np.lexsort((*values[:, 2:].T, *values[:, :2].T, owner))]  # the shuffle's order must not matter
    found, inliers, ms = np.zeros(len(counts), bool), np.zeros(len(counts), np.int64), np.tile(np.eye(3), (len(counts), 1, 1))
    for n, part in _alike(counts):
        pairs = n * (n - 1) // 2
        if n < 4:
            continue
        if model == "similarity" and pairs <= rounds and pairs * n <= SMALL:
            own = values[(ends[part] - n)[:, None] + np.arange(n)]
            found[part], ms[part], inside = similarities(own[..., :2], own[..., 2:], threshold)
            inliers[part] = inside.sum(axis=1)
            continue
        for k in part.tolist():
            own = values[ends[k] - n : ends[k]]
            m, inside = ransac(model, own[:, :2], own[:, 2:], threshold, rounds, confidence, seed(k))
            inliers[k] = inside.sum()
            if m is not None:
                found[k], ms[k] = True, m
    return found, inliers, ms


def fitted(points: DataFrame, key: list[str], model: str = "similarity", threshold: float = 1.5, rounds: int = 5000, confidence: float = 0.995) -> DataFrame:
    """(key..., found, inliers, m00 .. m12) from matched points (key..., qx, qy, tx, ty), from query to train."""
    names = ["m00", "m01", "m02", "m10", "m11", "m12"]
    kinds = points.select(*key).schema
    points_of = ["qx", "qy", "tx", "ty"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = batch.column("points").offsets.to_numpy(), batch.column("points").flatten()
            values = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in points_of], 1).astype(float)
            seed = lambda k: crc32(repr([batch.column(c)[k].as_py() for c in key]).encode())  # noqa: B023, E731
            found, inliers, ms = fits(values, offsets[1:] - offsets[0], model, threshold, rounds, confidence, seed)
            columns = ms[:, :2].reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(found, pa.bool_()), pa.array(inliers, pa.int64()), *[pa.array(c) for c in columns]], names=[*key, "found", "inliers", *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields) + ", found boolean, inliers long, " + ", ".join(f"{n} double" for n in names)
    # The matches of a pair are bounded by its keypoints, so a pair is a row, and many pairs come to a worker at a time.
    pairs = points.groupBy(*key).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in points_of])).alias("points"))
    return pairs.mapInArrow(run, schema)


def _warps(motion: str, p: np.ndarray) -> np.ndarray:
    """The transforms (3 by 3) of rows of parameters."""
    m = np.tile(np.eye(3), (len(p), 1, 1))
    if motion == "translation":
        m[:, :2, 2] = p
    elif motion == "euclidean":
        c, s = np.cos(p[:, 0]), np.sin(p[:, 0])
        m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1], m[:, :2, 2] = c, -s, s, c, p[:, 1:]
    else:
        m[:, 0, 0], m[:, 0, 1:], m[:, 1, 0], m[:, 1, 1], m[:, 1, 2] = 1 + p[:, 0], p[:, 1:3], p[:, 3], 1 + p[:, 4], p[:, 5]
        if motion == "homography":
            m[:, 2, :2] = p[:, 6:]
    return m


def _jacobians(motion: str, p: np.ndarray, gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the warped images (rows of pixels) by their parameters, in the last axis."""
    if motion == "translation":
        return np.stack([gx, gy], 2)
    if motion == "euclidean":
        c, s = np.cos(p[:, :1]), np.sin(p[:, :1])
        return np.stack([gx * (-s * x - c * y) + gy * (c * x - s * y), gx, gy], 2)
    if motion == "affine":
        return np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy], 2)
    m = _warps(motion, p)[..., None]
    z = m[:, 2, 0] * x + m[:, 2, 1] * y + 1
    u, v = (m[:, 0, 0] * x + m[:, 0, 1] * y + m[:, 0, 2]) / z, (m[:, 1, 0] * x + m[:, 1, 1] * y + m[:, 1, 2]) / z
    gx, gy = gx / z, gy / z
    return np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy, -(gx * u + gy * v) * x, -(gx * u + gy * v) * y], 2)


def _between(images: list[np.ndarray], of: np.ndarray, v: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
    """Each array (images, h, w), with its last line and column twice, at places (v, u) from 0 of image `of`, bilinear; in
    strips.
    """
    _, h, w = images[0].shape
    out = [np.empty(len(v)) for _ in images]
    for k in range(0, len(v), STRIP):
        part = slice(k, k + STRIP)
        y, x = np.floor(v[part]), np.floor(u[part])
        ty, tx = v[part] - y, u[part] - x
        base = (of[part] * h + np.minimum(y, h - 2).astype(np.intp)) * w + np.minimum(x, w - 2).astype(np.intp)
        for image, to in zip(images, out):
            flat = image.reshape(-1)
            upper, lower = ((0.0 + flat.take(row) * (1 - tx)) + flat.take(row + 1) * tx for row in (base, base + w))
            to[part] = (0.0 + upper * (1 - ty)) + lower * ty
    return out


def _solutions(systems: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The solution of each system, and whether there is one."""
    try:
        return np.linalg.solve(systems, told[..., None])[..., 0], np.ones(len(systems), bool)
    except np.linalg.LinAlgError:
        out, ok = np.zeros(told.shape), np.ones(len(systems), bool)
        for k, (system, t) in enumerate(zip(systems, told)):
            try:
                out[k] = np.linalg.solve(system, t)
            except np.linalg.LinAlgError:
                ok[k] = False
        return out, ok


def ecc(reference: np.ndarray, image: np.ndarray, motion: str = "translation", rounds: int = 100, epsilon: float = 1e-6, blur: int = 5, start: np.ndarray | None = None, seconds: float | None = None) -> tuple[np.ndarray, float]:
    """The warp from reference places to image places that maximises the enhanced correlation coefficient
    (Evangelidis and Psarakis, 2008, forward additive), and the coefficient.  NaN where it doesn't converge, or not in
    so many seconds.
    """
    ms, rhos = ecc_each(reference[None], image[None], motion, rounds, epsilon, blur, None if start is None else start[None], seconds)
    return ms[0], float(rhos[0])


def ecc_each(references: np.ndarray, images: np.ndarray, motion: str = "translation", rounds: int | np.ndarray = 100, epsilon: float = 1e-6, blur: int = 5, starts: np.ndarray | None = None, seconds: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ecc() of many pairs of one size (pairs, h, w), each with its own rounds and start: (warps, coefficients).

    Pairs go round by round together until each is done.  Those that see equally many pixels are solved together, so a
    pair's result doesn't depend on the others, to the last bit.  Of the time each has its share.
    """
    then, spent = monotonic(), 0.0
    n, h, w = references.shape
    rows = lambda stack: np.ascontiguousarray(np.moveaxis(stack, 2, 0))
    wide = lambda stack: np.pad(rows(stack), ((0, 0), (0, 1), (0, 1)), mode="edge")
    ref, img = (gaussian(np.moveaxis(i, 0, 2).astype(float), 0, blur) for i in (references, images))
    yy, xx = (v.ravel() for v in np.mgrid[:h, :w].astype(float))
    half = np.array([-0.5, 0, 0.5]), np.array([0, 1.0, 0])
    seen = [wide(v) for v in (img, filtered(img, half[1], half[0]), filtered(img, half[0], half[1]))]
    ref = rows(ref).reshape(n, -1)
    p = np.zeros((n, MOTIONS[motion])) if starts is None else starts.astype(float)
    rounds = np.broadcast_to(rounds, n)
    rho, last, going = np.full(n, np.nan), np.full(n, -1.0), np.arange(n)
    for k in range(int(rounds.max(initial=0))):
        if seconds is not None:
            now = monotonic()
            then, spent = now, spent + (now - then) / max(1, len(going))
        going = going[rounds[going] > k]
        if seconds is not None and spent > seconds:
            rho[going] = np.nan
            break
        if not len(going):
            break
        m = _warps(motion, p[going])[..., None]
        with np.errstate(all="ignore"):
            z = m[:, 2, 0] * xx + m[:, 2, 1] * yy + 1
            u, v = (m[:, 0, 0] * xx + m[:, 0, 1] * yy + m[:, 0, 2]) / z, (m[:, 1, 0] * xx + m[:, 1, 1] * yy + m[:, 1, 2]) / z
        ok = (u >= 0) & (u <= w - 1) & (v >= 0) & (v <= h - 1)
        counts = ok.sum(axis=1)
        enough = counts > p.shape[1]
        if not enough.all():
            rho[going[~enough]] = np.nan
            going, counts, ok, u, v = (c[enough] for c in (going, counts, ok, u, v))
        of, at = np.nonzero(ok)
        pixels = [*_between(seen, going[of], v[ok], u[ok]), ref[going[of], at], xx[at], yy[at]]
        first = np.cumsum(counts) - counts
        left = []
        for count, part in _alike(counts):
            pick = slice(None) if len(part) == len(going) else (first[part][:, None] + np.arange(count)).ravel()
            left.append(_stepped(motion, going[part], *[c[pick].reshape(-1, count) for c in pixels], p, rho, last, epsilon))
        going = np.sort(np.concatenate([*left, np.zeros(0, np.intp)]))
    return _warps(motion, p), rho


def _stepped(motion: str, going: np.ndarray, i: np.ndarray, gx: np.ndarray, gy: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, rho: np.ndarray, last: np.ndarray, epsilon: float) -> np.ndarray:
    """One round of the pairs `going`, of which equally many pixels are seen: their p, rho and last are set; those that
    go on are returned.
    """
    i, r = i - i.mean(axis=1, keepdims=True), r - r.mean(axis=1, keepdims=True)
    size = np.sqrt(_dots(i, i) * _dots(r, r))
    with np.errstate(all="ignore"):
        rho[going] = np.where(size == 0, np.nan, _dots(i, r) / size)
    on = ~((size == 0) | (np.abs(rho[going] - last[going]) < epsilon))
    going, i, gx, gy, r, x, y = (c[on] for c in (going, i, gx, gy, r, x, y))
    last[going] = rho[going]
    g = _jacobians(motion, p[going], gx, gy, x, y)
    across = g.transpose(0, 2, 1)
    by = lambda c: (across @ c[..., None])[..., 0]
    hessian, gi, gr = across @ g, by(i), by(r)
    solution, ok = _solutions(hessian, gi)
    bottom, top = _dots(r, i) - _dots(gr, solution), _dots(i, i) - _dots(gi, solution)
    ok &= ~(bottom <= 0)
    rho[going[~ok]] = np.nan
    going, i, r, hessian, across, bottom, top = (c[ok] for c in (going, i, r, hessian, across, bottom, top))
    p[going] += _solutions(hessian, by((top / bottom)[:, None] * r - i))[0]
    return going


def _of_one_size(images: list[np.ndarray]) -> list[list[int]]:
    """The places of images of the same shape."""
    sizes: dict[tuple[int, ...], list[int]] = {}
    for k, image in enumerate(images):
        sizes.setdefault(image.shape, []).append(k)
    return list(sizes.values())


def aligned(pairs: DataFrame, key: list[str], motion: str = "translation") -> DataFrame:
    """(key..., rho, m00 .. m12) of rows (key..., h, w, c, data, ref): each raster against its reference."""
    names = ["m00", "m01", "m02", "m10", "m11", "m12"]
    kinds = pairs.select(*key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in single(batches):
            rows = batch.to_pylist()
            images, refs = ([grey(unpacked(r[c], r["h"], r["w"], r["c"]).astype(float)) for r in rows] for c in ("data", "ref"))
            out: list[dict] = [{}] * len(rows)
            for same in _of_one_size(images):
                ms, rhos = ecc_each(np.stack([refs[k] for k in same]), np.stack([images[k] for k in same]), motion, blur=3)
                for k, m, rho in zip(same, ms, rhos):
                    out[k] = {c: rows[k][c] for c in key} | {"rho": float(rho)} | dict(zip(names, m[:2].ravel().tolist(), strict=True))
            fields = [batch.schema.field(k) for k in key] + [pa.field(n, pa.float64()) for n in ("rho", *names)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields) + ", rho double, " + ", ".join(f"{n} double" for n in names)
    return pairs.mapInArrow(run, schema)


#: Keypoints of a raster that the ladder matches at most, and pixels of references that a worker remembers.
MATCHED, HELD = 500, 1 << 20
#: The keypoints of a reference by detector, so that they are found once for all its frames.
Known = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def fallbacks(ref: np.ndarray, image: np.ndarray, motion: str, rounds: int, epsilon: float, limits: tuple[float, float, float], most: int = MATCHED, blur: int = 3, seconds: float | None = None) -> Iterator[tuple[str, np.ndarray | None]]:
    """Candidates in order: correlation from a start that SIFT gives, corners alone, the identity.

    Each is None where it isn't found or isn't valid (limits: scale, shift, determinant), and is looked for when it is
    asked for.  With a start, the correlation gets half of the rounds; one that isn't done in so many seconds counts as
    not found.
    """
    known: Known = {}
    fine = _correlations([ref], [image], [known], motion, rounds, epsilon, most, blur, seconds)[0]
    return _candidates(ref, image, known, fine, motion, limits, most)


def _candidates(ref: np.ndarray, image: np.ndarray, known: Known, fine: np.ndarray | None, motion: str, limits: tuple[float, float, float], most: int) -> Iterator[tuple[str, np.ndarray | None]]:
    ok = lambda m: m if m is not None and np.isfinite(m).all() and _valid(m, *limits) else None
    yield "correlation", ok(fine)
    yield "features", ok(by_features(ref, image, "orb", motion, most, known))
    yield "identity", np.eye(3)


def _correlations(refs: list[np.ndarray], images: list[np.ndarray], known: list[Known], motion: str, rounds: int, epsilon: float, most: int, blur: int, seconds: float | None) -> list[np.ndarray | None]:
    """The correlation of each pair of rasters, all of one size, from the start that SIFT gives; None where it fails."""
    rough = [by_features(*pair, "sift", motion, most, k) for *pair, k in zip(refs, images, known)]
    starts = np.array([np.zeros(MOTIONS[motion]) if m is None else _parameters(motion, m) for m in rough])
    limits = np.array([rounds if m is None else rounds // 2 for m in rough])
    ms, rhos = ecc_each(np.stack(refs), np.stack(images), motion, limits, epsilon, blur, starts, seconds)
    return [m if np.isfinite(rho) else None for m, rho in zip(ms, rhos)]


def by_features(ref: np.ndarray, image: np.ndarray, detector: str, motion: str, most: int, known: Known | None = None) -> np.ndarray | None:
    """The fit of the best 30 % of mutual matches, ten at least; None with fewer keypoints or matches."""
    known = {} if known is None else known
    if detector not in known:
        known[detector] = FINDERS[detector](ref, most)
    qa, _, qc = known[detector]
    if len(qa) < 10:
        return None
    ta, _, tc = FINDERS[detector](image, most)
    if len(ta) < 10:
        return None
    distance = matching.hamming(qc, tc) if detector in BINARY else matching.squared(qc, tc)
    near, back = distance.argmin(axis=1), distance.argmin(axis=0)
    mutual = np.flatnonzero(back[near] == np.arange(len(qa)))
    order = mutual[np.argsort(distance[mutual, near[mutual]], kind="stable")]
    order = order[: min(len(order), max(10, int(0.3 * len(order))))]
    if len(order) < 10:
        return None
    model = "homography" if motion == "homography" else "similarity"
    return ransac(model, qa[order].astype(float), ta[near[order]].astype(float), 3.0, 2000, 0.995, len(order))[0]


def _valid(m: np.ndarray, scale: float, shift: float, determinant: float) -> bool:
    sides = np.hypot(m[0, 0], m[1, 0]), np.hypot(m[0, 1], m[1, 1])
    det = abs(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0])
    return all(1 / scale <= s <= scale for s in sides) and np.hypot(m[0, 2], m[1, 2]) <= shift and 1 / determinant <= det <= determinant


def _parameters(motion: str, m: np.ndarray) -> np.ndarray:
    """The parameters of the motion that are nearest to a transform."""
    if motion == "translation":
        return m[:2, 2].copy()
    if motion == "euclidean":
        return np.array([np.arctan2(m[1, 0] - m[0, 1], m[0, 0] + m[1, 1]), m[0, 2], m[1, 2]])
    flat = (m / m[2, 2] - np.eye(3)).ravel()
    return flat[:6] if motion == "affine" else flat[:8]


def registered(pairs: DataFrame, key: list[str], motion: str = "euclidean", rounds: int = 200, epsilon: float = 1e-6, limits: tuple[float, float, float] = (1.5, 500.0, 2.5), blur: int = 3, seconds: float | None = None, clahe: bool = False, scale: float = 1.0) -> DataFrame:
    """(key..., way, m00 .. m12) of rows (key..., h, w, c, data, ref): the first way of the ladder that is valid.

    With clahe the contrast of both is equalised first, and both are made smaller by scale; the transform is that of the
    whole size.
    """
    names = ["m00", "m01", "m02", "m10", "m11", "m12"]
    kinds = pairs.select(*key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[np.ndarray, Known]] = {}
        held = 0
        for batch in single(batches):
            rows = batch.to_pylist()
            images, refs, found = [], [], []
            for r in rows:
                images.append(prepared(unpacked(r["data"], r["h"], r["w"], r["c"]), clahe, scale))
                of = r["ref"], r["h"], r["w"], r["c"]
                if of not in known:
                    if held > HELD:
                        known.clear()
                        held = 0
                    known[of] = prepared(unpacked(*of), clahe, scale), {}
                    held += known[of][0].size
                refs.append(known[of][0])
                found.append(known[of][1])
            inner = (limits[0], limits[1] * scale, limits[2])
            out: list[dict] = [{}] * len(rows)
            for same in _of_one_size(images):
                fine = _correlations(*([v[k] for k in same] for v in (refs, images, found)), motion, rounds, epsilon, MATCHED, blur, seconds)
                for k, f in zip(same, fine):
                    r, image = rows[k], images[k]
                    way, m = next((w, m) for w, m in _candidates(refs[k], image, found[k], f, motion, inner, MATCHED) if m is not None)
                    if scale != 1.0:
                        whole = np.diag([image.shape[1] / r["w"], image.shape[0] / r["h"], 1.0])
                        m = np.linalg.inv(whole) @ m @ whole
                        m = m / m[2, 2]
                    out[k] = {c: r[c] for c in key} | {"way": way} | dict(zip(names, m[:2].ravel().tolist(), strict=True))
            fields = [batch.schema.field(k) for k in key] + [pa.field("way", pa.string())] + [pa.field(n, pa.float64()) for n in names]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields) + ", way string, " + ", ".join(f"{n} double" for n in names)
    return pairs.mapInArrow(run, schema)


def prepared(image: np.ndarray, clahe: bool = False, scale: float = 1.0) -> np.ndarray:
    """A raster in grey, its contrast equalised, made smaller by scale."""
    real = grey(image)
    if clahe:
        real = equalised(real)
    real = real.astype(float)
    return area_resized(real, max(1, round(real.shape[0] * scale)), max(1, round(real.shape[1] * scale))) if scale != 1.0 else real


#: Places, around a keypoint, that its descriptor compares: 256 pairs from a fixed seed, drawn near the middle.
_PLACES = np.clip(np.rint(np.random.default_rng(7).normal(0, 4, (256, 4))), -9, 9)

#: Scales in which corners are looked for: so many, each smaller by this, until a side is shorter than that.
LEVELS, SMALLER_BY, SHORTEST = 8, 1.2, 32

#: How far from a keypoint its orientation is taken, in pixels of its scale.
REACH = 15


def corners(image: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points (x, y), responses, descriptors of four 64-bit codes) of the strongest corners over all scales, by
    the Harris response and binary tests that are turned to each corner's orientation.
    """
    real = image.astype(float)
    h, w = real.shape
    found = []
    for k in range(LEVELS):
        sides = round(h / SMALLER_BY**k), round(w / SMALLER_BY**k)
        if k and min(sides) < SHORTEST:
            break
        points, response, codes = _corners_at(area_resized(real, *sides) if k else real, most)
        found.append(((points + 0.5) * (np.array([w, h]) / (sides[1], sides[0])) - 0.5, response, codes))
    points, response, codes = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((points[:, 0], points[:, 1], -response))[:most]
    return points[order], response[order], codes[order]


def _corners_at(real: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The corners of one scale."""
    d, s = np.array([-1, 0, 1.0]), np.array([1, 2, 1.0])
    gx, gy = filtered(real, s, d), filtered(real, d, s)
    a, b, c = (gaussian(v, 1.5) for v in (gx * gx, gy * gy, gx * gy))
    response = a * b - c * c - 0.04 * (a + b) ** 2
    h, w = real.shape
    near = np.max([np.pad(response, 1, constant_values=-np.inf)[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    y, x = np.nonzero((response >= near) & (response > 1e-6))  # less is rounding of flat areas
    order = np.lexsort((x, y, -response[y, x]))[:most]
    y, x = y[order], x[order]
    smooth = gaussian(real, 2.0)
    at = lambda dy, dx: smooth[np.clip(y[:, None] + dy, 0, h - 1), np.clip(x[:, None] + dx, 0, w - 1)]
    turn = _orientation(real, y, x)
    cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]
    first, second = ((np.rint(sin * _PLACES[:, k + 1] + cos * _PLACES[:, k]).astype(int), np.rint(cos * _PLACES[:, k + 1] - sin * _PLACES[:, k]).astype(int)) for k in (0, 2))
    bits = at(*first) < at(*second)
    codes = np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1, 4)
    return np.stack([x + _peak(response, y, x, 0, 1), y + _peak(response, y, x, 1, 0)], 1), response[y, x], codes


def _orientation(real: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The angle from each keypoint to the centre of brightness of the disc around it."""
    h, w = real.shape
    reach = min(REACH, min(h, w) // 2)
    dy, dx = (v.ravel() for v in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    inside = dy * dy + dx * dx <= reach * reach
    dy, dx = dy[inside], dx[inside]
    disc = real[np.clip(y[:, None] + dy, 0, h - 1), np.clip(x[:, None] + dx, 0, w - 1)]
    return np.arctan2(disc @ dy, disc @ dx)


def _peak(response: np.ndarray, y: np.ndarray, x: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """How far, half a pixel at most, the top of the parabola through a keypoint and its two neighbours is from it."""
    h, w = response.shape
    before, after = (response[np.clip(y + s * dy, 0, h - 1), np.clip(x + s * dx, 0, w - 1)] for s in (-1, 1))
    bend = before + after - 2 * response[y, x]
    return np.clip(np.divide(before - after, 2 * bend, out=np.zeros(len(y)), where=bend < 0), -0.5, 0.5)


#: What finds keypoints, by the settings' name; which of them have binary descriptors.
FINDERS = {"orb": corners, "sift": scales.sift, "akaze": scales.akaze}
BINARY = ("orb", "akaze")


def features(rasters: DataFrame, most: int = 5000, clahe: bool = False, scale: float = 1.0, detector: str = "orb") -> DataFrame:
    """(img, kp_id, x, y, response, desc): one row for each keypoint, its descriptor with it: 64-bit codes (orb, akaze)
    or numbers of 0 .. 255 (sift).

    With clahe and scale they are found in the prepared() raster; their places are those of the whole size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in single(batches):
            for r in batch.to_pylist():
                image = unpacked(r["data"], r["h"], r["w"], r["c"])
                small = prepared(image, clahe, scale) if clahe or scale != 1.0 else grey(image.astype(float))
                points, response, codes = FINDERS[detector](small, most)
                points = (points + 0.5) * np.array([image.shape[1] / small.shape[1], image.shape[0] / small.shape[0]]) - 0.5
                n = len(points)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["img"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(points[:, 0].astype(float)), pa.array(points[:, 1].astype(float)), pa.array(response), pa.array(codes.astype(np.int64).tolist(), pa.list_(pa.int64()))],
                    names=["img", "kp_id", "x", "y", "response", "desc"],
                )

    return rasters.mapInArrow(run, "img long, kp_id long, x double, y double, response double, desc array<long>")
