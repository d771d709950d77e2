"""Stencils on array rasters, as SQL expressions: neighbours are read by index, with the border reflected
without repeating the edge pixel.  (P10, P16-P18, J10)

A raster is an array column in row-major order beside its height h and width w.
"""

from __future__ import annotations

#: Separable kernels.
BLUR3 = (1, 2, 1)  # over 4
DERIVE3, SMOOTH3 = (-1, 0, 1), (1, 2, 1)
SMOOTH5, SECOND5 = (1, 4, 6, 4, 1), (1, 0, -2, 0, 1)
#: The 11 by 11 ellipse of the alpha erosion, as the reach to both sides in each row.
ELLIPSE11 = (0, 3, 4, 5, 5, 5, 5, 5, 4, 3, 0)


def outer(rows: tuple[int, ...], columns: tuple[int, ...]) -> list[list[int]]:
    return [[a * b for b in columns] for a in rows]


def added(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[x + y for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


LAPLACE5 = added(outer(SECOND5, SMOOTH5), outer(SMOOTH5, SECOND5))
SOBEL_X, SOBEL_Y = outer(SMOOTH3, DERIVE3), outer(DERIVE3, SMOOTH3)
GAUSS3 = outer(BLUR3, BLUR3)  # over 16


def _inside(at: str, n: str) -> str:
    """A coordinate reflected into 0 .. n - 1; a single row or column reflects onto itself."""
    return f"if({n} = 1, 0, abs({n} - 1 - abs({n} - 1 - ({at}))))"


def convolved(p: str, kernel: list[list[int]], h: str = "h", w: str = "w") -> str:
    """SQL: the raster of the kernel's sums around each pixel.  Kernels reach less far than the raster."""
    reach = len(kernel) // 2
    taps = [f"{k} * element_at({p}, int({_inside(f'i div {w} + {dy - reach}', h)} * {w} + {_inside(f'i % {w} + {dx - reach}', w)} + 1))" for dy, row in enumerate(kernel) for dx, k in enumerate(row) if k]
    return f"transform(sequence(0, int({h} * {w}) - 1), i -> {' + '.join(taps)})"


def grey(b: str, g: str, r: str) -> str:
    """SQL: luminance of 8-bit blue, green and red, rounded."""
    return f"int(floor(0.114D * {b} + 0.587D * {g} + 0.299D * {r} + 0.5D))"


def saturated(x: str) -> str:
    """SQL: a number rounded half to even and held in 0 .. 255."""
    return f"int(least(255, greatest(0, rint({x}))))"


def magnitude(x: str, y: str) -> str:
    """SQL: two 8-bit absolute values added with saturation; each saturates first."""
    return f"least(255, least(255, abs({x})) + least(255, abs({y})))"
