"""Path and size expressions for the image catalogue, as SQL.  (S6-S8, S14, P1-P5, P7, P8, P27, P28)"""

from __future__ import annotations

#: File extensions, in lower case.
STANDARD = ("jpg", "jpeg", "png", "tif", "tiff")
RAW = ("arw", "cr2", "cr3", "nef", "dng", "orf", "raf", "rw2", "pef", "srw", "3fr", "mef", "mrw", "x3f", "dcr", "kdc", "erf", "nrw", "raw", "sr2", "rwl")


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in names)


def extension(path: str) -> str:
    """In lower case; empty for names without a dot, or with one only at the start."""
    return f"lower(regexp_extract({path}, '[^/][.]([^./]*)$', 1))"


def is_standard(path: str) -> str:
    return f"{extension(path)} in ({_listed(STANDARD)})"


def is_raw(path: str) -> str:
    return f"{extension(path)} in ({_listed(RAW)})"


def filename(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def folder(path: str) -> str:
    return f"regexp_extract({path}, '^(.*/)?[^/]*$', 1)"


def stem(path: str) -> str:
    return f"regexp_replace({filename(path)}, '(?<=.)[.][^.]*$', '')"


def resize_target(spec: str, width: str) -> str:
    """Whole pixels, or a percentage of the width rounded half away from zero; null if it is neither or not above zero."""
    bare = f"trim({spec})"
    share = f"try_cast(trim(substr({bare}, 1, length({bare}) - 1)) as double)"
    found = f"case when {bare} like '%\\%' then cast(round({width} * {share} / 100) as bigint) when {bare} rlike '^[+-]?[0-9]+$' then try_cast({bare} as bigint) end"
    return f"case when ({found}) > 0 then ({found}) end"


def fitted(w: str, h: str, box_w: str, box_h: str, most: str | None = None) -> str:
    """The scale that fits w by h into a box, `most` at the most."""
    scale = f"least(double({box_w}) / {w}, double({box_h}) / {h})"
    return f"least({scale}, {most})" if most else scale


def batch_sizes(gigabytes: str, megabytes: str) -> dict[str, str]:
    """How many images a batch holds, by task, for the memory there is and the size of an image."""
    most = f"greatest(4, cast(floor({gigabytes} * 0.5D * 1024 / {megabytes}) as bigint))"
    return {
        "sharpness_batch": f"least(16, greatest(4, {most}))",
        "feature_batch": f"least(32, greatest(8, 2 * {most}))",
        "warp_batch": f"least(24, greatest(8, {most}))",
        "stack_batch": f"least(16, greatest(6, {most} div 2))",
    }


def feature_batch(detector: str, megapixels: str, batch: str) -> str:
    """Batches for feature extraction, smaller for heavy detectors and large images."""
    return f"case when {megapixels} > 30 then case {detector} when 'orb' then least(3, {batch}) when 'sift' then 3 else 2 end else case {detector} when 'orb' then {batch} else greatest({batch} div 4, 3) end end"
