"""The built-in methods: how each one changes a scan.

``apply(scan, pattern, **parameters)`` gives a new scan.  Methods on values stay column
expressions; methods on whole frames run in Arrow batches, one frame a group.  Formulas
of filters and reconstructions follow the published literature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tomoflow.functions.columns import finite_or_zero
from tomoflow.functions.numbers import reconstruction_padding
from tomoflow.methods import REQUIRED, Method, register
from tomoflow.operators import aggregate, centre, elementwise, frames, gridding, halo, neighbourhood, reorient
from tomoflow.sources.scan import Scan, lines_of, voxels


def around(function: Callable) -> Callable:
    """A filter of the cube around each pixel as a method on a scan."""

    def apply(scan: Scan, pattern: str, kernel_size: int = 3) -> Scan:
        return scan.with_lines(function(scan.lines, (kernel_size // 2,) * 3, scan.shape[2]))

    return apply


def on_frames(function: Callable, own_pattern: str | None = None) -> Callable:
    def apply(scan: Scan, pattern: str, **parameters) -> Scan:
        given = {k: v for k, v in parameters.items() if v is not None}
        return scan.with_lines(frames.each_frame(scan.lines, function, own_pattern or pattern, **given))

    return apply


def on_lines(function: Callable) -> Callable:
    """A method on lines as one on a scan."""

    def apply(scan: Scan, pattern: str, **parameters) -> Scan:
        return scan.with_lines(function(scan.lines, **parameters))

    return apply


def remove_outlier(scan: Scan, pattern: str, dif: float = 0.1, kernel_size: int = 3, axis: str = "det_x") -> Scan:
    """Data, darks and flats alike; each of them once.

    ``axis`` is that of a running median, or ``cube`` for the median of the cube of
    kernel_size^3 pixels (of each mean calibration frame: the square).
    """
    reach = kernel_size // 2
    if axis == "det_x":
        done = [halo.remove_outlier_lines(table, dif, reach) for table in (scan.lines, scan.darks, scan.flats)]
        return replace(scan, lines=done[0], darks=done[1], flats=done[2])
    width = scan.shape[2]
    if axis != "cube":
        around = tuple(reach if a == axis else 0 for a in halo.AXES)
        return scan.with_lines(neighbourhood.remove_outliers(scan.lines, dif, around, width))

    def square(table):
        frame = elementwise.mean_lines(table).withColumn("angle", F.lit(0))
        return neighbourhood.remove_outliers(frame, dif, (0, reach, reach), width).select("det_y", "line")

    done = neighbourhood.remove_outliers(scan.lines, dif, (reach, reach, reach), width)
    return replace(scan, lines=done, darks=square(scan.darks), flats=square(scan.flats))


def theta_of(scan: Scan) -> np.ndarray:
    """The angles as an array: as many numbers as the scan has projections."""
    rows = scan.angles.orderBy("angle").select("theta").toPandas()["theta"].to_numpy()
    return rows[: scan.shape[0]]


def data_reducer(scan: Scan, pattern: str) -> Scan:
    return replace(scan, darks=elementwise.mean_lines(scan.darks), flats=elementwise.mean_lines(scan.flats))


def normalize(scan: Scan, pattern: str, cutoff: float = 10.0, averaging: str = "mean", minus_log: bool = False, nonnegativity: bool = False, remove_nans: bool = False) -> Scan:
    lines = elementwise.clean_lines(scan.lines) if remove_nans else scan.lines
    pixels = scan.shape[1] * scan.shape[2]
    return scan.with_lines(elementwise.corrected_lines(lines, scan.darks, scan.flats, cutoff, minus_log, nonnegativity, averaging, pixels))


def data_checker(scan: Scan, pattern: str, infsnans_correct: bool = True, zeros_warning: bool = False, data_to_method_name: str = "") -> Scan:
    """Values that aren't finite become 0; ``zeros_warning`` counts zeros on the way (see ``run.warn_of_zeros``)."""
    if infsnans_correct:
        bad = F.exists("line", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        scan = scan.with_lines(scan.lines.withColumn("line", F.when(bad, F.transform("line", finite_or_zero)).otherwise(F.col("line"))))
    if zeros_warning:
        seen = Observation(f"zeros-{uuid.uuid4().hex}")
        zeros = F.sum(F.size(F.filter("line", lambda x: x == 0))).alias("zeros")
        scan = scan.with_lines(scan.lines.observe(seen, zeros, F.sum(F.size("line")).alias("n")))
        scan = scan.publish(**{f"zeros after {data_to_method_name or 'loading'}": seen})
    return scan


def calculate_stats(scan: Scan, pattern: str) -> Scan:
    """glob_stats: (min, max, mean, n); one action, as later steps take it as plain numbers."""
    row = elementwise.line_stats(scan.lines).first()
    return scan.publish(glob_stats=(row["min"], row["max"], row["mean"], row["n"]))


def rescale_to_int(scan: Scan, pattern: str, bits: int = 8, glob_stats=None, perc_range_min: float = 0.0, perc_range_max: float = 100.0) -> Scan:
    low = high = None
    if glob_stats is not None:
        span = glob_stats[1] - glob_stats[0]
        low, high = glob_stats[0] + span * perc_range_min / 100, glob_stats[0] + span * perc_range_max / 100
    return scan.with_lines(elementwise.rescaled_lines(scan.lines, bits, low, high))


def average_projection_frames(scan: Scan, pattern: str, projection_averaging_factor: int = 2) -> Scan:
    pixels = aggregate.averaged_frames(voxels(scan.lines), projection_averaging_factor)
    angles = aggregate.averaged_angles(scan.angles.where(F.col("angle") < scan.shape[0]), projection_averaging_factor)
    shape = (-(-scan.shape[0] // projection_averaging_factor), *scan.shape[1:])
    return replace(scan, lines=lines_of(pixels), angles=angles, shape=shape)


def sino_360_to_180(scan: Scan, pattern: str, overlap: float = 0, side: str = "left") -> Scan:
    half, width = scan.shape[0] // 2, scan.shape[2]
    lines = scan.lines.withColumn("line", F.reverse("line")) if side == "right" else scan.lines
    done = reorient.folded(lines, half, width, int(round(overlap)))
    angles = scan.angles.where(F.col("angle") < half)
    return replace(scan, lines=done, angles=angles, shape=(half, scan.shape[1], 2 * width - int(round(overlap)) if overlap else width))


def reconstruction(function: Callable) -> Callable:
    """Sinogram by sinogram; theta comes from the scan, edges are repeated on both sides."""

    def apply(scan: Scan, pattern: str, center: float | None = None, recon_size: int | None = None, detector_pad: bool | int = False, **parameters) -> Scan:
        theta, width = theta_of(scan), scan.shape[2]
        if len(theta) != scan.shape[0]:
            raise ValueError(f"{scan.shape[0]} projections, but {len(theta)} angles")
        pad = reconstruction_padding(width) if detector_pad is True else int(detector_pad)
        size = int(recon_size or width)

        def run(sinogram: np.ndarray) -> np.ndarray:
            wide = np.pad(sinogram, ((0, 0), (pad, pad)), mode="edge") if pad else sinogram
            given = dict(parameters)
            if center is not None:
                given["center"] = center + pad
            return function(wide, theta, recon_size=size, **given)

        made = frames.each_frame(scan.lines, run, "sinogram")
        return scan.with_lines(made, (size, scan.shape[1], size))

    return apply


def _fista(sinogram, theta, recon_size=None, center=None, iterations=15, regularisation=0.0):
    if center is not None:  # moved so that the axis is in the middle
        columns = np.arange(sinogram.shape[1])
        move = center - (sinogram.shape[1] - 1) / 2
        sinogram = np.stack([np.interp(columns + move, columns, row) for row in sinogram])
    return frames.fista(sinogram, theta, iterations, regularisation, recon_size)


def find_center_vo(scan: Scan, pattern: str, ind: int | None = None, average_radius: int = 0, smin: float = -50, smax: float = 50, srad: float = 6, step: float = 0.5, ratio: float = 0.5, drop: int = 20) -> Scan:
    sino = centre.sinogram(scan.lines, scan.shape[1], ind, average_radius)
    rough = centre.by_symmetry(sino, smin, smax, 1.0, drop, ratio)
    offset = rough - (sino.shape[1] - 1) / 2
    return scan.publish(cor=centre.by_symmetry(sino, offset - srad, offset + srad, step, drop, ratio))


def find_center_pc(scan: Scan, pattern: str) -> Scan:
    first, last = centre.projection(scan.lines, 0), centre.projection(scan.lines, scan.shape[0] - 1)
    return scan.publish(cor=centre.by_phase_correlation(first, last))


def find_center_360(scan: Scan, pattern: str, ind: int | None = None, win_width: int = 10) -> Scan:
    sino = centre.sinogram(scan.lines, scan.shape[1], ind)
    half = len(sino) // 2
    cor, overlap, side, place = centre.by_overlap(sino[:half], sino[half : 2 * half], win_width)
    return scan.publish(cor=cor, overlap=overlap, side=side, overlap_position=place)


def find_center(scan: Scan, pattern: str, ind: int | None = None, reach: float = 5.0, step: float = 0.5) -> Scan:
    sino = centre.sinogram(scan.lines, scan.shape[1], ind)
    middle = (sino.shape[1] - 1) / 2
    candidates = [middle + o for o in np.arange(-reach, reach + step / 2, step)]
    return scan.publish(cor=centre.best_sharpness(sino, theta_of(scan), candidates))


def distortion_correction(scan: Scan, pattern: str, xcenter=REQUIRED, ycenter=REQUIRED, list_fact=REQUIRED, shift_xy=None, step_xy=(1, 1)) -> Scan:
    """Coordinates are those of the whole detector: a preview's frames begin at its origin."""
    shift_xy = scan.origin if shift_xy is None else shift_xy
    made = frames.each_frame(
        scan.lines, frames.undistort, "projection", xcenter=xcenter, ycenter=ycenter, list_fact=list_fact, shift_xy=tuple(shift_xy), step_xy=tuple(step_xy)
    )
    return scan.with_lines(made)


def data_resampler(scan: Scan, pattern: str, newshape_factor: int = 2) -> Scan:
    n, y, x = scan.shape
    done = aggregate.binned(voxels(scan.lines), newshape_factor)
    return scan.with_lines(lines_of(done), (n, -(-y // newshape_factor), -(-x // newshape_factor)))


def seam_blend(scan: Scan, pattern: str, seam_index: int = 0, reach: int = 2, shift_seam_index: int | None = None) -> Scan:
    """The seam is a column of the whole detector."""
    shift = scan.origin[0] if shift_seam_index is None else shift_seam_index
    return scan.with_lines(reorient.seam_blended(scan.lines, seam_index - shift, reach))


def unchanged(scan: Scan, pattern: str, **parameters) -> Scan:
    """Sinks are run by the runner, which knows where to write."""
    return scan


#: What ``recon`` offers by name.
RECONSTRUCTIONS = {"fbp": frames.fbp, "gridrec": gridding.gridrec}


def register_all() -> None:
    def add(name: str, apply: Callable, pattern: str = "all", parameters: dict[str, Any] | None = None, reach: str | None = None, halo_reach: Callable[[dict], int] | None = None, **more) -> None:
        own = halo_reach or (lambda p: int(p[reach]) // 2 if reach else 0)
        halo_of = lambda p: (own(p), own(p))
        register(Method(name, pattern, apply, parameters=parameters or {}, halo=halo_of, **more))

    calibration = {"cutoff": 10.0, "averaging": "mean", "minus_log": False, "nonnegativity": False, "remove_nans": False}
    add("data_reducer", data_reducer)
    add("normalize", normalize, "projection", calibration)
    add("dark_flat_field_correction", normalize, "projection", calibration)
    add("minus_log", on_lines(elementwise.minus_log_lines), parameters={"floor": 1e-6})
    add("data_checker", data_checker, parameters={"infsnans_correct": True, "zeros_warning": False, "data_to_method_name": ""})
    add("calculate_stats", calculate_stats, publishes=("glob_stats",))
    add("rescale_to_int", rescale_to_int, parameters={"bits": 8, "glob_stats": None, "perc_range_min": 0.0, "perc_range_max": 100.0})
    add("remove_outlier", remove_outlier, "projection", {"dif": 0.1, "kernel_size": 3, "axis": "det_x"})
    add("remove_outlier3d", lambda scan, pattern, **p: remove_outlier(scan, pattern, axis="cube", **p), "projection", {"dif": 0.1, "kernel_size": 3}, "kernel_size")
    add("median_filter", on_frames(frames.median_2d), parameters={"size": 3})
    add("median_filter3d", around(neighbourhood.median_filter), "projection", {"kernel_size": 3}, "kernel_size")
    add("mean_filter3d", around(neighbourhood.mean_filter), "projection", {"kernel_size": 3}, "kernel_size")
    add("paganin_filter", on_frames(frames.paganin, "projection"), "projection", {"ratio_delta_beta": 250.0, "pixel_size": 1.28, "distance": 1.0, "energy": 53.0}, memory_factor=12.0)
    add("remove_stripe_fw", on_frames(frames.remove_stripe_fw, "sinogram"), "sinogram", {"level": 3, "sigma": 2.0, "wname": "haar", "pad": True}, memory_factor=4.0)
    add("remove_stripe_based_sorting", on_frames(frames.sort_stripes, "sinogram"), "sinogram", {"size": 3})
    add("remove_all_stripe", on_frames(frames.remove_all_stripe, "sinogram"), "sinogram", {"size": 5, "ratio": 3.0})
    mask = {"difference": 0.1, "columns": 2, "length": 10, "threshold": 0.7, "depth": 1, "least_rows": 2, "stripe_width": 2}
    add("stripes_mask3d", lambda scan, pattern, **p: scan.with_lines(neighbourhood.stripes_mask(scan.lines, width=scan.shape[2], **p)), "projection", mask, halo_reach=lambda p: int(p["length"]))
    for name, apply, parameters, values in (
        ("find_center_vo", find_center_vo, {"ind": None, "average_radius": 0, "smin": -50, "smax": 50, "srad": 6, "step": 0.5, "ratio": 0.5, "drop": 20}, ("cor",)),
        ("find_center_pc", find_center_pc, {}, ("cor",)),
        ("find_center_360", find_center_360, {"ind": None, "win_width": 10}, ("cor", "overlap", "side", "overlap_position")),
        ("find_center", find_center, {"ind": None, "reach": 5.0, "step": 0.5}, ("cor",)),
    ):
        add(name, apply, "projection" if name == "find_center_pc" else "sinogram", parameters, publishes=values)
    add("distortion_correction_proj", distortion_correction, "projection", {"xcenter": REQUIRED, "ycenter": REQUIRED, "list_fact": REQUIRED, "shift_xy": None, "step_xy": (1, 1)})
    add("sino_360_to_180", sino_360_to_180, "sinogram", {"overlap": 0, "side": "left"})
    add("seam_blend_stitched_data", seam_blend, parameters={"seam_index": REQUIRED, "reach": 2, "shift_seam_index": None})
    add("average_projection_frames", average_projection_frames, "projection", {"projection_averaging_factor": 2})
    add("data_resampler", data_resampler, "projection", {"newshape_factor": 2})
    recon = {"center": None, "recon_size": None, "recon_mask_radius": None, "filter_freq_cutoff": 1.0, "detector_pad": False}
    for name in ("FBP", "FBP2d_astra", "FBP3d_tomobar", "LPRec3d_tomobar"):
        add(name, reconstruction(frames.fbp), "sinogram", recon, save_default=True, memory_factor=6.0)
    gridrec = recon | {"algorithm": "fbp", "sinogram_order": True, "init_recon": None, "filter_name": "linear"}

    def recon_by_name(scan: Scan, pattern: str, algorithm: str = "fbp", sinogram_order: bool = True, init_recon=None, **parameters) -> Scan:
        if algorithm not in RECONSTRUCTIONS or not sinogram_order or init_recon is not None:
            raise ValueError(f"recon is {' or '.join(RECONSTRUCTIONS)} of sinograms, without a start image")
        if algorithm == "fbp":
            parameters.pop("filter_name", None)
        return reconstruction(RECONSTRUCTIONS[algorithm])(scan, pattern, **parameters)

    add("recon", recon_by_name, "sinogram", gridrec, save_default=True, memory_factor=6.0)
    add("FISTA3d_tomobar", reconstruction(_fista), "sinogram", {"center": None, "recon_size": None, "iterations": 15, "regularisation": 0.0, "detector_pad": False}, save_default=True, memory_factor=8.0)
    add("total_variation_PD", on_frames(frames.denoise_tv), parameters={"regularisation": 0.05, "iterations": 50}, memory_factor=6.0)
    images = {"subfolder_name": "images", "axis": "auto", "file_format": "pgm", "bits": 8, "perc_range_min": 0.0, "perc_range_max": 100.0, "jpeg_quality": 95, "offset": 0}
    add("save_to_images", unchanged, parameters=images)
    add("save_intermediate_data", unchanged, parameters={"of": ""})
