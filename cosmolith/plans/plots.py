"""Commands for gnuplot, which draws what the operators write."""

from __future__ import annotations


def plot_command(paths: list[str], using: str, style: str = "lines", title: str | None = None, color: str | None = None, width: int = 1) -> str:
    """One `plot` over all paths."""
    look = f"using {using} with {style} linewidth {width}" + (f" linecolor rgb '{color}'" if color else "") + (f" title '{title}'" if title else " notitle")
    return "plot " + ", ".join(f"'{p}' {look}" for p in paths)


def track_plot(template: str, count: int, x: int = 2, y: int = 12, log_y: bool = True) -> str:
    """The tracks in files that a template numbers from 0, all in black."""
    return plot_command([template % i for i in range(count)], f"{x}:(log10(${y}))" if log_y else f"{x}:{y}", color="black")


def histogram_plot(path: str, cdf: bool = False) -> str:
    """A written histogram: bin_id, center, pdf, width, cdf, count."""
    return plot_command([path], "2:5" if cdf else "2:3:4", "lines" if cdf else "boxes")


def map_plot(path: str) -> str:
    """A written 2-D histogram: ix, iy, x_lo, y_lo, z."""
    return plot_command([path], "3:4:5", "image")
