"""What a field looks like: one line, a summary, everything; settings and versions."""

from __future__ import annotations

import platform
import sys
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from ..functions.attrs import format_cell_methods
from ..model import Cells, Field


@dataclass(frozen=True)
class Settings:
    atol: float = 2.220446049250313e-16
    rtol: float = 2.220446049250313e-16
    log_level: str = "WARNING"
    display_data: bool = True


_now = [Settings()]


def settings() -> Settings:
    return _now[-1]


@contextmanager
def configured(**changes: object) -> Iterator[Settings]:
    """Other settings inside a with statement."""
    _now.append(replace(_now[-1], **changes))
    try:
        yield _now[-1]
    finally:
        _now.pop()


def environment(spark: SparkSession) -> dict[str, str]:
    import numpy
    import pyarrow

    return {"platform": platform.platform(), "python": sys.version.split()[0], "spark": spark.version, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__}


def one_line(field: Field) -> str:
    axes = ", ".join(f"{a}({n})" for a, n in field.data.sizes.items())
    return f"<Field: {field.properties.get('standard_name', field.properties.get('long_name', ''))}({axes}) {field.data.units or ''}>".replace(" >", ">")


def ends_text(cells: Cells) -> str:
    """First and last values, which is all that is computed."""
    from ..operators.cells import ends

    if not settings().display_data:
        return ""
    r = ends(cells).first()
    show = lambda x: "--" if x is None else str(x)
    return f"[{show(r[0])}, ..., {show(r[2])}]" if cells.size > 2 else f"[{show(r[0])}]"


def dump(field: Field) -> str:
    """Properties, data and every construct, a line each."""
    out = [one_line(field)]
    out += [f"    {k} = {v!r}" for k, v in sorted(field.properties.items())]
    out.append(f"    data = {ends_text(field.data)} {field.data.units or ''}".rstrip())
    for c in field.constructs:
        if c.type == "domain_axis":
            out.append(f"    axis {c.ncdim or c.key}({c.size})")
        elif c.type == "cell_method":
            out.append(f"    {format_cell_methods([{'axes': list(c.axes), 'method': c.method}])}")
        else:
            more = f" = {ends_text(c.data)}" if c.data is not None else "".join(f" {t}: {k}" for t, k in c.terms.items())
            out.append(f"    {c.type} {c.identity(c.key)}({', '.join(c.axes or c.coordinates)})" + more)
    return "\n".join(out)


def deterministic_name(cells: Cells) -> str:
    """A name that arrays made by the same plan of the same inputs share, without reading them."""
    said = (cells.axes, cells.shape, cells.value, cells.units, cells.calendar, str(cells.fill))
    return f"{cells.df.semanticHash() & 0xFFFFFFFF:08x}-{zlib.crc32(repr(said).encode()):08x}"


def creation_commands(field: Field, name: str = "field") -> str:
    """Python that makes the field's description again; the cells are read from where they are stored."""
    d = field.data
    lines = ["from gridspark.model import Cells, Construct, Field", f"data = Cells(df, {d.axes!r}, {d.shape!r}, {d.value!r}, {d.units!r}, {d.calendar!r}, {d.fill!r}, {d.hardmask!r})", "constructs = ("]
    for c in field.constructs:
        own = {k: getattr(c, k) for k in ("key", "type", "axes", "properties", "ncvar", "ncdim", "size", "measure", "method", "cell", "connectivity", "coordinates", "terms")}
        lines.append(f"    Construct({', '.join(f'{k}={v!r}' for k, v in own.items() if v)}),")
    return "\n".join([*lines, ")", f"{name} = Field(data, constructs, {field.properties!r})"])
