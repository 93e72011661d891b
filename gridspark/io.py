"""Reading and writing fields whatever the format: the entry point for users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .model import Domain, Field
from .sources import container, dataset, zarr3
from .sources.discover import datasets

#: The formats that can be read, by what discovery says.
READABLE = ("netcdf3", "zarr", "kerchunk", "container")


def read(spark: SparkSession, *patterns: str, external: list[str] | None = None, extra: tuple[str, ...] = (), domain: bool = False, recursive: bool = False, names: tuple[str, ...] = ()) -> list[Field] | list[Domain]:
    """The fields, or with `domain` the domains, of all datasets that names, glob patterns and folders give, in the order of datasets and then variables.

    `external` are files with cell measures that others leave out. `extra` are roles (coordinates, ancillary_variables,
    cell_measures, ...) whose variables are fields too. `names` keeps fields of these identities only. A dataset of a format that is
    known but cannot be read is an error."""
    found = datasets(*patterns, recursive=recursive)
    closed = [f"{p} ({k})" for p, k in found if k not in READABLE]
    if closed:
        raise ValueError(f"formats that cannot be read here: {', '.join(closed)}")
    files = [p for p, k in found if k != "container"]
    by_path: dict[str, list] = {p: [] for p, _ in found}
    for p, part in dataset.grouped(spark, files, external, extra, domain).items() if files else ():
        by_path[p] = part
    for p, kind in found:
        if kind == "container":
            f = container.load(spark, f"file://{p}")
            by_path[p] = [f.domain if domain else f]
    out = [f for p, _ in found for f in by_path[p]]
    return [f for f in out if {*names} & {f.properties.get("standard_name"), f.properties.get("long_name"), f"ncvar%{f.properties.get('ncvar')}"}] if names else out


def write(fields: list[Field | Domain], path: str, fmt: str = "netcdf3", **options: object) -> dict[str, int]:
    """Fields to one dataset: netcdf3 takes the options of sources.dataset.write(), zarr (one field, its data only) and container (one field) those of theirs. Gives counts of values outside valid ranges, where the format has them."""
    if fmt == "netcdf3":
        return dataset.write(fields, path, **options)
    (f,) = fields
    if fmt == "zarr":
        zarr3.write(f.data, path, **options)
    elif fmt == "container":
        container.save(f, path, **options)
    else:
        raise ValueError(f"{fmt!r} is no format that can be written")
    return {}
