"""Finding datasets and telling their formats."""

from __future__ import annotations

import glob
import json
import os
import re

from .scratch import local

#: How files of each format begin.
MAGIC = {b"CDF\x01": "netcdf3", b"CDF\x02": "netcdf3", b"CDF\x05": "netcdf3", b"\x89HDF": "netcdf4", b"\x0e\x03\x13\x01": "netcdf4", b"PAR1": "parquet"}
CDL = re.compile(rb"^\s*(//[^\n]*\n\s*)*netcdf\s+\S+\s*\{")


def dataset_type(path: str) -> str | None:
    """netcdf3, netcdf4, parquet, zarr, kerchunk or cdl; None for what is none of them."""
    path = local(path)
    if os.path.isdir(path):
        if any(os.path.exists(f"{path}/{x}") for x in ("zarr.json", ".zarray", ".zgroup")):
            return "zarr"
        return "container" if os.path.isdir(f"{path}/_catalogue") else None
    with open(path, "rb") as f:
        head = f.read(4096)
    if head[:4] in MAGIC:
        return MAGIC[head[:4]]
    if CDL.match(head):
        return "cdl"
    if head.lstrip()[:1] == b"{":
        try:
            with open(path) as f:
                return "kerchunk" if "refs" in json.load(f) else None
        except ValueError:
            return None
    return None


def datasets(*patterns: str, recursive: bool = False, kinds: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """(path, type) of all datasets that names, glob patterns and folders give, in order. A Zarr folder is one dataset. Nothing found is an error."""
    out: dict[str, str] = {}

    def add(path: str, down: bool) -> None:
        kind = dataset_type(path)
        if kind:
            if kinds is None or kind in kinds:
                out[path] = kind
        elif os.path.isdir(path) and down:
            for name in sorted(os.listdir(path)):
                add(os.path.join(path, name), recursive)

    for p in patterns:
        found = sorted(glob.glob(os.path.expanduser(os.path.expandvars(local(p)))))
        for path in found:
            add(path, True)
        if not found:
            raise FileNotFoundError(p)
    if not out:
        raise FileNotFoundError(f"no datasets in {patterns}")
    return list(out.items())
