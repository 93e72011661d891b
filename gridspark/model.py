"""A field as a table of cells: one bigint column per axis, one value column, NULL where data are missing."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cells:
    """An n-dimensional array. `df` holds a row per cell; sizes are kept here, so shape algebra needs no job."""

    df: DataFrame
    axes: tuple[str, ...]
    shape: tuple[int, ...]
    value: str = "value"
    units: str | None = None
    calendar: str | None = None
    fill: object = None
    hardmask: bool = True

    @property
    def v(self) -> Column:
        return F.col(self.value)

    @property
    def sizes(self) -> dict[str, int]:
        return dict(zip(self.axes, self.shape))

    @property
    def size(self) -> int:
        n = 1
        for x in self.shape:
            n *= x
        return n

    @property
    def ndim(self) -> int:
        return len(self.axes)

    def select(self, value: Column) -> Cells:
        """The same cells with another value."""
        return replace(self, df=self.df.select(*self.axes, value.alias(self.value)))

    def frame(self) -> DataFrame:
        return self.df.select(*self.axes, self.value)


@dataclass(frozen=True)
class Construct:
    """A metadata construct: its kind, the axes it spans, its names, and its cells or other content."""

    key: str
    type: str
    axes: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)
    ncvar: str | None = None
    ncdim: str | None = None
    size: int | None = None
    measure: str | None = None
    method: str | None = None
    cell: str | None = None
    connectivity: str | None = None
    data: Cells | None = None
    bounds: DataFrame | None = None
    #: Of a coordinate reference: keys of its coordinates, and of the domain ancillary of each term of its formula.
    coordinates: tuple[str, ...] = ()
    terms: dict = field(default_factory=dict)

    def identities(self) -> list[str]:
        """All names, the identity first: standard name, then the others in a fixed order, then the netCDF names."""
        p, out = self.properties, []
        if p.get("standard_name"):
            out.append(p["standard_name"])
        if self.measure:
            out.append(f"measure:{self.measure}")
        if self.method:
            out.append(f"method:{self.method}")
        if self.cell:
            out.append(f"cell:{self.cell}")
        if self.connectivity:
            out.append(f"connectivity:{self.connectivity}")
        if p.get("grid_mapping_name"):
            out.append(f"grid_mapping_name:{p['grid_mapping_name']}")
        out += [f"{k}={p[k]}" for k in ("cf_role", "axis", "long_name") if p.get(k)]
        out += [f"{k}={p[k]}" for k in sorted(p) if k not in ("standard_name", "cf_role", "axis", "long_name")]
        if self.ncvar:
            out.append(f"ncvar%{self.ncvar}")
        if self.ncdim:
            out.append(f"ncdim%{self.ncdim}")
        return [*out, f"key%{self.key}"]

    def identity(self, default: str = "") -> str:
        found = [x for x in self.identities() if not x.startswith("key%")]
        return found[0] if found else default


@dataclass(frozen=True)
class Field:
    """Data and the constructs around them. Operators give new fields."""

    data: Cells
    constructs: tuple[Construct, ...] = ()
    properties: dict = field(default_factory=dict)

    def catalogue(self, spark: SparkSession) -> DataFrame:
        from .plans.catalog import catalogue

        return catalogue(spark, self.constructs)

    def construct(self, identity: str) -> Construct:
        found = [c for c in self.constructs if identity in c.identities()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} constructs are named {identity!r}, not one")
        return found[0]

    def replaced(self, new: Construct) -> Field:
        return replace(self, constructs=tuple(new if c.key == new.key else c for c in self.constructs))

    @property
    def domain(self) -> Domain:
        """Where the cells are: all constructs but those that are about the data."""
        return Domain(tuple(c for c in self.constructs if c.type not in ("cell_method", "field_ancillary")))

    def climatological_axes(self) -> set[str]:
        """Axes along which cell methods are within or over periods."""
        return {a for c in self.constructs if c.type == "cell_method" and {"within", "over"} & {*c.properties} for a in c.axes}


@dataclass(frozen=True)
class Domain:
    """The constructs of a field without its data."""

    constructs: tuple[Construct, ...] = ()
    properties: dict = field(default_factory=dict)

    @classmethod
    def of(cls, constructs: list[Construct] | tuple[Construct, ...], **properties: object) -> Domain:
        """A domain of constructs, with the axes that they span where they are not among them. Arrays that disagree on the size of an axis, and kinds that a domain has not, fail."""
        sizes = {c.key: c.size for c in constructs if c.type == "domain_axis"}
        for c in constructs:
            if c.type in ("cell_method", "field_ancillary"):
                raise ValueError(f"a domain has no {c.type}")
            for a, n in c.data.sizes.items() if c.data is not None else ():
                if sizes.setdefault(a, n) != n:
                    raise ValueError(f"{c.key} has {n} cells along {a}, which has {sizes[a]}")
        own = {c.key for c in constructs if c.type == "domain_axis"}
        return cls((*(Construct(a, "domain_axis", size=n) for a, n in sizes.items() if a not in own), *constructs), dict(properties))

    @property
    def sizes(self) -> dict[str, int]:
        return {c.key: c.size for c in self.constructs if c.type == "domain_axis"}
