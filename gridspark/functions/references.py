"""What coordinate references are made of: names, the coordinates they apply to, and the parameters of each part."""

from __future__ import annotations

#: Grid mappings with the standard names of their coordinates; those in the list have projection coordinates.
PROJECTIONS = (
    "albers_conical_equal_area", "azimuthal_equidistant", "geostationary", "lambert_azimuthal_equal_area", "lambert_conformal_conic", "lambert_cylindrical_equal_area", "mercator",
    "orthographic", "polar_stereographic", "sinusoidal", "stereographic", "transverse_mercator", "vertical_perspective",
)
ON_EARTH = ("latitude", "longitude")
#: Other grid mappings.
MAPPINGS = {"latitude_longitude": ON_EARTH, "rotated_latitude_longitude": ("grid_latitude", "grid_longitude", *ON_EARTH), "healpix": ("healpix_index", *ON_EARTH)}
#: Parameters that describe the figure of the Earth.
DATUM = (
    "earth_radius", "geographic_crs_name", "geoid_name", "geopotential_datum_name", "horizontal_datum_name", "inverse_flattening", "longitude_of_prime_meridian",
    "prime_meridian_name", "projected_crs_name", "reference_ellipsoid_name", "semi_major_axis", "semi_minor_axis", "towgs84",
)


def coordinates_of(name: str) -> tuple[str, ...]:
    """Standard names of the coordinates that a reference of this name applies to; a vertical one to its own."""
    if name in PROJECTIONS:
        return ("projection_x_coordinate", "projection_y_coordinate", *ON_EARTH)
    return MAPPINGS.get(name, (name,))


def parted(parameters: dict) -> tuple[dict, dict]:
    """(datum, conversion) of the attributes of a grid mapping variable."""
    return {k: v for k, v in parameters.items() if k in DATUM}, {k: v for k, v in parameters.items() if k not in DATUM}
