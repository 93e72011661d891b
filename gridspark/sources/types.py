"""Number types of files and of Spark."""

from __future__ import annotations

#: The default fill value of each type of the netCDF format.
DEFAULT_FILL = {
    "tinyint": -127,
    "smallint": -32767,
    "int": -2147483647,
    "bigint": -9223372036854775806,
    "float": 9.969209968386869e36,
    "double": 9.969209968386869e36,
    "string": "",
}
