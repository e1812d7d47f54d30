"""The entity catalogue and how a request for types is planned."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

#: Entity types in output order.
TYPES = (
    "LINE", "LWPOLYLINE", "POLYLINE_2D", "VERTEX_2D", "POLYLINE_3D", "VERTEX_3D", "POLYLINE_MESH", "VERTEX_MESH", "POLYLINE_PFACE", "VERTEX_PFACE", "VERTEX_PFACE_FACE", "SEQEND",
    "3DFACE", "SOLID", "TRACE", "SHAPE", "3DSOLID", "BODY", "VIEWPORT", "OLEFRAME", "OLE2FRAME", "LONG_TRANSACTION", "REGION", "RAY", "XLINE", "ARC", "CIRCLE", "ELLIPSE", "SPLINE",
    "POINT", "TEXT", "ATTRIB", "ATTDEF", "MTEXT", "LEADER", "HATCH", "TOLERANCE", "MLINE", "BLOCK", "ENDBLK", "INSERT", "MINSERT", "DIMENSION",
)
#: Types that only an explicit name or a wildcard selects.
EXPLICIT_ONLY = frozenset({"BLOCK", "ENDBLK", "SEQEND", "VERTEX_2D", "VERTEX_3D", "VERTEX_MESH", "VERTEX_PFACE", "VERTEX_PFACE_FACE"})
#: Types that can be written to a drawing file.
WRITABLE = ("LINE", "RAY", "XLINE", "POINT", "ARC", "CIRCLE", "LWPOLYLINE", "TEXT", "MTEXT")
#: Names of drawing units by code.
UNITS = ("unitless", "inches", "feet", "miles", "millimeters", "centimeters", "meters", "kilometers", "microinches", "mils", "yards", "angstroms", "nanometers", "microns", "decimeters", "decameters", "hectometers", "gigameters", "astronomical_units", "light_years", "parsecs", "us_survey_feet")


def canonical(name: str) -> str | None:
    """The catalogue's name of a raw type name, or None; every DIM_ type is DIMENSION."""
    name = name.strip().upper()
    name = "DIMENSION" if name.startswith("DIM_") else name
    return name if name in TYPES else None


def planned(request: str | Iterable[str] | None, present: Iterable[str] = TYPES) -> list[str]:
    """The catalogue types that a request selects, in the order of the request.

    Nothing, ``*`` and ``ALL`` select what is present but for explicit-only
    types. Wildcards match present types of every kind; unknown names select
    nothing. Names may be separated by commas or white space.
    """
    present = set(present)
    names = re.split(r"[,\s]+", request) if isinstance(request, str) else list(request or ())
    names = [n.strip().upper() for n in names if n and n.strip()]
    if not names or {"*", "ALL"} & set(names):
        return [t for t in TYPES if t in present and t not in EXPLICIT_ONLY]
    out: dict[str, None] = {}
    for n in names:
        if set("*?[]") & set(n):
            out |= dict.fromkeys(t for t in TYPES if t in present and fnmatch.fnmatchcase(t, n))
        elif (n := canonical(n) or "") in TYPES:
            out[n] = None
    return list(out)
