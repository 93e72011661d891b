"""The small languages of attributes: lists, key-value lists, cell methods; and names from properties."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = re.compile(r"\(|\)|[^\s()]+")


def words(text: Column) -> Column:
    """A white-space list."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def key_values(text: Column) -> Column:
    """map<string, array<string>> of "key: value value key: value"."""
    keys = F.regexp_extract_all(text, F.lit(r"(\S+):(?=\s|$)"), F.lit(1))
    values = F.transform(F.slice(F.split(text, r"(?:^|\s)\S+:(?=\s|$)"), 2, 1 << 20), words)
    return F.map_from_arrays(keys, values)


def parse_key_values(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    key = None
    for token in text.split():
        if token.endswith(":"):
            key = token[:-1]
            out.setdefault(key, [])
        elif key is None:
            raise ValueError(f"{text!r} does not begin with a key")
        else:
            out[key].append(token)
    return out


def parse_cell_methods(text: str) -> list[dict]:
    """One dict per method in order: axes, method, qualifiers within, where, over, intervals (value, units) and comment."""
    tokens = TOKENS.findall(text)
    out: list[dict] = []
    k = 0
    while k < len(tokens):
        axes = []
        while k < len(tokens) and tokens[k].endswith(":"):
            axes.append(tokens[k][:-1])
            k += 1
        if not axes or k == len(tokens):
            raise ValueError(f"{text!r} has no method after its axes")
        m: dict = {"axes": axes, "method": tokens[k]}
        k += 1
        while k + 1 < len(tokens) and tokens[k] in ("within", "where", "over"):
            m[tokens[k]] = tokens[k + 1]
            k += 2
        if k < len(tokens) and tokens[k] == "(":
            end = tokens.index(")", k)
            inside, k = tokens[k + 1 : end], end + 1
            comment: list[str] = []
            at = 0
            while at < len(inside):
                if inside[at] == "interval:":
                    stop = next((j for j in range(at + 2, len(inside)) if inside[j].endswith(":")), len(inside))
                    m.setdefault("intervals", []).append((float(inside[at + 1]), " ".join(inside[at + 2 : stop])))
                    at = stop
                else:
                    at += inside[at] == "comment:"
                    stop = next((j for j in range(at, len(inside)) if inside[j] == "interval:"), len(inside))
                    comment += inside[at:stop]
                    at = max(stop, at + 1) if stop == at else stop
            if comment:
                m["comment"] = " ".join(comment)
        out.append(m)
    return out


def format_cell_methods(methods: list[dict]) -> str:
    out = []
    for m in methods:
        own = [f"{a}:" for a in m["axes"]] + [m["method"]]
        own += [x for q in ("within", "where", "over") if q in m for x in (q, m[q])]
        extra = [f"interval: {v:g} {u}" for v, u in m.get("intervals", [])]
        if "comment" in m:
            extra.append(f"comment: {m['comment']}" if extra else m["comment"])
        out.append(" ".join(own + ([f"({' '.join(extra)})"] if extra else [])))
    return " ".join(out)


def sorted_method(m: dict) -> dict:
    """A cell method with its axes in alphabetical order, and its intervals with them if there is one for each."""
    order = sorted(range(len(m["axes"])), key=lambda k: m["axes"][k])
    out = {**m, "axes": [m["axes"][k] for k in order]}
    if len(m.get("intervals", ())) == len(order):
        out["intervals"] = [m["intervals"][k] for k in order]
    return out


def parse_grid_mapping(text: str) -> dict[str, list[str]]:
    """{grid mapping variable: its coordinates}; one name alone has no list."""
    return parse_key_values(text) if ":" in text else {text.strip(): []}


def parse_coordinate_interpolation(text: str) -> list[tuple[list[str], str]]:
    """[(tie point variables, interpolation variable)] of "lat: lon: interp"."""
    out, names = [], []
    for token in text.split():
        if token.endswith(":"):
            names.append(token[:-1])
        else:
            out.append((names, token))
            names = []
    return out


def identity(properties: Column, ncvar: Column) -> Column:
    """The name of a construct from its map of properties."""
    tagged = lambda k: F.concat(F.lit(f"{k}="), F.try_element_at(properties, F.lit(k)))
    return F.coalesce(F.try_element_at(properties, F.lit("standard_name")), tagged("cf_role"), tagged("axis"), tagged("long_name"), F.concat(F.lit("ncvar%"), ncvar), F.lit(""))


def name_and_modifier(standard_name: Column) -> Column:
    """struct<name, modifier> of a standard name with an optional modifier."""
    parts = words(standard_name)
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("modifier"))
