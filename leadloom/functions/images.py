"""Logos without an imaging library: SVG is cleaned and measured, raster files are checked by their headers."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIDE, MAX_PIXELS, DARK_FROM = 12, 20_000_000, 210
_DROP = {"script", "foreignObject", "image", "animate", "animateTransform", "animateMotion", "set"}
_COLOUR = re.compile(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b")


def clean_svg(body: bytes) -> bytes | None:
    """An SVG without scripts, embedded content, event handlers and outside references; null if it is none or declares entities."""
    if b"<!ENTITY" in body or b"<!DOCTYPE" in body:
        return None
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return None
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    if name(root) != "svg":
        return None
    for parent in list(root.iter()):
        for child in list(parent):
            if name(child) in _DROP:
                parent.remove(child)
        for k, v in list(parent.attrib.items()):
            outside = k.rpartition("}")[2] == "href" and not v.startswith("#") or re.search(r"url\((?!\s*['\"]?#)", v)
            if k.lower().startswith("on") or outside:
                del parent.attrib[k]
    return ET.tostring(root)


def image_size(body: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) from the header of a PNG, GIF or JPEG file."""
    if body[:8] == b"\x89PNG\r\n\x1a\n" and len(body) >= 24:
        return ("png", *struct.unpack(">II", body[16:24]))
    if body[:6] in (b"GIF87a", b"GIF89a") and len(body) >= 10:
        return ("gif", *struct.unpack("<HH", body[6:10]))
    if body[:2] == b"\xff\xd8":
        k = 2
        while k + 9 <= len(body) and body[k] == 0xFF:
            mark, size = body[k + 1], struct.unpack(">H", body[k + 2 : k + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", body[k + 5 : k + 9])
                return ("jpg", w, h)
            k += 2 + size
    return None


def svg_background(body: bytes) -> str | None:
    """``dark`` where the mean brightness of an SVG's colours is above DARK_FROM, so that it needs a dark ground; else null."""
    light = []
    for c in _COLOUR.findall(body.decode("utf-8", "replace")):
        c = c if len(c) == 6 else "".join(x * 2 for x in c)
        r, g, b = (int(c[i : i + 2], 16) for i in (0, 2, 4))
        light.append(0.299 * r + 0.587 * g + 0.114 * b)
    return "dark" if light and sum(light) / len(light) > DARK_FROM else None


def logo(body: bytes | None) -> dict:
    """kind, width, height, body (cleaned SVG or the file as it is), background; all null where it is no usable logo."""
    none = dict.fromkeys(("kind", "width", "height", "body", "background"))
    if not body:
        return none
    if size := image_size(body):
        ok = min(size[1:]) >= MIN_SIDE and size[1] * size[2] <= MAX_PIXELS
        return {"kind": size[0], "width": size[1], "height": size[2], "body": body, "background": None} if ok else none
    if b"<svg" in body[:2000] and (svg := clean_svg(body)):
        return {"kind": "svg", "width": None, "height": None, "body": svg, "background": svg_background(svg)}
    return none


def safe_logo(body: Column) -> Column:
    """``logo`` as an Arrow function."""

    @F.pandas_udf("struct<kind:string,width:int,height:int,body:binary,background:string>")
    def checked(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([logo(bytes(b) if b is not None else None) for b in bodies], columns=["kind", "width", "height", "body", "background"])

    return checked(body)
