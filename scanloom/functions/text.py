"""Headers, names and configuration as native expressions or small driver-side parsers."""

from __future__ import annotations

import ast
import base64
import configparser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that a run's configuration must have.
REQUIRED_FIELDS = (
    "scan_num", "nx", "ny", "x_range", "y_range", "x_num", "y_num", "det_roix0", "det_roiy0", "x_ratio", "y_ratio",
    "xray_energy_kev", "ccd_pixel_um", "distance",
)


def endpoint_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^\w+://([^/:]+)", 1)


def model_name_version(filename: Column) -> tuple[Column, Column]:
    """Of names like beam_v12.engine; a name of another form has an empty name and no version."""
    pattern = r"^(.+?)_v(\d+)\.engine$"
    return F.regexp_extract(filename, pattern, 1), F.regexp_extract(filename, pattern, 2).try_cast("int")


def literal(value: str):
    """A configuration value: what it spells as a literal, else the text itself."""
    try:
        return ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return value


def coerced(value: Column) -> tuple[Column, Column, Column]:
    """The value as an integer, as a double, and as text, for tables of configurations."""
    return value.try_cast("bigint"), value.try_cast("double"), value


def curve_key(text: str) -> bytes:
    """A 32-byte key from 40 characters of Z85 or 44 of base64."""
    if len(text) == 44:
        key = base64.b64decode(text, validate=True)
    elif len(text) == 40:
        digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"
        key = b""
        for i in range(0, 40, 5):
            n = 0
            for c in text[i : i + 5]:
                n = n * 85 + digits.index(c)
            key += n.to_bytes(4, "big")
    else:
        raise ValueError("a key has 40 characters of Z85 or 44 of base64")
    if len(key) != 32:
        raise ValueError("a key has 32 bytes")
    return key


def curve_options(server: str | None, public: str | None, secret: str | None) -> dict[str, bytes]:
    """All three keys or none."""
    given = [server, public, secret]
    if not any(given):
        return {}
    if not all(given):
        raise ValueError("give all three keys or none")
    return dict(zip(("server", "public", "secret"), map(curve_key, given)))


def scan_header(text: str) -> dict | None:
    """The [scan] section of an INI text with numbers read; None if it is missing or broken.  No angle is 0."""
    parser = configparser.ConfigParser()
    try:
        parser.read_string(text)
        section = parser["scan"]
        out = {k: literal(v) for k, v in section.items()}
        if not out:
            return None
        out["angle"] = float(out.get("angle", 0))
        return out
    except (configparser.Error, KeyError, ValueError):
        return None


def gui_ini(config: dict) -> str:
    return "[GUI]\n" + "".join(f"{k} = {v}\n" for k, v in config.items())


def missing_fields(config: dict) -> list[str]:
    return [k for k in REQUIRED_FIELDS if k not in config]
