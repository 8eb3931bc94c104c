"""Colour arithmetic as columns. Channels are 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _linear(c: float) -> float:
    u = c / 255.0
    return u / 12.92 if u <= 0.03928 else ((u + 0.055) / 1.055) ** 2.4


def linear(c: Column) -> Column:
    """Linear light of a channel, whole or not."""
    u = c / 255.0
    return F.when(u <= 0.03928, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def linear8(c: Column) -> Column:
    """The same of a whole channel, looked up among 256 values."""
    return F.get(F.lit([_linear(k) for k in range(256)]), c.cast("int"))


def luminance8(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear8(r) + 0.7152 * linear8(g) + 0.0722 * linear8(b)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    """WCAG ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab under D65."""
    lr, lg, lb = linear(r), linear(g), linear(b)
    xyz = (
        (0.4124 * lr + 0.3576 * lg + 0.1805 * lb) / 0.95047,
        0.2126 * lr + 0.7152 * lg + 0.0722 * lb,
        (0.0193 * lr + 0.1192 * lg + 0.9505 * lb) / 1.08883,
    )
    f = [F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116) for t in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def delta_e(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def hex_ok(h: Column) -> Column:
    return h.rlike("^#*[0-9A-Fa-f]{6}$")


def rgb_of_hex(h: Column) -> tuple[Column, Column, Column]:
    """Channels of #RRGGBB (leading # optional); null if it isn't six hex digits."""
    digits = F.when(hex_ok(h), F.ltrim(h, F.lit("#")))
    return tuple(F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def hex_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def css_to_hex(css: Column) -> Column:
    """rgb(...) or rgba(...) as #RRGGBB; null if it is neither or fully clear."""
    part = lambda i: F.regexp_extract(css, r"^rgba?\((\d+),\s*(\d+),\s*(\d+)(?:,\s*([\d.]+))?\)$", i)
    fine = (part(1) != "") & ~((part(4) != "") & (part(4).try_cast("double") == 0))
    return F.when(fine, hex_of_rgb(*(part(i).try_cast("int") for i in (1, 2, 3))))


def gray(r: Column, g: Column, b: Column) -> Column:
    """Fixed-point luma."""
    return F.shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)


def luma_changed(a: tuple, b: tuple, threshold=30) -> Column:
    d = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return F.floor((299 * d[0] + 587 * d[1] + 114 * d[2]) / 1000) > threshold


def saturation_value(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, F.floor((top - low) * 255 / F.greatest(top, F.lit(1)))).otherwise(0).cast("long"), top.cast("long")


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees, 0 to 360; null for grays."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(top > low, top - low)
    h = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.when(h < 0, h + 360).otherwise(h)


def hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value as bytes, in single precision and cut off; grays have hue 0."""
    f = lambda c: c.cast("float")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = f(F.when(top > low, top - low))
    away = lambda c: f(f(top - c) / d)
    h = F.when(r == top, f(away(b) - away(g))).when(g == top, f(f(F.lit(2.0)) + f(away(r) - away(b)))).otherwise(f(f(F.lit(4.0)) + f(away(g) - away(r))))
    turn = f(f(h / f(F.lit(6.0))) + f(F.lit(1.0)))
    byte = lambda x: F.floor(f(x * f(F.lit(255.0)))).cast("long")
    return F.coalesce(byte(f(turn - F.floor(turn))), F.lit(0).cast("long")), F.coalesce(byte(f(d / f(top))), F.lit(0).cast("long")), top.cast("long")


#: Upper edges of the hue bands in degrees, in order.
HUES = ((15, "red"), (45, "orange"), (65, "yellow"), (160, "green"), (200, "cyan"), (250, "blue"), (285, "purple"), (330, "magenta"))


def family(h: Column, s: Column) -> Column:
    out = F.when(h.isNull() | (s < 25), "neutral")
    for edge, name in HUES:
        out = out.when(h < edge, name)
    return out.otherwise("red")


def warmth(h: Column, s: Column) -> Column:
    return F.when(h.isNull() | (s < 25), "neutral").when((h < 70) | (h >= 330), "warm").otherwise("cool")


def tone(v: Column) -> Column:
    return F.when(v < 85, "dark").when(v < 170, "mid").otherwise("light")


def saturation_tier(s: Column) -> Column:
    return F.when(s < 25, "gray").when(s < 60, "muted").otherwise("vivid")


def aspect(w: Column, h: Column) -> Column:
    return F.when(w / h > 1.2, "landscape").when(w / h < 0.83, "portrait").otherwise("square")


#: Fixed value: characters from dark to light.
RAMP = "@%#*+=-:. "


def ramp_char(lum: Column) -> Column:
    at = F.least(F.greatest(F.floor((255 - lum) / 255 * 9), F.lit(0)), F.lit(9)).cast("int")
    return F.substring(F.lit(RAMP), at + 1, F.lit(1))


def letter(r: Column, g: Column, b: Column) -> Column:
    """The letter of a mean colour. The letters and the bounds of their channels."""
    return (
        F.when((r > 200) & (g < 100) & (b < 100), "R")
        .when((g > 200) & (r < 100) & (b < 100), "G")
        .when((b > 200) & (r < 100) & (g < 100), "B")
        .when((r > 150) & (g > 150) & (b < 100), "Y")
        .when((r > 150) & (g < 100) & (b > 150), "M")
        .when((r < 100) & (g > 150) & (b > 150), "C")
        .when((r > 200) & (g > 200) & (b > 200), "W")
        .otherwise("K")
    )
