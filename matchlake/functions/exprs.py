"""Scalar functions as Column builders, and the constants they share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ("auto", "transition", "teleop", "endgame")
PLAUSIBLE_FTPS = 20.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def share(part: Column | str, whole: Column | str, digits: int | None = 3) -> Column:
    """Part of a whole; null, not 0, where the whole is nothing."""
    part, whole = _c(part), _c(whole)
    out = F.when(whole != 0, part / whole)
    return out if digits is None else F.bround(out, digits)


# phases and clocks ---------------------------------------------------------------------------------------------------


def phase_of_event(t: Column, auto: Column, teleop: Column, endgame: Column) -> Column:
    """Phase of an event time in the match; teleop includes the endgame; outside the match it is unknown."""
    return (
        F.when(t.isNull() | (t < 0), "unknown").when(t < auto, "auto").when(t < auto + teleop - endgame, "teleop").when(t <= auto + teleop, "endgame").otherwise("unknown")
    )


def phase_by_end(t: Column, auto: Column, teleop: Column, endgame: Column) -> Column:
    """As above without a test for negative times and with the match's end left out."""
    return F.when(t < auto, "auto").when(t < auto + teleop - endgame, "teleop").when(t < auto + teleop, "endgame").otherwise("unknown")


def phase_simulated(t: Column, auto: Column, teleop: Column, endgame: Column) -> Column:
    """Never unknown: before the match it is auto, after it the endgame."""
    return F.when(t < auto, "auto").when(t < auto + teleop - endgame, "teleop").otherwise("endgame")


def clock_at(t: Column, start: Column, auto: Column, pause: Column, teleop: Column, endgame: Column) -> Column:
    """``struct(mt, phase)`` of a video time: match time stands still in the pause between auto and teleop, whose start still counts as auto."""
    run = t - start
    mt = F.when(run <= auto, run).when(run < auto + pause, auto).otherwise(run - pause)
    phase = (
        F.when(run < 0, "pre_match").when(run <= auto, "auto").when(run < auto + pause, "transition")
        .when(mt < auto + teleop - endgame, "teleop").when(mt <= auto + teleop, "endgame").otherwise("post_match")
    )
    return F.struct(F.bround(mt, 3).alias("mt"), phase.alias("phase"))


def match_start(offset: Column, anchor: Column, first_event: Column) -> Column:
    """Start of the match in video seconds: a fitted clock, else the first start event, else the clip's start."""
    return F.coalesce(anchor, first_event, offset, F.lit(0.0))


def points_for(phase: Column, goal: Column, values: Column) -> Column:
    """Points of a made shot; an unknown goal, phase or season scores 0."""
    return F.coalesce(F.try_element_at(F.try_element_at(values, phase), F.concat(F.lit("shot_made_"), goal)), F.lit(0))


# geometry ------------------------------------------------------------------------------------------------------------


def iou(a: Column, b: Column) -> Column:
    """Overlap of two ``struct(x, y, w, h)`` boxes, 0 where they have no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2, a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2)


def distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def lerp(a: Column, b: Column, u: Column) -> Column:
    """Between two values; null if either is."""
    return a + (b - a) * u


def alliance_frame(x: Column, y: Column, alliance: Column, length: Column, width: Column) -> Column:
    """``struct(ax, ay)``: blue keeps the field's axes, red is turned about its centre, no alliance gives nulls."""
    ax = F.when(alliance == "blue", x).when(alliance == "red", length - x)
    ay = F.when(alliance == "blue", y).when(alliance == "red", width - y)
    return F.struct(ax.alias("ax"), ay.alias("ay"))


def band_of(value: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """The half-open band that holds a value, else the nearest one, else null for null."""
    if not bands:
        return F.lit(None).cast("string")
    inside = None
    for name, low, high in bands:
        hit = (value >= low) & (value < high)
        inside = F.when(hit, name) if inside is None else inside.when(hit, name)
    near = [F.struct(F.least(F.abs(value - low), F.abs(value - high)).alias("gap"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, low, high) in enumerate(bands)]
    return F.when(value.isNotNull(), F.coalesce(inside, F.array_min(F.array(*near))["name"]))


def band_of_array(value: Column, bands: Column, low: str, high: str) -> Column:
    """As ``band_of`` with the bands in an array column of ``struct(id, low, high)``."""
    inside = F.filter(bands, lambda b: (value >= b[low]) & (value < b[high]))
    near = F.array_min(F.transform(bands, lambda b, i: F.struct(F.least(F.abs(value - b[low]), F.abs(value - b[high])).alias("gap"), i.alias("i"), b["id"].alias("id"))))
    return F.when(value.isNotNull() & (F.size(bands) > 0), F.coalesce(F.get(inside, F.lit(0))["id"], near["id"]))


def inside_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test against an array of ``struct(x, y)`` corners."""
    after = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    edges = F.arrays_zip(polygon.alias("a"), after.alias("b"))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def on_edge(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies on an edge of a polygon of given corners."""
    found = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]):
        flat = (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0
        found = found | flat & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
    return found


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_intersect(p: Sequence[Column], q: Sequence[Column], r: Sequence[Column], s: Sequence[Column], slack: float = 1e-9) -> Column:
    """Whether segments pq and rs meet, touching within ``slack`` included; points are ``(x, y)`` pairs."""
    on = lambda a, b, c: (F.least(a[0], b[0]) - slack <= c[0]) & (c[0] <= F.greatest(a[0], b[0]) + slack) & (F.least(a[1], b[1]) - slack <= c[1]) & (c[1] <= F.greatest(a[1], b[1]) + slack)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    o1, o2, o3, o4 = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
    flat = lambda o: F.abs(o) <= slack
    touches = (flat(o1) & on(p, q, r)) | (flat(o2) & on(p, q, s)) | (flat(o3) & on(r, s, p)) | (flat(o4) & on(r, s, q))
    return ((o1 * o2 < 0) & (o3 * o4 < 0)) | touches


def crosses_directed(p: Sequence[Column], q: Sequence[Column], r: Sequence[Column], s: Sequence[Column], direction: Sequence[float | Column], slack: float = 1e-9) -> Column:
    """Whether a move from p to q goes along ``direction`` and meets boundary rs, touching within ``slack`` included."""
    return ((q[0] - p[0]) * direction[0] + (q[1] - p[1]) * direction[1] > 0) & segments_intersect(p, q, r, s, slack)


def inside_box(x: Column, y: Column, box: Column) -> Column:
    return (x >= box["x"]) & (x <= box["x"] + box["w"]) & (y >= box["y"]) & (y <= box["y"] + box["h"])


def distance_to_box(x: Column, y: Column, box: Column) -> Column:
    dx = F.greatest(box["x"] - x, F.lit(0.0), x - box["x"] - box["w"])
    dy = F.greatest(box["y"] - y, F.lit(0.0), y - box["y"] - box["h"])
    return F.hypot(dx, dy)


def to_field(x: Column, y: Column, h: Column) -> Column:
    """Image point to field feet by a row-major 3x3 homography; null near the horizon."""
    at = lambda i: F.element_at(h, i + 1)
    w = at(6) * x + at(7) * y + at(8)
    ok = F.abs(w) > 1e-9
    return F.struct(F.when(ok, (at(0) * x + at(1) * y + at(2)) / w).alias("x"), F.when(ok, (at(3) * x + at(4) * y + at(5)) / w).alias("y"))


def box_to_field(box: Column, h: Column) -> Column:
    """Where a box stands: its bottom centre on the field."""
    return to_field(box["x"] + box["w"] / 2, box["y"] + box["h"], h)


def on_field(x: Column, y: Column, length: Column, width: Column, margin: float = 0.0) -> Column:
    return (x >= -margin) & (x <= length + margin) & (y >= -margin) & (y <= width + margin)


def speed_ftps(x1: Column, y1: Column, t1: Column, x2: Column, y2: Column, t2: Column) -> Column:
    return F.when(t2 > t1, F.hypot(x2 - x1, y2 - y1) / (t2 - t1))


def implausible(speed: Column, limit: float = PLAUSIBLE_FTPS) -> Column:
    return speed > limit


def centre_to_corner(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Box given by its centre, clipped to the unit frame."""
    x, y = F.greatest(F.lit(0.0), cx - w / 2), F.greatest(F.lit(0.0), cy - h / 2)
    return F.struct(x.alias("x"), y.alias("y"), (F.least(F.lit(1.0), cx + w / 2) - x).alias("w"), (F.least(F.lit(1.0), cy + h / 2) - y).alias("h"))


def pixels_to_unit(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Corner pixels, in either order, to a clipped box of the unit frame."""
    unit = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / n))
    lx, hx = unit(F.least(x1, x2), width), unit(F.greatest(x1, x2), width)
    ly, hy = unit(F.least(y1, y2), height), unit(F.greatest(y1, y2), height)
    return F.struct(lx.alias("x"), ly.alias("y"), (hx - lx).alias("w"), (hy - ly).alias("h"))


def region_to_frame(box: Column, region: Column) -> Column:
    """Box within a region or crop back to the frame."""
    return F.struct(
        (region["x"] + box["x"] * region["w"]).alias("x"), (region["y"] + box["y"] * region["h"]).alias("y"),
        (box["w"] * region["w"]).alias("w"), (box["h"] * region["h"]).alias("h"),
    )


def nearest_edge(box: Column, threshold: float) -> Column:
    """Name of the frame edge that a box is within ``threshold`` of, the nearest first; null if none."""
    gaps = F.array(*[F.struct(g.alias("gap"), F.lit(n).alias("edge")) for n, g in (
        ("left", box["x"]), ("right", 1.0 - box["x"] - box["w"]), ("top", box["y"]), ("bottom", 1.0 - box["y"] - box["h"]))])
    least = F.array_min(gaps)
    return F.when(least["gap"] <= threshold, least["edge"])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for vectors of other lengths or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def path_distance(a: Column, b: Column, least: int = 3) -> Column:
    """Mean distance of two paths over instants that both know; null below ``least`` of them."""
    gaps = F.filter(F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])), lambda d: d.isNotNull())
    return F.when(F.size(gaps) >= least, F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d) / F.size(gaps))


# names and keys ------------------------------------------------------------------------------------------------------


def team_number(value: Column) -> Column:
    """``frc254`` or ``254`` to 254, anything else to null."""
    return F.regexp_extract(value.cast("string"), r"^(?:frc)?(\d+)$", 1).try_cast("int")


def event_key(match_id: Column) -> Column:
    return F.when(match_id.rlike(r"^\d{4}[a-z0-9]+_"), F.split(match_id, "_")[0])


MATCH_ID = r"^(\d{4}[a-z0-9]+?)_(qm|ef|qf|sf|f)(\d+)(?:m(\d+))?$"
LEVELS = ("qm", "ef", "qf", "sf", "f")


def match_order(match_id: Column) -> Column:
    """``struct(event, level, number, game)`` to sort matches by; ids of another form have level 9."""
    part = lambda i: F.regexp_extract(match_id, MATCH_ID, i)
    known = F.coalesce(match_id.rlike(MATCH_ID), F.lit(False))
    return F.struct(
        F.when(known, part(1)).otherwise(F.coalesce(match_id, F.lit(""))).alias("event"),
        F.when(known, F.array_position(F.array(*map(F.lit, LEVELS)), part(2)).cast("int") - 1).otherwise(9).alias("level"),
        F.when(known, part(3).try_cast("int")).otherwise(0).alias("number"),
        F.coalesce(F.when(known, part(4).try_cast("int")), F.lit(0)).alias("game"),
    )


def is_practice(match_id: Column, flag: Column | None = None) -> Column:
    plain = match_order(match_id)["level"] == 9
    return plain if flag is None else F.coalesce(flag, F.lit(False)) | plain


def source_stem(name: Column) -> Column:
    """File stem without the suffix that augmented copies carry."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(_jpg|_png)?\.rf\..*$", "")


def is_robot_class(name: Column) -> Column:
    return F.lower(name).rlike(r"robot|^(red|blue)([_ ]|$)")


def alliance_of_class(name: Column) -> Column:
    return F.when(F.lower(name).contains("red"), "red").when(F.lower(name).contains("blue"), "blue")


def segment_of(stem: Column) -> Column:
    """All but the last ``_`` part of a frame's stem."""
    parts = F.split(stem, "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "_")


def video_id(url: Column) -> Column:
    """The 11-character id of a video address, or of a bare id."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/live/|^)([A-Za-z0-9_-]{11})(?:[?&#/].*)?$", 1), F.lit(""))


def video_start(url: Column) -> Column:
    """Start time in seconds of ``t=`` or ``start=``, as ``90``, ``90s`` or ``1h2m3s``."""
    raw = F.regexp_extract(url, r"[?&#](?:t|start)=([0-9hms]+)", 1)
    unit = lambda u, n: F.coalesce(F.regexp_extract(raw, rf"(\d+){u}", 1).try_cast("int") * n, F.lit(0))
    return F.when(raw == "", None).otherwise(F.coalesce(raw.try_cast("int"), unit("h", 3600) + unit("m", 60) + unit("s", 1)))


def timer_seconds(digits: Column) -> Column:
    """``M:SS`` digits of a scoreboard to seconds; null out of range."""
    only = F.regexp_replace(digits, r"\D", "")
    minutes, seconds = F.substring(only, 1, 1).try_cast("int"), F.substring(only, -2, 2).try_cast("int")
    return F.when((F.length(only) == 3) & (seconds < 60), minutes * 60 + seconds)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_text(seconds: Column) -> Column:
    """``m:ss`` of seconds, the sign kept."""
    whole = F.floor(F.abs(seconds))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))


def shots_from_points(points: Column, values: Column) -> Column:
    """Shots that explain a score step: the step by the smallest positive value if it divides, else null."""
    least = F.array_min(F.filter(F.map_values(values), lambda v: v > 0))
    return F.when(points.isNotNull() & (points % least == 0), F.floor(points / least))


def short_id(uuid: Column) -> Column:
    """First 11 characters of the URL-safe base64 of a UUID's bytes."""
    return F.substring(F.translate(F.base64(F.unhex(F.translate(uuid, "-", ""))), "+/=", "-_"), 1, 11)


def error_code(message: Column, rules: Sequence[tuple[str, str]], default: str = "internal") -> Column:
    """The code of the first rule whose text the message holds."""
    out = None
    for needle, code in rules:
        hit = F.lower(message).contains(needle)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return F.lit(default) if out is None else out.otherwise(default)


def crc_split(stem: Column, train: float = 0.8, valid: float = 0.9) -> Column:
    """train, valid or test by the CRC-32 of a name."""
    u = F.crc32(stem.cast("binary")) % 10000 / F.lit(10000.0)
    return F.when(u < train, "train").when(u < valid, "valid").otherwise("test")


def sha_fraction(seed: Column, group: Column) -> Column:
    """Fraction in [0, 1) of the first 64 bits of SHA-256 of ``seed:group``."""
    head = F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), group.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def yolo_line(kind: Column, box: Column) -> Column:
    """``class cx cy w h`` with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", kind, box["x"] + box["w"] / 2, box["y"] + box["h"] / 2, box["w"], box["h"])
