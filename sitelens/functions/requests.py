"""What kind of request a row is, and what sent it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BEACON_PATH = "/_beacon"

# The classification ladders, first match wins.
BOTS = "bot|crawl|spider|slurp"
BROWSERS = [
    ("edg(e|a|ios)?/", "Edge"),
    ("(opr|opera|opios)/|opera(%20| )mini/", "Opera"),
    ("samsungbrowser/", "Samsung Internet"),
    ("(firefox|fxios)/", "Firefox"),
    ("(chrome|crios|chromium)/", "Chrome family"),
    ("safari/", "Safari family"),
]
DEVICES = [
    ("ipad|tablet|kindle|silk/|playbook", "Tablet"),
    ("mobile|iphone|ipod|windows(%20| )phone|blackberry|bb10", "Mobile"),
    ("android", "Tablet"),
    ("windows(%20| )nt|macintosh|x11|cros|linux", "Desktop"),
]
RENDERING = (".css", ".js", ".mjs", ".woff", ".woff2", ".ttf", ".otf")


def _ladder(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    chosen = F.when(text.rlike(steps[0][0]), steps[0][1])
    for pattern, name in steps[1:]:
        chosen = chosen.when(text.rlike(pattern), name)
    return chosen.otherwise("Other")


def browser_family(agent: Column) -> Column:
    return _ladder(F.lower(agent), BROWSERS)


def device_class(agent: Column) -> Column:
    return _ladder(F.lower(agent), DEVICES)


def not_a_bot(agent: Column, extra: Sequence[str] = ()) -> Column:
    """Rows of people, as far as the agent tells; a null agent is not one."""
    if any(not s.strip() for s in extra):
        raise ValueError("a bot substring must not be empty")
    keep = ~F.lower(agent).rlike(BOTS)
    return reduce(lambda a, s: a & (F.instr(F.lower(agent), s.lower()) == 0), extra, keep)


def is_page_view() -> Column:
    return (F.col("cs_method") == "GET") & F.col("sc_content_type").startswith("text/html") & F.col("sc_status").isin("200", "304")


def on_beacon_path(path: str = BEACON_PATH) -> Column:
    """By the raw stem, which the collection path never needs escapes in."""
    return F.col("cs_uri_stem").startswith(path)


def shows_rendering(beacon_path: str = BEACON_PATH) -> Column:
    """A style sheet, script or font was fetched, or the beacon spoke; images show nothing."""
    stem = F.lower(F.col("cs_uri_stem"))
    asset = reduce(lambda a, b: a | b, [stem.endswith(s) for s in RENDERING])
    return asset | on_beacon_path(beacon_path)


def under_any(path: Column, prefixes: Sequence[str]) -> Column:
    """Literal prefix match; no prefixes match nothing."""
    return reduce(lambda a, b: a | b, [path.startswith(F.lit(p)) for p in prefixes], F.lit(False))


def matched_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    """The first of the prefixes that the path is under; one prefix is itself, none is null."""
    if len(prefixes) < 2:
        return F.lit(prefixes[0] if prefixes else None).cast("string")
    chosen = F.when(path.startswith(F.lit(prefixes[0])), prefixes[0])
    for p in prefixes[1:]:
        chosen = chosen.when(path.startswith(F.lit(p)), p)
    return chosen
