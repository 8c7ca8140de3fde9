"""Reports as HTML: one escaped document for each series, written as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.sources.bars import SERIES

STYLE = "body{font-family:Arial,sans-serif;max-width:1000px;margin:auto;padding:20px}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ddd;padding:5px;text-align:left}@media print{body{padding:0}}"
#: What a page shows when a value is not known, and the letters that are written otherwise in HTML.
ABSENT, ESCAPES = "\u2014", {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}


def escaped(x: Column) -> Column:
    """Text that stands for itself in HTML; a null stays null."""
    for letter, name in ESCAPES.items():
        x = F.replace(x, F.lit(letter), F.lit(name))
    return x


def _text(x: Column) -> Column:
    return F.coalesce(escaped(x.cast("string")), F.lit(ABSENT))


def _number(x: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_number(x.cast("double"), digits), F.lit(ABSENT))


def _row(*cells: Column, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) for x in cells), F.lit("</tr>"))


def _table(heads: tuple[str, ...], rows: Column) -> Column:
    return F.concat(F.lit("<table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>"), rows, F.lit("</table>"))


def _items(x: Column) -> Column:
    listed = F.array_join(F.transform(x, lambda t: F.concat(F.lit("<li>"), _text(t), F.lit("</li>"))), "")
    return F.concat(F.lit("<ul>"), F.when(F.coalesce(F.size(x), F.lit(0)) > 0, listed).otherwise(F.lit(f"<li>{ABSENT}</li>")), F.lit("</ul>"))


def _setup(side: str) -> Column:
    s = F.col(side)
    target = lambda k: F.try_element_at(s["targets"], F.lit(k))["price"]
    return F.when(F.coalesce(s["valid"], F.lit(False)), _row(F.lit(side), _text(s["trigger"]), _number(s["stop"]), _number(target(1)), _number(target(2)), _number(s["primary_rr"]), _number(s["confidence"], 0))).otherwise(
        F.concat(F.lit(f"<tr><td>{side}</td><td colspan=6>no valid setup</td></tr>"))
    )


def documents(reports: DataFrame) -> DataFrame:
    """(symbol, timeframe, html): a page for each row of ``analysis.reports``; what is not known is shown as a dash, all text is escaped."""
    c, word = F.col, lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    found = F.transform(c("patterns"), lambda p: _row(_text(word(p["pattern_id"])), _text(word(p["stage"])), _text(p["direction"]), _number(p["level"]), _number(p["inval"]), _number(p["target"]), _number(p["quality"], 0)))
    found = F.when(F.coalesce(F.size("patterns"), F.lit(0)) > 0, F.array_join(found, "")).otherwise(F.lit("<tr><td colspan=7>no current pattern</td></tr>"))
    zones = F.concat(*(_row(F.lit(x.replace("_", " ")), _number(c(x)["low"]), _number(c(x)["high"])) for x in ("immediate_support", "immediate_resistance", "major_support", "major_resistance")))
    title = _text(F.concat_ws(" ", "symbol", "timeframe"))
    parts = [
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{STYLE}</style></head><body><h1>"), title, F.lit("</h1><p>Price "), _number(c("close")), F.lit(", change "), _number(c("change_pct")),
        F.lit("%, score "), _number(c("score"), 0), F.lit(" of 100 ("), _text(c("rating")), F.lit(", coverage "), _number(100 * c("coverage"), 0), F.lit("%), timeframes "), _text(word(c("alignment"))), F.lit("</p><h2>Patterns</h2>"),
        _table(("Pattern", "Stage", "Direction", "Level", "Invalidation", "Target", "Quality"), found), F.lit("<h2>Levels</h2>"), _table(("Zone", "Low", "High"), zones), F.lit("<p>Breakout above "), _number(c("breakout_trigger")), F.lit(", breakdown below "),
        _number(c("breakdown_trigger")), F.lit("</p><h2>Setups</h2>"), _table(("Side", "Trigger", "Stop", "Target 1", "Target 2", "Reward to risk", "Confidence"), F.concat(_setup("long"), _setup("short"))),
        F.lit("<h2>Commentary</h2><p>"), _text(c("summary")), F.lit("</p><h3>Conflicts</h3>"), _items(c("conflicts")), F.lit("<h3>What would change it</h3>"), _items(c("changes")), F.lit("<p><b>"), _text(c("conclusion")), F.lit("</b></p></body></html>"),
    ]
    return reports.select(*SERIES, F.concat(*parts).alias("html"))


def write(reports: DataFrame, path: str) -> None:
    """The pages below ``path``, a file in ``symbol=.../timeframe=...`` for each series."""
    documents(reports).repartition(*SERIES).write.partitionBy(*SERIES).text(path)
