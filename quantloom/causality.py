"""Whether a signal plan uses only what is known at its bar.

Two checks, before a strategy may run:

* ``look_ahead`` reads the analysed plan: every window must be ordered and end at the current row, or make nothing but a column that
  a signal may know ahead (the entry price at the next open); aggregates over a whole series are refused.
* ``prefix_differences`` runs the plan over the series and over the series cut at some bar: signals before the cut must be
  the same, whatever follows; with ``shake`` the bars after the cut are there, but with other prices.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that hold what a signal of a bar may know of the next one: the price it enters at.
ALLOWED = ("entry_price",)
PRICES = ("open", "high", "low", "close")


def _nodes(plan: object) -> list[tuple[str, object]]:
    """(name, node) of a logical plan and all below it; a part that occurs twice is looked at once."""
    found, todo, seen = [], [plan], set()
    while todo:
        node = todo.pop()
        name, kids = node.nodeName(), node.children()
        found.append((name, node))
        for i in range(kids.size()):
            kid = kids.apply(i)
            if (mark := kid.hashCode()) not in seen:
                seen.add(mark)
                todo.append(kid)
    return found


def _texts(expressions: object) -> list[str]:
    return [expressions.apply(i).toString() for i in range(expressions.size())]


def _why(window: str) -> str | None:
    """Why a window expression sees rows after its own, if it does."""
    if not re.search(r" (ASC|DESC) NULLS", window):
        return "a window without an order"
    frame = re.search(r"specifiedwindowframe\((?:RowFrame|RangeFrame), ([^,]+), ([^,]+?)\)\) AS", window)
    if frame is None:
        return "a frame of unknown end"
    end = frame[2].strip("$()")
    return None if end in ("currentrow", "0") or re.fullmatch(r"-\d+", end) else f"a frame that ends at {end}"


def look_ahead(signals: DataFrame, keys: tuple[str, ...] = ("pair",), allowed: tuple[str, ...] = ALLOWED) -> list[str]:
    """What in a plan looks ahead, as text; empty if nothing does."""
    nodes = _nodes(signals._jdf.queryExecution().analyzed())
    found, projects = [], None
    for name, node in nodes:
        if name == "Window":
            for text in _texts(node.windowExpressions()):
                if not (why := _why(text)):
                    continue
                if projects is None:
                    projects = [x for n, p in nodes if n == "Project" for x in _texts(p.projectList()) if " AS " in x]
                column = text.rsplit(" AS ", 1)[1]
                users = [x.rsplit(" AS ", 1)[1].split("#")[0] for x in projects if re.search(rf"(?<!\w){re.escape(column)}(?!\d)", x.rsplit(" AS ", 1)[0])]
                if column.split("#")[0] not in allowed and not (users and all(u in allowed for u in users)):
                    found.append(f"{why}: {text[:120]}")
        elif name == "Aggregate":
            names = {x.split("#")[0] for x in _texts(node.groupingExpressions())}
            if names <= set(keys):
                found.append(f"an aggregate over {sorted(names) or 'all rows'}")
    return found


def prefix_differences(plan: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: int, compare: tuple[str, ...] = ("pair", "bar_idx", "direction", "variant", "filter_value"), shake: bool = False) -> int:
    """How many signals before bar ``cut - 1`` differ between the plan over all bars and over those before the cut.

    The last bar before the cut is left out: its entry price is the open of the next one.  With ``shake`` the second run has the
    later bars too, with every price tripled.
    """
    few = bars.where(F.col("bar_idx") < cut)
    if shake:
        later = bars.where(F.col("bar_idx") >= cut).withColumns({c: F.col(c) * 3 for c in PRICES})
        few = few.unionByName(later)
    whole, part = (plan(x).where(F.col("bar_idx") < cut - 1).select(*compare) for x in (bars, few))
    return whole.exceptAll(part).count() + part.exceptAll(whole).count()
