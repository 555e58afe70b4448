"""One frozen parameter record mirroring the dashboard sidebar."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # review scores that count as a good ("alta") review; the rest is "baixa"
    good_scores: tuple[int, ...] = (3, 4, 5)
    # customer regions to keep; None keeps every row (including NULL region)
    regions: tuple[str, ...] | None = None
    # total_price bounds; None = no price filter
    price_range: tuple[float, float] | None = None
    # True: lo <= x <= hi (dashboard); False: lo < x < hi (small dashboard)
    closed: bool = True
    # categories merged into ``new_category_name`` (the focus category)
    merge_categories: tuple[str, ...] = ()
    new_category_name: str = "cama_mesa_banho"
    top_n: int = 10
    # order statuses kept in the item table; None keeps all
    statuses: tuple[str, ...] | None = ("delivered",)
    # review rule: "both_max" (reference) or "one_row"
    review_mode: str = "both_max"


# Dashboard defaults and the batch-script variant (score 3 is bad there).
DASHBOARD = Params()
SCRIPT = Params(good_scores=(4, 5))
