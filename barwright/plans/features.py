"""Queries of the feature plans, over hourly bars of ``events``."""

from __future__ import annotations

from barwright.operators.features import PLANS
from barwright.plans.registry import ORACLES, query
from barwright.sources.bars import BARS_H1, bars_h1

for _name, _plan in PLANS.items():
    query(_name, _plan.sql(BARS_H1))(lambda spark, sf_dir, plan=_plan: plan.query(bars_h1(spark, sf_dir)))

#: The same by chunks of rows instead of by whole series; chunks this short so that the given tables have many of them.
LONG_ROWS = 128
for _name in ("mom_01", "mom_03", "vlm_03"):
    query(f"{_name}_long", ORACLES[_name])(lambda spark, sf_dir, plan=PLANS[_name]: plan.long_query(bars_h1(spark, sf_dir), LONG_ROWS))
