"""Retail promotion analytics as Spark DataFrame pipelines.

Layers:
  * nightly build  -- clean the sales and promotion feeds, join each promotion
    day with the same day of the year before, write article and category facts;
  * dashboard      -- KPI, daily trend, growth, share, best/worst stores and
    article detail over a promotion scope;
  * commerce       -- order, catalogue, loyalty, voucher and stock reports.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
never collects data to the driver.
"""

__all__ = ["session", "schemas"]
