"""Layer A: the nightly clean and year-over-year build as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promolens.operators.clean import clean_promo, clean_sales
from promolens.operators.yoy import DAILY_STORE_CATEGORY_GRAIN, MONTHLY_ARTICLE_GRAIN, REFERENCE_GRAIN, category_facts
from promolens.plans.common import facts_from_tables, present
from promolens.sources.fixtures import raw_feed


def q_clean_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(clean_sales(raw_feed(spark, sf_dir)))


def q_clean_promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(clean_promo(raw_feed(spark, sf_dir)))


def q_article_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(facts_from_tables(spark, sf_dir, REFERENCE_GRAIN))


def q_category_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(category_facts(facts_from_tables(spark, sf_dir, REFERENCE_GRAIN)))


def q_article_growth_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(facts_from_tables(spark, sf_dir, MONTHLY_ARTICLE_GRAIN))


def q_category_growth_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(category_facts(facts_from_tables(spark, sf_dir, MONTHLY_ARTICLE_GRAIN)))


def q_article_growth_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article facts against the store's category on the same day last year."""
    return present(facts_from_tables(spark, sf_dir, DAILY_STORE_CATEGORY_GRAIN))


def q_category_growth_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(category_facts(facts_from_tables(spark, sf_dir, DAILY_STORE_CATEGORY_GRAIN)))
