"""The dirty micro-fixture: five small CSV files with blank, NULL, typo,
negative and outlier cells, loaded through the CSV reader like real input."""

from __future__ import annotations

import os

from bandwise.plans.reports import OrderLines
from bandwise.sources.bindings import Roles
from bandwise.sources.csv import load_table

TRANSACTIONS = """order_id,user_id,product_id,price,quantity,timestamp,channel
o1,u1,p1,9.99,2,2024-01-01 10:00:00,app
o2,u1,p1,10.00,1,2024-01-01 11:00:00,app
o3,u2,p2,19.99,1,2024-01-02 10:00:00,kiosk
o4,u2,p2,20.00,3,2024-01-02 11:00:00,kiosk
o5,u3,p3,225.00,1,2024-01-03 10:00:00,app
o6,u3,p3,225.01,1,2024-01-03 11:00:00,app
o7,u1,p1,-5.00,1,2024-01-04 10:00:00,app
o8,u1,p1,0,1,2024-01-04 11:00:00,app
o9,u4,p4,30.00,0,2024-01-05 10:00:00,app
o10,u4,p4,abc,1,2024-01-05 11:00:00,app
o11,u9,p9,15.00,1,2024-01-06 10:00:00,app
o12,u5,p5,60.00,2,2024-01-06 11:00:00,
"""

CONSUMERS = """user_id,persona,trend_affinity,age_group,gender_identity,income_bracket,dietary_restriction
u1, fitness ,gut-health ,25-34,female,high,NA
u2,  ,keto,18-24,male,low,None
u3,premium,keto,35-44,female,high,vegan
u4,casual,,45-54,male,middle,
u5,,general,25-34,female,low,halal
"""

PRODUCTS = """product_id,category,claims,ingredient_tags,pack_size
p1,Proten Shake,"High-Protein, keto",whey,single
p2,Protein bar ,"vegan,keto-friendly",,4-pack
p3,,,oats,single
p4,Snack,halal,nuts,12-pack
p5,,low-sugar, ,single
"""

GEOGRAPHY = """order_id,state,city_tier,occasion
o1,CA,Tier 1,gym
o2,CA,Unknown,gym
o3,NY,,festive
o4,NY,Tier 2,festive
o12,TX,Tier 2,
"""

COMPETITORS = """competitor_product_id,price,timestamp
k1,10,2024-01-01
k1,20,2024-01-02
k1,,2024-01-03
k2,40,2024-01-01
"""

FILES = {
    "transactions": TRANSACTIONS,
    "consumer_insights": CONSUMERS,
    "product_metadata": PRODUCTS,
    "geography_occasion": GEOGRAPHY,
    "competitor_pricing": COMPETITORS,
}


def write_csvs(folder: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    paths = {}
    for role, text in {**FILES, **(overrides or {})}.items():
        path = os.path.join(folder, f"{role}.csv")
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(text)
        paths[role] = path
    return paths


def fixture_roles(spark, folder: str, overrides: dict[str, str] | None = None) -> Roles:
    paths = write_csvs(folder, overrides)

    def load(role):
        return lambda: load_table(spark, paths[role], role)

    return Roles(
        transactions=load("transactions"),
        consumers=load("consumer_insights"),
        products=load("product_metadata"),
        geography=load("geography_occasion"),
        competitors=load("competitor_pricing"),
    )


def fixture_lines(spark, folder: str, overrides: dict[str, str] | None = None) -> OrderLines:
    return OrderLines(fixture_roles(spark, folder, overrides))


def rows(df, *cols):
    """Collected rows as tuples of the given columns, in result order."""
    return [tuple(r[c] for c in cols) for r in df.collect()]
