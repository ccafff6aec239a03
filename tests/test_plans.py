"""Queries of fields and accounts against their SQL, on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from folia.functions import fields
from folia.operators import planner
from folia.plans import accounts as account_plans
from folia.plans import dictionary as dictionary_plans
from folia.plans import fields as field_plans
from folia.plans import stores as store_plans

FOLDER = "/root/testdata/sf0.001"
PLANS = {name: (plan.QUERIES[name], plan.ORACLE_SQL[name]) for plan in (field_plans, account_plans, dictionary_plans, store_plans) for name in plan.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", sorted(PLANS))
def test_queries_equal_their_sql(spark, duck, name):
    query, sql = PLANS[name]
    got = query(spark, FOLDER)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda every: sorted(repr([plain(v) for v in r]) for r in every)
    assert rows(got.select(*names).collect()) == rows(found.fetchall())


@pytest.mark.parametrize(("hits", "length", "truncated", "groups", "form"), [(9, 4, False, 3, "volume_chaptered"), (9, 5, False, 3, "grouped"), (8, 2, False, 3, "direct"), (0, 2, False, 0, "grouped"), (3, 9, True, 3, "volume_chaptered"), (8, 9, False, 21, "grouped")])
def test_forms_of_a_response(hits, length, truncated, groups, form):
    assert planner.display_mode(hits, length, truncated, groups) == form


def test_page_tokens_and_odd_answers(spark):
    marks = spark.createDataFrame([("１２",), ("（xv）",), ("3001",), ("0",), ("",), (None,)], "t string")
    assert [r.p for r in marks.select(fields.page_token(marks.t).alias("p")).collect()] == ["12", "pre-xv", None, None, None, None]
    texts = spark.createDataFrame([("```\n[1]\n```",), ("x",), ("{'a': 1}",), (None,), ("say {\"a\": \"}\"} or",)], "t string")
    assert [r.j for r in texts.select(fields.json_in(texts.t).alias("j")).collect()] == ["[1]", "{}", "{}", "{}", '{"a":"}"}']


def test_public_addresses(spark):
    ips = spark.createDataFrame([("8.8.8.8",), ("10.1.1.1",), ("::1",), ("2001:4860:4860::8888",), ("",), (None,)], "ip string")
    assert [r.p for r in ips.select(fields.is_public_ip(ips.ip).alias("p")).collect()] == [True, False, False, True, False, False]
