import pytest

from lectern.llm import queries
from tests.oracle import database, same

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    same(QUERIES[name](spark, data), database(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


COLUMNS = {"p1_found": "call_id bigint, start_pos bigint", "p2_found": "call_id bigint, markup string", "p3_found": "call_id bigint, lang string", "p4_found": "call_id bigint, line_no bigint", "p5_found": "call_id_a bigint, call_id_b bigint", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "source string", "p8_found": "doc_id bigint"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert ", ".join(f"{a} {b}" for a, b in QUERIES[name](spark, data).dtypes) == COLUMNS[name]
