"""Layout changes no token and is stable."""

import pytest

from strandline.functions.sql_format import format_sql, formatted
from strandline.functions.sql_lexer import parser_tokens

STATEMENTS = [
    "select a,count( * ) as n from db . t o left  outer join u on o.id=u.id where (o.a>1 and b in('x  y',2)) group by a order by n desc limit 10;",
    "with c as (select `A b`, left(x, 2) from t) select case when a then b else c end z from c union all select 1 from (select 2 from q) s",
    "SELECT sum(a) OVER (PARTITION BY b ORDER BY c) FROM t -- gone\n", "select t.`from`, t.order from t", "", "select (", "x",
]


@pytest.mark.parametrize("sql", STATEMENTS)
def test_tokens_and_stability(sql):
    same = lambda text: [t.text.lower() for t in parser_tokens(text)]
    done = format_sql(sql)
    assert same(done) == same(sql) and format_sql(done) == done


def test_layout():
    assert format_sql(STATEMENTS[0]).split("\n") == [
        "SELECT a, count(*) AS n", "FROM db.t o", "LEFT OUTER JOIN u ON o.id = u.id", "WHERE (o.a > 1 AND b IN ('x  y', 2))", "GROUP BY a", "ORDER BY n DESC", "LIMIT 10;",
    ]


def test_column(spark):
    rows = spark.createDataFrame([("select a from t",), (None,)], "s string")
    assert [r[0] for r in rows.select(formatted(rows.s)).collect()] == ["SELECT a\nFROM t", None]
