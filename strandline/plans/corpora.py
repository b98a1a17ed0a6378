"""Statements and a catalog that reach every rule of the analysis, and expressions with their normalised text.

The project's own tables hold no stars, set operations, subqueries or chains of CTEs; these do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: table, column, ordinal
CATALOG = [
    ("sales", "sale_id", 1), ("sales", "shop_id", 2), ("sales", "price", 3), ("shops", "shop_id", 1), ("shops", "city", 2), ("wh.stock", "never", 1), ("stock", "sku", 2), ("stock", "qty", 1), ("stock", "Note", None),
    ("left_t", "a", 1), ("left_t", "k", 2), ("right_t", "b", 1), ("right_t", "k", 2),
]

STATEMENTS = [
    # one table, with and without metadata
    "select c1 from nowhere_t", "select c1 as x, c2 y from nowhere_t", "select nowhere_t.c1 from nowhere_t", "select c1, c2 from db.nowhere_t", "select n.c1 from cat.db.nowhere_t n",
    "select price, sale_id as id from sales", "select lacking from sales", "select s.lacking, s.price from sales s", "select PRICE from sales", "select sku from wh.stock", "select Note, note from stock",
    # qualifiers
    "select z.price from sales s", "select sales.price from sales s", "select s.price, h.city from sales s join shops h on s.shop_id = h.shop_id", "select db.u.c1 from db.u", "select u.c1 from db.u",
    "select x.price from shops x join sales x on 1 = 1", "select x.city from shops x join sales x on 1 = 1", "select sales.city from shops sales join sales t on 1 = 1", "select q.r.c1 from t q",
    # unqualified over several tables
    "select city from sales s join shops h on s.shop_id = h.shop_id", "select shop_id from sales s join shops h on s.shop_id = h.shop_id", "select lacking from sales s join shops h on s.shop_id = h.shop_id",
    "select price from sales s join nowhere_t n on s.sale_id = n.sale_id", "select c1 from nowhere_t n, other_t o", "select city, price, nothing from sales, shops, left_t", "select a, b, k from left_t join right_t using (k)",
    "select price from sales a join sales b on a.sale_id = b.sale_id", "select a.price, b.price as other from sales a left join sales b on a.sale_id = b.sale_id", "select c1 from nowhere_t a cross join nowhere_t b",
    # stars
    "select * from sales", "select * from nowhere_t", "select * from sales s join shops h on s.shop_id = h.shop_id", "select * from sales join nowhere_t on 1 = 1", "select * from nowhere_t join other_t on 1 = 1",
    "select s.* from sales s", "select sales.* from sales", "select s.* from nowhere_t s", "select z.* from sales s", "select sales.* from sales s", "select h.city, s.*, price + 1 as p from sales s join shops h on 1 = 1",
    "select lacking, * from sales", "select *, h.*, count(*) as n from shops h", "select * from stock", "select * from sales a join sales b on 1 = 1", "select a.*, b.* from sales a join sales b on 1 = 1", "select * from left_t, right_t, sales",
    "select city, *, z.q, upper(city) from sales s, shops h, nowhere_t n",
    # expressions
    "select count(*) as cnt from sales", "select city, count(shop_id) as n from shops group by city", "select price + 1, price * 2 as double_price from sales", "select case when price > 1 then 'a' else 'b' end as k from sales",
    "select cast(price as integer) as p, coalesce(price, 0) from sales", "select distinct city from shops", "select sum(price) over (partition by shop_id) as t, price from sales", "select 'text' as c, 1, null from sales",
    # nothing to read from
    "select 1", "select 1 as one, 'x' as two",
    # subqueries and set operations
    "select a from (select a from left_t) q", "select q.a, b from (select a from left_t) q join right_t r on 1 = 1", "select a from left_t where k in (select k from right_t)", "select (select max(b) from right_t) as m from left_t",
    "select a from left_t where exists (select 1 from right_t where right_t.k = left_t.k)", "select a from left_t union all select b from right_t", "select a from left_t union select a from left_t", "select a from nowhere_t except select b from other_t",
    # CTEs
    "with c as (select a from left_t) select a from c", "with c as (select a, k from left_t), d as (select a from c join right_t on c.k = right_t.k) select a from d", "with c as (select a from left_t), d as (select a from c), e as (select a from d) select e.a, r.b from e join right_t r on 1 = 1",
    "with c as (select a from left_t), d as (select b from right_t) select a, b from c, d, sales", "with c as (select 1 as x) select x from c", "with c as (select a from left_t) select price from sales", "with c as (select * from left_t join left_t on 1 = 1) select c1.a, c2.a from c c1 join c c2 on 1 = 1",
    "WITH c as (select count(*) n from db.left_t) select n from c", "  with c as (select a from left_t) select a from c", "with\nc as (select a from left_t) select a from c", "with c as (select a from left_t), unused as (select b from db.right_t) select count(a) as n from c",
    # spelling
    "SELECT Price FROM Sales", "select\n  price\n  ,shop_id\nfrom sales ;", "select `price` as `the price` from `sales`", "select price from sales where price > 1 and city is not null order by price limit 3", "select s.price from sales as s where s.price between 1 and 2 group by s.price having count(*) > 1",
    # not one query
    "select from", "", "   ", "select a from left_t where", "select a b c from left_t", "select a from left_t join", "selec a from left_t", "select (a from left_t", "select a,, b from left_t",
]
#: Places of statements of STATEMENTS that are asked for again without a graph.
WITHOUT_GRAPH = (0, 5, 30, 49, 69, 80)

REQUESTS = [(k, q, "spark", True) for k, q in enumerate(STATEMENTS)] + [(1000 + k, STATEMENTS[k], "hive", False) for k in WITHOUT_GRAPH]

#: expression as written, as rendered
EXPRESSIONS = [
    ("count(*)", "COUNT(*)"), ("Count( a )", "COUNT(a)"), ("count(distinct a)", "COUNT(DISTINCT a)"), ("sum(a)/nullif(sum(b),0)", "SUM(a) / NULLIF(SUM(b), 0)"), ("a+b*2", "a + b * 2"), ("(a+b)*2", "(a + b) * 2"), ("a!=b", "a <> b"), ("a==b", "a = b"),
    ("case when a>1 then 'x' else 'y' end", "CASE WHEN a > 1 THEN 'x' ELSE 'y' END"), ("case a when 1 then 2 end", "CASE a WHEN 1 THEN 2 END"), ("cast(a as integer)", "CAST(a AS INT)"), ("cast(a as decimal(18,2))", "CAST(a AS DECIMAL(18, 2))"), ("a is not null", "NOT a IS NULL"), ("not a", "NOT a"),
    ("a in (1,2)", "a IN (1, 2)"), ("a between 1 and 2", "a BETWEEN 1 AND 2"), ("a like 'x%'", "a LIKE 'x%'"), ("a and b or c", "a AND b OR c"), ("-a", "-a"), ("t.a", "t.a"), ("`t`.`a`", "`t`.`a`"), ("1.50", "1.50"), ("'it''s'", "'it''s'"), ("null", "NULL"), ("true", "TRUE"), ("coalesce(a,'x')", "COALESCE(a, 'x')"), ("a||b", "a || b"),
]


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, "sql_id long, sql string, dialect string, include_graph boolean")


def catalog(spark: SparkSession) -> DataFrame:
    """Rows as ``operators.catalog.latest_columns`` gives them, for ``columns_by_name``."""
    return spark.createDataFrame(CATALOG, "table_name string, name string, ordinal int")


def expressions(spark: SparkSession) -> DataFrame:
    rows = [(k, f"select {written} as x from t", "spark", True) for k, (written, _) in enumerate(EXPRESSIONS)]
    return spark.createDataFrame(rows, "sql_id long, sql string, dialect string, include_graph boolean")
