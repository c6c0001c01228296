"""Registered queries over the driver's tables, each with SQL that computes the same from first principles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import texts
from .operators import documents, grids, infer, investigate, repair, reports, series
from .operators.profile import profile
from .operators.workbook import Workbook
from .sources import corpus

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
 CAST(l_discount AS DECIMAL(6,2)) AS disc, CAST(l_tax AS DECIMAL(6,2)) AS tax, CAST(l_shipdate AS DATE) AS ship, l_returnflag, l_linestatus FROM lineitem)"""
ORD = "o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(14,2)) AS total, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("decimal(12,2)").alias("qty"), F.col("l_extendedprice").cast("decimal(14,2)").alias("price"),
        F.col("l_discount").cast("decimal(6,2)").alias("disc"), F.col("l_tax").cast("decimal(6,2)").alias("tax"), F.col("l_shipdate").cast("date").alias("ship"), "l_returnflag", "l_linestatus",
    )


def _orders(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(14,2)").alias("total"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")


def _parts(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("decimal(6,0)").alias("size"), F.col("p_retailprice").cast("decimal(12,2)").alias("retail"))


def _customers(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))


def _rules(spark, frame, formulas: str, *keep: str) -> DataFrame:
    """The kept columns and all rules of one sheet, errors included."""
    run = Workbook(spark).sheet("t", frame, formulas).run()
    table = run.table("t")
    return table.select(*[c for c in table.columns if c in keep])


def _scalars(spark, sheets: dict, **more) -> DataFrame:
    book = Workbook(spark)
    for name, (frame, formulas) in sheets.items():
        book.sheet(name, frame, formulas, **more.get(name, {}))
    return book.run().values()


# column rules


@query(f"WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, price, CAST(ROUND(price * (1 - disc), 2) AS DECIMAL(18,2)) AS net FROM li")
def rule_net(spark, sf_dir):
    run = _rules(spark, _lineitem(spark, sf_dir), "net precision 2 = price * (1 - disc)", "l_orderkey", "l_linenumber", "l_partkey", "price", "net")
    return run.withColumn("net", F.col("net").cast("decimal(18,2)"))


@query(
    f"WITH {LI}, n AS (SELECT *, CAST(ROUND(price * (1 - disc), 2) AS DECIMAL(18,2)) AS net FROM li), v AS (SELECT *, CAST(ROUND(net * tax, 2) AS DECIMAL(18,2)) AS vat FROM n) "
    "SELECT l_orderkey, l_partkey, net, vat, CAST(net + vat AS DECIMAL(18,2)) AS gross FROM v"
)
def rule_chain(spark, sf_dir):
    out = _rules(spark, _lineitem(spark, sf_dir), "net precision 2 = price * (1 - disc)\nvat precision 2 = net * tax\ngross = net + vat", "l_orderkey", "l_partkey", "net", "vat", "gross")
    return out.select("l_orderkey", "l_partkey", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("net", "vat", "gross")])


@query(
    f"WITH {LI}, s AS (SELECT SUM(price) AS total FROM li) SELECT l_orderkey, l_partkey, l_linenumber, price, CAST(ROUND(CAST(price * 100000 AS DECIMAL(38,20)) / total, 4) AS DECIMAL(18,4)) AS share FROM li, s"
)
def share_of_total(spark, sf_dir):
    out = _rules(spark, _lineitem(spark, sf_dir), "share precision 4 = price * 100000 / SUM(price)", "l_orderkey", "l_partkey", "l_linenumber", "price", "share")
    return out.withColumn("share", F.col("share").cast("decimal(18,4)"))


@query(
    f"WITH {LI}, x AS (SELECT *, CAST(ROUND(price * (1 - disc), 2) AS DECIMAL(18,2)) AS net FROM li), y AS (SELECT *, CAST(net + CASE WHEN l_partkey % 97 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS stored FROM x) "
    "SELECT CAST(l_orderkey AS VARCHAR) AS row_label, CAST(stored AS VARCHAR) AS stored, CAST(net AS VARCHAR) AS computed FROM y WHERE stored <> net"
)
def stale_detect(spark, sf_dir):
    frame = _stale_sheet(spark, sf_dir)
    return Workbook(spark).sheet("lines", frame, "net precision 2 = price * (1 - disc)", label="l_orderkey").run().findings().filter("code = 'STALE'").select("row_label", "stored", "computed")


def _stale_sheet(spark, sf_dir) -> DataFrame:
    frame = _lineitem(spark, sf_dir)
    net = F.round(F.col("price") * (1 - F.col("disc")), 2)
    return frame.withColumn("net", (net + F.when(F.col("l_partkey") % 97 == 0, F.lit(Decimal("0.01"))).otherwise(Decimal("0.00"))).cast("decimal(18,2)"))


@query("SELECT 'STALE' AS code, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem WHERE l_partkey % 97 = 0 HAVING COUNT(*) > 0")
def stale_summary(spark, sf_dir):
    found = Workbook(spark).sheet("lines", _stale_sheet(spark, sf_dir), "net precision 2 = price * (1 - disc)").run().findings()
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# reduces and scalars

_SCALARS = f"""WITH {LI}, {ORD}, a AS (SELECT SUM(qty) AS s, COUNT(*) AS n, MIN(price) AS lo, MAX(price) AS hi FROM li)
SELECT 'lines' AS sheet, 'total' AS name, CAST(s AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM a UNION ALL
SELECT 'lines', 'mean', CAST(CAST(ROUND(CAST(s AS DECIMAL(38,12)) / n, 4) AS DECIMAL(18,4)) AS VARCHAR), NULL FROM a UNION ALL
SELECT 'lines', 'least', CAST(lo AS VARCHAR), NULL FROM a UNION ALL SELECT 'lines', 'most', CAST(hi AS VARCHAR), NULL FROM a UNION ALL SELECT 'lines', 'n', CAST(n AS VARCHAR), NULL FROM a"""


@query(_SCALARS)
def scalar_reduces(spark, sf_dir):
    return _scalars(spark, {"lines": (_lineitem(spark, sf_dir), "total = SUM(qty)\nmean precision 4 = AVG(qty)\nleast = MIN(price)\nmost = MAX(price)\nn = COUNT(qty)")})


@query(f"WITH {ORD} SELECT 'o' AS sheet, 'first' AS name, CAST(MIN(day) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM o UNION ALL SELECT 'o', 'last', CAST(MAX(day) AS VARCHAR), NULL FROM o UNION ALL SELECT 'o', 'days', CAST(MAX(day) - MIN(day) AS VARCHAR), NULL FROM o")
def scalar_dates(spark, sf_dir):
    return _scalars(spark, {"o": (_orders(spark, sf_dir), "first = MIN(day)\nlast = MAX(day)\ndays = last - first")})


@query(f"WITH {LI}, {ORD} SELECT 'recon' AS sheet, 'gap' AS name, CAST((SELECT SUM(price) FROM li) - (SELECT SUM(total) FROM o) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error")
def cross_sheet_sum(spark, sf_dir):
    return _scalars(spark, {"lines": (_lineitem(spark, sf_dir), ""), "o": (_orders(spark, sf_dir), ""), "recon": (None, "gap = SUM(lines.price) - SUM(o.total)")})


@query(f"WITH {LI}, {ORD}, t AS (SELECT SUM(price) AS s FROM li) SELECT o_orderkey, total, CAST(total - ROUND(CAST(t.s AS DECIMAL(38,6)) * 0.00001, 2) AS DECIMAL(24,2)) AS over FROM o, t")
def cross_sheet_rule(spark, sf_dir):
    book = Workbook(spark).sheet("lines", _lineitem(spark, sf_dir), "bar precision 2 = SUM(price) * 0.00001").sheet("o", _orders(spark, sf_dir), "over precision 2 = total - lines.bar")
    return book.run().table("o").select("o_orderkey", "total", F.col("over").cast("decimal(24,2)").alias("over"))


@query(f"WITH {LI} SELECT 'lines' AS sheet, 'SUM(price) > SUM(qty)' AS text, (SELECT SUM(price) > SUM(qty) FROM li) AS holds UNION ALL SELECT 'lines', 'MAX(disc) < 0.05', (SELECT MAX(disc) < 0.05 FROM li)")
def assert_balance(spark, sf_dir):
    run = Workbook(spark).sheet("lines", _lineitem(spark, sf_dir), "assert SUM(price) > SUM(qty)\nassert MAX(disc) < 0.05").run()
    return spark.createDataFrame(run.assertions(), "sheet string, text string, holds boolean")


@query(f"WITH {ORD}, m AS (SELECT MIN(o_orderkey) AS first FROM o) SELECT 'f' AS sheet, 'value' AS name, CAST(CAST(ROUND(SUM(CAST(total AS DOUBLE) / power(1.001, o_orderkey - first))) AS BIGINT) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM o, m")
def npv_orders(spark, sf_dir):
    """Orders as a series of flows in the order of their keys, which have no gaps."""
    return _scalars(spark, {"f": (_orders(spark, sf_dir), "value precision 0 = NPV(0.001, total)")}, f={"order_by": "o_orderkey"})


# functions


_YEARS = f"WITH {ORD}, f AS (SELECT o_custkey, year(day) AS y, CAST(SUM(total) AS DECIMAL(18,2)) AS v FROM o GROUP BY o_custkey, year(day)), g AS (SELECT o_custkey, MIN(y) AS lo, MAX(y) - MIN(y) + 1 = COUNT(*) AS whole FROM f GROUP BY o_custkey)"


@query(
    f"{_YEARS} SELECT o_custkey, CASE WHEN whole THEN CAST(ROUND(SUM(v * CASE y - lo " + " ".join(f"WHEN {k} THEN {Decimal('0.8') ** k:.8f}" for k in range(9)) + " END), 2) AS DECIMAL(38,2)) END AS npv, CASE WHEN NOT whole THEN 'TYPE' END AS error FROM f JOIN g USING (o_custkey) GROUP BY o_custkey, whole"
)
def npv_by_customer(spark, sf_dir):
    """The present value of each customer's years at 25 %; a customer with a year left out is refused, not the others."""
    flows = _orders(spark, sf_dir).groupBy("o_custkey", F.year("day").alias("y")).agg(F.sum("total").alias("v"))
    return series.present_values(flows, ["o_custkey"], "y", "v", Decimal("0.25"))


@query(f"WITH {ORD} SELECT o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN CAST((o_custkey % 20 + 1) / 100.0 AS DECIMAL(38,6)) END AS irr, CASE WHEN o_custkey % 7 = 0 THEN 'TYPE' END AS error FROM o GROUP BY o_custkey")
def irr_project(spark, sf_dir):
    """The rate of return of a loan to each customer: what they ordered is lent, interest comes with each order and the loan back with the last, which is a period late for every seventh."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "total")
    orders = _orders(spark, sf_dir).withColumn("k", F.row_number().over(w))
    loans = orders.groupBy("o_custkey").agg((F.floor(F.sum("total")) * 100 + 100).cast("decimal(24,2)").alias("lent"), F.max("k").alias("n"))
    interest = (F.col("lent") * (F.col("o_custkey") % 20 + 1) / 100).cast("decimal(24,2)")
    final = F.col("k") == F.col("n")
    paid = orders.select("o_custkey", "k").join(loans, "o_custkey").select("o_custkey", F.when(final & (F.col("o_custkey") % 7 == 0), F.col("k") + 1).otherwise(F.col("k")).alias("k"), (interest + F.when(final, F.col("lent")).otherwise(0)).alias("v"))
    flows = paid.unionByName(loans.select("o_custkey", F.lit(0).alias("k"), (-F.col("lent")).alias("v")))
    return series.rates_of_return(flows, ["o_custkey"], "k", "v")


@query(
    """WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer)
SELECT c_custkey, CAST(ROUND(bal, 1) AS DECIMAL(20,1)) AS r1, CAST(ABS(bal) AS DECIMAL(20,2)) AS a, CAST(bal % 7.5 AS DECIMAL(20,2)) AS m,
 CAST(bal - (((bal % 25) + 25) % 25) AS DECIMAL(20,2)) AS f, CAST(-((-bal) - ((((-bal) % 25) + 25) % 25)) AS DECIMAL(20,2)) AS c,
 CAST(CASE WHEN bal < 0 THEN 0.00 ELSE bal END AS DECIMAL(20,2)) AS i FROM c"""
)
def fn_exact(spark, sf_dir):
    text = "r1 = ROUND(bal, 1)\na = ABS(bal)\nm = MOD(bal, 7.5)\nf precision 2 = FLOOR(bal, 25)\nc precision 2 = CEILING(bal, 25)\ni = IF(bal < 0, 0, bal)"
    out = Workbook(spark).sheet("t", _customers(spark, sf_dir), text).run().table("t")
    return out.select("c_custkey", F.col("r1").cast("decimal(20,1)").alias("r1"), *[F.col(x).cast("decimal(20,2)").alias(x) for x in ("a", "m", "f", "c", "i")])


@query("SELECT p_partkey, CAST(ROUND(sqrt(CAST(p_retailprice AS DOUBLE)), 4) AS DECIMAL(20,4)) AS root, CAST(((20 * CAST(ROUND(p_retailprice * 100) AS BIGINT) + p_size) // (2 * p_size)) * 0.001 AS DECIMAL(20,3)) AS per FROM part WHERE p_size > 0")
def fn_wide(spark, sf_dir):
    frame = _parts(spark, sf_dir).filter("size > 0")
    out = Workbook(spark).sheet("t", frame, "root precision 4 = SQRT(retail)\nper precision 3 = retail / size").run().table("t")
    return out.select("p_partkey", F.col("root").cast("decimal(20,4)").alias("root"), F.col("per").cast("decimal(20,3)").alias("per"))


@query("SELECT p_partkey, CAST(ROUND(CAST(p_retailprice AS DOUBLE) * 0.005 / (1 - power(1.005, -36)), 2) AS DECIMAL(20,2)) AS pay FROM part")
def fn_pmt(spark, sf_dir):
    out = Workbook(spark).sheet("t", _parts(spark, sf_dir), "pay precision 2 = PMT(0.005, 36, retail)").run().table("t")
    return out.select("p_partkey", F.col("pay").cast("decimal(20,2)").alias("pay"))


@query("SELECT p_partkey, CAST(CAST(p_size AS DECIMAL(6,0)) * p_size * p_size AS DECIMAL(24,0)) AS cube, CAST(-(p_size * p_size) AS DECIMAL(24,0)) AS neg FROM part")
def fn_power(spark, sf_dir):
    out = _rules(spark, _parts(spark, sf_dir), "cube = size ^ 3\nneg = -size ^ 2", "p_partkey", "cube", "neg")
    return out.select("p_partkey", *[F.col(c).cast("decimal(24,0)").alias(c) for c in ("cube", "neg")])


@query("SELECT p_partkey, CAST(CASE WHEN (p_size > 10 AND NOT p_size >= 40) OR p_size = 1 OR p_name = 'x' THEN 1 ELSE 0 END AS DECIMAL(10,0)) AS flag FROM part")
def ops_logic(spark, sf_dir):
    out = _rules(spark, _parts(spark, sf_dir), 'flag = IF(size > 10 and not size >= 40 or size == 1 or p_name == "x", 1, 0)', "p_partkey", "flag")
    return out.withColumn("flag", F.col("flag").cast("decimal(10,0)"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % (p_size % 5) END AS DECIMAL(10,0)) AS left_over, CASE WHEN p_size % 5 = 0 THEN 'TYPE' END AS error FROM part")
def eager_errors(spark, sf_dir):
    """A zero divisor in the branch that isn't taken is an error all the same."""
    out = Workbook(spark).sheet("t", _parts(spark, sf_dir), "left_over = IF(MOD(size, 5) == 0, 0, MOD(size, MOD(size, 5)))").run().table("t")
    return out.select("p_partkey", F.col("left_over").cast("decimal(10,0)").alias("left_over"), F.col("left_over_error").alias("error"))


@query(f"WITH {ORD} SELECT o_orderkey, o_custkey, total, day + 30 AS due, last_day(day) AS month_end, last_day(CAST(day + INTERVAL 2 MONTH AS DATE)) AS quarter_end, CAST(day - DATE '1995-01-01' AS BIGINT) AS age FROM o")
def dates(spark, sf_dir):
    text = "due = day + 30\nmonth_end = EOMONTH(day, 0)\nquarter_end = EOMONTH(day, 2)\nage = day - 1995-01-01"
    out = Workbook(spark).sheet("t", _orders(spark, sf_dir), text).run().table("t")
    return out.select("o_orderkey", "o_custkey", "total", "due", "month_end", "quarter_end", F.col("age").cast("long").alias("age"))


# cell texts

_TEXT = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '$' || CAST(bal AS VARCHAR) WHEN 1 THEN CAST(bal AS VARCHAR) || ' kg' WHEN 2 THEN CAST(bal AS VARCHAR) || '%' WHEN 3 THEN 'n/a' WHEN 4 THEN '1995-06-17' ELSE CAST(bal AS VARCHAR) END"


def _texts(spark, sf_dir) -> DataFrame:
    bal, k = F.col("bal").cast("string"), F.col("c_custkey") % 6
    text = F.when(k == 0, F.concat(F.lit("$"), bal)).when(k == 1, F.concat(bal, F.lit(" kg"))).when(k == 2, F.concat(bal, F.lit("%"))).when(k == 3, "n/a").when(k == 4, "1995-06-17").otherwise(bal)
    return _customers(spark, sf_dir).select("c_custkey", "bal", text.alias("t"))


@query(
    f"""WITH c AS (SELECT c_custkey, CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS bal FROM customer), t AS (SELECT c_custkey, bal, {_TEXT} AS t FROM c)
SELECT c_custkey, CAST(CASE WHEN c_custkey % 6 IN (3, 4) THEN NULL WHEN c_custkey % 6 = 2 THEN bal / 100 ELSE bal END AS DECIMAL(20,4)) AS value,
 CASE WHEN c_custkey % 6 IN (3, 4) THEN NULL WHEN c_custkey % 6 = 2 THEN 4 ELSE 2 END AS places,
 CASE c_custkey % 6 WHEN 0 THEN '$|' WHEN 1 THEN '|kg' WHEN 2 THEN '|%' WHEN 5 THEN '|' END AS decoration,
 CASE c_custkey % 6 WHEN 3 THEN 'str' WHEN 4 THEN 'date' ELSE 'num' END AS kind FROM t"""
)
def coerce_text(spark, sf_dir):
    frame = _texts(spark, sf_dir)
    positive = F.regexp_replace("t", "^(\\$?)-", "$1")
    frame = frame.withColumn("t", positive)
    t = F.col("t")
    return frame.select("c_custkey", texts.number(t).cast("decimal(20,4)").alias("value"), texts.places(t).alias("places"), texts.decoration(t).alias("decoration"), texts.kind_of(t).alias("kind"))


@query(
    f"""WITH {ORD}, t AS (SELECT o_orderkey, o_custkey, day, EXTRACT(day FROM day) AS d, EXTRACT(month FROM day) AS m FROM o)
SELECT o_orderkey, o_custkey, CASE WHEN d = m THEN 'same' WHEN d <= 12 THEN 'ambiguous' ELSE 'decidable' END AS reading FROM t"""
)
def date_diagnose(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "o_custkey", texts.date_reading(F.date_format("day", "d/M/yyyy")).alias("reading"))


@query(
    """WITH c AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer)
SELECT c_custkey, CAST(CAST(ROUND(bal, 1) AS DECIMAL(20,1)) AS VARCHAR) AS fixed, CAST(CAST(ROUND(bal * 100, 1) AS DECIMAL(20,1)) AS VARCHAR) || '%' AS pct,
 replace(c_name || ' x', ' ', '&nbsp;') AS nbsp, CASE WHEN bal < 0 THEN '-$' || CAST(-bal AS VARCHAR) ELSE '$' || CAST(bal AS VARCHAR) END AS dollars FROM c"""
)
def display_rules(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return c.select("c_custkey", texts.fixed(F.col("bal"), 1).alias("fixed"), texts.percent(F.col("bal"), 3).alias("pct"), texts.nbsp(F.concat("c_name", F.lit(" x"))).alias("nbsp"), texts.with_prefix(F.col("bal").cast("string"), "$").alias("dollars"))


@query(
    "WITH c AS (SELECT c_custkey, c_custkey % 3 AS d, CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) AS VARCHAR) AS b FROM customer), t AS (SELECT c_custkey, d, CASE d WHEN 0 THEN '$' || b WHEN 1 THEN b || '%' ELSE b END AS x FROM c), f AS (SELECT arg_min(d, c_custkey) AS first FROM t) "
    "SELECT CAST(MAX(CASE d WHEN 1 THEN 4 ELSE 2 END) AS INT) AS width, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT d) AS BIGINT) AS decorations, CAST(COUNT(*) AS BIGINT) AS nums, MIN(c_custkey) FILTER (d <> first) AS deviant_at, arg_min(x, c_custkey) FILTER (d <> first) AS deviant FROM t, f"
)
def column_profile(spark, sf_dir):
    """Width, number of different decorations, numbers and the first cell that is decorated unlike those before it, of a text column."""
    bal, k = F.abs("bal").cast("string"), F.col("c_custkey") % 3
    frame = _customers(spark, sf_dir).select("c_custkey", F.when(k == 0, F.concat(F.lit("$"), bal)).when(k == 1, F.concat(bal, F.lit("%"))).otherwise(bal).alias("t"))
    return profile(frame, ["t"], "c_custkey").select("width", "n", "decorations", "nums", "deviant_at", "deviant")


# sweeps

_GRID = [grids.Param("d", Decimal("0.00"), Decimal("0.05"), 3), grids.Param("t", Decimal("0.00"), Decimal("0.02"), 4)]
_GRID_SQL = f"""{LI}, g AS (SELECT a.i * 4 + b.i + 1 AS q_ix, CAST(a.i * 0.05 AS DECIMAL(20,2)) AS d, CAST(b.i * 0.02 AS DECIMAL(20,2)) AS t FROM range(3) a(i), range(4) b(i)),
 ans AS (SELECT q_ix, d, t, CAST(SUM(ROUND(price * (1 - d) * (1 + t), 2)) AS DECIMAL(38,2)) AS revenue FROM li, g GROUP BY ALL),
 base AS (SELECT revenue AS b FROM ans WHERE q_ix = 1), lim AS (SELECT CAST(ROUND(b * 0.97, 2) AS DECIMAL(38,2)) AS low FROM base),
 x AS (SELECT ans.*, revenue >= low AS a0, d + t <= 0.11 AS a1, low FROM ans, lim), y AS (SELECT *, a0 AND a1 AS feasible FROM x)"""


def _answers(spark, sf_dir) -> tuple[DataFrame, Decimal]:
    got = grids.sheet_answers(_lineitem(spark, sf_dir), {"net": ("price * (1 - d) * (1 + t)", 2)}, {"revenue": "SUM(net)"}, _GRID)
    base = grids.sheet_answers(_lineitem(spark, sf_dir), {"net": ("price * (1 - d) * (1 + t)", 2)}, {"revenue": "SUM(net)"}, [grids.Param("d", Decimal("0.00"), Decimal("0.05"), 1), grids.Param("t", Decimal("0.00"), Decimal("0.02"), 1)]).first().revenue
    low = (base * Decimal("0.97")).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    return grids.with_assertions(got, [f"revenue >= {low}", "d + t <= 0.11"]), base


@query("SELECT CAST(s * 4 + t + 1 AS BIGINT) AS q_ix, CAST(s * 0.05 AS DECIMAL(20,2)) AS d, CAST(t * 0.02 AS DECIMAL(20,2)) AS t FROM range(0, (SELECT COUNT(*) FROM supplier)) x(s), range(0, 4) y(t)")
def grid(spark, sf_dir):
    """A grid of a point for each supplier and four rates."""
    n = _read(spark, sf_dir, "supplier").count()
    return grids.questions(spark, [grids.Param("d", Decimal("0.00"), Decimal("0.05"), n), grids.Param("t", Decimal("0.00"), Decimal("0.02"), 4)])


@query(f"WITH {_GRID_SQL} SELECT q_ix, d, t, revenue FROM ans")
def sweep_answers(spark, sf_dir):
    return _answers(spark, sf_dir)[0].select("q_ix", "d", "t", "revenue")


@query(
    f"WITH {LI}, q AS (SELECT a * 20 + b + 1 AS q_ix, CAST(a * 0.01 AS DECIMAL(20,2)) AS d, CAST(b * 0.005 AS DECIMAL(20,3)) AS t FROM range(0, 25) x(a), range(0, 20) y(b)) "
    "SELECT CAST(q_ix AS BIGINT) AS q_ix, d, t, CAST(SUM(CAST(ROUND(price * (1 - CAST(d AS DECIMAL(4,2))) * (1 + CAST(t AS DECIMAL(4,3))), 2) AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue, CAST(MAX(CAST(ROUND(price * (1 - CAST(d AS DECIMAL(4,2))) * (1 + CAST(t AS DECIMAL(4,3))), 2) AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS most FROM q, li GROUP BY q_ix, d, t"
)
def sweep_fine(spark, sf_dir):
    """A grid of 500 questions over all lines, each line rounded under each question, from two scans of the lines."""
    params = [grids.Param("d", Decimal("0.00"), Decimal("0.01"), 25), grids.Param("t", Decimal("0.000"), Decimal("0.005"), 20)]
    return grids.sheet_answers(_lineitem(spark, sf_dir), {"net": ("price * (1 - d) * (1 + t)", 2)}, {"revenue": "SUM(net)", "most": "MAX(net)"}, params)


@query(f"WITH {_GRID_SQL} SELECT q_ix, d, t, feasible, concat_ws('; ', CASE WHEN NOT a0 THEN 'low' END, CASE WHEN NOT a1 THEN 'sum' END) AS broken FROM y")
def sweep_ledger(spark, sf_dir):
    return grids.ledger(_answers(spark, sf_dir)[0], _GRID, ["low", "sum"])


@query(f"WITH {_GRID_SQL} SELECT CAST(0 AS INT) AS assert_ix, 'low' AS text, CAST(COUNT(*) FILTER (a0) AS BIGINT) AS holds, CAST(COUNT(*) FILTER (NOT a0) AS BIGINT) AS fails, MIN(q_ix) FILTER (NOT a0) AS first_failure FROM y UNION ALL SELECT 1, 'sum', CAST(COUNT(*) FILTER (a1) AS BIGINT), CAST(COUNT(*) FILTER (NOT a1) AS BIGINT), MIN(q_ix) FILTER (NOT a1) FROM y")
def sweep_gates(spark, sf_dir):
    return grids.gates(_answers(spark, sf_dir)[0], ["low", "sum"])


@query(f"WITH {_GRID_SQL} SELECT 'revenue' AS scalar, CAST(b AS DECIMAL(30,2)) AS base, CAST(MIN(revenue) AS DECIMAL(30,2)) AS low, arg_min(q_ix, revenue) AS low_q, CAST(MAX(revenue) AS DECIMAL(30,2)) AS high, arg_max(q_ix, revenue) AS high_q, CAST(COUNT(*) AS BIGINT) AS n FROM y, base GROUP BY b")
def sweep_deltas(spark, sf_dir):
    got, base = _answers(spark, sf_dir)
    return grids.deltas(got, ["revenue"], {"revenue": base})


@query(f"WITH {_GRID_SQL}, m AS (SELECT MAX(revenue) AS v FROM y WHERE feasible) SELECT MIN(q_ix) AS q_ix, revenue, CAST(COUNT(*) AS BIGINT) AS ties FROM y, m WHERE feasible AND revenue = v GROUP BY revenue")
def sweep_best(spark, sf_dir):
    return grids.best(_answers(spark, sf_dir)[0], "revenue")


@query(f"WITH {_GRID_SQL}, u AS (SELECT 'd' AS param, CAST(d AS DECIMAL(20,6)) AS point, feasible FROM y UNION ALL SELECT 't', CAST(t AS DECIMAL(20,6)), feasible FROM y) SELECT param, point FROM u GROUP BY ALL HAVING NOT bool_or(feasible)")
def sweep_forbidden(spark, sf_dir):
    return grids.forbidden(_answers(spark, sf_dir)[0], _GRID)


@query(f"WITH {_GRID_SQL}, s AS (SELECT q_ix, abs(0.11 - d - t) AS dist, CASE WHEN feasible THEN 'room' WHEN NOT a1 AND a0 THEN 'miss' END AS side FROM y) SELECT CAST(1 AS INT) AS assert_ix, side, CAST(MIN(dist) AS DECIMAL(30,6)) AS distance, arg_min(q_ix, dist * 1000 + q_ix * 0.000001) AS q_ix FROM s WHERE side IS NOT NULL GROUP BY side")
def sweep_slack(spark, sf_dir):
    got, _ = _answers(spark, sf_dir)
    return grids.slack(got, {1: (F.lit(Decimal("0.11")) - F.col("d") - F.col("t"), "<=")}, 2)


@query(f"WITH {LI} SELECT 'lines' AS sheet, 'net_total' AS name, CAST(SUM(ROUND(price * 0.93, 2)) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM li UNION ALL SELECT '', 'cut', '0.07', NULL")
def scenario_override(spark, sf_dir):
    book = Workbook(spark).sheet("", None, "param cut precision 2 in [0%, 10%] lattice 1% = default 5%")
    book.sheet("lines", _lineitem(spark, sf_dir), "net precision 2 = price * (1 - cut)\nnet_total = SUM(net)")
    return book.run({"cut": Decimal("0.07")}).values()


# inference


def _invoice(spark, sf_dir) -> DataFrame:
    x = _lineitem(spark, sf_dir).select("l_orderkey", F.col("qty"), F.col("price"), (F.col("qty") * F.col("price")).cast("decimal(18,2)").alias("a"), (F.col("qty") + F.col("price")).cast("decimal(18,2)").alias("b"), (F.col("price") * Decimal("0.08")).cast("decimal(18,2)").alias("c"))
    return x


_INV = f"{LI}, x AS (SELECT l_orderkey, qty, price, CAST(ROUND(qty * price, 2) AS DECIMAL(18,2)) AS a, CAST(qty + price AS DECIMAL(18,2)) AS b, CAST(ROUND(price * 0.08, 2) AS DECIMAL(18,2)) AS c FROM li)"


#: a / column in hundredths, rounded half up (all are positive).
_QUOTIENT = "(2 * CAST(a * 100 AS HUGEINT) * 100 + CAST({0} * 100 AS HUGEINT)) // (2 * CAST({0} * 100 AS HUGEINT))"


@query(f"WITH {_INV} SELECT 'a' AS target, 'qty * price' AS formula, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) FILTER (ROUND(qty * price, 2) = a) AS BIGINT) AS n_fit FROM x UNION ALL SELECT 'b', 'qty + price', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) FILTER (qty + price = b) AS BIGINT) FROM x UNION ALL SELECT 'qty', 'b - price', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) FILTER (b - price = qty) AS BIGINT) FROM x UNION ALL SELECT 'price', 'b - qty', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) FILTER (b - qty = price) AS BIGINT) FROM x UNION ALL "
       f"SELECT 'price', 'a / qty', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) FILTER ({_QUOTIENT.format('qty')} = CAST(price * 100 AS HUGEINT)) AS BIGINT) FROM x UNION ALL SELECT 'qty', 'a / price', CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) FILTER ({_QUOTIENT.format('price')} = CAST(qty * 100 AS HUGEINT)) AS BIGINT) FROM x")
def infer_pairs(spark, sf_dir):
    """Every sum, difference, product and quotient of two columns that a third one holds in all rows."""
    return infer.fits(_invoice(spark, sf_dir).drop("l_orderkey", "c"), most_misses=0)


@query(f"WITH {LI} SELECT 'w' || k || 'x' AS target, CASE k % 3 WHEN 0 THEN 'w' || k || 'a * w' || k || 'b' WHEN 1 THEN 'w' || k || 'a + w' || k || 'b' ELSE 'w' || k || 'b / w' || k || 'a' END AS formula, (SELECT COUNT(*) FROM li) AS n_rows, (SELECT COUNT(*) FROM li) AS n_fit FROM range(0, 24) t(k)")
def infer_wide(spark, sf_dir):
    """The rules of a sheet of 72 columns, a third of them products, sums and quotients of two others: 1.3 million candidates, of which a sample leaves 72; these are counted over all rows, and 24 of them are asked for."""
    fields = []
    for k in range(24):
        a, b = (F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", F.lit(f"{k}{side}")), F.lit(900_000)) + 100_000 for side in "ab")
        a, b = ((c.cast("decimal(12,0)") / 100).cast("decimal(12,2)") for c in (a, b))
        x = (a * b).cast("decimal(24,4)") if k % 3 == 0 else (a + b).cast("decimal(14,2)") if k % 3 == 1 else F.round(b.cast("decimal(30,12)") / a, 8).cast("decimal(20,8)")
        fields += [a.alias(f"w{k}a"), b.alias(f"w{k}b"), x.alias(f"w{k}x")]
    kept = infer.fits(_lineitem(spark, sf_dir).select(*fields), most_misses=0)
    return kept.filter("target like '%x'")  # a sum's and a product's inverses hold as well


@query(f"WITH {_INV}, y AS (SELECT *, a + CASE WHEN l_orderkey = (SELECT MIN(l_orderkey) FROM x) THEN 1 ELSE 0 END AS s FROM x) SELECT CAST(COUNT(*) FILTER (s <> a) AS BIGINT) AS misses, CAST(COUNT(*) AS BIGINT) AS n FROM y")
def near_miss(spark, sf_dir):
    x = _invoice(spark, sf_dir)
    first = x.agg(F.min("l_orderkey").alias("m")).first().m
    y = x.select(F.col("qty"), F.col("price"), (F.col("a") + F.when(F.col("l_orderkey") == first, 1).otherwise(0)).cast("decimal(18,2)").alias("s"))
    got = infer.fits(y, ["s", "qty", "price"]).filter("target = 's' and formula = 'qty * price'")
    return got.select((F.col("n_rows") - F.col("n_fit")).alias("misses"), F.col("n_rows").alias("n"))


# corpora

_TOTALS = f"""{ORD}, r AS (SELECT o_custkey, o_orderkey, total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, total) AS k FROM o),
 s AS (SELECT o_custkey, SUM(total) AS total, COUNT(*) AS n FROM r GROUP BY o_custkey)"""


def _statement_cells(spark, sf_dir) -> DataFrame:
    """A table per customer: their orders and a Total row, which is 1.00 too high for every seventh customer."""
    o = _orders(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "total"))
    rows = o.withColumn("row_ix", k - 1).select("o_custkey", "row_ix", F.col("o_orderkey").cast("string").alias("label"), F.col("total").cast("string").alias("text"))
    sums = o.groupBy("o_custkey").agg(F.sum("total").alias("t"), F.count(F.lit(1)).cast("int").alias("row_ix"))
    wrong = F.when(F.col("o_custkey") % 7 == 0, F.lit(Decimal("1.00"))).otherwise(Decimal("0.00"))
    totals = sums.select("o_custkey", "row_ix", F.lit("Total").alias("label"), (F.col("t") + wrong).cast("string").alias("text"))
    return rows.unionByName(totals).select(
        F.col("o_custkey").cast("string").alias("doc_id"), F.lit(0).alias("table_ix"), "row_ix", F.lit(1).alias("col_ix"), F.lit("Amount").alias("header"), "label", "text", F.lit(0).alias("start"), F.lit(0).alias("end")
    )


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(n AS INT) AS row_ix, CAST(total + 1 AS VARCHAR) AS stored, CAST(total AS VARCHAR) AS expected FROM s WHERE o_custkey % 7 = 0 AND n >= 2")
def total_row(spark, sf_dir):
    return investigate.total_rows(_statement_cells(spark, sf_dir)).select("doc_id", "row_ix", "stored", "expected")


@query(
    """WITH l AS (SELECT l_suppkey, CAST(l_quantity AS DECIMAL(12,0)) AS q, CAST(l_tax * 100 + 1 AS DECIMAL(12,0)) AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k FROM lineitem),
 m AS (SELECT l_suppkey, COUNT(*) AS n FROM l GROUP BY l_suppkey) SELECT CAST(l.l_suppkey AS VARCHAR) AS doc_id, CAST(k AS INT) AS row_ix, CAST(q * p + 1000 AS VARCHAR) AS stored, CAST(q * p AS VARCHAR) AS expected FROM l JOIN m USING (l_suppkey) WHERE k = 1 AND n >= 3"""
)
def line_product(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "price")) - 1
    x = _lineitem(spark, sf_dir).withColumn("k", k).select(F.col("l_suppkey").cast("string").alias("doc_id"), "k", F.col("qty").cast("decimal(12,0)").alias("q"), (F.col("tax") * 100 + 1).cast("decimal(12,0)").alias("p"))
    x = x.withColumn("z", (F.col("q") * F.col("p") + F.when(F.col("k") == 1, 1000).otherwise(0)).cast("decimal(20,0)"))
    cell = lambda i, h, c: F.struct(F.lit(i).alias("col_ix"), F.lit(h).alias("header"), c.cast("string").alias("text"))
    cells = x.select("doc_id", F.lit(0).alias("table_ix"), F.col("k").alias("row_ix"), F.explode(F.array(cell(0, "Item", F.concat(F.lit("i"), "k")), cell(1, "Qty", F.col("q")), cell(2, "Rate", F.col("p")), cell(3, "Amount", F.col("z")))).alias("c"), F.concat(F.lit("i"), "k").alias("label"))
    cells = cells.select("doc_id", "table_ix", "row_ix", "c.*", "label", F.lit(0).alias("start"), F.lit(0).alias("end"))
    return investigate.line_products(cells).select("doc_id", "row_ix", "stored", "expected")


@query(f"WITH {ORD}, x AS (SELECT o_custkey, o_orderpriority AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, total) - 1 AS row_ix FROM o), y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, label ORDER BY row_ix) AS nth FROM x) SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(row_ix AS INT) AS row_ix, CASE WHEN nth = 1 THEN label ELSE label || '~' || nth END AS key FROM y")
def dup_labels(spark, sf_dir):
    ix = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "total")) - 1
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit(0).alias("table_ix"), ix.alias("row_ix"), F.col("o_orderpriority").alias("label"))
    return investigate.row_keys(rows).select("doc_id", "row_ix", "key")


@query("WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN '.github/' WHEN 2 THEN 'tests/' ELSE 'a/' END || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.md' END AS path, n_chars * 200 AS size FROM documents) SELECT path, CASE WHEN path LIKE '.github/%' THEN 'dot-path' WHEN path LIKE 'tests/%' THEN 'excluded-directory' WHEN size > 500000 THEN 'size' END AS skipped FROM f WHERE path LIKE '%.md'")
def file_policy(spark, sf_dir):
    k = F.col("doc_id") % 4
    folder = F.when(k == 0, "docs/").when(k == 1, ".github/").when(k == 2, "tests/").otherwise("a/")
    files = _read(spark, sf_dir, "documents").select(F.concat(folder, F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".md")).alias("path"), (F.col("n_chars") * 200).alias("size"))
    return corpus.select_files(files).select("path", "skipped")


@query("SELECT doc_id, regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 15), chr(10)), '(?i)do not edit|auto-?generated|generated (by|with|from)|@generated') AS generated FROM documents")
def generated_filter(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", corpus.looks_generated(F.col("text")).alias("generated"))


def _markdown(spark, sf_dir, stale: int = 11) -> DataFrame:
    """A Markdown document per customer with orders: a pipe table, a rule, a total and its anchor; every eleventh customer's total is stale."""
    o = _orders(spark, sf_dir)
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("total").cast("string"), F.lit(" | "), (F.col("total") * 2).cast("decimal(16,2)").cast("string"), F.lit(" |"))
    grouped = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "total", line.alias("x")))), lambda r: r["x"]), "\n").alias("rows"), F.sum("total").alias("s"))
    shown = (F.col("s") * 2 + F.when(F.col("o_custkey") % stale == 0, F.lit(Decimal("0.50"))).otherwise(Decimal("0.00"))).cast("decimal(24,2)").cast("string")
    text = F.concat(F.lit("| Order | Net | Double |\n|---|---:|---:|\n"), "rows", F.lit("\n\n```vmark #t\nDouble = Net * 2\nall = SUM(Double)\n```\n\nIn all **"), shown, F.lit("**<!--vmark=t.all-->.\n"))
    return grouped.select(F.col("o_custkey").cast("string").alias("doc_id"), text.alias("text"))


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'all' AS name, CAST(total * 2 + 0.50 AS VARCHAR) AS stored, CAST(total * 2 AS VARCHAR) AS computed FROM s WHERE o_custkey % 11 = 0")
def check_documents(spark, sf_dir):
    found = documents.check_corpus(_markdown(spark, sf_dir))
    return found.filter("code = 'STALE' and stored is not null").select("doc_id", "name", "stored", "computed")


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(2 AS BIGINT) AS problems, CAST(2 AS BIGINT) AS stale, CAST(0 AS BIGINT) AS errors FROM s WHERE o_custkey % 11 = 0")
def check_tally(spark, sf_dir):
    return documents.tally(documents.check_corpus(_markdown(spark, sf_dir)))


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS applied, CAST(0 AS INT) AS refused, CAST(total * 2 AS VARCHAR) AS shown FROM s")
def splice_documents(spark, sf_dir):
    docs = _markdown(spark, sf_dir)
    done = repair.splice(docs, repair.plan_corpus(docs).select("doc_id", "start", "end", "old", "text"))
    return done.select("doc_id", "applied", "refused", F.regexp_extract("text", r"\*\*([^*]+)\*\*<!--vmark=t\.all", 1).alias("shown"))


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(n * 3 AS BIGINT) AS cells, CAST(n AS BIGINT) AS n_rows FROM s")
def pipe_tables(spark, sf_dir):
    cells = corpus.corpus_cells(_markdown(spark, sf_dir))
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("row_ix").alias("n_rows"))


def _rule_hits(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("table_ix"), F.lit(0).alias("row_ix"), F.lit(0).alias("col_ix"), F.col("doc_id").alias("k"))
    hit = lambda rule, when, sure: d.filter(when).select("doc_id", "table_ix", "row_ix", "col_ix", F.lit(rule).alias("rule"), F.lit(sure).alias("confirmed"), F.lit("1").alias("stored"), F.lit(rule).alias("expected"))
    return hit("total-row", "k % 2 = 0", True).unionByName(hit("engine-check", "k % 3 = 0", True)).unionByName(hit("engine-infer", "k % 5 = 0", False))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 2 = 0 OR doc_id % 3 = 0 AS confirmed, concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'total-row' END, CASE WHEN doc_id % 3 = 0 THEN 'engine-check' END, CASE WHEN doc_id % 5 = 0 THEN 'engine-infer' END) AS rules, CASE WHEN doc_id % 2 = 0 THEN 'total-row' WHEN doc_id % 3 = 0 THEN 'engine-check' ELSE 'engine-infer' END AS expected FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0")
def merge_findings(spark, sf_dir):
    got = investigate.merge(_rule_hits(spark, sf_dir))
    return got.select("doc_id", "confirmed", F.array_join("rules", ",").alias("rules"), "expected")


@query("SELECT CAST(COUNT(*) AS BIGINT) AS documents, CAST(COUNT(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0) AS BIGINT) AS confirmed, CAST(COUNT(*) FILTER (NOT (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 = 0) AS BIGINT) AS leads, CAST(COUNT(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0) AS BIGINT) AS with_findings, 'wrong figures' AS verdict FROM documents")
def repository_rates(spark, sf_dir):
    return investigate.rates(_read(spark, sf_dir, "documents"), investigate.merge(_rule_hits(spark, sf_dir)))


@query("WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'STALE' WHEN 1 THEN 'UNDEF' ELSE 'NOTE' END AS code, user_id FROM events) SELECT event_id, code, CASE WHEN code = 'STALE' THEN 0 ELSE 2 END AS section, CASE code WHEN 'STALE' THEN 0 WHEN 'UNDEF' THEN 3 ELSE 16 END AS code_rank, CAST(CASE WHEN code = 'STALE' THEN user_id ELSE 0 END AS BIGINT) AS sheet_rank FROM f")
def findings_order(spark, sf_dir):
    """Findings in report order with the keys of that order, by a range-partitioned sort."""
    k = F.col("event_id") % 3
    f = _read(spark, sf_dir, "events").select("event_id", F.when(k == 0, "STALE").when(k == 1, "UNDEF").otherwise("NOTE").alias("code"), "user_id")
    return reports.ordered(f, "user_id", "event_id")


@query(f"WITH {_TOTALS} SELECT 'STALE' AS code, CAST(2 * COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) AS BIGINT) AS documents FROM s WHERE o_custkey % 5 = 0 OR o_custkey % 5 <> 2 AND o_custkey % 11 = 0 HAVING COUNT(*) > 0")
def recheck_stream(spark, sf_dir):
    """Documents checked as a stream of files, then again with later and earlier versions: a fifth are changed, a fifth the same, a fifth deleted, and a fifth of the versions are out of date."""
    from .streaming.recheck import compact, latest, watch_table
    from .streaming.scratch import folder

    base = folder(spark, "recheck")
    run = lambda: watch_table(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    first = _markdown(spark, sf_dir).withColumn("path", F.col("doc_id"))
    first.withColumn("at", F.lit("2026-01-02").cast("timestamp")).write.parquet(f"{base}/in")
    run()
    fifth = F.col("doc_id").cast("long") % 5
    changed = _markdown(spark, sf_dir, 1).withColumn("path", F.col("doc_id")).filter(fifth.isin(0, 3))
    again = first.filter(fifth.isin(1, 2)).withColumn("text", F.when(fifth == 1, F.col("text")))
    versions = changed.unionByName(again).withColumn("at", F.when(fifth == 3, F.lit("2026-01-01")).otherwise(F.lit("2026-01-03")).cast("timestamp"))
    versions.write.mode("append").parquet(f"{base}/in")
    run()
    compact(spark, f"{base}/out")
    return latest(spark, f"{base}/out").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars and assertions of a line-item sheet with rules, reduces and a parameter."""
    book = Workbook(spark).sheet("", None, "param extra precision 2 in [0%, 10%] lattice 1% = default 2%")
    book.sheet("lines", _lineitem(spark, sf_dir), "net precision 2 = price * (1 - disc) * (1 - extra)\nvat precision 2 = net * tax\ngross = net + vat\nrevenue = SUM(gross)\nmean precision 4 = AVG(net)\nassert revenue > 0")
    run = book.run()
    held = spark.createDataFrame([(s, t, str(h).lower(), None) for s, t, h in run.assertions()], "sheet string, name string, value string, error string")
    return run.values().unionByName(held)


from . import corpus_queries, document_queries  # noqa: E402,F401 - register the queries over generated documents
