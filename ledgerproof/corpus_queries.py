"""Registered queries over documents that are generated from the driver's tables: what the engine finds in them, against SQL over the same tables."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.columns import closest_name, domain_fault
from .lang.parser import parse_lines
from .operators import documents, infer, investigate, names, reports, sweep
from .queries import _TOTALS, LI, ORD, _lineitem, _orders, _read, query
from .sources import corpus
from .sources.csv_import import parse_clause, stamp_state
from .sources.markdown import locate

#: Orders of each customer in a fixed sequence, with figures that a rule can be found in.
_HIRE = f"""{ORD}, r AS (SELECT o_custkey, o_orderkey, total, 2 + o_orderkey % 5 AS units, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, total) - 1 AS k, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM o)"""


def _string(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _row(*cells) -> F.Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _tables(rows: DataFrame, key: str, head: str, line: F.Column, *more) -> DataFrame:
    """(key, table, n): the lines of each key as one pipe table, in the order of k."""
    grouped = rows.withColumn("line", line).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), "\n").alias("lines"), F.count(F.lit(1)).alias("n"), *more)
    return grouped.withColumn("table", F.concat(F.lit(head), "lines"))


def _hire(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "total")
    rows = _orders(spark, sf_dir).withColumn("k", F.row_number().over(w) - 1).withColumn("units", (F.col("o_orderkey") % 5 + 2).cast("decimal(4,0)"))
    return rows.withColumn("cost", (F.col("units") * F.col("total")).cast("decimal(18,2)"))


# domains, names, stamps and imports


@query("SELECT p_partkey, p_size, CASE WHEN p_size < 1 OR p_size > 45 THEN '[1, 45]' WHEN p_size NOT IN (1, 2, 3, 5, 8, 13, 21, 34) THEN '{1, 2, 3, 5, 8, 13, 21, 34}' END AS broken FROM part")
def domain_filter(spark, sf_dir):
    """The clause of a parsed parameter domain that each size breaks."""
    (param,), faults = parse_lines("param size precision 0 in [1, 45] in {1, 2, 3, 5, 8, 13, 21, 34} = default 1")
    assert not faults
    return _read(spark, sf_dir, "part").select("p_partkey", "p_size", domain_fault(F.col("p_size").cast("decimal(6,0)"), param.domain).alias("broken"))


_COMMON = "CASE " + " ".join(f"WHEN left(n_name, {k}) = left(r_name, {k}) AND least(length(n_name), length(r_name)) >= {k} THEN {k}" for k in range(12, 0, -1)) + " ELSE 0 END"


@query(f"WITH s AS (SELECT n_name, r_name, levenshtein(n_name, r_name) AS d, {_COMMON} AS common FROM nation, region), r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY d, common DESC, r_name) AS k FROM s) SELECT n_name, r_name AS nearest, CAST(d AS INT) AS distance FROM r WHERE k = 1")
def did_you_mean(spark, sf_dir):
    """The nearest region name of each nation, ties by common beginning: two tables of fixed size."""
    names = _read(spark, sf_dir, "region").agg(F.sort_array(F.collect_list("r_name")).alias("names"))  # the 5 rows of region
    best = closest_name(F.col("n_name"), F.col("names"))
    return _read(spark, sf_dir, "nation").select("n_name").join(F.broadcast(names)).select("n_name", best["name"].alias("nearest"), best["distance"].alias("distance"))


_LESS = "left(p_name, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2)"


@query(
    f"WITH a AS (SELECT DISTINCT {_LESS} AS name FROM part), k AS (SELECT DISTINCT p_name AS nearest FROM part), p AS (SELECT name, nearest, levenshtein(name, nearest) AS d FROM a, k WHERE abs(length(name) - length(nearest)) <= 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, len(list_filter(range(1, least(length(name), length(nearest)) + 1), lambda i: left(name, i) = left(nearest, i))) DESC, nearest) AS k FROM p WHERE d <= 2) "
    "SELECT a.name, nearest, CAST(d AS INT) AS distance FROM a LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (name)"
)
def suggest_names(spark, sf_dir):
    """The part that each misspelt part name means, against all part names."""
    at = F.col("p_partkey") % F.length("p_name")
    part = _read(spark, sf_dir, "part")
    less = F.concat(F.left("p_name", at), F.substring("p_name", (at + 2).cast("int"), F.length("p_name")))
    return names.suggestions(part.select(less.alias("name")), part.select(F.col("p_name").alias("name")))


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY r_name) AS k FROM nation, region) SELECT n_name, 'UNDEF' AS code, 'SUM(' || n_name || ')' AS formula FROM nation")
def undefined_names(spark, sf_dir):
    """Documents whose one formula reads a column that the table doesn't have."""
    names = _read(spark, sf_dir, "region").agg(F.sort_array(F.collect_list(F.regexp_replace("r_name", " ", "_"))).alias("names"))
    head = F.concat(F.lit("| "), F.array_join("names", " | "), F.lit(" |\n"), F.lit("|--|--|--|--|--|\n| 1 | 2 | 3 | 4 | 5 |\n\n```vmark #t\nx = SUM("), F.regexp_replace("n_name", " ", "_"), F.lit(")\n```\n"))
    docs = _read(spark, sf_dir, "nation").join(F.broadcast(names)).select(F.col("n_name").alias("doc_id"), head.alias("text"))
    found = documents.check_corpus(docs).filter("code = 'UNDEF'")
    return found.select(F.col("doc_id").alias("n_name"), "code", F.concat(F.lit("SUM("), "doc_id", F.lit(")")).alias("formula"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unstamped' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'stale' END AS state FROM documents")
def sha_stamp(spark, sf_dir):
    """The state of a stamp over each file's bytes."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    claimed = F.when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 2, F.sha2(F.concat("text", F.lit("x")), 256))

    @F.pandas_udf("string")
    def state(text: pd.Series, stamp: pd.Series) -> pd.Series:
        return pd.Series([stamp_state((t or "").encode(), s) for t, s in zip(text, stamp, strict=True)])

    return docs.select("doc_id", state("text", claimed).alias("state"))


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'data/s' || s_suppkey || '.csv' AS target, CASE WHEN s_suppkey % 3 = 0 THEN ';' ELSE ',' END AS separator, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 'Id,Name' ELSE '' END AS names, CASE WHEN s_suppkey % 5 = 0 THEN sha256(CAST(s_suppkey AS VARCHAR)) END AS stamp FROM supplier WHERE s_suppkey % 7 <> 0"
)
def import_clause(spark, sf_dir):
    """Import declarations of a corpus as rows; what isn't one is left out."""
    key = F.col("s_suppkey")
    text = F.concat(
        F.lit("```vmark #b "), F.when(key % 7 == 0, F.lit("by ")).otherwise(F.lit("from ")), F.lit("data/s"), _string(key), F.lit(".csv"), F.when(key % 3 == 0, F.lit(" delimited ;")).otherwise(F.lit("")),
        F.when(key % 2 == 0, F.lit(" labelled Id, Name")).otherwise(F.lit("")), F.when(key % 5 == 0, F.concat(F.lit(" at sha256:"), F.sha2(_string(key), 256))).otherwise(F.lit("")), F.lit("\nm = COUNT(b.Id)\n```\n"),
    )
    docs = _read(spark, sf_dir, "supplier").select(_string(key).alias("doc_id"), text.alias("text"))

    def clause(text: str) -> list[dict]:
        (block,) = locate(text).blocks
        got = parse_clause(block.info)
        return [{"separator": got.separator, "names": ",".join(got.names), "stamp": got.stamp}]

    targets = corpus.import_targets(docs).select("doc_id", "target")
    rest = documents.per_document(docs.join(targets.select("doc_id"), "doc_id", "left_semi"), clause, "separator string, names string, stamp string")
    return targets.join(rest.drop("path"), "doc_id").select("doc_id", "target", "separator", "names", "stamp")


# anchors, blocks and cells


def _anchored(spark, sf_dir) -> DataFrame:
    """A document for each nation: two scalars, and an anchor for each customer; some show another value, some name nothing."""
    c = F.col("c_custkey")
    anchor = F.concat(F.lit("No "), _string(c), F.lit(" **"), F.when(c % 7 == 0, F.lit("11")).otherwise(F.lit("10")), F.lit("**<!--vmark=s."), F.when(c % 11 == 0, F.lit("w")).otherwise(F.lit("v")), F.lit("-->."))
    lines = _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", anchor.alias("a")))), lambda x: x["a"]), "\n\n").alias("anchors"))
    nations = _read(spark, sf_dir, "nation").join(lines, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    spare = F.when(F.col("n_nationkey") % 2 == 0, F.lit("**3**<!--vmark=s.spare-->\n\n")).otherwise(F.lit(""))
    return nations.select(F.col("n_name").alias("doc_id"), F.concat(F.lit("```vmark #s\nv = 10\nspare = 3\n```\n\n"), spare, F.coalesce("anchors", F.lit("none"))).alias("text"))


@query("SELECT n_name AS name, COUNT(c_custkey) FILTER (c_custkey % 7 = 0 AND c_custkey % 11 <> 0) AS stale, COUNT(c_custkey) FILTER (c_custkey % 11 = 0) AS unbound FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name HAVING stale + unbound > 0")
def anchor_join(spark, sf_dir):
    """Anchors that show another value than the scalar that they are bound to, and anchors that are bound to nothing."""
    found = documents.check_corpus(_anchored(spark, sf_dir)).filter("code in ('STALE', 'ANCHOR') and start >= 0")
    return found.groupBy(F.col("doc_id").alias("name")).agg(F.count_if(F.col("code") == "STALE").alias("stale"), F.count_if(F.col("code") == "ANCHOR").alias("unbound"))


@query("SELECT n_name AS document, 'spare' AS scalar FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_name, 'v' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 11 <> 0)")
def unused_scalar(spark, sf_dir):
    """Scalars that no formula, report or anchor reads."""
    return documents.check_corpus(_anchored(spark, sf_dir)).filter("code = 'WARN'").select(F.col("doc_id").alias("document"), F.col("name").alias("scalar"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'b' || i AS sheet, CAST(i AS INT) AS table_ix FROM supplier, unnest(range(0, s_suppkey % 4 + 1)) t(i) WHERE (s_suppkey + i) % 2 = 0")
def block_asof(spark, sf_dir):
    """The table that each block of a document belongs to: the one right before it."""
    key = F.col("s_suppkey")
    part = lambda i: F.concat(F.lit("| A |\n|--|\n| "), _string(i), F.lit(" |\n\n"), F.when((key + i) % 2 == 0, F.concat(F.lit("```vmark #b"), _string(i), F.lit("\nx = SUM(A)\n```\n\n"))).otherwise(F.lit("some prose\n\n")))
    docs = _read(spark, sf_dir, "supplier").select(_string(key).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), key % 4), part), "").alias("text"))
    return documents.per_document(docs, lambda text: [{"sheet": b.sheet, "table_ix": b.table} for b in locate(text).blocks], "sheet string, table_ix int").drop("path")


@query(f"WITH {_HIRE} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(k AS INT) AS row_ix, CAST(2 AS INT) AS col_ix, CAST(CAST(total * 2 + 1 AS DECIMAL(18,2)) AS VARCHAR) AS stored, CAST(CAST(total * 2 AS DECIMAL(18,2)) AS VARCHAR) AS expected FROM r WHERE o_orderkey % 13 = 0")
def interval_locate(spark, sf_dir):
    """Cells of a corpus that an engine finding's place lies in."""
    rows = _hire(spark, sf_dir)
    twice = (F.col("total") * 2 + F.when(F.col("o_orderkey") % 13 == 0, Decimal("1.00")).otherwise(Decimal("0.00"))).cast("decimal(18,2)")
    docs = _tables(rows, "o_custkey", "| Order | Net | Twice |\n|--|--|--|\n", _row(F.concat(F.lit("o"), _string("o_orderkey")), _string("total"), _string(twice)))
    docs = docs.select(_string("o_custkey").alias("doc_id"), F.concat("table", F.lit("\n\n```vmark #t\nTwice = Net * 2\n```\n")).alias("text"))
    found = investigate.engine_rule(docs, corpus.corpus_cells(docs))
    return found.select("doc_id", "row_ix", "col_ix", "stored", "expected")


# masking, totals and reports of a corpus


_PIECE = "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))"


@query(
    f"WITH p AS (SELECT doc_id, {_PIECE} AS p, length({_PIECE}) AS n FROM documents) SELECT doc_id, "
    "'    ' || chr(10) || repeat(' ', n + 4) || chr(10) || '    ' || chr(10) || p || chr(10) || '    ' || p || chr(10) || chr(10) || repeat(' ', n + 4) || chr(10) || chr(10) || '- ' || p || chr(10) || '    ' || p || chr(10) "
    "|| repeat(' ', n + 2) || chr(10) || '   ' || chr(10) || repeat(' ', n) || chr(10) || '   ' || chr(10) || p || ' ' || repeat(' ', n + 9) || ' ' || p AS masked FROM p"
)
def mask_length(spark, sf_dir):
    """Front matter, indented code after a blank line, quotations, fences and comments are blanks; all else, list items too, stays where it was."""
    piece = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    parts = ["---\r\nt: ", "\r\n---\r\n", "\n    ", "\n\n    ", "\n\n- ", "\n    ", "\n> ", "\n```\n", "\n```\n", " <!-- ", " --> "]
    text = F.concat(F.lit(parts[0]), piece, *[x for part in parts[1:] for x in (F.lit(part), piece)])
    return _read(spark, sf_dir, "documents").select("doc_id", corpus.mask(text.substr(F.lit(1), F.length(text))).alias("masked"))


def _statements(spark, sf_dir) -> DataFrame:
    """A document for each customer: their orders and a total, which is 1.00 too high for every seventh; every fifth has a term that is no number."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "total")
    rows = _orders(spark, sf_dir).withColumn("k", F.row_number().over(w))
    amount = F.when((F.col("o_custkey") % 5 == 0) & (F.col("k") == 1), F.lit("to come")).otherwise(_string("total"))
    tables = _tables(rows, "o_custkey", "| Item | Amount |\n|--|--|\n", _row(F.concat(F.lit("o"), _string("o_orderkey")), amount), F.sum("total").alias("t"))
    total = _string((F.col("t") + F.when(F.col("o_custkey") % 7 == 0, Decimal("1.00")).otherwise(Decimal("0.00"))).cast("decimal(24,2)"))
    return tables.select(_string("o_custkey").alias("doc_id"), F.concat("table", F.lit("\n| Total | "), total, F.lit(" |\n")).alias("text"))


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN o_custkey % 5 = 0 THEN 'unreadable' WHEN o_custkey % 7 = 0 THEN 'wrong' ELSE 'right' END AS state, CASE WHEN o_custkey % 5 <> 0 THEN CAST(total AS VARCHAR) END AS expected FROM s WHERE o_custkey % 5 = 0 OR n >= 2")
def total_states(spark, sf_dir):
    """Every total of a corpus: right, wrong, or not to be judged because a term is no number."""
    return investigate.Reading(_statements(spark, sf_dir)).totals.select("doc_id", "state", "expected")


def _ledgers(spark, sf_dir) -> DataFrame:
    """The statement of each customer, and below it a table with a rule: a product for even customers, a sum for odd ones. In every third the second row breaks the rule."""
    rows = _hire(spark, sf_dir)
    even = F.col("o_custkey") % 2 == 0
    off = F.when((F.col("k") == 1) & (F.col("o_custkey") % 3 == 1), F.col("total") * 7).otherwise(Decimal("0.00"))
    last = F.when(even, F.col("cost") + off).otherwise(F.col("units") + F.col("total") + off).cast("decimal(18,2)")
    fee = F.when(even, _string("units")).otherwise(F.concat(_string("units"), F.lit(".00")))
    head = F.when(F.col("o_custkey") % 2 == 0, F.lit("| Order | Units | Each | Cost |\n|--|--|--|--|\n")).otherwise(F.lit("| Order | Fee | Net | Due |\n|--|--|--|--|\n"))
    tables = _tables(rows, "o_custkey", "", _row(F.concat(F.lit("o"), _string("o_orderkey")), fee, _string("total"), _string(last)))
    more = tables.select(_string("o_custkey").alias("doc_id"), F.concat(F.lit("\nBelow it:\n\n"), head, "lines", F.lit("\n")).alias("more"))
    return _statements(spark, sf_dir).join(more, "doc_id").select("doc_id", F.concat("text", "more").alias("text"))


@query(
    f"WITH {_TOTALS}, u AS (SELECT o_custkey, o_orderkey, total, 2 * (2 + o_orderkey % 5) AS twice, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0.01 END AS step FROM r), "
    "c AS (SELECT o_custkey, COUNT(*) FILTER (NOT ((twice - step) * o_orderkey <= 2 * total AND 2 * total < (twice + step) * o_orderkey)) AS m1, COUNT(*) FILTER (NOT ((twice - step) * total <= 2 * o_orderkey AND 2 * o_orderkey < (twice + step) * total)) AS m2 FROM u GROUP BY o_custkey), "
    "j AS (SELECT o_custkey % 5 = 0 AS unread, o_custkey % 5 <> 0 AND n >= 2 AS checked, o_custkey % 5 <> 0 AND n >= 2 AND o_custkey % 7 = 0 AS wrong, o_custkey % 2 = 0 AND n >= 3 AS product, "
    "(o_custkey % 3 <> 1 OR m1 = 0 OR m2 = 0) AND n >= 2 AS proposed, o_custkey % 3 = 1 AND n >= 3 AND o_custkey % 2 = 0 AS wrong2, o_custkey % 3 = 1 AND n >= 3 AND o_custkey % 2 = 1 AS lead, n >= 3 AND (m1 = 1 OR m2 = 1) AS chance FROM s JOIN c USING (o_custkey)) SELECT 'confirmed' AS verdict, "
    "CAST(COUNT(*) FILTER (wrong) + COUNT(*) FILTER (wrong2) AS BIGINT) AS confirmed, CAST(COUNT(*) FILTER (lead) + COUNT(*) FILTER (chance) AS BIGINT) AS leads, CAST(2 * COUNT(*) AS BIGINT) AS tables_read, "
    "CAST(COUNT(*) FILTER (checked) + COUNT(*) FILTER (product) AS BIGINT) AS tables_checked, CAST(COUNT(*) FILTER (unread) AS BIGINT) AS unreadable, CAST(COUNT(*) AS BIGINT) AS without_rules, "
    "CAST(COUNT(*) FILTER (checked) + COUNT(*) FILTER (product OR proposed) AS BIGINT) AS with_arithmetic, CAST(COUNT(*) FILTER (proposed AND NOT wrong2) AS BIGINT) AS inferable, CAST(COUNT(*) FILTER (wrong2) AS BIGINT) AS inferable_after_fix FROM j"
)
def corpus_report(spark, sf_dir):
    """Accuracy and adoption of a corpus: wrong totals and products, rules that all rows but one follow, and what inference could propose, now and once the figures are right. A label such as o7 is a number too, so Units (or Fee) may by chance be its quotient with Each in all rows, a rule, or in all but one, a lead."""
    return investigate.report(_ledgers(spark, sf_dir))


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(n + 3 AS BIGINT) AS line, CAST(total + 1 AS VARCHAR) AS stored, CAST(least(n + 3, 14) AS BIGINT) AS shown FROM s WHERE o_custkey % 5 <> 0 AND o_custkey % 7 = 0 AND n >= 2")
def finding_excerpts(spark, sf_dir):
    """Wrong totals with their line and an excerpt of the table."""
    docs = _statements(spark, sf_dir)
    got = investigate.evidence(docs, investigate.investigate(docs, ["total-row"]))
    return got.select("path", F.col("line").cast("long").alias("line"), "stored", F.size("excerpt").cast("long").alias("shown"))


# inference over documents


def _plain_hire(spark, sf_dir, miss: bool = False) -> DataFrame:
    rows = _hire(spark, sf_dir)
    cost = F.col("cost") + F.when((F.col("k") == 1) & F.lit(miss), F.col("total")).otherwise(Decimal("0.00"))
    return _tables(rows, "o_custkey", "| Order | Units | Each | Cost |\n|--|--|--|--|\n", _row(F.concat(F.lit("o"), _string("o_orderkey")), _string("units"), _string("total"), _string(cost.cast("decimal(18,2)"))))


@query(
    f"WITH {_HIRE}, t AS (SELECT o_custkey, n, '| Order | Units | Each | Cost |' || chr(10) || '|--|--|--|--|' || chr(10) || string_agg('| o' || o_orderkey || ' | ' || units || ' | ' || total || ' | ' || CAST(units * total AS DECIMAL(18,2)) || ' |', chr(10) ORDER BY k) AS x FROM r GROUP BY o_custkey, n), q AS (SELECT o_custkey, bool_and((2 * units - 1) * total <= 2 * o_orderkey AND 2 * o_orderkey < (2 * units + 1) * total) AS quotient FROM r GROUP BY o_custkey) "
    "SELECT CAST(o_custkey AS VARCHAR) AS doc_id, x || CASE WHEN n >= 3 THEN chr(10) || chr(10) || '```vmark #unnamed1' || chr(10) || CASE WHEN quotient THEN 'Units precision 0 = Order / Each' || chr(10) || 'Cost              = Units * Each' ELSE 'Cost = Units * Each' END || chr(10) || '```' WHEN n = 1 THEN chr(10) || chr(10) || '<!--vmark:no-formulas-->' || chr(10) ELSE '' END AS text FROM t JOIN q USING (o_custkey)"
)
def infer_write(spark, sf_dir):
    """Documents with the rules that inference finds written into them: not on two rows, and a marker where there is nothing to find. Labels such as o7 are numbers too: where they happen to be Units times Each, rounded, in all rows, that is a rule."""
    docs = _plain_hire(spark, sf_dir).select(_string("o_custkey").alias("doc_id"), F.col("table").alias("text"))
    return infer.write_corpus(docs).select("doc_id", "text")


@query(f"WITH {_HIRE} SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN n >= 3 AND o_custkey % 3 <> 0 THEN 'Due = Mass * Rate' ELSE '' END AS rules, CASE WHEN n < 2 OR o_custkey % 3 = 0 THEN 1 ELSE 0 END AS marked, 0 AS refused FROM r")
def infer_verified(spark, sf_dir):
    """Rules that inference writes, and what a check of the written documents says: a third of the tables declares a unit that the fitting product doesn't have."""
    due = F.when(F.col("o_custkey") % 3 == 0, F.lit("EUR")).otherwise(F.lit("SEK"))
    tables = _tables(_hire(spark, sf_dir), "o_custkey", "", _row(F.concat(F.lit("o"), _string("o_orderkey")), _string("units"), _string("total"), _string("cost")))
    docs = tables.select(_string("o_custkey").alias("doc_id"), F.concat(F.lit("| Order | Mass [kg] | Rate [SEK/kg] | Due ["), due, F.lit("] |\n|--|--|--|--|\n"), "lines").alias("text"))

    def judged(text: str) -> list[dict]:
        result = infer.written_and_checked(text)[1]
        rules = [f"{name} = {b.text.partition('=')[2].strip() or b.text}" for s in result.model.sheets.values() for name, b in s.rules.items()]
        return [{"rules": "; ".join(rules), "marked": int(result.model.doc.no_formulas), "refused": sum(f.problem and f.code != "COVERAGE" for f in result.findings)}]

    return documents.per_document(docs, judged, "rules string, marked int, refused int").drop("path")


@query(f"WITH {_HIRE} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(1 AS INT) AS row_ix, CAST(3 AS INT) AS col_ix, CAST(CAST(units * total + total AS DECIMAL(18,2)) AS VARCHAR) AS stored, CAST(CAST(units * total AS DECIMAL(18,2)) AS VARCHAR) AS expected FROM r WHERE k = 1 AND n >= 3 AND o_custkey NOT IN (SELECT o_custkey FROM r GROUP BY o_custkey HAVING COUNT(DISTINCT units + CASE WHEN k = 1 THEN 1 ELSE 0 END) = 1)")
def infer_leads(spark, sf_dir):
    """The one row of a table that disagrees with a rule that all others follow. Where what is stored is one multiple of Each in all rows, a rule without a miss stands against it, so there is no lead."""
    docs = _plain_hire(spark, sf_dir, miss=True).select(_string("o_custkey").alias("doc_id"), F.col("table").alias("text"))
    found = investigate.infer_rule(docs, corpus.corpus_cells(docs)).filter("col_ix = 3")
    return found.select("doc_id", "row_ix", "col_ix", "stored", "expected")


@query(
    f"WITH {LI}, m AS (SELECT CAST((COUNT(*) % 7 + 2) / 100.0 AS DECIMAL(6,2)) AS m FROM li), x AS (SELECT l_orderkey, price, CAST(price * m AS DECIMAL(20,4)) AS c FROM li, m), k AS (SELECT CAST(arg_min(CAST(c AS DOUBLE) / CAST(price AS DOUBLE), l_orderkey * 1e9 + CAST(price AS DOUBLE)) AS DECIMAL(20,6)) AS k FROM x WHERE price <> 0) "
    "SELECT 'c' AS target, 'price' AS operand, regexp_replace(CAST(k AS VARCHAR), '0+$', '') AS k, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) FILTER (ROUND(price * k, 4) = c) AS BIGINT) AS n_fit FROM x, k GROUP BY k"
)
def infer_multiplier(spark, sf_dir):
    """A multiplier that the data gives, solved from the first row and verified on all."""
    lines = _lineitem(spark, sf_dir)
    m = Decimal(lines.count() % 7 + 2).scaleb(-2)
    frame = lines.select("price", (F.col("price") * m).cast("decimal(20,4)").alias("c"), F.struct("l_orderkey", "price").alias("place"))
    return infer.multipliers(frame, ["c", "price"], "place").filter("target = 'c'")


# units, charts, plans and sweeps of documents


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS n, CASE p_partkey % 3 WHEN 0 THEN 'declared' ELSE 'operands' END AS why FROM part WHERE p_partkey % 3 < 2")
def unit_faults(spark, sf_dir):
    """Formulas whose units disagree: with what is declared, or among their operands."""
    key = F.col("p_partkey")
    text = F.concat(
        F.lit("| Mass [kg] | Rate [SEK/kg] | Due ["), F.when(key % 3 == 0, F.lit("EUR")).otherwise(F.lit("SEK")), F.lit("] |\n|--|--|--|\n| 2 | "), _string("p_size"), F.lit(".00 | "), _string(F.col("p_size") * 2),
        F.lit(".00 |\n\n```vmark #t\nDue = Mass "), F.when(key % 3 == 1, F.lit("+")).otherwise(F.lit("*")), F.lit(" Rate\nall = SUM(Due)\n```\n**"), _string(F.col("p_size") * 2), F.lit(".00**<!--vmark=t.all-->\n"),
    )
    found = documents.check_corpus(_read(spark, sf_dir, "part").select(_string(key).alias("doc_id"), text.alias("text"))).filter("code = 'UNIT'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.first("message").startswith("declared"), "declared").otherwise("operands").alias("why"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'no image line shows the chart' WHEN 1 THEN 'there is no chart ring; there are area, bar, line, pie, stacked-bar' ELSE 'pie of `A` contains a negative value (-2.00, row 2)' END AS message FROM supplier WHERE s_suppkey % 4 < 3")
def chart_states(spark, sf_dir):
    """Charts that can't be drawn, or that no image line shows."""
    k = F.col("s_suppkey") % 4
    text = F.concat(F.lit("| M | A |\n|--|--|\n| x | 3 |\n| y | "), F.when(k == 2, F.lit("-2")).otherwise(F.lit("2")), F.lit(" |\n\n```vmark #s\nchart c as "), F.when(k == 1, F.lit("ring")).when(k == 2, F.lit("pie")).otherwise(F.lit("bar")), F.lit(" of A labelled M\n```\n"), F.when(k == 0, F.lit("")).otherwise(F.lit("![c](c.svg)<!--vmark=s.c-->\n")))
    found = documents.check_corpus(_read(spark, sf_dir, "supplier").select(_string("s_suppkey").alias("doc_id"), text.alias("text")))
    return found.filter("code = 'ARTIFACT'").select("doc_id", "message")


@query(f"WITH {_TOTALS} SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 't.Twice' AS id, 'column' AS kind, CAST(2 AS INT) AS width, '' AS needs FROM s UNION ALL SELECT CAST(o_custkey AS VARCHAR), 't.all', 'scalar', 2, 't.Twice' FROM s UNION ALL SELECT CAST(o_custkey AS VARCHAR), 't.assert 0', 'assertion', NULL, 't.all' FROM s")
def explain_plans(spark, sf_dir):
    """The plan of every document: bindings in order of evaluation with what they read and their width."""
    tables = _tables(_hire(spark, sf_dir), "o_custkey", "| Order | Net | Twice |\n|--|--|--|\n", _row(F.concat(F.lit("o"), _string("o_orderkey")), _string("total"), _string((F.col("total") * 2).cast("decimal(18,2)"))))
    docs = tables.select(_string("o_custkey").alias("doc_id"), F.concat("table", F.lit("\n\n```vmark #t\nTwice = Net * 2\nall = SUM(Twice)\nassert all > 0\n```\n")).alias("text"))

    def plan(text: str) -> list[dict]:
        return [{"id": p["id"], "kind": p["kind"], "width": p["width"], "needs": ",".join(p["needs"])} for p in reports.explain(documents.check(text))]

    return documents.per_document(docs, plan, "id string, kind string, width int, needs string").drop("path")


@query(
    "WITH q AS (SELECT s_suppkey, h * 10 AS h, 20 + s_suppkey % 30 AS rate FROM supplier, unnest(range(0, s_suppkey % 4 + 2)) t(h)) SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(COUNT(*) AS INT) AS questions, CAST(COUNT(*) FILTER (h * rate <= 800) AS INT) AS feasible, "
    "CAST(CAST(MAX(h * rate) FILTER (h * rate <= 800) AS DECIMAL(18,2)) AS VARCHAR) AS best FROM q GROUP BY s_suppkey"
)
def document_sweeps(spark, sf_dir):
    """Every document's grid of questions: how many, how many hold, and the best of those."""
    key = F.col("s_suppkey")
    text = F.concat(
        F.lit("```vmark #p\nparam h precision 0 integer in [0, "), _string((key % 4 + 1) * 10), F.lit("] lattice 10 = default 0\nrate precision 2 = "), _string(key % 30 + 20),
        F.lit(".00\ncost precision 2 = h * rate\nassert cost <= 800\n\nreport best scalar p.cost direction max among feasible\n```\n"),
    )

    def sweeps(text: str) -> list[dict]:
        sim = sweep.simulate(text)
        good = [a.values["p", "cost"] for a in sim.answers if a.feasible]
        return [{"questions": len(sim.answers), "feasible": len(good), "best": f"{max(good):.2f}" if good else None}]

    docs = _read(spark, sf_dir, "supplier").select(_string(key).alias("doc_id"), text.alias("text"))
    return documents.per_document(docs, sweeps, "questions int, feasible int, best string").drop("path")
