"""The driver's tables seen as postings, boards, probes and snapshots.

Each binding is a DataFrame here and, under the same name, a common table
expression in ``CTES`` for the equivalent SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.operators.census import classified
from postpulse.operators.staging import dealt, tasks_for

AS_OF = "1995-05-01"
EARLIER = "1995-03-15"
LATER_AS_OF = "1997-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_frame(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def values_row(row: tuple) -> str:
    return "(" + ", ".join(map(literal, row)) + ")"


def values_cte(name: str, columns: tuple[str, ...], rows: list[tuple]) -> str:
    """Literal rows as a common table expression."""
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join(map(values_row, rows))})"


def pick(place, values: list | tuple) -> F.Column:
    """The value at ``place`` of a literal list, counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings of 100 boards; one board and some rows are undated."""
    orders = table(spark, sf_dir, "orders")
    undated = (F.col("o_custkey") % 100 == 13) | (F.col("o_orderkey") % 97 == 0)
    return orders.select(
        F.lit("orders").alias("source"),
        F.concat(F.lit("b"), F.col("o_custkey") % 100).alias("company"),
        F.col("o_orderkey").alias("pos"),
        F.when(~undated, F.col("o_orderdate").cast("timestamp_ntz")).alias("posted_at"),
        F.col("o_orderpriority").alias("department"),
        F.col("o_orderstatus").alias("status"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as technology mentions: the part's name on the order's date.

    Large tables meet in as many tasks as the line items' size asks for.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    tasks = tasks_for(lines)
    lines, orders = dealt(lines, tasks, "l_orderkey"), dealt(orders, tasks, "o_orderkey")
    ordered = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if tasks_for(parts):
        ordered, parts = dealt(ordered, tasks, "l_partkey"), dealt(parts, tasks, "p_partkey")
    return (
        ordered.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.lit("lines").alias("source"),
            F.concat(F.lit("s"), "l_suppkey").alias("company"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("posted_at"),
            F.col("p_name").alias("technology"),
        )
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as titled postings of 40 boards, with the place in title and field."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    mark = F.col("l_orderkey") + F.col("l_linenumber")
    city = F.concat(F.lit("City"), F.col("p_partkey") % 25)
    own = F.when(F.col("l_orderkey") % 3 == 0, city).otherwise(
        F.concat(F.lit("City"), "s_nationkey")
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("t"), F.col("l_suppkey") % 40).alias("board"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
            F.concat("p_name", F.lit(" - "), city).alias("title"),
            F.when(mark % 7 == 0, "Remote").when(mark % 11 != 0, own).alias("location"),
            F.col("p_name"),
            F.col("p_type"),
        )
    )


# Invented titles with what a classification should say: title, family, key that
# fires, whether that key is one word, and seniority.  Six of a kind in a row;
# then six generic ones, six that are no jobs, and six that nothing fires on.
ROLES = (
    ("Senior Data Engineer", "engineering", "data engineer", False, "senior"),
    ("Python Developer", "engineering", "python", True, "mid"),
    ("DevOps Engineer II", "engineering", "devops", True, "mid"),
    ("Sr. Firmware Engineer", "engineering", "firmware", True, "senior"),
    ("Machine Learning Lead", "engineering", "machine learning", False, "senior"),
    ("QA Engineer Intern", "engineering", "qa engineer", False, "intern"),
    ("Account Executive", "sales_marketing", "account executive", False, "mid"),
    ("Sales Director", "sales_marketing", "sales", True, "executive"),
    ("Business Development Manager", "sales_marketing", "business development", False, "senior"),
    ("Inside Sales Associate", "retail_food", "sales associate", False, "junior"),
    ("Head of Partnerships", "sales_marketing", "partnerships", True, "executive"),
    ("Regional Sales Manager", "sales_marketing", "sales", True, "senior"),
    ("Registered Nurse", "healthcare", "nurse", True, "mid"),
    ("Physical Therapist", "healthcare", "therapist", True, "mid"),
    ("Dental Hygienist", "healthcare", "dental", True, "mid"),
    ("Veterinary Technician", "healthcare", "veterinar", True, "mid"),
    ("Chief Medical Officer", "healthcare", "medical officer", False, "executive"),
    ("Junior Pharmacist", "healthcare", "pharmac", True, "junior"),
    ("Staff Accountant", "corporate", "accountant", True, "principal"),
    ("Financial Analyst", "corporate", "analyst", True, "mid"),
    ("Payroll Clerk", "corporate", "payroll", True, "mid"),
    ("VP Finance", "corporate", "finance", True, "executive"),
    ("Tax Associate", "corporate", "tax ", True, "junior"),
    ("Controller", "corporate", "controller", True, "mid"),
    ("Electrician", "skilled_trades", "electrician", True, "mid"),
    ("HVAC Technician", "skilled_trades", "technician", True, "mid"),
    ("Plumber Apprentice", "skilled_trades", "plumber", True, "intern"),
    ("Welder", "skilled_trades", "welder", True, "mid"),
    ("Maintenance Lead", "skilled_trades", "maintenance", True, "senior"),
    ("Truck Driver", "logistics", "driver", True, "mid"),
    ("Math Teacher", "education", "teacher", True, "mid"),
    ("Teaching Assistant", "education", "teaching", True, "mid"),
    ("Principal Curriculum Designer", "education", "curriculum", True, "principal"),
    ("School Counselor", "corporate", "counsel", True, "mid"),
    ("Preschool Lead Teacher", "education", "teacher", True, "senior"),
    ("Substitute Teacher", "education", "teacher", True, "mid"),
    ("Manager", "generic", "manager", True, "senior"),
    ("Associate", "generic", "associate", True, "junior"),
    ("Team Lead", "generic", "lead", True, "senior"),
    ("Territory Manager", "generic", "manager", True, "senior"),
    ("Agent", "generic", "agent", True, "mid"),
    ("Junior Trainee", "generic", "trainee", True, "junior"),
    ("Volunteer", "volunteer_unpaid", "volunteer", True, "mid"),
    ("Be Your Own Boss!", "suspect_recruitment_ad", "be your own boss", False, "mid"),
    ("Work From Home Opportunity", "suspect_recruitment_ad", "work from home", False, "mid"),
    ("Volunteer Programme", "volunteer_unpaid", "volunteer", True, "mid"),
    ("Unpaid Internship", "volunteer_unpaid", "unpaid intern", False, "intern"),
    ("Volunteer Services Manager", "volunteer_unpaid", "volunteer", True, "senior"),
    ("Zymurgist", "other", None, False, "mid"),
    ("Falconer", "other", None, False, "mid"),
    ("Beekeeper", "other", None, False, "mid"),
    ("", "other", None, False, "mid"),
    ("Cheesemonger", "other", None, False, "mid"),
    (None, "other", None, False, "mid"),
)
ROLE_COLUMNS = ("role", "stated", "family", "key", "weak", "seniority")
_KINDS, _EACH, _GENERIC, _NO_JOBS = 6, 6, 36, 42


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as titled postings of 40 boards that specialise, some of them wholly.

    ``role`` is the title's place in ``ROLES``; some titles name a city besides.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    number, part = F.col("l_suppkey") % 40, F.col("l_partkey")
    mark = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    own = F.when(number % 3 == 0, 9).otherwise(6)
    role = (
        F.when(mark < own, (number % _KINDS) * _EACH + part % _EACH)
        .when((part % 4 == 0) & (number % 5 == 0), _NO_JOBS + F.floor(part / 4) % 6)
        .when(part % 4 <= 1, _GENERIC + F.floor(part / 4) % 6)
        .otherwise(F.floor(part / 4) % len(ROLES))
    )
    titled = pick(F.col("role"), [r[0] for r in ROLES])
    city = F.concat("stated", F.lit(" (Zz"), F.col("l_partkey") % 7, F.lit(")"))
    return lines.select("*", role.cast("long").alias("role")).select(
        "*", titled.alias("stated")
    ).select(
        F.concat(F.lit("t"), number).alias("board"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        "role",
        F.when(F.col("l_orderkey") % 5 == 1, city).otherwise(F.col("stated")).alias("title"),
    )


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``roles`` with what the title lexicon makes of them."""
    rows = classified(roles(spark, sf_dir))
    return rows.select("board", "pos", "title", "family", "weak")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as probe replies: run = line number, token = part, provider by part."""
    lines = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    http = (
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("int"))
        .when(F.col("l_orderkey") % 17 == 0, 429)
        .when(flag == "R", 404)
        .otherwise(200)
    )
    return lines.select(
        F.concat(F.lit("v"), F.col("l_partkey") % 6).alias("provider"),
        F.concat(F.lit("k"), "l_partkey").alias("token"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_orderkey")).alias("run"),
        http.alias("http"),
        (F.col("l_orderkey") % 23 != 0).alias("shape_ok"),
        F.when(F.col("l_linestatus") == "F", 0)
        .otherwise(F.floor("l_quantity"))
        .cast("long")
        .alias("jobs"),
    )


def snapshot(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    """Boards by customer: orders placed up to a day, with a ramp flag."""
    orders = table(spark, sf_dir, "orders")
    when = F.col("o_orderdate").cast("timestamp_ntz")
    limit = F.lit(day).cast("timestamp_ntz")
    recent = F.count_if(when > limit - F.make_interval(days=F.lit(30)))
    signal = F.when(recent >= 2, "ramping").otherwise("steady")
    return (
        orders.where(when <= limit)
        .groupBy(
            F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("source"),
            F.concat(F.lit("c"), "o_custkey").alias("company"),
        )
        .agg(F.count("*").alias("open"), signal.alias("signal"))
    )


def unread(spark: SparkSession, sf_dir: str, residue: int) -> DataFrame:
    """Boards that an issue failed to read: one residue class of customers."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 == residue)
    return customers.select(
        F.concat(F.lit("p"), F.col("c_custkey") % 3).alias("source"),
        F.concat(F.lit("c"), "c_custkey").alias("company"),
    )


def board_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("board")).agg(
        F.count("*").alias("postings"), F.count_if(F.col("o_orderstatus") == "F").alias("extra")
    )


_SNAPSHOT = """
SELECT 'p' || (o_custkey % 3) AS source, 'c' || o_custkey AS company, count(*) AS open,
  CASE WHEN count(*) FILTER (WHERE o_orderdate > TIMESTAMP '{day}' - INTERVAL 30 DAY) >= 2
    THEN 'ramping' ELSE 'steady' END AS signal
FROM orders WHERE o_orderdate <= TIMESTAMP '{day}' GROUP BY 1, 2"""
_UNREAD = """
SELECT 'p' || (c_custkey % 3) AS source, 'c' || c_custkey AS company
FROM customer WHERE c_custkey % 10 = {residue}"""

CTES = {
    "postings": """
SELECT 'orders' AS source, 'b' || (o_custkey % 100) AS company, o_orderkey AS pos,
  CASE WHEN o_custkey % 100 = 13 OR o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS posted_at,
  o_orderpriority AS department, o_orderstatus AS status
FROM orders""",
    "mentions": """
SELECT 'lines' AS source, 's' || l_suppkey AS company, o_orderdate AS posted_at, p_name AS technology
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "titles": """
SELECT 't' || (l_suppkey % 40) AS board, l_orderkey * 8 + l_linenumber AS pos,
  p_name || ' - City' || (p_partkey % 25) AS title,
  CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'Remote'
    WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL
    WHEN l_orderkey % 3 = 0 THEN 'City' || (p_partkey % 25) ELSE 'City' || s_nationkey END AS location,
  p_name, p_type
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "role_facts": "SELECT * FROM (VALUES "
    + ", ".join(values_row((k, *r)) for k, r in enumerate(ROLES))
    + f") r({', '.join(ROLE_COLUMNS)})",
    "roles": """
SELECT board, pos, place AS role,
  CASE WHEN l_orderkey % 5 = 1 THEN stated || ' (Zz' || (l_partkey % 7) || ')' ELSE stated END AS title
FROM (SELECT *, 't' || (l_suppkey % 40) AS board, l_orderkey * 8 + l_linenumber AS pos,
    CASE WHEN (l_orderkey + l_linenumber) % 10 < CASE WHEN l_suppkey % 40 % 3 = 0 THEN 9 ELSE 6 END
        THEN l_suppkey % 40 % 6 * 6 + l_partkey % 6
      WHEN l_partkey % 4 = 0 AND l_suppkey % 40 % 5 = 0 THEN 42 + l_partkey // 4 % 6
      WHEN l_partkey % 4 <= 1 THEN 36 + l_partkey // 4 % 6
      ELSE l_partkey // 4 % 54 END AS place FROM lineitem)
JOIN role_facts ON role = place""",
    "families": """
SELECT board, pos, title, family, weak FROM roles JOIN role_facts USING (role)""",
    "probes": """
SELECT 'v' || (l_partkey % 6) AS provider, 'k' || l_partkey AS token,
  l_linenumber::BIGINT * 1000000000 + l_orderkey AS run,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 429
    WHEN l_returnflag = 'R' THEN 404 ELSE 200 END AS http,
  l_orderkey % 23 <> 0 AS shape_ok,
  CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS jobs
FROM lineitem""",
    "previous": _SNAPSHOT.format(day=EARLIER),
    "current": _SNAPSHOT.format(day=AS_OF),
    "unread_previous": _UNREAD.format(residue=3),
    "unread_current": _UNREAD.format(residue=7),
    "board_sizes": """
SELECT 'c' || o_custkey AS board, count(*) AS postings,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS extra FROM orders GROUP BY 1""",
}

NEEDS = {"roles": ("role_facts",), "families": ("role_facts", "roles")}


def with_ctes(names: tuple[str, ...], body: str, more: tuple[str, ...] = ()) -> str:
    """``body`` after the named expressions (and ``more``, complete ones, in order)."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    parts = [f"{n} AS ({CTES[n]})" for n in wanted]
    if not wanted and not more:
        return body
    return f"WITH {', '.join([*parts, *more])}\n{body}"
