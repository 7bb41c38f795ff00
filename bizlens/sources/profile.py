"""Cross-table SME profile (S6, J4, W1): one row per customer, every column from the given tables.

Plan, designed for fact tables far larger than memory:

1. ``lineitem`` joins ``orders`` on the order key, both pruned. Both sides are
   shuffled once on that key, the lines as they were read (sums are made after the
   join: they are wider); a hot order key is split by AQE's skew-join handling.
2. Aggregate per ``customer`` (sums) and per ``(customer, part)`` (three flags), then
   per ``customer``. The pairs make the distinct-part counts exact and spread a hot
   customer over its parts; they are nearly as many as the lines, so they don't carry
   the sums. Both levels combine partially on the map side.
3. ``orders`` alone reduces to one row per ``(customer, priority)`` and then per
   customer, ``events`` to one per ``(user, k)`` (``k`` out of the JSON ``props``)
   and then per user: the most frequent value of a key comes from its counts.
4. ``customer`` joins ``nation`` for its region and LEFT JOINs the aggregates on
   the customer key. No side is broadcast by hint; AQE broadcasts at run time
   only under the size limit.

Money is summed exactly as whole ten-thousandths (``bigint``): the same value
as a ``decimal(18,4)`` sum, independent of the order in which partitions
combine, at the cost of long additions instead of decimal objects.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens import schema as S
from bizlens.functions.exprs import without_nan
from bizlens.sources.tables import read_table

# Period layout and scale of the profile.
PERIOD_START = "1998-05-01"   # first day of the current period
PERIOD_MONTHS = 39            # length of the current and of the previous period
MONTHS_PER_YEAR = 12          # revenue is net sales per year of the period
CUSTOMERS_PER_PART = 25       # distinct parts bought -> customer base
NET_SCALE = 10000             # money is summed in 1e-4 units

# Lines of over BIG_LINE pieces count as employees, of up to SMALL_LINE as staff.
BIG_LINE, SMALL_LINE = 40, 10

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _period_bounds(start: str, months: int) -> tuple[dt.datetime, dt.datetime, dt.datetime]:
    """First moments of the current and of the previous period, and the current one's end."""
    d = dt.date.fromisoformat(start)

    def shifted(by: int) -> dt.datetime:
        m = d.year * 12 + (d.month - 1) + by
        last = (dt.date(m // 12 + (m % 12 == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.datetime(m // 12, m % 12 + 1, min(d.day, last))

    return shifted(0), shifted(-months), shifted(months)


def customer_order_stats(orders: DataFrame, lineitem: DataFrame,
                         start: str = PERIOD_START, months: int = PERIOD_MONTHS) -> DataFrame:
    """Per-customer sales, invoice and distinct-part statistics."""
    cur_start, prev_start, cur_end = _period_bounds(start, months)
    od = F.col("o_orderdate").cast("timestamp_ntz")
    o = orders.select(
        F.col("o_orderkey").alias("orderkey"),
        F.col("o_custkey").alias("custkey"),
        F.when(od >= F.lit(cur_end).cast("timestamp_ntz"), F.lit(0))
         .when(od >= F.lit(cur_start).cast("timestamp_ntz"), F.lit(1))
         .when(od >= F.lit(prev_start).cast("timestamp_ntz"), F.lit(2))
         .otherwise(F.lit(0)).alias("period"))
    li = lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_extendedprice", "l_discount", "l_tax",
                         "l_quantity", "l_returnflag", "l_linestatus")
    each = lines_and_parts(li.join(o, "orderkey"))
    return each.groupBy("custkey").agg(*[F.sum(n).alias(n) for n in each.columns if n not in ("custkey", "of_part", "part")])


def lines_and_parts(joined: DataFrame) -> DataFrame:
    """A row per customer with its lines' sums, and a row per ``(customer, part)`` (``of_part``) with three flags only."""
    def units(x: Column) -> Column:
        """Money in 1e-4 units, rounded half up: exact integer sums."""
        return F.floor(x * NET_SCALE + 0.5).cast("bigint")

    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    j = joined.select("custkey", "period", "l_partkey", "l_returnflag", "l_linestatus",
                      units(price * (1 - discount)).alias("net"), units(price * discount).alias("off"),
                      units(price * F.col("l_tax")).alias("tax"), F.floor(discount * 100 + 0.5).cast("bigint").alias("off_pct"),
                      F.col("l_quantity").cast("bigint").alias("pieces"),
                      F.explode(F.array(F.lit(False), F.lit(True))).alias("of_part"))
    cur, prev, pair = F.col("period") == 1, F.col("period") == 2, F.col("of_part")
    sums = {"net_cur": F.when(cur, F.col("net")), "net_prev": F.when(prev, F.col("net")),
            "off_cur": F.when(cur, F.col("off")), "off_prev": F.when(prev, F.col("off")),
            "tax_cur": F.when(cur, F.col("tax")), "off_pct": F.col("off_pct"), "pieces": F.col("pieces")}
    counts = {"n_lines": F.lit(True), "n_f": F.col("l_linestatus") == "F", "n_o": F.col("l_linestatus") == "O",
              "n_r": F.col("l_returnflag") == "R", "n_a": F.col("l_returnflag") == "A",
              "n_n": F.col("l_returnflag") == "N", "n_big": F.col("pieces") > BIG_LINE,
              "n_small": F.col("pieces") <= SMALL_LINE}
    flags = {"parts_cur": cur, "parts_prev": prev, "parts_all": F.lit(True)}
    return j.groupBy("custkey", "of_part", F.when(pair, F.col("l_partkey")).alias("part")).agg(
        *[F.sum(F.when(~pair, x)).alias(n) for n, x in sums.items()], *[F.count_if(~pair & x).alias(n) for n, x in counts.items()],
        *[F.max(F.when(pair, x.cast("int"))).alias(n) for n, x in flags.items()])


def most_frequent(value: str, n: str = "n") -> Column:
    """Aggregate over a key's ``(value, n)`` rows: the non-null value with the largest ``n``, the lowest of equals.

    The counts are the first of two levels, so a hot key is spread over its values.
    """
    return F.min(F.when(F.col(value).isNotNull(),
                        F.struct((-F.col(n)).alias("less"), F.col(value).alias("value"))))["value"]


def customer_priority_stats(orders: DataFrame) -> DataFrame:
    """Per-customer order counts, prices, months and most frequent priority."""
    d = F.col("o_orderdate")
    o = orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"),
                      "o_orderstatus", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("cents"),
                      (F.year(d) * 12 + F.month(d)).alias("month"))
    status = {f"n_s{x.lower()}": F.count_if(F.col("o_orderstatus") == x).alias(f"n_s{x.lower()}") for x in "FOP"}
    each = o.groupBy("custkey", "priority").agg(
        F.count("*").alias("n"), *status.values(), F.sum("cents").alias("cents"), F.max("cents").alias("most"),
        F.min("cents").alias("least"), F.min("month").alias("first"), F.max("month").alias("last"))
    return each.groupBy("custkey").agg(
        F.sum("n").alias("n_orders"), *[F.sum(n).alias(n) for n in status],
        *[F.sum(F.when(F.col("priority") == p, F.col("n")).otherwise(0)).alias(f"n_p{i}")
          for i, p in enumerate(PRIORITIES, 1)],
        F.sum("cents").alias("cents"), F.max("most").alias("cents_max"), F.min("least").alias("cents_min"),
        (F.max("last") - F.min("first")).alias("span"),
        most_frequent("priority").alias("top_priority"))


def customer_event_stats(events: DataFrame) -> DataFrame:
    """Clicks, views and purchases per user and the most frequent ``k`` of their ``props``; the filter reaches the scan."""
    kinds = {"n_click": "click", "n_view": "view", "n_purchase": "purchase"}
    e = (events.select("user_id", "event_type", "props").where(F.col("event_type").isin(*kinds.values()))
         .select(F.col("user_id").alias("custkey"), "event_type",
                 F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    each = e.groupBy("custkey", "k").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("event_type") == x).alias(n) for n, x in kinds.items()])
    return each.groupBy("custkey").agg(*[F.sum(n).alias(n) for n in kinds],
                                       most_frequent("k").alias("top_k"))


#: Aggregates of the fact tables that are 0 for a customer without rows there.
COUNTS = ["net_cur", "net_prev", "off_cur", "off_prev", "tax_cur", "off_pct", "pieces", "n_lines", "n_f", "n_o", "n_r",
          "n_a", "n_n", "n_big", "n_small", "parts_cur", "parts_prev", "parts_all", "n_orders", "n_sf", "n_so", "n_sp",
          "n_p1", "n_p2", "n_p3", "n_p4", "n_p5", "cents", "cents_max", "cents_min", "span", "n_click", "n_view", "n_purchase"]


def picked(index: str, values: list[str]) -> str:
    """The element of a fixed list at a 0-based index, as standard SQL."""
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def attributes(months: int = PERIOD_MONTHS) -> dict[str, str]:
    """Profile columns as standard SQL over the customer row and its aggregates (``COUNTS``, 0 where absent)."""

    def yearly(units: str) -> str:
        return f"CAST({units} AS DOUBLE) / {float(NET_SCALE)} / {months / MONTHS_PER_YEAR}"

    def real(c: str) -> str:
        """Ratios are doubles from the start: the engines' decimals have other scales."""
        return f"CAST({c} AS DOUBLE)"

    lines, placed = "greatest(n_lines, 1)", "greatest(n_orders, 1)"
    status = picked("CASE WHEN n_sf >= n_so AND n_sf >= n_sp THEN 0 WHEN n_so >= n_sp THEN 1 ELSE 2 END", S.TARGET_SEGMENTS)
    flag = picked("CASE WHEN n_n >= n_a AND n_n >= n_r THEN 0 WHEN n_a >= n_r THEN 1 ELSE 2 END", S.CHANNELS)
    priority = "CASE top_priority " + " ".join(
        f"WHEN '{p}' THEN '{v}'" for p, v in zip(PRIORITIES, S.EDUCATION_LEVELS)) + " END"
    stage = picked("CASE WHEN n_orders <= 8 THEN 0 WHEN n_orders <= 11 THEN 1 ELSE 2 END", S.BUSINESS_STAGES)

    def at_least(n: str, least: int) -> str:
        return f"CASE WHEN {n} >= {least} THEN 1 ELSE 0 END"

    return {
        "sme_id": "custkey",
        "business_name": "c_name",
        "revenue": yearly("net_cur"),
        "profit_margin": f"0.45 - {real('n_r')} / {lines}",
        "debt_ratio": "0.9 * (10000 - c_acctbal) / 11000",
        "collateral_value": f"{real('cents_max')} / 250",
        "marketing_spend": yearly("off_cur"),
        "employee_count": "n_big",
        "staff_count": "n_small",
        "age_of_business": "greatest(n_orders - 6, 0)",
        "sector": picked(f"nationkey % {len(S.SECTORS)}", S.SECTORS),
        "previous_funding_received": at_least("n_p1", 2),
        "previous_funding_amount": f"{real('cents_max')} / 100",
        "default_history": f"CASE WHEN 100 * n_r > 42 * {lines} THEN 1 ELSE 0 END",
        "loan_applications_count": "n_p1",
        "funding_requested_amount": f"{real('cents')} / 100 / {placed}",
        "expected_roi": f"{real('n_n')} / {lines}",
        "project_duration_months": "3 + (span - span % 3) / 3",
        "business_stage": stage,
        "collateral_offered": "CASE WHEN c_acctbal > 2000 THEN 1 ELSE 0 END",
        "business_registration_uploaded": at_least("n_sf", 2),
        "tax_clearance_uploaded": at_least("n_so", 2),
        "financial_statements_uploaded": at_least("n_sp", 3),
        "tax_registered": at_least("n_p5", 1),
        "tax_paid_last_year": at_least("n_p4", 1),
        "licenses_required": "1 + regionkey % 4",
        "licenses_up_to_date": at_least("n_p3", 1),
        "total_payroll": "50000 + pieces * 200",
        "cost_per_hire": "5000 + off_pct * 100",
        "nssf_contribution_percent": f"0.05 + 0.07 * {real('n_p2')} / {placed}",
        "nhif_contribution_percent": f"0.02 + 0.03 * {real('n_p3')} / {placed}",
        "staff_turnover_rate": f"0.6 * {real('n_a')} / {lines}",
        "bank_balance": "CASE WHEN c_acctbal > 0 THEN c_acctbal * 20 ELSE 0 END",
        "m_pesa_balance": f"{real('cents_min')} / 500",
        "pending_invoices": "n_o",
        "paid_invoices": "n_f",
        "late_payments": "n_r",
        "campaign_spend": yearly("tax_cur"),
        "clicks": "n_click",
        "impressions": "n_view",
        "conversions": "n_purchase",
        "target_segment": status,
        "total_customers": f"parts_cur * {CUSTOMERS_PER_PART}",
        "active_customers": "parts_all * 15",
        "repeat_customers": "n_orders * 40",
        "channels_used": flag,
        "owner_age": "20 + coalesce(top_k % 40, 2 * n_orders)",
        "owner_gender": picked("CASE WHEN n_f >= n_o THEN 0 ELSE 1 END", S.OWNER_GENDERS),
        "education_level": priority,
        "employment_status": picked("CASE WHEN n_p1 + n_p2 >= n_p4 + n_p5 THEN 0 ELSE 1 END", S.EMPLOYMENT_STATUSES),
        "location": picked(f"regionkey % {len(S.LOCATIONS)}", S.LOCATIONS),
        "revenue_6m_ago": yearly("net_prev"),
        "customers_6m_ago": f"parts_prev * {CUSTOMERS_PER_PART}",
        "marketing_spend_6m_ago": yearly("off_prev"),
    }


def profile_from_frames(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, events: DataFrame,
                        nation: DataFrame, start: str = PERIOD_START, months: int = PERIOD_MONTHS) -> DataFrame:
    home = nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey"))
    base = (customer.select(F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal",
                            F.col("c_nationkey").alias("nationkey"))
            .join(home, "nationkey", "left")
            .join(customer_order_stats(orders, lineitem, start, months), "custkey", "left")
            .join(customer_priority_stats(orders), "custkey", "left")
            .join(customer_event_stats(events), "custkey", "left"))
    base = base.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNTS})
    made = attributes(months)
    types = {f.name: f.dataType.simpleString() for f in S.PROFILE_SCHEMA.fields}
    return without_nan(base).selectExpr(*[f"CAST({made[n]} AS {t}) AS {n}" for n, t in types.items()])


def build_profile(spark: SparkSession, sf_dir: str, start: str = PERIOD_START,
                  months: int = PERIOD_MONTHS) -> DataFrame:
    """SME profile over the fact tables in ``sf_dir`` (operator S6)."""
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_nationkey"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
                                                  "o_totalprice", "o_orderpriority"])
    lineitem = read_table(spark, sf_dir, "lineitem",
                          ["l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity",
                           "l_returnflag", "l_linestatus"])
    events = read_table(spark, sf_dir, "events", ["user_id", "event_type", "props"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    return profile_from_frames(customer, orders, lineitem, events, nation, start, months)


# ------------------------------------------------------------------ monthly series


def month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def monthly_sales(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``(custkey, month, net)``: net sales in 1e-4 units per customer and month, combined before the shuffle by customer."""
    li = lineitem.select(F.col("l_orderkey").alias("orderkey"),
                         F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * NET_SCALE + 0.5)
                         .cast("bigint").alias("net"))
    o = orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
                      month_number(F.col("o_orderdate")).alias("month"))
    return li.join(o, "orderkey").groupBy("custkey", "month").agg(F.sum("net").alias("net"))


def monthly_series(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, first: str, last: str,
                   trailing: int = 6) -> DataFrame:
    """W1 for every month from ``first`` to ``last`` (``YYYY-MM``): a row per business and month, without gaps.

    ``revenue`` of the month, ``trailing_revenue`` of the ``trailing`` months up to it,
    ``previous_revenue`` of as many before these, and ``growth``, their ratio
    less 1 (null if there was nothing before). Months before ``first`` count
    where a window reaches them. A window holds one business's months, at
    most the length of the grid, however many sales it had.
    """
    number = lambda text: int(text[:4]) * 12 + int(text[5:7]) - 1
    a, b = number(first) - 2 * trailing, number(last)
    sales = monthly_sales(orders, lineitem).where(F.col("month").between(a, b))
    grid = customer.select(F.col("c_custkey").alias("custkey"),
                           F.explode(F.sequence(F.lit(a), F.lit(b))).alias("month"))
    by_month = Window.partitionBy("custkey").orderBy("month")
    full = grid.join(sales, ["custkey", "month"], "left").withColumn("net", F.coalesce("net", F.lit(0)).cast("bigint"))
    full = full.withColumn("trail", F.sum("net").over(by_month.rowsBetween(1 - trailing, 0)))
    full = full.withColumn("before", F.lag("trail", trailing).over(by_month))
    money = lambda c: F.col(c).cast("double") / F.lit(float(NET_SCALE))
    return full.where(F.col("month") >= number(first)).select(
        F.col("custkey").alias("sme_id"),
        F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"))
        .alias("month"),
        money("net").alias("revenue"), money("trail").alias("trailing_revenue"),
        money("before").alias("previous_revenue"),
        F.when(F.col("before") > 0, F.col("trail") / F.col("before") - 1).alias("growth"))


def build_monthly_series(spark: SparkSession, sf_dir: str, first: str, last: str, trailing: int = 6) -> DataFrame:
    return monthly_series(read_table(spark, sf_dir, "customer", ["c_custkey"]),
                          read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]),
                          read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"]),
                          first, last, trailing)
