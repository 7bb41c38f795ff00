"""What the profile shuffles: lines as read, and pairs of customer and part without the sums; the sums by brute force."""

import datetime as dt
import math

from bizlens.sources import profile as P

ORDERS = [(k, 1 if k < 7 else k % 3 + 1, dt.datetime(1994 + k % 6, 1 + k % 12, 3)) for k in range(12)]
LINES = [(i % 13, None if i % 11 == 0 else i % 5, 10.5 * (i + 1), i % 7 / 100, i % 9 / 100, float(i % 50 + 1),
          "RAN"[i % 3] if i % 8 else None, "FO"[i % 2]) for i in range(120)]


def _frames(spark):
    return (spark.createDataFrame(ORDERS, "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP"),
            spark.createDataFrame(LINES, "l_orderkey BIGINT, l_partkey BIGINT, l_extendedprice DOUBLE, l_discount DOUBLE, "
                                         "l_tax DOUBLE, l_quantity DOUBLE, l_returnflag STRING, l_linestatus STRING"))


def test_lines_join_orders_as_they_were_read(spark):
    plan = P.customer_order_stats(*_frames(spark))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner")
    assert "FLOOR" in above and "FLOOR" not in below


def test_pairs_carry_flags_only_and_customers_sums_once(spark):
    orders, lines = _frames(spark)
    joined = lines.join(orders.selectExpr("o_orderkey AS l_orderkey", "o_custkey AS custkey", "1 AS period"), "l_orderkey")
    rows = P.lines_and_parts(joined).collect()
    customers = {o[1] for o in ORDERS if o[0] in {x[0] for x in LINES}}
    assert sorted(r.custkey for r in rows if not r.of_part) == sorted(customers)
    pairs = [r for r in rows if r.of_part]
    assert len(pairs) == len({(r.custkey, r.part) for r in pairs}) > len(customers)
    assert all(r.net_cur is None and r.pieces is None and r.n_lines == 0 and r.parts_all == 1 for r in pairs)


def test_sums_and_distinct_parts_by_brute_force(spark):
    cur, prev, end = P._period_bounds(P.PERIOD_START, P.PERIOD_MONTHS)
    order = {k: (c, 0 if d >= end or d < prev else 1 if d >= cur else 2) for k, c, d in ORDERS}
    units = lambda x: math.floor(x * P.NET_SCALE + 0.5)
    want: dict = {}
    for k, part, price, off, tax, pieces, flag, status in LINES:
        if k in order:
            c, period = order[k]
            w = want.setdefault(c, {"net_cur": 0, "net_prev": 0, "tax_cur": 0, "pieces": 0, "n_lines": 0, "n_r": 0, "n_f": 0,
                                    "n_big": 0, "parts_cur": set(), "parts_prev": set(), "parts_all": set()})
            for name, of in (("cur", 1), ("prev", 2)):
                if period == of:
                    w[f"net_{name}"] += units(price * (1 - off))
                    w[f"parts_{name}"].add(part)
            w["tax_cur"] += units(price * tax) if period == 1 else 0
            w["pieces"] += int(pieces)
            w["n_lines"] += 1
            w["n_r"] += flag == "R"
            w["n_f"] += status == "F"
            w["n_big"] += pieces > P.BIG_LINE
            w["parts_all"].add(part)
    got = {r.custkey: r for r in P.customer_order_stats(*_frames(spark)).collect()}
    assert {w["n_lines"] for w in want.values()} and any(w["parts_cur"] for w in want.values()) and len(got) == len(want)
    for c, w in want.items():
        assert {n: got[c][n] or 0 for n in w} == {n: len(x) if isinstance(x, set) else x for n, x in w.items()}
