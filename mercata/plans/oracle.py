"""Reference SQL for every registered query, runnable by DuckDB on the supplied parquet views.

The SQL is written independently of the DataFrame code, straight from the report definitions
(including their literal forms, e.g. ratings joined to every verified day), so a match checks the
Spark plan's rewrites.  ``sql(body, *views)`` prefixes the canonical view CTEs a body needs.
"""

from __future__ import annotations

from mercata.params import SEGMENT_DEAL_LIMITS, Params

P = Params()


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def r4(x: str) -> str:
    """Report rounding of a DOUBLE: binary noise off (10 places), half-up to 4 places, back to DOUBLE."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 4) AS DOUBLE)"


def avg_dec(x: str) -> str:
    """Exact AVG of a DECIMAL(.., 2) column, rounded half-up to 6 decimals (a decimal AVG).

    DuckDB's AVG over DECIMAL returns DOUBLE; integer arithmetic on cents keeps it exact.
    """
    s = f"CAST(SUM({x}) * 100 AS HUGEINT)"
    n = f"NULLIF(COUNT({x}), 0)"
    return (f"(CAST(CASE WHEN {s} >= 0 THEN ({s} * 20000 + {n}) // (2 * {n}) "
            f"ELSE -((-{s}) * 20000 + {n}) // (2 * {n}) END AS DECIMAL(38,0)) * CAST(0.000001 AS DECIMAL(7,6)))")


# name -> (definition, dependencies)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "sales": ("""
        SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS seller_id, l_partkey AS offer_id,
               l_orderkey AS deal_id, l_orderkey AS order_offer_id, l_partkey AS category_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS INTEGER) AS quantity,
               l_returnflag = 'R' AS returned, l_shipdate AS shipped_at
        FROM lineitem""", ()),
    "sales_b": ("""
        SELECT s.*, o.o_custkey AS buyer_id, o.o_orderdate AS buyingtime
        FROM sales s JOIN orders o ON s.deal_id = o.o_orderkey""", ("sales",)),
    "order_headers": ("""
        SELECT o_orderkey AS order_offer_id, o_custkey AS buyer_id, CAST(o_orderdate AS DATE) AS day
        FROM orders""", ()),
    "refunds": ("""
        SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS seller_id, l_orderkey AS order_id,
               l_partkey AS offer_id, l_orderkey AS order_offer_id, l_partkey AS category_id,
               CAST(l_quantity AS INTEGER) AS refund_quantity,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS refunded_gmv, l_shipdate AS refund_finish_date
        FROM lineitem WHERE l_returnflag = 'R'""", ()),
    "offers_by_category": ("""
        SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS seller_id, l_partkey AS category_leaf,
               COUNT(*) AS offers
        FROM lineitem GROUP BY 1, 2, 3""", ()),
    "offers_total": ("""
        SELECT day, seller_id, COUNT(*) AS offers,
               COUNT(*) FILTER (WHERE (seller_id + year(day)) % 5 <> 0 AND l_quantity >= 25) AS offers_no_classifieds
        FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS seller_id, l_quantity FROM lineitem)
        GROUP BY day, seller_id""", ()),
    "verified_sellers": ("""
        SELECT DISTINCT l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS day
        FROM lineitem WHERE l_linestatus = 'F' AND (l_suppkey + year(l_shipdate)) % 3 <> 0""", ()),
    "verified_accounts": ("""
        SELECT DISTINCT user_id AS account_id, CAST(ts AS DATE) AS day
        FROM events WHERE event_type = 'signup'""", ()),
    "segment_monthly": ("""
        SELECT us_id, month_, CAST(us_id % 4 + 1 AS INTEGER) AS segment FROM (
            SELECT l_suppkey AS us_id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS month_ FROM lineitem
            UNION
            SELECT user_id, CAST(year(ts) * 100 + month(ts) AS INTEGER) FROM events)""", ()),
    "category_tree": ("""
        SELECT p_partkey AS ca_id_leaf, p_type AS new_meta, p_brand AS new_ca_name_1 FROM part""", ()),
    "owner_map": ("""
        SELECT c_custkey AS ud_us_id, CAST(c_nationkey AS VARCHAR) AS nip FROM customer""", ()),
    "owners": ("SELECT * FROM owner_map WHERE nip IS NOT NULL", ("owner_map",)),
    "test_users": ("SELECT c_custkey AS us_id FROM customer WHERE c_acctbal < 0", ()),
    "account_status_history": ("""
        SELECT c_custkey AS cis_user_id,
               CASE WHEN c_custkey % 5 = 0 THEN 'company' WHEN c_custkey % 5 = 1 THEN 'ver'
                    WHEN c_custkey % 5 = 4 THEN NULL ELSE 'plain' END AS cis_status,
               DATE '2000-01-01' + CAST(c_custkey % 500 AS INTEGER) AS cis_from_date,
               'N' AS cis_historical
        FROM customer
        UNION ALL
        SELECT c_custkey, 'company', DATE '1998-01-01' + CAST(c_custkey % 500 AS INTEGER), 'T'
        FROM customer WHERE c_custkey % 3 = 0""", ()),
    "last_logins": ("""
        SELECT user_id AS account_id, max(ts) AS success_login_timestamp FROM events GROUP BY user_id""", ()),
    "users": ("""
        SELECT c_custkey AS account_id, c_name AS login,
               CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'active' END AS account_status,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'company' ELSE 'private' END AS account_type,
               DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS account_create_date
        FROM customer""", ()),
    "consents": ("""
        SELECT CAST(ts AS DATE) AS day, user_id AS userid,
               CASE WHEN event_type = 'signup' THEN 'marketing' ELSE 'testing-invites' END AS consentname,
               CASE WHEN event_id % 2 = 0 THEN 'PHONE' ELSE 'EMAIL' END AS channel,
               value >= 50 AS approved
        FROM events WHERE event_type IN ('signup', 'click')""", ()),
    "net_gmv_daily": ("""
        SELECT CAST(l_shipdate AS DATE) AS dt, l_suppkey AS account_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS GMV_ref
        FROM lineitem WHERE l_returnflag <> 'R'""", ()),
    "ratings": ("""
        SELECT user_id AS opponent_id,
               CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN false ELSE true END AS recommend,
               ts AS create_date
        FROM events""", ()),
    "fees": ("""
        SELECT CAST(ts AS DATE) AS day, user_id AS account_id, event_type AS short_type,
               CAST(CAST(value AS DECIMAL(18,2)) - 50 AS DECIMAL(18,2)) AS gross_amount,
               CASE WHEN event_id % 10 = 0 THEN 'other' ELSE 'main' END AS marketplace
        FROM events""", ()),
    "fee_types": ("""
        SELECT * FROM (VALUES ('view', 'engagement'), ('click', 'engagement'), ('signup', 'acquisition'),
                              ('purchase', 'sales'), ('error', NULL)) AS t(id, my_group_desc)""", ()),
    "owner_list": ("""
        SELECT CAST(n_nationkey AS VARCHAR) AS nip FROM nation WHERE n_regionkey IN (1, 3)""", ()),
    "account_list": ("""
        SELECT c_custkey AS us_id, c_mktsegment AS list_segment, c_acctbal AS list_balance
        FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""", ()),
    "webinar_attendance": ("""
        SELECT user_id AS id, 'acct-' || CAST(user_id AS VARCHAR) AS account_name,
               'webinar-' || CAST(event_id % 4 AS VARCHAR) AS webinar_title
        FROM events WHERE event_type = 'signup'""", ()),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *views: str, ctes: str = "") -> str:
    """``WITH <views...>, <ctes> <body>``; ``ctes`` are extra named sub-queries."""
    parts = [f"{n} AS ({VIEWS[n][0]}\n)" for n in _order(views)]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# ---------------------------------------------------------------- top owners (net GMV hub)
T = P.top
_TW = f"BETWEEN {_d(T.date_start)} AND {_d(T.date_stop)}"

#: Grain of the hub: owner, month, meta category, level-1 category, order type.
_HUB = "nip, month, new_meta, new_ca_name_1, order_type"
_OPEN = f"month <> '{T.running_month}'"


def _share(weight: str, cond: str = "TRUE") -> str:
    """Positive part of the given opinions, each counted ``weight`` times."""
    return f"sum({weight}) FILTER (good AND {cond}) / nullif(sum({weight}) FILTER (given AND {cond}), 0)"


_RECENT = f"day >= {_d(T.rating_recent_start)}"
_3M = ", ".join(f"'{m}'" for m in T.recent_months)
TOP_CTES = f"""
-- every order line with its order's day and buyer type; in_time: the order day lies in the window
line AS (
    SELECT own.nip, li.price, li.returned, li.day AS ship_day, h.day AS order_day,
           coalesce(h.day {_TW}, FALSE) AS in_time, part.new_meta, part.new_ca_name_1,
           if(buyer.account_type = 'company', 'B2B', 'B2C') AS buyer_kind
    FROM sales AS li
    JOIN owners AS own ON own.ud_us_id = li.seller_id
    LEFT JOIN order_headers AS h ON h.order_offer_id = li.deal_id
    LEFT JOIN users AS buyer ON buyer.account_id = h.buyer_id
    LEFT JOIN category_tree AS part ON part.ca_id_leaf = li.category_id),
sold AS (
    SELECT nip, strftime(order_day, '%Y%m') AS month, new_meta, new_ca_name_1,
           coalesce(buyer_kind, 'B2C') AS order_type, sum(price) AS gmv
    FROM line WHERE in_time GROUP BY ALL),
-- a refund knows category and type only through an order of the window
back AS (
    SELECT nip, strftime(ship_day, '%Y%m') AS month, if(in_time, new_meta, NULL) AS new_meta,
           if(in_time, new_ca_name_1, NULL) AS new_ca_name_1,
           if(in_time, coalesce(buyer_kind, 'B2C'), 'B2C') AS order_type, sum(price) AS ref_gmv
    FROM line WHERE returned AND ship_day {_TW} GROUP BY ALL),
-- cells that were sold, less what came back in the same cell; what came back elsewhere has no owner, month or amount
hub AS (
    SELECT {_HUB}, gmv - coalesce(ref_gmv, 0) AS gmv FROM sold LEFT JOIN back USING ({_HUB})
    UNION ALL
    SELECT DISTINCT NULL, NULL, new_meta, new_ca_name_1, order_type, CAST(NULL AS DECIMAL(38,2))
    FROM back ANTI JOIN sold USING ({_HUB})),
owner_month AS (SELECT nip, month, sum(gmv) AS gmv FROM hub GROUP BY ALL),
wide AS (
    SELECT nip, sum(gmv) FILTER ({_OPEN}) AS gmv12m,
           {", ".join(f"round(sum(gmv) FILTER (month = '{m}'), 2) AS gmv_{m}" for m in T.pivot_months)},
           {", ".join(f"round(sum(gmv) FILTER (order_type = '{k}'), 2) AS gmv_{k}" for k in ("B2B", "B2C"))},
           {", ".join(f"round(sum(gmv) FILTER (order_type = '{k}' AND month IN ({_3M})), 2) AS gmv_{k}_3m" for k in ("B2B", "B2C"))}
    FROM hub GROUP BY nip),
-- one row a rating of the window; days: how often the rated account was verified in it
opinion AS (
    SELECT own.nip, CAST(r.create_date AS DATE) AS day, coalesce(r.recommend, FALSE) AS good, r.recommend IS NOT NULL AS given,
           (SELECT count(*) FROM verified_accounts AS c WHERE c.account_id = r.opponent_id
              AND c.day BETWEEN {_d(T.rating_start)} AND {_d(T.rating_stop)}) AS days
    FROM ratings AS r JOIN owners AS own ON own.ud_us_id = r.opponent_id
    WHERE CAST(r.create_date AS DATE) BETWEEN {_d(T.rating_start)} AND {_d(T.rating_stop)}),
rating AS (
    SELECT nip, count(*) FILTER (good) AS positive, count(*) FILTER (given) AS rated, {_share("1")} AS share,
           count(*) FILTER ({_RECENT}) AS n_recent,
           count(*) FILTER (good AND {_RECENT}) AS positive_3m, count(*) FILTER (given AND {_RECENT}) AS rated_3m,
           {_share("1", _RECENT)} AS share_3m, {_share("days")} AS weighted
    FROM opinion GROUP BY nip),
steady AS (
    SELECT nip, count(*) FILTER (gmv >= {T.monthly_gmv_limit}) AS months_over
    FROM owner_month WHERE nip IN (SELECT nip FROM rating WHERE weighted >= {T.min_rating_share})
    GROUP BY nip HAVING months_over >= {T.min_months}),
meta_sum AS (
    SELECT nip, new_meta, sum(gmv) AS total FROM hub WHERE {_OPEN} GROUP BY ALL),
meta_place AS (
    SELECT *, rank() OVER (PARTITION BY nip ORDER BY total DESC, new_meta) AS place FROM meta_sum),
sub_first AS (
    SELECT nip, new_ca_name_1, sum(gmv) AS total FROM hub WHERE {_OPEN} GROUP BY nip, new_meta, new_ca_name_1
    QUALIFY rank() OVER (PARTITION BY nip ORDER BY total DESC, new_meta) = 1),
podium AS (
    SELECT a.nip, a.new_meta, round(a.total, 2) AS gmv, sub_first.new_ca_name_1, round(sub_first.total, 2) AS gmv1,
           b.new_meta AS second_new_meta, round(b.total, 2) AS second_new_meta_gmv
    FROM meta_place AS a JOIN sub_first USING (nip)
    LEFT JOIN meta_place AS b ON b.nip = a.nip AND b.place = 2
    WHERE a.place = 1)
"""
TOP_VIEWS = ("sales", "owners", "users", "category_tree", "order_headers", "ratings", "verified_accounts")


def top(body: str) -> str:
    return sql(body, *TOP_VIEWS, ctes=TOP_CTES)


def _doubles(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


_MONTHS = tuple(f"gmv_{m}" for m in T.pivot_months)
_KINDS, _KINDS_3M = ("gmv_B2B", "gmv_B2C"), ("gmv_B2B_3m", "gmv_B2C_3m")

ORACLE: dict[str, str] = {
    "gross_by_cell": top(f"SELECT {_HUB}, {_doubles('gmv')} FROM sold"),
    "refund_by_cell": top(f"SELECT {_HUB}, {_doubles('ref_gmv')} FROM back"),
    "net_gmv_monthly": top(f"SELECT {_HUB}, {_doubles('gmv')} FROM hub"),
    "net_gmv_annual": top(f"SELECT nip, CAST(sum(gmv) AS DOUBLE) AS gmv FROM hub WHERE {_OPEN} GROUP BY nip"),
    "gmv_pivot_recent": top(f"SELECT nip, {_doubles(*_KINDS_3M)} FROM wide "
                            f"WHERE nip IN (SELECT nip FROM hub WHERE month IN ({_3M}))"),
    "gmv_pivot_months": top(f"SELECT nip, {_doubles(*_MONTHS)} FROM wide"),
    "gmv_pivot_type": top(f"SELECT nip, {_doubles(*_KINDS)} FROM wide"),
    "rating_quality": top(f"SELECT nip, positive, rated, {r4('share')} AS share FROM rating"),
    "rating_quality_3m": top(f"SELECT nip, positive_3m AS positive, rated_3m AS rated, {r4('share_3m')} AS share "
                             "FROM rating WHERE n_recent > 0"),
    "rating_qualified": top(f"SELECT nip, {r4('weighted')} AS share FROM rating WHERE weighted >= {T.min_rating_share}"),
    "gmv_qualified": top("SELECT nip, months_over FROM steady"),
    "top_categories": top("SELECT nip, new_meta, new_ca_name_1, second_new_meta, "
                          f"{_doubles('gmv', 'gmv1', 'second_new_meta_gmv')} FROM podium"),
    "top_owner_report": top(f"""
        SELECT nip, {r4('share')} AS rating_share, {r4('share_3m')} AS rating_share_3m,
               CAST(round(gmv12m, 2) AS DOUBLE) AS gmv12m, new_meta, new_ca_name_1, second_new_meta,
               {_doubles('gmv', 'gmv1', 'second_new_meta_gmv', *_MONTHS, *_KINDS, *_KINDS_3M)}
        FROM steady JOIN rating USING (nip) JOIN podium USING (nip) LEFT JOIN wide USING (nip)"""),
}


# ---------------------------------------------------------------- segmentation
S = P.seg
_SW = f"BETWEEN {_d(S.date_from)} AND {_d(S.date_to)}"
_LIM = SEGMENT_DEAL_LIMITS
_SEGMENTS = ("small", "medium", "large", "VIP")
_LABELS = "[" + ", ".join(f"'{x}'" for x in _SEGMENTS) + "]"
_LADDER = " ".join(f"WHEN p.avg_GMV >= cut.{x} AND p.avg_count_deals >= {_LIM[x]} THEN '{x}'" for x in reversed(_SEGMENTS))


def _with_total(keys: str, sums: str, rows: str) -> str:
    """Sums by keys and category, and by keys over all known categories as category 'Total'."""
    total = sums.replace("AS", "FILTER (new_meta IS NOT NULL) AS")
    return (f"SELECT {keys}, new_meta, {sums} FROM {rows} GROUP BY {keys}, new_meta UNION ALL "
            f"SELECT {keys}, 'Total', {total} FROM {rows} GROUP BY {keys} HAVING count(new_meta) > 0")


SEG_CTES = f"""
offer_line AS (
    SELECT f.day, f.seller_id, part.new_meta, f.offers,
           if(EXISTS (FROM verified_sellers AS v WHERE v.account_id = f.seller_id AND v.day = f.day),
              ({_LABELS})[m.segment], NULL) AS seller_segment
    FROM offers_by_category AS f
    LEFT JOIN category_tree AS part ON part.ca_id_leaf = f.category_leaf
    LEFT JOIN segment_monthly AS m ON m.us_id = f.seller_id AND m.month_ = year(f.day) * 100 + month(f.day)
    WHERE f.day {_SW}),
offer_day AS ({_with_total("day, seller_id, seller_segment", "sum(offers) AS n", "offer_line")}),
offer_month AS (
    SELECT strftime(day, '%Y%m') AS year_month, seller_id, new_meta, seller_segment, round(avg(n), 0) AS offers, min(day) AS min_date
    FROM offer_day GROUP BY ALL),
deal AS (
    SELECT strftime(li.day, '%Y%m') AS year_month, li.seller_id, part.new_meta, li.price
    FROM sales AS li LEFT JOIN category_tree AS part ON part.ca_id_leaf = li.category_id
    WHERE li.day {_SW} AND li.seller_id NOT IN (SELECT us_id FROM test_users)),
deal_month AS ({_with_total("year_month, seller_id", "sum(price) AS GMV, count(*) AS count_deals", "deal")}),
favourite AS (
    SELECT seller_id, new_meta AS maincat FROM deal GROUP BY seller_id, new_meta
    QUALIFY rank() OVER (PARTITION BY seller_id ORDER BY sum(price) DESC, new_meta) = 1),
account_now AS (
    SELECT cis_user_id, cis_status, cis_from_date, ever AS company
    FROM (SELECT *, CAST(bool_or(coalesce(cis_status = 'company', FALSE)) OVER (PARTITION BY cis_user_id) AS INTEGER) AS ever
          FROM account_status_history)
    WHERE cis_historical = 'N'),
profile AS (
    SELECT nip, seller_id, account_now.cis_status AS actual_account_status, account_now.cis_from_date AS last_date_account_status,
           account_now.company AS company_history, seller_segment, new_meta, maincat,
           CAST(seller_id IN (SELECT seller_id FROM offers_by_category WHERE day = {_d(S.yesterday)}) AS INTEGER) AS yesterday,
           sum(GMV) AS sum_GMV, {avg_dec('GMV')} AS avg_GMV, avg(count_deals) AS avg_count_deals, avg(offers) AS avg_count_offers,
           min(min_date) AS min_date, count(DISTINCT if(GMV IS NULL, NULL, year_month)) AS count_month_sales,
           count(DISTINCT year_month) AS count_month_offers
    FROM offer_month
    LEFT JOIN deal_month USING (seller_id, new_meta, year_month)
    LEFT JOIN favourite USING (seller_id)
    LEFT JOIN account_now ON account_now.cis_user_id = seller_id
    LEFT JOIN owner_map ON owner_map.ud_us_id = seller_id
    GROUP BY ALL),
filled AS (
    SELECT * REPLACE (coalesce(avg_GMV, 0) AS avg_GMV, coalesce(avg_count_deals, 0) AS avg_count_deals,
                      coalesce(avg_count_offers, 0) AS avg_count_offers),
           coalesce(actual_account_status IN ('company', 'ver'), FALSE) AS is_verified
    FROM profile),
owner_cell AS (
    SELECT nip, seller_segment, new_meta, sum(avg_GMV) AS avg_GMV, sum(avg_count_deals) AS avg_count_deals,
           avg(avg_count_offers) AS avg_count_offers
    FROM filled WHERE is_verified AND nip IS NOT NULL AND seller_segment IS NOT NULL AND new_meta IS NOT NULL GROUP BY ALL),
cut AS (
    SELECT new_meta, {", ".join(f"quantile_cont(CAST(avg_GMV AS DOUBLE), {S.quantile}) FILTER (seller_segment = '{x}' AND avg_count_deals >= {_LIM[x]}) AS {x}" for x in _SEGMENTS)}
    FROM owner_cell GROUP BY new_meta),
assigned AS (
    SELECT p.* REPLACE (round_even(p.avg_GMV, 0) AS avg_GMV, round_even(p.avg_count_deals, 0) AS avg_count_deals,
                        round_even(p.avg_count_offers, 0) AS avg_count_offers),
           CASE {_LADDER} ELSE 'lack' END AS new_segment,
           (SELECT nullif(count(DISTINCT o.new_meta), 0) FROM filled AS o
            WHERE o.seller_id = p.seller_id AND NOT o.is_verified AND o.new_meta IS DISTINCT FROM 'Total') AS category_count
    FROM filled AS p LEFT JOIN cut ON cut.new_meta = p.new_meta
    WHERE NOT p.is_verified)
"""
SEG_VIEWS = ("offers_by_category", "category_tree", "verified_sellers", "segment_monthly", "sales", "test_users",
             "account_status_history", "owner_map")


def seg(body: str) -> str:
    return sql(body, *SEG_VIEWS, ctes=SEG_CTES)


_PROFILE_COLS = """nip, seller_id, actual_account_status, last_date_account_status,
    CAST(company_history AS BIGINT) AS company_history, seller_segment, new_meta, maincat,
    CAST(yesterday AS BIGINT) AS yesterday, CAST(sum_GMV AS DOUBLE) AS sum_GMV,
    CAST(avg_GMV AS DOUBLE) AS avg_GMV, CAST(ROUND(CAST(avg_count_deals AS DECIMAL(38,10)), 4) AS DOUBLE) AS avg_count_deals,
    CAST(ROUND(CAST(avg_count_offers AS DECIMAL(38,10)), 4) AS DOUBLE) AS avg_count_offers, min_date, count_month_sales, count_month_offers"""

ORACLE.update({
    "monthly_offer_panel": seg("SELECT year_month, seller_id, new_meta, seller_segment, offers, min_date FROM offer_month"),
    "monthly_sales_panel": seg("SELECT year_month, seller_id, new_meta, CAST(GMV AS DOUBLE) AS GMV, count_deals "
                               "FROM deal_month"),
    "main_category": seg("SELECT seller_id, maincat FROM favourite"),
    "current_account_status": seg("SELECT cis_user_id, cis_status, cis_from_date, CAST(company AS BIGINT) AS company "
                                  "FROM account_now"),
    "seller_profile": seg(f"SELECT {_PROFILE_COLS} FROM profile"),
    "profile_with_total": seg(f"SELECT {_PROFILE_COLS} FROM filled"),
    "verified_owner_rollup": seg("SELECT nip, seller_segment, new_meta, CAST(avg_GMV AS DOUBLE) AS avg_GMV, "
                                 "CAST(ROUND(CAST(avg_count_deals AS DECIMAL(38,10)), 4) AS DOUBLE) AS avg_count_deals, "
                                 "CAST(ROUND(CAST(avg_count_offers AS DECIMAL(38,10)), 4) AS DOUBLE) AS avg_count_offers FROM owner_cell"),
    "segment_thresholds": seg("SELECT new_meta, CAST(ROUND(CAST(small AS DECIMAL(38,10)), 4) AS DOUBLE) AS small, CAST(ROUND(CAST(medium AS DECIMAL(38,10)), 4) AS DOUBLE) AS medium, "
                              "CAST(ROUND(CAST(large AS DECIMAL(38,10)), 4) AS DOUBLE) AS large, CAST(ROUND(CAST(VIP AS DECIMAL(38,10)), 4) AS DOUBLE) AS VIP FROM cut"),
    "thresholds_long": seg("SELECT new_meta, segment, CAST(ROUND(CAST(quartile AS DECIMAL(38,10)), 4) AS DOUBLE) AS quartile FROM cut "
                           "UNPIVOT INCLUDE NULLS (quartile FOR segment IN (small, medium, large, VIP))"),
    "assign_segment": seg("""
        SELECT seller_id, actual_account_status, last_date_account_status,
               CAST(company_history AS BIGINT) AS company_history, new_meta, maincat,
               CAST(sum_GMV AS DOUBLE) AS sum_GMV, min_date, CAST(avg_GMV AS DOUBLE) AS avg_GMV,
               CAST(avg_count_deals AS DOUBLE) AS avg_count_deals, CAST(avg_count_offers AS DOUBLE) AS avg_count_offers,
               CAST(yesterday AS BIGINT) AS yesterday, count_month_sales, count_month_offers, new_segment,
               category_count
        FROM assigned"""),
})


# ---------------------------------------------------------------- status change
ST = P.status
_STW = f"BETWEEN {_d(ST.date_from)} AND {_d(ST.date_to)}"
STATUS_CTES = f"""
-- one row a seller and year with an offer; test accounts are out before years are compared
seller_year AS (
    SELECT seller_id, year(day) AS year, sum(offers) AS sum_of_offers, sum(offers_no_classifieds) AS sum_of_offers_no_clasifieds,
           CAST((seller_id, year(day)) IN (SELECT (account_id, year(day)) FROM verified_sellers WHERE day {_STW}) AS INTEGER) AS verified
    FROM offers_total WHERE day {_STW} AND seller_id NOT IN (SELECT us_id FROM test_users)
    GROUP BY ALL),
yearly AS (
    SELECT cur.*, cur.verified - prev.verified AS verified_status
    FROM seller_year AS cur ASOF LEFT JOIN seller_year AS prev ON prev.seller_id = cur.seller_id AND cur.year > prev.year),
marked AS (
    SELECT * REPLACE (coalesce(verified_status, 0) AS verified_status),
           CAST(sum_of_offers > 0 AND sum_of_offers_no_clasifieds = 0 AS INTEGER) AS only_clasifieds
    FROM yearly),
change AS (
    SELECT year, verified_status, only_clasifieds, sum(sum_of_offers) AS sum_of_offers,
           sum(sum_of_offers_no_clasifieds) AS sum_of_offers_no_clasifieds, count(*) AS count_seller_id,
           (['company -> regular', 'no change', 'regular -> company'])[verified_status + 2] AS verified_status_desc,
           if(only_clasifieds = 1, 'yes', 'no') AS only_clasifieds_desc
    FROM marked GROUP BY ALL),
change_share AS (
    SELECT a.year, a.verified_status, a.verified_status_desc, a.n AS count_seller_id,
           a.n / (SELECT count(*) FROM marked AS m WHERE m.year = a.year) AS share
    FROM (SELECT year, verified_status, verified_status_desc, sum(count_seller_id) AS n FROM change GROUP BY ALL) AS a)
"""


def status(body: str) -> str:
    return sql(body, "offers_total", "verified_sellers", "test_users", ctes=STATUS_CTES)


_YEARLY_COLS = ("seller_id, year, CAST(verified AS BIGINT) AS verified, CAST(verified_status AS BIGINT) AS verified_status, "
                "CAST(sum_of_offers AS BIGINT) AS sum_of_offers, "
                "CAST(sum_of_offers_no_clasifieds AS BIGINT) AS sum_of_offers_no_clasifieds")

ORACLE.update({
    "yearly_status_change": status(f"SELECT {_YEARLY_COLS} FROM yearly"),
    "status_change_summary": status("""
        SELECT year, CAST(verified_status AS BIGINT) AS verified_status, CAST(only_clasifieds AS BIGINT) AS only_clasifieds,
               CAST(sum_of_offers AS BIGINT) AS sum_of_offers,
               CAST(sum_of_offers_no_clasifieds AS BIGINT) AS sum_of_offers_no_clasifieds,
               count_seller_id, verified_status_desc, only_clasifieds_desc
        FROM change"""),
    "status_change_share": status(f"""
        SELECT year, CAST(verified_status AS BIGINT) AS verified_status, verified_status_desc,
               CAST(count_seller_id AS BIGINT) AS count_seller_id, {r4('share')} AS share
        FROM change_share"""),
    "status_head_sample": status(f"SELECT {_YEARLY_COLS} FROM yearly ORDER BY seller_id, year LIMIT 1000"),
    "only_classified_sellers": status("""
        SELECT seller_id, year, CAST(verified AS BIGINT) AS verified, CAST(verified_status AS BIGINT) AS verified_status,
               CAST(sum_of_offers AS BIGINT) AS sum_of_offers,
               CAST(sum_of_offers_no_clasifieds AS BIGINT) AS sum_of_offers_no_clasifieds,
               CAST(only_clasifieds AS BIGINT) AS only_clasifieds
        FROM marked WHERE only_clasifieds = 1 AND year = 2001"""),
})


# ---------------------------------------------------------------- accounts and owners
A = P.acct
ACCOUNT_CTES = f"""
ac_consents AS (
    SELECT userid, consentname, channel FROM consents
    WHERE day = {_d(A.events_yesterday)} AND approved = true
      AND consentname IN ('marketing', 'testing-invites') AND channel IN ('PHONE', 'EMAIL')),
ac_base AS (
    SELECT l.*, u.login, u.account_status, u.account_type
    FROM account_list l LEFT JOIN users u ON l.us_id = u.account_id),
ac_gmv AS (
    SELECT b.us_id, SUM(g.GMV_ref) AS gmv_30dni
    FROM net_gmv_daily g JOIN ac_base b ON g.account_id = b.us_id
    WHERE g.dt BETWEEN {_d(A.sales_yesterday)} - INTERVAL 29 DAY AND {_d(A.sales_yesterday)}
    GROUP BY 1),
ac_enriched AS (
    SELECT b.*, g.gmv_30dni, o.offers,
           CASE WHEN zm.userid IS NOT NULL THEN 'yes' ELSE 'no' END AS consent_marketing_phone,
           CASE WHEN zt.userid IS NOT NULL THEN 'yes' ELSE 'no' END AS consent_testing_email
    FROM ac_base b
    LEFT JOIN ac_gmv g ON b.us_id = g.us_id
    LEFT JOIN offers_total o ON g.us_id = o.seller_id AND o.day = {_d(A.sales_yesterday)}
    LEFT JOIN (SELECT DISTINCT userid FROM ac_consents WHERE consentname = 'marketing' AND channel IN ('PHONE')) zm
           ON zm.userid = b.us_id
    LEFT JOIN (SELECT DISTINCT userid FROM ac_consents WHERE consentname = 'testing-invites' AND channel IN ('EMAIL')) zt
           ON zt.userid = b.us_id),
at_offers AS (SELECT DISTINCT seller_id FROM offers_total WHERE day = {_d(A.sales_yesterday)}),
at_gmv AS (
    SELECT account_id, MIN(dt) AS first_sale_date, COUNT(DISTINCT dt) AS days_with_sales,
           SUM(GMV_ref) AS sum_gmv, {avg_dec('GMV_ref')} AS avg_gmv
    FROM net_gmv_daily WHERE dt >= {_d(A.gmv_open_from)} GROUP BY account_id),
at_logins AS (SELECT DISTINCT id, account_name FROM webinar_attendance),
at_webinars AS (
    SELECT id, COUNT(*) AS attendances, string_agg(webinar_title, ', ' ORDER BY webinar_title) AS webinar_titles,
           MIN(webinar_title) AS webinar_title
    FROM webinar_attendance GROUP BY id),
attendees AS (
    SELECT u.login, u.account_id AS id, n.nip, l.account_name, u.account_create_date,
           g.first_sale_date, g.days_with_sales, ROUND(g.sum_gmv, 2) AS sum_GMV_ref,
           ROUND(g.avg_gmv, 2) AS daily_avg_GMV,
           CASE WHEN o.seller_id IS NULL THEN 'no' ELSE 'yes' END AS have_offer_yesterday,
           w.webinar_titles, w.webinar_title, w.attendances
    FROM users u
    LEFT JOIN owner_map n ON n.ud_us_id = u.account_id
    RIGHT JOIN at_logins l ON l.id = u.account_id
    LEFT JOIN at_gmv g ON g.account_id = u.account_id
    LEFT JOIN at_offers o ON o.seller_id = u.account_id
    LEFT JOIN at_webinars w ON w.id = u.account_id
    WHERE u.account_id IS NOT NULL),
af_base AS (
    SELECT v.account_id, n.nip, s.segment,
           CASE WHEN m.userid IS NULL THEN 0 ELSE 1 END AS marketing,
           CASE WHEN tu.us_id IS NULL THEN 0 ELSE 1 END AS test_account,
           COALESCE(o.offers, 0) AS offers
    FROM verified_accounts v
    LEFT JOIN owner_map n ON n.ud_us_id = v.account_id
    LEFT JOIN segment_monthly s ON s.us_id = v.account_id AND s.month_ = {A.activity_month}
    LEFT JOIN test_users tu ON tu.us_id = v.account_id
    LEFT JOIN (SELECT userid FROM consents
               WHERE day = {_d(A.activity_day)} AND consentname = 'marketing' AND approved = true
               GROUP BY userid) m ON m.userid = v.account_id
    LEFT JOIN (SELECT seller_id, SUM(offers) AS offers FROM offers_total
               WHERE day = {_d(A.sales_yesterday)} GROUP BY seller_id) o ON o.seller_id = v.account_id
    WHERE v.day = {_d(A.activity_day)}),
af_flags AS (
    SELECT nip, segment, segment_desc,
           CASE WHEN marketing > 0 THEN 1 ELSE 0 END AS marketing,
           CASE WHEN offers > 0 THEN 1 ELSE 0 END AS active_yesterday
    FROM (SELECT nip, segment,
                 CASE segment WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large' WHEN 4 THEN 'VIP' END
                     AS segment_desc,
                 SUM(marketing) AS marketing, SUM(offers) AS offers
          FROM af_base WHERE test_account = 0 GROUP BY nip, segment)),
ll AS (
    SELECT nip, ever_offer, MAX(success_login_timestamp) AS max_log, COUNT(account_id) AS accounts
    FROM (SELECT v.account_id, n.nip,
                 CASE WHEN tu.us_id IS NULL THEN 0 ELSE 1 END AS test_account,
                 CASE WHEN o.seller_id IS NULL THEN 0 ELSE 1 END AS ever_offer,
                 l.success_login_timestamp
          FROM verified_accounts v
          LEFT JOIN owner_map n ON n.ud_us_id = v.account_id
          LEFT JOIN test_users tu ON tu.us_id = v.account_id
          LEFT JOIN (SELECT user_id AS account_id, max(ts) AS success_login_timestamp FROM events
                     WHERE CAST(ts AS DATE) <= {_d(A.events_yesterday)} GROUP BY user_id) l ON l.account_id = v.account_id
          LEFT JOIN (SELECT DISTINCT seller_id FROM offers_total WHERE day <= {_d(A.sales_yesterday)}) o ON o.seller_id = v.account_id
          WHERE v.day = {_d(A.events_yesterday)})
    WHERE test_account = 0
    GROUP BY nip, ever_offer)
"""
ACCOUNT_VIEWS = ("consents", "account_list", "users", "net_gmv_daily", "offers_total", "webinar_attendance",
                 "owner_map", "verified_accounts", "segment_monthly", "test_users", "last_logins", "owner_list")


def acct(body: str) -> str:
    return sql(body, *ACCOUNT_VIEWS, ctes=ACCOUNT_CTES)


ORACLE.update({
    "account_enrichment": acct("""
        SELECT us_id, list_segment, list_balance, login, account_status, account_type,
               CAST(gmv_30dni AS DOUBLE) AS gmv_30dni, offers, consent_marketing_phone, consent_testing_email
        FROM ac_enriched"""),
    "owner_active_offers": acct(f"""
        SELECT n.nip, CAST(SUM(o.offers) AS BIGINT) AS offers
        FROM offers_total o
        JOIN owner_map n ON n.ud_us_id = o.seller_id
        JOIN owner_list l ON l.nip = n.nip
        WHERE o.day = {_d(A.sales_yesterday)}
        GROUP BY n.nip"""),
    "attendee_enrichment": acct("""
        SELECT login, id, nip, account_name, account_create_date, first_sale_date, days_with_sales,
               CAST(sum_GMV_ref AS DOUBLE) AS sum_GMV_ref, CAST(daily_avg_GMV AS DOUBLE) AS daily_avg_GMV,
               have_offer_yesterday, webinar_titles, webinar_title, attendances
        FROM attendees"""),
    "owner_activity_flags": acct("""
        SELECT nip, CAST(segment AS BIGINT) AS segment, segment_desc, CAST(marketing AS BIGINT) AS marketing,
               CAST(active_yesterday AS BIGINT) AS active_yesterday
        FROM af_flags"""),
    "active_owner_count": acct("SELECT COUNT(*) AS rows FROM af_flags WHERE active_yesterday = 1"),
    "owner_last_login": acct("SELECT nip, CAST(ever_offer AS BIGINT) AS ever_offer, max_log, accounts FROM ll"),
    "login_recency_summary": acct(f"""
        SELECT CAST(ever_offer AS BIGINT) AS ever_offer, CAST(recent_login AS BIGINT) AS recent_login,
               COUNT(nip) AS owners, CAST(SUM(accounts) AS BIGINT) AS accounts
        FROM (SELECT *, CASE WHEN COALESCE(max_log, TIMESTAMP '{A.login_never}') >= TIMESTAMP '{A.login_cutoff}'
                             THEN 1 ELSE 0 END AS recent_login FROM ll)
        GROUP BY 1, 2"""),
})


# ---------------------------------------------------------------- ledger
L = P.ledger
_LW = f"BETWEEN {_d(L.date_from)} AND {_d(L.date_to)}"
ORACLE["order_refund_ledger"] = sql(f"""
    SELECT 'refund' AS typ, n.nip AS ud_nip, r.order_id, r.offer_id, CAST(r.refund_quantity AS BIGINT) AS refund_quantity,
           CAST(r.refunded_gmv AS DOUBLE) AS refunded_gmv, CAST(o.o_orderdate AS DATE) AS order_date,
           CAST(r.refund_finish_date AS DATE) AS refund_date
    FROM refunds r
    JOIN orders o ON o.o_orderkey = r.order_id
    JOIN lg_nip n ON n.ud_us_id = r.seller_id
    WHERE r.day {_LW}
    UNION ALL
    SELECT 'order', n.nip, s.deal_id, s.offer_id, CAST(s.quantity AS BIGINT), CAST(s.price AS DOUBLE),
           CAST(s.buyingtime AS DATE), NULL
    FROM sales_b s
    JOIN lg_nip n ON n.ud_us_id = s.seller_id
    WHERE s.day {_LW}""", "refunds", "sales_b", "owner_map",
    ctes=f"lg_nip AS (SELECT * FROM owner_map WHERE nip = '{L.owner}')")


# ---------------------------------------------------------------- follow-ups
FU = P.follow
FOLLOW_CTES = f"""
fu_vips AS (SELECT l.nip, m.ud_us_id AS id FROM owner_list l LEFT JOIN owners m ON m.nip = l.nip),
fs_billings AS (
    SELECT f.account_id AS id, f.short_type, t.my_group_desc, f.gross_amount, strftime(f.day, '%Y%m') AS month
    FROM fees f JOIN fee_types t ON f.short_type = t.id AND t.my_group_desc IS NOT NULL
    WHERE f.day BETWEEN {_d(FU.fee_start)} AND {_d(FU.fee_stop)} AND f.marketplace = '{FU.marketplace}'),
fee_q AS (
    SELECT * FROM (
        SELECT b.month, v.nip, b.short_type, b.my_group_desc, SUM(b.gross_amount) AS amount
        FROM fs_billings b JOIN fu_vips v ON v.id = b.id
        GROUP BY 1, 2, 3, 4)
    WHERE abs(amount) > 0),
fc_dates AS (
    SELECT strftime(d, '%Y%m') AS month
    FROM (SELECT unnest(generate_series({_d(FU.forecast_start)}, {_d(FU.forecast_stop)}, INTERVAL 1 MONTH)) AS d)),
fc_grid AS (SELECT l.nip, d.month FROM owner_list l CROSS JOIN fc_dates d),
fc_offers AS (
    SELECT strftime(date, '%Y%m') AS month, nip, CAST(ROUND(CAST(AVG(offers) AS DECIMAL(38,10)), 2) AS DOUBLE) AS offers
    FROM (SELECT o.day AS date, v.nip, SUM(o.offers) AS offers
          FROM offers_total o JOIN fu_vips v ON v.id = o.seller_id
          WHERE o.day BETWEEN {_d(FU.forecast_start)} AND {_d(FU.forecast_stop)}
          GROUP BY 1, 2)
    GROUP BY 1, 2),
fc_gmv AS (
    SELECT strftime(g.dt, '%Y%m') AS month, v.nip, SUM(g.GMV_ref) AS gmv
    FROM net_gmv_daily g RIGHT JOIN fu_vips v ON v.id = g.account_id
    WHERE g.dt BETWEEN {_d(FU.forecast_start)} AND {_d(FU.forecast_stop)}
    GROUP BY 1, 2),
forecast AS (
    SELECT t.nip, t.month, COALESCE(o.offers, 0) AS offers, COALESCE(g.gmv, 0) AS gmv
    FROM fc_grid t
    LEFT JOIN fc_offers o ON o.month = t.month AND o.nip = t.nip
    LEFT JOIN fc_gmv g ON g.nip = o.nip AND g.month = o.month)
"""


def follow(body: str) -> str:
    return sql(body, "owner_list", "owners", "fees", "fee_types", "offers_total", "net_gmv_daily", ctes=FOLLOW_CTES)


ORACLE.update({
    "fee_summary": follow("SELECT month, nip, short_type, my_group_desc, CAST(amount AS DOUBLE) AS amount FROM fee_q"),
    "forecast_panel": follow("SELECT nip, month, CAST(offers AS DOUBLE) AS offers, CAST(gmv AS DOUBLE) AS gmv FROM forecast"),
})


# ---------------------------------------------------------------- single operators
_SALES_META = f"""
sm AS (SELECT s.*, ct.new_meta FROM sales s LEFT JOIN category_tree ct ON ct.ca_id_leaf = s.category_id
       WHERE s.day {_TW})"""
ORACLE.update({
    "scan_date_range": sql(f"""
        SELECT day, COUNT(*) AS lines, CAST(SUM(price) AS DOUBLE) AS gmv
        FROM sales WHERE day {_TW} GROUP BY day""", "sales"),
    "scan_day_snapshot": sql(f"""
        SELECT userid, consentname, channel, approved FROM consents WHERE day = {_d(A.events_yesterday)}""",
                             "consents"),
    "filter_null_safe_not_equal": sql("""
        SELECT cis_status, COUNT(*) AS accounts FROM account_status_history
        WHERE cis_historical = 'N' AND cis_status IS DISTINCT FROM 'company' AND cis_status IS DISTINCT FROM 'ver'
        GROUP BY 1""", "account_status_history"),
    "filter_drops_nulls": sql("""
        SELECT cis_status, COUNT(*) AS accounts FROM account_status_history
        WHERE cis_historical = 'N' AND cis_status <> 'company'
        GROUP BY 1""", "account_status_history"),
    "existence_flag": sql("""
        SELECT c.c_custkey AS account_id, CAST(CASE WHEN s.seller_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS is_seller
        FROM customer c LEFT JOIN (SELECT DISTINCT seller_id FROM sales) s ON s.seller_id = c.c_custkey""",
                          "sales"),
    "restrict_to_list": sql("""
        SELECT nip, COUNT(*) AS accounts FROM owner_map WHERE nip IN (SELECT nip FROM owner_list) GROUP BY nip""",
                            "owner_map", "owner_list"),
    "grouping_total": sql("""
        SELECT strftime(day, '%Y%m') AS month, new_meta, CAST(SUM(price) AS DOUBLE) AS gmv, COUNT(*) AS lines
        FROM sm GROUP BY 1, 2
        UNION ALL
        SELECT strftime(day, '%Y%m'), 'Total', CAST(SUM(price) AS DOUBLE), COUNT(*)
        FROM sm WHERE new_meta IS NOT NULL GROUP BY 1""", "sales", "category_tree", ctes=_SALES_META),
    "union_by_name": sql("""
        SELECT strftime(day, '%Y%m') AS month, new_meta, CAST(SUM(price) AS DOUBLE) AS gmv FROM sm GROUP BY 1, 2
        UNION ALL
        SELECT strftime(day, '%Y%m'), NULL, CAST(SUM(price) AS DOUBLE) FROM sm GROUP BY 1""",
                         "sales", "category_tree", ctes=_SALES_META),
    "group_quantile": sql(f"""
        SELECT new_meta, {r4('quantile_cont(CAST(gmv AS DOUBLE), 0.25)')} AS q1,
               {r4('quantile_cont(CAST(gmv AS DOUBLE), 0.5)')} AS median
        FROM (SELECT seller_id, new_meta, SUM(price) AS gmv FROM sm GROUP BY 1, 2)
        GROUP BY new_meta""", "sales", "category_tree", ctes=_SALES_META),
    "lag_delta": sql("""
        SELECT seller_id, year, CAST(gmv AS DOUBLE) AS gmv,
               CAST(gmv - LAG(gmv) OVER (PARTITION BY seller_id ORDER BY year) AS DOUBLE) AS gmv_change
        FROM (SELECT seller_id, year(day) AS year, SUM(price) AS gmv FROM sales GROUP BY 1, 2)""", "sales"),
    "round_modes": sql(f"""
        SELECT seller_id, year, {r4('avg_quantity')} AS avg_quantity, ROUND(avg_quantity, 0) AS half_up,
               round_even(avg_quantity, 0) AS half_even
        FROM (SELECT l_suppkey AS seller_id, year(l_shipdate) AS year, AVG(l_quantity) AS avg_quantity
              FROM lineitem GROUP BY 1, 2)"""),
    "safe_ratio_daily": sql(f"""
        SELECT user_id, day, purchases, errors, {r4('purchases / NULLIF(errors, 0)')} AS ratio
        FROM (SELECT user_id, CAST(ts AS DATE) AS day,
                     COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
                     COUNT(*) FILTER (WHERE event_type = 'error') AS errors
              FROM events GROUP BY 1, 2)"""),
})

ORACLE["owner_active_offers_sql"] = ORACLE["owner_active_offers"]

_SW2 = f"BETWEEN {_d(S.date_from)} AND {_d(S.date_to)}"
ORACLE.update({
    "scan_open_range": sql(f"""
        SELECT account_id, COUNT(DISTINCT dt) AS days, CAST(SUM(GMV_ref) AS DOUBLE) AS gmv
        FROM net_gmv_daily WHERE dt >= {_d(A.gmv_open_from)} GROUP BY 1""", "net_gmv_daily"),
    "scan_trailing_30d": sql(f"""
        SELECT account_id, CAST(SUM(GMV_ref) AS DOUBLE) AS gmv_30d FROM net_gmv_daily
        WHERE dt BETWEEN {_d(A.sales_yesterday)} - INTERVAL 29 DAY AND {_d(A.sales_yesterday)} GROUP BY 1""",
                             "net_gmv_daily"),
    "filter_in_list": sql("""
        SELECT consentname, channel, COUNT(DISTINCT userid) AS accounts FROM consents
        WHERE approved AND consentname IN ('marketing', 'testing-invites') AND channel IN ('PHONE')
        GROUP BY 1, 2""", "consents"),
    "filter_multi": sql(f"""
        SELECT seller_id, COUNT(*) AS lines FROM sales
        WHERE day {_TW} AND quantity >= 45 AND price >= 50000 GROUP BY 1""", "sales"),
    "join_same_day": sql(f"""
        SELECT strftime(o.day, '%Y%m') AS month, CAST(SUM(o.offers) AS BIGINT) AS offers,
               CAST(SUM(CASE WHEN v.account_id IS NOT NULL THEN o.offers ELSE 0 END) AS BIGINT) AS verified_offers
        FROM offers_total o
        LEFT JOIN verified_sellers v ON v.account_id = o.seller_id AND v.day = o.day
        WHERE o.day {_SW2} GROUP BY 1""", "offers_total", "verified_sellers"),
    "join_month_key": sql(f"""
        SELECT CAST(year(o.day) * 100 + month(o.day) AS BIGINT) AS month_, CAST(u.segment AS BIGINT) AS segment,
               CAST(SUM(o.offers) AS BIGINT) AS offers
        FROM offers_total o
        LEFT JOIN segment_monthly u ON u.us_id = o.seller_id AND u.month_ = year(o.day) * 100 + month(o.day)
        WHERE o.day {_SW2} GROUP BY 1, 2""", "offers_total", "segment_monthly"),
    "exclude_test_accounts": sql(f"""
        SELECT strftime(day, '%Y%m') AS month, CAST(SUM(price) AS DOUBLE) AS gmv FROM sales
        WHERE day {_TW} AND seller_id NOT IN (SELECT us_id FROM test_users) GROUP BY 1""", "sales", "test_users"),
    "left_join_filtered_right": sql(f"""
        SELECT strftime(r.day, '%Y%m') AS month, COUNT(*) AS refunds, COUNT(h.order_offer_id) AS with_order_in_window
        FROM refunds r LEFT JOIN order_headers h ON h.order_offer_id = r.order_offer_id AND h.day {_TW}
        WHERE r.day {_TW} GROUP BY 1""", "refunds", "order_headers"),
    "agg_basic": sql(f"""
        SELECT seller_id, CAST(SUM(price) AS DOUBLE) AS gmv, CAST({avg_dec('price')} AS DOUBLE) AS avg_price,
               CAST(MIN(price) AS DOUBLE) AS min_price, CAST(MAX(price) AS DOUBLE) AS max_price,
               COUNT(*) AS lines, MIN(day) AS first_day
        FROM sales WHERE day {_TW} GROUP BY 1""", "sales"),
    "agg_distinct": sql(f"""
        SELECT seller_id, COUNT(DISTINCT offer_id) AS offers, COUNT(DISTINCT day) AS days,
               COUNT(DISTINCT strftime(day, '%Y%m')) AS months
        FROM sales WHERE day {_TW} GROUP BY 1""", "sales"),
    "group_nunique": sql("SELECT seller_id, COUNT(DISTINCT new_meta) AS categories FROM sm GROUP BY 1",
                         "sales", "category_tree", ctes=_SALES_META),
    "group_drop_null_keys": sql("""
        SELECT a.cis_status, o.nip, COUNT(*) AS accounts
        FROM account_status_history a JOIN owner_map o ON a.cis_user_id = o.ud_us_id
        WHERE a.cis_historical = 'N' AND a.cis_status IS NOT NULL AND o.nip IS NOT NULL
        GROUP BY 1, 2""", "account_status_history", "owner_map"),
    "share_of_group": sql(f"""
        SELECT month, new_meta, CAST(gmv AS DOUBLE) AS gmv,
               {r4('CAST(gmv AS DOUBLE) / CAST(SUM(gmv) OVER (PARTITION BY month) AS DOUBLE)')} AS share
        FROM (SELECT strftime(day, '%Y%m') AS month, new_meta, SUM(price) AS gmv FROM sm GROUP BY 1, 2)""",
                          "sales", "category_tree", ctes=_SALES_META),
    "distinct_rows": sql(f"""
        SELECT strftime(day, '%Y%m') AS month, COUNT(*) AS seller_days
        FROM (SELECT DISTINCT account_id, day FROM verified_sellers WHERE day {_SW2}) GROUP BY 1""",
                         "verified_sellers"),
    "dates_month_year": sql("""
        SELECT year(CAST(ts AS DATE)) AS year, strftime(CAST(ts AS DATE), '%Y%m') AS month, CAST(ts AS DATE) AS day,
               COUNT(*) AS events
        FROM events GROUP BY 1, 2, 3"""),
})

ORACLE["join_full_outer_net"] = ORACLE["net_gmv_monthly"]


_QUALIFIED_FOLLOW = TOP_CTES.rstrip().rstrip(",") + ",\nqualified_list AS (SELECT nip FROM steady),\n" + \
    FOLLOW_CTES.replace("FROM owner_list l", "FROM qualified_list l")


def follow_qualified(body: str) -> str:
    return sql(body, *TOP_VIEWS, "fees", "fee_types", "offers_total", "net_gmv_daily", ctes=_QUALIFIED_FOLLOW)


ORACLE.update({
    "fee_summary_qualified": follow_qualified(
        "SELECT month, nip, short_type, my_group_desc, CAST(amount AS DOUBLE) AS amount FROM fee_q"),
    "forecast_panel_qualified": follow_qualified(
        "SELECT nip, month, CAST(offers AS DOUBLE) AS offers, CAST(gmv AS DOUBLE) AS gmv FROM forecast"),
})

# the same answers through another plan
ORACLE["join_day_in_interval"] = ORACLE["join_same_day"]
ORACLE["owner_last_login_by_key_sets"] = ORACLE["owner_last_login"]
