"""SQL twins of the registered queries, written for DuckDB over the same tables.

Each twin states the semantics directly (row-level imputation, date spines,
self-joins), not the way the Spark plan gets there.
"""

from __future__ import annotations

from tillwise.functions.scalars import MONTHS, WEEKDAYS

CTES = {
    "sales": """
        SELECT o_orderkey AS sale_id, c_mktsegment AS series_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount,
               o_orderpriority AS item,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE CAST(10 + o_orderkey % 41 AS DOUBLE) / 10 END AS rating,
               CAST(o_orderdate AS DATE) AS day,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderstatus = 'F' THEN 'Credit Card' ELSE 'Cash' END AS payment
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "kept": "SELECT * FROM sales WHERE amount IS NOT NULL",
    "filled": """
        SELECT k.*, coalesce(k.rating, m.v) AS r FROM kept k
        JOIN (SELECT series_id, avg(rating) AS v FROM kept GROUP BY 1) m USING (series_id)""",
    "filled_median": """
        SELECT k.*, coalesce(k.rating, m.v) AS r FROM kept k
        JOIN (SELECT series_id, quantile_cont(rating, 0.5) AS v FROM kept GROUP BY 1) m USING (series_id)""",
    "sparse": """
        SELECT series_id, day, avg(amount) AS amount, count(item) AS items, avg(r) AS rating,
               avg(CASE WHEN payment = 'Credit Card' THEN 1e0 ELSE 0e0 END) AS credit_card_ratio
        FROM filled GROUP BY 1, 2""",
    "sparse_median": """
        SELECT series_id, day, avg(amount) AS amount, count(item) AS items, avg(r) AS rating,
               avg(CASE WHEN payment = 'Credit Card' THEN 1e0 ELSE 0e0 END) AS credit_card_ratio
        FROM filled_median GROUP BY 1, 2""",
    "spine": """
        SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
        FROM kept GROUP BY 1""",
    "dense": """
        SELECT s.series_id, s.day, coalesce(d.amount, 0) AS amount, coalesce(d.items, 0) AS items,
               coalesce(d.rating, 0) AS rating
        FROM spine s LEFT JOIN
             (SELECT series_id, day, sum(amount) AS amount, count(item) AS items, avg(r) AS rating
              FROM filled GROUP BY 1, 2) d USING (series_id, day)""",
    "smooth0": """
        SELECT series_id, day, items, rating,
               CASE WHEN count(amount) OVER f = 7 THEN avg(amount) OVER f END AS m
        FROM dense WINDOW f AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "smooth": """
        SELECT series_id, day, items, rating, coalesce(
            first_value(m IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
            last_value(m IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          ) AS amount FROM smooth0""",
    "dense_ma": """
        SELECT *, CASE WHEN count(*) OVER a = 7 THEN avg(amount) OVER a END AS ma7_,
                  CASE WHEN count(*) OVER b = 30 THEN avg(amount) OVER b END AS ma30_
        FROM smooth WINDOW a AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                           b AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "features_d": """
        SELECT series_id, day, amount, items, rating,
               CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month,
               CAST(quarter(day) AS INTEGER) AS quarter, CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend,
               first_value(ma7_ IGNORE NULLS) OVER g AS ma7, first_value(ma30_ IGNORE NULLS) OVER g AS ma30
        FROM dense_ma WINDOW g AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "contest": """
        SELECT series_id, day, amount AS actual, split,
               lag(amount, 1) OVER w AS naive, lag(amount, 7) OVER w AS seasonal_naive,
               avg(amount) FILTER (split = 'train') OVER (PARTITION BY series_id) AS train_mean
        FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY day)
                                  <= floor(count(*) OVER (PARTITION BY series_id) * 0.8)
                             THEN 'train' ELSE 'test' END AS split FROM sparse)
        WINDOW w AS (PARTITION BY series_id ORDER BY day)""",
    "preds": """
        SELECT series_id, model, split, day, actual, predicted FROM (
            SELECT series_id, split, day, actual, 1 AS ord, 'naive' AS model, naive AS predicted FROM contest
            UNION ALL SELECT series_id, split, day, actual, 2, 'seasonal_naive', seasonal_naive FROM contest
            UNION ALL SELECT series_id, split, day, actual, 3, 'train_mean', train_mean FROM contest)
        WHERE predicted IS NOT NULL AND split = 'test'""",
    "scores": """
        SELECT series_id, model, count(*) AS n, sqrt(avg((actual - predicted) ** 2)) AS RMSE,
               avg(abs(actual - predicted)) AS MAE,
               100 * avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)) AS MAPE,
               1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS R2
        FROM preds GROUP BY 1, 2""",
    "long": """
        SELECT series_id, model, 'RMSE' AS metric, RMSE AS value, RMSE AS signed FROM scores
        UNION ALL SELECT series_id, model, 'MAE', MAE, MAE FROM scores
        UNION ALL SELECT series_id, model, 'MAPE', MAPE, MAPE FROM scores
        UNION ALL SELECT series_id, model, 'R2', R2, -R2 FROM scores""",
    "ranks": """
        SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY signed, model) AS rank FROM long""",
}

NEEDS = {
    "sales": [],
    "kept": ["sales"],
    "filled": ["kept"],
    "filled_median": ["kept"],
    "sparse": ["filled"],
    "sparse_median": ["filled_median"],
    "spine": ["kept"],
    "dense": ["spine", "filled"],
    "smooth0": ["dense"],
    "smooth": ["smooth0"],
    "dense_ma": ["smooth"],
    "features_d": ["dense_ma"],
    "contest": ["sparse"],
    "preds": ["contest"],
    "scores": ["preds"],
    "long": ["scores"],
    "ranks": ["long"],
}


def with_ctes(needed: list[str], body: str, recursive: bool = False) -> str:
    """Prefix the body with the named tables and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in NEEDS[name]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    tables = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    head = "WITH RECURSIVE" if recursive else "WITH"
    joiner = ",\n" if body.lstrip().startswith("+") else "\n"
    return f"{head} {tables}{joiner}{body.lstrip().removeprefix('+')}" if tables else body


def t(expr: str, places: int, name: str | None = None) -> str:
    """The same rounding as the Spark side."""
    return f"round({expr} + 1e-{places + 4}, {places}) + 0.0 AS {name or expr}"


FULL = "PARTITION BY series_id ORDER BY day"
CAL = {
    "day_of_week": "CAST(isodow(day) - 1 AS INTEGER)",
    "day_of_month": "CAST(day(day) AS INTEGER)",
    "week_of_year": "CAST(weekofyear(day) AS INTEGER)",
    "month": "CAST(month(day) AS INTEGER)",
    "quarter": "CAST(quarter(day) AS INTEGER)",
    "year": "CAST(year(day) AS INTEGER)",
    "is_weekend": "CAST(isodow(day) >= 6 AS INTEGER)",
    "is_month_end": "CAST(last_day(day) = day AS INTEGER)",
}


def cal(*names: str) -> str:
    return ", ".join(f"{CAL[n]} AS {n}" for n in names)


def trailing(expr: str, n: int, fn: str = "avg") -> str:
    frame = f"({FULL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) OVER {frame} = {n} THEN {fn}({expr}) OVER {frame} END"


def histogram(source: str, column: str, bins: int, places: int) -> str:
    """Body of an equal-width histogram over a table expression."""
    return f"""
    +b AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
           FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM {source})),
     c AS (SELECT CAST(least(floor({bins} * ({column} - lo) / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
           FROM {source}, b WHERE {column} IS NOT NULL GROUP BY 1)
    SELECT CAST(s.bin AS INTEGER) AS bin, {t(f"(lo + s.bin * ((hi - lo) / {bins}))", places, "bin_start")},
           {t(f"(lo + (s.bin + 1) * ((hi - lo) / {bins}))", places, "bin_end")}, coalesce(c.n, 0) AS n
    FROM (SELECT unnest(range({bins})) AS bin) s CROSS JOIN b LEFT JOIN c ON c.bin = s.bin"""


def fill_next(c: str) -> str:
    return f"first_value({c} IGNORE NULLS) OVER ({FULL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def fill_last(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER ({FULL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def sparse_features(source: str) -> str:
    """CTE list ending in ``features_s``: the nineteen features over a sparse table."""
    ewm = ", ".join(
        f"sum(pow({1 - 2 / (s + 1)!r}, a.i - b.i) * b.amount) / sum(pow({1 - 2 / (s + 1)!r}, a.i - b.i)) AS ewm{s}"
        for s in (7, 30)
    )
    raw = {
        "ma3": trailing("amount", 3), "ma7": trailing("amount", 7), "ma14": trailing("amount", 14),
        "volatility": trailing("amount", 7, "stddev_samp"),
        **{f"lag{k}": f"lag(amount, {k}) OVER ({FULL})" for k in (1, 7, 30)},
    }
    filled = ", ".join(f"coalesce({fill_next(c)}, {fill_last(c)}) AS {c}" for c in raw)
    return f"""
    numbered AS (SELECT *, row_number() OVER ({FULL}) AS i FROM {source}),
    ewm AS (SELECT a.series_id, a.day, {ewm} FROM numbered a JOIN numbered b
            ON a.series_id = b.series_id AND b.i <= a.i GROUP BY 1, 2),
    raw AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in raw.items())} FROM {source}),
    features_s AS (
        SELECT series_id, day, amount, items, rating, credit_card_ratio,
               {cal("day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend", "is_month_end")},
               {filled}, ewm7, ewm30
        FROM raw JOIN ewm USING (series_id, day))"""


SPARSE_NAMES = [
    "items", "rating", "credit_card_ratio", "day_of_week", "day_of_month", "week_of_year", "month",
    "quarter", "is_weekend", "is_month_end", "ma3", "ma7", "ma14", "volatility", "lag1", "lag7", "lag30",
    "ewm7", "ewm30",
]
DENSE_NAMES = ["items", "rating", "day_of_week", "month", "quarter", "is_weekend", "ma7", "ma30"]


def minmax(c: str, over: str = "PARTITION BY series_id") -> str:
    return (
        f"({c} - min({c}) OVER ({over})) / coalesce(nullif(max({c}) OVER ({over}) - min({c}) OVER ({over}), 0), 1)"
    )


def standard(c: str, over: str = "PARTITION BY series_id") -> str:
    return f"({c} - avg({c}) OVER ({over})) / coalesce(nullif(stddev_pop({c}) OVER ({over}), 0), 1)"


SPLIT = (
    "CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY day) "
    "<= floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'test' END AS split"
)

ORACLE: dict[str, str] = {}


def twin(name: str, needed: list[str], body: str, recursive: bool = False) -> None:
    ORACLE[name] = with_ctes(needed, body, recursive)


# ---- flagship, profiles ----------------------------------------------------

twin(
    "weekly_naive_scores",
    ["dense"],
    f"""
    +x AS (SELECT series_id, day, amount AS actual, lag(amount, 7) OVER ({FULL}) AS predicted,
                  {trailing("amount", 7)} AS ma7, {CAL["is_weekend"]} AS is_weekend, {SPLIT} FROM dense)
    SELECT series_id, count(*) AS n, {t("sqrt(avg((actual - predicted) ** 2))", 2, "RMSE")},
           {t("avg(abs(actual - predicted))", 2, "MAE")},
           {t("(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)))", 6, "R2")},
           {t("avg(ma7)", 2, "mean_ma7")}, CAST(sum(is_weekend) AS BIGINT) AS weekend_days, min(day) AS test_start
    FROM x WHERE split = 'test' AND predicted IS NOT NULL GROUP BY 1""",
)
twin("head_rows", ["sales"], "SELECT * FROM sales ORDER BY day, sale_id LIMIT 5")
COLUMN_TYPES = {
    "sale_id": "bigint", "series_id": "string", "amount": "double", "item": "string",
    "rating": "double", "day": "date", "payment": "string",
}
twin(
    "null_profile",
    ["sales"],
    " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, '{c}' AS column_name, '{ty}' AS data_type, count({c}) AS non_null FROM sales"
        for c, ty in COLUMN_TYPES.items()
    ),
)


def describe_number(c: str) -> str:
    q = ", ".join(t(f"quantile_cont({c}, {p})", 3, f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75))
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
        f"CAST(NULL AS BIGINT) AS freq, {t(f'avg({c})', 3, 'mean')}, {t(f'stddev_samp({c})', 3, 'std')}, "
        f"{t(f'min({c})', 3, 'min')}, {q}, {t(f'max({c})', 3, 'max')} FROM sales"
    )


def describe_text(c: str) -> str:
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return (
        f"SELECT '{c}' AS column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", "
        f"first(v ORDER BY n DESC, v) AS top, max(n) AS freq, {nulls} "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM sales WHERE {c} IS NOT NULL GROUP BY 1)"
    )


twin(
    "describe_all",
    ["sales"],
    " UNION ALL ".join(
        [describe_number(c) for c in ("amount", "rating")]
        + [describe_text(c) for c in ("series_id", "item", "payment")]
    ),
)
twin(
    "value_counts",
    ["sales"],
    "SELECT payment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent "
    "FROM sales WHERE payment IS NOT NULL GROUP BY 1",
)
twin("histogram_amount", ["sales"], histogram("sales", "amount", 30, 3))
twin("histogram_rating", ["sales"], histogram("sales", "rating", 20, 6))
twin(
    "histogram_daily_mean",
    ["sparse_median"],
    "+lg AS (SELECT series_id, ln(1 + amount) AS a FROM sparse_median),\n"
    + f"z0 AS (SELECT {standard('a')} AS z FROM lg), zz AS (SELECT {t('z', 6)} FROM z0),\n"
    + histogram("zz", "z", 50, 6).lstrip().removeprefix("+"),
)
twin(
    "rating_amount_points",
    ["sales"],
    "SELECT series_id, rating, count(*) AS n, min(amount) AS lowest, max(amount) AS highest FROM sales "
    "WHERE rating IS NOT NULL AND amount IS NOT NULL GROUP BY 1, 2",
)
twin(
    "rating_amount_correlation",
    ["sales"],
    f"SELECT series_id, count(*) AS n, {t('corr(rating, amount)', 6, 'corr')} FROM sales "
    "WHERE rating IS NOT NULL AND amount IS NOT NULL GROUP BY 1",
)
twin(
    "shared_range",
    ["kept"],
    f"""+v AS (SELECT sum(amount) AS s, avg(amount) AS a FROM kept GROUP BY series_id, day)
    SELECT {t("least(min(s), min(a))", 2, "y_min")}, {t("greatest(max(s), max(a))", 2, "y_max")},
           {t("greatest(max(s), max(a)) * 1.1e0", 2, "y_limit")} FROM v""",
)

# ---- cleaning --------------------------------------------------------------

for how, source in (("mean", "filled"), ("median", "filled_median")):
    twin(
        f"clean_impute_{how}",
        [source],
        f"SELECT sale_id, series_id, amount, {t('r', 6, 'rating_filled')} FROM {source}",
    )
twin(
    "clean_complete_rows",
    ["sales"],
    "SELECT sale_id, amount AS amount_original, 0e0 AS discount, CAST(payment = 'Credit Card' AS INTEGER) AS is_credit, "
    "CAST(item IN ('1-URGENT', '2-HIGH') AS INTEGER) AS is_rush FROM sales "
    "WHERE amount IS NOT NULL AND rating IS NOT NULL AND payment IS NOT NULL",
)
twin(
    "null_as_zero",
    ["sales"],
    f"SELECT series_id, {t('avg(coalesce(amount, 0))', 3, 'mean_amount')}, {t('avg(coalesce(rating, 0))', 6, 'mean_rating')}, "
    "count(*) AS n, count(*) FILTER (payment = 'Credit Card') AS n_credit FROM sales GROUP BY 1",
)
twin(
    "date_ranges",
    ["sales"],
    "SELECT series_id, CASE WHEN day <= DATE '1997-06-30' THEN 'up_to' WHEN day <= DATE '2000-01-01' THEN 'between' "
    "ELSE 'after' END AS part, count(*) AS n FROM sales GROUP BY 1, 2",
)
twin(
    "parse_dates",
    [],
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS strict_day, "
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS lenient_day FROM orders",
)
twin(
    "encode_categories",
    ["sales"],
    """+f AS (SELECT item, row_number() OVER (ORDER BY d, k) - 1 AS code FROM (
             SELECT item, day AS d, sale_id AS k, row_number() OVER (PARTITION BY item ORDER BY day, sale_id) AS r FROM sales)
             WHERE r = 1)
    SELECT sale_id, CAST(code AS INTEGER) AS item_code,
           CAST(CASE payment WHEN 'Cash' THEN 0 WHEN 'Credit Card' THEN 1 END AS INTEGER) AS payment_code
    FROM sales JOIN f USING (item)""",
)
twin(
    "customer_codes",
    [],
    """SELECT customer, CAST(row_number() OVER (ORDER BY d, k) - 1 AS INTEGER) AS code FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k,
               row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS r FROM orders)
       WHERE r = 1""",
)
twin("distinct_items", ["sales"], "SELECT DISTINCT series_id, item FROM sales")

# ---- roll-ups --------------------------------------------------------------

twin("daily_dense", ["dense"], f"SELECT series_id, day, {t('amount', 2)}, items, {t('rating', 6)} FROM dense")
for name in ("sparse", "sparse_median"):
    twin(
        "daily_" + name,
        [name],
        f"SELECT series_id, day, {t('amount', 3)}, items, {t('rating', 6)}, {t('credit_card_ratio', 6)} FROM {name}",
    )
twin(
    "daily_dense_events",
    [],
    f"""WITH s AS (SELECT event_type AS series_id, CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)),
                     INTERVAL 1 DAY)) AS DATE) AS day FROM events WHERE value IS NOT NULL GROUP BY 1),
         d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, sum(value) AS amount, count(*) AS items
               FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT series_id, day, {t("coalesce(amount, 0)", 3, "amount")}, coalesce(items, 0) AS items, 0e0 AS rating
    FROM s LEFT JOIN d USING (series_id, day)""",
)
twin("daily_mean", ["sales"], f"SELECT day, {t('avg(amount)', 3, 'amount')} FROM sales GROUP BY 1")
twin(
    "monthly_dense",
    ["sales"],
    f"""+m AS (SELECT series_id, last_day(day) AS month_end, avg(amount) AS a FROM sales GROUP BY 1, 2),
         s AS (SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', min(day)), max(day),
               INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM sales GROUP BY 1)
    SELECT series_id, month_end, {t("a", 3, "amount")} FROM s LEFT JOIN m USING (series_id, month_end)""",
)
twin(
    "monthly_present",
    ["sales"],
    f"SELECT series_id, strftime(day, '%Y-%m') AS month, {t('avg(amount)', 3, 'amount')} FROM sales GROUP BY 1, 2",
)


def domain(labels: list[str], label: str) -> str:
    rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(labels))
    return f"(VALUES {rows}) AS dom(position, {label})"


for name, labels, label, fn in (
    ("weekday_profile", WEEKDAYS, "weekday", "dayname"),
    ("month_profile", MONTHS, "month", "monthname"),
):
    twin(
        name,
        ["sales"],
        f"""+m AS (SELECT series_id, {fn}(day) AS {label}, avg(amount) AS a FROM sales GROUP BY 1, 2)
        SELECT s.series_id, CAST(dom.position AS INTEGER) AS position, dom.{label}, {t("a", 3, "amount")}
        FROM (SELECT DISTINCT series_id FROM sales) s CROSS JOIN {domain(labels, label)}
        LEFT JOIN m ON m.series_id = s.series_id AND m.{label} = dom.{label}""",
    )
twin(
    "weekday_month_pivot",
    ["sales"],
    "SELECT CAST(isodow(day) - 1 AS INTEGER) AS position, dayname(day) AS weekday, "
    + ", ".join(t(f"avg(amount) FILTER (monthname(day) = '{m}')", 3, m) for m in MONTHS)
    + " FROM sales GROUP BY 1, 2",
)
twin(
    "series_span",
    ["sales"],
    "SELECT series_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n_rows, "
    "CAST(max(day) - min(day) AS INTEGER) AS span_days FROM sales GROUP BY 1",
)
twin(
    "last_known_values",
    ["sparse"],
    f"""SELECT series_id, day, {t("amount", 3)}, items, {t("rating", 6)} FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS r FROM sparse) WHERE r = 1""",
)

# ---- windows and features --------------------------------------------------

twin(
    "features_dense",
    ["features_d"],
    f"SELECT series_id, day, {t('amount', 2)}, items, {t('rating', 6)}, day_of_week, month, quarter, is_weekend, "
    f"{t('ma7', 2)}, {t('ma30', 2)} FROM features_d",
)
_PLACES = {"rating": 6, "credit_card_ratio": 6}
twin(
    "features_sparse",
    ["sparse"],
    "+"
    + sparse_features("sparse")
    + f" SELECT series_id, day, {t('amount', 3)}, "
    + ", ".join(
        c if c == "items" or c in CAL else t(c, _PLACES.get(c, 3)) for c in SPARSE_NAMES
    )
    + " FROM features_s",
)
twin(
    "features_sparse_events",
    [],
    """WITH d AS (SELECT DISTINCT event_type AS series_id, CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL),
         n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM d)
    SELECT series_id, day, CASE WHEN n >= 31 THEN 'kept' ELSE 'dropped' END AS state FROM n""",
)


def centred(n: int, before: int, after: int) -> str:
    f = f"({FULL} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN count(amount) OVER {f} = {n} THEN avg(amount) OVER {f} END"


twin(
    "ma_centered",
    ["sparse"],
    f"+m AS (SELECT series_id, day, {centred(7, 3, 3)} AS ma7, {centred(30, 15, 14)} AS ma30 FROM sparse) "
    f"SELECT series_id, day, {t('ma7', 3)}, {t('ma30', 3)} FROM m",
)
twin(
    "fill_gaps_both_ways",
    ["sales"],
    f"""+d AS (SELECT series_id, day, min(amount) AS amount FROM sales GROUP BY 1, 2),
        f AS (SELECT series_id, day, {fill_next("amount")} AS bfill, {fill_last("amount")} AS ffill FROM d)
    SELECT *, coalesce(bfill, ffill) AS filled FROM f""",
)
twin(
    "daily_change_hist",
    ["sparse"],
    f"+d0 AS (SELECT amount - lag(amount) OVER ({FULL}) AS c FROM sparse), ch AS (SELECT {t('c', 3, 'change')} FROM d0),\n"
    + histogram("ch", "change", 30, 3).lstrip().removeprefix("+"),
)
twin(
    "small_exog",
    ["sparse"],
    f"SELECT series_id, day, {t('coalesce(rating, 0)', 6, 'rating')}, {t('coalesce(credit_card_ratio, 0)', 6, 'credit_card_ratio')}, "
    f"{cal('month', 'day_of_month', 'day_of_week')} FROM sparse",
)
_FRAME14 = f"({FULL} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
twin(
    "sequences_14",
    ["features_d"],
    f"""+q AS (SELECT series_id, day, amount AS y, count(*) OVER {_FRAME14} AS steps, lag(amount, 14) OVER ({FULL}) AS oldest,
                   lag(amount, 1) OVER ({FULL}) AS newest, sum(CAST(items AS DOUBLE)) OVER {_FRAME14} AS items_sum FROM features_d),
         k AS (SELECT *, {SPLIT} FROM q WHERE steps = 14)
    SELECT series_id, day, split, CAST(steps AS INTEGER) AS steps, CAST(9 AS INTEGER) AS width,
           {t("oldest", 2)}, {t("newest", 2)}, {t("items_sum", 2)}, {t("y", 2)} FROM k""",
)

# ---- scaling ---------------------------------------------------------------

_MM = ["amount", *DENSE_NAMES]
twin(
    "scaled_minmax",
    ["features_d"],
    "+z AS (SELECT series_id, day, "
    + ", ".join(f"{minmax(c)} AS {c}" for c in _MM)
    + " FROM features_d) SELECT series_id, day, "
    + ", ".join(t(c, 6) for c in _MM)
    + " FROM z",
)
_ST = ["amount_scaled", *SPARSE_NAMES]
twin(
    "scaled_standard",
    ["sparse_median"],
    "+"
    + sparse_features("sparse_median")
    + ", lg AS (SELECT *, ln(1 + amount) AS amount_log FROM features_s), z AS (SELECT series_id, day, "
    + f"{standard('amount_log')} AS amount_scaled, "
    + ", ".join(f"{standard(c)} AS {c}" for c in SPARSE_NAMES)
    + " FROM lg) SELECT series_id, day, "
    + ", ".join(t(c, 6) for c in _ST)
    + " FROM z",
)
twin(
    "scaler_params",
    ["sparse"],
    f"+s AS (SELECT *, {SPLIT} FROM sparse)\n"
    + " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS column_name, {t(f'avg({c})', 3, 'center')}, "
        f"{t(f'coalesce(nullif(stddev_pop({c}), 0), 1)', 3, 'scale')} FROM s WHERE split = 'train' GROUP BY 1"
        for c in ("amount", "items")
    ),
)
twin(
    "scale_train_only",
    ["sparse"],
    f"""+s AS (SELECT *, {SPLIT} FROM sparse),
         p AS (SELECT series_id, min(amount) AS a0, max(amount) AS a1, min(items) AS i0, max(items) AS i1
               FROM s WHERE split = 'train' GROUP BY 1)
    SELECT series_id, day, {t("(amount - a0) / (a1 - a0)", 6, "amount")},
           {t("(items - i0) / CAST(i1 - i0 AS DOUBLE)", 6, "items")}
    FROM s JOIN p USING (series_id) WHERE split = 'test'""",
)
twin(
    "scale_roundtrip",
    ["sparse"],
    f"SELECT series_id, day, {t('amount', 3, 'from_minmax')}, {t('amount', 3, 'from_standard')}, 0e0 AS clipped FROM sparse",
)

# ---- splits ----------------------------------------------------------------

twin("split_80_20", ["sparse"], f"SELECT series_id, day, {SPLIT} FROM sparse")
twin(
    "split_calendar",
    ["sparse"],
    """+b AS (SELECT series_id, min(day) AS d0, max(day) - min(day) AS n FROM sparse GROUP BY 1),
         e AS (SELECT series_id, d0 + CAST(floor(n * 0.7) AS INTEGER) AS train_end, n FROM b),
         v AS (SELECT series_id, train_end, train_end + CAST(floor(n * 0.2) AS INTEGER) AS valid_end FROM e)
    SELECT series_id, day, train_end, valid_end, CASE WHEN day <= train_end THEN 'train' WHEN day <= valid_end THEN 'valid'
           ELSE 'test' END AS split FROM sparse JOIN v USING (series_id)""",
)
twin(
    "split_hash",
    ["kept"],
    "SELECT sale_id, series_id, CASE WHEN row_number() OVER (ORDER BY md5(sale_id || '-42'), sale_id) "
    "<= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM kept",
)

twin(
    "split_hash_repeated",
    [],
    """WITH k AS (SELECT l_orderkey, count(*) AS m, md5(l_orderkey || '-42') AS h FROM lineitem GROUP BY 1),
    r AS (SELECT *, sum(m) OVER (ORDER BY h, l_orderkey) - m AS before, ceil(0.2 * (SELECT count(*) FROM lineitem)) AS want FROM k),
    t AS (SELECT l_orderkey, m, CAST(greatest(0, least(m, want - before)) AS BIGINT) AS test FROM r)
    SELECT l_orderkey, 'test' AS split, test AS n FROM t WHERE test > 0
    UNION ALL SELECT l_orderkey, 'train', m - test FROM t WHERE test < m""",
)
_TS = "PARTITION BY series_id ORDER BY ts"
twin(
    "events_by_timestamp",
    [],
    f"""WITH d AS (SELECT event_type AS series_id, ts, avg(value) AS amount, count(*) AS items FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT series_id, epoch_us(ts) AS micros, {t("amount", 3)}, items,
           {t(f"CASE WHEN count(*) OVER ({_TS} ROWS 2 PRECEDING) = 3 THEN avg(amount) OVER ({_TS} ROWS 2 PRECEDING) END", 3, "ma3")},
           {t(f"CASE WHEN count(*) OVER ({_TS} ROWS 6 PRECEDING) = 7 THEN stddev_samp(amount) OVER ({_TS} ROWS 6 PRECEDING) END", 3, "volatility")},
           {t(f"lag(amount, 7) OVER ({_TS})", 3, "lag7")} FROM d""",
)

# ---- decomposition ---------------------------------------------------------

twin(
    "decompose_30",
    ["sparse"],
    f"""+b AS (SELECT series_id, day, amount AS observed, count(*) OVER (PARTITION BY series_id) AS n,
                   (row_number() OVER ({FULL}) - 1) % 30 AS phase,
                   CASE WHEN count(*) OVER ({FULL} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) = 31 THEN
                     (sum(amount) OVER ({FULL} ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)
                      + 0.5 * lag(amount, 15) OVER ({FULL}) + 0.5 * lead(amount, 15) OVER ({FULL})) / 30 END AS trend
            FROM sparse),
         m AS (SELECT series_id, phase, avg(observed - trend) AS a FROM b GROUP BY 1, 2),
         c AS (SELECT series_id, phase, a - avg(a) OVER (PARTITION BY series_id) AS seasonal FROM m)
    SELECT series_id, day, {t("observed", 3)}, {t("trend", 3)}, {t("seasonal", 3)},
           {t("(observed - trend - seasonal)", 3, "resid")}
    FROM b JOIN c USING (series_id, phase) WHERE n >= 60""",
)
twin(
    "decompose_30_events",
    [],
    """SELECT CAST(coalesce(sum(d), 0) AS BIGINT) AS n FROM (
        SELECT count(DISTINCT CAST(ts AS DATE)) AS d FROM events WHERE value IS NOT NULL GROUP BY event_type) WHERE d >= 60""",
)
twin(
    "acf_30",
    ["sparse"],
    f"""+x AS (SELECT series_id, amount - avg(amount) OVER (PARTITION BY series_id) AS v, row_number() OVER ({FULL}) AS i FROM sparse),
         p AS (SELECT a.series_id, b.i - a.i AS lag, sum(a.v * b.v) AS c FROM x a JOIN x b
               ON a.series_id = b.series_id AND b.i BETWEEN a.i AND a.i + 30 GROUP BY 1, 2),
         r AS (SELECT p.series_id, p.lag, (SELECT count(*) FROM x WHERE x.series_id = p.series_id) AS n,
                      c / (SELECT sum(v * v) FROM x WHERE x.series_id = p.series_id) AS acf FROM p),
         w AS (SELECT *, coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER
                 (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sq FROM r)
    SELECT series_id, n, CAST(lag AS INTEGER) AS lag, {t("acf", 6)},
           {t("CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * sq) / n) END", 6, "half_width")} FROM w""",
)

# ---- evaluation ------------------------------------------------------------

twin(
    "metrics_by_model",
    ["scores"],
    f"SELECT series_id, model, n, {t('RMSE', 3)}, {t('MAE', 3)}, {t('MAPE', 4)}, {t('R2', 6)} FROM scores",
)
_MODELS = ["naive", "seasonal_naive", "train_mean"]
twin(
    "metrics_pivot",
    ["long"],
    "SELECT series_id, metric, "
    + ", ".join(t(f"max(value) FILTER (model = '{m}')", 3, m) for m in _MODELS)
    + " FROM long GROUP BY 1, 2",
)
twin(
    "model_ranking",
    ["ranks"],
    f"""+a AS (SELECT series_id, model, avg(rank) AS avg_rank FROM ranks GROUP BY 1, 2)
    SELECT series_id, model, {t("avg_rank", 4)},
           CAST(row_number() OVER (PARTITION BY series_id ORDER BY avg_rank, model) AS INTEGER) AS place FROM a""",
)
twin("best_per_metric", ["ranks"], f"SELECT series_id, metric, model, {t('value', 3)} FROM ranks WHERE rank = 1")
twin(
    "better_by_r2",
    ["scores"],
    f"""SELECT a.series_id, {t("a.R2", 6, "r2_first")}, {t("b.R2", 6, "r2_second")},
        CASE WHEN a.R2 > b.R2 THEN a.model ELSE b.model END AS better
    FROM scores a JOIN scores b USING (series_id) WHERE a.model = 'seasonal_naive' AND b.model = 'train_mean'""",
)
twin(
    "ensemble_7d",
    ["sparse"],
    f"""+r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS r,
                   max(day) OVER (PARTITION BY series_id) AS e FROM sparse),
         a AS (SELECT series_id, 8 - r AS step, e, amount AS f FROM r WHERE r <= 7),
         b AS (SELECT series_id, avg(amount) AS s FROM r WHERE r <= 30 GROUP BY 1),
         j AS (SELECT series_id, step, e + CAST(step AS INTEGER) AS day, f, s FROM a JOIN b USING (series_id))
    SELECT series_id, CAST(step AS INTEGER) AS step, day AS day_first, day AS day_second, day,
           {t("f", 3, "first")}, {t("s", 3, "second")}, {t("((f + s) / 2)", 3, "ensemble")}, {t("(f - s)", 3, "difference")},
           {t("((f - s) / ((f + s) / 2) * 100)", 4, "percent_difference")},
           printf('$%.2f', round((f + s) / 2 + 1e-6, 2)) AS ensemble_text, strftime(day, '%Y-%m-%d') AS day_text FROM j""",
)
twin(
    "ensemble_all_models",
    ["preds"],
    f"SELECT series_id, day, {t('avg(predicted)', 3, 'predicted')} FROM preds GROUP BY 1, 2",
)
twin(
    "overlap_window",
    ["dense", "sparse"],
    f"""+d AS (SELECT series_id, day, amount, row_number() OVER ({FULL}) AS i FROM dense),
         ds AS (SELECT series_id, day, amount AS actual, {SPLIT} FROM d WHERE i > 14),
         ss AS (SELECT series_id, day, amount AS actual, {SPLIT} FROM sparse),
         u AS (SELECT 'sequence' AS model, * FROM ds WHERE split = 'test' UNION ALL SELECT 'rows', * FROM ss WHERE split = 'test'),
         e AS (SELECT series_id, max(lo) AS common_start, min(hi) AS common_end FROM (
               SELECT series_id, model, min(day) AS lo, max(day) AS hi FROM u GROUP BY 1, 2) GROUP BY 1)
    SELECT series_id, model, day, {t("actual", 3)}, common_start, common_end FROM u JOIN e USING (series_id)
    WHERE day BETWEEN common_start AND common_end""",
)
for name, expr in (("last_37_absolute", "abs(predicted - actual)"), ("last_37_signed", "(predicted - actual)")):
    twin(
        name,
        ["preds"],
        f"""SELECT series_id, model, split, day, {t("actual", 3)}, {t("predicted", 3)}, {t(expr, 3, "difference")} FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY day DESC) AS r FROM preds) WHERE r <= 37""",
    )
twin(
    "score_summary",
    ["scores"],
    "SELECT series_id, model, CAST(trunc(RMSE) AS BIGINT) AS RMSE, CAST(trunc(MAE) AS BIGINT) AS MAE, "
    f"CAST(trunc(MAPE) AS BIGINT) AS MAPE, {t('R2', 2)} FROM scores",
)
twin(
    "actual_vs_predicted",
    ["preds"],
    f"SELECT series_id, day, model, {t('predicted', 3)}, {t('actual', 3)}, {t('abs(actual - predicted)', 3, 'difference')} "
    "FROM preds WHERE model = 'naive'",
)
twin(
    "future_spine",
    ["sales"],
    f"""+f AS (SELECT series_id, max(day) + CAST(k AS INTEGER) AS day FROM sales, (SELECT unnest(range(1, 8)) AS k) GROUP BY series_id, k)
    SELECT series_id, day, {cal("day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "is_weekend", "is_month_end")}
    FROM f""",
)

# ---- models with a closed form ---------------------------------------------


def differenced(d: int, D: int, s: int) -> str:
    table = "SELECT series_id, day, amount AS y, rating AS x FROM sparse"
    for step in [s] * D + [1] * d:
        table = (
            f"SELECT series_id, day, y - lag(y, {step}) OVER ({FULL}) AS y, x - lag(x, {step}) OVER ({FULL}) AS x "
            f"FROM ({table})"
        )
    return table


twin(
    "differencing",
    ["sparse"],
    " UNION ALL ".join(
        f"SELECT series_id, day, CAST({i} AS INTEGER) AS block, {t('y', 3, 'dy')}, {t('x', 6, 'dx')} "
        f"FROM ({differenced(*b)}) WHERE y IS NOT NULL"
        for i, b in enumerate([(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 7), (1, 1, 7), (1, 1, 14)])
    ),
)
_ROWS = f"""
    rw AS (SELECT series_id, day, amount AS y, lag(amount) OVER ({FULL}) AS l, rating AS x,
                  amount - lag(amount) OVER ({FULL}) AS dy, row_number() OVER ({FULL}) AS i, {SPLIT} FROM sparse)"""
_AR1 = f"""{_ROWS},
    ab AS (SELECT series_id, count(*) AS n, regr_slope(y, l) AS phi, regr_intercept(y, l) AS c
           FROM rw WHERE split = 'train' AND i > 1 GROUP BY 1),
    ar AS (SELECT series_id, any_value(n) AS n, any_value(phi) AS phi, any_value(c) AS c, sum((y - c - phi * l) ** 2) AS sse
           FROM rw JOIN ab USING (series_id) WHERE split = 'train' AND i > 1 GROUP BY 1)"""
twin(
    "ar1_fit",
    ["sparse"],
    f"""+{_AR1} SELECT series_id, n, CAST(2 AS INTEGER) AS k, {t("phi", 5)}, {t("c", 1, "const")},
        {t("sqrt(sse / n)", 2, "sigma")}, {t("(n * ln(sse / n) + 4)", 3, "aic")} FROM ar""",
)
twin(
    "ar1_forecast",
    ["sparse"],
    f"""+{_AR1},
    o AS (SELECT series_id, max_by(y, day) AS last FROM rw WHERE split = 'train' GROUP BY 1),
    h AS (SELECT series_id, day, row_number() OVER ({FULL}) AS step FROM rw WHERE split = 'test'),
    f AS (SELECT series_id, day, step, c / (1 - phi) + pow(phi, step) * (last - c / (1 - phi)) AS p,
                 1.959963984540054 * sqrt(sse / n * (1 - pow(phi * phi, step)) / (1 - phi * phi)) AS w
          FROM h JOIN o USING (series_id) JOIN ar USING (series_id))
    SELECT series_id, day, CAST(step AS INTEGER) AS step, {t("p", 1, "predicted")}, {t("(p - w)", 1, "lower")},
           {t("(p + w)", 1, "upper")} FROM f""",
)
ORACLE["stored_ar1_forecast"] = ORACLE["ar1_forecast"]
twin(
    "gram_matrix",
    ["sparse"],
    f"""+rw AS (SELECT series_id, lag(amount, 1) OVER ({FULL}) AS a, lag(amount, 2) OVER ({FULL}) AS b, rating AS x, amount AS y, {SPLIT} FROM sparse),
    v AS (SELECT series_id, [1e0, a, b, x, y] AS v FROM rw WHERE split = 'train' AND b IS NOT NULL),
    p AS (SELECT series_id, i, j, sum(v[i + 1] * v[j + 1]) AS p FROM v, range(5) AS l(i), range(5) AS r(j) WHERE i <= j GROUP BY 1, 2, 3)
    SELECT series_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(floor(log10(p)) AS INTEGER) AS power,
           {t("(p / pow(10e0, floor(log10(p))))", 8, "digits")} FROM p""",
)
twin(
    "candidates_by_series",
    ["sparse"],
    """+e AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT series_id, count(*) AS n_rows FROM (SELECT series_id, day FROM sparse UNION ALL SELECT series_id, day FROM e) GROUP BY 1),
    f AS (SELECT series_id, p, CAST(floor(n_rows * 0.8) AS BIGINT) - 12 AS n, CAST(p + 1 AS INTEGER) AS k
          FROM n, (SELECT unnest([1, 2, 10, 12]) AS p) WHERE p * 3 <= n_rows)
    SELECT series_id, '(' || p || ',0,0)(0,0,0,0)+c' AS spec, n, k, n > k + 1 AS fitted FROM f""",
)
twin(
    "arx_fit",
    ["sparse"],
    f"""+{_ROWS},
    m AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(l) AS ml, avg(x) AS mx, covar_pop(y, l) AS yl,
                 covar_pop(y, x) AS yx, covar_pop(l, x) AS lx, var_pop(l) AS ll, var_pop(x) AS xx
          FROM rw WHERE split = 'train' AND i > 1 GROUP BY 1),
    b AS (SELECT *, (yl * xx - yx * lx) / (ll * xx - lx * lx) AS phi, (yx * ll - yl * lx) / (ll * xx - lx * lx) AS beta FROM m)
    SELECT series_id, n, {t("phi", 5)}, {t("beta", 1)}, {t("(my - phi * ml - beta * mx)", 0, "const")} FROM b""",
)
def two_regressors(y: str, a: str, b: str, source: str, names: str) -> str:
    """Constant and slopes of y on (a, b) per series."""
    c, p, q = names.split()
    return f"""SELECT series_id, n, {p}, {q}, my - {p} * ma - {q} * mb AS {c} FROM (
        SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS {p}, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS {q} FROM (
            SELECT series_id, count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, covar_pop({y}, {a}) AS ya, covar_pop({y}, {b}) AS yb,
                   covar_pop({a}, {b}) AS ab, var_pop({a}) AS aa, var_pop({b}) AS bb FROM {source} GROUP BY 1))"""


twin(
    "arma_fit",
    ["sparse"],
    f"""+rw AS (SELECT series_id, day, amount AS y, lag(amount, 1) OVER ({FULL}) AS l, lag(amount, 2) OVER ({FULL}) AS l2,
                   row_number() OVER ({FULL}) AS i, {SPLIT} FROM sparse),
    one AS ({two_regressors("y", "l", "l2", "(SELECT * FROM rw WHERE split = 'train' AND i > 2)", "c1 p1 p2")}),
    e AS (SELECT series_id, day, y, l, i, split, y - c1 - p1 * l - p2 * l2 AS e FROM rw JOIN one USING (series_id)),
    el AS (SELECT *, lag(e) OVER ({FULL}) AS e1 FROM e),
    two AS ({two_regressors("y", "l", "e1", "(SELECT * FROM el WHERE split = 'train' AND i > 3)", "c phi theta")})
    SELECT series_id, n, {t("phi", 5)}, {t("theta", 5)}, {t("(c / 1e5)", 5, "const")} FROM two""",
)
twin(
    "seq_split_sizes",
    ["dense"],
    f"""+q AS (SELECT series_id, day, row_number() OVER ({FULL}) - 14 AS i, count(*) OVER (PARTITION BY series_id) - 14 AS n FROM dense),
    p AS (SELECT series_id, day, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'valid' ELSE 'test' END AS split
          FROM q WHERE i > 0)
    SELECT series_id, split, count(*) AS n, max(day) AS last_day FROM p GROUP BY 1, 2""",
)
# Every step drops the oldest of fourteen targets and appends the prediction; the newest day's items stay.
twin(
    "seq_weighted_recursion",
    ["smooth"],
    f"""+s AS (SELECT series_id, day, amount, items, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS r FROM smooth),
    seed AS (SELECT series_id, max(day) AS day, list(amount ORDER BY day) AS w, max_by(items, day) AS items FROM s WHERE r <= 14
             GROUP BY 1 HAVING count(*) = 14),
    walk AS (
        SELECT series_id, day, 0 AS step, w, items, CAST(NULL AS DOUBLE) AS p FROM seed
        UNION ALL
        SELECT series_id, day, step + 1, list_append(w[2:], v), items, v FROM (
            SELECT *, 5 + 10 * items + list_sum(list_transform(list_zip(w, range(1, 15)), lambda z: z[1] * z[2] / 120e0)) AS v FROM walk WHERE step < 7))
    SELECT series_id, day + CAST(step AS INTEGER) AS day, CAST(step AS INTEGER) AS step, {t("p", 1, "predicted")} FROM walk WHERE step > 0""",
    recursive=True,
)
twin(
    "ar_grid_best",
    ["sparse"],
    f"""+{_ROWS},
    dd AS (SELECT *, lag(dy) OVER ({FULL}) AS dl FROM rw),
    s AS (SELECT * FROM dd WHERE split = 'train' AND i > 2),
    g AS (SELECT series_id, count(*) AS n, var_pop(y) * count(*) AS s0, regr_slope(y, l) AS phi, regr_intercept(y, l) AS c,
                 sum(dy * dy) AS s2, sum(dy * dl) / sum(dl * dl) AS psi FROM s GROUP BY 1),
    e AS (SELECT series_id, any_value(n) AS n, any_value(s0) AS s0, sum((y - c - phi * l) ** 2) AS s1,
                 any_value(s2) AS s2, sum((dy - psi * dl) ** 2) AS s3 FROM s JOIN g USING (series_id) GROUP BY 1),
    a AS (SELECT series_id, n, 0 AS ord, '(0,0,0)(0,0,0,0)+c' AS spec, n * ln(s0 / n) + 2 AS aic FROM e
          UNION ALL SELECT series_id, n, 1, '(1,0,0)(0,0,0,0)+c', n * ln(s1 / n) + 4 FROM e
          UNION ALL SELECT series_id, n, 2, '(0,1,0)(0,0,0,0)', n * ln(s2 / n) FROM e
          UNION ALL SELECT series_id, n, 3, '(1,1,0)(0,0,0,0)', n * ln(s3 / n) + 2 FROM e)
    SELECT series_id, spec, n, {t("aic", 2)} FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY aic, ord) AS r FROM a) WHERE r = 1""",
)
twin(
    "future_exog",
    ["sparse"],
    f"""+{sparse_features("sparse")},
    z AS (SELECT * EXCLUDE (day_of_week, day_of_month, week_of_year, month, quarter, is_weekend, is_month_end),
                 row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS r FROM features_s),
    u AS (SELECT * EXCLUDE (day), day + CAST(k AS INTEGER) AS day FROM z, (SELECT unnest(range(1, 8)) AS k) WHERE r = 1)
    SELECT series_id, day, """
    + ", ".join(
        f"{CAL[c]} AS {c}" if c in CAL else c if c == "items" else t(c, _PLACES.get(c, 3)) for c in SPARSE_NAMES
    )
    + " FROM u",
)
twin(
    "tabular_matrix",
    ["filled"],
    f"""+f AS (SELECT item, row_number() OVER (ORDER BY min(o)) - 1 AS code
               FROM (SELECT item, strftime(day, '%Y%m%d') || lpad(CAST(sale_id AS VARCHAR), 20, '0') AS o FROM kept) GROUP BY 1)
    SELECT sale_id, amount, CAST(code AS INTEGER) AS item_code, {t("r", 6, "rating")},
           CAST(CASE payment WHEN 'Cash' THEN 0 WHEN 'Credit Card' THEN 1 END AS INTEGER) AS payment_code,
           {cal("year", "month", "day_of_month", "day_of_week")} FROM filled JOIN f USING (item)""",
)

# ---- sources and sinks -----------------------------------------------------

twin("csv_source", ["sales"], "SELECT * FROM sales")
twin(
    "predictions_sink",
    ["preds"],
    f"SELECT series_id, split, day, {t('actual', 3)}, {t('predicted', 3)}, model FROM preds WHERE model = 'naive'",
)
twin(
    "predictions_by_model",
    ["preds"],
    f"SELECT series_id, split, day, {t('actual', 3)}, {t('predicted', 3)}, model FROM preds WHERE model IN ('naive', 'seasonal_naive')",
)
