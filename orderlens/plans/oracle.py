"""The registered queries in SQL, over the given tables alone.

Named steps are chained as common table expressions; a query pulls in the steps
it mentions. Doubles are rounded to four places the same way on both sides.
"""

from __future__ import annotations

import re

from orderlens.operators.features import FEATURES
from orderlens.operators.report import METRIC_DEFAULTS, REASON_TYPES
from orderlens.operators.scaling import SCALED

TYPES = ["price_spike", "delivery_delay", "inventory_depletion"]
ORDER = "order_date, order_id, order_item_id"
PAIR = "product_id, order_region"
PRICE = FEATURES[0]


def r4(x: str, name: str) -> str:
    return f"floor(({x})*10000+0.5)/10000 AS {name}"


def h60(salt: str, ids: str) -> str:
    return f"(('0x'||substr(md5(concat_ws('|','42','{salt}',{ids})),1,15))::BIGINT)"


def u(salt: str, ids: str) -> str:
    return f"({h60(salt, ids)}::DOUBLE/1152921504606846976.0)"


def z(x: str, part: str, name: str) -> str:
    w = f"OVER (PARTITION BY {part})"
    return (
        f"CASE WHEN stddev_pop({x}) {w} IS NULL OR stddev_pop({x}) {w}=0 THEN 0.0 "
        f"ELSE ({x}-avg({x}) {w})/stddev_pop({x}) {w} END AS {name}"
    )


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE/nullif(({b})::DOUBLE,0),0.0)"


STEPS: dict[str, str] = {}

STEPS["order_items"] = """
SELECT l_orderkey AS order_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_item_id,
  l_partkey AS product_id, r_name AS order_region, r_name AS supplier, p_type AS category_name,
  l_extendedprice/nullif(l_quantity,0) AS price, l_quantity AS quantity,
  date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS days_real,
  substr(o_orderpriority,1,1)::DOUBLE AS days_scheduled,
  l_extendedprice*l_discount AS discount, l_discount AS discount_rate, o_orderdate AS order_date
FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
  JOIN region ON n_regionkey=r_regionkey JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey
"""

STEPS["based"] = f"""
SELECT *, coalesce(median(price) OVER (PARTITION BY supplier, category_name ORDER BY {ORDER}
  ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), price) AS baseline FROM order_items
"""

STEPS["zscored"] = f"""
SELECT *, {z('quantity','category_name','order_quantity_zscore_by_category')},
  {z('delivery_delay_days','category_name','delivery_delay_deviation')},
  {z('discount_rate','category_name','discount_rate_anomaly')}, price-baseline AS {PRICE}
FROM (SELECT *, days_real-days_scheduled AS delivery_delay_days FROM based)
"""


def inventory(prefix: str, source: str) -> None:
    """Steps <prefix>_windows, <prefix>_constants, <prefix>_stock over ``source``."""
    STEPS[f"{prefix}_windows"] = f"""
SELECT *, (date_sub('day', first_order_date, order_date)//14)::BIGINT AS restock_window
FROM (SELECT *, min(order_date) OVER (PARTITION BY {PAIR}) AS first_order_date FROM {source})
"""
    STEPS[f"{prefix}_constants"] = f"""
SELECT {PAIR}, min(first_order_date) AS first_order_date,
  greatest(1.0, round_even(sum(n)/count(*)*(sum(q)/sum(k))*2, 0)::DOUBLE) AS base_stock
FROM (SELECT {PAIR}, restock_window, count(*) AS n, sum(quantity) AS q, count(quantity) AS k,
  min(first_order_date) AS first_order_date FROM {prefix}_windows GROUP BY ALL) GROUP BY {PAIR}
"""
    STEPS[f"{prefix}_stock"] = f"""
SELECT *, CASE WHEN recent_demand>0 THEN stock_after_order/recent_demand END AS days_of_cover_remaining,
  coalesce(lag(stock_after_order) OVER (PARTITION BY {PAIR} ORDER BY {ORDER})-stock_after_order, 0.0) AS stock_decline_rate
FROM (SELECT w.*, c.base_stock, CASE WHEN quantity IS NOT NULL THEN c.base_stock-sum(quantity) OVER (PARTITION BY w.product_id,
    w.order_region, restock_window ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) END AS stock_after_order,
  coalesce(avg(quantity) OVER (PARTITION BY w.product_id, w.order_region ORDER BY {ORDER}
    ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), quantity) AS recent_demand
  FROM {prefix}_windows w JOIN {prefix}_constants c ON w.product_id=c.product_id AND w.order_region=c.order_region)
"""


inventory("clean", "zscored")

STEPS["subsets"] = f"""
SELECT *, CASE WHEN rn<=m THEN 0 WHEN rn<=2*m THEN 1 WHEN rn<=3*m THEN 2 END::INTEGER AS subset
FROM (SELECT *, row_number() OVER (ORDER BY {h60('subset','order_item_id')}, order_item_id) AS rn,
  greatest(1, round_even(0.015*(count(*) OVER ()),0)::BIGINT) AS m FROM based)
"""

STEPS["changed"] = f"""
SELECT * EXCLUDE (price, days_real, rn, m), days_real AS clean_days_real,
  CASE WHEN subset=0 THEN price*(1.25+0.25*{u('spike','order_item_id')}) ELSE price END AS price,
  CASE WHEN subset=1 THEN days_real+10+floor(6*{u('delay','order_item_id')}) ELSE days_real END AS days_real,
  CASE WHEN subset IN (0,1) THEN 1 ELSE 0 END AS is_anomaly,
  CASE WHEN subset=0 THEN 'price_spike' WHEN subset=1 THEN 'delivery_delay' ELSE 'normal' END AS anomaly_type
FROM subsets
"""
STEPS["changed_windows"] = f"""
SELECT *, (date_sub('day', first_order_date, order_date)//14)::BIGINT AS restock_window
FROM (SELECT *, min(order_date) OVER (PARTITION BY {PAIR}) AS first_order_date FROM changed)
"""
STEPS["members"] = f"""
SELECT * FROM changed_windows SEMI JOIN (SELECT DISTINCT {PAIR}, restock_window FROM changed_windows WHERE subset=2)
  USING ({PAIR}, restock_window)
"""
STEPS["ranges"] = f"""
SELECT {PAIR}, restock_window, count(*) AS orders, min(quantity) AS min_quantity, max(quantity) AS max_quantity,
  avg(quantity) AS mean_quantity, min(price) AS min_price, max(price) AS max_price, min(discount) AS min_discount,
  max(discount) AS max_discount, min(discount_rate) AS min_rate, max(discount_rate) AS max_rate,
  min(order_date) AS window_start, max(order_date) AS window_end, median(quantity) AS median_quantity,
  median(price) AS median_price FROM members GROUP BY ALL
"""
WK = "product_id, order_region, restock_window"
STEPS["sized"] = f"""
SELECT r.*, t.* EXCLUDE ({WK}), (3+floor(3*{u('burst_size','r.product_id, r.order_region, r.restock_window')}))::BIGINT AS burst_size
FROM ranges r JOIN (SELECT {WK}, supplier, category_name, days_scheduled, discount, discount_rate, clean_days_real
  FROM members QUALIFY row_number() OVER (PARTITION BY {WK} ORDER BY {ORDER})=1) t USING ({WK})
"""
STEPS["numbered"] = f"""
SELECT *, coalesce(sum(burst_size) OVER (ORDER BY {h60('burst_id', WK)}, {WK}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS before,
  (SELECT max(order_id) FROM changed) AS top FROM sized
"""
STEPS["draws"] = f"""
SELECT *, greatest(1.0, least(floor0, centre)) AS low_q, greatest(centre+1, floor0+1, ceil(max_quantity)+1) AS high_q,
  greatest(abs(max_price-min_price)*0.05, median_price*0.02, 0.05) AS jitter,
  greatest((max_discount-min_discount)*0.5, 0.5) AS discount_span, greatest((max_rate-min_rate)*0.5, 0.01) AS rate_span
FROM (SELECT *, greatest(1.0, floor(min_quantity)-1) AS floor0,
  round_even(CASE WHEN median_quantity>0 THEN median_quantity ELSE mean_quantity END, 0) AS centre
  FROM numbered, LATERAL (SELECT unnest(range(1, burst_size+1)) AS i))
"""


def swing(salt: str) -> str:
    return f"({u(salt, WK + ', i')}*2-1)"


STEPS["bursts"] = f"""
SELECT top+before+i AS order_id, (top+before+i)::VARCHAR AS order_item_id, product_id, order_region, supplier, category_name,
  least(greatest(median_price+{swing('burst_price')}*jitter, greatest(min_price-jitter,0.0)), max_price+jitter) AS price,
  low_q+floor((high_q-low_q+1)*{u('burst_quantity', WK + ', i')}) AS quantity,
  clean_days_real AS days_real, days_scheduled,
  least(greatest(coalesce(discount,0.0)+{swing('burst_discount')}*discount_span, greatest(0.0,min_discount)), greatest(0.0,max_discount)) AS discount,
  least(greatest(coalesce(discount_rate,0.0)+{swing('burst_rate')}*rate_span, greatest(0.0,min_rate)), greatest(0.0,max_rate)) AS discount_rate,
  date_trunc('minute', make_timestamp(epoch_us(window_start)+((epoch_us(window_end)-epoch_us(window_start))*i)//(burst_size+1))) AS order_date,
  median_price AS baseline, 1 AS is_anomaly, 'inventory_depletion' AS anomaly_type
FROM draws
"""
STEPS["injected"] = f"""
SELECT *, {z('quantity','category_name','order_quantity_zscore_by_category')},
  {z('delivery_delay_days','category_name','delivery_delay_deviation')},
  {z('discount_rate','category_name','discount_rate_anomaly')}, price-baseline AS {PRICE}
FROM (SELECT *, days_real-days_scheduled AS delivery_delay_days FROM (
  SELECT order_id, order_item_id, product_id, order_region, supplier, category_name, price, quantity, days_real,
    days_scheduled, discount, discount_rate, order_date, baseline, is_anomaly, anomaly_type FROM changed
  UNION ALL BY NAME SELECT * FROM bursts))
"""
inventory("full", "injected")
STEPS["labelled"] = """
SELECT * REPLACE (coalesce(stock_after_order,0.0) AS stock_after_order,
  coalesce(days_of_cover_remaining,0.0) AS days_of_cover_remaining, coalesce(stock_decline_rate,0.0) AS stock_decline_rate)
FROM full_stock
"""
STEPS["split"] = f"""
SELECT *, CASE WHEN is_anomaly<>0 THEN 'anomaly' WHEN {u('split','order_item_id')}<0.7 THEN 'train' ELSE 'held' END AS split
FROM labelled
"""
_medians = ", ".join(f"median({f}) AS med_{i}" for i, f in enumerate(FEATURES))
STEPS["medians"] = f"SELECT {_medians} FROM split WHERE split='train'"
STEPS["train"] = "SELECT s.* REPLACE (" + ", ".join(
    f"coalesce({f}, med_{i}) AS {f}" for i, f in enumerate(FEATURES)
) + ") FROM split s, medians WHERE split='train'"
STEPS["moments"] = "SELECT " + ", ".join(
    f"avg({f}) AS mean_{i}, stddev_pop({f}) AS std_{i}" for i, f in enumerate(FEATURES)
) + ", median(" + PRICE + ") AS price_median FROM train"
STEPS["price_scales"] = f"""
SELECT price_median, mad AS price_mad, coalesce(nullif(1.4826*mad,0), nullif(1.4826*nonzero_mad,0), nullif(std_0,0), 1.0) AS price_scale
FROM moments, (SELECT median(abs({PRICE}-price_median)) AS mad FROM train, moments),
  (SELECT median(abs({PRICE}-m)) AS nonzero_mad FROM train, (SELECT median({PRICE}) AS m FROM train WHERE {PRICE}<>0) WHERE {PRICE}<>0)
"""


def scaled_sql(source: str) -> str:
    columns = [f"(coalesce({PRICE},0.0)-p.price_median)/p.price_scale AS {SCALED[0]}"]
    columns += [
        f"(coalesce({f},0.0)-mean_{i})/coalesce(nullif(std_{i},0),1.0) AS {SCALED[i]}"
        for i, f in enumerate(FEATURES)
        if i
    ]
    squares = "+".join(f"{s}*{s}" for s in SCALED)
    return (
        f"SELECT *, sqrt({squares}) AS score FROM (SELECT t.*, {', '.join(columns)} "
        f"FROM {source} t, moments, price_scales p)"
    )


STEPS["scored"] = scaled_sql("split")
STEPS["clean_scored"] = scaled_sql("clean_stock")
STEPS["rate"] = "SELECT avg(is_anomaly) AS rate FROM labelled"
STEPS["ranked_scores"] = """
SELECT score, row_number() OVER (ORDER BY score)-1 AS rn, (count(*) OVER ()-1)*(1.0-rate) AS h FROM clean_scored, rate
WHERE order_item_id IN (SELECT order_item_id FROM split WHERE split='train')
"""
STEPS["calibrated"] = """
SELECT a+(h-floor(h))*(b-a) AS threshold FROM (SELECT max(score) FILTER (WHERE rn=floor(h)) AS a,
  max(score) FILTER (WHERE rn=ceil(h)) AS b, max(h) AS h FROM ranked_scores)
"""
STEPS["native"] = "SELECT quantile_cont(score, 0.935) AS threshold FROM scored WHERE split='train'"
_ranked = ", ".join(
    f"{{'size': -abs({s}), 'position': {i}, 'feature': '{f}'}}" for i, (s, f) in enumerate(zip(SCALED, FEATURES))
)
_part = lambda i: f"r[{i}].feature||' deviated strongly ('||printf('%.3f', -r[{i}].size)||')'"
STEPS["flagged"] = f"""
SELECT order_item_id, order_id, order_date AS timestamp, score AS anomaly_score, is_anomaly, anomaly_type,
  {_part(1)}||'; '||{_part(2)}||'; '||{_part(3)} AS reason
FROM (SELECT s.*, list_sort([{_ranked}]) AS r FROM scored s, calibrated c WHERE score>=c.threshold)
"""
STEPS["typed_flags"] = (
    "SELECT *, CASE signal "
    + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in REASON_TYPES.items())
    + " ELSE 'other' END AS type FROM (SELECT *, regexp_extract(trim(split_part(reason,';',1)),'^([a-z_]+)',1) AS signal FROM flagged)"
)
STEPS["clean_stats"] = """
SELECT category_name, avg(d) AS dm, stddev_pop(d) AS ds, avg(discount_rate) AS rm, stddev_pop(discount_rate) AS rs
FROM (SELECT *, days_real-days_scheduled AS d FROM order_items) GROUP BY 1
"""
STEPS["live_windows"] = f"""
SELECT l.* EXCLUDE (base_stock, restock_window, first_order_date), c.base_stock, (date_sub('day', c.first_order_date, order_date)//14)::BIGINT AS restock_window
FROM labelled l JOIN clean_constants c USING ({PAIR})
"""
STEPS["live"] = f"""
SELECT order_item_id, is_anomaly, anomaly_type, {PRICE}, delivery_delay_deviation, discount_rate_anomaly, stock_after_order,
  CASE WHEN demand>0 THEN stock_after_order/demand END AS days_of_cover_remaining
FROM (SELECT order_item_id, is_anomaly, anomaly_type,
  price-coalesce(median(price) OVER (PARTITION BY supplier, category_name ORDER BY {ORDER} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), price) AS {PRICE},
  CASE WHEN ds=0 THEN 0.0 ELSE (delivery_delay_days-dm)/ds END AS delivery_delay_deviation,
  CASE WHEN rs=0 THEN 0.0 ELSE (discount_rate-rm)/rs END AS discount_rate_anomaly,
  base_stock-sum(quantity) OVER (PARTITION BY {PAIR}, restock_window ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS stock_after_order,
  coalesce(avg(quantity) OVER (PARTITION BY {PAIR} ORDER BY {ORDER} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), quantity) AS demand
  FROM live_windows JOIN clean_stats USING (category_name))
"""
LATEST = "ORDER BY order_date DESC, order_id DESC, order_item_id DESC"
STEPS["arrivals"] = f"SELECT z.*, {h60('arrival', 'order_item_id')} AS arrival FROM clean_stock z, cut WHERE order_date>=cut"
STEPS["earlier_orders"] = "SELECT z.* FROM clean_stock z, cut WHERE order_date<cut"
STEPS["shuffled_price"] = f"""
SELECT order_item_id, price-coalesce(median(price) OVER (PARTITION BY supplier, category_name ORDER BY arrival, pos
  ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), price) AS deviation
FROM (SELECT order_item_id, supplier, category_name, price, arrival, 0 AS pos FROM arrivals UNION ALL
  SELECT NULL, supplier, category_name, price, -1, -back FROM (SELECT *, row_number() OVER
    (PARTITION BY supplier, category_name {LATEST}) AS back FROM earlier_orders) WHERE back<=30)
"""
STEPS["shuffled_demand"] = f"""
SELECT order_item_id, coalesce(avg(quantity) OVER (PARTITION BY {PAIR} ORDER BY arrival, pos
  ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), quantity) AS demand
FROM (SELECT order_item_id, {PAIR}, quantity, arrival, 0 AS pos FROM arrivals UNION ALL
  SELECT NULL, {PAIR}, quantity, -1, -back FROM (SELECT *, row_number() OVER
    (PARTITION BY {PAIR} {LATEST}) AS back FROM earlier_orders) WHERE back<=7)
"""
STEPS["last_windows"] = f"""
SELECT {PAIR}, max(restock_window) AS last_window, arg_max(q, restock_window) AS used
FROM (SELECT {PAIR}, restock_window, sum(quantity) AS q FROM earlier_orders GROUP BY ALL) GROUP BY {PAIR}
"""
STEPS["shuffled_windows"] = f"""
SELECT a.*, coalesce(last_window,0) AS seeded, coalesce(used,0.0) AS used, greatest(max(restock_window) OVER
  (PARTITION BY product_id, order_region ORDER BY arrival ROWS UNBOUNDED PRECEDING), coalesce(last_window,0)) AS in_window
FROM arrivals a LEFT JOIN last_windows USING ({PAIR})
"""
STEPS["shuffled"] = f"""
SELECT order_item_id, deviation AS {PRICE}, delivery_delay_deviation, discount_rate_anomaly, stock AS stock_after_order,
  stock/demand AS days_of_cover_remaining
FROM (SELECT *, base_stock-sum(quantity) OVER (PARTITION BY {PAIR}, in_window ORDER BY arrival ROWS UNBOUNDED PRECEDING)
  -CASE WHEN in_window=seeded THEN used ELSE 0.0 END AS stock FROM shuffled_windows)
  JOIN shuffled_price USING (order_item_id) JOIN shuffled_demand USING (order_item_id)
"""
STEPS["shuffled_scored"] = scaled_sql("shuffled")
STEPS["apart"] = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(a.{f}-b.{f}) AS delta FROM shuffled a JOIN clean_stock b USING (order_item_id) "
    f"WHERE abs(a.{f}-b.{f})>1e-6+1e-6*abs(b.{f})"
    for f in FEATURES
)
STEPS["verdicts"] = """
SELECT a.score>=threshold AS live, b.score>=threshold AS offline
FROM calibrated, shuffled_scored a JOIN clean_scored b USING (order_item_id)
"""
STEPS["live_scored"] = scaled_sql("live")
STEPS["cut"] = "SELECT max(order_date) - INTERVAL 1095 DAY AS cut FROM order_items"


def metrics(source: str, pred: str, by: str = "", having: str = "") -> str:
    """Counts and rates of a prediction over a labelled source."""
    n = lambda c: f"count(*) FILTER (WHERE {c})"
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    y = "is_anomaly=1"
    inner = (
        f"SELECT {lead}count(*) AS n, {n(f'{y} AND ({pred})')} AS tp, {n(f'is_anomaly<>1 AND ({pred})')} AS fp, "
        f"{n(f'{y} AND NOT ({pred})')} AS fn, {n(f'is_anomaly<>1 AND NOT ({pred})')} AS tn"
        + "".join(
            f", {n(f'anomaly_type=$${t}$$ AND {y}')} AS n_{t}, {n(f'anomaly_type=$${t}$$ AND {y} AND ({pred})')} AS tp_{t}"
            for t in TYPES
        )
        + f" FROM {source}{group}"
    )
    p, r = ratio("tp", "tp+fp"), ratio("tp", "tp+fn")
    return (
        f"SELECT *, {ratio('tp+fp', 'n')} AS flag_rate, {p} AS precision, {r} AS recall, "
        f"{ratio(f'2*{p}*{r}', f'{p}+{r}')} AS f1, {ratio('fp', 'fp+tn')} AS fp_rate FROM ({inner})"
    )


RATES = ["flag_rate", "precision", "recall", "f1", "fp_rate"]
RATE_COLUMNS = ", ".join(r4(c, c) for c in RATES)
HOLDOUTS = f"""
SELECT *, 'all' AS holdout FROM scored WHERE split IN ('held','anomaly')
UNION ALL SELECT *, 'population' FROM scored WHERE split='held'
UNION ALL (SELECT * EXCLUDE (rn, k), 'population' FROM (SELECT *, row_number() OVER (ORDER BY {h60('population','order_item_id')}, order_item_id) AS rn,
  (SELECT round_even((count(*) FILTER (WHERE split='held'))*(avg(is_anomaly)/(1-avg(is_anomaly))), 0) FROM split) AS k
  FROM scored WHERE split='anomaly') WHERE rn<=k)
UNION ALL SELECT *, 'balanced' FROM scored WHERE split='anomaly'
UNION ALL (SELECT * EXCLUDE (rn, k), 'balanced' FROM (SELECT *, row_number() OVER (ORDER BY {h60('balanced','order_item_id')}, order_item_id) AS rn,
  (SELECT count(*) FROM split WHERE split='anomaly') AS k FROM scored WHERE split='held') WHERE rn<=k)
"""
STEPS["held_out"] = HOLDOUTS
ITEM = "order_item_id"


def rounded(columns: list[str]) -> str:
    return ", ".join(r4(c, c) for c in columns)


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def _sweep(source: str, thresholds: list[str], by: str = "", extra: str = "") -> str:
    lead = f"{by}, " if by else ""
    recalls = ", ".join(r4(ratio(f"tp_{t}", f"n_{t}"), f"recall_{t}") for t in TYPES)
    return _union(
        [
            f"SELECT {lead}{r4(t, 'threshold')}, {RATE_COLUMNS}, {recalls} FROM ({metrics(source, f'score>={t}', by)})"
            for t in thresholds
        ]
    )


STOCK = ["stock_after_order", "days_of_cover_remaining", "stock_decline_rate"]
TS = "strftime(order_date,'%Y-%m-%d %H:%M:%S') AS order_date"
CAL = "(SELECT threshold FROM calibrated)"
NAT = "(SELECT threshold FROM native)"
LABELLED_DOUBLES = [
    "price", "quantity", "days_real", "discount", "discount_rate", "order_quantity_zscore_by_category",
    "delivery_delay_days", "delivery_delay_deviation", "discount_rate_anomaly", PRICE, *STOCK,
]
RANGE_DOUBLES = [
    "min_quantity", "max_quantity", "mean_quantity", "median_quantity", "min_price", "max_price", "median_price",
    "min_discount", "max_discount", "min_rate", "max_rate",
]
NULLABLE = ["order_id", "order_item_id", "product_id", "order_region", "supplier", "category_name", "price",
            "quantity", "days_real", "days_scheduled", "discount", "discount_rate", "order_date"]
STEPS["gap_items"] = """
SELECT * REPLACE (CASE WHEN order_id%11<>0 THEN price END AS price, CASE WHEN order_id%13<>0 THEN quantity END AS quantity,
  CASE WHEN order_id%17<>0 THEN days_real END AS days_real, CASE WHEN order_id%19<>0 THEN discount_rate END AS discount_rate)
FROM order_items
"""
STEPS["gap_based"] = STEPS["based"].replace("FROM order_items", "FROM gap_items")
STEPS["gap_zscored"] = STEPS["zscored"].replace("FROM based", "FROM gap_based")
inventory("gap", "gap_zscored")


def keyed(name: str, items: str, prefix: str) -> None:
    """Step ``name``: what an order sees of earlier ones, from arrays of known prices and per-window sums, not from the reference."""
    STEPS[f"{name}_prices"] = f"""
SELECT supplier, category_name, list(price ORDER BY {ORDER}) AS known FROM {items} WHERE price IS NOT NULL GROUP BY ALL
"""
    STEPS[f"{name}_frozen"] = f"""
SELECT category_name, avg(days_real-days_scheduled) AS dm, stddev_pop(days_real-days_scheduled) AS ds,
  avg(discount_rate) AS rm, stddev_pop(discount_rate) AS rs FROM {items} GROUP BY ALL
"""
    STEPS[f"{name}_seen"] = f"""
SELECT w.*, c.base_stock, CASE WHEN order_date<cut THEN quantity ELSE coalesce(quantity,0) END AS known_quantity,
  count(price) OVER (PARTITION BY supplier, category_name ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
FROM {prefix}_windows w JOIN {prefix}_constants c ON w.product_id=c.product_id AND w.order_region=c.order_region, cut
"""
    STEPS[f"{name}_used"] = f"""
SELECT *, base_stock-sum(coalesce(quantity,0)) OVER (PARTITION BY {PAIR}, restock_window ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS stock,
  coalesce(avg(known_quantity) OVER (PARTITION BY {PAIR} ORDER BY {ORDER} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), known_quantity) AS demand
FROM {name}_seen
"""
    z_of = lambda x, m, d: f"coalesce(CASE WHEN {d}>0 THEN (({x})-{m})/{d} END, 0.0)"
    STEPS[name] = f"""
SELECT {ITEM}, price-coalesce(list_aggregate(known[greatest(k-29,1):k],'median'),price) AS {PRICE},
  {z_of('days_real-days_scheduled','dm','ds')} AS delivery_delay_deviation, {z_of('discount_rate','rm','rs')} AS discount_rate_anomaly,
  stock AS stock_after_order, CASE WHEN demand>0 THEN stock/demand END AS days_of_cover_remaining
FROM (SELECT u.* EXCLUDE ({', '.join([PRICE, 'delivery_delay_deviation', 'discount_rate_anomaly'])}) FROM {name}_used u) u
  LEFT JOIN {name}_prices p ON u.supplier=p.supplier AND u.category_name=p.category_name
  LEFT JOIN {name}_frozen f ON u.category_name=f.category_name, cut WHERE order_date>=cut
"""


keyed("keyed_clean", "order_items", "clean")
keyed("keyed_gaps", "gap_items", "gap")


def parity_pairs(live: str, reference: str) -> str:
    """One row per order and feature: live value a, reference value b, and whether they agree."""
    same = "CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE abs(a-b)<=1e-6+1e-6*abs(b) END"
    return (
        f"SELECT *, {same} AS same FROM (" + " UNION ALL ".join(
            f"SELECT l.{ITEM}, '{f}' AS feature, l.{f}::DOUBLE AS a, r.{f}::DOUBLE AS b FROM {live} l JOIN {reference} r ON l.{ITEM}=r.{ITEM}"
            for f in FEATURES
        ) + ")"
    )


STEPS["clean_pairs"] = parity_pairs("keyed_clean", "clean_stock")
STEPS["gap_pairs"] = parity_pairs("keyed_gaps", "gap_stock")


def _summary(pairs: str) -> str:
    return (
        f"SELECT feature, count(*) FILTER (WHERE same) AS exact, count(*) AS total, "
        f"{r4('coalesce(max(abs(a-b)) FILTER (WHERE same),0.0)','max_abs_delta')}, "
        f"CASE WHEN bool_and(same) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {pairs} GROUP BY feature"
    )


TREES, DEPTH = 300, 8
_c = lambda n: f"(CASE WHEN ({n})=2 THEN 1.0 WHEN ({n})>2 THEN 2*(ln(({n})-1)+0.5772156649015329)-2*(({n})-1)/({n})::DOUBLE ELSE 0.0 END)"
_vector = "[" + ", ".join(f"floor({c}*1000000+0.5)/1000000" for c in SCALED) + "]"

STEPS["forest_all"] = f"SELECT {ITEM}, split, is_anomaly, anomaly_type, row_number() OVER (ORDER BY {ITEM}) AS rid, {_vector} AS x FROM scored"


def forest(name: str, where: str, rows: str = "forest_all") -> None:
    """Steps {name}_train to {name}_trees: the forest of the ``rows`` that ``where`` keeps."""
    STEPS[f"{name}_train"] = f"SELECT {ITEM}, x FROM {rows} WHERE {where}"
    STEPS[f"{name}_size"] = f"SELECT least(1.0, 512.0/count(*))::DOUBLE AS share, floor(1/least(1.0, 512.0/count(*)))::BIGINT AS per FROM {name}_train"
    STEPS[f"{name}_sample"] = f"""
    SELECT tree, x FROM (SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY {h60('rank', f'tree, {ITEM}')}, {ITEM}) AS rn
      FROM (SELECT *, turn*per+place AS tree FROM (SELECT t.*, per, turn, floor({u('tree', f'turn, {ITEM}')}/share)::BIGINT AS place
        FROM {name}_train t, {name}_size, range({TREES}) r(turn) WHERE turn < ceil({TREES}/per::DOUBLE)) WHERE place<per) WHERE tree<{TREES}) WHERE rn<=256
    """
    for _d in range(DEPTH + 1):
        STEPS[f"{name}_grown_{_d}"] = (
            f"SELECT tree, 1::BIGINT AS node, x FROM {name}_sample" if _d == 0 else
            f"SELECT g.tree, 2*g.node+(x[feature]>cut)::BIGINT AS node, x FROM {name}_grown_{_d - 1} g JOIN {name}_parted_{_d - 1} p "
            "ON g.tree=p.tree AND g.node=p.node WHERE feature>0"
        )
        STEPS[f"{name}_parted_{_d}"] = f"""
    SELECT tree, node, rows, feature, CASE WHEN feature>0 THEN least_x[feature]+(most_x[feature]-least_x[feature])*{u('cut', 'tree, node')} ELSE 0.0 END AS cut,
      CASE WHEN feature>0 THEN 0 ELSE floor(({_d}+{_c('rows')})*1000000+0.5)::BIGINT END AS path
    FROM (SELECT *, CASE WHEN {_d}<{DEPTH} AND rows>1 AND len(usable)>0 THEN usable[1+{h60('split', 'tree, node')}%len(usable)] ELSE 0 END AS feature
      FROM (SELECT *, list_filter(range(1,{len(SCALED) + 1}), lambda i: most_x[i]>least_x[i]) AS usable
        FROM (SELECT tree, node, count(*) AS rows, [{', '.join(f'min(x[{i + 1}])' for i in range(len(SCALED)))}] AS least_x,
          [{', '.join(f'max(x[{i + 1}])' for i in range(len(SCALED)))}] AS most_x FROM {name}_grown_{_d} GROUP BY tree, node)))
    """
    STEPS[f"{name}_nodes"] = " UNION ALL ".join(f"SELECT tree, node, feature, cut, path FROM {name}_parted_{d}" for d in range(DEPTH + 1))
    #: A tree as three lists by node number, so that a walk is list lookups: f feature, k cut, w path.
    STEPS[f"{name}_trees"] = f"""
    SELECT tree, list(coalesce(feature,0) ORDER BY n) AS f, list(coalesce(cut,0.0) ORDER BY n) AS k, list(coalesce(path,0) ORDER BY n) AS w
    FROM (SELECT t.tree, n.n, p.feature, p.cut, p.path FROM range({TREES}) t(tree) CROSS JOIN range(1, {2 << DEPTH}) n(n)
      LEFT JOIN {name}_nodes p ON p.tree=t.tree AND p.node=n.n) GROUP BY tree
    """


def walked(rows: str, name: str) -> str:
    """Query of rid and score: every row of ``rows`` (rid, x) down every tree of a forest."""
    walk = f"SELECT rid, x, f, k, w, 1::BIGINT AS node FROM {rows} CROSS JOIN {name}_trees"
    for _ in range(DEPTH):
        walk = f"SELECT rid, x, f, k, w, CASE WHEN f[node]>0 THEN 2*node+(x[f[node]]>k[node])::BIGINT ELSE node END AS node FROM ({walk})"
    return f"SELECT rid, pow(2.0, -(sum(w[node])::DOUBLE/{TREES})/({_c('256')}*1000000)) AS score FROM ({walk}) GROUP BY rid"


forest("forest", "split='train'")
forest("forest_full", "true")
STEPS["forest_scores"] = walked("forest_all", "forest")
STEPS["forest_full_scores"] = walked("forest_all", "forest_full")
STEPS["full_scored"] = "SELECT a.*, score FROM forest_all a JOIN forest_full_scores s ON a.rid=s.rid"
STEPS["forest_scored"] = "SELECT a.*, score FROM forest_all a JOIN forest_scores s ON a.rid=s.rid"
STEPS["forest_limit"] = "SELECT quantile_cont(score, 0.935) AS forest_limit FROM forest_scored WHERE split='train'"
STEPS["forest_flagged"] = "SELECT *, score>forest_limit AS flagged FROM forest_scored, forest_limit"


#: The suite: training rows and the balanced test, their vectors under each scaling, a forest of each.
_suite_columns = f"{ITEM}, split, is_anomaly, anomaly_type, {', '.join(FEATURES)}"
STEPS["forest_suite_rows"] = f"""
SELECT {_suite_columns} FROM train UNION ALL SELECT {_suite_columns} FROM split WHERE split='anomaly'
UNION ALL SELECT {_suite_columns} FROM (SELECT *, row_number() OVER (ORDER BY {h60('balanced', ITEM)}, {ITEM}) AS rn FROM split WHERE split='held')
  WHERE rn<=(SELECT count(*) FROM split WHERE split='anomaly')
"""
_centred = [f"(coalesce({f},0.0)-mean_{i})/coalesce(nullif(std_{i},0),1.0)" for i, f in enumerate(FEATURES)]
SUITE = {
    "raw": [f"coalesce({f},0.0)" for f in FEATURES],
    "standard": _centred,
    "mad_price": [f"(coalesce({PRICE},0.0)-p.price_median)/p.price_scale", *_centred[1:]],
}
for _s, _columns in SUITE.items():
    STEPS[f"forest_{_s}_all"] = (
        f"SELECT {ITEM}, split, is_anomaly, anomaly_type, row_number() OVER (ORDER BY {ITEM}) AS rid, "
        f"[{', '.join(f'floor({c}*1000000+0.5)/1000000' for c in _columns)}] AS x FROM forest_suite_rows, moments, price_scales p"
    )
    forest(f"forest_{_s}", "split='train'", f"forest_{_s}_all")
    STEPS[f"forest_{_s}_walked"] = walked(f"forest_{_s}_all", f"forest_{_s}")
    STEPS[f"forest_{_s}_scored"] = f"SELECT a.*, score FROM forest_{_s}_all a JOIN forest_{_s}_walked s ON a.rid=s.rid"
STEPS["forest_suite"] = " UNION ALL ".join(
    f"SELECT 'isolation_forest' AS model, '{s}' AS scaling, is_anomaly, anomaly_type, "
    f"score>(SELECT quantile_cont(score, 0.935) FROM forest_{s}_scored WHERE split='train') AS flagged FROM forest_{s}_scored WHERE split<>'train'"
    for s in SUITE
) + (
    " UNION ALL SELECT 'vector_length', 'mad_price', is_anomaly, anomaly_type, score>threshold FROM scored, native "
    f"WHERE {ITEM} IN (SELECT {ITEM} FROM forest_suite_rows WHERE split<>'train')"
)
_suite = metrics("forest_suite", "flagged", "model, scaling")
_suite_recalls = ", ".join(r4(ratio(f"tp_{t}", f"n_{t}"), f"recall_{t}") for t in TYPES)

STEPS["keyed_scored"] = scaled_sql("keyed_clean")
STEPS["keyed_rows"] = f"SELECT {ITEM}, row_number() OVER (ORDER BY {ITEM}) AS rid, {_vector} AS x FROM keyed_scored"
STEPS["keyed_walked"] = walked("keyed_rows", "forest")
STEPS["keyed_orders"] = f"SELECT {ITEM}, order_id FROM order_items"

_live = lambda cond: f"SELECT {ITEM}, {rounded(FEATURES)} FROM clean_stock, cut WHERE {cond}"
_defaults = ", ".join(f"('{m}', {v}::DOUBLE)" for m, v in METRIC_DEFAULTS.items())
MEASURED = metrics('scored', f'score>={CAL}')
ROBUST = (
    f"SELECT {ITEM}, {r4('CASE WHEN mad IS NULL OR 1.4826*mad=0 THEN 0.0 ELSE (price-m)/(1.4826*mad) END', 'robust_z')} "
    "FROM (SELECT *, median(abs(price-m)) OVER (PARTITION BY category_name) AS mad FROM "
    "(SELECT *, median(price) OVER (PARTITION BY category_name) AS m FROM order_items))"
)

QUERIES: dict[str, str] = {
    "order_items": f"SELECT order_id, {ITEM}, product_id, order_region, category_name, {rounded(['price','quantity','days_real','days_scheduled','discount','discount_rate'])}, {TS} FROM order_items",
    "price_baseline": f"SELECT {ITEM}, {r4('baseline','price_baseline')} FROM based",
    "price_deviation": f"SELECT {ITEM}, {r4('price-baseline', PRICE)} FROM based",
    "quantity_zscore": f"SELECT {ITEM}, {rounded(['order_quantity_zscore_by_category'])} FROM zscored",
    "delivery_delay": f"SELECT {ITEM}, days_real-days_scheduled AS delivery_delay_days FROM order_items",
    "delivery_zscore": f"SELECT {ITEM}, {rounded(['delivery_delay_deviation'])} FROM zscored",
    "discount_zscore": f"SELECT {ITEM}, {rounded(['discount_rate_anomaly'])} FROM zscored",
    "robust_zscore": ROBUST,
    "feature_table": f"SELECT {ITEM}, {rounded([PRICE,'order_quantity_zscore_by_category','delivery_delay_days','delivery_delay_deviation','discount_rate_anomaly'])} FROM zscored",
    "pair_constants": f"SELECT {PAIR}, strftime(first_order_date,'%Y-%m-%d %H:%M:%S') AS first_order_date, {rounded(['base_stock'])} FROM clean_constants",
    "restock_window": f"SELECT {ITEM}, restock_window FROM clean_windows",
    "inventory_balance": f"SELECT {ITEM}, {rounded(['base_stock','stock_after_order'])} FROM clean_stock",
    "recent_demand": f"SELECT {ITEM}, {rounded(['recent_demand'])} FROM clean_stock",
    "days_of_cover": f"SELECT {ITEM}, {rounded(['days_of_cover_remaining'])} FROM clean_stock",
    "stock_decline": f"SELECT {ITEM}, {rounded(['stock_decline_rate'])} FROM clean_stock",
    "offline_reference": f"SELECT {ITEM}, {rounded(FEATURES)} FROM clean_stock",
    "label_subsets": f"SELECT {ITEM}, subset FROM subsets WHERE subset IS NOT NULL",
    "price_spikes": f"SELECT {ITEM}, {rounded(['price'])} FROM changed WHERE subset=0",
    "delivery_delays": f"SELECT {ITEM}, {rounded(['days_real'])} FROM changed WHERE subset=1",
    "window_stats": f"SELECT {WK}, orders, {rounded(RANGE_DOUBLES)} FROM ranges",
    "burst_rows": f"SELECT order_id, {ITEM}, {PAIR}, {rounded(['price','quantity','days_real','discount','discount_rate','baseline'])}, {TS} FROM bursts",
    "labelled_orders": f"SELECT order_id, {ITEM}, {PAIR}, {rounded(LABELLED_DOUBLES)}, {TS}, is_anomaly, anomaly_type FROM labelled",
    "anomaly_summary": f"SELECT anomaly_type, count(*) AS count, {r4('count(*)/(SELECT count(*) FROM labelled)::DOUBLE*100','percent')} FROM labelled GROUP BY 1",
    "label_check": "SELECT anomaly_type, sum(is_anomaly)::BIGINT AS flagged, count(*) FILTER (WHERE is_anomaly>1) AS overlapping FROM labelled GROUP BY 1",
    "frozen_stats": f"SELECT category_name, {r4('avg(d)','delay_mean')}, {r4('CASE WHEN count(d)>1 THEN stddev_pop(d) ELSE 0 END','delay_std')}, {r4('avg(discount_rate)','discount_mean')}, {r4('CASE WHEN count(discount_rate)>1 THEN stddev_pop(discount_rate) ELSE 0 END','discount_std')} FROM (SELECT *, days_real-days_scheduled AS d FROM order_items) GROUP BY 1",
    "price_tail": f"SELECT supplier, category_name, string_agg(printf('%.4f', floor(price*10000+0.5)/10000), ' ' ORDER BY {ORDER}) AS prices FROM (SELECT * FROM order_items, cut WHERE order_date<cut AND price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY supplier, category_name ORDER BY order_date DESC, order_id DESC, order_item_id DESC)<=30) GROUP BY 1,2",
    "inventory_tail": f"""SELECT c.product_id, c.order_region, {r4('base_stock','base_stock')}, coalesce(last_window,0)::BIGINT AS last_window, {r4('coalesce(used,0.0)','used')}, coalesce(quantities,'') AS quantities
      FROM clean_constants c LEFT JOIN (SELECT {PAIR}, max(restock_window) AS last_window, arg_max(q, restock_window) AS used FROM (SELECT {PAIR}, restock_window, sum(quantity) AS q FROM clean_windows, cut WHERE order_date<cut GROUP BY ALL) GROUP BY 1,2) w
        ON c.product_id=w.product_id AND c.order_region=w.order_region
      LEFT JOIN (SELECT {PAIR}, string_agg(printf('%.1f', quantity), ' ' ORDER BY {ORDER}) AS quantities FROM (SELECT * FROM clean_windows, cut WHERE order_date<cut QUALIFY row_number() OVER (PARTITION BY {PAIR} ORDER BY order_date DESC, order_id DESC, order_item_id DESC)<=7) GROUP BY 1,2) t
        ON c.product_id=t.product_id AND c.order_region=t.order_region""",
    "live_features": _live("order_date>=cut"),
    "live_scoring": f"SELECT {ITEM}, is_anomaly, anomaly_type, {r4('score','score')}, score>={CAL} AS flagged, {_part(1)}||'; '||{_part(2)}||'; '||{_part(3)} AS reason FROM (SELECT *, list_sort([{_ranked}]) AS r FROM live_scored)",
    "live_evaluation": f"SELECT n, tp, fp, fn, tn, {RATE_COLUMNS} FROM ({metrics('live_scored', f'score>={CAL}')})",
    "iforest_scores": f"SELECT {ITEM}, anomaly_type, {r4('score','score')}, flagged FROM forest_flagged",
    "forest_metrics": f"SELECT n, tp, fp, fn, tn, {RATE_COLUMNS} FROM ({metrics('forest_flagged', 'flagged')})",
    "forest_recall_by_type": _union([f"SELECT '{t}' AS anomaly_type, n_{t} AS true_count, tp_{t} AS true_positives, {r4(ratio(f'tp_{t}', f'n_{t}'),'recall')} FROM ({metrics('forest_flagged', 'flagged')})" for t in TYPES]),
    "model_suite": f"SELECT model, scaling, n, tp, fp, fn, tn, {RATE_COLUMNS}, {_suite_recalls} FROM ({_suite})",
    "best_model": f"SELECT model, {r4('f1','f1')} FROM ({_suite}) WHERE scaling='mad_price' ORDER BY f1 DESC, model LIMIT 1",
    "forest_sweep": _sweep("forest_scored", ["0.4", "0.45", "0.5", "0.55", "0.6"]),
    "full_data_model": " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({_sweep(f'{m}_scored', ['0.45', '0.5', '0.55'])})" for m in ("forest", "full")),
    "stored_model": f"SELECT {ITEM}, {r4('score','score')}, flagged, 1.0::DOUBLE AS f1 FROM forest_flagged",
    "threshold_sources": _union([f"SELECT '{n}' AS source, count(*) FILTER (WHERE score{c}) AS flags FROM forest_scored, forest_limit" for n, c in (("env", ">=0.5"), ("manifest", ">=forest_limit"), ("model-predict", ">forest_limit"))]),
    "csv_orders": f"SELECT order_id, {ITEM}, {PAIR}, supplier, category_name||' é, \"x\"' AS category_name, {r4('CASE WHEN order_id%11<>0 THEN price END','price')}, {rounded(['quantity','days_real'])}, {TS} FROM order_items WHERE order_id%13<>0",
    "id_list": f"SELECT {ITEM} FROM order_items, cut WHERE order_date<cut",
    "labelled_sink": f"SELECT order_id, {ITEM}, {rounded(LABELLED_DOUBLES)}, {TS}, is_anomaly, anomaly_type FROM labelled",
    "first_flips": f"SELECT {ITEM}, live, offline, {rounded(['live_score','offline_score'])} FROM flips WHERE live<>offline ORDER BY {ITEM} LIMIT 8",
    "flag_increments": _union([f"SELECT {i} AS look, {ITEM}, (order_id%3)::BIGINT AS batch_id FROM flagged WHERE {c}" for i, c in ((1, "order_id%3<2"), (2, "order_id%3=2"), (3, "order_id%3=0"))]),
    "lof_products": f"SELECT g.p AS product_id, {r4('avg(d.lrd)/max(own.lrd)','score')} FROM profile_edges g JOIN profile_density d ON g.o=d.p JOIN profile_density own ON own.p=g.p GROUP BY g.p",
    "scoring_job": f"SELECT k.{ITEM}, order_id::VARCHAR AS order_id, {r4('score', 'anomaly_score')} FROM keyed_walked w JOIN keyed_rows k ON w.rid=k.rid JOIN keyed_orders o ON o.{ITEM}=k.{ITEM}, forest_limit WHERE score>forest_limit",
    "scoring_log": f"SELECT k.{ITEM}, order_id::VARCHAR AS order_id, {rounded(FEATURES)} FROM keyed_clean k JOIN keyed_orders o ON o.{ITEM}=k.{ITEM}",
    "scoring_run": "SELECT 'ForestModel' AS model_name, NULL::DOUBLE AS threshold, 'model-predict' AS threshold_source, count(*)::BIGINT AS orders_processed, 2::BIGINT AS batches FROM keyed_clean",
    "keyed_features": f"SELECT {ITEM}, {rounded(FEATURES)} FROM keyed_clean",
    "keyed_features_with_gaps": f"SELECT {ITEM}, {rounded(FEATURES)} FROM keyed_gaps",
    "live_features_with_gaps": f"SELECT {ITEM}, {rounded(FEATURES)} FROM keyed_gaps",
    "reference_with_gaps": f"SELECT {ITEM}, {rounded(FEATURES)} FROM gap_stock",
    "parity_with_gaps": _summary("gap_pairs"),
    "parity_summary": _summary("clean_pairs"),
    "parity_result": f"SELECT count(*) FILTER (WHERE every) AS exact_rows, count(*) AS rows, CASE WHEN bool_and(every) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT {ITEM}, bool_and(same) AS every FROM clean_pairs GROUP BY {ITEM})",
    "stream_envelope": f"SELECT {ITEM}, order_id, {PAIR}, {r4('price','price')}, {TS} FROM order_items",
    "parity_divergence": f"SELECT feature, count(*) AS diverged, {r4('avg(delta)','mean_delta')}, {r4('max(delta)','max_delta')}, {r4('median(delta)','median_delta')} FROM apart GROUP BY 1",
    "verdict_flips": f"SELECT count(*) AS rows, count(*) FILTER (WHERE offline) AS flagged_offline, count(*) FILTER (WHERE live) AS flagged_live, count(*) FILTER (WHERE live<>offline) AS flipped, {r4(ratio('count(*) FILTER (WHERE live<>offline)','count(*)'),'flip_rate')} FROM verdicts",
    "train_split": f"SELECT {ITEM}, split FROM split",
    "median_impute": "SELECT " + ", ".join(r4(f"med_{i}", f) for i, f in enumerate(FEATURES)) + " FROM medians",
    "price_scale": f"SELECT {rounded(['price_median','price_mad','price_scale'])} FROM price_scales",
    "scaled_features": f"SELECT {ITEM}, {rounded([*SCALED, 'score'])} FROM scored",
    "flags": f"SELECT {ITEM}, order_id, {rounded(['anomaly_score'])} FROM flagged",
    "reason_text": f"SELECT {ITEM}, reason FROM flagged",
    "prf": f"SELECT n, tp, fp, fn, tn, {RATE_COLUMNS} FROM ({metrics('scored', f'score>={CAL}')})",
    "confusion": f"SELECT actual, predicted, rows FROM (SELECT unnest([{{'actual':0,'predicted':0,'rows':tn}},{{'actual':0,'predicted':1,'rows':fp}},{{'actual':1,'predicted':0,'rows':fn}},{{'actual':1,'predicted':1,'rows':tp}}], recursive := true) FROM ({metrics('scored', f'score>={CAL}')}))",
    "recall_by_type": _union([f"SELECT '{t}' AS anomaly_type, n_{t} AS true_count, tp_{t} AS true_positives, {r4(ratio(f'tp_{t}', f'n_{t}'),'recall')} FROM ({metrics('scored', f'score>={CAL}')})" for t in TYPES]),
    "fp_rate": f"SELECT {rounded(['flag_rate','fp_rate'])} FROM ({metrics('scored', f'score>={CAL}')})",
    "calibrated_threshold": f"SELECT {rounded(['threshold'])} FROM calibrated",
    "holdouts": f"SELECT holdout, n, {RATE_COLUMNS} FROM ({metrics('held_out', f'score>={NAT}', 'holdout')})",
    "segment_flag_rates": _union([f"SELECT '{s}' AS segment, {r4(ratio(f'count(*) FILTER (WHERE {c} AND score>={NAT})', f'count(*) FILTER (WHERE {c})'),'flag_rate')} FROM scored" for s, c in [("train", "split='train'"), ("held", "split='held'"), ("anomaly", "split='anomaly'"), ("all", "true")]]),
    "threshold_sweep": _sweep("scored", [CAL, "3.0", "4.0", "6.0", "9.0"]),
    "before_after": _sweep("held_out", [NAT, CAL], "holdout"),
    "score_distribution": f"SELECT anomaly_type, {r4('median(score)','median')}, {r4('quantile_cont(score,0.95)','p95')}, count(*) AS n FROM scored GROUP BY 1",
    "median_shift": f"SELECT {r4('median(s.score)','native_median')}, {r4('median(c.score)','clean_median')}, {r4('median(c.score)-median(s.score)','shift')} FROM scored s JOIN clean_scored c USING ({ITEM}) WHERE s.is_anomaly=0",
    "native_space": f"SELECT anomaly_type, count(*) AS n, count(*) FILTER (WHERE score>={CAL}) AS flagged FROM scored GROUP BY 1",
    "block_shuffle": f"SELECT {ITEM}, block, row_number() OVER (PARTITION BY block ORDER BY h, {ITEM}) AS place FROM (SELECT *, (date_diff('day', (SELECT min(order_date)::DATE FROM order_items), order_date::DATE)//7)::BIGINT AS block, {h60('block', ITEM)} AS h FROM order_items)",
    "id_anti_join": f"SELECT {ITEM}, quantity FROM order_items, cut WHERE order_date<cut",
    "id_intersection": f"SELECT {ITEM} FROM labelled INTERSECT SELECT {ITEM} FROM order_items",
    "training_overlap": f"SELECT count(*) AS rows, count(stored) AS present, count(*) FILTER (WHERE abs(stock_after_order-stored)<=1e-6+1e-6*abs(stored)) AS identical FROM (SELECT c.stock_after_order, l.stock_after_order AS stored FROM clean_stock c LEFT JOIN labelled l USING ({ITEM}))",
    "earliest_orders": f"SELECT {ITEM}, {TS} FROM order_items o ORDER BY o.order_date, o.order_id, o.order_item_id LIMIT 100",
    "latest_orders": f"SELECT {ITEM}, {TS} FROM order_items o ORDER BY o.order_date DESC, o.order_id DESC, o.order_item_id DESC LIMIT 100",
    "random_sample": f"SELECT {ITEM}, {rounded(['price'])} FROM order_items ORDER BY {h60('eda', ITEM)}, {ITEM} LIMIT 500",
    "severity": "SELECT severity, count(*) AS rows FROM (SELECT CASE WHEN anomaly_score>=10 THEN 'High' WHEN anomaly_score>=6 THEN 'Medium' ELSE 'Low' END AS severity FROM flagged) GROUP BY 1",
    "primary_reason": f"SELECT {ITEM}, signal, type FROM typed_flags",
    "display_rows": f"SELECT strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS time, order_id::VARCHAR AS order_id, {r4('anomaly_score','score')}, CASE WHEN anomaly_score>=10 THEN 'High' WHEN anomaly_score>=6 THEN 'Medium' ELSE 'Low' END AS severity, type, signal, substr(reason,1,110) AS reason FROM typed_flags WHERE type IN ('price','delivery','inventory','discount','stock')",
    "newest_flags": f"SELECT {ITEM}, strftime(f.timestamp,'%Y-%m-%d %H:%M:%S') AS time FROM flagged f ORDER BY f.timestamp DESC, {ITEM} DESC LIMIT 200",
    "flag_volume": "SELECT strftime(timestamp,'%Y-%m-%d') AS bucket, 'day' AS unit, count(*) AS count FROM flagged GROUP BY 1",
    "burst_buckets": "SELECT strftime(moment,'%H:%M:%S')||'.'||lpad((epoch_us(moment)%1000000//10000)::VARCHAR,2,'0') AS bucket, 'centisecond' AS unit, count(*) AS count FROM (SELECT make_timestamp(epoch_us(TIMESTAMP '2024-01-01')+epoch_us(ts)%1000000) AS moment FROM events) GROUP BY 1",
    "flag_span": "SELECT count(*) AS flags, (s//86400)::BIGINT||'d '||((s%86400)//3600)::BIGINT||'h' AS span FROM (SELECT date_diff('second', min(timestamp) OVER (), max(timestamp) OVER ()) AS s FROM flagged) GROUP BY s",
    "kpis": f"SELECT processed, flagged, {r4('rate','flag_rate')}, {r4('(rate-0.065)*100','delta_points')}, CASE WHEN abs((rate-0.065)*100)<=1.5 THEN 'near' WHEN abs((rate-0.065)*100)<=3.5 THEN 'off' ELSE 'far' END AS band FROM (SELECT *, {ratio('flagged','processed')} AS rate FROM (SELECT (SELECT count(*) FROM labelled) AS processed, (SELECT count(*) FROM flagged) AS flagged))",
    "type_counts": f"SELECT type, count(*) AS count, {r4('count(*)/(SELECT count(*) FROM typed_flags)::DOUBLE','share')} FROM typed_flags GROUP BY 1",
    "processed_orders": "SELECT count(*) AS processed, strftime(max(order_date),'%Y-%m-%d %H:%M:%S') AS last_seen FROM labelled",
    "freshness": "SELECT strftime(last,'%Y-%m-%d %H:%M:%S') AS last, 30.0::DOUBLE AS age_seconds, 'Live' AS status FROM (SELECT greatest((SELECT max(timestamp) FROM flagged),(SELECT max(order_date) FROM labelled)) AS last)",
    "shown_metrics": f"SELECT metric, {r4('coalesce(value, fallback)','value')}, value IS NOT NULL AS measured FROM (VALUES {_defaults}) d(metric, fallback) LEFT JOIN ({_union([f'SELECT $${m}$$ AS metric, floor({m}*1000+0.5)/1000 AS value FROM ({MEASURED})' for m in ('precision', 'recall', 'f1')])}) USING (metric)",
    "coverage": "SELECT count(DISTINCT order_region) AS regions, count(DISTINCT category_name) AS categories, count(DISTINCT (order_region, category_name)) AS region_categories, count(DISTINCT (product_id, order_region)) AS product_regions FROM order_items",
    "null_counts": _union([f"SELECT '{c}' AS column, count(*)-count({c}) AS nulls FROM order_items" for c in NULLABLE]),
    "histogram": f"SELECT bin, {r4('low+bin*width','low')}, {r4('low+(bin+1)*width','high')}, count FROM (SELECT b.bin, low, width, count(o.bin) AS count FROM (SELECT unnest(range(25))::INTEGER AS bin) b LEFT JOIN (SELECT least(floor((price-low)/width),24)::INTEGER AS bin FROM order_items, ends) o ON b.bin=o.bin, ends GROUP BY ALL)",
    "top_values": "SELECT category_name AS value, count(*) AS count FROM order_items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
}
STEPS["profile"] = """
SELECT product_id, floor(avg(price)*0.01*1000000+0.5)/1000000 AS a, floor(avg(quantity)*0.1*1000000+0.5)/1000000 AS b,
  floor(avg(discount_rate)*100*1000000+0.5)/1000000 AS c, floor(avg(days_real)*0.1*1000000+0.5)/1000000 AS d, count(*)::DOUBLE AS e
FROM order_items GROUP BY 1
"""
#: Every product against every other; ties at the last place are broken by the coordinates.
STEPS["profile_edges"] = """
SELECT * FROM (SELECT p.product_id AS p, o.product_id AS o,
    sqrt((p.a-o.a)*(p.a-o.a)+(p.b-o.b)*(p.b-o.b)+(p.c-o.c)*(p.c-o.c)+(p.d-o.d)*(p.d-o.d)+(p.e-o.e)*(p.e-o.e)) AS dist, o.a, o.b, o.c, o.d, o.e
  FROM profile p JOIN profile o ON p.product_id<>o.product_id)
QUALIFY row_number() OVER (PARTITION BY p ORDER BY dist, a, b, c, d, e)<=20
"""
STEPS["profile_reach"] = "SELECT p, max(dist) AS kdist FROM profile_edges GROUP BY p"
STEPS["profile_density"] = """
SELECT g.p, 1/(avg(greatest(r.kdist, g.dist))+1e-10) AS lrd FROM profile_edges g JOIN profile_reach r ON g.o=r.p GROUP BY g.p
"""
STEPS["flips"] = f"""
SELECT {ITEM}, a.score>=threshold AS live, b.score>=threshold AS offline, a.score AS live_score, b.score AS offline_score
FROM calibrated, shuffled_scored a JOIN clean_scored b USING ({ITEM})
"""
STEPS["ends"] = "SELECT min(price) AS low, (max(price)-min(price))/25 AS width FROM order_items"


def compose(query: str) -> str:
    """Prefix a query with the steps it needs, in order of definition."""
    needed: set[str] = set()
    queue = [query]
    while queue:
        text = queue.pop()
        for name, body in STEPS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                queue.append(body)
    order = _ordered(needed)
    if not order:
        return query
    kept = lambda n: " MATERIALIZED" if n.startswith(("forest", "full_scored")) else ""
    steps = ",\n".join(f"{n} AS{kept(n)} ({STEPS[n].strip()})" for n in order)
    return f"WITH {steps}\n{query}"


def _ordered(needed: set[str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in needed:
            if other != name and re.search(rf"\b(FROM|JOIN|,)\s+{other}\b", STEPS[name]):
                visit(other)
        done.append(name)

    for name in STEPS:
        if name in needed:
            visit(name)
    return done


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in QUERIES.items()}
