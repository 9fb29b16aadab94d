"""SQL statements that check the registered queries on another engine.

They are written from the definition of each metric, not from its Spark plan:
self-joins and correlated subqueries stand where the operators use windows.
"""

from __future__ import annotations

from ..operators import kmeans1d
from ..operators.cohort import INDEXES
from .catalog import CHART_FRAMES, DATA_FRAMES, DAYS, KEEP_SEGMENTS, MONTHS, YEARS


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _rows(customer: str, segment: str, sale: str, date: str, source: str, where: str = "true", ym: str = "%y_%m") -> str:
    return f"""rows_ AS (
  SELECT {customer} AS customer, {segment} AS customer_segment, CAST({sale} AS DOUBLE) AS sale, {date} AS date,
         CAST(year({date}) AS BIGINT) AS year, CAST(month({date}) AS BIGINT) AS month,
         CAST(day({date}) AS BIGINT) AS day, strftime({date}, '{ym}') AS y_m
  FROM {source} WHERE {where})"""


_ORDERS_SOURCE = "orders JOIN customer ON o_custkey = c_custkey"
_CALENDAR = f"year(o_orderdate) IN {_in(YEARS)} AND month(o_orderdate) IN {_in(MONTHS)} AND day(o_orderdate) IN {_in(DAYS)}"
_SEGMENTS = f"c_mktsegment IN {_in(KEEP_SEGMENTS)}"


def _orders(where: str = "true", ym: str = "%y_%m") -> str:
    return _rows("o_custkey", "c_mktsegment", "o_totalprice", "o_orderdate", _ORDERS_SOURCE, where, ym)


_MAIN = _orders()
_LINEITEM = _rows(
    "o_custkey",
    "c_mktsegment",
    "l_extendedprice",
    "o_orderdate",
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
)
_EVENTS = _rows("user_id", "event_type", "value", "ts", "events")

_ALL_COLUMNS = "customer, customer_segment, round(sale, 6) AS sale, date, year, month, day, y_m"

_TOTALS = """SELECT round(sum(sale), 2) AS total_revenue, count(DISTINCT customer) AS unique_customer,
  round((SELECT avg(s) FROM (SELECT sum(sale) AS s FROM rows_ GROUP BY customer)), 4) AS avg_customer_revenue
FROM rows_"""


def _share(value: str, expression: str, digits: int | None) -> str:
    shown = f"round(v, {digits})" if digits is not None else "v"
    return f"""SELECT customer_segment, {shown} AS {value},
  round(v / nullif((SELECT sum(v) FROM g), 0), 6) AS percent FROM g"""


def _segment_share(rows: str, value: str, expression: str, digits: int | None) -> str:
    return f"""WITH {rows}, g AS (
  SELECT customer_segment, {expression} AS v FROM rows_ WHERE customer_segment IS NOT NULL GROUP BY 1)
{_share(value, expression, digits)}"""


_TYPED = """typed AS (
  SELECT r.*, CASE WHEN strftime(f.first_date, '%y_%m') = y_m THEN 'New' ELSE 'Existing' END AS type,
         strftime(f.first_date, '%y_%m') AS first_purchase
  FROM rows_ r LEFT JOIN (SELECT customer, min(date) AS first_date FROM rows_ GROUP BY 1) f
    ON r.customer = f.customer)"""

_NEW_PERCENT = """CAST(e AS BIGINT) AS "Existing", CAST(n AS BIGINT) AS "New",
  CASE WHEN e = 0 THEN 0 ELSE round(CAST(n AS DOUBLE) / e, 6) END AS "New Percent" """


def _new_percent(rows: str, keys: str) -> str:
    return f"""WITH {rows}, {_TYPED}, g AS (
  SELECT {keys}, count(DISTINCT CASE WHEN type = 'Existing' THEN customer END) AS e,
         count(DISTINCT CASE WHEN type = 'New' THEN customer END) AS n
  FROM typed GROUP BY {keys})
SELECT {keys}, {_NEW_PERCENT} FROM g"""


def _type_percent(rows: str) -> str:
    return f"""WITH {rows}, {_TYPED}, g AS (
  SELECT type, count(DISTINCT customer) AS n FROM typed GROUP BY 1)
SELECT type, round(n / (SELECT sum(n) FROM g), 6) AS type_percent FROM g"""


_ACTIVE = """active AS (
  SELECT customer, y_m, CASE WHEN sum(sale) > 0 THEN 1 ELSE 0 END AS active FROM rows_ GROUP BY 1, 2),
months AS (
  SELECT y_m, (SELECT max(p.y_m) FROM rows_ p WHERE p.y_m < d.y_m) AS before
  FROM (SELECT DISTINCT y_m FROM rows_) d),
monthly AS (
  SELECT m.y_m, CAST(sum(a.active) AS BIGINT) AS total,
         CAST(count(CASE WHEN a.active = 1 AND p.active = 1 THEN 1 END) AS BIGINT) AS retained
  FROM months m JOIN active a ON a.y_m = m.y_m
  LEFT JOIN active p ON p.customer = a.customer AND p.y_m = m.before
  GROUP BY 1)"""

# The months of the orders, of which a view needs one column each.
_MONTHS = [f"{y % 100:02d}_{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
_MONTH_COLUMNS = ", ".join(
    f"""CAST(max(CASE WHEN a.y_m = '{m}' THEN a.active ELSE 0 END) AS BIGINT) AS "{m}\"""" for m in _MONTHS
)


def _retention(rows: str) -> str:
    return f"""WITH {rows}, {_ACTIVE}
SELECT y_m, total AS "Total unique customer", retained AS "Retained customer",
  round(CAST(retained AS DOUBLE) / nullif(total, 0), 6) AS "Retention rate" FROM monthly"""


_COHORT = f"""WITH {_MAIN}, c AS (
  SELECT r.*, f.cohort, r.month - f.cohort + 1 AS idx
  FROM rows_ r JOIN (SELECT customer, min(month) AS cohort FROM rows_ GROUP BY 1) f USING (customer)),
cells AS (
  SELECT cohort, idx, sum(sale) AS revenue, count(DISTINCT customer) AS customers FROM c GROUP BY 1, 2),
shares AS (
  SELECT a.*, a.revenue / nullif(b.revenue, 0) AS revenue_pct,
         CAST(a.customers AS DOUBLE) / nullif(b.customers, 0) AS retention_pct
  FROM cells a JOIN cells b ON a.cohort = b.cohort AND b.idx = 1)"""


def _cohort_table(value: str) -> str:
    cells = ", ".join(f"CAST(max(CASE WHEN idx = {i} THEN {value} END) AS DOUBLE) AS index_{i}" for i in INDEXES)
    return f'{_COHORT}\nSELECT cohort AS "Cohort Month", {cells} FROM shares GROUP BY 1'


_RFM = """span AS (SELECT count(DISTINCT y_m) AS months, max(date) AS latest FROM rows_),
rfm AS (
  SELECT customer, max(date) AS "MaxPurchaseDate",
         CAST(floor(epoch(max(latest) - max(date)) / 86400) AS DOUBLE) / max(months) AS "Recency",
         CAST(count(date) AS DOUBLE) / max(months) AS "Frequency",
         sum(sale) / max(months) AS "Monetary", sum(sale) AS "Total Revenue"
  FROM rows_, span GROUP BY customer)"""

_RFM_COLUMNS = """customer, "MaxPurchaseDate", round("Recency", 6) AS "Recency",
  round("Frequency", 6) AS "Frequency", round("Monetary", 6) AS "Monetary" """


def _kmeans(vals: str, problems: str, most: int) -> str:
    """Common table expressions for one-dimensional k-means.

    ``vals`` has (col, id, v) and ``problems`` (name, col, k).  Ends in
    ``fitted`` (name, id, v, cluster, center) with clusters ranked by center.
    """
    return f"""vals AS ({vals}), problems AS ({problems}),
stats AS (SELECT col, min(v) AS low, max(v) AS high, var_pop(v) AS variance FROM vals GROUP BY 1),
coarse AS (
  SELECT col, low + (high - low) * i / {kmeans1d.STEPS} AS edge FROM stats, range(1, {kmeans1d.STEPS}) q(i)
  UNION SELECT col, low + (high - low) * pow(2.0, -CAST(i AS DOUBLE) / 4) FROM stats, range(1, {kmeans1d.HALVINGS} + 1) q(i)
  UNION SELECT col, high - (high - low) * pow(2.0, -CAST(i AS DOUBLE) / 4) FROM stats, range(1, {kmeans1d.HALVINGS} + 1) q(i)),
counted AS (
  SELECT *, sum(weight) OVER (PARTITION BY col) AS n
  FROM (SELECT v.col, e.edge, count(*) AS weight, min(v.v) AS low, max(v.v) AS high
        FROM vals v ASOF LEFT JOIN coarse e ON v.col = e.col AND v.v >= e.edge GROUP BY 1, 2)),
parts AS (
  SELECT col, low, high, CAST(2 * ((weight * {kmeans1d.SHARES} + n - 1) // n) AS BIGINT) AS parts
  FROM counted WHERE weight * {kmeans1d.SHARES} > n),
edges AS (
  SELECT col, edge FROM coarse
  UNION SELECT col, low + (high - low) * i / parts FROM (SELECT *, unnest(range(1, parts)) AS i FROM parts)),
placed AS (
  SELECT v.col, v.v, e.edge FROM vals v ASOF LEFT JOIN edges e ON v.col = e.col AND v.v >= e.edge),
bins AS (
  SELECT col, row_number() OVER (PARTITION BY col ORDER BY edge NULLS FIRST) AS i, weight, total,
         total / weight - sum(total) OVER (PARTITION BY col) / sum(weight) OVER (PARTITION BY col) AS x
  FROM (SELECT col, edge, CAST(count(*) AS DOUBLE) AS weight, sum(v) AS total FROM placed GROUP BY 1, 2)),
sums AS (
  SELECT col, i, total, weight, sum(weight) OVER w AS cw, sum(weight * x) OVER w AS cs, sum(weight * x * x) OVER w AS cq
  FROM bins WINDOW w AS (PARTITION BY col ORDER BY i)),
pairs AS (
  SELECT b.col, a.i, b.i AS j,
         (b.cq - a.cq + a.weight * a.x2) - pow(b.cs - a.cs + a.weight * a.x1, 2) / (b.cw - a.cw + a.weight) AS cost
  FROM (SELECT s.*, b.x AS x1, b.x * b.x AS x2 FROM sums s JOIN bins b USING (col, i)) a
  JOIN sums b ON a.col = b.col AND a.i <= b.i),
best AS (
  SELECT col, 1 AS m, j, cost, 1 AS cut FROM pairs WHERE i = 1
  UNION ALL
  SELECT p.col, b.m + 1, p.j, min(b.cost + p.cost), arg_min(p.i, b.cost + p.cost)
  FROM best b JOIN pairs p ON p.col = b.col AND p.i = b.j + 1
  WHERE b.m < {most} GROUP BY p.col, b.m, p.j),
cuts AS (
  SELECT p.name, p.col, least(p.k, t.n) AS m, t.n AS j
  FROM problems p JOIN (SELECT col, max(i) AS n FROM bins GROUP BY 1) t USING (col)
  UNION ALL
  SELECT c.name, c.col, c.m - 1, b.cut - 1
  FROM cuts c JOIN best b ON b.col = c.col AND b.m = c.m AND b.j = c.j WHERE c.m > 1),
starts AS (
  SELECT name, col, list(center ORDER BY m) AS centers
  FROM (SELECT c.name, c.col, c.m, sum(b.total) / sum(b.weight) AS center
        FROM cuts c JOIN best d ON d.col = c.col AND d.m = c.m AND d.j = c.j
        JOIN bins b ON b.col = c.col AND b.i BETWEEN d.cut AND c.j GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
lloyd AS (
  SELECT name, col, 0 AS round_, centers, false AS done FROM starts
  UNION ALL
  SELECT g.name, g.col, g.round_ + 1, g.moved,
         list_sum(list_transform(range(1, len(g.moved) + 1), lambda i: pow(g.moved[i] - g.centers[i], 2))) <= {kmeans1d.TOL} * s.variance
  FROM (SELECT name, col, round_, centers,
               list_transform(range(1, len(centers) + 1), lambda i: coalesce(map_from_entries(list((j, mean)))[i], centers[i])) AS moved
        FROM (SELECT name, col, round_, centers, j, avg(v) AS mean
              FROM (SELECT l.name, l.col, l.round_, l.centers, v.v, {_nearest("l.centers", "v.v")} AS j
                    FROM lloyd l JOIN vals v ON v.col = l.col WHERE NOT l.done)
              GROUP BY ALL)
        GROUP BY name, col, round_, centers) g
  JOIN stats s ON s.col = g.col WHERE g.round_ < {kmeans1d.MAX_ITER}),
final AS (SELECT name, col, arg_max(centers, round_) AS centers FROM lloyd GROUP BY 1, 2),
fitted AS (
  SELECT name, id, v, centers[j] AS center, CAST(dense_rank() OVER (PARTITION BY name ORDER BY j) - 1 AS BIGINT) AS cluster
  FROM (SELECT f.name, v.id, v.v, f.centers, {_nearest("f.centers", "v.v")} AS j FROM final f JOIN vals v ON v.col = f.col))"""


def _nearest(centers: str, value: str) -> str:
    away = f"list_transform({centers}, lambda c: abs(c - {value}))"
    return f"list_position({away}, list_min({away}))"


_MEASURES = ("Recency", "Frequency", "Monetary")
_RFM_VALS = " UNION ALL ".join(f"""SELECT '{m}' AS col, customer AS id, "{m}" AS v FROM rfm""" for m in _MEASURES)
_RFM_PROBLEMS = " UNION ALL ".join(f"SELECT '{m}' AS name, '{m}' AS col, 4 AS k" for m in _MEASURES)

# The customers below the highest revenue, clustered by revenue along with the rest.
_KEPT_VALS = """ UNION ALL SELECT 'kept', customer, "Total Revenue" FROM rfm
  WHERE "Total Revenue" < (SELECT max("Total Revenue") FROM rfm)"""
_KEPT_PROBLEM = " UNION ALL SELECT 'kept', 'kept', 3"

_SEGMENTED = f"""WITH RECURSIVE {_MAIN}, {_RFM}, {_kmeans(_RFM_VALS + _KEPT_VALS, _RFM_PROBLEMS + _KEPT_PROBLEM, 4)},
ranks AS (
  SELECT id AS customer,
         max(CASE WHEN name = 'Recency' THEN (SELECT max(cluster) FROM fitted WHERE name = 'Recency') - cluster END) AS r,
         max(CASE WHEN name = 'Frequency' THEN cluster END) AS f,
         max(CASE WHEN name = 'Monetary' THEN cluster END) AS m
  FROM fitted GROUP BY 1),
scored AS (SELECT *, CAST(r + f + m AS BIGINT) AS score FROM ranks),
segment AS (
  SELECT rfm.*, CAST(r AS BIGINT) AS "Recency cluster", CAST(f AS BIGINT) AS "Frequency cluster",
         CAST(m AS BIGINT) AS "Monetary cluster", score AS "RFM Overall Score",
         CASE WHEN score > (SELECT max(score) // 3 FROM scored) * 2 THEN 'High Value'
              WHEN score > (SELECT max(score) // 3 FROM scored) THEN 'Mid Value' ELSE 'Low Value' END AS "RFM Segment"
  FROM rfm JOIN scored USING (customer))"""

_SEGMENT_COLUMNS = f"""{_RFM_COLUMNS}, "Recency cluster", "Frequency cluster", "Monetary cluster",
  "RFM Overall Score", "RFM Segment" """


_NUMBERS = (*_MEASURES, "Recency cluster", "Frequency cluster", "Monetary cluster", "RFM Overall Score")
# Values of the two text features, in order.
_VALUE_SEGMENTS = ("High Value", "Low Value", "Mid Value")
_MARKET_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_FEATURES = [
    *[f'CAST("{c}" - min("{c}") OVER () AS DOUBLE) / (max("{c}") OVER () - min("{c}") OVER ())' for c in _NUMBERS],
    *[f"""CASE WHEN "RFM Segment" = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END""" for v in _VALUE_SEGMENTS],
    *[f"""CASE WHEN customer_segment = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END""" for v in _MARKET_SEGMENTS],
]
_TRAINING = f"""{_SEGMENTED}, training AS (
  SELECT customer, customer_segment, cluster AS label, {", ".join(f"{e} AS feature_{i}" for i, e in enumerate(_FEATURES))}
  FROM segment JOIN (SELECT DISTINCT customer, customer_segment FROM rows_) USING (customer)
  JOIN fitted ON name = 'kept' AND id = customer)"""
_DISTANCE = " + ".join(f"pow(a.feature_{i} - b.feature_{i}, 2)" for i in range(len(_FEATURES)))

# Five folds, dealt out within each label in the order of a digest of the customers.
_FOLDED = f"""{_TRAINING}, folded AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', customer, customer_segment))) - 1) % 5 AS fold FROM training),
held AS (SELECT CAST(f AS BIGINT) AS held FROM range(5) t(f))"""
_LONG = ", ".join(f"feature_{i}" for i in range(len(_FEATURES)))


def _scores(family: str, params: str, predictions: str) -> str:
    """Mean accuracy over the folds of ``predicted`` (held, customer, label, prediction)."""
    return f"""{_FOLDED}, {predictions}
SELECT '{family}' AS model, round(avg(accuracy), 6) AS best_score, '{params}' AS best_params
FROM (SELECT held, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM predicted GROUP BY 1)"""


# Grid points of the families that train by iteration.
_POINTS = {"logistic_regression": 3, "svc": 3, "random_forest": 1, "boosted_trees": 1, "mlp": 1}


def _summary(family: str, points: int) -> str:
    """What is known of a family's search without its model; a useful one beats the commonest label."""
    return f"""{_TRAINING}, counts AS (SELECT label, count(*) AS n FROM training GROUP BY 1)
SELECT '{family}' AS model, CAST(sum(n) AS BIGINT) AS customers, count(*) AS classes, {points}::BIGINT AS points,
       5::BIGINT AS folds, round(max(n) / sum(n)::DOUBLE, 6) AS majority_share, true AS beats_majority
FROM counts"""


_KNN_PREDICTIONS = f"""near AS (
  SELECT a.fold AS held, a.customer, a.label, b.label AS other,
         row_number() OVER (PARTITION BY a.customer ORDER BY {_DISTANCE}, b.label) AS place
  FROM folded a JOIN folded b ON a.fold <> b.fold),
votes AS (
  SELECT k, held, customer, label, other, count(*) AS n
  FROM near, unnest([5, 10, 15]) t(k) WHERE place <= k GROUP BY ALL),
predicted AS (SELECT k, held, customer, label, arg_min(other, (-n, other)) AS prediction FROM votes GROUP BY 1, 2, 3, 4)"""

_BAYES_PREDICTIONS = f"""long AS (
  SELECT customer, label, fold, unnest(range({len(_FEATURES)})) AS i, unnest([{_LONG}]) AS v FROM folded),
smoothing AS (
  SELECT held, 1e-9 * max(s2) AS eps
  FROM (SELECT held, i, var_pop(v) AS s2 FROM long JOIN held ON fold <> held GROUP BY 1, 2) GROUP BY 1),
moments AS (
  SELECT held, label, i, avg(v) AS mu, var_pop(v) + max(eps) AS s2
  FROM long JOIN held ON fold <> held JOIN smoothing USING (held) GROUP BY 1, 2, 3),
priors AS (
  SELECT held, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY held)) AS prior
  FROM folded JOIN held ON fold <> held GROUP BY 1, 2),
likelihoods AS (
  SELECT l.fold AS held, l.customer, l.label, m.label AS other,
         max(p.prior) - sum(ln(2 * pi() * m.s2) / 2 + pow(l.v - m.mu, 2) / (2 * m.s2)) AS score
  FROM long l JOIN moments m ON m.held = l.fold AND m.i = l.i
  JOIN priors p ON p.held = m.held AND p.label = m.label GROUP BY 1, 2, 3, 4),
predicted AS (SELECT held, customer, label, arg_max(other, score) AS prediction FROM likelihoods GROUP BY 1, 2, 3)"""


def _tree_scores(depths: tuple[int, ...] = (5, 10, 15), criteria: tuple[str, ...] = ("gini", "entropy")) -> str:
    """Greedy trees over every threshold, grown level by level for each criterion and fold left out.

    Nodes are numbered like a heap.  Numbers are scaled by a product, as the
    fitted scaler does, since held-out values may lie on a threshold.
    """
    low, high = 'CAST(min("{0}") OVER () AS DOUBLE)', 'CAST(max("{0}") OVER () AS DOUBLE)'
    scaled = [
        *[f'(CAST("{c}" AS DOUBLE) - {low}) * (1.0::DOUBLE / ({high} - {low}))'.replace("{0}", c) for c in _NUMBERS],
        *_FEATURES[len(_NUMBERS) :],
    ]
    names = ", ".join(f"x{i}" for i in range(len(scaled)))
    ctes = [
        f"""cells AS MATERIALIZED (
  SELECT customer, unnest(range({len(scaled)})) AS i, unnest([{names}]) AS v
  FROM (SELECT customer, {", ".join(f"{e} AS x{i}" for i, e in enumerate(scaled))}
        FROM segment JOIN (SELECT DISTINCT customer, customer_segment FROM rows_) USING (customer)
        JOIN fitted ON name = 'kept' AND id = customer))""",
        f"""n0 AS MATERIALIZED (
  SELECT criterion, held, customer, label, fold = held AS test, 1::BIGINT AS node
  FROM (SELECT customer, label, fold FROM folded), held, (SELECT unnest({list(criteria)}) AS criterion))""",
    ]
    gini = lambda c: f"-({c[0]} * {c[0]} + {c[1]} * {c[1]} + {c[2]} * {c[2]}) / ({c[0]} + {c[1]} + {c[2]})"
    log = lambda c: f"CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0.0::DOUBLE END"
    entropy = lambda c: f"({c[0]} + {c[1]} + {c[2]}) * ln({c[0]} + {c[1]} + {c[2]}) - ({log(c[0])} + {log(c[1])} + {log(c[2])})"
    left, right = [f"l{k}" for k in range(3)], [f"r{k}" for k in range(3)]
    for level in range(max(depths)):
        ctes += [
            f"""o{level} AS MATERIALIZED (
  SELECT criterion, held, node FROM n{level} WHERE NOT test GROUP BY ALL HAVING count(DISTINCT label) > 1)""",
            f"""p{level} AS (
  SELECT criterion, held, node, i, v, lead(v) OVER w AS after,
         {", ".join(f"CAST(sum(c{k}) OVER w AS DOUBLE) AS l{k}, CAST(sum(c{k}) OVER (PARTITION BY criterion, held, node, i) AS DOUBLE) AS a{k}" for k in range(3))}
  FROM (SELECT criterion, held, node, i, v, {", ".join(f"count(*) FILTER (label = {k}) AS c{k}" for k in range(3))}
        FROM n{level} JOIN o{level} USING (criterion, held, node) JOIN cells USING (customer) WHERE NOT test GROUP BY ALL)
  WINDOW w AS (PARTITION BY criterion, held, node, i ORDER BY v)),
s{level} AS (
  SELECT criterion, held, node, i, CASE WHEN (v + after) / 2 < after THEN (v + after) / 2 ELSE v END AS threshold,
         round(CASE criterion WHEN 'gini' THEN {gini(left)} + {gini(right)} ELSE {entropy(left)} + {entropy(right)} END, 6) AS score
  FROM (SELECT *, {", ".join(f"a{k} - l{k} AS r{k}" for k in range(3))} FROM p{level} WHERE after IS NOT NULL)),
b{level} AS MATERIALIZED (
  SELECT criterion, held, node, arg_min(i, (score, i, threshold)) AS i, arg_min(threshold, (score, i, threshold)) AS threshold
  FROM s{level} GROUP BY 1, 2, 3)""",
            f"""n{level + 1} AS MATERIALIZED (
  SELECT n.criterion, n.held, n.customer, n.label, n.test,
         CASE WHEN b.i IS NULL THEN n.node ELSE 2 * n.node + CASE WHEN x.v > b.threshold THEN 1 ELSE 0 END END AS node
  FROM n{level} n LEFT JOIN b{level} b USING (criterion, held, node) LEFT JOIN cells x ON x.customer = n.customer AND x.i = b.i)""",
        ]
    cuts = " UNION ALL ".join(
        f"""SELECT criterion, {d} AS depth, held, avg(CASE WHEN label = best THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
  FROM n{d} JOIN (SELECT criterion, held, node, arg_max(label, (n, -label)) AS best
                  FROM (SELECT criterion, held, node, label, count(*) AS n FROM n{d} WHERE NOT test GROUP BY ALL) GROUP BY 1, 2, 3)
    USING (criterion, held, node) WHERE test GROUP BY ALL"""
        for d in depths
    )
    return f"""{_FOLDED}, {", ".join(ctes)}, shares AS ({cuts}),
points AS (SELECT criterion, depth, avg(accuracy) AS score FROM shares GROUP BY 1, 2)
SELECT 'decision_tree' AS model, round(score, 6) AS best_score,
       '{{''criterion'': ''' || criterion || ''', ''max_depth'': ' || depth || '}}' AS best_params
FROM points ORDER BY round(score, 12) DESC, list_position({list(criteria)}, criterion), depth LIMIT 1"""


def _predict() -> str:
    """Gaussian naive Bayes learned from the orders' customers, asked about the customers of the line items.

    One k-means run clusters the measures of both.  Features are scaled by the
    range of the training rows.
    """
    other = _RFM.replace("span AS", "other_span AS").replace("rfm AS", "other_rfm AS").replace("FROM rows_, span", "FROM other_rows, other_span").replace("FROM rows_)", "FROM other_rows)")
    vals = _RFM_VALS + _KEPT_VALS + "".join(f""" UNION ALL SELECT 'other {m}', customer, "{m}" FROM other_rfm""" for m in _MEASURES)
    problems = _RFM_PROBLEMS + _KEPT_PROBLEM + "".join(f" UNION ALL SELECT 'other {m}', 'other {m}', 4" for m in _MEASURES)

    def ranked(name: str, prefix: str, rfm: str) -> str:
        return f"""{name}_ranks AS (
  SELECT id AS customer,
         max(CASE WHEN name = '{prefix}Recency' THEN (SELECT max(cluster) FROM fitted WHERE name = '{prefix}Recency') - cluster END) AS r,
         max(CASE WHEN name = '{prefix}Frequency' THEN cluster END) AS f,
         max(CASE WHEN name = '{prefix}Monetary' THEN cluster END) AS m
  FROM fitted WHERE name IN ('{prefix}Recency', '{prefix}Frequency', '{prefix}Monetary') GROUP BY 1),
{name} AS (
  SELECT x.*, r AS "Recency cluster", f AS "Frequency cluster", m AS "Monetary cluster", r + f + m AS "RFM Overall Score",
         CASE WHEN r + f + m > (SELECT max(r + f + m) // 3 FROM {name}_ranks) * 2 THEN 'High Value'
              WHEN r + f + m > (SELECT max(r + f + m) // 3 FROM {name}_ranks) THEN 'Mid Value' ELSE 'Low Value' END AS "RFM Segment"
  FROM {rfm} x JOIN {name}_ranks USING (customer))"""

    hot = [f"""CASE WHEN "RFM Segment" = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END""" for v in _VALUE_SEGMENTS]
    hot += [f"CASE WHEN customer_segment = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for v in _MARKET_SEGMENTS]
    numbers = ", ".join(f'CAST("{c}" AS DOUBLE)' for c in _NUMBERS)
    return f"""WITH RECURSIVE {_MAIN}, {_LINEITEM.replace("rows_ AS", "other_rows AS", 1)}, {_RFM}, {other}, {_kmeans(vals, problems, 4)},
{ranked("own", "", "rfm")}, {ranked("other", "other ", "other_rfm")},
train AS (
  SELECT customer, cluster AS label, [{numbers}] AS numbers, [{", ".join(hot)}] AS hot
  FROM own JOIN (SELECT DISTINCT customer, customer_segment FROM rows_) USING (customer) JOIN fitted ON name = 'kept' AND id = customer),
asked AS (
  SELECT customer, [{numbers}] AS numbers, [{", ".join(hot)}] AS hot
  FROM other JOIN (SELECT DISTINCT customer, customer_segment FROM other_rows) USING (customer)),
ranges AS (SELECT i, min(numbers[i]) AS low, max(numbers[i]) AS high FROM train, range(1, {len(_NUMBERS) + 1}) q(i) GROUP BY 1),
train_cells AS (
  SELECT customer, label, i, (numbers[i] - low) / (high - low) AS v FROM train, ranges
  UNION ALL SELECT customer, label, i + {len(_NUMBERS)}, hot[i] FROM train, range(1, {len(hot) + 1}) q(i)),
asked_cells AS (
  SELECT customer, i, (numbers[i] - low) / (high - low) AS v FROM asked, ranges
  UNION ALL SELECT customer, i + {len(_NUMBERS)}, hot[i] FROM asked, range(1, {len(hot) + 1}) q(i)),
smoothing AS (SELECT 1e-9 * max(s2) AS eps FROM (SELECT i, var_pop(v) AS s2 FROM train_cells GROUP BY 1)),
moments AS (SELECT label, i, avg(v) AS mu, var_pop(v) + max(eps) AS s2 FROM train_cells, smoothing GROUP BY 1, 2),
priors AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM train GROUP BY 1),
likelihoods AS (
  SELECT customer, label, max(prior) - sum(ln(2 * pi() * s2) / 2 + pow(v - mu, 2) / (2 * s2)) AS score
  FROM asked_cells JOIN moments USING (i) JOIN priors USING (label) GROUP BY 1, 2)
SELECT customer, CAST(arg_max(label, score) AS BIGINT) AS "Life Time Value Predicted" FROM likelihoods GROUP BY 1"""


def _histograms() -> str:
    each = (_histogram(m, 2).partition(f"WITH {_MAIN}, {_RFM}, ")[2] for m in _MEASURES)
    return f"WITH {_MAIN}, {_RFM} " + " UNION ALL ".join(f"SELECT * FROM (WITH {sql})" for sql in each)


def _histogram(measure: str, digits: int) -> str:
    return f"""WITH {_MAIN}, {_RFM}, b AS (SELECT min("{measure}") AS low, max("{measure}") AS high FROM rfm),
w AS (SELECT low, high, least(CAST(floor(30 * ("{measure}" - low) / (high - low)) AS BIGINT) + 1, 30) AS bin FROM rfm, b)
SELECT '{measure}' AS measure, bin, round(low + (bin - 1) * (high - low) / 30, {digits}) AS bin_start,
  round(low + bin * (high - low) / 30, {digits}) AS bin_end, count(*) AS count
FROM w GROUP BY bin, low, high"""


def _trend(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS x, '{y}' AS y, "RFM Segment", round(regr_slope("{y}", "{x}"), 4) AS slope,
  round(regr_intercept("{y}", "{x}"), 4) AS intercept, round(regr_r2("{y}", "{x}"), 6) AS r2, count(*) AS points
FROM segment GROUP BY 3"""


_REVENUE = f"""{_MAIN}, revenue AS (SELECT customer, sum(sale) AS "Total Revenue" FROM rows_ GROUP BY 1)"""
_REVENUE_VALS = """SELECT 'r' AS col, customer AS id, "Total Revenue" AS v FROM """

_LTV = f"""WITH RECURSIVE {_REVENUE},
kept AS (SELECT * FROM revenue WHERE "Total Revenue" < (SELECT max("Total Revenue") FROM revenue)),
{_kmeans(_REVENUE_VALS + "kept", "SELECT 'ltv' AS name, 'r' AS col, 3 AS k", 3)}"""

_HINT_PROBLEMS = "SELECT CAST(i AS VARCHAR) AS name, 'r' AS col, i AS k FROM range(1, 10) q(i)"

_RESULTS = [
    ("Basic Info data", "total_revenue", "SELECT 1"),
    ("Basic Info data", "unique_customer", "SELECT 1"),
    ("Basic Info data", "customer_revenue", "SELECT DISTINCT customer FROM rows_"),
    ("Basic Info data", "avg_customer_revenue", "SELECT 1"),
    ("Basic Info data", "segment_revenue", "SELECT DISTINCT customer_segment FROM rows_"),
    ("Basic Info data", "segment_unique_customer", "SELECT DISTINCT customer_segment FROM rows_"),
    ("Growth data", "monthly_revenue", "SELECT DISTINCT y_m FROM rows_"),
    ("Growth data", "monthly_customer", "SELECT DISTINCT y_m FROM rows_"),
    ("Growth data", "segment_monthly_revenue", "SELECT DISTINCT y_m, customer_segment FROM rows_"),
    ("Growth data", "segment_monthly_customer", "SELECT DISTINCT y_m, customer_segment FROM rows_"),
    ("New Existing Customer data", "count", "SELECT DISTINCT y_m, type FROM typed"),
    ("New Existing Customer data", "month_new_percent", "SELECT DISTINCT y_m FROM rows_"),
    ("New Existing Customer data", "type_percent", "SELECT DISTINCT type FROM typed"),
    ("New Existing Customer data", "segment_count", "SELECT DISTINCT y_m, type, customer_segment FROM typed"),
    ("New Existing Customer data", "segment_monthly_new_percent", "SELECT DISTINCT y_m, customer_segment FROM rows_"),
    ("Retention data", "by_customer", "SELECT DISTINCT customer FROM rows_"),
    ("Retention data", "by_month", "SELECT DISTINCT y_m FROM rows_"),
    *[
        ("Cohort data", name, "SELECT DISTINCT m FROM (SELECT min(month) AS m FROM rows_ GROUP BY customer)")
        for name in ("by_revenue", "by_revenue_pct", "by_retention", "by_retention_pct")
    ],
    ("Segmentation data", "rfm", "SELECT DISTINCT customer FROM rows_"),
    ("Segmentation data", "segment", "SELECT DISTINCT customer FROM rows_"),
]

_TEXT_ROWS = _rows("o_custkey", "'no segment'", "o_totalprice", "o_orderdate", "orders")

ORACLE: dict[str, str] = {
    "bind_rows": f"WITH {_MAIN} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_segment_filter": f"WITH {_orders(_SEGMENTS)} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_inline_segment_filter": f"""WITH {_EVENTS}
SELECT {_ALL_COLUMNS} FROM rows_ WHERE customer_segment IN ('purchase', 'click')""",
    "bind_no_segment": f"WITH {_TEXT_ROWS} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_without_date": """SELECT o_custkey AS customer, o_orderpriority AS customer_segment,
  round(o_totalprice, 6) AS sale FROM orders""",
    "bind_calendar_filter": f"WITH {_orders(_CALENDAR)} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_all_filters": f"WITH {_orders(_CALENDAR + ' AND ' + _SEGMENTS)} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_text_dates": f"WITH {_TEXT_ROWS} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_text_short_years": f"WITH {_TEXT_ROWS} SELECT {_ALL_COLUMNS} FROM rows_",
    "bind_integer_sale": f"""WITH {_rows("l_orderkey", "l_returnflag", "l_linenumber", "l_shipdate", "lineitem")}
SELECT {_ALL_COLUMNS} FROM rows_""",
    "bind_calendar_years": f"WITH {_MAIN} SELECT DISTINCT year FROM rows_",
    "bind_calendar_months": f"WITH {_MAIN} SELECT DISTINCT month FROM rows_",
    "bind_calendar_days": f"WITH {_MAIN} SELECT DISTINCT day FROM rows_",
    "bind_row_count": f"WITH {_MAIN} SELECT count(*) AS row_count FROM rows_",
    "bind_activity": f"""WITH {_MAIN}
SELECT customer, customer_segment, (year % 100) * 100 + month AS ym, round(sum(sale), 2) AS sale,
  min(date) AS first_date, max(date) AS last_date, count(date) AS n_dates
FROM rows_ GROUP BY 1, 2, 3""",
    "basic_total_revenue": f"WITH {_MAIN} SELECT round(sum(sale), 2) AS total_revenue FROM rows_",
    "basic_unique_customer": f"WITH {_MAIN} SELECT count(DISTINCT customer) AS unique_customer FROM rows_",
    "basic_customer_revenue": f"WITH {_MAIN} SELECT customer, round(sum(sale), 2) AS sale FROM rows_ GROUP BY 1",
    "basic_avg_customer_revenue": f"""WITH {_MAIN}
SELECT round(avg(s), 4) AS avg_customer_revenue FROM (SELECT sum(sale) AS s FROM rows_ GROUP BY customer)""",
    "basic_segment_revenue": _segment_share(_MAIN, "sale", "sum(sale)", 2),
    "basic_segment_unique_customer": _segment_share(_MAIN, "customer", "count(DISTINCT customer)", None),
    "basic_totals_without_date": f"""WITH rows_ AS (
  SELECT o_custkey AS customer, o_totalprice AS sale FROM orders) {_TOTALS}""",
    "basic_segment_unique_customer_events": _segment_share(_EVENTS, "customer", "count(DISTINCT customer)", None),
    "basic_totals_filtered": f"WITH {_orders(_CALENDAR + ' AND ' + _SEGMENTS)} {_TOTALS}",
    "growth_monthly_revenue": f"WITH {_MAIN} SELECT y_m, round(sum(sale), 2) AS sale FROM rows_ GROUP BY 1",
    "growth_monthly_customer": f"WITH {_MAIN} SELECT y_m, count(DISTINCT customer) AS customer FROM rows_ GROUP BY 1",
    "growth_segment_monthly_revenue": f"""WITH {_MAIN}
SELECT y_m, customer_segment, round(sum(sale), 2) AS sale FROM rows_ GROUP BY 1, 2""",
    "growth_segment_monthly_customer": f"""WITH {_MAIN}
SELECT y_m, customer_segment, count(DISTINCT customer) AS customer FROM rows_ GROUP BY 1, 2""",
    "growth_monthly_revenue_lineitem": f"WITH {_LINEITEM} SELECT y_m, round(sum(sale), 2) AS sale FROM rows_ GROUP BY 1",
    "new_existing_rows": f"WITH {_MAIN}, {_TYPED} SELECT {_ALL_COLUMNS}, type, first_purchase FROM typed",
    "new_existing_count": f"""WITH {_MAIN}, {_TYPED}
SELECT y_m, type, count(DISTINCT customer) AS "count type" FROM typed GROUP BY 1, 2""",
    "new_existing_month_new_percent": _new_percent(_MAIN, "y_m"),
    "new_existing_type_percent": _type_percent(_MAIN),
    "new_existing_segment_count": f"""WITH {_MAIN}, {_TYPED}
SELECT y_m, type, customer_segment, count(DISTINCT customer) AS customer FROM typed GROUP BY 1, 2, 3""",
    "new_existing_segment_monthly_new_percent": _new_percent(_MAIN, "y_m, customer_segment"),
    "new_existing_month_new_percent_events": _new_percent(_EVENTS, "y_m"),
    "new_existing_type_percent_filtered": _type_percent(_orders(f"{_SEGMENTS} AND year(o_orderdate) IN {_in(YEARS)}")),
    "retention_activity": f"WITH {_MAIN}, {_ACTIVE} SELECT y_m, customer, CAST(active AS BIGINT) AS active FROM active",
    "retention_by_customer": f"""WITH {_MAIN}, {_ACTIVE}
SELECT c.customer, {_MONTH_COLUMNS}
FROM (SELECT DISTINCT customer FROM rows_) c LEFT JOIN active a ON a.customer = c.customer GROUP BY c.customer""",
    "retention_by_month": _retention(_MAIN),
    "retention_by_month_long": f"""WITH {_MAIN}, {_ACTIVE}
SELECT y_m, 'Total unique customer' AS type, total AS count FROM monthly
UNION ALL SELECT y_m, 'Retained customer', retained FROM monthly""",
    "retention_by_month_chronological": _retention(_orders(ym="%Y_%m")),
    "retention_by_month_filtered": _retention(
        _orders(f"{_SEGMENTS} AND year(o_orderdate) IN {_in(YEARS)} AND month(o_orderdate) IN {_in(MONTHS)}")
    ),
    "cohort_cells": f"""{_COHORT}
SELECT cohort AS "Cohort Month", idx AS "Cohort Index", round(revenue, 2) AS revenue, customers,
  round(revenue_pct, 6) AS revenue_pct, round(retention_pct, 6) AS retention_pct FROM shares""",
    "cohort_by_revenue": _cohort_table("round(revenue, 2)"),
    "cohort_by_revenue_pct": _cohort_table("round(revenue_pct, 6)"),
    "cohort_by_retention": _cohort_table("customers"),
    "cohort_by_retention_pct": _cohort_table("round(retention_pct, 6)"),
    "rfm_measures": f"WITH {_MAIN}, {_RFM} SELECT {_RFM_COLUMNS} FROM rfm",
    "rfm_measures_lineitem": f"WITH {_LINEITEM}, {_RFM} SELECT {_RFM_COLUMNS} FROM rfm",
    "rfm_measures_events": f"WITH {_EVENTS}, {_RFM} SELECT {_RFM_COLUMNS} FROM rfm",
    "rfm_clusters": f"""{_SEGMENTED}
SELECT customer, "Recency cluster", "Frequency cluster", "Monetary cluster" FROM segment""",
    "rfm_segment": f"{_SEGMENTED} SELECT {_SEGMENT_COLUMNS} FROM segment",
    "rfm_segment_sizes": f"""{_SEGMENTED}
SELECT "RFM Overall Score", "RFM Segment", count(*) AS customers FROM segment GROUP BY 1, 2""",
    "rfm_rank_clusters": """WITH means AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT o_orderkey, (SELECT count(*) FROM means b WHERE b.mean > means.mean) AS cluster
FROM orders JOIN means ON p = o_orderpriority""",
    "rfm_histogram_recency": _histogram("Recency", 6),
    "rfm_histogram_frequency": _histogram("Frequency", 6),
    "rfm_histogram_monetary": _histogram("Monetary", 2),
    "rfm_histograms": _histograms(),
    "rfm_trends": f"""{_SEGMENTED} {_trend("Recency", "Frequency")} UNION ALL {_trend("Recency", "Monetary")}
UNION ALL {_trend("Frequency", "Monetary")}""",
    "ltv_feature_frame": f"""{_SEGMENTED}
SELECT {_SEGMENT_COLUMNS}, round("Total Revenue", 2) AS "Total Revenue", customer_segment
FROM segment JOIN (SELECT DISTINCT customer, customer_segment FROM rows_) USING (customer)""",
    "ltv_feature_rows_events": f"""WITH {_EVENTS}, r AS (
  SELECT customer, round(sum(sale), 2) AS "Total Revenue" FROM rows_ GROUP BY 1)
SELECT customer, customer_segment, "Total Revenue"
FROM r JOIN (SELECT DISTINCT customer, customer_segment FROM rows_) USING (customer)""",
    "ltv_cluster_hint": f"""WITH RECURSIVE {_REVENUE}, {_kmeans(_REVENUE_VALS + "revenue", _HINT_PROBLEMS, 9)}
SELECT CAST(name AS BIGINT) AS k, round(sum(pow(v - center, 2)) / 1e9, 3) AS sse FROM fitted GROUP BY name""",
    "ltv_trim_highest": f"""WITH {_REVENUE}
SELECT customer, round("Total Revenue", 2) AS "Total Revenue" FROM revenue
WHERE "Total Revenue" < (SELECT max("Total Revenue") FROM revenue)""",
    "ltv_trim_quantile": f"""WITH {_REVENUE}
SELECT customer, round("Total Revenue", 2) AS "Total Revenue" FROM revenue
WHERE "Total Revenue" < (SELECT quantile_cont("Total Revenue", 0.95) FROM revenue)""",
    "ltv_clusters": f"""{_LTV}
SELECT id AS customer, round(v, 2) AS "Total Revenue", cluster AS "LTV Cluster" FROM fitted""",
    "ltv_cluster_info": f"""{_LTV}
SELECT cluster AS "LTV Cluster", round(avg(v), 4) AS "Life Time Value (Revenue)", count(*) AS "Customer Count"
FROM fitted GROUP BY 1""",
    "ltv_features": f"""{_TRAINING}
SELECT customer, label, {", ".join(f"round(feature_{i}, 6) AS feature_{i}" for i in range(len(_FEATURES)))}
FROM training""",
    "ltv_fold_sizes": f"""{_TRAINING}, sizes AS (SELECT label, count(*) AS n FROM training GROUP BY 1)
SELECT label, fold, CAST(n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS customers
FROM sizes, range(5) f(fold)""",
    "ltv_nearest_neighbors": f"""{_TRAINING}, near AS (
  SELECT a.customer, b.label, row_number() OVER (PARTITION BY a.customer ORDER BY {_DISTANCE}, b.label) AS place
  FROM training a, training b),
votes AS (SELECT customer, label, count(*) AS n FROM near WHERE place <= 5 GROUP BY 1, 2)
SELECT customer, CAST(arg_min(label, (-n, label)) AS BIGINT) AS prediction FROM votes GROUP BY 1""",
    "ltv_scores_knn": f"""{_FOLDED}, {_KNN_PREDICTIONS},
accuracies AS (
  SELECT k, held, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM predicted GROUP BY 1, 2),
points AS (SELECT k, avg(accuracy) AS score FROM accuracies GROUP BY 1)
SELECT 'knn' AS model, round(score, 6) AS best_score, '{{''n_neighbors'': ' || k || '}}' AS best_params
FROM points ORDER BY round(score, 12) DESC, k LIMIT 1""",
    **{f"ltv_scores_{family}": _summary(family, points) for family, points in _POINTS.items()},
    "ltv_scores_decision_tree": _tree_scores(),
    "ltv_scores_naive_bayes": _scores("naive_bayes", "{}", _BAYES_PREDICTIONS),
    "ltv_predict": _predict(),
    "suite_result_sizes": f"WITH {_MAIN}, {_TYPED}\n"
    + "\nUNION ALL ".join(
        f"SELECT '{report}' AS report, '{name}' AS result, count(*) AS row_count FROM ({sql})"
        for report, name, sql in _RESULTS
    ),
}


def _summed(frames: list) -> str:
    """Rows and the sum of all values of the frames, from the statements of the queries that give them."""
    rows = []
    for report, name, query, columns in frames:
        query, *parts = query.split("/")
        where = " AND ".join("{} = '{}'".format(*part.split("=")) for part in parts) or "true"
        whole = " + ".join(f'coalesce(CAST("{c}" AS DOUBLE), 0)' for c in columns or _MONTHS)
        rows.append(f"""SELECT '{report}' AS report, '{name}' AS result, count(*) AS row_count, round(sum({whole}), 2) AS total
FROM ({ORACLE[query]}) WHERE {where}""")
    return "\nUNION ALL ".join(rows)


ORACLE["suite_checksums"] = _summed(DATA_FRAMES)
ORACLE["suite_charts"] = _summed(CHART_FRAMES)
