"""SQL that the registered queries are held against, written apart from their plans."""

from __future__ import annotations

#: The loan book (see sources.loanbook) as common table expressions.
BOOK = """
WITH lines AS (
  SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_extendedprice AS k5,
    (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000 AS u, year(l_shipdate) AS year,
    l_extendedprice, l_quantity, l_discount, l_tax, c_acctbal, o_orderpriority, c_mktsegment, o_orderstatus, l_linestatus,
    CASE WHEN (l_orderkey + l_partkey) % 11 <> 0 THEN l_quantity END AS emp_like,
    CASE WHEN (l_orderkey + l_suppkey) % 10 <> 0 THEN l_discount END AS rate_like
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
loans AS (
  SELECT *, CASE WHEN u < 60 + 6 * l_quantity + 1500 * l_discount + CASE o_orderpriority WHEN '1-URGENT' THEN 120 WHEN '5-LOW' THEN -40 ELSE 0 END THEN 1 ELSE 0 END AS def
  FROM lines),
book AS (
  SELECT * EXCLUDE (rn), rn % 4 AS fold, CASE WHEN year = 2001 THEN 'OOT' WHEN rn % 5 = 0 THEN 'Test' ELSE 'Train' END AS dataset
  FROM (SELECT *, row_number() OVER (PARTITION BY def, year ORDER BY u, k1, k2, k3, k4, k5) AS rn FROM loans))
"""
#: The fixed score of the metric queries, and the binned loan book with the fixed scorecard of the class queries.
SCORED = BOOK + ", scored AS (SELECT *, (6 * l_quantity + 1500 * l_discount) / 500 AS s FROM book)\n"


def chi2_sf(x: str, df: str) -> str:
    """The chi-squared tail as an expression: a series of explicit terms below the mean, else the continued fraction."""
    y, a = f"(({x}) / 2.0)", f"(({df}) / 2.0)"
    series = f"list_sum(list_transform(range(0, 601), lambda k: exp(k * ln({y}) - lgamma({a} + k + 1))))"
    fraction = f"list_reduce(list_concat([{y} + 601.0 - {a}], list_transform(range(0, 300), lambda j: CAST(300 - j AS DOUBLE))), lambda f, k: {y} + 2 * (k - 1) + 1 - {a} - k * (k - {a}) / f)"
    return f"CASE WHEN {y} <= 0 THEN 1.0 WHEN {y} < {a} + 1 THEN 1 - exp(-{y} + {a} * ln({y})) * {series} ELSE exp(-{y} + {a} * ln({y}) - lgamma({a})) / ({fraction}) END"


def log10p(x: str, df: str) -> str:
    """Of a tail probability, which keeps small ones apart."""
    return f"round(log10(greatest({chi2_sf(x, df)}, 1e-280)), 4)"


def stacked(rows: str, columns: list[str], keep: str, kind: str) -> str:
    """A UNION ALL of (keep, variable, value) per column."""
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS variable, CAST({c} AS {kind}) AS value FROM {rows}" for c in columns)


def psi(pairs: list[tuple[str, str]], continuous: list[str], qualitative: list[str], sample: str, bins: int) -> str:
    """(ref, curr, variable, psi) of each pair of samples, after the loan book."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    cuts = ", ".join(str(k / bins) for k in range(bins + 1))
    return f"""
, pairs(ref, curr) AS (VALUES {values}),
num AS ({stacked('book', continuous, f"CAST({sample} AS VARCHAR) AS smp, ", 'DOUBLE')}),
edges AS (
  SELECT ref, curr, variable, list_sort(list_distinct(quantile_cont(value, [{cuts}]))) AS e
  FROM pairs JOIN num ON num.smp = ref GROUP BY ref, curr, variable),
placed AS (
  SELECT edges.ref, edges.curr, edges.variable, num.smp = edges.ref AS is_ref, CAST(len(list_filter(e, lambda x: x < value)) AS VARCHAR) AS bin
  FROM edges JOIN num ON edges.variable = num.variable AND num.smp IN (edges.ref, edges.curr)
  WHERE value > e[1] AND value <= e[len(e)]),
cat AS ({stacked('book', qualitative, f"CAST({sample} AS VARCHAR) AS smp, ", 'VARCHAR')}),
every AS (
  SELECT * FROM placed UNION ALL
  SELECT ref, curr, variable, cat.smp = ref AS is_ref, value AS bin FROM pairs JOIN cat ON cat.smp IN (ref, curr) WHERE value IS NOT NULL),
counts AS (SELECT ref, curr, variable, bin, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM every GROUP BY ALL),
shares AS (SELECT ref, curr, variable, r / sum(r) OVER w AS r, c / sum(c) OVER w AS c FROM counts WINDOW w AS (PARTITION BY ref, curr, variable)),
psis AS (SELECT ref, curr, variable, sum((c - r) * ln(c / r)) AS psi FROM shares GROUP BY ALL)
"""


#: Average ranks and the Kruskal-Wallis statistic of (key, value, level) rows in the table `obs`.
KRUSKAL = """
, vals AS (SELECT key, value, count(*) AS t FROM obs GROUP BY ALL),
ranks AS (SELECT *, sum(t) OVER (PARTITION BY key ORDER BY value) - (t - 1) / 2.0 AS rank FROM vals),
whole AS (SELECT key, CAST(sum(t) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM vals GROUP BY key),
levels AS (SELECT obs.key AS key, level, sum(rank) AS r, CAST(count(*) AS DOUBLE) AS c FROM obs JOIN ranks ON obs.key = ranks.key AND obs.value = ranks.value GROUP BY obs.key, level),
kw AS (
  SELECT key, (12 / (n * (n + 1)) * sum(r * r / c) - 3 * (n + 1)) / (1 - any_value(ties) / (n * n * n - n)) AS h, count(*) - 1 AS df
  FROM levels JOIN whole USING (key) GROUP BY key, n)
"""
#: The chi-squared statistic and both forms of Cramér's V of (key, value, level) rows in the table `obs`.
CHI2 = """
, cells AS (SELECT key, value, level, count(*) AS o FROM obs GROUP BY ALL),
ma AS (SELECT key, value, sum(o) AS a FROM cells GROUP BY ALL),
mb AS (SELECT key, level, sum(o) AS b FROM cells GROUP BY ALL),
tot AS (SELECT key, CAST(sum(o) AS DOUBLE) AS n, count(DISTINCT value) AS r, count(DISTINCT level) AS k FROM cells GROUP BY key),
grid AS (
  SELECT ma.key AS key, n, r, k, a * b / n AS e, abs(coalesce(o, 0) - a * b / n) AS off
  FROM ma JOIN mb ON ma.key = mb.key JOIN tot ON ma.key = tot.key LEFT JOIN cells ON cells.key = ma.key AND cells.value = ma.value AND cells.level = mb.level),
chi AS (
  SELECT key, n, r, k, sum(power(CASE WHEN r = 2 AND k = 2 THEN off - least(0.5, off) ELSE off END, 2) / e) AS chi2, (r - 1) * (k - 1) AS dof FROM grid GROUP BY ALL),
vs AS (
  SELECT *, sqrt(chi2 / n / (least(r, k) - 1)) AS v,
    sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)) AS vc
  FROM chi)
"""
#: Curve of the scores `s` of the rows in `scored`, per key `by_`.
CURVE = """
, sc AS (SELECT dataset, s, count(*) AS n, sum(def) AS e FROM scored GROUP BY ALL),
cur AS (
  SELECT *, sum(e) OVER w AS tp, sum(n - e) OVER w AS fp, sum(e) OVER (PARTITION BY dataset) AS pos, sum(n - e) OVER (PARTITION BY dataset) AS neg
  FROM sc WINDOW w AS (PARTITION BY dataset ORDER BY s DESC))
"""
