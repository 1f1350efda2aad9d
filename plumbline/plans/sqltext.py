"""Shared fragments of the checking SQL."""

CELLS = """cells AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, n_name AS unit, r_name AS region, o_orderpriority AS priority,
         o_orderstatus AS status, c_mktsegment AS segment, o_totalprice AS price, CAST(o_custkey AS VARCHAR) AS customer,
         'B' || CASE WHEN o_orderkey % 10 < 5 THEN substr(r_name, 1, 2) ELSE substr(o_orderpriority, 1, 1) END AS batch
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
COUNTS = """counts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, p_brand AS gene, SUM(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
ARMS = """arms AS (
  SELECT MAX(CASE WHEN rn = 1 THEN region END) AS ref, MAX(CASE WHEN rn = 2 THEN region END) AS alt
  FROM (SELECT region, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, region) AS rn FROM cells GROUP BY region)
  WHERE rn <= 2)"""
KEPT = """kept AS (
  SELECT c.*, CASE WHEN region = ref THEN 'ref' ELSE 'alt' END AS arm
  FROM cells c, arms WHERE region = ref OR region = alt)"""
LIBRARY = "library AS (SELECT cell_id, SUM(value) AS library FROM counts GROUP BY 1)"


def base(*extra: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CELLS, COUNTS, ARMS, KEPT, *extra]) + "\n"


def t_p(t: str, df: str) -> str:
    """Two-sided Student-t tail by Simpson's rule on the angle atan(t / sqrt(df))."""
    start = f"atan(abs({t})/sqrt({df}))"
    width = f"least(pi()/2 - {start}, 40/sqrt({df}))"
    weight = "(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    total = (
        f"list_sum(list_transform(range(0, 4001), lambda i: {weight} * "
        f"pow(greatest(cos({start} + i * ({width}) / 4000), 0.0), ({df}) - 1)))"
    )
    const = f"2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi())"
    return f"least(1.0, {const} * {total} * ({width}) / 4000 / 3)"


def welch_p(prefix: str = "") -> str:
    """p from columns t, df, n_ref, n_alt."""
    return f"CASE WHEN n_ref < 2 OR n_alt < 2 THEN 1.0 WHEN t = 0 THEN 1.0 ELSE {t_p(prefix + 't', prefix + 'df')} END"


WELCH_T = """CASE WHEN v0/n_ref + v1/n_alt > 0 THEN (m1 - m0) / sqrt(v0/n_ref + v1/n_alt) ELSE 0 END AS t,
  CASE WHEN pow(v0/n_ref, 2)/(n_ref-1) + pow(v1/n_alt, 2)/(n_alt-1) > 0
       THEN pow(v0/n_ref + v1/n_alt, 2) / (pow(v0/n_ref, 2)/(n_ref-1) + pow(v1/n_alt, 2)/(n_alt-1))
       ELSE n_ref + n_alt - 2 END AS df"""

# Welch per feature on log1p counts over cells, zeros included.
GENE_WELCH = f"""sizes AS (SELECT SUM(CASE WHEN arm='ref' THEN 1 ELSE 0 END) AS n_ref, SUM(CASE WHEN arm='alt' THEN 1 ELSE 0 END) AS n_alt FROM kept),
gene_sums AS (
  SELECT gene, SUM(CASE WHEN arm='ref' THEN x ELSE 0 END) AS a1, SUM(CASE WHEN arm='ref' THEN x*x ELSE 0 END) AS a2,
         SUM(CASE WHEN arm='alt' THEN x ELSE 0 END) AS b1, SUM(CASE WHEN arm='alt' THEN x*x ELSE 0 END) AS b2
  FROM (SELECT gene, arm, ln(1 + value) AS x FROM counts JOIN kept USING (cell_id)) GROUP BY gene),
gene_stats AS (
  SELECT gene, n_ref, n_alt, a1/n_ref AS m0, b1/n_alt AS m1,
         greatest((a2 - a1*a1/n_ref)/(n_ref-1), 0) AS v0, greatest((b2 - b1*b1/n_alt)/(n_alt-1), 0) AS v1
  FROM gene_sums, sizes),
gene_t AS (SELECT *, {WELCH_T} FROM gene_stats),
gene_tests AS (SELECT *, {welch_p()} AS p FROM gene_t)"""

PICKED = "picked AS (SELECT gene FROM gene_t ORDER BY round(abs(t), 10) DESC, gene LIMIT 1)"
FOCUS = """focus AS (
  SELECT k.*, p.gene, coalesce(c.value, 0) AS value FROM kept k CROSS JOIN picked p
  LEFT JOIN counts c ON c.cell_id = k.cell_id AND c.gene = p.gene)"""

# Welch per feature on (unit, arm) means of log1p CPM.
UNIT_WELCH = f"""library AS (SELECT cell_id, SUM(value) AS library FROM counts GROUP BY 1),
unit_n AS (SELECT unit, arm, COUNT(*) AS n_cells FROM kept GROUP BY 1, 2),
unit_values AS (
  SELECT unit, arm, gene, SUM(x) / ANY_VALUE(n_cells) AS value FROM (
    SELECT k.unit, k.arm, c.gene, ln(1 + c.value / l.library * 1e6) AS x
    FROM counts c JOIN kept k USING (cell_id) JOIN library l USING (cell_id)) s JOIN unit_n USING (unit, arm)
  GROUP BY 1, 2, 3),
usizes AS (SELECT SUM(CASE WHEN arm='ref' THEN 1 ELSE 0 END) AS n_ref, SUM(CASE WHEN arm='alt' THEN 1 ELSE 0 END) AS n_alt FROM unit_n),
usums AS (
  SELECT gene, SUM(CASE WHEN arm='ref' THEN value ELSE 0 END) AS a1, SUM(CASE WHEN arm='ref' THEN value*value ELSE 0 END) AS a2,
         SUM(CASE WHEN arm='alt' THEN value ELSE 0 END) AS b1, SUM(CASE WHEN arm='alt' THEN value*value ELSE 0 END) AS b2
  FROM unit_values GROUP BY gene),
ustats AS (
  SELECT gene, n_ref, n_alt, a1/n_ref AS m0, b1/n_alt AS m1,
         greatest((a2 - a1*a1/n_ref)/(n_ref-1), 0) AS v0, greatest((b2 - b1*b1/n_alt)/(n_alt-1), 0) AS v1
  FROM usums, usizes),
ut AS (SELECT *, {WELCH_T} FROM ustats),
utests AS (SELECT *, {welch_p()} AS p FROM ut)"""


def fdr_sql(source: str, method: str = "bh", out: str = "q_tests") -> str:
    c = "1.0" if method == "bh" else "(SELECT SUM(1.0/i) FROM range(1, (SELECT COUNT(*)+1 FROM " + source + ")) r(i))"
    return f"""{out}_ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p, gene) AS rn, COUNT(*) OVER () AS m FROM {source}),
{out} AS (SELECT *, least(1.0, MIN(p * m * {c} / rn) OVER (ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
  FROM {out}_ranked)"""
