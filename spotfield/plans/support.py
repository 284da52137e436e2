"""What registered queries share: rounding on the way out and the SQL pieces that their oracles are built of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import C_GENES, H_GENES, S_GENES, V_GENES


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0, so that results agree across engines and runs."""
    return df.select(*((F.round(c, decimals) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(x: str, name: str = "") -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE)" + (f" AS {name}" if name else "")


def exact(x: str) -> str:
    """A column that is rounded already, as it is."""
    return f"CAST({x} AS DOUBLE) + CAST(0 AS DOUBLE) AS {x}"


def genes_sql(*programs: tuple[str, tuple[str, ...]]) -> str:
    return "VALUES " + ", ".join(f"('{p}', '{g}', {i + 1})" for p, genes in programs for i, g in enumerate(genes))


SPOTS = """spots AS (SELECT 'cust' AS sample, CAST(c_custkey AS BIGINT) AS spot, CAST(c_custkey // 40 AS INT) AS array_row,
  CAST(2 * (c_custkey % 40) + (c_custkey // 40) % 2 AS INT) AS array_col, c_mktsegment AS label, CAST(c_nationkey AS INT) AS stratum, c_acctbal > 0 AS mask, c_acctbal AS score FROM customer)"""
CNT = """cnt AS (SELECT CAST(o_custkey AS BIGINT) AS spot, p_brand AS gene, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"""
PROG = f"prog(program, gene, requested_order) AS ({genes_sql(('C', C_GENES), ('S', S_GENES))})"
HV = f"hv(program, gene, requested_order) AS ({genes_sql(('H', H_GENES), ('V', V_GENES))})"
DENSE = "dense AS (SELECT s.spot, p.program, p.gene, ln(1 + coalesce(x.v, 0)) AS e FROM spots s CROSS JOIN prog p LEFT JOIN cnt x ON x.spot = s.spot AND x.gene = p.gene)"
Z = "z AS (SELECT d.spot, d.program, d.gene, d.e, (e - m) / sd AS z FROM dense d JOIN (SELECT gene, avg(e) AS m, coalesce(nullif(stddev_pop(e), 0), 1) AS sd FROM dense GROUP BY 1) USING (gene))"
CS = "cs AS (SELECT spot, round(c, 9) AS c, round(s, 9) AS s, round(c - s, 9) AS r FROM (SELECT spot, avg(z) FILTER (program = 'C') AS c, avg(z) FILTER (program = 'S') AS s FROM z GROUP BY 1))"
PAIR = "pair AS (SELECT a.spot AS i, b.spot AS j, (a.array_col - b.array_col) * (a.array_col - b.array_col) + 3 * (a.array_row - b.array_row) * (a.array_row - b.array_row) AS d2 FROM spots a JOIN spots b ON a.spot <> b.spot)"
NN = "nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS k FROM pair)"
KNN6 = "e AS (SELECT least(i, j) AS i, greatest(i, j) AS j, sqrt(min(d2)) AS dist FROM nn WHERE k <= 6 GROUP BY 1, 2)"
HEXE = "e AS (SELECT i, j, sqrt(d2) AS dist FROM pair WHERE i < j AND d2 <= 4)"
SYM = "sym AS (SELECT i, j, dist FROM e UNION ALL SELECT j, i, dist FROM e)"
G = "f AS (SELECT cs.*, coalesce(g.g, 0) AS g FROM cs LEFT JOIN (SELECT a.spot, CAST((2 * sum(abs(CAST(round(a.r * 1e9) AS BIGINT) - CAST(round(b.r * 1e9) AS BIGINT))) + count(*)) // (2 * count(*)) AS DOUBLE) / 1e9 AS g FROM cs a JOIN sym ON sym.i = a.spot JOIN cs b ON b.spot = sym.j GROUP BY 1) g ON g.spot = cs.spot)"
MASK = """t AS (SELECT quantile_cont(c, 0.8) AS tc, quantile_cont(s, 0.8) AS ts, quantile_cont(g, 0.6) AS tg FROM f),
m AS (SELECT f.*, c >= tc AS high_c, s >= ts AS high_s, g >= tg AS high_g, c >= tc AND s >= ts AND g >= tg AS interface, g >= tg AND (c >= tc OR s >= ts) AND NOT (c >= tc AND s >= ts AND g >= tg) AS diffuse FROM f, t)"""

MATRIX = ", ".join((SPOTS, CNT, PROG, DENSE, Z, CS))
GRAPH = ", ".join((MATRIX, PAIR, NN, KNN6, SYM))
FIELDS = ", ".join((GRAPH, G))
MASKS = f"{FIELDS}, {MASK}"


def comp_sql(mask: str) -> str:
    """Component of each spot that a mask keeps, by a recursive closure."""
    return f"""on_{mask} AS (SELECT spot FROM m WHERE {mask}),
in_{mask} AS (SELECT i, j FROM sym WHERE i IN (SELECT spot FROM on_{mask}) AND j IN (SELECT spot FROM on_{mask})),
re_{mask} AS (SELECT spot AS a, spot AS b FROM on_{mask} UNION SELECT x.a, y.j FROM re_{mask} x JOIN in_{mask} y ON y.i = x.b),
co_{mask} AS (SELECT c AS component, count(*) AS size FROM (SELECT a, min(b) AS c FROM re_{mask} GROUP BY 1) GROUP BY 1)"""


ADJ = """nb AS (SELECT quantile_cont(abs(r), 0.2) AS band FROM f), sg AS (SELECT spot, r, CASE WHEN r > band THEN 1 WHEN r < -band THEN -1 ELSE 0 END AS s FROM f, nb),
adj AS (SELECT avg(CAST(a.s = b.s AND a.s <> 0 AS INT)) AS adj_same_fraction, avg(CAST(a.s = 0 OR b.s = 0 AS INT)) AS adj_zero_fraction, avg(CAST(a.s * b.s = -1 AS INT)) AS adj_opposite_fraction,
  avg(CAST(a.r <= 0 AND b.r > 0 OR b.r <= 0 AND a.r > 0 AS INT)) AS r_crossing_fraction FROM e JOIN sg a ON a.spot = e.i JOIN sg b ON b.spot = e.j)"""
