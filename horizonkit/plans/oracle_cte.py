"""Shared DuckDB CTE fragments: the same role mapping as ``plans.roles``."""

STUDY = """
study AS (
  SELECT o_orderkey AS ID,
         CASE WHEN o_orderkey % 101 <> 0 THEN o_custkey END AS Name,
         o_orderdate AS exam_ts,
         CASE WHEN o_orderkey % 53 <> 0 THEN
              CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS Obito_MS,
         CASE WHEN o_orderkey % 59 <> 0 THEN CAST(2001 - year(o_orderdate) AS DOUBLE) END AS Time,
         o_totalprice, o_orderpriority
  FROM orders)"""

CLINICAL = """
clinical AS (
  SELECT CASE WHEN o_orderkey % 101 <> 0 THEN o_custkey END AS Name,
         o_orderdate AS visit_ts,
         CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS death_ts,
         l_quantity AS qty, l_discount AS disc, l_tax AS tax,
         l_orderkey AS ord_key, l_linenumber AS ord_line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MERGED = STUDY + "," + CLINICAL + """,
deaths AS (
  SELECT Name, death_ts AS death FROM (
    SELECT Name, death_ts,
           row_number() OVER (PARTITION BY Name ORDER BY ord_key, ord_line, death_ts) AS rn
    FROM clinical WHERE death_ts IS NOT NULL AND Name IS NOT NULL) t
  WHERE rn = 1),
joined AS (
  SELECT s.*, c.qty AS quantity, c.disc, c.tax
  FROM study s LEFT JOIN clinical c
    ON s.Name IS NOT DISTINCT FROM c.Name
   AND CAST(s.exam_ts AS DATE) IS NOT DISTINCT FROM CAST(c.visit_ts AS DATE)),
merged AS (
  SELECT j.ID, j.Name, j.exam_ts,
         CASE WHEN j.Obito_MS = 1 THEN d.death END AS Data_MSC,
         round(floor((epoch_us(CASE WHEN j.Obito_MS = 1 THEN d.death END) - epoch_us(j.exam_ts))
                     / 86400000000.0) / 365.25, 2) AS Tempo,
         j.quantity, j.disc, j.tax, j.Obito_MS, j.Time, j.o_totalprice, j.o_orderpriority
  FROM joined j LEFT JOIN deaths d ON j.Name = d.Name)"""

SCORES = """
scores AS (
  SELECT d.doc_id AS id, l.toxic AS label, (d.n_chars % 101) / 100.0 AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

FEATURES_LONG = """
features_long AS (
  SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label,
         'f' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, range(1, 65) r(i))"""

THRESHOLDS = """
thresholds AS (
  SELECT i, 0.01 + CAST(i - 1 AS DOUBLE) * 0.01 AS t FROM range(1, 100) r(i))"""

#: Needs ``scores`` and ``thresholds``: the threshold of best strict G-Mean in ``b``.
BEST = """
c AS (SELECT t.i, t.t,
        count_if(s.label = 1 AND s.p >= t.t) AS tp, count_if(s.label = 0 AND s.p >= t.t) AS fp,
        count_if(s.label = 1 AND s.p < t.t) AS fn, count_if(s.label = 0 AND s.p < t.t) AS tn
      FROM thresholds t, scores s GROUP BY t.i, t.t),
g AS (SELECT i, t, sqrt(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END * (tn / (tn + fp + 1e-8)))
             AS score FROM c),
b AS (SELECT * FROM g ORDER BY score DESC, i ASC LIMIT 1)"""

#: Needs predictions ``pr (label, pred)``: per-class figures in ``f``.
REPORT = """
cls AS (SELECT label AS k FROM pr UNION SELECT pred FROM pr),
per AS (
  SELECT CAST(k AS VARCHAR) AS class,
         (SELECT count(*) FROM pr WHERE label = k) AS support,
         (SELECT count(*) FROM pr WHERE label = k AND pred = k) AS tp,
         (SELECT count(*) FROM pr WHERE pred = k) AS npred FROM cls),
m AS (
  SELECT class, support, tp,
         CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0
                     THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""
